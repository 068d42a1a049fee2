"""Line dedup (operator 4): segment-partition edit join, DataFrame and SQL functions only.

A line is cut into `edits` + 1 segments; of two lines within `edits` edits, at
least one segment of the shorter stands unchanged in the longer, near its place.
The index holds the segments under the line's length and the segment's number;
lines probe it with the substrings of theirs that can match there. Lines that
meet are verified by a banded edit distance whose states, one for each number of
edits, are bit sets over the band's diagonals and advance by shifts and masks.
Where many lines share a segment, what they don't share is cut into segments
again, within that key, so that no key's lines are all paired. Lines too short
for segments meet by what is left of them without one character.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import components, dropped, lasting, maybe_in, scratch, written

EDITS = 1
#: Lines with fewer words stay as they are, unless the caller says otherwise; the query and the pipeline let every line with a word take part.
LEAST_WORDS = 5
#: Lines under one key that are paired rather than dealt by further keys.
FEW = 6
#: Segments of what the lines of such a key don't share; characters that are not cut again.
PARTS = SHORT = 8


def lines_of(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, pos, line (split at line feeds), h for lines that take part: those with that many words, of documents with an id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("pos", "line"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("line").rlike(r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (least_words - 1)))
    return rows.withColumn("h", F.xxhash64("line"))


class Slot(NamedTuple):
    """One key of a line: the index's, which lines of the same length probe as well, or one that only probes; and the line without the key's segment."""

    key: Column
    index: bool
    rest: Column


def slots_of(line: Column, n: Column, edits: int, *context: Column, least: int | None = None) -> list[Slot]:
    """The keys of a line of n characters within a context. Two lines within the edits, the shorter of more than `least` characters (as many as edits, if not given), share a key, one of them as index, and so do their rests within it."""
    least = edits if least is None else least
    out = []

    def segment(length: Column, i: int) -> tuple[Column, Column]:
        """Start (from 0) and size of segment i of a line of that length."""
        small = F.floor(length / (edits + 1)).cast("int")
        longer = length - small * (edits + 1)  # the last ones are longer by one
        short = edits + 1 - longer
        return (small * i + F.greatest(F.lit(0), F.lit(i) - short)).cast("int"), (small + (F.lit(i) >= short).cast("int")).cast("int")

    for delta in range(edits + 1):  # the other's length is less by delta
        length = n - delta
        for i in range(edits + 1):
            start, size = segment(length, i)
            left = i  # at most i edits before segment i, edits - i after it
            low, high = max(-left, delta - (edits - i)), min(left, delta + (edits - i))
            for shift in range(low, high + 1):
                at = start + shift
                key = F.xxhash64(*context, F.substring(line, at + 1, size), length, F.lit(i))
                rest = F.concat(F.substring(line, F.lit(1), at), F.substring(line, at + size + 1, n))
                out.append(Slot(F.when((length > least) & (at >= 0), key), delta == 0 and shift == 0, rest))
    return out


def short_slots(line: Column, n: Column, edits: int, *context: Column) -> list[Slot]:
    """The keys of a whole line by which it meets lines of at most `edits` characters, which have no segments. Those are all within the edits of each other; a longer line has at most twice as many characters and shares one of them."""
    short = n <= edits
    out = [Slot(F.when(short, F.xxhash64(*context, F.lit("short"), F.lit(edits))), True, line)]
    for i in range(2 * edits):
        key = F.xxhash64(*context, F.lit("short"), F.lit(edits), F.substring(line, i + 1, 1))
        if i < edits:
            out.append(Slot(F.when(short & (n > i), key), True, line))
        out.append(Slot(F.when(~short & (n <= 2 * edits) & (n > i), key), False, line))
    return out


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _alike(x: Column, y: Column, most: Column, end: bool) -> Column:
    """How many characters, up to `most`, x and y share from the start (or the end), by halving."""

    def grow(got: Column, power: Column) -> Column:
        more = (got + F.call_function("shiftleft", F.lit(1), power)).cast("int")
        part = [F.substring(s, -more if end else F.lit(1), more) for s in (x, y)]
        return F.when((more <= most) & (part[0] == part[1]), more).otherwise(got)

    powers = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1))
    return F.aggregate(powers, F.lit(0), grow)


#: Characters after which a band that no state has reached is given up.
_HEAD = 16


def _banded(a: Column, b: Column, n: Column, m: Column, edits: int) -> Column:
    """within_edits of strings of n and m characters, without a search for shared ends."""
    width = 2 * edits + 1
    mask = (1 << width) - 1
    start = [sum(1 << (edits + d) for d in range(e + 1)) for e in range(edits + 1)]
    first = F.struct(*[F.lit(s).cast("int").alias(f"e{e}") for e, s in enumerate(start)])
    gap = F.array_repeat(F.lit(None).cast("string"), edits)
    chars = F.struct(F.split(a, "").alias("x"), (F.concat(gap, F.split(b, "")) if edits else F.split(b, "")).alias("y"))

    def band(c: Column, begin: int, size: Column) -> Column:
        """a's characters, each beside those of b within the band."""
        return F.arrays_zip(F.slice(c["x"], begin, size).alias("c"), *[F.slice(c["y"], begin + d, size).alias(f"y{d}") for d in range(width)])

    def step(state: Column, at: Column) -> Column:
        same = None
        for d in range(width):  # place j of a against place j + d - edits of b
            bit = F.when(at[f"y{d}"] == at["c"], 1 << d).otherwise(0)
            same = bit if same is None else same.bitwiseOR(bit)
        new: list[Column] = []
        for e in range(edits + 1):
            r = state[f"e{e}"].bitwiseAND(same)
            if e:
                before = state[f"e{e - 1}"]
                r = r.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1)).bitwiseAND(F.lit(mask))
            new.append(r.cast("int"))
        return F.struct(*[v.alias(f"e{e}") for e, v in enumerate(new)])

    def rest(c: Column, state: Column) -> Column:
        done = F.when((n > _HEAD) & (state[f"e{edits}"] != 0), F.aggregate(band(c, 1 + _HEAD, F.greatest(n - _HEAD, F.lit(0))), state, step)).otherwise(state)
        return F.call_function("shiftright", done[f"e{edits}"], F.greatest(m - n + edits, F.lit(0)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return (F.abs(m - n) <= edits) & _bind(chars, lambda c: _bind(F.aggregate(band(c, 1, F.least(n, F.lit(_HEAD))), first, step), lambda state: rest(c, state)))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most `edits` (up to 5). Shared starts and ends are cut off; the rest of a is read a character at a time; bit d of state e says that with e edits the band's diagonal d - edits is reached."""

    def middle(v: Column) -> Column:
        def after(p: Column) -> Column:
            cut = F.struct(F.substring(v["x"], p + 1, v["n"] - p).alias("x"), F.substring(v["y"], p + 1, v["m"] - p).alias("y"), (v["n"] - p).alias("n"), (v["m"] - p).alias("m"))
            return _bind(cut, lambda w: _bind(_alike(w["x"], w["y"], F.least(w["n"], w["m"]), True), lambda q: between(w, q)))

        def between(w: Column, q: Column) -> Column:
            own = F.struct(F.substring(w["x"], F.lit(1), w["n"] - q).alias("x"), F.substring(w["y"], F.lit(1), w["m"] - q).alias("y"), (w["n"] - q).alias("n"), (w["m"] - q).alias("m"))
            return _bind(own, lambda r: _banded(r["x"], r["y"], r["n"], r["m"], edits))

        return (F.abs(v["n"] - v["m"]) <= edits) & _bind(_alike(v["x"], v["y"], F.least(v["n"], v["m"]), False), after)

    return _bind(F.struct(a.alias("x"), b.alias("y"), F.char_length(a).alias("n"), F.char_length(b).alias("m")), middle)


def _verified(pairs: DataFrame, text: DataFrame, edits: int) -> DataFrame:
    """Those of pairs (a, b) of line hashes whose lines, of text (h, line), are within the edits."""
    both = pairs.join(text.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")
    return both.where(within_edits(F.col("x"), F.col("y"), edits)).select("a", "b")


# -- keys of lines and, within a key of many lines, of what they don't share --

#: Roles under a key: one line of a pair is BOTH, SAME or INDEX; a PROBE is the longer line of a pair.
BOTH, PROBE, SAME, INDEX = range(4)
#: What is done with a key's lines: cut again if they are many; all linked to the first; paired in full.
CUT, STAR, FULL = range(3)


def _keys(part: Column, n: Column, role: Column, context: Column) -> list[Column]:
    """Arrays of (key, role, kind, part) for one edit: whatever is within it shares a key.

    The edit lies in one of PARTS segments of the shorter text, and all others are equal: the key is what stands around that segment, which is the next part. Up to SHORT characters, the key is what is left without one character, and all under it are within the edit of each other. Lines of one length (SAME) and of lengths that differ by one (INDEX, PROBE) have keys of their own.
    """

    def cut(length: Column, i: Column) -> tuple[Column, Column]:
        small = F.floor(length / PARTS).cast("int")
        short = F.lit(PARTS) - (length - small * PARTS).cast("int")  # the last ones are longer by one
        return (small * i + F.greatest(F.lit(0), i - short)).cast("int"), (small + (i >= short).cast("int")).cast("int")

    def row(key: Column, as_: int, kind: int, rest: Column | None = None) -> Column:
        return F.struct(key.alias("key"), F.lit(as_).alias("role"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if rest is None else rest).alias("part"))

    def without(i: Column) -> Column:
        return F.concat(F.substring(part, F.lit(1), i), F.substring(part, i + 2, n))

    def around(length: Column, more: int, tag: str, as_: int) -> Callable[[Column], Column]:
        def of(i: Column) -> Column:
            at, size = cut(length, i)
            size = size + more
            return row(F.xxhash64(context, F.lit(tag), length, i, F.substring(part, F.lit(1), at), F.substring(part, at + size + 1, n)), as_, CUT, F.substring(part, at + 1, size))

        return of

    each, none = F.sequence(F.lit(0), F.lit(PARTS - 1)), F.array().cast("array<struct<key: bigint, role: int, kind: int, part: string>>")
    same, index, probe = role.isin(BOTH, SAME), role.isin(BOTH, INDEX), role == PROBE
    holes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return [
        F.when(same & (n <= SHORT), F.transform(holes, lambda i: row(F.xxhash64(context, F.lit("s"), i, n, without(i)), SAME, STAR))).otherwise(none),
        F.when(same & (n > SHORT), F.transform(each, around(n, 0, "s", SAME))).otherwise(none),
        F.when(index & (n <= SHORT), F.array(row(F.xxhash64(context, F.lit("t"), n, part), INDEX, STAR))).otherwise(none),
        F.when(index & (n > SHORT), F.transform(each, around(n, 0, "i", INDEX))).otherwise(none),
        F.when(probe & (n <= SHORT + 1), F.transform(holes, lambda i: row(F.xxhash64(context, F.lit("t"), n - 1, without(i)), PROBE, STAR))).otherwise(none),
        F.when(probe & (n > SHORT + 1), F.transform(each, around(n - 1, 1, "i", PROBE))).otherwise(none),
    ]


def _slot_rows(slots: list[Slot], kind: int) -> Column:
    """Slots as an array of (key, role, kind, part)."""
    return F.array(*[F.struct(s.key.alias("key"), F.lit(BOTH if s.index else PROBE).alias("role"), F.lit(kind).alias("kind"), s.rest.alias("part")) for s in slots])


def _deeper(members: DataFrame, edits: int) -> DataFrame:
    """Keys of the parts of members (key, h, role, part) within their key."""
    rows = members.withColumn("n", F.char_length("part"))
    part, n = F.col("part"), F.col("n")
    if edits == 1:
        keys = _keys(part, n, F.col("role"), F.col("key"))
    else:
        keys = [_slot_rows(slots_of(part, n, edits, F.col("key")), CUT), _slot_rows(short_slots(part, n, edits, F.col("key")), FULL)]
    rows = rows.select("h", F.explode(F.concat(*keys)).alias("k")).select("h", "k.*")
    return rows.where("key is not null").select("key", "h", "role", "kind", "part")


def keyed_lines(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, pos, h of the lines that take part, their keys (k0, k1, ...) and, of lines too short for segments, the line."""
    rows = lines_of(docs, least_words).withColumn("n", F.char_length("line"))
    slots = slots_of(F.col("line"), F.col("n"), edits, least=_least(edits))
    return rows.select("doc_id", "pos", "h", *[s.key.alias(f"k{j}") for j, s in enumerate(slots)], F.when(F.col("n") <= _least(edits) + edits, F.col("line")).alias("short"))


def _least(edits: int) -> int:
    """Lines of up to so many characters have no segments."""
    return SHORT if edits == 1 else edits


def _whole(once: DataFrame, edits: int) -> DataFrame:
    """Keys of whole lines: key, h, role, kind, slot (of segments: its number)."""
    slots = slots_of(F.lit(""), F.lit(0), edits)
    each = F.array(*[F.struct(F.col(f"k{j}").alias("key"), F.lit(BOTH if s.index else PROBE).alias("role"), F.lit(CUT).alias("kind"), F.lit(j).alias("slot")) for j, s in enumerate(slots)])
    part, n = F.col("short"), F.char_length("short")
    if edits == 1:
        short = F.concat(*[k for role, most in ((BOTH, SHORT), (PROBE, SHORT + 1)) for k in _keys(part, n, F.when(n <= most, F.lit(role)), F.lit(0))])
    else:
        short = _slot_rows(short_slots(part, n, edits, F.lit(0)), FULL)
    short = F.transform(short, lambda x: F.struct(x["key"], x["role"], x["kind"], F.lit(-1).alias("slot")))
    both = F.when(n.isNull(), each).when(n <= _least(edits), short).otherwise(F.concat(each, short))
    return once.select("h", F.explode(both).alias("k")).select("k.key", "h", "k.role", "k.kind", "k.slot").where("key is not null")


def _members(keyed: DataFrame) -> DataFrame:
    """The rows of keys under which a line may meet another, with the key's first line but probes as lead and the number of its lines."""
    ends = keyed.groupBy("key").agg(F.min(F.when(F.col("role") != PROBE, F.col("h"))).alias("lead"), F.min("h").alias("_lo"), F.max("h").alias("_hi"), F.min("role").alias("_role"), F.count(F.lit(1)).alias("n"))
    shared = written(ends.where(f"lead is not null and _lo <> _hi and _role <> {INDEX}").select("key", "lead", "n"))
    out = written(maybe_in(keyed, shared, "key").join(shared, "key"))
    dropped(shared)
    return out


def _candidates(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines under one key: with its first line, or all pairs of keys with few lines."""
    star = members.where(f"kind = {STAR} and h <> lead").select(F.col("h").alias("a"), F.col("lead").alias("b"))
    few = members.where(f"kind = {CUT} and n <= {FEW}").groupBy("key").agg(F.collect_list(F.struct("h", "role")).alias("m"))
    x, y = F.col("p.x"), F.col("p.y")
    few = few.select(F.explode(F.flatten(F.transform("m", lambda v: F.transform("m", lambda w: F.struct(v.alias("x"), w.alias("y")))))).alias("p"))
    few = few.where((x["h"] < y["h"]) & ((x["role"] != PROBE) | (y["role"] != PROBE)) & ((x["role"] != INDEX) | (y["role"] != INDEX)))
    out = star.union(few.select(x["h"].alias("a"), y["h"].alias("b")))
    return out


def line_classes(docs: DataFrame, rows: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Of lines that equal, or are linked to, others: h and class (a line hash). rows: keyed_lines of docs. Lines linked to none but themselves have no row.

    Up to FEW lines under one key are paired. The lines of other keys are cut again within that key, by what they don't share, and so on, until few are left under a key or a part has at most SHORT characters; there the lines that equal but for one character are linked to the first of them. So work grows with the lines of a key and the logarithm of their length, not with their pairs, however many share a segment. With more than one edit, parts of at most 2 * `edits` characters that share one are paired in full; such lines are bounded by the alphabet.
    """
    # equal lines once, so that a frequent line is one member of its keys
    keys = [c for c in rows.columns if c[0] == "k"]
    once = written(rows.groupBy("h").agg(*[F.min(c).alias(c) for c in [*keys, "short"]]))
    members = _members(_whole(once, edits))
    ids = written(members.select("h").distinct())
    lines = lines_of(docs, least_words).select("h", "line")
    text = written(maybe_in(lines, ids, "h").join(ids, "h", "left_semi").groupBy("h").agg(F.min("line").alias("line")))
    dropped(once, ids)
    found = []
    level = 0
    while True:
        pairs = _candidates(members)
        if edits > 1:
            one = members.where(f"kind = {FULL} and role = {BOTH}").select("key", F.col("h").alias("a"))
            pairs = pairs.union(one.join(members.where(f"kind = {FULL}").select("key", F.col("h").alias("b")), "key").where("a <> b").select("a", "b"))
        found.append(written(pairs.distinct()))
        more = members.where(f"kind = {CUT} and n > {FEW}")
        if level == 0:
            line = F.col("line")
            cut = F.coalesce(*[F.when(F.col("slot") == j, s.rest) for j, s in enumerate(slots_of(line, F.char_length("line"), edits))])
            more = more.join(text, "h").select("key", "h", "role", cut.alias("part"))
        kids = written(_deeper(more, edits))
        dropped(members)
        if kids.isEmpty():
            dropped(kids)
            break
        members = _members(kids)
        dropped(kids)
        level += 1
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.union(x)
    links = written(_verified(pairs.distinct(), text, edits))
    dropped(text, *found)
    comp = components(links)
    return comp.select(F.col("id").alias("h"), F.col("comp").alias("class"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id and pos of lines that go: of equal and linked lines, all but the first by doc_id and place."""
    with scratch():
        rows = written(keyed_lines(docs, edits, least_words))
        classes = written(line_classes(docs, rows, edits, least_words))
        # the first of each line, then of each class: what stays is one row a class, so a frequent line is never gathered
        first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first")).join(classes, "h", "left")
        stay = first.groupBy(F.coalesce("class", "h").alias("class")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"))
        gone = lasting(rows.select("doc_id", "pos").join(stay, ["doc_id", "pos"], "left_anti").groupBy("doc_id").agg(F.collect_set("pos").alias("at")))
    return gone


def without_lines(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """row (docs' own columns), text (what remains of it), lines and gone: its lines and those that went."""
    gone = repeated_lines(docs, edits, least_words).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"))
    split = F.split(F.col("row.text").cast("string"), "\n", -1)
    count = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(split)).alias("lines")
    hit = maybe_in(rows, gone.withColumnRenamed("id", "key"), "key").join(gone.hint("merge"), F.col("key") == F.col("id"), "left")  # the places grow with the input: never broadcast
    rest = maybe_in(rows, gone.withColumnRenamed("id", "key"), "key", how="left_anti")
    # places that stay, by one pass over either array; a row that repeats an id may have fewer lines than the places tell
    stay = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("at"))
    kept = _bind(split, lambda all_: F.struct(F.array_join(F.transform(stay(all_), lambda i: F.get(all_, i)), "\n").alias("text"), (F.size(all_) - F.size(stay(all_))).alias("gone")))
    hit = hit.select("row", count, F.when(F.col("at").isNotNull() & F.col("row.text").isNotNull(), kept).alias("kept"))
    hit = hit.select("row", F.coalesce("kept.text", F.col("row.text").cast("string")).alias("text"), "lines", F.coalesce("kept.gone", F.lit(0)).alias("gone"))
    return hit.unionByName(rest.select("row", F.col("row.text").cast("string").alias("text"), count, F.lit(0).alias("gone")))


def dedup(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs, with all columns, whatever their names, without the lines that go; a document that loses all its lines goes too.

    Lines are split at line feeds and take part with that many words or more; others stay. Linked lines form groups, of which the first by doc_id and place stays; a chain of links is one group. Null and empty texts stay as they are, as do documents without an id. Rows that repeat an id are taken to be one document: a place that goes does so in each of them. Very long texts are split whole; a line of any length takes part. Empty input: no rows.
    """
    out = without_lines(docs, edits, least_words).where("gone = 0 or gone < lines")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, edits: int = EDITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_removed, kept_sha256 (of the remaining lines, joined by line feeds). Edge cases as for dedup."""
    out = without_lines(docs.select("doc_id", "text"), edits, least_words)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("lines").cast("long").alias("n_lines"), F.col("gone").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
