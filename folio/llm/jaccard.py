"""N-gram Jaccard join (operator 3): count-vector R-tree.

A document is the set of its word shingles. Shingles are hashed into groups, and
the counts of its groups are the document's point. For two sets, the sum over
groups of the smaller count bounds the overlap, and the same sum over the upper
corners of two boxes bounds it for all documents inside.

The upper levels of the tree are spread over the cluster. A pair within the
threshold differs in at most D shingles, so of D + 1 slices of the groups at least
one has the same counts in both: points are dealt by their slices' counts, boxes
of no extent, and only documents that share one meet. (A slice that is empty in
both tells nothing and is not indexed; a set that leaves too many empty is dealt
again into more slices, until more of them hold a shingle than a pair can differ
in, so that one of those is the same in both. Of the keys a set need not index,
the most frequent are left out.) Documents that meet, directly or through others,
form a subtree; it is cut into leaves, and leaf pairs are searched down nested
boxes of NODE children to points, and surviving pairs verified on the sets. What is
emitted is a spanning forest of each leaf pair, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import batch_bytes, components, lasting, maybe_in, mix, raw, released, scratch, word_hashes, written

#: Groups of a point in the leaves; documents of an inner box; documents of a leaf.
GROUPS, NODE, LEAF = 256, 16, 256
#: Documents of a subtree that is searched without being compared with its first ones before.
LARGE = 4 * LEAF
#: Groups of a slice: so many that slices of few shingles seldom have the same counts by chance.
_SLICE_GROUPS = 1 << 20
#: Ratio of the sizes in a class, as a power of that between partners; slices, as a multiple of those needed.
_CLASS, _SPARE = 4, 1.15
_SPREAD = np.uint64(0xD1342543DE82EF95)
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `words` words of the ASCII-lower-cased text; of all words, if they are fewer; none without words."""
    h = word_hashes(np.frombuffer(raw(text).lower(), np.uint8))
    n = len(h)
    if not n:
        return h
    k = min(words, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * _A + h[i : n - k + 1 + i] * _B)
    return np.unique(out)


def most_apart(total: int, percent: int) -> int:
    """The most shingles in which sets within the threshold differ, from the sum of their sizes."""
    return (100 - percent) * total // (100 + percent)


def slice_rounds(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """Rounds of hashes of the slices' counts, each with the most keys in which it may differ from that of a partner, and one. Sizes are dealt into classes, and a set's slices are made as for the largest pair of its class and, where a larger partner may lie there, of the next.

    In a class, a set is dealt by one round after another, each with more slices, up to the first in which more slices hold a shingle than it and any partner there can differ in. Of a pair, both have the round in which the earlier one stops, and of the slices that one fills at least one is untouched by what differs. At 50 percent and below no round need be enough, and each shingle is a key.
    """
    n = len(s)
    if not n:
        return []
    if percent <= 50:
        return [(n, mix(s + _A))]
    ratio = (100 / percent) ** _CLASS
    level = 0
    while n >= int(np.ceil(ratio ** (level + 1))):
        level += 1
    out = []
    for c in (level, level + 1):
        top = int(np.ceil(ratio ** (c + 1))) - 1
        if c > level and 100 * n < percent * (int(np.ceil(ratio**c))):
            break
        m = int(np.ceil(_SPARE * (most_apart(2 * top, percent) + 1)))
        enough = most_apart(n + min(top, 100 * n // percent), percent) + 1
        filled, turn = 0, 0
        while filled < enough:
            h = mix(s + np.uint64(turn * int(_A) & (1 << 64) - 1)) if turn else s
            place = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            weight = mix(((mix(h ^ _B) & np.uint64(_SLICE_GROUPS - 1)) + np.uint64(1)) * _SPREAD)  # a slice's sum of these tells its counts
            if turn:
                order = np.argsort(place, kind="stable")
                place, weight = place[order], weight[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            out.append((enough, mix(np.add.reduceat(weight, first) + mix(place[first] * _A + np.uint64((1 + 64 * c + turn) * int(_B) & (1 << 64) - 1)))))
            filled, turn, m = len(first), turn + 1, m + m // 2 + 1
    return out


def slice_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The keys of all rounds; sets within the threshold share one."""
    return np.concatenate([np.zeros(0, np.uint64), *[keys for _, keys in slice_rounds(s, percent)]])


def sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, n_shingles, two hashes of the set, and the rounds of its slices: `spare` (keys that need not be indexed) and keys."""
    batch_bytes(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            n, h1, h2, spare, keys, at, rounds = [], [], [], [], [], [0], [0]
            for text in batch.column(1):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                h1.append(int(np.bitwise_xor.reduce(mix(s * _A))) if len(s) else 0)
                h2.append(int(mix(s ^ _B).sum(dtype=np.uint64)) if len(s) else 0)
                for most, k in slice_rounds(s, percent):
                    spare.append(len(k) - most)
                    keys.append(k)
                    at.append(at[-1] + len(k))
                rounds.append(len(spare))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            each = pa.StructArray.from_arrays([pa.array(spare, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))], ["spare", "keys"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(rounds, pa.int32()), each)], names=["doc_id", "n_shingles", "h1", "h2", "rounds"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, "doc_id long, n_shingles long, h1 long, h2 long, rounds array<struct<spare: int, keys: array<long>>>")


def _tree(rows: np.ndarray, points: np.ndarray, size: np.ndarray) -> list:
    """Nested boxes over rows: [upper corner, least and most size, children]; children are boxes or, at the bottom, rows."""
    rows = rows[np.lexsort((points[rows, 0], size[rows]))]
    level = [[points[r].max(0), size[r].min(), size[r].max(), r] for r in (rows[i : i + NODE] for i in range(0, len(rows), NODE))]
    while len(level) > 1:
        level = [[np.max([n[0] for n in part], 0), min(n[1] for n in part), max(n[2] for n in part), part] for part in (level[i : i + NODE] for i in range(0, len(level), NODE))]
    return level[0]


def _points(found: list[np.ndarray]) -> np.ndarray:
    """The counts of the groups of each set."""
    out = np.zeros((len(found), GROUPS), np.int32)
    for i, s in enumerate(found):
        out[i] = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _search(ids: np.ndarray, found: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Forest edges between the rows left and right (the same, or apart): down two trees, from boxes to points to sets. known: a label of each row; rows of one label need no edge."""
    if not len(left) or not len(right):
        return []
    size = np.array([len(s) for s in found])
    points = _points(found)
    parent = list(range(len(found)))
    if known is not None:
        first: dict[int, int] = {}
        parent = [first.setdefault(int(k), i) for i, k in enumerate(known)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    a = _tree(left, points, size)
    todo = [(a, a if left is right else _tree(right, points, size))]
    while todo:
        x, y = todo.pop()
        if 100 * x[2] < percent * y[1] or 100 * y[2] < percent * x[1]:
            continue
        if (100 + percent) * np.minimum(x[0], y[0]).sum() < percent * (x[1] + y[1]):
            continue
        if isinstance(x[3], list) or isinstance(y[3], list):
            if x is y:
                todo += [(u, v) for k, u in enumerate(x[3]) for v in x[3][k:]]
            else:
                todo += [(u, v) for u in (x[3] if isinstance(x[3], list) else [x]) for v in (y[3] if isinstance(y[3], list) else [y])]
            continue
        bound = np.minimum(points[x[3]][:, None, :], points[y[3]][None, :, :]).sum(2)
        near = (100 + percent) * bound >= percent * (size[x[3]][:, None] + size[y[3]][None, :])
        for p, q in zip(*np.nonzero(near), strict=True):
            i, j = int(x[3][p]), int(y[3][q])
            if i != j and (ri := root(i)) != (rj := root(j)) and _linked(found[i], found[j], percent):
                parent[ri] = rj
                edges.append((int(ids[i]), int(ids[j])))
    return edges


def join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Null, empty and blank texts have no shingles and link with nothing. Rows without an id give a row with a null component. Rows that repeat an id give a row each; what any of them links to counts for the id. Empty input: no rows.
    """
    own = written(sets(docs, words, percent))
    small = own.select("doc_id", "n_shingles", "h1", "h2")
    with scratch():
        known = small.where("n_shingles > 0 and doc_id is not null")
        classes = known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"))
        copies = written(known.join(classes, ["h1", "h2", "n_shingles"]).where("doc_id <> rep").select("doc_id", "h1", "h2", "rep").distinct())
        # a key's documents meet its smallest; copies of another set stay out
        firsts = own.where("doc_id is not null").select("doc_id", "h1", "h2", "rounds")
        firsts = maybe_in(firsts, copies, how="left_anti").union(maybe_in(firsts, copies).join(copies, ["doc_id", "h1", "h2"], "left_anti"))
        # most keys occur once: they are counted alone, and only the ids of others travel
        often = written(firsts.select(F.explode(F.flatten("rounds.keys")).alias("key")).groupBy("key").count().where("count > 1"))
        each = firsts.select("doc_id", "h1", "h2", F.posexplode("rounds").alias("round", "r"))
        each = each.select("doc_id", F.xxhash64("h1", "h2").alias("own"), "round", "r.spare", F.explode("r.keys").alias("key"))
        hits = _rarest(maybe_in(each, often, "key").join(often, "key"))
        hits = written(hits.select("key", "doc_id").distinct())
        leads = hits.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead <> last").select("key", "lead")
        pairs = written(hits.join(leads, "key").where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct())
        met = written(components(pairs))
        edges = written(_verified(docs, met, pairs, hits, words, percent))
        linked = lasting(components(edges.union(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))))
    out = small.select("doc_id", "n_shingles").join(linked.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def _rarest(hits: DataFrame) -> DataFrame:
    """Of the keys that a set shares with others (doc_id, own, round, spare, key, count), the rarest, and so many that partners still share one.

    A round may differ from a partner's in all its keys but `spare` and one. In one order of all keys, from rare to frequent, the first key that both have is therefore among the first of either; the last `spare` need not be indexed, and those that occur once come first and meet nothing. A set that shares no more than `spare` keys has no partner. So what many documents share, a passage or a template, seldom makes them meet.
    """
    by = Window.partitionBy("doc_id", "own", "round")
    rank = F.row_number().over(by.orderBy("count", "key"))
    return hits.withColumn("_rank", rank).withColumn("_n", F.count(F.lit(1)).over(by)).where("_rank <= _n - spare")


def _verified(docs: DataFrame, met: DataFrame, pairs: DataFrame, hits: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) that link what is linked within the subtrees of met (id, comp).

    Subtrees of up to LARGE documents are searched as they are. The documents of larger ones are first compared with those they meet (pairs), a leaf at a time, so that a large group of near copies is linked in linear work; only keys (of hits) that still hold several components are searched, each by itself.
    """
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    sizes = met.groupBy("comp").count()
    sized = written(met.join(sizes, "comp").select(F.col("id").alias("doc_id"), "comp", "count"))
    out = _leaf_pairs(texts, sized.where(f"count <= {LARGE}").select("doc_id", "comp", "count", F.col("doc_id").alias("known")), words, percent)
    large = sized.where(f"count > {LARGE}").select("doc_id")
    if large.isEmpty():
        return out
    near = written(_with_leads(texts, pairs.join(large.withColumnRenamed("doc_id", "a"), "a"), words, percent))
    comp = written(components(near))
    told = hits.join(large, "doc_id").join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("comp", "doc_id").alias("known"))
    told = written(told)
    mixed = told.groupBy("key").agg(F.min("known").alias("_lo"), F.max("known").alias("_hi"), F.count(F.lit(1)).alias("count")).where("_lo <> _hi").select("key", "count")
    rest = told.join(mixed, "key").select("doc_id", F.col("key").alias("comp"), "count", "known")
    return out.union(near).union(_leaf_pairs(texts, rest, words, percent))


def _with_leads(texts: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) that are linked. The documents of one b are dealt to tasks of about LEAF, each of which has b's text."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / LEAF).cast("int").alias("n"))
    dealt = pairs.join(parts, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("n")).cast("int").alias("part"))
    leads = parts.select(F.col("b").alias("doc_id"), "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"))
    both = written(dealt.union(leads))
    rows = maybe_in(texts, both.select("doc_id").distinct()).join(both, "doc_id")

    def search(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        own = int(table["b"][0].as_py())
        found = [shingles(t.as_py(), words) for t in table["text"]]
        heads = np.flatnonzero(ids == own)
        out = [int(i) for h in heads for i, s in zip(ids, found, strict=True) if i != own and _near(s, found[h], percent)]
        return pa.table({"a": pa.array(out, pa.int64()), "b": pa.array([own] * len(out), pa.int64())})

    return rows.groupBy("b", "part").applyInArrow(search, "a long, b long")


def _near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether sets are linked; their points' bound first."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    p = _points([a, b])
    return (100 + percent) * int(np.minimum(p[0], p[1]).sum()) >= percent * (len(a) + len(b)) and _linked(a, b, percent)


def _leaf_pairs(texts: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Forest edges within groups (doc_id, comp, count, known): each is cut into leaves of about LEAF documents, and every two leaves are searched in one task; small groups share tasks."""
    total = groups.where(f"count <= {LEAF}").count()
    tasks = max(1, -(-total // (8 * LEAF)))
    leaves = groups.withColumn("n", F.ceil(F.col("count") / LEAF).cast("int"))
    leaves = leaves.select("doc_id", "comp", "known", "n", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int").alias("own"))
    leaves = leaves.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    one = F.col("n") == 1
    leaves = leaves.select("doc_id", "known", "comp", "own", F.least("own", "_j").alias("i"), F.greatest("own", "_j").alias("j"), F.when(one, F.pmod(F.xxhash64("comp"), F.lit(tasks))).otherwise(F.xxhash64("comp", F.least("own", "_j"), F.greatest("own", "_j"))).alias("task"))
    leaves = written(leaves)
    rows = maybe_in(texts, leaves.select("doc_id").distinct()).join(leaves, "doc_id")

    def search(table: pa.Table) -> pa.Table:
        ids, known, comp, own, i, j = (table[c].to_numpy() for c in ("doc_id", "known", "comp", "own", "i", "j"))
        text = table["text"]
        edges: list[tuple[int, int]] = []
        order = np.lexsort((ids, j, i, comp))
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(comp[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0), [True]))) if len(order) else []
        for a, b in zip(cut, cut[1:], strict=False):
            rows = order[a:b]
            found = [shingles(text[int(r)].as_py(), words) for r in rows]
            full = np.array([len(s) > 0 for s in found])  # a row that repeats an id may have no words
            side = own[rows]
            left = np.flatnonzero((side == i[rows[0]]) & full)
            right = left if i[rows[0]] == j[rows[0]] else np.flatnonzero((side == j[rows[0]]) & full)
            edges += _search(ids[rows], found, left, right, percent, known[rows])
        x, y = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return rows.groupBy("task").applyInArrow(search, "a long, b long")


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, whose id is the smallest of its component; rows without an id or without words stay.

    Edge cases as for join; rows that repeat an id stay or go together. Empty input: no rows.
    """
    gone = written(join(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    ids = gone.withColumnRenamed("_gone", "doc_id")
    hit = maybe_in(docs, ids)
    rest = maybe_in(docs, ids, how="left_anti")  # their texts need no shuffle
    return rest.unionByName(hit.join(gone, hit["doc_id"] == gone["_gone"], "left_anti"))
