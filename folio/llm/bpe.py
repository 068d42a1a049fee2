"""Token counts (operator 10) and token ids with a byte-level BPE vocabulary.

A text is cut at its spaces into units that never share a token. Per distinct
unit, a dynamic program over prefixes gives the last token of each prefix's
encoding, and from it the exact number of tokens of each prefix: appending
token t to the encoding of a prefix is right exactly if t and the token before
it stay apart when encoded together. The table of a document is the join of its
units' tables, one signed byte for each character: the running sum at i is the
number of tokens of the first i characters, so truncation and budget questions
need no further encoding.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.common import batch_bytes, released

#: Units kept in a worker's memory; beyond that it starts anew.
CACHE_UNITS = 800_000
#: Prefixes of pieces whose state is kept.
CACHE_PREFIXES = 250_000
SPECIAL = re.compile(r"<\|endoftext\|>")
_RUN = re.compile(r"[^\S\x1c-\x1f]{2,}(?=[\S\x1c-\x1f])")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.A)
_CUT = re.compile(r" (?=\S)")


def _unicode_bytes() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ends(ranks: dict[bytes, int]) -> dict:
    """The tokens as nested tables by their bytes from last to first, each with the id of the token that is complete there, if any."""
    top: list = [None, {}]
    for token, rank in ranks.items():
        node = top
        for b in reversed(token):
            node = node[1].setdefault(b, [None, {}])
        node[0] = rank
    return top[1]


_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def _changes(counts: list[int]) -> bytes:
    """Signed bytes; single tokens hold up to 128 spaces, so a run's count changes by little from one prefix to the next."""
    out = np.diff(np.array(counts, np.int64))
    if len(out) and (out.min() < -128 or out.max() > 127):
        raise ValueError("a prefix's count changes by more than a signed byte holds")
    return out.astype(np.int8).tobytes()


class Units(dict):
    """Of a word without its leading space: what `make` gives for the unit of space and word. None for a word which needs its neighbours."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= CACHE_UNITS:
            self.clear()
        if not word or word[0].isspace() or word[-1].isspace():
            value = None
        else:
            value = self.make(" " + word)
        if len(word) <= 64:
            self[word] = value
        return value


class Coder:
    """Encodes as the tokenizers library does with the same file."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path))
        stand, added = _unicode_bytes(), {t["content"] for t in spec["added_tokens"]}
        self.ranks = {bytes(stand[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.names = {i: t for t, i in self.ranks.items()}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.single = self.fast._core_bpe.encode_single_piece
        self.prefixes: dict[bytes, tuple] = {}
        self.pieces_seen: dict[str, bytes] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.ids = Units(self.unit_ids)
        self.tables = Units(self.unit_table)

    @cached_property
    def ends(self) -> dict:
        return _ends(self.ranks)  # for prefix counts alone: ids, as packing has them, do without

    def encode(self, unit: str) -> list[int]:
        if unit.isascii() and "<|" not in unit or not SPECIAL.search(unit) and max(unit, default="") < "ɐ":
            return self.fast.encode_ordinary(unit)
        return self.library.encode(unit, add_special_tokens=False).ids

    # -- ids --

    def unit_ids(self, unit: str) -> bytes:
        if unit[1:].isalpha() and unit[-1] < "ɐ" and max(unit) < "ɐ":
            ids = self.single(unit.encode()) if unit[0] == " " or unit[0].isalpha() else self.encode(unit)
        else:
            ids = self.encode(unit)
        return struct.pack(f"<{len(ids)}I", *ids)

    def text_ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        return self._joined(text, self.ids, self.unit_ids)

    def _joined(self, text: str, units: Units, make) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if first and not first[-1].isspace():
            try:
                return b"".join([make(first), *map(units.__getitem__, rest)])
            except TypeError:  # white space beside white space: cut only before the last of it
                pass
        cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
        return b"".join(make(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b)

    # -- prefix counts --

    def stays_apart(self, a: int, b: int) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            found = self.apart[a, b] = self.single(self.names[a] + self.names[b]) == [a, b]
        return found

    def piece_table(self, piece: str) -> bytes:
        """Changes of the token count at each prefix, by character, of a piece that the library encodes on its own.

        States of prefixes are kept, with their part of the table: what is known of one serves all pieces that begin with it. The last token of a prefix is unique, so the search begins with the short ones; it reads back from the prefix's end, in the tokens by their bytes from last to first.
        """
        found = self.pieces_seen.get(piece)
        if found is not None:
            return found
        p = piece.encode()
        n, get, apart, known, ends = len(p), self.ranks.get, self.apart.get, self.prefixes, self.ends
        if len(known) > CACHE_PREFIXES:
            known.clear()
        keep, counts, last, i = n <= 48, [], [], n if n <= 48 else 0
        if keep:
            while i and (state := known.get(p[:i])) is None:
                i -= 1
            if i:
                counts, last = [*state[0]], [*state[1]]
        for i in range(i + 1, n + 1):
            more, j = ends, i - 1
            while j and (node := more.get(p[j])) is not None:
                t, more = node
                if t is not None:
                    before = last[j - 1]
                    ok = apart((before, t))
                    if ok or ok is None and self.stays_apart(before, t):
                        counts.append(counts[j - 1] + 1)
                        last.append(t)
                        break
                j -= 1
            else:
                counts.append(1)
                last.append(get(p[:i]))
        if keep:
            known[p] = (tuple(counts), tuple(last))
            for k in (n // 2, n - 2):
                if k > 3 and p[:k] not in known:
                    known[p[:k]] = (tuple(counts[:k]), tuple(last[:k]))
        if n != len(piece):
            counts = [c for c, b in zip(counts, [*p[1:], 0], strict=True) if b & 0xC0 != 0x80]
        out = bytes([d & 255 for d in map(sub, counts, [0, *counts[:-1]])])
        if n <= 64:
            if len(self.pieces_seen) >= CACHE_UNITS // 2:
                self.pieces_seen.clear()
            self.pieces_seen[piece] = out
        return out

    def pieces(self, unit: str) -> list[str]:
        if unit.isascii():
            return _ASCII_PIECES.findall(unit)
        return [unit[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(unit)]

    def unit_table(self, unit: str) -> bytes:
        """The table of a unit of a text."""
        if "<|" in unit and SPECIAL.search(unit):
            return self._with_special(unit)
        if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():
            return self.piece_table(unit)
        pieces = self.pieces(unit)
        out = b"".join([self._contraction(x) if x in _LONG_CONTRACTIONS else self.piece_table(x) for x in pieces])
        for m in _RUN.finditer(unit):  # a run that ends the prefix is one piece
            counts = [0, *prefix_counts(out).tolist()]
            counts[m.end()] = counts[m.start()] + len(self.encode(m[0]))
            out = _changes(counts)
        return out

    def _contraction(self, piece: str) -> bytes:
        return _changes([0, 1, 2, len(self.encode(piece))])

    def _with_special(self, unit: str) -> bytes:
        counts, at = [0], 0
        for m in SPECIAL.finditer(unit):
            base = counts[-1]
            counts += [base + c for c in prefix_counts(self.unit_table(unit[at : m.start()])).tolist()] if at < m.start() else []
            done = counts[-1]
            counts += [base + len(self.fast.encode_ordinary(unit[at:j])) for j in range(m.start() + 1, m.end())]
            counts.append(done + 1)
            at = m.end()
        rest = prefix_counts(self.unit_table(unit[at:])).tolist() if at < len(unit) else []
        return _changes([*counts, *(counts[-1] + c for c in rest)])

    def text_table(self, text: str) -> bytes:
        """Changes of the prefix count, one signed byte a character."""
        return self._joined(text, self.tables, self.unit_table)


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def prefix_counts(table: bytes) -> np.ndarray:
    """Tokens of each non-empty prefix."""
    return np.cumsum(np.frombuffer(table, np.int8), dtype=np.int32)


def count_at(table: bytes, n_chars: int) -> int:
    """Tokens of the first n_chars characters."""
    return int(np.frombuffer(table, np.int8)[:n_chars].sum(dtype=np.int64))


def fits(table: bytes, budget: int) -> int:
    """The most characters from the start that make at most `budget` tokens."""
    c = prefix_counts(table)
    ok = np.flatnonzero(c <= budget)
    return int(ok[-1]) + 1 if len(ok) and budget >= 0 else 0


def token_counts(docs: DataFrame, path: str, limit: int = 1024, keep_table: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_tokens, over_limit, fit_chars (the longest prefix within the limit) and, with keep_table, the prefix table itself.

    Null texts count as empty; an empty text has 0 tokens. Rows that repeat stay. Null ids stay null. Other columns are not looked at.
    """
    batch_bytes(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in released(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "table")}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                t = code.text_table(text)
                c = prefix_counts(t)
                n = int(c[-1]) if len(c) else 0
                row = (i, len(text.encode()), n, n > limit, len(text) if n <= limit else fits(t, limit), t if keep_table else None)
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            if not keep_table:
                del out["table"]
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, kinds[k]) for k in out]))

    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_tokens": pa.int64(), "over_limit": pa.bool_(), "fit_chars": pa.int64(), "table": pa.binary()}
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", table binary" * keep_table
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(count, schema)


def token_pieces(docs: DataFrame, path: str, size: int = 1024, end: int = 2) -> DataFrame:
    """The token ids of each document, then id `end`, cut into pieces of `size` of which the first may be shorter: rows (doc_id, piece, start, length, ids_crc32)."""
    batch_bytes(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in released(batches):
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.text_ids(text.as_py() or "") + last
                n = len(ids) // 4
                at, piece = 0, 0
                step = n % size or size
                while at < n:
                    rows.append((i, piece, at, step, zlib.crc32(ids[4 * at : 4 * (at + step)])))
                    at, piece, step = at + step, piece + 1, size
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
