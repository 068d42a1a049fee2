"""Media columns (operator 1): texts or other payloads stored as FLAC, decoded again, and cut into seekable PCM blocks."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm import flac
from folio.llm.common import batch_bytes, raw, released

#: Bytes that one call of the codec gets, unless one payload alone is longer.
GROUP = 2 << 20
_KINDS = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary()}


def padded(text: bytes) -> bytes:
    """Filled up with zeros to a positive multiple of 64 bytes."""
    return text + bytes(-len(text) % 64 if text else 64)


def feature(payload: bytes) -> str:
    """Of decoded samples: mean, root mean square, peak, and share of sign changes."""
    s = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = np.count_nonzero((s[1:] < 0) != (s[:-1] < 0)) / max(1, len(s) - 1)
    return f"mean={s.mean():.4f};rms={np.sqrt((s * s).mean()):.4f};peak={np.abs(s).max()};zcr={crossings:.4f}"


def store(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Each whole text as a FLAC stream of 8-bit samples, read back and measured.

    Null and empty texts give 64 zero bytes. Ids may be null or repeat; each row gives a row. A stored form that does not decode to its payload raises an error. Other columns are not looked at.
    """
    batch_bytes(docs.sparkSession)
    names = [k for k in _KINDS if keep_media or k != "media"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            group: list[tuple] = []
            size = 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = raw(text.as_py())
                group.append((i, len(t), padded(t)))
                size += len(t)
                if size >= GROUP:
                    yield _rows(group, names)
                    group, size = [], 0
            if group:
                yield _rows(group, names)

    kinds = {"doc_id": "long", "n_bytes": "long", "payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long", "media": "binary"}
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(work, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in names))


def _rows(group: list[tuple], names: list[str]) -> pa.RecordBatch:
    stored = flac.encode([p for _, _, p in group])
    back = flac.decode(stored)
    rows = []
    for (i, n, p), m, b in zip(group, stored, back, strict=True):
        if b != p:
            raise ValueError(f"document {i} does not read back as it was stored")
        rows.append((i, n, len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(b), m))
    cols = dict(zip(_KINDS, zip(*rows, strict=True), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[k], _KINDS[k]) for k in names], names=names)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """From rows (doc_id, media): a row for each frame with its sample_offset, n_samples and pcm (signed 8-bit), so that any range is found by its offset."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                m = m.as_py()
                if m is None:
                    continue
                pcm = (np.frombuffer(flac.decode([m])[0], np.uint8) ^ 128).tobytes()
                points = flac.parse(m).points
                at, n = points["s"].astype(np.int64), points["n"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), pa.int64()), pa.array(at), pa.array(n), pa.array([pcm[a : a + k] for a, k in zip(at, n, strict=True)], pa.binary())], names=["doc_id", "sample_offset", "n_samples", "pcm"])

    return media.selectExpr("cast(doc_id as long) doc_id", "media").mapInArrow(work, "doc_id long, sample_offset long, n_samples long, pcm binary")
