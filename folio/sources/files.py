"""Files as tables, and the interface of page extractors."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def regular_file(path: str) -> int:
    """Size of a local regular file; an error, before it is opened, for anything else."""
    info = os.stat(path)
    if stat.S_ISDIR(info.st_mode):
        raise IsADirectoryError(f"{path} is a directory")
    if not stat.S_ISREG(info.st_mode):
        raise OSError(f"{path} is not a regular file")
    return info.st_size


def same_file(a: str, b: str) -> bool:
    """Whether two paths are one place; nothing is opened."""
    return os.path.abspath(a) == os.path.abspath(b)


def equal_contents(a: str, b: str, chunk: int = 1 << 15) -> bool:
    """Two regular local files, read side by side up to the first difference."""
    if same_file(a, b):
        return True
    if regular_file(a) != regular_file(b):
        return False
    with open(a, "rb") as x, open(b, "rb") as y:
        if not all(stat.S_ISREG(os.fstat(f.fileno()).st_mode) for f in (x, y)):
            raise OSError("a file was exchanged for something else")
        while True:
            p, q = x.read(chunk), y.read(chunk)
            if p != q:
                return False
            if not p:
                return True


def files(spark: SparkSession, path: str) -> DataFrame:
    """id (the path), content, size. A row holds a whole file, up to Spark's 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), "content", F.col("length").alias("size"))


class Extractor(Protocol):
    """Turns a file's bytes into pages (page_no from 1, text, objects)."""

    def pages(self, content: bytes) -> Iterator[tuple[int, str, int]]: ...


class TextExtractor:
    """A page for each form feed; without any, for each line that is not blank."""

    def pages(self, content: bytes) -> Iterator[tuple[int, str, int]]:
        text = content.decode("utf-8", "replace")
        parts = text.split("\f") if "\f" in text else [x for x in text.split("\n") if x.strip()]
        for i, part in enumerate(parts, 1):
            yield i, part, 0


class HtmlExtractor:
    """One page: the text between tags; objects are tags."""

    def pages(self, content: bytes) -> Iterator[tuple[int, str, int]]:
        import html
        import re

        text = content.decode("utf-8", "replace")
        body = re.sub(r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ", text)
        yield 1, " ".join(html.unescape(body).split()), len(re.findall(r"<[a-zA-Z]", text))


def extract(table: DataFrame, extractor: Extractor) -> DataFrame:
    """Pages of files (id, content): id, page_no, text, objects, err. A file that fails gives one row with err, and fails nothing else."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for i, content in zip(pdf["id"], pdf["content"], strict=True):
                try:
                    rows += [(i, n, t, o, None) for n, t, o in extractor.pages(bytes(content))]
                except Exception as error:  # carried as data
                    rows.append((i, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["id", "page_no", "text", "objects", "err"]).astype({"page_no": "Int32", "objects": "Int32"})

    return table.select("id", "content").mapInPandas(work, "id string, page_no int, text string, objects int, err string")
