"""compare A B, quick A B, version: exit 0 if alike, 1 if different, 2 on errors."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import threading

from folio.options import Options
from folio.sources.files import equal_contents, regular_file

VERSION = "0.1.0"


log = logging.getLogger("folio")


def _compared(args: argparse.Namespace, options: Options, sizes: list[int]) -> dict:
    """The result of a comparison, with its text; the jobs are cancelled when the time is up."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from folio.plans.cascade import compare
    from folio.sources.files import files
    from folio.sources.sinks import as_text

    spark = SparkSession.builder.getOrCreate()
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelAllJobs()

    timer = threading.Timer(args.timeout, stop) if args.timeout else None
    if timer:
        timer.start()
    try:
        paths = [os.path.abspath(p) for p in (args.a, args.b)]
        docs = [files(spark, p).select(F.lit(i).cast("long").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")) for i, p in enumerate(paths, 1)]
        log.debug("comparing %s", paths)
        found = compare(docs[0].union(docs[1]), spark.createDataFrame([(1, 2)], "a long, b long"), options)
        named = found.withColumns({"name1": F.lit(args.a), "name2": F.lit(args.b), "size1": F.lit(sizes[0]), "size2": F.lit(sizes[1])})
        row = named.first().asDict()
        text = as_text(spark.createDataFrame([tuple(row.values())], named.schema)).first()["text"]
        return {k: v for k, v in row.items() if k not in ("name1", "name2", "size1", "size2")} | ({"text": text} if args.format == "text" else {})
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"not done within {args.timeout} seconds") from error
        raise
    finally:
        if timer:
            timer.cancel()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("folio")
    top.add_argument("-f", "--format", choices=("text", "json"), default="text")
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("--version", action="version", version=VERSION)
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("compare", "quick"):
        c = commands.add_parser(name)
        c.add_argument("a")
        c.add_argument("b")
        if name == "compare":
            c.add_argument("-m", "--mode", default="auto")
            c.add_argument("-t", "--threshold", type=float, default=0.95)
            c.add_argument("--text-tolerant", action="store_true")
            c.add_argument("--no-tiles", action="store_true")
            c.add_argument("--dpi", type=int, default=150)
            c.add_argument("-w", "--workers", type=int, default=None)
            c.add_argument("--hash", default="both")
            c.add_argument("--text-hash", default="minhash")
            c.add_argument("--sampling", default="auto")
            c.add_argument("--memory", type=int, default=512, help="megabytes")
            c.add_argument("--timeout", type=float, default=0, help="seconds; 0 for none")
    try:
        args = top.parse_args(argv)
    except SystemExit as stop:
        return 2 if stop.code else 0
    if args.command == "version":
        print(VERSION)
        return 0
    try:
        log.setLevel(logging.DEBUG if args.verbose else logging.ERROR if args.quiet else logging.WARNING)
        sizes = [regular_file(p) for p in (args.a, args.b)]
        log.debug("sizes %s", sizes)
        if args.command == "quick":
            same = equal_contents(args.a, args.b)
            print(json.dumps({"identical": same, "file1": args.a, "file2": args.b}) if args.format == "json" else "IDENTICAL" if same else "DIFFERENT")
            return 0 if same else 1
        workers = {} if args.workers is None else {"workers": args.workers}
        options = Options(mode=args.mode, hash_type=args.hash, text_hash=args.text_hash, text_change="scored" if args.text_tolerant else "fails", tiles=not args.no_tiles, dpi=args.dpi, threshold=args.threshold, sampling=args.sampling, max_memory_mb=args.memory, **workers)
        if args.timeout < 0:
            raise ValueError(f"timeout must not be negative, not {args.timeout}")
        row = _compared(args, options, sizes)
        print(json.dumps(row, default=list) if args.format == "json" else row["text"])
        return 0 if row["status"] != "DIFFERENT" else 1
    except (OSError, ValueError, TimeoutError) as error:
        print(error, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
