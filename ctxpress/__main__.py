"""Command line: shortens or profiles text files or standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ctxpress.functions.content import content_profile
from ctxpress.operators.compress import compress
from ctxpress.operators.cost import list_supported_models, savings_summary, with_savings
from ctxpress.operators.modes import list_modes
from ctxpress.runtime import ensure_importable
from ctxpress.sources.files import read_stdin, read_texts, summary, write_texts


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m ctxpress", description=__doc__)
    p.add_argument("input", nargs="?", help="a path or pattern of text files; standard input if left out")
    p.add_argument("-r", "--ratio", type=float, default=0.5)
    p.add_argument("-m", "--mode", choices=["auto", *list_modes()])
    p.add_argument("-q", "--query")
    p.add_argument("-o", "--output", help="a folder for the texts; standard output if left out")
    p.add_argument("--detect", action="store_true", help="choose by content type")
    p.add_argument("--analyze", action="store_true", help="only say what the content is")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--cost", choices=list_supported_models())
    p.add_argument("--requests-per-day", type=int, default=1000)
    a = p.parse_args(argv)
    spark = ensure_importable(spark or SparkSession.builder.appName("ctxpress").getOrCreate())
    texts = read_texts(spark, a.input) if a.input else read_stdin(spark)
    if a.analyze:
        for row in content_profile(texts).select("path", F.to_json("profile").alias("p")).toLocalIterator():
            print(row["path"], row["p"])
        return 0
    done = compress(texts, target_ratio=a.ratio, query=a.query, mode=a.mode, detect_content=a.detect)
    if a.output:
        write_texts(done, a.output)
    else:
        for row in done.select("compressed_text").toLocalIterator():
            print(row[0])
    if a.stats:
        for row in done.select("path", summary().alias("s")).toLocalIterator():
            print(row["path"], row["s"], file=sys.stderr)
    if a.cost:
        for row in with_savings(done, models=(a.cost,), requests_per_day=a.requests_per_day).select(savings_summary().alias("s")).toLocalIterator():
            print(row["s"], file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
