"""python -m usage_trace.cli --input HITS --source TREE --output OUT [--lang LANG] [--encoding NAME]

Traces all keywords (*.grep files in HITS) over TREE and writes OUT/KEYWORD.tsv for each, header first. With --partitioned, or an
OUT that is no local folder, results are OUT/keyword=.../ part files, which pass no driver.
Exit codes: 0 done, 1 bad arguments or no hit files, 2 failure.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from usage_trace.functions.classify import RULES
from usage_trace.operators.java_structure import structures
from usage_trace.operators.quality import kind_counts, unread_files
from usage_trace.plans.languages import by_suffix
from usage_trace.plans.trace import release, trace
from usage_trace.sources.files import file_lines, read_files
from usage_trace.sources.hits import count_hits, read_hits
from usage_trace.sources.results import write_keyword_files, write_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="usage_trace", description=__doc__)
    p.add_argument("--input", required=True, help="folder of *.grep files, one per keyword")
    p.add_argument("--source", required=True, help="root of the source tree")
    p.add_argument("--output", required=True, help="folder for results")
    p.add_argument("--lang", choices=sorted(RULES), help="label all hits by the rules of one language")
    p.add_argument("--encoding", help="encoding of hits and sources; else it is found file by file")
    p.add_argument("--partitioned", action="store_true", help="write part files by keyword, without the driver")
    p.add_argument("--per-line", action="store_true", help="report a line once for a name, however often it has it")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    hits = read_hits(spark, args.input, args.encoding)
    files = read_files(spark, args.source, (), args.encoding).persist()
    known = files.where(files["suffix"].isin(*by_suffix(), ""))
    lines = file_lines(known)
    structure = structures(known.where("suffix = '.java'")).persist()
    records = trace(hits, lines, roots=(os.path.abspath(args.source), args.source), structure=structure, only=args.lang, per_line=args.per_line)
    if args.partitioned or "://" in args.output:
        write_results(records, args.output)
    else:
        write_keyword_files(records, keywords(spark, args.input, hits), args.output)
    for title, rows, order in (("hits", count_hits(hits), "keyword"), ("uses", kind_counts(records), "keyword"), ("unread", unread_files(known, structure), "filepath")):
        for row in rows.orderBy(order).toLocalIterator():
            print(title, *row, sep="\t")
    release(records)


def keywords(spark: SparkSession, path: str, hits: DataFrame) -> DataFrame:
    """keyword of each hit file, of empty ones too."""
    if "://" in path:
        return hits.select("keyword")
    return spark.createDataFrame([(n.removesuffix(".grep"),) for n in sorted(os.listdir(path)) if n.endswith(".grep")], "keyword string")


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    if "://" not in args.input and not (os.path.isdir(args.input) and any(n.endswith(".grep") for n in os.listdir(args.input))):
        print(f"no *.grep files in {args.input}", file=sys.stderr)
        return 1
    if "://" not in args.source and not os.path.isdir(args.source):
        print(f"{args.source} is not a folder", file=sys.stderr)
        return 1
    try:
        run(SparkSession.builder.appName("usage_trace").getOrCreate(), args)
    except Exception as e:  # noqa: BLE001  reported, as a command's exit code
        print(f"failed: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
