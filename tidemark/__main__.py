"""``python -m tidemark QUERY FOLDER [OUT]`` runs a query over a folder of tables, writes its rows if a place is
named, and prints a summary as JSON."""

from __future__ import annotations

import argparse
import json
import logging
import time

from . import log
from .plans import catalogue
from .session import build_session
from .sources import sinks


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="tidemark")
    parser.add_argument("query", choices=sorted(catalogue.queries()))
    parser.add_argument("folder")
    parser.add_argument("out", nargs="?")
    parser.add_argument("--log-level", default="INFO")
    args = parser.parse_args(argv)
    log.configure(args.log_level)
    spark = build_session(app=f"tidemark {args.query}")
    began = time.monotonic()
    df = catalogue.queries()[args.query](spark, args.folder)
    if args.out:
        sinks.table(df, args.out)
        df = spark.read.schema(df.schema).parquet(args.out)
    summary = {"query": args.query, "rows": df.count(), "columns": df.columns, "out": args.out, "seconds": round(time.monotonic() - began, 3)}
    logging.getLogger(__name__).info("query ended", extra={"query": args.query, "rows": summary["rows"]})
    print(json.dumps(summary, sort_keys=True))
    return summary


if __name__ == "__main__":
    main()
