"""Run a registered query from the command line.

    python -m haat list
    python -m haat run QUERY [--data DIR] [--out PATH] [--format parquet|csv|json]
                              [--master local[8]] [--show N]

Without ``--out`` the first rows are shown; with it, the whole result is
written in parallel (nothing is collected to the driver).
"""

from __future__ import annotations

import argparse
import sys


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="haat")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered queries")
    run = sub.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("--data", default="/root/testdata/sf0.01")
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    run.add_argument("--master")
    run.add_argument("--show", type=int, default=20)
    args = ap.parse_args(argv)

    from haat.plans.registry import QUERIES
    if args.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; try: python -m haat list", file=sys.stderr)
        return 2
    from haat.session import get_spark
    spark = get_spark(args.master)
    df = QUERIES[args.query](spark, args.data)
    if args.out:
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(args.out) if args.format == "csv"
         else w.format(args.format).save(args.out))
        print(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
