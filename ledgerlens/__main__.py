"""Command line.

    python -m ledgerlens list
    python -m ledgerlens run gateway_health --input /data/star [--show 20 | --csv /out/dir]
    python -m ledgerlens build --input /data/star --out /data/tables
    python -m ledgerlens build --csv-dir /data/csv --out /data/tables
    python -m ledgerlens dashboard sla_heatmap --tables /data/tables [--start 2024-01-08 --end 2024-01-21]
        [--region ASIA] [--gateway GatewayA] [--show 20 | --csv /out/dir]
    python -m ledgerlens expire --tables /data/tables [--keep 2]
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgerlens")
    p.add_argument("--master", default=None, help="Spark master (default: the session's)")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="registered queries")
    r = sub.add_parser("run", help="run one registered query")
    r.add_argument("query")
    r.add_argument("--input", required=True, help="folder of the star tables")
    r.add_argument("--show", type=int, default=20)
    r.add_argument("--csv", default=None, help="write the result as a CSV folder instead")
    b = sub.add_parser("build", help="store both tables, by day (from the star tables or from CSV)")
    src = b.add_mutually_exclusive_group(required=True)
    src.add_argument("--input", help="folder of the star tables")
    src.add_argument("--csv-dir", help="folder with transactions.csv and support_tickets.csv")
    b.add_argument("--out", required=True)
    d = sub.add_parser("dashboard", help="one dashboard dataset over stored tables")
    d.add_argument("dataset")
    d.add_argument("--tables", required=True, help="folder written by `build`")
    d.add_argument("--start", help="first day of the view (with --end)")
    d.add_argument("--end", help="last day of the view")
    d.add_argument("--region", action="append", help="a region of the view (repeat for more)")
    d.add_argument("--gateway", action="append", help="a gateway of the view (repeat for more)")
    d.add_argument("--show", type=int, default=20)
    d.add_argument("--csv", default=None)
    e = sub.add_parser("expire", help="let go of old versions of stored tables")
    e.add_argument("--tables", required=True)
    e.add_argument("--keep", type=int, default=2)
    args = p.parse_args(argv)

    from .plans.registry import all_queries
    if args.cmd == "list":
        print("\n".join(all_queries()))
        return 0

    from .session import build_session
    spark = build_session(master=args.master or "local[*]")
    if args.cmd == "run":
        q = all_queries().get(args.query)
        if q is None:
            print(f"unknown query {args.query!r}; see `list`", file=sys.stderr)
            return 2
        df = q(spark, args.input)
        if args.csv:
            from .sources.io import write_csv
            write_csv(df, args.csv)
        else:
            df.show(args.show, truncate=False)
    elif args.cmd == "dashboard":
        from .operators.filters import ViewFilter
        from .plans.registry import stored_datasets
        view = ViewFilter(args.start, args.end, args.region, args.gateway)
        make = stored_datasets(spark, args.tables, view).get(args.dataset)
        if make is None:
            print(f"unknown dataset {args.dataset!r}", file=sys.stderr)
            return 2
        df = make()
        df = df.drop("_date") if "_date" in df.columns else df
        if args.csv:
            from .sources.io import write_csv
            write_csv(df, args.csv)
        else:
            df.show(args.show, truncate=False)
    elif args.cmd == "expire":
        from .sources.snapshots import expire
        print(f"{len(expire(spark, args.tables, args.keep))} parts removed")
    elif args.cmd == "build":
        from .plans.build import build_from_csv, build_tables
        audit = (build_tables(spark, args.input, args.out) if args.input
                 else build_from_csv(spark, args.csv_dir, args.out))
        audit.show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
