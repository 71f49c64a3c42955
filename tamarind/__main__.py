"""Run queries from a shell: ``python -m tamarind list`` or ``python -m tamarind run NAME --tables DIR [--json] [--out PATH]``."""

from __future__ import annotations

import argparse

from tamarind.operators.relational import as_json
from tamarind.plans import catalogue
from tamarind.session import local_session, release
from tamarind.sources import readers


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tamarind")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    commands.add_parser("sources", help="the candidate sources")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("name", choices=sorted(catalogue.QUERIES), metavar="NAME")
    run.add_argument("--tables", required=True, help="folder of the Parquet tables")
    run.add_argument("--json", action="store_true", help="a JSON document for each row")
    run.add_argument("--out", help="write there instead of printing: JSON with --json, else Parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to print")
    asked = parser.parse_args(args)
    if asked.command == "list":
        print("\n".join(catalogue.QUERIES))
        return 0
    if asked.command == "sources":
        print("\n".join(readers.described()))
        return 0
    spark = local_session()
    try:
        found = catalogue.QUERIES[asked.name](spark, asked.tables)
        if asked.out:
            as_json(found).write.text(asked.out) if asked.json else found.write.parquet(asked.out)
        elif asked.json:
            for row in as_json(found.limit(asked.rows)).toLocalIterator():
                print(row["json"])
        else:
            found.show(asked.rows, truncate=60)
    finally:
        release(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
