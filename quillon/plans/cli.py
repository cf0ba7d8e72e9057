"""``python -m quillon.plans.cli query "SELECT a FROM 'file.csv' WHERE ..." --format table|csv|json|ndjson --output PATH``."""

from __future__ import annotations

import argparse
import re
import sys

from quillon.errors import EngineError, ParseError
from quillon.plans.sql import query
from quillon.session import get_session
from quillon.sources.csvfile import to_csv_text
from quillon.sources.frames import from_file, to_file, to_json_text, to_string

FORMATS = ("table", "csv", "json", "ndjson")
#: Rows of a table on the screen, unless --rows says otherwise; the table says how many rows it leaves out.
SHOWN = 1000


def split_source(sql: str) -> tuple[str, str]:
    """The file path after FROM and the statement with ``this`` in its place."""
    m = re.search(r"\bFROM\s+('(?:[^']|'')+'|\"[^\"]+\"|\S+)", sql, re.I)
    if not m:
        raise ParseError("expected FROM with a file path", position=len(sql))
    path = m[1].rstrip(";")
    path = path[1:-1].replace("''", "'") if path[0] in "'\"" else path
    return path, sql[: m.start(1)] + "this" + sql[m.end(1) :]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon")
    commands = parser.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run SQL over a file")
    q.add_argument("sql")
    q.add_argument("--format", choices=FORMATS, default="table")
    q.add_argument("--output", help="write there instead, by extension or --format")
    q.add_argument("--rows", type=int, default=SHOWN, help="rows of a table to show")
    q.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    spark = get_session(master=args.master)
    try:
        path, sql = split_source(args.sql)
        out = query(from_file(spark, path), sql)
        if args.output:
            to_file(out, args.output)
        elif args.format == "csv":
            sys.stdout.write(to_csv_text(out))
        elif args.format == "json":
            print(to_json_text(out, pretty=True))
        elif args.format == "ndjson":
            for line in out.toJSON().toLocalIterator():
                print(line)
        else:
            print(to_string(out, args.rows, width=200))
    except EngineError as error:
        print(f"{error.code}: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
