"""Checks, prints, repairs and translates a query from a file or from standard input."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from aquila.plans.compiler import Compiler, Settings, UnresolvedError
from aquila.plans.lexer import ParseError
from aquila.plans.parser import parse
from aquila.plans.printer import to_text
from aquila.plans.quickfix import quick_fix
from aquila.sources.tableset import read_tableset

# Exit status.
OK, BAD_ARGUMENTS, BAD_FILE, BAD_QUERY, BAD_TRANSLATION = range(5)


class _Arguments(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(BAD_ARGUMENTS, f"{self.prog}: {message}\n")


def main(argv: list[str] | None = None) -> int:
    """Status 0 where the query is right, 1 for wrong arguments, 2 for a file that can't be read, 3 for a query that can't be
    parsed or names what a tableset lacks, 4 for one that can't be translated."""
    arguments = _Arguments(prog="aquila", description=__doc__)
    shown = arguments.add_mutually_exclusive_group()
    shown.add_argument("-a", "--adql", action="store_true", help="show the query as it was understood")
    shown.add_argument("-s", "--sql", action="store_true", help="show the Spark SQL; needs --tables")
    arguments.add_argument("-f", "--try-fix", action="store_true", help="repair common mistakes first")
    arguments.add_argument("-t", "--tables", help="a tableset (XML) to check names against")
    arguments.add_argument("file", nargs="?", help="the query; standard input without it")
    try:
        asked = arguments.parse_args(argv)
        if asked.sql and not asked.tables:
            arguments.error("--sql needs --tables")
    except SystemExit as end:
        return int(end.code or 0)
    try:
        text = Path(asked.file).read_text() if asked.file else sys.stdin.read()
        catalog = read_tableset(Path(asked.tables).read_bytes()) if asked.tables else None
    except (OSError, ValueError, SyntaxError) as problem:
        print(problem, file=sys.stderr)
        return BAD_FILE
    text = text.strip().removesuffix(";")
    try:
        tree = parse(quick_fix(text) if asked.try_fix else text)
        for table in catalog.tables if catalog else ():
            table.view = table.full_name
        compiled = Compiler(catalog, Settings()).compile(tree) if catalog else None
    except (ParseError, UnresolvedError) as problem:
        print(problem, file=sys.stderr)
        return BAD_QUERY
    except (ValueError, TypeError) as problem:
        print(problem, file=sys.stderr)
        return BAD_TRANSLATION
    if asked.adql:
        print(to_text(tree))
    if asked.sql:
        print(compiled.sql)
    return OK


if __name__ == "__main__":
    sys.exit(main())
