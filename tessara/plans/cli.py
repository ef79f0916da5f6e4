"""Command line: tables from -t name=path, one statement from -c, or a shell."""

from __future__ import annotations

import argparse
import sys
import time

from ..session import session
from .context import Context
from .errors import EngineError

HELP = ".tables  .schema NAME  .timing on|off  .help  .quit\nA statement ends at ; or a blank line."


def run(ctx: Context, text: str, timing: bool = True) -> str:
    began = time.perf_counter()
    result = ctx.sql(text)
    table = result.to_table()
    if result.explained is not None:
        return table
    n = table.count("\n") - 3
    return f"{table}\n({n} row{'s' * (n != 1)})" + (f" in {time.perf_counter() - began:.3f} s" if timing else "")


def command(ctx: Context, line: str, state: dict) -> str | None:
    """The answer to a dot command; None ends the shell."""
    word, _, rest = line.partition(" ")
    if word in (".quit", ".exit"):
        return None
    if word == ".tables":
        return "\n".join(ctx.table_names())
    if word == ".schema":
        return "\n".join(f"{n} {k}" for n, k in ctx.schema_of(rest.strip()))
    if word == ".timing":
        state["timing"] = rest.strip() != "off"
        return f"timing {'on' if state['timing'] else 'off'}"
    return HELP if word == ".help" else f"unknown command {word}; .help lists them"


def shell(ctx: Context, lines, out=print) -> None:
    state, text = {"timing": True}, ""
    for line in lines:
        line = line.rstrip("\n")
        try:
            if not text and line.startswith("."):
                answer = command(ctx, line.strip(), state)
                if answer is None:
                    return
                out(answer)
                continue
            text += line + "\n"
            if text.strip() and (line.rstrip().endswith(";") or not line.strip()):
                statement, text = text, ""
                out(run(ctx, statement, state["timing"]))
        except EngineError as e:
            out(f"error: {e}")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessara")
    parser.add_argument("-t", "--table", action="append", default=[], metavar="NAME=PATH")
    parser.add_argument("-c", "--command")
    args = parser.parse_args(argv)
    ctx = Context(session())
    for pair in args.table:
        name, _, path = pair.partition("=")
        (ctx.register_parquet if path.rstrip("/").endswith(".parquet") else ctx.register_csv)(name, path)
    try:
        if args.command:
            print(run(ctx, args.command))
        else:
            shell(ctx, sys.stdin)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
