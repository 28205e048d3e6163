"""A prompt for statements and dot commands."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import TextIO

from twinlake.gateway.errors import classify
from twinlake.gateway.gateway import Gateway, Result
from twinlake.gateway.render import FORMATS
from twinlake.gateway.statements import split_statements

HELP = {
    ".help": "this list",
    ".exit": "leave (also .quit)",
    ".connect [name]": "open a source again, or another one",
    ".history": "statements so far",
    ".clear": "clear the screen",
    ".output [file]": "append results to a file, or back to the screen",
    ".save file [format]": "write the last result to a file",
}


class Repl:
    def __init__(self, gateway: Gateway, *, connect: Callable[[str | None], str] | None = None, fmt: str = "table", out: TextIO | None = None):
        self.gateway, self.connect, self.fmt, self.out = gateway, connect, fmt, out or sys.stdout
        self.history: list[str] = []
        self.last: Result | None = None
        self.to: Path | None = None
        self.pending = ""

    def say(self, text: str) -> None:
        if self.to:
            with self.to.open("a") as f:
                f.write(text)
        else:
            self.out.write(text)

    def command(self, line: str) -> bool:
        """Run a dot command; False to leave."""
        name, *args = line.split()
        name = name.lower()
        if name in (".exit", ".quit"):
            return False
        if name in (".help", "?"):
            self.out.write("".join(f"{c:22}{t}\n" for c, t in HELP.items()))
        elif name == ".history":
            for n, sql in enumerate(self.history, 1):
                flat = " ".join(sql.split())
                self.out.write(f"{n:4}  {flat if len(flat) <= 80 else flat[:79] + '...'}\n")
        elif name in (".clear", ".cls"):
            self.out.write("\x1b[2J\x1b[H")
        elif name == ".output":
            self.to = Path(args[0]) if args else None
        elif name == ".save":
            fmt = args[1] if len(args) > 1 else self.fmt
            if not args or fmt not in FORMATS or self.last is None:
                self.out.write("nothing to save\n" if self.last is None else f"usage: .save file [{'/'.join(FORMATS)}]\n")
            else:
                Path(args[0]).write_text(self.last.render(fmt))
        elif name == ".connect" and self.connect:
            self.out.write(self.connect(args[0] if args else None) + "\n")
        else:
            self.out.write(f"unknown command {name}; .help lists them\n")
        return True

    def feed(self, line: str) -> bool:
        """One line of input; statements run once their semicolon is there. False to leave."""
        if not self.pending and line.strip().startswith((".", "?")):
            return self.command(line.strip())
        self.pending += line if line.endswith("\n") else line + "\n"
        if self.pending.rstrip().endswith(";"):
            text, self.pending = self.pending, ""
            for sql in split_statements(text):
                self.statement(sql)
        return True

    def statement(self, sql: str) -> None:
        self.history.append(sql)
        try:
            self.last = self.gateway.execute(sql)
            self.say(self.last.render(self.fmt))
        except Exception as e:
            self.say(f"error: {classify(e).message}\n")

    def loop(self, lines: Iterable[str]) -> None:
        for line in lines:
            if not self.feed(line):
                return
        if self.pending.strip():
            self.statement(self.pending.strip().rstrip(";"))
