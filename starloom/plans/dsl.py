"""The feature language: one call per line, arguments are calls or tokens.

Grammar: line = name '(' arg { ',' arg } ')'; a token is any run of characters but parentheses, commas and space. Blank lines
and lines with // are skipped; spaces mean nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class ParseError(ValueError):
    """A line that is not a call."""


@dataclass(frozen=True)
class Token:
    text: str

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Call | Token, ...]

    def __str__(self) -> str:
        return f"{self.name}({','.join(map(str, self.args))})"

    def calls(self):
        """This call and all calls inside it."""
        yield self
        for a in self.args:
            if isinstance(a, Call):
                yield from a.calls()


_PART = re.compile(r"[(),]|[^(),\s]+")


def parse_line(line: str) -> Call:
    parts = _PART.findall(re.sub(r"\s+", "", line))
    at = 0

    def need(what: str) -> None:
        nonlocal at
        if at >= len(parts) or parts[at] != what:
            raise ParseError(f"expected {what!r} at part {at} of {line!r}")
        at += 1

    def term() -> Call | Token:
        nonlocal at
        if at >= len(parts) or parts[at] in "(),":
            raise ParseError(f"expected a name at part {at} of {line!r}")
        name = parts[at]
        at += 1
        if at >= len(parts) or parts[at] != "(":
            return Token(name)
        need("(")
        args = [term()]
        while at < len(parts) and parts[at] == ",":
            at += 1
            args.append(term())
        need(")")
        return Call(name, tuple(args))

    out = term()
    if at != len(parts) or not isinstance(out, Call):
        raise ParseError(f"not a single call: {line!r}")
    return out


def parse_program(text: str) -> list[Call]:
    return [parse_line(x) for x in text.splitlines() if x.strip() and "//" not in x]
