"""Citation markers: find them outside code, keep those in range, close the gaps of the others.

An answer is read once, from left to right, into pieces: text, code (what Markdown fences or
back-ticks protect) and markers. Whatever is asked about citations is a walk over these pieces.
Reading code is no regular language, so the two readers are Arrow UDFs; everything else is built in.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..schema import struct

# The marker form, and the characters before which a dropped marker leaves no space.
MARKER_TEXT = r"\[[ \t]*\d+(?:[ \t]*,[ \t]*\d+)*[ \t]*\]"
CLOSERS = ",.;:!?)]}»”’、。，．！？：；）】」』"
VERIFIED = struct("text string, used array<int>, emitted int, grounded int")

BLANK = " \t"
_SIGN = re.compile(rf"(?P<marker>{MARKER_TEXT})|(?P<run>`+|~{{3,}})")
_NUMBER = re.compile(r"\d+")


class Piece(NamedTuple):
    """kind is text, code or marker; numbers are those of a marker."""

    kind: str
    text: str
    numbers: tuple[int, ...] = ()


class Ticks:
    """Where runs of back-ticks are, by their length."""

    def __init__(self, text: str):
        self.starts: dict[int, list[int]] = {}
        for m in re.finditer("`+", text):
            self.starts.setdefault(len(m[0]), []).append(m.start())

    def after(self, at: int, length: int) -> int | None:
        """End of the next run of this length."""
        own = self.starts.get(length, [])
        k = bisect_left(own, at)
        return own[k] + length if k < len(own) else None


def fence_end(text: str, at: int, sign: str, length: int) -> int:
    """End of a fenced block: its closing line of as many signs or more, else the end of the text."""
    line = text.find("\n", at)
    while line >= 0:
        stop = text.find("\n", line + 1)
        stop = len(text) if stop < 0 else stop
        signs = text[line + 1 : stop].strip(BLANK)
        if len(signs) >= length and signs == sign * len(signs):
            return stop
        line = text.find("\n", stop)
    return len(text)


def pieces(text: str) -> Iterator[Piece]:
    """All of a text in order. A run of back-ticks without a partner protects nothing."""
    ticks, plain, at = Ticks(text), 0, 0
    while m := _SIGN.search(text, at):
        at = m.end()
        if run := m["run"]:
            opens = not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
            if len(run) >= 3 and opens:
                end = fence_end(text, at, run[0], len(run))
            else:
                end = ticks.after(at, len(run)) if run[0] == "`" else None
            if end is None:
                continue
            found, at = Piece("code", text[m.start() : end]), end
        else:
            found = Piece("marker", m[0], tuple(map(int, _NUMBER.findall(m[0]))))
        if plain < m.start():
            yield Piece("text", text[plain : m.start()])
        yield found
        plain = at
    if plain < len(text):
        yield Piece("text", text[plain:])


def numbers(text: str) -> list[int]:
    """Every cited number outside code, in order."""
    return [n for p in pieces(text) for n in p.numbers]


class Joiner:
    """Puts pieces together again and closes the gaps that dropped markers leave.

    Lines begin and end at code as well. One marker dropped at the start of a line takes the blanks
    after it along and leaves the indent. Elsewhere neighbouring dropped markers are one gap: its
    blanks go but for the last one behind it (a space if there is none), unless a closing sign, white
    space or the end of the line follows.
    """

    def __init__(self) -> None:
        self.out: list[str] = []
        self.line = ""  # the current line since its start or the last code
        self.gap, self.blank = 0, ""

    def _close(self, follows: str) -> None:
        if not self.gap:
            return
        kept = self.line.rstrip(BLANK)
        if self.gap > 1 or kept:
            self.line = kept + ("" if not follows or follows.isspace() or follows in CLOSERS else self.blank or " ")
        self.gap = 0

    def drop(self) -> None:
        self.gap += 1
        self.blank = ""

    def text(self, t: str) -> None:
        if self.gap:
            rest = t.lstrip(BLANK)
            self.blank = t[: len(t) - len(rest)][-1:] or self.blank
            if not rest:
                return
            self._close(rest[0])
            t = rest
        head, newline, tail = (self.line + t).rpartition("\n")
        self.out.append(head + newline)
        self.line = tail

    def code(self, t: str) -> None:
        self._close("")
        self.out += [self.line, t]
        self.line = ""

    def done(self) -> str:
        self._close("")
        return "".join([*self.out, self.line])


def verify_text(text: str, n_hits: int) -> tuple[str, list[int]]:
    """Text with only markers 1..n_hits, and those numbers in order."""
    used: set[int] = set()
    join = Joiner()
    for p in pieces(text.replace("\0", "")):
        if p.kind == "code":
            join.code(p.text)
        elif p.kind == "text":
            join.text(p.text)
        elif valid := [n for n in dict.fromkeys(p.numbers) if 1 <= n <= n_hits]:
            used.update(valid)
            join.text("".join(f"[{n}]" for n in valid))
        else:
            join.drop()
    return join.done(), sorted(used)


def verify(text: Column, n_hits: Column) -> Column:
    """struct(text, used, emitted, grounded) per answer."""

    @F.pandas_udf(VERIFIED)
    def run(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = []
        for x, k in zip(t.fillna(""), n.fillna(0), strict=True):
            clean, used = verify_text(x, int(k))
            rows.append((clean, used, len(numbers(x)), len(numbers(clean))))
        return pd.DataFrame(rows, columns=["text", "used", "emitted", "grounded"])

    return run(text, n_hits)


def find_markers(text: Column) -> Column:
    @F.pandas_udf(ArrayType(IntegerType()))
    def run(t: pd.Series) -> pd.Series:
        return t.fillna("").map(numbers)

    # without back-ticks or tildes there is no code: no Python needed
    brackets = F.regexp_extract_all(text, F.lit(f"({MARKER_TEXT})"), F.lit(1))
    plain = F.transform(F.flatten(F.transform(brackets, lambda b: F.regexp_extract_all(b, F.lit(r"(\d+)"), F.lit(1)))), lambda n: n.cast("int"))
    return F.when(F.coalesce(text, F.lit("")).rlike("[`~]"), run(text)).otherwise(F.coalesce(plain, F.array().cast("array<int>")))


def strip_all(text: Column) -> Column:
    return verify(text, F.lit(0))["text"]


def groundedness(emitted: Column, grounded: Column) -> Column:
    """Share of the emitted markers that resolve; 0 without any."""
    return F.coalesce(F.try_divide(grounded.cast("double"), emitted.cast("double")), F.lit(0.0))
