"""Call sets: text such as ``*/frame, 10-20, 7, 100-/50`` as a predicate Column.

``*``, ``N``, ``N-M``, ``N-``, each with an optional ``/step`` or ``/frequency``; a bare frequency;
commas between ranges; ``@file`` reads ranges from a file's lines.  An empty set contains nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: bits of the call flags
FAKE, NON_REPRODUCIBLE, NO_SIDE_EFFECTS, RENDER, SWAP_RENDERTARGET, END_FRAME, INCOMPLETE, VERBOSE, MARKER, MARKER_PUSH, MARKER_POP = (1 << i for i in range(11))
FREQUENCIES = {"frame": END_FRAME, "rendertarget": END_FRAME | SWAP_RENDERTARGET, "fbo": END_FRAME | SWAP_RENDERTARGET, "render": RENDER, "draw": RENDER}
_RANGE = re.compile(r"\s*(?:([a-zA-Z]+)|(?:(\*)|(\d+)\s*(?:(-)\s*(\d+)?)?)\s*(?:/\s*(?:(\d+)|([a-zA-Z]+)))?)\s*$")


@dataclass(frozen=True)
class CallRange:
    start: int = 0
    stop: int | None = None
    step: int = 1
    mask: int | None = None

    def column(self, no: Column, flags: Column) -> Column:
        c = no >= self.start
        if self.stop is not None:
            c = c & (no <= self.stop)
        if self.step > 1:
            c = c & (F.pmod(no - self.start, F.lit(self.step)) == 0)
        if self.mask is not None:
            c = c & (flags.bitwiseAND(self.mask) != 0)
        return c

    def contains(self, no: int, flags: int) -> bool:
        return no >= self.start and (self.stop is None or no <= self.stop) and (no - self.start) % self.step == 0 and (self.mask is None or bool(flags & self.mask))


def _frequency(name: str) -> int:
    if name not in FREQUENCIES:
        raise ValueError(f"expected frequency, found {name!r}")
    return FREQUENCIES[name]


def parse(text: str) -> list[CallRange]:
    out: list[CallRange] = []
    for token in text.split(","):
        token = token.strip()
        if not token:
            continue
        if token.startswith("@"):
            for line in Path(token[1:]).read_text().splitlines():
                out += parse(line)
            continue
        m = _RANGE.match(token)
        if not m:
            raise ValueError(f"not a call range: {token!r}")
        freq, star, first, dash, last, step, step_freq = m.groups()
        if freq:
            out.append(CallRange(mask=_frequency(freq)))
            continue
        start = 0 if star else int(first)
        stop = None if star or (dash and last is None) else int(last) if dash else start
        out.append(CallRange(start, stop, max(int(step), 1) if step else 1, _frequency(step_freq) if step_freq else None))
    return out


class CallSet:
    """Ranges that grow by ``merge``; the first merge replaces the default set."""

    def __init__(self, default: str = "") -> None:
        self.ranges = parse(default)
        self._fresh = True

    def merge(self, text: str) -> CallSet:
        if self._fresh:
            self.ranges, self._fresh = [], False
        self.ranges += parse(text)
        return self

    def column(self, no: Column, flags: Column) -> Column:
        c = F.lit(False)
        for r in self.ranges:
            c = c | r.column(no, flags)
        return c
