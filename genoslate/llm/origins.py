"""Where the characters of a decoded layer came from, without a range for each of them.

An origin answers one question: which range of the layer around it do the units ``a`` to ``b`` (end exclusive) of a layer come from? Units are characters of
texts and bytes of raw data. What an origin holds grows with how irregular an encoding is, not with how long the text is: base64 is told by its
runs and alignment, escapes by their runs, UTF-8 by the characters of several bytes.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

Range = tuple[int, int]


@dataclass(frozen=True)
class Whole:
    """All units come from one range."""

    start: int
    end: int

    def span(self, a: int, b: int) -> Range:
        return self.start, self.end


class Base64:
    """Bytes of base64 text at one alignment; ``starts``: where its lines begin, ``sizes``: their letters, ``skip``: letters left out at first."""

    def __init__(self, runs: list[Range], skip: int):
        self.starts = np.array([a for a, _ in runs], np.int64)
        self.before = np.cumsum([0] + [b - a for a, b in runs])
        self.skip = skip

    def _at(self, letter: int) -> int:
        k = int(np.searchsorted(self.before, letter, side="right")) - 1
        k = min(k, len(self.starts) - 1)
        return int(self.starts[k] + letter - self.before[k])

    def span(self, a: int, b: int) -> Range:
        # byte i lies in the letters of its first and last bit
        return self._at(self.skip + 8 * a // 6), self._at(self.skip + (8 * (b - 1) + 7) // 6) + 1


class Pieces:
    """Units that come in runs: from ``out`` on, each unit comes from ``step`` units, one after another from ``at`` on, or, where ``step`` is 0, all come
    from the ``size`` units there."""

    def __init__(self) -> None:
        self.out, self.at, self.step, self.size = (array("q") for _ in range(4))
        self.units = 0

    def add(self, at: int, units: int, step: int, size: int) -> None:
        if not (step and self.out and self.step[-1] == step and self.at[-1] + (self.units - self.out[-1]) * step == at):
            for held, value in ((self.out, self.units), (self.at, at), (self.step, step), (self.size, size)):
                held.append(value)
        self.units += units

    def _unit(self, unit: int) -> Range:
        k = bisect_right(self.out, unit) - 1
        if not self.step[k]:
            return self.at[k], self.at[k] + self.size[k]
        start = self.at[k] + (unit - self.out[k]) * self.step[k]
        return start, start + self.step[k]

    def span(self, a: int, b: int) -> Range:
        return self._unit(a)[0], self._unit(b - 1)[1]


class Decoded:
    """Characters of bytes: only those of several bytes are kept."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        wide = np.flatnonzero((code >= 0x80) & ~((code >= 0xDC80) & (code < 0xDD00)))
        extra = 1 + (code[wide] >= 0x800).astype(np.int8) + (code[wide] >= 0x10000)
        self.wide = wide.astype(np.int32)
        self.extra = np.concatenate([[0], np.cumsum(extra)]).astype(np.int32)

    def byte(self, char: int) -> int:
        return char + int(self.extra[np.searchsorted(self.wide, char)])

    def span(self, a: int, b: int) -> Range:
        return self.byte(a), self.byte(b)


@dataclass(frozen=True)
class Chain:
    """Units of a layer by way of the layer around it."""

    outer: object
    inner: object

    def span(self, a: int, b: int) -> Range:
        return self.outer.span(*self.inner.span(a, b))


def within(outer, inner):
    """The origin of a layer in the original text, from that of the layer around it (None: the text itself)."""
    if outer is None:
        return inner
    if isinstance(inner, Whole):
        return Whole(*outer.span(inner.start, inner.end))
    return outer if isinstance(outer, Whole) else Chain(outer, inner)
