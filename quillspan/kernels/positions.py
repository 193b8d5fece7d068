"""Places in a text: code points, UTF-8 bytes, lines and columns, from one pass."""

from __future__ import annotations

from bisect import bisect_right
from functools import cached_property
from itertools import accumulate


def width(ch: str) -> int:
    c = ord(ch)
    return 1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4


class Source:
    """A text with its places. Offsets into it are code points unless told otherwise."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def bytes_before(self) -> range | list[int]:
        """UTF-8 bytes before each code point."""
        if self.text.isascii():
            return range(len(self.text) + 1)
        return [0, *accumulate(map(width, self.text))]

    @cached_property
    def line_starts(self) -> list[int]:
        out, at = [0], self.text.find("\n")
        while at >= 0:
            out.append(at + 1)
            at = self.text.find("\n", at + 1)
        return out

    def byte(self, at: int) -> int:
        return self.bytes_before[at]

    def line(self, at: int) -> int:
        """0-based."""
        return bisect_right(self.line_starts, at) - 1

    def rune_position(self, at: int) -> tuple[int, int]:
        """1-based line and column in code points."""
        k = self.line(at)
        return k + 1, at - self.line_starts[k] + 1

    def byte_position(self, at: int, base: int = 1) -> tuple[int, int]:
        """Line and column in bytes."""
        k = self.line(at)
        return k + base, self.byte(at) - self.byte(self.line_starts[k]) + base
