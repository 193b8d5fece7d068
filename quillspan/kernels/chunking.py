"""Lossless segmentation into spans, budgeted packing, recursive refinement."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate

from quillspan.kernels.positions import Source

#: White space of Unicode at which words end (not U+001C to U+001F).
WORD_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f"[^{WORD_SPACE}]+")
LINE = re.compile(r"[^\n]*\n|[^\n]+")
MEASURES = ("bytes", "runes", "words")
LEVELS = ("markdownSections", "markdownBlocks", "paragraphs", "lines", "runes")
ATOMIC = ("fencedCodeBlock", "codeBlock", "htmlBlock")


class ChunkingError(ValueError):
    """A bad option or input; ``code`` names it."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"chunking: {code}: {message}")
        self.code = code


@dataclass
class Span:
    ordinal: int
    kind: str
    text: str
    start_byte: int
    end_byte: int
    start_rune: int
    end_rune: int
    start_line: int
    start_column: int
    end_line: int
    end_column: int
    atomic: bool = False
    heading_level: int = 0
    heading_path: list[str] = field(default_factory=list)
    language: str = ""
    level: str = ""


@dataclass
class Chunk:
    ordinal: int
    text: str
    start_byte: int
    end_byte: int
    start_rune: int
    end_rune: int
    span_ordinals: list[int]
    heading_path: list[str]
    weight: int
    oversized: bool = False
    level: str = ""
    diagnostics: list[dict] = field(default_factory=list)


def cut(source: Source, pieces: list[tuple[int, int, str]]) -> list[Span]:
    """Spans of (start, end, kind); empty pieces are left out."""
    out: list[Span] = []
    for a, b, kind in pieces:
        if a < b:
            out.append(Span(len(out), kind, source.text[a:b], source.byte(a), source.byte(b), a, b, *source.rune_position(a), *source.rune_position(b)))
    return out


def lines(text: str, keep_terminators: bool = True) -> list[Span]:
    pieces = []
    for m in LINE.finditer(text):
        a, b = m.span()
        if keep_terminators or text[b - 1] != "\n":
            pieces.append((a, b, "line"))
            continue
        end = b - (2 if text[a:b].endswith("\r\n") else 1)
        pieces += [(a, end, "line"), (end, b, "lineTerminator")]
    return cut(Source(text), pieces)


def blank_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of blank lines that don't start the text."""
    runs: list[list[int]] = []
    open_ = False
    for m in LINE.finditer(text):
        body = m[0].removesuffix("\n").removesuffix("\r")
        if body.strip(" \t"):
            open_ = False
        elif open_:
            runs[-1][1] = m.end()
        else:
            runs.append([m.start(), m.end()])
            open_ = True
    return [(a, b) for a, b in runs if a > 0]


def paragraphs(text: str, blank_lines: str = "trailing") -> list[Span]:
    if blank_lines not in ("trailing", "separate", "leading"):
        raise ChunkingError("unknown_option", f"blankLines {blank_lines!r}")
    pieces, at = [], 0
    for a, b in blank_runs(text):
        if blank_lines == "separate":
            pieces += [(at, a, "paragraph"), (a, b, "paragraphSeparator")]
        else:
            pieces.append((at, b if blank_lines == "trailing" else a, "paragraph"))
        at = a if blank_lines == "leading" else b
    return cut(Source(text), [*pieces, (at, len(text), "paragraph")])


def markdown_blocks(text: str, atomic: tuple[str, ...] = ATOMIC) -> list[Span]:
    from quillspan.kernels.markdown import parse

    if not text:
        return []
    blocks = parse(text).children
    if not blocks:
        return cut(Source(text), [(0, len(text), "text")])
    starts = [0, *(b.start for b in blocks[1:]), len(text)]
    pieces = [(a, b, n.type) for a, b, n in zip(starts, starts[1:], blocks, strict=False)]
    nodes = [n for (a, b, _), n in zip(pieces, blocks, strict=True) if a < b]
    spans = cut(Source(text), pieces)
    for s, n in zip(spans, nodes, strict=True):
        s.atomic, s.heading_level, s.language = s.kind in atomic, n.level if n.type == "heading" else 0, n.language
    return spans


def markdown_sections(text: str, max_heading_level: int = 6) -> list[Span]:
    from quillspan.kernels.markdown import parse

    most = max_heading_level or 6
    if not 1 <= most <= 6:
        raise ChunkingError("invalid_option", "maxHeadingLevel must be 1 to 6")
    if not text:
        return []
    heads = [n for n in parse(text).children if n.type == "heading" and n.level <= most]
    bounds = [0, *(n.start for n in heads), len(text)]
    spans = cut(Source(text), [(a, b, "preamble" if i == 0 else "section") for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])
    stack = [""] * 6
    at = len(spans) - len(heads)
    for s, n in zip(spans[at:], heads, strict=True):
        stack[n.level - 1 :] = [n.text_content().strip(), *[""] * (6 - n.level)]
        s.heading_level, s.heading_path = n.level, [t for t in stack if t]
    return spans


def windows(text: str, most: int, measure: str = "runes") -> list[Span]:
    """Windows of at most ``most`` code points or bytes; a code point isn't cut. Words give paragraphs."""
    if measure == "words":
        return paragraphs(text)
    source = Source(text)
    pieces, at = [], 0
    while at < len(text):
        if measure == "runes":
            end = min(len(text), at + most)
        else:
            end = at + 1
            while end < len(text) and source.byte(end + 1) - source.byte(at) <= most:
                end += 1
        pieces.append((at, end, "runes"))
        at = end
    return cut(source, pieces)


def measure_text(text: str, measure: str = "runes") -> int:
    if measure == "bytes":
        return len(text.encode("utf-8", "surrogatepass"))
    if measure == "words":
        return sum(1 for _ in WORD.finditer(text))
    return len(text)


def validate(spans: list[Span], text: str | None = None) -> None:
    """Gapless from 0, dense ordinals, lengths that match; with ``text`` also covering it."""
    at_byte = at_rune = 0
    for i, s in enumerate(spans):
        n = len(s.text.encode("utf-8", "surrogatepass"))
        if s.ordinal != i or s.start_byte != at_byte or s.start_rune != at_rune or s.end_byte - s.start_byte != n or s.end_rune - s.start_rune != len(s.text):
            raise ChunkingError("invalid_range", f"span {i}")
        at_byte, at_rune = s.end_byte, s.end_rune
    if text is not None and "".join(s.text for s in spans) != text:
        raise ChunkingError("invalid_range", "spans don't cover the source")


class Weighed:
    """Spans with running sums of their weights: a chunk is a pair of cuts, its weight the difference of two sums."""

    def __init__(self, spans: list[Span], weights: list[int], budget: int, oversized: str) -> None:
        for i, w in enumerate(weights):
            if w < 0:
                raise ChunkingError("invalid_weight", f"span {i} has a negative weight")
            if w > budget and oversized == "error":
                raise ChunkingError("span_exceeds_budget", f"span {i} weighs {w}, budget {budget}")
        self.spans, self.budget = spans, budget
        self.sums = [0, *accumulate(weights)]
        self.large = [i for i, w in enumerate(weights) if w > budget]
        self.text = "".join(s.text for s in spans)
        self.places = [0, *accumulate(len(s.text) for s in spans)]

    def cuts(self, overlap: int = 0) -> Iterator[tuple[int, int]]:
        """(first span, span after the last) of each chunk; spans over the budget are alone."""
        sums, n = self.sums, len(self.spans)
        stops = iter([*self.large, n])
        at, stop, start = 0, next(stops), 0
        while at < n:
            if at == stop:  # too large; nothing overlaps it
                yield at, at + 1
                at = start = at + 1
                stop = next(stops)
                continue
            end = min(stop, bisect_right(sums, sums[start] + self.budget) - 1)
            yield start, end
            if end < stop:  # as many of the last spans again as leave room for the next one
                start = max(start, end - overlap, bisect_left(sums, sums[end + 1] - self.budget))
            else:
                start = end
            at = end

    def within(self, end: int, weight: int) -> int:
        """The first of the spans up to a cut that together weigh at most so much."""
        return bisect_left(self.sums, self.sums[end] - weight)

    def chunk(self, a: int, b: int, ordinal: int) -> Chunk:
        first, last, own = self.spans[a], self.spans[b - 1], self.spans[a:b]
        large = b - a == 1 and self.sums[b] - self.sums[a] > self.budget
        told = [{"code": "span_exceeds_budget", "severity": "warning", "message": f"span {a} exceeds budget", "start_byte": first.start_byte, "end_byte": first.end_byte}] if large else []
        path = next((s.heading_path for s in own if s.heading_path), [])
        level = next((s.level for s in own if s.level), "")
        return Chunk(ordinal, self.text[self.places[a] : self.places[b]], first.start_byte, last.end_byte, first.start_rune, last.end_rune, list(range(a, b)), list(path), self.sums[b] - self.sums[a], large, level, told)


def check_pack(budget: int, overlap: int, oversized: str, measure: str = "runes", unit: str = "spans") -> None:
    if budget <= 0 or overlap < 0 or oversized not in ("allow", "error") or measure not in MEASURES or unit != "spans":
        raise ChunkingError("invalid_option", f"budget {budget}, measure {measure!r}, overlap {overlap} {unit!r}, oversized {oversized!r}")


def packed(spans: list[Span], measure: str, budget: int, overlap: int, oversized: str) -> list[Chunk]:
    w = Weighed(spans, [measure_text(s.text, measure) for s in spans], budget, oversized)
    return [w.chunk(a, b, i) for i, (a, b) in enumerate(w.cuts(overlap))]


def pack(spans: list[Span], max_units: int, measure: str = "runes", overlap: int = 0, oversized: str = "allow", unit: str = "spans") -> list[Chunk]:
    check_pack(max_units, overlap, oversized, measure, unit)
    validate(spans)
    return packed(spans, measure, max_units, overlap, oversized)


def pack_weighted(spans: list[Span], weights: list[int], max_weight: int, overlap_weight: int = 0, oversized: str = "allow") -> list[Chunk]:
    """Packing by the caller's weights; each chunk also begins with the last whole spans of the one before, within the overlap's weight and its own room."""
    check_pack(max_weight, overlap_weight, oversized)
    validate(spans)
    if len(spans) != len(weights):
        raise ChunkingError("invalid_weight", "spans and weights differ in length")
    w = Weighed(spans, weights, max_weight, oversized)
    chunks: list[Chunk] = []
    start = 0
    for a, b in w.cuts():
        start = min(a, max(start, w.within(a, overlap_weight), w.within(b, max_weight))) if overlap_weight and chunks else a
        chunks.append(w.chunk(start, b, len(chunks)))
    return chunks


def segment(text: str, level: str, most: int, measure: str, atomic: tuple[str, ...]) -> list[Span]:
    if level == "markdownSections":
        return markdown_sections(text)
    if level == "markdownBlocks":
        return markdown_blocks(text, atomic)
    if level == "paragraphs":
        return paragraphs(text)
    if level == "lines":
        return lines(text)
    if level == "runes":
        return windows(text, most, measure)
    raise ChunkingError("unknown_recursive_level", level)


def recursive_leaves(text: str, max_units: int, measure: str = "runes", levels: tuple[str, ...] = LEVELS, atomic: tuple[str, ...] = ATOMIC) -> list[Span]:
    source = Source(text)
    leaves: list[Span] = []

    def refine(s: Span, k: int) -> None:
        if measure_text(s.text, measure) <= max_units or s.atomic or k >= len(levels):
            leaves.append(s)
            return
        children = []
        for c in segment(s.text, levels[k], max_units, measure, atomic):
            a, b = s.start_rune + c.start_rune, s.start_rune + c.end_rune
            (line, column), (end_line, end_column) = source.rune_position(a), source.rune_position(b)
            children.append(replace(c, start_byte=source.byte(a), end_byte=source.byte(b), start_rune=a, end_rune=b, start_line=line, start_column=column, end_line=end_line, end_column=end_column, heading_path=c.heading_path or s.heading_path, level=levels[k]))
        if len(children) == 1:  # the same range again
            children[0].atomic |= s.atomic
        for c in children:
            refine(c, k + 1)

    refine(Span(0, "source", text, 0, source.byte(len(text)), 0, len(text), 1, 1, *source.rune_position(len(text))), 0)
    for i, s in enumerate(leaves):
        s.ordinal = i
    return leaves


def recursive(text: str, max_units: int, measure: str = "runes", levels: tuple[str, ...] = LEVELS, overlap: int = 0, oversized: str = "allow", atomic: tuple[str, ...] = ATOMIC, unit: str = "spans") -> list[Chunk]:
    check_pack(max_units, overlap, oversized, measure, unit)
    leaves = recursive_leaves(text, max_units, measure, tuple(levels), tuple(atomic))
    return packed(leaves, measure, max_units, overlap, oversized)
