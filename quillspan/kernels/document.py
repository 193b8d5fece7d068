"""Documents of front matter, body and named blocks."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from dataclasses import dataclass, field

from quillspan.kernels.sanitize import load_yaml, sanitize, strict_json

SPLIT = re.compile(r"---[\t\n\f\r ]*\r?\n(.*?)\r?\n---[\t\n\f\r ]*\r?\n?", re.S)
OPENER = re.compile(r"<[\t\n\f\r ]*([a-z][a-z0-9_-]*)\b[^>]*>", re.I | re.S | re.A)
FENCE = re.compile(r"```([^\n\r`]*)\r?\n(.*?)\r?\n```", re.S)
LABEL, NAME = re.compile(r"[a-z0-9][a-z0-9_-]*"), re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")


class DocumentError(ValueError):
    pass


@dataclass(frozen=True)
class FieldRule:
    name: str
    type: str = "string"
    required: bool = False
    default: object = None


@dataclass(frozen=True)
class BlockRule:
    """A named block: from tags, fences, or both; ``json``: parse its text, after repair if ``repair``."""

    name: str
    tags: tuple[str, ...] = ()
    fences: tuple[str, ...] = ()
    json: bool = False
    repair: bool = False
    required: bool = False
    strip: bool = False


@dataclass(frozen=True)
class Spec:
    fields: tuple[FieldRule, ...] = ()
    blocks: tuple[BlockRule, ...] = ()
    frontmatter_required: bool = False
    repair_frontmatter: bool = False

    def errors(self) -> list[str]:
        out, seen = [], set()
        for f in self.fields:
            if not NAME.fullmatch(f.name):
                out.append(f"invalid field name {f.name!r}")
            if f.type not in ("string", "number", "bool"):
                out.append(f"field {f.name!r}: unsupported type {f.type!r}")
            elif f.default is not None and not fits(f.default, f.type):
                out.append(f"field {f.name!r}: default is no {f.type}")
            if f.name in seen:
                out.append(f"duplicate field {f.name!r}")
            seen.add(f.name)
        seen = set()
        for b in self.blocks:
            for label in (b.name, *b.tags, *b.fences):
                if not LABEL.fullmatch(label):
                    out.append(f"invalid block label {label!r}")
            if not b.tags and not b.fences:
                out.append(f"block {b.name!r} has no source")
            if b.name in seen:
                out.append(f"duplicate block {b.name!r}")
            seen.add(b.name)
        return out


@dataclass
class Block:
    """Offsets are bytes of the body."""

    name: str
    kind: str
    text: str
    raw: str
    start: int
    end: int
    json_value: str | None = None


@dataclass
class Document:
    source: str
    body: str
    frontmatter: dict = field(default_factory=dict)
    blocks: list[Block] = field(default_factory=list)
    has_frontmatter: bool = False


def split(text: str) -> tuple[str | None, str]:
    """(front matter or None, body)."""
    m = SPLIT.match(text)
    return (m[1], text[m.end() :]) if m else (None, text)


def fits(value: object, kind: str) -> bool:
    if kind == "bool":
        return isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, str)


def front_values(raw: str | None, spec: Spec) -> dict:
    if raw is None:
        if spec.frontmatter_required:
            raise DocumentError("front matter is required")
        raw = ""
    if spec.repair_frontmatter:
        raw = sanitize(raw, "yaml").sanitized
    ok, error, value = load_yaml(raw) if raw.strip() else (True, "", {})
    if not ok:
        raise DocumentError(f"front matter: {error}")
    value = {} if value is None else value
    if not isinstance(value, dict):
        raise DocumentError("front matter is no mapping")
    out = {str(k): v for k, v in value.items()}
    for f in spec.fields:
        v = out.get(f.name)
        if v is None or f.type == "string" and v == "":
            if f.default is not None:
                out[f.name] = f.default
            elif f.required:
                raise DocumentError(f"field {f.name!r} is required")
        elif not fits(v, f.type):
            raise DocumentError(f"field {f.name!r}: expected {f.type}, got {type(v).__name__}")
    return out


class Tags:
    """The tags of one name in a text, with the closing tag of each place, in one pass.

    With each tag the number of open ones goes up or down by one; the tag that closes what begins at a place is where
    it first falls below its value there, which a stack of places still waiting tells for all.
    """

    def __init__(self, text: str, name: str, end: int) -> None:
        self.spans: list[tuple[int, int]] = []
        steps = []
        for m in re.compile(rf"<[\t\n\f\r ]*(/)?[\t\n\f\r ]*{re.escape(name)}\b[^>]*>", re.I | re.S | re.A).finditer(text, 0, end):
            self.spans.append(m.span())
            steps.append(-1 if m[1] else 0 if m[0].rstrip(">").rstrip().endswith("/") else 1)
        self.starts = [a for a, _ in self.spans]
        self.closer: list[int | None] = [None] * (len(steps) + 1)
        waiting, depth = [(0, 0)], 0  # (place among the tags, open ones there)
        for i, step in enumerate(steps):
            depth += step
            while waiting and waiting[-1][1] > depth:
                self.closer[waiting.pop()[0]] = i
            waiting.append((i + 1, depth))

    def closing(self, at: int) -> tuple[int, int] | None:
        """(start, end) of the tag that closes the one before ``at``; nested ones are counted."""
        i = self.closer[bisect_left(self.starts, at)]
        return None if i is None else self.spans[i]


def find_blocks(body: str, rule: BlockRule) -> list[Block]:
    out: list[Block] = []
    if rule.tags:
        until, end = 0, body.rfind(">") + 1  # no tag ends after that
        known: dict[str, Tags] = {}
        for m in OPENER.finditer(body, 0, end):
            name = m[1].lower()
            if name in rule.tags and m.start() >= until:
                tags = known[name] = known.get(name) or Tags(body, name, end)
                if c := tags.closing(m.end()):
                    out.append(Block(rule.name, "xml", body[m.end() : c[0]], body[m.start() : c[1]], m.start(), c[1]))
                    until = c[1]
    if rule.fences:
        for m in FENCE.finditer(body):
            words = m[1].split()
            if words and words[0].lower() in rule.fences:
                out.append(Block(rule.name, "fence", m[2], m[0], *m.span()))
    return out


def json_of(text: str, repair: bool) -> str:
    text = text.strip()
    if repair:
        text = sanitize(text, "json").sanitized
    ok, error, value = strict_json(text)
    if not ok:
        raise DocumentError(f"block JSON: {error}")
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def build(text: str, spec: Spec = Spec()) -> Document:
    """Split, read and check the front matter, find the blocks, strip those that are to go from the body."""
    if errors := spec.errors():
        raise DocumentError("; ".join(errors))
    raw, body = split(text)
    doc = Document(text, body, front_values(raw, spec), has_frontmatter=raw is not None)
    gone: list[tuple[int, int]] = []
    for rule in spec.blocks:
        found = find_blocks(body, rule)
        if rule.required and not found:
            raise DocumentError(f"block {rule.name!r} is required")
        for b in found:
            if rule.json:
                b.json_value = json_of(b.text, rule.repair)
            if rule.strip:
                gone.append((b.start, b.end))
        doc.blocks += found
    doc.blocks.sort(key=lambda b: b.start)
    for a, b in sorted(gone, reverse=True):
        if b <= len(doc.body):
            doc.body = doc.body[:a] + doc.body[b:]
    size = lambda n: len(body[:n].encode("utf-8", "surrogatepass"))
    for b in doc.blocks:
        b.start, b.end = size(b.start), size(b.end)
    return doc


#: Words that strings of front matter may give booleans as.
TRUE, FALSE = ("1", "t", "T", "TRUE", "true", "True"), ("0", "f", "F", "FALSE", "false", "False")


def get_string(values: dict, key: str, fallback: str = "") -> str:
    v = values.get(key)
    if v is None or v == "":
        return fallback
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)


def get_number(values: dict, key: str, fallback: float = 0.0) -> float:
    v = values.get(key)
    try:
        return fallback if v is None or isinstance(v, bool) else float(v)
    except (TypeError, ValueError):
        return fallback


def get_bool(values: dict, key: str, fallback: bool = False) -> bool:
    v = values.get(key)
    if isinstance(v, bool):
        return v
    word = v.strip() if isinstance(v, str) else ""
    return True if word in TRUE else False if word in FALSE else fallback


def first_heading(body: str) -> str:
    from quillspan.kernels.markdown import parse

    return next((t for n in parse(body).walk() if n.type == "heading" and (t := n.text_content().strip())), "")
