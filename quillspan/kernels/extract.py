"""Structured payloads within larger text: front matter, fences, XML-like tags, whole-text JSON and YAML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from quillspan.kernels.positions import Source
from quillspan.kernels.sanitize import sanitize, strict_json

#: Default tags, extractors and formats.
TAGS = ("json", "yaml", "xml", "data", "result", "answer", "tool_call", "arguments", "payload")
EXTRACTORS = ("frontmatter", "markdowncodeblocks", "xmltagged", "rawstructured")
FORMATS = ("json", "yaml", "yml", "xml", "toml", "text", "unknown")
GENERIC = {"data", "result", "answer", "payload", "arguments", "tool_call"}
MAPPING = re.compile(r"^[\t\n\f\r ]*[^#\t\n\f\r ][^:\n]+:[\t\n\f\r ]+[^\n]+$", re.M)
LISTING = re.compile(r"^[\t\n\f\r ]*-[\t\n\f\r ]+[^\n]+$", re.M)
OPEN_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)")


class ExtractError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    formats: tuple[str, ...] = ()
    tags: tuple[str, ...] = TAGS
    extractors: tuple[str, ...] = EXTRACTORS
    include_diagnostics: bool = False
    infer_format: bool = True
    min_confidence: float = 0.0
    max_candidates: int = 0

    @classmethod
    def of(cls, **given: object) -> Options:
        """Lists are lower-cased and trimmed; empty ones mean the defaults."""
        for k in ("formats", "tags", "extractors"):
            if k in given:
                given[k] = tuple(str(v).strip().lower() for v in given[k] or ())
        out = cls(**given)
        errors = [f"unknown format {f!r}" for f in out.formats if f not in FORMATS] + [f"unknown extractor {e!r}" for e in out.extractors if e not in EXTRACTORS]
        errors += [f"invalid tag {t!r}" for t in out.tags if not t or re.search(r"[ <>/\t\n\r]", t)]
        if not 0 <= out.min_confidence <= 1:
            errors.append("minConfidence must be between 0 and 1")
        if out.max_candidates < 0:
            errors.append("maxCandidates must be >= 0")
        if errors:
            raise ExtractError("; ".join(errors))
        return replace(out, tags=out.tags or TAGS, extractors=out.extractors or EXTRACTORS)

    def kept(self, found: list[Candidate]) -> list[Candidate]:
        out = [c for c in found if (not self.formats or c.format == "unknown" or c.format in self.formats) and c.confidence >= self.min_confidence]
        out = out[: self.max_candidates or None]
        return out if self.include_diagnostics else [replace(c, diagnostics=[]) for c in out]


@dataclass
class Candidate:
    """Places are code points here; ``rows`` adds bytes, rows and columns."""

    kind: str
    format: str
    text: str
    raw: str
    wrapper: str
    label: str
    info: str
    start: int
    end: int
    payload_start: int
    payload_end: int
    confidence: float
    diagnostics: list[str] = field(default_factory=list)


def format_of_label(label: str) -> str:
    words = label.strip().lower().split()
    if not words:
        return "unknown"
    return {"jsonc": "json", "yml": "yaml"}.get(words[0], "unknown" if words[0] in GENERIC else words[0])


def format_of_payload(text: str) -> str:
    t = text.strip()
    if t.startswith("{") and t.endswith("}") or t.startswith("[") and t.endswith("]"):
        return "json"
    return "yaml" if "\n" in t and ":" in t else "unknown"


def frontmatter(text: str, options: Options = Options()) -> list[Candidate]:
    first = text.find("\n")
    if (text if first < 0 else text[:first]).strip() != "---":
        return []
    begin = at = len(text) if first < 0 else first + 1
    while at < len(text):
        end = text.find("\n", at)
        line = text[at:] if end < 0 else text[at:end]
        stop = len(text) if end < 0 else end + 1
        if line.strip() == "---":
            return options.kept([Candidate("frontmatter", "yaml", text[begin:at], text[:stop], "frontmatter", "yaml", "", 0, stop, begin, at, 0.98)])
        at = stop
    if not options.include_diagnostics:
        return []
    return options.kept([Candidate("frontmatter", "yaml", text[begin:], text, "frontmatter", "yaml", "", 0, len(text), begin, len(text), 0.4, ["missing closing frontmatter delimiter"])])


def fences(text: str, options: Options = Options()) -> list[Candidate]:
    out: list[Candidate] = []
    at = 0
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop + 1
        m = OPEN_FENCE.match(text, at, stop)
        if not m:
            at = stop
            continue
        mark, info = m[1], m[2].strip()
        label = info.split()[0].lower() if info else ""
        kind = format_of_label(label) if options.infer_format else "unknown"
        begin, close = stop, re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t\r]*(?:\n|\Z)")
        line, end = stop, None
        while line < len(text) and end is None:
            c = close.match(text, line)
            if c:
                end = c.end()
            else:
                nxt = text.find("\n", line)
                line = len(text) if nxt < 0 else nxt + 1
        payload_end = line if end is not None else len(text)
        body = text[begin:payload_end]
        stop = end if end is not None else len(text)
        out.append(Candidate("markdownCodeBlock", kind, body, text[m.start(1) : stop], "markdownFence", label, info, m.start(1), stop, begin, payload_end, 0.95 if end is not None else 0.6, [] if end is not None else ["unterminated markdown fence"]))
        at = stop
    return options.kept(out)


def xml_tagged(text: str, options: Options = Options()) -> list[Candidate]:
    """Tags in the order of the options: what an earlier tag covers isn't told again. The first closing tag counts."""
    out: list[Candidate] = []
    covered: list[tuple[int, int]] = []
    for tag in options.tags:
        close = f"</{tag}>"
        for m in re.compile(rf"<{re.escape(tag)}(?:[\t\n\f\r ][^>]*)?>", re.S).finditer(text):
            end = text.find(close, m.end())
            stop = m.end() if end < 0 else end + len(close)
            if any(m.start() < b and a < stop for a, b in covered):
                continue
            label = format_of_label(tag)
            if end >= 0:
                body = text[m.end() : end]
                kind = (label if label != "unknown" else format_of_payload(body)) if options.infer_format else "unknown"
                covered.append((m.start(), stop))
                out.append(Candidate("xmlTagged", kind, body, text[m.start() : stop], "xmlTag", tag, m[0], m.start(), stop, m.end(), end, 0.9))
            elif options.include_diagnostics:
                out.append(Candidate("xmlTagged", label, "", m[0], "xmlTag", tag, "", m.start(), stop, stop, stop, 0.3, ["missing closing tag"]))
    return options.kept(sorted(out, key=lambda c: (c.start, c.end)))


def raw_structured(text: str, options: Options = Options()) -> list[Candidate]:
    t = text.strip(" \t\n\r")
    if not t:
        return []
    a = len(text) - len(text.lstrip(" \t\n\r"))
    found = None
    if t[0] == "{" and "}" in t or t[0] == "[" and "]" in t:
        if strict_json(t)[0]:
            found = ("json", 0.98)
        elif sanitize(t, "json").strict_parse_clean:
            found = ("json", 0.75)
    elif t[0] not in "{[":
        n = len(MAPPING.findall(t))
        if n >= 2 or n and LISTING.search(t):
            r = sanitize(t, "yaml")
            if r.parse_clean or r.lint_clean or r.fixes:
                found = ("yaml", 0.9 if r.parse_clean and r.lint_clean else 0.7)
    if found is None:
        return []
    return options.kept([Candidate("raw", found[0], t, t, "none", found[0], "", a, a + len(t), a, a + len(t), found[1])])


RUN = {"frontmatter": frontmatter, "markdowncodeblocks": fences, "xmltagged": xml_tagged, "rawstructured": raw_structured}


def extract_all(text: str, options: Options = Options()) -> list[Candidate]:
    found = [c for name in EXTRACTORS if name in options.extractors for c in RUN[name](text, options)]
    return options.kept(sorted(found, key=lambda c: (c.start, c.end)))


def rows(text: str, found: list[Candidate]) -> list[dict]:
    """Candidates with 0-based rows and byte columns."""
    source, out = Source(text), []
    for c in found:
        row = {k: getattr(c, k) for k in ("kind", "format", "text", "raw", "wrapper", "label", "info")}
        for name, a, b in (("", c.start, c.end), ("payload_", c.payload_start, c.payload_end)):
            (r1, c1), (r2, c2) = source.byte_position(a, 0), source.byte_position(b, 0)
            row |= {f"{name}start_byte": source.byte(a), f"{name}end_byte": source.byte(b), f"{name}start_row": r1, f"{name}start_column": c1, f"{name}end_row": r2, f"{name}end_column": c2}
        out.append(row | {"confidence": c.confidence, "diagnostics": c.diagnostics})
    return out


def validate(format_: str, text: str, wrapper: str) -> dict:
    """valid, format, sanitized, errors, fixes and issues of a candidate's text."""
    kind = format_ if format_ not in ("", "unknown", None) else format_of_payload(text)
    none: dict = {"valid": False, "format": kind, "sanitized": text, "errors": [], "fixes": [], "issues": []}
    if kind == "json":
        if strict_json(text)[0]:
            return none | {"valid": True}
        r = sanitize(text, "json")
        valid = r.strict_parse_clean
    elif kind in ("yaml", "yml"):
        r = sanitize(text, "yaml")
        valid = r.parse_clean and r.lint_clean
    elif kind == "xml":
        ok = wrapper == "xmlTag" and bool(text.strip())
        return none | {"valid": ok, "errors": [] if ok else ["empty or unwrapped XML"]}
    else:
        return none | {"errors": [f"unsupported format {kind!r}"]}
    return {"valid": valid, "format": kind, "sanitized": r.sanitized, "errors": r.errors, "fixes": [vars(f) for f in r.fixes], "issues": issue_rows(r.sanitized, r.issues)}


def issue_rows(text: str, issues: list) -> list[dict]:
    source, out = Source(text), []
    for i in issues:
        (r1, c1), (r2, c2) = source.byte_position(i.start, 0), source.byte_position(i.end, 0)
        out.append({"rule": i.rule, "source": text[i.start : i.end], "description": i.description, "start_byte": source.byte(i.start), "end_byte": source.byte(i.end), "start_row": r1, "start_col": c1, "end_row": r2, "end_col": c2, "row": r1})
    return out
