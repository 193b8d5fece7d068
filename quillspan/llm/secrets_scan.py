"""Secret scans: fixed patterns, and an assignment-aware lexer that adds to them.

The lexer reads source and configuration syntax (``name = "literal"``, ``name: literal``, ``"name": "literal"``,
``name => literal``, ``export NAME=literal``, XML attributes, triple-quoted strings, YAML block scalars, ``a + b``) into
name-literal pairs; keys around (of YAML by indentation, of braces) are part of a name; ``#`` and ``//`` comments are passed over.
Constants are propagated forward through the text: a name gives what it holds to each name it is assigned to, and pieces put
together by ``+`` are one literal (of ``FOLDED`` characters at most; longer ones are judged piece by piece). A
literal is scored by the most sensitive of the names that it reaches, and by its form.

A text takes one pass forward and one back over its assignments, whatever they refer to.

Edge cases: a null or empty text has no spans; spans are in code points; the same text twice gives the same
spans; other columns are kept out of the result; an empty table gives no rows; what isn't closed ends with its line.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import common

Span = tuple[str, int, int]

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "lexed")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weights of the parts of a target name, out of 1.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.5, "key": 0.5, "access": 0.3, "signing": 0.4, "client": 0.2, "api": 0.4, "cert": 0.3, "salt": 0.5, "dsn": 0.5, "webhook": 0.4}
#: Parts that make a name about a secret, not one.
HARMLESS = {"name", "id", "path", "file", "url", "length", "len", "type", "field", "label", "regex", "pattern", "count", "size", "public", "policy", "prompt", "hint", "expires", "expiry", "ttl"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|change_?me|example.*|placeholder|your[-_ ].*|todo|none|null|true|false|undefined|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$")
THRESHOLD = 0.75

TOKEN = re.compile(
    r"""(?P<triple>\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3})|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|(?P<comment>\#[^\n]*|(?<![:\w])//[^\n]*)|(?P<name>[A-Za-z_][\w.\-]*)"""
    r"""|(?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]])|(?P<bare>[A-Za-z0-9+/_.=\-@!$%^&*~]+)|(?P<line>\n[ \t]*)|(?P<other>\S)""",
    re.ASCII,
)
#: A YAML block scalar: its key's indentation, and its lines.
BLOCK_SCALAR = re.compile(r"[|>][+\-0-9]*[ \t]*(?=\n)")
NAME, WORD = re.compile(r"[A-Za-z_][\w.\-]*$", re.ASCII), re.compile(r"[A-Za-z_][\w.]*", re.ASCII)
#: Characters of a literal put together from pieces, and its pieces, at most.
FOLDED, PIECES = 4096, 64
HEX_TABLE = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))


def base_spans(text: str, data: bytes) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    # Any 32 bytes hold 8 places that are multiples of 4.
    if b"11111111" in data[::4].translate(HEX_TABLE):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def name_weight(name: str) -> float:
    parts = [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    weight = sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined})
    if parts and parts[-1] in HARMLESS:
        weight -= 0.8
    return max(0.0, min(1.0, weight))


def form_weight(value: str) -> float:
    """How much a literal looks like a secret: long, mixed and of high entropy; 0 for placeholders and sentences."""
    if len(value) < 8 or PLACEHOLDER.match(value) or re.search(r"\s", value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.15 * classes + 0.12 * entropy + (0.2 if n >= 16 else 0.1))


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def tokens(text: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(text):
        kind, cut = m.lastgroup, {"triple": 3, "string": 1}.get(m.lastgroup, 0)
        if kind != "comment":
            s, e = m.span()
            out.append(Token("string" if kind == "triple" else kind, text[s + cut : e - cut], s + cut, e - cut))
    return out


@dataclass
class Held:
    """What an assignment gives to its name: literals, and earlier assignments that it refers to."""

    name: str
    literals: list[Token]
    refers: list[int]
    folded: list[Token] | None = None


def block_lines(text: str, at: int, indent: int) -> tuple[list[Token], int]:
    """The lines from ``at`` (a line's start) on that are indented more than ``indent``, and where they end."""
    out: list[Token] = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        body = text[at:end].strip()
        lead = end - at - len(text[at:end].lstrip())
        if body and lead <= indent:
            break
        if body:
            out.append(Token("string", body, at + lead, at + lead + len(body)))
        at = end + 1
    return out, at


def assignments(text: str) -> list[Held]:
    toks = tokens(text)
    out: list[Held] = []
    latest: dict[str, int] = {}
    around: list[tuple[str, int]] = []  # keys around: (name, indentation of a YAML key or -1 for braces)
    indent, i, at_start = 0, 0, True
    while i < len(toks):
        t = toks[i]
        if t.kind == "line":
            indent, at_start = len(t.text) - 1, True
            i += 1
            continue
        if at_start:
            while around and around[-1][1] >= indent:
                around.pop()
            at_start = False
        if t.kind == "op" and t.text == "}" and any(k < 0 for _, k in around):
            while around.pop()[1] >= 0:
                pass
        elif t.kind == "op" and t.text == "{":
            around.append(("", -1))
        nxt = toks[i + 1] if i + 1 < len(toks) else None
        if t.kind not in ("name", "string") or nxt is None or nxt.kind != "op" or nxt.text not in ("=", ":", ":=", "=>") or not NAME.match(t.text):
            i += 1
            continue
        j = i + 2
        if nxt.text == ":" and j + 1 < len(toks) and toks[j].kind == "name" and toks[j + 1].text in ("=", ":=") and toks[j + 1].kind == "op":
            j += 2  # name: type = literal
        name = ".".join([*(k for k, _ in around if k), t.text])
        if j >= len(toks) or toks[j].kind == "line":  # the key of what is indented below
            if nxt.text == ":":
                around.append((t.text, indent))
            i = j
            continue
        if toks[j].kind == "op" and toks[j].text == "{":
            around.append((t.text, -1))
            i = j + 1
            continue
        if nxt.text == ":" and (m := BLOCK_SCALAR.match(text, toks[j].start)):
            lines, end = block_lines(text, m.end() + 1, indent)
            out.append(Held(name, lines, [], lines if len(lines) <= PIECES else None))
            while j < len(toks) and toks[j].start < end - 1:
                j += 1
            i = j
            continue
        literals, refers, parts, whole = [], [], [], True
        while j < len(toks):
            o = toks[j]
            if o.kind == "string":
                literals.append(o)
                parts.append(o)
            elif o.kind in ("name", "bare"):
                end = o.end
                while j + 1 < len(toks) and toks[j + 1].kind in ("bare", "name", "other") and toks[j + 1].start == end:  # a bare word of several tokens
                    j += 1
                    end = toks[j].end
                word = Token("bare", text[o.start : end], o.start, end)
                k = latest.get(word.text)
                if not WORD.fullmatch(word.text):
                    literals.append(word)
                    parts.append(word)
                elif k is not None:
                    refers.append(k)
                    parts = parts + out[k].folded if out[k].folded is not None and len(parts) + len(out[k].folded) <= PIECES else parts
                    whole &= out[k].folded is not None
                elif re.search(r"\d", word.text):
                    literals.append(word)  # a bare word of letters and digits that names nothing
                    parts.append(word)
                else:
                    whole = False
            else:
                break
            j += 1
            if j < len(toks) and toks[j].kind == "op" and toks[j].text == "+":
                j += 1
                continue
            break
        if literals or refers:
            whole &= len(parts) <= PIECES and sum(p.end - p.start for p in parts) <= FOLDED
            latest[t.text] = len(out)
            out.append(Held(name, literals, refers, parts if whole else None))
        else:
            latest.pop(t.text, None)
        i = max(j, i + 1)
    return out


def lexed_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals that reach a sensitive name."""
    if "=" not in text and ":" not in text:
        return []
    held = assignments(text)
    reach = [name_weight(h.name) for h in held]
    for k in range(len(held) - 1, -1, -1):  # what refers to an assignment comes after it
        for r in held[k].refers:
            reach[r] = max(reach[r], reach[k])
    best: dict[tuple[int, int], float] = {}
    for h, weight in zip(held, reach, strict=True):
        if not weight:
            continue
        for literal in h.literals:
            tell(best, [literal], literal.text, weight)
        if h.folded and len(h.folded) > 1:
            tell(best, h.folded, "".join(p.text for p in h.folded), weight)
    return [(s, e, v) for (s, e), v in best.items()]


def tell(best: dict[tuple[int, int], float], pieces: list[Token], value: str, weight: float) -> None:
    form = form_weight(value)
    score = 0.6 * weight + 0.4 * form if form else 0.0
    if score >= THRESHOLD:
        for p in pieces:
            best[p.start, p.end] = max(score, best.get((p.start, p.end), 0.0))


def outside(spans: list[tuple[int, int, float]], base: list[Span]) -> list[tuple[int, int, float]]:
    """Those of the spans that lie within none of ``base`` (by start)."""
    starts = [b for _, b, _ in base]
    reach = list(accumulate((c for _, _, c in base), max))
    return [x for x in spans if (i := bisect_right(starts, x[0])) == 0 or reach[i - 1] < x[1]]


def scan(text: str, data: bytes | None = None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by start, then kind as listed. A literal within a base span isn't told twice."""
    base = base_spans(text, text.encode("utf-8", "surrogatepass") if data is None else data)
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base.sort(key=order)
    added = [("lexed", s, e) for s, e, _ in outside(lexed_spans(text), base)]
    return base, sorted(base + added, key=order) if added else base


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document; narrow, in one pass over the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in KINDS}
            base_of, all_of = [], []
            for t in batch.column(1).to_pylist():
                base, every = scan(t) if t else ([], [])
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in every))
                base_of.append(hashlib.sha256(listed(base).encode()).hexdigest())
                all_of.append(listed(every))
            n = lambda k: pa.array(counts[k], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_assign": n("assign"), "n_access": n("access"), "n_hex": n("hex"), "base_sha256": base_of, "spans": all_of, "n_lexed": n("lexed")})

    common.small_batches(df.sparkSession)
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(common.lean(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")
