"""Templates in the syntax of Go's text/template and html/template, with a small set of helpers.

HTML mode escapes by context: text, quoted attribute, URL attribute. An action within a script or style, or in an
unquoted attribute, is refused when parsed instead of being escaped wrongly.
"""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass, field

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
LEX = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<num>-?\d+(?:\.\d+)?)|(?P<var>\$[A-Za-z0-9_]*)|(?P<field>\.[A-Za-z_][A-Za-z0-9_]*|\.)|(?P<id>[A-Za-z_][A-Za-z0-9_]*)|(?P<op>:=|=|\||\(|\)|,))""")
URL_ATTRIBUTES = {"href", "src", "action", "formaction", "cite", "poster", "data", "background"}
MISSING_KEY = ("default", "invalid", "zero", "error")
FUNC_SETS = ("none", "sprig", "extra")


class TemplateError(ValueError):
    pass


class Html(str):
    """Text that is safe as it is."""


def truth(v: object) -> bool:
    return bool(v) if not isinstance(v, float) else v != 0


def show(v: object) -> str:
    if v is None:
        return "<no value>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else repr(v)
    if isinstance(v, (list, tuple)):
        return f"[{' '.join(map(show, v))}]"
    if isinstance(v, dict):
        return f"map[{' '.join(f'{k}:{show(v[k])}' for k in sorted(v))}]"
    return str(v)


def to_yaml(v: object, indent: int = 0) -> str:
    pad = " " * indent
    if isinstance(v, dict):
        return "".join(f"{pad}{k}:{chr(10) + to_yaml(x, indent + 4) if isinstance(x, (dict, list)) and x else ' ' + to_yaml(x)}" for k, x in sorted(v.items())) or "{}\n"
    if isinstance(v, (list, tuple)):
        return "".join(f"{pad}- {to_yaml(x, indent + 2).lstrip() if isinstance(x, (dict, list)) else to_yaml(x)}" for x in v) or "[]\n"
    if isinstance(v, str):
        return (json.dumps(v, ensure_ascii=False) if not v or re.search(r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|: |\s#|\n|\s$|^(?:true|false|null|~|[-+.\d]+)$", v) else v) + "\n"
    return ("null" if v is None else show(v)) + "\n"


def printf(fmt: str, *args: object) -> str:
    left = list(args)

    def one(m: re.Match) -> str:
        if m[2] == "%":
            return "%"
        if not left:
            return f"%!{m[2]}(MISSING)"
        v = left.pop(0)
        if m[2] == "q":
            return json.dumps(str(v), ensure_ascii=False)
        if m[2] in "vs":
            return f"%{m[1]}s" % show(v)
        return f"%{m[1]}{m[2]}" % (int(v) if m[2] in "dxX" else v)

    return re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)([vsdqfxXgte%])", one, fmt)


def index(v: object, *keys: object) -> object:
    for k in keys:
        v = v.get(k) if isinstance(v, dict) else v[k]
    return v


def compare(op: Callable) -> Callable:
    return lambda a, b: op(a, b)


BUILTINS: dict[str, Callable] = {
    "len": lambda v: len(v), "index": index, "printf": printf, "print": lambda *a: "".join(map(show, a)), "println": lambda *a: " ".join(map(show, a)) + "\n",
    "not": lambda v: not truth(v), "eq": lambda a, *b: any(a == x for x in b), "ne": lambda a, b: a != b, "lt": compare(lambda a, b: a < b), "le": compare(lambda a, b: a <= b),
    "gt": compare(lambda a, b: a > b), "ge": compare(lambda a, b: a >= b), "html": lambda v: escape(show(v)), "urlquery": lambda v: urllib.parse.quote_plus(show(v)),
    "js": lambda v: json.dumps(show(v))[1:-1], "slice": lambda v, *i: v[slice(*i)] if len(i) == 2 else v[i[0] :] if i else v,
}
SPRIG: dict[str, Callable] = {
    "upper": lambda s: show(s).upper(), "lower": lambda s: show(s).lower(), "trim": lambda s: show(s).strip(), "title": lambda s: re.sub(r"\b\w", lambda m: m[0].upper(), show(s)),
    "default": lambda d, v=None: v if truth(v) else d, "empty": lambda v: not truth(v), "coalesce": lambda *a: next((v for v in a if truth(v)), None), "ternary": lambda a, b, c: a if truth(c) else b,
    "join": lambda sep, v: sep.join(map(show, v)), "replace": lambda a, b, s: show(s).replace(a, b), "contains": lambda a, s: a in show(s), "hasPrefix": lambda a, s: show(s).startswith(a), "hasSuffix": lambda a, s: show(s).endswith(a),
    "trimPrefix": lambda a, s: show(s).removeprefix(a), "trimSuffix": lambda a, s: show(s).removesuffix(a), "repeat": lambda n, s: show(s) * n, "quote": lambda *a: " ".join(json.dumps(show(v), ensure_ascii=False) for v in a),
    "squote": lambda *a: " ".join(f"'{show(v)}'" for v in a), "indent": lambda n, s: "\n".join(" " * n + x for x in show(s).split("\n")), "nindent": lambda n, s: "\n" + "\n".join(" " * n + x for x in show(s).split("\n")),
    "toJson": lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")), "add": lambda *a: sum(map(int, a)), "sub": lambda a, b: int(a) - int(b), "mul": lambda a, b: int(a) * int(b), "first": lambda v: v[0], "last": lambda v: v[-1],
    "list": lambda *a: list(a), "dict": lambda *a: dict(zip(a[::2], a[1::2], strict=True)), "keys": lambda d: sorted(d), "splitList": lambda sep, s: s.split(sep), "trunc": lambda n, s: s[:n] if n >= 0 else s[n:], "nospace": lambda s: re.sub(r"\s", "", s),
}
EXTRA: dict[str, Callable] = {"toYaml": lambda v: to_yaml(v).rstrip("\n"), "indentBlock": lambda n, s: "\n".join(" " * n + x for x in show(s).split("\n"))}


@dataclass(frozen=True)
class Config:
    name: str = "template"
    mode: str = "text"
    funcs: tuple[str, ...] = ("sprig", "extra")
    missing_key: str = "error"
    left: str = "{{"
    right: str = "}}"
    custom: tuple[tuple[str, Callable], ...] = ()

    def errors(self) -> list[str]:
        out = []
        if not self.name.strip():
            out.append("name is empty")
        out += [f"unknown function set {f!r}" for f in self.funcs if f not in FUNC_SETS]
        if "none" in self.funcs and len(self.funcs) > 1:
            out.append("function set none stands alone")
        if self.missing_key not in MISSING_KEY:
            out.append(f"unknown missing-key policy {self.missing_key!r}")
        if not self.left or not self.right or self.left == self.right:
            out.append("delimiters must be set and differ")
        if self.mode not in ("text", "html"):
            out.append(f"unknown mode {self.mode!r}")
        return out + [f"invalid function name {n!r}" for n, _ in self.custom if not NAME.fullmatch(n)]

    def functions(self) -> dict[str, Callable]:
        out = dict(BUILTINS)
        for f in self.funcs:
            out |= {"sprig": SPRIG, "extra": EXTRA}.get(f, {})
        return out | dict(self.custom)


@dataclass
class Part:
    kind: str
    value: object = None
    body: list[Part] = field(default_factory=list)
    other: list[Part] = field(default_factory=list)
    context: str = "text"


@dataclass
class Rendered:
    text: str
    template_name: str
    mode: str
    bytes: int


def lex(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(code) and code[at:].strip():
        m = LEX.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup], at < m.start(m.lastgroup)))
        at = m.end()
    return out


class Pipeline:
    """Commands joined by bars; an operand is a literal, a field chain, a variable or a pipeline in brackets."""

    def __init__(self, toks: list) -> None:
        self.toks, self.at = toks, 0
        self.declare: list[str] = []
        names = [i for i, t in enumerate(toks) if t[0] == "op" and t[1] in (":=", "=")]
        if names:
            self.declare = [t[1] for t in toks[: names[0]] if t[0] == "var"]
            self.at = names[0] + 1
        self.commands = self.pipe()
        if self.at < len(toks):
            raise TemplateError(f"unexpected {toks[self.at][1]!r}")

    def pipe(self) -> list[list]:
        out = [self.command()]
        while self.at < len(self.toks) and self.toks[self.at][1] == "|":
            self.at += 1
            out.append(self.command())
        return out

    def command(self) -> list:
        out: list = []
        while self.at < len(self.toks):
            kind, text, gap = self.toks[self.at]
            if kind == "op" and text in ("|", ")"):
                break
            self.at += 1
            if kind == "field" and out and not gap and text != "." and out[-1][0] in ("field", "var", "pipe"):
                out[-1] = (*out[-1][:2], [*out[-1][2], text[1:]])
            elif kind == "field":
                out.append(("field", None, [] if text == "." else [text[1:]]))
            elif kind == "var":
                out.append(("var", text, []))
            elif kind == "str":
                out.append(("value", json.loads(text) if text[0] == '"' else text[1:-1]))
            elif kind == "num":
                out.append(("value", float(text) if "." in text else int(text)))
            elif kind == "id":
                out.append(("value", {"true": True, "false": False, "nil": None}[text]) if text in ("true", "false", "nil") else ("func", text))
            elif text == "(":
                inner = self.pipe()
                if self.at >= len(self.toks) or self.toks[self.at][1] != ")":
                    raise TemplateError("a bracket isn't closed")
                self.at += 1
                out.append(("pipe", inner, []))
            else:
                raise TemplateError(f"unexpected {text!r}")
        if not out:
            raise TemplateError("missing value for command")
        return out


class TemplateSet:
    def __init__(self, source: str, config: Config = Config()) -> None:
        if errors := config.errors():
            raise TemplateError("; ".join(errors))
        self.config, self.funcs = config, config.functions()
        self.templates: dict[str, list[Part]] = {}
        self.parse(config.name, source)

    def parse(self, name: str, source: str) -> TemplateSet:
        left, right = re.escape(self.config.left), re.escape(self.config.right)
        stack: list[tuple[Part, list[Part]]] = []
        root = now = []
        at, strip_next = 0, False
        context = HtmlContext()
        for m in re.compile(rf"{left}(-\s)?(.*?)(\s-)?{right}", re.S).finditer(source):
            text = source[at : m.start()]
            text = text.lstrip() if strip_next else text
            text = text.rstrip() if m[1] else text
            strip_next, at = bool(m[3]), m.end()
            if text:
                now.append(Part("text", text))
                context.feed(text)
            code = m[2].strip()
            if code.startswith("/*"):
                continue
            word = re.match(r"[a-z]+\b", code)
            word = word[0] if word else ""
            rest = code[len(word) :].strip()
            if word in ("if", "range", "with"):
                part = Part(word, Pipeline(lex(rest)))
                now.append(part)
                stack.append((part, now))
                now = part.body
            elif word in ("define", "block"):
                q = re.match(r'"([^"]*)"\s*(.*)', rest, re.S)
                if not q:
                    raise TemplateError(f"{word} needs a name")
                part = Part(word, q[1])
                if word == "block":
                    now.append(Part("template", (q[1], Pipeline(lex(q[2])))))
                stack.append((part, now))
                now = part.body
            elif word == "else":
                if not stack or stack[-1][0].kind not in ("if", "range", "with"):
                    raise TemplateError("unexpected else")
                top = stack[-1][0]
                now = top.other
                if rest:
                    inner = Part(re.match("[a-z]+", rest)[0], Pipeline(lex(re.sub("^[a-z]+", "", rest).strip())))
                    now.append(inner)
                    stack.append((inner, None))
                    now = inner.body
            elif word == "end":
                if not stack:
                    raise TemplateError("unexpected end")
                part, back = stack.pop()
                while back is None:
                    part, back = stack.pop()
                if part.kind in ("define", "block"):
                    self.templates[part.value] = part.body
                now = back
            elif word == "template":
                q = re.match(r'"([^"]*)"\s*(.*)', rest, re.S)
                if not q:
                    raise TemplateError("template needs a name")
                now.append(Part("template", (q[1], Pipeline(lex(q[2])) if q[2].strip() else None)))
            elif word in ("break", "continue"):
                now.append(Part(word))
            else:
                p = Pipeline(lex(code))
                self.known(p.commands)
                where = context.now() if self.config.mode == "html" else "text"
                now.append(Part("action", p, context=where))
                context.feed("x" if where != "text" else "")
        if stack:
            raise TemplateError("unexpected end of template: an action isn't ended")
        tail = source[at:].lstrip() if strip_next else source[at:]
        if tail:
            now.append(Part("text", tail))
        self.templates[name] = root
        return self

    def known(self, commands: list[list]) -> None:
        for c in commands:
            for o in c:
                if o[0] == "func" and o[1] not in self.funcs and o[1] not in ("and", "or"):
                    raise TemplateError(f"function {o[1]!r} not defined")
                if o[0] == "pipe":
                    self.known(o[1])

    def names(self) -> list[str]:
        return sorted(self.templates)

    def lookup(self, name: str) -> bool:
        return name in self.templates

    def render(self, data: object, name: str | None = None) -> Rendered:
        name = name or self.config.name
        if name not in self.templates:
            raise TemplateError(f"template {name!r} is not defined")
        out: list[str] = []
        Run(self, out).parts(self.templates[name], data, [{"$": data}])
        text = "".join(out)
        return Rendered(text, name, self.config.mode, len(text.encode("utf-8", "surrogatepass")))


class Flow(Exception):
    pass


class Run:
    def __init__(self, owner: TemplateSet, out: list[str]) -> None:
        self.owner, self.out = owner, out

    def parts(self, parts: list[Part], dot: object, scopes: list[dict]) -> None:
        for p in parts:
            if p.kind == "text":
                self.out.append(p.value)
            elif p.kind == "action":
                v = self.pipeline(p.value, dot, scopes)
                if not p.value.declare:
                    self.out.append(guard(v, p.context) if self.owner.config.mode == "html" else show(v))
            elif p.kind in ("if", "with"):
                inner = [*scopes, {}]
                v = self.pipeline(p.value, dot, inner)
                if truth(v):
                    self.parts(p.body, v if p.kind == "with" else dot, inner)
                else:
                    self.parts(p.other, dot, inner)
            elif p.kind == "range":
                self.loop(p, dot, scopes)
            elif p.kind == "template":
                name, arg = p.value
                if name not in self.owner.templates:
                    raise TemplateError(f"template {name!r} is not defined")
                v = self.pipeline(arg, dot, scopes) if arg else None
                self.parts(self.owner.templates[name], v, [{"$": v}])
            elif p.kind in ("break", "continue"):
                raise Flow(p.kind)

    def loop(self, p: Part, dot: object, scopes: list[dict]) -> None:
        inner = [*scopes, {}]
        names, p.value.declare = p.value.declare, []
        v = self.pipeline(p.value, dot, inner)
        p.value.declare = names
        items = list(sorted(v.items())) if isinstance(v, dict) else list(enumerate(range(v) if isinstance(v, int) else v or []))
        if not items:
            self.parts(p.other, dot, inner)
        for k, x in items:
            scope = dict(zip(names, [x] if len(names) == 1 else [k, x], strict=False))
            try:
                self.parts(p.body, x, [*scopes, scope])
            except Flow as f:
                if str(f) == "break":
                    break

    def pipeline(self, p: Pipeline, dot: object, scopes: list[dict]) -> object:
        v = self.commands(p.commands, dot, scopes)
        for name in p.declare:
            holder = next((s for s in reversed(scopes) if name in s), scopes[-1])
            holder[name] = v
        return v

    def commands(self, commands: list[list], dot: object, scopes: list[dict]) -> object:
        value: list = []
        for c in commands:
            head = c[0]
            if head[0] == "func":
                if head[1] in ("and", "or"):
                    v = None
                    for o in c[1:]:
                        v = self.operand(o, dot, scopes)
                        if truth(v) == (head[1] == "or"):
                            break
                    value = [v]
                    continue
                args = [self.operand(o, dot, scopes) for o in c[1:]] + value
                try:
                    value = [self.owner.funcs[head[1]](*args)]
                except TemplateError:
                    raise
                except Exception as e:
                    raise TemplateError(f"error calling {head[1]}: {e}") from e
            else:
                if len(c) > 1 or value:
                    raise TemplateError("can't give argument to non-function")
                value = [self.operand(head, dot, scopes)]
        return value[0]

    def operand(self, o: tuple, dot: object, scopes: list[dict]) -> object:
        if o[0] == "value":
            return o[1]
        if o[0] == "func":
            return self.owner.funcs[o[1]]()
        if o[0] == "pipe":
            v = self.commands(o[1], dot, scopes)
        elif o[0] == "var":
            v = next((s[o[1]] for s in reversed(scopes) if o[1] in s), None)
        else:
            v = dot
        for name in o[2]:
            if isinstance(v, dict):
                if name not in v and self.owner.config.missing_key == "error":
                    raise TemplateError(f"map has no entry for key {name!r}")
                v = v.get(name)
            elif v is None:
                raise TemplateError(f"nil pointer evaluating {name}")
            elif hasattr(v, name) and not name.startswith("_"):
                v = getattr(v, name)
            else:
                raise TemplateError(f"can't evaluate field {name}")
        return v


class HtmlContext:
    """Where in HTML the text read so far ends."""

    def __init__(self) -> None:
        self.seen = ""

    def feed(self, text: str) -> None:
        self.seen += text

    def now(self) -> str:
        for tag in ("script", "style"):
            opened = [m.end() for m in re.finditer(rf"(?i)<{tag}\b[^>]*>", self.seen)]
            if opened and not re.search(rf"(?i)</{tag}", self.seen[opened[-1] :]):
                raise TemplateError(f"an action within {tag} is not supported")
        at = self.seen.rfind("<")
        if at < 0 or not re.match(r"</?[A-Za-z]", self.seen[at:]):
            return "text"
        inside = re.match(r"""</?[A-Za-z][^\s>"']*(?:\s+[^\s=>"']+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*\s*(/?>)?""", self.seen[at:])
        if inside and inside[1]:
            return "text"
        m = re.search(r"""([A-Za-z-]+)\s*=\s*(["'])([^"']*)$""", self.seen[at:])
        if not m:
            raise TemplateError("an action in a tag must be within a quoted attribute")
        if m[1].lower().startswith("on") or m[1].lower() == "style":
            raise TemplateError(f"an action within {m[1]} is not supported")
        return ("url" if not m[3] else "urlpart") if m[1].lower() in URL_ATTRIBUTES else "attribute"


def escape(text: str) -> str:
    return re.sub(r"[&<>\"'+\0]", lambda m: {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", "+": "&#43;", "\0": "�"}[m[0]], text)


def guard(v: object, context: str) -> str:
    text = "" if v is None else show(v)
    if context == "text":
        return text if isinstance(v, Html) else escape(text)
    if context in ("url", "urlpart"):
        scheme = re.match(r"([^/?#:]*):", text)
        if context == "url" and scheme and scheme[1].lower() not in ("http", "https", "mailto"):
            return "#ZgotmplZ"
        return escape(urllib.parse.quote(text, safe="-._~:/?#[]@!$&()*+,;=%"))
    return escape(text)


def render_text(source: str, data: object) -> Rendered:
    return TemplateSet(source).render(data)


def render_html(source: str, data: object) -> Rendered:
    return TemplateSet(source, Config(mode="html")).render(data)
