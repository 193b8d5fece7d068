"""Lint and repair of JSON and YAML.

Repair runs rounds: analyse, lint, apply fixes, until the text is clean, nothing changes or the rounds are used up.
The catalogues list the rules that are implemented here.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache

#: Names of rules.
JSON_RULES = {
    "markdown_fence_wrapper": "the document is wrapped in a Markdown fence",
    "single_quotes": "strings are quoted by single quotes",
    "python_literals": "True, False or None in place of true, false or null",
    "trailing_comma": "a comma stands before a closing bracket",
    "duplicate_key": "an object has a key twice",
    "multiple_top_level_values": "values follow the first one",
    "missing_closer": "a bracket or quote isn't closed",
    "unquoted_key": "a key has no quotes",
    "comment": "a comment, which JSON has not",
    "missing_comma": "two members have no comma between them",
    "strict_parse_error": "the document is no strict JSON",
}
YAML_RULES = {
    "tab_indent": "a line is indented by tabs",
    "missing_space_after_colon": "no space follows a key's colon",
    "list_dash_no_space": "no space follows a list's dash",
    "duplicate_key": "a mapping has a key twice",
    "parse_error": "the document can't be parsed",
}
JSON_EXAMPLES = [("single_quotes", "{'ok': True,}"), ("trailing_comma", '{"a": [1, 2,],}'), ("markdown_fence_wrapper", '~~~json\n{"a": 1}\n~~~\n')]
YAML_EXAMPLES = [("missing_space_after_colon", "name:Alice\n"), ("tab_indent", "a:\n\tb: 1\n"), ("list_dash_no_space", "-one\n-two\n")]


class OptionsError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """``unknown``: what ``from_dict`` does with keys it doesn't know: reject, allow or collect."""

    max_iterations: int = 10
    tab_width: int = 2
    only_rules: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    unknown: tuple[str, ...] = ()

    def on(self, rule: str) -> bool:
        return rule not in self.disabled_rules and (not self.only_rules or rule in self.only_rules)

    @classmethod
    def from_dict(cls, given: dict, kind: str, policy: str = "reject") -> Options:
        if policy not in ("reject", "allow", "collect"):
            raise OptionsError(f"unknown policy {policy!r}")
        names = {"maxIterations": "max_iterations", "onlyRules": "only_rules", "disabledRules": "disabled_rules"} | ({"tabWidth": "tab_width"} if kind == "yaml" else {})
        other = sorted(k for k in given if k not in names and k not in names.values())
        if other and policy == "reject":
            raise OptionsError(f"unknown options: {', '.join(other)}")
        values = {names.get(k, k): tuple(v) if isinstance(v, list) else v for k, v in given.items() if k not in other}
        out = cls(**values, unknown=tuple(other) if policy == "collect" else ())
        if errors := out.errors(kind):
            raise OptionsError("; ".join(errors))
        return out

    def errors(self, kind: str) -> list[str]:
        rules = JSON_RULES if kind == "json" else YAML_RULES
        out = [f"{n} must be greater than zero" for n, v in (("maxIterations", self.max_iterations), ("tabWidth", self.tab_width)) if not isinstance(v, int) or v <= 0]
        out += [f"unknown rule {r!r}" for r in (*self.only_rules, *self.disabled_rules) if r not in rules]
        return out + [f"rule {r!r} is both only and disabled" for r in self.only_rules if r in self.disabled_rules]


@dataclass
class Issue:
    rule: str
    description: str
    start: int
    end: int


@dataclass
class Fix:
    rule: str
    description: str
    before: str
    after: str


@dataclass
class Result:
    original: str
    sanitized: str
    errors: list[str] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)
    fixes: list[Fix] = field(default_factory=list)
    parse_clean: bool = False
    lint_clean: bool = False
    strict_parse_clean: bool = False
    original_strict_parse_clean: bool = False


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def strict_json(text: str) -> tuple[bool, str, object]:
    """(valid, error, value): one value by the JSON grammar; a later duplicate key wins."""
    try:
        return True, "", json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        return False, str(e), None


# --- JSON -----------------------------------------------------------------------------------

JSON_TOKEN = re.compile(r"""(?P<string>"(?:[^"\\\n]|\\.)*"?)|(?P<single>'(?:[^'\\\n]|\\.)*'?)|(?P<comment>//[^\n]*|/\*.*?\*/|\#[^\n]*)|(?P<mark>[{}\[\],:])|(?P<space>\s+)|(?P<word>[^\s{}\[\],:"']+)""", re.S)
FENCE = re.compile(r"\s*(```+|~~~+)[^\n]*\n(.*?)\n?[ \t]*\1[ \t]*\s*$", re.S)
LITERALS = {"True": "true", "False": "false", "None": "null"}
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?$")


@dataclass
class Token:
    kind: str
    text: str
    start: int


def json_tokens(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start()) for m in JSON_TOKEN.finditer(text)]


def json_issues(text: str) -> list[Issue]:
    out = []
    if m := FENCE.match(text):
        return [Issue("markdown_fence_wrapper", JSON_RULES["markdown_fence_wrapper"], 0, m.end())]

    def say(rule: str, t: Token) -> None:
        out.append(Issue(rule, JSON_RULES[rule], t.start, t.start + len(t.text)))

    solid = [t for t in json_tokens(text) if t.kind != "space"]
    stack: list[tuple[str, set[str]]] = []
    plain = [t for t in solid if t.kind != "comment"]
    done = False
    for t in solid:
        if t.kind == "comment":
            say("comment", t)
    for i, t in enumerate(plain):
        before, after = plain[i - 1] if i else None, plain[i + 1] if i + 1 < len(plain) else None
        value = t.kind in ("string", "single", "word") or t.text in "{["
        if done and not stack and value:
            say("multiple_top_level_values", t)
            break
        if value and stack and before and (before.kind in ("string", "single", "word") or before.text in "}]"):
            say("missing_comma", t)
        if t.kind == "single":
            say("single_quotes", t)
        if t.kind in ("string", "single") and (len(t.text) < 2 or t.text[-1] != t.text[0]):
            say("missing_closer", t)
        if t.kind == "word" and t.text in LITERALS:
            say("python_literals", t)
        elif t.kind == "word" and after and after.text == ":" and stack and stack[-1][0] == "{":
            say("unquoted_key", t)
        if t.text == "," and after and after.text in "}]" and after.kind == "mark":
            say("trailing_comma", t)
        if t.kind in ("string", "single", "word") and after and after.text == ":" and stack and stack[-1][0] == "{":
            name = t.text.strip("\"'")
            if name in stack[-1][1]:
                say("duplicate_key", t)
            stack[-1][1].add(name)
        if t.kind == "mark" and t.text in "{[":
            stack.append((t.text, set()))
        elif t.kind == "mark" and t.text in "}]" and stack:
            stack.pop()
        if not stack:
            done = True
    for opener, _ in stack:
        out.append(Issue("missing_closer", f"{opener} isn't closed", len(text), len(text)))
    valid, error, _ = strict_json(text)
    if not valid and not out:
        out.append(Issue("strict_parse_error", error, 0, len(text)))
    return sorted(out, key=lambda i: i.start)


def quoted(text: str) -> str:
    body = text[1:-1] if len(text) > 1 and text[-1] == text[0] else text[1:]
    return json.dumps(re.sub(r"\\(['\"\\/bfnrt])", lambda m: {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), body), ensure_ascii=False)


def json_fix(text: str, rule: str) -> str:
    """The text with all places of one rule repaired."""
    if rule == "markdown_fence_wrapper":
        m = FENCE.match(text)
        return m[2] if m else text
    toks = json_tokens(text)
    solid = [i for i, t in enumerate(toks) if t.kind not in ("space", "comment")]
    place = {i: k for k, i in enumerate(solid)}
    out, stack = [], []
    for i, t in enumerate(toks):
        k = place.get(i)
        before = toks[solid[k - 1]] if k else None
        after = toks[solid[k + 1]] if k is not None and k + 1 < len(solid) else None
        new = t.text
        if rule == "comment" and t.kind == "comment":
            new = ""
        elif rule == "single_quotes" and t.kind == "single":
            new = quoted(t.text)
        elif rule == "python_literals" and t.kind == "word":
            new = LITERALS.get(t.text, t.text)
        elif rule == "trailing_comma" and t.text == "," and after and after.kind == "mark" and after.text in "}]":
            new = ""
        elif rule == "unquoted_key" and t.kind == "word" and after and after.text == ":" and stack and stack[-1] == "{" and t.text not in LITERALS:
            new = json.dumps(t.text, ensure_ascii=False)
        elif rule == "missing_comma" and stack and k and (t.kind in ("string", "single", "word") or t.text in "{[") and before and (before.kind in ("string", "single", "word") or before.text in "}]"):
            new = "," + t.text
        elif rule == "missing_closer" and t.kind in ("string", "single") and (len(t.text) < 2 or t.text[-1] != t.text[0]):
            new = t.text + t.text[0]
        out.append(new)
        if t.kind == "mark" and t.text in "{[":
            stack.append(t.text)
        elif t.kind == "mark" and t.text in "}]" and stack:
            stack.pop()
    if rule == "missing_closer":
        out.append("".join("}" if b == "{" else "]" for b in reversed(stack)))
    return "".join(out)


# --- YAML -----------------------------------------------------------------------------------

COLON = re.compile(r"^(\s*(?:-\s+)?[A-Za-z_][\w.-]*):(?=[^\s:/])", re.M)
DASH = re.compile(r"^(\s*)-(?=[A-Za-z0-9_\"'])(?!--)", re.M)
TAB = re.compile(r"^( *\t[ \t]*)(?=\S)", re.M)


def yaml_loader():  # noqa: ANN201
    """A loader by the core schema of YAML 1.2 that refuses duplicate keys."""
    import yaml

    class Core(yaml.SafeLoader):
        yaml_implicit_resolvers = {}

        def construct_mapping(self, node, deep=False):  # noqa: ANN001, ANN202
            seen = set()
            for k, _ in node.value:
                key = self.construct_object(k, deep=True)
                if isinstance(key, (str, int, float, bool)) and key in seen:
                    raise yaml.constructor.ConstructorError(None, None, f"duplicate key {key!r}", k.start_mark)
                if isinstance(key, (str, int, float, bool)):
                    seen.add(key)
            return super().construct_mapping(node, deep)

    for tag, pattern, first in (
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"), ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", "-+0123456789"), ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+.0123456789"),
    ):
        Core.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), list(first))
    Core.add_constructor("tag:yaml.org,2002:int", lambda c, n: int(n.value.replace("0o", "0o"), 0) if n.value.startswith(("0x", "0o")) else int(n.value))
    Core.add_constructor("tag:yaml.org,2002:float", lambda c, n: float(n.value.lower().replace(".inf", "inf").replace(".nan", "nan")))
    Core.add_constructor("tag:yaml.org,2002:bool", lambda c, n: n.value.lower() == "true")
    return Core


def load_yaml(text: str) -> tuple[bool, str, object]:
    """(valid, error, value) of a YAML document."""
    try:
        import yaml
    except ImportError:
        return simple_yaml(text)
    try:
        return True, "", yaml.load(text, yaml_loader())  # noqa: S506
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return False, str(e), None


@lru_cache(maxsize=16)
def yaml_error(text: str) -> str | None:
    """What is wrong with a YAML text; None if nothing. A repair asks it of the same text several times."""
    ok, error, _ = load_yaml(text)
    return None if ok else error


def scalar(text: str) -> object:
    text = text.strip()
    if text.startswith('"') and text.endswith('"') and len(text) > 1:
        ok, _, v = strict_json(text)
        return v if ok else text[1:-1]
    if text.startswith("'") and text.endswith("'") and len(text) > 1:
        return text[1:-1].replace("''", "'")
    text = re.sub(r"\s+#.*$", "", text)
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text.lower() in ("true", "false") and text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if re.fullmatch(r"[-+]?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?", text):
        return float(text)
    if text[0] in "[{":
        ok, error, v = strict_json(text)
        if ok:
            return v
        if text[0] == "[" and text.endswith("]") and not re.search(r"[\[\]{}]", text[1:-1]):
            return [scalar(x) for x in text[1:-1].split(",") if x.strip()]
        raise ValueError(error)
    return text


#: Mappings and lists of a YAML text may be nested so deep.
MOST_DEPTH = 200


def simple_yaml(text: str) -> tuple[bool, str, object]:
    """Block mappings, block lists and scalars: what front matter and small payloads are made of."""
    rows = []
    for n, line in enumerate(text.split("\n"), 1):
        line = line.rstrip("\r")
        body = line.strip(" ")
        if not body or body.startswith("#") or body == "---":
            continue
        if "\t" in line[: len(line) - len(line.lstrip(" \t"))]:
            return False, f"line {n}: indented by a tab", None
        rows.append((len(line) - len(line.lstrip(" ")), body, n))
    at = 0

    def block(indent: int, depth: int = 0) -> object:
        nonlocal at
        if depth > MOST_DEPTH:
            raise ValueError(f"line {rows[at][2]}: nested over {MOST_DEPTH} deep")
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            out = []
            while at < len(rows) and rows[at][0] == indent and (rows[at][1].startswith("- ") or rows[at][1] == "-"):
                rest = rows[at][1][1:].lstrip(" ")
                if not rest:
                    at += 1
                    out.append(block(rows[at][0], depth + 1) if at < len(rows) and rows[at][0] > indent else None)
                elif rest.startswith("- ") or re.match(r"""(?:"[^"]*"|'[^']*'|[^\s"'\[{#-][^:#]*|-[^\s:][^:#]*):(?:\s|$)""", rest):
                    inner = rows[at][0] + len(rows[at][1]) - len(rest)
                    rows[at] = (inner, rest, rows[at][2])
                    out.append(block(inner, depth + 1))
                else:
                    at += 1
                    out.append(scalar(rest))
            return out
        out = {}
        while at < len(rows) and rows[at][0] == indent:
            m = re.match(r"""("[^"]*"|'[^']*'|[^\s"'\[{#-][^:]*?|-[^\s:][^:]*?)\s*:(?:\s+(.*))?$""", rows[at][1])
            if not m:
                raise ValueError(f"line {rows[at][2]}: no mapping")
            key = str(scalar(m[1]))
            if key in out:
                raise ValueError(f"line {rows[at][2]}: duplicate key {key!r}")
            at += 1
            if m[2] and not m[2].startswith("#"):
                if re.search(r":\s", m[2]) and m[2][0] not in "\"'[{":
                    raise ValueError(f"line {rows[at - 1][2]}: a mapping isn't allowed here")
                out[key] = scalar(m[2])
            elif at < len(rows) and (rows[at][0] > indent or rows[at][0] == indent and rows[at][1].startswith("- ")):
                out[key] = block(rows[at][0], depth + 1)
            else:
                out[key] = None
        return out

    try:
        if not rows:
            return True, "", None
        if len(rows) == 1 and not re.search(r":(?:\s|$)", rows[0][1]) and not rows[0][1].startswith("- "):
            return True, "", scalar(rows[0][1])
        value = block(rows[0][0])
        if at < len(rows):
            return False, f"line {rows[at][2]}: bad indentation", None
        return True, "", value
    except (ValueError, IndexError) as e:
        return False, str(e), None


def yaml_issues(text: str) -> list[Issue]:
    out = [Issue(rule, YAML_RULES[rule], m.start(), m.end()) for rule, p in (("tab_indent", TAB), ("missing_space_after_colon", COLON), ("list_dash_no_space", DASH)) for m in p.finditer(text)]
    error = yaml_error(text)
    if error is not None:
        rule = "duplicate_key" if "duplicate key" in error else "parse_error"
        if rule == "duplicate_key" or not out:
            out.append(Issue(rule, error, 0, len(text)))
    return sorted(out, key=lambda i: i.start)


def yaml_fix(text: str, rule: str, tab_width: int) -> str:
    if rule == "tab_indent":
        return TAB.sub(lambda m: m[0].expandtabs(tab_width) if " " not in m[0] else m[0].replace("\t", " " * tab_width), text)
    if rule == "missing_space_after_colon":
        return COLON.sub(r"\1: ", text)
    if rule == "list_dash_no_space":
        return DASH.sub(r"\1- ", text)
    return text


#: The order in which fixes are applied.
JSON_FIXES = ("markdown_fence_wrapper", "comment", "single_quotes", "python_literals", "unquoted_key", "missing_comma", "missing_closer", "trailing_comma")
YAML_FIXES = ("tab_indent", "missing_space_after_colon", "list_dash_no_space")


def lint(text: str, kind: str, options: Options = Options()) -> list[Issue]:
    return [i for i in (json_issues if kind == "json" else yaml_issues)(text) if options.on(i.rule)]


def sanitize(text: str, kind: str, options: Options = Options()) -> Result:
    r = Result(text, text)
    wrong = yaml_error if kind == "yaml" else lambda t: None if (got := strict_json(t))[0] else got[1]
    r.original_strict_parse_clean = wrong(text) is None
    for _ in range(options.max_iterations):
        issues = lint(r.sanitized, kind, options)
        if not issues:
            break
        found, before = {i.rule: i.description for i in issues}, r.sanitized
        for rule in JSON_FIXES if kind == "json" else YAML_FIXES:
            if rule in found:
                new = json_fix(r.sanitized, rule) if kind == "json" else yaml_fix(r.sanitized, rule, options.tab_width)
                if new != r.sanitized:
                    r.fixes.append(Fix(rule, found[rule], r.sanitized, new))
                    r.sanitized = new
                    if rule == "markdown_fence_wrapper":
                        break
        if r.sanitized == before:
            break
    r.issues = lint(r.sanitized, kind, options)
    error = wrong(r.sanitized)
    r.parse_clean = r.strict_parse_clean = error is None
    r.errors = [] if error is None else [error]
    r.lint_clean = not r.issues
    return r


def parse_tree(text: str) -> str:
    """A JSON document as nested tokens, ``(ERROR ...)`` where it is none."""
    out, depth = [], 0
    for t in json_tokens(text):
        if t.kind in ("space", "comment"):
            continue
        if t.kind == "mark" and t.text in "{[":
            out.append(f"({'object' if t.text == '{' else 'array'}")
            depth += 1
        elif t.kind == "mark" and t.text in "}]":
            out.append(")" if depth else "(ERROR)")
            depth -= depth > 0
        elif t.kind == "mark":
            continue
        elif t.kind == "string" and len(t.text) > 1 and t.text[-1] == '"':
            out.append("(string)")
        elif t.kind == "word" and NUMBER.match(t.text):
            out.append("(number)")
        elif t.kind == "word" and t.text in ("true", "false", "null"):
            out.append(f"({t.text})")
        else:
            out.append("(ERROR)")
    out += ["(MISSING))"] * depth
    return f"(document {' '.join(out)})".replace(" )", ")")
