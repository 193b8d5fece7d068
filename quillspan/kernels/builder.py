"""Markdown out of values: blocks are lazily rendered strings, joined by blank lines."""

from __future__ import annotations

import re
from collections.abc import Callable

LANGUAGE = re.compile(r"[A-Za-z0-9_+.#-]*")


def escape(text: str, cell: bool = False) -> str:
    out = re.sub(r"([\\*_`\[\]<>])", r"\\\1", str(text))
    return re.sub(r"\r\n|\r|\n", "<br>", out.replace("|", r"\|")) if cell else out


def longest(text: str, mark: str = "`") -> int:
    return max(map(len, re.findall(f"{re.escape(mark)}+", text)), default=0)


class Inline(str):
    """Markdown that is rendered already."""


def raw(text: str) -> Inline:
    return Inline(text)


def code(text: str) -> Inline:
    fence = "`" * (longest(text) + 1)
    pad = " " if text.startswith("`") or text.endswith("`") else ""
    return Inline(f"{fence}{pad}{text}{pad}{fence}")


def em(text: str) -> Inline:
    return Inline(f"*{render(text)}*")


def strong(text: str) -> Inline:
    return Inline(f"**{render(text)}**")


def link(text: str, url: str, title: str = "") -> Inline:
    tail = ' "' + title.replace('"', '\\"') + '"' if title else ""
    return Inline(f"[{render(text)}]({url.replace(')', '%29')}{tail})")


def render(value: object, cell: bool = False) -> str:
    if isinstance(value, Inline):
        return re.sub(r"\r\n|\r|\n", "<br>", re.sub(r"(?<!\\)\|", r"\|", value)) if cell else str(value)
    if isinstance(value, (list, tuple)):
        return "".join(render(v, cell) for v in value)
    return escape("" if value is None else str(value).lower() if isinstance(value, bool) else str(value), cell)


class BuilderError(ValueError):
    pass


class Builder:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.errors: list[str] = []

    def _add(self, text: str) -> Builder:
        self.parts.append(text)
        return self

    def title(self, value: object) -> Builder:
        return self.heading(1, value)

    def heading(self, level: int, value: object) -> Builder:
        if not 1 <= level <= 6:
            self.errors.append("heading level must be between 1 and 6")
            return self
        return self._add(f"{'#' * level} {render(value)}")

    def paragraph(self, *values: object) -> Builder:
        return self._add(render(list(values)))

    text = paragraph

    def raw(self, text: str) -> Builder:
        return self._add(text)

    def thematic_break(self) -> Builder:
        return self._add("---")

    def _inner(self, body: Builder | str | Callable[[Builder], object]) -> str:
        if callable(body):
            b = Builder()
            body(b)
            body = b
        if isinstance(body, Builder):
            return "; ".join(body.errors) if body.errors else body.joined()
        return render(body)

    def blockquote(self, body: Builder | str | Callable[[Builder], object]) -> Builder:
        return self._add("\n".join(f"> {x}" for x in self._inner(body).split("\n")))

    def callout(self, kind: str, title: str, body: Builder | str | Callable[[Builder], object]) -> Builder:
        head = f"> [!{kind.upper()}]" + (f" {render(title)}" if title else "")
        return self._add("\n".join([head, *(f"> {x}" for x in self._inner(body).split("\n"))]))

    def bullet_list(self, items: list) -> Builder:
        return self._add("\n".join(f"- {render(x)}" for x in items))

    def ordered_list(self, items: list, start: int = 1) -> Builder:
        if start <= 0:
            self.errors.append("ordered list start must be greater than zero")
            return self
        return self._add("\n".join(f"{start + i}. {render(x)}" for i, x in enumerate(items)))

    def checklist(self, items: list[dict]) -> Builder:
        return self._add("\n".join(f"- [{'x' if i.get('checked', i.get('Checked')) else ' '}] {render(i.get('text', i.get('Text', '')))}" for i in items))

    def code_block(self, language: str, text: str) -> Builder:
        if not LANGUAGE.fullmatch(language):
            self.errors.append(f"invalid code language {language!r}")
            return self
        fence = "`" * max(3, longest(text) + 1)
        body = text.rstrip("\n")
        return self._add(f"{fence}{language}\n{body}\n{fence}")

    def table(self) -> Table:
        return Table(self)

    def joined(self) -> str:
        return "\n\n".join(p for p in (x.strip("\n") for x in self.parts) if p)

    def validate(self) -> list[str]:
        return list(self.errors)

    def render(self) -> str:
        if self.errors:
            raise BuilderError("; ".join(self.errors))
        out = self.joined()
        return out + "\n" if out else ""

    def render_html(self) -> str:
        from quillspan.kernels.markdown import render as to_html

        return to_html(self.render())


class Table:
    """Columns, alignments, rows; nothing is added before ``end``."""

    def __init__(self, owner: Builder) -> None:
        self.owner, self.names, self.aligns, self.body, self.done = owner, [], [], [], False

    def columns(self, *names: object) -> Table:
        """Names, or mappings with a label and an alignment."""
        self.names = [n.get("label", "") if isinstance(n, dict) else n for n in names]
        if any(isinstance(n, dict) for n in names):
            self.align(*(n.get("align", "") if isinstance(n, dict) else "" for n in names))
        return self

    def align(self, *aligns: str) -> Table:
        for a in aligns:
            if a not in ("", "left", "center", "right"):
                self.owner.errors.append(f"unknown alignment {a!r}")
        self.aligns = list(aligns)
        return self

    def row(self, *cells: object) -> Table:
        if len(cells) != len(self.names):
            self.owner.errors.append(f"table row has {len(cells)} cells, expected {len(self.names)}")
        else:
            self.body.append(list(cells))
        return self

    def rows(self, rows: list) -> Table:
        for r in rows:
            self.row(*r)
        return self

    def end(self) -> Builder:
        if self.done:
            self.owner.errors.append("table is ended already")
        elif not self.names:
            self.owner.errors.append("table has no columns")
        else:
            self.owner._add(table(self.names, self.aligns, self.body))
        self.done = True
        return self.owner


def table(names: list, aligns: list[str], body: list[list]) -> str:
    cells = [[render(c, True).strip() for c in r] for r in (names, *body)]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    rule = []
    for i, w in enumerate(widths):
        w = max(w, 3)
        a = aligns[i] if i < len(aligns) else ""
        rule.append({"left": ":" + "-" * (w - 1), "center": ":" + "-" * (w - 2) + ":", "right": "-" * (w - 1) + ":"}.get(a, "-" * w))
    line = lambda r: "| " + " | ".join(r) + " |"
    padded = [line([c.ljust(w) for c, w in zip(r, widths, strict=True)]) for r in cells]
    return "\n".join([padded[0], line(rule), *padded[1:]])
