"""CommonMark (no extensions): blocks, inlines, source ranges and HTML.

Text nodes keep their raw source: escapes and entities are resolved when rendered. A line break ends a
text node. All offsets in this module are code points; ``flatten`` adds bytes, lines and columns.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from quillspan.kernels.positions import Source

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Tag names of the sixth kind of HTML block in the CommonMark specification.
BLOCK_TAGS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
OPEN_TAG, CLOSE_TAG = rf"<[A-Za-z][A-Za-z0-9-]*(?:{ATTRIBUTE})*\s*/?>", r"</[A-Za-z][A-Za-z0-9-]*\s*>"
HTML_STARTS = [re.compile(p, re.I) for p in (r"<(?:script|pre|style|textarea)(?:[\s>]|$)", r"<!--", r"<\?", r"<![A-Za-z]", r"<!\[CDATA\[", rf"</?(?:{'|'.join(BLOCK_TAGS.split())})(?:\s|/?>|$)", rf"(?:{OPEN_TAG}|{CLOSE_TAG})\s*$")]
HTML_ENDS = [re.compile(p, re.I) for p in (r"</(?:script|pre|style|textarea)>", r"-->", r"\?>", r">", r"\]\]>")]
INLINE_HTML = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTO_URI, AUTO_MAIL = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>"), re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
ENTITY = re.compile(r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});")
RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
SETEXT = re.compile(r"(=+|-+)[ \t]*$")
FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
BULLET, NUMBER = re.compile(r"[-+*](?=[ \t]|$)"), re.compile(r"(\d{1,9})([.)])(?=[ \t]|$)")
LINK_TITLE = re.compile(r"""\s+("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\))""", re.S)
LABEL = re.compile(r"\[((?:\\.|[^\[\]\\]){1,999})\]", re.S)


#: Blocks and inlines may be nested so deep; each node has a path as long as its depth.
MOST_DEPTH = 1000


class MarkdownError(ValueError):
    pass


@dataclass
class Node:
    type: str
    start: int = -1
    end: int = -1
    children: list[Node] = field(default_factory=list)
    text: str = ""
    level: int = 0
    language: str = ""
    destination: str = ""
    title: str = ""
    alt: str = ""
    ordered: bool = False
    number: int = 0
    marker: str = ""
    info: str = ""
    raw: str = ""
    tight: bool = True
    hard: bool = False
    soft: bool = False
    # While blocks are open: lines as (place of the first character, characters), and container state.
    lines: list[tuple[int, str]] = field(default_factory=list)
    indent: int = 0
    fence: str = ""
    kind: int = 0
    blank_last: bool = False

    def text_content(self) -> str:
        return "".join(n.text for n in self.walk())

    def walk(self):  # noqa: ANN201
        """This node and all below it, in pre-order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)


class Cursor:
    """A line with tabs as columns: place in the line, column, and columns of a tab that is only partly used."""

    def __init__(self, line: str, offset: int) -> None:
        self.line, self.offset, self.at, self.column, self.rest = line, offset, 0, 0, 0

    def look(self) -> tuple[int, int]:
        """(place of the first character that isn't blank, columns up to it)."""
        i, column = self.at, self.column
        while i < len(self.line) and self.line[i] in " \t":
            column += 1 if self.line[i] == " " else 4 - column % 4
            i += 1
        return i, column - self.column

    def skip(self, columns: int) -> None:
        while columns > 0 and self.at < len(self.line):
            if self.line[self.at] == "\t":
                step = 4 - self.column % 4
                used = min(step, columns)
                self.column += used
                columns -= used
                if used < step:
                    return
            elif self.line[self.at] == " ":
                self.column += 1
                columns -= 1
            else:
                return
            self.at += 1

    def jump(self, at: int) -> None:
        while self.at < at:
            self.column += 4 - self.column % 4 if self.line[self.at] == "\t" else 1
            self.at += 1

    def tail(self) -> tuple[int, str]:
        """What is left, with the unused columns of a tab as spaces."""
        if self.at < len(self.line) and self.line[self.at] == "\t" and self.column % 4:
            return self.offset + self.at + 1, " " * (4 - self.column % 4) + self.line[self.at + 1 :]
        return self.offset + self.at, self.line[self.at :]

    @property
    def blank(self) -> bool:
        return not self.line[self.at :].strip(" \t\r")


class Blocks:
    """The block phase: a stack of open blocks, extended line by line."""

    def __init__(self, text: str) -> None:
        self.text, self.refs = text, {}
        self.root = Node("document", 0, len(text))
        self.open = [self.root]
        at = 0
        for line in re.findall(r"[^\n]*\n|[^\n]+", text):
            self.line(Cursor(line.removesuffix("\n").removesuffix("\r"), at), line)
            at += len(line)
        self.close_to(0)

    @property
    def tip(self) -> Node:
        return self.open[-1]

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open.pop()
            if node.type == "paragraph":
                self.references(node)
                if not node.lines and self.open:
                    self.open[-1].children.remove(node)
            elif node.type == "codeBlock":
                while node.lines and not node.lines[-1][1].strip(" \t\r\n"):
                    node.lines.pop()

    def add(self, node: Node) -> Node:
        if self.tip.type == "list" and node.type != "listItem":
            self.close_to(len(self.open) - 1)
        if len(self.open) > MOST_DEPTH:
            raise MarkdownError(f"blocks are nested over {MOST_DEPTH} deep")
        self.tip.children.append(node)
        self.open.append(node)
        return node

    def references(self, node: Node) -> None:
        """Take link reference definitions off the start of a paragraph."""
        while node.lines and node.lines[0][1].lstrip().startswith("["):
            body = "\n".join(t for _, t in node.lines)
            got = self.reference(body)
            if got is None:
                return
            label, destination, title, end = got
            self.refs.setdefault(label, (destination, title))
            used = body.count("\n", 0, end) + (end >= len(body))
            node.lines = node.lines[used:] if end < len(body) else []

    @staticmethod
    def reference(body: str) -> tuple[str, str, str, int] | None:
        at = len(body) - len(body.lstrip())
        m = LABEL.match(body, at)
        if not m or not m[1].strip() or not body.startswith(":", m.end()):
            return None
        at = m.end() + 1
        gap = re.compile(r"[ \t]*\n?[ \t]*").match(body, at)
        got = destination_at(body, gap.end())
        if got is None or (got[1] == gap.end()):
            return None
        destination, at = got
        title, end = "", None
        if t := LINK_TITLE.match(body, at):
            rest = re.compile(r"[ \t]*(?:\n|$)").match(body, t.end())
            if rest and "\n\n" not in t[0]:
                title, end = t[1][1:-1], rest.end()
        if end is None:
            rest = re.compile(r"[ \t]*(?:\n|$)").match(body, at)
            if not rest:
                return None
            end = rest.end()
        return normal_label(m[1]), resolve(destination), resolve(title), end

    def line(self, c: Cursor, raw: str) -> None:
        depth = 1
        while depth < len(self.open):
            node = self.open[depth]
            first, indent = c.look()
            if node.type == "blockquote":
                if indent > 3 or not c.line.startswith(">", first):
                    break
                c.jump(first + 1)
                if c.at < len(c.line) and c.line[c.at] in " \t":
                    c.skip(1)
            elif node.type == "listItem":
                if c.blank:
                    if not node.children and node.blank_last:
                        break
                    c.jump(first)
                elif indent >= node.indent:
                    c.skip(node.indent)
                else:
                    break
            elif node.type == "fencedCodeBlock":
                m = re.compile(rf"{re.escape(node.fence[0])}{{{len(node.fence)},}}[ \t]*$").match(c.line, first)
                if indent <= 3 and m:
                    node.lines.append((c.offset + len(raw), ""))  # a mark that it was closed
                    node.kind = 1
                    self.close_to(depth)
                    return
                c.skip(min(indent, node.indent))
            elif node.type == "codeBlock":
                if indent >= 4:
                    c.skip(4)
                elif c.blank:
                    c.jump(first)
                else:
                    break
            elif node.type == "htmlBlock":
                if c.blank and node.kind >= 5:
                    break
            elif node.type == "paragraph":
                if c.blank:
                    break
            elif node.type != "list":
                break
            depth += 1
        all_matched, old = depth == len(self.open), list(self.open)
        matched = self.open[depth - 1]
        lazy_ok = self.tip.type == "paragraph"
        started = False
        if matched.type in ("fencedCodeBlock", "codeBlock", "htmlBlock"):
            self.keep(matched, c, raw)
            return
        while matched.type not in ("fencedCodeBlock", "codeBlock", "htmlBlock"):
            base = depth - (matched.type == "paragraph")  # what a new block goes into
            first, indent = c.look()
            rest = c.line[first:].rstrip("\r")
            if indent >= 4:
                if not (self.tip.type == "paragraph" and not started and (all_matched or lazy_ok)) and not c.blank:
                    self.close_to(base)
                    c.skip(4)
                    node = self.add(Node("codeBlock", c.tail()[0]))
                    self.keep(node, c, raw)
                    return
                break
            place = c.offset + first
            if rest.startswith(">"):
                self.close_to(base)
                self.add(Node("blockquote", place))
                c.jump(first + 1)
                if c.at < len(c.line) and c.line[c.at] in " \t":
                    c.skip(1)
            elif m := ATX.match(rest):
                self.close_to(base)
                node = self.add(Node("heading", place, level=len(m[1])))
                body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", rest[m.end() :].rstrip(" \t"))
                node.lines = [(place + m.end(), body.rstrip(" \t"))] if body.strip() else []
                self.close_to(len(self.open) - 1)
                return
            elif m := FENCE.match(rest):
                self.close_to(base)
                node = self.add(Node("fencedCodeBlock", place, indent=indent, fence=m[1] or m[3], info=(m[2] or m[4] or "").strip()))
                node.language = resolve(node.info.split()[0]) if node.info.split() else ""
                return
            elif rest.startswith("<") and (kind := next((k for k, p in enumerate(HTML_STARTS) if p.match(rest) and (k < 6 or not self.at_paragraph(matched, depth, started))), None)) is not None:
                self.close_to(base)
                node = self.add(Node("htmlBlock", c.offset + c.at, kind=kind))
                self.keep(node, c, raw)
                return
            elif self.at_paragraph(matched, depth, started) and (m := SETEXT.match(rest)) and self.setext(matched, m[1]):
                return
            elif RULE.match(rest):
                self.close_to(base)
                self.add(Node("thematicBreak", place))
                self.close_to(len(self.open) - 1)
                return
            elif item := self.item(rest, self.at_paragraph(matched, depth, started)):
                width, ordered, number, marker = item
                self.close_to(base)
                top = self.tip
                if not (top.type == "list" and top.ordered == ordered and top.marker == marker):
                    self.add(Node("list", place, ordered=ordered, number=number, marker=marker))
                c.jump(first + width)
                _, gap = c.look()
                if c.blank or gap > 4:
                    c.skip(1)
                    pad = width + 1
                else:
                    c.skip(gap)
                    pad = width + gap
                self.add(Node("listItem", place, indent=indent + pad))
            else:
                break
            started = True
            depth = len(self.open)
            matched = self.tip
        if not started and not all_matched and lazy_ok and not c.blank and old[-1].type == "paragraph" and matched.type != "paragraph":
            first, _ = c.look()  # a lazy continuation
            self.tip.lines.append((c.offset + first, c.line[first:].rstrip("\r")))
            return
        self.close_to(depth if not started else len(self.open))
        node = self.tip
        if c.blank:
            for n in self.open:
                n.blank_last = True
            return
        for n in self.open[1:]:
            n.blank_last = False
        first, _ = c.look()
        if node.type == "paragraph":
            node.lines.append((c.offset + first, c.line[first:].rstrip("\r")))
            return
        node = self.add(Node("paragraph", c.offset + first))
        node.lines.append((c.offset + first, c.line[first:].rstrip("\r")))

    def after_blank(self, node: Node) -> bool:
        """Whether the line before the node's is blank."""
        start = self.text.rfind("\n", 0, max(0, node.start)) + 1
        before = self.text.rfind("\n", 0, max(0, start - 1)) + 1
        return start > 0 and not self.text[before : start - 1].strip(" \t>\r")

    def at_paragraph(self, matched: Node, depth: int, started: bool) -> bool:
        return matched.type == "paragraph" and not started and depth == len(self.open)

    def setext(self, node: Node, line: str) -> bool:
        self.references(node)
        if not node.lines:
            return False
        node.type, node.level = "heading", 1 if line[0] == "=" else 2
        node.start = node.lines[0][0]
        node.lines[-1] = (node.lines[-1][0], node.lines[-1][1].rstrip(" \t"))
        self.open.remove(node)
        return True

    @staticmethod
    def item(rest: str, in_paragraph: bool) -> tuple[int, bool, int, str] | None:
        if m := BULLET.match(rest):
            got = (1, False, 0, m[0])
        elif m := NUMBER.match(rest):
            got = (m.end(), True, int(m[1]), m[2])
        else:
            return None
        if in_paragraph and (not rest[m.end() :].strip() or got[1] and got[2] != 1):
            return None
        return got

    def keep(self, node: Node, c: Cursor, raw: str) -> None:
        place, rest = c.tail()
        ending = raw[len(c.line) :] if raw.startswith(c.line) else ""
        node.lines.append((place, rest + ("\n" if "\n" in ending else "")))
        if node.type == "htmlBlock" and node.kind < 5 and HTML_ENDS[node.kind].search(rest):
            self.close_to(self.open.index(node))


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


def resolve(text: str) -> str:
    """Backslash escapes and entities."""
    return re.sub(rf"\\([{re.escape(PUNCTUATION)}])|({ENTITY.pattern})", lambda m: m[1] or entity(m[2]), text)


def entity(e: str) -> str:
    if e[1] == "#":
        n = int(e[3:-1], 16) if e[2] in "xX" else int(e[2:-1])
        return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "�"
    out = html.unescape(e)
    return e if out == e or out.endswith(";") and len(out) > 1 else out


def destination_at(s: str, at: int) -> tuple[str, int] | None:
    if s.startswith("<", at):
        m = re.compile(r"<((?:\\.|[^<>\n\\])*)>").match(s, at)
        return (m[1], m.end()) if m else None
    depth, i = 0, at
    while i < len(s) and s[i] not in " \n\t" and ord(s[i]) >= 32:
        if s[i] == "\\" and i + 1 < len(s) and s[i + 1] in PUNCTUATION:
            i += 1
        elif s[i] == "(":
            depth += 1
        elif s[i] == ")":
            if not depth:
                break
            depth -= 1
        i += 1
    return (s[at:i], i) if not depth else None


class Inlines:
    """The inline phase of one block: its lines joined, with the place of each character in the source."""

    def __init__(self, block: Node, refs: dict) -> None:
        self.s = "\n".join(t for _, t in block.lines)
        self.places: list[int] = []
        for p, t in block.lines:
            self.places += range(p, p + len(t) + 1)
        self.refs, self.out = refs, []
        self.delims: list[dict] = []
        self.brackets: list[dict] = []
        self.run()
        self.emphasis(0)
        block.children = [n for n in self.out if n.type != "gone"]
        merge(block)

    def node(self, type_: str, a: int, b: int, **more: object) -> Node:
        return Node(type_, self.places[a], self.places[b - 1] + 1 if b > a else self.places[a], **more)

    def text(self, a: int, b: int) -> None:
        if a < b:
            self.out.append(self.node("text", a, b, text=self.s[a:b]))

    def run(self) -> None:
        s, i, plain = self.s, 0, 0
        special = re.compile(r"[\\`*_\[\]!<\n]")
        while m := special.search(s, i):
            i, ch = m.start(), m[0]
            if ch == "\\":
                if i + 1 < len(s) and s[i + 1] == "\n":
                    self.text(plain, i)
                    self.line_break(True)
                    i = plain = self.after_break(i + 2)
                else:
                    i += 2 if i + 1 < len(s) and s[i + 1] in PUNCTUATION else 1
                continue
            if ch == "\n":
                end = i
                while end > plain and s[end - 1] == " ":
                    end -= 1
                self.text(plain, end)
                self.line_break(i - end >= 2)
                i = plain = self.after_break(i + 1)
                continue
            if ch == "`":
                n = len(re.compile("`+").match(s, i)[0])
                close = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(s, i + n)
                if not close:
                    i += n
                    continue
                self.text(plain, i)
                a, b = i + n, close.start()
                body = s[a:b]
                if body.startswith((" ", "\n")) and body.endswith((" ", "\n")) and body.strip(" \n"):
                    a, b = a + 1, b - 1
                span = self.node("codeSpan", i, close.end())
                span.children = [self.node("text", x, y, text=s[x:y], soft=y < b) for x, y in pieces(s, a, b)]
                self.out.append(span)
                i = plain = close.end()
                continue
            if ch == "<":
                auto = AUTO_URI.match(s, i) or AUTO_MAIL.match(s, i)
                raw = None if auto else INLINE_HTML.match(s, i)
                if not auto and not raw:
                    i += 1
                    continue
                self.text(plain, i)
                if auto:
                    self.out.append(self.node("autoLink", i, auto.end(), text=auto[1], kind=int(auto.re is AUTO_MAIL)))
                else:
                    self.out.append(self.node("rawHTML", i, raw.end(), raw=raw[0]))
                i = plain = (auto or raw).end()
                continue
            if ch in "*_":
                n = len(re.compile(re.escape(ch) + "+").match(s, i)[0])
                before, after = s[i - 1] if i else "\n", s[i + n] if i + n < len(s) else "\n"
                left, right = flank(before, after)
                self.text(plain, i)
                self.out.append(self.node("text", i, i + n, text=s[i : i + n]))
                opens = left and (ch == "*" or not right or punct(before))
                closes = right and (ch == "*" or not left or punct(after))
                if opens or closes:
                    self.delims.append({"node": self.out[-1], "ch": ch, "n": n, "size": n, "open": opens, "close": closes})
                i = plain = i + n
                continue
            if ch == "!" and not s.startswith("![", i):
                i += 1
                continue
            self.text(plain, i)
            if ch in "![":
                n = 2 if ch == "!" else 1
                self.out.append(self.node("text", i, i + n, text=s[i : i + n]))
                self.brackets.append({"node": self.out[-1], "at": i, "after": i + n, "image": n == 2, "active": True, "delims": len(self.delims)})
                i = plain = i + n
                continue
            i = plain = self.close_bracket(i)
        self.text(plain, len(s))

    def line_break(self, hard: bool) -> None:
        last = self.out[-1] if self.out and self.out[-1].type == "text" and not self.out[-1].soft and not self.out[-1].hard else None
        if last is None:
            self.out.append(last := Node("text", -1, -1))
        last.hard, last.soft = hard, not hard

    def after_break(self, i: int) -> int:
        while i < len(self.s) and self.s[i] in " \t":
            i += 1
        return i

    def close_bracket(self, i: int) -> int:
        s = self.s
        if not self.brackets:
            self.text(i, i + 1)
            return i + 1
        b = self.brackets.pop()
        got = None
        if b["active"]:
            got = self.inline_target(i + 1) or self.reference_target(b, i)
        if got is None:
            self.text(i, i + 1)
            return i + 1
        destination, title, end = got
        self.emphasis(b["delims"])
        k = next(j for j, n in enumerate(self.out) if n is b["node"])
        node = self.node("image" if b["image"] else "link", b["at"], end, destination=destination, title=title)
        node.children = [n for n in self.out[k + 1 :] if n.type != "gone"]
        merge(node)
        if b["image"]:
            node.alt = "".join(n.text for n in node.walk() if n.type in ("text", "string"))
        else:
            for x in self.brackets:
                if not x["image"]:
                    x["active"] = False
        self.out[k:] = [node]
        return end

    def inline_target(self, at: int) -> tuple[str, str, int] | None:
        s = self.s
        if not s.startswith("(", at):
            return None
        space = re.compile(r"[ \t]*\n?[ \t]*")
        got = destination_at(s, space.match(s, at + 1).end())
        if got is None:
            return None
        destination, i = got
        title = ""
        if t := LINK_TITLE.match(s, i):
            title, i = t[1][1:-1], t.end()
        i = space.match(s, i).end()
        return (resolve(destination), resolve(title), i + 1) if s.startswith(")", i) else None

    def reference_target(self, b: dict, i: int) -> tuple[str, str, int] | None:
        m = LABEL.match(self.s, i + 1)
        label, end = (m[1], m.end()) if m else (self.s[b["after"] : i], i + 3 if self.s.startswith("[]", i + 1) else i + 1)
        got = self.refs.get(normal_label(label)) if label.strip() else None
        return (*got, end) if got else None

    def emphasis(self, bottom: int) -> None:
        d = self.delims
        k = bottom
        while k < len(d):
            closer = d[k]
            if not closer["close"]:
                k += 1
                continue
            j = k - 1
            while j >= bottom:
                o = d[j]
                odd = (o["close"] or closer["open"]) and (o["size"] + closer["size"]) % 3 == 0 and (o["size"] % 3 or closer["size"] % 3)
                if o["open"] and o["ch"] == closer["ch"] and not odd:
                    break
                j -= 1
            if j < bottom:
                if not closer["open"]:
                    d.pop(k)
                else:
                    k += 1
                continue
            o = d[j]
            n = 2 if o["n"] >= 2 and closer["n"] >= 2 else 1
            a, z = (next(x for x, y in enumerate(self.out) if y is q["node"]) for q in (o, closer))
            on, cn = o["node"], closer["node"]
            node = Node("emphasis", on.end - n, cn.start + n, level=n)
            node.children = [x for x in self.out[a + 1 : z] if x.type != "gone"]
            merge(node)
            on.text, on.end = on.text[:-n], on.end - n
            cn.text, cn.start = cn.text[n:], cn.start + n
            self.out[a + 1 : z] = [node]
            del d[j + 1 : k]
            k = j + 1
            for q in (closer, o):
                q["n"] -= n
                if not q["n"]:
                    q["node"].type = "gone" if not (q["node"].hard or q["node"].soft) else "text"
                    at = next(x for x, y in enumerate(d) if y is q)
                    d.pop(at)
                    k -= at < k
        del d[bottom:]


def pieces(s: str, a: int, b: int) -> list[tuple[int, int]]:
    out, at = [], a
    while at < b:
        end = s.find("\n", at, b)
        end = b if end < 0 else end + 1
        out.append((at, end))
        at = end
    return out


def merge(node: Node) -> None:
    """Join neighbouring text without a break between."""
    out: list[Node] = []
    for n in node.children:
        if out and n.type == "text" and out[-1].type == "text" and not out[-1].soft and not out[-1].hard and out[-1].end == n.start:
            out[-1].text, out[-1].end, out[-1].soft, out[-1].hard = out[-1].text + n.text, n.end, n.soft, n.hard
        else:
            out.append(n)
    node.children = out


def punct(ch: str) -> bool:
    return ch in PUNCTUATION or unicodedata.category(ch)[0] in "PS"


def flank(before: str, after: str) -> tuple[bool, bool]:
    space = lambda c: c.isspace()
    left = not space(after) and (not punct(after) or space(before) or punct(before))
    right = not space(before) and (not punct(before) or space(after) or punct(after))
    return left, right


def parse(text: str) -> Node:
    blocks = Blocks(text)
    finish(blocks.root, blocks)
    ranges(blocks.root, text, len(text))
    return blocks.root


def finish(root: Node, blocks: Blocks) -> None:
    """Inline phase of all blocks below ``root``, and what only is known at a block's end."""
    stack = [(root, False)]
    while stack:
        node, tight = stack.pop()
        below = False
        if node.type == "list":
            items = node.children
            below = node.tight = not any(blocks.after_blank(n) for n in [*items[1:], *(c for i in items for c in i.children[1:])])
        elif node.type in ("paragraph", "heading"):
            if node.type == "paragraph" and node.lines:
                node.start = node.lines[0][0]
                node.lines[-1] = (node.lines[-1][0], node.lines[-1][1].rstrip(" \t"))
            Inlines(node, blocks.refs) if node.lines else None
            if node.type == "paragraph" and tight:
                node.type = "textBlock"
            continue
        elif node.type in ("codeBlock", "fencedCodeBlock"):
            node.text = "".join(t for _, t in node.lines)
            continue
        elif node.type == "htmlBlock":
            node.raw = "".join(t for _, t in node.lines)
            continue
        elif node.type == "listItem":
            below = tight
        stack += [(c, below) for c in reversed(node.children)]


def ranges(root: Node, text: str, limit: int) -> None:
    """Ends of nodes: the start of what follows, less white space; text and raw HTML keep their own."""
    stack = [(root, limit, 0)]
    while stack:
        node, limit, depth = stack.pop()
        if depth > MOST_DEPTH:
            raise MarkdownError(f"nodes are nested over {MOST_DEPTH} deep")
        following = []
        for c in reversed(node.children):
            following.append(limit)
            limit = c.start if c.start >= 0 else limit
        for c, after in zip(node.children, reversed(following), strict=True):
            if c.start < 0:
                c.start = next((n.start for n in c.walk() if n.start >= 0), -1)
            if c.start < 0:
                c.start = c.end = 0
            elif c.type not in ("text", "rawHTML"):
                c.end = c.start + len(text[c.start : max(c.start, after)].rstrip())
            stack.append((c, after, depth + 1))


ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"}
DANGEROUS = re.compile(r"(?i)^(?:javascript:|vbscript:|file:|data:(?!image/(?:png|gif|jpeg|webp|svg\+xml)[;,]))")


def escape(text: str) -> str:
    return re.sub('[&<>"]', lambda m: ESCAPES[m[0]], text)


def url(text: str) -> str:
    """Percent-encode what a URL can't hold, then escape."""
    out = re.sub(r"%(?![0-9A-Fa-f]{2})|[^A-Za-z0-9\-._~:/?#@!$&'()*+,;=%]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), text)
    return out.replace("&", "&amp;")


def render(text: str) -> str:
    """HTML; raw HTML and dangerous URLs are left out."""
    out: list[str] = []
    stack: list[Node | str] = list(reversed(parse(text).children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack += reversed(html_parts(x))
    return "".join(out)


def html_parts(n: Node) -> list[Node | str]:
    """The node's HTML, its children in their places."""
    inner = n.children
    match n.type:
        case "text":
            return [escape(resolve(n.text)) + ("<br>\n" if n.hard else "\n" if n.soft else "")]
        case "emphasis":
            tag = "em" if n.level == 1 else "strong"
            return [f"<{tag}>", *inner, f"</{tag}>"]
        case "codeSpan":
            return [f"<code>{escape(n.text_content().replace(chr(10), ' '))}</code>"]
        case "rawHTML":
            return ["<!-- raw HTML omitted -->"]
        case "autoLink":
            return [f'<a href="{"mailto:" if n.kind else ""}{url(n.text)}">{escape(n.text)}</a>']
        case "link" | "image":
            title = f' title="{escape(n.title)}"' if n.title else ""
            target = "" if DANGEROUS.match(n.destination) else url(n.destination)
            if n.type == "image":
                return [f'<img src="{target}" alt="{escape(resolve(n.alt))}"{title}>']
            return [f'<a href="{target}"{title}>', *inner, "</a>"]
        case "heading":
            return [f"<h{n.level}>", *inner, f"</h{n.level}>\n"]
        case "paragraph":
            return ["<p>", *inner, "</p>\n"]
        case "textBlock":
            return inner
        case "thematicBreak":
            return ["<hr>\n"]
        case "codeBlock" | "fencedCodeBlock":
            lang = f' class="language-{escape(n.language)}"' if n.language else ""
            return [f"<pre><code{lang}>{escape(n.text)}</code></pre>\n"]
        case "htmlBlock":
            return ["<!-- raw HTML omitted -->\n"]
        case "blockquote":
            return ["<blockquote>\n", *inner, "</blockquote>\n"]
        case "list":
            tag = "ol" if n.ordered else "ul"
            start = f' start="{n.number}"' if n.ordered and n.number != 1 else ""
            return [f"<{tag}{start}>\n", *inner, f"</{tag}>\n"]
    # An item: its text isn't wrapped in a tight list, so what comes next goes to a new line.
    parts: list[Node | str] = ["<li>" + ("\n" if inner and inner[0].type != "textBlock" else "")]
    for k, c in enumerate(inner):
        parts.append(c)
        if c.type == "textBlock" and k < len(inner) - 1:
            parts.append("\n")
    return [*parts, "</li>\n"]


def flatten(text: str, types: tuple[str, ...] | None = None) -> list[dict]:
    """Nodes in pre-order, with the ids of their parents; ``types`` keeps only some."""
    source, out = Source(text), []
    stack: list[tuple[Node, int | None, int, list[int]]] = [(parse(text), None, 0, [])]
    own = 0
    while stack:
        n, parent, index, path = stack.pop()
        if types is None or n.type in types:
            a, b = source.byte_position(n.start), source.byte_position(n.end)
            out.append({
                "node_id": own, "parent_id": parent, "depth": len(path), "child_index": index, "path": path, "type": n.type, "text": n.text, "level": n.level, "language": n.language,
                "destination": n.destination, "title": n.title, "alt": n.alt, "ordered": n.ordered, "start": n.number if n.ordered else 0, "marker": n.marker if n.type == "list" else "", "info": n.info, "raw": n.raw,
                "start_byte": source.byte(n.start), "end_byte": source.byte(n.end), "start_rune": n.start, "end_rune": n.end,
                "start_line": a[0], "start_column": a[1], "end_line": b[0], "end_column": b[1], "text_content": n.text_content(),
            })
        stack += [(c, own, i, [*path, i]) for i, c in reversed(list(enumerate(n.children)))]
        own += 1
    return out


def counts(text: str) -> dict:
    """How many nodes of some kinds a text has."""
    root = parse(text)
    kinds = Counter(n.type for n in root.walk())
    bad = any(not n.type or n.type == "heading" and not 1 <= n.level <= 6 for n in root.walk())
    return {"headings": kinds["heading"], "links": kinds["link"], "images": kinds["image"], "code_blocks": kinds["codeBlock"] + kinds["fencedCodeBlock"], "html": kinds["htmlBlock"] + kinds["rawHTML"], "blocks": len(root.children), "valid": not bad}


def check(node: dict) -> list[str]:
    """Errors of a node given as nested dicts (type, level, children)."""
    errors: list[str] = []
    stack = [(node, "root")]
    while stack:
        n, path = stack.pop()
        if not n.get("type"):
            errors.append(f"{path}: type is empty")
        if n.get("type") == "heading" and not 1 <= int(n.get("level") or 0) <= 6:
            errors.append(f"{path}: heading level must be 1 to 6")
        stack += [(c, f"{path}.Children[{i}]") for i, c in reversed(list(enumerate(n.get("children") or [])))]
    return errors
