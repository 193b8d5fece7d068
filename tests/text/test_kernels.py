import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.kernels import builder, chunking, document, extract, markdown, sanitize, template
from quillspan.kernels.positions import Source

TEXT = st.text(alphabet="ab é🙂\n\r\t#-*`_[]()<>~>.1\\", max_size=60)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_segments_are_lossless(text):
    for spans in (chunking.lines(text), chunking.lines(text, False), *(chunking.paragraphs(text, m) for m in ("trailing", "separate", "leading")), chunking.markdown_blocks(text), chunking.markdown_sections(text), chunking.windows(text, 3), chunking.windows(text, 4, "bytes")):
        chunking.validate(spans, text)
    leaves = chunking.recursive_leaves(text, 5)
    assert "".join(s.text for s in leaves) == text
    assert all(len(c.text) <= 5 for c in chunking.recursive(text, 5, atomic=()))


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_markdown_never_fails_and_ranges_nest(text):
    markdown.render(text)
    for n in markdown.flatten(text):
        assert 0 <= n["start_rune"] <= n["end_rune"] <= len(text)
        assert text[: n["start_rune"]].encode() == text.encode()[: n["start_byte"]]


@given(st.lists(st.integers(1, 9), max_size=20), st.integers(1, 12), st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_pack_loses_nothing(sizes, budget, overlap):
    text = "".join("x" * (n - 1) + "\n" for n in sizes)
    spans = chunking.lines(text)
    chunks = chunking.pack(spans, budget, overlap=overlap)
    assert sorted({i for c in chunks for i in c.span_ordinals}) == list(range(len(spans)))
    assert all(c.text and (c.weight <= budget or c.oversized and len(c.span_ordinals) == 1) for c in chunks)


def test_lines_and_paragraphs():
    assert [(s.kind, s.text) for s in chunking.lines("one\r\ntwo", False)] == [("line", "one"), ("lineTerminator", "\r\n"), ("line", "two")]
    assert chunking.lines("") == []
    s = "first\r\n\r\nsecond\n\n\nthird"
    assert [x.text for x in chunking.paragraphs(s)] == ["first\r\n\r\n", "second\n\n\n", "third"]
    assert [x.kind for x in chunking.paragraphs(s, "separate")] == ["paragraph", "paragraphSeparator"] * 2 + ["paragraph"]
    assert [x.text for x in chunking.paragraphs("a\n\n", "leading")] == ["a\n", "\n"]
    assert [x.text for x in chunking.paragraphs(" \n\n")] == [" \n\n"]
    with pytest.raises(chunking.ChunkingError):
        chunking.paragraphs("a", "both")


def test_packing_values():
    assert [c.text for c in chunking.pack(chunking.lines("é1\né2\né3\né4\n"), 8, "bytes", 1)] == ["é1\né2\n", "é2\né3\n", "é3\né4\n"]
    chunks = chunking.pack(chunking.lines("ab\nfar too long for it\ncd\n"), 5)
    assert [(c.oversized, c.weight, [d["code"] for d in c.diagnostics]) for c in chunks] == [(False, 3, []), (True, 20, ["span_exceeds_budget"]), (False, 3, [])]
    with pytest.raises(chunking.ChunkingError, match="span_exceeds_budget"):
        chunking.pack(chunking.lines("far too long"), 5, oversized="error")
    spans = chunking.windows("vwxyz", 1)
    last = chunking.pack_weighted(spans, [3, 40, 2, 2, 9], 45, 4)[-1]
    assert (last.span_ordinals, last.text, last.start_byte, last.end_byte) == ([2, 3, 4], "xyz", 2, 5)
    spans[1].end_byte += 1
    with pytest.raises(chunking.ChunkingError, match="invalid_range"):
        chunking.pack(spans, 3)


def test_recursive_values():
    assert len(chunking.recursive("abcdefghijklmnopqrstuvwxyz", 5)) == 6
    chunks = chunking.recursive("# Heading\n\nabcdefghijklmnopqrstuvwxyz", 8)
    assert len(chunks) >= 4 and all(c.heading_path == ["Heading"] for c in chunks)
    assert [(c.text, c.level) for c in chunking.recursive("", 5)] == [("", "")]
    assert chunking.recursive("a", 5, levels=("nonsense",))[0].text == "a"
    with pytest.raises(chunking.ChunkingError, match="unknown_recursive_level"):
        chunking.recursive("abcdefgh", 5, levels=("nonsense",))


def test_sections():
    spans = chunking.markdown_sections("preamble\n\n# A\nBody\n\n## B\nNested\n\n# C\nEnd\n")
    assert [s.heading_path for s in spans] == [[], ["A"], ["A", "B"], ["C"]] and spans[0].kind == "preamble"


def test_block_ranges():
    blocks = ["Opening words, *slanted* in part.", "1) one\n2) two", "Under a line\n====", "~~~text file=x\nraw *stays*\n~~~", "> cited\n> twice", "***", "<section>\nkept\n</section>"]
    assert [("\n\n".join(blocks) + "\n")[c.start : c.end] for c in markdown.parse("\n\n".join(blocks) + "\n").children] == blocks


def test_node_fields():
    s = 'Über\n===\n\nSee ![a **tiny** map](maps/north.svg "North") here.\n\n~~~sql key=1\nselect 2\n~~~\n\n    four in\n\n<aside>note</aside>\n\nPlain <kbd>K</kbd> end.\n'
    by = {}
    for n in markdown.flatten(s):
        by.setdefault(n["type"], n)
    i = by["image"]
    assert (i["destination"], i["title"], i["alt"], i["start_line"], i["start_column"]) == ("maps/north.svg", "North", "a tiny map", 4, 5)
    f = by["fencedCodeBlock"]
    assert (f["language"], f["info"], f["text"], f["start_line"]) == ("sql", "sql key=1", "select 2\n", 6)
    assert (by["codeBlock"]["start_line"], by["codeBlock"]["text"]) == (10, "four in\n")
    assert by["htmlBlock"]["raw"].startswith("<aside>note</aside>") and by["rawHTML"]["raw"] == "<kbd>"
    t = "Ça 🙂 va **très** bien, [lire](https://example.org/é).\n"
    assert [t[n["start_rune"] : n["end_rune"]] for n in markdown.flatten(t, ("emphasis", "link"))] == ["**très**", "[lire](https://example.org/é)"]


def seconds(f, *args):
    start = time.process_time()
    try:
        f(*args)
    except ValueError as e:
        return time.process_time() - start, str(e)
    return time.process_time() - start, ""


@pytest.mark.parametrize("mark", ["> ", "- ", "1. ", "* > "])
def test_deeply_nested_blocks(mark):
    for n in (200, 450):
        text = mark * (n // (2 if mark == "* > " else 1)) + "x"
        assert markdown.flatten(text)[-1]["type"] == "text" and "x" in markdown.render(text) and markdown.counts(text)["valid"]
    for f in (markdown.flatten, markdown.render, chunking.markdown_blocks, document.first_heading):
        spent, error = seconds(f, mark * 100_000 + "x")
        assert "nested" in error and spent < 3


def test_deeply_nested_inlines_and_data():
    spent, error = seconds(markdown.flatten, "*a " * 3000 + "b*" * 3000)
    assert spent < 5 and ("nested" in error or not error)
    assert "nested" in sanitize.simple_yaml("- " * 5000 + "x")[1] and "nested" in sanitize.simple_yaml("\n".join(" " * i + "a:" for i in range(3000)))[1]
    assert sanitize.strict_json("[" * 100_000)[0] is False


def test_unclosed_tags_are_one_pass():
    rule = document.BlockRule("t", ("t",))
    assert seconds(document.find_blocks, "<t>" * 50_000, rule)[0] < 2
    assert seconds(document.find_blocks, "<t " * 200_000, rule)[0] < 2
    assert len(document.find_blocks("<t>x</t>" * 5000 + "<t>" * 5000, rule)) == 5000
    for text, want in (("</t><t>a</t>", ["a"]), ("<T>a<t/>b</t></t>", ["a<t/>b"]), ("<t><t>a</t>", ["a"]), ("<t>a</u></t><t x='1'>b</ t >", ["a</u>", "b"]), ("<t>a<t>b</t>", ["b"])):
        assert [b.text for b in document.find_blocks(text, rule)] == want


def brute_pack(sizes, budget, overlap):
    """Chunks as lists of places, span by span."""
    out, now = [], []
    for i, n in enumerate(sizes):
        if n > budget:
            out += [now, [i]] if now else [[i]]
            now = []
        elif now and sum(sizes[k] for k in now) + n > budget:
            out.append(now)
            tail = now[-overlap:] if overlap else []
            while tail and sum(sizes[k] for k in tail) + n > budget:
                tail = tail[1:]
            now = [*tail, i]
        else:
            now = [*now, i]
    return [*out, now] if now else out


@given(st.lists(st.integers(0, 12), max_size=14), st.integers(1, 15), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_pack_matches_brute_force(sizes, budget, overlap):
    text = "".join("x" * n + "\n" for n in sizes)
    spans = chunking.lines(text)
    got = chunking.pack(spans, budget, overlap=overlap)
    assert [c.span_ordinals for c in got] == brute_pack([n + 1 for n in sizes], budget, overlap)
    assert all(c.text == text[c.start_rune : c.end_rune] and c.weight == len(c.text) and c.oversized == (c.weight > budget) for c in got)


@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 14), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_weighted_overlap_matches_brute_force(weights, budget, overlap):
    spans = chunking.lines("ab\n" * len(weights))
    got = [c.span_ordinals for c in chunking.pack_weighted(spans, weights, budget, overlap)]
    want = []
    for own in brute_pack(weights, budget, 0):
        total = sum(weights[k] for k in own)
        fits = [k for k in (want[-1] if want else []) if k < own[0] and sum(weights[k : own[0]]) <= min(overlap, budget - total)]
        want.append([*(fits if overlap else []), *own])
    assert got == want


@pytest.mark.parametrize(
    ("text", "html"),
    [
        ("***a** b*", "<p><em><strong>a</strong> b</em></p>\n"),
        ("[foo]\n\n[foo]: /u \"t\"\n", '<p><a href="/u" title="t">foo</a></p>\n'),
        ("a  \nb\\\nc\nd", "<p>a<br>\nb<br>\nc\nd</p>\n"),
        ("Hi\n===\nx\n---\n", "<h1>Hi</h1>\n<h2>x</h2>\n"),
        ("1. a\n2. b\n   - c\n\n     d\n3. e", "<ol>\n<li>a</li>\n<li>b\n<ul>\n<li>\n<p>c</p>\n<p>d</p>\n</li>\n</ul>\n</li>\n<li>e</li>\n</ol>\n"),
        ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>\n"),
        ("> a\nb\n> c", "<blockquote>\n<p>a\nb\nc</p>\n</blockquote>\n"),
        ("<a@b.c> &amp; \\* <b>", '<p><a href="mailto:a@b.c">a@b.c</a> &amp; * <!-- raw HTML omitted --></p>\n'),
        ("[a](javascript:x)", '<p><a href="">a</a></p>\n'),
        ("`` c`d ``", "<p><code>c`d</code></p>\n"),
        ("a\n# b\nc", "<p>a</p>\n<h1>b</h1>\n<p>c</p>\n"),
        ("\tcode\n\nx", "<pre><code>code\n</code></pre>\n<p>x</p>\n"),
    ],
)
def test_html(text, html):
    assert markdown.render(text) == html


def test_validate_node():
    assert markdown.check({"type": "document", "children": [{"type": "heading", "level": 9}, {}]}) == ["root.Children[0]: heading level must be 1 to 6", "root.Children[1]: type is empty"]


def test_document():
    spec = document.Spec((document.FieldRule("title", required=True), document.FieldRule("n", "number", default=3)), (document.BlockRule("cfg", ("cfg",), ("json",), json=True, repair=True, strip=True),))
    d = document.build("---\ntitle: T\n---\nA\n<cfg>{'a': 1,}</cfg>\n```json x\n{\"b\": 2}\n```\nZ", spec)
    assert d.frontmatter == {"title": "T", "n": 3} and d.body == "A\n\n\nZ"
    assert [(b.kind, b.json_value) for b in d.blocks] == [("xml", '{"a": 1}'), ("fence", '{"b": 2}')]
    assert document.split("---\n---\nx") == (None, "---\n---\nx")
    with pytest.raises(document.DocumentError, match="required"):
        document.build("x", spec)
    with pytest.raises(document.DocumentError, match="expected number"):
        document.build("---\ntitle: T\nn: x\n---\n", spec)
    assert document.Spec((document.FieldRule("1x"), document.FieldRule("a"), document.FieldRule("a", "list")), (document.BlockRule("B"),)).errors() != []
    nested = document.find_blocks("<t>a<t>b</t>c</t><t>d</t>", document.BlockRule("t", ("t",)))
    assert [b.text for b in nested] == ["a<t>b</t>c", "d"]
    assert document.first_heading("> ## In\n\n# Out") == "In"
    assert (document.get_string({"a": 2.0}, "a"), document.get_number({"a": "2.5"}, "a"), document.get_bool({"a": "T"}, "a")) == ("2", 2.5, True)


def test_builder():
    out = builder.Builder().title("Harvest 2031").paragraph("Pears and plums.").heading(3, "Left to pick").bullet_list(["quinces", "late apples"]).render()
    assert out == "# Harvest 2031\n\nPears and plums.\n\n### Left to pick\n\n- quinces\n- late apples\n"
    t = builder.Builder().table().columns({"label": "Tree", "align": "right"}, {"label": "Kg", "align": "left"}, "Remark").row("Oak", 7, "bark | moss").row("Elm", 1250, "first\nthen").end().render()
    rows = [[c.strip() for c in re.split(r"(?<!\\)\|", line)[1:-1]] for line in t.splitlines()]
    assert rows[0] == ["Tree", "Kg", "Remark"] and rows[2:] == [["Oak", "7", "bark \\| moss"], ["Elm", "1250", "first<br>then"]]
    assert [(c[0] == ":", c[-1] == ":") for c in rows[1]] == [(False, True), (True, False), (False, False)] and len({len(x) for x in t.splitlines()}) == 1
    p = builder.Builder().paragraph("Keep _these_ [marks], run ", builder.code("make all"), "!").render()
    assert p == "Keep \\_these\\_ \\[marks\\], run `make all`!\n"
    assert builder.Builder().callout("note", "T", lambda b: b.paragraph("x")).render() == "> [!NOTE] T\n> x\n"
    with pytest.raises(builder.BuilderError):
        builder.Builder().heading(7, "x").render()
    assert builder.Builder().code_block("py", "a ``` b\n").render() == "````py\na ``` b\n````\n"


def test_extract():
    t = "---\na: 1\n---\n```json demo\n{\"a\":1}\n```\n~~~yaml\nk: v\n~~~\n<json>{}</json> <payload type=\"yaml\">a: 1\nb: 2</payload>"
    got = extract.extract_all(t)
    assert [(c.kind, c.format, c.label) for c in got] == [("frontmatter", "yaml", "yaml"), ("markdownCodeBlock", "json", "json"), ("markdownCodeBlock", "yaml", "yaml"), ("xmlTagged", "json", "json"), ("xmlTagged", "yaml", "payload")]
    assert got[4].info == '<payload type="yaml">'
    assert extract.frontmatter("---\na: 1\n") == [] and extract.frontmatter("---\na: 1\n", extract.Options(include_diagnostics=True))[0].confidence == 0.4
    assert [c.confidence for s in ('{"a":1}', "{'a': 1,}", "key: 1\nname: 2", "plain prose") for c in extract.raw_structured(s)] == [0.98, 0.75, 0.9]
    assert extract.fences("```x\nopen")[0].confidence == 0.6
    assert len(extract.extract_all(t, extract.Options(max_candidates=2))) == 2
    assert [extract.validate(*a)["valid"] for a in (("json", "{'ok': True,}", "none"), ("unknown", "prose", "none"), ("xml", "x", "xmlTag"), ("yaml", "a: 1", "none"))] == [True, False, True, True]
    with pytest.raises(extract.ExtractError):
        extract.Options.of(formats=["pdf"], min_confidence=2.0)
    src = Source("alpha\nbeta\ngamma")
    assert [src.byte_position(i, 0) for i in (0, 5, 6, 10, 11, 16)] == [(0, 0), (0, 5), (1, 0), (1, 4), (2, 0), (2, 5)]


@pytest.mark.parametrize(
    ("kind", "text", "fixed"),
    [("json", "{'ok': True,}", '{"ok": true}'), ("json", "~~~json\n{'ok': True,}\n~~~\n", '{"ok": true}'), ("json", '{"a":[1,2', '{"a":[1,2]}'), ("yaml", "name:Alice\n", "name: Alice\n"), ("yaml", "a:\n\tb: 1\n", "a:\n  b: 1\n"), ("yaml", "-one\n-two\n", "- one\n- two\n")],
)
def test_repair(kind, text, fixed):
    r = sanitize.sanitize(text, kind)
    assert (r.sanitized, r.parse_clean, r.lint_clean) == (fixed, True, True) and r.fixes


def test_sanitize_options():
    assert sanitize.strict_json('{"a":1,"a":2}')[0] and not any(sanitize.strict_json(t)[0] for t in ("[1,]", "NaN", '{"a":1} x', "01"))
    assert [i.rule for i in sanitize.lint('{"a":1,"a":2}', "json")] == ["duplicate_key"]
    assert sanitize.sanitize("{'a': 1,}", "json", sanitize.Options(only_rules=("trailing_comma",))).sanitized == "{'a': 1}"
    with pytest.raises(sanitize.OptionsError):
        sanitize.Options.from_dict({"bogus": 1}, "json")
    assert sanitize.Options.from_dict({"bogus": 1, "maxIterations": 3}, "json", "collect").unknown == ("bogus",)
    with pytest.raises(sanitize.OptionsError):
        sanitize.Options.from_dict({"onlyRules": ["tab_indent"], "disabledRules": ["tab_indent"]}, "yaml")


def test_simple_yaml_agrees_on_front_matter():
    for text in ("a: 1\nb: [1, two]\nc:\n  - x: 1\n    y: z\n  - 2\nd: 'q'\ne: 2.5\nf: true\n", "title: Doc 1\nlang: en", "", "- a\n- b\n"):
        assert sanitize.simple_yaml(text) == sanitize.load_yaml(text)


def test_templates():
    r = template.render_text("In {{ .town | lower }}: é", {"town": "OSLO"})
    assert (r.text, r.mode, r.template_name, r.bytes) == ("In oslo: é", "text", "template", 11)
    h = template.render_html('<b>{{ .who }}</b> <img src="{{ .at }}">', {"who": "a<b>&c", "at": "vbscript:x"}).text
    assert "a&lt;b&gt;&amp;c" in h and "vbscript:" not in h
    s = template.TemplateSet('{{ define "line" }}* {{ .k }}{{ end }}', template.Config(name="list"))
    assert s.render({"k": "v"}, "line").text == "* v" and s.names() == ["line", "list"] and s.lookup("line")
    with pytest.raises(template.TemplateError, match="map has no entry for key"):
        template.render_text("{{ .Name }}", {})
    assert len(template.Config(name="", funcs=("none", "sprig"), missing_key="bogus", left="[[", right="[[").errors()) >= 4
    assert template.render_text("{{ . }}", "ok").text == "ok"
    assert template.TemplateSet("[[ shout .x ]]", template.Config(left="[[", right="]]", custom=(("shout", lambda v: v + "!"),))).render({"x": "a"}).text == "a!"
    assert template.render_text("{{ toYaml . }}", {"a": [1, "x"], "b": {"c": True}}).text == "a:\n    - 1\n    - x\nb:\n    c: true"
    for bad in ("<script>{{ . }}</script>", "<a b={{ . }}>", "{{ if . }}", "{{ nope . }}"):
        with pytest.raises(template.TemplateError):
            template.TemplateSet(bad, template.Config(mode="html"))
