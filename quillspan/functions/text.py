"""Native column functions: measures, formats, slugs, Markdown formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.kernels.chunking import WORD_SPACE

GENERIC = ("data", "result", "answer", "payload", "arguments", "tool_call")


def measure(text: Column, unit: str = "runes") -> Column:
    """Bytes, code points, or words between Unicode white space."""
    if unit == "bytes":
        return F.octet_length(text)
    if unit == "words":
        return F.regexp_count(text, F.lit(f"[^{WORD_SPACE}]+"))
    if unit != "runes":
        raise ValueError(f"unknown measure {unit!r}")
    return F.char_length(text)


def running(parts: Column) -> Column:
    """Pieces of a text with the byte (b), code point (r) and 1-based line (l) at which each starts."""
    before = lambda f: F.aggregate(
        parts, F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.concat(s["a"], F.array(s["n"])).alias("a"), (s["n"] + f(x)).alias("n")), lambda s: s["a"],
    )
    zipped = F.arrays_zip(parts.alias("t"), before(F.octet_length).alias("b"), before(F.char_length).alias("r"), before(lambda x: F.when(F.endswith(x, F.lit("\n")), 1).otherwise(0)).alias("l"))
    return F.transform(zipped, lambda z: F.struct(z["t"].alias("t"), z["b"].alias("b"), z["r"].alias("r"), (z["l"] + 1).alias("l")))


def format_of_label(label: Column) -> Column:
    word = F.regexp_extract(F.lower(F.trim(label)), r"^(\S+)", 1)
    return F.when(word.isin("json", "jsonc"), "json").when(word.isin("yaml", "yml"), "yaml").when((word == "") | word.isin(*GENERIC), "unknown").otherwise(word)


def format_of_payload(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    wrapped = (F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))) | (F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")))
    return F.when(wrapped, "json").when(F.contains(t, F.lit("\n")) & F.contains(t, F.lit(":")), "yaml").otherwise("unknown")


#: White space of JavaScript, at which anchors' words end.
ANCHOR_SPACE = "\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def slug(text: Column) -> Column:
    """An anchor: lower case; of its characters only a-z, 0-9 and dashes stay, white space becomes a dash, of several dashes one stays."""
    s = F.regexp_replace(F.lower(F.regexp_replace(text, f"^[{ANCHOR_SPACE}]+|[{ANCHOR_SPACE}]+$", "")), f"[^a-z0-9{ANCHOR_SPACE}-]", "")
    return F.regexp_replace(F.regexp_replace(s, f"[{ANCHOR_SPACE}-]+", "-"), "^-|-$", "")


def escape_markdown(text: Column, cell: bool = False) -> Column:
    out = F.regexp_replace(text, r"([\\*_`\[\]<>])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(out, r"\|", r"\\|"), r"\r\n|\r|\n", "<br>") if cell else out


def heading(level: int, text: Column) -> Column:
    if not 1 <= level <= 6:
        raise ValueError("heading level must be between 1 and 6")
    return F.concat(F.lit("#" * level + " "), escape_markdown(text))


def bullet_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), escape_markdown(x))), "\n")


def ordered_list(items: Column, start: int = 1) -> Column:
    if start <= 0:
        raise ValueError("ordered list start must be greater than zero")
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + start).cast("string"), F.lit(". "), escape_markdown(x))), "\n")


def checklist(items: Column) -> Column:
    """Of structs (text, checked)."""
    return F.array_join(F.transform(items, lambda x: F.concat(F.when(x["checked"], "- [x] ").otherwise("- [ ] "), escape_markdown(x["text"]))), "\n")


def blockquote(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("> "), x)), "\n")


def emphasis(text: Column) -> Column:
    return F.concat(F.lit("*"), escape_markdown(text), F.lit("*"))


def strong(text: Column) -> Column:
    return F.concat(F.lit("**"), escape_markdown(text), F.lit("**"))


def link(text: Column, destination: Column) -> Column:
    """A link; a destination with blanks or parentheses goes in angle brackets."""
    angled = F.rlike(destination, F.lit(r"[\s()<>]"))
    plain = F.regexp_replace(destination, r"([<>])", r"\\$1")
    return F.concat(F.lit("["), escape_markdown(text), F.lit("]("), F.when(angled, F.concat(F.lit("<"), plain, F.lit(">"))).otherwise(destination), F.lit(")"))


def code(text: Column) -> Column:
    """A code span, in as many backticks as its text needs."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    pad = F.when(F.startswith(text, F.lit("`")) | F.endswith(text, F.lit("`")), " ").otherwise("")
    return F.concat(fence, pad, text, pad, fence)


def callout(kind: str, title: Column, text: Column) -> Column:
    return F.concat(F.lit(f"> [!{kind.upper()}] "), title, F.lit("\n"), blockquote(text))


def code_block(language: str, text: Column) -> Column:
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit(f"{language}\n"), F.regexp_replace(text, r"\n+$", ""), F.lit("\n"), fence)


def document(*blocks: Column) -> Column:
    """Blocks joined by blank lines; empty and null ones are left out."""
    trimmed = [F.regexp_replace(b, r"^\n+|\n+$", "") for b in blocks]
    return F.concat(F.array_join(F.filter(F.array(*trimmed), lambda x: x.isNotNull() & (x != "")), "\n\n"), F.lit("\n"))


def frontmatter(text: Column) -> Column:
    """The front matter's YAML; null where there is none."""
    pattern = r"(?s)^---[\t\n\f\r ]*\r?\n(.*?)\r?\n---[\t\n\f\r ]*\r?\n?"
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[\t\n\f\r ]*\r?\n(.*?)\r?\n---[\t\n\f\r ]*\r?\n?", "")
