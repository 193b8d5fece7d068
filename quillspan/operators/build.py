"""Markdown out of rows: tables by two aggregations, reports by native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import escape_markdown


def markdown_table(df: DataFrame, group: list[str], columns: dict[str, str], order: list[str]) -> DataFrame:
    """A Markdown table of each group's rows. ``columns``: column name -> alignment (left, center, right or '').

    Widths and rows come from one aggregation of each group, so a group is read once.
    """
    names = list(columns)
    cells = [F.trim(escape_markdown(F.coalesce(F.col(c).cast("string"), F.lit("")), cell=True)) for c in names]
    heads = [escape_markdown(F.lit(c), cell=True) for c in names]
    src = df.select(*group, F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]).alias("o"), *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    per = src.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("o", *[f"c{i}" for i in range(len(names))]))).alias("r"), *[F.max(F.char_length(f"c{i}")).alias(f"w{i}") for i in range(len(names))])
    width = [F.greatest(F.col(f"w{i}"), F.char_length(heads[i])) for i in range(len(names))]
    line = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    pad = lambda x, i: F.rpad(x, width[i], " ")
    rule = []
    for i, c in enumerate(names):
        w, a = F.greatest(width[i], F.lit(3)), columns[c]
        left, right = a in ("left", "center"), a in ("right", "center")
        rule.append(F.concat(F.lit(":" * left), F.repeat(F.lit("-"), w - int(left) - int(right)), F.lit(":" * right)))
    body = F.transform("r", lambda r: line([pad(r[f"c{i}"], i) for i in range(len(names))]))
    table = F.array_join(F.concat(F.array(line([pad(heads[i], i) for i in range(len(names))]), line(rule)), body), "\n")
    return per.select(*group, F.concat(table, F.lit("\n")).alias("markdown"))
