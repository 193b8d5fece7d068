"""How row-local kernels meet DataFrames: Arrow batches in, rows out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of output gathered before they leave a kernel.
ROWS = 4096


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts in an Arrow batch at most: they are Python strings all at once, and one can be very long. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)


def explode(df: DataFrame, keys: list[str], text: str, schema: str, kernel: Callable[[str], list[dict]], errors: str = "permissive", extra: list[str] | None = None) -> DataFrame:
    """A row for each dict that ``kernel`` makes of a text, with the key columns.

    A null text gives no rows. ``errors``: ``permissive`` turns a kernel's ValueError (or too deep a recursion) into one row with only
    ``error`` set; ``failfast`` raises it. ``extra`` columns are passed to the kernel after the text. Keys may not be named as what the kernel makes.
    """
    extra = extra or []
    made_names = {f.name.lower() for f in StructType.fromDDL(schema).fields} | {"error"}
    if clash := [k for k in keys if k.lower() in made_names]:
        raise ValueError(f"key columns {clash} are named like columns of the result; rename them first")
    small_batches(df.sparkSession)
    src = df.select(*keys, F.col(text).alias("__text"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)])
    own = StructType.fromDDL(schema)
    out = StructType([src.schema[k] for k in keys] + own.fields)
    names = [f.name for f in own.fields]
    if errors == "permissive" and "error" not in names:
        out = out.add("error", "string")
    arrow = to_arrow_schema(out)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            rows: list[dict] = []
            for i, t in enumerate(cols[n]):
                if t is None:
                    continue
                key = {k: cols[j][i] for j, k in enumerate(keys)}
                try:
                    made = kernel(t, *(c[i] for c in cols[n + 1 :]))
                except (ValueError, RecursionError) as e:
                    if errors != "permissive":
                        raise
                    made = [{"error": str(e)}]
                rows += [r | key for r in made]
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return src.mapInArrow(run, out)
