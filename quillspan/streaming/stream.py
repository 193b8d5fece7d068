"""The same row-local operators on streams. They keep no state: what a batch makes of a row, a stream does in append mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 64, format: str = "parquet", glob: str | None = None) -> DataFrame:  # noqa: ANN001
    """A stream of a folder's files, or of one file. ``glob`` filters names of data files, so it doesn't find a table that is a folder itself."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    name = at.getName()
    if found and found[0].isFile() and found[0].getPath().getName() == name:
        folder = f"{folder.rstrip('/').removesuffix(name)}[{name[0]}]{name[1:]}"  # Spark streams a single file only by a pattern
    r = spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", glob) if glob else r).load(folder)


def apply_stream(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, format: str = "parquet"):  # noqa: ANN201
    """Run an operator over what is there now and append its rows to files, each exactly once."""
    return operator(stream).writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


def counts_by_window(stream: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """Rows by event-time window; late ones within the watermark still count."""
    timed = stream.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", window), *(by or [])).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *(by or []), "n")
