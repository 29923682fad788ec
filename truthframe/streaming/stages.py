"""Stages of a file pipeline as structured streams, with the state of every file."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from truthframe.sources.tables import latest


def files(spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream; ``per_trigger`` bounds a batch, as a prefetch does."""
    reader = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.load(path)


def stage(
    source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "file_name", name: str | None = None, time: str | None = None, late: str = "1 day"
) -> StreamingQuery:
    """Transforms what comes, each key once, into a folder of Parquet; restarts go on from the checkpoint and write nothing twice.

    With a ``time`` column a key is remembered for ``late`` after it was seen, as long as it may come again, so the state has
    a bound; without one every key is kept. A file that a stage has put out is the next stage's source, so stages chain by folders.
    """
    if key:
        source = source.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if time else source.dropDuplicates([key])
    q = transform(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (q.queryName(name) if name else q).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def keep_latest(source: DataFrame, out: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """The latest row of each key as a table: batch n is merged into version n - 1 and written as version n.

    A batch that is run again after a failure reads the same version and writes the same one, so the table is right
    whatever was lost. ``current`` reads it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = max((v for v in versions(spark, out) if v < number), default=None)
        rows = batch if before is None else spark.read.parquet(f"{out}/v{before}").unionByName(batch)
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{out}/v{number}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, out: str) -> list[int]:
    """Versions of a kept table that are complete."""
    if not _exists(spark, out):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    found = [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n[1:]) for n in found if n[:1] == "v" and n[1:].isdigit() and _exists(spark, f"{out}/{n}/_SUCCESS"))


def current(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/v{versions(spark, out)[-1]}")


def running_state(source: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value with the latest ``order`` for each key, as a stateful aggregation for update or complete mode."""
    return source.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order), F.count("*").alias("rows"))


def windowed(source: DataFrame, time: str, size: str, slide: str | None, keys: list[str], value: str, late: str) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return source.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(source: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """``(key, start, end, n)``: rows of a key no further apart than the gap."""
    rows = source.withWatermark(time, late) if late else source
    return rows.groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def local_path(url: str) -> str:
    return urlparse(url).path
