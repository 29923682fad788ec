"""Session helpers: tables read by name, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "truthframe", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """The running session, or a new one with adaptive execution on and UTC as time zone; columns don't record their place in the caller's code, which takes most of the time of building large plans."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    spark = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession | None = None) -> None:
    """Hands this package to the session's Python workers, once, so that they need no copy on their path.

    The archive is handed over by the driver itself, wherever tables are kept. Whatever runs Python calls this.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    sc = spark.sparkContext
    _SHIPPED.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix=f"{package.name}-code-")  # the driver's own; no data
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder, f"{package.name}-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where that is unset and all runs on this machine (tests) one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="truthframe-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cuts the lineage of ``df``: written once to the shared folder as Parquet and read from there.

    Unlike a cached or locally checkpointed frame, the result doesn't depend on any executor staying alive.
    ``drop_written`` deletes what is no longer needed; the rest goes when the process ends.
    """
    spark = df.sparkSession
    ship(spark)
    path = written_path(spark, name)
    if not _WRITTEN:  # after the session's own handler was registered, so before it runs
        atexit.unregister(_clean_up)
        atexit.register(_clean_up)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows as part of the plan itself, without a task for each core."""
    kinds = StructType.fromDDL(schema)
    columns = list(zip(*rows)) or [()] * len(kinds)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=kinds.names), kinds).coalesce(1)


def settle(df: DataFrame, name: str = "stage", small: int = 10_000) -> tuple[DataFrame, pa.Table | None]:
    """Cuts the lineage of a frame that is likely to be small: up to ``small`` rows become part of the plan, and are returned beside it; more are written."""
    head = df.limit(small + 1).toArrow()  # no more than that reaches the driver
    if head.num_rows > small:
        return materialize(df, name), None
    return df.sparkSession.createDataFrame(head, df.schema).coalesce(1), head  # of one partition: small frames meet without a shuffle


def drop_written(df: DataFrame | None) -> None:
    """Deletes the table behind a frame made by ``materialize``; any other frame is left alone."""
    path = getattr(df, "_written_path", None)
    if path:
        _delete(df.sparkSession, path)
        _WRITTEN[:] = [(s, p) for s, p in _WRITTEN if p != path]


def _clean_up() -> None:
    """Deletes what is left of written tables, on whatever file system, while the session still runs."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            at = urlparse(path)
            if at.scheme in ("", "file"):
                shutil.rmtree(at.path, ignore_errors=True)
