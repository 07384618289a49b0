"""Helpers that every operator shares: table access, lineage cuts, spreading and size checks."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows, and bytes of their values, of a side that may be sent to every executor; beyond either the operators shuffle or work in blocks.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 64_000_000

_written: list[tuple[SparkSession, str]] = []

#: The folder that holds the package.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in. Where executors don't see that
    folder, ship the package with --py-files."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        known["PYTHONPATH"] = os.pathsep.join([HOME, *paths])


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, with only the columns that are named."""
    reach_workers(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a folder of this machine only where it is unset and the session is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    reach_workers(spark)
    path = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted with what is materialized."""
    path = f"{shared_dir(spark)}/siltstone-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_written(since: int = 0) -> None:
    """Delete what was materialized, the latest first."""
    while len(_written) > since:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            continue


atexit.register(remove_written)


@contextmanager
def intermediates() -> Iterator[None]:
    """What is materialized inside is deleted at the end. A result must be written or collected before."""
    since = len(_written)
    try:
        yield
    finally:
        remove_written(since)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a scan at least as many partitions as there are cores before costly per-row work; a large scan stays as it is. What comes out of
    a shuffle stays as well: to ask for its number of partitions would run it."""
    reach_workers(df.sparkSession)
    least = least or df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df.repartition(least) if df.rdd.getNumPartitions() < least else df


def is_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS, most_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether a frame has at most limit rows and most_bytes bytes; stops reading beyond the rows. The frame is computed for it, so it should be
    a stored one or a cheap one."""
    fixed = sum(8 for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, (T.StringType, T.BinaryType)))
    plain = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))) for f in df.schema.fields if not isinstance(f.dataType, T.AtomicType)]
    size = sum((F.coalesce(c, F.lit(0)).cast("long") for c in [*plain, *nested]), F.lit(fixed).cast("long"))
    rows, total = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= limit and total <= most_bytes


def small_side(df: DataFrame, limit: int = MAX_BROADCAST_ROWS, most_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark a join side for broadcast only where its size was checked; else leave the choice to the optimiser's statistics."""
    return F.broadcast(df) if is_small(df, limit, most_bytes) else df
