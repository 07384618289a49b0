"""Session factory with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from siltstone.runtime import reach_workers

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "siltstone", cores: int | str | None = None, **extra: str) -> SparkSession:
    """A local session. On a cluster, use the session that the launcher made instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g"} | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    reach_workers(spark)
    return spark
