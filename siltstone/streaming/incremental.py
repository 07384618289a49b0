"""Streams: running counts in event-time windows, first deliveries only, sessions, and best matches that grow by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siltstone.runtime import remove


def event_stream(spark: SparkSession, path: str, schema: T.StructType, stamp: str = "ts", late: str = "10 minutes", **options: str) -> DataFrame:
    """Parquet files of a folder as a stream with a watermark. A stamp without a zone is read as UTC."""
    df = spark.readStream.schema(schema).options(**options).parquet(path)
    return df.withColumn(stamp, F.col(stamp).cast("timestamp")).withWatermark(stamp, late)


def windowed_counts(events: DataFrame, stamp: str, keys: list[str], value: str, width: str, slide: str | None = None) -> DataFrame:
    """(start, keys, n, total) of tumbling windows, or of sliding ones. Works on a stream and on a table alike."""
    w = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, stamp: str, key: str, gap: str) -> DataFrame:
    return events.groupBy(F.session_window(stamp, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_deliveries(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once within the watermark; on a table, once at all."""
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def merged_best(known: DataFrame, new: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The k best of both by score, then item; an item counts once in a group, with its highest score."""
    both = known.unionByName(new).groupBy(group, item).agg(F.max(score).alias(score))
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def written_whole(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the whole result of a stream's aggregation under path, written anew with each batch, until all that is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, table_path: str) -> DataFrame:
    """The state that keep_best has reached."""
    files = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    names = [s.getPath().getName() for s in files.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(files)]
    return spark.read.parquet(f"{table_path}/v={max(int(n[2:]) for n in names if n.startswith('v='))}")


def keep_best(stream: DataFrame, table_path: str, checkpoint: str, group: str, item: str, score: str, k: int) -> StreamingQuery:
    """Maintain the k best rows a group in versions under table_path. A batch that is run again writes its own version again, so each counts once."""
    spark = stream.sparkSession
    schema = stream.select(group, item, score).schema

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(f"{table_path}/v={number - 1}") if number else spark.createDataFrame([], schema)
        merged_best(before, batch.select(group, item, score), group, item, score, k).write.mode("overwrite").parquet(f"{table_path}/v={number}")
        if number > 1:  # a batch that is run again needs the version before its own, no older one
            remove(spark, f"{table_path}/v={number - 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
