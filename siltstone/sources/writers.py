"""Writers: JSON lines, chat files, CSV reports and Parquet."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, compression: str | None = None, mode: str = "error", verify: bool = False) -> None:
    """UTF-8 JSON lines; compression may be gzip, bzip2 or deflate. With verify, a first record is read again and must have all columns."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    (writer.option("compression", compression) if compression else writer).json(path)
    if verify:
        line = df.sparkSession.read.text(path).first()
        if line is not None and set(json.loads(line[0])) != set(df.columns):
            raise ValueError(f"first record of {path} has not the columns {df.columns}")


def write_split(df: DataFrame, flag: str, path: str, mode: str = "error") -> None:
    """Rows by a flag in folders of one output, so that the good rows of a later read prune the others."""
    df.write.mode(mode).partitionBy(flag).parquet(path)


def write_vectors(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append without reading what is there; zstandard, as the archive has it."""
    df.write.mode("append").option("compression", "zstd").parquet(path)


def write_report(df: DataFrame, path: str, order: list[Column | str], mode: str = "error") -> None:
    """Fully quoted CSV in order. The sort is distributed: files follow each other by name."""
    df.orderBy(*order).write.mode(mode).option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def matches_document(matches: DataFrame, key: str, stats: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """(key, document): each test's matches in order of rank and its statistics as one JSON text. Matches must be cut to most a test before."""
    cut = matches.where(F.col("rank") <= most)
    listed = cut.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", *(c for c in cut.columns if c not in (key, "rank"))))).alias("top"))
    fields = [key, "top"]
    if stats is not None:
        listed = listed.join(stats.select(key, F.struct(*(c for c in stats.columns if c != key)).alias("stats")), key, "left")
        fields.append("stats")
    return listed.select(key, F.to_json(F.struct(*fields)).alias("document"))


def chat_lines(prompt: Column, response: Column | None = None, system: Column | None = None) -> Column:
    """A chat as JSON: the system message only if it isn't blank, the assistant's only if it is given."""
    said = lambda role, c: F.when(F.trim(c) != "", F.struct(F.lit(role).alias("role"), c.alias("content")))
    parts = ([said("system", system)] if system is not None else []) + [F.struct(F.lit("user").alias("role"), prompt.alias("content"))] + ([said("assistant", response)] if response is not None else [])
    return F.to_json(F.struct(F.filter(F.array(*parts), lambda m: m.isNotNull()).alias("messages")))


def exploded_documents(documents: DataFrame, document: str) -> DataFrame:
    """Rows of documents in either layout: an array of matches, or parallel arrays of ids and scores."""
    schema = "test_id string, top array<struct<rank int, score double, corpus_id string>>, ids array<string>, scores array<double>"
    parsed = documents.select(F.from_json(document, schema).alias("d")).select("d.*")
    zipped = F.transform(F.arrays_zip("ids", "scores"), lambda x, i: F.struct((i + 1).cast("int").alias("rank"), x["scores"].alias("score"), x["ids"].alias("corpus_id")))
    return parsed.select("test_id", F.explode(F.coalesce("top", zipped)).alias("m")).select("test_id", "m.rank", "m.score", "m.corpus_id")


def latex_rows(df: DataFrame, label: str, value: str, p: str, places: int = 3) -> DataFrame:
    """Table rows `label & value*** \\\\` with stars by significance."""
    from siltstone.operators.evaluation import significance_stars

    number = F.format_string(f"%.{places}f", F.col(value).cast("double"))
    return df.select(label, F.concat(F.col(label), F.lit(" & "), number, significance_stars(F.col(p)), F.lit(r" \\")).alias("line"))


def markdown_overview(df: DataFrame, dataset: str, original: str, variant: str, level: str, originals: int = 3, length: int = 500) -> DataFrame:
    """(dataset, line) of the first originals of each data set with their variants by level; texts are cut to length."""
    from pyspark.sql import Window

    w = Window.partitionBy(dataset).orderBy(original)
    kept = df.withColumn("__n", F.dense_rank().over(w)).where(F.col("__n") <= originals)
    line = F.concat(F.lit("- **"), F.col(level).cast("string"), F.lit("** "), F.substring(F.col(variant), 1, length))
    listed = kept.groupBy(dataset, "__n", original).agg(F.sort_array(F.collect_set(line)).alias("lines"))
    return listed.select(dataset, F.col("__n").alias("n"), F.concat(F.lit("### "), F.substring(F.col(original), 1, length), F.lit("\n"), F.array_join("lines", "\n")).alias("section"))
