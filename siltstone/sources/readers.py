"""Readers: JSON lines, Parquet, CSV and text in the usual compressions, with columns found by their aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File endings that count as data, and names under which a column may be stored, the first first.
DATA_ENDINGS = (".jsonl", ".jsonl.zst", ".json.zst", ".zst", ".jsonl.gz", ".json.gz", ".parquet")
ALIASES = {
    "embedding": ("embedding", "embeddings", "vector", "emb"),
    "text": ("text", "content", "chunk", "body"),
    "id": ("id", "hash_id", "doc_id", "chunk_id"),
    "score": ("score", "similarity"),
    "dataset": ("dataset", "source"),
}
MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
CHUNK = T.StructType([T.StructField(n, T.IntegerType() if n == "token_size" else T.StringType()) for n in ("id", "text", "source", "token_size", "content_type", "category", "dpo_label")])


def find_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = DATA_ENDINGS) -> list[str]:
    """Data files under a folder, sorted; an error if the folder is missing or has none. Only names are listed."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    out, files = [], fs.listFiles(path, True)
    while files.hasNext():
        status = files.next()
        if status.isFile() and status.getPath().getName().endswith(endings):
            out.append(status.getPath().toString())
    if not out:
        raise FileNotFoundError(f"no data files in {folder}")
    return sorted(out)


def read_lines(spark: SparkSession, paths: str | list[str], skip_unreadable: bool = False) -> DataFrame:
    """(line, file) of text files in plain, gzip or zstandard form; bytes that aren't UTF-8 become replacement characters. With skip_unreadable a
    file that breaks off gives what could be read of it, and the others go on; files_without_lines tells those that gave nothing."""
    return spark.read.option("ignoreCorruptFiles", str(skip_unreadable).lower()).text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file"))


def files_without_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file) of the paths that can't be read or are empty."""
    listed = spark.createDataFrame([(p.rstrip("/").rsplit("/", 1)[-1],) for p in paths], "file string")
    return listed.join(read_lines(spark, paths, skip_unreadable=True).select("file").distinct(), "file", "left_anti")


def rows_from(spark: SparkSession, path: str, file: str, offset: int) -> DataFrame:
    """Parquet rows that are left after so many rows of a file were done: that file from the offset on, and the files behind it by name."""
    df = spark.read.parquet(path)
    name, place = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    return df.where((name > file) | ((name == file) & (place >= offset)))


def parse_lines(lines: DataFrame, schema: T.StructType | str, keep_bad: bool = False) -> DataFrame:
    """Lines as records; malformed ones are dropped, or kept with is_bad. Unlike a silent reader, counts can be taken first."""
    parsed = lines.withColumn("__r", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = ~F.trim("line").startswith("{") | F.col("__r").isNull() | F.expr("try_parse_json(line) is null")
    if keep_bad:
        return parsed.select("__r.*", "file", bad.alias("is_bad"))
    return parsed.where(~bad).select("__r.*", "file")


def read_json(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """JSON lines with a declared schema; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def read_documents(spark: SparkSession, folder: str, path_part: str | None = None, merge: bool = True) -> DataFrame:
    """Parquet under a folder, columns by name over all files; only paths with a part, if one is asked for."""
    reader = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", str(merge).lower()).option("pathGlobFilter", "*.parquet")
    df = reader.parquet(folder).withColumn("file", F.col("_metadata.file_path"))
    return df.where(F.contains("file", F.lit(path_part))) if path_part else df


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))


def aliased(df: DataFrame, name: str) -> Column | None:
    """The column that stands for a name, by exact name, then whatever its case."""
    lowered = {c.lower(): c for c in df.columns}
    return next((F.col(f"`{lowered[a]}`") for a in ALIASES.get(name, (name,)) if a in lowered), None)


def dimension(df: DataFrame, vector: str = "embedding") -> int | None:
    """The dimension of all vectors; an error where they differ; None where there is none."""
    least, most = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} numbers")
    return least


def read_vectors(df: DataFrame, dims: int | None = None) -> DataFrame:
    """(id, text, embedding) by aliases: id made from file and place where there is none; rows without a vector are dropped. With dims, a vector of another
    dimension is an error when it is read; dimension(df) infers it."""
    vector, text, key = aliased(df, "embedding"), aliased(df, "text"), aliased(df, "id")
    if vector is None:
        raise ValueError(f"no vector column among {df.columns}")
    made = F.concat(F.lit("emb_"), F.monotonically_increasing_id().cast("string"))
    return df.select((key.cast("string") if key is not None else made).alias("id"), (text if text is not None else F.lit(None).cast("string")).alias("text"), vector.cast("array<float>").alias("embedding")).where("embedding is not null").where(F.lit(True) if dims is None else F.coalesce(F.assert_true(F.size("embedding") == dims, F.lit(f"a vector hasn't {dims} numbers")).isNull(), F.lit(True)))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header and quoted texts over several lines. Without a schema all columns are strings."""
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').option("quote", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_files(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file, with ids from the file name cut at two underscores; names that begin with an underscore are skipped."""
    df = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "[!_]*.json").json(folder)
    parts = F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "__")
    return df.select("*", *(F.get(parts, i).alias(n) for i, n in enumerate(("file_dataset", "file_test_id", "file_corpus_id"))))


def json_file_errors(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """(file, record) of the documents that don't parse."""
    wide = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    df = spark.read.option("pathGlobFilter", "[!_]*.json").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("record"))
    return df.where(F.from_json("record", wide, {"columnNameOfCorruptRecord": "__bad"})["__bad"].isNotNull())


def long_variants(df: DataFrame, original: str, prefix: str) -> DataFrame:
    """(original, variant, text) of each column whose name has the prefix; blank originals and blank texts are left out."""
    names = [c for c in df.columns if c.startswith(prefix)]
    made = F.array(*(F.struct(F.lit(c).alias("variant"), F.col(f"`{c}`").alias("text")) for c in names))
    out = df.where(F.trim(F.coalesce(F.col(original), F.lit(""))) != "").select(F.col(original).alias("original"), F.explode(made).alias("v"))
    return out.select("original", "v.variant", "v.text").where(F.trim(F.coalesce("text", F.lit(""))) != "")


def newest_run(runs: DataFrame, label: str, stamp: str) -> DataFrame:
    """Of each label the run with the latest stamp."""
    from siltstone.operators.dedup import keep_first

    return keep_first(runs.where(F.col(stamp).isNotNull()), [label], [F.expr(f"-unix_micros(cast(`{stamp}` as timestamp))")])


def read_many(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """Parquet of all paths that exist, columns by name, and the paths that don't."""
    jvm = spark._jvm

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    found = [p for p in paths if there(p)]
    df = spark.read.option("mergeSchema", "true").parquet(*found) if found else None
    return df, [p for p in paths if p not in found]


class Registry:
    """Loaders of data sets under names, each a function (spark) -> DataFrame."""

    def __init__(self) -> None:
        self.loaders: dict = {}

    def add(self, name: str, loader) -> None:
        if name in self.loaders:
            raise ValueError(f"{name} is registered")
        self.loaders[name] = loader

    def add_union(self, name: str, parts: list[str]) -> None:
        """A data set of others, by name, with the part's name as column task."""

        def load(spark: SparkSession) -> DataFrame:
            frames = [self.load(spark, p).withColumn("task", F.lit(p)) for p in parts]
            out = frames[0]
            for frame in frames[1:]:
                out = out.unionByName(frame, allowMissingColumns=True)
            return out

        self.add(name, load)

    def load(self, spark: SparkSession, name: str, limit: int | None = None) -> DataFrame:
        if name not in self.loaders:
            raise KeyError(f"unknown data set {name}; known: {sorted(self.loaders)}")
        df = self.loaders[name](spark)
        return df.limit(limit) if limit is not None else df


# Names of the public data sets that are known, and the tasks of the one that is a union.
DATASETS = ("gsm8k", "codeforces", "allenai", "mbpp", "humaneval", "popqa", "zebralogic", "agieval")
UNION_NAME, UNION_TASKS = "bigbenchhard", ("boolean_expressions", "causal_judgement", "date_understanding", "logical_deduction_three_objects", "word_sorting")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder of Parquet or JSON lines, by its name or what it holds."""
    names = [path] if path.endswith(DATA_ENDINGS) else find_files(spark, path)
    return spark.read.parquet(*names) if names[0].endswith(".parquet") else spark.read.json(names)


def folder_registry(root: str, files: dict[str, str] | None = None) -> Registry:
    """The known data sets as local copies: a folder a name under root, or a path of its own in files; a union's tasks are folders under its name."""
    files, registry = files or {}, Registry()
    for name in (*DATASETS, *(f"{UNION_NAME}/{t}" for t in UNION_TASKS)):
        registry.add(name.rsplit("/", 1)[-1], lambda spark, path=files.get(name, f"{root}/{name}"): read_any(spark, path))
    registry.add_union(UNION_NAME, list(UNION_TASKS))
    return registry


TRIALS = "sample_id long, test_split string, correct string"
RATES = "epoch string, checkpoint string, sample_id long, pass_rate double, n_correct int, n_samples int"


def read_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """(checkpoint, sample_id, pass_rate, n_samples) of a run in either layout: one file of rates, or a folder a checkpoint with a row a trial."""
    names = [p.rsplit("/", 1)[1] for p in find_files(spark, folder, (".csv",))]
    if any(n.startswith("pass_rates") for n in names):
        rates = spark.read.option("header", "true").schema(RATES).option("pathGlobFilter", "pass_rates*.csv").csv(folder)
        return rates.select("checkpoint", "sample_id", "pass_rate", F.col("n_samples").cast("long").alias("n_samples"))
    trials = spark.read.option("header", "true").schema(TRIALS).option("recursiveFileLookup", "true").csv(folder)
    named = trials.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("checkpoint"), "sample_id", (F.col("correct") == "1").alias("ok"))
    return named.groupBy("checkpoint", "sample_id").agg(F.avg(F.col("ok").cast("double")).alias("pass_rate"), F.count(F.lit(1)).alias("n_samples"))
