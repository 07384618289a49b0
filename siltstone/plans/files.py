"""Queries through files: tables written in each format and read again, and shapes that records are written in."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import records
from siltstone.operators import annotation as ann
from siltstone.operators import vectors as vec
from siltstone.plans.annotations import pairs
from siltstone.plans.similarity import rounded, sides
from siltstone.runtime import scratch, table
from siltstone.sources import readers, writers

STAGES = ["dolma_web_000", "dolci_sft_000", "forum_qa_000", "dolma_code_000"]
TEMPLATE = "Task {task} of {model}:\n{prompt}\n\nAnswer {nothing}{"


def json_lines_round_trip(spark, sf_dir):
    """Documents as compressed JSON lines, found again by their endings, and parsed line by line."""
    folder = scratch(spark)
    writers.write_json_lines(table(spark, sf_dir, "documents", "doc_id", "text"), folder, compression="gzip", verify=True)
    lines = readers.read_lines(spark, readers.find_files(spark, folder, (".json.gz",)))
    return readers.parse_lines(lines, "doc_id long, text string").select("doc_id", F.md5("text").alias("hash"))


def csv_round_trip(spark, sf_dir):
    """Items as fully quoted CSV with line ends in their texts."""
    folder = scratch(spark)
    writers.write_report(table(spark, sf_dir, "benchmark_item", "test_id", "benchmark", "text"), folder, ["benchmark", "test_id"])
    return readers.read_csv(spark, folder).select("test_id", F.md5("text").alias("hash"))


def vectors_round_trip(spark, sf_dir):
    """Vectors as Parquet, columns found by their aliases, the dimension inferred and checked."""
    folder = scratch(spark)
    writers.write_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "chunk_id"), folder)
    stored = readers.read_documents(spark, folder)
    read = readers.read_vectors(stored, readers.dimension(stored, "embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read.select("id", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


def split_round_trip(spark, sf_dir):
    """Documents by a flag; a reader of one side reads that side's files only."""
    folder = scratch(spark)
    writers.write_split(table(spark, sf_dir, "documents", "doc_id", "content_type", "n_chars").withColumn("flag", F.coalesce(F.col("n_chars") < 500, F.lit(True))), "flag", folder)
    return spark.read.parquet(folder).where("flag = 'true'").groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


def appended_rows(spark, sf_dir):
    folder = scratch(spark)
    rows = table(spark, sf_dir, "documents", "doc_id", "lang")
    for part in (rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")):
        writers.append_rows(part, folder)
    found, missing = readers.read_many(spark, [folder, f"{folder}-none"])
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).withColumn("missing", F.lit(len(missing)))


def resumed_rows(spark, sf_dir):
    """What is left of a file behind its first ten rows."""
    folder = scratch(spark)
    table(spark, sf_dir, "nation", "n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey").write.parquet(folder)
    name = readers.find_files(spark, folder, (".parquet",))[0].rsplit("/", 1)[-1]
    return readers.rows_from(spark, folder, name, 10).select("n_nationkey", "n_name")


def regenerated_matches(spark, sf_dir):
    """The matches of each test written as one JSON document, and made rows again."""
    tests, corpus = sides(spark, sf_dir)
    best = vec.top_matches(tests, corpus, k=5).select("test_id", "rank", "score", "corpus_id")
    return writers.exploded_documents(writers.matches_document(best, "test_id"), "document").select("test_id", "rank", "score", "corpus_id")


def long_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "code_answer", "prompt", "claude_code", "gold_code").select("prompt", F.col("claude_code").alias("v_answer"), F.col("gold_code").alias("v_gold"))
    return readers.long_variants(rows, "prompt", "v_").groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text").cast("long")).alias("characters"))


def evaluation_layout(spark, sf_dir):
    """Trials in a folder a checkpoint, read as rates."""
    folder = scratch(spark)
    rows = table(spark, sf_dir, "events", "event_type", "user_id", "value").select("event_type", F.col("user_id").alias("sample_id"), F.lit("clean").alias("test_split"), (F.col("value") > 50).cast("int").cast("string").alias("correct"))
    rows.write.partitionBy("event_type").option("header", "true").csv(folder)
    return rounded(readers.read_evaluation(spark, folder)).withColumn("checkpoint", F.replace("checkpoint", F.lit("event_type="), F.lit("")))


def newest_runs(spark, sf_dir):
    return readers.newest_run(table(spark, sf_dir, "raw_record", "dataset_short_name", "created_at"), "dataset_short_name", "created_at")


def chat_turns(spark, sf_dir):
    """Prompts and answers as chat lines, with a fenced answer in LF line ends."""
    rows = table(spark, sf_dir, "code_answer", "answer_id", "prompt", "gold_code").where("gold_code is not null")
    line = writers.chat_lines(F.col("prompt"), records.fenced_answer(F.col("gold_code")), F.lit(" "))
    said = lambda i, name: F.get_json_object("line", f"$.messages[{i}].{name}")
    return rows.select("answer_id", line.alias("line")).select("answer_id", said(0, "role").alias("first"), F.md5(said(0, "content")).alias("prompt_hash"), F.md5(said(1, "content")).alias("answer_hash"), said(2, "role").alias("third"))


def filled_prompts(spark, sf_dir):
    rows = table(spark, sf_dir, "code_answer", "answer_id", "task_id", "model", "prompt")
    made = records.filled_template(TEMPLATE, {"task": F.col("task_id"), "model": F.col("model"), "prompt": F.col("prompt")})
    choices = records.lettered_choices(F.array(F.lit("one"), F.lit("two")))
    return rows.select("answer_id", F.md5(made).alias("hash"), choices.alias("choices"))


def stages_in_order(spark, sf_dir):
    """Rates of the listed stages with their places in the list."""
    rows = ann.of_stages(pairs(spark, sf_dir), "stage", STAGES)
    return rounded(rows.groupBy("stage_order", "stage").agg(F.count(F.lit(1)).alias("n"), F.avg(ann.one("dup")).alias("rate")))


def grids_in_order(spark, sf_dir):
    a, b = records.grid_size(F.col("test_id"))
    rows = table(spark, sf_dir, "benchmark_item", "test_id").select("test_id", ann.grid_complexity(a, b).alias("cells"))
    return rows.where("cells > 0").orderBy("cells", "test_id").limit(50)


_P = "WITH p AS (SELECT lower(trim(dataset)) AS stage, is_sd AS dup FROM annotation WHERE is_sd IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) "
_LIST = "[" + ", ".join(f"'{s}'" for s in STAGES) + "]"
_BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE = {
    "json_lines_round_trip": "SELECT doc_id, md5(text) AS hash FROM documents",
    "csv_round_trip": "SELECT test_id, md5(text) AS hash FROM benchmark_item",
    "vectors_round_trip": "SELECT vec_id::VARCHAR AS id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "split_round_trip": "SELECT content_type, count(*) AS n FROM documents WHERE coalesce(n_chars < 500, true) GROUP BY 1",
    "appended_rows": "SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(1 AS INTEGER) AS missing FROM documents GROUP BY 1",
    "resumed_rows": "SELECT n_nationkey, n_name FROM nation ORDER BY 1 OFFSET 10",
    "regenerated_matches": """
WITH t AS (SELECT vec_id AS test_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 10 = 0), c AS (SELECT vec_id AS corpus_id, embedding::DOUBLE[] AS b FROM embeddings WHERE vec_id % 10 <> 0),
s AS (SELECT test_id, corpus_id, round(list_cosine_similarity(a, b), 6) AS score FROM t, c)
SELECT test_id::VARCHAR AS test_id, CAST(row_number() OVER (PARTITION BY test_id ORDER BY score DESC, corpus_id) AS INTEGER) AS rank, score, corpus_id::VARCHAR AS corpus_id FROM s
QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY score DESC, corpus_id) <= 5""",
    "long_variants": "SELECT variant, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS characters FROM (SELECT prompt, 'v_answer' AS variant, claude_code AS t FROM code_answer UNION ALL SELECT prompt, 'v_gold', gold_code FROM code_answer) WHERE trim(coalesce(prompt, '')) <> '' AND trim(coalesce(t, '')) <> '' GROUP BY 1",
    "evaluation_layout": "SELECT event_type AS checkpoint, user_id AS sample_id, round(avg((value > 50)::INT), 6) AS pass_rate, count(*) AS n_samples FROM events GROUP BY 1, 2",
    "newest_runs": "SELECT dataset_short_name, max(created_at) AS created_at FROM raw_record WHERE created_at IS NOT NULL GROUP BY 1",
    "chat_turns": rf"SELECT answer_id, 'user' AS first, md5(prompt) AS prompt_hash, md5('```python' || chr(10) || regexp_replace(regexp_replace(gold_code, '\r\n?', chr(10), 'g'), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g') || chr(10) || '```') AS answer_hash, NULL::VARCHAR AS third FROM code_answer WHERE gold_code IS NOT NULL",
    "filled_prompts": "SELECT answer_id, md5('Task ' || coalesce(task_id::VARCHAR, '') || ' of ' || coalesce(model, '') || ':' || chr(10) || coalesce(prompt, '') || chr(10) || chr(10) || 'Answer {nothing}{') AS hash, 'A. one' || chr(10) || 'B. two' AS choices FROM code_answer",
    "stages_in_order": _P + f"SELECT CAST(list_position({_LIST}, stage) AS INTEGER) AS stage_order, stage, count(*) AS n, round(avg(dup::INT), 6) AS rate FROM p WHERE list_contains({_LIST}, stage) GROUP BY 1, 2",
    "grids_in_order": r"SELECT test_id, CAST(regexp_extract(test_id, '(\d+)x(\d+)', 1) AS INTEGER) * CAST(regexp_extract(test_id, '(\d+)x(\d+)', 2) AS INTEGER) AS cells FROM benchmark_item WHERE regexp_matches(test_id, '\d+x\d+') ORDER BY 2, 1 LIMIT 50",
}
QUERIES = {name: globals()[name] for name in ORACLE}
