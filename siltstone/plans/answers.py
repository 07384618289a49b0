"""Queries on what is read out of stored prompts and model answers, built from table rows so that SQL knows the outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.config import Preparation
from siltstone.functions import parsing, records
from siltstone.runtime import table
from siltstone.sources import writers


def stored_sections(spark, sf_dir):
    """Both sections of a stored prompt."""
    rows = table(spark, sf_dir, "code_answer", "answer_id", "prompt", "gold_code").where("gold_code is not null")
    stored = F.concat(F.lit("Compare.\n## Test Task (A):\n"), "prompt", F.lit("\n\n## Corpus Task:\n"), "gold_code", F.lit("\n## Question\nSame?"))
    test, corpus = records.prompt_sections(stored)
    return rows.select("answer_id", F.md5(test).alias("test_hash"), F.md5(corpus).alias("corpus_hash"))


def last_objects(spark, sf_dir):
    """The last whole object in an answer with several."""
    rows = table(spark, sf_dir, "code_answer", "answer_id", "task_id")
    said = F.concat(F.lit('First {"answer": 0}, no: {"answer": {"id":\n'), F.col("answer_id").cast("string"), F.lit(', "of": ['), F.col("task_id").cast("string"), F.lit("]}} and {unfinished"))
    return rows.select("answer_id", parsing.last_json_of(said).alias("object"))


def puzzle_answers(spark, sf_dir):
    """Houses of a solution, from JSON and from loose entries, renamed by a plan."""
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    house = F.concat(F.lit('"House 1": {"Name": "'), "n_name", F.lit('", "Pet": "cat"}'))
    said = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('So {"solution": {'), house, F.lit("}} it is"))).otherwise(F.concat(F.lit("I say "), house, F.lit(", no more")))
    got = rows.select("n_nationkey", parsing.puzzle_solution_of(said).alias("s"))
    renamed = parsing.substituted(F.col("s"), F.create_map(F.lit("pet"), F.lit("Animal"), F.lit("CAT"), F.lit("dog")))
    return got.select("n_nationkey", F.col("s")["House 1"]["Name"].alias("name"), renamed["House 1"]["Animal"].alias("animal"))


def shuffled_clues(spark, sf_dir):
    """A region's nations as numbered clues in seeded order."""
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey", "n_name")
    listed = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    clues = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["n_name"])), "\n")
    text = F.concat(F.lit("Puzzle.\n## Clues:\n"), clues, F.lit("\n\nGood luck."))
    return listed.select("n_regionkey", parsing.shuffled_clues_of(text, 3).alias("text"))


def latex_report(spark, sf_dir):
    """Table rows with significance marks."""
    rows = table(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice").groupBy("o_orderpriority").agg((F.avg("o_totalprice") / 1_000_000).alias("v"), (F.count(F.lit(1)) % 100 / 1000).alias("p"))
    return writers.latex_rows(rows, "o_orderpriority", "v", "p")


def parsed_records(spark, sf_dir):
    """Reinforcement records by the settings of the preparation."""
    rows = table(spark, sf_dir, "code_answer", "prompt", "gold_code").select("prompt", F.col("gold_code").alias("solution"))
    made = records.parsed_records(rows, Preparation(mode="rl"))
    return made.groupBy(F.md5("text").alias("hash"), "content_type").agg(F.count(F.lit(1)).alias("n"))


_BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE = {
    "stored_sections": rf"SELECT answer_id, md5(regexp_replace(prompt, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')) AS test_hash, md5(regexp_replace(gold_code, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')) AS corpus_hash FROM code_answer WHERE gold_code IS NOT NULL",
    "last_objects": """SELECT answer_id, '{"answer": {"id": ' || answer_id || ', "of": [' || task_id || ']}}' AS object FROM code_answer""",
    "puzzle_answers": "SELECT n_nationkey, n_name AS name, 'dog' AS animal FROM nation",
    "shuffled_clues": """
WITH c AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
o AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY md5('3:' || i || ':' || n_name), i) AS k FROM c)
SELECT n_regionkey, 'Puzzle.' || chr(10) || '## Clues:' || chr(10) || string_agg(k || '. ' || n_name, chr(10) ORDER BY k) || chr(10) || 'Good luck.' AS text FROM o GROUP BY 1""",
    "latex_report": r"""
WITH r AS (SELECT o_orderpriority, avg(o_totalprice) / 1000000 AS v, count(*) % 100 / 1000.0::DOUBLE AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, o_orderpriority || ' & ' || printf('%.3f', v) || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END || ' \\' AS line FROM r""",
    "parsed_records": "WITH t AS (SELECT 'Prompt: ' || prompt || CASE WHEN coalesce(gold_code, '') <> '' THEN chr(10) || chr(10) || 'Response: ' || gold_code ELSE '' END AS t FROM code_answer WHERE coalesce(prompt, '') <> '') SELECT md5(t) AS hash, 'conversation' AS content_type, count(*) AS n FROM t GROUP BY 1",
}
QUERIES = {name: globals()[name] for name in ORACLE}
