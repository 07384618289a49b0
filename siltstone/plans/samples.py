"""Queries of samples, splits, mixes and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import joins, ranking, sampling
from siltstone.operators.distribution import seeded_order
from siltstone.plans.annotations import pairs
from siltstone.plans.similarity import rounded
from siltstone.plans.texts import source_of
from siltstone.runtime import spread, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "source", "lang", "content_type").withColumn("source", source_of())


def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(docs(spark, sf_dir), "doc_id", 50, 1).select("doc_id")


def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(docs(spark, sf_dir), "source", "doc_id", share=0.1, seed=2).select("doc_id", "source")


def per_group_sample(spark, sf_dir):
    return sampling.per_group_sample(pairs(spark, sf_dir), ["test_id", "stage"], "annotation_id", 2, 3).select("annotation_id")


def weighted_sample(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("weight", F.col("score") * F.col("score"))
    return sampling.weighted_sample(rows, ["stage"], "annotation_id", "weight", 20, 4).select("annotation_id")


def balanced_quota_sample(spark, sf_dir):
    kinds = ["exact", "equivalent", "subset", "superset", "related", "unrelated"]
    return sampling.balanced_sample(pairs(spark, sf_dir), "kind", "annotation_id", 100, kinds, 5).select("annotation_id", "kind")


def replicated_sample(spark, sf_dir):
    return sampling.replicated_sample(docs(spark, sf_dir), "source", "doc_id", 30, 6).select("doc_id", F.col("copy").cast("bigint").alias("copy"))


def train_val_split(spark, sf_dir):
    return sampling.train_val_split(pairs(spark, sf_dir), "dup", "annotation_id", seed=7).select("annotation_id", "part")


def class_ratio_downsample(spark, sf_dir):
    return sampling.class_ratio_downsample(pairs(spark, sf_dir), "dup", "annotation_id", 0.5, 8).select("annotation_id")


def half_split(spark, sf_dir):
    return sampling.half_split(pairs(spark, sf_dir), "test_id", 125)


def interleave_mix(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return sampling.interleaved(rows.where("content_type = 'math'"), rows.where("content_type = 'prose'"), "doc_id", 2, 9)


def exact_copies(spark, sf_dir):
    rows = table(spark, sf_dir, "code_answer", "answer_id", "task_id", "tests_passed")
    return sampling.exact_copies(rows.withColumn("ok", F.coalesce("tests_passed", F.lit(False))), "task_id", "ok", "answer_id", 3).select("task_id", "answer_id", "copy")


def replace_slots(spark, sf_dir):
    rows = docs(spark, sf_dir).select(F.col("doc_id").alias("position"), F.col("source").alias("value"))
    new = sampling.uniform_sample(rows, "position", 100, 10).select("position", F.concat(F.lit("injected_"), F.col("position").cast("string")).alias("value"))
    return joins.replaced_slots(rows, new, "position", ["value"])


def pick_until_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
    return ranking.pick_until_budget(rows, "doc_id", "bytes", 200_000).select("doc_id", "start")


def file_offsets(spark, sf_dir):
    rows = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))
    return ranking.running_offsets(rows, "source", "rows").select("source", "rows", "start")


def range_file_lookup(spark, sf_dir):
    files = ranking.running_offsets(docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("rows")), "source", "rows")
    ranges = files.select("source", "start", (F.col("start") + F.col("rows")).alias("end"))
    points = table(spark, sf_dir, "documents", "doc_id").select((F.col("doc_id") - 1).alias("point"))
    return joins.range_lookup(points, ranges, "point", "start", "end").select("point", "source")


def lookup_with_not_found(spark, sf_dir):
    """Corpus texts of all rows, and of keys that no row has."""
    rows = table(spark, sf_dir, "annotation", "annotation_id", "corpus_id", "score")
    asked = rows.select("annotation_id", F.when(F.col("score").isNull(), F.concat("corpus_id", F.lit("?"))).otherwise(F.col("corpus_id")).alias("corpus_id"))
    texts = table(spark, sf_dir, "annotation", "annotation_id", "corpus_id", "corpus_text").where("corpus_text is not null").withColumnRenamed("annotation_id", "at")
    got = joins.hydrate(asked, texts, "corpus_id", "corpus_text", "at", "[NOT FOUND]")
    return got.select("annotation_id", F.md5("corpus_text").alias("hash"))


def hydrate_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "annotation_id", "test_id", "score")
    items = table(spark, sf_dir, "benchmark_item", "test_id", "text", "rating", "global_idx")
    return joins.hydrate(rows, items, "test_id", "rating", "global_idx").select("annotation_id", "rating")


def first_split_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "code_answer", "answer_id", "task_id", "model")
    return joins.first_by_priority(rows, "task_id", "model", ["model_b", "model_a"], "answer_id").select("task_id", "model", "answer_id")


def rows_with_tests(spark, sf_dir):
    rows = table(spark, sf_dir, "code_answer", "answer_id", "task_id", "tests_passed")
    passed = rows.where("tests_passed").select("task_id")
    return joins.with_tests(rows, passed, "task_id", "keep").select("answer_id", "has_tests")


def metric_comparison(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    early = rows.where("o_orderdate < '1995-01-01'").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    late = rows.where("o_orderdate >= '1995-01-01'").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    return rounded(joins.metric_comparison(early, late, "o_orderpriority", "v"), places=4)


def minhash_decontaminate(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "corpus_id", "corpus_text").where("corpus_text is not null").dropDuplicates(["corpus_id"])
    items = table(spark, sf_dir, "benchmark_item", "text").withColumnRenamed("text", "corpus_text")
    return joins.minhash_decontaminated(rows, items, "corpus_id", "corpus_text").select("corpus_id")


def minhash_signatures(spark, sf_dir):
    """Signatures of 128 values of all corpus texts, as a digest of their values."""
    rows = spread(table(spark, sf_dir, "annotation", "annotation_id", "corpus_text").where("corpus_text is not null"))
    signed = rows.select("annotation_id", joins.minhash(F.col("corpus_text"), 128).alias("s")).where("s is not null")
    return signed.select("annotation_id", F.md5(F.array_join(F.col("s").cast("array<string>"), ",")).alias("digest"))


def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "documents", "doc_id", "lang").select(F.col("doc_id").alias("id"), "lang")
    b = table(spark, sf_dir, "raw_record", "record_id", "mode").select(F.col("record_id").alias("id"), "mode")
    return a.unionByName(b, allowMissingColumns=True).groupBy("lang", "mode").agg(F.count(F.lit(1)).alias("n"))


def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "annotation", "test_id", "is_sd").where("is_sd").select("test_id")
    b = table(spark, sf_dir, "benchmark_item", "test_id")
    out = a.intersect(b).withColumn("op", F.lit("intersect"))
    return out.union(b.subtract(a).withColumn("op", F.lit("except"))).union(a.union(b).distinct().withColumn("op", F.lit("union")))


def md5_order(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id").orderBy(seeded_order("order", "doc_id"), "doc_id").limit(100)


def multi_key_sort(spark, sf_dir):
    return pairs(spark, sf_dir).orderBy("test_id", F.col("score").desc(), "annotation_id").limit(200).select("test_id", "score", "annotation_id")


def _o(seed, item):
    return f"md5(concat_ws(':', '{seed}', {item}::VARCHAR)), {item}"


_D = "WITH d AS (SELECT doc_id, coalesce(replace(lower(trim(source)), '-', '_'), 'unknown') AS source, content_type FROM documents) "
_P = "WITH p AS (SELECT annotation_id, lower(trim(dataset)) AS stage, test_id, score, is_sd AS dup, lower(trim(match_type)) AS kind FROM annotation WHERE is_sd IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) "
_SP = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PERM = ", ".join(f"{{'a': {a}, 'b': {b}}}" for a, b in joins.permutations(128))
_RUNS = "list_distinct([substr(t, i, 3) FOR i IN range(1, length(t) - 1)])"
_GRAM = r"[CAST(('0x' || substr(md5(g), 1, 7)) AS BIGINT) FOR g IN list_distinct([substr(t, i, 3) FOR i IN range(1, length(t) - 1)])]"

ORACLE = {
    "uniform_sample": f"SELECT doc_id FROM documents ORDER BY {_o(1, 'doc_id')} LIMIT 50",
    "stratified_sample": _D + f", q AS (SELECT source, floor(floor((SELECT count(*) FROM d) * 0.1::DOUBLE) * count(*) / (SELECT count(*) FROM d)) AS quota FROM d GROUP BY 1), r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY {_o(2, 'doc_id')}) AS k FROM d) SELECT doc_id, source FROM r JOIN q USING (source) WHERE k <= quota",
    "per_group_sample": _P + f"SELECT annotation_id FROM (SELECT *, row_number() OVER (PARTITION BY test_id, stage ORDER BY {_o(3, 'annotation_id')}) AS k FROM p) WHERE k <= 2",
    "weighted_sample": _P + ", u AS (SELECT *, (CAST('0x' || substr(md5(concat_ws(':', '4', annotation_id::VARCHAR)), 1, 7) AS BIGINT) + 1) / 268435457.0::DOUBLE AS u FROM p), k AS (SELECT *, CASE WHEN score * score > 0 THEN round(ln(u) / (score * score), 9) ELSE -1e300 END AS key FROM u) SELECT annotation_id FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY key DESC, annotation_id) AS n FROM k) WHERE n <= 20",
    "balanced_quota_sample": _P + f", r AS (SELECT annotation_id, kind, row_number() OVER (PARTITION BY kind ORDER BY {_o(5, 'annotation_id')}) AS k FROM p) SELECT annotation_id, kind FROM r WHERE k <= 16 + CASE WHEN kind IN ('exact', 'equivalent', 'subset', 'superset') THEN 1 ELSE 0 END",
    "replicated_sample": _D + f", r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_o(6, 'doc_id')}) AS k, least(30, count(*) OVER (PARTITION BY source)) AS n FROM d) SELECT doc_id, unnest(range(1, CAST((30 - k) // n + 2 AS BIGINT))) AS copy FROM r WHERE k <= 30",
    "train_val_split": _P + f", n AS (SELECT count_if(dup) AS p1, count_if(NOT dup) AS q FROM p), v AS (SELECT *, CASE WHEN p1 > 0 THEN greatest(1, floor(p1 * 0.2::DOUBLE)) ELSE 0 END AS vf FROM n), w AS (SELECT *, least(vf * 3, floor(q / 5)) AS vo, (p1 - vf) * 10 AS tr FROM v), r AS (SELECT annotation_id, dup, row_number() OVER (PARTITION BY dup ORDER BY {_o(7, 'annotation_id')}) AS k FROM p) SELECT annotation_id, CASE WHEN dup THEN CASE WHEN k <= vf THEN 'val' ELSE 'train' END WHEN k <= vo THEN 'val' WHEN k <= vo + tr THEN 'train' ELSE 'unused' END AS part FROM r, w",
    "class_ratio_downsample": _P + f", n AS (SELECT floor(count_if(dup) * 0.5::DOUBLE) AS most FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY dup ORDER BY {_o(8, 'annotation_id')}) AS k FROM p) SELECT annotation_id FROM r, n WHERE dup OR k <= most",
    "half_split": _P + f", t AS (SELECT DISTINCT test_id FROM p), r AS (SELECT test_id, row_number() OVER (ORDER BY {_o(66, 'test_id')}) AS k FROM t) SELECT test_id, CASE WHEN k <= 125 THEN 'first' ELSE 'second' END AS half FROM r",
    "interleave_mix": _D + f", f AS (SELECT 'few' AS part, doc_id FROM d WHERE content_type = 'math'), m AS (SELECT 'many' AS part, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_o(9, 'doc_id')}) AS k FROM d WHERE content_type = 'prose') WHERE k <= 2 * (SELECT count(*) FROM f)) SELECT part, doc_id, md5(concat_ws(':', '10', part, doc_id::VARCHAR)) AS order FROM (FROM f UNION ALL FROM m)".replace("AS order FROM", 'AS "order" FROM'),
    "exact_copies": "WITH o AS (SELECT task_id, arg_min(answer_id, {'a': CASE WHEN tests_passed THEN 0 ELSE 1 END, 'b': answer_id}) AS answer_id FROM code_answer GROUP BY 1) SELECT task_id, answer_id, CAST(unnest([1, 2, 3]) AS INTEGER) AS copy FROM o",
    "replace_slots": _D + f", c AS (SELECT doc_id FROM d ORDER BY {_o(10, 'doc_id')} LIMIT 100) SELECT d.doc_id AS position, CASE WHEN c.doc_id IS NOT NULL THEN 'injected_' || d.doc_id ELSE source END AS value, c.doc_id IS NOT NULL AS replaced FROM d LEFT JOIN c ON c.doc_id = d.doc_id",
    "pick_until_budget": "WITH s AS (SELECT doc_id, coalesce(sum(coalesce(strlen(text), 0)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM documents) SELECT doc_id, CAST(start AS BIGINT) AS start FROM s WHERE start < 200000",
    "file_offsets": _D + ", g AS (SELECT source, count(*) AS rows FROM d GROUP BY 1) SELECT source, rows, CAST(coalesce(sum(rows) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g",
    "range_file_lookup": _D + ", g AS (SELECT source, count(*) AS n FROM d GROUP BY 1), f AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, n FROM g) SELECT doc_id - 1 AS point, source FROM documents JOIN f ON doc_id - 1 >= a AND doc_id - 1 < a + n".replace("SELECT doc_id - 1 AS point, source FROM documents JOIN f", "SELECT x.doc_id - 1 AS point, f.source FROM documents x JOIN f").replace("ON doc_id - 1 >= a AND doc_id - 1", "ON x.doc_id - 1 >= a AND x.doc_id - 1"),
    "lookup_with_not_found": "WITH t AS (SELECT corpus_id, arg_max(corpus_text, annotation_id) AS t FROM annotation WHERE corpus_text IS NOT NULL GROUP BY 1) SELECT annotation_id, md5(CASE WHEN score IS NULL THEN '[NOT FOUND]' ELSE coalesce(t, '[NOT FOUND]') END) AS hash FROM annotation LEFT JOIN t USING (corpus_id)",
    "hydrate_matches": "SELECT annotation_id, rating FROM annotation a LEFT JOIN benchmark_item b ON b.test_id = a.test_id",
    "first_split_lookup": "SELECT task_id, arg_min(model, {'a': CASE model WHEN 'model_b' THEN 1 ELSE 2 END, 'b': answer_id}) AS model, arg_min(answer_id, {'a': CASE model WHEN 'model_b' THEN 1 ELSE 2 END, 'b': answer_id}) AS answer_id FROM code_answer WHERE model IN ('model_a', 'model_b') GROUP BY 1",
    "rows_with_tests": "SELECT answer_id, coalesce(task_id IN (SELECT task_id FROM code_answer WHERE tests_passed AND task_id IS NOT NULL), false) AS has_tests FROM code_answer",
    "metric_comparison": "WITH a AS (SELECT o_orderpriority, avg(o_totalprice) AS base FROM orders WHERE o_orderdate < '1995-01-01' GROUP BY 1), b AS (SELECT o_orderpriority, avg(o_totalprice) AS tuned FROM orders WHERE o_orderdate >= '1995-01-01' GROUP BY 1) SELECT o_orderpriority, round(base, 4) AS base, round(tuned, 4) AS tuned, round(tuned - base, 4) AS diff, round(CASE WHEN base = 0 THEN 0 ELSE 100 * (tuned - base) / base END, 4) AS pct FROM a FULL JOIN b USING (o_orderpriority)",
    "minhash_signatures": rf"WITH n AS (SELECT annotation_id, trim(regexp_replace(lower(corpus_text), '[{_SP}]+', ' ', 'g')) AS t FROM annotation WHERE corpus_text IS NOT NULL), c AS (SELECT annotation_id, {_GRAM} AS c FROM n WHERE length(t) >= 3) SELECT annotation_id, md5(array_to_string([list_min([(x * p.a + p.b) % {joins.PRIME} FOR x IN c]) FOR p IN [{_PERM}]], ',')) AS digest FROM c",
    "minhash_decontaminate": rf"WITH n AS (SELECT 'c' || corpus_id AS id, trim(regexp_replace(lower(max(corpus_text)), '[{_SP}]+', ' ', 'g')) AS t FROM annotation WHERE corpus_text IS NOT NULL GROUP BY corpus_id UNION ALL SELECT 'i' || test_id, trim(regexp_replace(lower(text), '[{_SP}]+', ' ', 'g')) FROM benchmark_item), g AS MATERIALIZED (SELECT id, unnest({_RUNS}) AS g FROM n WHERE length(t) >= 3), z AS (SELECT id, count(*) AS n FROM g GROUP BY 1), k AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g WHERE x.id[1] = 'c' AND y.id[1] = 'i' GROUP BY 1, 2), hit AS (SELECT a FROM k JOIN z p ON p.id = a JOIN z q ON q.id = b WHERE k / (p.n + q.n - k)::DOUBLE >= 0.8) SELECT substr(id, 2) AS corpus_id FROM n WHERE id[1] = 'c' AND id NOT IN (FROM hit)",
    "union_by_name": "SELECT lang, mode, count(*) AS n FROM (SELECT doc_id AS id, lang, NULL AS mode FROM documents UNION ALL SELECT record_id, NULL, mode FROM raw_record) GROUP BY ALL",
    "set_operations": "WITH a AS (SELECT DISTINCT test_id FROM annotation WHERE is_sd), b AS (SELECT DISTINCT test_id FROM benchmark_item) SELECT test_id, 'intersect' AS op FROM (FROM a INTERSECT FROM b) UNION ALL SELECT test_id, 'except' FROM (FROM b EXCEPT FROM a) UNION ALL SELECT test_id, 'union' FROM (FROM a UNION FROM b)",
    "md5_order": f"SELECT doc_id FROM documents ORDER BY {_o('order', 'doc_id')} LIMIT 100",
    "multi_key_sort": _P + "SELECT test_id, score, annotation_id FROM p ORDER BY test_id, score DESC, annotation_id LIMIT 200",
}
UNCHECKED: list[str] = []
QUERIES = {name: globals()[name] for name in [*ORACLE, *UNCHECKED]}
