"""The pN_ queries: each problem's operator with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import bpe, consensus, leak, lookalike, mixing, neardup, pairs, split, topn
from siltstone.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotation", "dataset", "test_id", "corpus_id", "score").withColumn("dataset", topn.clean_key("dataset"))
    return topn.top_n_per_group(rows, ["dataset", "test_id"], "corpus_id", "score", 10).select("dataset", "test_id", "corpus_id")


def p1_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotation", "dataset", "test_id", "corpus_id", "score").withColumn("dataset", topn.clean_key("dataset"))
    return topn.top_n_per_group(rows, ["dataset", "test_id"], "corpus_id", "score", 10)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("pieces > 1 and piece = 0").select("record_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "raw_record", "record_id", "text", "dataset_short_name", "mode")
    return split.split_oversized(records, table(spark, sf_dir, "chunking_config"), "record_id", "text", "dataset_short_name", "mode")


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record put together again from its pieces without what they share, with its tokens and whether all pieces keep to the limit and the overlap."""
    config = table(spark, sf_dir, "chunking_config")
    mode = F.lower(F.trim("mode"))
    records = table(spark, sf_dir, "raw_record", "record_id", "dataset_short_name", "mode").withColumn("mode", F.when(mode.isNull() | (mode == ""), "paragraph").otherwise(mode))
    limits = records.join(config.select("dataset_short_name", "mode", "max_tokens", "overlap_tokens"), ["dataset_short_name", "mode"]).select("record_id", "max_tokens", "overlap_tokens")
    before = Window.partitionBy("record_id").orderBy("piece")
    pieces = p2_pieces(spark, sf_dir).join(limits, "record_id")
    shared = F.coalesce(F.lag("end").over(before) - F.col("start"), F.lit(0))
    pieces = pieces.withColumn("shared", shared)
    pieces = pieces.withColumn("twice", split.token_count(F.substring(F.col("text"), F.lit(1), F.col("shared").cast("int")))).withColumn("rest", F.substring(F.col("text"), F.col("shared").cast("int") + 1, F.char_length("text")))
    sound = (F.col("n_tokens") <= F.col("max_tokens")) & ((F.col("piece") == 0) | (F.col("twice") == F.least("overlap_tokens", F.col("max_tokens") - 1)))
    whole = pieces.groupBy("record_id").agg(F.sum(F.col("n_tokens") - F.col("twice")).alias("n_tokens"), F.bool_and(sound).alias("sound"), F.array_sort(F.collect_list(F.struct("piece", "rest"))).alias("parts"), F.count("text").alias("texts"))
    text = F.when(F.col("texts") > 0, F.md5(F.array_join(F.col("parts.rest"), "")))
    return whole.select("record_id", "n_tokens", "sound", text.alias("text_hash"))


def verdict_consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    annotation = table(spark, sf_dir, "annotation", "annotation_id", "pair_id", "is_sd", "checker_is_sd")
    rater_label = table(spark, sf_dir, "rater_label", "label_id", "pair_id", "rater_id", "is_sd", "match_type", "error", "labelled_at")
    return consensus.consensus(consensus.pair_verdicts(annotation, rater_label), "pair_id", "annotator", "label")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "rater_label", "pair_id").distinct()
    decided = verdict_consensus(spark, sf_dir).items.where("n >= 3 and label = 'duplicate'").withColumnRenamed("item", "pair_id")
    return decided.join(rated, "pair_id", "left_semi").select("pair_id")


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_consensus(spark, sf_dir).items.select(F.col("item").alias("pair_id"), "label", "n", F.round("agreement", 6).alias("agreement"), F.round("posterior", 6).alias("posterior"))


def p3_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_consensus(spark, sf_dir).annotators.select("annotator", "n", F.round("accuracy", 4).alias("accuracy"))


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_consensus(spark, sf_dir).agreement.select("items", "verdicts", *(F.round(c, 9).alias(c) for c in ("observed", "expected", "alpha")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, sf_dir, "code_answer", "answer_id", "prompt", "claude_code"), "answer_id", "prompt", "claude_code", labelled=table(spark, sf_dir, "documents", "text", "lang"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    config = table(spark, sf_dir, "dedup_config").orderBy("config_name").first()
    texts = table(spark, sf_dir, "annotation", "corpus_id", "corpus_text")
    return neardup.NearDuplicates(texts, "corpus_id", "corpus_text", config["minhash_threshold"], config["minhash_ngram"], config["minhash_num_perm"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, sf_dir).pairs("corpus_id").select("corpus_id_a", "corpus_id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, sf_dir).groups("corpus_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "annotation", "corpus_id", "corpus_text")
    items = table(spark, sf_dir, "benchmark_item", "test_id", "text")
    return leak.leaked_items(corpus, items, "corpus_id", "corpus_text", "test_id", "text").select("corpus_id", "test_id")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "annotation", "corpus_id", "corpus_text", "dataset").withColumn("dataset", topn.clean_key("dataset"))
    items = table(spark, sf_dir, "benchmark_item", "test_id", "text")
    return leak.leaked_items(corpus, items, "corpus_id", "corpus_text", "test_id", "text", max_edits=2, extra=["dataset"])


def p6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_leaks by the exact search, which its recall is measured against."""
    corpus = table(spark, sf_dir, "annotation", "corpus_id", "corpus_text", "dataset").withColumn("dataset", topn.clean_key("dataset"))
    items = table(spark, sf_dir, "benchmark_item", "test_id", "text")
    return leak.leaked_items(corpus, items, "corpus_id", "corpus_text", "test_id", "text", max_edits=2, exact=True, extra=["dataset"])


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: leaks and windows that the exact search finds, and those of them that p6_leaks finds."""
    exact, found = p6_exact(spark, sf_dir), p6_leaks(spark, sf_dir).select("corpus_id", "test_id", F.col("windows").alias("met"))
    both = exact.join(found, ["corpus_id", "test_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("leaks"), F.count("met").alias("leaks_found"), F.sum("windows").alias("windows"), F.sum("met").alias("windows_found"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = p7_ids(spark, sf_dir)
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("digest"))


def mixed(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mixture(documents, table(spark, sf_dir, "mixture_target"), "doc_id", "source", bpe.token_count(F.col("text")))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).copies()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, sf_dir).shares()


def p8_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source of a mix is to give, whether what it gives is off by less than its longest document, and whether its repeats keep to the cap."""
    made = mixed(spark, sf_dir)
    longest = made.sized.groupBy("source").agg(F.max("tokens").alias("longest"))
    shares = made.shares().join(longest, "source", "left")
    near = F.abs(F.col("reached_tokens") - F.col("allotted_tokens")) <= F.coalesce("longest", F.lit(0))
    numbers = [F.round(c, 3).alias(c) for c in ("budget_tokens", "target_tokens", "allotted_tokens")]
    return shares.select("mix_name", "source", "available_tokens", *numbers, near.alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "form")


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    own = [p1_found, p1_ranked, p2_found, p2_pieces, p2_rejoined, p3_found, p3_consensus, p3_annotators, p3_agreement, p4_found, p5_found, p5_groups, p6_found, p6_leaks, p6_exact, p6_recall, p7_ids, p7_digests, p8_mixture, p8_shares, p8_plan, p9_found, p9_forms, p9_classes]
    return {f.__name__: f for f in own}
