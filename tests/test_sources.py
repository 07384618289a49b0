"""Readers and writers on files."""

import gzip
import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import runtime
from siltstone.sources import readers, writers

ROWS = [{"id": str(i), "text": f"text {i} é 😀"} for i in range(5)]
LINES = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in ROWS).encode()


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.jsonl").write_bytes(LINES)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(LINES))
    (tmp_path / "deep/c.jsonl.zst").write_bytes(zstandard.compress(LINES))
    (tmp_path / "no.txt").write_text("x")
    return tmp_path


def test_find_and_read_all_codecs(spark, folder):
    files = readers.find_files(spark, str(folder))
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.jsonl", "b.jsonl.gz", "c.jsonl.zst"]
    lines = readers.read_lines(spark, files)
    assert lines.count() == 15 and {r.file for r in lines.select("file").distinct().collect()} == {"a.jsonl", "b.jsonl.gz", "c.jsonl.zst"}
    got = readers.parse_lines(lines, "id string, text string")
    assert sorted(r.text for r in got.where("file = 'c.jsonl.zst'").collect()) == sorted(r["text"] for r in ROWS)
    assert readers.read_json(spark, files, "id string, text string").count() == 15


def test_missing_and_empty_folders(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.find_files(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        readers.find_files(spark, str(tmp_path))


def test_bad_lines_and_bytes(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'{"id": "1", "text": "ok"}\n{bad\nnot json\n{"id": "2", "text": "\xff"}\n')
    lines = readers.read_lines(spark, str(tmp_path / "x.jsonl"))
    assert [r.text for r in readers.parse_lines(lines, "id string, text string").orderBy("id").collect()] == ["ok", "�"]
    assert readers.parse_lines(lines, "id string, text string", keep_bad=True).where("is_bad").count() == 2


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id string, text string")
    for codec in (None, "gzip", "bzip2"):
        writers.write_json_lines(df, str(tmp_path / f"j{codec}"), codec)
        assert sorted(map(tuple, readers.read_json(spark, str(tmp_path / f"j{codec}"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    writers.append_rows(df, str(tmp_path / "p"))
    writers.append_rows(df.withColumn("more", F.lit(1)), str(tmp_path / "p"))
    got = readers.read_documents(spark, str(tmp_path / "p"))
    assert got.count() == 10 and "more" in got.columns and readers.read_documents(spark, str(tmp_path / "p"), "nowhere").count() == 0
    writers.write_split(df.withColumn("is_garbage", F.col("id") == "1"), "is_garbage", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("not is_garbage").count() == 4
    assert json.loads(readers.as_json_lines(df.limit(1)).first().line)["id"] == "0"


def test_reports_and_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 'quote " and\nline', 2), ("b", "x,y", 1)], "k string, t string, n int")
    writers.write_report(df, str(tmp_path / "r"), ["n"])
    got = readers.read_csv(spark, str(tmp_path / "r"))
    assert [(r.k, r.t, r.n) for r in got.orderBy("n").collect()] == [("b", "x,y", "1"), ("a", 'quote " and\nline', "2")]


def test_vectors_by_alias(spark):
    df = spark.createDataFrame([([1.0, 2.0], "t"), (None, "u")], "Vector array<double>, content string")
    got = readers.read_vectors(df).collect()
    assert len(got) == 1 and got[0].text == "t" and got[0].id.startswith("emb_")
    with pytest.raises(ValueError):
        readers.read_vectors(df.select("content"))


def test_json_files_and_variants(spark, tmp_path):
    (tmp_path / "ds__t1__c1.json").write_text('{"is_sd":\n true}')
    (tmp_path / "_skip.json").write_text('{"is_sd": false}')
    row = readers.read_json_files(spark, str(tmp_path), "is_sd boolean").collect()
    assert [tuple(r) for r in row] == [(True, "ds", "t1", "c1")]
    wide = spark.createDataFrame([("o", "a", " "), (" ", "b", "c")], "original string, regen_1 string, regen_2 string")
    assert [tuple(r) for r in readers.long_variants(wide, "original", "regen_").collect()] == [("o", "regen_1", "a")]
    runs = spark.createDataFrame([("x", "2024-01-01 00:00:00", 1), ("x", "2024-02-01 00:00:00", 2), ("y", None, 3)], "label string, stamp string, n int")
    assert [r.n for r in readers.newest_run(runs, "label", "stamp").collect()] == [2]


def test_documents_and_chats(spark):
    matches = spark.createDataFrame([("t", 2, 0.5, "c2"), ("t", 1, 0.9, "c1")], "test_id string, rank int, score double, corpus_id string")
    stats = spark.createDataFrame([("t", 0.9)], "test_id string, max double")
    doc = writers.matches_document(matches, "test_id", stats)
    assert json.loads(doc.first().document)["top"][0]["corpus_id"] == "c1" and json.loads(doc.first().document)["stats"] == {"max": 0.9}
    assert [(r.rank, r.corpus_id) for r in writers.exploded_documents(doc, "document").collect()] == [(1, "c1"), (2, "c2")]
    old = spark.createDataFrame([('{"test_id": "t", "ids": ["a", "b"], "scores": [0.3, 0.2]}',)], "d string")
    assert [(r.rank, r.score, r.corpus_id) for r in writers.exploded_documents(old, "d").collect()] == [(1, 0.3, "a"), (2, 0.2, "b")]
    chat = spark.sql("select ' ' as s, 'p' as p, 'r' as r").select(writers.chat_lines(F.col("p"), F.col("r"), F.col("s")).alias("c"), writers.chat_lines(F.col("p"), None, F.col("p")).alias("d")).first()
    assert [m["role"] for m in json.loads(chat.c)["messages"]] == ["user", "assistant"] and [m["role"] for m in json.loads(chat.d)["messages"]] == ["system", "user"]


def test_registry_settings_and_modes(spark, tmp_path):
    from siltstone.config import Preparation, nested
    from siltstone.functions import records

    reg = readers.Registry()
    reg.add("a", lambda s: s.createDataFrame([(1, "x")], "i int, t string"))
    reg.add("b", lambda s: s.createDataFrame([(2,)], "i int"))
    reg.add_union("both", ["a", "b"])
    assert {(r.i, r.task) for r in reg.load(spark, "both").collect()} == {(1, "a"), (2, "b")} and reg.load(spark, "both", 1).count() == 1
    with pytest.raises(KeyError):
        reg.load(spark, "c")
    with pytest.raises(ValueError):
        reg.add("a", None)
    assert nested({"a": {"b": 1}}, "a.b") == 1 and nested({}, "a.b", 2) == 2
    (tmp_path / "c.json").write_text('{"chunking": {"mode": "rl", "max_tokens": 99}}')
    assert Preparation.read(str(tmp_path / "c.json")).max_tokens == 99
    for bad in ({"mode": "x"}, {"min_tokens": 9, "max_tokens": 5}, {"sample_share": 0}, {"dpo_extract": "none"}):
        with pytest.raises(ValueError):
            Preparation(**bad)
    with pytest.raises(ValueError):
        Preparation.of({"chunking": {"odd": 1}})
    rl = spark.createDataFrame([("p", "s"), ("q", None), ("", "s")], "prompt string, solution string")
    assert sorted(r.text for r in records.parsed_records(rl, Preparation(mode="rl")).collect()) == ["Prompt: p\n\nResponse: s", "Prompt: q"]
    flat = spark.createDataFrame([("p", "r"), (None, "r")], "question string, answer string")
    assert [r.content_type for r in records.parsed_records(flat, Preparation(mode="conversation")).collect()] == ["conversation"]
    docs = spark.createDataFrame([("One.\n\ndef f():\n    return 1",), (None,), ("",)], "text string")
    assert [r.content_type for r in records.parsed_records(docs, Preparation()).collect()] == ["prose", "code"]
    chat = spark.sql("select array(struct('user' as role, 'q' as content), struct('assistant' as role, 'a' as content)) as chosen, array(struct('user' as role, 'q' as content)) as rejected")
    assert [r.dpo_label for r in records.parsed_records(chat, Preparation(mode="dpo")).collect()] == ["chosen"]


def test_evaluation_layouts_and_missing_files(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one/pass_rates.csv").write_text("epoch,checkpoint,sample_id,pass_rate,n_correct,n_samples\nfinal,c1,7,0.5,2,4\n")
    (tmp_path / "two/ck9").mkdir(parents=True)
    (tmp_path / "two/ck9/trials.csv").write_text("sample_id,test_split,correct\n7,eval,1\n7,eval,0\n")
    assert [tuple(r) for r in readers.read_evaluation(spark, str(tmp_path / "one")).collect()] == [("c1", 7, 0.5, 4)]
    assert [tuple(r) for r in readers.read_evaluation(spark, str(tmp_path / "two")).collect()] == [("ck9", 7, 0.5, 2)]
    spark.range(3).write.parquet(str(tmp_path / "p"))
    df, missing = readers.read_many(spark, [str(tmp_path / "p"), str(tmp_path / "q")])
    assert df.count() == 3 and missing == [str(tmp_path / "q")] and readers.read_many(spark, [str(tmp_path / "q")])[0] is None


def test_reports(spark):
    rows = spark.createDataFrame([("a", 0.12345, 0.004), ("b", 0.5, None)], "k string, v double, p double")
    assert [r.line.split("&")[1].strip() for r in writers.latex_rows(rows, "k", "v", "p").orderBy("k").collect()] == ["0.123**" + " " + chr(92) * 2, "0.500" + " " + chr(92) * 2]
    got = writers.markdown_overview(spark.createDataFrame([("d", "o1", "v1", 1), ("d", "o1", "v2", 2), ("d", "o2", "w", 1), ("d", "o3", "z", 1)], "ds string, o string, v string, l int"), "ds", "o", "v", "l", originals=2, length=2).collect()
    assert sorted(r.section for r in got) == ["### o1\n- **1** v1\n- **2** v2", "### o2\n- **1** w"]


def test_unreadable_files_are_told_and_skipped(spark, tmp_path):
    with gzip.open(tmp_path / "good.gz", "wt") as f:
        f.write('{"a": 1}\n')
    (tmp_path / "bad.gz").write_bytes(b"no gzip at all")
    paths = [str(tmp_path / n) for n in ("good.gz", "bad.gz")]
    assert [r.file for r in readers.read_lines(spark, paths, skip_unreadable=True).collect()] == ["good.gz"]
    assert [r.file for r in readers.files_without_lines(spark, paths).collect()] == ["bad.gz"]
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "d__t__c.json").write_text('{"x": 1}')
    (docs / "d__t__b.json").write_text('{"x": ')
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    assert [r.file for r in readers.json_file_errors(spark, str(docs), schema).collect()] == ["d__t__b.json"]


def test_dimensions_resume_and_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None)], "id long, vector array<double>")
    assert readers.dimension(readers.read_vectors(df)) == 2 and readers.read_vectors(df, 2).count() == 2
    with pytest.raises(Exception, match="hasn't 3 numbers"):
        readers.read_vectors(df, 3).collect()
    with pytest.raises(ValueError, match="1 to 2"):
        readers.dimension(df.union(spark.createDataFrame([(4, [1.0])], df.schema)).where("vector is not null"), "vector")
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "p"))
    name = next(p.name for p in (tmp_path / "p").glob("*.parquet"))
    assert sorted(r.id for r in readers.rows_from(spark, str(tmp_path / "p"), name, 7).collect()) == [7, 8, 9]
    for task in readers.UNION_TASKS:
        spark.createDataFrame([("q", "a")], "input string, target string").write.json(str(tmp_path / "root" / readers.UNION_NAME / task))
    for found in (tmp_path / "root").rglob("*.json"):
        found.rename(found.with_suffix(".jsonl"))
    spark.createDataFrame([("q",)] * 3, "question string").write.parquet(str(tmp_path / "root" / "gsm8k"))
    known = readers.folder_registry(str(tmp_path / "root"))
    assert known.load(spark, "gsm8k", 2).count() == 2
    assert sorted(r.task for r in known.load(spark, readers.UNION_NAME).collect()) == sorted(readers.UNION_TASKS)
    with pytest.raises(KeyError):
        known.load(spark, "other")


def test_first_record_is_verified(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b string").coalesce(1)
    writers.write_json_lines(df, str(tmp_path / "x"), verify=True)
    writers.write_json_lines(df.limit(0), str(tmp_path / "y"), verify=True)
    assert "é" in next((tmp_path / "x").glob("*.json")).read_text()


def test_small_sides_are_bounded_in_bytes(spark):
    assert runtime.is_small(spark.range(10), 10) and not runtime.is_small(spark.range(11), 10)
    wide = spark.range(4).select(F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit(1)).alias("v"))
    assert runtime.is_small(wide, 10, 5000) and not runtime.is_small(wide, 10, 3000)
    with runtime.intermediates():
        kept = runtime.materialize(spark.range(3))
        path = kept.inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)
