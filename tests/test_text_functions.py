"""Functions on texts and records, on literal cases."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import chunking, parsing, records, similarity, text, tokens


def one(spark, column, **fields):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in fields.items())
    return spark.createDataFrame([tuple(fields.values())], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize("given, cleaned", [(None, ""), ("", ""), (5, ""), ("a\x00b\x85c", "abc"), ("a\tb\nc\r", "a\tb\nc\r"), ("\ufffd", "\ufffd"), ("x\ufffd\ufffd\ufffdy", "x\ufffdy"), ("e\u0301", "é"), ("😀", "😀"), ("a\ud800b", "a?b")])
def test_sanitize(given, cleaned):
    assert text.sanitized_text(given) == cleaned


def test_quality(spark):
    assert text.compression("") == 0.0 and text.compression(None) == 0.0
    rows = [("only prose words here", False), ("12345 67890 !!", True), ("the same phrase " * 400, True), (None, True), ("  \n", True), ("".join(chr(0x4E00 + i * 37 % 20000) for i in range(150)), False)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", text.is_garbage(F.col("t")).alias("g")).orderBy("i").collect()
    assert [r.g for r in got] == [g for _, g in rows]


@pytest.mark.parametrize("block, kind", [
    ("def f(x):\n    return x", "code"), ("SELECT a FROM b", "code"), ("function f() {\n  g();\n}", "code"), ("#include <x>\nint main() {}", "code"), ("", "prose"), ("Just a sentence.", "prose"),
    ("We know $x \\leq y$.", "prose"), ("\\begin{a} \\frac{1}{2} \\end{a}", "math"), ("$$ x \\leq 1 $$", "math"), ("    - a list item\n    - another", "prose"),
])
def test_block_type(block, kind):
    assert chunking.block_type(block) == kind


def test_chunks():
    doc = "Intro text.\n\ndef a():\n    pass\n\n    return x\n\ndef b():\n    return 2\n\nMore prose here.\n\n\\begin{x}\n\n\\frac \\sum \\int\n\n\\end{x}\n"
    got = chunking.chunks(doc)
    assert [k for _, k in got] == ["prose", "code", "code", "prose", "math"]
    assert got[1][0].startswith("def a") and "return x" in got[1][0] and got[2][0].startswith("def b")
    assert chunking.chunks(None) == [] and chunking.chunks(" \n ") == []
    assert chunking.math_parts("\\begin{a}\n\nb\n\n\\end{a}\n\nc") == ["\\begin{a}\n\nb\n\n\\end{a}", "c"]
    assert chunking.math_parts("\\begin{a}\n\nb") == ["\\begin{a}\n\nb"] and chunking.code_parts("x = 1\n\ny = 2") == ["x = 1", "y = 2"]
    assert chunking.token_batches([10, 1, 4, 4], 12, 3) == [0, 1, 1, 1]
    assert chunking.token_batches([10, 1, 4, 4], 12, 2) == [0, 2, 1, 1]


def test_latex():
    assert text.plain_latex("$$$1 \\le n \\leq 10^{5}$$$ and \\frac{a}{b} \\text{ok}\u200b") == "1 <= n <= 10^(5) and (a)/(b) ok"
    assert text.plain_latex(None) is None


def test_records(spark):
    chat = "array(struct('system' as role, 'x' as content), struct('user' as role, 'q' as content), struct('assistant' as role, 'a' as content), struct('user' as role, 'q2' as content))"
    got = spark.sql(f"select {chat} as m, array(struct('user' as role, 'q' as content)) as n, 'p' as prompt, cast(null as string) as solution")
    row = got.select(records.conversation_text(F.col("m")).alias("a"), records.conversation_text(F.col("n")).alias("b"), records.solution_text(F.col("prompt"), F.col("solution")).alias("c"), records.messages_text(F.col("n")).alias("d")).first()
    assert row.a == "Prompt: q\n\nResponse: a" and row.b is None and row.c == "Prompt: p" and row.d == "user: q"
    both = got.select(F.col("m").alias("chosen"), F.col("n").alias("rejected"))
    assert [r.dpo_label for r in records.preference_rows(both).collect()] == ["chosen"]
    assert records.preference_rows(both, mode="rejected").count() == 0
    flat = spark.createDataFrame([("", "u", "r")], "prompt string, user string, answer string")
    assert flat.select(records.flat_conversation_text(flat).alias("v")).first().v == "Prompt: u\n\nResponse: r"
    paths = [("a/common_crawl-2024/x", "common_crawl"), ("a/wiki/x", "wiki"), ("b/c", "unknown"), ("wiki_to_rcqa-1/x", "wiki_to_rcqa")]
    assert [r.v for r in spark.createDataFrame(paths, "p string, want string").select(records.category_of_path(F.col("p")).alias("v")).collect()] == [w for _, w in paths]
    prompt = "x\n## Test Task (a):\nfirst\n\n## Corpus Task:\nsecond\n## Rules"
    a, b = records.prompt_sections(F.col("p"))
    assert tuple(spark.createDataFrame([(prompt,)], "p string").select(a, b).first()) == ("first", "second")
    assert one(spark, records.lettered_choices(F.col("c")), c=["x", "y"]) == "A. x\nB. y"
    assert one(spark, records.filled_template("{a}-{b}", {"a": F.col("a"), "b": F.col("b")}), a="1", b=None) == "1-"


@pytest.mark.parametrize("said, letter", [("B. because", "B"), ("b)", "B"), ("the answer: C", None), ("D", "D"), ("nothing", None), ("I say A: yes", "A"), ("", None)])
def test_answer_letter(spark, said, letter):
    want = letter if said != "the answer: C" else None
    assert one(spark, parsing.answer_letter(F.col("s")), s=said) == want


@pytest.mark.parametrize("said, letter, number", [("ANSWER: (b)", "B", None), ("My answer is c", "C", None), ("so\n(d).\n", "D", None), ("answer: 2", None, 2), ("answer: x\nanswer: 3 or 1", None, 1), ("none", None, None)])
def test_announced_answers(spark, said, letter, number):
    assert one(spark, parsing.announced_letter(F.col("s")), s=said) == letter
    assert one(spark, parsing.numbered_choice(F.col("s"), 4), s=said) == number


def test_code_and_json(spark):
    assert one(spark, parsing.fenced_code(F.col("s")), s="a\n```python\nx = 1\n```\nb") == "x = 1"
    assert one(spark, parsing.fenced_code(F.col("s")), s="x = 1") == "x = 1"
    assert one(spark, parsing.completed_code(F.col("s")), s="python\nx = 1\n```") == "x = 1"
    assert one(spark, parsing.function_name(F.col("s")), s="def  f_1 (a):") == "f_1"
    assert [tuple(x) for x in one(spark, parsing.answer_options(F.col("s")), s="(a) X Y; (b) Z; bad")] == [("a", "X Y"), ("b", "Z")]
    assert parsing.last_json('{"a": 1} then {"b": {"c": 2}} and {"d"') == '{"b": {"c": 2}}'
    assert parsing.last_json("none") is None and parsing.last_json("{bad}") is None
    assert parsing.puzzle_solution('x {"solution": {"House 1": {"Pet": "Cat"}}} y') == {"House 1": {"Pet": "Cat"}}
    assert parsing.puzzle_solution('"House 2": {"Pet": "Dog"') is None
    assert parsing.puzzle_solution('{"broken" "House 2": {"Pet": "Dog"}') == {"House 2": {"Pet": "Dog"}}
    assert one(spark, parsing.verdict(F.col("s")).getField("is_duplicate"), s='Sure: {"is_duplicate": true, "confidence": 0.5}!') is True
    assert one(spark, parsing.verdict(F.col("s")), s="no") is None


def test_puzzles(spark):
    grid = spark.sql("select array('House', 'Pet', 'Color') as h, array(array('1', 'Cat', 'Red'), array('2', 'Dog', 'Blue')) as r, map('House 1', map('Pet', ' CAT', 'Color', 'Blue')) as p, map('cat', 'Lion', 'Pet', 'Beast') as plan")
    row = grid.select(parsing.grid_as_map(F.col("h"), F.col("r")).alias("m"), "p", "plan").select("*", parsing.cell_accuracy(F.col("p"), F.col("m")).alias("c"), parsing.substituted(F.col("m"), F.col("plan")).alias("s")).first()
    assert row.m == {"House 1": {"Pet": "Cat", "Color": "Red"}, "House 2": {"Pet": "Dog", "Color": "Blue"}}
    assert tuple(row.c) == (1, 4) and row.s["House 1"] == {"Beast": "Lion", "Color": "Red"}


@pytest.mark.parametrize("a, b, want", [
    ("", "", dict(jac=1.0, cov=1.0, bag=1.0, w2=0.0, c3=0.0, rouge=0.0, edit=0.0, ratio=0.0, tok=0.0)),
    ("a b c", "", dict(jac=0.0, cov=0.0, bag=0.0, w2=0.0, c3=0.0, rouge=0.0, edit=1.0, ratio=0.0, tok=0.0)),
    ("a b c", "a b c", dict(jac=1.0, cov=1.0, bag=1.0, w2=100.0, c3=100.0, rouge=1.0, edit=0.0, ratio=1.0, tok=1.0)),
    ("a b c d", "x y z", dict(jac=0.0, cov=0.0, bag=0.0, w2=0.0, c3=0.0, rouge=0.0, edit=1.0, ratio=0.75, tok=0.0)),
])
def test_empty_conventions(spark, a, b, want):
    x, y = F.col("a"), F.col("b")
    row = spark.createDataFrame([(a, b)], "a string, b string").select(similarity.ngram_jaccard(x, y, 3).alias("jac"), similarity.ngram_coverage(x, y, 3).alias("cov"), similarity.bag_cosine(x, y).alias("bag"), similarity.word_overlap(x, y, 2).alias("w2"), similarity.char_overlap(x, y, 3).alias("c3"), similarity.rouge_l(x, y).alias("rouge"), similarity.word_edit_distance(x, y).alias("edit"), similarity.length_ratio(x, y).alias("ratio"), similarity.token_jaccard(x, y).alias("tok")).first()
    assert row.asDict() == pytest.approx(want)


def test_sequences_against_plain_tables():
    import random

    draw = random.Random(1)
    for _ in range(60):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(12))] for _ in range(2))
        lcs = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        edit = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                lcs[i][j] = lcs[i - 1][j - 1] + 1 if x == y else max(lcs[i - 1][j], lcs[i][j - 1])
                edit[i][j] = min(edit[i - 1][j] + 1, edit[i][j - 1] + 1, edit[i - 1][j - 1] + (x != y))
        assert similarity.common_subsequence(a, b) == lcs[-1][-1] and similarity.word_edits(a, b) == edit[-1][-1]


def test_numbers(spark):
    kept, precision, recall = similarity.number_preservation(F.col("a"), F.col("b"))
    got = spark.createDataFrame([("1 and 2.5", "2.5 then 1"), ("1 2", "1"), ("x", "y"), ("x", "7")], "a string, b string").select(kept, precision, recall).collect()
    assert [tuple(r) for r in got] == [(True, 1.0, 1.0), (False, 1.0, 0.5), (True, 1.0, 1.0), (False, 0.0, 1.0)]


def test_clue_shuffle(spark):
    puzzle = "Intro\n## Clues:\n1. first\n2. second\nstill second\n3. third\n4. fourth\n\nWhat is it?"
    got = parsing.clues_shuffled(puzzle, 3)
    lines = got.split("\n")
    assert lines[:2] == ["Intro", "## Clues:"] and lines[-1] == "What is it?" and [x[0] for x in lines if x[:2].rstrip(".").isdigit()] == list("1234")
    assert {x[3:] for x in lines if x[1:2] == "."} == {"first", "second", "third", "fourth"} and "second\nstill second" in got
    assert parsing.clues_shuffled(puzzle, 3) == got and any(parsing.clues_shuffled(puzzle, s) != got for s in range(4))
    assert parsing.clues_shuffled("no clues 1. x") == "no clues 1. x" and parsing.clues_shuffled(None) is None
    assert one(spark, parsing.shuffled_clues_of(F.col("s"), 3), s=puzzle) == got


def test_templates_line_ends_and_tasks(spark):
    df = spark.createDataFrame([("{b}", "x\r\ny\r", ["t1", "t2", "t3", "t4"])], "a string, c string, tests array<string>")
    got = df.select(
        records.filled_template("{a}-{b}-{c", {"a": F.col("a"), "b": F.lit("B")}).alias("t"), records.unix_lines(F.col("c")).alias("u"),
        records.task_prompt(F.lit("T"), F.col("tests"), 2, "I", "S").alias("p"), records.fenced_answer(F.col("c")).alias("f"),
    ).first()
    assert got.t == "{b}-B-{c" and got.u == "x\ny\n" and got.p == "I\nT\nS\nt1\nt2" and got.f == "```python\nx\ny\n```"


def test_token_counts_equal_another_public_encoder(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    texts = ["", "Hello  world\n\n  x", "<|endoftext|> plain", "naïve café 漢字 \u200d", "def f(x):\n    return x ** 2 + 10", "we'll can't THEY'RE", "a" * 500]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert [r.n for r in df.select(tokens.bpe_tokens(F.col("t")).alias("n")).collect()] == [*(len(other.encode(t, add_special_tokens=False).ids) for t in texts), 0]


def test_latex_signs():
    cases = {r"\sum_{i} \times \bmod": "sum_i * mod", r"\sqrt {2}^{10}": "sqrt(2)^(10)", r"\unknown{x} \; y": "unknownx y", "a  \n  b\n\n\n\nc": "a\nb\n\nc", r"\$5": r"\$5"}
    assert {k: text.plain_latex(k) for k in cases} == cases
