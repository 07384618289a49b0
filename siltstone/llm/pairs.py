"""Problem 4: defective prompt and response pairs, with the kind of defect.

Responses are sorted by text and each compared with its neighbour: one that another continues is a shortened version.
Lengths at which far more responses end than at the lengths around are limits. Both are evidence of truncation, beside
what the response itself shows (an open fence, code or a sentence that breaks off). Then the rules for copies, refusals
and foreign languages apply.
"""

from __future__ import annotations

import ast
import builtins
import codeop
import re
import unicodedata
import warnings
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm import declines, language
from siltstone.llm.language import plain_words
from siltstone.runtime import materialize, small_side, spread

# Words that only introduce a repeated prompt.
LABELS = frozenset("q a question prompt task aufgabe frage tâche pregunta tarea input instruction instructions user the is here request problem ask asked you said".split())
_UNSEEN = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+")
_SOLVES = re.compile(r"\bdef +\w+ *\(|\blambda\b[^:\n]*:|^[ \t]*class +\w+ *[:(]|^[ \t]*import +\w+|^[ \t]*from +[\w.]+ +import\b", re.M)
_DEFINES = re.compile(r"\bdef \w+\(|\blambda\b|\breturn\b.*[\[(=]")
_STRINGS = re.compile(r'"""(.*?)(?:"""|\Z)|\'\'\'(.*?)(?:\'\'\'|\Z)', re.S)
_COMMENT = re.compile(r"^\s*(?:#|//)\s?(.*)$|(?<=\s)(?:# |// )(.*)$", re.M)
_PARAGRAPHS = re.compile(r"\n\s*\n")
_FENCE = re.compile(r"(?:^|(?<=\n)|(?<=`))[ \t]*```[ \t]*([\w+#.-]*)[ \t]*")
_CODE = re.compile(r"^\s*(?:async def |def |class |for .+:|while .+:|if .+:|elif .+:|else:|try:|except\b.*:|with .+:|return\b|import \w|from \w+ import|@\w|print\(|[\w.\[\]\"', ]+ ?(?:[-+*/%]|//|\*\*)?= ?\S|[\w.]+\(.*\)\s*$|function |const |let |var |#include|public |private )", re.M)
_CLOSED = re.compile(r"[.!?…。:;][\"')\]»”’*_`]*$|[\"'`)\]}»”]$")
#: How many times as many responses as at the lengths around make a length a limit, and how many at least.
SPIKE_TIMES, SPIKE_LEAST, SPIKE_WIDTH = 8.0, 20, 5


@lru_cache(maxsize=65_536)
def shows(ch: str) -> bool:
    return ch in "\n\t\r" or unicodedata.category(ch) not in ("Cf", "Cc", "Cn")


def visible(text: str) -> str:
    """Without characters that show nothing: format and control characters, but line ends and tabs."""
    if text.isascii():
        return _UNSEEN.sub("", text)
    drop = [ch for ch in set(text) if not shows(ch)]
    return text.translate(dict.fromkeys(map(ord, drop))) if drop else text


def parts(answer: str) -> tuple[str, str, bool]:
    """(prose, code, whether a fence stays open). Without a fence, a text with lines of code is all code."""
    marks = list(_FENCE.finditer(answer))
    if not marks:
        return ("", answer, False) if _CODE.search(answer) and not prose_only(answer) else (answer, "", False)
    prose, code, at, inside = [], [], 0, False
    for m in marks:
        (code if inside else prose).append(answer[at : m.start()])
        if inside and m[1]:  # a word right behind a closing fence belongs to the prose
            at = m.start(1)
        else:
            at = m.end()
        inside = not inside
    (code if inside else prose).append(answer[at:])
    body = "\n".join(code)
    if body.strip() and not _CODE.search(body):  # a fence around prose
        return "\n".join([*prose, body]), "", inside
    return "\n".join(prose), body, inside


def prose_only(text: str) -> bool:
    """Whether lines that look like code are few among sentences."""
    lines = [x for x in text.splitlines() if x.strip()]
    return sum(bool(_CODE.match(x)) for x in lines) * 4 < len(lines) and not re.search(r"^\s*(?:def|class|import|from) |\blambda\b", text, re.M)


def comments(code: str) -> list[str]:
    """Comments and bare strings of the code, also of code that doesn't parse."""
    out = [a or b for a, b in _STRINGS.findall(code)]
    joined = "\n".join(a or b for a, b in _COMMENT.findall(_STRINGS.sub("", code) if out else code))
    return [*out, joined] if joined else out


def breaks_off(code: str) -> bool:
    """Whether Python code stops before it is whole. A plain mistake elsewhere in it is none."""
    code = code.rstrip(" \t")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(code)
        except SyntaxError as error:
            return _stops(code, error)
        except (ValueError, RecursionError, MemoryError):
            return False
    functions = [x for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    if not functions or tree.body[-1] is not functions[-1]:
        return bool(tree.body) and isinstance(tree.body[-1], ast.Expr) and isinstance(tree.body[-1].value, ast.Name) and len(tree.body) > 1
    function = functions[-1]
    last = function.body[-1]
    if isinstance(last, ast.Expr) and isinstance(last.value, ast.Name):
        return True
    if isinstance(last, ast.Return):
        value = last.value
        if not isinstance(value, ast.Name) or hasattr(builtins, value.id):
            return False
        nodes = list(ast.walk(function))
        known = {a.arg for x in nodes if isinstance(x, ast.arguments) for a in [*x.posonlyargs, *x.args, *x.kwonlyargs]} | {x.id for x in nodes if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)} | {f.name for f in functions}
        return value.id not in known and any(k.startswith(value.id) for k in known | set(dir(builtins)))
    if isinstance(last, ast.Expr) and isinstance(last.value, ast.Constant):
        return len(function.body) == 1  # a docstring alone
    if isinstance(last, (ast.Raise, ast.Pass, ast.Expr, ast.With, ast.Assert, ast.FunctionDef)):
        return False
    nodes = list(ast.walk(function))
    if any(isinstance(x, (ast.Yield, ast.YieldFrom, ast.Global, ast.Nonlocal)) for x in nodes):
        return False
    if any(isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == "print" for x in nodes):
        return False
    returns = [x for x in nodes if isinstance(x, ast.Return) and x.value is not None]
    ends = isinstance(last, ast.If) and bool(last.orelse) and all(isinstance(b[-1], (ast.Return, ast.Raise)) for b in (last.body, last.orelse))
    ends = ends or (isinstance(last, ast.Try) and isinstance(last.body[-1], ast.Return)) or (isinstance(last, ast.While) and isinstance(last.test, ast.Constant))
    return not ends and bool(returns or any(isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store) for x in nodes))


def _stops(code: str, error: SyntaxError) -> bool:
    said = str(error.msg)
    if "never closed" in said or "unterminated triple" in said or "expected an indented block" in said or "unexpected EOF" in said:
        return True
    lines = code.rstrip().split("\n")
    at_end = (error.lineno or 0) >= len(lines) and (error.end_offset or error.offset or 0) >= len(lines[-1].rstrip())
    if (error.lineno or 0) >= len(lines) and ("unterminated" in said or "expected 'except' or 'finally'" in said):
        return True
    try:
        compile(code, "", "exec", ast.PyCF_ONLY_AST | codeop.PyCF_ALLOW_INCOMPLETE_INPUT | codeop.PyCF_DONT_IMPLY_DEDENT)
    except SyntaxError as again:
        return "incomplete input" in str(again.msg) or at_end
    except (ValueError, RecursionError, MemoryError):
        return False
    return at_end


class Judge:
    """The rules, with the fitted profiles of languages and the fitted classifier of refusals."""

    def __init__(self, labelled: list[tuple[str, str]] | None = None, pairs: list[tuple[str | None, str]] | None = None):
        labelled = labelled or []
        self.profiles = language.Profiles(labelled)
        # what a labelled text or a prompt says declines nothing either
        beside, without = [*language.PASSAGES.values(), *(t for _, t in labelled)], []
        for prompt, answer in pairs or []:
            prose, code, _ = parts(visible(answer))
            beside.append(visible(prompt or ""))
            if _SOLVES.search(code):
                beside += [prose, *comments(code)]
            elif not code.strip():
                without.append(prose)
        self.declines = declines.Declines().fit(beside, without)

    def defect(self, prompt: str | None, answer: str | None, shortened: bool = False, at_limit: bool = False) -> str | None:
        """The kind of defect of one pair, or None."""
        prompt, answer = visible(prompt or ""), visible(answer or "")
        prose, code, still_open = parts(answer)
        if not (prose + code).strip():
            return "empty"
        solves = bool(_SOLVES.search(code))
        if not _DEFINES.search(code):
            asked, said = plain_words(prompt), plain_words(prose + "\n" + code)
            if asked and said and is_copy(asked, said):
                return "copy"
        notes = comments(code) if code else []
        if not solves and any(self.declines.declining(t) for t in (prose, *notes)):
            return "refusal"
        if shortened or still_open or (code and breaks_off(code)):
            return "truncated"
        marks = list(_FENCE.finditer(answer))
        # what the answer ends with outside of code
        tail = answer[marks[-1].end() :].strip() if code and marks else "" if code else prose.strip()
        # prose behind code is a sentence however short; prose alone may be a bare value
        sentences = bool(tail) and len(plain_words(tail)) > (0 if solves else 3)
        if sentences and not _CLOSED.search(tail):
            return "truncated"
        natural = bool(code.strip() and answer.endswith("\n")) or answer.rstrip().endswith("```") or bool(_CLOSED.search(answer.rstrip()))
        if at_limit and not natural:
            return "truncated"
        own = self.profiles.language(prompt)
        if own:
            for piece in [*_PARAGRAPHS.split(prose), *notes]:
                if piece and (other := self.profiles.language(piece, own)) and other != own:
                    return "language"
        return None


@lru_cache(maxsize=1)
def plain_judge() -> Judge:
    """With what the classifiers bring along only."""
    return Judge()


def defect(prompt: str | None, answer: str | None, shortened: bool = False, at_limit: bool = False) -> str | None:
    return plain_judge().defect(prompt, answer, shortened, at_limit)


def is_copy(asked: list[str], said: list[str]) -> bool:
    """Whether an answer says nothing but the prompt: its words, once or several times, whatever stands around."""
    known, mine = Counter(asked), Counter(w for w in said)
    extra = sum(n for w, n in mine.items() if w not in known and w not in LABELS)
    held = sum(n for w, n in known.items() if w in mine)
    return extra <= 0.05 * len(said) and held >= 0.6 * len(asked) and len(said) >= 0.6 * len(asked)


def body(answer: Column) -> Column:
    """What stands in the first fence, also in one that stays open; without a fence the whole answer; without outer white space."""
    fenced = F.regexp_extract(answer, r"(?s)```[\w+#.-]*[ \t]*\r?\n?(.*?)(?:```|\z)", 1)
    return F.regexp_replace(F.when(F.contains(answer, F.lit("```")), fenced).otherwise(answer), r"^\s+|\s+$", "")


def cut_short(text: str, longer: str) -> bool:
    """Whether a text stops in the middle of a longer one: not where a line of code ends and the next one begins something new."""
    if len(longer) <= len(text) or not longer.startswith(text):
        return False
    if not _CODE.search(text):
        return True
    rest = longer[len(text) :]
    first = rest.lstrip(" \t")
    if not first.startswith(("\n", "\r")):
        return not first.startswith(("#", "//"))  # a note at the line's end
    line = next((x for x in first.splitlines() if x.strip()), "")
    return line[:1] in (" ", "\t") and not line.lstrip().startswith(("#", "//", '"', "'"))


def shortened_versions(texts: DataFrame) -> DataFrame:
    """(h) of every text that stops in the middle of another of its group. texts: group, text, h (a digest of both).

    Texts are sorted by group and text, in ranges of about equal size. Sorted, a beginning stands right before a text that
    continues it; the last of a range is held against the first of the next, one row a range.
    """
    ranges = texts.where("text <> ''").distinct().repartitionByRange("group", "text").sortWithinPartitions("group", "text").withColumn("range", F.spark_partition_id())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = before = number = None
        for batch in batches:
            found = []
            for g, t, h, r in zip(batch["group"], batch["text"], batch["h"], batch["range"], strict=True):
                if before is None:
                    first, number = (g, t), int(r)
                elif before[0] == g and cut_short(before[1], t):
                    found.append(before[2])
                before = (g, t, h)
            if found:
                yield pd.DataFrame({"h": found, "range": number, "group": 0, "text": None, "first_group": 0, "first": None, "edge": False})
        if before is not None:
            yield pd.DataFrame({"h": [before[2]], "range": [number], "group": [before[0]], "text": [before[1]], "first_group": [first[0]], "first": [first[1]], "edge": [True]})

    got = materialize(ranges.mapInPandas(compare, "h binary, range int, group long, text string, first_group long, first string, edge boolean"))
    following = Window.partitionBy(F.lit(0)).orderBy("range")
    edges = got.where("edge").withColumn("next_group", F.lead("first_group").over(following)).withColumn("next", F.lead("first").over(following)).where("group = next_group")

    @F.pandas_udf("boolean")
    def stops(texts: pd.Series, longer: pd.Series) -> pd.Series:
        return pd.Series([cut_short(a, b) for a, b in zip(texts, longer, strict=True)], dtype=bool)

    return got.where("not edge").select("h").union(edges.where(stops("text", "next")).select("h")).distinct()


def limit_lengths(lengths: DataFrame) -> DataFrame:
    """(length) at which far more texts end than at the lengths around. lengths: one column length."""
    counts = lengths.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    around = counts.select(F.col("length").alias("own"), F.col("n").alias("own_n"), F.explode(F.sequence(F.col("length") - SPIKE_WIDTH, F.col("length") + SPIKE_WIDTH)).alias("length")).where("own <> length")
    seen = around.join(counts, "length", "left").groupBy("own", "own_n").agg(F.sum(F.coalesce("n", F.lit(0))).alias("others"))
    return seen.where((F.col("own_n") >= SPIKE_LEAST) & (F.col("own_n") > SPIKE_TIMES * F.col("others") / (2 * SPIKE_WIDTH))).select(F.col("own").alias("length"))


def pairs_sample(rows: DataFrame) -> list[tuple[str | None, str]]:
    """At most SAMPLE_ROWS pairs (prompt, text) of bounded length, those with the least hashes."""
    n = rows.count()
    kept = rows.select("prompt", "text", (F.xxhash64("text", "prompt").cast("double") / F.lit(2.0**64) + 0.5).alias("place"))
    kept = kept.where(F.char_length("text").between(1, declines.SAMPLE_LENGTH) & (F.coalesce(F.char_length("prompt"), F.lit(0)) <= declines.SAMPLE_LENGTH))
    kept = kept.where(F.col("place") <= min(1.0, 2 * declines.SAMPLE_ROWS / max(1, n))).distinct()
    return [(r["prompt"], r["text"]) for r in kept.orderBy("place", "text", "prompt").limit(declines.SAMPLE_ROWS).collect()]


def defective_pairs(df: DataFrame, key: str, prompt: str, answer: str, labelled: DataFrame | None = None, labelled_text: str = "text", labelled_lang: str = "lang") -> DataFrame:
    """(key, defect): one row for each row of df whose answer is defective.

    Languages are told by profiles fitted on labelled, refusals by a classifier fitted on df's answers, both on bounded samples (SAMPLE_ROWS
    and SAMPLE_LENGTH of their modules); every row is judged.
    A null, empty or invisible answer is empty; with a null or empty prompt no copy and no foreign language is told; a row
    has the first that holds of empty, copy, refusal, truncated, language; repeated rows are judged alike; answers
    of any length are read whole; an empty table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{prompt}`").alias("prompt"), F.col(f"`{answer}`").alias("text"))
    samples = language.labelled_sample(labelled, labelled_text, labelled_lang) if labelled is not None else []
    shared = df.sparkSession.sparkContext.broadcast(Judge(samples, pairs_sample(rows)))
    plain = body(F.col("text"))
    digest = F.unhex(F.md5(F.concat_ws("\x1f", F.xxhash64("prompt").cast("string"), plain)))
    short = shortened_versions(rows.where("text is not null").select(F.xxhash64("prompt").alias("group"), plain.alias("text"), digest.alias("h"))).withColumn("shortened", F.lit(True))
    limits = materialize(limit_lengths(rows.select(F.char_length("text").alias("length")))).withColumn("at_limit", F.lit(True))
    marked = spread(rows).withColumn("h", digest).join(small_side(short), "h", "left").withColumn("length", F.char_length("text")).join(small_side(limits), "length", "left")
    marked = marked.select("key", "prompt", "text", F.coalesce("shortened", F.lit(False)).alias("shortened"), F.coalesce("at_limit", F.lit(False)).alias("at_limit"))

    @F.pandas_udf("string")
    def judge(prompts: pd.Series, texts: pd.Series, shortened: pd.Series, at_limit: pd.Series) -> pd.Series:
        return pd.Series([shared.value.defect(*x) for x in zip(prompts, texts, shortened, at_limit, strict=True)], dtype=object)

    judged = marked.select("key", judge("prompt", "text", "shortened", "at_limit").alias("defect"))
    return judged.where(F.col("defect").isNotNull()).select(F.col("key").alias(key), "defect")
