"""Answers, code and JSON out of model responses."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that announce an answer letter, in the order they are tried.
ANSWER_PHRASES = (r"answer:\s*\(?([a-d])\)?", r"the answer is\s*\(?([a-d])\)?", r"correct answer is\s*\(?([a-d])\)?", r"i choose\s*\(?([a-d])\)?", r"my answer is\s*\(?([a-d])\)?")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def answer_letter(response: Column) -> Column:
    """First A to D before a delimiter, else the first character if it is one."""
    upper = F.upper(F.regexp_replace(response, r"^\s+|\s+$", ""))
    return F.coalesce(_found(upper, r"\b([A-D])[.):\s]"), _found(upper, r"^([A-D])"))


def announced_letter(response: Column) -> Column:
    """The letter after a phrase that announces it, else the last of the last five lines that is a letter alone."""
    lower = F.lower(response)
    lines = F.slice(F.reverse(F.split(F.regexp_replace(lower, r"^\s+|\s+$", ""), "\n")), 1, 5)
    alone = F.try_element_at(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.rlike(r"^\(?[a-d]\)?\.?$")), F.lit(1))
    return F.upper(F.coalesce(*(_found(lower, p) for p in ANSWER_PHRASES), F.regexp_replace(alone, r"[().]", "")))


def answer_options(options: Column) -> Column:
    """`(a) x; (b) y` as array<struct<letter, text>>; parts of another form are left out."""
    parts = F.filter(F.transform(F.split(options, "; "), lambda p: F.trim(p)), lambda p: p.rlike(r"^\([a-d]\)\s*.+"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\(([a-d])\)", 1).alias("letter"), F.regexp_extract(p, r"^\([a-d]\)\s*(.+)", 1).alias("text")))


def numbered_choice(response: Column, choices: int) -> Column:
    """The least choice number that stands in what follows the last `answer:` of a line; null if none does."""
    after = F.transform(F.filter(F.split(F.lower(response), "\n"), lambda x: F.contains(x, F.lit("answer:"))), lambda x: F.trim(F.substring_index(x, "answer:", -1)))
    last = F.try_element_at(F.filter(after, lambda x: x != ""), F.lit(-1))
    return F.coalesce(*(F.when(F.contains(last, F.lit(str(i))), F.lit(i)) for i in range(1, choices + 1)))


def fenced_code(text: Column) -> Column:
    """The first fenced block, or the text where there is no fence."""
    block = F.regexp_extract(text, r"(?s)```(?:\w+)?\n?(.*?)\n?```", 1)
    return F.when(text.rlike(r"(?s)```(?:\w+)?\n?(.*?)\n?```"), block).otherwise(text)


def completed_code(text: Column) -> Column:
    """The first block of a completion that goes on behind an opened fence; else the first fenced block; else empty."""
    pattern = r"(?s)```(?:\w+\n)?(.*?)\n?```"
    opened = F.concat(F.lit("```"), text)
    bare = F.replace(text, F.lit("```python"), F.lit("```"))
    return F.when(opened.rlike(pattern), F.regexp_extract(opened, pattern, 1)).otherwise(F.regexp_extract(bare, pattern, 1))


def function_name(code: Column) -> Column:
    return _found(code, r"def\s+(\w+)\s*\(")


def function_signature(code: Column) -> Column:
    return _found(code, r"def\s+\w+\s*\([^)]*\)\s*:", 0)


def verdict(response: Column, schema: str = "is_duplicate boolean, match_type string, confidence double") -> Column:
    """The response as JSON, or the object in it that has is_duplicate; null if neither parses."""
    whole = F.when(F.trim(response).rlike(r"(?s)^\{.*\}$"), response)
    inner = _found(response, r'(?s)\{[^{}]*"is_duplicate"[^{}]*\}', 0)
    return F.from_json(F.coalesce(whole, inner), schema)


def last_json(text: str | None) -> str | None:
    """The last object whose braces balance, if it is JSON. Braces inside strings count, as they do in the answers' evaluation."""
    depth, start, found = 0, None, None
    for i, ch in enumerate(text or ""):
        if ch == "{":
            start = i if start is None else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                found, start = text[start : i + 1], None
    try:
        return json.dumps(json.loads(found.replace("\n", ""))) if found else None
    except json.JSONDecodeError:
        return None


_SOLUTION = re.compile(r'\{[\s\S]*"solution"[\s\S]*\}')
_HOUSE = re.compile(r'"(House \d+)":\s*\{([^}]+)\}')
_TRAIT = re.compile(r'"(\w+)":\s*"([^"]+)"')


def puzzle_solution(text: str | None) -> dict[str, dict[str, str]] | None:
    """The solution's houses from JSON in a response, else from whatever entries of houses it has."""
    if m := _SOLUTION.search(text or ""):
        try:
            whole = json.loads(re.sub(r"[\n\r]+", " ", m[0]))
            got = whole.get("solution", whole)
            if isinstance(got, dict):
                return {str(h): {str(k): str(v) for k, v in traits.items() if v is not None} for h, traits in got.items() if isinstance(traits, dict)}
        except json.JSONDecodeError:
            pass
    houses = {h: dict(_TRAIT.findall(body)) for h, body in _HOUSE.findall(text or "")}
    return {h: t for h, t in houses.items() if t} or None


def last_json_of(text: Column) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(last_json)

    return apply(text)


def puzzle_solution_of(text: Column) -> Column:
    @F.pandas_udf("map<string,map<string,string>>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(puzzle_solution)

    return apply(text)


def grid_as_map(header: Column, rows: Column) -> Column:
    """{header, rows} as a map `House i` to a map of trait to value; the first column, the house's number, is left out."""
    names = F.slice(header, F.lit(2), F.size(header))
    values = F.transform(rows, lambda r, i: F.struct(F.concat(F.lit("House "), (i + 1).cast("string")), F.map_from_arrays(names, F.slice(r, F.lit(2), F.size(r)))))
    return F.map_from_entries(values)


def cell_accuracy(predicted: Column, truth: Column) -> Column:
    """(correct, total) of a solution's cells, compared without case and outer blanks."""
    cells = F.flatten(F.transform(F.map_entries(truth), lambda h: F.transform(F.map_entries(h["value"]), lambda c: F.struct(h["key"].alias("h"), c["key"].alias("k"), c["value"].alias("v")))))
    right = F.filter(cells, lambda c: F.lower(F.trim(F.try_element_at(F.try_element_at(predicted, c["h"]), c["k"]))) == F.lower(F.trim(c["v"])))
    return F.struct(F.coalesce(F.size(right), F.lit(0)).alias("correct"), F.size(cells).alias("total"))


def substituted(solution: Column, plan: Column) -> Column:
    """A solution with its traits and values renamed by a map, whatever their case; what the plan lacks stays."""
    lowered = F.transform_keys(plan, lambda k, v: F.lower(k))
    new = lambda x: F.coalesce(F.try_element_at(plan, x), F.try_element_at(lowered, F.lower(x)), x)
    return F.transform_values(solution, lambda h, traits: F.map_from_entries(F.transform(F.map_entries(traits), lambda e: F.struct(new(e["key"]), new(e["value"])))))


_CLUES = re.compile(r"#{1,2} clues?:?[ \t]*\n\s*", re.I)
_NUMBERED = re.compile(r"\d+\.\s*")


def clues_shuffled(text: str | None, seed: int = 0) -> str | None:
    """A puzzle with its numbered clues in seeded order and numbered anew; lines that go on belong to their clue, what stands
    behind the clues stays. Unchanged without a heading of clues or without a clue."""
    heading = _CLUES.search(text or "")
    if not heading:
        return text
    lines = text[heading.end() :].split("\n")
    clues: list[list[str]] = []
    rest: list[str] = []
    for i, line in enumerate(lines):
        if m := _NUMBERED.match(line):
            clues.append([line[m.end() :]])
        elif clues and line.strip():
            clues[-1].append(line)
        elif clues and not any(_NUMBERED.match(later) for later in lines[i:]):
            rest = lines[i:]
            break
    if not clues:
        return text
    said = ["\n".join(c).strip() for c in clues]
    order = sorted(range(len(said)), key=lambda i: (hashlib.md5(f"{seed}:{i}:{said[i]}".encode("utf-8", "surrogatepass")).hexdigest(), i))
    numbered = "\n".join(f"{n}. {said[i]}" for n, i in enumerate(order, 1))
    tail = "\n".join(rest).strip()
    return text[: heading.end()] + numbered + ("\n" + tail if tail else "")


def shuffled_clues_of(text: Column, seed: int = 0) -> Column:
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clues_shuffled(t, seed))

    return apply(text)
