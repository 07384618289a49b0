"""Problem 9: one consistent form for texts that look the same in different characters.

Pairs of strings or code points that look alike are joined to transitive classes by union-find. The most
frequent member of a class stands for it. Texts are decomposed canonically, rewritten greedily (leftmost,
longest) with an Aho-Corasick automaton of all other members, and composed again.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.classes import in_blocks, pairs_across, pairs_within
from siltstone.runtime import materialize, spread

# Letters of Latin, Cyrillic and Greek that are drawn alike, one class a word, after the public table of confusable characters of
# Unicode Technical Standard 39; single-script classes of it and those that are told apart at a look (as α and a) are left out.
LETTER_CLASSES = (
    "AАΑ BВΒ CСϹ EЕΕ FϜ GԌ HНΗ IІΙӀ JЈͿ KКΚ MМΜϺ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YУΥҮ ZΖ ГΓ ЛΛ ПΠ ФΦ ƐԐ ƏӘ ƟӨ ƷӠ ÐĐƉ "
    "aа cсϲ eе hһ iі jјϳ oоο pрρ sѕ vνѵ xх yу qԛ wԝ dԁ lӏ кκĸ ɛεԑ ɑα əә ɵө ʒӡ ɔͻ µμ"
).split()
# Characters without width that aren't of Unicode's category Cf.
WIDTHLESS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤ" + "".join(chr(c) for c in range(0xFE00, 0xFE10))
# Characters of the category Cf that are seen all the same (Unicode's property Prepended_Concatenation_Mark).
SEEN = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
#: Blocks of Unicode that hold full-width forms and ligatures of letters.
COMPATIBLE = ((0x80, 0x3001), (0xA720, 0xAC00), (0xFB00, 0xFB50), (0xFF00, 0xFFF0))


def compatible_pairs() -> list[tuple[str, str]]:
    """Full-width forms, and digraphs and ligatures of letters with what they are drawn from, by Unicode's own compatibility forms."""
    out = []
    for ch in (chr(code) for a, b in COMPATIBLE for code in range(a, b)):
        kind, _, parts = unicodedata.decomposition(ch).partition(" ")
        plain = unicodedata.normalize("NFKC", ch)
        if kind == "<wide>" and ch != "\u3000":
            out.append((chr(int(parts, 16)), ch))
        elif kind == "<compat>" and len(plain) > 1 and all(unicodedata.category(x).startswith("L") for x in ch + plain):
            out.append((plain, ch))
    return out


def look_alike_pairs() -> list[tuple[str, str]]:
    """The pairs that the classes grow from: letters, ligatures, full-width forms and space characters."""
    pairs = [(word[0], other) for word in LETTER_CLASSES for other in word[1:]]
    pairs += compatible_pairs()
    pairs += [(" ", chr(code)) for code in range(0x80, 0x3001) if unicodedata.category(chr(code)) == "Zs"]
    return pairs


def classes(pairs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Transitive classes of the pairs, by union-find with path halving."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        # what decomposes canonically is met only in its parts
        a, b = find(unicodedata.normalize("NFD", a)), find(unicodedata.normalize("NFD", b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    members: dict[str, list[str]] = {}
    for x in parent:
        members.setdefault(find(x), []).append(x)
    return [sorted(m) for m in members.values() if len(m) > 1]


def rewrite_table(groups: list[list[str]], frequency: dict[str, int]) -> dict[str, str]:
    """For each member that gives way, what it becomes. A spelled-out string stands before its ligatures, whatever
    the frequencies, and its letters are rewritten themselves, so that a second rewriting changes nothing."""
    single: dict[str, str] = {}
    spelled: dict[str, str] = {}
    for group in groups:
        longest = max(len(m) for m in group)
        stands = min((m for m in group if len(m) == longest), key=lambda m: (-frequency.get(m, 0), m))
        (single if longest == 1 else spelled).update({m: stands for m in group if m != stands})
    table = dict(single)
    for member, stands in spelled.items():
        table[member] = "".join(single.get(ch, ch) for ch in stands)
    return table


class Rewriter:
    def __init__(self, table: tuple[tuple[str, str], ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for member, stands in table:
            self.automaton.add_word(member, (len(member), stands))
        self.empty = not table
        if table:
            self.automaton.make_automaton()

    @staticmethod
    def visible_parts(text: str) -> str:
        """Without characters that have no width."""
        if text.isascii():
            return text
        drop = {ch for ch in set(text) if ch > "\x7f" and (ch in WIDTHLESS or (unicodedata.category(ch) == "Cf" and ch not in SEEN))}
        return text.translate({ord(ch): None for ch in drop}) if drop else text

    def __call__(self, text: str) -> str:
        text = unicodedata.normalize("NFD", self.visible_parts(text))
        if self.empty:
            return unicodedata.normalize("NFC", text)
        out, done = [], 0
        for end, (length, stands) in self.automaton.iter_long(text):
            out += (text[done : end + 1 - length], stands)
            done = end + 1
        out.append(text[done:])
        return unicodedata.normalize("NFC", "".join(out))


@lru_cache(maxsize=4)
def rewriter(table: tuple[tuple[str, str], ...]) -> Rewriter:
    return Rewriter(table)


def member_counts(df: DataFrame, text: str, members: list[str]) -> dict[str, int]:
    """How often each member occurs in all texts. Each partition sends one row a member; the result is as long as the table of members."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        letters = [m for m in members if len(m) == 1]
        strings = [m for m in members if len(m) > 1]
        for batch in batches:
            for t in batch["text"]:
                if t:
                    t = unicodedata.normalize("NFD", Rewriter.visible_parts(t))
                    seen = Counter(t)
                    total.update({m: seen[m] for m in letters if m in seen})
                    total.update({m: t.count(m) for m in strings})
        if total:
            yield pd.DataFrame({"member": list(total), "n": [int(v) for v in total.values()]})

    counted = df.select(F.col(f"`{text}`").alias("text")).mapInPandas(count, "member string, n long")
    return {r["member"]: r["n"] for r in counted.groupBy("member").agg(F.sum("n").alias("n")).collect()}


def fitted_table(df: DataFrame, text: str = "text", pairs: Iterable[tuple[str, str]] | None = None) -> tuple[tuple[str, str], ...]:
    """The rewrite table of a corpus, with representatives by their frequency in all its texts."""
    groups = classes(pairs if pairs is not None else look_alike_pairs())
    # a spelled-out string stands whatever the frequencies, unless there is another of its length
    decided = [[m for m in g if len(m) == max(map(len, g))] for g in groups]
    frequency = member_counts(df, text, [m for g in decided if len(g) > 1 for m in g])
    return tuple(sorted(rewrite_table(groups, frequency).items()))


def consistent_form(df: DataFrame, text: str = "text", out: str = "form", table: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """df with the consistent form of its texts as column out.

    Null stays null and empty stays empty; case, digits, punctuation, line ends and accents are kept; very long texts
    take time in proportion; repeated rows stay; an empty table gives an empty result; other columns pass through,
    but a column already named out is replaced.
    """
    fixed = fitted_table(df, text) if table is None else table

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        rewrite = rewriter(fixed)
        return pd.Series([rewrite(t) if t is not None else None for t in texts], dtype=object)

    return df.withColumn(out, form(F.col(f"`{text}`")))


def looks(df: DataFrame, key: str, text: str, pairs: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(key, form, string): digests of the consistent form and of the text of each row with a visible character."""
    # aliases of its own: the input may have columns of these names
    source = spread(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull()))
    fixed = fitted_table(source, "text", pairs)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = rewriter(fixed)
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            keys, forms, strings = [], [], []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                form = rewrite(t)
                if any(not ch.isspace() and unicodedata.category(ch) != "Cc" for ch in form):
                    keys.append(k)
                    forms.append(digest(form))
                    strings.append(digest(t))
            if keys:
                yield pd.DataFrame({"key": pd.Series(keys, dtype=batch["key"].dtype), "form": forms, "string": strings})

    key_type = source.schema["key"].dataType.simpleString()
    return materialize(source.mapInPandas(digests, f"key {key_type}, form binary, string binary"))


def same_looking_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", pairs: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of rows whose texts differ as strings and have one consistent form.

    Copies of one string are never paired with each other: the strings of a form are paired first, then each
    side is expanded to its rows, both in blocks, so that a string of which a third of all rows are copies costs only the rows of
    the result. Null texts and texts without a visible character are in no pair; keys are taken as unique;
    ties don't arise; an empty table gives an empty result; other columns are ignored.
    """
    rows = looks(df, key, text, pairs)
    strings = rows.select(F.col("form").alias("cls"), F.col("string").alias("key")).distinct()
    linked = materialize(pairs_within(in_blocks(strings)).select(F.col("ka").alias("a"), F.col("kb").alias("b")))
    found = pairs_across(linked, in_blocks(rows.select(F.col("string").alias("cls"), "key")))
    return found.select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"))


def same_looking_classes(df: DataFrame, key: str = "doc_id", text: str = "text", pairs: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """(key, class_id, links): of each row with a visible character the least key of those that look the same, and with how many other strings
    its text has its look in common. Rows without a visible character and null texts are left out; other cases as for the pairs."""
    rows = looks(df, key, text, pairs)
    strings = rows.groupBy("form", "string").agg(F.min("key").alias("least"))
    classes = strings.groupBy("form").agg(F.min("least").alias("class_id"), (F.count(F.lit(1)) - 1).alias("links"))
    return rows.join(classes, "form").select(F.col("key").alias(key), "class_id", "links")
