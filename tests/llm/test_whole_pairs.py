"""Long answers are judged by all of their words and letters, refusals and languages in wordings and tongues that no list holds."""

import pytest

from siltstone.llm import declines, language, pairs

PROMPT = "Write a function that returns the sum of all even numbers of a list."
SOUND = "def total(xs):\n    # {}\n    return sum(x for x in xs if x % 2 == 0)\n"


def test_the_script_is_that_of_all_letters():
    told = language.Profiles().language
    mixed = "".join("д" if i % 2 else "a" for i in range(800)) + "дд"  # 402 Cyrillic letters of 802; every second is Latin
    assert told(mixed) == "ru"
    assert told("д" * 7) is None and told("д" * 8) == "ru"


@pytest.mark.parametrize("filler", [0, 30, 400])
def test_refusals_of_any_length(filler):
    reasons = " ".join(f"Rule number {i} of the house speaks about such requests in detail." for i in range(filler))
    assert pairs.defect(PROMPT, f"I'm sorry, but I can't help with that. {reasons}".strip()) == "refusal"


@pytest.mark.parametrize(
    "answer, kind",
    [
        ("My guidelines keep me from answering that.", "refusal"),
        ("This is a task that I'd rather leave to you.", "refusal"),
        ("Diese Aufgabe möchte ich lieber nicht lösen.", "refusal"),
        ("Je ne souhaite pas répondre à cela.", "refusal"),
        ("# I cannot help with this request.", "refusal"),
        ("From my side, I must decline this request.", "refusal"),
        ("Unfortunately the list is unsorted, so sort it first. Then scan it once.", None),
        ("Go through the list and add the even numbers to the sum.", None),
        (SOUND.format("I can't use recursion here, so a loop does the work."), None),
        (SOUND.format("Sorry for the long name, I won't shorten it."), None),
        (SOUND.format("Vrátí součet všech sudých prvků seznamu"), "language"),
        (SOUND.format("Zwróć sumę wszystkich elementów listy"), "language"),
        (SOUND.format("Restituisce la somma di tutti gli elementi"), "language"),
        (SOUND.format("returns the sum of all the even numbers"), None),
        (SOUND.format("xs: list of int"), None),
    ],
)
def test_wordings_and_languages(answer, kind):
    assert pairs.defect(PROMPT, answer) == kind


def test_wordings_are_learnt_from_a_table():
    odd = [f"Thanks, yet this poor bot bows out of {w} today, as told by my rules, sorry." for w in ("counting", "sorting", "adding", "folding", "merging")] * 8
    judge = pairs.Judge([], [(PROMPT, t) for t in odd] + [(PROMPT, SOUND.format("adds the even ones"))] * 40)
    new = "Thanks, yet this poor bot bows out of adding today."
    assert judge.defect(PROMPT, new) == "refusal" and judge.declines.odds(new) > declines.Declines().odds(new)


def test_profiles_on_held_out_passages():
    """Halves of the passages: a profile fitted with the first half tells the second."""
    halves = {lang: (t[: len(t) // 2], t[len(t) // 2 :]) for lang, t in language.PASSAGES.items()}
    own, language.PASSAGES = language.PASSAGES, {lang: a for lang, (a, _) in halves.items()}
    try:
        told = language.Profiles()
    finally:
        language.PASSAGES = own
    got = {lang: told.language(b) for lang, (_, b) in halves.items()}
    assert sum(v == lang for lang, v in got.items()) >= 0.75 * len(got)
    assert all(v in (None, lang) for lang, v in got.items())
