"""The source mix repeats whole rows, and rows that share an id are rows of their own."""

import random
from collections import Counter

import pytest

from somnotab.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def mixed(spark, rows):
    docs = spark.createDataFrame([(i, t, lang, s, len(t)) for i, t, lang, s in rows], SCHEMA)
    goals = {r["source"]: r["target"] for r in mixing.targets(mixing.measured(docs, "doc_id", "text", "source")).collect()}
    return goals, [tuple(r) for r in mixing.sampled(docs).collect()]


def test_rows_stay_whole(spark):
    rng = random.Random(2)
    rows = [(None if k % 3 == 0 else k // 2, f"{k}  " + "w\t" * rng.choice([4, 4, 9, 30]), "en", s) for s in "abcde" for k in range(60)]
    goals, got = mixed(spark, rows)
    known = {(i, t, lang, s, len(t)) for i, t, lang, s in rows}
    times = Counter(got)
    assert set(times) <= known and max(times.values()) <= mixing.MAX_EPOCHS
    for source, target in goals.items():
        words = sum(len(t.split()) for _, t, _, s, _ in got if s == source)
        assert words == pytest.approx(target, abs=15.5)  # half of the longest text, and half a word
        own = [n for row, n in times.items() if row[3] == source]
        assert max(own) - min(own) <= 1  # none is repeated more than once more than another


def test_rows_of_no_id_are_not_divided(spark):
    # Source b takes two of seven words: a part of its rows, never a part of each.
    rows = [(None, f"word{k} of b", "en", "b") for k in range(70)] + [(None, f"word{k} of a", "en", "a") for k in range(70)]
    goals, got = mixed(spark, rows)
    assert all(len(t.split()) == 3 for _, t, *_ in got)
    for source in "ab":
        assert sum(s == source for *_, s, _ in got) == round(goals[source] / 3)


def test_alike_rows_share_without_loss(spark):
    rows = [(1, "one two", lang, "b") for lang in ("x", "y", "y", "z", "w")] + [(2, "one two", "x", "a")] * 5
    goals, got = mixed(spark, rows)
    times = Counter(s for *_, s, _ in got)
    assert times == {s: int(goals[s] / 2 + 0.5) for s in "ab"}
