"""The shingle join against all pairs of plain Python sets."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from somnotab.llm import overlap

SCHEMA = "doc_id long, text string, lang string, source string, node long, key string, digest string, n int, size int"


def grams(text, width=3):
    words = [w for w in (text or "").encode().lower().split() if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def by_hand(rows, percent=90, width=3):
    """doc_id, set size, smallest id in reach, through all pairs of distinct sets."""
    members = defaultdict(list)
    for doc, text in rows:
        members[frozenset(grams(text, width))].append(doc)
    distinct = [s for s in members if s]
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(distinct)), 2):
        a, b = distinct[i], distinct[j]
        if 100 * len(a & b) >= percent * len(a | b):
            root[find(j)] = find(i)
    least = defaultdict(list)
    for i, s in enumerate(distinct):
        least[find(i)] += [d for d in members[s] if d is not None]
    name = {s: min(least[find(i)], default=None) for i, s in enumerate(distinct)}
    return sorted([(d, len(grams(t, width)), name.get(frozenset(grams(t, width)), d)) for d, t in rows], key=repr)


def joined(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "k", "d", 2, 3) for d, t in rows], SCHEMA)
    return sorted(map(tuple, overlap.groups(docs, **options).collect()), key=repr)


def edited(rng, words, edits, own="n"):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = f"{own}{rng.randrange(10**6)}"
        elif kind == 1:
            out.insert(at, f"{own}{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[at]
    return out


def families(rng, lengths, copies, edits):
    rows = []
    for k, n in enumerate(lengths):
        words = [f"f{k}w{rng.randrange(4 * n)}" for _ in range(n)]
        chain = words
        for c in range(copies):
            chain = edited(rng, chain if c % 3 == 0 else words, rng.choice(edits))
            rows.append(" ".join(chain))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_families_of_all_sizes(spark):
    """Lengths on both sides of every border, edits on both sides of the limit, chains of near copies."""
    rng = random.Random(1)
    lengths = [3, 8, 9, 10, 11, 12, 19, 20, 21, 30, 45, 49, 50, 52, 55, 60, 62, 63, 66, 90, 130, 400, 1500]
    rows = families(rng, lengths, 14, (0, 1, 1, 2, 3, 5, 12))
    want = by_hand(rows)
    linked = sum(doc != least for doc, _, least in want)
    assert 60 < linked < len(rows) - 60
    assert joined(spark, rows) == want


@pytest.mark.parametrize("percent", [80, 95])
def test_other_similarities(spark, percent):
    rng = random.Random(percent)
    rows = families(rng, [4, 5, 10, 20, 40, 49, 51, 61, 63, 80, 200], 12, (0, 1, 2, 3, 6, 9))
    assert joined(spark, rows, percent=percent, width=2) == by_hand(rows, percent, 2)


def test_bucket_of_many_strangers(spark, monkeypatch):
    """One template whose edits are mostly too far from its center and from each other: tiles must compare them."""
    monkeypatch.setattr(overlap, "BLOCK", 16)
    rng = random.Random(5)
    template = [f"t{rng.randrange(2000)}" for _ in range(240)]
    rows = []
    for i in range(260):
        words = list(template)
        for at in rng.sample(range(240), 2 if i % 10 == 0 else 5):
            words[at] = f"new{rng.randrange(40)}" if i % 2 else f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = by_hand(rows)
    assert 20 < len({least for *_, least in want}) < 240
    assert joined(spark, rows) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (None, "one"), (6, "one two"), (7, "one\x0b two "), (8, "two one")]
    rows += [(9, "a b c"), (9, "a b c"), (None, "x y z"), (None, "x y z"), (None, None), (10, "é É"), (11, "É é"), (12, "é É é")]
    rows += [(13, long), (14, long + " end"), (15, "w w w " * 20_000), (16, "W " * 40), (17, "y" * 200_000)]
    assert joined(spark, rows) == by_hand(rows)
    assert joined(spark, []) == []


@settings(max_examples=300, deadline=None)
@given(st.integers(9, 400), st.integers(0, 45), st.integers(0, 45), st.integers(0, 10**6), st.sampled_from([80, 90, 95]))
def test_linked_sets_share_a_bucket_and_pass(common, more, other, seed, percent):
    """The two conditions are necessary ones: no linked pair has disjoint buckets or is ruled out."""
    rng = np.random.default_rng(seed)
    drawn = overlap._mixed(rng.integers(0, 1 << 62, common + more + other, dtype=np.uint64))
    a, b = np.sort(drawn[: common + more]), np.sort(np.concatenate([drawn[:common], drawn[common + more :]]))
    if len(np.unique(drawn)) < len(drawn) or 100 * common < percent * len(drawn) or more + other == 0:
        return
    assert np.intersect1d(overlap.keys(a, percent), overlap.keys(b, percent)).size
    s, t = overlap.signature(a, percent), overlap.signature(b, percent)
    x = overlap._folded([s, t], min(len(s), len(t)))
    apart = int(np.bitwise_count(x[0] ^ x[1]).sum())
    assert apart <= more + other
    assert overlap._within(len(a), len(b), apart, percent)
