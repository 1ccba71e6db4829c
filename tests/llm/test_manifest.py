"""The manifest against trees built in one place."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from somnotab.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, pos long, tree string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    for level in levels[:-1]:
        begin = i - i % 3
        yield "".join(level[begin:i]), "".join(level[i + 1 : begin + 3])
        i //= 3


def by_hand(rows):
    sources = defaultdict(list)
    for row in rows:
        text = row[1]
        tamper = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        claim = text.replace("\n", "") if tamper and text is not None else text
        sources[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, text), leaf(row, claim), row[0]))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    lower = {s: tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    upper = tree([lower[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, (_, _, made, claim, doc) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = [*way(lower[s], i), *way(upper, k)]
            for a, b in steps:
                claim = sha(a + claim + b)
            root = upper[-1][0]
            yield doc, made, lower[s][-1][0], root, sha("".join(a + b for a, b in steps)), claim, claim == root


def documents(spark, rows):
    return spark.createDataFrame([(*r, "d", 3, "t", 1) for r in rows], SCHEMA)


def checked(spark, rows):
    found = manifest.manifest(documents(spark, rows), manifest.even_checksum(F.col("doc_id"))).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(by_hand(rows), key=repr)
    return found


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "", 0),
    (3, "line\nline\n", "en", "a", 10),
    (4, "one", "en", "a", 3),
    (4, "one", "en", "a", 3),
    (4, "one\n", "en", "a", 3),
    (None, "two\nwords", None, None, 1),
    (None, "two\nwords", None, None, 1),
    (5, "long\n" * 60_000, "es", "é", -1),
    (6, "-", "-", "=", 1),
    (-7, "\n", "漢", "Z", 1),
]


def test_odd_rows(spark):
    assert {r["verified"] for r in checked(spark, ODD)} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [1, 1], [3, 1], [2187], [2188, 1, 4], [6600, 9, 2, 2, 2, 2, 2, 2, 2, 1]])
def test_sizes_around_superblocks(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6), f"t{rng.random()}\n", "en", f"s{s}", i) for s, n in enumerate(sizes) for i in range(n)]
    checked(spark, rows)


def test_small_superblocks_and_many_sources(spark, monkeypatch):
    """Superblocks of nine nodes give several layers in both trees."""
    monkeypatch.setattr(manifest, "DEPTH", 2)
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.choice(["a\n", "b", None]), "en", f"s{rng.randrange(40) ** 2 // 40}", 1) for _ in range(900)]
    # A third of the table is one and the same row.
    checked(spark, rows + [(11, "copy\n", "en", "hot", 5)] * 450)


def test_untouched_rows_are_verified(spark):
    rows = manifest.manifest(documents(spark, ODD)).collect()
    assert all(r["verified"] for r in rows) and len(rows) == len(ODD)


def test_empty_table(spark):
    assert manifest.manifest(documents(spark, ODD).limit(0)).collect() == []
