"""Fill-in-the-middle against a plain rewriting over Python's code points."""

import hashlib
import random

from pyspark.sql import functions as F

from somnotab.llm import middles

SCHEMA = "doc_id long, text string, n long, form string, output string"


def by_hand(doc, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def odd_texts():
    rng = random.Random(8)
    letters = "ab \n\r\u0085 é́漢𝄞👩‍👧<>PSM$\\{}0"
    texts = [None, "", " ", "x", "𝄞", "has <P> inside", "<S>", "a<M>b", "$1\\1", "\n\n", "<" * 50, "P>" * 40]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (1023, 1024, 1025, 2048, 3000)]
    return texts + ["words and 𝄞 " * 100_000, "\n" * 1_500_000]


def test_against_code_points(spark):
    rows = [(i, t, 5, "x", "y") for i, t in enumerate(odd_texts())]
    rows += [(None, "no id", 0, "", ""), (None, "no id", 0, "", ""), (7, "again", 1, "", ""), (7, "again", 1, "", "")]
    found = middles.transform(spark.createDataFrame(rows, SCHEMA))
    texts = found.select("*", middles.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(texts) == len(rows)
    want = sorted([(r[0], *by_hand(r[0], r[1])) for r in rows], key=repr)
    assert sorted([tuple(r)[:6] for r in texts], key=repr) == want
    assert sorted(r["back"] for r in texts) == sorted(r[1] or "" for r in rows)
    assert {r["form"] for r in texts} == {"plain", "spm", "psm"}
    report = middles.report(found).collect()
    assert all(len(r["output_sha256"]) == 64 for r in report)


def test_other_units(spark):
    """Units of three letters: the parts are whole units, what no unit matches stays in the suffix."""
    frame = spark.createDataFrame([(i, "abcdefghij" * i) for i in range(60)], "doc_id long, text string")
    for r in middles.transform(frame, unit="[a-z]{3}").collect():
        assert r["n"] == 10 * r["doc_id"] // 3
        if r["form"] == "psm":
            assert r["output"].index("<S>") - 3 == 3 * r["prefix_chars"]
            assert len(r["output"]) - r["output"].index("<M>") - 3 == 3 * r["middle_chars"]


def test_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert middles.transform(empty).count() == 0
    plan = middles.report(middles.transform(empty))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
