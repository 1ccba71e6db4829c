from pyspark.sql import functions as F

from checks import reports as rp
from somnotab.functions import text as tx
from somnotab.operators import labelling as lb
from somnotab.specs.exams import EXAMS


def test_phrase_searches_are_compiled(spark):
    """Spark interprets what stands inside ``array_compact``; the searches stand before it."""
    reports = spark.createDataFrame([(1, "/a", "doc", "x")], "doc_id long, path string, ext string, text string")
    plan = lb.label_and_slice(reports)._jdf.queryExecution().executedPlan().toString()
    compacted = [line for line in plan.split("\n") if "filter(" in line]
    assert "Contains(" in plan and compacted
    assert not any("Contains(" in line.split("filter(", 1)[1].split("lambda", 1)[0] for line in compacted)


def test_phrases_are_looked_for_where_the_opening_word_stands(spark):
    """One search of the text for the word; the same labels as a search for every phrase."""
    phrases = [phrase for exam in EXAMS for phrase in exam.phrases]
    texts = [None, "", "informe", "informe de polisomnografia", *phrases]
    for phrase in phrases:
        texts += [f"informe informe de {phrase}", f"informe{phrase}", f"{phrase[:-1]} {phrase[-1]}", f"{phrase} y {phrases[0]}"]
    keys = spark.createDataFrame([(t,) for t in texts], "key string")
    opened = keys.withColumn("opened", lb.label_openings(F.col("key")))
    both = opened.select(
        lb.label_hits(F.col("key")).alias("a"), lb.label_hits(F.col("key"), openings=F.col("opened")).alias("b")
    )
    assert both.where("not (a <=> b)").collect() == [] and both.where("exists(b, x -> x is not null)").count() >= len(phrases)
    reports = spark.createDataFrame([(1, "/a", "doc", "x")], "doc_id long, path string, ext string, text string")
    plan = lb.with_labels(reports)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contains(_key") == 1


def test_keys_are_the_same_with_and_without_replacements(spark):
    texts = ["informe abc", "informe İ ı ſ K", "informe º ÁÉ", "INFORME ñandú 😀"]
    rows = [(i, "/a", "doc", t) for i, t in enumerate(texts)]
    labelled = lb.with_labels(spark.createDataFrame(rows, "doc_id long, path string, ext string, text string"))
    key = tx.marker_key(tx.phrase_key(F.col("normal")))
    assert labelled.where("_marker_key is not null").count() == len(texts)
    assert labelled.where(~F.col("_marker_key").eqNullSafe(key)).collect() == []


def test_sections_equal_a_search_that_ignores_case(spark):
    """Letters that fold to i, s and k, signs beyond the basic plane, and markers that touch or lack."""
    pieces = ["Nombre ANA \U0001f600 ", "İıſK", " x "]
    texts = [None, "", "conclusion"]
    for exam in EXAMS:
        starts = [exam.start or "", "informe de polisomnografia basal con dispositivo mandibular"]
        for start in {s.replace("(?:de avance )?", "de avance ").replace("i?", "i") for s in starts}:
            for end in (exam.end, exam.end.upper(), exam.end.replace("i", "ı").replace("s", "ſ"), ""):
                texts += [p + start.replace("i", "İ") + m + end + "fin" + exam.end for p in pieces for m in (*pieces, "")]
    rows = spark.createDataFrame([(t,) for t in texts], "normal string")
    for exam in EXAMS:
        rest = F.col("normal") if exam.start is None else tx.text_after(F.col("normal"), f"(?:{exam.start})", "iU")
        long_search = F.trim(F.regexp_extract(rest, f"(?isU)\\A(.*?)(?:{exam.end})", 1))
        got = rows.select("normal", tx.slice_between(F.col("normal"), exam.start, exam.end).alias("a"), long_search.alias("b"))
        assert got.where("not (a <=> b)").collect() == []


def test_customers_are_spread_before_they_become_reports(spark, tmp_path):
    columns = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame([(1, "c#1", 1, 1.0, "BUILDING")], columns).write.parquet(f"{tmp_path}/customer.parquet")
    reports = rp.all_reports(spark, str(tmp_path))
    plan = reports._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Repartition", 1)[1]
    assert "Generate" not in below and reports.count() == len(rp.TEMPLATES)
