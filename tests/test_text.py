"""Normal form, labels, slices."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from somnotab.functions import text as tx
from somnotab.operators import labelling as lb
from somnotab.specs.exams import EXAMS, HINT_WORDS


def python_normal(text):
    folded = text.translate(str.maketrans(tx.FOLDED_FROM, tx.FOLDED_TO))
    return re.sub(r"\s+", " ", folded).strip()


def test_only_twelve_letters_are_folded(values):
    assert values(tx.fold_accents, ["áéíóúÁÉÍÓÚñÑ", "üçàÜ"]) == ["aeiouAEIOUnN", "üçàÜ"]


def test_every_kind_of_whitespace_collapses(values):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"a{s}b" for s in spaces] + [f" {s}a {s}{s}b{s}" for s in spaces] + ["", " \n "]
    assert values(tx.normalize, texts) == [python_normal(t) for t in texts]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aáÑ \t\n  \x1cü|", max_size=30), min_size=20, max_size=40))
def test_normal_form_equals_the_model(values, texts):
    assert values(tx.normalize, texts) == [python_normal(t) for t in texts]


def test_key_is_as_long_as_the_text(values):
    texts = ["İstanbul ÀÉ Σας ß K", "INFORME"]
    assert [len(k) for k in values(tx.phrase_key, texts)] == [len(t) for t in texts]


def test_hint_words_cover_all_phrases():
    for exam in EXAMS:
        for phrase in exam.phrases:
            assert any(word in phrase.split() for word in HINT_WORDS), phrase


def test_hint_pattern_misses_no_spelling(values):
    """Whatever folds to a hint word is found in the raw text."""
    spelled = ["informe", "INFORME", "ínfórmé", "IÑFÓRMÉ", "İnforme", "estadisticas", "ESTADÍSTICAS", "éstádístícás"]
    near = ["infome", "inform", "informa", "in forme", "estadistica s", ""]
    pattern = tx.unfolded_pattern(HINT_WORDS)
    assert values(lambda c: c.rlike(pattern), spelled + near) == [True] * 8 + [False] * 6
    keys = values(lambda c: tx.phrase_key(tx.normalize(c)), spelled)
    assert all(any(word in key for word in HINT_WORDS) for key in keys)


def reports(spark, texts, ext="doc"):
    rows = [(i, f"/r/{i}", ext, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, path string, ext string, text string")


def labels(spark, texts):
    rows = lb.with_labels(reports(spark, texts)).orderBy("doc_id").collect()
    return [r["labels"] for r in rows]


def test_labels(spark):
    texts = [
        "ÍNFORME  de\nPolisomnografía basal",
        "informe de polisomnografia en titulacion de CPAP",
        "informe de polisomnografia basal con dispositivo de avance mandibular",
        "informe de polisomnografia basal con dispositivo mandibular",
        "informe de polisomnografia en titulacion de bpap",
        "informe de polisomnografia en titulacion de bipap",
        "ESTADÍSTICAS DIARIAS",
        "informe de capnografía y estadisticas diarias",
        "informe de titulacion con auto cpap",
        "informe poligrafia respiratoria",
        "informe de otra cosa",
        "nada",
        "",
        None,
    ]
    assert labels(spark, texts) == [
        ["BASAL"], ["CPAP"], ["BASAL", "DAM"], ["BASAL", "DAM"], ["BPAP"], ["BPAP"],
        ["ACTIGRAFIA"], ["ACTIGRAFIA", "CAPNOGRAFIA"], ["AUTOCPAP"], ["POLIGRAFIA"],
        ["DESCONOCIDO"], ["DESCONOCIDO"], ["DESCONOCIDO"], None,
    ]


def python_slice(text, start, end):
    first = re.search(start, text, re.S | re.I)
    if not first:
        return None
    rest = text[first.end() :]
    last = re.search(end, rest, re.S | re.I)
    return (rest[: last.start()].strip() or None) if last else None


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["ini", "INI", "fin", "x", "y", "|"]), max_size=9).map(" ".join), min_size=20, max_size=40))
def test_slice_equals_the_model(values, texts):
    for start, pattern in (("ini", "ini"), (None, "^")):
        got = values(lambda c: tx.blank_to_null(tx.slice_between(c, start, "fin")), texts)
        assert got == [python_slice(t, pattern, "fin") for t in texts]


def test_statuses(spark):
    basal = "Informe de polisomnografia basal X Saturacion O2 minima durante el sueno"
    rows = [
        (1, "/a", "doc", basal), (2, "/b", "DOCX", basal), (3, "/c", "pdf", basal),
        (4, "/d", "rtf", None), (5, "/e", "rtf", "hola"),
        (6, "/f", "rtf", "informe de polisomnografia basal sin fin"),
        (7, "/g", "rtf", "saturacion o2 minima durante el sueno informe de polisomnografia basal"),
        (8, "/h", "rtf", "informe de polisomnografia basal  saturacion o2 minima durante el sueno"),
        (9, "/i", None, basal),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, path string, ext string, text string")
    got = {r["doc_id"]: r["status"] for r in lb.label_and_slice(frame).collect()}
    assert got == {
        1: "ok", 2: "no_extractor", 3: "unsupported_ext", 4: "unreadable", 5: "unknown_type",
        6: "no_slice", 7: "no_slice", 8: "no_slice", 9: "unsupported_ext",
    }


def test_first_non_empty_group(values):
    pattern = r"(?i)a(\d*)|b(\d+)"
    assert values(lambda c: tx.first_group(c, pattern, 2), ["a1", "b2", "a b3", "c", None]) == [
        "1", "2", None, None, None,
    ]


def test_before_last(values):
    texts = ["uno talla dos talla tres", "sin", "talla", ""]
    assert values(lambda c: tx.text_before_last(c, "talla", "U"), texts) == ["uno talla dos ", "", "", ""]
    assert values(lambda c: tx.text_before_last(c, "TALLA", "iU"), texts) == ["uno talla dos ", "", "", ""]


def test_plan_normalises_once_and_does_not_shuffle(spark):
    frame = lb.label_and_slice(reports(spark, ["x"])).where("status = 'ok'")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 1
    assert "Exchange" not in plan


def test_slice_is_linear_without_an_end(spark):
    """Twice the text takes about twice the time, however often the opening words repeat."""
    import time

    from somnotab.functions.text import slice_between

    def seconds(n):
        rows = spark.createDataFrame([("estadisticas diarias " + "fecha " * n,)], "x string")
        start = time.perf_counter()
        assert rows.select(slice_between(F.col("x"), "fecha", "conclusiones")).first()[0] == ""
        return time.perf_counter() - start

    seconds(10)
    assert seconds(200_000) < 5
