"""Numbers, dates, units, derived columns, publication."""

import random
from datetime import date, datetime

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from somnotab.functions import casts, units
from somnotab.operators import casting, curation
from somnotab.plans import curation as plan
from somnotab.sources import sinks, tables
from somnotab.specs.curated import BASAL_CLASSES, FINAL_COLUMNS, MEASURES, ColumnClasses, measure

NUMBERS = ["12,5", "12.", ".", "1.234,5", "1d", "1f", "0x10", "0x1p3", " 12 ", "nan", "", "-3,5", "+2", "1e3", ".5", "inf", "-Infinity", "N/A", None]


def pandas_number(text):
    value = pd.to_numeric(pd.Series([str(text).replace(",", ".")]), errors="coerce").iloc[0]
    return None if pd.isna(value) else float(value)


def test_numbers(values):
    assert values(casts.to_double, NUMBERS) == [pandas_number(n) for n in NUMBERS]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="0123456789.,+-d ", max_size=8), min_size=40, max_size=60))
def test_numbers_equal_the_model(values, texts):
    for got, want in zip(values(casts.to_double, texts), [pandas_number(t) for t in texts]):
        assert got == want or (None not in (got, want) and got == pytest.approx(want, rel=1e-15))


DATES = [
    "05/03/2024", "05/13/2024", "2024-05-01", "2024-05-25", "2024/25/05", "05-03-24", "05/03/79",
    "31/02/2024", "N/A", "", None, "1/2/3", "99/05/01", "32/01/24", "60/01/02", "24/05/13",
    "13/13/2024", "05.03.2024", " 05/03/2024 10:30 ", "2024-05-01T10:00:00", "5/3/024",
    "005/03/2024", "0024/05/01", "1/05/0099", "00/00/2024", "31/12/75", "31/12/76", "31/12/49",
]


def pandas_date(text):
    value = pd.to_datetime(str(text).strip(), dayfirst=True, errors="coerce")
    return None if pd.isna(value) else value.date()


@pytest.mark.filterwarnings("ignore")
def test_dates(values):
    year = casts.current_year()
    got = values(lambda c: casts.to_date(c, year), DATES)
    assert got == [pandas_date(d) for d in DATES]


@pytest.mark.filterwarnings("ignore")
def test_dates_equal_the_model(values):
    draw = random.Random(5)
    texts = []
    for _ in range(800):
        mark = draw.choice("-/")
        day, month = draw.randint(0, 40), draw.randint(0, 15)
        year = draw.choice([draw.randint(1990, 2030), draw.randint(1600, 2300), draw.randint(0, 99)])
        parts = [draw.choice([f"{v:02d}", str(v)]) for v in (day, month)]
        order = [*parts, f"{year:02d}"] if draw.random() < 0.6 else [f"{year:02d}", *parts]
        texts.append(mark.join(order))
    got = values(lambda c: casts.to_date(c, casts.current_year()), texts)
    assert dict(zip(texts, got)) == {t: pandas_date(t) for t in texts}


def test_iso_dates(values):
    got = values(lambda c: casts.to_date(c, 2026, "iso"), ["2024-05-01", "05/03/2024", "2024-25-05"])
    assert got == [date(2024, 5, 1), date(2024, 3, 5), None]


def test_two_digit_years_follow_the_reference_year(values):
    assert values(lambda c: casts.to_date(c, 2020), ["01/01/69", "01/01/70"]) == [
        date(2069, 1, 1), date(1970, 1, 1),
    ]


def test_whole_numbers_fail_as_a_column(spark):
    frame = spark.createDataFrame([("1", "1,5", "5"), ("x", "2", None)], "a string, b string, c string")
    classes = ColumnClasses(integers=("a", "b", "c", "absent"))
    assert casting.fractional_columns(frame, ["a", "b", "c"]) == {"b"}
    typed = casting.cast_columns(frame, classes)
    assert typed.dtypes == [("a", "bigint"), ("b", "string"), ("c", "bigint")]
    assert typed.collect() == [(1, "1.5", 5), (None, "2", None)]
    report = {r["variable"]: r["status"] for r in casting.transform_report(typed, classes, {"b"}).collect()}
    assert report == {"a": "transformed", "b": "not_transformed", "c": "transformed", "absent": "not_found"}


def test_age(spark):
    frame = spark.createDataFrame([(1.0, 6.0, None), (None, None, None)], "y double, m double, d double")
    columns = [F.col(c) for c in "ymd"]
    loose = [r[0] for r in frame.select(units.age_in_years(*columns)).collect()]
    strict = [r[0] for r in frame.select(units.age_in_years(*columns, strict=True)).collect()]
    assert loose == [1.5, 0.0] and strict == [1.5, None]


@pytest.mark.parametrize("name", [m.name for m in MEASURES])
def test_units(spark, name):
    m = measure(name)
    known = [(u, s.times / s.over) for s in m.scales for u in s.units]
    rows = [(2.0, f" {u.upper()} ") for u, _ in known] + [(2.0, "pie"), (2.0, None), (None, known[0][0])]
    frame = spark.createDataFrame(rows, "v double, u string")
    got = [r[0] for r in frame.select(units.convert(F.col("v"), units.clean_unit(F.col("u")), m)).collect()]
    assert got == [2.0 * f for _, f in known] + [None, None, 0.0 if m.null_is_zero else None]


def unified(spark, **changes):
    base = {c: "1" for c in (*BASAL_CLASSES.strings, *BASAL_CLASSES.doubles)}
    base |= {"fecha_estudio": "05/03/2024", "medida_peso": "Kg", "medida_talla": "a"}
    base |= {"medida_cuello": "pulg", "medida_perimetro_abdominal": ".ccm", "talla": None, "otra": "z"}
    return spark.createDataFrame([tuple({**base, **changes}.values())], ", ".join(f"{c} string" for c in {**base, **changes}))


NOW = datetime(2026, 1, 15, 10, 30)


def test_curated_table(spark):
    curated = plan.curate(unified(spark), NOW)
    assert curated.columns == [*FINAL_COLUMNS, "version_control"]
    row = curated.first()
    assert row["version_control"] == "Extraido en: 2026-01-15 : 10:30:00"
    assert row["fecha_estudio"] == date(2024, 3, 5)
    assert (row["peso_kg"], row["talla_cm"], row["cuello_cm"], row["perimetro_abdominal_cm"]) == (1.0, 0.0, None, 1.0)
    types = dict(curated.dtypes)
    assert {types[c] for c in BASAL_CLASSES.doubles if c in types} == {"double"}
    assert "Exchange" not in curated._jdf.queryExecution().executedPlan().toString()


def test_curated_table_with_its_reports(spark):
    frame = unified(spark, medida_talla="varas")
    result = plan.curate_with_reports(frame, NOW)
    assert result.table.collect() == plan.curate(frame, NOW).collect()
    status = {r["variable"]: (r["type"], r["status"]) for r in result.transformed.collect()}
    assert status["fecha_estudio"] == ("datetime", "transformed") and status["peso"][0] == "float"
    assert ("talla", "varas", 1) in {(r["measure"], r["unit"], r["n"]) for r in result.unknown_units.collect()}
    assert [(r["month"], r["n"]) for r in result.months.collect()] == [(date(2024, 3, 1), 1)]
    lines = {r["variable"]: r for r in result.profile.collect()}
    assert list(lines) == result.table.columns and lines["talla_cm"]["type"] == "double"
    result.discard()


def test_missing_final_column_is_an_error(spark):
    with pytest.raises(AnalysisException):
        plan.curate(unified(spark).drop("imc"), NOW)


def test_unknown_units(spark):
    frame = curation.with_clean_units(unified(spark, medida_talla="MTS", medida_peso=None))
    got = {(r["measure"], r["unit"], r["n"]) for r in curation.unknown_units(frame).collect()}
    assert got == {("talla", "mts", 1), ("cuello", "pulg", 1)}


def test_percentages_must_be_numbers(spark):
    with pytest.raises(ValueError):
        curation.check_percent_columns(("t90", "nombre"), BASAL_CLASSES.doubles)


def test_publication(spark, tmp_path):
    curated = plan.curate(unified(spark, t90="5,5"), NOW)
    for _ in range(2):
        plan.publish(curated, str(tmp_path))
    data = spark.read.parquet(f"{tmp_path}/data")
    assert data.count() == 1 and data.first()["t90"] == 0.055
    assert curated.first()["t90"] == 5.5
    formats = {r["column"]: (r["position"], r["type"], r["pattern"]) for r in spark.read.json(f"{tmp_path}/formats").collect()}
    assert formats["nombre"] == (0, "TEXT", "@")
    assert formats["t90"] == (25, "PERCENT", "0.00%")
    assert formats["imc"] == (2, "NUMBER", "0.00")
    assert formats["fecha_estudio"] == (5, "DATE", "yyyy-mm-dd")
    assert "peso_kg" not in formats and "version_control" not in formats


def test_row_identifiers(spark):
    frame = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None)], "x string, y string")
    first = [r["uuid"] for r in curation.row_uuid(frame, ["x", "y"]).collect()]
    assert first == [r["uuid"] for r in curation.row_uuid(frame, ["x", "y"]).collect()]
    assert len(set(first)) == 3
    drawn = [r["uuid"] for r in curation.row_uuid(frame).collect()]
    assert len(set(drawn)) == 3 and all(len(u) == 36 and u[14] == "4" for u in drawn + first)


def test_result_files_are_unified(spark, tmp_path):
    first, second, output = (f"{tmp_path}/{n}.csv" for n in ("a", "b", "unificado"))
    write = lambda f, p: sinks._csv(f, "append").csv(p)
    write(spark.createDataFrame([("0012", "N/A", 'con "comillas", y coma')], "id string, x string, y string"), first)
    write(spark.createDataFrame([("z", "7", " s ")], "extra string, id string, y string"), second)
    for _ in range(2):
        frame = plan.unify_files(spark, [first, second, output][: 3], output)
        rows = {r["id"]: r.asDict() for r in frame.collect()}
        assert rows["0012"]["x"] is None and rows["0012"]["extra"] is None
        assert rows["0012"]["y"] == 'con "comillas", y coma'
        assert rows["7"]["extra"] == "z" and len(rows["7"]["uuid"]) == 36
        assert len(rows) == 2


def test_mixed_headers_line_ends_and_spellings(spark, tmp_path):
    folder, output = f"{tmp_path}/a b.csv", f"{tmp_path}/unificado.csv"
    write = lambda rows, names: sinks._csv(spark.createDataFrame(rows, names), "append").csv(folder)
    write([("1", "70", "170")], "id string, peso string, talla string")
    write([("2", "180", "80"), ("3", "one\ntwo", "90")], "id string, talla string, peso string")
    for spelling in (output, f"file:{output}", f"file://{output}/"):
        frame = plan.unify_files(spark, [folder, spelling], output, keys=["id"], multi_line=True)
        rows = {r["id"]: (r["peso"], r["talla"]) for r in frame.collect()}
        assert rows == {"1": ("70", "170"), "2": ("80", "180"), "3": ("90", "one\ntwo")}


def test_null_and_blank_keys_differ(spark):
    frame = spark.createDataFrame([(None,), ("",), ("a",)], "x string")
    assert len({r["uuid"] for r in curation.row_uuid(frame, ["x"]).collect()}) == 3


def test_null_texts(spark):
    texts = ["NA", "None", "null", "NULL", "n/a", "#N/A", "<NA>", "N/A", "-", "na", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    kept = [r["x"] for r in tables.null_texts_to_null(frame).collect() if r["x"] is not None]
    assert kept == ["-", "na"]
