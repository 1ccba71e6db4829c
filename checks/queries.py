"""Queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import reports as rp
from somnotab.functions import casts, units
from somnotab.functions import text as tx
from somnotab.operators import (
    audit as au,
    casting,
    curation,
    extraction,
    ingest,
    inventory,
    labelling,
    profile,
    schema,
    search,
    workbook,
)
from somnotab.plans import curation as curation_plan
from somnotab.plans import profiles
from somnotab.plans.extraction import extracted_reports
from somnotab.session import checkpoint_root
from somnotab.sources import tables, warehouse
from somnotab.specs import workbook as wb
from somnotab.specs.curated import MEASURES, ColumnClasses, measure
from somnotab.specs.exams import EXAMS, EXTRACTORS, READABLE, extractor_for

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# A fixed clock, so that results do not depend on the day of the run.
NOW = datetime(2026, 1, 15, 10, 30, 0)


def check(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def register(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- text ---------------------------------------------------------------------------------

_SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _normal_sql(column: str) -> str:
    folded = f"translate({column}, '{tx.FOLDED_FROM}', '{tx.FOLDED_TO}')"
    return f"trim(regexp_replace({folded}, '{_SPACES}', ' ', 'g'))"


@check("normalize_text", f"select doc_id, {_normal_sql('text')} as normal from documents")
def normalize_text(spark, folder):
    documents = table(spark, folder, "documents")
    return labelling.with_normal_text(documents.select("doc_id", "text"))


def _document_labels_sql() -> str:
    rules = " union all ".join(
        f"select doc_id, '{exam.label}' as exam_type from n where "
        + " or ".join(f"regexp_matches(normal, '{phrase}', 'i')" for phrase in exam.phrases)
        for exam in EXAMS
    )
    return (
        f"with n as (select doc_id, {_normal_sql('text')} as normal from documents),"
        f" hits as ({rules}) select doc_id, exam_type from hits union all"
        " select doc_id, 'DESCONOCIDO' from n where doc_id not in (select doc_id from hits)"
    )


@check("classify_documents", _document_labels_sql())
def classify_documents(spark, folder):
    documents = table(spark, folder, "documents").select(
        "doc_id", F.lit("doc").alias("ext"), "text"
    )
    labelled = labelling.with_labels(documents)
    return labelling.explode_labels(labelled).select("doc_id", "exam_type")


_EXPECTED_LABELS = ", ".join(
    f"({i}, 0, 'BASAL', 'no_slice'), ({i}, 1, 'DAM', 'ok')"
    if t.exam == "DAM"
    else f"({i}, 0, '{t.exam}', 'ok')"
    for i, t in enumerate(rp.TEMPLATES)
)


@check(
    "classify_labels",
    f"select c_custkey * 100 + i as doc_id, label_pos, exam_type, status from customer,"
    f" (values {_EXPECTED_LABELS}) as kinds(i, label_pos, exam_type, status)",
)
def classify_labels(spark, folder):
    slices = labelling.label_and_slice(rp.all_reports(spark, folder))
    return slices.select("doc_id", "label_pos", "exam_type", "status")


_STARTS = {
    "BASAL": "INFORME DE POLISOMNOGRAFIA BASAL",
    "CPAP": None,
    "DAM": "INFORME DE POLISOMNOGRAFIA BASAL CON DISPOSITIVO DE AVANCE MANDIBULAR",
    "BPAP": "INFORME DE POLISOMNOGRAFIA EN TITULACION DE BPAP",
    "ACTIGRAFIA": "Fecha",
    "CAPNOGRAFIA": "Informe de Capnografia",
    "AUTOCPAP": None,
    "POLIGRAFIA": None,
}
_ENDS = {
    "BASAL": "Saturacion O2 Minima durante el sueno",
    "CPAP": "CONCLUSIONES",
    "DAM": "Conclusion",
    "BPAP": "CONCLUSIONES",
    "ACTIGRAFIA": "Estadisticas Diarias",
    "CAPNOGRAFIA": "Conclusion",
    "AUTOCPAP": "Informe de cumplimiento",
    "POLIGRAFIA": "Indicacion del estudio",
}


def _by_label(values: dict[str, str | None]) -> str:
    cases = " ".join(
        f"when {i} then {repr(values[e.label]) if values[e.label] is not None else 'null'}"
        for i, e in enumerate(EXAMS)
    )
    return f"case c_custkey % 8 {cases} end"


_MIDDLE = "case when c_custkey % 7 = 0 then '' else c_name || ' ' || c_mktsegment end"


@check(
    "slice_between",
    f"""with p as (
        select c_custkey, {_by_label(_STARTS)} as opening, {_MIDDLE} as middle from customer)
    select c_custkey, nullif(case when c_custkey % 5 = 0 then ''
        when opening is null then trim('antes ' || middle) else middle end, '') as section
    from p""",
)
def slice_between(spark, folder):
    customers = table(spark, folder, "customer")
    opening, ending = F.expr(_by_label(_STARTS)), F.expr(_by_label(_ENDS))
    label = F.expr(_by_label({e.label: e.label for e in EXAMS}))
    text = F.concat_ws(
        " ", F.lit("antes"), opening, F.expr(_MIDDLE),
        F.when(F.col("c_custkey") % 5 != 0, ending), F.lit("fin"), opening, F.lit("x"),
    )
    cut = customers.select(
        "c_custkey", label.alias("label"), tx.normalize(text).alias("normal")
    ).withColumn("cut", labelling.exam_slice(F.col("label"), F.col("normal")))
    return cut.select("c_custkey", tx.blank_to_null(F.col("cut")).alias("section"))


_UNIT = "case when p_size % 2 = 0 then 'kg' else 'gramos' end"


@check(
    "first_group",
    f"select p_partkey, case when p_partkey % 3 < 2 then {_UNIT} end as unit from part",
)
def first_group(spark, folder):
    parts = table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    unit = F.expr(_UNIT)
    text = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("peso ("), unit, F.lit(") "), size))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("peso "), size, F.lit(" "), unit))
        .otherwise(F.concat(F.lit("sin dato "), F.col("p_name")))
    )
    pattern = r"peso (?:\(([a-z]+)\) \d+|\d+ ([a-z]+))"
    return parts.select("p_partkey", tx.first_group(text, pattern, groups=2).alias("unit"))


@check(
    "layout_variant",
    "select p_partkey, case p_size % 4 when 0 then 2 when 1 then 1 else 3 end as variant"
    " from part",
)
def layout_variant(spark, folder):
    parts = table(spark, folder, "part")
    heading = F.expr(
        "case p_size % 4 when 0 then 'AC Suma  AP RERA' when 1 then 'AC suma AP H'"
        " when 2 then 'AC RERA' else 'AC H' end"
    )
    text = tx.normalize(F.concat_ws(" ", F.col("p_name"), heading, F.col("p_brand")))
    marks = extractor_for("BASAL", "doc").variant_marks
    key = tx.phrase_key(text)
    return parts.select("p_partkey", extraction.layout_variant(key, marks).alias("variant"))


# --- extraction ---------------------------------------------------------------------------


def _extract_query(template: rp.Template) -> Query:
    def query(spark, folder):
        slices = labelling.label_and_slice(template.reports(spark, folder))
        records = extraction.extract(slices, template.exam, template.ext)
        return records.select("doc_id", *[F.col(f"`{c}`") for c in template.fields])

    return query


for _t in rp.TEMPLATES:
    check(f"extract_{_t.exam.lower()}_{_t.ext}", _t.expected_sql())(_extract_query(_t))


def _record_text_sql() -> str:
    parts = []
    for i, t in enumerate(rp.TEMPLATES):
        columns = extractor_for(t.exam, t.ext).columns
        values = " || '~' || ".join(f"coalesce({t.fields[c]}, 'N/A')" for c in columns)
        parts.append(
            f"select c_custkey * 100 + {i} as doc_id, '{t.exam}' as exam_type,"
            f" '{t.ext}' as ext, 'ok' as status, {values} as record_text from customer"
        )
        if t.exam == "DAM":
            parts.append(
                f"select c_custkey * 100 + {i}, 'BASAL', '{t.ext}', 'no_slice', null from customer"
            )
    return " union all ".join(parts)


@check("extract_all", _record_text_sql())
def extract_all(spark, folder):
    extracted = extracted_reports(rp.all_reports(spark, folder))
    text = F.when(
        F.col("record").isNotNull(),
        F.array_join("record", "~", extraction.MISSING),
    )
    return extracted.select(
        "doc_id", "exam_type", "ext", "status", text.alias("record_text")
    )


def _result_rows_sql() -> str:
    t = rp.BASAL_DOC
    columns = extractor_for(t.exam, t.ext).columns
    values = ", ".join(f"coalesce({t.fields[c]}, 'N/A') as {c}" for c in columns)
    return (
        f"select {values}, '/reports/BASAL/' || cast(c_custkey as varchar) || '.doc' as fuente"
        " from customer"
    )


@check("result_rows", _result_rows_sql())
def result_rows(spark, folder):
    extracted = extracted_reports(rp.all_reports(spark, folder), exams=("BASAL",))
    columns = extractor_for("BASAL", "doc").columns
    records = extraction.records_of(extracted, "BASAL", "doc")
    return extraction.with_missing_text(records.select(*columns, "fuente"), columns)


def _audit_sql() -> str:
    lines = []
    for t in rp.TEMPLATES:
        for name, sql in t.fields.items():
            lines.append(
                f"select '{t.exam}' as exam_type, 'WARNING' as level, 'missing_field' as reason,"
                f" '{name}' as field from customer where ({sql}) is null"
            )
        if t.exam == "DAM":
            lines.append("select 'BASAL', 'ERROR', 'no_slice', null from customer")
    return (
        "select exam_type, level, reason, field, count(*) as n from ("
        + " union all ".join(lines)
        + ") group by all"
    )


@check("audit_missing", _audit_sql())
def audit_missing(spark, folder):
    lines = au.audit(extracted_reports(rp.all_reports(spark, folder)))
    return au.audit_counts(lines)


@check(
    "audit_documents",
    "select case when source in ('src0', 'src1') then 'WARNING' else 'INFO' end as level,"
    " case when source in ('src0', 'src1') then 'unsupported_ext' else 'unknown_type' end as reason,"
    " count(*) as n from documents group by all",
)
def audit_documents(spark, folder):
    documents = table(spark, folder, "documents")
    ext = F.when(F.col("source").isin("src0", "src1"), "pdf").otherwise("DOCX")
    tree = documents.select(
        "doc_id", F.col("source").alias("path"), ext.alias("ext"), "text"
    )
    lines = au.audit(extracted_reports(tree))
    return lines.groupBy("level", "reason").agg(F.count("*").alias("n"))


# --- typing -------------------------------------------------------------------------------

_PRICE = "replace(cast(cast(l_extendedprice as decimal(12, 2)) as string), '.', ',')"
_PRICE_TEXT = (
    f"case l_orderkey % 9 when 0 then 'N/A' when 1 then '1d' when 2 then '1.234,5'"
    f" when 3 then ' ' || {_PRICE} || ' ' when 4 then '.' else {_PRICE} end"
)


@check(
    "to_double",
    "select l_orderkey, l_linenumber, case when l_orderkey % 9 in (0, 1, 2, 4) then null"
    " else cast(cast(l_extendedprice as decimal(12, 2)) as double) end as price from lineitem",
)
def to_double(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", casts.to_double(F.expr(_PRICE_TEXT)).alias("price")
    )


_Y, _M, _D = (
    rp.text("year(o_orderdate)"),
    rp.padded("month(o_orderdate)"),
    rp.padded("day(o_orderdate)"),
)
_DATE_TEXT = (
    f"case o_orderkey % 7 when 0 then {_D} || '/' || {_M} || '/' || {_Y}"
    f" when 1 then {_Y} || '-' || {_M} || '-' || {_D}"
    f" when 2 then {_M} || '/' || {_D} || '/' || {_Y}"
    f" when 3 then {_D} || '-' || {_M} || '-' || substr({_Y}, 3, 2)"
    f" when 4 then '31/02/' || {_Y} when 5 then 'N/A'"
    f" else ' ' || {_D} || '.' || {_M} || '.' || {_Y} || ' 10:30 ' end"
)
_SWAPPED = (
    "case when day(o_orderdate) <= 12 then make_date(year(o_orderdate), day(o_orderdate),"
    " month(o_orderdate)) else cast(o_orderdate as date) end"
)


def _date_sql(year_first: str) -> str:
    return (
        f"select o_orderkey, case o_orderkey % 7 when 1 then {year_first} when 2 then {_SWAPPED}"
        " when 4 then null when 5 then null else cast(o_orderdate as date) end as day from orders"
    )


def _dates(spark, folder, mode):
    orders = table(spark, folder, "orders").select("o_orderkey", F.expr(_DATE_TEXT).alias("day"))
    classes = ColumnClasses(dates=("day",))
    return casting.cast_columns(orders, classes, reference_year=2026, date_mode=mode)


@check("to_date", _date_sql(_SWAPPED))
def to_date(spark, folder):
    return _dates(spark, folder, "compat")


@check("to_date_iso", _date_sql("cast(o_orderdate as date)"))
def to_date_iso(spark, folder):
    return _dates(spark, folder, "iso")


_TYPED = ColumnClasses(
    strings=("flag", "line", "absent_text"),
    integers=("quantity", "price"),
    doubles=("discount", "junk", "absent_number"),
    dates=("shipped", "never"),
)


def _typing_input(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        "l_orderkey",
        F.col("l_returnflag").alias("flag"),
        F.col("l_linenumber").alias("line"),
        F.expr("replace(cast(l_quantity as string), '.', ',')").alias("quantity"),
        F.expr(_PRICE).alias("price"),
        F.expr("cast(cast(l_discount as decimal(4, 2)) as string)").alias("discount"),
        F.lit("x").alias("junk"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("shipped"),
        F.lit("31/02/2020").alias("never"),
    )


@check(
    "to_bigint",
    "select l_orderkey, cast(l_quantity as bigint) as quantity,"
    " cast(cast(l_extendedprice as decimal(12, 2)) as varchar) as price from lineitem",
)
def to_bigint(spark, folder):
    typed = casting.cast_columns(_typing_input(spark, folder), _TYPED, 2026)
    return typed.select("l_orderkey", "quantity", "price")


@check(
    "to_string",
    "select l_orderkey, l_returnflag as flag, cast(l_linenumber as varchar) as line from lineitem",
)
def to_string(spark, folder):
    typed = casting.cast_columns(_typing_input(spark, folder), _TYPED, 2026)
    return typed.select("l_orderkey", "flag", "line")


@check(
    "transform_report",
    """select variable, type, case
        when variable like 'absent%' then 'not_found'
        when (select count(*) from lineitem) = 0 or variable in ('price', 'junk', 'never')
        then 'not_transformed' else 'transformed' end as status
    from (values ('quantity', 'int'), ('price', 'int'), ('discount', 'float'),
        ('junk', 'float'), ('absent_number', 'float'), ('shipped', 'datetime'),
        ('never', 'datetime'), ('flag', 'str'), ('line', 'str'), ('absent_text', 'str'))
        as v(variable, type)""",
)
def transform_report(spark, folder):
    raw = _typing_input(spark, folder)
    typed, failed = casting.cast_with_failures(raw, _TYPED, 2026)
    return casting.transform_report(typed, _TYPED, failed)


# --- derivations --------------------------------------------------------------------------

_YEARS = "case when p_partkey % 5 = 0 then null else cast(p_size as double) end"
_MONTHS = "case when p_partkey % 3 = 0 then null else cast(p_partkey % 12 as double) end"
_DAYS = "case when p_partkey % 2 = 0 then null else cast(p_partkey % 30 as double) end"


@check(
    "age_years",
    f"select p_partkey, coalesce({_YEARS}, 0) + coalesce({_MONTHS}, 0) / 12"
    f" + coalesce({_DAYS}, 0) / cast(365.25 as double) as age from part",
)
def age_years(spark, folder):
    parts = table(spark, folder, "part")
    age = units.age_in_years(F.expr(_YEARS), F.expr(_MONTHS), F.expr(_DAYS))
    return parts.select("p_partkey", age.alias("age"))


# Spellings per measure: accepted ones in both scales, one unknown and one missing.
_SPELLINGS = {
    "peso": ("kg", " KGS ", "kl", "g", "Grs", "lb", None),
    "talla": ("m", " MTS ", "cm", "a", "C", "pies", None),
    "cuello": ("m", "Metros", "cm ", "cms", "c", "pulg", None),
    "perimetro_abdominal": ("ms", "MTS", "cm.", ".ccm", " ccm", "metros", None),
}
_VALUE = "case when p_partkey % 11 = 0 then null else p_retailprice end"


def _spelling_sql(name: str) -> str:
    cases = " ".join(
        f"when {i} then {'null' if s is None else repr(s)}"
        for i, s in enumerate(_SPELLINGS[name])
    )
    return f"case (p_partkey + p_size) % 7 {cases} end"


def _conversion_sql(name: str) -> str:
    m = measure(name)
    value = _VALUE if not m.null_is_zero else f"coalesce({_VALUE}, 0)"
    cases = ""
    for scale in m.scales:
        listed = ", ".join(f"'{u}'" for u in scale.units)
        cases += f" when u in ({listed}) then ({value}) * {scale.times} / {scale.over}"
    return (
        f"select p_partkey, case{cases} end as converted from"
        f" (select *, trim(lower({_spelling_sql(name)})) as u from part)"
    )


def _measures(spark, folder):
    parts = table(spark, folder, "part")
    columns = []
    for m in MEASURES:
        columns.append(F.expr(_VALUE).alias(m.name))
        columns.append(F.expr(_spelling_sql(m.name)).alias(m.unit_column))
    return curation.with_clean_units(parts.select("p_partkey", *columns))


def _conversion_query(name: str) -> Query:
    def query(spark, folder):
        converted = curation.with_converted_measures(_measures(spark, folder))
        return converted.select("p_partkey", F.col(measure(name).target).alias("converted"))

    return query


for _name, _key in (
    ("peso", "to_kg"),
    ("talla", "to_cm_height"),
    ("cuello", "to_cm_neck"),
    ("perimetro_abdominal", "to_cm_waist"),
):
    check(_key, _conversion_sql(_name))(_conversion_query(_name))


def _unknown_units_sql() -> str:
    parts = []
    for m in MEASURES:
        listed = ", ".join(f"'{u}'" for u in m.known_units)
        parts.append(
            f"select '{m.name}' as measure, trim(lower({_spelling_sql(m.name)})) as unit from part"
            f" where trim(lower({_spelling_sql(m.name)})) not in ({listed})"
        )
    return (
        "select measure, unit, count(*) as n from ("
        + " union all ".join(parts)
        + ") group by all"
    )


@check("unknown_units", _unknown_units_sql())
def unknown_units(spark, folder):
    return curation.unknown_units(_measures(spark, folder))


def _number_sql(sql: str) -> str:
    return f"cast(replace({sql}, ',', '.') as double)"


def _curated_sql(t: rp.Template) -> str:
    f = t.fields
    plain = [c for c in curation.FINAL_COLUMNS if c in f and c not in _TEXT_COLUMNS]
    columns = [f"{_number_sql(f[c])} as {c}" for c in plain]
    columns += [f"{f[c]} as {c}" for c in ("nombre", "id", "solicita", "empresa")]
    k = rp.K
    ages = [f"coalesce({_number_sql(f[c])}, 0)" for c in ("edad_anos", "edad_meses", "edad_dias")]
    weight = _number_sql(f["peso"])
    height = _number_sql(f["talla"])
    columns += [
        f"make_date({k} % 25 + 2000, {k} % 12 + 1, {k} % 28 + 1) as fecha_estudio",
        f"'/reports/BASAL/' || cast({k} as varchar) || '.{t.ext}' as fuente",
        f"{ages[0]} + {ages[1]} / 12 + {ages[2]} / cast(365.25 as double) as edad_anos_decimal",
        f"case when lower({f['medida_peso']}) = 'gr' then {weight} / 1000 else {weight} end as peso_kg",
        f"case when {f['medida_talla']} = 'mts' then {height} * 100 else {height} end as talla_cm",
        f"{_number_sql(f['cuello'])} as cuello_cm",
        f"{_number_sql(f['perimetro_abdominal'])} as perimetro_abdominal_cm",
        "'Extraido en: 2026-01-15 : 10:30:00' as version_control",
    ]
    return f"select {_uuid_sql(f'cast({k} as varchar)')} as uuid, {', '.join(columns)} from customer"


def _uuid_sql(key: str) -> str:
    """The identifier of one text key."""
    digest = f"sha256(cast(len({key}) as varchar) || ':' || {key})"
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({digest}, 17, 1)) - 1) % 4 + 1, 1)"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-4' || substr({digest}, 14, 3) || '-' || {variant}"
        f" || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12)"
    )


_TEXT_COLUMNS = ("nombre", "id", "solicita", "empresa", "fecha_estudio", "fuente")


def _curated(spark, folder, template: rp.Template) -> DataFrame:
    slices = labelling.label_and_slice(template.reports(spark, folder))
    records = extraction.extract(slices, template.exam, template.ext)
    unified = curation_plan.unify([records], keys=["doc_id"])
    typed = curation_plan.typed(unified, NOW.year)
    shaped = curation.with_converted_measures(
        curation.with_clean_units(curation.with_decimal_age(typed))
    )
    return curation.with_version(curation.curated_columns(shaped), NOW)


@check("curate_basal_doc", _curated_sql(rp.BASAL_DOC))
def curate_basal_doc(spark, folder):
    return _curated(spark, folder, rp.BASAL_DOC)


@check("curate_basal_rtf", _curated_sql(rp.BASAL_RTF))
def curate_basal_rtf(spark, folder):
    return _curated(spark, folder, rp.BASAL_RTF)


_PLACED = {name: f"l_orderkey * {i + 1} + l_linenumber" for i, name in enumerate(curation.FINAL_COLUMNS)}


@check(
    "project_curated",
    "select " + ", ".join(f"{sql} as {name}" for name, sql in _PLACED.items()) + " from lineitem",
)
def project_curated(spark, folder):
    """All final columns, out of a table that has them in another order and others between them."""
    lines = table(spark, folder, "lineitem")
    columns = [F.expr(sql).alias(name) for name, sql in reversed(_PLACED.items())]
    return curation.curated_columns(lines.select("l_shipdate", *columns, "l_tax"))


@check(
    "percent_scale",
    "select l_orderkey, l_quantity / 100 as l_quantity, l_tax / 100 as l_tax, l_discount"
    " from lineitem",
)
def percent_scale(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_quantity", "l_tax", "l_discount"
    )
    return curation.percent_to_fraction(
        lines, ("l_quantity", "l_tax"), ("l_quantity", "l_tax", "l_discount")
    )


_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


@check(
    "row_uuid",
    "select count(*) as n, count(*) as n_distinct, count(*) as n_valid,"
    " count(*) as n_stable from customer",
)
def row_uuid(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    stable = curation.row_uuid(customers, ["c_custkey", "c_name"]).withColumnRenamed(
        "uuid", "stable"
    )
    return curation.row_uuid(stable).agg(
        F.count("*").alias("n"),
        F.countDistinct("stable").alias("n_distinct"),
        F.count_if(F.col("uuid").rlike(_UUID)).alias("n_valid"),
        F.count_if(F.col("stable").rlike(_UUID)).alias("n_stable"),
    )


# --- schemas ------------------------------------------------------------------------------


@check(
    "union_by_name",
    "select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment,"
    " null as extra from customer union all"
    " select s_suppkey, s_name, s_acctbal, null, s_nationkey from supplier",
)
def union_by_name(spark, folder):
    customers = table(spark, folder, "customer").selectExpr(
        "c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment"
    )
    suppliers = table(spark, folder, "supplier").selectExpr(
        "s_nationkey as extra", "s_acctbal as balance", "s_suppkey as key", "s_name as name"
    )
    return schema.union_by_name([customers, suppliers])


_COLUMN_PAIRS = (
    "select distinct 'file' || cast(o_orderkey % 97 as varchar) as source,"
    " 'col' || cast(o_custkey % 211 as varchar) as col from orders"
)


def _column_pairs(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.select(
        F.concat(F.lit("file"), (F.col("o_orderkey") % 97).cast("string")).alias("source"),
        F.concat(F.lit("col"), (F.col("o_custkey") % 211).cast("string")).alias("column"),
    ).distinct()


def _written_files(spark, folder) -> str:
    """A folder of result files, up to four for each source: its columns as header, a line per line item."""
    headers = _column_pairs(spark, folder).groupBy("source").agg(F.array_join(F.collect_set("column"), ",").alias("header"))
    lines = table(spark, folder, "lineitem").select(
        F.concat(F.lit("file"), (F.col("l_orderkey") % 97).cast("string")).alias("own"),
        F.pmod(F.xxhash64("l_orderkey"), F.lit(4)).alias("part"),
        F.concat_ws(",", "l_partkey", "l_quantity").alias("line"),
    )
    bodies = lines.groupBy("own", "part").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    files = headers.join(bodies, F.col("source") == F.col("own"), "left")
    path = f"{checkpoint_root(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    text = F.concat_ws("\n", "header", "body").alias("value")
    parts = files.select(text, "source", F.coalesce("part", F.lit(0)).alias("part"))
    parts.write.partitionBy("source", "part").text(path)
    return path


def _of_folder(file):
    """The source that a file's folder names."""
    return F.regexp_extract(file, "source=([^/]+)/", 1)


def _joined(name: str):
    return F.array_join(name, ",").alias(name)


@check(
    "schema_diff",
    f"""with p as ({_COLUMN_PAIRS}), absent as (
        select s.source, c.col from (select distinct source from p) s,
            (select distinct col from p) c
        except select source, col from p)
    select s.source, coalesce(string_agg(a.col, ',' order by a.col), '') as missing
    from (select distinct source from p) s left join absent a on a.source = s.source
    group by s.source""",
)
def schema_diff(spark, folder):
    columns = tables.folder_columns(spark, [_written_files(spark, folder)], _of_folder)
    found = schema.missing_columns(columns)
    return found.select("source", _joined("missing"))


@check(
    "schema_diff_base",
    f"""with p as ({_COLUMN_PAIRS}), base as (select col from p where source = 'file0')
    select s.source,
        coalesce((select string_agg(col, ',' order by col) from base
            where col not in (select col from p q where q.source = s.source)), '') as missing,
        coalesce((select string_agg(col, ',' order by col) from p q where q.source = s.source
            and q.col not in (select col from base)), '') as extra
    from (select distinct source from p) s""",
)
def schema_diff_base(spark, folder):
    columns = tables.folder_columns(spark, [_written_files(spark, folder)], _of_folder)
    found = schema.differences_from_base(columns, "file0")
    return found.select("source", _joined("missing"), _joined("extra"))


@check(
    "source_shape",
    f"""with p as ({_COLUMN_PAIRS})
    select p.source, coalesce(max(r.n), 0) as n_rows, count(distinct p.col) as n_columns
    from p left join (select 'file' || cast(l_orderkey % 97 as varchar) as source,
        count(*) as n from lineitem group by 1) r
    on r.source = p.source group by p.source""",
)
def source_shape(spark, folder):
    path = _written_files(spark, folder)
    columns = tables.folder_columns(spark, [path], _of_folder)
    return schema.source_shapes(tables.folder_rows(spark, [path], _of_folder), columns)


# --- profile ------------------------------------------------------------------------------


@check(
    "month_histogram",
    "select cast(date_trunc('month', o_orderdate) as date) as month, count(*) as n from orders"
    " where o_orderkey % 10 <> 3 group by 1",
)
def month_histogram(spark, folder):
    orders = table(spark, folder, "orders")
    dated = orders.withColumn(
        "studied", F.when(F.col("o_orderkey") % 10 != 3, F.col("o_orderdate"))
    )
    return profile.month_histogram(dated, "studied")


def _profile_input(spark, folder):
    """Orders with missing values, sentinels, zeros and text dates."""
    return table(spark, folder, "orders").select(*[F.expr(s).alias(n) for n, s in _PROFILED.items()])


_PROFILED = {
    "orden": "o_orderkey",
    "cliente": "case when o_orderkey % 6 = 1 then null else o_custkey end",
    "importe": "case when o_orderkey % 10 = 4 then cast(-9999 as double) when o_orderkey < 50"
    " then cast(0 as double) else o_totalprice end",
    "grande": "o_totalprice * 1000",
    "vacio": "cast(null as double)",
    "estado": "case when o_orderkey % 8 = 2 then null else o_orderstatus end",
    "prioridad": "o_orderpriority || ' ' || cast(o_custkey % 23 as string)",
    "fecha_texto": "cast(o_custkey % 5 as string)",
}
_CATEGORIES = ["estado", "prioridad", "fecha_texto"]
_TYPES = {
    "orden": "bigint", "cliente": "bigint", "importe": "double", "grande": "double",
    "vacio": "double", "estado": "string", "prioridad": "string", "fecha_texto": "string",
}
_NUMBERS = ("orden", "cliente", "importe", "grande", "vacio")
_PROFILED_SQL = "select " + ", ".join(f"{s} as {n}" for n, s in _PROFILED.items()) + " from orders"


def _display_sql(x: str) -> str:
    return f"case when abs({x}) > 1e6 then printf('%.2E', {x}) else printf('%.2f', {x}) end"


def _each(line) -> str:
    return " union all ".join(line(name) for name in _PROFILED)


def _percent_sql(part: str) -> str:
    return f"printf('%.2f', {part} / cast(count(*) as double) * 100) || '%'"


@check(
    "describe",
    f"with t as ({_PROFILED_SQL}) "
    + " union all ".join(
        f"select '{n}' as variable, {_display_sql(f'cast(min(nullif({n}, -9999)) as double)')} as min,"
        f" {_display_sql(f'avg(nullif({n}, -9999))')} as mean,"
        f" {_display_sql(f'cast(max(nullif({n}, -9999)) as double)')} as max from t"
        for n in _NUMBERS
    ),
)
def describe(spark, folder):
    lines = profile.summary(_profile_input(spark, folder))
    shown = [profile.display_number(F.col(c)).alias(c) for c in ("min", "mean", "max")]
    return lines.where(F.col("variable").isin(*_NUMBERS)).select("variable", *shown)


@check(
    "display_number",
    f"select l_orderkey, {_display_sql('l_extendedprice * l_tax / 3')} as small,"
    f" {_display_sql('l_extendedprice * 1000')} as large,"
    f" {_display_sql('-l_quantity / 8')} as negative from lineitem",
)
def display_number(spark, folder):
    lines = table(spark, folder, "lineitem")
    return lines.select(
        "l_orderkey",
        profile.display_number(F.expr("l_extendedprice * l_tax / 3")).alias("small"),
        profile.display_number(F.expr("l_extendedprice * 1000")).alias("large"),
        profile.display_number(F.expr("-l_quantity / 8")).alias("negative"),
    )


@check(
    "missing",
    f"with t as ({_PROFILED_SQL}) "
    + _each(
        lambda n: f"select '{n}' as variable, count(*) - count({n}) as n_missing,"
        f" {_percent_sql(f'(count(*) - count({n}))')} as missing_share from t"
    ),
)
def missing(spark, folder):
    return profile.missing_share(_profile_input(spark, folder))


@check(
    "distinct_share",
    f"with t as ({_PROFILED_SQL}) "
    + _each(
        lambda n: f"select '{n}' as variable, count(distinct {n}) as n_distinct,"
        f" {_percent_sql(f'count(distinct {n})')} as distinct_share from t"
    ),
)
def distinct_share(spark, folder):
    return profile.distinct_share(_profile_input(spark, folder))


def _sample_sql(n: str) -> str:
    usable = f"{n} is not null" + (f" and {n} <> 0" if n in _NUMBERS else "")
    return f"arg_min({n}, orden) filter (where {usable})"


# Both sides write a double in their own way, so doubles are compared as cents.
_DOUBLES = ("importe", "grande", "vacio")


def _sample_text_sql(n: str) -> str:
    sample = _sample_sql(n)
    if n in _DOUBLES:
        sample = f"cast(round({sample} * 100) as bigint)"
    return f"cast({sample} as varchar)"


def _sample_text():
    cents = F.round(F.col("sample").try_cast("double") * 100).cast("bigint").cast("string")
    shown = F.when(F.col("sample") == profile.NOT_APPLICABLE, F.col("sample")).otherwise(cents)
    return F.when(F.col("variable").isin(*_DOUBLES), shown).otherwise(F.col("sample"))


@check(
    "sample_value",
    f"with t as ({_PROFILED_SQL}) "
    + " union all ".join(
        f"select '{n}' as variable, {_sample_text_sql(n)} as sample from t" for n in _PROFILED
    ),
)
def sample_value(spark, folder):
    lines = profile.summary(_profile_input(spark, folder), order_by=["orden"])
    return lines.select("variable", _sample_text().alias("sample"))


_FREQUENCIES_SQL = f"""with t as ({_PROFILED_SQL}), f as (
    {" union all ".join(f"select '{n}' as variable, {n} as value, count(*) as n from t where {n} is not null group by 2" for n in _CATEGORIES)}),
r as (select *, row_number() over (partition by variable order by n desc, value) as rank from f),
g as (select variable, least(rank, 11) as rank,
    case when rank > 10 then 'OTROS' else value end as value, sum(n) as n from r group by all)"""


@check(
    "top10_others",
    f"{_FREQUENCIES_SQL} select variable, cast(rank as integer) as rank, value,"
    " cast(n as bigint) as n from g",
)
def top10_others(spark, folder):
    return profile.top_frequencies(
        profile.value_frequencies(_profile_input(spark, folder), _CATEGORIES)
    )


_FREQUENCY_TEXT_SQL = (
    "select variable, '\"' || string_agg(value || ': ' || cast(cast(n as bigint) as varchar),"
    " ' | ' order by rank) || '\"' as frequencies from g group by variable"
)


@check("frequency_text", f"{_FREQUENCIES_SQL} {_FREQUENCY_TEXT_SQL}")
def frequency_text(spark, folder):
    return profile.frequency_texts(
        profile.value_frequencies(_profile_input(spark, folder), _CATEGORIES)
    )


def _profile_sql() -> str:
    lines = []
    for n in _PROFILED:
        number = n in _NUMBERS
        stats = [
            f"coalesce({_display_sql(f'cast({f}(nullif({n}, -9999)) as double)')}, 'nan')"
            if number
            else "'N/A'"
            for f in ("min", "avg", "max")
        ]
        lines.append(
            f"select '{n}' as variable, count({n}) as count,"
            f" cast(count(distinct {n}) as varchar) || ' (' || {_percent_sql(f'count(distinct {n})')} || ')' as unique,"
            f" cast(count(*) - count({n}) as varchar) || ' (' || {_percent_sql(f'(count(*) - count({n}))')} || ')' as missing,"
            f" {stats[0]} as min, {stats[1]} as mean, {stats[2]} as max, '{_TYPES[n]}' as type,"
            f" coalesce({_sample_text_sql(n)}, 'N/A') as sample from t"
        )
    listed = f"select * from ({_FREQUENCY_TEXT_SQL}) where variable not like '%fecha%'"
    return (
        f"{_FREQUENCIES_SQL}, p as ({' union all '.join(lines)}), x as ({listed})"
        " select p.variable, p.count, p.unique, coalesce(x.frequencies, 'N/A') as frequencies,"
        " p.missing, p.min, p.mean, p.max, p.type, p.sample from p left join x on x.variable = p.variable"
    )


@check("profile", _profile_sql())
def profile_table(spark, folder):
    table_profile = profile.profile(_profile_input(spark, folder), _CATEGORIES, ["orden"])
    return table_profile.withColumn("sample", _sample_text())


@check(
    "value_counts",
    "select l_returnflag || l_linestatus || cast(l_quantity as integer) as value, count(*) as n"
    " from lineitem group by 1",
)
def value_counts(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.expr("l_returnflag || l_linestatus || cast(l_quantity as integer)").alias("code")
    )
    return profile.value_counts(lines, "code")


@check(
    "profile_merged",
    ORACLES["profile"],
)
def profile_merged(spark, folder):
    """The same profile from the states of the order months, one of which was measured twice."""
    path = f"{checkpoint_root(spark).rstrip('/')}/profile-{uuid.uuid4().hex}"
    orders = table(spark, folder, "orders")
    measured = orders.select(*[F.expr(s).alias(n) for n, s in _PROFILED.items()], "o_orderdate")
    names = list(_PROFILED)
    late = F.month("o_orderdate") == 7
    order_by = ["orden"]
    first = measured.where(~late | (F.col("orden") % 2 == 0))
    profiles.refresh(first, path, "o_orderdate", order_by)
    profiles.refresh(measured.where(late), path, "o_orderdate", order_by)
    merged = profiles.current(spark, path, _CATEGORIES)
    return merged.where(F.col("variable").isin(*names)).withColumn("sample", _sample_text())


_FREQUENT = {**{n: _PROFILED[n] for n in _CATEGORIES}, "orden": "cast(o_orderkey as string)"}


@check(
    "top10_frequent",
    "with t as (select "
    + ", ".join(f"{s} as {n}" for n, s in _FREQUENT.items())
    + " from orders), f as ("
    + " union all ".join(
        f"select '{n}' as variable, {n} as value, count(*) as n from t where {n} is not null group by 2" for n in _FREQUENT
    )
    + """), r as (select *, row_number() over (partition by variable order by n desc, value) as rank from f),
    g as (select variable, least(rank, 11) as rank,
        case when rank > 10 then 'OTROS' else value end as value, sum(n) as n from r group by all)
    select variable, cast(rank as integer) as rank, value, cast(n as bigint) as n from g""",
)
def top10_frequent(spark, folder):
    """Candidates of sketches, counted exactly; among the columns is one of unique values."""
    orders = table(spark, folder, "orders")
    return profile.most_frequent(orders.select(*[F.expr(s).alias(n) for n, s in _FREQUENT.items()]))


@check(
    "top_values",
    "select l_returnflag || l_linestatus || cast(l_quantity as integer) as value, count(*) as n"
    " from lineitem group by 1 order by n desc, value limit 25",
)
def top_values(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.expr("l_returnflag || l_linestatus || cast(l_quantity as integer)").alias("code")
    )
    return profile.top_values(lines, "code", 25)


# --- batch gate ---------------------------------------------------------------------------

_DAY = "cast(cast(ts as date) as string)"
_STATUS = (
    "select '{status}' as status, {reason} as reason, {rows} as n_rows, {keyed} as n_keyed,"
    " {bad} as n_bad_dates, {dup} as n_duplicates, {dups} as duplicates, {old} as n_existing,"
    " {olds} as existing"
)


def _status_sql(status, reason=None, **parts) -> str:
    count = "(select count(*) from events)"
    values = {
        "rows": count, "keyed": count, "bad": "0", "dup": "0", "dups": "''", "old": "0",
        "olds": "''", **parts,
    }
    return _STATUS.format(
        status=status, reason="null" if reason is None else f"'{reason}'", **values
    )


def _batch(spark, folder, uuid: str = "cast(event_id as string)", day: str = _DAY):
    return table(spark, folder, "events").select(
        F.expr(uuid).alias("uuid"),
        F.expr(day).alias("day"),
        F.expr("case when user_id % 4 = 0 then '' else event_type end").alias("event_type"),
        "value",
    )


def _status(gated: DataFrame) -> DataFrame:
    return gated.withColumn("duplicates", F.array_join("duplicates", ",")).withColumn(
        "existing", F.array_join("existing", ",")
    )


def _first_ten(condition: str) -> str:
    return (
        "(select string_agg(u, ',' order by u) from (select cast(event_id as varchar) as u"
        f" from events where {condition} order by u limit 10))"
    )


@check("ingest_status_ok", _status_sql("success"))
def ingest_status_ok(spark, folder):
    return _status(ingest.gate(_batch(spark, folder), "day"))


@check(
    "ingest_status_duplicate",
    _status_sql(
        "error",
        "duplicates_in_batch",
        rows="(select count(*) + count_if(event_id % 100 = 7) from events)",
        keyed="(select count(*) + count_if(event_id % 100 = 7) from events)",
        dup="(select count(*) from events where event_id % 100 = 7)",
        dups=_first_ten("event_id % 100 = 7"),
    ),
)
def ingest_status_duplicate(spark, folder):
    batch = _batch(spark, folder)
    again = batch.where("cast(uuid as bigint) % 100 = 7")
    return _status(ingest.gate(batch.unionByName(again), "day"))


_LOADED = "event_id % 50 = 3 and day(ts) <= 10"


@check(
    "ingest_status_existing",
    _status_sql(
        "error",
        "already_loaded",
        rows="(select count(*) from events)",
        keyed="(select count(*) from events)",
        old=f"(select count(*) from events where {_LOADED})",
        olds=_first_ten(_LOADED),
    ),
)
def ingest_status_existing(spark, folder):
    """The target also holds identifiers of the batch under days the batch does not name."""
    events = table(spark, folder, "events")
    batch = _batch(spark, folder)
    return _status(ingest.gate(batch, "day", _loaded_rows(events)))


def _loaded_rows(events):
    return events.where("event_id % 50 = 3").select(
        F.col("event_id").cast("string").alias("uuid"),
        F.expr("case when day(ts) <= 10 then cast(ts as date)"
               " else date_add(cast(ts as date), 400) end").alias("day"),
    )


@check("ingest_status_indexed", ORACLES["ingest_status_existing"])
def ingest_status_indexed(spark, folder):
    """The same, answered by the side table of a warehouse; a batch without a marker does not count."""
    path = f"{checkpoint_root(spark).rstrip('/')}/warehouse-{uuid.uuid4().hex}"
    events = table(spark, folder, "events")
    warehouse.append(_loaded_rows(events), path, "one", "day")
    warehouse.commit(spark, path, "one", {})
    failed = events.select(F.col("event_id").cast("string").alias("uuid"), F.col("ts").cast("date").alias("day"))
    warehouse.append(failed, path, "failed", "day")
    batch = _batch(spark, folder)
    loaded = warehouse.already_loaded(spark, path, ingest.keyed_rows(batch, "day"), "day")
    return _status(ingest.gate(batch, "day", loaded=loaded))


@check(
    "ingest_status_bad_date",
    _status_sql("error", "bad_date", bad="(select count_if(event_id % 97 = 5) from events)"),
)
def ingest_status_bad_date(spark, folder):
    day = f"case when event_id % 97 = 5 then '2024-13-01' else {_DAY} end"
    return _status(ingest.gate(_batch(spark, folder, day=day), "day"))


@check("ingest_status_skip", _status_sql("skip", "no_identifiers", keyed="0"))
def ingest_status_skip(spark, folder):
    return _status(ingest.gate(_batch(spark, folder, uuid="''"), "day"))


@check(
    "ingest_status_exception",
    _status_sql(
        "exception", "undated_row", keyed="(select count_if(event_id % 31 <> 2) from events)"
    ),
)
def ingest_status_exception(spark, folder):
    day = f"case when event_id % 31 = 2 then '' else {_DAY} end"
    return _status(ingest.gate(_batch(spark, folder, day=day), "day"))


@check(
    "ingest_rows",
    "select cast(event_id as varchar) as uuid, cast(ts as date) as day,"
    " case when user_id % 4 <> 0 then event_type end as event_type, value,"
    f" cast({int(NOW.replace(tzinfo=timezone.utc).timestamp())} as bigint) as migrado from events",
)
def ingest_rows(spark, folder):
    rows = ingest.shaped_rows(_batch(spark, folder), "day", NOW.replace(tzinfo=timezone.utc))
    return rows.withColumn("migrado", F.unix_seconds("migrado"))


# --- workbooks ----------------------------------------------------------------------------

_CELL_VALUES = {
    **{c: f"'{c}-' || cast(o_custkey * {i + 1} as string)" for i, c in enumerate(wb.CELLS)},
    "G6": "cast(o_custkey as string)",
    "E36": "case when o_orderkey % 6 = 1 then null else cast(o_custkey % 100 as string) end",
    "G9": "case o_orderkey % 5 when 0 then 'si' when 1 then null else 'SI' end",
    "B7": "case o_orderkey % 7 when 0 then 'ASMA' when 1 then null else 'Paciente con epoc '"
    " || o_orderstatus end",
    "B1": "case o_orderkey % 3 when 0 then 'Programa teleasistido' when 1 then null"
    " else 'Programa' end",
}
_GATE = "coalesce({G9} = 'SI', false) and coalesce(upper({B7}) like '%EPOC%', false)".format(
    G9=f"({_CELL_VALUES['G9']})", B7=f"({_CELL_VALUES['B7']})"
)


def _cells(spark, folder):
    """Long cell table with one workbook per order and one cell nobody asks for."""
    cells = {**_CELL_VALUES, "Z99": "o_orderpriority"}
    pairs = [
        F.struct(F.lit(cell).alias("cell"), F.expr(sql).alias("value"))
        for cell, sql in cells.items()
    ]
    orders = rp.spread(table(spark, folder, "orders"))
    return orders.select(
        F.concat(F.lit("/w/"), F.col("o_orderkey").cast("string"), F.lit(".xlsx")).alias("file"),
        F.inline(F.array(*pairs)),
    )


def _accepted_sql() -> str:
    tele = "o_orderkey % 3 = 0"
    fields = [
        f"{_CELL_VALUES[cell]} as {name}"
        if cell
        else f"case when {tele} then {_CELL_VALUES['H18']} else {_CELL_VALUES['I18']} end as {name}"
        for name, cell in wb.FIELD_CELLS.items()
    ]
    return (
        "select '/w/' || cast(o_orderkey as varchar) || '.xlsx' as ruta_archivo, "
        + ", ".join(fields)
        + f", case when {tele} then 'TELE' else 'PRESENCIAL' end as modalidad"
        + f" from orders where {_GATE}"
    )


@check("cells_pivot", _accepted_sql())
def cells_pivot(spark, folder):
    return workbook.accepted(workbook.classify(workbook.pivot_cells(_cells(spark, folder))))


@check(
    "cells_rejects",
    f"""select '/w/' || cast(o_orderkey as varchar) || '.xlsx' as ruta_archivo,
        concat_ws(', ',
            case when coalesce({_CELL_VALUES['G9']}, '') <> 'SI' then
                'No cumple con ''SI'' en G9' end,
            case when coalesce(upper({_CELL_VALUES['B7']}), '') not like '%EPOC%' then
                'No cumple con ''EPOC'' en B7' end) as razon,
        {_CELL_VALUES['B7']} as "contenido_B7"
    from orders where not ({_GATE})""",
)
def cells_rejects(spark, folder):
    return workbook.rejected(workbook.classify(workbook.pivot_cells(_cells(spark, folder))))


# --- files --------------------------------------------------------------------------------

_FILE_PATH = (
    "'/datos/' || p_type || '/' || p_brand || '/' || p_name || case p_partkey % 7"
    " when 0 then '.doc' when 1 then '.DOCX' when 2 then '.v2.rtf' when 3 then '.pdf'"
    " when 4 then ' EGRESO.xlsx' when 5 then ' seguimiento.xlsx' else '' end"
)
_EXT = (
    "case p_partkey % 7 when 0 then 'doc' when 1 then 'docx' when 2 then 'rtf'"
    " when 3 then 'pdf' when 6 then '' else 'xlsx' end"
)
_VALID = "p_partkey % 7 < 3"


def _paths(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.expr(_FILE_PATH).alias("path"))


@check(
    "file_inventory",
    f"select p_partkey, {_FILE_PATH} as path, {_EXT} as ext, {_VALID} as valid from part",
)
def file_inventory(spark, folder):
    return inventory.inventory(_paths(spark, folder))


@check(
    "inventory_counters",
    f"select count(*) as num_files, count_if({_VALID}) as valid_files,"
    f" count_if(not ({_VALID})) as discarded_files from part",
)
def inventory_counters(spark, folder):
    return inventory.counters(inventory.inventory(_paths(spark, folder)))


@check(
    "folder_count",
    "select count(distinct p_type) + count(distinct p_type || '/' || p_brand) as num_dirs"
    " from part",
)
def folder_count(spark, folder):
    return inventory.folder_count(_paths(spark, folder), root="/datos/")


@check(
    "page_extensions",
    f"""with names as (select list_last(string_split(url, '/')) as name from pages),
    dots as (select name, strpos(reverse(name), '.') as behind from names),
    types as (select case when behind > 1 and behind < len(name) then lower(right(name, behind - 1)) else '' end as ext from dots)
    select ext, ext in ({', '.join(repr(r) for r in READABLE)}) as valid, count(*) as n from types group by all""",
)
def page_extensions(spark, folder):
    pages = table(spark, folder, "pages").select(F.col("url").alias("path"))
    return inventory.inventory(pages).groupBy("ext", "valid").agg(F.count("*").alias("n"))


@check(
    "name_predicate",
    "select p_partkey, p_partkey % 7 = 4 as is_workbook from part",
)
def name_predicate(spark, folder):
    paths = _paths(spark, folder)
    name = inventory.file_name(F.col("path"))
    return paths.select("p_partkey", workbook.is_rehab_workbook(name).alias("is_workbook"))


_WORD = "the"
_HAS_WORD = f"contains(text, '{_WORD}')"
_LONG = "strlen(text) >= 1024"
_BUCKET = f"""case
    when doc_id % 5 = 0 or (doc_id % 5 = 1 and not {_LONG}) then
        case when {_HAS_WORD} then 'binarios_con_palabra' else 'binarios_sin_palabra' end
    when doc_id % 5 = 2 or not {_HAS_WORD} then 'texto_sin_palabra'
    else 'texto_con_palabra' end"""


def _contents(spark, folder):
    """Texts as bytes: some with a NUL in front, some with one at the end, some not UTF-8."""
    documents = table(spark, folder, "documents")
    content = F.encode("text", "UTF-8")
    nul, broken = F.lit(bytes(1)), F.lit(b"\xff")
    kind = F.col("doc_id") % 5
    return documents.select(
        F.col("doc_id").cast("string").alias("path"),
        F.when(kind == 0, F.concat(nul, content))
        .when(kind == 1, F.concat(content, nul))
        .when(kind == 2, F.concat(content, broken))
        .otherwise(content)
        .alias("content"),
    )


@check(
    "keyword_buckets",
    f"""select bucket, count(d.doc_id) as n from (values ('texto_con_palabra'),
        ('texto_sin_palabra'), ('binarios_con_palabra'), ('binarios_sin_palabra'),
        ('no_procesados')) as b(bucket)
    left join (select doc_id, {_BUCKET} as found from documents) d on d.found = b.bucket
    group by bucket""",
)
def keyword_buckets(spark, folder):
    return search.counts(search.search(_contents(spark, folder), _WORD))


@check(
    "keyword_listing",
    f"select {_BUCKET} as bucket, cast(doc_id as varchar) as path from documents",
)
def keyword_listing(spark, folder):
    return search.listing(search.search(_contents(spark, folder), _WORD))


assert len(EXTRACTORS) == len(rp.TEMPLATES)
