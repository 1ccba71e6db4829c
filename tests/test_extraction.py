"""Field specs against a plain model, hand-written reports, long texts, plans."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from checks import reports as rp
from somnotab.functions import text as tx
from somnotab.operators import audit as au
from somnotab.operators import extraction as ex
from somnotab.operators import labelling as lb
from somnotab.plans.extraction import extracted_reports
from somnotab.specs.exams import EXTRACTORS, extractor_for
from somnotab.specs.fields import expand

COUNTS = {
    "BASAL.doc": 40, "BASAL.rtf": 40, "CPAP.doc": 17, "CPAP.docx": 17, "CPAP.rtf": 17,
    "BPAP.doc": 26, "BPAP.rtf": 26, "DAM.doc": 27, "DAM.rtf": 27, "CAPNOGRAFIA.doc": 10,
    "CAPNOGRAFIA.rtf": 10, "ACTIGRAFIA.doc": 7, "AUTOCPAP.docx": 10, "POLIGRAFIA.docx": 11,
}


def test_field_counts():
    assert {f"{e.exam}.{e.ext}": len(e.columns) for e in EXTRACTORS} == COUNTS


def test_group_counts_and_lower_case():
    for extractor in EXTRACTORS:
        for spec in ex._all_fields(extractor):
            pattern = expand(spec.pattern)
            assert re.compile(pattern.replace(r"\z", r"\Z")).groups == spec.groups, spec
            if spec.lowered:
                words = re.sub(r"\\[A-Za-z]", "", pattern + "".join(spec.after) + (spec.before or ""))
                assert words == words.lower(), spec


#: Fields searched in pieces, each as the one long search that it stands for.
ANY_NAME = r"Nombre(?: del paciente)?:? ?\|? ?({words})(?= ?\|? ?Edad\b)"
LONG = {
    ("BASAL.doc", "nombre"): "nombre{colon}([a-z0-9., ]+)(?= ?edad)",
    ("BASAL.rtf", "nombre"): r"nombre ?(?:del ?paciente)?{cell}([a-z0-9., ]+)(?= ?\|? ?(?:edad|\Z))",
    ("CPAP.doc", "nombre_paciente"): r"nombre(?: del paciente)?{sep}({words})(?={sep}edad\b)",
    ("BPAP.doc", "nombre_paciente"): "Nombre{sep}({two words})(?= Edad)",
    ("DAM.doc", "nombre_paciente"): ANY_NAME,
    ("CAPNOGRAFIA.doc", "nombre_paciente"): ANY_NAME,
    ("DAM.doc", "latencia_total"): r"latencia de sueno fue\D*({dec})",
    ("CAPNOGRAFIA.doc", "media_etco2_sueno"): r"durante (?:el )?sueno\D*\d+\D*durante (?:el )?sueno\D*({dec})",
    ("CPAP.doc", "mascara_marca"): r"\b[bc]i?-?pap?p?\b es marca ([a-z0-9 &.-]+?)(?= y se utilizo mascara)",
} | {
    (kind, "mascara_marca"): r"\b[BCbc][iI]?-?[Pp][Aa]?[Pp]\b es marca ([A-Za-z0-9 &.-]+?)(?= y se utilizo mascara)"
    for kind in ("CPAP.docx", "CPAP.rtf", "BPAP.doc", "BPAP.rtf")
}


def test_every_field_in_pieces_has_a_long_search():
    pieces = {(f"{e.exam}.{e.ext}", f.name) for e in EXTRACTORS for f in ex._all_fields(e) if f.pieces}
    assert pieces == set(LONG)


def model(spec, text, kind):
    """The field as one search over the whole slice, without regions or lower-casing."""
    if spec.pieces is not None:
        found = re.search(expand(LONG[kind, spec.name]), text, 0 if spec.cased else re.I)
        return (found[1] or None) if found else None
    prefix = "".join(f"{m}.*?" for m in spec.after)
    suffix = ""
    pattern = expand(spec.pattern).replace(r"[^\d\n]", r"\D")
    if spec.before is not None:
        suffix = f"(?=.*{spec.before})"
        pattern = pattern.replace(r"(?: |\z)", f"(?= |{spec.before})").replace(
            r"(?:edad|\z)", "edad"
        )
    whole = (prefix + pattern + suffix).replace(r"\z", r"\Z")
    found = re.search(whole, text, re.S | (0 if spec.cased else re.I))
    return next((g for g in found.groups() if g), None) if found else None


def extracted(spark, exam, ext, texts):
    extractor = extractor_for(exam, ext)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, section string")
    records = ex.extract_fields(rows, extractor).orderBy("doc_id").collect()
    return extractor, [r.asDict() for r in records]


# Words of the reports, in fragments that often fit together and often do not.
FRAGMENTS = [
    "Nombre: ANA", "Edad: 45 anos", "3 meses", "y 2 dias", "Id: 123", "Identificacion", "Peso: 70,5 kg",
    "peso (kg) 70", "Talla: 170 cm", "talla", "IMC: 24.5", "Cuello: 38 cm", "Perimetro Abdominal: 90 cm",
    "Solicita: Dr X", "Empresa: ACME", "Fecha: 05/03/2024", "PROCEDIMIENTO", "Epworth: 10/24",
    "ARQUITECTURA DE SUENO:", "Tiempo en Cama: 400,5", "Latencia de Sueno: 12", "Eficiencia de Sueno: 80%",
    "Microalertamientos", "Indice Despertares: 12 /Hr.", "DISTRIBUCION DE FASES DE SUENO:", "REM 1 2 3,5",
    "Resumen de eventos respiratorios (Tiempo de sueno total)", "Indice (nº/h TST) 1 2 3 4 5 6",
    "Numero 1 2 3 4 5 6 7 8", "Numero|1|2|3|4|x|", "Suma AP", "RERA", "OXIMETRIA:", "<90 (min) 1 2 3 4,5",
    "Indice Desat (#/hour) 1 2 3 4", "INTERPRETACION", "T90: 5,5 %", "7", "|",
]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(FRAGMENTS), max_size=40).map(" ".join), min_size=60, max_size=60))
def test_regions_equal_one_long_search(spark, texts):
    extractor, records = extracted(spark, "BASAL", "doc", texts)
    common = [f for f in extractor.fields]
    for text, record in zip(texts, records):
        for spec in common:
            assert record[spec.name] == model(spec, text, "BASAL.doc"), (spec.name, text)


TITRATION = [
    "interpretacion arquitectura del sueno:", "durmio 350,5 minutos de los 400,5", "cama (87,5%)", "mascara",
    'mascara nasal tamano "M"', "tamano", "(ref. R 1)", "(Ref. R2)", "es marca X y se utilizo mascara", "CPAP", "BiPAP",
    "porcentaje de sueno REM de 20,5%", "IAH: 25,5/hr", "IAH 12 /hora", "sueno profundo", "de 15,5%", "edad: 45 anos",
    "nombre ANA-MARIA DE LA O edad", "a una presion de 10 cm de agua se observo", "id: AB1234", "procedimiento",
    "fecha: 2024/05/01",
]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(TITRATION), max_size=20).map(" ".join), min_size=60, max_size=60))
def test_titration_regions_equal_one_long_search(spark, texts):
    for exam, ext in (("CPAP", "doc"), ("CPAP", "docx"), ("BPAP", "rtf")):
        extractor, records = extracted(spark, exam, ext, texts)
        for text, record in zip(texts, records):
            for spec in extractor.fields:
                assert record[spec.name] == model(spec, text, f"{exam}.{ext}"), (exam, ext, spec.name, text)


def shuffled_texts(template, seed, n=150):
    """Texts of the template's own phrases: in order, with gaps, in another order, in other case."""
    draw = random.Random(seed)
    texts = []
    for _ in range(n):
        filled = re.sub(r"\{[^}]*\}", lambda _: draw.choice(SAMPLES), template.text)
        filled = " ".join(re.sub("[«»]", "", filled).translate(FOLD).split())
        words = re.split(r"(?<=[ |])", filled)
        chunks, i = [], 0
        while i < len(words):
            size = draw.randint(1, 8)
            chunks.append("".join(words[i : i + size]))
            i += size
        chunks = [c for c in chunks if draw.random() > 0.15]
        if draw.random() < 0.3:
            draw.shuffle(chunks)
        if draw.random() < 0.2:
            chunks = chunks + chunks
        text = "".join(chunks)
        texts.append(" ".join(draw.choice([text, text, text.upper(), text.lower()]).split()))
    return texts


SAMPLES = ["12,5", "45", "7", "ANA PEREZ", "05/03/2024", "2024/03/05", "R-1", "14/10", "anos", "M", "1:02:03", "kg"]
FOLD = str.maketrans(tx.FOLDED_FROM, tx.FOLDED_TO)


@pytest.mark.parametrize("template", rp.TEMPLATES, ids=lambda t: f"{t.exam}.{t.ext}")
def test_every_field_equals_one_long_search(spark, template):
    texts = shuffled_texts(template, f"{template.exam}{template.ext}")
    extractor, records = extracted(spark, template.exam, template.ext, texts)
    found = set()
    for text, record in zip(texts, records):
        for spec in extractor.fields:
            assert record[spec.name] == model(spec, text, f"{template.exam}.{template.ext}"), (spec.name, text)
            if record[spec.name] is not None:
                found.add(spec.name)
    assert len(found) > len(extractor.fields) / 2


def test_header_variants(spark):
    texts = [
        "Nombre: ANA PEREZ Edad: 45 anos Id 12",
        "Edad: 2 meses y 3 dias Identificacion: X9 Peso",
        "Peso: 70kg Talla: 1.70 m IMC",
        "Peso (kg) 70 Talla (cm) 170 IMC: 24,5 Cuello: 38 cm Perimetro",
        "Empresa: ACME 05/03/2024",
        "perimetro abdominal: 90 cm solicita: X eps",
        "Perimetro Abdominal: 90 cm Solicita: X eps",
    ]
    _, got = extracted(spark, "BASAL", "doc", texts)
    assert got[0]["nombre"] == "ANA PEREZ " and got[0]["edad_anos"] == "45"
    assert (got[1]["edad_anos"], got[1]["edad_meses"], got[1]["edad_dias"]) == (None, "2", "3")
    assert got[1]["id"] == "X9"
    assert (got[2]["peso"], got[2]["medida_peso"], got[2]["talla"]) == (None, "kg", "1.70")
    assert (got[3]["peso"], got[3]["medida_peso"], got[3]["talla"], got[3]["medida_talla"]) == ("70", "kg", "170", "cm")
    assert got[4]["empresa"] == "ACME"
    assert got[5]["perimetro_abdominal"] is None and got[5]["solicita"] == "X"
    assert (got[6]["perimetro_abdominal"], got[6]["medida_perimetro_abdominal"]) == ("90", "cm")


def test_layout_variants(spark):
    head = "Resumen de eventos respiratorios (Tiempo de sueno total) "
    texts = [
        head + "Suma AP Numero 1 2 3 4 5 6 7 8",
        head + "Suma AP RERA Numero 1 2 3 4 5 6 7 8",
        head + "RERA Numero|1|2|3|4|5 y 6|",
        head + "sumaAP Numero 1 2 3 4 5 6 7 8",
    ]
    _, got = extracted(spark, "BASAL", "doc", texts)
    assert [r["numero_eventos_ah"] for r in got] == ["6", "8", "5 y 6", None]
    index = "Indice [nº/h]|1|2|3|4|5|6|"
    texts = [
        head + "|Suma AP| Numero|1|2|3|4|5|6|7|8| " + index,
        head + "|Suma AP| RERA |Numero|1|2|3|4|5|6|7|8| " + index,
        head + "|Suma AP RERA| Numero|1|2|3|4|5|6|7|8| " + index,
    ]
    _, got = extracted(spark, "BASAL", "rtf", texts)
    assert [(r["numero_eventos_ah"], r["ih"], r["iah"]) for r in got] == [
        ("6", "4", "5"), ("8", "5", "6"), ("5", "4", "5"),
    ]


def test_reference_label_is_the_short_one(spark):
    _, got = extracted(spark, "AUTOCPAP", "docx", ["referencia: X1)", "ref: X2)", "talla M, ref"])
    assert [r["mascara_referencia"] for r in got[:2]] == ["erencia: X1", "X2"]
    assert got[2]["mascara_tamano"] == "M"


def test_actigraphy_identifier_label_is_one_letter(spark):
    _, got = extracted(spark, "ACTIGRAFIA", "doc", ["ID: 12", "CD: 13", "X|: 14", "CC: 15"])
    assert [r["id_paciente"] for r in got] == ["12", "13", "14", None]


@pytest.mark.parametrize("extractor", EXTRACTORS, ids=lambda e: f"{e.exam}.{e.ext}")
def test_long_texts_do_not_exhaust_the_stack(spark, extractor):
    words = " ".join(f"palabra{i}" for i in range(20_000))
    texts = [f"Nombre del paciente: {words}", f"nombre: {words} id edad {words}", words.replace("palabra", "p a l-")]
    _, got = extracted(spark, extractor.exam, extractor.ext, texts)
    assert len(got) == 3


def test_long_text_with_many_numbers_is_linear(spark):
    numbers = " ".join(str(i) for i in range(30_000))
    start = time.time()
    extracted(spark, "BASAL", "doc", [f"peso {numbers}", f"arquitectura de sueno: {numbers}"])
    assert time.time() - start < 30


# Opening words of all kinds, and what closes a value of any of them.
OPENINGS = [
    "nombre", "Nombre:", "nombre ana", "Nombre ANA |", "id 5", "peso", "peso 70 kg", "talla (cm) 170 ", "solicita",
    "Solicita: X", "Empresa: Y", "empresa", "latencia de sueno fue", "durante el sueno", "CPAP es marca A",
    "mascara tamano (ref. R", "edad 45 anos", "sexo: F", ", ,", "fecha",
]
CLOSINGS = "edad Edad peso talla imc empresa eps |Empresa |Edad Empresa |Fecha Fecha y se utilizo mascara sexo id 12,5 )"


def seconds(spark, extractor, n):
    """Openings behind, before and around their closing words, the last ones with something in between, too."""
    texts = [f"nombre: {'id ' * n}5 edad", f"nombre: edad {'id ' * n}5 x edad", f"nombre: {'id: ' * n}; 5 edad {'cc ' * n} 7 edad"]
    for opening in OPENINGS:
        many = " ".join([opening] * (n // len(opening.split())))
        texts += [many, f"{CLOSINGS} {many}", f"{many} {CLOSINGS}", f"{many} ; {CLOSINGS} {many}", f"mascara tamano {many} 7 {CLOSINGS}"]
    start = time.perf_counter()
    extracted(spark, extractor.exam, extractor.ext, texts)
    return time.perf_counter() - start


@pytest.mark.parametrize("extractor", EXTRACTORS, ids=lambda e: f"{e.exam}.{e.ext}")
def test_repeated_opening_words_are_linear(spark, extractor):
    """A hundred texts of ten and twenty thousand words."""
    seconds(spark, extractor, 100)
    half, whole = seconds(spark, extractor, 10_000), seconds(spark, extractor, 20_000)
    assert whole < 2.5 * half + 1
    assert whole < 20


#: Parts of names and their labels, so that openings meet inside values, at their ends and at closings.
NAMES = [
    "nombre", "Nombre", "nombre:", "Nombre:", "Nombre |", "nombre|", "Nombre del paciente", "nombre del paciente:", "edad",
    "Edad", "|Edad", "|edad", ": edad", "edades", "ANA", "ana-maria", ";", "|", "5", "12,5", "7", "CPAP es marca", "bipap es marca X",
    "y se utilizo mascara", "cc: 5", "ti", "id a5b", "nombre: x", "latencia de sueno fue", "durante el sueno", "durante sueno", "peso", "70 kg", "talla", "imc", "id",
    "solicita", "Solicita: Z", "empresa", "|Empresa", "Empresa", "Fecha", "|Fecha", "(ref. R", ")", "mascara tamano",
]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(NAMES), max_size=14), min_size=150, max_size=150), st.data())
def test_pieces_equal_one_long_search(spark, words, data):
    glue = data.draw(st.sampled_from([" ", "", None]))
    draw = random.Random(len(words[0]))
    texts = [" ".join("".join(w + (draw.choice([" ", ""]) if glue is None else glue) for w in text).split()) for text in words]
    for e in EXTRACTORS:
        extractor, records = extracted(spark, e.exam, e.ext, texts)
        for text, record in zip(texts, records):
            for spec in extractor.fields:
                assert record[spec.name] == model(spec, text, f"{e.exam}.{e.ext}"), (e.exam, e.ext, spec.name, text)


def test_all_extractors_in_one_pass(spark):
    text = (
        "informe de polisomnografia basal con dispositivo mandibular Nombre: ANA Edad: 45 anos "
        "T90: 5,5% saturacion o2 minima durante el sueno CONCLUSION"
    )
    rows = [(1, "/a.doc", "doc", text), (2, "/b.docx", "docx", text), (3, "/c", "pdf", text)]
    reports = spark.createDataFrame(rows, "doc_id long, path string, ext string, text string")
    wide = extracted_reports(reports).persist()
    got = {(r["doc_id"], r["exam_type"]): r["status"] for r in wide.collect()}
    assert got == {
        (1, "BASAL"): "ok", (1, "DAM"): "ok", (2, "BASAL"): "no_extractor",
        (2, "DAM"): "no_extractor", (3, None): "unsupported_ext",
    }
    basal = ex.records_of(wide, "BASAL", "doc").first()
    narrow = ex.extract(lb.label_and_slice(reports), "BASAL", "doc").first()
    for name in extractor_for("BASAL", "doc").columns:
        assert basal[name] == narrow[name]
    assert basal["fuente"] == "/a.doc"
    lines = au.audit(wide).collect()
    missing = [r["field"] for r in lines if r["reason"] == "missing_field" and r["exam_type"] == "DAM"]
    assert set(extractor_for("DAM", "doc").columns) - set(missing) == {"nombre_paciente", "edad_paciente", "t90"}
    reasons = {(r["doc_id"], r["reason"], r["level"]) for r in lines if r["reason"] != "missing_field"}
    assert reasons == {(2, "no_extractor", "WARNING"), (3, "unsupported_ext", "WARNING")}
    wide.unpersist()


def test_switched_off_types_are_not_extracted(spark):
    text = "informe de capnografia Nombre: ANA Edad CONCLUSION"
    reports = spark.createDataFrame([(1, "/a", "doc", text)], "doc_id long, path string, ext string, text string")
    [row] = extracted_reports(reports, exams=("BASAL",)).collect()
    assert (row["status"], row["record"]) == ("no_extractor", None)


def test_missing_text(spark):
    frame = spark.createDataFrame([("a", None)], "x string, y string")
    assert ex.with_missing_text(frame, ["x", "y"]).first() == ("a", "N/A")


def test_filters_do_not_repeat_the_search(spark):
    reports = spark.createDataFrame([(1, "/a", "doc", "x")], "doc_id long, path string, ext string, text string")
    plan = ex.records_of(extracted_reports(reports), "BASAL", "doc")._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line.split("(")[0] or " Filter " in line]
    assert filters and not any("regexp_extract" in line for line in filters)
    assert "Exchange" not in plan


def test_searches_of_records_are_compiled(spark):
    """Spark interprets what stands inside a lambda and its array; no search does, and the audit has no lambda of its own."""
    slices = spark.createDataFrame(
        [(1, "doc", "BASAL", "x", "ok")], "doc_id long, ext string, exam_type string, section string, status string"
    )
    records = ex.extract_all(slices)
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    audited = au.audit(records)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" in plan and "transform(" in plan
    assert "regexp_extract(" not in plan.split("transform(", 1)[1].split("lambdafunction", 1)[0]
    assert "filter(" not in audited


def test_audit_lines_of_lost_fields_and_failed_rows(spark):
    columns = extractor_for("AUTOCPAP", "docx").columns
    values = [None if i in (0, 3, len(columns) - 1) else "x" for i in range(len(columns))]
    full = ["x"] * len(columns)
    rows = [
        (1, "docx", "AUTOCPAP", "ok", values),
        (2, "docx", "AUTOCPAP", "ok", full),
        (3, "pdf", None, "unsupported_ext", None),
    ]
    schema = "doc_id long, ext string, exam_type string, status string, record array<string>"
    lines = {tuple(r) for r in au.audit(spark.createDataFrame(rows, schema)).collect()}
    lost = {(1, "AUTOCPAP", "WARNING", "missing_field", columns[i]) for i in (0, 3, len(columns) - 1)}
    assert lines == lost | {(3, None, "WARNING", "unsupported_ext", None)}
