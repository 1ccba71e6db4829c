"""Schemas, profile, batch gate, workbooks, search, inventory, flows."""

import csv
import io
import json
import os
import random
import subprocess
import sys
from datetime import date, datetime, timedelta, timezone
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from somnotab.operators import ingest, inventory, profile, profile_states, schema, search, workbook
from somnotab.plans import extraction as flow
from somnotab.plans import profiles
from somnotab.plans.load import load_batch
from somnotab.session import discard
from somnotab.sources import files, records, sinks, tables, tree, warehouse
from somnotab.specs import workbook as wb
from somnotab.streaming.reports import append_new_reports, write_new_reports

NOW = datetime(2026, 1, 15, 10, 30, tzinfo=timezone(timedelta(hours=-5)))


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_schema_comparison(spark):
    frames = {
        "base": spark.createDataFrame([], "a int, b int"),
        "other": spark.createDataFrame([], "b int, c int"),
    }
    columns = schema.column_table(frames)
    missing = {r["source"]: r["missing"] for r in schema.missing_columns(columns).collect()}
    assert missing == {"base": ["c"], "other": ["a"]}
    against = {r["source"]: (r["missing"], r["extra"]) for r in schema.differences_from_base(columns, "base").collect()}
    assert against == {"base": ([], []), "other": (["a"], ["c"])}
    rows = spark.createDataFrame([("base",)], "source string")
    shapes = {r["source"]: (r["n_rows"], r["n_columns"]) for r in schema.source_shapes(rows, columns).collect()}
    assert shapes == {"base": (1, 2), "other": (0, 2)}
    with pytest.raises(ValueError):
        schema.differences_from_base(columns, "absent")


@pytest.fixture
def profiled(spark):
    rows = [
        (i, None if i == 3 else float(i % 4), "x" if i < 6 else f"v{i}", date(2024, 1 + i % 2, 5), -9999 if i == 2 else i)
        for i in range(20)
    ]
    return spark.createDataFrame(rows, "k int, n double, c string, fecha date, s int")


def test_profile(profiled):
    lines = {r["variable"]: r for r in profile.profile(profiled, ["c", "fecha"], ["k"]).collect()}
    assert list(lines) == ["k", "n", "c", "fecha", "s"]
    n = lines["n"]
    assert (n["count"], n["unique"], n["missing"], n["sample"]) == (19, "4 (20.00%)", "1 (5.00%)", "1.0")
    assert (n["min"], n["max"], n["frequencies"]) == ("0.00", "3.00", "N/A")
    assert lines["s"]["min"] == "0.00" and lines["s"]["unique"] == "20 (100.00%)"
    c = lines["c"]
    assert c["frequencies"].startswith('"x: 6 | v10: 1 | v11: 1') and c["frequencies"].endswith(' | OTROS: 5"')
    assert (c["min"], lines["fecha"]["frequencies"]) == ("N/A", "N/A")


def test_profile_of_nothing(profiled):
    lines = {r["variable"]: r for r in profile.profile(profiled.where("false"), ["c"]).collect()}
    assert lines["n"]["unique"] == "0 (nan%)" and lines["n"]["mean"] == "nan"
    assert lines["c"]["sample"] == "N/A" and lines["c"]["frequencies"] == "N/A"


def test_top_frequencies_are_limited_before_the_shuffle(profiled):
    frequencies = profile.value_frequencies(profiled, ["c"])
    assert "WindowGroupLimit" in plan_of(profile.top_frequencies(frequencies))


def test_profile_scans_its_table_once_more_than_the_frequencies(profiled, tmp_path):
    profiled.write.parquet(f"{tmp_path}/t")
    described = profile.profile(profiled.sparkSession.read.parquet(f"{tmp_path}/t"), ["c"], ["k"])
    plan = plan_of(described)
    # The statistics read the table; totals and best values read the stored frequencies.
    assert plan.count("FileScan") == 3 and plan.count(f"{tmp_path}/t") == 1
    assert plan.count("Exchange") <= 5
    discard(described)


def test_number_display(spark):
    numbers = [0.125, 0.375, 2.675, -4.375, 1e6, 1000000.5, 7.125e7, 9.999e6, -2.5e7, 1.5e300, 0.0, 1234.5]
    frame = spark.createDataFrame([(x,) for x in numbers], "x double")
    got = [r[0] for r in frame.select(profile.display_number(F.col("x"))).collect()]
    assert got == [f"{x:.2E}" if abs(x) > 1e6 else f"{x:.2f}" for x in numbers]


def batch(spark, rows):
    return spark.createDataFrame(rows, "uuid string, day string, x string")


GATE_CASES = [
    ([("a", "2024-05-01", ""), ("b", "2024-05-02T10:00", "1")], "success", None),
    ([("a", "2024-05-01", ""), ("a", "2024-05-02", "")], "error", "duplicates_in_batch"),
    ([("a", "01/05/2024", "")], "error", "bad_date"),
    ([("a", "2024-02-30", ""), ("", "2024-05-01", "")], "error", "bad_date"),
    ([("", "2024-05-01", ""), (None, "x", "")], "skip", "no_identifiers"),
    ([("a", "", ""), ("b", None, "")], "skip", "no_identifiers"),
    ([], "skip", "no_identifiers"),
    ([("a", "2024-05-01", ""), ("b", "", "")], "exception", "undated_row"),
    ([("a", "2024-05-01", ""), ("", "mal", "")], "exception", "undated_row"),
    ([("a", "2024-05-01", ""), ("", "2024-05-01", "")], "success", None),
]


@pytest.mark.parametrize("rows, status, reason", GATE_CASES)
def test_gate(spark, rows, status, reason):
    row = ingest.gate(batch(spark, rows), "day").first()
    assert (row["status"], row["reason"], row["n_rows"]) == (status, reason, len(rows))


def test_load(spark, tmp_path):
    def load(rows, table="t", field="day"):
        return load_batch(spark, batch(spark, rows), str(tmp_path), table, field, NOW)

    first = load([("a", "2024-05-01T09:00", ""), ("b", "2024-05-02", "1"), ("", "2024-05-03", "2")])
    assert (first["status"], first["rows_inserted"]) == ("success", 3)
    again = load([("a", "2024-05-02", ""), ("c", "2024-05-01", "")])
    assert (again["status"], again["reason"], again["existing"]) == ("error", "already_loaded", ["a"])
    elsewhere = load([("a", "2024-06-01", "")])
    assert elsewhere["status"] == "success"
    assert load([("d", "2024-05-01", ""), ("e", None, "")])["status"] == "exception"
    assert load([("d", "2024-05-01", "")], table="no-name")["status"] == "error"
    assert load([("d", "2024-05-01", "")], field="")["status"] == "error"
    assert load([("d", "2024-05-01", "")], field="falta")["status"] == "exception"
    stored = warehouse.read(spark, f"{tmp_path}/t")
    assert stored.count() == 4
    row = stored.where("uuid = 'a' and day = '2024-05-01'").first()
    assert row["x"] is None and row["day"] == date(2024, 5, 1) and row["migrado"].timestamp() == NOW.timestamp()
    assert stored.where("uuid is null").count() == 1
    keyed = ingest.keyed_rows(batch(spark, [("a", "2024-05-01", "")]), "day")
    plan = plan_of(ingest.in_touched_partitions(stored, keyed, "day"))
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(day" in plan or "PartitionFilters: [cast(day" in plan


def test_days_between_are_joined(spark):
    target = spark.createDataFrame(
        [("a", date(2024, 5, 1)), ("b", date(2024, 6, 1)), ("c", date(2024, 5, 3))], "uuid string, day date"
    )
    rows = [("a", "2024-05-01", ""), ("b", "2024-05-02", ""), ("c", "2024-05-04", "")]
    keyed = ingest.keyed_rows(batch(spark, rows), "day")
    assert [r["uuid"] for r in ingest.already_loaded(keyed, target, "day").collect()] == ["a"]


def test_load_reads_its_source_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            seen.add(rows.num_rows)
            yield rows

    source = batch(spark, [("a", "2024-05-01", "1"), ("b", "2024-05-02", "2")])
    source = source.mapInArrow(counted, source.schema)
    assert load_batch(spark, source, str(tmp_path), "t", "day", NOW)["rows_inserted"] == 2
    assert seen.value == 2
    bare = load_batch(spark, source, str(tmp_path), "t", "day", datetime(2026, 1, 1))
    assert bare["status"] == "error"


def test_workbook_without_named_cells_is_rejected(spark):
    cells = spark.createDataFrame([("/w/x.xlsx", "ZZ9", "v")], "file string, cell string, value string")
    classified = workbook.classify(workbook.pivot_cells(cells))
    assert [r["ruta_archivo"] for r in workbook.rejected(classified).collect()] == ["/w/x.xlsx"]
    assert workbook.accepted(classified).count() == 0


def workbook_cells(spark):
    def sheet(name, **cells):
        return [(name, cell, value) for cell, value in cells.items()]

    rows = (
        sheet("tele", G9="SI", B7="con epoc", B1="Teleconsulta", H18="h", I18="i", G6="1")
        + sheet("sitio", G9="SI", B7="EPOC", H18="h", I18="i")
        + sheet("minuscula", G9="si", B7="EPOC", B1=None)
        + sheet("asma", G9="SI", B7="asma")
        + sheet("nada", Z1="x", A1="y", B1="b")
    )
    return spark.createDataFrame(rows, "file string, cell string, value string")


def test_workbooks(spark, tmp_path):
    classified = workbook.classify(workbook.pivot_cells(workbook_cells(spark)))
    records, refused = sinks.write_workbooks(classified, str(tmp_path))
    accepted = {r["ruta_archivo"]: r for r in tables.read_table(spark, records).collect()}
    assert {k: (r["modalidad"], r["resist_final"]) for k, r in accepted.items()} == {
        "tele": ("TELE", "h"), "sitio": ("PRESENCIAL", "i"),
    }
    assert len(accepted["tele"]) == 23 and len(wb.FIELD_CELLS) == 21
    rejected = {r["ruta_archivo"]: (r["razon"], r["contenido_B7"]) for r in tables.read_table(spark, refused).collect()}
    assert rejected == {
        "minuscula": ("No cumple con 'SI' en G9", "EPOC"),
        "asma": ("No cumple con 'EPOC' en B7", "asma"),
        "nada": ("No cumple con 'SI' en G9, No cumple con 'EPOC' en B7", None),
    }


def test_cells_in_any_order_are_merged(spark):
    """Cells of a file in many batches and tasks, repeated, nobody's, without value, cell or file: the greatest value of each."""
    source = random.Random(5)
    files = [None, "", *(f"/w/{i}.xlsx" for i in range(30))]
    values = [None, "", "a", "B", "\u00e9", "\U0001f600", "\uffff", "10", "9"]
    rows = [
        (source.choice(files), source.choice([None, "ZZ9", *wb.CELLS]), source.choice(values)) for _ in range(3000)
    ] + [("nada", "ZZ9", "x"), ("vacio", "G9", None), (None, None, None)]
    cells = spark.createDataFrame(rows, "file string, cell string, value string").repartition(3)
    wanted = {}
    for file, cell, value in rows:
        found = wanted.setdefault(file, dict.fromkeys(wb.CELLS))
        if cell in found and value is not None:
            found[cell] = max([v for v in (found[cell], value) if v is not None], key=str.encode)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for n in (7, 10_000):
            spark.conf.set(size, n)
            got = [r.asDict() for r in workbook.pivot_cells(cells).collect()]
            assert {r.pop("file"): r for r in got} == wanted and len(got) == len(wanted)
    finally:
        spark.conf.set(size, before)
    assert workbook.pivot_cells(cells.where("false")).collect() == []


_ONE_TASK_OF_CELLS = """
import sys
from pyspark.sql import SparkSession, functions as F
from somnotab.operators import workbook
from somnotab.specs import workbook as wb
log = sys.argv[1]
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.shuffle.spill.numElementsForceSpillThreshold", "5000").config("spark.eventLog.enabled", "true")
    .config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.compress", "false")
    .config("spark.eventLog.dir", "file://" + log).getOrCreate())
sheet = F.explode(F.array(*[F.lit(c) for c in wb.CELLS])).alias("cell")
cells = spark.range(0, 2000, 1, 1).select(F.concat(F.lit("/w/"), "id").alias("file"), sheet, F.col("id").cast("string").alias("value"))
assert workbook.pivot_cells(cells).where("G6 = H5").count() == 2000
spark.stop()
"""


def test_a_task_sorts_files_not_cells(tmp_path):
    """48,000 cells of 2,000 workbooks in one task, where a sort of over 5,000 rows is spilled: none is."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run(
        [sys.executable, "-c", _ONE_TASK_OF_CELLS, str(tmp_path)],
        cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300,
    )
    assert run.returncode == 0, run.stderr[-2000:]
    (log,) = tmp_path.iterdir()
    ends = [e for e in map(json.loads, log.read_text().splitlines()) if e["Event"] == "SparkListenerTaskEnd"]
    assert ends and sum(e["Task Metrics"]["Disk Bytes Spilled"] for e in ends) == 0


def test_workbook_names(values):
    names = ["X EGRESO.xlsx", "SEGUIMIENTO 2.xlsx", "egreso.xlsx", "EGRESO.XLSX", "EGRESO.xls"]
    assert values(workbook.is_rehab_workbook, names) == [True, True, False, False, False]


def test_search(spark):
    rows = [
        ("t1", b"la palabra"), ("t2", b"La Palabra"), ("b1", b"\0palabra"), ("b2", b"\0"),
        ("late", b"x" * 1024 + b"\0palabra"), ("early", b"x" * 1023 + b"\0palabra"),
        ("bad", b"\xff palabra"), ("utf", "año palabra".encode()), ("none", None), ("empty", b""),
    ]
    frame = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "path string, content binary")
    found = search.search(frame, "palabra")
    got = {r["path"]: r["bucket"] for r in found.collect()}
    assert got == {
        "t1": search.TEXT_WITH, "t2": search.TEXT_WITHOUT, "b1": search.BINARY_WITH,
        "b2": search.BINARY_WITHOUT, "late": search.TEXT_WITH, "early": search.BINARY_WITH,
        "bad": search.TEXT_WITHOUT, "utf": search.TEXT_WITH, "none": search.NOT_PROCESSED,
        "empty": search.TEXT_WITHOUT,
    }
    counts = {r["bucket"]: r["n"] for r in search.counts(found).collect()}
    assert counts[search.TEXT_WITH] == 3 and counts[search.NOT_PROCESSED] == 1
    assert [r["path"] for r in search.listing(found).collect()][:3] == ["b1", "early", "b2"]


def test_extensions(values):
    paths = ["/a/x.DOC", "/a/.doc", "/a/x.tar.gz", "/a.d/x", "/a/x.", "x.rtf"]
    assert values(inventory.extension, paths) == ["doc", "", "gz", "", "", "rtf"]


def test_file_tree(spark, tmp_path):
    for name in ("x.doc", "s/y.DOCX", "s/t/z.pdf", "u/v/w.rtf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("palabra")
    listed = inventory.inventory(files.list_files(spark, str(tmp_path)))
    row = inventory.counters(listed).first()
    assert (row["num_files"], row["valid_files"], row["discarded_files"]) == (4, 3, 1)
    assert inventory.folder_count(listed, f"file:{tmp_path}/").first()["num_dirs"] == 4
    found = search.search(files.read_contents(spark, str(tmp_path)), "palabra")
    assert {r["bucket"] for r in found.collect()} == {search.TEXT_WITH}
    with pytest.raises(ValueError):
        files.validate_folder(spark, f"{tmp_path}/absent")
    with pytest.raises(ValueError):
        files.validate_folder(spark, f"{tmp_path}/x.doc")


def test_json_batch(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"uuid": "a", "day": "2024-05-01"},\n {"uuid": "b"}]')
    frame = tables.read_batch(spark, str(tmp_path / "array.json"), "uuid string, day string", array_file=True)
    assert {(r["uuid"], r["day"]) for r in frame.collect()} == {("a", "2024-05-01"), ("b", None)}


REPORTS = "doc_id long, path string, ext string, text string"
BASAL = (
    "Informe de polisomnografía basal Nombre: ANA Edad: 45 años Id: 1 T90 INTERPRETACIÓN T90: 5,5 % "
    "Saturación O2 mínima durante el sueño"
)


def test_extraction_flow_appends(spark, tmp_path):
    rows = [(1, "/a.doc", "doc", BASAL), (2, "/b.doc", "doc", "informe de capnografia Nombre: EVA Edad CONCLUSION"), (3, "/c", "pdf", "x")]
    frame = spark.createDataFrame(rows, REPORTS)
    for _ in range(2):
        out = flow.run(frame, str(tmp_path))
    assert sorted(p.rsplit("/", 1)[1] for p in out.results) == ["resultados_capnografia_doc.csv", "resultados_psg_doc.csv"]
    raw = spark.read.option("header", True).csv(f"{tmp_path}/resultados_psg_doc.csv").drop("run")
    assert len(raw.columns) == 41 and raw.count() == 2
    assert {(r["edad_anos"], r["peso"], r["fuente"], r["t90"]) for r in raw.collect()} == {("45", "N/A", "/a.doc", "5,5")}
    back = tables.read_results(spark, out.results)
    assert back.count() == 4 and back.where("peso is null").count() == 4
    assert spark.read.parquet(out.audit).where("reason = 'unsupported_ext'").count() == 2


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    frame = spark.createDataFrame([(1, "/a.doc", "doc", BASAL), (2, "/c", "pdf", "x")], REPORTS)
    for run_id in ("r1", "r2", "r1", "r2"):
        out = flow.run(frame, str(tmp_path), run_id=run_id)
    back = tables.read_results(spark, out.results)
    assert back.count() == 2 and "run" not in back.columns
    assert spark.read.parquet(out.audit).where("reason = 'unsupported_ext'").count() == 2


def test_stream_appends_each_report_once(spark, tmp_path):
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for i, text in enumerate((BASAL, "otra cosa")):
        spark.createDataFrame([(i, f"/{i}", "doc", text)], REPORTS).write.mode("append").parquet(source)
        for _ in range(2):
            stream = spark.readStream.schema(REPORTS).parquet(source)
            append_new_reports(stream, output, checkpoint).awaitTermination()
        assert spark.read.parquet(output).count() == i + 1
    statuses = {r["doc_id"]: r["status"] for r in spark.read.parquet(output).collect()}
    assert statuses == {0: "ok", 1: "unknown_type"}


def _random_csv(rng, rows, end):
    """Values with quotes, commas and line ends of every kind."""
    made = [["".join(rng.choice('xy ,"\n\r') for _ in range(rng.randrange(9))) for _ in range(3)] for _ in range(rows)]
    made = [["id", "a,b", "texto"], *[r for r in made if any(r)]]
    buffer = io.StringIO(newline="")
    csv.writer(buffer, quoting=csv.QUOTE_ALL, lineterminator=end).writerows(made)
    return made, buffer.getvalue()


@pytest.mark.parametrize("size", ["70", "333", "1m"])
def test_records_across_cut_points(spark, tmp_path, size):
    """Whatever the splits, every record is whole, in order and once."""
    rng = random.Random(size)
    want = {}
    for name, end in (("a", "\n"), ("b", "\r\n"), ("c d", "\n")):
        want[f"{name}.csv"], text = _random_csv(rng, 25, end)
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    (tmp_path / "none.csv").write_text("")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {}
        for r in records.records(spark, str(tmp_path)).orderBy("file", "split", "at").collect():
            [values] = csv.reader(io.StringIO(r["record"], newline=""))
            got.setdefault(unquote(r["file"]).rsplit("/", 1)[1], []).append(values)
        assert got == want
        frame = tables.read_results(spark, [str(tmp_path)], multi_line=True)
        assert frame.columns == ["id", "a,b", "texto"]
        missing = tables.NULL_TEXTS
        rows = [tuple(v if v not in missing else None for v in r) for rows in want.values() for r in rows[1:]]
        assert sorted(map(tuple, frame.collect()), key=repr) == sorted(rows, key=repr)
        counts = {r["source"]: r["n_rows"] for r in tables.folder_rows(spark, [str(tmp_path)], multi_line=True).collect()}
        assert counts == {name: len(rows) - 1 for name, rows in want.items()}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_split_starts_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    made, text = _random_csv(random.Random(3), 60, "\n")
    (tmp_path / "x.csv").write_text(text, newline="")
    monkeypatch.setattr(records, "BROADCAST_BYTES", 0)
    rows = records.records(spark, str(tmp_path)).orderBy("split", "at").collect()
    assert [next(csv.reader(io.StringIO(r["record"], newline=""))) for r in rows] == made


def test_folder_to_schema_table(spark, tmp_path):
    (tmp_path / "uno.csv").write_text("﻿id,peso\n1,2\n\n3,4\n", encoding="utf-8")
    (tmp_path / "dos.csv").write_text('id,"talla, cm","dos\nlineas"\r\n1,2,3\r\n')
    (tmp_path / "tres.csv").write_text("id")
    (tmp_path / "tres y medio.csv").write_text("id,x" + "y" * 9000 + "\n")
    (tmp_path / "vacio.csv").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "uno.csv").write_text("id,edad\n5,6\n")
    folder = str(tmp_path)
    columns = tables.folder_columns(spark, [folder])
    pairs = {}
    for r in columns.collect():
        pairs.setdefault(r["source"], set()).add(r["column"])
    assert pairs == {
        "uno.csv": {"id", "peso", "edad"}, "dos.csv": {"id", "talla, cm", "dos\nlineas"}, "tres.csv": {"id"},
        "tres y medio.csv": {"id", "x" + "y" * 9000},
    }
    rows = {r["source"]: r["n_rows"] for r in tables.folder_rows(spark, [folder], multi_line=True).collect()}
    assert rows == {"uno.csv": 3, "dos.csv": 1, "tres.csv": 0, "tres y medio.csv": 0}
    shapes = schema.source_shapes(tables.folder_rows(spark, [folder], multi_line=True), columns).collect()
    assert {tuple(r) for r in shapes} == {("uno.csv", 3, 3), ("dos.csv", 1, 3), ("tres.csv", 0, 1), ("tres y medio.csv", 0, 2)}
    missing = {r["source"]: r["missing"] for r in schema.missing_columns(columns).collect()}
    assert missing["uno.csv"] == ["dos\nlineas", "talla, cm", "x" + "y" * 9000]
    [base] = schema.differences_from_base(columns, "uno.csv").where("source = 'tres.csv'").collect()
    assert (base["missing"], base["extra"]) == (["edad", "peso"], [])


def test_headers_where_only_spark_opens_files(spark, tmp_path, monkeypatch):
    (tmp_path / "a b.csv").write_text("﻿id,peso\n1,2\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("id\n1\n")
    monkeypatch.setattr(tables, "can_open", lambda path: False)
    found = {r["file"].rsplit("/", 1)[1]: r["header"] for r in tables.headers(spark, [str(tmp_path)]).collect()}
    assert found == {"a b.csv": "id,peso", "c.csv": "id"}


def test_only_the_first_bytes_of_a_file_are_read(tmp_path, monkeypatch):
    (tmp_path / "big.csv").write_text("id,peso\n" + "1,2\n" * 100_000)
    read = []

    class Stream:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.stream.close()

        def read(self, n):
            read.append(n)
            return self.stream.read(n)

    class System:
        def open_input_stream(self, name, buffer_size):
            return Stream(open(name, "rb"))

    monkeypatch.setattr(tables, "system_of", lambda path: (System(), path.removeprefix("file:")))
    assert tables._first_record(f"file:{tmp_path}/big.csv") == "id,peso"
    assert sum(read) == 4096


def _stored(spark, tmp_path):
    rows = warehouse.read(spark, f"{tmp_path}/t")
    return [] if rows is None else sorted(r["uuid"] for r in rows.collect())


@pytest.mark.parametrize("step", ["stage", "shaped_rows", "append", "keys", "commit before", "commit after", "discard"])
def test_load_fails_at_a_step(spark, tmp_path, monkeypatch, step):
    """Whatever step fails, the answer says what is in the table, and the same batch can be loaded again."""
    from somnotab.plans import load as plan

    def load(rows, batch_id):
        return load_batch(spark, batch(spark, rows), str(tmp_path), "t", "day", NOW, batch_id)

    assert load([("a", "2024-05-01", "1")], "first")["status"] == "success"
    real = {"append": warehouse.append, "commit": warehouse.commit, "rename": warehouse.rename}

    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step in ("stage", "discard"):
            m.setattr(plan, step, broken)
        elif step == "shaped_rows":
            m.setattr(ingest, step, broken)
        elif step == "append":
            m.setattr(warehouse, "append", broken)
        elif step == "keys":  # rows are written, nothing else
            m.setattr(warehouse, "append", lambda *a: (real["append"](*a), files.delete_folder(spark, f"{tmp_path}/t/keys/batch=b-second"), broken()))
        elif step == "commit before":
            m.setattr(warehouse, "rename", broken)
        else:  # the marker stands, the answer is lost
            m.setattr(warehouse, "commit", lambda *a: (real["commit"](*a), broken()))
        answer = load([("b", "2024-05-01", "1"), ("c", "2024-05-02", "2")], "second")
    there = step in ("commit after", "discard")
    assert answer["status"] == ("success" if there else "exception")
    assert _stored(spark, tmp_path) == (["a", "b", "c"] if there else ["a"])
    again = load([("b", "2024-05-01", "1"), ("c", "2024-05-02", "2")], "second")
    assert again["status"] == "success" and again["rows_inserted"] == 2
    assert again.get("repeated", False) is there
    assert _stored(spark, tmp_path) == ["a", "b", "c"]
    assert load([("c", "2024-05-02", "x")], "third")["existing"] == ["c"]
    assert warehouse.remove_unmarked(spark, f"{tmp_path}/t") == []


def test_unmarked_batches(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert warehouse.read(spark, path) is None and warehouse.remove_unmarked(spark, path) == []
    rows = spark.createDataFrame([("a", date(2024, 5, 1)), (None, date(2024, 5, 1))], "uuid string, day date")
    warehouse.append(rows, path, "007", "day")
    assert warehouse.read(spark, path) is None
    keyed = ingest.keyed_rows(batch(spark, [("a", "2024-05-01", "")]), "day")
    assert warehouse.already_loaded(spark, path, keyed, "day").collect() == []
    warehouse.commit(spark, path, "007", {"status": "success"})
    warehouse.append(rows, path, "8", "day")
    assert warehouse.read(spark, path).count() == 2
    assert warehouse.answer_of(spark, path, "007") == {"status": "success"} and warehouse.answer_of(spark, path, "7") is None
    assert warehouse.remove_unmarked(spark, path) == ["8"]
    with pytest.raises(ValueError):
        warehouse.check_batch_id("a/b")


def test_lookup_opens_only_files_with_a_hash_of_the_batch(spark, tmp_path):
    path = f"{tmp_path}/t"
    for day in range(1, 6):
        rows = spark.createDataFrame([(f"d{day}n{i}", date(2024, 5, day)) for i in range(50)], "uuid string, day date")
        warehouse.append(rows, path, str(day), "day")
        warehouse.commit(spark, path, str(day), {})

    def lookup(rows):
        keyed = ingest.keyed_rows(batch(spark, rows), "day")
        found = warehouse.already_loaded(spark, path, keyed, "day")
        return sorted(r["uuid"] for r in found.collect()), found.inputFiles(), warehouse.touched_files(spark, path, keyed)

    # Known on another day of the batch counts, known on a day that the batch does not name does not.
    loaded, read, touched = lookup([("d2n7", "2024-05-04", ""), ("d3n1", "2024-05-04", ""), ("new", "2024-05-02", "")])
    assert loaded == ["d2n7"] and len(touched) == 1 and "batch=b-2" in touched[0]
    assert [f for f in read if "/data/" in f] == [f for f in read if "batch=b-2" in f]
    loaded, read, touched = lookup([("new", "2024-05-02", "")])
    assert loaded == touched == [] and not any("/data/" in f for f in read)


def test_swap_that_fails_leaves_the_last_table(spark, tmp_path, monkeypatch):
    path, fresh = f"{tmp_path}/out", f"{tmp_path}/fresh"
    spark.range(3).write.parquet(path)
    spark.range(5).write.parquet(fresh)
    real = files.rename
    for lost in (1, 2):
        calls = []

        def failing(spark_, old, new, lost=lost, calls=calls):
            calls.append(new)
            if len(calls) == lost:
                raise OSError("lost")
            real(spark_, old, new)

        with monkeypatch.context() as m:
            m.setattr(files, "rename", failing)
            with pytest.raises(OSError):
                files.swap_in(spark, fresh, path)
        assert spark.read.parquet(path).count() == 3
    # The driver is lost between the two renames.
    real(spark, path, f"{path}-previous")
    files.restore(spark, path)
    assert spark.read.parquet(path).count() == 3
    files.swap_in(spark, fresh, path)
    assert spark.read.parquet(path).count() == 5 and not files.path_exists(spark, f"{path}-previous")


def _lines_of(frame):
    return sorted(map(tuple, frame.select("variable", "rank", "value", "n").collect()))


@pytest.mark.parametrize("tracked", [16, 200, 10_000])
def test_frequent_values_without_counting_all(spark, tracked):
    """Skewed, flat, unique, tied and empty columns, whatever the sketch can keep."""
    rng = random.Random(tracked)
    rows = []
    for i in range(6000):
        skewed = "hot" if i % 3 == 0 else f"w{min(int(rng.paretovariate(0.8)), 3000)}"
        rows.append((skewed, f"u{i}", f"t{i % 12}", None, float("nan") if i % 2 else -0.0, i % 5 or None))
    frame = spark.createDataFrame(rows, "a string, b string, c string, d string, e double, `f,g` int").repartition(7)
    want = profile.top_frequencies(profile.value_frequencies(frame), 3)
    assert _lines_of(profile.most_frequent(frame, top=3, tracked=tracked)) == _lines_of(want)
    best = profile.top_values(frame, "a", 2, tracked).collect()
    assert best[0]["value"] == "hot" and best[0]["n"] == 2000 and len(best) == 2
    assert profile.most_frequent(frame.limit(0)).collect() == []


def test_only_undecided_columns_are_grouped_in_full(spark, monkeypatch):
    rows = [("hot" if i % 2 else f"r{i}", f"u{i}") for i in range(4000)]
    frame = spark.createDataFrame(rows, "a string, b string")
    full = []
    real = profile.value_frequencies
    monkeypatch.setattr(profile, "value_frequencies", lambda df, columns=None: full.append(columns) or real(df, columns))
    lines = _lines_of(profile.most_frequent(frame, top=1, tracked=64))
    assert lines == [("a", 1, "hot", 2000), ("a", 2, "OTROS", 2000), ("b", 1, "u0", 1), ("b", 2, "OTROS", 3999)]
    assert full == [["b"]]


def test_profile_states_merge(spark, tmp_path):
    """Months measured one by one, one of them again: the same profile as from the table as a whole."""
    rng = random.Random(6)

    def rows(month, n, shift):
        day = None if month is None else date(2024, month, 3)
        return [
            (i * 100 + (month or 0), day, rng.choice([None, -9999.0, 0.0, i * 0.25 + shift]), rng.choice(["x", "y", "z", None]), None)
            for i in range(n)
        ]

    kind = "k long, fecha date, v double, c string, nada string"
    parts = {m: rows(m, 60, 1.5) for m in (1, 2, 3, None)}
    profiles.refresh(spark.createDataFrame([r for p in parts.values() for r in p], kind), str(tmp_path), "fecha", ["k"])
    parts[2], parts[5] = rows(2, 80, 7.25), rows(5, 10, 0.0)
    for month in (2, 5):
        profiles.refresh(spark.createDataFrame(parts[month], kind), str(tmp_path), "fecha", ["k"])
    whole = spark.createDataFrame([r for p in parts.values() for r in p], kind)
    want = [r.asDict() for r in profile.profile(whole, ["c", "nada"], ["k"]).collect()]
    got = [r.asDict() for r in profiles.current(spark, str(tmp_path), ["c", "nada"]).collect()]
    assert got == want
    assert spark.read.parquet(f"{tmp_path}/states").select("part").distinct().count() == 5


def test_sketched_distinct_values(spark, tmp_path):
    frame = spark.range(30_000).selectExpr("id as k", "date_add(date'2024-01-01', int(id % 90)) as d", "concat('v', id % 20000) as v")
    profiles.refresh(frame, str(tmp_path), "d", ["k"], ["d"])
    lines = {r["variable"]: r["unique"] for r in profiles.current(spark, str(tmp_path), [], exact=False).collect()}
    error = 4 * 1.04 / 2 ** (profile_states.LG_BUCKETS / 2)
    for name, n in (("k", 30_000), ("v", 20_000), ("d", 90)):
        assert abs(int(lines[name].split()[0]) - n) <= error * n


def test_whole_tree_against_a_walk(spark, tmp_path):
    """Hidden names, empty files, empty and linked folders: all that a walk over the tree sees."""
    names = ["a.doc", "vacio.rtf", ".oculto.docx", "_privado.doc", "sub/b.DOCX", "sub/.git/c.doc", "sub/dos/tres/d e%20ñ.rtf", "sin", ".hidden/e.doc"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "vacio" in name else "x")
    (tmp_path / "nada" / "tampoco").mkdir(parents=True)
    (tmp_path / "enlace").symlink_to(tmp_path / "sub")
    (tmp_path / "roto").symlink_to(tmp_path / "falta")
    (tmp_path / "a2.doc").symlink_to(tmp_path / "a.doc")
    walked = [p for p in tmp_path.glob("**/*") if "enlace" not in p.parent.parts]
    entries = tree.tree(spark, str(tmp_path))
    got = {(r["path"].removeprefix(f"file:{tmp_path}/"), r["folder"]) for r in entries.collect()}
    assert got == {(str(p.relative_to(tmp_path)), p.is_dir()) for p in walked if p.is_file() or p.is_dir()}
    listed = inventory.inventory(tree.tree_files(entries))
    counted = inventory.counters(listed).first()
    files_seen = [p for p in walked if p.is_file()]
    valid = [p for p in files_seen if p.suffix[1:].lower() in ("docx", "doc", "rtf")]
    assert tuple(counted) == (len(files_seen), len(valid), len(files_seen) - len(valid))
    assert tree.tree_folders(entries).first()["num_dirs"] == sum(p.is_dir() for p in walked)
    with pytest.raises(ValueError):
        tree.tree(spark, f"{tmp_path}/falta")


def test_words_across_chunk_borders(spark, tmp_path):
    """Chunks of a file give what the whole file gives: words, NULs and characters on their borders."""
    size = search.PROBE_BYTES
    rng = random.Random(9)
    contents = {
        "on": b"x" * (size - 3) + b"palabra" + b"y" * 9,
        "end": b"x" * (2 * size - 7) + b"palabra",
        "begin": b"x" * size + b"palabra",
        "split": "ñ".encode() * size + b"palabra",
        "odd": b"a" + "ñ".encode() * size + b"palabra",
        "four": b"ab" + "😀".encode() * size + b"palabra",
        "cut": "ñ".encode() * (size // 2) + b"\xc3",
        "stray": b"palabra" + b"x" * (size - 7) + b"\xb1 y",
        "lost": b"palabra" + b"x" * (size - 8) + b"\xc3" + b"y",
        "long": b"palabra" + b"x" * (size - 8) + b"\xf0\x9f" + b"y" * size,
        "nul": b"palabra" + b"x" * size + b"\0",
        "bin": b"\0" + b"x" * (size - 4) + b"palabra",
        "bin2": b"x" * (size - 1) + b"\0" + b"palabr",
        "empty": b"",
        "exact": b"x" * (3 * size),
    }
    for i in range(40):
        text = "".join(rng.choice(["a", "ñ", "漢", "😀", "palabra", "palab"]) for _ in range(rng.randrange(900, 1500))).encode()
        if i % 2:
            at = rng.randrange(len(text))
            text = text[:at] + bytes([rng.choice([0x80, 0xC3, 0xFF, 0x41])]) + text[at + 1 :]
        contents[f"r{i}"] = text
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    frame = spark.createDataFrame([(f"file:{tmp_path}/{n}", bytearray(c), len(c)) for n, c in contents.items()], "path string, content binary, length long")
    want = {r["path"]: r["bucket"] for r in search.search(frame, "palabra").collect()}
    found = search.search_files(frame.select("path", "length"), "palabra", size)
    assert {r["path"]: r["bucket"] for r in found.collect()} == want
    assert len(set(want.values())) == 4
    gone = spark.createDataFrame([(f"file:{tmp_path}/falta", 5)], "path string, length long")
    assert search.search_files(gone, "palabra").first()["bucket"] == search.NOT_PROCESSED


def test_stream_batch_that_fails_is_written_once(spark, tmp_path, monkeypatch):
    source, output, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))

    def start():
        stream = spark.readStream.schema(REPORTS).parquet(source)
        write_new_reports(stream, output, checkpoint).awaitTermination()

    spark.createDataFrame([(1, "/a", "doc", BASAL), (2, "/b", "pdf", "x")], REPORTS).write.parquet(source)
    start()
    spark.createDataFrame([(3, "/c", "doc", BASAL), (4, "/d", "pdf", "x")], REPORTS).write.mode("append").parquet(source)
    with monkeypatch.context() as m:  # the result files are written, the audit is not
        m.setattr(sinks, "write_run", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            start()
    start()
    start()
    back = tables.read_results(spark, [f"{output}/resultados_psg_doc.csv"])
    assert sorted(r["fuente"] for r in back.collect()) == ["/a", "/c"]
    refused = spark.read.parquet(f"{output}/audit").where("reason = 'unsupported_ext'")
    assert sorted(r["doc_id"] for r in refused.collect()) == [2, 4]
