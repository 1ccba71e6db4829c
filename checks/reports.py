"""Report texts rendered inside Spark from table columns.

A template names its fields in braces; each field is an SQL expression over a test table that
Spark and the checking engine read alike. Text in « » is left out where one of its fields is
NULL. The report goes through the whole text pipeline, and the expected record is simply the
field expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somnotab.operators.labelling import computed_once

K = "c_custkey"


def text(sql: str) -> str:
    return f"cast({sql} as string)"


def whole(low: int, span: int, step: int = 1, key: str = K) -> str:
    return text(f"{key} * {step} % {span} + {low}")


def tenths(low: int, span: int, step: int = 1, mark: str = ",", key: str = K) -> str:
    """A number with one decimal."""
    return f"{whole(low, span, step, key)} || '{mark}' || {text(f'{key} * {step} % 10')}"


def padded(sql: str) -> str:
    return f"lpad({text(sql)}, 2, '0')"


def day_first(key: str = K) -> str:
    return (
        f"{padded(f'{key} % 28 + 1')} || '/' || {padded(f'{key} % 12 + 1')}"
        f" || '/' || {text(f'{key} % 25 + 2000')}"
    )


def sometimes(sql: str, modulus: int, rest: int, key: str = K) -> str:
    """NULL for one residue of the key: the field is left out of the report there."""
    return f"case when {key} % {modulus} = {rest} then null else {sql} end"


@dataclass(frozen=True)
class Template:
    exam: str
    ext: str
    text: str
    fields: dict[str, str]
    helpers: dict[str, str] = field(default_factory=dict)
    table: str = "customer"
    key: str = K

    def expression(self, name: str) -> str:
        return self.helpers[name] if name in self.helpers else self.fields[name]

    def rendered(self) -> Column:
        """The text as one SQL expression."""
        pieces = []
        for part in re.split("(«[^»]*»)", self.text):
            if part.startswith("«"):
                pieces.append(f"coalesce({self._joined(part[1:-1])}, '')")
            elif part:
                pieces.append(self._joined(part))
        return F.expr(f"concat({', '.join(pieces)})")

    def _joined(self, part: str) -> str:
        pieces = []
        for piece in re.split(r"(\{[^}]*\})", part):
            if piece.startswith("{"):
                pieces.append(self.expression(piece[1:-1]))
            elif piece:
                pieces.append("'" + piece.replace("\\", "\\\\").replace("'", "\\'") + "'")
        return f"concat({', '.join(pieces)})"

    def reports(self, spark: SparkSession, folder: str) -> DataFrame:
        """``reports(doc_id, path, ext, text)`` with one row per row of the table."""
        return self.render(spread(spark.read.parquet(f"{folder}/{self.table}.parquet")))

    def render(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns())

    def columns(self) -> list[Column]:
        return [
            F.col(self.key).alias("doc_id"),
            F.format_string(f"/reports/{self.exam}/%d.{self.ext}", self.key).alias("path"),
            F.lit(self.ext).alias("ext"),
            self.rendered().alias("text"),
        ]

    def expected_sql(self, names: list[str] | None = None) -> str:
        chosen = self.fields if names is None else {n: self.fields[n] for n in names}
        values = ", ".join(f'{sql} as "{name}"' for name, sql in chosen.items())
        return f"select {self.key} as doc_id, {values} from {self.table}"


# Fixed value: rows of which one task makes the reports or the cells; 50,000 workbooks are 1.35 million cells,
# which a task sorts in memory.
ROWS_PER_TASK = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a test file over all cores, and over more tasks the more rows there are.

    A report is a thousand times the size of the row it is rendered from, and a file of one row
    group is read by one task. What a task makes must not grow with the table, or its sorts spill.
    """
    tasks = -(-rows.count() // ROWS_PER_TASK)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism))


NAME = "replace(c_name, '#', ' ')"
DOCTOR = "'Dr ' || replace(c_name, '#', ' ')"
COMPANY = "'EPS ' || c_mktsegment"
BALANCE = text("cast(abs(c_acctbal) as decimal(12, 2))")
BALANCE_COMMA = f"replace({BALANCE}, '.', ',')"
VARIANT = f"{K} % 3 + 1"

_BASAL_FIELDS = {
    "edad_anos": whole(1, 90),
    "edad_meses": sometimes(whole(1, 11), 4, 1),
    "edad_dias": sometimes(whole(1, 28), 5, 2),
    "id": f"'A' || {text(K)}",
    "imc": tenths(18, 25),
    "solicita": DOCTOR,
    "empresa": "c_mktsegment",
    "fecha_estudio": day_first(),
    "epworth": sometimes(whole(0, 25), 6, 3),
    "talla": whole(120, 90),
    "medida_talla": f"case when {K} % 2 = 0 then 'cm' else 'mts' end",
    "medida_cuello": "'cm'",
    "medida_perimetro_abdominal": "'cm'",
}

BASAL_DOC = Template(
    "BASAL",
    "doc",
    """Centro del sueño   INFORME DE POLISOMNOGRAFÍA BASAL
Nombre: {nombre}Edad: {edad_anos} años«, {edad_meses} meses»« y {edad_dias} días» Id: {id}
Peso{_peso} Talla{_talla} IMC: {imc} Cuello: {cuello} {medida_cuello}
Perímetro Abdominal: {perimetro_abdominal} {medida_perimetro_abdominal} Solicita: {solicita} Empresa: {empresa}
Fecha: {fecha_estudio} PROCEDIMIENTO registro de doce canales« Escala de Epworth: {epworth}/24»
ARQUITECTURA DE SUEÑO:\tTiempo en Cama: {tiempo_en_cama} min Tiempo Total de Sueño: {tiempo_sueno} min
«Eficiencia de Sueño: {eficiencia_sueno}%» Latencia de Sueño: {latencia_sueno_total} min
Latencia de sueño REM: {latencia_sueno_rem} min
Microalertamientos 12 Índice Despertares: {indice_microalertamientos} /Hr.
DISTRIBUCIÓN DE FASES DE SUEÑO: Fase n min % S1 3 10,5 4,2 S3 4 80,5 {porcentaje_sueno_profundo}
REM 5 60,5 {porcentaje_sueno_rem}
Resumen de eventos respiratorios (Tiempo de sueño total) {_events}
Índice (nº/h TST) {iac} {iao} {iam} 7,7 {ih} {iah}
OXIMETRÍA: Índice Desat (#/hour) 1,5 {indice_desat_rem} {indice_desat_nrem} {indice_desat_total}
<90 (min) 1 2 3 {oxim_menor90_total} <80 (min) 1 2 3 {oxim_menor80_total}
<70 (min) 1 2 3 {oxim_menor70_total} <60 (min) 1 2 3 {oxim_menor60_total}
INTERPRETACIÓN sin novedad« T90: {t90} %» Saturación O2 Mínima durante el sueño 85 CONCLUSIÓN
""",
    fields={
        "nombre": f"{NAME} || ' '",
        **_BASAL_FIELDS,
        "peso": BALANCE_COMMA,
        "medida_peso": f"case when {K} % 3 = 0 then 'gr' else 'kg' end",
        "cuello": tenths(30, 20),
        "perimetro_abdominal": tenths(60, 80),
        "tiempo_en_cama": tenths(300, 200),
        "tiempo_sueno": tenths(200, 150, mark="."),
        "eficiencia_sueno": sometimes(tenths(40, 60), 7, 4),
        "latencia_sueno_total": tenths(1, 90),
        "latencia_sueno_rem": tenths(20, 200),
        "indice_microalertamientos": tenths(1, 50),
        "porcentaje_sueno_rem": tenths(1, 30),
        "porcentaje_sueno_profundo": tenths(1, 40),
        "iac": tenths(0, 30),
        "iao": tenths(0, 31),
        "iam": tenths(0, 32),
        "ih": tenths(0, 33),
        "iah": tenths(0, 34),
        "indice_desat_rem": tenths(0, 35),
        "indice_desat_nrem": tenths(0, 36),
        "indice_desat_total": tenths(0, 37),
        "oxim_menor90_total": tenths(0, 38),
        "oxim_menor80_total": tenths(0, 39),
        "oxim_menor70_total": tenths(0, 40),
        "oxim_menor60_total": tenths(0, 41),
        "t90": sometimes(tenths(0, 100), 8, 5),
        "numero_eventos_ah": whole(0, 500),
    },
    helpers={
        "_peso": f"case when {K} % 2 = 0 then ' (' || (case when {K} % 3 = 0 then 'gr' else 'kg' end)"
        f" || ') ' || {BALANCE_COMMA} else ': ' || {BALANCE_COMMA} || ' ' ||"
        f" (case when {K} % 3 = 0 then 'gr' else 'kg' end) end",
        "_talla": f"case when {K} % 2 = 0 then ' (cm) ' || {whole(120, 90)}"
        f" else ': ' || {whole(120, 90)} || ' mts' end",
        "_events": f"case {VARIANT} when 1 then 'AC AO AM Suma AP H AH Numero 1 2 3 6 9 ' || {whole(0, 500)}"
        f" when 2 then 'AC AO AM Suma AP H AH RERA IDR Numero 1 2 3 6 9 5 4 ' || {whole(0, 500)}"
        f" else 'AC AO AM H AH Numero|1|2|3|4|' || {whole(0, 500)} || '|' end",
    },
)

BASAL_RTF = Template(
    "BASAL",
    "rtf",
    """INFORME DE POLISOMNOGRAFÍA BASAL|
Nombre del paciente: |{nombre}|Edad: {edad_anos} años« {edad_meses} meses»« {edad_dias} días»|Identificación: |{id}|
Peso: |{_peso}|Talla: {_talla}|IMC: |{imc}|Cuello: {cuello} {medida_cuello}|
Perímetro Abdominal: {perimetro_abdominal} {medida_perimetro_abdominal}|Solicita: |{solicita}|Empresa: |{empresa}|
Fecha del estudio: |{fecha_estudio}| | PROCEDIMIENTO registro« Escala de Epworth {epworth}/24»
ARQUITECTURA DE SUEÑO: |Tiempo en Cama: |{tiempo_en_cama}|Tiempo Total de Sueño: |{tiempo_sueno}|
«Eficiencia de Sueño: |{eficiencia_sueno}|»Latencia de Sueño: |{latencia_sueno_total}|Latencia de sueño REM: |{latencia_sueno_rem}|
Microalertamientos |12|Índice Despertares: |{indice_microalertamientos}|
DISTRIBUCIÓN DE FASES DE SUEÑO: |S1 |10,5|4,2|S3 |80,5|{porcentaje_sueno_profundo}|REM |60,5|{porcentaje_sueno_rem}|
Resumen de eventos respiratorios (Tiempo de sueño total)|{_events}
{_index}|
OXIMETRÍA |Índice Desat (#/hour)|1,5|{indice_desat_rem}|{indice_desat_nrem}|{indice_desat_total}|
<90 (min)||2|3|{oxim_menor90_total}|<80 (min)|1|2|3|{oxim_menor80_total}|
<70 (min)|1||3|{oxim_menor70_total}|<60 (min)|1|2||{oxim_menor60_total}|
INTERPRETACIÓN« T90: {t90} %» Saturación O2 Mínima durante el sueño 85
""",
    fields={
        "nombre": NAME,
        **_BASAL_FIELDS,
        "peso": BALANCE,
        "medida_peso": "'Kg'",
        "cuello": whole(30, 20),
        "perimetro_abdominal": whole(60, 80),
        "tiempo_en_cama": tenths(300, 200, mark="."),
        "tiempo_sueno": tenths(200, 150, mark="."),
        "eficiencia_sueno": sometimes(tenths(40, 60, mark="."), 7, 4),
        "latencia_sueno_total": tenths(1, 90, mark="."),
        "latencia_sueno_rem": tenths(20, 200, mark="."),
        "indice_microalertamientos": tenths(1, 50),
        "porcentaje_sueno_rem": tenths(1, 30),
        "porcentaje_sueno_profundo": tenths(1, 40),
        "iac": tenths(0, 30),
        "iao": tenths(0, 31),
        "iam": tenths(0, 32),
        "ih": tenths(0, 33),
        "iah": tenths(0, 34),
        "indice_desat_rem": tenths(0, 35),
        "indice_desat_nrem": tenths(0, 36),
        "indice_desat_total": tenths(0, 37),
        "oxim_menor90_total": tenths(0, 38),
        "oxim_menor80_total": tenths(0, 39),
        "oxim_menor70_total": tenths(0, 40),
        "oxim_menor60_total": tenths(0, 41),
        "t90": sometimes(tenths(0, 100), 8, 5),
        "numero_eventos_ah": whole(0, 500),
    },
    helpers={
        "_peso": f"case when {K} % 2 = 0 then '(Kg)| ' || {BALANCE} else {BALANCE} || ' Kg' end",
        "_talla": f"case when {K} % 2 = 0 then '(cm) ' || {whole(120, 90)}"
        f" else {whole(120, 90)} || ' mts' end",
        "_events": f"case {VARIANT} when 1 then 'AC|AO|AM| Suma AP |H|AH|Numero|1|2|3|6|9|' || {whole(0, 500)} || '|'"
        f" when 2 then 'AC|AO|AM| Suma AP |H|AH| RERA |IDR|Numero|1|2|3|6|9|5|4|' || {whole(0, 500)} || '|'"
        f" else 'AC|AO|AM|H|AH|Numero|1|2|3|4|' || {whole(0, 500)} || '|' end",
        "_index": f"(case when {K} % 2 = 0 then 'Indice (nº/h TST)|' else 'Indice [nº/h]|' end)"
        f" || {tenths(0, 30)} || '|' || {tenths(0, 31)} || '|' || {tenths(0, 32)} || '|'"
        f" || (case {VARIANT} when 2 then '7,7|' else '' end)"
        f" || {tenths(0, 33)} || '|' || {tenths(0, 34)}",
    },
)

_MASK_FIELDS = {
    "mascara_marca": "'Marca ' || c_mktsegment",
    "mascara_tipo": "case when c_custkey % 2 = 0 then 'nasal' else 'facial' end",
    "mascara_tamano": "case when c_custkey % 3 = 0 then 'S' when c_custkey % 3 = 1 then 'M' else 'XL2' end",
    "mascara_referencia": f"'R-' || {text(K)}",
}
_MASK = (
    'El {_device} es marca {mascara_marca} y se utilizó máscara {mascara_tipo} tamaño '
    '"{mascara_tamano}" (ref. {mascara_referencia})'
)

_CPAP_FIELDS = {
    "nombre_paciente": NAME,
    "edad_paciente": whole(1, 90),
    "medida_edad_paciente": "case when c_custkey % 9 = 0 then 'meses' else 'anos' end",
    "id_paciente": text(f"{K} + 1000000"),
    "fecha_proced": day_first(),
    "iah_diagnostico": tenths(5, 60),
    **_MASK_FIELDS,
    "tiempo_dormido": tenths(200, 150),
    "tiempo_en_cama": tenths(350, 150),
    "eficiencia_sueno": tenths(40, 60),
    "porc_sueno_rem": sometimes(tenths(1, 30), 5, 1),
    "porc_sueno_profundo": tenths(1, 40),
    "indice_microalertamientos": tenths(1, 50),
    "presion_terapeutica": sometimes(whole(4, 16), 7, 2),
}

CPAP_DOC = Template(
    "CPAP",
    "doc",
    """INFORME DE POLISOMNOGRAFÍA EN TITULACIÓN DE CPAP
Nombre del paciente: {nombre_paciente} edad: {edad_paciente} {medida_edad_paciente} Id: {id_paciente}
Fecha: {fecha_proced} PROCEDIMIENTO IAH: {iah_diagnostico} /hr """ + _MASK + """
INTERPRETACIÓN Arquitectura del sueño: Durmió {tiempo_dormido} minutos de los {tiempo_en_cama} minutos ({eficiencia_sueno}%)
«con porcentaje de sueño REM de {porc_sueno_rem}%» y porcentaje de sueño profundo (estadio 3) de {porc_sueno_profundo}%
El índice de microalertamientos fue {indice_microalertamientos}/hora. «A una presión de {presion_terapeutica} cm de agua se observó mejoría.»
CONCLUSIONES adecuada respuesta
""",
    fields=_CPAP_FIELDS,
    helpers={"_device": "case when c_custkey % 2 = 0 then 'CPAP' else 'C-PAP' end"},
)

CPAP_DOCX = Template(
    "CPAP",
    "docx",
    """INFORME DE POLISOMNOGRAFÍA EN TITULACIÓN DE CPAP
Nombre: {nombre_paciente} Edad: {edad_paciente} {_anos} Id: {id_paciente} 77 Adq Fecha: {fecha_proced} IAH: {iah_diagnostico} /hr
""" + _MASK + """
INTERPRETACIÓN Arquitectura del sueño: Durmió {tiempo_dormido} minutos de {tiempo_en_cama} que permaneció en cama ({eficiencia_sueno}%)
«Porcentaje de sueño REM: {porc_sueno_rem} %» Porcentaje de sueño profundo (estado 3): {porc_sueno_profundo} %
Índice de microalertamientos: {indice_microalertamientos} / hora «a una presión de {presion_terapeutica} cm de agua se observó mejoría»
CONCLUSIÓN
""",
    fields={
        **_CPAP_FIELDS,
        "tiempo_dormido": tenths(200, 150, mark="."),
        "tiempo_en_cama": tenths(350, 150, mark="."),
    },
    helpers={
        "_device": "'CPAP'",
        "_anos": "case when c_custkey % 9 = 0 then 'meses' else 'años' end",
    },
)

CPAP_RTF = Template(
    "CPAP",
    "rtf",
    """INFORME DE POLISOMNOGRAFÍA EN TITULACIÓN DE CPAP|
Nombre del paciente:|{nombre_paciente}|Edad: {edad_paciente} {medida_edad_paciente}|Identificación: |{id_paciente}|
Fecha del estudio: |{fecha_proced}|IAH: {iah_diagnostico} /hr """ + _MASK + """
Interpretación: arquitectura del sueño: eficiencia ({eficiencia_sueno}%).
Durmió {tiempo_dormido} minutos de los {tiempo_en_cama} minutos que permaneció en cama
«porcentaje de sueño REM de {porc_sueno_rem}%» porcentaje de sueño profundo (estado 3) de {porc_sueno_profundo}%
índice de microalertamientos fue: {indice_microalertamientos}/hora «A una presión de {presion_terapeutica} cm de agua se observó mejoría»
CONCLUSIONES
""",
    fields={**_CPAP_FIELDS, "medida_edad_paciente": "'anos'"},
    helpers={"_device": "'CPAP'"},
)

_BPAP_FIELDS = {
    "nombre_paciente": NAME,
    "edad_paciente": whole(1, 90),
    "id_paciente": text(f"{K} + 1000000"),
    "peso_paciente": tenths(40, 90),
    "talla_paciente": whole(140, 60),
    "imc_paciente": tenths(18, 25),
    "cuello_paciente": tenths(30, 20),
    "perimetro_abdominal": whole(60, 80),
    "md_solicita": DOCTOR,
    "eps_paciente": COMPANY,
    "fecha_proced": day_first(),
    **_MASK_FIELDS,
    "iah_diagnostico": tenths(5, 60),
    "tiempo_de_sueno(eficiencia)": tenths(200, 150),
    "tiempo_en_cama(eficiencia)": tenths(350, 150),
    "latencia_total": tenths(1, 90),
    "latencia_rem": tenths(20, 200),
    "sueno_rem": tenths(1, 30),
    "sueno_profundo": tenths(1, 40),
    "indice_microalertamientos": tenths(1, 50),
    "presion_inicial": f"{whole(4, 8)} || '/' || {whole(3, 5)}",
    "presion_terapeutica": sometimes(f"{whole(12, 20)} || '/' || {whole(10, 9)}", 6, 1),
}

BPAP_DOC = Template(
    "BPAP",
    "doc",
    """INFORME DE POLISOMNOGRAFÍA EN TITULACIÓN DE BIPAP
Nombre: {nombre_paciente} Edad: {edad_paciente} años Id: {id_paciente} Peso: {peso_paciente} kg Talla: {talla_paciente} cm
IMC: {imc_paciente} Cuello: {cuello_paciente} cm Perímetro Abdominal: {perimetro_abdominal} cm
Solicita: {md_solicita} Empresa: {eps_paciente} Fecha: {fecha_proced} """ + _MASK + """
IAH: {iah_diagnostico}/hr Durmió {tiempo_de_sueno(eficiencia)} minutos de los {tiempo_en_cama(eficiencia)} minutos que permaneció en cama
La latencia de sueño fue: {latencia_total} minutos y la latencia de sueño REM fue {latencia_rem} minutos,
sueño REM de {sueno_rem}% y sueño profundo (estadio 3) de {sueno_profundo}%, índice de microalertamientos fue {indice_microalertamientos}/hora.
Se inició con presión de {presion_inicial} cm de agua« y a una presión de {presion_terapeutica} cm de H2O mejoró».
La saturación de oxígeno promedio durante el sueño con terapia fue de {so2_prom_sueno}% CONCLUSIONES
""",
    fields={**_BPAP_FIELDS, "so2_prom_sueno": tenths(70, 29)},
    helpers={"_device": "'BIPAP'"},
)

BPAP_RTF = Template(
    "BPAP",
    "rtf",
    """INFORME DE POLISOMNOGRAFÍA EN TITULACIÓN DE BPAP|
Nombre del paciente:|{nombre_paciente}|Edad: {edad_paciente} años|Id: {id_paciente}|Peso: (Kg) {peso_paciente}|Talla: (cm) {talla_paciente}|
IMC: {imc_paciente}|Cuello: |{cuello_paciente} cm|Perímetro Abdominal: {perimetro_abdominal} cm|
Solicita: |{md_solicita}|Empresa: |{eps_paciente}|Fecha: |{fecha_proced}|""" + _MASK + """
IAH: {iah_diagnostico} /hr Durmió {tiempo_de_sueno(eficiencia)} minutos de los {tiempo_en_cama(eficiencia)} minutos que permaneció en cama
La latencia de sueño fue: {latencia_total} minutos y la latencia de sueño REM: {latencia_rem} minutos,
porcentaje de sueño REM de {sueno_rem}%, porcentaje de sueño profundo (estadio 3) de {sueno_profundo}%,
índice de microalertamientos fue {indice_microalertamientos}/hora.
Se inició con presión de {presion_inicial} cm de agua« y a una presión de {presion_terapeutica} cm de H2O mejoró».
una vez alcanzada la presión terapéutica la saturación fue de {so2_prom_sueno_terapeutica}% CONCLUSIONES
""",
    fields={**_BPAP_FIELDS, "so2_prom_sueno_terapeutica": tenths(70, 29)},
    helpers={"_device": "'BPAP'"},
)

_DAM_FIELDS = {
    "nombre_paciente": NAME,
    "edad_paciente": whole(1, 90),
    "id_paciente": text(f"{K} + 1000000"),
    "peso_paciente": whole(40, 90),
    "talla_paciente": whole(140, 60),
    "imc_paciente": tenths(18, 25),
    "cuello_paciente": whole(30, 20),
    "perimetro_abdominal": whole(60, 80),
    "md_solicita": DOCTOR,
    "eps_paciente": COMPANY,
    "fecha_proced": day_first(),
    "escala_epworth": f"{whole(0, 25)} || '/24'",
    "eficiencia_sueno": tenths(40, 60),
    "latencia_total": tenths(1, 90),
    "latencia_rem": tenths(20, 200),
    "sueno_profundo": tenths(1, 40),
    "indice_microalertamientos": tenths(1, 50),
    "iah": tenths(1, 60),
    "gravedad_iah": "case when c_custkey % 4 = 0 then 'grave' when c_custkey % 4 = 1 then 'moderado'"
    " when c_custkey % 4 = 2 then 'leve' else 'normal' end",
    "duracion_prom_ah": tenths(10, 30),
    "so2_prom_vigilia": whole(85, 15),
    "so2_prom_sueno_nrem": whole(80, 15),
    "so2_prom_sueno_rem": whole(75, 15),
    "s02_minima_ah": whole(60, 30),
    "indice_desaturacion": sometimes(tenths(0, 40), 5, 3),
    "tiempo_bajo_90so2": tenths(0, 200),
    "t90": sometimes(tenths(0, 100), 8, 5),
}

DAM_DOC = Template(
    "DAM",
    "doc",
    """INFORME DE POLISOMNOGRAFÍA BASAL CON DISPOSITIVO DE AVANCE MANDIBULAR
Nombre: {nombre_paciente} Edad: {edad_paciente} años Id: {id_paciente} Peso: (Kg) {peso_paciente} Talla: (m) {talla_paciente}
IMC: {imc_paciente} Cuello: {cuello_paciente} cm perímetro abdominal: {perimetro_abdominal} cm
Solicita: {md_solicita} Empresa: {eps_paciente} Fecha: {fecha_proced} PROCEDIMIENTO Escala de Epworth: {escala_epworth}
eficiencia de sueño de {eficiencia_sueno}%, la latencia de sueño fue de {latencia_total} minutos,
la latencia de sueño REM fue de {latencia_rem} minutos, porcentaje de sueño profundo (estadio 3) de {sueno_profundo}%,
índice de microalertamientos fue {indice_microalertamientos}/hora, índice de apnea hipopnea (IAH) fue de {iah}/hora considerado: {gravedad_iah},
promedio de duración de {duracion_prom_ah} segundos, saturación de oxígeno promedio en vigilia fue de {so2_prom_vigilia}%,
durante el sueño el promedio fue de {so2_prom_sueno_nrem}% en sueño no-rem y de {so2_prom_sueno_rem}% en sueño rem,
saturación mínima durante las apneas hipopneas fue de {s02_minima_ah}%« índice de desaturación: {indice_desaturacion}/h»,
permaneció {tiempo_bajo_90so2} minutos de sueño con saturación menor a 90%«, T90: {t90} %» CONCLUSIONES
""",
    fields=_DAM_FIELDS,
)

DAM_RTF = Template(
    "DAM",
    "rtf",
    """INFORME DE POLISOMNOGRAFÍA BASAL CON DISPOSITIVO MANDIBULAR|
Nombre del paciente: |{nombre_paciente}|Edad: {edad_paciente} años|Identificación: |{id_paciente}|Peso: {peso_paciente} Kg|Talla: {talla_paciente} cm|
IMC: {imc_paciente}|Cuello: {cuello_paciente} cm|Perímetro Abdominal: {perimetro_abdominal} cm|
Solicita: |{md_solicita}|Empresa: |{eps_paciente}|Fecha del estudio: {fecha_proced}|(Escala de Epworth {escala_epworth})
eficiencia de sueño de {eficiencia_sueno}%, la latencia de sueño fue: {latencia_total} minutos,
la latencia de sueño REM fue de {latencia_rem} minutos, porcentaje de sueño profundo (estado 3) de {sueno_profundo}%,
índice de microalertamientos fue {indice_microalertamientos}/hora, índice de apnea hipopnea (IAH) fue de {iah}/hora, severidad: {gravedad_iah},
promedio de duración de {duracion_prom_ah} segundos, saturación de oxígeno promedio en vigilia fue de {so2_prom_vigilia}%,
el promedio fue de {so2_prom_sueno_nrem}% en sueño No-REM y de {so2_prom_sueno_rem}% en sueño REM,
con caída promedio a {s02_minima_ah}%« Índice de desaturación: {indice_desaturacion}/h»,
Permaneció {tiempo_bajo_90so2} minutos de sueño con saturación menor a 90%«, T90: {t90} %» CONCLUSIONES
""",
    fields=_DAM_FIELDS,
)

_YEAR_FIRST = (
    f"{text(f'{K} % 25 + 2000')} || '/' || {padded(f'{K} % 12 + 1')} || '/' || {padded(f'{K} % 28 + 1')}"
)

CAPNOGRAPHY_DOC = Template(
    "CAPNOGRAFIA",
    "doc",
    """INFORME DE CAPNOGRAFÍA Nombre: {nombre_paciente} Edad: {edad_paciente} {medida_edad_paciente} Id: {id_paciente}
Empresa: {eps_paciente} Fecha: {fecha_proced} DATOS DEL ESTUDIO durante el sueño 35 durante el sueño {media_etco2_sueno}
«Durante REM: 30 Durante REM: {media_etco2_rem}» Durante NREM: 31,5 Durante NREM: {media_etco2_nrem}
El nivel más alto de EtCO2 durante el sueño fue de {nivel_max_etco2} CONCLUSIÓN
""",
    fields={
        "nombre_paciente": NAME,
        "edad_paciente": whole(1, 90),
        "medida_edad_paciente": "case when c_custkey % 9 = 0 then 'meses' else 'anos' end",
        "id_paciente": f"'A' || {text(f'{K} + 1000000')}",
        "eps_paciente": COMPANY,
        "fecha_proced": _YEAR_FIRST,
        "media_etco2_sueno": tenths(20, 40),
        "media_etco2_rem": sometimes(tenths(20, 41), 4, 2),
        "media_etco2_nrem": tenths(20, 42),
        "nivel_max_etco2": whole(30, 40),
    },
)

CAPNOGRAPHY_RTF = Template(
    "CAPNOGRAFIA",
    "rtf",
    """INFORME DE CAPNOGRAFÍA|Nombre del paciente:|{nombre_paciente}|Edad|{edad_paciente} {medida_edad_paciente}|Id: |{id_paciente}|
Empresa: |{eps_paciente}|Fecha: |{fecha_proced}|Distribución de EtCO2 |Total|REM|NREM|Sueño|
Media|{_total}|{media_etco2_rem}|{media_etco2_nrem}|{media_etco2_sueno}|
«EtCO2 más alta durante TC: {nivel_max_etco2} mmHg» CONCLUSIÓN
""",
    fields={
        "nombre_paciente": NAME,
        "edad_paciente": whole(1, 90),
        "medida_edad_paciente": "'anos'",
        "id_paciente": f"'A' || {text(f'{K} + 1000000')}",
        "eps_paciente": COMPANY,
        "fecha_proced": _YEAR_FIRST,
        "media_etco2_sueno": whole(20, 40),
        "media_etco2_rem": whole(20, 41),
        "media_etco2_nrem": whole(20, 42),
        "nivel_max_etco2": sometimes(whole(30, 40), 4, 2),
    },
    helpers={"_total": whole(20, 43)},
)

_MONTH = (
    "case c_custkey % 3 when 0 then 'enero' when 1 then 'mayo' else 'octubre' end"
)

ACTIGRAPHY_DOC = Template(
    "ACTIGRAFIA",
    "doc",
    """Fecha: {fecha_proced} Información de paciente Nombre: {nombre_paciente} {_kind}: {id_paciente} Edad: {edad_paciente} {medida_edad_paciente}
Promedio 10:30:00 p. m. 6:45:10 a. m. 8:15:10 {tiempo_total_sueno} {latencia_prom} ESTADÍSTICAS DIARIAS del registro
""",
    fields={
        "nombre_paciente": "c_mktsegment",
        "id_paciente": text(f"{K} + 1000"),
        "edad_paciente": whole(1, 90),
        "medida_edad_paciente": "case when c_custkey % 9 = 0 then 'meses' else 'anos' end",
        "fecha_proced": f"{whole(1, 28)} || ' de ' || ({_MONTH}) || ' ' || {text(f'{K} % 25 + 2000')}",
        "tiempo_total_sueno": f"{whole(1, 9)} || ':' || {padded(f'{K} % 60')} || ':' || {padded(f'{K} * 7 % 60')}",
        "latencia_prom": tenths(1, 60),
    },
    helpers={"_kind": "case when c_custkey % 2 = 0 then 'ID' else 'TI' end"},
)

AUTOCPAP_DOCX = Template(
    "AUTOCPAP",
    "docx",
    """INFORME DE TITULACIÓN CON AUTO CPAP Nombre: {nombre_paciente} Sexo: {sexo_paciente} Fecha estudio: {fecha_estudio} Fecha de nacimiento: 01/01/1970
Edad: {edad_paciente} {_anos} ID: {id_paciente} INDICACIÓN del estudio
«Se observó disminución de eventos respiratorios a {presion_terapeutica} cm de agua.» Se utilizó máscara {mascara_tipo} talla {_size}, ref: {mascara_referencia})
INFORME DE CUMPLIMIENTO
""",
    fields={
        "nombre_paciente": NAME,
        "sexo_paciente": "case when c_custkey % 2 = 0 then 'F' else 'M' end",
        "fecha_estudio": day_first(),
        "edad_paciente": whole(1, 90),
        "medida_edad_paciente": "case when c_custkey % 9 = 0 then 'meses' else 'anos' end",
        "id_paciente": text(f"{K} + 1000"),
        "presion_terapeutica": sometimes(whole(4, 16), 7, 2),
        "mascara_tipo": "case when c_custkey % 2 = 0 then 'nasal' else 'facial' end",
        "mascara_tamano": "case when c_custkey % 3 = 0 then 'S' when c_custkey % 3 = 1 then 'M' else 'XL2' end",
        "mascara_referencia": f"'R-' || {text(K)}",
    },
    helpers={
        "_anos": "case when c_custkey % 9 = 0 then 'meses' else 'años' end",
        "_size": "case when c_custkey % 3 = 0 then 'S' when c_custkey % 3 = 1 then '\"M\"' else '\"XL2\"' end",
    },
)

POLYGRAPHY_DOCX = Template(
    "POLIGRAFIA",
    "docx",
    """INFORME POLIGRAFÍA RESPIRATORIA Fecha: {fecha_estudio} Información Nombre: {nombre_paciente} Id: {id_paciente} Edad: {edad_paciente} {_anos} Estudio nocturno
IAH: {iah} IH: {ih}« Apnea Obstructiva: {iac}» Mixta: {iam} IDO: {ido} <=90%sat: {meq_90porc_sat} Indicación del estudio
""",
    fields={
        "fecha_estudio": f"case when {K} % 2 = 0 then {day_first()} else"
        f" {whole(1, 28)} || ' de ' || ({_MONTH}) || ' ' || {text(f'{K} % 25 + 2000')} end",
        "nombre_paciente": NAME,
        "id_paciente": text(f"{K} + 1000"),
        "edad_paciente": whole(1, 90),
        "medida_edad_paciente": "case when c_custkey % 9 = 0 then 'meses' else 'anos' end",
        "iah": tenths(1, 60),
        "ih": tenths(0, 30),
        "iac": sometimes(tenths(0, 31), 3, 1),
        "iam": tenths(0, 32),
        "ido": tenths(0, 33),
        "meq_90porc_sat": tenths(0, 34),
    },
    helpers={"_anos": "case when c_custkey % 9 = 0 then 'meses' else 'años' end"},
)

TEMPLATES = (
    BASAL_DOC, BASAL_RTF, CPAP_DOC, CPAP_DOCX, CPAP_RTF, BPAP_DOC, BPAP_RTF, DAM_DOC, DAM_RTF,
    CAPNOGRAPHY_DOC, CAPNOGRAPHY_RTF, ACTIGRAPHY_DOC, AUTOCPAP_DOCX, POLYGRAPHY_DOCX,
)


def all_reports(spark: SparkSession, folder: str) -> DataFrame:
    """One report of every kind per customer, from one scan; ``doc_id`` counts the kinds within the key.

    The fence keeps the rendering from being copied into the filters of what follows.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(len(TEMPLATES) - 1))).alias("_kind")
    rows = spread(spark.read.parquet(f"{folder}/customer.parquet")).select("*", every)
    kind = F.col("_kind")
    named = rows.select("*", (F.col(K) * 100 + kind).alias("doc_id"))
    chosen = {"path": None, "ext": None, "_text": None}
    for i, template in enumerate(TEMPLATES):
        for name, column in zip(chosen, template.columns()[1:], strict=True):
            chosen[name] = F.when(kind == i, column) if chosen[name] is None else chosen[name].when(kind == i, column)
    reports = named.select("doc_id", *[column.alias(name) for name, column in chosen.items()])
    return computed_once(reports, "_text", "text")
