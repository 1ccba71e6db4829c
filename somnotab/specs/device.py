"""Fields of the baseline report with a mandibular device."""

from __future__ import annotations

from somnotab.specs.fields import Field, cased

# The label of the name, which the capnography report shares.
NAME = Field(
    "nombre_paciente",
    r"\n(?: del paciente)?:? ?\|? ?({words})(?= ?\|? ?Edad{end})",
    pieces=r"Nombre((?: del paciente)?:? ?\|? ?"
    r"(?:(?!Nombre(?: del paciente)?(?::| ?\|(?! ?Edad\b)))[\w -])*+(?:\|? ?Edad\b)?+\W?+)",
)

# Labels, units and stop words of the DOC layout.
DOC = cased(
    NAME,
    Field("edad_paciente", "Edad{sep}({num})"),
    Field("id_paciente", r"Id{sep}(\d{4,10})"),
    Field("peso_paciente", r"Peso{sep}(?:\([kK]g\))? ?({num})"),
    Field("talla_paciente", r"Talla{sep}(?:\([mM]\))? ?({num})"),
    Field("imc_paciente", "IMC{sep}({num})"),
    Field("cuello_paciente", "Cuello{sep}({num})"),
    Field("perimetro_abdominal", "perimetro abdominal[: ]*({num}) ?cm"),
    Field("md_solicita", "Solicita{sep}(.*?) Empresa", through=" Empresa"),
    Field("eps_paciente", "Empresa{sep}(.*?) ?Fecha", through="Fecha"),
    Field("fecha_proced", "Fecha{sep}({dmy}|{ymd})(?= ?PROCEDIMIENTO)"),
    Field("escala_epworth", r"Escala de Epworth{sep}(\d{1,2}/\d{2})"),
    Field("eficiencia_sueno", r"eficiencia de sueno de ?\(? ?({num})"),
    Field(
        "latencia_total", r"\n[^\d\n]*({dec})", pieces=r"latencia de sueno fue(\D*+(?:{dec})?+)"
    ),
    Field("latencia_rem", "latencia de sueno REM(?: fue)?(?: de)?[:|]? ?({dec}) minutos"),
    Field("sueno_profundo", r"porcentaje de sueno profundo \(estadio 3\) de ({num})%"),
    Field("indice_microalertamientos", "indice de microalertamientos fue ({num})/hora"),
    Field("iah", r"indice de apnea hipopnea \(IAH\) fue de ({num})/h"),
    Field("gravedad_iah", "considerad[oa][: ]*([a-zA-Z]+)", after=("IAH",)),
    Field("duracion_prom_ah", "promedio de duracion de ({num}) segundos"),
    Field("so2_prom_vigilia", "saturacion de oxigeno promedio en vigilia fue de ({num})"),
    Field(
        "so2_prom_sueno_nrem",
        "durante el sueno el promedio fue de ({num}) ?%? en sueno no[- ]?rem",
    ),
    Field("so2_prom_sueno_rem", "y de ({num}) ?%? en sueno rem"),
    Field("s02_minima_ah", "saturacion minima durante las apneas hipopneas fue de ({num})"),
    Field("indice_desaturacion", "indice de desaturacion[: ]*({num})/h"),
    Field(
        "tiempo_bajo_90so2",
        "permanecio ({num}) minutos de sueno con saturacion menor a 90%",
    ),
    Field("t90", "T90[: ]*({num}) ?%"),
)

# Labels, units and stop words of the RTF layout.
RTF = cased(
    Field("nombre_paciente", r"Nombre del paciente: ?\|?(.*?)\|Edad", through=r"\|Edad"),
    Field("edad_paciente", r"Edad: ?(\d{1,3}) ?anos"),
    Field("id_paciente", r"Identificacion: ?\|?(\d{6,11})\|"),
    Field("peso_paciente", r"Peso: ?(\d{2,3}) ?Kg"),
    Field("talla_paciente", r"Talla: ?(\d{2,3}) ?cm"),
    Field("imc_paciente", r"IMC: ?(\d{2}(?:[.,]\d{1,2})?)"),
    Field("cuello_paciente", r"Cuello: ?(\d{2,3}) ?cm"),
    Field("perimetro_abdominal", r"Perimetro Abdominal: ?(\d{2,3}) ?cm"),
    Field("md_solicita", r"Solicita: ?\|?(.*?)\|Empresa", through=r"\|Empresa"),
    Field("eps_paciente", r"Empresa: ?\|?(.*?)\|Fecha del estudio", through=r"\|Fecha del estudio"),
    Field("fecha_proced", r"Fecha del estudio: ?(\d{1,2}/\d{1,2}/\d{4})"),
    Field("escala_epworth", r"\(Escala de Epworth (\d{1,2}/\d{2})\)"),
    Field("eficiencia_sueno", "eficiencia de sueno de ?({num3})%"),
    Field("latencia_total", "latencia de sueno fue: ?({num3}) minutos"),
    Field("latencia_rem", "latencia de sueno REM fue ?(?:de ?)?({num3}) minutos"),
    Field("sueno_profundo", r"porcentaje de sueno profundo \(estado 3\) de ?({num3})"),
    Field("indice_microalertamientos", "indice de microalertamientos fue ?({num3})/hora"),
    Field("iah", r"indice de apnea hipopnea \(IAH\) fue de ?({num3})/hora"),
    Field("gravedad_iah", ": ?(grave|moderado|leve|normal)", after=("IAH",)),
    Field("duracion_prom_ah", "promedio de duracion de ?({num3}) segundos"),
    Field("so2_prom_vigilia", r"saturacion de oxigeno promedio en vigilia fue de ?(\d{1,3})%"),
    Field("so2_prom_sueno_nrem", r"promedio fue de ?(\d{1,3})% en sueno No-REM"),
    Field("so2_prom_sueno_rem", r"y de ?(\d{1,3})% en sueno REM"),
    Field("s02_minima_ah", r"promedio a ?(\d{1,3})%"),
    Field("indice_desaturacion", "Indice de desaturacion: ?({num3})/h"),
    Field(
        "tiempo_bajo_90so2",
        "Permanecio ?({num3}) minutos de sueno con saturacion menor a 90%",
    ),
    Field("t90", "T90: ?({num3}) ?%"),
)
