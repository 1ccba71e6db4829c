"""Fields of the titration reports: CPAP, BPAP and automatic CPAP."""

from __future__ import annotations

from somnotab.specs.fields import Field, cased

_QUOTE_OPEN = "[“\"']"
_QUOTE_CLOSE = "[”\"']"


def _mask(device: str, alphabet: str, inside_quotes: str) -> list[Field]:
    """Brand, type, size and reference of the mask; shared by every titration layout."""
    return [
        Field(
            "mascara_marca",
            rf"\n([{alphabet} &.-]+?)(?= y se utilizo mascara)",
            pieces=rf"\b{device}\b es marca ([{alphabet} &.-]*+)",
        ),
        Field("mascara_tipo", r"mascara (\w+) tamano"),
        Field(
            "mascara_tamano",
            rf"\btamano {_QUOTE_OPEN}{inside_quotes}([{alphabet}]+){inside_quotes}{_QUOTE_CLOSE}",
            after=(r"mascara\b",),
        ),
        Field(
            "mascara_referencia",
            r"\([Rr]ef\. ([^)]+)\)",
            after=(r"\bmascara\b", r"\btamano\b"),
            through=r"\)",
        ),
    ]


# Spellings of the device name before "es marca".
_DEVICE_ANY_CASE = "[bc]i?-?pap?p?"
_DEVICE_CASED = "[BCbc][iI]?-?[Pp][Aa]?[Pp]"

_CASED_MASK = cased(*_mask(_DEVICE_CASED, "A-Za-z0-9", " ?"))
_CASED_MASK_TIGHT = cased(*_mask(_DEVICE_CASED, "A-Za-z0-9", ""))

_SLEEP_ARCHITECTURE = ("interpretacion arquitectura del sueno:",)

# Labels, units and stop words of the CPAP layouts.
CPAP_DOC = [
    Field(
        "nombre_paciente",
        r"\n(?: del paciente)?{sep}({words})(?={sep}edad{end})",
        pieces=r"nombre((?: del paciente)?{sep}"
        r"(?:(?!nombre(?: del paciente)? ?[:|](?! ?edad\b))[\w -])*+(?:[:|]? ?edad\b)?+\W?+)",
    ),
    Field("edad_paciente", "edad{sep}({num})"),
    Field("medida_edad_paciente", r"edad{sep}\d+ ?(anos|meses)\b", cased=True),
    Field("id_paciente", "id{sep}([a-z0-9]{4,20})"),
    Field("fecha_proced", "fecha{sep}({dmy}|{ymd})(?= ?procedimiento)"),
    Field("iah_diagnostico", r"IAH[: ]*({num}) ?/(?:hr|h|hora)\b", cased=True),
    *_mask(_DEVICE_ANY_CASE, "a-z0-9", " ?"),
    Field("tiempo_dormido", "durmio ({dec}) ?minutos", after=_SLEEP_ARCHITECTURE),
    Field(
        "tiempo_en_cama",
        "durmio {dec} ?minutos de ?(?:los ?)?({dec})",
        after=_SLEEP_ARCHITECTURE,
    ),
    Field(
        "eficiencia_sueno",
        r"(?:\(|[, ]para una eficiencia(?: de sueno)? de |eficiencia[:( ]+)({dec})",
        after=("interpretacion ",),
    ),
    Field("porc_sueno_rem", "(?:porcentaje|%) de sueno rem ?(?:de |[:=] ?)({dec})"),
    Field(
        "porc_sueno_profundo",
        r"porcentaje de sueno profundo ?(?:\(estadi?o ?3\))? ?(?::|de)? ?(\d{1,3}[,.]\d)",
    ),
    Field(
        "indice_microalertamientos",
        r"indice de microalertamientos ?(?:fue|:)? ?({dec}) ?(?:/|por )?h(?:ora|r)?\b",
    ),
    Field(
        "presion_terapeutica",
        r"a ?(?:una presion de ?)?(\d+) ?cm ?(?:de ?(?:agua|h2o)|h2o)? ?se observo",
    ),
]

CPAP_DOCX = [
    *cased(
        Field("nombre_paciente", "Nombre: ?(.*?) ?Edad", through="Edad"),
        Field("edad_paciente", r"Edad{sep}(\d{1,3})"),
    ),
    Field("medida_edad_paciente", r"edad{sep}\d{1,3} ?(\w+)"),
    *cased(
        Field("id_paciente", r"Id: ?(\d+) ?\d+ ?Adq"),
        Field("fecha_proced", r"Fecha: ?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
        Field("iah_diagnostico", "IAH ?[:=] ?({num})"),
    ),
    *_CASED_MASK,
    *cased(
        Field("tiempo_dormido", r"Durmio (\d+\.?\d*) minutos"),
        Field("tiempo_en_cama", r"de (\d+\.?\d*) que permanecio en cama"),
    ),
    Field(
        "eficiencia_sueno",
        r"\((\d{1,3}[.,]\d)%?\)",
        after=(r"interpretacion\b", r"arquitectura\b", r"durmio\b", r"cama\b"),
    ),
    *cased(
        Field("porc_sueno_rem", "Porcentaje de sueno REM{colon}({open}) ?%"),
        Field(
            "porc_sueno_profundo",
            r"Porcentaje de sueno profundo ?\(estado ?3\){colon}({open}) ?%",
        ),
        Field("indice_microalertamientos", " microalertamientos{colon}({open}) ?/ ?hora"),
        Field(
            "presion_terapeutica",
            "a una presion de ({open}) ?cm ?(?:de ?)?agua(?: ?de ?agua)? se observo ",
        ),
    ),
]

_RTF_PATIENT = cased(
    Field("nombre_paciente", r"Nombre(?: del paciente)?:? ?\|?(.*?)\|Edad", through=r"\|Edad"),
    Field("edad_paciente", r"Edad[:|]? ?(\d{1,3}) ?anos"),
    Field("id_paciente", r"(?:Id|Identificacion)[:|]? ?\|?(\d{5,10})\b"),
)
[_RTF_DATE] = cased(Field("fecha_proced", r"Fecha(?: del estudio)?[:|]? ?\|?({dmy})"))
[_RTF_IAH] = cased(Field("iah_diagnostico", "IAH[:|]? ?({num}) ?/hr"))
_SLEPT_AND_IN_BED = cased(
    Field("tiempo_dormido", "Durmio ({num}) minutos"),
    Field(
        "tiempo_en_cama",
        "minutos de(?: los)? ({num}) (?:minutos )?que permanecio en cama",
    ),
)
_RTF_PHASES = cased(
    Field("porc_sueno_rem", "porcentaje de sueno REM(?: de|:)? ?({num})"),
    Field(
        "porc_sueno_profundo",
        r"porcentaje de sueno profundo \(estadi?o 3\)(?: de|:)? ?({num})",
    ),
    Field("indice_microalertamientos", "indice de microalertamientos(?: fue)?[: ]*({num})/hora"),
)

CPAP_RTF = [
    *_RTF_PATIENT,
    Field("medida_edad_paciente", r"edad{sep}\d+ ?(anos|meses)"),
    _RTF_DATE,
    _RTF_IAH,
    *_CASED_MASK,
    *_SLEPT_AND_IN_BED,
    Field(
        "eficiencia_sueno",
        r"[(:] ?(\d{1,3}[,.]\d)",
        after=("interpretacion", "arquitectura", "eficiencia"),
    ),
    *_RTF_PHASES,
    *cased(
        Field("presion_terapeutica", r"A una presion de (\d+) ?cm de agua se observo"),
    ),
]

# Column names of the two sleep times in the BPAP record.
_BPAP_TIMES = [
    _SLEPT_AND_IN_BED[0].named("tiempo_de_sueno(eficiencia)"),
    _SLEPT_AND_IN_BED[1].named("tiempo_en_cama(eficiencia)"),
]
_BPAP_PRESSURES = [
    *cased(
        Field(
            "presion_inicial",
            r"inicio (?:a una|con) presion de ?(\d+(?:/\d+)?) ?cm ?"
            r"(?:de ?[aA]gua|de ?H2O|H2O|[aA]gua)\b",
        )
    ),
    Field(
        "presion_terapeutica",
        r"a una presion de (\d{2}/\d{2}) ?cm ?(?:de ?)?(?:agua|h2o)\b",
    ),
]
_MEASURE = r"(\d{2,3}(?:[.,]\d+)?)"

# Labels, units and stop words of the BPAP layouts.
BPAP_DOC = [
    *cased(
        Field(
            "nombre_paciente",
            r"\n{sep}({two words})(?= Edad)",
            pieces=r"Nombre({sep}(?:(?!Nombre ?[:|])[\w -])*+)",
        ),
        Field("edad_paciente", r"Edad{sep}(\d{1,3})"),
        Field("id_paciente", r"Id{sep}(\d{5,12})"),
        Field("peso_paciente", f"Peso{{sep}}{_MEASURE} ?kg"),
        Field("talla_paciente", f"Talla{{sep}}{_MEASURE} ?cm"),
        Field("imc_paciente", r"IMC{sep}(\d{2}(?:[.,]\d+)?)"),
        Field("cuello_paciente", f"Cuello{{sep}}{_MEASURE} ?cm"),
        Field("perimetro_abdominal", f"Perimetro Abdominal{{sep}}{_MEASURE} ?cm"),
        Field("md_solicita", "Solicita{sep}(.*?) Empresa", through=" Empresa"),
        Field("eps_paciente", "Empresa{sep}(.*?) Fecha", through=" Fecha"),
        Field("fecha_proced", "Fecha{sep}({dmy})"),
    ),
    *_CASED_MASK_TIGHT,
    *cased(Field("iah_diagnostico", "IAH[: ]*({num})/hr")),
    *_BPAP_TIMES,
    *cased(
        Field("latencia_total", "latencia de sueno fue[: ]*({num}) minutos"),
        Field("latencia_rem", "latencia de sueno REM fue[: ]*({num}) minutos"),
        Field("sueno_rem", "sueno REM de ?({num})%"),
        Field("sueno_profundo", "de ?({num})", after=("sueno profundo",)),
        Field("indice_microalertamientos", "indice de microalertamientos fue ?({num})/hora"),
    ),
    *_BPAP_PRESSURES,
    *cased(
        Field(
            "so2_prom_sueno",
            "fue de ?({num})%",
            after=("saturacion de oxigeno promedio durante el sueno",),
        )
    ),
]

BPAP_RTF = [
    *_RTF_PATIENT,
    *cased(
        Field("peso_paciente", r"Peso[:|]? ?\(?(?:Kg)?\)?{sep}({num})"),
        Field("talla_paciente", r"Talla[:|]? ?\(?(?:cm|m)?\)?{sep}({num})"),
        Field("imc_paciente", "IMC[:|]? ?({num})"),
        Field("cuello_paciente", r"Cuello[:|]? ?\|?({num}) ?cm"),
        Field("perimetro_abdominal", "Perimetro Abdominal[:|]? ?({num}) ?cm"),
        Field("md_solicita", r"Solicita[:|]? ?\|?(.*?) ?\|Empresa", through=r"\|Empresa"),
        Field("eps_paciente", r"Empresa[:|]? ?\|?(.*?) ?\|Fecha", through=r"\|Fecha"),
    ),
    _RTF_DATE,
    *_CASED_MASK_TIGHT,
    _RTF_IAH,
    *_BPAP_TIMES,
    *cased(
        Field("latencia_total", "latencia de sueno(?: fue)?:? ?({num}) minutos"),
        Field("latencia_rem", "latencia de sueno REM(?: fue)?:? ?({num}) minutos"),
    ),
    _RTF_PHASES[0].named("sueno_rem"),
    _RTF_PHASES[1].named("sueno_profundo"),
    _RTF_PHASES[2],
    *_BPAP_PRESSURES,
    *cased(
        Field(
            "so2_prom_sueno_terapeutica",
            "fue de ({num})%",
            after=("una vez alcanzada la presion terapeutica",),
        )
    ),
]

# Labels, units and stop words of the automatic CPAP layout.
AUTOCPAP_DOCX = [
    Field("nombre_paciente", "nombre(?: del paciente)? ?: ?([^:]+?) ?sexo"),
    Field("sexo_paciente", "sexo ?: ?([^:]+?) ?fecha"),
    Field(
        "fecha_estudio",
        r"fecha ?(?:est\.?|estudio)? ?: ?(\d{2}[/-]\d{2}[/-]\d{4}) ?(?=fecha|de nacimiento|\z)",
    ),
    Field("edad_paciente", r"edad(?: ?del ?paciente)? ?[:=] ?(\d+)"),
    Field("medida_edad_paciente", r"\bedad(?: del paciente)? ?: ?\d+ ([a-z]+)(?= id\b)"),
    Field("id_paciente", "(?:id|cc|ce|ti) ?: ?([a-z0-9]+) ?(?=indicacion)"),
    Field(
        "presion_terapeutica",
        r"se observo disminucion de eventos respiratorios a (\d+) ?cm ?de ?[agu|h20]",
    ),
    Field("mascara_tipo", r"mascara (\w+) talla"),
    Field(
        "mascara_tamano",
        r"""talla ?(?:[:=] ?)?(?:["']? ?([^"' ,)]+) ?["']?|([^, )]+))(?=[, )]*(?:ref|\)|\z))""",
        groups=2,
    ),
    Field("mascara_referencia", r"(?:ref|referencia) ?[:-]? ?([^)]{1,60})(?:\)|\z)"),
]
