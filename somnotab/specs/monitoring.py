"""Fields of the capnography, actigraphy and respiratory polygraphy reports."""

from __future__ import annotations

from somnotab.specs.device import NAME
from somnotab.specs.fields import Field, cased

_WORD = "[a-záéíóúüñ]+"
_IDENTITY = "(?:id|cc|ti|ce) ?:? ?"
# What may belong to a value that begins with the next digit: its first letters and a label before them.
_IDENTITY_HEAD = rf"(?:(?![a-z]*edad)[a-z]*{_IDENTITY})?(?![a-z]*edad)[a-z]*+(?=\d)"
_ASLEEP = "durante (?:el )?sueno"
_DISTRIBUTION = ("Distribucion de EtCO2",)


def _mean_cell(name: str, skipped: int) -> Field:
    """Value of the "Media" row after ``skipped`` non-empty cells."""
    return Field(name, rf"Media\|(?:[^|]+\|){{{skipped}}}(\d+)", after=_DISTRIBUTION)


# Labels, units and stop words of the capnography layouts.
CAPNOGRAPHY_DOC = [
    *cased(NAME),
    Field("edad_paciente", "edad{sep}({num})"),
    Field(
        "medida_edad_paciente",
        rf"edad{{sep}}{{num}} ?({_WORD})\b(?: ?y ?\d+ ?{_WORD})? ?id",
    ),
    *cased(
        Field("id_paciente", r"Id{sep}([A-Za-z]?\d{4,10})"),
        Field("eps_paciente", "Empresa{sep}(.*?) ?Fecha", through="Fecha"),
        Field("fecha_proced", "Fecha{sep}({dmy}|{ymd})(?= ?DATOS)"),
    ),
    Field(
        "media_etco2_sueno",
        rf"\n\d+[^\d\n]*?{_ASLEEP}[^\d\n]*({{dec}})",
        pieces=rf"{_ASLEEP}\D*+(?:(?=(\d++\D*+{{dec}})))?+",
    ),
    *cased(
        Field("media_etco2_rem", "Durante REM: ?{num} ?Durante REM: ?({dec})"),
        Field("media_etco2_nrem", "Durante NREM: ?{num} ?Durante NREM: ?({dec})"),
        Field("nivel_max_etco2", r"nivel mas alto de EtCO2 durante el sueno fue de (\d+)"),
    ),
]

CAPNOGRAPHY_RTF = [
    *cased(
        Field("nombre_paciente", r"Nombre(?: del paciente)?:\|([^|]+)\|Edad"),
        Field("edad_paciente", r"\|Edad\| ?(\d{1,2}) ?anos?\b"),
    ),
    Field("medida_edad_paciente", r"edad\|? ?\d+ ?(\w+)\|? ?id"),
    *cased(
        Field("id_paciente", r"Id: ?\|? ?([A-Za-z]?\d{6,10})"),
        Field("eps_paciente", r"Empresa: ?\|([^|]+)\|Fecha"),
        Field("fecha_proced", r"Fecha: ?\|(\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4})\|"),
        _mean_cell("media_etco2_sueno", 3),
        _mean_cell("media_etco2_rem", 1),
        _mean_cell("media_etco2_nrem", 2),
        Field("nivel_max_etco2", r"EtCO2 mas alta durante TC: ?(\d{1,2})"),
    ),
]

_HALF_DAY = r"[ap]\. ?m\."

# Labels, units and stop words of the actigraphy layout. The identifier label is
# a set of single characters, so any of them before the colon counts.
ACTIGRAPHY_DOC = [
    *cased(
        Field(
            "nombre_paciente",
            r"Nombre ?: ?\*{0,2}([A-ZÑÁÉÍÓÚÜ ]+?) ?(?=\*{2}|TI ?:|ID ?:|CC ?:)",
        ),
        Field("id_paciente", r"[ID|T]: ?(\d+)"),
    ),
    Field("edad_paciente", r"edad: ?(\d+)\b"),
    Field("medida_edad_paciente", r"edad: ?\d+ ?(\w+)\b"),
    *cased(
        Field(
            "fecha_proced",
            r": ?(\d{1,2} (?:de )?[A-Za-z]+ \d{4})(?= Informacion de paciente)",
        ),
        Field(
            "tiempo_total_sueno",
            f"Promedio {{hms}} {_HALF_DAY} {{hms}} {_HALF_DAY} {{hms}} ({{hms}})",
        ),
        Field(
            "latencia_prom",
            rf"Promedio(?: {{hms}} ?(?:{_HALF_DAY})? ?){{4}}(\d+,\d+)",
        ),
    ),
]

# Labels, units and stop words of the polygraphy layout.
POLYGRAPHY_DOCX = [
    Field(
        "fecha_estudio",
        r"fecha\D{1,10}(\d{1,2}[/-]\d{1,2}[/-]\d{4}"
        r"|\d{1,2} ?(?:de|del)? ?[a-z]+ ?(?:de|del)?\d{4}) ?informacion",
    ),
    Field("nombre_paciente", "nombre(?: del paciente)? ?: ?([^:]+?) ?id"),
    # Between the value and the age stands no digit. So none ends in a stretch without digits that has no age and
    # that a digit ends; only what reaches up to that digit can be the beginning of another one.
    Field(
        "id_paciente",
        rf"{_IDENTITY}([a-z0-9]+)(?=[^\d\n]*?(?:edad|\z))",
        after=("nombre:",),
        before="edad",
        shortened=rf"(?:(?<=edad)|(?<!\D))(?!{_IDENTITY_HEAD})(?:(?!edad)\D)+?(?<![a-z\d])({_IDENTITY_HEAD})",
    ),
    Field("edad_paciente", r"edad(?: del paciente)? ?[:=] ?(\d+)"),
    Field("medida_edad_paciente", r"edad(?: del paciente)? ?[:=] ?\d+ ?(anos|meses)\b(?= ?estudio)"),
    Field("iah", "iah: ?({open})"),
    Field("ih", "ih: ?({open})"),
    Field("iac", " obstructiva: ?({open})"),
    Field("iam", "mixta: ?({open})"),
    Field("ido", "ido: ?({open})"),
    Field("meq_90porc_sat", "<=90%sat: ?({open})"),
]
