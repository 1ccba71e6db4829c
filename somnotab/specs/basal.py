"""Fields of the baseline polysomnography report, DOC and RTF layouts."""

from __future__ import annotations

from somnotab.specs.fields import Field, cell, column

_ARCHITECTURE = "arquitectura de sueno:"
_PHASES = "distribucion de fases de sueno:"
_EVENTS = "resumen de eventos respiratorios"
_EVENTS_TST = r"resumen de eventos respiratorios \(tiempo de sueno total\)"
_DATE_AHEAD = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"


def _age_part(unit: str, value: str) -> str:
    return f"(?: ?,? ?y? ?{value} ?{unit}?)?"


def _unit(separator: str, tail: str, gap: str = " ?") -> str:
    """Unit in parentheses before the number, or bare / in parentheses after it."""
    return rf"{separator}(?:\( ?([a-z]+) ?\){gap}{{num}}|{{num}}{gap}\(?([a-z]+)\)?){tail}"


_IDENTIFIER = Field("id", r"\bid(?:entificacion)?\b{cell}([a-z0-9]+)", before=r"\bpeso\b")

# Labels, units and stop words of the DOC layout.
DOC = [
    Field(
        "nombre",
        r"\n{colon}([a-z0-9., ]+)(?= ?edad)",
        pieces="nombre({colon}(?:(?!nombre ?:)[a-z0-9., ])*+)",
    ),
    Field(
        "edad_anos",
        r"edad{colon}(\d+) ?anos?"
        + _age_part("meses", r"\d+") + _age_part("dias", r"\d+") + ".{0,100}? ?id",
    ),
    Field(
        "edad_meses",
        r"edad{colon}(?:\d+ ?anos?)?"
        + _age_part("meses", r"(\d+)") + _age_part("dias", r"\d+") + ".{0,100}? ?id",
    ),
    Field(
        "edad_dias",
        r"edad{colon}(?:\d+ ?anos?)?"
        + _age_part("meses", r"\d+") + _age_part("dias", r"(\d+)") + ".{0,100}? ?id",
    ),
    _IDENTIFIER,
    Field("peso", r"(?<!\d)({num})(?: |\z)", after=("peso",), before=" talla"),
    Field("medida_peso", _unit("peso{colon}", " "), groups=2, before="talla"),
    Field(
        "talla",
        r"talla{colon}(?:\( ?[a-z]+ ?\) ?)?({num})(?: ?\(?[a-z]+\)?)? ",
        before="imc",
    ),
    Field("medida_talla", _unit("talla{colon}", " "), groups=2, before="imc"),
    Field("imc", "imc{colon}({num}) ?cuello"),
    Field("cuello", "cuello{colon}({num}) ?[a-z]* ?perimetro"),
    Field("medida_cuello", r"cuello{colon}{num} ?([^\d ]+) ?perimetro"),
    Field(
        "perimetro_abdominal",
        "Perimetro Abdominal{colon}({num}) ?(?:cm|m)? ?Solicita",
        cased=True,
    ),
    Field(
        "medida_perimetro_abdominal",
        r"Perimetro Abdominal{colon}{num} ?([^\d ]+) ?Solicita",
        cased=True,
    ),
    Field("solicita", "solicita{colon}(.*?) ?e(?:mpresa|ps)", through="e(?:mpresa|ps)"),
    Field("empresa", rf"e(?:mpresa|ps){{colon}}(.{{1,50}}?)(?= ?(?:fecha|{_DATE_AHEAD}|\z))"),
    Field("fecha_estudio", r"fecha{colon}(\d{1,4}[-/]\d{2}[-/]\d{2,4}) ?procedimiento"),
    Field("epworth", r"epworth{colon}(\d+) ?/24"),
    Field("tiempo_en_cama", "tiempo en cama: ?({num})", after=(_ARCHITECTURE,)),
    Field("tiempo_sueno", "tiempo total de sueno: ?({num})", after=(_ARCHITECTURE,)),
    Field("eficiencia_sueno", "eficiencia de sueno: ?({num})%", after=(_ARCHITECTURE,)),
    Field("latencia_sueno_total", "latencia de sueno{colon}({num})", after=(_ARCHITECTURE,)),
    Field("latencia_sueno_rem", "latencia de sueno rem{colon}({num})", after=(_ARCHITECTURE,)),
    Field(
        "indice_microalertamientos",
        r"indice despertares{colon}({num}) ?/hr\. ?distribucion de fases de sueno",
        after=("microalertamientos",),
    ),
    Field("porcentaje_sueno_rem", r"rem \d+ {num} ({num})", after=(_PHASES,)),
    Field("porcentaje_sueno_profundo", r"s3 \d+ {num} ({num})", after=(_PHASES,)),
    *[
        Field(name, column(r"indice \(nº/h tst\)", k), after=(_EVENTS,))
        for name, k in (("iac", 1), ("iao", 2), ("iam", 3), ("ih", 5), ("iah", 6))
    ],
    *[
        Field(f"indice_desat_{part}", column(r"indice desat \(#/hour\)", k), after=("oximetria:",))
        for part, k in (("rem", 2), ("nrem", 3), ("total", 4))
    ],
    *[
        Field(f"oxim_menor{limit}_total", column(rf"<{limit} \(min\)", 4), after=("oximetria:",))
        for limit in (90, 80, 70, 60)
    ],
    Field("t90", "T90{sep}({loose}) ?%", after=("INTERPRETACION",), cased=True),
]

_INDEX_CELLS = r"indice (?:\(nº/h tst\)|\[nº/h\])"

# Labels, units and stop words of the RTF layout, whose table cells end in a pipe.
RTF = [
    Field(
        "nombre",
        r"\n ?(?:del ?paciente)?{cell}([a-z0-9., ]+)(?= ?\|? ?(?:edad|\t))",
        pieces=r"nombre( ?(?:del ?paciente)?{cell}"
        r"(?:(?!nombre ?(?:del ?paciente)? ?(?::|\|(?! ?(?:edad|\t))))[a-z0-9., ])*+"
        r"(?:\|? ?(?:edad|\t))?+)",
    ),
    Field("edad_anos", r"edad{sep}(\d+) ?anos?.{0,100}?id"),
    Field("edad_meses", r"edad.{0,100}?(\d+) ?meses?.{0,100}?id"),
    Field("edad_dias", r"edad.{0,100}?(\d+) ?dias?.{0,100}?id"),
    _IDENTIFIER,
    Field("peso", r"peso{cell}(?:\( ?[a-z]+ ?\) ?\|?)? ?({num})", before="talla"),
    Field("medida_peso", _unit("peso{cell}", "", gap=r" ?\|? ?"), groups=2, before="talla"),
    Field("talla", r"talla{cell}(?:\( ?[a-z]+ ?\) ?\|?)? ?({num})", before="imc"),
    Field("medida_talla", _unit("talla{cell}", "", gap=r" ?\|? ?"), groups=2, before="imc"),
    Field("imc", r"imc{cell}({loose}) ?\|? ?cuello"),
    Field("cuello", r"cuello{cell}(\d+) ?[a-z]+ ?\|? ?perimetro"),
    Field("medida_cuello", r"cuello{cell}\d+ ?([a-z]+) ?\|? ?perimetro"),
    Field("perimetro_abdominal", r"perimetro ?abdominal{cell}(\d+) ?[a-z]+ ?\|? ?solicita"),
    Field(
        "medida_perimetro_abdominal",
        r"perimetro ?abdominal{cell}\d+ ?([a-z]+) ?\|? ?solicita",
    ),
    Field("solicita", r"solicita{cell}(.+?) ?\|? ?empresa", through="empresa"),
    Field(
        "empresa",
        rf"e(?:mpresa|ps){{cell}}(.{{1,50}}?)(?= ?\|? ?(?:fecha|{_DATE_AHEAD}|\z))",
    ),
    Field(
        "fecha_estudio",
        r"fecha(?: del estudio)?{cell}(\d{1,2}/\d{1,2}/\d{2,4}) ?\|[ |]*procedimiento",
    ),
    Field("epworth", r"escala ?de ?epworth (\d+) ?/ ?\d+"),
    *[
        Field(name, label + r"{cell}([\d.]+)", after=(_ARCHITECTURE,))
        for name, label in (
            ("tiempo_en_cama", "tiempo en cama"),
            ("tiempo_sueno", "tiempo total de sueno"),
            ("eficiencia_sueno", "eficiencia de sueno"),
            ("latencia_sueno_total", "latencia de sueno"),
            ("latencia_sueno_rem", "latencia de sueno rem"),
        )
    ],
    Field(
        "indice_microalertamientos",
        "indice despertares{cell}({loose})",
        after=("microalertamientos",),
    ),
    Field("porcentaje_sueno_rem", r"rem ?\| ?{loose} ?\| ?({loose})", after=(_PHASES,)),
    Field("porcentaje_sueno_profundo", r"s3 ?\| ?{loose} ?\| ?({loose})", after=(_PHASES,)),
    *[
        Field(name, cell(_INDEX_CELLS, k), after=(_EVENTS_TST,))
        for name, k in (("iac", 1), ("iao", 2), ("iam", 3))
    ],
    *[
        Field(
            f"indice_desat_{part}",
            cell(r"indice desat \(#/hour\)", k, skip=r"[\d.,]*"),
            after=("oximetria",),
        )
        for part, k in (("rem", 2), ("nrem", 3), ("total", 4))
    ],
    *[
        Field(
            f"oxim_menor{limit}_total",
            cell(rf"<{limit} ?\(min\)", 4, skip=r"[\d.,]*"),
            after=("oximetria",),
        )
        for limit in (90, 80, 70, 60)
    ],
    Field("t90", "t90{sep}({loose}) ?%", after=("interpretacion",)),
]

# The two column headings that tell the layout variants apart, each as the bare
# words and as they must stand in the lower-cased text.
# Variant 2 has both, variant 1 only the first, variant 3 is everything else.
DOC_VARIANT_MARKS = (("suma ap", r"\bsuma ap\b"), ("rera", r"\brera\b"))
RTF_VARIANT_MARKS = (("suma ap", r"\| ?suma ap ?\|"), ("rera", r"\| ?rera ?\|"))


def _event_count(pattern: str) -> Field:
    return Field("numero_eventos_ah", pattern, after=(_EVENTS_TST,))


def _index(name: str, k: int) -> Field:
    return Field(name, cell(_INDEX_CELLS, k), after=(_EVENTS_TST,))


_ANY_CELL = "[^|]*"

# Positions in the count row and the index row, per layout variant.
DOC_VARIANTS = {
    1: [_event_count(column("numero", 6, "{loose}"))],
    2: [_event_count(column("numero", 8, "{loose}"))],
    3: [_event_count(cell("numero ?", 5, skip=_ANY_CELL, value=_ANY_CELL))],
}
RTF_VARIANTS = {
    1: [
        _event_count(cell("numero", 6, skip=_ANY_CELL, value=_ANY_CELL)),
        _index("ih", 4),
        _index("iah", 5),
    ],
    2: [_event_count(cell("numero ?", 8)), _index("ih", 5), _index("iah", 6)],
    3: [
        _event_count(cell("numero ?", 5, skip=_ANY_CELL, value=_ANY_CELL)),
        _index("ih", 4),
        _index("iah", 5),
    ],
}
