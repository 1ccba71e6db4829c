"""Column classes, units and final layout of the curated baseline table."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ColumnClasses:
    strings: tuple[str, ...] = ()
    integers: tuple[str, ...] = ()
    doubles: tuple[str, ...] = ()
    dates: tuple[str, ...] = ()


# Declared class of each column of the unified table.
BASAL_CLASSES = ColumnClasses(
    strings=(
        "nombre", "id", "medida_peso", "medida_talla", "medida_cuello",
        "medida_perimetro_abdominal", "solicita", "empresa", "fuente", "uuid",
    ),
    integers=(),
    doubles=(
        "edad_anos", "edad_meses", "edad_dias", "epworth", "peso", "talla", "imc", "cuello",
        "perimetro_abdominal", "tiempo_en_cama", "tiempo_sueno", "eficiencia_sueno",
        "latencia_sueno_total", "latencia_sueno_rem", "indice_microalertamientos",
        "porcentaje_sueno_rem", "porcentaje_sueno_profundo", "iac", "iao", "iam",
        "indice_desat_rem", "indice_desat_nrem", "indice_desat_total", "oxim_menor90_total",
        "oxim_menor80_total", "oxim_menor70_total", "oxim_menor60_total", "t90", "ih", "iah",
        "numero_eventos_ah",
    ),
    dates=("fecha_estudio",),
)

# Columns published as percentages.
PERCENT_COLUMNS = (
    "eficiencia_sueno", "porcentaje_sueno_rem", "porcentaje_sueno_profundo", "t90",
)

# Final columns, in order.
FINAL_COLUMNS = (
    "nombre", "id", "imc", "solicita", "empresa", "fecha_estudio", "epworth",
    "tiempo_en_cama", "tiempo_sueno", "eficiencia_sueno", "latencia_sueno_total",
    "latencia_sueno_rem", "indice_microalertamientos", "porcentaje_sueno_rem",
    "porcentaje_sueno_profundo", "iac", "iao", "iam", "indice_desat_rem",
    "indice_desat_nrem", "indice_desat_total", "oxim_menor90_total", "oxim_menor80_total",
    "oxim_menor70_total", "oxim_menor60_total", "t90", "numero_eventos_ah", "ih", "iah",
    "fuente", "uuid", "edad_anos_decimal", "peso_kg", "talla_cm", "cuello_cm",
    "perimetro_abdominal_cm",
)

# Number format of each class in the published sheet, first match wins.
FORMATS = (
    ("strings", "TEXT", "@"),
    ("integers", "NUMBER", "0"),
    ("percents", "PERCENT", "0.00%"),
    ("doubles", "NUMBER", "0.00"),
    ("dates", "DATE", "yyyy-mm-dd"),
)


@dataclass(frozen=True)
class Scale:
    """Unit spellings and how a value in them becomes the target unit."""

    units: tuple[str, ...]
    times: int = 1
    over: int = 1


@dataclass(frozen=True)
class Measure:
    """A measured column, its unit column and target column.

    ``reported_as_known`` are the units left out of the unknown-unit report; it is its own
    list because for the height it is narrower than the accepted units.
    """

    name: str
    unit_column: str
    target: str
    scales: tuple[Scale, ...]
    null_is_zero: bool = True
    reported_as_known: tuple[str, ...] | None = None

    @property
    def known_units(self) -> tuple[str, ...]:
        if self.reported_as_known is not None:
            return self.reported_as_known
        return tuple(u for s in self.scales for u in s.units)


# Accepted unit spellings per measure.
MEASURES = (
    Measure(
        "peso", "medida_peso", "peso_kg",
        (Scale(("kg", "kgs", "kgr", "kl")), Scale(("g", "gr", "grs"), over=1000)),
        null_is_zero=False,
    ),
    Measure(
        "talla", "medida_talla", "talla_cm",
        (Scale(("m", "mts", "metros"), times=100), Scale(("c", "cm", "cms", "a"))),
        reported_as_known=("cm", "m"),
    ),
    Measure(
        "cuello", "medida_cuello", "cuello_cm",
        (Scale(("m", "mts", "metros"), times=100), Scale(("c", "cm", "cms"))),
    ),
    Measure(
        "perimetro_abdominal", "medida_perimetro_abdominal", "perimetro_abdominal_cm",
        (
            Scale(("m", "ms", "mts"), times=100),
            Scale(("cm", "cms", "cm.", ".cm", ".ccm", "ccm")),
        ),
    ),
)


def measure(name: str) -> Measure:
    return next(m for m in MEASURES if m.name == name)
