"""Exam types: how they are recognised, where their section lies, which extractor reads them."""

from __future__ import annotations

from dataclasses import dataclass, field

from somnotab.specs import basal, device, monitoring, titration
from somnotab.specs.fields import Field

# File types that are read.
READABLE = ("docx", "doc", "rtf")

# Fixed value: label of a report in which no exam type was recognised.
UNKNOWN = "DESCONOCIDO"


@dataclass(frozen=True)
class Exam:
    """A label, the phrases that reveal it and the markers around its section.

    Phrases are lower case and tested on the lower-cased normal form. ``start=None`` is the
    beginning of the text.
    """

    label: str
    phrases: tuple[str, ...]
    start: str | None
    end: str


_BASAL = "informe de polisomnografia basal"
_TITRATION = "informe de polisomnografia en titulacion de"
_CONCLUSION = "conclusion"

# Recognition phrases and section markers, in recognition order.
EXAMS = (
    Exam("BASAL", (_BASAL,), _BASAL, "saturacion o2 minima durante el sueno"),
    Exam("CPAP", (f"{_TITRATION} cpap",), None, _CONCLUSION),
    Exam(
        "DAM",
        (
            f"{_BASAL} con dispositivo mandibular",
            f"{_BASAL} con dispositivo de avance mandibular",
        ),
        f"{_BASAL} con dispositivo (?:de avance )?mandibular",
        _CONCLUSION,
    ),
    Exam(
        "BPAP",
        (f"{_TITRATION} bpap", f"{_TITRATION} bipap"),
        f"{_TITRATION} bi?pap",
        _CONCLUSION,
    ),
    Exam("ACTIGRAFIA", ("estadisticas diarias",), "fecha", "estadisticas diarias"),
    Exam("CAPNOGRAFIA", ("informe de capnografia",), "informe de capnografia", _CONCLUSION),
    Exam("AUTOCPAP", ("informe de titulacion con auto cpap",), None, "informe de cumplimiento"),
    Exam("POLIGRAFIA", ("informe poligrafia respiratoria",), None, "indicacion del estudio"),
)


# Words of which every recognition phrase holds at least one.
HINT_WORDS = ("informe", "estadisticas")

# Fixed value: the word most recognition phrases begin with.
OPENING = "informe"


@dataclass(frozen=True)
class Extractor:
    """Field list for one exam type in one file type.

    ``variants`` maps a layout variant to fields that replace or complete the common ones;
    ``variant_marks`` are the two headings that decide the variant.
    """

    exam: str
    ext: str
    fields: tuple[Field, ...]
    variants: dict[int, tuple[Field, ...]] = field(default_factory=dict)
    variant_marks: tuple[tuple[str, str], ...] | None = None
    with_source: bool = False

    @property
    def columns(self) -> list[str]:
        names = [f.name for f in self.fields]
        for extra in self.variants.values():
            names += [f.name for f in extra if f.name not in names]
        return names


def _extractor(exam, ext, fields, variants=None, marks=None, with_source=False) -> Extractor:
    fixed = {k: tuple(v) for k, v in (variants or {}).items()}
    return Extractor(exam, ext, tuple(fields), fixed, marks, with_source)


EXTRACTORS = (
    _extractor("BASAL", "doc", basal.DOC, basal.DOC_VARIANTS, basal.DOC_VARIANT_MARKS, True),
    _extractor("BASAL", "rtf", basal.RTF, basal.RTF_VARIANTS, basal.RTF_VARIANT_MARKS, True),
    _extractor("CPAP", "doc", titration.CPAP_DOC),
    _extractor("CPAP", "docx", titration.CPAP_DOCX),
    _extractor("CPAP", "rtf", titration.CPAP_RTF),
    _extractor("BPAP", "doc", titration.BPAP_DOC),
    _extractor("BPAP", "rtf", titration.BPAP_RTF),
    _extractor("DAM", "doc", device.DOC),
    _extractor("DAM", "rtf", device.RTF),
    _extractor("CAPNOGRAFIA", "doc", monitoring.CAPNOGRAPHY_DOC),
    _extractor("CAPNOGRAFIA", "rtf", monitoring.CAPNOGRAPHY_RTF),
    _extractor("ACTIGRAFIA", "doc", monitoring.ACTIGRAPHY_DOC),
    _extractor("AUTOCPAP", "docx", titration.AUTOCPAP_DOCX),
    _extractor("POLIGRAFIA", "docx", monitoring.POLYGRAPHY_DOCX),
)

# The types whose extraction is switched on by default in the scheduled run.
LIVE = ("BASAL",)


def extractor_for(exam: str, ext: str) -> Extractor:
    for candidate in EXTRACTORS:
        if (candidate.exam, candidate.ext) == (exam, ext):
            return candidate
    raise KeyError(f"no extractor for {exam} in .{ext} files")
