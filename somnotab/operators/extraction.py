"""Labelled slices to records.

An extractor is a list of field specs; the work is three projections over one row:

1. lower-case the section and cut the regions the fields name (each distinct one once),
2. one ``regexp_extract`` per field on its region,
3. empty string to NULL.

Keeping them apart matters. Catalyst does not inline an expensive expression that is used
more than once, so a region is searched by all its fields but cut once, and step 3, which
looks at a value twice, does not run the search twice. Where step 3 is a lambda, a fence keeps the
searches out of it: nothing inside a lambda is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from somnotab.functions import text as tx
from somnotab.operators.labelling import OK, computed_once
from somnotab.specs.exams import EXTRACTORS, Extractor, extractor_for
from somnotab.specs.fields import Field

MISSING = "N/A"


def layout_variant(key: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    """1, 2 or 3 by the two headings found in the lower-cased text.

    The bare words are looked for first, so that most texts without them need no pattern search.
    """
    first, second = (key.contains(words) & key.rlike(f"(?U){mark}") for words, mark in marks)
    return F.when(first & second, 2).when(first, 1).otherwise(3)


_KEY = "_key"


_CUTS = {
    "after": tx.text_after,
    "before": tx.text_before_last,
    "through": tx.text_through_last,
    "pieces": tx.text_pieces,
    "shortened": tx.text_shortened,
}


class _Projections:
    """Collects regions and field expressions for one or several extractors."""

    def __init__(self, section: str, extractors: tuple[Extractor, ...], dispatch: bool):
        self.section = section
        self.extractors = extractors
        self.dispatch = dispatch
        # Region identity to column name and the extractors that use it.
        self.regions: dict[tuple, tuple[str, set[int]]] = {}
        for number, extractor in enumerate(extractors):
            for spec in _all_fields(extractor):
                for depth in range(2, len(spec.region) + 1):
                    name = f"_region{len(self.regions)}"
                    _, users = self.regions.setdefault(spec.region[:depth], (name, set()))
                    users.add(number)

    def _mine(self, numbers) -> Column:
        return F.col("_extractor").isin(*sorted(numbers))

    def _text(self, region: tuple) -> Column:
        """The column holding a region; with no cuts, the section or its lower-cased form."""
        if len(region) > 1:
            return F.col(self.regions[region][0])
        return F.col(_KEY if region[0] else self.section)

    def steps(self) -> list[dict[str, Column]]:
        """The lower-cased section, then regions by depth; each step reads the one before."""
        key = tx.phrase_key(F.col(self.section))
        if self.dispatch:
            key = F.when(F.col("_extractor").isNotNull(), key)
        steps: dict[int, dict[str, Column]] = {1: {_KEY: key}}
        for region, (name, users) in self.regions.items():
            side, marker, flags = region[-1]
            value = _CUTS[side](self._text(region[:-1]), marker, flags)
            if self.dispatch:
                value = F.when(self._mine(users), value)
            steps.setdefault(len(region), {})[name] = value
        return [steps[depth] for depth in sorted(steps)]

    def variant(self) -> Column | None:
        result = None
        for number, extractor in enumerate(self.extractors):
            if extractor.variant_marks is None:
                continue
            value = layout_variant(F.col(_KEY), extractor.variant_marks)
            if self.dispatch:
                mine = F.col("_extractor") == number
                result = F.when(mine, value) if result is None else result.when(mine, value)
            else:
                result = value
        return result

    def _groups(self, spec: Field, group: int) -> Column:
        return F.regexp_extract(self._text(spec.region), spec.regex, group)

    def _value(self, spec: Field) -> Column:
        """First non-empty group; empty string when there is none."""
        if spec.groups == 1:
            return self._groups(spec, 1)
        options = [tx.blank_to_null(self._groups(spec, g)) for g in range(1, spec.groups + 1)]
        return F.coalesce(*options, F.lit(""))

    def _of_extractor(self, extractor: Extractor, name: str) -> Column:
        for spec in extractor.fields:
            if spec.name == name:
                return self._value(spec)
        value = None
        for variant, specs in extractor.variants.items():
            [spec] = [s for s in specs if s.name == name]
            chosen = F.col("_variant") == variant
            option = self._value(spec)
            value = F.when(chosen, option) if value is None else value.when(chosen, option)
        return value

    def columns(self) -> list[Column]:
        """One column per field of the only extractor."""
        [extractor] = self.extractors
        return [self._of_extractor(extractor, c).alias(c) for c in extractor.columns]

    def record(self) -> Column:
        """Texts found by the row's own extractor, in its column order, as one array; empty where there is none."""
        result = None
        for number, extractor in enumerate(self.extractors):
            mine = F.col("_extractor") == number
            values = F.array(*[self._of_extractor(extractor, c) for c in extractor.columns])
            result = F.when(mine, values) if result is None else result.when(mine, values)
        return result


def _all_fields(extractor: Extractor) -> list[Field]:
    return [*extractor.fields, *(s for specs in extractor.variants.values() for s in specs)]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def _with_regions(rows: DataFrame, work: _Projections) -> DataFrame:
    frame = rows
    for step in work.steps():
        frame = frame.withColumns(step)
    variant = work.variant()
    return frame if variant is None else frame.withColumn("_variant", variant)


def extract(slices: DataFrame, exam: str, ext: str, section: str = "section") -> DataFrame:
    """Records of one exam type in one file type.

    ``slices`` holds at least ``exam_type``, ``ext`` and the section; other columns pass
    through. Missing values are NULL. When the extractor tags its source and there is a
    ``path`` column, ``fuente`` is added. Fields that are not selected later are not searched.
    """
    rows = slices.where((F.col("exam_type") == exam) & (F.col("ext") == ext))
    return extract_fields(rows, extractor_for(exam, ext), section)


def extract_fields(rows: DataFrame, extractor: Extractor, section: str = "section") -> DataFrame:
    """Apply an extractor's field list to every row, whatever its type columns say."""
    work = _Projections(section, (extractor,), dispatch=False)
    keep = [c for c in rows.columns if c != section]
    raw = _with_regions(rows, work).select(*keep, *work.columns())
    records = raw.select(
        *keep, *[tx.blank_to_null(_quoted(c)).alias(c) for c in extractor.columns]
    )
    if extractor.with_source and "path" in keep:
        records = records.withColumn("fuente", F.col("path"))
    return records


def extract_all(
    slices: DataFrame,
    extractors: tuple[Extractor, ...] = EXTRACTORS,
    section: str = "section",
) -> DataFrame:
    """All extractors over one scan; one row per (report, label) of every status.

    The section is replaced by ``record``: the values of the row's own extractor in its column
    order, NULL where a field was not found, and no array at all for rows that cannot be
    extracted. ``records_of`` gives them their names back; the audit needs nothing else, so
    the texts are read once for both.

    The array keeps the generated code small: as separate columns the sparse union of all
    extractors would not fit one whole-stage method.
    """
    number = None
    for i, e in enumerate(extractors):
        mine = (F.col("status") == OK) & (F.col("exam_type") == e.exam) & (F.col("ext") == e.ext)
        number = F.when(mine, i) if number is None else number.when(mine, i)
    work = _Projections(section, extractors, dispatch=True)
    keep = [c for c in slices.columns if c != section]
    rows = _with_regions(slices.withColumn("_extractor", number), work)
    found = computed_once(rows.select(*keep, work.record().alias("_texts")), "_texts", "_found")
    record = F.transform("_found", tx.blank_to_null)
    return computed_once(found.select(*keep, record.alias("_record")), "_record", "record")


def records_of(extracted: DataFrame, exam: str, ext: str) -> DataFrame:
    """Named records of one extractor out of ``extract_all``."""
    extractor = extractor_for(exam, ext)
    rows = extracted.where(
        (F.col("exam_type") == exam) & (F.col("ext") == ext) & F.col("record").isNotNull()
    )
    named = [F.get("record", F.lit(i)).alias(c) for i, c in enumerate(extractor.columns)]
    if extractor.with_source:
        named.append(F.col("path").alias("fuente"))
    return rows.select("doc_id", "path", "ext", "exam_type", *named)


def with_missing_text(records: DataFrame, columns: list[str]) -> DataFrame:
    """Write NULL as the text ``N/A``, the form the result files use."""
    filled = {c: F.coalesce(_quoted(c), F.lit(MISSING)) for c in columns}
    return records.select(
        *[filled[c].alias(c) if c in filled else _quoted(c) for c in records.columns]
    )
