"""Workbook cells to one gated record per file.

Input is the long cell table ``(file, cell, value)``. The pivot is a plain aggregate
with partial results on the map side, so the shuffle moves one row per file and task, and neither a
huge workbook nor a repeated cell gathers in one task. Spark sorts for an aggregate of texts; each
Arrow batch is merged before, so the sort holds a row per file and batch, not one per cell. A file
without any named cell is a file that does not pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from somnotab.specs import workbook as wb


def is_rehab_workbook(name: Column) -> Column:
    """Name test on the bare file name; case counts."""
    part = name.contains(wb.NAME_PARTS[0])
    for other in wb.NAME_PARTS[1:]:
        part = part | name.contains(other)
    return part & name.endswith(wb.SUFFIX)


def _merger(names: tuple[str, ...]):
    def merge(batches):
        wanted, width = pa.array(names, pa.string()), len(names)
        for batch in batches:
            cell, value = batch.column("cell"), batch.column("value")
            files = batch.column("file").dictionary_encode(null_encoding="encode")
            code = pc.index_in(cell, wanted.cast(cell.type))
            # A place for each file and named cell; places without a value are not there.
            place = pc.add(pc.multiply(files.indices.cast(pa.int64()), width), code.cast(pa.int64()))
            known = pa.table([place, value], ["place", "value"]).filter(pc.and_(code.is_valid(), value.is_valid()))
            best = known.group_by("place", use_threads=False).aggregate([("value", "max")]).sort_by("place")
            places = best["place"].to_numpy()
            ends = np.searchsorted(places, np.arange(len(files.dictionary) + 1) * width)
            items = pa.concat_arrays([pa.array([], value.type), *best["value_max"].chunks])
            found = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), wanted.take(pa.array(places % width)), items)
            yield pa.RecordBatch.from_arrays([files.dictionary, found], ["file", "found"])

    return merge


def merged_cells(cells: DataFrame) -> DataFrame:
    """``(file, found)``: the named cells of a file that stand in one Arrow batch, as a map to the greatest value."""
    kinds = cells.schema
    found = T.MapType(T.StringType(), kinds["value"].dataType)
    schema = T.StructType([kinds["file"], T.StructField("found", found)])
    return cells.select("file", "cell", "value").mapInArrow(_merger(wb.CELLS), schema)


def pivot_cells(cells: DataFrame) -> DataFrame:
    """One row per file with a column per named cell."""
    values = [F.max(F.try_element_at("found", F.lit(c))).alias(c) for c in wb.CELLS]
    return merged_cells(cells).groupBy("file").agg(*values)


def classify(pivoted: DataFrame) -> DataFrame:
    """Add ``modalidad``, ``accepted`` and ``razon``."""
    tele = F.coalesce(F.upper(wb.MODALITY_CELL).contains(wb.TELE), F.lit(False))
    consent = F.coalesce(F.col(wb.CONSENT_CELL) == wb.CONSENT, F.lit(False))
    diagnosis = F.coalesce(F.upper(wb.DIAGNOSIS_CELL).contains(wb.DIAGNOSIS), F.lit(False))
    reasons = F.array_compact(
        F.array(F.when(~consent, wb.NO_CONSENT), F.when(~diagnosis, wb.NO_DIAGNOSIS))
    )
    return (
        pivoted.withColumn("modalidad", F.when(tele, wb.TELE).otherwise(wb.ON_SITE))
        .withColumn("accepted", consent & diagnosis)
        .withColumn("razon", F.array_join(reasons, ", "))
    )


def accepted(classified: DataFrame) -> DataFrame:
    """Records of the files that pass the gate."""
    final = F.when(
        F.col("modalidad") == wb.TELE, F.col(wb.RESIST_FINAL_TELE)
    ).otherwise(F.col(wb.RESIST_FINAL_ON_SITE))
    fields = [
        (final if cell is None else F.col(cell)).alias(name)
        for name, cell in wb.FIELD_CELLS.items()
    ]
    return classified.where("accepted").select(
        F.col("file").alias("ruta_archivo"), *fields, "modalidad"
    )


def rejected(classified: DataFrame) -> DataFrame:
    """Files that do not pass, with the reasons and the diagnosis cell."""
    return classified.where(~F.col("accepted")).select(
        F.col("file").alias("ruta_archivo"),
        "razon",
        F.col(wb.DIAGNOSIS_CELL).alias("contenido_B7"),
    )
