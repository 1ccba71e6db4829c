"""Cells of the pulmonary rehabilitation workbook."""

from __future__ import annotations

# Name parts and suffix of the workbooks that are read.
NAME_PARTS = ("EGRESO", "SEGUIMIENTO")
SUFFIX = ".xlsx"

# Where each field of the accepted record is found.
FIELD_CELLS = {
    "id_paciente": "G6",
    "edad_paciente": "H5",
    "fecha_inicio": "G7",
    "fecha_fin": "G8",
    "eps": "B6",
    "c6m_inicial": "C16",
    "c6m_final": "D16",
    "c6m_cambio": "E16",
    "mmrc_inicial": "C28",
    "mmrc_final": "D28",
    "mmrc_cambio": "E28",
    "cat_inicial": "C31",
    "cat_final": "D31",
    "cat_cambio": "E31",
    "exacerb_inicial": "H32",
    "exacerb_final": "I32",
    "exacerb_cambio": "J32",
    "fev1_pred_porc_post": "E36",
    "resist_inicial": "G18",
    "resist_final": None,
    "resist_cambio": "J18",
}

# The final resistance depends on the modality.
RESIST_FINAL_TELE = "H18"
RESIST_FINAL_ON_SITE = "I18"

# Gate and modality cells.
CONSENT_CELL, CONSENT = "G9", "SI"
DIAGNOSIS_CELL, DIAGNOSIS = "B7", "EPOC"
MODALITY_CELL, TELE, ON_SITE = "B1", "TELE", "PRESENCIAL"

# Reasons of rejection.
NO_CONSENT = "No cumple con 'SI' en G9"
NO_DIAGNOSIS = "No cumple con 'EPOC' en B7"

CELLS = tuple(
    dict.fromkeys(
        [c for c in FIELD_CELLS.values() if c]
        + [RESIST_FINAL_TELE, RESIST_FINAL_ON_SITE, CONSENT_CELL, DIAGNOSIS_CELL, MODALITY_CELL]
    )
)
