"""Table specifications: role, join keys, item and value columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TableSpec:
    name: str
    role: str  # core, event, child or dictionary
    keys: tuple[str, ...]
    item_col: str | None = None
    value_col: str | None = None


# The clinical tables, their join keys and measurement columns.
_SUBJECT = ("SUBJECT_ID",)
_ADMISSION = ("SUBJECT_ID", "HADM_ID")
_STAY = ("SUBJECT_ID", "HADM_ID", "ICUSTAY_ID")

CLINICAL_TABLES: tuple[TableSpec, ...] = (
    TableSpec("PATIENTS", "core", _SUBJECT),
    TableSpec("ADMISSIONS", "core", _ADMISSION),
    TableSpec("ICUSTAYS", "core", _STAY),
    TableSpec("SERVICES", "core", _ADMISSION),
    TableSpec("TRANSFERS", "core", _ADMISSION),
    TableSpec("LABEVENTS", "event", _ADMISSION, "ITEMID", "VALUENUM"),
    TableSpec("CHARTEVENTS", "event", _STAY, "ITEMID", "VALUENUM"),
    TableSpec("OUTPUTEVENTS", "event", _STAY, "ITEMID", "VALUENUM"),
    TableSpec("INPUTEVENTS_CV", "event", _STAY, "ITEMID", "VALUENUM"),
    TableSpec("INPUTEVENTS_MV", "event", _STAY, "ITEMID", "VALUENUM"),
    TableSpec("PROCEDUREEVENTS_MV", "event", _STAY, "ITEMID", "VALUENUM"),
    TableSpec("DATETIMEEVENTS", "event", _STAY, "ITEMID", "VALUENUM"),
    TableSpec("MICROBIOLOGYEVENTS", "event", _ADMISSION),
    TableSpec("NOTEEVENTS", "event", _ADMISSION),
    TableSpec("DIAGNOSES_ICD", "child", _ADMISSION),
    TableSpec("PROCEDURES_ICD", "child", _ADMISSION),
    TableSpec("CPTEVENTS", "child", _ADMISSION),
    TableSpec("DRGCODES", "child", _ADMISSION),
    TableSpec("PRESCRIPTIONS", "child", _STAY),
    TableSpec("CALLOUT", "child", _STAY),
    TableSpec("D_ITEMS", "dictionary", ("ITEMID",)),
    TableSpec("D_LABITEMS", "dictionary", ("ITEMID",)),
    TableSpec("D_ICD_DIAGNOSES", "dictionary", ("ICD9_CODE",)),
    TableSpec("D_ICD_PROCEDURES", "dictionary", ("ICD9_CODE",)),
    TableSpec("D_CPT", "dictionary", ("CPT_CD",)),
    TableSpec("CAREGIVERS", "dictionary", ("CGID",)),
)


def specs_by_role(role: str, specs: Iterable[TableSpec] = CLINICAL_TABLES) -> list[TableSpec]:
    return [s for s in specs if s.role == role]


def discover(
    spark: SparkSession,
    root: str,
    specs: Iterable[TableSpec] = CLINICAL_TABLES,
    exclude: Iterable[str] = (),
    views: bool = True,
) -> dict[str, DataFrame]:
    """Lazy DataFrames for the tables that exist under ``root``; optionally as temp views."""
    from .readers import resolve_table

    skip, found = set(exclude), {}
    for spec in specs:
        if spec.name in skip:
            continue
        df = resolve_table(spark, root, spec.name, on_missing="none")
        if df is not None:
            found[spec.name] = df
            if views:
                df.createOrReplaceTempView(spec.name)
    return found


def catalog_frame(spark: SparkSession, specs: Iterable[TableSpec] = CLINICAL_TABLES) -> DataFrame:
    rows = [(s.name, s.role, list(s.keys), s.item_col, s.value_col) for s in specs]
    return spark.createDataFrame(
        rows, "name string, role string, keys array<string>, item_col string, value_col string"
    )
