"""From a table to synthetic rows with the same columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.columns import select_roles
from ..functions.missing import normalize_missing
from ..operators.encode import TabularEncoder
from ..operators.flow import FlowParams, FlowSynthesizer, materialise
from ..operators.sampling import sample_rows, split_rows
from ..session import cut_lineage
from .reports import compare_real_synth

# Roles of the assembled clinical table's columns.
EXCLUDED = (
    "ROW_ID", "SUBJECT_ID", "HADM_ID", "ICUSTAY_ID", "ROW_ID_pat", "ROW_ID_icu", "ROW_ID_services",
    "ROW_ID_transfers", "ICUSTAY_ID_transfers",
    "ADMITTIME", "DISCHTIME", "DEATHTIME", "DOB", "DOD", "DOD_HOSP", "DOD_SSN", "EDREGTIME", "EDOUTTIME",
    "INTIME", "OUTTIME", "TRANSFERTIME", "INTIME_transfers", "OUTTIME_transfers",
    "DIAGNOSIS",
)
CATEGORICAL = (
    "ADMISSION_TYPE", "ADMISSION_LOCATION", "DISCHARGE_LOCATION", "INSURANCE", "LANGUAGE", "RELIGION",
    "MARITAL_STATUS", "ETHNICITY", "GENDER", "DBSOURCE", "FIRST_CAREUNIT", "LAST_CAREUNIT", "PREV_SERVICE",
    "CURR_SERVICE", "DBSOURCE_transfers", "EVENTTYPE", "PREV_CAREUNIT", "CURR_CAREUNIT",
)
INTEGER = (
    "HOSPITAL_EXPIRE_FLAG", "HAS_CHARTEVENTS_DATA", "EXPIRE_FLAG", "FIRST_WARDID", "LAST_WARDID", "PREV_WARDID",
    "CURR_WARDID", "DIAGNOSES_ICD_count", "PROCEDURES_ICD_count", "CPTEVENTS_count", "DRGCODES_count",
    "PRESCRIPTIONS_count", "OUTPUTEVENTS_count", "INPUTEVENTS_CV_count", "INPUTEVENTS_MV_count",
    "PROCEDUREEVENTS_MV_count", "DATETIMEEVENTS_count", "MICROBIOLOGYEVENTS_count",
)


@dataclass
class Synthesis:
    encoder: TabularEncoder
    model: FlowSynthesizer
    train: DataFrame
    synthetic: DataFrame
    comparison: dict[str, DataFrame]


def synthesize(
    df: DataFrame,
    key: Sequence[str],
    categorical: Sequence[str] = CATEGORICAL,
    integers: Sequence[str] = INTEGER,
    exclude: Sequence[str] = EXCLUDED,
    n_samples: int = 1000,
    params: FlowParams | None = None,
    max_missing_ratio: float | None = 0.5,
    max_rows: int | None = None,
    label: str | None = None,
    direction: str = "forward",
) -> Synthesis:
    """Split, encode the training part, fit, sample, decode and compare with the training rows."""
    params = params or FlowParams()
    df = normalize_missing(df)
    if max_rows is not None:
        df = sample_rows(df, key, max_rows, params.seed)
    hidden = [*exclude, *key, *([label] if label else [])]
    nums, cats, ints = select_roles(df, categorical, integers, hidden)
    # several passes read the training rows
    train = cut_lineage(split_rows(df, key, seed=params.seed).where("split = 'train'").drop("split"))
    encoder = TabularEncoder(nums, cats, ints, max_missing_ratio).fit(train)
    keep = [*key, *([label] if label else [])]
    encoded = encoder.transform(train, keep)
    model = FlowSynthesizer(params).fit(encoded, key, label)
    made = materialise(model.sample(df.sparkSession, n_samples, direction=direction))
    synthetic = encoder.inverse_transform(made, ["id", *(["label"] if label else [])])
    return Synthesis(encoder, model, train, synthetic, compare_real_synth(train, synthetic, nums, cats))
