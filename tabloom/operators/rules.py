"""Declarative value checks on columns chosen by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns


@dataclass(frozen=True)
class Rule:
    """Values for which ``bad`` holds break the rule in columns whose name matches ``pattern``.

    ``severity`` "violation" marks the row; "extreme" is only counted.
    """

    name: str
    pattern: str
    bad: Callable[[Column], Column]
    severity: str = "violation"


def word(*words: str) -> str:
    """Name parts (singular or plural) are separated by case changes, digits or punctuation, so "age" is in
    "patientAge" and "AGES", not in "percentage"."""
    return rf"(?:^|[^A-Za-z])(?:{'|'.join(words)})s?(?:$|[^A-Za-z])"


def spaced(name: str) -> str:
    """The name with a space at every case change."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)


# The columns that may not be negative and the limits of plausible values.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("negative", word("age", "count", "number"), lambda c: c < 0),
    Rule("bmi_over_100", word("bmi"), lambda c: c > 100, "extreme"),
    Rule("age_over_150", word("age"), lambda c: c > 150, "extreme"),
)


def matching(df: DataFrame, rules: Sequence[Rule]) -> list[tuple[Rule, str]]:
    return [
        (r, c) for r in rules for c in numeric_columns(df) if re.search(r.pattern, spaced(c), re.IGNORECASE)
    ]


def rule_flags(df: DataFrame, keep: Sequence[str], rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """``keep`` plus has_violation (0/1) over all rows."""
    hits = [F.coalesce(r.bad(F.col(f"`{c}`")), F.lit(False)) for r, c in matching(df, rules) if r.severity == "violation"]
    broken = F.lit(False)
    for h in hits:
        broken = broken | h
    return df.select(*keep, broken.cast("int").alias("has_violation"))


def rule_counts(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """(rule, column, severity, n) for every rule that some value breaks."""
    pairs = matching(df, rules)
    if not pairs:
        return df.sparkSession.createDataFrame([], "rule string, column string, severity string, n bigint")
    cells = [
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(c).alias("column"), F.lit(r.severity).alias("severity"),
            F.count_if(r.bad(F.col(f"`{c}`"))).alias("n"),
        )
        for r, c in pairs
    ]
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s")).where("n > 0")
