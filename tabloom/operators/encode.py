"""Reversible mixed-type encoder: one-hot with a missing level, min-max to [-1, 1]."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..functions.missing import filter_missing_rows, missing_filter_report
from ..functions.scalars import half_even_long


@dataclass(frozen=True)
class Slot:
    """One position of the feature array."""

    column: str
    level: str | None  # None in a categorical slot is the missing level
    categorical: bool
    low: float
    high: float

    @property
    def span(self) -> float:
        return (self.high - self.low) or 1.0


class TabularEncoder:
    """fit on training rows, then transform to (key..., features) and back."""

    def __init__(
        self,
        numeric: Sequence[str],
        categorical: Sequence[str],
        integers: Sequence[str] = (),
        max_missing_ratio: float | None = 0.5,
        max_levels: int | None = None,
    ) -> None:
        self.numeric = list(numeric)
        self.categorical = list(categorical)
        self.integers = [c for c in integers if c in self.numeric]
        self.max_missing_ratio = max_missing_ratio
        self.max_levels = max_levels
        self.slots: list[Slot] | None = None
        self.n_rows_filtered = 0

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical

    def _filtered(self, df: DataFrame) -> DataFrame:
        return filter_missing_rows(df, self.columns, self.max_missing_ratio)

    def fit(self, df: DataFrame) -> "TabularEncoder":
        text = set(self.numeric) - set(numeric_columns(df))
        if text:
            raise ValueError(f"numeric columns expected: {sorted(text)}")
        if self.max_missing_ratio is not None:
            self.n_rows_filtered = missing_filter_report(df, self.columns, self.max_missing_ratio).first()["n_filtered"]
        rows = self._filtered(df)
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(self.numeric):
            aggs += [F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}")]
        bounds = rows.agg(*aggs).first()
        n = bounds["n"]
        slots = [
            Slot(c, None, False, bounds[f"lo{i}"] or 0.0, bounds[f"hi{i}"] or 0.0) for i, c in enumerate(self.numeric)
        ]
        counts = self._level_counts(rows)
        for c in self.categorical:
            found = counts.get(c, {})
            if self.max_levels is not None and len(found) > self.max_levels:
                raise ValueError(f"{c} has more than {self.max_levels} levels")
            for level in [*sorted(v for v in found if v is not None), None]:
                k = found.get(level, 0)
                slots.append(Slot(c, level, True, 1.0 if k == n and n else 0.0, 1.0 if k else 0.0))
        self.slots = slots
        return self

    def _level_counts(self, rows: DataFrame) -> dict[str, dict[str | None, int]]:
        if not self.categorical:
            return {}
        cells = F.array(
            *[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("level")) for c in self.categorical]
        )
        counts = rows.select(F.inline(cells)).groupBy("col", "level").agg(F.count(F.lit(1)).alias("k"))
        place = F.row_number().over(W.partitionBy("col").orderBy("level"))
        out: dict[str, dict[str | None, int]] = {}
        if self.max_levels is not None:
            # at most max_levels + 2 rows per column come back; one too many raises in fit
            counts = counts.withColumn("_p", place).where(F.col("_p") <= self.max_levels + 2)
        # every level becomes a slot of the encoder
        for r in counts.toLocalIterator():
            out.setdefault(r["col"], {})[r["level"]] = r["k"]
        return out

    def _require(self) -> list[Slot]:
        if self.slots is None:
            raise RuntimeError("fit the encoder first")
        return self.slots

    @property
    def n_features(self) -> int:
        return len(self._require())

    def level_table(self, spark) -> DataFrame:
        """(position, column, level, low, high) of every feature."""
        rows = [(i, s.column, s.level, s.categorical, s.low, s.high) for i, s in enumerate(self._require())]
        return spark.createDataFrame(
            rows, "position int, column string, level string, categorical boolean, low double, high double"
        )

    def raw_columns(self) -> list[Column]:
        out = []
        for s in self._require():
            if not s.categorical:
                out.append(F.col(s.column).cast("double"))
            elif s.level is None:
                out.append(F.col(s.column).isNull().cast("double"))
            else:
                out.append(F.coalesce(F.col(s.column).cast("string") == F.lit(s.level), F.lit(False)).cast("double"))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` plus the scaled features array; rows above the missing ratio are left out.

        A level unseen in fit encodes as no level at all.
        """
        scaled = [
            F.lit(2.0) * (c - F.lit(s.low)) / F.lit(s.span) - F.lit(1.0) for s, c in zip(self._require(), self.raw_columns())
        ]
        return self._filtered(df).select(*keep, F.array(*scaled).alias("features"))

    def inverse_transform(self, df: DataFrame, keep: Sequence[str] = (), vec: str = "features") -> DataFrame:
        """Back to the original columns: unscale, round integers half to even, strongest level wins."""
        slots = self._require()
        raw = [
            (F.col(vec)[i] + F.lit(1.0)) / F.lit(2.0) * F.lit(s.span) + F.lit(s.low) for i, s in enumerate(slots)
        ]
        out = []
        for i, c in enumerate(self.numeric):
            out.append((half_even_long(raw[i]) if c in self.integers else raw[i]).alias(c))
        for c in self.categorical:
            at = [i for i, s in enumerate(slots) if s.categorical and s.column == c]
            values = F.array(*[raw[i] for i in at])
            levels = F.array(*[F.lit(slots[i].level).cast("string") for i in at])
            out.append(F.element_at(levels, F.array_position(values, F.array_max(values)).cast("int")).alias(c))
        return df.select(*keep, *out)
