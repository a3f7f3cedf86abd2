"""Metric scores, the index and its labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kicknet.operators import metrics as M


@dataclass(frozen=True)
class ShareOfBest:
    """Metric as a percentage of the value of the best sites."""

    name: str
    metric: str
    best: float

    def score(self) -> Column:
        return F.col(self.metric) / F.lit(float(self.best)) * 100


@dataclass(frozen=True)
class Inverted:
    """Metric that falls as sites get better, on a scale that ends at ``worst``."""

    name: str
    metric: str
    best: float
    worst: float

    def score(self) -> Column:
        span = F.lit(float(self.worst)) - F.lit(float(self.best))
        return (F.lit(float(self.worst)) - F.col(self.metric)) / span * 100


@dataclass(frozen=True)
class Band:
    low: float
    high: float
    comparison: str
    narrative: str


# Best values of the metrics, in the order the index adds them up
SCORES = (
    ShareOfBest("ColeopteraTaxa_Score", M.COLEOPTERA_TAXA.name, 5),
    ShareOfBest("EphemeropteraTaxa_Score", M.EPHEMEROPTERA_TAXA.name, 10.2),
    ShareOfBest("TotalTaxa_Score", M.TOTAL_TAXA.name, 46),
    ShareOfBest("IntolerantTaxa_Score", M.INTOLERANT_TAXA.name, 9),
    Inverted("MBI_score", M.BIOTIC_INDEX.name, 4.9, 11),
    ShareOfBest("PercentScraper_Score", M.PERCENT_SCRAPERS.name, 29.6),
)
# This metric enters the index as it is
UNSCALED = (M.PERCENT_EPT.name,)
INDEX = "mIBI"
INDEX_CAP = 100.0

# Bands of the index. Values between two bands have no label.
BANDS = (
    Band(73.0, 100.0, ">75th percentile", "Exceptional"),
    Band(41.8, 72.9, "> 10th percentile", "Good"),
    Band(20.9, 41.8, "bisect 10th percentile (upper)", "Fair"),
    Band(0.0, 20.8, "bisect 10th percentile (lower)", "Poor"),
)


def score_metrics(table: DataFrame, scores: Sequence = SCORES) -> DataFrame:
    return table.withColumns({s.name: s.score() for s in scores})


def score_index(
    table: DataFrame, scores: Sequence = SCORES, unscaled: Sequence[str] = UNSCALED
) -> DataFrame:
    """Mean of the scores, capped above. The scores themselves are not capped."""
    parts = [F.col(s.name) for s in scores] + [F.col(c) for c in unscaled]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return table.withColumn(INDEX, total / F.lit(float(len(parts)))).withColumn(
        # NaN sorts above every number
        INDEX,
        F.when((F.col(INDEX) > INDEX_CAP) & ~F.isnan(INDEX), INDEX_CAP).otherwise(F.col(INDEX)),
    )


def _label(bands: Sequence[Band], text: Callable[[Band], str]) -> Column:
    return F.coalesce(
        *[F.when(F.col(INDEX).between(b.low, b.high), F.lit(text(b))) for b in bands]
    )


def classify_index(table: DataFrame, bands: Sequence[Band] = BANDS) -> DataFrame:
    """Two label columns; the first band that contains the index wins."""
    return table.withColumns(
        {
            "Comparison_to_Reference": _label(bands, lambda b: b.comparison),
            "Narrative_Description": _label(bands, lambda b: b.narrative),
        }
    )
