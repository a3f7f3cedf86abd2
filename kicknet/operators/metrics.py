"""Sample metrics: richness, composition and the biotic index.

A metric is a small specification; a table of any set of metrics is one
two-step aggregate, first by (sample, taxon id) and then by sample. Both steps
combine before they shuffle, so a sample of any size only moves its taxa.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kicknet.functions.missing import divide, whole, zero_if_missing
from kicknet.operators.matching import null_safe_join
from kicknet.operators.taxa import FEEDING, ID, ORDER, SEMI_AQUATIC, TOLERANCE
from kicknet.sources.workspace import written


def _everything() -> Column:
    return F.lit(True)


def _partial_sum(value: Column, name: str) -> list[Column]:
    """Sum and number of missing values, to be added up per sample."""
    return [
        F.coalesce(F.sum(value), F.lit(0.0)).alias(name),
        F.count(F.when(value.isNull(), 1)).alias(f"{name}_missing"),
    ]


def _added(name: str) -> Column:
    return F.when(F.sum(f"{name}_missing") == 0, F.sum(name))


@dataclass(frozen=True)
class Richness:
    """Number of distinct taxon ids among the rows the condition holds for; a null id is one taxon."""

    name: str
    where: Callable[[], Column] = _everything

    def by_taxon(self, count: Column) -> list[Column]:
        return [F.max(F.when(self.where(), 1).otherwise(0)).alias(self.name)]

    def by_sample(self) -> Column:
        return F.sum(self.name)

    def present(self) -> Column:
        return F.sum(self.name) > 0


@dataclass(frozen=True)
class Share:
    """Percentage of the sample's individuals in the rows the condition holds for."""

    name: str
    where: Callable[[], Column]

    def by_taxon(self, count: Column) -> list[Column]:
        # rows outside the subset add a plain 0 and are never missing
        subset = F.when(self.where(), count).when(~F.coalesce(self.where(), F.lit(False)), 0.0)
        return [
            *_partial_sum(count, f"{self.name}_all"),
            *_partial_sum(subset, f"{self.name}_part"),
            F.max(F.when(self.where(), 1).otherwise(0)).alias(f"{self.name}_present"),
        ]

    def by_sample(self) -> Column:
        return F.when(
            self.present(),
            divide(_added(f"{self.name}_part"), _added(f"{self.name}_all")) * 100,
        )

    def present(self) -> Column:
        return F.max(f"{self.name}_present") > 0


@dataclass(frozen=True)
class WeightedMean:
    """Mean of an attribute over individuals; null if any row lacks the attribute or the count."""

    name: str
    attribute: str

    def by_taxon(self, count: Column) -> list[Column]:
        return [
            *_partial_sum(count, f"{self.name}_all"),
            *_partial_sum(count * F.col(self.attribute), f"{self.name}_part"),
        ]

    def by_sample(self) -> Column:
        return divide(_added(f"{self.name}_part"), _added(f"{self.name}_all"))

    def present(self) -> Column:
        return F.lit(True)


# Spellings of the insect orders and the scrapers' feeding group
COLEOPTERA = ("Coleoptera", "COLEOPTERA")
EPHEMEROPTERA = ("Ephemeroptera", "EPHEMEROPTERA")
PLECOPTERA = ("Plecoptera", "PLECOPTERA")
TRICHOPTERA = ("Trichoptera", "TRICHOPTERA")
SCRAPER = "SC"
INTOLERANT_UP_TO = 3.0

TOTAL_TAXA = Richness("TotalTaxa_Value")
COLEOPTERA_TAXA = Richness(
    "ColeopteraTaxa_Value",
    lambda: (F.col(TOLERANCE) != F.lit(SEMI_AQUATIC)) & F.col(ORDER).isin(*COLEOPTERA),
)
EPHEMEROPTERA_TAXA = Richness(
    "EphemeropteraTaxa_Value", lambda: F.col(ORDER).isin(*EPHEMEROPTERA)
)
INTOLERANT_TAXA = Richness(
    "IntolerantTaxa_Value", lambda: F.col(TOLERANCE) <= F.lit(INTOLERANT_UP_TO)
)
BIOTIC_INDEX = WeightedMean("MBI", TOLERANCE)
PERCENT_SCRAPERS = Share("PercentScrapers", lambda: F.col(FEEDING) == SCRAPER)
PERCENT_EPT = Share(
    "Percent_EPT", lambda: F.col(ORDER).isin(*EPHEMEROPTERA, *PLECOPTERA, *TRICHOPTERA)
)

METRICS = (
    TOTAL_TAXA,
    COLEOPTERA_TAXA,
    EPHEMEROPTERA_TAXA,
    INTOLERANT_TAXA,
    BIOTIC_INDEX,
    PERCENT_SCRAPERS,
    PERCENT_EPT,
)


def _by_taxon(rows: DataFrame, sample_key, count_col: str, metrics) -> DataFrame:
    count = F.col(count_col).cast("double")
    partials = [p for m in metrics for p in m.by_taxon(count)]
    return rows.groupBy(*sample_key, ID).agg(*partials)


def single_metric(rows: DataFrame, sample_key: Sequence[str], count_col: str, metric) -> DataFrame:
    """One metric for the samples that have a row it looks at."""
    return _of_samples(_by_taxon(rows, sample_key, count_col, [metric]), sample_key, metric)


def _of_samples(by_taxon: DataFrame, sample_key: Sequence[str], metric) -> DataFrame:
    return (
        by_taxon.groupBy(*sample_key)
        .agg(metric.by_sample().alias(metric.name), metric.present().alias("_present"))
        .where("_present")
        .drop("_present")
    )


def assemble_metrics(
    rows: DataFrame,
    sample_key: Sequence[str],
    count_col: str,
    metrics: Sequence = METRICS,
    strict: bool = False,
) -> DataFrame:
    """All metrics, one row per sample.

    Missing metrics become 0, also the ones that are missing because a count or
    a tolerance is, or because all counts are 0; ``strict`` leaves those null and only turns the metrics of
    absent subsets to 0.
    """
    values = []
    for m in metrics:
        value = m.by_sample()
        if strict:
            if not isinstance(m, Richness):
                value = F.when(~F.isnan(value), value)  # 0/0, as of a sample without individuals
            value = F.when(m.present(), value).otherwise(0.0)
        elif not isinstance(m, Richness):
            value = zero_if_missing(value)
        values.append(value.alias(m.name))
    return _by_taxon(rows, sample_key, count_col, metrics).groupBy(*sample_key).agg(*values)


def assemble_metrics_full_join(
    rows: DataFrame, sample_key: Sequence[str], count_col: str, metrics: Sequence = METRICS
) -> DataFrame:
    """The same table put together from one table per metric by full outer joins.

    ``assemble_metrics`` gives the same rows in one pass and is what the scores use. The
    sums by taxon go to a work folder: every metric's table is made from them.
    """
    key = list(sample_key)
    by_taxon = written(_by_taxon(rows, key, count_col, metrics), "by_taxon")
    result = None
    for m in metrics:
        table = _of_samples(by_taxon, key, m).select(whole(key).alias("_key"), m.name)
        if result is None:
            result = table
        else:
            result = result.join(table, "_key", "full")
    filled = [
        F.coalesce(F.col(m.name), F.lit(0)).alias(m.name)
        if isinstance(m, Richness)
        else zero_if_missing(F.col(m.name)).alias(m.name)
        for m in metrics
    ]
    return result.select(*[F.col("_key")[c].alias(c) for c in key], *filled)


def sample_totals(rows: DataFrame, sample_key: Sequence[str], count_col: str, total: str):
    """Every row with its sample's total of counts, null if one of them is.

    Totals are aggregated and joined back: unlike a window this never brings
    the rows of a large sample together.
    """
    totals = (
        rows.groupBy(*sample_key)
        .agg(*_partial_sum(F.col(count_col).cast("double"), "_total"))
        .withColumn(total, F.when(F.col("_total_missing") == 0, F.col("_total")))
    )
    return null_safe_join(rows, totals, sample_key, "inner", [total])
