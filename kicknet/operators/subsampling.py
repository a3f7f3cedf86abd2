"""Subsampling of large samples to a fixed number of individuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kicknet.operators.matching import null_safe_join, repeat_rows, spread_evenly
from kicknet.sources.workspace import written

# Fixed value: individuals a sample is reduced to
TARGET = 360
# times that a task of the draw writes out and sorts
TIMES_PER_TASK = 500_000
# 52 bits of a hash make a uniform number
_HASH_DIGITS = 13
_HASH_RANGE = float(16**_HASH_DIGITS)


def expand_individuals(df: DataFrame, count_col: str, number: str = "individual") -> DataFrame:
    """One row per individual: each row repeated by its whole count, numbered from 1."""
    return repeat_rows(df, F.floor(count_col), number)


def _checked(count: Column) -> Column:
    refuse = F.raise_error(F.lit("subsampling needs counts that are neither missing nor negative"))
    return F.when(count.isNull() | F.isnan(count) | (count < 0), refuse.cast("double")).otherwise(
        count
    )


def kind_hash(columns: Sequence[str]) -> Column:
    """Hash of the values that make individuals interchangeable.

    Each value comes after its length, and null is no length, so different values can
    not make one text.
    """
    texts = [F.col(c).cast("string") for c in columns]
    return F.md5(
        F.concat(
            *[
                F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n"))
                for t in texts
            ]
        )
    )


def _waiting_time(seed: int) -> Column:
    """Exponential variate of the number ``_number`` of a kind, from a hash of both and the seed."""
    digest = F.md5(F.concat_ws("|", "_kind", F.col("_number").cast("string"), F.lit(str(seed))))
    uniform = F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("double") / _HASH_RANGE
    return -F.log(1 - uniform)


def rarefy(
    df: DataFrame,
    sample_key: Sequence[str],
    id_col: str,
    count_col: str = "count",
    target: int = TARGET,
    seed: int = 0,
) -> DataFrame:
    """Draw ``target`` individuals without replacement from every sample that has more.

    Smaller samples pass unchanged. In a drawn sample fractional counts are cut
    to whole individuals, each kind of row drawn appears once, and its count is
    the number of individuals drawn of its (sample, taxon).

    Give every individual an independent exponential time; the ``target``
    earliest of a sample are a uniform draw. Individuals of a kind (equal but
    for the count) are interchangeable, so only the ordered times of a kind
    matter, and those of n individuals are running sums of E/n, E/(n-1), ... A
    kind therefore needs no more than its first ``target`` times: exact for any
    n, and a sample of billions costs no more than its kinds. And only the
    ``target`` kinds whose first times are the earliest can be drawn from, so no more
    than ``target`` squared times of a sample are written out, after the shuffles by
    sample. The kinds of large samples go to a work folder first, as the number of
    tasks of the draw follows from the number of their times.
    """
    key = list(sample_key)
    kind = [c for c in df.columns if c != count_col]
    count = _checked(F.col(count_col).cast("double"))
    totals = df.groupBy(*key).agg(F.sum(count).alias("_total"))
    passed = null_safe_join(df, totals.where(F.col("_total") <= target), key, "left_semi")

    whole_counts = (
        df.groupBy(*kind)
        .agg(F.sum(F.floor(count)).cast("long").alias("_n"))
        .where(F.col("_n") >= 1)
    )
    large = totals.where(F.col("_total") > target)
    kinds = null_safe_join(whole_counts, large, key, "left_semi").withColumn(
        "_kind", kind_hash(kind)
    )
    kinds = written(kinds, "kinds")
    n_times = kinds.agg(F.sum(F.least(F.col("_n"), F.lit(target).cast("long")))).first()[0] or 0
    numbers = F.sequence(F.lit(1).cast("long"), F.least(F.col("_n"), F.lit(target).cast("long")))
    gap = _waiting_time(seed) / (F.col("_n") - F.col("_number") + 1)
    # the limit on row_number is applied within every task before kinds are brought together
    by_first = Window.partitionBy(*key).orderBy("_first", "_kind")
    front = (
        kinds.withColumn("_number", F.lit(1).cast("long"))
        .withColumn("_first", gap)
        .withColumn("_rank", F.row_number().over(by_first))
        .where(F.col("_rank") <= target)
        .drop("_rank", "_first", "_number")
    )
    front = spread_evenly(front, key, n_times, TIMES_PER_TASK)
    in_kind = Window.partitionBy(*key, "_kind").orderBy("_number")
    times = (
        front.withColumn("_number", F.explode(numbers))
        .withColumn("_gap", gap)
        .withColumn("_time", F.sum("_gap").over(in_kind.rowsBetween(Window.unboundedPreceding, 0)))
    )
    in_sample = Window.partitionBy(*key).orderBy("_time", "_kind", "_number")
    drawn = times.withColumn("_place", F.row_number().over(in_sample)).where(
        F.col("_place") <= target
    )
    per_taxon = F.count("*").over(Window.partitionBy(*key, id_col))
    counted = (
        drawn.withColumn("_drawn", per_taxon)
        .select(*kind, F.col("_drawn").cast(df.schema[count_col].dataType).alias(count_col))
        .distinct()
    )
    return passed.unionByName(counted.select(*df.columns))
