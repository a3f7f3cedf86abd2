"""Double counting: coarse records of a sample beyond the first of their rank value.

Rows are compared by their whole content (every column but the order columns),
so an exact copy of a first row is not redundant while the same taxon with
another count is. "First" is by ``order_cols``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kicknet.functions.missing import any_true, whole
from kicknet.operators.matching import (
    anti_join_all, keep_first, lead_hash, null_safe_join, shuffle_partitions,
)
from kicknet.operators.taxa import CLASS, FAMILY, GENUS, GROUP, NAME, ORDER, PHYLUM, TRIBE

# rank that must be missing -> rank whose value is counted once
COARSE_RANKS = {FAMILY: ORDER, ORDER: CLASS, CLASS: PHYLUM}


def at_tribe() -> Column:
    return F.col(GENUS).isNull() & F.col(GROUP).isNotNull() & F.col(TRIBE).isNotNull()


def at_family() -> Column:
    return F.col(GENUS).isNull() & F.col(FAMILY).isNotNull()


def redundant_tribe(rows: DataFrame, sample_key: Sequence[str], order_cols: Sequence[str]):
    """Tribe-level rows that are not the first of their tribe in the sample."""
    coarse = rows.where(at_tribe())
    return anti_join_all(coarse, keep_first(coarse, [*sample_key, TRIBE], order_cols), order_cols)


def redundant_family(rows: DataFrame, sample_key: Sequence[str], order_cols: Sequence[str]):
    """Family-level rows that are neither the first of their family nor the first of their tribe."""
    coarse = rows.where(at_family())
    tribes = keep_first(rows.where(at_tribe()), [*sample_key, TRIBE], order_cols)
    families = keep_first(coarse, [*sample_key, FAMILY], order_cols)
    return anti_join_all(coarse, families.unionByName(tribes), order_cols)


def redundant_rank(
    rows: DataFrame, sample_key: Sequence[str], order_cols: Sequence[str], missing: str
):
    """Order, class or phylum level: first rows of a name that are not the first of their rank value.

    ``missing`` is the rank below, which has to be null.
    """
    rank = COARSE_RANKS[missing]
    named = keep_first(rows.where(F.col(missing).isNull()), [*sample_key, NAME], order_cols)
    named = named.where(F.col(rank).isNotNull())
    return anti_join_all(named, keep_first(named, [*sample_key, rank], order_cols), order_cols)


def _first_row_marks(
    rows: DataFrame, sample_key: list[str], order_cols: list[str], content: list[str]
) -> DataFrame:
    """What the five rules say about row contents: one line per content that is a first row.

    Every row enters the rules it falls under; the first row per rule and value
    is a minimum, so this moves one row per (sample, rule, value) and map task
    however many rows or copies a sample has. The second step compares the
    first rows of the names of a sample, at most one per master name.
    """

    def entry(applies: Column, rule: str, key: str) -> Column:
        return F.when(applies, F.struct(F.lit(rule).alias("rule"), F.col(key).alias("value")))

    entries = F.array_compact(
        F.array(
            entry(at_tribe(), TRIBE, TRIBE),
            entry(at_family(), FAMILY, FAMILY),
            *[entry(F.col(missing).isNull(), rank, NAME) for missing, rank in COARSE_RANKS.items()],
        )
    )
    body = [c for c in content if c not in sample_key]
    # a minimum over structs sorts the rows of a task, which otherwise are those of a whole split
    dealt = rows.repartition(shuffle_partitions(rows), F.xxhash64(F.monotonically_increasing_id()))
    entered = dealt.select(
        *sample_key, F.explode(entries).alias("_entry"), whole(order_cols + body).alias("_row")
    ).select(*sample_key, F.col("_entry.rule").alias("_rule"), F.col("_entry.value").alias("_value"), "_row")
    keys = [*sample_key, "_rule", "_value"]
    first = (
        entered.groupBy(lead_hash(entered, keys).alias("_lead"), *keys)
        .agg(F.min("_row").alias("_first"))
        .drop("_lead")
    )
    rank_value = F.coalesce(
        *[F.when(F.col("_rule") == rank, F.col("_first")[rank]) for rank in COARSE_RANKS.values()],
        F.when(F.col("_rule").isin(TRIBE, FAMILY), F.col("_value")),
    )
    leader = F.min("_first").over(Window.partitionBy(*sample_key, "_rule", "_rank_value"))
    marks = (
        first.withColumn("_rank_value", rank_value)
        .where(F.col("_rank_value").isNotNull())
        .withColumn("_leader", leader)
        .withColumn("_is_leader", whole(body, "_first") == whole(body, "_leader"))
        .where(F.col("_rule").isin(TRIBE, FAMILY) | ~F.col("_is_leader"))
    )
    return (
        marks.select(
            *sample_key, *[F.col("_first")[c].alias(c) for c in body], "_rule", "_is_leader"
        )
        .groupBy(*content)
        .agg(
            any_true(F.col("_rule") == TRIBE).alias("_tribe_first"),
            any_true(F.col("_rule") == FAMILY).alias("_family_first"),
            any_true(~F.col("_is_leader")).alias("_rank_spare"),
        )
    )


def drop_redundant(
    rows: DataFrame, sample_key: Sequence[str], order_cols: Sequence[str]
) -> DataFrame:
    """The rows without those any of the five rules calls redundant.

    Equal to taking the ``redundant_*`` tables off one after another by
    anti-joins, with one pass for the first rows and one join. Rows that have a
    genus, family, order and class fall under no rule and are passed on
    unshuffled.
    """
    sample_key, order_cols = list(sample_key), list(order_cols)
    content = [c for c in rows.columns if c not in order_cols]
    coarse = F.lit(False)
    for rank in (GENUS, *COARSE_RANKS):
        coarse = coarse | F.col(rank).isNull()
    open_rows = rows.where(coarse)
    marks = _first_row_marks(open_rows, sample_key, order_cols, content)

    def marked(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    redundant = (
        (at_tribe() & ~marked("_tribe_first"))
        | (at_family() & ~marked("_family_first") & ~marked("_tribe_first"))
        | marked("_rank_spare")
    )
    names = ["_tribe_first", "_family_first", "_rank_spare"]
    kept = null_safe_join(open_rows, marks, content, "left", names).where(~redundant).drop(*names)
    return rows.where(~coarse).unionByName(kept)
