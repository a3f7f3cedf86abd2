"""Taxonomic ambiguity within a sample: a parent record next to records of its children.

Three rules decide what becomes of a record that is identified only to some
rank: drop it if the sample has a kept record below it (RPKC-S), or drop it and
give its count to those records, in proportion (DPAC-S) or to the largest one
(APTC-S). Ranks need not form a tree.

What happens to a row depends only on its group and its rank values, so the
levels are worked out on a table with one line per (group, rank values). That
table is aggregated before it is shuffled and holds at most as many lines per
group as the taxonomy has, whatever the size of a sample; its lines are then
joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kicknet.functions.missing import any_true, divide, spreading_sum, whole
from kicknet.operators.matching import lead_hash, null_safe_join, spread_evenly
from kicknet.sources.workspace import written

RPKC, DPAC, APTC = "RPKC-S", "DPAC-S", "APTC-S"
METHODS = (RPKC, DPAC, APTC)
# lines that a task sorts once for every rank
LINES_PER_TASK = 100_000


def _level(ranks: Sequence[str]) -> Column:
    """Number of the first rank that has a value; null if none has."""
    return F.coalesce(*[F.when(F.col(r).isNotNull(), i) for i, r in enumerate(ranks, 1)])


def _over(group: Sequence[str], rank: str):
    # led by a hash, the sort of the window compares one number for most pairs of lines
    return Window.partitionBy(F.xxhash64(*group, rank), *group, rank)


def _sum_where(flag: Column, value: Column, window) -> Column:
    """Sum of the flagged values over the window, null if a flagged value is null."""
    missing = F.count(F.when(flag & value.isNull(), 1)).over(window)
    return F.when(missing == 0, F.sum(F.when(flag, value)).over(window))


def _walk(lines: DataFrame, group: list[str], ranks: list[str], look=None, receive=None):
    """Decide ``_keep`` level by level, from the second rank up.

    ``look(rank, parent, window)`` names what has to be known of the lines that
    share a rank value, ``receive`` are the columns that change when kept lines
    take over the count of the parents among them. The lines go to a work folder,
    which tells their number, and are spread by group once; every level is one
    window that fits that.
    """
    lines = written(lines, "lines")
    lines = spread_evenly(lines, group, lines.count(), LINES_PER_TASK)
    lines = lines.withColumn("_keep", F.col("_level") == 1)
    for number, rank in enumerate(ranks[1:], 2):
        window = _over(group, rank)
        parent = F.col("_level") == number
        seen = {"_has_child": F.max("_keep").over(window)}
        if look:
            seen.update(look(rank, parent, window))
        keep = F.col("_keep") | (parent & ~F.col("_has_child"))
        lines = lines.withColumns(seen).withColumns({**(receive or {}), "_keep": keep}).drop(*seen)
    return lines


def _takes_over(rank: str, parent: Column, window) -> Column:
    """Kept lines with a value at this rank that some parent line has as well."""
    return (
        F.col("_keep") & F.col(rank).isNotNull() & (F.count(F.when(parent, 1)).over(window) > 0)
    )


def _keep_lines(df: DataFrame, group: list[str], ranks: list[str]) -> DataFrame:
    lines = df.select(*group, *ranks, _level(ranks).alias("_level")).where("_level is not null")
    return _walk(lines.distinct(), group, ranks)


def _proportional_lines(df: DataFrame, group, ranks, count: Column) -> DataFrame:
    """``_factor``: what the counts of a line's rows are multiplied by.

    A row's gain at a level is proportional to its running count, so all rows
    of a line grow by the same factor.
    """
    lines = (
        df.select(*group, *ranks, _level(ranks).alias("_level"), count.alias("_count"))
        .where("_level is not null")
        .groupBy(*group, *ranks, "_level")
        .agg(spreading_sum(F.col("_count")).alias("_count"))
        .withColumn("_factor", F.lit(1.0))
    )

    def look(rank, parent, window):
        held = F.col("_count") * F.col("_factor")
        return {
            "_takes": _takes_over(rank, parent, window),
            "_given": _sum_where(parent, F.col("_count"), window),
            "_held": _sum_where(F.col("_keep"), held, window),
        }

    grown = F.col("_factor") * (divide(F.col("_given"), F.col("_held")) + 1)
    factor = F.when(F.col("_takes"), grown).otherwise(F.col("_factor"))
    return _walk(lines, group, ranks, look, {"_factor": factor})


def _largest_lines(rows: DataFrame, group, ranks, count: Column, order, rest, seed) -> DataFrame:
    """``_top``: the largest row of each line, and ``_extra``: what that row receives.

    Counts are not negative, so a row that has received stays the largest of
    its line and no other row of the line ever receives. Ties between equal
    counts go by a hash of the group, the order columns (all columns without
    any) and the seed. ``rest`` are the columns that tell the rows of a line apart.
    """
    told_apart = [*group, *(order or [*ranks, *rest])]
    tie = F.md5(
        F.concat_ws("|", *[F.col(c).cast("string") for c in told_apart], F.lit(str(seed)))
    )
    usable = F.col("_count").isNotNull() & ~F.isnan("_count")
    negative = F.raise_error(F.lit(f"{APTC} needs counts that are not negative"))
    lines = (
        rows.withColumn("_level", _level(ranks))
        .where("_level is not null")
        .withColumn("_count", F.when(count < 0, negative.cast("double")).otherwise(count))
        .groupBy(lead_hash(rows, [*group, *ranks]).alias("_lead"), *group, *ranks, "_level")
        .agg(
            spreading_sum(F.col("_count")).alias("_count"),
            any_true(~usable).alias("_unusable"),
            F.min(
                F.when(
                    usable,
                    F.struct(
                        (-F.col("_count")).alias("rank"),
                        tie.alias("tie"),
                        whole(rest).alias("row"),
                        F.col("_number").alias("number"),
                    ),
                )
            ).alias("_top"),
        )
        .drop("_lead")
        .withColumn("_extra", F.lit(0.0))
    )

    extra = F.col("_extra")
    running = F.struct(
        (F.col("_top.rank") - extra).alias("rank"),
        F.col("_top.tie").alias("tie"),
        F.col("_top.row").alias("row"),
        whole(ranks).alias("line"),
    )
    unsure = F.col("_unusable") | extra.isNull() | F.isnan(extra)

    def look(rank, parent, window):
        return {
            "_takes": _takes_over(rank, parent, window),
            "_given": _sum_where(parent, F.col("_count"), window),
            "_blocked": F.max(F.col("_keep") & unsure).over(window),
            "_largest": F.min(F.when(F.col("_keep"), running)).over(window),
        }

    gets = F.col("_takes") & ~F.col("_blocked") & (running == F.col("_largest"))
    gained = F.when(gets, extra + F.col("_given")).otherwise(extra)
    return _walk(lines, group, ranks, look, {"_extra": gained})


def _resolve_rpkc(df, group, ranks, to_filter) -> DataFrame:
    df = written(df)
    lowest, key = F.col(ranks[0]), group + ranks
    lines = _keep_lines(df, group, ranks).where((F.col("_level") > 1) & F.col("_keep"))
    # rows with a value at the lowest rank are kept whatever the group holds
    settled, rest = df.where(lowest.isNotNull()), df.where(lowest.isNull())
    if to_filter:
        some_rank = reduce(lambda a, b: a | b, [F.col(r).isNotNull() for r in ranks])
        kept = null_safe_join(rest.where(some_rank), lines, key, "left_semi")
        return settled.unionByName(kept)
    flagged = null_safe_join(rest, lines, key, "left", ["_keep"])
    flagged = flagged.withColumn("is_ambiguous", F.col("_keep").isNull()).drop("_keep")
    return settled.withColumn("is_ambiguous", F.lit(False)).unionByName(flagged)


def _resolve_dpac(df, group, ranks, count, to_filter) -> DataFrame:
    key = group + ranks
    lines = _proportional_lines(df, group, ranks, count)
    if to_filter:
        rows = null_safe_join(df, lines.where("_keep"), key, "inner", ["_factor"])
        return rows.withColumn("new_count", count * F.col("_factor")).drop("_factor")
    rows = null_safe_join(df, lines, key, "left", ["_factor", "_keep"])
    keep = F.coalesce(F.col("_keep"), F.lit(False))
    return (
        rows.withColumn("is_ambiguous", ~keep)
        .withColumn("new_count", F.when(keep, count * F.col("_factor")).otherwise(count))
        .drop("_factor", "_keep")
    )


def _resolve_aptc(df, group, ranks, count, to_filter, order, seed) -> DataFrame:
    key, columns = group + ranks, df.columns
    rest = [c for c in order if c not in key]
    rest += [c for c in columns if c not in key and c not in rest]
    rows = df.where(_level(ranks).isNotNull()) if to_filter else df
    # numbered once, rows tell a receiver from its copies: one pass over the joined rows
    rows = written(rows.withColumn("_number", F.monotonically_increasing_id()))
    lines = _largest_lines(rows, group, ranks, count, order, rest, seed)
    receives = F.col("_extra").isNull() | (F.col("_extra") != 0)
    lines = lines.withColumn("_receiver", F.when(F.col("_keep") & receives, F.col("_top.number")))
    if to_filter:
        lines = lines.where("_keep")
    carried = ["_keep", "_receiver", "_extra"]
    joined = null_safe_join(rows, lines, key, "inner" if to_filter else "left", carried)
    gained = F.when(F.col("_number") == F.col("_receiver"), count + F.col("_extra")).otherwise(count)
    added = [] if to_filter else [(~F.coalesce("_keep", F.lit(False))).alias("is_ambiguous")]
    return joined.select(*columns, *added, gained.alias("new_count"))


def resolve_ambiguous(
    df: DataFrame,
    group_cols: str | Sequence[str],
    hierarchy_cols: Sequence[str],
    count_col: str = "count",
    method: str = RPKC,
    to_filter: bool = True,
    order_cols: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """Resolve ambiguous taxa within groups.

    ``hierarchy_cols`` go from the lowest rank up. With ``to_filter`` the
    ambiguous rows are gone, otherwise they are marked in ``is_ambiguous``. The
    redistributing methods add ``new_count``; ambiguous rows keep their own
    count there. ``order_cols`` and ``seed`` settle which of several equally
    large rows receives a count under APTC-S.
    """
    if method not in METHODS:
        raise ValueError(f"method has to be one of {', '.join(METHODS)}, not {method!r}")
    group = [group_cols] if isinstance(group_cols, str) else list(group_cols)
    ranks = list(hierarchy_cols)
    if not group or not ranks:
        raise ValueError("group_cols and hierarchy_cols need at least one column each")
    needed = [*group, *ranks, *order_cols, *([] if method == RPKC else [count_col])]
    absent = [c for c in needed if c not in df.columns]
    if absent:
        raise ValueError(f"no such column: {', '.join(absent)}")
    taken = {"new_count", "is_ambiguous"} & set(df.columns)
    if taken:
        raise ValueError(f"the input already has {', '.join(sorted(taken))}")

    if method == RPKC:
        result = _resolve_rpkc(df, group, ranks, to_filter)
        return result.select(*group, *[c for c in result.columns if c not in group])
    count = F.col(count_col).cast("double")
    if method == DPAC:
        result = _resolve_dpac(df, group, ranks, count, to_filter)
    else:
        result = _resolve_aptc(df, group, ranks, count, to_filter, list(order_cols), seed)
    added = [c for c in ("is_ambiguous", "new_count") if c in result.columns]
    return result.select(*group, *[c for c in df.columns if c not in group], *added)
