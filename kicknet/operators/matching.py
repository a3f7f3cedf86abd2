"""Row matching: whole-row anti-join, first row per key, repeated rows, sized broadcast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kicknet.functions.missing import whole

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
REPEAT_CHUNK = 100_000


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions.

    For a repartition ahead of rows being multiplied: with a stated number
    adaptive execution does not merge the still small partitions.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_evenly(df: DataFrame, columns: Sequence[str], size: int, per_task: int) -> DataFrame:
    """Rows dealt by the columns to so many tasks that each gets about ``per_task`` of ``size``.

    For what sorts many times, or multiplies, the rows of a shuffle: adaptive execution
    merges partitions by their compressed bytes, of which a task may hold a hundred times
    as many. With a stated number it leaves them as they are; what one task can do is
    left to it.
    """
    keys = [F.col(f"`{c}`") for c in columns]
    if size <= per_task:
        return df.repartition(*keys)
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-size // per_task)), *keys)


def broadcast_if_small(
    df: DataFrame,
    source: DataFrame | None = None,
    max_rows: int = BROADCAST_MAX_ROWS,
    max_bytes: int = BROADCAST_MAX_BYTES,
) -> DataFrame:
    """Mark a table for broadcast only if its measured size is within both bounds.

    ``source`` is a table the other one is made from by a costlier step: if that
    alone has too many rows, the step is not run for its size. A larger table
    comes back marked for a sort-merge join, whose hot keys adaptive execution
    splits: unmarked, Spark would broadcast it if its files are small.
    """
    if source is not None and source.count() > max_rows:
        return df.hint("merge")
    columns = ", ".join(f"cast(`{c}` as string)" for c in df.columns)
    size = f"coalesce(sum(octet_length(concat_ws('', {columns}))), 0)"
    rows, size = df.selectExpr("count(*)", size).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df.hint("merge")


def lead_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """A hash of the columns, equal for equal values, as a first grouping or window key.

    Aggregates that can not hash, such as a minimum over structs, sort their rows by the
    keys: with a number in front nearly all pairs are compared by it alone.
    """
    types = {f.name: f.dataType for f in df.schema}
    # adding 0 makes -0.0 and 0.0 the same bits
    floats = (T.DoubleType, T.FloatType)
    return F.xxhash64(
        *[F.col(f"`{c}`") + F.lit(0.0) if isinstance(types[c], floats) else F.col(f"`{c}`") for c in columns]
    )


def null_safe_join(
    left: DataFrame, right: DataFrame, columns: Sequence[str], how: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Equi-join on columns of the same names, null equal to null.

    The result has the columns of ``left`` and the ``carry`` columns of
    ``right``. A hash of the columns is the first join key: sorting then
    compares one number per row and looks at the columns only where rows agree.
    """
    types = {f.name: f.dataType for f in left.schema}
    other = {f.name: f.dataType for f in right.schema}
    # adding 0 makes -0.0 and 0.0 the same bits
    hashed = [
        f"`{c}` + 0d" if isinstance(types[c], T.DoubleType) else f"`{c}`"
        for c in columns
        if types[c] == other[c]
    ]
    key = f"xxhash64({', '.join(hashed)})" if hashed else "0L"
    keyed = left.selectExpr("*", f"{key} as _left_hash")
    match = right.selectExpr(
        f"{key} as _right_hash", *[f"`{c}` as `_right_{c}`" for c in columns], *carry
    )
    pairs = [f"`{c}` <=> `_right_{c}`" for c in columns]
    joined = keyed.join(match, F.expr(" and ".join(["_left_hash = _right_hash", *pairs])), how)
    return joined.select(*left.columns, *([] if how in ("left_semi", "left_anti") else carry))


def anti_join_all(left: DataFrame, right: DataFrame, ignoring: Sequence[str] = ()) -> DataFrame:
    """Rows of ``left`` that equal no row of ``right`` in their shared columns, null equal to null.

    Copies on the left all stay or all go. The right side is made distinct
    before it moves, so copies there cost nothing.
    """
    shared = [c for c in left.columns if c in right.columns and c not in ignoring]
    if not shared:
        raise ValueError("the two tables share no column")
    return null_safe_join(left, right.select(*shared).distinct(), shared, "left_anti")


def keep_first(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The earliest row of each key, entire.

    A minimum over a struct that starts with the order columns: it combines
    before the shuffle, so a key holding a large part of all rows sends one row
    per map task. The other columns only settle ties.
    """
    order = [c for c in order_cols if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(lead_hash(df, keys).alias("_lead"), *keys).agg(
        F.min(whole(order + rest)).alias("_first")
    )
    return first.select(
        *[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns]
    )


def repeat_spread(df: DataFrame, times: Column, number: str, chunk: int = REPEAT_CHUNK) -> DataFrame:
    """Each row ``times`` times, numbered from 1 in column ``number``; none if below 1.

    Rows are cut into spans of ``chunk`` repeats that are spread over the
    cluster, so no task writes out one huge row alone.
    """
    spans = F.expr(f"sequence(0L, (_times - 1) div {chunk})")
    numbers = F.expr(
        f"sequence(_span * {chunk} + 1, least(_times, (_span + 1) * {chunk}))"
    )
    return (
        df.withColumn("_times", times.cast("long"))
        .where("_times >= 1")
        .withColumn("_span", F.explode(spans))
        .repartition(shuffle_partitions(df))
        .withColumn(number, F.explode(numbers))
        .drop("_times", "_span")
    )


def repeat_rows(df: DataFrame, times: Column, number: str, chunk: int = REPEAT_CHUNK) -> DataFrame:
    """As ``repeat_spread``, where few rows are repeated often: only those are shuffled."""
    counted = df.withColumn("_repeats", times.cast("long"))
    few = counted.where(F.col("_repeats").between(1, chunk))
    few = few.withColumn(number, F.explode(F.expr("sequence(1L, _repeats)")))
    many = repeat_spread(
        counted.where(F.col("_repeats") > chunk), F.col("_repeats"), number, chunk
    )
    return few.unionByName(many).drop("_repeats")
