"""Which observations count: roles, types and filters before a sample is scored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kicknet.functions.conversions import to_number, typed_clock, typed_date
from kicknet.operators.taxa import ID, MASTER_COLUMNS, SEMI_AQUATIC

# Column names and text of the current export
CHARACTERISTIC = "characteristic_name"
COMMENT = "result_comment"
COUNTED = "Count"


@dataclass(frozen=True)
class ColumnRoles:
    """Names of the seven columns the calculator needs, as they are called in the file."""

    mlid: str
    start_date: str
    start_time: str
    equip_id: str
    bio_id: str
    taxon_name: str
    result_val: str

    @property
    def sample_key(self) -> list[str]:
        return [self.mlid, self.start_date, self.start_time]

    def names(self) -> list[str]:
        return [getattr(self, f.name) for f in fields(self)]

    def check(self, columns: Sequence[str]) -> ColumnRoles:
        """Refuse roles that are unbound, bound twice, absent or clash with the master's columns."""
        unbound = [f.name for f in fields(self) if not getattr(self, f.name)]
        if unbound:
            raise ValueError(f"no column chosen for {', '.join(unbound)}")
        names = self.names()
        if len(set(names)) < len(names):
            raise ValueError("two roles have the same column")
        absent = [n for n in names if n not in columns]
        if absent:
            raise ValueError(f"no such column: {', '.join(absent)}; there are {', '.join(columns)}")
        clash = {n.lower() for n in names if n != self.bio_id} & set(MASTER_COLUMNS)
        if clash:
            raise ValueError(f"column names of the taxa master: {', '.join(sorted(clash))}")
        return self


def countable(obs: DataFrame) -> DataFrame:
    """Counts without a comment."""
    return obs.where(F.col(CHARACTERISTIC).contains(COUNTED) & F.col(COMMENT).isNull())


def bind_roles(obs: DataFrame, roles: ColumnRoles, order_cols: Sequence[str] = ()) -> DataFrame:
    """The seven columns, the taxon id renamed to ``id``, and the columns that order the rows."""
    roles.check(obs.columns)
    return obs.select(
        *[
            F.col(f"`{n}`").alias(ID) if n == roles.bio_id else F.col(f"`{n}`")
            for n in roles.names()
        ],
        *[F.col(c) for c in order_cols],
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to double, null where the text is no number."""
    dtype = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: to_number(F.col(f"`{c}`"), dtype[c]) for c in columns})


def type_times(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Start date to a date and start time to ``HH:MM``."""
    dtype = {f.name: f.dataType for f in df.schema}
    return df.withColumns(
        {
            roles.start_date: typed_date(F.col(f"`{roles.start_date}`"), dtype[roles.start_date]),
            roles.start_time: typed_clock(F.col(f"`{roles.start_time}`"), dtype[roles.start_time]),
        }
    )


def taken_with(df: DataFrame, roles: ColumnRoles, gears: Sequence[str]) -> DataFrame:
    """Rows with a complete sample key, taken with one of the accepted gears."""
    complete = F.lit(True)
    for name in roles.sample_key:
        complete = complete & F.col(f"`{name}`").isNotNull()
    return df.where(complete & F.col(f"`{roles.equip_id}`").isin(*gears))


def not_semi_aquatic(obs: DataFrame, tolerance_col: str) -> DataFrame:
    """Rows whose own tolerance is a number and not the semi-aquatic mark."""
    value = to_number(F.col(f"`{tolerance_col}`"), obs.schema[tolerance_col].dataType)
    return obs.where(value != F.lit(SEMI_AQUATIC))


def numeric_counts(df: DataFrame, count_col: str, mixed: str = "refuse") -> DataFrame:
    """Counts above -1, of a column that as a whole is numeric.

    A text column, as from a csv file, is numeric if every value that is not missing
    is a plain number; a subquery of the plan finds out, so nothing runs before the
    result is asked for. One with other text is refused then, or gives no rows at
    all with ``mixed="empty"``, as a spreadsheet column of type text does.
    """
    if mixed not in ("refuse", "empty"):
        raise ValueError(f"mixed has to be refuse or empty, not {mixed!r}")
    column, dtype = F.col(f"`{count_col}`"), df.schema[count_col].dataType
    if not isinstance(dtype, T.NumericType):
        number = to_number(column)
        known = (F.trim(column.cast("string")) != "") & number.isNull()
        odd = df.agg(F.max(F.when(known, column.cast("string")))).scalar()
        numeric = odd.isNull()
        if mixed == "refuse":
            said = F.concat(F.lit(f"{count_col} is not numeric: it holds '"), odd, F.lit("'"))
            numeric = F.when(numeric, True).otherwise(F.raise_error(said).cast("boolean"))
        df = df.where(numeric).withColumn(count_col, number)
    return df.where(F.col(f"`{count_col}`") > -1)
