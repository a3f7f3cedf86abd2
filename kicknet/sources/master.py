"""Scan of the taxa master."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kicknet.functions.conversions import to_number
from kicknet.operators.taxa import (
    CLASS, FAMILY, FEEDING, GENUS, GROUP, ID, NAME, ORDER, PHYLUM, TOLERANCE, TRIBE,
)
from kicknet.sources.observations import _check_format, header_of

# The master's column names and the engine's, and which are numbers
SOURCE_NAMES = {
    "ID": ID,
    "BIOSNAME": NAME,
    "TOLERANCE": TOLERANCE,
    "FFG": FEEDING,
    "ORDER": ORDER,
    "FAMILY": FAMILY,
    "GENUS": GENUS,
    "GROUP": GROUP,
    "TRIBE_ETC": TRIBE,
    "CLASS": CLASS,
    "PHYLUM": PHYLUM,
}
NUMERIC = ("ID", "TOLERANCE")


def prune_master(master: DataFrame) -> DataFrame:
    """The eleven columns in use, typed and under the engine's names."""
    absent = [c for c in SOURCE_NAMES if c not in master.columns]
    if absent:
        raise ValueError(f"the taxa master has no column {', '.join(absent)}")
    return master.select(
        *[
            (to_number(F.col(source)) if source in NUMERIC else F.col(source).cast("string")).alias(
                name
            )
            for source, name in SOURCE_NAMES.items()
        ]
    )


def scan_taxa(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """The master from a csv file with a header line, or from Parquet."""
    _check_format(fmt)
    if fmt == "parquet":
        return prune_master(spark.read.parquet(path))
    # numbers too are read as text, so that one rule says what a number is
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header_of(spark, path, 1)])
    return prune_master(
        spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    )
