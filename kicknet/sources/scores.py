"""Sink of the score table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from kicknet.sources.observations import _check_format

# Fixed value: start of the name the score table is written under
BASENAME = "mIBI_scores"


def write_scores(
    scores: DataFrame, folder: str, fmt: str = "parquet", day: date | None = None, dated: bool = True
) -> str:
    """Write the score table to a new folder named after the day, and return its path."""
    _check_format(fmt)
    name = f"{BASENAME}-{(day or date.today()).isoformat()}" if dated else BASENAME
    path = f"{folder.rstrip('/')}/{name}.{fmt}"
    writer = scores.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path
