"""Scans of observation exports."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet")
# columns a scan adds: they give the row order of the files
ROW_ORDER = ("_file", "_block", "_line")
# bytes read of a file to find its header, and files read at once
HEAD_BYTES, HEADS_AT_ONCE = 1 << 16, 16


def _check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format has to be one of {', '.join(FORMATS)}, not {fmt!r}")


def _head_line(spark: SparkSession, file: str, line: int) -> str | None:
    """Line ``line`` (from 1) of a file; None if it has fewer.

    Reads ``HEAD_BYTES`` of it, and more only while the line has not ended.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    path = hadoop.fs.Path(spark._jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        head, size = b"", HEAD_BYTES
        while True:
            more = bytes(stream.readNBytes(size))
            head, ended = head + more, len(more) < size
            lines = re.split(rb"\r\n|\n|\r", head)
            # the last piece may go on, unless the file ends with it
            if len(lines) > line or (ended and len(lines) == line and lines[-1]):
                return lines[line - 1].decode("utf-8", "replace")
            if ended:
                return None
            size = len(head)
    finally:
        stream.close()


def headers_of(spark: SparkSession, path: str, line: int) -> dict[tuple[str, ...], list[str]]:
    """The files under a path by the column names in their line ``line`` (from 1).

    Only the first bytes of each file are read, some files at a time, by the file system
    that Spark itself reads them with.
    """
    files = sorted(spark.read.text(path, recursiveFileLookup=True).inputFiles())
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        for file, value in zip(files, pool.map(lambda f: _head_line(spark, f, line), files)):
            if value is not None:
                found.setdefault(tuple(next(csv.reader([value]), [])), []).append(file)
    return found


def header_of(spark: SparkSession, path: str, line: int) -> list[str]:
    """The column names in line ``line`` (from 1) of the first file under a path."""
    files = sorted(spark.read.text(path, recursiveFileLookup=True).inputFiles())
    if not files:
        raise ValueError(f"no file under {path}")
    value = _head_line(spark, files[0], line)
    if value is None:
        raise ValueError(f"{files[0]} has no header in line {line}")
    return next(csv.reader([value]))


def scan_observations(
    spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """Observations of one export or a folder of exports, with columns that order the rows.

    A csv export has a preamble in its first line and the column names in its
    second; all its columns are text. Files stay splittable: the preamble is
    skipped as the reader's header line, and the line with the names is filtered
    out. Files are bound by their own header: those with the same columns in another
    order are read by name, those with other columns are refused. Only cells with line
    breaks need ``multi_line``, which reads each file in one task.
    """
    _check_format(fmt)
    if fmt == "parquet":
        return spark.read.parquet(path).select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.lit(0).cast("long").alias("_block"),
            F.col("_metadata.row_index").alias("_line"),
        )
    headers = headers_of(spark, path, 2)
    if not headers:
        raise ValueError(f"no file with a header in line 2 under {path}")
    first = min(headers, key=lambda names: min(headers[names]))
    for names, files in headers.items():
        if sorted(names) != sorted(first):
            raise ValueError(
                f"{files[0]} has the columns {', '.join(names)}, {headers[first][0]} has {', '.join(first)}"
            )
    if len(headers) == 1:
        return _scan_csv(spark, [path], list(first), multi_line)
    if len(set(first)) < len(first):
        raise ValueError("repeated column names, in another order in other files")
    parts = [_scan_csv(spark, files, list(names), multi_line) for names, files in headers.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).select(*[f"`{c}`" for c in first], *ROW_ORDER)


def _scan_csv(spark: SparkSession, paths: list[str], names: list[str], multi_line: bool) -> DataFrame:
    """Files with the same header, whose line is left out."""
    # positions as names, so that repeated or odd column names do no harm in the reader
    places = [f"c{i}" for i in range(len(names))]
    lines = (
        spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in places]))
        .option("header", True)
        .option("enforceSchema", True)
        .option("recursiveFileLookup", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(paths)
    )
    is_header = reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(n or None)) for c, n in zip(places, names)]
    )
    # a block is read by one task from top to bottom, so the id orders its lines
    ordered = lines.select(
        *places,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return ordered.where(~is_header).toDF(*names, *ROW_ORDER)


def preview_columns(df: DataFrame) -> list[str]:
    """The columns a role can be bound to."""
    return [c for c in df.columns if c not in ROW_ORDER]
