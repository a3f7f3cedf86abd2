"""Where a job may put intermediate files, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP_BYTES = 4 << 20
#: Rows, and compressed bytes of them, that a shuffle is to bring to one task of a `bounded` step.
TASK_ROWS, TASK_BYTES = 100_000, 8 << 20
PARTITIONS = "spark.sql.shuffle.partitions"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    A session without one gets a temporary folder if it runs on this machine alone, as
    in tests, and is refused otherwise: executors would not share the folder. What is
    put there goes when the session ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="kicknet-")
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, files = _filesystem(spark, folder)
    files.deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows, written once to a work folder and read from there.

    For a table that several branches of a plan read and that is dear to derive: Spark
    would derive it again for each of them. It also ends the lineage.
    """
    spark, schema = df.sparkSession, df.schema
    folder = work_folder(spark, name)
    # small row groups: what a single task wrote is read by several
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    return spark.read.schema(schema).parquet(folder)


@contextmanager
def task_sizes(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """What runs in this block shuffles a table of so many rows to tasks of bounded size.

    Adaptive execution merges partitions up to 64 MB by default, of which a task that
    sorts and aggregates may hold over ten times as much. Smaller settings are left.
    """
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {name: spark.conf.get(name, None) for name in (PARTITIONS, ADVISORY)}
    spark.conf.set(PARTITIONS, max(int(spark.conf.get(PARTITIONS)), -(-rows // TASK_ROWS)))
    spark.conf.set(ADVISORY, min(bytes_of(spark.conf.get(ADVISORY)), TASK_BYTES))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def bounded(rows: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a step makes of the rows, in tasks whose size does not follow the table's.

    The rows are written first, so their number is known and the branches of the step read
    them instead of deriving them again; the result is written, as the sizes hold until then.
    """
    spark = rows.sparkSession
    with task_sizes(spark):
        kept = written(rows, "standardised")
    with task_sizes(spark, kept.count()):
        return written(step(kept), name)


#: Tables kept by `once`, by application, name and state of the files they are made from.
_kept: dict[tuple, str] = {}


def once(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made the first time a session asks for it and then read from a work folder.

    It is made again if one of the files or folders in `sources` has changed.
    """
    stamps = []
    for source in sources:
        path, files = _filesystem(spark, source)
        status = files.getFileStatus(path)
        stamps.append((source, status.getModificationTime(), status.getLen()))
    key = (spark.sparkContext.applicationId, name, *stamps)
    if key not in _kept:
        folder = work_folder(spark, name)
        make().write.parquet(folder)
        _kept[key] = folder
    return spark.read.parquet(_kept[key])
