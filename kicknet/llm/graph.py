"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Removes an execution's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a task that writes a table whose size is known.
FILE_ROWS = 20_000


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir, which all executors share."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master + "[").startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """The rows, written once as a table in the shared folder and read from there.

    `most`: narrow rows that the last stage reads or writes, no more than these; few are
    written by few tasks, not to a file for each shuffle partition.

    This ends the lineage: a lost executor costs no more than its running tasks. The
    shuffle files behind the rows are removed at once, the tables when the session
    ends, or by `drop`.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    if most is not None:
        df = df.coalesce(1 + most // FILE_ROWS)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    kept = spark.read.schema(schema).parquet(path)
    kept._table_path = path
    return kept


def _filesystem(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()
    )


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Has the folder removed when the session's JVM ends."""
    _filesystem(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder that nothing reads any more."""
    _filesystem(spark, path).delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)


def drop(*tables: DataFrame) -> None:
    """Removes tables made by `cut` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._table_path)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """Every node that has an edge with the smallest node it is joined to: (node, root).

    Rounds of two steps on edges (node, smaller node), after Kiveris and others,
    "Connected components in MapReduce and beyond" (2014). Large step: all larger
    neighbours of a node are joined to the smallest of its neighbours and itself.
    Small step: the same for its smaller neighbours. Minima are combined before the
    shuffle and joined back, so a node with many edges is not one task. The rounds
    end when a round changes nothing; they are logarithmic in the longest path in
    practice, and each is cut off by a checkpoint. No round adds edges. `most`: the number
    of edges, if known.
    """
    now = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        most,
    )
    before = None
    while True:
        stats = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(stats) == before or not stats[0]:
            break
        before = tuple(stats)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), stats[0])
        drop(now)
        now = after
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest node joined to each of n nodes by the links (i, j), in memory."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root
