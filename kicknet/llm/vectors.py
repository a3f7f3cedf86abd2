"""Embedding near-dedup: all pairs of vectors with one label and a high cosine.

PCA-ordered tiled comparison. Equal vectors of a label are one class. Classes are
ordered by label and leading principal coordinate and cut into tiles; a tile is
compared with tiles of its label whose boxes in the leading coordinates come near
enough: two unit vectors with cosine t are at most sqrt(2 - 2t) apart in any of
them. Within a pair of tiles the dot product is summed over blocks of coordinates, the
leading ones first. What the rest can add is at most the product of the norms of the
suffixes (Cauchy-Schwarz); pairs that can not reach the threshold are dropped. So
every pair at or above the threshold is found, and none below it.

A pair of tiles gives one row per linked vector: its number of links, and its root in
the links of this pair, which is enough for the components; pairs of vectors are never
written. A label is cut into as many tiles as it needs, so a hot one is many tasks. The
work stays quadratic in the vectors of a label that lie within the band of the leading
coordinates; that is what an exact join by comparison costs.

Vectors that are null, empty, zero or hold null or non-finite numbers, and vectors with
a null label, link with nothing. Vectors of different lengths do not link. Rows with
a repeated or null id are vectors of their own. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import components, cut, forest

TILE = 1024
#: Ends of the blocks of coordinates; the last block has the rest.
BLOCKS = (8, 24)
#: Leading coordinates in a tile's box.
BOX = 4
#: Rounding allowed for in bounds; nearer to the threshold the cosine is taken anew.
SLACK = 1e-9
#: Share of pairs left from which a block is multiplied whole.
DENSE = 0.1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return flat


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _moments(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((dim, dim))
    for batch in batches:
        if batch.num_rows:
            x = unit(_matrix(batch.column(0), dim))
            total += x.T @ x
    i = np.arange(dim * dim)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total.ravel())], ["i", "v"])


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes of the unit vectors as columns, the one with the most spread first.

    Only dim x dim sums come to the driver.
    """
    sums = (
        vectors.where(F.size("v") == dim)
        .select("v")
        .mapInArrow(lambda it: _moments(it, dim), "i long, v double")
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    moments = np.zeros(dim * dim)
    for r in sums:
        moments[r["i"]] = r["v"]
    _, axes = np.linalg.eigh(moments.reshape(dim, dim))
    return axes[:, ::-1]


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    lists = batch.column(batch.schema.get_field_index(column))
    dims = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(dims):
        yield int(dim), batch.take(pa.array(np.flatnonzero(dims == dim)))


def _axes_for(axes: np.ndarray, dim: int) -> np.ndarray:
    return axes if len(axes) == dim else np.eye(dim)


def _leading(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, rows in _by_dim(batch, "v") if batch.num_rows else ():
            y = unit(_matrix(rows.column(rows.schema.get_field_index("v")), dim))
            lead = y @ _axes_for(axes, dim)[:, 0]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(lead)], [*rows.schema.names, "lead"]
            )


TILE_SCHEMA = (
    "tile long, label long, dim int, low array<double>, high array<double>, "
    "cids array<long>, sizes array<long>, data binary"
)


def _tiles(batches: Iterator[pa.RecordBatch], axes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Tiles of consecutive rows with one label and length; rows come sorted."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    key: tuple[int, int] | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        cids, sizes, x = (np.concatenate(a) for a in zip(*held))
        label, dim = key
        for at in range(0, len(cids), TILE):
            part = unit(x[at : at + TILE])
            y = part @ _axes_for(axes, dim)[:, :BOX]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "tile": int(cids[at]),
                        "label": label,
                        "dim": dim,
                        "low": y.min(0).tolist(),
                        "high": y.max(0).tolist(),
                        "cids": cids[at : at + TILE].tolist(),
                        "sizes": sizes[at : at + TILE].tolist(),
                        "data": part.tobytes(),
                    }
                ],
                schema=pa.schema(
                    [
                        ("tile", pa.int64()),
                        ("label", pa.int64()),
                        ("dim", pa.int32()),
                        ("low", pa.list_(pa.float64())),
                        ("high", pa.list_(pa.float64())),
                        ("cids", pa.list_(pa.int64())),
                        ("sizes", pa.list_(pa.int64())),
                        ("data", pa.binary()),
                    ]
                ),
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        lists = batch.column(3)
        dims = np.diff(lists.offsets.to_numpy())
        new = np.flatnonzero((labels[1:] != labels[:-1]) | (dims[1:] != dims[:-1])) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            now = int(labels[a]), int(dims[a])
            if held and (now != key or sum(len(h[0]) for h in held) >= 8 * TILE):
                yield from flush()
                held = []
            key = now
            part = batch.slice(a, b - a)
            held.append(
                (
                    part.column(1).to_numpy(),
                    part.column(2).to_numpy(),
                    _matrix(part.column(3), now[1]),
                )
            )
    if held:
        yield from flush()


def linked(
    x: np.ndarray, y: np.ndarray, axes: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of x and j of y (unit vectors) whose cosine is at least `least`."""
    a, b = x @ axes, y @ axes
    ends = [e for e in BLOCKS if e < a.shape[1]] + [a.shape[1]]
    rest_a = [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", a[:, e:], a[:, e:]))) for e in ends]
    rest_b = [np.sqrt(np.maximum(0, np.einsum("ij,ij->i", b[:, e:], b[:, e:]))) for e in ends]
    found_i, found_j = [], []
    for at in range(0, len(a), 256):
        part = slice(at, at + 256)
        sums = a[part, : ends[0]] @ b[:, : ends[0]].T
        k = 0
        may = sums + np.multiply.outer(rest_a[0][part], rest_b[0]) >= least - SLACK
        while k + 1 < len(ends) and may.mean() > DENSE:
            sums += a[part, ends[k] : ends[k + 1]] @ b[:, ends[k] : ends[k + 1]].T
            k += 1
            may = sums + np.multiply.outer(rest_a[k][part], rest_b[k]) >= least - SLACK
        i, j = np.nonzero(may)
        s = sums[i, j]
        i += at
        while k + 1 < len(ends) and len(i):
            block = slice(ends[k], ends[k + 1])
            s = s + np.einsum("ij,ij->i", a[i, block], b[j, block])
            k += 1
            keep = s + rest_a[k][i] * rest_b[k][j] >= least - SLACK
            i, j, s = i[keep], j[keep], s[keep]
        near = np.abs(s - least) <= SLACK
        s[near] = np.einsum("ij,ij->i", x[i[near]], y[j[near]])
        found_i.append(i[s >= least])
        found_j.append(j[s >= least])
    return np.concatenate(found_i), np.concatenate(found_j)


def _compare(
    batches: Iterator[pa.RecordBatch], axes: np.ndarray, least: float
) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            a = np.frombuffer(r["data_a"]).reshape(-1, r["dim"])
            b = np.frombuffer(r["data_b"]).reshape(-1, r["dim"])
            same = r["a"] == r["b"]
            i, j = linked(a, b, _axes_for(axes, r["dim"]), least)
            if same:
                i, j = i[i < j], j[i < j]
                ids, sizes = np.array(r["cids_a"]), np.array(r["sizes_a"])
            else:
                ids = np.array(r["cids_a"] + r["cids_b"])
                sizes = np.array(r["sizes_a"] + r["sizes_b"])
                j = j + len(a)
            if not len(i):
                continue
            links = np.zeros(len(ids), dtype=np.int64)
            np.add.at(links, i, sizes[j])
            np.add.at(links, j, sizes[i])
            root = forest(len(ids), i, j)
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[on]), pa.array(ids[root[on]]), pa.array(links[on])],
                ["cid", "root", "links"],
            )


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.93,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; links have a cosine >= `least`."""
    v = F.col(vector_col).cast("array<double>")
    usable = (
        F.col(label_col).isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).cast("long").alias("label"),
        F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))).alias("v"),
    ).withColumn("cid", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    classes = (
        rows.where("cid is not null")
        .groupBy("label", "cid")
        .agg(F.count("*").alias("size"), F.first("v").alias("v"))
    )
    common = rows.where("cid is not null").groupBy(F.size("v").alias("n")).count()
    common = common.orderBy(F.desc("count"), "n").limit(1).collect()
    dim = common[0]["n"] if common else 1
    axes = principal_axes(rows.where("cid is not null"), dim)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)) + SLACK)
    tiles = cut(
        classes.select("label", "cid", "size", "v")
        .mapInArrow(lambda it: _leading(it, axes), "label long, cid long, size long, v array<double>, lead double")
        .repartitionByRange("label", F.size("v"), "lead", "cid")
        .sortWithinPartitions("label", F.size("v"), "lead", "cid")
        .mapInArrow(lambda it: _tiles(it, axes), TILE_SCHEMA)
    )
    boxes = tiles.select("tile", "label", "dim", "low", "high")

    def band(df: DataFrame, by: int) -> DataFrame:
        floor = lambda c, d: F.floor(c / reach).cast("long") + d
        return df.withColumn(
            "band", F.explode(F.sequence(floor(F.col("low")[0], -by), floor(F.col("high")[0], by)))
        )

    left = band(boxes, 0).select(F.col("tile").alias("a"), "label", "dim", "band", F.struct("low", "high").alias("p"))
    right = band(boxes, 1).select(F.col("tile").alias("b"), "label", "dim", "band", F.struct("low", "high").alias("q"))
    gap = F.aggregate(
        F.zip_with(
            F.arrays_zip("p.low", "p.high"),
            F.arrays_zip("q.low", "q.high"),
            lambda s, t: F.greatest(s["low"] - t["high"], t["low"] - s["high"], F.lit(0.0)),
        ),
        F.lit(0.0),
        lambda acc, g: acc + g * g,
    )
    pairs = (
        left.join(right, ["label", "dim", "band"])
        .where((F.col("a") <= F.col("b")) & (gap <= reach * reach))
        .select("a", "b", "dim")
        .distinct()
    )
    met = pairs
    for side in "ab":
        met = met.join(
            tiles.select(
                F.col("tile").alias(side),
                F.col("cids").alias(f"cids_{side}"),
                F.col("sizes").alias(f"sizes_{side}"),
                F.col("data").alias(f"data_{side}"),
            ),
            side,
        )
    links = cut(
        met.mapInArrow(lambda it: _compare(it, axes, least), "cid long, root long, links long")
    )
    degree = links.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(links, "cid", "root").withColumnRenamed("root", "top")
    placed = (
        rows.drop("v", "label")
        .join(classes.select("cid", "size"), "cid", "left")
        .join(degree, "cid", "left")
        .join(roots, F.col("cid") == F.col("node"), "left")
        .withColumn("top", F.coalesce("top", "cid"))
    )
    least_id = placed.where("top is not null").groupBy("top").agg(F.min("vec_id").alias("first"))
    return placed.join(least_id, "top", "left").select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("size") - 1, F.lit(0))).alias("n_links"),
        F.coalesce("first", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("first", "vec_id"), F.lit(True)).alias("kept"),
    )
