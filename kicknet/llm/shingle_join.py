"""N-gram Jaccard join: which texts have nearly the same set of word shingles.

A size-aware heavy-light join. With sizes n and m, a similarity of p percent leaves
at most D = (n + m) * (100 - p) / (100 + p) shingles that only one set has.

- *Light* pairs (larger set up to a boundary): each set writes every subset of the
  fixed size that a partner of size m has to share with it; equal subsets meet.
- *Heavy* pairs scan inverted lists. A list of a single shingle may hold a third of all
  texts (a common line), so lists are kept of blocks of shingles: within a size
  class, shingles are dealt to D + 1 + s blocks by hash, and at least s + 1 blocks of a
  pair must be equal. A set that is on at most s long lists leaves those out, since
  any partner also shares a short one with it. A set on more long lists stays on all of
  them. So nothing is lost and common passages make no long scans. A set that meets
  others on fewer than s + 1 lists has no partner and is left out.
- The *boundary* is the one with the least estimated cost for the sizes at hand:
  subsets written against list entries, each of the latter weighed by `LIST_COST`.

Equal sets are one class first. On a list, members are compared with the smallest
member, and joined components are formed; then those still in another component than
the smallest member are compared with the others. Each comparison intersects the
whole sets, but a pair is first held against the sets' sketches: shingles counted in 256
buckets. Counts that differ by more than D in sum leave more than D shingles in one set
only, so no link is lost, and the sets of nearly all pairs that are no link stay where
they are. So a group of k near copies costs a multiple of k, not k^2, and every link
either is found or lies within a component. All joins are on hashed keys, and split when
hot by adaptive execution.

Text is lower-cased (A-Z only); words are `[^\\x20\\x09-\\x0D]+`. A text with fewer words
than the width has one shingle, the words it has. Null, empty and blank texts have the
empty set and link with nothing. Shingles and sets are known by 64-bit hashes. Rows with
a null id take part; repeated rows are texts of their own. A table without rows gives
none. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import components, cut, drop, forest
from kicknet.llm.texts import LOWER, SpanHash, int64, mix, slices, values, word_spans

#: Largest boundary tried, the widest light set.
MOST_LIGHT = 24
#: Cost of one entry of an inverted list in subsets written.
LIST_COST = 4.0
#: Ratio of neighbouring size classes of heavy sets.
CLASS_RATIO = 1.4
#: From so many entries a list counts as long.
LONG_LIST = 32
#: Sets in a tile of those that share long lists.
TILE = 256
#: Parts of the size classes, and of the pairs to verify, that are worked on one after the other.
ROUNDS = 4
#: Buckets of a sketch, of a byte each.
SKETCH = 256


def shingle_sets(
    data: np.ndarray, offsets: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, rows one after the other, and n + 1 offsets."""
    rows = len(offsets) - 1
    low = LOWER[data]
    starts, ends, row = word_spans(low, offsets)
    words = SpanHash(low)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(row, np.arange(rows))
    count = np.searchsorted(row, np.arange(rows), "right") - first
    k = len(words)
    own = np.arange(k)
    left = (first + count)[row] - own if k else own
    full = np.flatnonzero((left >= width) | ((own == first[row]) & (count[row] < width)))
    size = np.minimum(width, left[full]) if k else full
    hashes = SpanHash(words, 2)(full, full + size) if k else np.zeros(0, np.uint64)
    of = row[full]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(rows + 1))


def differing(n: int, m: int, percent: int) -> int:
    """The most shingles in one set only that a pair of linked sets of these sizes has."""
    return (n + m) * (100 - percent) // (100 + percent)


def partner_sizes(n: int, percent: int) -> range:
    return range(-(-n * percent // 100), n * 100 // percent + 1)


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, (n + m - differing(n, m, percent) + 1) // 2) for m in partner_sizes(n, percent))


def class_of(n: np.ndarray, light: int) -> np.ndarray:
    """Size class: 0 for light sets, from 1 for heavy ones."""
    n = np.maximum(n, 1)
    return np.maximum(0, np.floor(np.log((n - 0.5) / (light + 0.5)) / np.log(CLASS_RATIO)) + 1).astype(int)


def class_blocks(cls: int, light: int, percent: int) -> tuple[int, int]:
    """(blocks, spare blocks) of a class."""
    top = int(np.floor((light + 0.5) * CLASS_RATIO**cls + 0.5)) + 1
    need = differing(top, top, percent) + 1
    spare = 2 + need // 6
    return need + spare, spare


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The boundary with the least cost for a histogram of set sizes."""

    def cost(light: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= light:
                total += count * subset_count(n, percent)
            if n * 100 // percent > light:
                total += count * LIST_COST * (differing(n, n, percent) + 1)
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def _light_keys(hashes: np.ndarray, percent: int, light: int) -> np.ndarray:
    n = len(hashes)
    keys = []
    for m in partner_sizes(n, percent):
        if m > light or m < 1:
            continue
        size = (n + m - differing(n, m, percent) + 1) // 2
        if size > min(n, m):
            continue
        salt = values(7 + min(n, m) * 64 + max(n, m), 1)[0]
        total = hashes.sum(dtype=np.uint64)
        drop = n - size
        out = np.array(
            [hashes[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), drop)]
            if drop
            else [0],
            dtype=np.uint64,
        )
        keys.append(mix((total - out) ^ salt))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _heavy_keys(hashes: np.ndarray, cls: int, blocks: int) -> np.ndarray:
    salt = values(100_000 + cls, blocks)
    part = (mix(hashes ^ salt[0]) % np.uint64(blocks)).astype(np.int64)
    sums = np.zeros(blocks, dtype=np.uint64)
    np.add.at(sums, part, hashes)
    return mix(sums ^ salt)


def sketch(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of shingles in each bucket, 255 at most, a line for each set."""
    sets = len(ends) - 1
    of = np.repeat(np.arange(sets), np.diff(ends))
    bucket = (mix(hashes ^ values(5, 1)[0]) % np.uint64(SKETCH)).astype(np.int64)
    counts = np.bincount(of * SKETCH + bucket, minlength=sets * SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).reshape(sets, SKETCH)


SET_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64())])
KEY_SCHEMA = pa.schema(
    [("cid", pa.int64()), ("cls", pa.int32()), ("spare", pa.int32()), ("keys", pa.list_(pa.int64()))]
)
SHINGLE_SCHEMA = pa.schema(
    [("cid", pa.int64()), ("shingles", pa.list_(pa.int64())), ("sketch", pa.binary())]
)


def _set_id(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """An id for each set of shingles."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mix(hashes ^ values(3, 1)[0]), out=sums[1:])
    return mix((sums[ends[1:]] - sums[ends[:-1]]) + np.diff(ends).astype(np.uint64))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        hashes, ends = shingle_sets(data, offsets, width)
        n = np.diff(ends)
        cid = pa.array(_set_id(hashes, ends).view(np.int64), mask=n == 0)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).cast(pa.int64()), pa.array(n), cid], schema=SET_SCHEMA
        )


def _keys(
    batches: Iterator[pa.RecordBatch], width: int, percent: int, light: int
) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in slices(batches):
        hashes, ends = shingle_sets(data, offsets, width)
        sizes, ids = np.diff(ends), _set_id(hashes, ends).view(np.int64)
        low, high = class_of(sizes, light), class_of(sizes * 100 // percent, light)
        out: list[tuple[int, int, int, np.ndarray]] = []
        for i in np.flatnonzero(sizes):
            own = hashes[ends[i] : ends[i + 1]]
            for cls in range(low[i], high[i] + 1):
                if cls:
                    blocks, spare = class_blocks(cls, light, percent)
                    keys = _heavy_keys(own, cls, blocks)
                else:
                    spare, keys = -1, _light_keys(own, percent, light)
                out.append((ids[i], cls, spare, keys.view(np.int64)))
        if out:
            cids, classes, spares, keys = zip(*out)
            at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cids, pa.int64()), pa.array(classes, pa.int32()), pa.array(spares, pa.int32()), lists],
                schema=KEY_SCHEMA,
            )


def _shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in slices(batches):
        hashes, ends = shingle_sets(data, offsets, width)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), int64(hashes))
        sketches = pa.array([counts.tobytes() for counts in sketch(hashes, ends)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [int64(_set_id(hashes, ends)), lists, sketches], schema=SHINGLE_SCHEMA
        )


def _schema(schema: pa.Schema) -> str:
    names = {
        pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.binary(): "binary"
    }
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    sized = (
        pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        .where(
            (F.size("x") * 100 >= F.size("y") * percent)
            & (F.size("y") * 100 >= F.size("x") * percent)
        )
    )
    shared = F.size(F.array_intersect("x", "y"))
    return sized.where(
        shared * 100 >= (F.size("x") + F.size("y") - shared) * percent
    ).select("a", "b")


def _near(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose sketches allow a link."""
    for batch in batches:
        a, b, n, m, x, y = batch.columns
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (x, y))
        apart = np.abs(x.astype(np.int16) - y).sum(axis=1, dtype=np.int64)
        both = n.to_numpy().astype(np.int64) + m.to_numpy()
        near = pa.array(np.flatnonzero(apart * (100 + percent) <= both * (100 - percent)))
        yield pa.RecordBatch.from_arrays([a.take(near), b.take(near)], ["a", "b"])


def _sketched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar enough as far as sizes and sketches tell."""
    for side in "ab":
        pairs = pairs.join(
            sets.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")),
            side,
        )
    alike = pairs.where(
        (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    )
    return alike.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(
        lambda it: _near(it, percent), "a long, b long"
    )


def _verified_in_rounds(pairs: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """Tables of the pairs that are similar enough.

    Sets are shuffled for those that the sketches leave: all at once if these are no more
    than the sets, which each round shuffles anew, else a part of the pairs at a time.
    """
    near = cut(_sketched(pairs, sets, percent))
    rounds = min(ROUNDS, 1 + near.count() // max(1, sets.count()))
    part = F.pmod(F.xxhash64("a", "b"), F.lit(rounds))
    found = [cut(_verified(near.where(part == k), sets, percent)) for k in range(rounds)]
    drop(near)
    return found


def _union(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def similar_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> tuple[DataFrame, DataFrame]:
    """(documents with their class, links that join classes).

    The first has doc_id, n (size of the set) and cid (class of equal sets, null if
    empty), one row per input row. The second has a and b, classes whose sets have a
    similarity of at least `percent`, enough of them to join all that are joined.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = cut(
        texts.mapInArrow(lambda it: _sets(it, width), _schema(SET_SCHEMA))
    )
    histogram = {
        r["n"]: r["count"]
        for r in members.where(F.col("n").between(1, 2 * MOST_LIGHT)).groupBy("n").count().collect()
    }
    light = choose_boundary(histogram, percent)
    keys = cut(
        texts.mapInArrow(lambda it: _keys(it, width, percent, light), _schema(KEY_SCHEMA))
        .groupBy("cid", "cls", "spare")
        .agg(F.first("keys").alias("keys"))
    )
    # keys carry their class, so classes never meet: some at a time bound the disk
    entries = {
        r["part"]: r["n"]
        for r in keys.groupBy((F.col("cls") % ROUNDS).alias("part")).agg(F.sum(F.size("keys")).alias("n")).collect()
    }
    parts = [_crowding(keys.where(F.col("cls") % ROUNDS == part), entries.get(part, 0)) for part in range(ROUNDS)]
    drop(keys)
    on = _union(parts)
    most = on.count()
    first = on.groupBy("key").agg(F.min("cid").alias("a"))
    pairs = on.join(first, "key").where("cid != a").select("a", F.col("cid").alias("b")).distinct()
    pairs = cut(pairs, most)
    used = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    rows = members.join(used, "cid").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    sets = cut(
        texts.join(rows.select("doc_id").distinct(), texts["doc_id"].eqNullSafe(rows["doc_id"]), "left_semi")
        .mapInArrow(lambda it: _shingles(it, width), _schema(SHINGLE_SCHEMA))
        .join(used, "cid", "left_semi")
        .groupBy("cid")
        .agg(F.first("shingles").alias("shingles"), F.first("sketch").alias("sketch"))
        .withColumn("n", F.size("shingles"))
    )
    links = _verified_in_rounds(pairs, sets, percent)
    roots = components(_union(links), most=_union(links).count())
    labelled = on.join(roots, on["cid"] == roots["node"], "left").select(
        "key", "cid", F.coalesce("root", "cid").alias("root")
    )
    split = labelled.groupBy("key").agg(
        F.min("cid").alias("a"), F.min("root").alias("low"), F.max("root").alias("high")
    ).where("low != high").select("key", "a")
    left = cut(labelled.join(split, "key"), most)
    lengths = left.groupBy("key").agg(F.count("*").alias("length"))
    sized = cut(left.join(lengths, "key"), most)
    drop(left)
    short = sized.where(F.col("length") < LONG_LIST)
    home = short.where("cid = a").select("key", F.col("root").alias("home")).distinct()
    astray = short.join(home, "key").where("root != home").select(
        "key", F.col("cid").alias("p"), F.col("root").alias("p_root")
    )
    more = (
        short.join(astray, "key")
        .where("root != p_root and cid != a")
        .select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b"))
        .distinct()
        .join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    )
    long = sized.where(F.col("length") >= LONG_LIST).select("key", "cid")
    asked = cut(more)
    drop(pairs)
    found = _verified_in_rounds(asked, sets, percent)
    drop(asked)
    tiled, tables = _tile_links(long, sets, percent)
    every = cut(_union([*links, *found, tiled]))
    drop(*parts, sets, *links, *found, sized, *tables)
    return members, every


def _crowding(keys: DataFrame, entries: int) -> DataFrame:
    """(key, cid) of the lists on which the sets of some classes are compared, from so many entries.

    Sets that meet others on too few lists are left out, which shortens lists, so this is
    done twice; sets on few long lists leave these out.
    """
    shared, before = keys.select("cid", "cls", "spare", F.explode("keys").alias("key")), []
    for _ in range(2):
        lists = shared.groupBy("key").agg(F.count("*").alias("length")).where("length > 1")
        met = cut(shared.select("cid", "cls", "spare", "key").join(lists, "key"), entries)
        drop(*before)
        enough = (
            met.groupBy("cid", "cls", "spare")
            .agg(F.count("*").alias("met"), F.count_if(F.col("length") >= LONG_LIST).alias("long"))
            .where("met > spare")
            .select("cid", "cls", (F.col("long") > F.col("spare")).alias("crowded"))
        )
        shared = cut(
            met.join(enough, ["cid", "cls"]).select("cid", "cls", "spare", "key", "length", "crowded"), entries
        )
        before = [shared]
        drop(met)
    on = cut(shared.where((F.col("length") < LONG_LIST) | F.col("crowded")).select("key", "cid"), entries)
    drop(shared)
    return on


def _tile_links(
    entries: DataFrame, sets: DataFrame, percent: int
) -> tuple[DataFrame, list[DataFrame]]:
    """Links among sets that share a list of `entries` (key, cid), for long lists; and tables in use.

    Sets are dealt to tiles by their first key, those with a crowded one to several, and
    tiles that share a list are compared by one matrix product. A pair of tiles returns each linked set
    with its root in the links of this pair; pairs of sets are not written.
    """
    placed = cut(
        entries.groupBy("cid").agg(F.min("key").alias("lead"), F.collect_set("key").alias("keys"))
    )
    crowds = placed.groupBy("lead").agg(F.ceil(F.count("*") / TILE).alias("parts")).where("parts > 1")
    several = max(1, -(-placed.count() // TILE))
    tiles = cut(
        placed.join(crowds, "lead", "left")
        .join(sets, "cid")
        .select(
            F.when(
                F.col("parts") > 1, F.xxhash64("lead", F.pmod(F.xxhash64("cid"), F.col("parts")))
            )
            .otherwise(F.pmod(F.xxhash64("lead"), F.lit(several)))
            .alias("tile"),
            F.struct("cid", "shingles", "keys").alias("one"),
        )
        .groupBy("tile")
        .agg(F.collect_list("one").alias("all"))
        .select(
            "tile",
            F.array_distinct(F.flatten("all.keys")).alias("keys"),
            F.col("all.cid").alias("cids"),
            F.transform("all", lambda x: F.size(x["shingles"])).alias("sizes"),
            F.flatten("all.shingles").alias("flat"),
        )
    )
    on = tiles.select("tile", F.explode("keys").alias("key"))
    met = (
        on.withColumnRenamed("tile", "a")
        .join(on.withColumnRenamed("tile", "b"), "key")
        .where("a <= b")
        .select("a", "b")
        .distinct()
    )
    for side in "ab":
        met = met.join(
            tiles.select(
                F.col("tile").alias(side),
                *(F.col(c).alias(f"{c}_{side}") for c in ("cids", "sizes", "flat")),
            ),
            side,
        )
    return met.mapInArrow(lambda it: _compare(it, percent), "a long, b long"), [placed, tiles]


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        for r in range(batch.num_rows):

            def item(name: str) -> np.ndarray:
                return columns[name][r].values.to_numpy(zero_copy_only=False)

            sides = [(item(f"sizes_{side}"), item(f"flat_{side}")) for side in "ab"]
            (na, fa), (nb, fb) = sides
            both = np.intersect1d(fa, fb)
            rows = []
            for sizes, flat in sides:
                of = np.repeat(np.arange(len(sizes)), sizes)
                at = np.searchsorted(both, flat)
                at[at == len(both)] = 0
                hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
                m = np.zeros((len(sizes), len(both)), dtype=np.float32)
                m[of[hit], at[hit]] = 1
                rows.append(m)
            shared = np.rint(rows[0] @ rows[1].T).astype(np.int64)
            i, j = np.nonzero(shared * 100 >= percent * (na[:, None] + nb[None, :] - shared))
            ids = np.concatenate([item("cids_a"), item("cids_b")])
            root = forest(len(ids), i, j + len(na))
            on = np.flatnonzero(ids != ids[root])
            if len(on):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[on]), pa.array(ids[root[on]])], ["a", "b"]
                )


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Every row's doc_id, n_shingles and component_id.

    component_id is the smallest id that is reached by links, the row's own included.
    """
    members, links = similar_classes(docs, id_col, text_col, width, percent)
    roots = components(links, most=links.count())
    placed = members.join(roots, members["cid"] == roots["node"], "left").select(
        "doc_id", "n", F.coalesce("root", "cid").alias("root")
    )
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("least", "doc_id").alias("component_id"),
    )
