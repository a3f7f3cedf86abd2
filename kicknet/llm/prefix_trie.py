"""Conversation prefix trie: which conversations begin with the same turns.

A node of depth d is a distinct sequence of the first d turns (role and text); the root
has none. The trie is found by peeling, from the greatest depth up. At each depth

1. the conversations that end there are merged with the nodes that survive from
   below: one group, one node;
2. the last turn of every node is stripped, which makes it a row of its parent's group.

So a group is complete when its depth is reached, and members, children, leaves and
saved tokens of whole subtrees are sums over the rows that are merged: nodes are
discovered and aggregated in one pass. Equal conversations are one row from the
start (combined before the shuffle), so a conversation that a third of all people have had
is no hot group, nor is a common first turn: its children come as sums of each task.

Where a node meets no other, stripping changes nothing but its length, so it is
stripped at once down to the next depth at which it is merged. That depth is known from the
number of distinct conversations that pass through each prefix, which grows there.
There is one job for each depth at which anything is merged, not for each turn of
the longest conversation; every level is written to the shared folder, and a lost executor
costs a part of one.

A prefix is known by 128 bits of a hash chained over the SHA-256 of its turns; texts are
hashed where they are read and never shuffled. Parents are joined to their
children once, at the end. Ids of the conversations that end at a node are written into
one digest: they are joined in runs of `RUN` ids before the node's runs are
read in order, as a stream.

Turns are ordered by (turn, digest of role and text), nulls first; null role or text
counts as empty; repeated rows are turns of their own. Rows with a null conversation
id belong to none and are left out. Other columns are ignored. A table without
conversations gives the root alone, with no id. A conversation is a row, of some 40 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import cut, drop

#: Ids of one span of this many numbers are joined to one string first.
RUN = 4096
_PATH = "array<struct<id:binary,bytes:bigint>>"
_LINKS = "array<struct<key:binary,total:bigint>>"
_CHAIN = "array<struct<key:binary,total:bigint,through:bigint>>"


def turn_paths(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id and `path`, its turns in order: 16 bytes that identify each, and its length."""
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    by = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256)
    one = F.struct(
        F.col(f"`{turn}`").alias("turn"),
        digest.alias("digest"),
        F.octet_length(said).cast("bigint").alias("bytes"),
    )
    listed = (
        turns.where(F.col(f"`{conv}`").isNotNull())
        .groupBy(F.col(f"`{conv}`").cast("long").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(one)).alias("turns"))
    )
    return listed.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(F.unhex(F.substring(t["digest"], 1, 32)).alias("id"), t["bytes"].alias("bytes")),
        ).alias("path"),
    )


def spliced(paths: DataFrame, donor: Column, taken: Column, most: int) -> DataFrame:
    """Conversations whose first turns are another conversation's.

    The first `taken` (at most `most`) turns of conversation `donor`, all if it has
    fewer and none if there is no such conversation, then the own turns after the first
    `taken`. Both are expressions over conv_id.
    """
    heads = paths.select(F.col("conv_id").alias("_donor"), F.slice("path", 1, most).alias("_head"))
    return (
        paths.withColumn("_from", donor)
        .withColumn("_taken", taken.cast("int"))
        .join(heads, F.col("_from") == F.col("_donor"), "left")
        .select(
            "conv_id",
            F.concat(
                F.coalesce(
                    F.expr("slice(_head, 1, _taken)"), F.expr(f"cast(array() as {_PATH})")
                ),
                F.expr("slice(path, _taken + 1, greatest(size(path) - _taken, 0))"),
            ).alias("path"),
        )
    )


def _chained(paths: DataFrame) -> DataFrame:
    """conv_id and `chain`: for each prefix, its key and the bytes of its turns."""

    def link(a: Column, t: Column) -> Column:
        key = F.unhex(F.substring(F.sha2(F.concat(a["key"], t["id"]), 256), 1, 32))
        total = a["total"] + t["bytes"]
        entry = F.struct(key.alias("key"), total.alias("total"))
        return F.struct(key.alias("key"), total.alias("total"), F.array_append(a["chain"], entry).alias("chain"))

    start = F.expr(f"named_struct('key', binary(''), 'total', 0L, 'chain', cast(array() as {_LINKS}))")
    return paths.select("conv_id", F.aggregate("path", start, link, lambda a: a["chain"]).alias("chain"))


def _counted(chained: DataFrame) -> DataFrame:
    """Chains with `through`, the number of distinct conversations with each prefix."""
    prefixes = chained.select("conv_id", F.posexplode("chain.key").alias("at", "key"))
    through = prefixes.groupBy("key").agg(F.count("*").alias("through"))
    counts = (
        prefixes.join(through, "key")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "through"))).alias("counts"))
    )
    return chained.join(counts, "conv_id", "left").select(
        "conv_id",
        "n_convs",
        F.when(F.size("chain") == 0, F.expr(f"cast(array() as {_CHAIN})"))
        .otherwise(
            F.zip_with(
                "chain",
                "counts",
                lambda c, n: F.struct(c["key"].alias("key"), c["total"].alias("total"), n["through"].alias("through")),
            )
        )
        .alias("chain"),
    )


def _total(depth: str) -> Column:
    """Bytes of the first turns of a chain."""
    return F.expr(f"if({depth} < 1, 0L, chain[greatest({depth}, 1) - 1].total)")


def _next_merge() -> Column:
    """The next depth above a row at which others join it; the root if there is none."""
    return F.expr(
        "coalesce(array_max(transform(filter(sequence(0, size(chain) - 2),"
        " i -> chain[i].through > element_at(chain, -1).through), i -> i + 1)), 0)"
    )


def _rows(df: DataFrame) -> DataFrame:
    """Nodes as rows of the groups they are merged into, stripped down to the depth `to`."""
    return df.select(
        F.expr("slice(chain, 1, to)").alias("chain"),
        "conv_id",
        "n_convs",
        F.lit(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * (_total("size(chain) - 1") - _total("to"))).alias("saved_tokens"),
    )


def _finished(nodes: DataFrame) -> DataFrame:
    """Nodes with the depth `to` that they are merged at next."""
    return nodes.select(
        "*", F.when(F.size("chain") < 2, 0).otherwise(_next_merge()).cast("int").alias("to")
    )


def _peeled(ended: DataFrame) -> list[DataFrame]:
    """Tables of nodes: lone ends, then one for each depth of a merge, up to the root."""
    zero = F.lit(0).cast("long")
    own = (F.col("n_convs") - 1) * (_total("size(chain)") - _total("size(chain) - 1"))
    # an end that no other conversation passes is a leaf, complete at once
    ends = ended.withColumn("alone", F.expr("coalesce(try_element_at(chain, -1).through, 2) = 1"))
    leaves = ends.where("alone").select(
        "chain",
        "conv_id",
        "n_convs",
        zero.alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        own.alias("saved_tokens"),
    )
    waiting = cut(ends.where("not alone").drop("alone").withColumn("depth", F.size("chain")))
    places = F.expr(
        "filter(sequence(0, size(chain)), i -> i = 0"
        " or (i < size(chain) and chain[i - 1].through > chain[i].through)"
        " or (i = size(chain) and chain[i - 1].through > 1))"
    )
    merges = {r[0] for r in ended.select(F.explode(places)).distinct().collect()}
    levels: list[DataFrame] = []
    reached: list[set[int]] = []  # depths that the rows of a level are merged at

    def keep(nodes: DataFrame) -> None:
        levels.append(cut(_finished(nodes)))
        reached.append({r[0] for r in levels[-1].select("to").distinct().collect()})

    keep(leaves)
    for depth in sorted(merges, reverse=True):
        rows = waiting.where(F.col("depth") == depth).select(
            "chain",
            "conv_id",
            "n_convs",
            *(zero.alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
        )
        for level, to in zip(levels, reached):
            if depth in to:
                below = level.where((F.col("to") == depth) & (F.size("chain") > depth))
                rows = rows.unionByName(_rows(below))
        nodes = rows.groupBy("chain").agg(
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        )
        keep(
            nodes.withColumns(
                {"n_leaves": F.greatest("n_leaves", F.lit(1)), "saved_tokens": F.col("saved_tokens") + own}
            )
        )
    drop(waiting)
    return levels


def _spelled(nodes: DataFrame) -> DataFrame:
    """One row a node: those between two merges are written out."""
    depth = F.size("chain")
    rows = nodes.withColumn("at", F.explode(F.when(depth == 0, F.array(F.lit(0))).otherwise(F.expr("sequence(to + 1, size(chain))"))))
    last = F.col("at") == depth

    def key(at: str) -> Column:
        return F.expr(f"if({at} < 1, binary(''), chain[greatest({at}, 1) - 1].key)")

    return rows.select(
        key("at").alias("node"),
        F.when(F.col("at") > 0, key("at - 1")).alias("parent"),
        F.col("at").cast("long").alias("depth"),
        "conv_id",
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        F.when(last, F.col("saved_tokens"))
        .otherwise(F.col("saved_tokens") + (F.col("n_convs") - 1) * (_total("size(chain) - 1") - _total("at - 1")))
        .alias("saved_tokens"),
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the runs of each node, which come in order; one run at a time is held."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["ended", "ends_sha256"]
        )

    for batch in batches:
        for name, ids in zip(batch.column("node"), batch.column("ids")):
            if digest is not None and name.as_py() == node:
                digest.update(b",")
            else:
                if digest is not None:
                    yield row()
                node, digest = name.as_py(), hashlib.sha256()
            digest.update(ids.as_py().encode())
    if digest is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, conv_id) rows to one digest a node: ids in numerical order, comma-joined."""
    runs = ends.groupBy("node", F.expr(f"floor(conv_id / {RUN})").alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )
    ordered = runs.repartition("node").sortWithinPartitions("node", "run")
    return ordered.select("node", "ids").mapInArrow(_digests, "ended binary, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """All nodes of the conversations (conv_id, path): one row a node.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens of the subtree, ends_sha256.
    """
    convs = cut(_chained(paths))
    ended = cut(_counted(convs.groupBy("chain").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))))
    levels = _peeled(ended)
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    named = _spelled(nodes)
    if not ended.limit(1).count():  # the root all the same
        named = convs.sparkSession.sql(
            "select binary('') node, binary(null) parent, 0L depth, bigint(null) conv_id, 0L n_convs,"
            " 0L n_children, 1L n_leaves, 0L saved_tokens"
        )
    named = cut(named)
    drop(*levels)
    top = named.where("depth = 0").select("conv_id").first()[0]
    above = named.where("depth > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("_above"))
    end = F.expr("coalesce(try_element_at(chain, -1).key, binary(''))")
    digests = end_digests(convs.select(end.alias("node"), "conv_id"))
    # children of the root need no join: all have the same parent
    return (
        named.join(above, "parent", "left")
        .join(digests, F.col("node") == F.col("ended"), "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") == 1, F.lit(top)).otherwise(F.col("_above")).cast("long").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_trie(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The prefix trie of a table of turns."""
    return trie(turn_paths(turns, conv, turn, role, text))
