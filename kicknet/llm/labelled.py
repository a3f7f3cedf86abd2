"""Labelled texts for training: which rows may be learned from, and a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import cut, drop


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int
) -> tuple[list[bytes], list[int]]:
    """Texts (UTF-8) and labels of at most `most` rows for each label.

    Of the labelled rows that are not held out, those with the smallest hash of their
    text. Texts that several rows share are taken once; a text with both labels is
    left out.
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y"))
    hashed = (
        docs.where("text is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .select("doc_id", F.xxhash64("text").alias("h"))
    )
    rows = (
        hashed.join(known, "doc_id")  # narrow: no text is shuffled
        .groupBy("h")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"), F.min("doc_id").alias("doc_id"))
        .where("y = top")
    )
    picked = rows.where("y = 0").orderBy("h").limit(most).union(rows.where("y = 1").orderBy("h").limit(most))
    chosen = cut(picked.select("doc_id", "y", "h"))
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # 2 * most rows at the most
        .where(F.xxhash64("text") == F.col("h"))
        .select("h", "y", "text")
        .distinct()
        .collect()
    )
    drop(chosen)
    found.sort(key=lambda r: (r["h"], r["text"]))
    return [r["text"].encode() for r in found], [r["y"] for r in found]
