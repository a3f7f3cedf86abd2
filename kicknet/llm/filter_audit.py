"""Filter interaction audit: what each text filter removes, in every order of the filters.

Five filters look at a text; a document fails

    A  under 200 words
    B  fewer than half of the words distinct
    C  over 3 % capitals A-Z
    D  any of # $ % & * |
    E  the same text as a document with a smaller id

Words are maximal `[^\\x20\\x09-\\x0D]+`, case-sensitive. A document's failures are one mask
of five bits, and everything asked for is additive in the number of documents with a
mask. So documents are looked at once, and the 120 orders of the filters are worked out
on at most 32 counts a part.

Duplicates (E) go by full text, but few texts are shuffled:

1. *Sketch.* Each text raises two counters of a counting Bloom filter. Tasks count their
   own texts, the shuffle merges the counters, and one bit a counter is kept: it stands
   at one exactly. The counters of a text lie in one chunk of 65,536.
2. *Prepass.* A text with such a counter occurs once in the table; it is cleared. The
   sketch has 16 counters a text and 2^28 at most, so the broadcast is 32 MB or less.
   Beyond some 100 million texts it clears fewer of them and the next step moves more;
   `most_bits` raises the bound where executors have the memory.
3. *Exact.* The texts left are grouped in full for their smallest id; copies within a
   task are one row before the shuffle. A document that holds the smallest id of its text
   is the first, all others of that text fail.

Null texts are empty. A null id is not smaller than any other, and such a document never
fails E; it has no labels. Documents with the same id and the same text do not fail E by
each other. A null part is the empty string. A document that several label rows name has
a label if one of them sets it. Other columns are ignored. A table without rows gives none.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import cut

FILTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
#: Counters in a chunk of the sketch, and the most in all.
CHUNK_BITS, MOST_BITS = 16, 28
COUNTERS_A_TEXT = 16


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails; A is the lowest bit."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [
        n < 200,
        distinct * 100 < n * 50,
        capitals * 100 > F.length(text) * 3,
        text.rlike("[#$%&*|]"),
    ]
    mask = F.lit(0)
    for bit, fails in enumerate(failed):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    return mask


def _places(h: Column, bits: int) -> tuple[Column, list[Column]]:
    """Chunk of a hash and its two counters in that chunk."""
    chunk = F.shiftrightunsigned(h, 64 - (bits - CHUNK_BITS)) if bits > CHUNK_BITS else F.lit(0).cast("long")
    low = (1 << CHUNK_BITS) - 1
    return chunk, [h.bitwiseAND(low), F.shiftrightunsigned(h, CHUNK_BITS).bitwiseAND(low)]


def sketch_bits(n: int, most: int = MOST_BITS) -> int:
    """Number of address bits of a sketch for n texts."""
    return min(max(CHUNK_BITS, (COUNTERS_A_TEXT * max(1, n) - 1).bit_length()), most)


def lone_counters(hashes: DataFrame, bits: int) -> DataFrame:
    """The merged sketch of a column h of hashes: (chunk, lone).

    `lone` has one bit a counter, 64 to a number: set where the counter is one.
    """
    chunk, (first, second) = _places(F.col("h"), bits)
    # a text whose two counters are the same raises it once, so one still means one text
    raised = hashes.select(chunk.alias("chunk"), F.explode(F.array_distinct(F.array(first, second))).alias("at"))
    ones = raised.groupBy("chunk", "at").agg(F.count("*").alias("n")).where("n = 1")
    words = ones.groupBy("chunk", F.shiftright("at", 6).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set")
    )
    held = words.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("sets"))
    full = F.transform(
        F.sequence(F.lit(0), F.lit((1 << CHUNK_BITS) // 64 - 1)),
        lambda i: F.coalesce(F.try_element_at("sets", i), F.lit(0).cast("long")),
    )
    return held.select("chunk", full.alias("lone"))


def with_possible_repeats(docs: DataFrame, sketch: DataFrame, bits: int) -> DataFrame:
    """Rows with `repeats`: false if the sketch says that the text with hash h occurs once."""
    chunk, places = _places(F.col("h"), bits)
    joined = docs.withColumn("chunk", chunk).join(F.broadcast(sketch), "chunk", "left")

    def lone(at: Column) -> Column:
        word = F.get("lone", F.shiftright(at, 6).cast("int"))
        return F.getbit(word, at.bitwiseAND(63).cast("int")) == 1

    once = F.coalesce(lone(places[0]) | lone(places[1]), F.lit(False))
    return joined.withColumn("repeats", ~once).drop("chunk", "lone")


def failures(
    docs: DataFrame,
    part_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """doc_id, part and `mask` of the failed filters, one row per input row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
        F.xxhash64(text).alias("h"),
    )
    bits = sketch_bits(docs.count(), most_bits)
    sketch = cut(lone_counters(rows.select("h"), bits))
    seen = with_possible_repeats(rows, sketch, bits)
    firsts = (
        seen.where("repeats and doc_id is not null")
        .groupBy("text")
        .agg(F.min("doc_id").alias("first_id"))
        .select("first_id", F.xxhash64("text").alias("first_h"))
    )
    masked = seen.select("doc_id", "part", "h", "repeats", text_failures(F.col("text")).alias("mask"))
    later = F.col("repeats") & F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    return masked.join(
        firsts, (F.col("doc_id") == F.col("first_id")) & (F.col("h") == F.col("first_h")), "left"
    ).select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones of each (part, mask)."""
    known = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("label_id"), F.lit(0).alias("salt"))
        .agg(
            F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"),
            F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"),
        )
    )
    # rows without an id match nothing; the salt spreads them over the tasks of the join
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096)) + 1)
    joined = failed.select(
        "part",
        "mask",
        F.coalesce("doc_id", F.lit(0)).alias("label_id"),
        F.coalesce(salt.cast("int"), F.lit(0)).alias("salt"),
    ).join(known, ["label_id", "salt"], "left")
    return joined.groupBy("part", "mask").agg(
        F.count("*").alias("docs"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def order_table(counts: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant and lost."""
    orders = ["".join(o) for o in permutations(FILTERS)]
    rows = (
        counts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " ")))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
        .withColumn("own", F.expr("substring(filter_order, step, 1)"))
        .withColumn("before", F.expr("substring(filter_order, 1, step - 1)"))
        # the letters of the failed filters
        .withColumn(
            "failed",
            F.concat(*[F.when(F.getbit("mask", F.lit(i)) == 1, f).otherwise("") for i, f in enumerate(FILTERS)]),
        )
    )
    fails = F.instr("failed", F.col("own")) > 0
    gone = F.expr("length(translate(before, failed, '')) < length(before)")
    out = fails & ~gone

    def total(flag: Column, value: str) -> Column:
        return F.sum(F.when(flag, F.col(value)).otherwise(0))

    # a document that fails k filters is removed by each of them in 120 / k orders
    share = F.col("docs") * F.expr(f"cast({len(orders)} / greatest(length(failed), 1) as bigint)")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, "docs").alias("kept"),
        total(out, "docs").alias("removed"),
        total(fails & gone, "docs").alias("redundant"),
        total(F.col("failed") == F.col("own"), "docs").alias("unique_fails"),
        total(out, "good").alias("good_lost"),
        total(out, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The whole audit of a table of documents; see `failures` for the options."""
    return order_table(mask_counts(failures(docs, **options), labels))
