"""Benchmark decontamination by spaced seeds.

Fixed masks are laid over every run of tokens; each hashes the tokens at its
selected places and ignores the others, so a replaced word need not hide a copy. Hashes
of the test items and of the documents are joined. Each hit gives an alignment of an
item with a document; along it, all stretches with enough equal tokens are taken that do
not overlap, those with the most equal tokens first.

The masks depend on how many equal tokens an item asks for (`masks_for`). Whatever tokens
are replaced, a stretch that counts is hit by one of them; the tests prove it by going
through all patterns. Masks that no item asks for are not laid over the documents.

Before the join, documents' hashes pass a bit table of fixed size made from the items'
hashes, which lets all true hits through. Larger test sets only make it let through
more. Hits are joined as rows, so neither side has to fit in memory.

A token is a run of letters and digits (A-Z lower-cased; every character outside
ASCII belongs to a token). A stretch counts if it has `least_equal` equal tokens (or, for
short items, 80 % of the item) and 75 % of its tokens are equal. So items of one to four
tokens are found as exact copies only, and items without tokens never. Null texts are
empty. Repeated rows are found
each by itself; documents with a null id are found under a null id. Extra columns do not
matter; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import cut
from kicknet.llm.texts import LOWER, SpanHash, int64, slices, values

#: Places that each mask looks at. One of them hits any stretch with 12 equal tokens, 75 % of all.
MASKS = (
    "111111", "11110011", "11001111", "10111011", "1111010001", "1110101001", "1110100101", "1101101001"
)
WEIGHT = 6
TABLE_BITS = 24
LEAST_EQUAL, LEAST_SHARE = 12, 0.75

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows and the n + 1 offsets of the rows among them."""
    low = LOWER[data]
    inside = _TOKEN[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = SpanHash(low, 21)(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def needed(n_tokens: int, least_equal: int) -> int:
    """Equal tokens that a stretch of an item of that many tokens has to have."""
    return min(least_equal, -(-4 * n_tokens // 5))


def patterns(weight: int) -> tuple[str, ...]:
    """All masks of that weight with a third as many places between that are ignored, or fewer."""
    if weight < 2:
        return ("1",) * weight
    return tuple(
        "".join("01"[i in (0, span - 1, *between)] for i in range(span))
        for span in range(weight, weight + weight // 3 + 1)
        for between in combinations(range(1, span - 1), weight - 2)
    )


@cache
def masks_for(n_tokens: int, least_equal: int) -> tuple[str, ...]:
    """Masks for an item of that many tokens."""
    need = needed(n_tokens, least_equal)
    if need >= LEAST_EQUAL:
        return MASKS
    found = patterns(min(need, WEIGHT))
    if need < needed(n_tokens, n_tokens):  # a long item, but few equal tokens are asked for
        found = (*dict.fromkeys((*found, *patterns(WEIGHT), "111")),)
    return found


_FACTORS = values(31, WEIGHT) | np.uint64(1)
_OF_MASK = values(32, 2**10)


def seeds(terms: list[np.ndarray], mask: str) -> np.ndarray:
    """The hash of one mask at each token that has a whole span after it.

    terms: the tokens' hashes times each of `_FACTORS`.
    """
    n = max(0, len(terms[0]) - len(mask) + 1)
    total = np.full(n, _OF_MASK[int(mask, 2)])
    for term, k in zip(terms, (k for k, used in enumerate(mask) if used == "1")):
        total += term[k : k + n]
    return total


def _slots(seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the table that stand for a seed."""
    return seed >> np.uint64(64 - TABLE_BITS), (seed >> np.uint64(16)) & np.uint64(2**TABLE_BITS - 1)


def _item_seeds(batches: Iterator[pa.RecordBatch], least_equal: int) -> Iterator[pa.RecordBatch]:
    """(id, at, seed, mask) of items (id, text), each with its own masks."""
    for rows, data, offsets in slices(batches):
        hashes, ends = tokens(data, offsets)
        terms = [hashes * f for f in _FACTORS]
        sizes = np.diff(ends)
        row = np.repeat(np.arange(rows.num_rows), sizes)
        left = ends[1:][row] - np.arange(len(hashes))
        kinds = {int(n): masks_for(int(n), least_equal) for n in np.unique(sizes)}
        for mask in sorted({m for masks in kinds.values() for m in masks}):
            asks = np.isin(sizes, [n for n, masks in kinds.items() if mask in masks])
            seed = seeds(terms, mask)
            at = np.flatnonzero(asks[row[: len(seed)]] & (left[: len(seed)] >= len(mask)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row[at])), pa.array(at - ends[row[at]]), int64(seed[at]), pa.array([mask] * len(at), pa.string())],
                ["id", "at", "seed", "mask"],
            )


def _hits(
    batches: Iterator[pa.RecordBatch], table: np.ndarray, masks: list[str]
) -> Iterator[pa.RecordBatch]:
    """(id, at, seed) of rows (id, text) whose seeds are in the table."""
    for rows, data, offsets in slices(batches):
        hashes, ends = tokens(data, offsets)
        terms = [hashes * f for f in _FACTORS]
        row = np.repeat(np.arange(rows.num_rows), np.diff(ends))
        for mask in masks:
            seed = seeds(terms, mask)
            at = np.flatnonzero(table[_slots(seed)[0]])
            at = at[table[_slots(seed[at])[1]]]
            at = at[at + len(mask) <= ends[row[at] + 1]]
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row[at])), pa.array(at - ends[row[at]]), int64(seed[at])],
                    ["id", "at", "seed"],
                )


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        hashes, ends = tokens(data, offsets)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), int64(hashes))
        yield pa.RecordBatch.from_arrays([rows.column(0), lists], ["item_id", "words"])


def stretches(equal: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(start, end, equal tokens) of the stretches of an alignment that count, in order.

    Of all stretches with `need` equal tokens and `LEAST_SHARE` of theirs equal, the one
    with the most equal tokens is taken, the shortest and first of such; then the same on
    either side of it. A stretch not taken shares tokens with one that was.
    """
    found, todo = [], [(0, len(equal))]
    while todo:
        low, high = todo.pop()
        places = low + np.flatnonzero(equal[low:high])  # stretches begin and end at equal tokens
        n = len(places)
        if n < need:
            continue
        rank = np.arange(n)
        # ranks i to j count if (j - i + 1) >= share * (places[j] - places[i] + 1)
        first = rank - LEAST_SHARE * places
        last = rank + 1 - LEAST_SHARE * (places + 1)
        lows = np.minimum.accumulate(first)
        # the first i with first[i] <= last[j]: lows falls
        begin = np.searchsorted(-lows, -last, "left")
        size = rank - begin + 1
        best = int(size.max())
        if best < need:
            continue
        ends = np.flatnonzero(size == best)
        j = int(ends[np.argmin(places[ends] - places[begin[ends]])])
        start, end = int(places[begin[j]]), int(places[j]) + 1
        found.append((start, end, best))
        todo += [(low, start), (end, high)]
    return sorted(found)


def _verify(
    batches: Iterator[pa.RecordBatch], least_equal: int
) -> Iterator[pa.RecordBatch]:
    """Rows (text, places) to (item_id, start, n_tokens, n_equal) stretches, with the id."""
    for rows, data, offsets in slices(batches):
        hashes, ends = tokens(data, offsets)
        hashes = hashes.view(np.int64)
        out = []
        for r, places in enumerate(rows.column(rows.schema.get_field_index("places")).to_pylist()):
            own = hashes[ends[r] : ends[r + 1]]
            doc = rows.column(0)[r].as_py()
            for p in places:
                item, shift = np.array(p["words"], dtype=np.int64), p["shift"]
                a, b = max(0, shift), min(len(own), shift + len(item))
                if b <= a:
                    continue
                equal = own[a:b] == item[a - shift : b - shift]
                for start, end, n in stretches(equal, needed(len(item), least_equal)):
                    out.append((doc, p["item_id"], a + start, end - start, n))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out)],
                ["doc_id", "item_id", "start", "n_tokens", "n_equal"],
            )


def contaminated(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least_equal: int = LEAST_EQUAL,
) -> DataFrame:
    """Stretches of documents that are passages of test items.

    doc_id, item_id, start and n_tokens (place in the document, in tokens), n_equal.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    items = tests.select(
        F.col(item_col).cast("long").alias("id"),
        F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"),
    )
    words = items.mapInArrow(_token_lists, "item_id long, words array<long>")
    item_seeds = cut(
        items.mapInArrow(lambda it: _item_seeds(it, least_equal), "id long, at long, seed long, mask string")
    )
    masks = sorted(r["mask"] for r in item_seeds.select("mask").distinct().collect())
    top = F.shiftrightunsigned("seed", 64 - TABLE_BITS)
    low = F.shiftrightunsigned("seed", 16).bitwiseAND(F.lit(2**TABLE_BITS - 1))
    slots = item_seeds.select(F.explode(F.array(top, low)).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))
    words64 = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    packed = np.zeros(2 ** (TABLE_BITS - 6), dtype="<i8")
    packed[words64["at"].to_numpy()] = words64["bits"].to_numpy()

    def hits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
        yield from _hits(it, table, masks)

    keyed = texts.select(F.xxhash64("text").alias("id"), "text")
    placed = (
        keyed.mapInArrow(hits, "id long, at long, seed long")
        .join(item_seeds.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "seed"), "seed")
        .select("id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .distinct()
        .join(words, "item_id")
        .groupBy("id")
        .agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("places"))
    )
    placed = cut(placed)
    return (
        texts.withColumn("id", F.xxhash64("text"))
        .join(placed, "id")
        .select("doc_id", "text", "places")
        .mapInArrow(
            lambda it: _verify(it, least_equal),
            "doc_id long, item_id long, start long, n_tokens long, n_equal long",
        )
    )


def clean(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a passage of a test item."""
    found = cut(contaminated(docs, tests, **options).select("doc_id").distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")
