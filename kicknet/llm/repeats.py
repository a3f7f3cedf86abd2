"""Suffix dedup: passages removed from every document but the first that has them.

Prefix-free parsing cut to the depth that is needed. A byte goes if it is covered by a
string of `length` bytes (50) that also starts in a document with a smaller id.

1. *Parse.* A rolling hash over `gram` bytes (20) sets triggers: the smallest hash
   within each string of 50 bytes. Equal strings have the same trigger at the same
   place, wherever they occur. A phrase is all strings in a row with one trigger, so it
   overlaps the next by 49 bytes: every string lies in exactly one phrase, and the
   order of suffixes beyond a phrase (the suffix array of the parse) can not matter.
2. *Dictionary.* Per trigger, the first and last document and whether its phrases
   differ. A trigger in one document only ends here: that is nearly all of an
   ordinary corpus.
3. Phrases with a shared trigger are looked up. A phrase that an earlier document has
   in full goes in full, at the cost of one row, however often it is repeated.
4. The first occurrence of a phrase can share single strings with other phrases of its
   trigger. Only these distinct phrases are brought together by trigger, with the hashes
   of their suffixes, cut to 50 bytes: equal suffixes are neighbours in the suffix array
   of the dictionary, and only equality to this depth is asked for. Within a task, the
   strings of a block of triggers are sorted by hash; runs of them come back as one row.
   Phrases of triggers that have more than a 2,048th of them are not brought together:
   their strings are spread by hash, a row each, and find the earliest document in a join.
5. The removed spans go back to the texts by document.

Everything is hash aggregation and joins on 64-bit keys: minima are combined before
the shuffle. The thousand keys with the most rows (a passage that a third of all
documents share, a run of one byte) are salted in the joins, so no other key can hold
more than a thousandth of the rows. Triggers of one document only are kept from the
second shuffle by a bit table of the shared ones, of 16 MB at most; when it fills up,
more rows are shuffled, as many as in step 2, and the result is the same. The phrases of
step 4 are worked on in `rounds` parts of the hash space one after the other (strings
with a row each in `2 * rounds`), which bounds the disk that shuffles take. Strings are
compared by trigger hash and string hash, 128 bits.

Null texts are empty. Documents with a null id neither lose anything nor count as
smaller. Rows with the same id are not smaller than each other; each is treated by
itself. Extra columns are kept by `without_repeats`. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import cut, drop
from kicknet.llm.texts import SpanHash, int64, slices

LENGTH, GRAM, ROUNDS = 50, 20, 2
#: A place is one number: 22 bits of the text's hash, 36 of the start, 6 of the count.
_START_BITS, _COUNT_BITS = 36, 6
#: Address bits of the table of shared triggers, at most, and its bits a trigger.
MOST_BITS, BITS_A_TRIGGER = 27, 32
#: Keys that are salted, at most, the rows from which on a key is, and its salts.
HOT_KEYS, HOT_ROWS, SALTS = 1000, 1000, 256
#: A trigger that has this many of the phrases of step 4, and more than one in CALM_SHARE, is hot there.
HOT_PHRASES, CALM_SHARE = 200, 2048
#: Phrases whose strings are compared at once in a task, but for a trigger that has more.
BLOCK_ROWS = 20_000


def phrases(
    data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> tuple[np.ndarray, ...]:
    """(row, first string's start, number of strings, trigger hash) of each phrase."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(data) - length + 1
    if n <= 0:
        return none
    # a string starts at each byte of a text but its last ones
    sizes = np.diff(offsets)
    holds = np.maximum(sizes - length + 1, 0)
    valid = np.repeat(np.tile([True, False], len(sizes)), np.stack([holds, sizes - holds], 1).ravel())[:n]
    value = SpanHash(data, 11).every(gram)
    least, width, span = value, 1, length - gram + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    # the first of the smallest hashes stays until its place is left or a smaller one comes
    new = np.ones(n, dtype=bool)
    new[1:] = (value[: n - 1] == least[:-1]) | (value[span : span + n - 1] < least[:-1])
    new[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    first, count = first[valid[first]], count[valid[first]]
    return np.searchsorted(offsets, first, "right") - 1, first, count, least[first]


def _text_bits(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """22 bits that tell rows with the same id apart, at the place of `_place`."""
    whole = SpanHash(data, 13)(offsets[:-1], offsets[1:])
    return (whole >> np.uint64(42)) << np.uint64(42)


def _ids(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column(0)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def shared_bits(triggers: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A table with a bit set for the leading bits of each trigger hash, 64 to a number."""
    wanted = max(1, triggers.count()) * BITS_A_TRIGGER
    bits = min(max(6, (wanted - 1).bit_length()), most)
    slot = F.shiftrightunsigned("h", 64 - bits)
    words = triggers.groupBy(F.shiftrightunsigned(slot, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("set")
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    found = words.toArrow()
    out[found.column("word").to_numpy()] = found.column("set").to_numpy().view(np.uint64)
    return out


def _may_be_shared(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = h >> np.uint64(64 - 6 - (len(table).bit_length() - 1))
    return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def join_hot(rows: DataFrame, lookup: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """The rows joined with a lookup table that has `n`, the number of rows, for each key.

    Rows of the keys with the most rows are spread over salts by a hash of the columns
    `spread`; the lookup table's rows for these keys, bounded in number, are repeated.
    It is read twice.
    """
    hot = cut(lookup.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS))
    every = F.explode(F.sequence(F.lit(1), F.lit(SALTS)))
    salted = lookup.withColumn("salt", F.lit(0)).unionByName(hot.withColumn("salt", every)).drop("n")
    marked = rows.join(F.broadcast(hot.select(*keys, F.lit(True).alias("hot"))), keys, "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    return marked.withColumn("salt", salt).join(salted, [*keys, "salt"]).drop("salt", "hot")


def _parse(batches: Iterator[pa.RecordBatch], length: int, gram: int, shared=None) -> Iterator[pa.RecordBatch]:
    """(h, x, doc, n) of the phrases of documents; n equal ones are one row if no other of the trigger is between.

    With a table of shared triggers: (h, x, doc, place) of each phrase whose trigger may be
    among them.
    """
    for rows, data, offsets in slices(batches):
        ids, valid = _ids(rows)
        row, start, count, h = phrases(data, offsets, length, gram)
        keep = valid[row] if len(row) else np.zeros(0, bool)
        if shared is not None:
            keep &= _may_be_shared(h, shared.value)
        row, start, count, h = row[keep], start[keep], count[keep], h[keep]
        if not len(row):
            continue
        x = SpanHash(data, 12)(start, start + count + length - 1)
        columns = [int64(h), int64(x), pa.array(ids[row])]
        if shared is None:
            order = np.argsort(h, kind="stable")
            new = np.ones(len(order), dtype=bool)
            for a in (x, h, row):
                new[1:] &= a[order][1:] == a[order][:-1]
            new[1:] = ~new[1:]
            take = pa.array(order[new])
            n = pa.array(np.diff(np.append(np.flatnonzero(new), len(order))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in columns), n], ["h", "x", "doc", "n"])
        else:
            place = (
                _text_bits(data, offsets)[row]
                | ((start - offsets[row]).astype(np.uint64) << np.uint64(_COUNT_BITS))
                | count.astype(np.uint64)
            )
            yield pa.RecordBatch.from_arrays([*columns, int64(place)], ["h", "x", "doc", "place"])


def _unpack(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    places = places.view(np.uint64)
    start = (places >> np.uint64(_COUNT_BITS)) & np.uint64(2**_START_BITS - 1)
    return (places >> np.uint64(42)) << np.uint64(42), start.astype(np.int64), (
        places & np.uint64(2**_COUNT_BITS - 1)
    ).astype(np.int64)


def _own(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, column: str):
    """The entries of a list column of places that belong to the row's own text.

    (row, start within the data, count, position in the flattened list)
    """
    lists = rows.column(rows.schema.get_field_index(column))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy()) if not lists.null_count else np.array(
        [len(v) if v.is_valid else 0 for v in lists]
    )
    row = np.repeat(np.arange(rows.num_rows), sizes)
    bits, start, count = _unpack(flat)
    mine = np.flatnonzero(bits == _text_bits(data, offsets)[row])
    return row[mine], start[mine] + offsets[row[mine]], count[mine], mine


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(h, doc, place, strings): hashes of the strings of the asked phrases."""
    for rows, data, offsets in slices(batches):
        ids, _ = _ids(rows)
        row, start, count, mine = _own(rows, data, offsets, "places")
        if not len(row):
            continue
        triggers = rows.column(rows.schema.get_field_index("triggers")).flatten().take(pa.array(mine))
        places = rows.column(rows.schema.get_field_index("places")).flatten().take(pa.array(mine))
        ends = np.concatenate([[0], np.cumsum(count)])
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - start, count)
        strings = pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), int64(SpanHash(data, 14)(at, at + length))
        )
        yield pa.RecordBatch.from_arrays(
            [triggers, pa.array(ids[row]), places, strings], ["h", "doc", "place", "strings"]
        )


def _seen_earlier(
    h: np.ndarray, doc: np.ndarray, place: np.ndarray, sizes: np.ndarray, strings: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of each run of strings that an earlier document has, for phrases of whole triggers."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(strings)
    same = strings[order[1:]] == strings[order[:-1]]
    again = np.zeros(len(order), dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    some = order[again]
    if not len(some):
        return doc[:0], place[:0]
    some = some[np.lexsort((strings[some], h[row[some]]))]
    s, t, d = strings[some], h[row[some]], doc[row[some]]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(d, first), np.diff(np.append(first, len(some))))
    at = np.sort(some[d > low])
    opens = np.ones(len(at), dtype=bool)
    opens[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    begin = np.flatnonzero(opens)
    count = np.diff(np.append(begin, len(at)))
    at = at[begin]
    i = at - (np.cumsum(sizes) - sizes)[row[at]]
    whole = place[row[at]].view(np.uint64)
    front = (whole >> np.uint64(_COUNT_BITS)) + i.astype(np.uint64)
    return doc[row[at]], ((front << np.uint64(_COUNT_BITS)) | count.astype(np.uint64)).view(np.int64)


def _earlier_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, place) of each run of strings that an earlier document has.

    The phrases (h, doc, place, strings) come sorted by trigger. The last trigger of a block
    waits for the next one, as it may go on there.
    """
    held: list[pa.RecordBatch] = []

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = rows.column("strings").combine_chunks()
        h, doc, place = (rows.column(c).to_numpy() for c in ("h", "doc", "place"))
        sizes = np.diff(lists.offsets.to_numpy())
        found = _seen_earlier(h, doc, place, sizes, lists.flatten().to_numpy(zero_copy_only=False))
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["doc", "place"])

    waiting, enough = 0, BLOCK_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        waiting += batch.num_rows
        if waiting < enough:
            continue
        rows = pa.Table.from_batches(held)
        h = rows.column("h").to_numpy()
        other = np.flatnonzero(h != h[-1])
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield from run(rows.slice(0, end))
        held = rows.slice(end).to_batches()
        waiting = rows.num_rows - end
        enough = max(BLOCK_ROWS, 2 * waiting)
    if held:
        yield from run(pa.Table.from_batches(held))


def _spans(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """doc_id, the bytes that stay, the number of bytes and the removed spans."""
    for rows, data, offsets in slices(batches):
        row, start, count, _ = _own(rows, data, offsets, "places")
        edges = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edges, start, 1)
        np.add.at(edges, start + count + length - 1, -1)
        gone = np.cumsum(edges[:-1]) > 0
        at = np.repeat(np.arange(rows.num_rows), np.diff(offsets))
        opens, closes = gone.copy(), gone.copy()
        firsts, lasts = offsets[:-1][np.diff(offsets) > 0], offsets[1:][np.diff(offsets) > 0] - 1
        opens[1:] &= ~gone[:-1]
        opens[firsts] = gone[firsts]
        closes[:-1] &= ~gone[1:]
        closes[lasts] = gone[lasts]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = at[begin] if len(begin) else begin
        span_ends = np.searchsorted(of, np.arange(rows.num_rows + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays(
            [pa.array(begin - offsets[of]), pa.array(end - begin)], ["start", "length"]
        )
        stays = ~gone
        names = [n for n in rows.schema.names if n not in ("text", "places")]
        kept = np.concatenate([[0], np.cumsum(stays)])[offsets].astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                *(rows.column(rows.schema.get_field_index(n)) for n in names),
                pa.Array.from_buffers(
                    pa.binary(), rows.num_rows, [None, pa.py_buffer(kept), pa.py_buffer(data[stays].tobytes())]
                ),
                pa.array(np.diff(offsets)),
                pa.ListArray.from_arrays(pa.array(span_ends), pairs),
            ],
            [*names, "kept", "n_bytes", "spans"],
        )


def repeated_places(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, rounds: int = ROUNDS
) -> DataFrame:
    """(doc, places): where repeated strings start in documents, for (doc_id, text) rows."""
    triggers = (
        docs.mapInArrow(lambda it: _parse(it, length, gram), "h long, x long, doc long, n int")
        .groupBy("h")
        .agg(
            F.min("doc").alias("low"),
            F.max("doc").alias("high"),
            (F.min("x") != F.max("x")).alias("differ"),
            F.sum("n").alias("n"),
        )
        .where("low < high")
        .select("h", "low", "differ", "n")
    )
    triggers = cut(triggers)
    shared = docs.sparkSession.sparkContext.broadcast(shared_bits(triggers))
    parsed = docs.mapInArrow(
        lambda it: _parse(it, length, gram, shared), "h long, x long, doc long, place long"
    )
    found = cut(join_hot(parsed, triggers, ["h"], ["doc", "place"]).where("differ or doc > low"))
    shared.unpersist()
    drop(triggers)
    mixed = found.where("differ").select("h", "x", "doc", "place")
    most = mixed.count()
    first = cut(mixed.groupBy("h", "x").agg(F.min("doc").alias("first"), F.count("*").alias("n")), most)
    placed = cut(join_hot(mixed, first, ["h", "x"], ["doc", "place"]), most)
    whole = [cut(found.where("not differ").select("doc", "place")), placed.where("doc > first").select("doc", "place")]
    drop(found, first)

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    asked = placed.where("doc = first").groupBy("doc").agg(
        F.collect_list(F.struct("h", "place")).alias("asked")
    ).select(
        F.col("doc").alias("doc_id"),
        F.col("asked.h").alias("triggers"),
        F.col("asked.place").alias("places"),
    )
    phrase = cut(
        docs.join(asked, "doc_id").mapInArrow(
            lambda it: _suffixes(it, length), "h long, doc long, place long, strings array<long>"
        )
    )
    most = phrase.count()
    least = max(HOT_PHRASES, most // CALM_SHARE)
    hot = cut(phrase.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h"), most)
    calm = phrase.join(F.broadcast(hot), "h", "left_anti")
    for part in range(rounds):
        whole.append(
            cut(
                calm.where(F.pmod("h", F.lit(rounds)) == part)
                .repartition("h")
                .sortWithinPartitions("h")
                .select("h", "doc", "place", "strings")
                .mapInArrow(_earlier_runs, "doc long, place long")
            )
        )
    if not hot.isEmpty():
        crowded = cut(phrase.join(F.broadcast(hot), "h", "left_semi"))
        whole += [_earlier_strings(crowded, 2 * rounds, part) for part in range(2 * rounds)]
        drop(crowded)
    drop(hot)
    drop(phrase)
    return union(whole).groupBy("doc").agg(F.collect_list("place").alias("places"))


def _earlier_strings(phrase: DataFrame, parts: int, part: int) -> DataFrame:
    """(doc, place) of each string that an earlier document has, in a part of the hash space."""
    strings = phrase.select("h", "doc", "place", F.posexplode("strings").alias("i", "s")).where(
        F.pmod("s", F.lit(parts)) == part
    )
    earliest = cut(
        strings.groupBy("h", "s")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
        .where("low < high")
        .select("h", "s", "low", "n")
    )
    found = cut(
        join_hot(strings, earliest, ["h", "s"], ["doc", "place", "i"])
        .where("doc > low")
        .select(
            "doc",
            # the place of the i-th string of the phrase, alone
            (F.shiftleft(F.shiftright("place", _COUNT_BITS) + F.col("i"), _COUNT_BITS) + F.lit(1)).alias("place"),
        )
    )
    drop(earliest)
    return found


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    rounds: int = ROUNDS,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, `kept` (binary), n_bytes and `spans` of every row.

    `spans` are the removed runs (start, length; bytes). Columns named in `also` are
    passed on in a struct of that name.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *([F.struct(*(F.col(f"`{c}`") for c in also)).alias("also")] if also else []),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    if not 0 <= length - gram < 2**_COUNT_BITS - 1:
        raise ValueError(f"length has to be {gram} to {gram + 2**_COUNT_BITS - 2} for a gram of {gram}")
    places = repeated_places(texts.select("doc_id", "text"), length, gram, rounds)
    places = cut(places.withColumnRenamed("doc", "doc_id"))
    none = F.expr("cast(array() as array<long>)")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.drop("text").schema)
    return (
        texts.join(places, "doc_id", "left")
        .withColumn("places", F.coalesce("places", none))
        .mapInArrow(
            lambda it: _spans(it, length),
            f"{kept}, kept binary, n_bytes long, spans array<struct<start:long,length:long>>",
        )
    )


def as_text(kept: pa.Array) -> pa.Array:
    """Bytes as text, without the parts of characters that a cut has left."""
    return pa.array([b.decode("utf-8", "ignore") for b in kept.to_pylist()], pa.string())


def shortened(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with their texts less the repeated passages."""
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    out = without_repeats(docs, id_col, text_col, also=rest, **options).drop("n_bytes", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], as_text(batch.columns[-1])], [*batch.schema.names[:-1], "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.drop("kept").schema)
    named = out.mapInArrow(run, f"{schema}, text string")
    own = {id_col: "doc_id", text_col: "text"}
    return named.select(*(F.col(own.get(c, f"also.`{c}`")).alias(c) for c in docs.columns))
