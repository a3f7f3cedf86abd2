"""Token counts from flat token files by a scan for separators.

A token file is nothing but token ids of one width, little endian, with an
end-of-document id after each document; no index says where documents begin. Files are
read in blocks. Each block is searched for the id at once and reports its documents'
lengths between separators, its first and last separator and its size. A prefix scan
over the blocks of a file (running sum of tokens and documents, running maximum of the
last separator) stitches the documents that blocks cut apart.

Tokens after the last separator of a file are a document too. Empty documents (two
separators in a row) count 0. An empty file has no documents. A file whose size is not
a multiple of the width is refused. Spark hands a file over as one row, so that only files
up to `WHOLE_FILE` are read that way; of larger ones each task gets byte ranges, opened
where the file lies (a local or shared folder, HDFS, S3 or Google storage as Arrow knows
them). Files may have any size. `same_file` scans parts as one file.

The prefix scan sees one narrow row a block, the documents' places are joined to it by block:
no task holds the documents of a file.

`write_token_files` makes such files: encoded documents are dealt to shards of bounded
size and written in the order of their ids by Spark's text writer, the separator being
its line end. `document_counts` counts the files of a part of the shards before it writes
those of the next one, so that no more than one part's files and shuffle stand on the disk.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kicknet.llm.graph import cut, remove, remove_at_exit, shared_folder, shuffles_removed

BLOCK_BYTES = 1 << 20
SHARD_BYTES = 16 << 20
WHOLE_FILE = 128 << 20
#: Bytes of large files that one task reads.
TASK_BYTES = 64 << 20
ROUNDS = 4


_FOUND = "file string, block struct<path:string,i:long>, size long, found long, first long, last long, docs array<struct<start:long,end:long>>"


def _blocks(rows: pa.RecordBatch, blocks: list[bytes], eod: int, width: int) -> pa.RecordBatch:
    """Size, separators and documents of blocks; a first document starts where it is not known yet."""
    size, found, first, last, starts, ends = [], [], [], [], [], []
    for data in blocks:
        tokens = np.frombuffer(data, dtype=f"<u{width}")
        at = np.flatnonzero(tokens == eod)
        size.append(len(tokens))
        found.append(len(at))
        first.append(int(at[0]) if len(at) else None)
        last.append(int(at[-1]) if len(at) else None)
        starts.append(np.concatenate([[-1], at[:-1] + 1]) if len(at) else at)
        ends.append(at)
    edges = pa.array(np.concatenate([[0], np.cumsum(found)]).astype(np.int32))
    begin = np.concatenate(starts).astype(np.int64)
    spans = pa.StructArray.from_arrays(
        [pa.array(begin, mask=begin < 0), pa.array(np.concatenate(ends).astype(np.int64))], ["start", "end"]
    )
    numbers = [pa.array(x, pa.int64()) for x in (size, found, first, last)]
    return pa.RecordBatch.from_arrays(
        [rows.column(0), rows.column(1), *numbers, pa.ListArray.from_arrays(edges, spans)],
        ["file", "block", "size", "found", "first", "last", "docs"],
    )


def _given_blocks(batches: Iterator[pa.RecordBatch], eod: int, width: int) -> Iterator[pa.RecordBatch]:
    """Blocks whose bytes are the last column."""
    for batch in batches:
        if batch.num_rows:
            yield _blocks(batch, [x.as_buffer() for x in batch.column(2)], eod, width)


def open_file(path: str) -> pa.NativeFile:
    """A file, opened for reading at any place, by the path that Spark gives it."""
    local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
    if local:
        return pyarrow.fs.LocalFileSystem().open_input_file(local[1])
    system, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return system.open_input_file(inner)


def _read_blocks(batches: Iterator[pa.RecordBatch], eod: int, width: int) -> Iterator[pa.RecordBatch]:
    """Blocks given by their offset and size; one block's bytes are held at a time."""
    for batch in batches:
        for r in range(batch.num_rows):
            offset, size = batch.column(2)[r].as_py(), batch.column(3)[r].as_py()
            with open_file(batch.column(1)[r]["path"].as_py()) as file:
                data = file.read_at(size, offset)
            if len(data) != size:
                raise OSError(f"{batch.column(1)[r]['path']}: {len(data)} of {size} bytes at {offset}")
            yield _blocks(batch.slice(r, 1), [data], eod, width)


def scan_token_files(
    spark: SparkSession,
    path: str,
    eod: int,
    width: int = 2,
    block_bytes: int = BLOCK_BYTES,
    same_file: Column | None = None,
    whole_file: int = WHOLE_FILE,
) -> DataFrame:
    """file, document (from 0), start (in tokens) and n_tokens of each document.

    `same_file` names the file that a part belongs to, an expression over `path`; parts
    of one file are in the order of their paths. Files above `whole_file` bytes are read
    by ranges, smaller ones through Spark.
    """
    return _stitched(_scanned(spark, path, eod, width, block_bytes, same_file, whole_file))


def _scanned(
    spark: SparkSession,
    path: str,
    eod: int,
    width: int = 2,
    block_bytes: int = BLOCK_BYTES,
    same_file: Column | None = None,
    whole_file: int = WHOLE_FILE,
) -> DataFrame:
    """A table of the files' blocks; the files are not read again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > whole_file
    seen = files.agg(
        F.max(F.when(F.col("length") % width != 0, F.struct("path", "length"))).alias("bad"),
        F.coalesce(F.sum(F.when(large, F.col("length"))), F.lit(0)).alias("large"),
    ).first()
    if seen["bad"]:
        raise ValueError(f"{seen['bad']['path']}: {seen['bad']['length']} bytes is no size of a token file")
    step = max(1, block_bytes // width) * width
    named = files.where("length > 0").withColumn("file", same_file if same_file is not None else F.col("path"))

    def by_block(of: DataFrame, *more: str) -> DataFrame:
        i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step)))
        return of.select("file", "path", "length", *more, i.alias("i"))

    block = F.struct("path", "i").alias("block")
    given = by_block(named.where(~large), "content").select(
        "file", block, F.expr(f"substring(content, cast(i * {step} as int) + 1, {step})").alias("data")
    )
    found = given.mapInArrow(lambda it: _given_blocks(it, eod, width), _FOUND)
    if seen["large"]:
        offset = F.col("i") * step
        ranges = (
            by_block(named.where(large))
            .select("file", block, offset.alias("offset"), F.least(F.lit(step), F.col("length") - offset).alias("n"))
            .repartition(max(1, -(-seen["large"] // TASK_BYTES)), "block")
        )
        found = found.unionByName(ranges.mapInArrow(lambda it: _read_blocks(it, eod, width), _FOUND))
    return cut(found)  # read for the prefix scan and for the documents


def _stitched(found: DataFrame) -> DataFrame:
    """file, document, start and n_tokens of each document of whole files, from their blocks."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        found.select("file", "block", "size", "found", "last")
        .withColumn("begin", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .select(
            "file",
            "block",
            "begin",
            F.coalesce(F.sum("found").over(before), F.lit(0)).alias("documents"),
            (F.coalesce(F.max(F.col("begin") + F.col("last")).over(before), F.lit(-1)) + 1).alias("open"),
            F.lead("size").over(order).isNull().alias("is_last"),
        )
    )
    rows = found.join(placed, ["file", "block"])
    tail = F.struct((F.col("last") + 1).alias("start"), F.col("size").alias("end"))
    has_tail = F.col("is_last") & (F.col("begin") + F.col("size") > F.coalesce(F.col("begin") + F.col("last") + 1, "open"))
    docs = F.when(has_tail, F.concat("docs", F.array(tail))).otherwise(F.col("docs"))
    start = F.coalesce(F.col("begin") + F.col("doc.start"), F.col("open"))
    return rows.select("file", "begin", "documents", "open", F.posexplode(docs).alias("k", "doc")).select(
        "file",
        (F.col("documents") + F.col("k")).alias("document"),
        (F.col("begin") + F.col("doc.end") - start).alias("n_tokens"),
        start.alias("start"),
    )


@lru_cache(maxsize=1)
def _processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    """The rows with `tokens`, ids of 16 bits, in place of the text, the last column."""
    processor = _processor(model)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [t or "" for t in batch.columns[-1].to_pylist()]
            ids = processor.encode(texts, num_threads=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([np.array(x, "<u2").tobytes() for x in ids], pa.binary())],
                [*batch.schema.names[:-1], "tokens"],
            )


def _dealt(docs: DataFrame, model: bytes, shard_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their shard, where each is within it, and the number of shards."""
    processor = _processor(model)
    if processor.get_piece_size() > 2**16:
        raise ValueError("the model has more pieces than 16 bits can number")
    if processor.eos_id() < 0:
        raise ValueError("the model has no id for the end of a text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    keyed = rows.withColumn("tie", F.xxhash64("text")).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(shards))
    )
    order = Window.partitionBy("shard").orderBy("doc_id", "tie")
    places = keyed.select(
        "doc_id", "shard", (F.row_number().over(order) - 1).cast("long").alias("document")
    )
    return keyed, places, shards


def _write_part(keyed: DataFrame, model: bytes, shards: int, rounds: int, part: int, folder: str) -> None:
    """Adds the token files of every `rounds`-th shard to a folder."""
    separator = _processor(model).eos_id().to_bytes(2, "little").decode()
    with shuffles_removed(keyed.sparkSession):
        (
            keyed.select("doc_id", "tie", "shard", "text")
            .where(F.col("shard") % rounds == part)
            .mapInArrow(
                lambda it: _encoded(it, model), "doc_id long, tie long, shard long, tokens binary"
            )
            .repartition(-(-shards // rounds), "shard")
            .sortWithinPartitions("shard", "doc_id", "tie")
            .select("shard", F.col("tokens").cast("string").alias("value"))
            .write.mode("append")
            .partitionBy("shard")
            .option("lineSep", separator)
            .text(folder)
        )


def _new_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    return folder


def write_token_files(
    docs: DataFrame, model: bytes, shard_bytes: int = SHARD_BYTES, rounds: int = ROUNDS
) -> tuple[str, DataFrame]:
    """(folder of token files, where each document is: doc_id, shard, document).

    Ids have 16 bits, the separator is the model's </s>, the files are removed when the
    session ends. Documents of a shard are in the order of doc_id (nulls first). Shards
    are written in `rounds` parts, one after the other, so that no more than one
    part stands in shuffle files.
    """
    keyed, places, shards = _dealt(docs, model, shard_bytes)
    folder = _new_folder(docs.sparkSession)
    for part in range(min(rounds, shards)):
        _write_part(keyed, model, shards, rounds, part, folder)
    return folder, places


def document_counts(
    docs: DataFrame, model: bytes, shard_bytes: int = SHARD_BYTES, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, shard, document and n_tokens of every row, counted in its token file.

    The files are those of `write_token_files`; a part of them is removed once it is scanned.
    """
    spark = docs.sparkSession
    keyed, places, shards = _dealt(docs, model, shard_bytes)
    found = []
    for part in range(min(rounds, shards)):
        folder = _new_folder(spark)
        _write_part(keyed, model, shards, rounds, part, folder)
        found.append(_scanned(spark, folder, _processor(model).eos_id()))
        remove(spark, folder)
    counts = _stitched(reduce(DataFrame.unionByName, found)).select(
        F.regexp_extract("file", r"shard=(\d+)", 1).cast("long").alias("shard"), "document", "n_tokens"
    )
    return places.join(counts, ["shard", "document"]).select("doc_id", "shard", "document", "n_tokens")
