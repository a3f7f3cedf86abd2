"""A corpus cleaned in five stages, each an operator of kicknet.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of `documents`. Documents with a null text are clean, unlike any other and
have no pieces; an empty table stays empty; extra columns of `documents` stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kicknet.llm import decontam, pieces, repeats, shingle_join, toxicity
from kicknet.llm.graph import cut, drop
from kicknet.llm.queries import piece_model, table

#: From this score on a document is toxic.
TOXIC_FROM = 0.5
#: Words whose pieces an encoding task keeps, less than alone: workers still hold former stages.
KNOWN_WORDS = 80_000
#: Rows of the Arrow batches between Spark and Python: documents are long.
BATCH_ROWS = "1000"


def short_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches; stages run after they return, so it stays set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, fitted to the labelled ones among them, does not reject."""
    short_batches(spark)
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rest = F.struct(*(f"`{c}`" for c in docs.columns if c != "text")).alias("rest")
    clean = toxicity.score(docs.select(rest, "text"), field).where(F.col("score") < TOXIC_FROM)
    return clean.select(*(F.col("text" if c == "text" else f"rest.`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group joined by 5-word shingles that are 80 % alike: the smallest id."""
    short_batches(spark)
    groups = shingle_join.jaccard_components(docs)
    first = cut(groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct())
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["doc_id"]), "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte passages that an earlier one has."""
    short_batches(spark)
    short = repeats.shortened(docs)
    return short.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    short_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the ids of their pieces; the text is what the ids decode to."""
    short_batches(spark)
    out = pieces.encode_texts(docs, piece_model(), decode=True, known_words=KNOWN_WORDS)
    return out.drop("text").withColumnRenamed("decoded", "text").withColumn(
        "n_pieces", F.size("ids").cast("long")
    )


STAGES = [
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding and decoding", sentence_pieces),
]

#: SQL can not express the field, the transducer and the stages between them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
