"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kicknet.llm import queries_audit
from kicknet.llm import chat, decontam, main_text, pieces, quality, repeats, shingle_join, token_counts, toxicity, vectors
from kicknet.llm.labelled import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folder of tokenizer files and the model that the queries use.
TOKENIZERS = os.environ.get("KICKNET_TOKENIZERS", "/opt/tokenizers")


@cache
def piece_model() -> bytes:
    return pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_chat(turns.unionByName(extra)).select(
        "*",
        chat.read_chat(F.col("formatted")).alias("turns"),
        F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = (
    r"regexp_replace({0}, '([<\[])(\\*)(/?s>|TURN\]|MORE\]|/?INST\])', '\1\\\2\3', 'g')"
)
OP2_SQL = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as txt from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
r as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, txt) as before,
    row_number() over (partition by conv_id order by turn nulls first, role, txt) as k from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || txt || chr(10), '' order by k)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(txt) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(txt, '' order by k) filter (where role = 'assistant'), ''))
    as loss_sha256,
  cast(sum(length({_ESCAPED.format("txt")}) + case
    when before is not distinct from role and k > 1 then 6
    else 13 + length({_ESCAPED.format("role")}) end) as bigint) as formatted_chars
from r group by conv_id
"""


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents joined by sets of 3-word shingles that are 90 % alike."""
    docs = table(spark, sf_dir, "documents")
    return shingle_join.jaccard_components(docs, width=3, percent=90)


def shingle_group_sql(source: str, width: int, percent: int) -> str:
    """Table expressions ending in `grouped` (doc_id, n_shingles, component_id) over `source`."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
words as (select doc_id, regexp_extract_all(
    translate(coalesce("text", ''), '{capitals}', '{capitals.lower()}'), '[^\x20\x09-\x0D]+') as w
  from {source}),
shingles as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < {width} then [w]
    else list_transform(range(1, len(w) - {width} + 2), lambda i: w[i:i + {width - 1}]) end) as s
  from words),
sized as (select doc_id, count(*) as n from shingles group by doc_id),
met as (select a.doc_id as x, b.doc_id as y, count(*) as k
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by all),
linked as (select x, y from met join sized p on p.doc_id = x join sized q on q.doc_id = y
  where 100 * k >= {percent} * (p.n + q.n - k)),
edges as (select x, y from linked union all select y, x from linked),
reached(x, y) as (select x, y from edges union select r.x, e.y from reached r join edges e on r.y = e.x),
grouped as (select d.doc_id, coalesce(any_value(sized.n), 0) as n_shingles,
    least(d.doc_id, coalesce(min(reached.y), d.doc_id)) as component_id
  from {source} d left join sized on sized.doc_id = d.doc_id left join reached on reached.x = d.doc_id
  group by d.doc_id)"""


OP8_SQL = f"""with recursive {shingle_group_sql("documents", 3, 90)}
select doc_id, n_shingles, component_id from grouped"""


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document without the passages that an earlier document has."""
    return repeats.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )



def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with one label and a cosine of at least 0.93."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


OP10_SQL = """with recursive
good as (select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
edges as (select a.vec_id as x, b.vec_id as y from good a join good b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.93),
reached(x, y) as (select x, y from edges union select r.x, e.y from reached r join edges e on r.y = e.x),
placed as (select e.vec_id, (select count(*) from edges where x = e.vec_id) as n_links,
  least(e.vec_id, coalesce((select min(y) from reached where x = e.vec_id), e.vec_id)) as component_id
  from embeddings e)
select *, vec_id = component_id as kept from placed"""


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded from its ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pieces.encode_texts(docs, piece_model(), decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        pieces.ids_digest(F.col("ids")).alias("ids_sha256"),
        (F.col("decoded") == F.col("text")).alias("same_text"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )



def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text.extract(pages).withColumn("n_chars", F.length("text").cast("long"))



def op1_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, one row per document and item."""
    found = decontam.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("start", "n_tokens").alias("n_places"),
        F.max("n_equal").alias("n_equal"),
        F.max("n_tokens").alias("n_tokens"),
        F.min("start").alias("first_start"),
    )



def judged(scores: DataFrame, least: float) -> DataFrame:
    """Scores with held_out and predicted added."""
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
        *(c for c in scores.columns if c not in ("doc_id", "score")),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document and the number of its offending spans."""
    docs = table(spark, sf_dir, "documents")
    field = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scores = toxicity.score(docs.select("doc_id", "text"), field).drop("text")
    return judged(scores.withColumn("n_spans", F.size("spans").cast("long")).drop("spans"), 0.5)



def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents")
    network = quality.fit(docs, table(spark, sf_dir, "labels"))
    return judged(quality.score(docs, network), 0.3)



def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files made of the documents."""
    return token_counts.document_counts(table(spark, sf_dir, "documents"), piece_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_contaminated": op1_contaminated,
    "op2_chat_format": op2_chat_format,
    "op3_sentence_pieces": op3_sentence_pieces,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_toxicity": op6_toxicity,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_token_counts": op9_token_counts,
    "op10_near_vectors": op10_near_vectors,
    **queries_audit.QUERIES,
}
ORACLES: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op10_near_vectors": OP10_SQL,
    **queries_audit.ORACLES,
}
