"""Registered queries of the prefix trie, the language model and the filter audit, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kicknet.llm import filter_audit, pitman_yor, prefix_trie


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with turns of one of its neighbours."""
    paths = prefix_trie.turn_paths(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    taken = F.crc32(conv.cast("string").cast("binary")) % 9
    return prefix_trie.trie(prefix_trie.spliced(paths, conv - conv % 5, taken, 8))


# DuckDB has no CRC-32: the table of its 256 steps is made by its rule, and folded over the digits
_CRC_STEP = "case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end"
OP11_SQL = f"""with recursive
steps(i, v, k) as (select range, cast(range as bigint), 0 from range(256)
  union all select i, {_CRC_STEP}, k + 1 from steps where k < 8),
crc_table as (select list(v order by i) as c from steps where k = 8),
turns as (select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce("text", '')) as digest,
    strlen(coalesce("text", '')) as bytes from conversations where conv_id is not null),
own as (select conv_id, list({{'id': digest, 'bytes': bytes}} order by turn nulls first, digest, bytes) as path from turns group by conv_id),
hashed as (select conv_id, path, xor(list_reduce(list_prepend(cast(4294967295 as bigint),
      list_transform(string_split(cast(conv_id as varchar), ''), lambda d: cast(ascii(d) as bigint))),
      lambda a, d: xor(a >> 8, c[1 + (xor(a, d) & 255)])), 4294967295) % 9 as h from own, crc_table),
rebuilt as (select a.conv_id, list_concat(coalesce(b.path[1:a.h], []), a.path[a.h + 1:]) as path
  from hashed a left join own b on b.conv_id = a.conv_id - a.conv_id % 5),
places as (select conv_id, unnest(range(0, len(path) + 1)) as depth, path from rebuilt),
members as (select conv_id, depth, list_transform(path[1:depth], lambda t: t.id) as ids,
    coalesce(path[depth].bytes, 0) as bytes, depth = len(path) as ends from places),
nodes as (select ids, depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from members group by ids, depth),
families as (select ids[1:depth - 1] as ids, count(*) as n_children from nodes where depth > 0 group by all),
kinds as (select n.*, coalesce(f.n_children, 0) as n_children from nodes n left join families f on n.ids = f.ids),
upward as (select ids[1:up] as ids, case when n_children = 0 then 1 else 0 end as leaf, saved
  from (select *, unnest(range(0, depth + 1)) as up from kinds)),
below as (select ids, sum(leaf) as n_leaves, sum(saved) as saved_tokens from upward group by ids)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children,
  cast(b.n_leaves as bigint) as n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, n.ends_sha256
from kinds n join below b on b.ids = n.ids left join nodes p on n.depth > 0 and p.ids = n.ids[1:n.depth - 1]
"""


def op12_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of every document in a Pitman-Yor model of word pairs, six sevenths learned from."""
    docs = _table(spark, sf_dir, "documents")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    return pitman_yor.language_scores(docs, learn)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, for every language and order of the filters."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP13_SQL = r"""with
texts as (select doc_id, coalesce(lang, '') as part, coalesce("text", '') as t from documents),
words as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
    min(doc_id) over (partition by t) as first_id from texts),
flags as (select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > first_id, false)] as fails from words),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id),
docs as (select f.part, f.fails, count(*) as n, sum(coalesce(k.good, 0)) as good, sum(coalesce(k.toxic, 0)) as toxic
  from flags f left join known k on k.doc_id = f.doc_id group by f.part, f.fails),
f(x) as (values (1), (2), (3), (4), (5)),
orders as (select [a.x, b.x, c.x, d.x, e.x] as o from f a, f b, f c, f d, f e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') as filter_order, unnest(range(1, 6)) as step from orders),
met as (select part, filter_order, step, o[step] as own, n, good, toxic, fails[o[step]] as bad,
    len(list_filter(o[1:step - 1], lambda i: fails[i])) > 0 as gone,
    len(list_filter(fails, lambda b: b)) = 1 as alone from docs, steps),
counted as (select part, filter_order, step, own,
    sum(case when not bad and not gone then n else 0 end) as kept,
    sum(case when bad and not gone then n else 0 end) as removed,
    sum(case when bad and gone then n else 0 end) as redundant,
    sum(case when bad and alone then n else 0 end) as unique_fails,
    sum(case when bad and not gone then good else 0 end) as good_lost,
    sum(case when bad and not gone then toxic else 0 end) as toxic_lost from met group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley
from counted
"""

QUERIES = {"op11_prefix_trie": op11_prefix_trie, "op12_language_scores": op12_language_scores, "op13_filter_audit": op13_filter_audit}
ORACLES = {"op11_prefix_trie": OP11_SQL, "op13_filter_audit": OP13_SQL}
