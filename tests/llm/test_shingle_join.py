"""The n-gram Jaccard join against a comparison of all pairs."""

import random

import pyarrow as pa
import pytest

from kicknet.llm import graph
from kicknet.llm import shingle_join as J


def brute(docs, width, percent):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        k = len(w)
        sets.append({tuple(w[i : i + width]) for i in range(max(k - width + 1, 1))} if k else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            k = len(a & b)
            if a and b and 100 * k >= percent * (len(a) + len(b) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(
        ((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)),
        key=str,
    )


def edited(rng, words, base, edits):
    base = list(base)
    for _ in range(edits):
        base[rng.randrange(len(base))] = words(1)[0]
    return base


def corpus(words, near=70):
    """Copies, near copies around the threshold, small sets, a common line, odd rows."""
    rng = random.Random(3)
    line = words(12)
    texts = []
    for size in (3, 4, 8, 12, 19, 30, 60, 200):
        for _ in range(4):
            base = words(size)
            texts += [base, base, base[:-1], [*base, "more"]]
            texts += [edited(rng, words, base, k) for k in (1, 1, 2, 3)]
            texts.append([*line, *base])
    base = words(120)
    texts += [edited(rng, words, base, rng.randint(1, 5)) for _ in range(near)]
    texts += [["x"] * 50, ["x"] * 51, ["Ab", "é"], ["aB", "é"], ["Ab", "É"]]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    return [*docs, (9000, None), (9001, ""), (9002, " \n\t"), (None, docs[0][1]), (docs[1][0], docs[1][1])]


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("width,percent,long", [(3, 90, 3), (5, 80, 32)])
def test_equals_all_pairs(spark, words, monkeypatch, width, percent, long):
    monkeypatch.setattr(J, "LONG_LIST", long)
    monkeypatch.setattr(J, "TILE", 16)
    docs = corpus(words)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(J.jaccard_components(df, width=width, percent=percent)) == brute(docs, width, percent)


@pytest.mark.parametrize("light", [0, 20])
def test_every_boundary_gives_the_same(spark, words, monkeypatch, light):
    monkeypatch.setattr(J, "choose_boundary", lambda *_: light)
    docs = corpus(words, near=10)[:120]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(J.jaccard_components(df, width=3, percent=90)) == brute(docs, 3, 90)


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, key string, cid int")
    assert J.jaccard_components(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c", "k", 5), (2, "a b c", None, None)], empty.schema)
    assert rows(J.jaccard_components(df, width=3)) == [(1, 1, 1), (2, 1, 1)]


def test_sketches_lose_no_link_and_keep_other_pairs_from_the_sets(spark, words):
    docs = corpus(words)
    texts = pa.array([text for _, text in docs])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    ids = dict.fromkeys(r["cid"] for b in J._shingles(iter([batch]), 3) for r in b.to_pylist() if r["shingles"])
    table = pa.Table.from_batches(J._shingles(iter([batch]), 3)).to_pylist()
    known = {r["cid"]: r for r in table if r["cid"] in ids}
    sets = spark.createDataFrame(
        [(c, len(r["shingles"]), r["shingles"], r["sketch"]) for c, r in known.items()],
        "cid long, n int, shingles array<long>, sketch binary",
    )
    every = sorted(known)
    pairs = spark.createDataFrame([(a, b) for a in every for b in every if a < b], "a long, b long")
    linked = {
        (a, b) for a, b in pairs.collect()
        if 100 * len(x := {*known[a]["shingles"]} & {*(y := known[b]["shingles"])}) >= 90 * (len(known[a]["shingles"]) + len(y) - len(x))
    }
    near = {tuple(r) for r in J._sketched(pairs, sets, 90).collect()}
    assert linked and linked <= near and len(near) < 2 * len(linked) + 100 < pairs.count() / 5
    assert {tuple(r) for t in J._verified_in_rounds(pairs, sets, 90) for r in t.collect()} == linked


def test_few_rows_make_few_files(spark, words, monkeypatch):
    """Tables of known size are not written to a file for each shuffle partition."""
    files, keep = [], graph.drop

    def counted(*tables):
        files.extend((tuple(t.columns), len(t.inputFiles())) for t in tables)
        keep(*tables)

    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(graph, "drop", counted)
    monkeypatch.setattr(J, "drop", counted)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        chain = spark.range(200).selectExpr("id as a", "id + 1 as b")
        assert {tuple(r) for r in graph.components(chain).collect()} == {(i, 0) for i in range(201)}
        rounds = [n for _, n in files]
        assert len(rounds) > 2 and max(rounds[1:]) == 1
        files.clear()
        docs = corpus(words, near=9)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert rows(J.jaccard_components(df)) == brute(docs, 5, 80)
        crowding = [n for columns, n in files if "length" in columns and "cls" in columns]
        assert len(crowding) == 16 and max(crowding) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
