"""Classifiers on held-out rows, vectors against all pairs, the pipeline's stages."""

import os
from itertools import product

import numpy as np
import pytest

import corpus_pipeline as P
from kicknet.llm import quality, queries, toxicity, vectors
from kicknet.llm.labelled import held_out, sample

FOLDER = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rates(spark, name, label):
    labels = queries.table(spark, FOLDER, "labels").select("doc_id", label)
    rows = queries.QUERIES[name](spark, FOLDER).join(labels, "doc_id").where("held_out").collect()
    ones = [r["predicted"] for r in rows if r[label] == 1]
    zeros = [r["predicted"] for r in rows if r[label] == 0]
    return sum(ones) / len(ones), sum(zeros) / len(zeros)


@needs_tables
def test_quality_of_held_out_documents(spark):
    good, bad = rates(spark, "op4_quality", "quality")
    assert good > 0.9 and bad < 0.35


@needs_tables
def test_toxicity_of_held_out_documents(spark):
    toxic, clean = rates(spark, "op6_toxicity", "toxic")
    assert toxic > 0.5 and clean < 0.03


def test_odd_texts_have_scores(spark):
    texts = [None, "", "!!! 12", "an idiot, you", "w " * 200_000, "é日"]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, score int, spans string")
    train = [(b"you are an idiot and more", 1), (b"what an idiot he is", 1), (b"idiot that you are", 1), (b"idiot", 1)]
    train += [(f"clean words number {i} of text".encode(), 0) for i in range(40)]
    field = toxicity.train(*map(list, zip(*train)))
    rows = {r["doc_id"]: r for r in toxicity.score(df, field).collect()}
    assert rows[3]["score"] > 0.5 and [tuple(s) for s in rows[3]["spans"]] == [(3, 5)]
    assert all(rows[i]["score"] < 0.1 for i in (0, 1, 2, 4, 5))
    net = quality.train(*map(list, zip(*train)))
    assert all(0 <= r["score"] <= 1 for r in quality.score(df, net).collect())
    assert quality.score(df.limit(0), net).collect() == [] == toxicity.score(df.limit(0), field).collect()
    assert toxicity.score(df, toxicity.train([], [])).agg({"score": "max"}).first()[0] == 0
    assert quality.score(df, quality.train([], [])).count() == len(texts)


def test_marginals_equal_all_tag_sequences():
    rng = np.random.default_rng(5)
    texts = [b"one two three four five. six", b"", b"seven eight nine ten eleven twelve!", b"a b a"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words = toxicity.read_words(np.frombuffer(b"".join(texts), np.uint8), offsets)
    weights = np.zeros(2**toxicity.FEATURE_BITS)
    used = np.unique(words.features)
    weights[used] = rng.normal(scale=0.5, size=len(used))
    field = toxicity.Field(weights, rng.normal(size=(2, 2)), 0.7)
    sums = np.zeros((2, 2))
    got = field.marginals(words, sums)
    expected, steps = np.zeros(len(words.row)), np.zeros((2, 2))
    for k in np.unique(words.sequence):
        at = np.flatnonzero(words.sequence == k)
        emit = weights[words.features[at]].sum(axis=1)
        tags = np.array(list(product((0, 1), repeat=len(at))))
        value = tags @ emit + tags[:, 0] * field.first
        value += field.steps[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        p = np.exp(value) / np.exp(value).sum()
        expected[at] = p @ tags
        for a, b in product((0, 1), repeat=2):
            steps[a, b] += p @ ((tags[:, :-1] == a) & (tags[:, 1:] == b)).sum(axis=1)
    assert len(np.unique(words.sequence)) == 4
    assert np.allclose(got, expected) and np.allclose(sums, steps)


def exact_network(rng):
    net = quality.new_network(rng)
    for name, value in vars(net).items():
        setattr(net, name, value.astype(float) + rng.normal(scale=0.1, size=value.shape))
    return net


def naive_value(net, chunk):
    best = np.full(quality.FILTERS, -np.inf)
    for place in range(len(chunk) - quality.WIDTH + 1):
        window = np.concatenate([net.embedding[b] for b in chunk[place : place + quality.WIDTH]])
        best = np.maximum(best, [window @ net.filters[:, f] for f in range(quality.FILTERS)])
    features = np.append(np.tanh(best + net.bias), np.mean([b < 256 for b in chunk]))
    return np.tanh(features @ net.hidden + net.hidden_bias) @ net.out + net.out_bias[0]


def test_scores_equal_a_naive_convolution():
    rng = np.random.default_rng(8)
    net = exact_network(rng)
    texts = [b"", b"abc", bytes(rng.integers(97, 123, 2 * quality.CHUNK + 7).astype(np.uint8))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = quality.score_texts(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    for text, score in zip(texts, got):
        covered, values = set(), []
        for at in range(0, max(1, len(text) - (quality.CHUNK - quality.STRIDE)), quality.STRIDE):
            chunk = list(text[at : at + quality.CHUNK])
            covered |= set(range(at, at + len(chunk)))
            values.append(naive_value(net, chunk + [256] * (quality.CHUNK - len(chunk))))
        assert len(covered) == len(text)
        assert np.isclose(score, 1 / (1 + np.exp(-np.mean(values))), atol=1e-6)


def test_gradients_equal_differences_of_the_loss():
    rng = np.random.default_rng(9)
    net = exact_network(rng)
    chunks = rng.integers(97, 103, (5, 40)).astype(np.int16)
    chunks[4, 25:] = 256
    of, y, weight = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])

    def loss():
        z = np.bincount(of, net.values(chunks)) / np.bincount(of)
        return ((np.logaddexp(0, z) - y * z) * weight).mean()

    for value, grad in zip(net.parts(), quality._step(net, chunks, of, y, weight)):
        flat, slopes = value.reshape(-1), np.asarray(grad).reshape(-1)
        for k in {*rng.integers(len(flat), size=8), *np.argsort(-abs(slopes))[:8]}:
            middle, ends = flat[k], []
            for step in (1e-5, -1e-5):
                flat[k] = middle + step
                ends.append(loss())
            flat[k] = middle
            assert np.isclose((ends[0] - ends[1]) / 2e-5, slopes[k], rtol=1e-3, atol=1e-6)


def test_samples_leave_held_out_rows_and_doubtful_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i % 30}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i != 31 else 0) for i in range(60)], "doc_id long, toxic int")
    out = {r["doc_id"] for r in docs.where(held_out(docs["doc_id"])).collect()}
    texts, y = sample(docs, labels, "toxic", 8)
    assert len(texts) <= 16 and len(texts) == len(set(texts)) == len(y)
    assert all(any(f"text {i % 30}".encode() == t for i in range(60) if i not in out) for t in texts)


def brute(rows, least):
    usable = []
    for k, (_, v, label) in enumerate(rows):
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = usable[i], usable[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    first = {}
    for k, (d, *_) in enumerate(rows):
        first[find(k)] = min(d, first.get(find(k), d))
    return sorted((d, links[k], first[find(k)], d == first[find(k)]) for k, (d, *_) in enumerate(rows))


@pytest.mark.parametrize("tile", [16, 1024])
def test_vectors_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rng = np.random.default_rng(3)
    rows, centres = [], rng.normal(size=(6, 20))
    for k in range(260):
        v = rng.normal(size=20) if k % 3 else centres[k % 6] + rng.normal(scale=0.06 + 0.1 * (k % 5 == 0), size=20)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2))
    rows += [(300 + i, rows[0][1], 0) for i in range(20)]
    rows += [(400, None, 0), (401, [], 0), (402, [0.0] * 20, 0), (403, [None] + [1.0] * 19, 0), (404, [float("nan")] * 20, 0)]
    rows += [(405, [float("inf")] + [0.0] * 19, 0), (406, rows[0][1], None), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df.repartition(3)).collect())
    assert got == brute(rows, 0.93)
    assert vectors.near_vectors(df.limit(0)).collect() == []


@needs_tables
def test_the_pipeline_drops_what_its_stages_find(spark):
    docs = queries.table(spark, FOLDER, "documents")
    columns = docs.columns
    kept = {}
    now = docs
    for name, stage in P.STAGES:
        now = P.cut(stage(spark, now, FOLDER))
        assert name == P.STAGES[-1][0] or now.columns == columns
        kept[name] = {r["doc_id"] for r in now.select("doc_id").collect()}
    names = [n for n, _ in P.STAGES]
    before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert set(before) > kept[names[0]] > kept[names[1]] == kept[names[2]] > kept[names[3]] == kept[names[4]]
    copies = {}
    for d in kept[names[1]]:
        assert copies.setdefault(before[d], d) == d  # no exact copies are left
    from kicknet.llm.pieces import compile_model

    machine = compile_model(queries.piece_model())
    for r in now.limit(50).collect():
        assert r["ids"] == machine.encode(r["text"]) and r["n_pieces"] == len(r["ids"])
        assert r["n_chars"] == len(r["text"])
