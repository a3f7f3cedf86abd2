"""The Pitman-Yor model against enumeration, a sampler that seats customers one by one, and counts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from kicknet.llm import pitman_yor
from kicknet.llm.queries_audit import op12_language_scores
from pyspark.sql import functions as F

DDL = "doc_id long, text string, score string, chunk int, learn string"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]
        yield [[items[0]], *rest]


@pytest.mark.parametrize("c, p, others, d", [(2, 0.3, 4, 0.7), (5, 0.01, 0, 0.4), (6, 0.2, 50, 0.8)])
def test_table_numbers_have_the_distribution_of_all_seatings(c, p, others, d):
    weights = Counter()
    for seating in partitions(list(range(c))):
        weight = 1.0
        for k, table in enumerate(seating):
            weight *= (pitman_yor.STRENGTH + d * (others + k)) * p
            for n in range(1, len(table)):
                weight *= n - d
        weights[len(seating)] += weight
    n = 40_000
    drawn = pitman_yor.sample_tables(
        np.random.default_rng(1), np.full(n, c), np.full(n, p), np.full(n, others), d
    )
    for t, weight in weights.items():
        assert abs((drawn == t).mean() - weight / sum(weights.values())) < 0.01


@pytest.mark.parametrize("p, d", [(0.05, 0.6), (0.5, 0.8), (0.9, 0.3)])
def test_dishes_seated_in_steps_have_as_many_tables_as_exact_ones(p, d):
    def mean(exact):
        n = 1500
        return pitman_yor.sample_tables(
            np.random.default_rng(2), np.full(n, 800), np.full(n, p), np.full(n, 3), d, exact
        ).mean()

    assert abs(mean(100) / mean(800) - 1) < 0.25  # of 800 customers: less than 0.2 % of a probability


def brute_scores(docs, learn, d, d0, sweeps=60, burn=20):
    """Scores by a Gibbs sampler that takes away and seats one customer after the other."""
    rng = random.Random(4)
    s = pitman_yor.STRENGTH
    pairs = [(u, w) for doc, on in zip(docs, learn) if on for u, w in zip(["<s>", *doc], doc)]
    kinds = len({w for _, w in pairs})
    seats = defaultdict(list)  # (context, dish) -> sizes of tables; the parent is context 0
    total, tables = Counter(), Counter()

    def chance(u, w):
        own = seats[u, w]
        above = chance(0, w) if u != 0 else 1 / (kinds + 1)
        return (sum(own) - d_of(u) * len(own) + (s + d_of(u) * tables[u]) * above) / (s + total[u])

    def d_of(u):
        return d0 if u == 0 else d

    def add(u, w):
        own = seats[u, w]
        above = chance(0, w) if u != 0 else 1 / (kinds + 1)
        weights = [n - d_of(u) for n in own] + [(s + d_of(u) * tables[u]) * above]
        k = rng.choices(range(len(weights)), weights)[0]
        total[u] += 1
        if k < len(own):
            own[k] += 1
        else:
            own.append(1)
            tables[u] += 1
            if u != 0:
                add(0, w)

    def remove(u, w):
        own = seats[u, w]
        k = rng.choices(range(len(own)), own)[0]
        own[k] -= 1
        total[u] -= 1
        if not own[k]:
            own.pop(k)
            tables[u] -= 1
            if u != 0:
                remove(0, w)

    for u, w in pairs:
        add(u, w)
    needed = sorted({(u, w) for doc in docs for u, w in zip(["<s>", *doc], doc)}, key=str)
    mean = Counter()
    for sweep in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        if sweep >= burn:
            for u, w in needed:
                mean[u, w] += (chance(u, w) if total[u] else chance(0, w)) / (sweeps - burn)
    return [sum(math.log10(mean[u, w]) for u, w in zip(["<s>", *doc], doc)) for doc in docs]


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    follow = {w: [rng.choice(words) for _ in range(4)] for w in words}
    texts = []
    for _ in range(120):
        w, text = rng.choice(words), []
        for _ in range(rng.randint(1, 25)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w]) if rng.random() < 0.8 else rng.choice(words)
        texts.append(" ".join(text))
    texts += [None, "", " \t", "never seen words", "the " * 3000, texts[0], texts[0]]
    return list(enumerate(texts))


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_scores_equal_counts_and_the_plain_sampler(spark, tmp_path):
    rows = corpus()
    table = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], DDL)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r for r in op12_language_scores(spark, str(tmp_path)).collect()}
    assert sorted(found) == [i for i, _ in rows]
    docs = {i: tokens(t) for i, t in rows}
    counts = Counter(w for i, doc in docs.items() if not held(i) for w in doc)
    n, v = sum(counts.values()), len(counts)
    for i, doc in docs.items():
        r = found[i]
        assert r["held_out"] == held(i) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"]) == (len(doc), sum(w in counts for w in doc))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in doc)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    pairs = Counter((u, w) for i, doc in docs.items() if not held(i) for u, w in zip(["<s>", *doc], doc))
    above = Counter(w for _, w in pairs)

    def share(c):
        once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
        return min(0.95, max(0.05, once / max(1, once + 2 * twice)))

    plain = brute_scores([docs[i] for i, _ in rows], [not held(i) for i, _ in rows], share(pairs), share(above))
    for (i, _), score in zip(rows, plain):
        assert abs(found[i]["score"] - score) < 0.1 + 0.05 * abs(score), i
    unseen = [i for i, _ in rows if held(i)]
    assert sum(found[i]["score"] for i in unseen) > sum(found[i]["base_score"] for i in unseen)

    # many chunks and blocks, with a context that blocks share: the same counts, nearly the same scores
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    again = pitman_yor.language_scores(table.repartition(3), learn, chunk_tokens=500, block_tokens=700)
    for r in again.collect():
        one = found[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (one["n_tokens"], one["n_known"], n)
        assert abs(r["base_score"] - one["base_score"]) < 1e-6 * max(1, abs(one["base_score"]))
        assert abs(r["score"] - one["score"]) < 0.1 + 0.05 * abs(one["score"])


@pytest.mark.parametrize("most", [50, 2**62])
def test_numbers_are_ordered_with_their_places(most):
    code = np.random.default_rng(3).integers(0, 50, 1000)
    found, place = pitman_yor.ordered(code, most)  # beyond 64 bits with the place: by a list of places
    order = np.argsort(code, kind="stable")
    assert (found == code[order]).all() and (place == order).all()


def test_a_chunk_holds_a_word_once_and_sends_each_pair_to_one_block(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefgh", [30, 1, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(40)]
    table = spark.createDataFrame([(i, i % 3 > 0, t) for i, t in enumerate(texts)], "doc_id long, learn boolean, text string")
    chunks = table.coalesce(1).mapInArrow(lambda it: pitman_yor._chunks(it, 10_000), pitman_yor.CHUNK).toArrow()
    words = np.frombuffer(chunks["words"][0].as_py(), np.uint64)
    number = np.frombuffer(chunks["tokens"][0].as_py(), np.uint32)
    assert len(words) == len({w for t in texts for w in tokens(t)}) and chunks["ends"][0].values[-1].as_py() == len(number)

    u, count, docs = np.append(words, pitman_yor.START), Counter(), Counter()
    ends = chunks["ends"][0].as_py()
    for d, (a, b) in enumerate(zip(ends, ends[1:])):
        for x, y in zip([len(words), *number[a : b - 1]], number[a:b]):
            pair = int(u[x]), int(words[y])
            count[pair] += d % 3 > 0
            docs[pair, d] += 1
    hot = np.array([words[np.bincount(number).argmax()]], np.uint64)
    plan = pitman_yor.Plan(5, hot, np.array([4], np.uint64))
    found, by_doc, blocks = {}, Counter(), defaultdict(set)
    for part in range(2):
        for batch in pitman_yor._pairs(iter(chunks.to_batches()), plan, True, part, 2):
            for row in batch.to_pylist():
                assert row["dst"] % 2 == part
                contexts, runs, w, n, per_pair, doc, times = pitman_yor.unpack(row["data"])
                pairs = [*zip(np.repeat(contexts, runs).tolist(), w.tolist())]
                assert pairs == sorted(set(pairs)) and not found.keys() & set(pairs)
                found.update(zip(pairs, n.tolist()))
                for (pair, d), k in zip(zip((p for p, m in zip(pairs, per_pair) for _ in range(m)), doc.tolist()), times.tolist()):
                    by_doc[pair, d] += k
                for x, _ in pairs:
                    blocks[x].add(row["dst"])
    assert found == dict(count) and by_doc == docs
    assert len(blocks.pop(int(hot[0]))) > 1 and all(len(b) == 1 for b in blocks.values())


def test_probabilities_of_all_words_add_up_to_one():
    plan = pitman_yor.Plan(1, np.zeros(0, np.uint64), np.zeros(0, np.uint64), kinds=5, root=np.array([[14.0, 6.0]]))
    n, t = np.array([1, 2, 3, 4, 4, 0]), np.array([1, 1, 1, 1, 2, 0])
    assert abs(plan.parent(n, t, 0).sum() - 1) < 1e-12


def test_tables_without_training_texts_or_rows(spark):
    table = spark.createDataFrame([(None, "a b", "", 1, ""), (3, "a", "", 1, "")], DDL)
    rows = pitman_yor.language_scores(table, F.lit(False)).collect()
    assert [r["score"] for r in rows] == [0.0, 0.0] and {r["train_tokens"] for r in rows} == {0}
    assert pitman_yor.language_scores(table.limit(0), F.lit(True)).collect() == []
