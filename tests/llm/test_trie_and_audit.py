"""The prefix trie and the filter audit against brute force in plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

from kicknet.llm import filter_audit, prefix_trie
from kicknet.llm.queries_audit import op11_prefix_trie, op13_filter_audit
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string, path string, n_convs long"


def brute_trie(rebuilt):
    """Nodes of {conversation: sequence of (role, text)}."""
    members = defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        parts = [below(c) for c in children[node]]
        return sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts)

    rows = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if rebuilt[c] == node))
        parent = min(members[node[:-1]]) if node else None
        rows.add((min(convs), len(node), parent, len(convs), len(children[node]), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def turn_rows(rng):
    rows = []
    for conv in range(-7, 60):
        first = rng.choice(["hi", "hello", None, ""])
        for turn in range(rng.randint(1, 6)):
            text = first if turn == 0 else rng.choice(["yes", "no", "é" * 3, "x" * 5000])
            rows.append((conv, turn if turn else None, rng.choice(["user", None]) if turn > 2 else "user", text, "clash", 1))
    rows += [(100 + i, 1, "user", "the same", "clash", 1) for i in range(300)]
    for conv, n, odd in ((500, 40, None), (505, 40, 30), (510, 25, None), (515, 60, 59), (520, 60, 59)):
        rows += [(conv, t, "user", "odd" if t == odd else f"turn {t}", "clash", 1) for t in range(n)]
    return rows


def sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        convs[conv].append((-1 if turn is None else turn, role or "", text or ""))
    return {c: tuple((r, t) for _, r, t in sorted(ts, key=lambda x: x[0])) for c, ts in convs.items()}


def test_the_trie_equals_brute_force(spark, tmp_path):
    rows = turn_rows(random.Random(3))
    table = spark.createDataFrame(rows, TURNS)
    own = sequences(rows)
    assert {tuple(r) for r in prefix_trie.conversation_trie(table).collect()} == brute_trie(own)

    table.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "conversations.parquet"))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (c % 5 if c >= 0 else -((-c) % 5))
        rebuilt[c] = own.get(donor, ())[:h] + turns[h:]
    found = op11_prefix_trie(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == brute_trie(rebuilt)
    assert len(found) == len(set(found))


def test_the_trie_of_few_rows(spark):
    empty = prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).collect()
    nothing = hashlib.sha256().hexdigest()
    assert [tuple(r) for r in empty] == [(None, 0, None, 0, 0, 1, 0, nothing)]
    rows = [(None, 1, "user", "lost", "", 1), (5, 1, "user", "a", "", 1), (5, 1, "user", "a", "", 1)]
    nodes = prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(r["depth"] for r in nodes) == [0, 1, 2]  # repeated rows are turns of their own


def test_ids_of_many_runs_are_digested_in_order(spark):
    ids = spark.range(0, 30000, 3).select(F.lit(b"n").alias("node"), (F.col("id") - 9000).alias("conv_id"))
    text = ",".join(str(i - 9000) for i in range(0, 30000, 3))
    assert prefix_trie.end_digests(ids.repartition(7)).first()["ends_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_audit(docs, labels):
    texts = [(d, (lang or ""), t or "") for d, t, lang, *_ in docs]
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    rows = defaultdict(lambda: [0] * 7)
    fails = []
    for d, part, t in texts:
        w = word_list(t)
        failed = ""
        failed += "A" * (len(w) < 200)
        failed += "B" * (100 * len(set(w)) < 50 * len(w))
        failed += "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        failed += "D" * bool(re.search(r"[#$%&*|]", t))
        failed += "E" * (d is not None and any(o is not None and o < d and s == t for o, _, s in texts))
        fails.append((d, part, failed))
    for order in permutations("ABCDE"):
        for k in range(5):
            for d, part, failed in fails:
                row = rows[part, "".join(order), k + 1]
                gone = any(f in failed for f in order[:k])
                bad = order[k] in failed
                row[0] += not bad and not gone
                row[1] += bad and not gone
                row[2] += bad and gone
                row[3] += failed == order[k]
                row[4] += bad and not gone and d is not None and d in good
                row[5] += bad and not gone and d is not None and d in toxic
    for (part, order, step), row in rows.items():
        row[6] = sum(rows[part, o, s][1] for p, o, s in list(rows) if p == part and o[s - 1] == order[step - 1])
    return {(*key, *row) for key, row in rows.items()}


DOCS = "doc_id long, text string, lang string, mask string, h int, part int"


def audit_docs(rng):
    words = ["alpha", "Beta", "gamma#", "delta", "EPS", "zeta", "é"]
    docs = []
    for i in range(60):
        n = rng.choice([0, 3, 150, 260])
        text = " ".join(rng.choice(words[:rng.randint(1, 7)]) + str(rng.randint(0, rng.choice([1, 400]))) for _ in range(n))
        docs.append((i, text, rng.choice(["en", "de", None, ""]), "x", 1, 1))
    docs += [(100 + i, "a copy of a text", "en", "x", 1, 1) for i in range(40)]
    docs += [(7, "a copy of a text", "de", "x", 1, 1), (7, "a copy of a text", "de", "x", 1, 1)]
    docs += [(None, "a copy of a text", "en", "x", 1, 1), (None, None, "en", "x", 1, 1), (200, "w " * 90000, "fr", "x", 1, 1)]
    return docs


def test_the_audit_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    docs = audit_docs(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)]
    labels += [(8, 1, 1), (8, 0, 0), (None, 1, 1)]
    table, known = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    expected = brute_audit(docs, labels)
    assert {tuple(r) for r in filter_audit.audit(table, known).select(*columns).collect()} == expected
    table.write.parquet(str(tmp_path / "documents.parquet"))
    known.write.parquet(str(tmp_path / "labels.parquet"))
    assert {tuple(r) for r in op13_filter_audit(spark, str(tmp_path)).select(*columns).collect()} == expected
    assert filter_audit.audit(table.limit(0), known).count() == 0


def test_the_sketch_clears_only_lone_texts(spark):
    hashes = spark.range(4000).select(F.xxhash64(F.col("id") % 3000).alias("h"))
    counts = hashes.groupBy("h").count()
    for bits in (16, 18):  # crowded and roomy
        sketch = filter_audit.lone_counters(hashes, bits)
        seen = filter_audit.with_possible_repeats(hashes, sketch, bits).join(counts, "h")
        assert seen.where("count > 1 and not repeats").count() == 0
        cleared = seen.where("not repeats").count()
        assert cleared > (1500 if bits == 16 else 1900)
