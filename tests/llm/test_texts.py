"""Chat formatting, repeated passages, decontamination, pieces, token counts, pages."""

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kicknet.llm import chat, decontam, main_text, pieces, repeats, token_counts
from kicknet.llm.graph import shared_folder
from kicknet.llm.queries import TOKENIZERS, piece_model

LONG = "w " * 300_000


# --- chat --------------------------------------------------------------------------------


def test_chats_come_back(spark):
    rows = [
        (1, 1, "assistant", "a</s>"), (1, 0, "user", "hi [INST] <s> <\\s> <\\\\/s>"), (1, 2, "assistant", None),
        (1, 3, None, "[MORE][TURN]"), (1, 3, None, "[MORE][TURN]"), (2, None, "user", ""),
        (None, 5, "assistant", "é\n日"), (3, 0, "to[TURN]ol", LONG),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chat(df)
    got = {
        r["conv_id"]: r
        for r in out.select(
            "*",
            chat.read_chat(F.col("formatted")).alias("read"),
            chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        ).collect()
    }
    expected = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1])):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert {k: [tuple(t) for t in r["read"]] for k, r in got.items()} == expected
    for k, r in got.items():
        assert r["loss"] == [t for role, t in expected[k] if role == "assistant"]
    assert got[1]["formatted"].count("<s>") == 3  # neighbours of one role are one turn
    assert chat.format_chat(df.limit(0)).collect() == []


# --- repeated passages -------------------------------------------------------------------


def removed(docs, length):
    first = {}
    for d, t in sorted((d, t or "") for d, t in docs if d is not None):
        b = t.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append((d, bytes(x for x, g in zip(b, gone) if not g), len(b)))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot_rows, bits, rounds", [(repeats.HOT_ROWS, repeats.MOST_BITS, 2), (2, 8, 3)])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, hot_rows, bits, rounds):
    monkeypatch.setattr(repeats, "HOT_ROWS", hot_rows)  # the second case salts keys and fills the table
    monkeypatch.setattr(repeats, "SALTS", 3)
    monkeypatch.setattr(repeats.shared_bits, "__defaults__", (bits,))
    rng = random.Random(5)
    pool = [rng.randbytes(rng.randint(20, 160)).hex() for _ in range(12)]
    docs = [(i, "".join(rng.choice(pool)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(70, "ab" * 100), (71, "ab" * 130), (72, "a" * 49), (73, "a" * 49), (74, None), (75, ""), (76, "é日" * 60)]
    docs += [(77, "x" + "é日" * 50), (78, "ab" * 900), (None, pool[0]), (3, docs[9][1]), docs[5]]
    df = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, place int, kept string")
    got = repeats.without_repeats(df.repartition(3), rounds=rounds).collect()
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"]) for r in got), key=str) == removed(docs, 50)
    for r in got:
        assert sum(s["length"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])
    short = {(r["doc_id"], r["place"], r["kept"]) for r in repeats.shortened(df).collect()}
    assert len(short) >= 65 and (76, 1, "k") in short
    assert repeats.without_repeats(df.limit(0)).collect() == []


def test_hot_triggers_give_the_same_strings(spark, monkeypatch):
    rng = random.Random(6)
    passage = rng.randbytes(60).hex()
    docs = [(i, rng.randbytes(20).hex() + passage[i % 7 : 100 - i % 5] + rng.randbytes(9).hex()) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    calls, spread = [], repeats._earlier_strings
    monkeypatch.setattr(repeats, "_earlier_strings", lambda *a: calls.append(a) or spread(*a))
    for hot, crowded in ((2, True), (10**6, False)):
        monkeypatch.setattr(repeats, "HOT_PHRASES", hot)
        calls.clear()
        got = repeats.without_repeats(df.repartition(3)).collect()
        assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"]) for r in got), key=str) == removed(docs, 50)
        assert bool(calls) == crowded


def test_phrases_have_the_first_of_the_smallest_hashes():
    rng = np.random.default_rng(3)
    for k in range(60):
        sizes = rng.integers(0, 150, 4)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = rng.integers(0, (1, 2, 256)[k % 3], offsets[-1]).astype(np.uint8)
        value = repeats.SpanHash(data, 11)(places := np.arange(max(0, len(data) - 19)), places + 20)
        expected, before = [], None
        for row, (begin, end) in enumerate(zip(offsets, offsets[1:])):
            for start in range(begin, end - 49):
                at = start + int(np.argmin(value[start : start + 31]))
                if (row, at) == before:
                    expected[-1][2] += 1
                else:
                    expected.append([row, start, 1, value[at]])
                before = row, at
        assert [list(p) for p in zip(*repeats.phrases(data, offsets))] == expected


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_strings_of_earlier_documents_come_back_as_runs(monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK_ROWS", block)
    # (trigger, document, start, strings); the same string under two triggers is not the same
    rows = [(1, 5, 0, [7, 8, 9]), (1, 6, 40, [1, 8, 9, 7, 2, 9]), (1, 5, 90, [8]), (2, 7, 0, [8, 3]), (3, 1, 2, [4]), (3, 2, 3, [4])]
    bits = 5 << 42
    place = [bits | start << 6 | len(strings) for _, _, start, strings in rows]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([r[0]]), pa.array([r[1]]), pa.array([p]), pa.array([r[3]], pa.list_(pa.int64()))],
            ["h", "doc", "place", "strings"],
        )
        for r, p in zip(rows, place)
    ]
    got = sorted((doc, p) for b in repeats._earlier_runs(iter(batches)) for doc, p in zip(*(c.to_pylist() for c in b.columns)))
    assert got == [(2, bits | 3 << 6 | 1), (6, bits | 41 << 6 | 3), (6, bits | 45 << 6 | 1)]


# --- decontamination ---------------------------------------------------------------------


def test_contaminated_documents_are_found_and_clean_ones_are_not(spark, words):
    rng = random.Random(2)
    items = [(k, " ".join(words(rng.randint(15, 50)))) for k in range(20)] + [(90, None), (91, "too short")]
    docs, expected = [], set()
    for k, text in items[:20]:
        w = text.split()
        changed = list(w)
        changed[4] = "zzzz"
        changed[9] = "yyyy"
        for j, body in enumerate((w, changed, [x.upper() for x in w])):
            docs.append((10 * k + j, " ".join([*words(30), *body, *words(40)])))
            expected.add((10 * k + j, k))
        docs.append((10 * k + 5, " ".join([*words(30), *w[:7], *words(40)])))
    docs += [(900, None), (901, ""), (902, LONG), (None, docs[0][1]), (docs[0][0], docs[0][1])]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, tests).collect()}
    assert found == expected | {(None, 0)}
    kept = {r["doc_id"] for r in decontam.clean(df, tests).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in found}
    assert decontam.contaminated(df, tests.limit(0)).collect() == []
    assert decontam.contaminated(df.limit(0), tests).collect() == []


@pytest.mark.parametrize("first, gap, second", [(20, 15, 20), (40, 30, 40), (60, 45, 60), (100, 70, 100)])
def test_copies_on_both_sides_of_a_replaced_block_are_found(spark, first, gap, second):
    w = [f"w{i}" for i in range(first + gap + second)]
    changed = w[:first] + [f"x{i}" for i in range(gap)] + w[first + gap :]
    df = spark.createDataFrame([(1, " ".join(["before", *changed, "after"]))], "doc_id long, text string")
    tests = spark.createDataFrame([(5, " ".join(w))], "item_id long, text string")
    found = sorted(tuple(r) for r in decontam.contaminated(df, tests).collect())
    assert found == [(1, 5, 1, first, first), (1, 5, 1 + first + gap, second, second)]


def test_stretches_are_those_that_the_rule_asks_for():
    rng = random.Random(4)
    for _ in range(400):
        equal = [rng.random() < rng.choice((0.5, 0.75, 0.9)) for _ in range(rng.randint(0, 40))]
        n = len(equal)
        valid = [
            (s, e) for s in range(n) for e in range(s + 1, n + 1)
            if sum(equal[s:e]) >= 6 and 4 * sum(equal[s:e]) >= 3 * (e - s)
        ]
        got = decontam.stretches(np.array(equal, dtype=bool), 6)
        assert all((s, e) in valid and k == sum(equal[s:e]) for s, e, k in got)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        assert max((k for *_, k in got), default=0) == max((sum(equal[s:e]) for s, e in valid), default=0)
        assert all(any(s < f and b < e for b, f, _ in got) for s, e in valid)


def avoided(masks, need):
    """Whether a stretch with `need` equal tokens, 75 % of all, of any length has no hit.

    The most that equal (+1) and other tokens (-3) can add up to without a hit, by the
    number of equal tokens and the last tokens, until nothing grows any more.
    """
    span = max(map(len, masks))
    states = 1 << (span - 1)
    last = np.arange(2 * states)
    hit = np.any([(last & int(m, 2)) == int(m, 2) for m in masks], axis=0)
    goes = np.arange(states)[~hit[1::2]]
    best = np.full((need + 1, states), -np.inf)
    best[0, 0] = 0
    for _ in range(1000):
        now = best.copy()
        for c in range(need + 1):
            np.maximum.at(now[c], (np.arange(states) << 1) % states, best[c] - 3)
            np.maximum.at(now[min(c + 1, need)], (goes << 1 | 1) % states, best[c, goes] + 1)
        if now[need].max() >= 0:
            return True
        if np.array_equal(now, best):
            return False
        best = now
    return True


def test_masks_hit_every_stretch_that_counts():
    assert avoided(("110110101", "101101011", "111001101"), 12)  # the test can fail
    for least in range(1, 15):
        assert not avoided(decontam.masks_for(1000, least), least)
    for n in range(1, 15):  # items of which fewer are asked for: all patterns
        masks = [int(m, 2) << k for m in decontam.masks_for(n, 12) for k in range(n - len(m) + 1)]
        for bits in range(1 << n):
            if not any(bits & m == m for m in masks):
                equal = np.array([bits >> i & 1 for i in range(n)], dtype=bool)
                assert decontam.stretches(equal, decontam.needed(n, 12)) == []


def test_copies_with_replaced_tokens_and_short_items_are_found(spark):
    replaced = {  # some patterns that three masks of nine tokens do not hit, and short items
        16: (3, 7, 11, 14), 15: (3, 7, 11), 10: (3, 6), 9: (4,), 8: (4,), 7: (3,), 6: (2,), 5: (2,), 4: (), 3: (), 2: (), 1: ()
    }
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in replaced]
    docs = [
        (n, " ".join(["before", *(f"r{i}" if i in out else f"w{n}x{i}" for i in range(n)), "after"]))
        for n, out in replaced.items()
    ]
    docs += [(100 + n, text) for n, text in items] + [(200, "w3x0 w3x1 w2x0 w4x0 r w4x2 w4x3"), (201, "w5x1 w5x2 w5x3 w5x4")]
    found = decontam.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    got = {r["doc_id"]: (r["item_id"], r["n_tokens"], r["n_equal"]) for r in found}
    assert len(got) == len(found)
    assert got == {n: (n, n, n - len(out)) for n, out in replaced.items()} | {100 + n: (n, n, n) for n in replaced} | {201: (5, 4, 4)}


# --- pieces ------------------------------------------------------------------------------

TEXTS = [
    "Hello  world", "  a b ", "a\n\tb", "ﬁ Ⅳ é é 　x", "", " ", "   ", "a▁b", "x\x00y", "日本𠮷", "aaaaaaaaaaaaaaaaaaaa",
    "the the▁▁▁ x ▁", None, LONG,
]


def test_pieces_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    rng = random.Random(1)
    some = ["".join(rng.choice("abcdeit n  the▁éß\n日.") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(TEXTS + some)), "ids long, text string").withColumn("n", F.col("ids"))
    for r in pieces.encode_texts(df, piece_model(), decode=True).collect():
        text = (TEXTS + some)[r["n"]] or ""
        assert r["ids"] == library.encode(text)
        assert r["decoded"] == text.replace("▁", " ")
    assert pieces.encode_texts(df.limit(0), piece_model()).collect() == []


def test_unknown_ids_and_short_merges():
    machine = pieces.compile_model(piece_model())
    with pytest.raises(ValueError):
        machine.decode([40_000])
    for text in ("▁the", "▁▁▁x", "▁inter", "ing"):
        rule = machine._merged(text) or None
        if rule is not None:
            assert machine._free_path(text) == list(rule)


# --- token counts ------------------------------------------------------------------------


def test_counts_of_token_files(spark, tmp_path):
    import numpy as np

    files = {"a": [5, 6, 2, 2, 7, 2], "b": [2], "c": [9, 9, 9], "d": [], "e": [1] * 50 + [2] + [3] * 70}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, "<u2").tobytes())
    expected = {}
    for name, tokens in files.items():
        counts, now = [], 0
        for t in tokens:
            if t == 2:
                counts.append(now)
                now = 0
            else:
                now += 1
        expected[name] = counts + ([now] if now else [])
    for block, whole in [(b, w) for b in (4, 6, 1 << 20) for w in (0, 8, 1 << 20)]:  # by ranges, some so, none
        rows = token_counts.scan_token_files(spark, str(tmp_path), 2, block_bytes=block, whole_file=whole).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r["document"]):
            got.setdefault(r["file"][-1], []).append(r["n_tokens"])
            tokens = files[r["file"][-1]]
            end = r["start"] + r["n_tokens"]
            assert 2 not in tokens[r["start"] : end] and (end == len(tokens) or tokens[end] == 2)
        assert got == {k: v for k, v in expected.items() if v}
    (tmp_path / "odd").write_bytes(b"123")
    with pytest.raises(ValueError):
        token_counts.scan_token_files(spark, str(tmp_path), 2)


def test_a_file_above_two_gigabytes_is_counted_by_many_tasks(spark, tmp_path):
    """Sparse: nothing but zeros, separators where a block ends, begins and beyond 2^31 bytes."""
    import numpy as np

    size, at = 2_200_000_000, [0, (1 << 19) - 1, 1 << 19, 1_099_999_000]  # bytes; places in tokens
    with open(tmp_path / "big", "wb") as f:
        f.truncate(size)
        for place in at:
            f.seek(2 * place)
            f.write(np.array([2], "<u2").tobytes())
    rows = token_counts.scan_token_files(spark, str(tmp_path), 2, block_bytes=1 << 20).orderBy("document").collect()
    edges = [-1, *at, size // 2]
    assert [(r["document"], r["start"], r["n_tokens"]) for r in rows] == [
        (k, a + 1, b - a - 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))
    ]


def test_counts_of_documents(spark):
    texts = [t for t in TEXTS if t != LONG] + ["one two"] * 3
    docs = [(i if i % 5 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, shard int")
    machine = pieces.compile_model(piece_model())
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.document_counts(df, piece_model(), shard_bytes=64).collect())
    assert got == sorted((str(d), len(machine.encode(t))) for d, t in docs)


def test_token_files_go_when_they_are_counted(spark):
    def there():
        return set(Path(shared_folder(spark).removeprefix("file:")).glob("tokens-*"))

    docs = [(i, "one two " * i) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    machine = pieces.compile_model(piece_model())
    before = there()
    for some, shard_bytes in ((df, 1), (df, 16), (df.limit(0), 1)):  # parts without documents, too
        counts = token_counts.document_counts(some, piece_model(), shard_bytes=shard_bytes)
        assert there() == before
        assert sorted((r["doc_id"], r["n_tokens"]) for r in counts.collect()) == [
            (d, len(machine.encode(t))) for d, t in docs if some is df
        ]


# --- pages -------------------------------------------------------------------------------

PAGES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>T</h1><p><b>One &amp; two,\n  three<br><p>Four.</article><footer>F</footer>",
     "T\nOne & two, three\nFour."),
    ('<div class="sidebar"><p>Buy, this, that, and, more, now.</p></div><div class="post"><h1>Title</h1><p>Long enough, '
     'with commas, to be the best of all.</p><p>Short.</p></div><div id="comments"><p>I, too, like, commas, a, lot.</p></div>'
     "<form><p>Sign, up, here</p></form>", "Title\nLong enough, with commas, to be the best of all.\nShort."),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>Yes &lt;b&gt; &#233;</p>", "Yes <b> é"),
    (None, ""), ("", ""), ("plain text", "plain text"), ("<p", "<p"), ("<nav>only</nav>", ""),
    ("<main><p>" + "word, " * 50_000 + "</p></main>", ("word, " * 50_000).strip()),
]


def test_pages_without_an_end_of_the_head():
    for page in (
        "<html><head><title>T</title><meta charset=utf-8><body><p>Some, text.</p></body></html>",
        "<head><link rel=a href=b>\n<script>x</script><div><p>Some, text.</p></div>",
        "<html><head><title>T</title>\n<p>Some, text.",
        "<html><head><title>T</title>\nSome, text.</html>",
        "<html><head><meta name=a></head><body><p>Some, text.</p></body></html>",
    ):
        assert main_text.main_text(page) == "Some, text."


def test_wrappers_that_are_named_like_other_parts_keep_the_article():
    lines = ["words, " * 19 + "words,", "more, text " * 9 + "more, text"]
    text = "".join(f"<p>{line}</p>" for line in lines)
    comments = f"<div id=comments class=comments-area><article><p>{'I, ' * 400}</p></article></div>"
    for name in (
        "class='content has-sidebar'", "class='no-sidebar'", "class='with-menu'", "class='elementor-widget-container'",
        "class='social-science'", "id='search-results'", "class='search'",
    ):
        around = f"<body><div class=nav>Menu</div>%s<div class='site-footer'><p>foot, er</p></div>{comments}</body>"
        for page in (
            around % f"<div {name}>{text}</div>",
            around % f"<div {name}><article class='social'>{text}</article></div>",
            around % f"<main><div {name}>{text}</div><div class=related><article><p>teaser</p></article></div></main>",
            around % f"<article {name}>{text}</article>",
            around % f"<article><p>teaser</p></article><div {name}>{text}</div>" if "search'" in name else around % text,
        ):
            assert main_text.main_text(page) in ("\n".join(lines), "teaser\n" + "\n".join(lines)), page
    parts = "".join(f"<div class='elementor-widget-container'><p>{w}, text</p></div>" for w in "abcde")
    assert main_text.main_text(f"<body>{parts}</body>") == "\n".join(f"{w}, text" for w in "abcde")
    # a longer advert does not take the place of a short article; links under such a name are left out
    page = "<div class=ad>Buy, this, now, please, do.</div><article><p>Short.</p></article>"
    assert main_text.main_text(page) == "Short."
    page = f"<body>{text}<div class=top-news-menu>x <a href=y>Sections, and, links</a></div></body>"
    assert main_text.main_text(page) == "\n".join(lines)


def test_reader_comments_are_left_out():
    line = "words, " * 19 + "words."
    said = "<p>I, too, have, something, to, say.</p>"
    item = "<li><span class=comment-author>Ann</span> <time>May 1</time>" + said
    for inside in (
        f"<div class='user-comments'>{said}</div>", f"<ol class=commentlist>{item}{item}</ol>",
        f"<div id=postComments>{said}</div>", f"<div itemprop=comment>{said}</div>",
        f"<div><div><b class=user>A</b><i class=date>1</i>{said}</div><div><b class=user>B</b><i class=date>2</i>{said}</div></div>",
    ):
        assert main_text.main_text(f"<article><h1>T</h1><p>{line}</p>{inside}</article>") == "T\n" + line, inside
        assert main_text.main_text(f"<div><h1>T</h1><p>{line}</p></div>{inside}") == "T\n" + line, inside
    after = f"<section id=discussion><h2>Discussion</h2>{said * 9}</section>"
    assert main_text.main_text(f"<article><p>{line}</p></article>{after}") == line
    # a section of an article may be called so, and a class may only say that there are comments
    assert main_text.main_text(f"<article><p>{line}</p><section id=discussion><p>{line}</p></section></article>") == f"{line}\n{line}"
    for name in ("has-comments", "comments-open", "commentary", "with-comments"):
        assert main_text.main_text(f"<body><div class={name}><p>{line}</p><p>{line}</p></div></body>") == f"{line}\n{line}"
    bylines = "".join(f"<div><h2>{k}</h2><b class=author>A</b><time>1</time><p>{line}</p></div>" for k in "ab")
    assert main_text.main_text(f"<div>{bylines}</div>").count(line) == 2


@pytest.mark.parametrize(
    "part", ["<a ", "<a '", '<a "', "<div>", "<div>a", "<b><p>", "<b>a</i>", "<!x", "<!--", "</", "<p>x<", "<script>", "<td><b>", "a"]
)
def test_hostile_pages_take_linear_time(part):
    n = 200_000 // len(part)
    for page in (part * n, "<p>Text, here.</p>" + part * n + ">\"'>", f"<a {part * n} b>"):
        start = time.process_time()
        main_text.main_text(page)
        assert time.process_time() - start < 10, part  # quadratic time would be minutes


def test_main_texts(spark):
    for page, text in PAGES:
        assert main_text.main_text(page) == text
    df = spark.createDataFrame([(i, p, "old") for i, (p, _) in enumerate(PAGES)], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in main_text.extract(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(PAGES)}
    assert main_text.extract(df.limit(0)).collect() == []
    deep = "<div>" * 5000 + "<p>deep, text, here</p>"
    assert main_text.main_text(deep) == "deep, text, here"


def test_digest_is_of_the_ids(spark):
    df = spark.createDataFrame([([1, 22],)], "ids array<int>")
    assert df.select(pieces.ids_digest(F.col("ids")).alias("d")).first()["d"] == hashlib.sha256(b"1 22").hexdigest()


def test_passages_too_long_for_a_phrase_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="length has to be"):
        repeats.without_repeats(docs, length=84)
