"""Language-model scores of texts by a hierarchical Pitman-Yor model of word pairs.

Every word is a context with a restaurant of its own. Its customers are the tokens that
follow it in training texts, the dish of a table is the word its customers are. A new table
sends one customer to the restaurant that all contexts share as their parent, whose
customers are thus the tables below it and whose own base is uniform over the V known words
and one unknown. With c customers and t tables of a dish among c., t. of the restaurant,

    P(w | u) = (c - d t + (strength + d t.) P(w)) / (strength + c.)

and the same above with the uniform base. The discounts d come from the numbers of
kinds seen once and twice, on each level.

Seating is sampled by Gibbs. A step draws the number of tables of one dish in one
restaurant from its exact distribution given all other tables (seatings of the same
number are summed by generalised Stirling numbers), with the dishes of a restaurant in two
halves. A dish with more than `EXACT` customers seats the first `EXACT` so and the
others by the restaurant's rule, in steps of 1/64 of those seated. Sweeps start from one
table a dish; after `BURN` of them each sweep is a sample, and the predictive
probabilities of `SAMPLES` samples are averaged. During the sweeps the parent's
probabilities are those of the start; each sample then gets a parent of its own,
seated from its tables.

How the work is spread: texts become chunks of word hashes and numbers of words, written once. A chunk's
distinct word pairs go to *blocks* of contexts, and what a block has to know of words in the
parent comes from *owners* of words; both are numbers of equal size that grow with the corpus.
Pairs are packed into one binary value per chunk and block, which Spark shuffles.
A context with more than a quarter of a block's tokens (a third of all words may be the same)
is dealt over as many blocks as its share is worth by its pairs; its totals are then
added up over these blocks. Nothing but sums and these few totals reaches the driver,
and every pair, however rare, is kept and counted.

Texts are lower-cased (A-Z); tokens are the words `[^\\x20\\x09-\\x0D]+` and one end. Null and
empty texts have the end alone. A null id counts as not held out. Repeated rows are texts
of their own. Other columns are ignored. Without training texts every probability is 1; a
table without rows gives none. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kicknet.llm.graph import cut, drop
from kicknet.llm.texts import LOWER, SpanHash, int64, mix, slices, values, word_spans

CHUNK_TOKENS, BLOCK_TOKENS = 600_000, 1_500_000
STRENGTH, BURN, SAMPLES, EXACT = 1.0, 3, 3, 200
START, END = values(61, 2)

ROW = "kind int, dst long, src long, data binary, sums array<double>"
PAIRS, WORDS, STATE, SHARED, SUMS = range(5)  # kinds of rows


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for kind, size in head.tolist():
        dtype = np.dtype(chr(kind))
        out.append(np.frombuffer(data, dtype, size, at))
        at += size * dtype.itemsize
    return out


def small(array: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as they need."""
    return array.astype(np.min_scalar_type(int(array.max(initial=0))))


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kind, dst, src, data, sums = zip(*rows) if rows else ((),) * 5
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), t) for c, t in zip((kind, dst, src, data, sums), types)],
        ["kind", "dst", "src", "data", "sums"],
    )


# -- chunks of tokens ---------------------------------------------------------------------

CHUNK = (
    "chunk long, ids array<long>, learn array<boolean>, ends array<long>, words binary,"
    " tokens binary, often array<long>, often_n array<long>"
)

CHUNK_COLUMNS = ["chunk", "ids", "learn", "ends", "words", "tokens", "often", "often_n"]


def _contexts(tokens: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    """The token before each; `start` at the start of a text."""
    u = np.empty_like(tokens)
    u[1:] = tokens[:-1]
    u[ends[:-1]] = start
    return u


def ordered(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below `most` in order, and the place each had; equal ones stay in order.

    Number and place are sorted as one value where they fit, several times as fast as by a list of places.
    """
    bits = len(code).bit_length()
    if int(most).bit_length() + bits > 64:
        order = np.argsort(code, kind="stable")
        return code[order], order
    both = (code.astype(np.uint64) << np.uint64(bits)) | np.arange(len(code), dtype=np.uint64)
    both.sort()
    place = (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    both >>= np.uint64(bits)
    return both.astype(np.int64), place


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Tokens of (doc_id, learn, text) rows, about `most` together: hashes of words and their numbers."""
    part = TaskContext.get().partitionId()
    made, parts, size = 0, [], 0

    def chunk() -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        tokens = tokens.astype(np.uint32)
        ends = np.concatenate([[0], np.cumsum(np.concatenate([p[3] for p in parts]))])
        n = np.bincount(_contexts(tokens, ends, len(words)), minlength=len(words) + 1)
        many = n * 10_000 >= len(tokens)
        row = [
            pa.array([(part << 32) + made]),
            pa.array([[x for p in parts for x in p[0].to_pylist()]], pa.list_(pa.int64())),
            pa.array([[x for p in parts for x in p[1].to_pylist()]], pa.list_(pa.bool_())),
            pa.array([ends], pa.list_(pa.int64())),
            pa.array([words.tobytes()], pa.binary()),
            pa.array([tokens.tobytes()], pa.binary()),
            pa.array([np.append(words, START)[many].view(np.int64)], pa.list_(pa.int64())),
            pa.array([n[many]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(row, CHUNK_COLUMNS)

    for rows, data, offsets in slices(batches):
        low = LOWER[data]
        start, end, row = word_spans(low, offsets)
        n = np.bincount(row, minlength=rows.num_rows) + 1
        tokens = np.full(len(start) + rows.num_rows, END)
        if len(start):
            tokens[np.arange(len(start)) + row] = SpanHash(low, 61)(start, end)
        parts.append((rows.column(0), rows.column(1), tokens, n))
        size += len(tokens)
        if size >= most:
            yield chunk()
            made, parts, size = made + 1, [], 0
    if parts:
        yield chunk()


# -- what is known on the way -------------------------------------------------------------


@dataclass
class Plan:
    """Numbers that all tasks share; every list is bounded by the number of blocks."""

    blocks: int
    heavy: np.ndarray  # contexts that several blocks share, sorted
    spread: np.ndarray  # and over how many
    tokens: float = 0.0  # in training
    kinds: float = 0.0
    discount: float = 0.5
    root_discount: float = 0.5
    root: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # samples x (customers, tables)
    shared: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # heavy x (customers, tables...)

    def place(self, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether contexts are heavy, and where in the list."""
        if not len(self.heavy):
            return np.zeros(len(array), bool), np.zeros(len(array), np.int64)
        at = np.minimum(np.searchsorted(self.heavy, array), len(self.heavy) - 1)
        return self.heavy[at] == array, at

    def shares(self, words: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which share of a context each pair is in, by (block, context); blocks and contexts of the shares.

        `u` and `w` are numbers in `words`. A context is one share; if heavy, one in each of its blocks.
        """
        n = np.uint64(self.blocks)
        heavy, at = self.place(words)
        size = np.ones(len(words), np.int64)
        if heavy.any():
            size[heavy] = self.spread[at[heavy]]
        first = np.cumsum(size) - size
        share = first[u]
        if heavy.any():
            on = np.flatnonzero(heavy[u])
            own = mix(mix(words[u[on]]) ^ words[w[on]]) % size[u[on]].astype(np.uint64)
            share[on] += own.astype(np.int64)
        context = np.repeat(words, size)
        step = (np.arange(len(context)) - np.repeat(first, size)).astype(np.uint64)
        block = ((mix(context ^ values(62, 1)) % n + step) % n).astype(np.int64)
        order = np.lexsort((context, block))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank[share], block[order], context[order]

    def owner(self, w: np.ndarray) -> np.ndarray:
        return (mix(w ^ values(63, 1)) % np.uint64(self.blocks)).astype(np.int64)

    def parent(self, n: np.ndarray, t: np.ndarray, sample: int) -> np.ndarray:
        """Probabilities in the shared restaurant of words with n customers and t tables."""
        d, (customers, tables) = self.root_discount, self.root[sample]
        return (n - d * t + (STRENGTH + d * tables) / (self.kinds + 1)) / (STRENGTH + customers)


def _bounds(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal numbers, and one past the last."""
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(of))


def _pairs(
    batches: Iterator[pa.RecordBatch], plan: Plan, documents: bool, part: int, parts: int
) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct pairs for each block: contexts and run lengths, words, training counts.

    With `documents`, also which documents of the chunk have the pair, and how often.
    Only blocks whose number is `part` modulo `parts` are served.
    """
    for batch in batches:
        for r in range(batch.num_rows):
            c = {name: batch.column(name)[r] for name in ("chunk", "learn", "ends", "words", "tokens")}
            words = np.frombuffer(c["words"].as_buffer(), np.uint64)
            w = np.frombuffer(c["tokens"].as_buffer(), np.uint32)
            ends = c["ends"].values.to_numpy()
            learn = c["learn"].values.to_numpy(zero_copy_only=False)
            share, blocks, contexts = plan.shares(np.append(words, START), _contexts(w, ends, len(words)), w)
            doc = np.repeat(np.arange(len(learn), dtype=np.uint32), np.diff(ends))
            if parts > 1:
                on = np.flatnonzero((blocks % parts == part)[share])
                share, w, doc = share[on], w[on], doc[on]
            if not len(w):
                continue
            code, order = ordered(share * len(words) + w, len(contexts) * len(words))
            doc = doc[order]  # in order within a pair
            new = np.ones(len(code), bool)
            new[1:] = code[1:] != code[:-1]
            at = np.flatnonzero(new)
            share, w = np.divmod(code[at], len(words))
            count = np.add.reduceat(learn[doc].astype(np.uint32), at, dtype=np.uint32)
            links = new.copy()
            links[1:] |= doc[1:] != doc[:-1]
            link = np.flatnonzero(links)
            times = np.diff(np.append(link, len(code))).astype(np.uint32)
            per_pair = np.add.reduceat(links.astype(np.uint32), at, dtype=np.uint32)
            link_ends = np.concatenate([[0], np.cumsum(per_pair, dtype=np.int64)])
            rows = []
            pu, pw, pb = contexts[share], words[w], blocks[share]
            for a, b in zip(*_bounds(pb)):
                first, last = _bounds(pu[a:b])
                arrays = [pu[a:b][first], small(last - first), pw[a:b], small(count[a:b])]
                if documents:
                    x, y = link_ends[a], link_ends[b]
                    arrays += [small(per_pair[a:b]), small(doc[link[x:y]]), small(times[x:y])]
                rows.append((PAIRS, int(pb[a]), c["chunk"].as_py(), pack(*arrays), None))
            yield _out(rows)


# -- seating ------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of a discount, c and t to `most`."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            grown = table[c] + np.log(np.maximum(c - t * discount, 0))
            grown[t > c] = -np.inf
            if c == 0:
                grown[:] = -np.inf
            table[c + 1] = np.logaddexp(np.concatenate([[-np.inf], table[c][:-1]]), grown)
    return table


def _favour(seated, c, tables, p, others, discount):
    """How much likelier the customers after the first `seated` of c are with one table more.

    Their weights add up to about Gamma(c + a - b t) / Gamma(seated + a - b t), t tables.
    """
    b = discount * (1 - p)
    shift = p * (STRENGTH + discount * others) - b * tables
    return ((seated + shift) / (c + shift)) ** b


def sample_tables(
    rng: np.random.Generator,
    c: np.ndarray,
    p: np.ndarray,
    others: np.ndarray,
    discount: float,
    exact: int = EXACT,
) -> np.ndarray:
    """Numbers of tables for dishes with c customers and parent's probability p.

    `others` are the tables of the restaurant's other dishes.
    """
    out = np.minimum(c, 1).astype(np.int64)
    table = log_stirling(discount, exact)
    order = np.argsort(c, kind="stable")
    order = order[c[order] > 1]
    size = np.minimum(c[order], exact)
    for a, b in zip(*_bounds(size)):
        n = int(size[a])
        tables = np.arange(1, n + 1)
        step = max(1, 500_000 // n)
        for at in range(a, b, step):
            own = order[at : min(b, at + step)]
            opened = np.cumsum(np.log(STRENGTH + discount * (others[own, None] + tables - 1)), axis=1)
            weight = table[n, 1 : n + 1] + tables * np.log(p[own, None]) + opened
            if n == exact:  # what the customers still to come say about the number of tables
                weight += tables * np.log(_favour(n, c[own, None], tables, p[own, None], others[own, None], discount))
            weight -= weight.max(axis=1, keepdims=True)
            total = np.cumsum(np.exp(weight), axis=1)
            drawn = rng.random(len(own)) * total[:, -1]
            out[own] = 1 + (total < drawn[:, None]).sum(axis=1)
    large = np.flatnonzero(c > exact)
    seated = np.full(len(large), exact, np.int64)
    while len(large):
        step = np.minimum(np.maximum(1, seated // 64), c[large] - seated)
        new = p[large] * (STRENGTH + discount * (others[large] + out[large]))
        new *= _favour(seated, c[large], out[large], p[large], others[large], discount)
        out[large] += rng.binomial(step, new / (new + seated - discount * out[large]))
        seated += step
        left = seated < c[large]
        large, seated = large[left], seated[left]
    return out


@dataclass
class Block:
    """The restaurants of a block: pairs sorted by (context, word)."""

    c: np.ndarray  # customers of each pair
    of: np.ndarray  # number of the pair's context
    contexts: np.ndarray
    words: np.ndarray  # distinct, by (owner, word)
    word: np.ndarray  # number of the pair's word
    bounds: list[tuple[int, int, int]]  # (owner, start, end) in words
    messages: list[tuple[int, np.ndarray, list[np.ndarray]]]  # chunk, number of each of its pairs, links


def read_block(rows: pa.Table, plan: Plan) -> Block:
    messages, u, runs, w, c = [], [], [], [], []
    for kind, src, data in zip(rows["kind"].to_pylist(), rows["src"].to_pylist(), rows["data"]):
        if kind == PAIRS:
            contexts, run, words, count, *links = unpack(data.as_buffer())
            messages.append((src, links))
            u.append(contexts)
            runs.append(run)
            w.append(words)
            c.append(count)
    sizes = [len(x) for x in w]
    contexts, of = np.unique(np.concatenate(u), return_inverse=True)
    words, word = np.unique(np.concatenate(w), return_inverse=True)
    of = np.repeat(of, np.concatenate(runs))
    code, order = ordered(of * len(words) + word, len(contexts) * len(words))
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    number = np.empty(len(code), np.int64)
    number[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    c = np.add.reduceat(np.concatenate(c).astype(np.int64)[order], at)
    of, word = np.divmod(code[at], len(words))
    owner = plan.owner(words)
    by_owner = np.lexsort((words, owner))
    rank = np.empty(len(words), np.int64)
    rank[by_owner] = np.arange(len(words))
    first, last = _bounds(owner[by_owner])
    bounds = [(int(owner[by_owner[a]]), int(a), int(b)) for a, b in zip(first, last)]
    split = np.split(number, np.cumsum(sizes)[:-1])
    return Block(
        c, of, contexts, words[by_owner], rank[word], bounds,
        [(src, n, links) for (src, links), n in zip(messages, split)],
    )


def _replies(rows: pa.Table, block: Block, columns: int) -> list[np.ndarray]:
    """What the owners say of the block's words."""
    found = {
        src: unpack(data.as_buffer())
        for kind, src, data in zip(rows["kind"].to_pylist(), rows["src"].to_pylist(), rows["data"])
        if kind == WORDS
    }
    return [np.concatenate([found[owner][i] for owner, _, _ in block.bounds]) for i in range(columns)]


def _to_owners(key: int, block: Block, columns: list[np.ndarray]) -> list[tuple]:
    sums = [np.bincount(block.word, x, minlength=len(block.words)).astype(np.int64) for x in columns]
    return [
        (WORDS, owner, key, pack(block.words[a:b], *(s[a:b] for s in sums)), None)
        for owner, a, b in block.bounds
    ]


def _totals(block: Block, x: np.ndarray) -> np.ndarray:
    return np.bincount(block.of, x, minlength=len(block.contexts))


def _shared_rows(block: Block, plan: Plan, totals: list[np.ndarray]) -> list[tuple]:
    """The block's part of contexts that several blocks share."""
    heavy, _ = plan.place(block.contexts)
    return [
        (SHARED, 0, int(block.contexts[i : i + 1].view(np.int64)[0]), None, [float(t[i]) for t in totals])
        for i in np.flatnonzero(heavy)
    ]


def _with_shared(block: Block, plan: Plan, totals: np.ndarray, column: int) -> np.ndarray:
    """Totals of contexts over all blocks."""
    heavy, at = plan.place(block.contexts)
    return np.where(heavy, plan.shared[at, column], totals) if heavy.any() else totals


def count_block(key: int, rows: pa.Table, plan: Plan) -> list[tuple]:
    """Start: one table a dish."""
    block = read_block(rows, plan)
    tables = np.minimum(block.c, 1)
    sums = [float((block.c == 1).sum()), float((block.c == 2).sum())]
    return [
        *_to_owners(key, block, [block.c, tables]),
        *_shared_rows(block, plan, [_totals(block, block.c), _totals(block, tables)]),
        (SUMS, 0, 0, None, sums),
    ]


def seat_block(key: int, rows: pa.Table, plan: Plan) -> list[tuple]:
    """Gibbs sweeps over the block's restaurants."""
    block = read_block(rows, plan)
    _, n = _replies(rows, block, 2)
    p = plan.parent(n, np.minimum(n, 1), 0)[block.word]
    rng = np.random.default_rng([97, key])
    t = np.minimum(block.c, 1)
    start = _totals(block, t)
    elsewhere = _with_shared(block, plan, start, 1) - start  # tables of shared contexts in other blocks
    several = np.flatnonzero(block.c > 1)
    of = block.of[several]
    fixed = start - np.bincount(of, t[several], minlength=len(start)) + elsewhere  # tables of the other dishes
    samples = []
    for sweep in range(BURN + SAMPLES):
        half = rng.random(len(several)) < 0.5
        for own in (several[half], several[~half]):
            tables = fixed + np.bincount(of, t[several], minlength=len(start))
            t[own] = sample_tables(rng, block.c[own], p[own], tables[block.of[own]] - t[own], plan.discount)
        if sweep >= BURN:
            samples.append(t.copy())
    return [
        *_to_owners(key, block, [block.c, *samples]),
        *_shared_rows(block, plan, [_totals(block, x) for x in (block.c, *samples)]),
        (STATE, key, 0, pack(*(x[several].astype(np.uint32) for x in samples)), None),
    ]


def score_block(key: int, rows: pa.Table, plan: Plan) -> list[tuple]:
    """Sums over the block's pairs for each document of each chunk."""
    block = read_block(rows, plan)
    replies = _replies(rows, block, 1 + 2 * SAMPLES)
    state = next(d for k, d in zip(rows["kind"].to_pylist(), rows["data"]) if k == STATE)
    several = np.flatnonzero(block.c > 1)
    customers = _with_shared(block, plan, _totals(block, block.c), 0)
    mean = np.zeros(len(block.c))
    for s, seated in enumerate(unpack(state.as_buffer())):
        t = np.minimum(block.c, 1)
        t[several] = seated
        tables = _with_shared(block, plan, _totals(block, t), 1 + s)
        above = plan.parent(replies[1 + s], replies[1 + SAMPLES + s], s)[block.word]
        weight = (STRENGTH + plan.discount * tables)[block.of] * above
        own = (block.c - plan.discount * t + weight) / (STRENGTH + customers[block.of])
        mean += np.where(customers[block.of] > 0, own, above)
    score = np.log10(mean / SAMPLES)
    known = replies[0][block.word]
    base = np.log10((known + 1) / (plan.tokens + plan.kinds + 1))
    out = []
    for chunk, number, (per_pair, doc, times) in block.messages:
        pair = np.repeat(number, per_pair)
        docs = np.flatnonzero(np.bincount(doc))
        sums = [np.bincount(doc, times * x[pair])[docs] for x in (score, base, known > 0)]
        out.append((PAIRS, chunk, key, pack(docs, *sums), None))
    return out


def merge_words(key: int, rows: pa.Table, plan: Plan, sampled: bool) -> list[tuple]:
    """An owner's words: sums over blocks, tables in the parent, and what blocks ask for."""
    senders = [(src, unpack(d.as_buffer())) for src, d in zip(rows["src"].to_pylist(), rows["data"])]
    words, number = np.unique(np.concatenate([a[0] for _, a in senders]), return_inverse=True)
    columns = len(senders[0][1]) - 1
    sums = [
        np.bincount(number, np.concatenate([a[1 + i] for _, a in senders]), minlength=len(words)).astype(np.int64)
        for i in range(columns)
    ]
    stats = [float(sums[0].sum()), float((sums[0] > 0).sum())]
    if sampled:
        rng = np.random.default_rng([98, key])
        p = np.full(len(words), 1 / (plan.kinds + 1))
        seated = []
        for n in sums[1:]:
            t = np.minimum(n, 1)
            seated.append(sample_tables(rng, n, p, plan.root[0, 1] - t, plan.root_discount))
            stats += [float(n.sum()), float(seated[-1].sum())]
        sums += seated
    else:
        stats += [float(sums[1].sum()), float((sums[1] > 0).sum()), float((sums[1] == 1).sum()), float((sums[1] == 2).sum())]
    out: list[tuple] = [(SUMS, 0, 0, None, stats)]
    ends = np.cumsum([len(a[0]) for _, a in senders])
    for (src, _), n in zip(senders, np.split(number, ends[:-1])):
        out.append((WORDS, src, key, pack(*(s[n].astype(np.uint32 if s.max(initial=0) < 2**32 else np.uint64) for s in sums)), None))
    return out


# -- stages -------------------------------------------------------------------------------


def _stage(rows: DataFrame, run, *args) -> DataFrame:
    """Runs a function on the rows of each block or owner; the result is written."""

    def task(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_out(run(key[0].as_py(), table, *args))])

    return rows.groupBy("dst").applyInArrow(task, ROW)


def _sums(rows: DataFrame, n: int) -> list[float]:
    """Element-wise sums of the rows that hold sums."""
    only = rows.where(F.col("kind") == SUMS)
    found = only.agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(n)]).first()
    return [float(x) for x in found]


def _shared(rows: DataFrame, plan: Plan, n: int) -> np.ndarray:
    """Totals of the contexts that several blocks share, in the plan's order."""
    if not len(plan.heavy):
        return np.zeros((0, n))
    only = rows.where(F.col("kind") == SHARED)
    found = only.groupBy("src").agg(*[F.sum(F.col("sums")[i]) for i in range(n)]).collect()
    out = np.zeros((len(plan.heavy), n))
    for r in found:
        out[np.searchsorted(plan.heavy, np.array([r[0]], np.int64).view(np.uint64)[0])] = [r[1 + i] for i in range(n)]
    return out


def _share(once: float, twice: float) -> float:
    return round(min(0.95, max(0.05, once / max(1.0, once + 2 * twice))), 3)


def _final(rows: pa.Table) -> pa.Table:
    """Sums of a chunk's documents."""
    own = rows.filter(pc.is_valid(rows["ids"]))
    ids, learn = own["ids"][0].values, own["learn"][0].values
    ends = own["ends"][0].values.to_numpy()
    sums = np.zeros((3, len(ids)))
    for data in rows["data"]:
        if data.is_valid:
            docs, *parts = unpack(data.as_buffer())
            for total, x in zip(sums, parts):
                np.add.at(total, docs, x)
    return pa.table(
        {
            "doc_id": ids,
            "held_out": pc.invert(learn),
            "n_tokens": pa.array(np.diff(ends)),
            "n_known": pa.array(np.rint(sums[2]).astype(np.int64)),
            "base_score": pa.array(sums[1]),
            "score": pa.array(sums[0]),
        }
    )


def language_scores(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Texts for which `learn` is true or null are learned from. `base_score` is that of
    single words with one added to each count, `score` the model's; both are log10.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(learn, F.lit(True)).alias("learn"),
        F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    chunks = cut(rows.mapInArrow(lambda it: _chunks(it, chunk_tokens), CHUNK))
    tokens = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    blocks = max(1, -(-tokens // block_tokens))
    often = (
        chunks.select(F.inline(F.arrays_zip(F.col("often").alias("u"), F.col("often_n").alias("n"))))
        .groupBy("u")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") * 4 * blocks >= tokens)
        .collect()
        if blocks > 1
        else []
    )
    heavy = np.array([r["u"] for r in often], np.int64).view(np.uint64)
    spread = np.array([min(blocks, 1 + 2 * r["n"] * blocks // tokens) for r in often], np.uint64)
    plan = Plan(blocks, heavy[np.argsort(heavy)], spread[np.argsort(heavy)])

    def pairs(plan: Plan, documents: bool = False, part: int = 0, parts: int = 1) -> DataFrame:
        return chunks.select("chunk", "learn", "ends", "words", "tokens").mapInArrow(
            lambda it: _pairs(it, plan, documents, part, parts), ROW
        )

    def of_kind(df: DataFrame, kind: int) -> DataFrame:
        return df.where(F.col("kind") == kind)

    counted = cut(_stage(pairs(plan), count_block, plan))
    plan.discount = _share(*_sums(counted, 2))
    plan.shared = _shared(counted, plan, 2)
    asked = cut(_stage(of_kind(counted, WORDS), merge_words, plan, False))
    drop(counted)
    plan.tokens, plan.kinds, customers, tables, once, twice = _sums(asked, 6)
    plan.root_discount = _share(once, twice)
    plan.root = np.array([[customers, tables]])

    seated = cut(_stage(pairs(plan).unionByName(of_kind(asked, WORDS)), seat_block, plan))
    drop(asked)
    answers = cut(_stage(of_kind(seated, WORDS), merge_words, plan, True))
    plan.shared = _shared(seated, plan, 1 + SAMPLES)
    plan.root = np.array(_sums(answers, 2 + 2 * SAMPLES)[2:]).reshape(SAMPLES, 2)

    # half of the blocks at a time: rows with documents are the largest that are shuffled
    scored = []
    for part in range(2):
        known = of_kind(answers, WORDS).unionByName(of_kind(seated, STATE)).where(F.col("dst") % 2 == part)
        sums = _stage(pairs(plan, True, part, 2).unionByName(known), score_block, plan)
        scored.append(cut(sums.select(F.col("dst").alias("chunk"), "data")))
    drop(answers, seated)
    scored = scored[0].unionByName(scored[1])
    meta = chunks.select("chunk", "ids", "learn", "ends")
    final = meta.unionByName(scored, allowMissingColumns=True).groupBy("chunk").applyInArrow(
        _final,
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return final.withColumn("train_tokens", F.lit(int(plan.tokens)).cast("long"))
