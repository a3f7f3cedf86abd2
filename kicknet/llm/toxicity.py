"""Toxicity by a linear-chain conditional random field over words.

Words (runs of letters, A-Z lower-cased) carry a tag, toxic or not. Features of a word
are itself and its first 3 to 10 bytes, hashed; neighbouring tags are tied by transition
weights. Sequences are sentences, or 64 words of a longer one.

Labels are given for documents, so words are labelled first: the fewest features
that explain the toxic documents of the sample and hardly occur in clean ones mark
words of toxic documents; all other words are clean. The field is then fitted to these
sequences by the gradient of its log-likelihood. The sample is bounded: at most
`SAMPLE` documents of each label, near copies once.

A text is scored whole: forward-backward gives each word's marginal, and the score is
the probability that at least one word whose marginal is 0.1 or more is toxic. Spans
are runs of words with a marginal of at least 0.5, as byte offsets. Null, empty and
wordless texts have the score 0 and no spans. Without any toxic label every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kicknet.llm.labelled import sample
from kicknet.llm.texts import CHUNK_BYTES, LOWER, SpanHash, slices, values

SAMPLE = 1500
FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6, 7, 8, 10)
LONGEST = 64
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 8, 300, 2048, 0.1, 1e-4
NOTABLE, SPAN_AT = 0.1, 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Words:
    """Words of some texts, one after the other, and their sequences."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    features: np.ndarray  # words x kinds of features
    sequence: np.ndarray  # sequence of each word
    place: np.ndarray  # place of each word in its sequence


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = LOWER[data]
    inside = _LETTER[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros((0, 1 + len(PREFIXES)), np.int32), none, none)
    spans = SpanHash(low, 41)
    index = np.empty((len(start), 1 + len(PREFIXES)), dtype=np.int32)
    for i, k in enumerate((0, *PREFIXES)):
        hashes = spans(start, np.minimum(end, start + k) if k else end) ^ values(50 + k, 1)[0]
        index[:, i] = hashes >> np.uint64(64 - FEATURE_BITS)
    stops = np.concatenate([[0], np.cumsum(_STOP[low])])
    group = stops[start] + row  # both only grow
    new = np.ones(len(start), dtype=bool)
    new[1:] = group[1:] != group[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(start)), 0))
    place = np.arange(len(start)) - first
    new |= place % LONGEST == 0
    return Words(start, end, row, index, np.cumsum(new) - 1, place % LONGEST)


@dataclass
class Field:
    """Weights: of features for the toxic tag, and of (tag, next tag)."""

    weights: np.ndarray
    steps: np.ndarray  # 2 x 2
    first: float  # of a sequence that begins toxic

    def marginals(self, words: Words, pairs: np.ndarray | None = None) -> np.ndarray:
        """Probability of the toxic tag for each word; `pairs` gets the sums over steps."""
        p = np.zeros(len(words.row))
        if not len(p):
            return p
        emit = np.exp(np.clip(self.weights[words.features].sum(axis=1), -30, 30))
        n = int(words.sequence[-1]) + 1
        length = np.bincount(words.sequence, minlength=n)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        step = np.exp(self.steps)
        top = int(length[0])
        active = [int(np.searchsorted(-length, -t)) for t in range(top)]  # longer than t
        front = []
        a0, a1 = np.ones(n), np.full(n, np.exp(self.first))
        for t in range(top):
            k = active[t]
            if t:
                a0, a1 = (
                    a0[:k] * step[0, 0] + a1[:k] * step[1, 0],
                    a0[:k] * step[0, 1] + a1[:k] * step[1, 1],
                )
            a1 = a1[:k] * emit[begin[:k] + t]
            total = a0[:k] + a1
            a0, a1 = a0[:k] / total, a1 / total
            front.append((a0, a1))
        b0, b1 = np.ones(n), np.ones(n)
        for t in range(top - 1, -1, -1):
            k = active[t]
            a0, a1 = front[t]
            toxic, other = a1 * b1[:k], a0 * b0[:k]
            p[begin[:k] + t] = toxic / (toxic + other)
            if t:
                e = emit[begin[:k] + t]
                c0, c1 = b0[:k], b1[:k] * e
                if pairs is not None:
                    f0, f1 = front[t - 1][0][:k], front[t - 1][1][:k]
                    joint = [f0 * step[0, 0] * c0, f0 * step[0, 1] * c1, f1 * step[1, 0] * c0, f1 * step[1, 1] * c1]
                    total = sum(joint)
                    pairs += np.array([(j / total).sum() for j in joint]).reshape(2, 2)
                n0, n1 = step[0, 0] * c0 + step[0, 1] * c1, step[1, 0] * c0 + step[1, 1] * c1
                total = n0 + n1
                b0[:k], b1[:k] = n0 / total, n1 / total
        return p


def _distinct(texts: list[bytes], labels: list[int]) -> tuple[list[bytes], np.ndarray]:
    """Texts without near copies: one for each smallest hash of three words."""
    seen: set[tuple[int, int]] = set()
    keep = []
    for i, text in enumerate(texts):
        words = text.lower().split()
        least = min((hash_words(words[k : k + 3]) for k in range(max(1, len(words) - 2))), default=0)
        if (least, labels[i]) not in seen:
            seen.add((least, labels[i]))
            keep.append(i)
    return [texts[i] for i in keep], np.array([labels[i] for i in keep])


def hash_words(words: list[bytes]) -> int:
    joined = b" ".join(words)
    return zlib.crc32(joined) << 32 | zlib.adler32(joined)


def _telling(words: Words, labels: np.ndarray) -> np.ndarray:
    """Which features mark toxic words."""
    size = 2**FEATURE_BITS
    in_toxic, in_clean = np.zeros(size, np.int64), np.zeros(size, np.int64)
    of_toxic = []  # (document, feature) of toxic documents
    for k in range(words.features.shape[1]):
        seen = np.unique(words.row.astype(np.int64) * size + words.features[:, k])
        doc, feature = seen // size, seen % size
        toxic = labels[doc] == 1
        in_toxic += np.bincount(feature[toxic], minlength=size)
        in_clean += np.bincount(feature[~toxic], minlength=size)
        of_toxic.append(seen[toxic])
    n1, n0 = max(1, int(labels.sum())), max(1, int((labels == 0).sum()))
    rate = (in_toxic + 0.5) / (n1 + 1) / ((in_clean + 0.5) / (n0 + 1))
    rare = in_clean <= max(1, 0.002 * n0)
    could = rare & (rate >= 8) & (in_toxic >= 3)
    chosen = could & (in_toxic >= max(8, 0.03 * n1))
    open_docs = np.ones(len(labels), dtype=bool)
    own = np.concatenate([x[could[x % size]] for x in of_toxic])
    doc, feature = own // size, own % size
    open_docs[doc[chosen[feature]]] = False
    while True:  # the feature that explains most of the documents left
        left = open_docs[doc]
        gain = np.bincount(feature[left], minlength=size) - 4.0 * in_clean
        best = int(np.argmax(gain))
        if gain[best] < 3:
            return chosen
        chosen[best] = True
        open_docs[doc[feature == best]] = False


def _read_all(texts: list[bytes]) -> Words:
    """Words of many texts, read some at a time."""
    parts: list[Words] = []
    at = sequences = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
            size += len(texts[end])
            end += 1
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[at:end]])]).astype(np.int64)
        part = read_words(np.frombuffer(b"".join(texts[at:end]), np.uint8), offsets)
        part.row = (part.row + at).astype(np.int32)
        part.sequence = (part.sequence + sequences).astype(np.int32)
        part.place = part.place.astype(np.int8)
        part.start = part.end = np.zeros(0, np.int64)  # places in the text are not learned from
        if len(part.sequence):
            sequences = int(part.sequence[-1]) + 1
        parts.append(part)
        at = end
    whole = []
    for f in fields(Words):  # one after the other, so that not all stand in memory twice
        whole.append(np.concatenate([getattr(p, f.name) for p in parts]))
        for p in parts:
            setattr(p, f.name, None)
    return Words(*whole)


def train(texts: list[bytes], labels: list[int]) -> Field:
    """A field fitted to labelled texts."""
    size = 2**FEATURE_BITS
    field = Field(np.zeros(size), np.zeros((2, 2)), 0.0)
    if not any(labels):
        field.weights -= 30.0
        return field
    texts, y = _distinct(texts, labels)
    words = _read_all(texts)
    marks = _telling(words, y)
    tag = marks[words.features].any(axis=1) & (y[words.row] == 1)
    rng = np.random.default_rng(17)
    n = int(words.sequence[-1]) + 1 if len(words.row) else 0
    begin = np.searchsorted(words.sequence, np.arange(n + 1))
    field.weights -= 1.0
    params = [field.weights, field.steps, np.zeros(1)]
    squares = [np.full(p.shape, 1e-8) for p in params]
    epochs = max(EPOCHS, -(-LEAST_STEPS // max(1, -(-n // BATCH))))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            pick = np.sort(order[at : at + BATCH])
            sizes = begin[pick + 1] - begin[pick]
            index = np.arange(sizes.sum()) + np.repeat(begin[pick] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            part = Words(
                words.start,
                words.end,
                words.row[index],
                words.features[index],
                np.repeat(np.arange(len(pick)), sizes),
                words.place[index],
            )
            field.first = float(params[2][0])
            pairs = np.zeros((2, 2))
            p, t = field.marginals(part, pairs), tag[index].astype(float)
            next_ = part.sequence[1:] == part.sequence[:-1]
            real = np.bincount((t[:-1] * 2 + t[1:]).astype(int)[next_], minlength=4).reshape(2, 2)
            starts = part.place == 0
            kinds = part.features.shape[1]
            emission = np.bincount(part.features.ravel(), np.repeat(p - t, kinds), minlength=size)
            touched = np.bincount(part.features.ravel(), minlength=size) > 0
            grads = [
                (emission + DECAY * len(pick) * field.weights * touched) / len(pick),
                (pairs - real) / len(pick),
                np.array([(p[starts] - t[starts]).sum() / len(pick)]),
            ]
            for value, grad, square in zip(params, grads, squares):
                square += grad * grad
                value -= RATE * grad / np.sqrt(square)
    field.first = float(params[2][0])
    return field


def _scored(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        words = read_words(data, offsets)
        p = field.marginals(words)
        n = rows.num_rows
        notable = p >= NOTABLE
        clean = np.bincount(words.row[notable], np.log1p(-np.minimum(p[notable], 1 - 1e-12)), minlength=n)
        on = p >= SPAN_AT
        new = on.copy()
        new[1:] &= ~on[:-1] | (words.row[1:] != words.row[:-1])
        last = on.copy()
        last[:-1] &= ~on[1:] | (words.row[1:] != words.row[:-1])
        begin, end, of = words.start[new], words.end[last], words.row[new]
        ends = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
        spans = pa.StructArray.from_arrays(
            [pa.array(begin - offsets[of]), pa.array(end - begin)], ["start", "length"]
        )
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(1 - np.exp(clean)), pa.ListArray.from_arrays(pa.array(ends), spans)],
            [*rows.schema.names, "score", "spans"],
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> Field:
    """A field from the labelled rows that are not held out, `most` of each label."""
    return train(*sample(docs, labels, label, most))


def score(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows with their score and offending spans (start, length; bytes).

    Columns that are called score or spans are replaced.
    """
    rest = [c for c in docs.columns if c not in ("score", "spans", text_col)]
    rows = docs.select(*rest, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(
        lambda it: _scored(it, field),
        f"{schema}, score double, spans array<struct<start:long,length:long>>",
    )
    return out.withColumnRenamed("text", text_col)
