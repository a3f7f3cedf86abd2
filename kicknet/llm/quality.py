"""Text quality by a small convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that cover all of it. Each byte has a learned
vector; learned filters run over the bytes of a chunk, their strongest answers
(max-pooling) go through a hidden layer, and the chunk's value is the result. The mean
of the values of all chunks, through a logistic function, is the probability that the
text is of good quality.

Training is stochastic gradient descent (Adam) on a bounded sample: at most `SAMPLE`
labelled rows of each label, drawing chunks anew from their whole texts in every
round. The rarer label weighs more. Null and empty texts are one chunk without bytes.
With labels of one kind only, every score is that label's share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kicknet.llm.labelled import sample
from kicknet.llm.texts import slices

SAMPLE = 2000
CHUNK, STRIDE = 256, 192
WIDTH, DIM, FILTERS, HIDDEN = 6, 6, 24, 16
ROUNDS, BATCH, CHUNKS_DRAWN, RATE = 30, 64, 2, 0.01
#: Chunks handled at once in a task.
AT_ONCE = 1024


@dataclass
class Network:
    embedding: np.ndarray  # 257 x DIM, the last for places after the end
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS + 1 x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return list(self.__dict__.values())

    def pooled(self, chunks: np.ndarray, where: bool = False):
        """Strongest answer of each filter in each chunk, and where it is."""
        n, size = chunks.shape
        x = self.embedding[chunks].reshape(n, size * DIM)
        places = size - WIDTH + 1
        windows = np.lib.stride_tricks.as_strided(
            x, (n, places, WIDTH * DIM), (x.strides[0], DIM * x.itemsize, x.itemsize)
        )
        answers = np.ascontiguousarray(windows).reshape(-1, WIDTH * DIM) @ self.filters
        answers = answers.reshape(n, places, FILTERS)
        if not where:
            return answers.max(axis=1), None
        at = answers.argmax(axis=1)
        return np.take_along_axis(answers, at[:, None], axis=1)[:, 0], at

    def values(self, chunks: np.ndarray) -> np.ndarray:
        best, _ = self.pooled(chunks)
        return self.head(best, chunks)[-1]

    def head(self, best: np.ndarray, chunks: np.ndarray):
        filled = (chunks < 256).mean(axis=1, keepdims=True).astype(np.float32)
        features = np.concatenate([np.tanh(best + self.bias), filled], axis=1)
        inner = np.tanh(features @ self.hidden + self.hidden_bias)
        return features, inner, inner @ self.out + self.out_bias[0]


def new_network(rng: np.random.Generator) -> Network:
    def draw(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    return Network(
        draw(257, DIM, scale=0.5),
        draw(WIDTH * DIM, FILTERS, scale=0.3),
        np.zeros(FILTERS, np.float32),
        draw(FILTERS + 1, HIDDEN, scale=0.3),
        np.zeros(HIDDEN, np.float32),
        draw(HIDDEN, scale=0.3),
        np.zeros(1, np.float32),
    )


def chunk_starts(length: int) -> np.ndarray:
    """Starts of chunks that cover a text."""
    return np.arange(0, max(1, length - (CHUNK - STRIDE)), STRIDE)


def cut_chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Chunks from the starts; places from the text's end on are 256."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    # 256 is no byte: the type has to be wide before it is put in
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)].astype(np.int16), np.int16(256))


def _step(net: Network, chunks: np.ndarray, of: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Gradients of the weighted log-loss of texts whose chunks are given."""
    best, at = net.pooled(chunks, where=True)
    features, inner, value = net.head(best, chunks)
    n = len(y)
    count = np.bincount(of, minlength=n)
    z = np.bincount(of, value, minlength=n) / count
    p = 1 / (1 + np.exp(-z))
    dz = ((p - y) * weight / n)[of] / count[of]
    dz = dz.astype(np.float32)
    d_inner = np.outer(dz, net.out) * (1 - inner**2)
    d_features = d_inner @ net.hidden.T
    d_best = d_features[:, :FILTERS] * (1 - features[:, :FILTERS] ** 2)
    k = np.arange(len(chunks))[:, None]
    windows = chunks[k[:, :, None], at[:, :, None] + np.arange(WIDTH)]  # chunks x FILTERS x WIDTH
    x = net.embedding[windows].reshape(len(chunks), FILTERS, WIDTH * DIM)
    d_filters = np.einsum("cfx,cf->xf", x, d_best)
    d_x = (d_best[:, :, None] * net.filters.T[None]).reshape(-1, DIM)
    d_embedding = np.zeros_like(net.embedding)
    np.add.at(d_embedding, windows.reshape(-1), d_x)
    return [
        d_embedding,
        d_filters,
        d_best.sum(0),
        features.T @ d_inner,
        d_inner.sum(0),
        inner.T @ dz,
        np.array([dz.sum()], np.float32),
    ]


def train(texts: list[bytes], labels: list[int]) -> Network:
    rng = np.random.default_rng(5)
    net = new_network(rng)
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias[:] = 0.0 if not len(y) else (8.0 if y[0] else -8.0)
        return net
    share = y.mean()
    weight = np.where(y == 1, 1.0, min(4.0, share / (1 - share)))
    lengths = np.array([len(t) for t in texts])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    params = net.parts()
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    total = ROUNDS * -(-len(y) // BATCH)
    for _ in range(ROUNDS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            many = np.maximum(1, -(-(lengths[pick] - (CHUNK - STRIDE)) // STRIDE))
            drawn = np.floor(rng.random((len(pick), CHUNKS_DRAWN)) * many[:, None]).astype(np.int64)
            starts = offsets[pick][:, None] + drawn * STRIDE
            ends = np.repeat(offsets[pick + 1], CHUNKS_DRAWN)
            of = np.repeat(np.arange(len(pick)), CHUNKS_DRAWN)
            grads = _step(net, cut_chunks(data, starts.ravel(), ends), of, y[pick], weight[pick])
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (
                    rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                ).astype(np.float32)
    return net


def score_texts(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of good quality of each of the texts."""
    lengths = np.diff(offsets)
    many = np.maximum(1, -(-(lengths - (CHUNK - STRIDE)) // STRIDE))
    of = np.repeat(np.arange(len(lengths)), many)
    first = np.concatenate([[0], np.cumsum(many)[:-1]])
    starts = offsets[of] + (np.arange(len(of)) - first[of]) * STRIDE
    total = np.zeros(len(lengths))
    for at in range(0, len(of), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        value = net.values(cut_chunks(data, starts[part], offsets[of[part] + 1]))
        total += np.bincount(of[part], value, minlength=len(lengths))
    return 1 / (1 + np.exp(-total / many))


def _scored(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(score_texts(net, data, offsets))], ["doc_id", "score"]
        )


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Network:
    """A network from the labelled rows that are not held out, `most` of each label."""
    return train(*sample(docs, labels, label, most))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scored(it, net), "doc_id long, score double")
