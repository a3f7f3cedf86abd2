"""SentencePiece encoding and decoding as a weighted transducer.

The model file is compiled into a transducer: the normaliser (a dummy prefix and the
mark for a space), one path per piece, and byte fallback for characters that no piece
has. Composed with an input it is a lattice of pieces over the input's positions,
whose states are (position, last piece). The result is the shortest path in the
tropical semiring.

- Unigram models: an arc weighs minus the piece's score; shortest path as usual.
- BPE models: what a merge rule yields is not the path with the best scores. A
  sequence of pieces is the result of the merges exactly if each two neighbours are the
  result for their own concatenation, since merges never cross a boundary that stays.
  So an arc weighs 0 if the piece may follow the last one and infinity if not, and each
  position keeps one state of finite weight. Which pieces may follow each other is worked
  out on demand from the merge rule and kept.

Where no piece goes on past a word (checked when the model is compiled), an input is the
concatenation of its words, marks in front; distinct words are composed once per task
and kept in a table of bounded size.

Null and empty texts have no pieces. Ids that the model does not have are refused.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Words (in each of two generations) and neighbours that a task keeps.
MOST_WORDS, MOST_NEIGHBOURS = 250_000, 150_000
INFINITY = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Transducer:
    """A compiled model."""

    ids: dict[str, int]
    texts: list[str]
    scores: list[float]
    kinds: list[int]
    model: int
    dummy_prefix: bool
    tidy: bool
    longest: int
    by_word: bool
    bytes_at: dict[int, int]
    unknown: int
    most_words: int = MOST_WORDS
    _words: dict[str, bytes] = field(default_factory=dict)
    _older: dict[str, bytes] = field(default_factory=dict)
    _follows: dict[str, dict[str, bool]] = field(default_factory=dict)
    _known: int = 0
    #: Length of the longest piece for each beginning of 4 characters.
    _reach: dict[str, int] = field(default_factory=dict)
    _split: dict[str, tuple[str, str]] = field(default_factory=dict)
    _left_edges: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    _right_edges: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    _bytes: list[bytes] = field(default_factory=list)

    def __post_init__(self) -> None:
        for text, kind in zip(self.texts, self.kinds):
            if kind == BYTE:
                self._bytes.append(bytes([int(text[3:5], 16)]))
            elif kind == UNKNOWN:
                self._bytes.append(" ⁇ ".encode())
            else:
                self._bytes.append(b"" if kind == CONTROL else text.replace(SPACE, " ").encode())
        if self.model == BPE:
            self.ids = {t: k for t, k in self.ids.items() if self.alone(t)}
            for t in self.ids:
                if len(t) > 3:
                    self._reach[t[:4]] = max(len(t), self._reach.get(t[:4], 0))

    def normalise(self, text: str) -> str:
        if self.tidy:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return ((" " if self.dummy_prefix else "") + text).replace(" ", SPACE)

    def _merged(self, text: str, stop: int = 1) -> tuple[str, ...]:
        """The merge rule itself: the best pair first, then the leftmost; down to `stop` parts.

        The empty tuple if the merges of a piece end before.
        """
        parts = list(text)
        while len(parts) > stop:
            best, at = -INFINITY, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and self.scores[k] > best:
                    best, at = self.scores[k], i
            if at < 0:
                return ()
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts of a piece's last merge; None for a character."""
        if len(piece) == 1:
            return None
        found = self._split.get(piece)
        if found is None:
            parts = list(self._merged(piece, stop=2))
            found = self._split[piece] = tuple(parts) if len(parts) == 2 else ("", "")
        return found

    def _edge(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """Pieces at one end of a piece while it is merged, with the rank that uses them up."""
        table = self._right_edges if right else self._left_edges
        found = table.get(piece)
        if found is None:
            found, used = [], INFINITY
            part = piece
            while True:
                found.append((part, used))
                halves = self._halves(part)
                if halves is None:
                    break
                used = self._rank(part)
                part = halves[1 if right else 0]
            table[piece] = found
        return found

    def _rank(self, piece: str) -> float:
        k = self.ids.get(piece)
        return INFINITY if k is None else -self.scores[k]

    def alone(self, piece: str) -> bool:
        """Whether the merges turn the piece's own text into the piece."""
        return len(piece) == 1 or self._halves(piece) != ("", "")

    def weight(self, last: str, piece: str) -> float:
        """Weight of the arc for `piece` out of a state with `last`.

        For BPE, infinity if a merge over the boundary comes before the merges that use
        up what stands on its two sides.
        """
        if self.model != BPE:
            k = self.ids.get(piece)
            return -self.scores[k] if k is not None else 10.0 - min(self.scores)
        if not last:
            return 0.0
        ids, scores = self.ids, self.scores
        rights = self._edge(piece, False)
        for a, a_used in self._edge(last, True):
            for b, b_used in rights:
                k = ids.get(a + b)
                if k is not None and -scores[k] < a_used and -scores[k] <= b_used:
                    return INFINITY
        return 0.0

    def _free_path(self, text: str) -> list[str]:
        """The only path of weight 0, longest arcs first; a position without a way on is closed.

        Every prefix has one result under the merge rule, so there is one state of
        finite weight for each position, and a closed position stays closed.
        """
        n, ids, reach = len(text), self.ids, self._reach
        closed = bytearray(n + 1)
        pieces, starts = [""], [0]
        end = min(n, reach.get(text[:4], 3))
        while True:
            start, before = starts[-1], pieces[-1]
            follows = self._follows.get(before)
            if follows is None:
                follows = self._follows[before] = {}
            while end > start:
                if not closed[end]:
                    piece = text[start:end]
                    if piece in ids or end == start + 1:
                        free = follows.get(piece)
                        if free is None:
                            free = follows[piece] = self.weight(before, piece) == 0.0
                            self._known += 1
                        if free:
                            break
                end -= 1
            if end == n:
                pieces.append(piece)
                return pieces[1:]
            if end > start:
                pieces.append(piece)
                starts.append(end)
                end = min(n, end + reach.get(text[end : end + 4], 3))
            else:
                closed[start] = 1
                starts.pop()
                pieces.pop()
                end = start

    def path(self, text: str) -> list[int]:
        """Ids along the shortest path of the composition with a normalised text."""
        if self.model == BPE:
            if self._known >= MOST_NEIGHBOURS:
                self._follows, self._known = {}, 0
            path = self._free_path(text)
            try:
                return list(map(self.ids.__getitem__, path))
            except KeyError:  # a character by its bytes
                return list(chain.from_iterable(map(self._emit, path)))
        n = len(text)
        weight = [INFINITY] * (n + 1)
        last: list[str] = [""] * (n + 1)
        weight[0] = 0.0
        ids, longest, arc = self.ids, self.longest, self.weight
        for start in range(n):
            so_far = weight[start]
            if so_far == INFINITY:
                continue
            before = last[start]
            for end in range(start + 1, min(n, start + longest) + 1):
                piece = text[start:end]
                if piece in ids or end == start + 1:
                    w = so_far + arc(before, piece)
                    if w < weight[end]:
                        weight[end], last[end] = w, piece
        out: list[list[int]] = []
        while n:
            out.append(self._emit(last[n]))
            n -= len(last[n])
        return list(chain.from_iterable(reversed(out)))

    def _emit(self, piece: str) -> list[int]:
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.bytes_at[b] for b in raw] if self.bytes_at else [self.unknown]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), dtype=np.int32).tolist()

    def packed(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers, one after the other."""
        text = self.normalise(text or "")
        if not self.by_word:
            return np.array(self.path(text), dtype=np.int32).tobytes()
        if len(self._words) >= self.most_words:  # words that go on occurring come back from the older ones
            self._older, self._words = self._words, {}
        words, older = self._words, self._older
        parts = _words_of(text)
        for w in set(parts).difference(words):
            known = older.get(w)
            words[w] = struct.pack(f"<{len(k := self.path(w))}i", *k) if known is None else known
        return b"".join(map(words.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise ValueError("an id has no piece")
        try:
            text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace")
        except IndexError:
            raise ValueError("an id has no piece") from None
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def _words_of(text: str) -> list[str]:
    """Cuts in front of each run of marks."""
    if not text:
        return []
    if SPACE * 2 not in text:
        return text.replace(SPACE, f" {SPACE}").split(" ")[text[0] == SPACE :]
    parts = text.split(SPACE)
    out, marks = [], 0
    if parts[0]:
        out.append(parts[0])
    for part in parts[1:]:
        marks += 1
        if part:
            out.append(SPACE * marks + part)
            marks = 0
    if marks:
        out.append(SPACE * marks)
    return out


def compile_model(data: bytes) -> Transducer:
    """The transducer of a model file's content."""
    texts, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    normaliser: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece[1].decode("utf-8"))
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if normaliser.get(2):
        raise ValueError("models with a character map of their own are not supported")
    ids = {t: k for k, (t, kind) in enumerate(zip(texts, kinds)) if kind in (NORMAL, USER)}
    if USER in kinds or UNUSED in kinds:
        raise ValueError("models with user-defined or unused pieces are not supported")
    inner = any(SPACE in t.lstrip(SPACE) for t in ids)
    return Transducer(
        ids=ids,
        texts=texts,
        scores=scores,
        kinds=kinds,
        model=trainer.get(3, UNIGRAM),
        dummy_prefix=bool(normaliser.get(3, 1)),
        tidy=bool(normaliser.get(4, 1)),
        longest=max(map(len, ids)),
        by_word=trainer.get(3, UNIGRAM) == BPE and not inner,
        bytes_at={int(t[3:5], 16): k for k, (t, kind) in enumerate(zip(texts, kinds)) if kind == BYTE},
        unknown=kinds.index(UNKNOWN) if UNKNOWN in kinds else 0,
    )


@lru_cache(maxsize=2)
def _compiled(data: bytes) -> Transducer:
    return compile_model(data)


def read_model(path: str) -> bytes:
    """The content of a model file, a few hundred kilobytes that travel with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encoder(model: bytes, decode: bool = False, known_words: int = MOST_WORDS):
    """A function of Arrow batches (.., text) that adds `ids` and, if asked, `decoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _compiled(model)
        machine.most_words = known_words
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids = [
                    machine.packed(t)
                    for t in batch.column(batch.schema.get_field_index("text")).to_pylist()
                ]
                ends = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                columns = [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                names = [*batch.schema.names, "ids"]
                if decode:
                    columns.append(pa.array([machine.decode(np.frombuffer(x, np.int32).tolist()) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_texts(
    docs: DataFrame,
    model: bytes,
    text_col: str = "text",
    decode: bool = False,
    known_words: int = MOST_WORDS,
) -> DataFrame:
    """The rows with `ids` (and `decoded`, the text read back from them) added.

    A task keeps the pieces of up to twice `known_words` words, for speed.

    Other columns stay; columns that are called ids or decoded are replaced.
    """
    rows = docs.drop("ids", "decoded")
    added = "ids array<int>" + (", decoded string" if decode else "")
    if text_col != "text":
        rows = rows.drop("text").withColumnRenamed(text_col, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(encoder(model, decode, known_words), f"{schema}, {added}")
    return out if text_col == "text" else out.withColumnRenamed("text", text_col)


def ids_digest(ids: Column) -> Column:
    """Lower-case hex digest of the ids, joined by spaces."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
