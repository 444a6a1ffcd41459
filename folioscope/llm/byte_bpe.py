"""Byte-level BPE over whole batches.

Texts of a batch are laid end to end as code points. A table turns code points into classes, an eight-state automaton
over the classes says where pieces begin, and its states are found by an associative scan: every row of a matrix of
classes composes its transition functions column by column, the rows' functions are chained once, and the known start
states are pushed through. No regular expression runs. Pieces then go through pair merging with a cache, and the start
of each piece is kept, so that ids decode and map back to characters.

Defined results: empty and null texts have no ids (an empty list); text of special tokens is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Pieces remembered per worker before the cache starts anew.
CACHE = 400_000
#: Characters that are scanned together, to bound memory whatever the batch.
CHUNK = 4_000_000

# Classes: letter, digit, other, apostrophe; blanks before text and inside or at the end of blanks, U+0020 apart;
# the letters of the contractions 's 't 'm 'd, and the first of 're 've 'll.
LETTER, DIGIT, OTHER, QUOTE, SPACE_LAST, SPACE_IN, BLANK_LAST, BLANK_IN, ONE, TWO = range(10)
# States after a character: in letters, digits, others, blanks, after a space that belongs to the next piece, at the
# start of a piece, after an apostrophe at the start of a piece, one letter before the end of a contraction.
S_LETTER, S_DIGIT, S_OTHER, S_BLANK, S_PREFIX, S_FRESH, S_QUOTE, S_HALF = range(8)
_NEXT = {LETTER: S_LETTER, DIGIT: S_DIGIT, OTHER: S_OTHER, QUOTE: S_QUOTE, SPACE_LAST: S_PREFIX, SPACE_IN: S_BLANK, BLANK_LAST: S_FRESH, BLANK_IN: S_BLANK, ONE: S_LETTER, TWO: S_LETTER}
_LETTERS = (LETTER, ONE, TWO)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """move[state, class] and begins[state, class]: whether a piece begins at the character."""
    move = np.array([[_NEXT[c] for c in range(10)] for _ in range(8)], np.uint8)
    begins = np.ones((8, 10), bool)
    begins[S_LETTER, _LETTERS] = begins[S_DIGIT, DIGIT] = False
    for state in (S_OTHER, S_QUOTE):
        begins[state, (OTHER, QUOTE)] = False
        move[state, QUOTE] = S_OTHER
    begins[S_BLANK, (SPACE_IN, BLANK_IN)] = False
    begins[S_PREFIX, (LETTER, ONE, TWO, DIGIT, OTHER, QUOTE)] = False
    move[S_PREFIX, QUOTE] = S_OTHER
    begins[S_QUOTE, (ONE, TWO)] = False
    move[S_QUOTE, ONE], move[S_QUOTE, TWO] = S_FRESH, S_HALF
    begins[S_HALF, _LETTERS] = False
    move[S_HALF, _LETTERS] = S_FRESH
    return move, begins


MOVE, BEGINS = _tables()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point, contractions and the place of blanks left out."""
    kinds = {"L": LETTER, "N": DIGIT}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    # The code points with the property White_Space.
    table[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK_IN
    table[0x20], table[0x27] = SPACE_IN, QUOTE
    return table


def scan(classes: np.ndarray, width: int = 256) -> np.ndarray:
    """The state before each character, from S_FRESH, by composing transition functions."""
    n = len(classes)
    rows = -(-n // width)
    grid = np.full(rows * width, OTHER, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for column in grid:
        whole = MOVE[whole, column[:, None]]
    start = np.empty(rows, np.uint8)
    state = S_FRESH
    for r in range(rows):
        start[r] = state
        state = whole[r, state]
    before = np.empty((width, rows), np.uint8)
    for k, column in enumerate(grid):
        before[k] = start
        start = MOVE[start, column]
    return before.T.reshape(-1)[:n]


def piece_starts(points: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Positions where pieces begin; ``documents`` holds the first position of each non-empty text, ascending."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    classes = _classes()[points]
    blank = (classes == SPACE_IN) | (classes == BLANK_IN)
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:]
    last[documents[1:] - 1] = False
    following = np.zeros(n, points.dtype)
    following[:-1] = points[1:]
    following[documents[1:] - 1] = 0
    one = np.isin(points, [ord(c) for c in "stmd"])
    two = (np.isin(points, [ord("r"), ord("v")]) & (following == ord("e"))) | ((points == ord("l")) & (following == ord("l")))
    classes = np.where(one, ONE, np.where(two, TWO, classes)).astype(np.uint8)
    classes = np.where(last, np.where(classes == SPACE_IN, SPACE_LAST, BLANK_LAST), classes)
    # a text begins afresh: the automaton is run over a blank that ends before it, one place earlier
    padded = np.insert(classes, documents, BLANK_LAST)
    states = scan(padded.astype(np.uint8))
    real = np.ones(len(padded), bool)
    real[documents + np.arange(len(documents))] = False
    return np.flatnonzero(BEGINS[states[real], classes])


class ByteBpe:
    """Ids of texts by a vocabulary of ranks."""

    def __init__(self, path: str):
        with Path(path).open("rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Pair merging, lowest rank first, leftmost on ties; a heap keeps long pieces at n log n."""
        if (whole := self.ranks.get(word)) is not None:
            return (whole,)
        n, ranks = len(word), self.ranks
        parts = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i] if parts[i] else n
            if j >= n or not parts[i] or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], b""
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get(parts[i] + parts[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[right[i]])))
            if (k := left[i]) >= 0 and (r := ranks.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[i])))
        return tuple(ranks[p] for p in parts if p)

    def pieces(self, texts: Sequence[str | None]) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """(number of texts, pieces, for each text the number of pieces) in chunks of bounded size."""
        at = 0
        while at < len(texts):
            chunk, size = [], 0
            while at < len(texts) and (not chunk or size < CHUNK):
                chunk.append(texts[at] or "")
                size += len(chunk[-1])
                at += 1
            joined = "".join(chunk)
            lengths = np.fromiter(map(len, chunk), np.int64, len(chunk))
            firsts = np.concatenate([[0], np.cumsum(lengths)])
            starts = piece_starts(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), firsts[:-1][lengths > 0])
            cuts = [*starts.tolist(), len(joined)]
            yield len(chunk), [joined[a:b] for a, b in zip(cuts, cuts[1:])], np.diff(np.searchsorted(starts, firsts))

    def lookup(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        cache = self.cache
        for p in set(pieces).difference(cache):
            cache[p] = self.merge(p.encode("utf-8", "surrogatepass"))
        found = [cache[p] for p in pieces]
        if len(cache) > CACHE:
            cache.clear()
        return found

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)."""
        ids, counts = [], []
        for _, pieces, per_text in self.pieces(texts):
            found = self.lookup(pieces)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids.append(np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum())))
            sums = np.concatenate([[0], np.cumsum(sizes)])
            counts.append(np.diff(sums[np.concatenate([[0], np.cumsum(per_text)])]))
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.int32), np.empty(0, np.int64))

    def encode_with_offsets(self, text: str) -> list[tuple[int, int]]:
        """(id, first character of its piece), enough to cut a text at a boundary of pieces."""
        out, at = [], 0
        for _, pieces, _ in self.pieces([text]):
            for piece, ids in zip(pieces, self.lookup(pieces)):
                out += [(i, at) for i in ids]
                at += len(piece)
        return out

    @property
    def vocabulary(self) -> dict[int, bytes]:
        return {i: b for b, i in self.ranks.items()}

    def decode(self, ids: Sequence[int], vocabulary: dict[int, bytes] | None = None) -> str:
        words = vocabulary or self.vocabulary
        return b"".join(words[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(2)
def tokenizer(folder: str = TOKENIZERS, name: str = BYTE_BPE_50K) -> ByteBpe:
    """One tokenizer per worker; the folder of public tokenizers is a parameter."""
    return ByteBpe(f"{folder}/{name}")


def _map(frame: DataFrame, key: str, text: str, schema: str, build) -> DataFrame:
    """Runs ``build(ids, counts)`` over Arrow batches; keys pass through untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), build(batch.column(1).to_pylist())], names=[key, "result"])

    return frame.select(key, text).mapInArrow(run, schema)


def encode_corpus(frame: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids``, the token ids of every text."""

    def build(texts: list[str | None]) -> pa.Array:
        ids, counts = tokenizer(folder).encode(texts)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))

    return _map(frame, key, text, f"{key} BIGINT, result ARRAY<INT>", build).withColumnRenamed("result", "ids")


def count_tokens(frame: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``tokens``, the number of token ids of every text; the ids themselves never leave the worker."""

    def build(texts: list[str | None]) -> pa.Array:
        return pa.array(tokenizer(folder).encode(texts)[1], pa.int32())

    return _map(frame, key, text, f"{key} BIGINT, result INT", build).withColumnRenamed("result", "tokens")
