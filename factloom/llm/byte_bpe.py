"""Byte-level BPE over whole columns of text: numpy pretokenizer and batched merge rounds.

A batch of texts is one flat array of code points. Words are found by comparing the classes of neighbouring
characters, and the distinct new words of the batch go through merge rounds together: the symbols of all of
them lie in one flat array, the rank of every neighbouring pair is found by binary search over the sorted pair
keys, and in each round every word merges its lowest-ranked pair.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files; a parameter of every operator below.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

LETTER, NUMBER, OTHER, SPACE = 1, 2, 0, 3

# The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions of the tokenizer's pattern, by length of what follows the apostrophe.
CONTRACTIONS = {1: ["s", "t", "m", "d"], 2: ["re", "ve", "ll"]}

_NO_RANK = np.int64(1 << 40)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    import unicodedata

    kinds = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        first = unicodedata.category(chr(cp))[0]
        if first == "L":
            kinds[cp] = LETTER
        elif first == "N":
            kinds[cp] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def word_starts(cps: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions in the flat array where a word of the pattern starts, as a boolean mask.

    cps: the code points of all texts, one after the other; text_starts: where non-empty texts start.
    """
    n = len(cps)
    kind = char_classes()[cps]
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run_end = np.append(start[1:] | first[1:n], True) if n else start  # last character of its run
    blank = cps == 32
    # The last character of a white-space run that is followed by a word leaves the run; a plain space joins the word.
    last_space = (kind == SPACE) & run_end & ~first[1:]
    start |= last_space
    joined = np.flatnonzero(last_space & blank) + 1
    start[joined] = False
    # An apostrophe alone that starts a word takes a contraction with it.
    lone = np.flatnonzero((cps == 39) & start & run_end & ~first[1:])
    if len(lone):
        ends = np.append(text_starts[1:], n)
        room = ends[np.searchsorted(text_starts, lone, side="right") - 1] - lone - 1
        length = np.zeros(len(lone), np.int64)
        for size in sorted(CONTRACTIONS, reverse=True):
            for tail in CONTRACTIONS[size]:
                fits = (room >= size) & (length == 0)
                for i, letter in enumerate(tail):
                    fits &= cps[np.minimum(lone + 1 + i, n - 1)] == ord(letter)
                length[fits] = size
        hit, size = lone[length > 0], length[length > 0]
        start[hit + 1] = False
        after = hit + 1 + size
        inside = after < n
        start[after[inside]] = True
    return start


class Vocabulary:
    """Ranks of a byte-level BPE, and the words encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        pairs = {}
        for token, rank in tokens:
            # A token's own pair is the one left when its bytes are merged by all lower ranks.
            if len(token) > 1:
                pairs[self._halves(token, rank)] = rank
        keys = np.array([(a << 32) | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(pairs.values()), np.int64)[order]
        self.known: dict[int, int] = {}  # hash of a word: its place in the word table
        self.ids: list[np.ndarray] = []

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and r < rank and (best is None or r < best):
                    best, at = r, i
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def encode_words(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the number of ids of each word; flat: the words' bytes one after the other, all words non-empty."""
        symbols = self.byte_ids[flat]
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_words = [], []
        while True:
            same = word[1:] == word[:-1]
            key = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(same & (self.pair_keys[at] == key), self.pair_ranks[at], _NO_RANK)
            # Words of one symbol have no pair; the lowest rank of each of the others.
            heads = np.flatnonzero(np.append(True, ~same))
            low = np.minimum.reduceat(np.append(rank, _NO_RANK), heads)
            low = np.minimum(low, _NO_RANK)
            live = low < _NO_RANK
            sizes = np.diff(np.append(heads, len(symbols)))
            mine = np.repeat(live, sizes)
            if not live.all():
                done_symbols.append(symbols[~mine])
                done_words.append(word[~mine])
                if not live.any():
                    break
            lowest = np.repeat(low, sizes)
            hit = np.append((rank == lowest[:-1]) & mine[:-1], False)
            # Of pairs that overlap (a run of one symbol), every second merges, from the left.
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():
                run = np.cumsum(np.append(True, np.diff(at) != 1))
                begin = at[np.searchsorted(run, run)]
                hit[at[(at - begin) % 2 == 1]] = False
                at = np.flatnonzero(hit)
            symbols[at] = lowest[at]
            keep = mine.copy()
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order].astype(np.int32), np.bincount(word, minlength=len(lengths))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Words kept encoded in a worker; beyond that the table starts anew, so that its memory stays bounded.
KEPT_WORDS = 400_000


class Encoder:
    """Encodes batches of texts; keeps the words it has met."""

    def __init__(self, path: str) -> None:
        self.vocabulary = vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.places = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def words(self, cps: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each word in the flat array, and the word's place in the table of encoded words."""
        starts = np.flatnonzero(word_starts(cps, text_starts))
        sizes = np.diff(np.append(starts, len(cps)))
        inside = (np.arange(len(cps)) - np.repeat(starts, sizes)).astype(np.uint64)
        # Two sums over odd multipliers that depend on the place in the word make up 64 bits for each word.
        with np.errstate(over="ignore"):
            x = (cps.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * (inside * np.uint64(0xD1B54A32D192ED03) + np.uint64(0x8CB92BA72F3D8DD7))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            h = np.add.reduceat(x, starts)
            h ^= h >> np.uint64(32)
            h = h * np.uint64(0x94D049BB133111EB) + sizes.astype(np.uint64)
        distinct, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = np.ones(len(distinct), bool) if not len(self.hashes) else self.hashes[at] != distinct
        if new.any():
            if len(self.hashes) + new.sum() > KEPT_WORDS:
                self.clear()
                new[:] = True
            self._learn(cps, starts[one[new]], sizes[one[new]], distinct[new])
            at = np.searchsorted(self.hashes, distinct)
        return starts, self.places[at][inverse]

    def _learn(self, cps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        total = int(sizes.sum())
        offset = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes)
        chars = cps[np.arange(total) + offset]
        width = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        data = np.frombuffer(chars.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        lengths = np.add.reduceat(width, np.append(0, np.cumsum(sizes)[:-1]))
        ids, counts = self.vocabulary.encode_words(data, lengths)
        here = len(self.begin)
        self.begin = np.append(self.begin, len(self.flat) + np.append(0, np.cumsum(counts)[:-1]))
        self.count = np.append(self.count, counts)
        self.flat = np.append(self.flat, ids)
        every, place = np.append(self.hashes, hashes), np.append(self.places, np.arange(here, here + len(hashes)))
        order = np.argsort(every)
        self.hashes, self.places = every[order], place[order]

    def batch(self, texts: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and, if asked, the ids of all texts one after the other. Null texts count as empty."""
        values = texts.to_pylist()
        joined = "".join(v for v in values if v)
        size = np.fromiter((len(v) if v else 0 for v in values), np.int64, len(values))
        if not joined:
            return np.zeros(len(values), np.int64), np.zeros(0, np.int32)
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum(size)
        text_starts = (ends - size)[size > 0]
        starts, place = self.words(cps, text_starts)
        counts = self.count[place]
        so_far = np.append(0, np.cumsum(counts))
        per_text = so_far[np.searchsorted(starts, ends)] - so_far[np.searchsorted(starts, ends - size)]
        if not ids:
            return per_text, np.zeros(0, np.int32)
        total = int(so_far[-1])
        source = np.repeat(self.begin[place] - so_far[:-1], counts) + np.arange(total)
        return per_text, self.flat[source]


def _slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about so many bytes with the place each begins at; a longer text comes alone and whole."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids): each text's list of ids, without special tokens. An empty text and a null text give an empty list.

    One pass over two columns without a shuffle. Every row of df gives a row, repeated keys too; a null key stays null.
    """
    path = os.path.join(tokenizers, name)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            keys = batch.column(0)
            for at, texts in _slices(batch.column(1)):
                counts, ids = encoder.batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), lists], ["key", "ids"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): as encode(), only the number of ids, so that no lists leave the workers."""
    path = os.path.join(tokenizers, name)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            keys = batch.column(0)
            for at, texts in _slices(batch.column(1)):
                counts, _ = encoder.batch(texts, ids=False)
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(texts)), pa.array(counts, pa.int64())], ["key", "n_tokens"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint").select(F.col("key").alias(key), "n_tokens")
