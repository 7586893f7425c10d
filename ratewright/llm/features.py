"""Hashed text features of whole texts, as flat arrays for linear models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ratewright.llm.common import Words, mix, slices, texts_of

Features = Callable[[list[bytes], int], tuple[np.ndarray, np.ndarray]]


def _salted(h: np.ndarray, salt: int, dims: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(dims - 1)).astype(np.int64)


def _edges(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last eight bytes of each word as numbers (first byte lowest), and its length."""
    length = words.ends - words.starts
    head = np.zeros(len(words), dtype=np.uint64)
    tail = np.zeros(len(words), dtype=np.uint64)
    top = max(len(words.raw) - 1, 0)
    for j in range(8):
        has = length > j
        head |= np.where(has, words.raw[np.minimum(words.starts + j, top)], 0).astype(np.uint64) << np.uint64(8 * j)
        tail |= np.where(has, words.raw[np.maximum(words.ends - 1 - j, 0)], 0).astype(np.uint64) << np.uint64(8 * j)
    return head, tail, length


def _whole(head: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each word by its ends and length, near enough to the word itself."""
    return mix(head * np.uint64(3) + mix(tail + length.astype(np.uint64)))


def form_features(texts: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each word, in text order: mostly what words look like rather than what they say.

    Of each word: the kinds of its first, middle and last byte, those with its length, its last two and three bytes, its
    first four, and whether it repeats one of the four words before it. ``dims`` is a power of two.
    """
    words = Words(texts)
    text = words.text_of()
    if not len(words):
        return text, text
    head, tail, length = _edges(words)
    h = _whole(head, tail, length)
    kind = np.full(256, 4, dtype=np.uint64)
    for k, codes in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256))):
        kind[list(codes)] = k
    middle = words.raw[(words.starts + words.ends) // 2]
    shape = kind[head & np.uint64(255)] * np.uint64(25) + kind[middle] * np.uint64(5) + kind[tail & np.uint64(255)]
    again = np.zeros(len(words), dtype=np.uint64)
    for lag in (1, 2, 3, 4):
        again[lag:] |= ((h[lag:] == h[:-lag]) & (text[lag:] == text[:-lag])).astype(np.uint64) << np.uint64(min(lag, 3) - 1)
    own = [
        _salted(shape, 1, dims),
        _salted(shape * np.uint64(32) + np.minimum(length, 20).astype(np.uint64), 2, dims),
        _salted(tail & np.uint64(0xFFFF), 3, dims),
        _salted(tail & np.uint64(0xFFFFFF), 4, dims),
        _salted(again, 5, dims),
        _salted(head & np.uint64(0xFFFFFFFF), 6, dims),
    ]
    return np.repeat(text, len(own)), np.stack(own, axis=1).ravel()


def word_features(texts: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each lower-case word and of its first three, four, five and six bytes, repeats included."""
    words = Words(texts, lower=True)
    text = words.text_of()
    if not len(words):
        return text, text
    head, tail, length = _edges(words)
    own = [_salted(_whole(head, tail, length), 1, dims)]
    own += [_salted(head & np.uint64((1 << 8 * n) - 1), n, dims) for n in (3, 4, 5, 6)]
    return np.tile(text, len(own)), np.concatenate(own)


def grouped(text: np.ndarray, feature: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (text, feature) pairs, sorted: text, feature, count."""
    code, n = np.unique(text * dims + feature, return_counts=True)
    return code // dims, code % dims, n


def sample_features(rows: DataFrame, features: Features, dims: int) -> pa.Table:
    """To the driver: (mark, feature list, count list) of (mark int, text) rows. For bounded samples only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = texts_of(batch)
            text, feature, n = grouped(*features(texts, dims), dims)
            cuts = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (feature, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["mark", "feature", "count"])

    return rows.select("mark", "text").mapInArrow(run, "mark int, feature array<int>, count array<int>").toArrow()


def flat(sample: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """marks, and of each entry its row, feature and count."""
    marks = sample.column("mark").to_numpy()
    lists = sample.column("feature").combine_chunks()
    row = np.repeat(np.arange(len(marks)), np.asarray(lists.value_lengths()).astype(np.int64))
    return marks, row, lists.flatten().to_numpy(), sample.column("count").combine_chunks().flatten().to_numpy()


class Adam:
    """Steps for one array of parameters."""

    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
