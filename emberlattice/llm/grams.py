"""Word hashes, rolling windows of them, and blobs of numbers dealt to buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import xxhash

PRIME = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, kept in the worker up to a bound."""

    def __init__(self, bound: int = 200_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all (a public 64-bit finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` consecutive entries; as many as there are such runs."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, width):
        out *= PRIME
        out += hashes[j : j + n]
    return mixed(out)


def windows_of(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents laid end to end: whether a window that starts at each entry stays in its document (for all but the
    last width - 1 entries), and the document of each entry."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = max(0, len(owner) - width + 1)
    return owner[:n] == owner[len(owner) - n :] if n else np.zeros(0, dtype=bool), owner


def by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Each bucket that occurs with its part of every column as bytes, in the order given."""
    order = np.argsort(bucket, kind="stable")
    ordered = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1, [len(ordered)]])
    columns = [c[order] for c in columns]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            yield int(ordered[a]), [c[a:b].tobytes() for c in columns]


def joined_blobs(column, dtype) -> np.ndarray:
    """The numbers of a column of blobs, one after another."""
    return np.frombuffer(b"".join(x.as_py() for chunk in column.chunks for x in chunk), dtype=dtype)


def chunks(texts, numbers: Callable[[str], np.ndarray], most: int = 1_500_000) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of documents with about `most` numbers: begin, end, and each document's numbers (a null text counts as empty)."""
    begin, size, parts = 0, 0, []
    for i, text in enumerate(texts):
        parts.append(numbers(text.as_py() or ""))
        size += len(parts[-1])
        if size >= most:
            yield begin, i + 1, parts
            begin, size, parts = i + 1, 0, []
    if parts:
        yield begin, begin + len(parts), parts
