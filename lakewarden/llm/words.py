"""Word hashing for operators that work on arrays of hashed words in Python workers."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

#: The longest word that a worker's memo keeps.
MEMO_WORD_BYTES = 64


def give_back_memory() -> None:
    """Return what a task has freed to the system: idle workers wait beside the JVM's heap in one executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


_kept: dict = {}


def kept(key, make: Callable):
    """What a worker keeps from one task to the next, made once; one thing at a time, as workers serve every operator."""
    if key not in _kept:
        forget()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    if _kept:
        _kept.clear()
        give_back_memory()


def settled(work: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """The same work on a task's batches; memory is given back when the task ends, and what another operator
    has kept is given back when it begins, unless the work keeps something itself."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        if not keeps:
            forget()
        try:
            yield from work(batches)
        finally:
            give_back_memory()

    return run


class WordMemo(dict):
    """Word -> what compute(word) gives, each word once while it is in use.

    Two generations of `size` words bound it: when the young one is full it
    becomes the old one, and words that are met again move over.
    """

    def __init__(self, compute, size: int):
        super().__init__()
        self._compute, self._size, self._old = compute, size, {}

    def __missing__(self, word: bytes):
        value = self._old.get(word)
        if value is None:
            value = self._compute(word)
        if len(word) <= MEMO_WORD_BYTES:
            if len(self) >= self._size:
                self._old = dict(self)
                self.clear()
            self[word] = value
        return value


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def hashed_words(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, A-Z lower-cased."""
    return hashes_of(text.lower().split() if text else [])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _factor(i: int) -> np.uint64:
    """Odd and without a pattern: factors in progression would give (a, b, b, a) and (b, a, a, b) one sum."""
    return np.uint64(xxhash.xxh3_64_intdigest(i.to_bytes(8, "little")) | 1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, in order; empty if there are fewer.

    Word hashes are random 64-bit numbers, so their sum with an odd factor for
    each place tells runs apart; one finaliser spreads it.
    """
    if len(words) < n:
        return words[:0]
    size = len(words) - n + 1
    out = words[:size] * _factor(0)
    for i in range(1, n):
        out += words[i : i + size] * _factor(i)
    return mixed(out)
