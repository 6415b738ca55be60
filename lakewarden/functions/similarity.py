"""Character-shingle similarity: normal form, MinHash signatures, exact Jaccard."""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
LOWEST = 50  # shingle hashes that a signature looks at
SEED = 42
NOT_WORD = re.compile(r"[^\w\s]")
SPACE = re.compile(r"\s+")


def normal_form(text: str) -> str:
    return SPACE.sub(" ", NOT_WORD.sub(" ", text.lower())).strip()


def shingle_set(text: str, k: int) -> set[str]:
    if not text:
        return set()
    return {text} if len(text) <= k else {text[i : i + k] for i in range(len(text) - k + 1)}


@cache
def hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    draw = random.Random(SEED)
    pairs = [(draw.randint(1, PRIME - 1), draw.randint(0, PRIME - 1)) for _ in range(size)]
    return np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)


_memo: dict[str, int] = {}


def shingle_hash(shingle: str) -> int:
    """31 bits of SHA-256; a worker's memo is emptied at a million shingles."""
    value = _memo.get(shingle)
    if value is None:
        if len(_memo) >= 1_000_000:
            _memo.clear()
        value = _memo[shingle] = int.from_bytes(hashlib.sha256(shingle.encode("utf-8")).digest()[:4], "big") & 0x7FFFFFFF
    return value


def signature(shingles: set[str], size: int) -> list[int]:
    if not shingles:
        return [0] * size
    a, b = hash_family(size)
    lowest = np.array(sorted(map(shingle_hash, shingles))[:LOWEST], np.int64)
    return ((a[:, None] * lowest[None, :] + b[:, None]) % PRIME).min(1).tolist()


def jaccard(a: set[str], b: set[str]) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def shingle_codes(text: str, k: int) -> np.ndarray:
    """A text's distinct shingles as longs: up to three characters are packed, longer ones hashed to 64 bits."""
    if not text:
        return np.zeros(0, np.int64)
    if k > 3:
        return np.array(sorted(int.from_bytes(hashlib.sha256(s.encode("utf-8")).digest()[:8], "big", signed=True) for s in shingle_set(text, k)), np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    width = min(k, len(points))
    codes = points[: len(points) - width + 1].copy()
    for i in range(1, width):
        codes = codes << 21 | points[i : len(points) - width + 1 + i]
    return np.unique(codes)


def unpacked(code: int) -> str:
    out = ""
    while code:
        out = chr((code & 0x1FFFFF) - 1) + out
        code >>= 21
    return out


class _CodeHashes(dict):
    """Packed shingle -> its hash; a worker's memo is emptied at a million shingles."""

    def __missing__(self, code: int) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[code] = shingle_hash(unpacked(code))
        return value


_code_hashes = _CodeHashes()


def code_signature(text: str, codes: np.ndarray, k: int, size: int) -> list[int]:
    """signature() of a text's shingles, from their packed codes."""
    if not len(codes):
        return [0] * size
    if k > 3:
        return signature(shingle_set(text, k), size)
    hashes = np.fromiter(map(_code_hashes.__getitem__, codes.tolist()), np.int64, len(codes))
    lowest = np.sort(hashes)[:LOWEST] if len(hashes) <= LOWEST else np.sort(np.partition(hashes, LOWEST - 1)[:LOWEST])
    a, b = hash_family(size)
    return ((a[:, None] * lowest[None, :] + b[:, None]) % PRIME).min(1).tolist()


def sketch_udf(k: int, size: int):
    """Text -> (n, sig) of its normal form: the number of its shingles and their signature."""

    @F.arrow_udf("struct<n: int, sig: array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        counts, sigs = [], []
        for text in texts:
            norm = normal_form(text.as_py() or "")
            codes = shingle_codes(norm, k)
            counts.append(len(codes))
            sigs.append(code_signature(norm, codes, k, size))
        signed = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * size), pa.array(np.array(sigs, np.int64).ravel()))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), signed], ["n", "sig"])

    return sketch


def code_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct codes; two empty ones are equal."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if not len(few):
        return 0.0 if len(many) else 1.0
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return both / (len(few) + len(many) - both)


def scores(threshold: float, k: int):
    """(pairs(src, tgt, ..), members(.., id, text)) -> the pairs at the threshold with their Jaccard similarity."""

    def score(pairs: pa.Table, members: pa.Table) -> pa.Table:
        codes = {i: shingle_codes(normal_form(text), k) for i, text in zip(members.column("id").to_pylist(), members.column("text").to_pylist(), strict=True)}
        found = [(src, tgt, value) for src, tgt in zip(pairs.column("src").to_pylist(), pairs.column("tgt").to_pylist(), strict=True) if (value := code_jaccard(codes[src], codes[tgt])) >= threshold]
        return pa.table({"src": pa.array([x[0] for x in found], pa.string()), "tgt": pa.array([x[1] for x in found], pa.string()), "jaccard": pa.array([x[2] for x in found], pa.float64())})

    return score


def text_jaccard_udf(k: int):
    """Jaccard similarity of two texts' shingles; a text that stands in the row before is not cut again."""

    @F.arrow_udf("double")
    def similarity(left: pa.Array, right: pa.Array) -> pa.Array:
        last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.int64))
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            if a != last[0]:
                last = (a, shingle_codes(normal_form(a), k))
            out.append(code_jaccard(last[1], shingle_codes(normal_form(b), k)))
        return pa.array(out, pa.float64())

    return similarity
