"""Token-id output: one wavelet matrix per shard, in one compressed file.

A shard holds a contiguous range of document ids.  Its token ids are numbered by
the shard's own sorted alphabet and kept as bit-planes, as many as that needs:
plane b has the b-th highest bit of every number, in the order that the
planes above produce (zeros first, stably).

The file: magic, header length, JSON header, then sections that are compressed
on their own: documents, which of them have an id, lengths, alphabet, the rank
directory (for each plane the ones before each block of BLOCK_BITS, and where its
blocks stand), and the blocks of the planes one by one.  A reader loads all but
the blocks; access(position), rank/count(token), select(token, k) and
occurrences(token) then read a block or two of each plane (`ShardFile`).

A task closes a shard when it holds SHARD_TOKENS tokens and begins the next one,
so neither memory nor files grow with the number of rows in a task.  A document is
never cut; one of more tokens than that is a shard of its own size.

Encoding: text is cut at ASCII white space, which no token of the vocabulary's
pre-tokenizer spans, and a worker encodes each distinct word once, by the
tokenizers library; ids are the same as for the whole text.

Null and odd input: a null or empty text is its end id alone.  Null ids come
first; repeated ids stand side by side, in one task.  An empty table gives no file.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch_path, written
from .files import AtomicFile, open_ranges
from .words import WordMemo, kept, settled

MAGIC = b"LWWM0002"
BITS = 16
BLOCK_BITS = 1 << 16  # places of a plane that are compressed together and that a rank entry covers
#: Tokens at which a task closes a shard and begins the next.
SHARD_TOKENS = 1 << 23
#: Tasks that read shards back, at most; each reads its files one after the other.
MOST_READERS = 20_000
#: Words in each of the two generations that a worker remembers, about 200 bytes each.
MEMO_WORDS = 350_000
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
CAPITAL_BEFORE_MARK = re.compile(rb"[A-Z][\x80-\xff]")
CLOSING = b".,!?;:&%$#*)\"]}"


CHUNK = 1 << 17  # places of a plane that are worked on at a time; they stay in the processor's cache


def split_stably(values: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values where a plane has zeros, and those where it has ones, each in order."""
    off, on = [values[:0]], [values[:0]]
    for at in range(0, len(values), CHUNK):
        part, held = values[at : at + CHUNK], bit[at : at + CHUNK]
        off.append(part[np.flatnonzero(~held)])
        on.append(part[np.flatnonzero(held)])
    return np.concatenate(off), np.concatenate(on)


def merge_stably(off: np.ndarray, on: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Undoes split_stably."""
    out, i, j = np.empty(len(bit), off.dtype), 0, 0
    for at in range(0, len(bit), CHUNK):
        held = bit[at : at + CHUNK]
        ones = np.flatnonzero(held)
        part = out[at : at + CHUNK]
        part[ones] = on[j : j + len(ones)]
        part[np.flatnonzero(~held)] = off[i : i + len(held) - len(ones)]
        i, j = i + len(held) - len(ones), j + len(ones)
    return out


class WaveletMatrix:
    """Bit-planes over uint16 symbols, block by block, with the ones before each block.

    block(level, b) gives a block's bytes: from memory, or out of a file.
    """

    def __init__(self, n: int, zeros: list[int], symbols: np.ndarray, ones: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.zeros, self.symbols, self.ones, self.block = n, zeros, symbols, ones, block
        self.depth = len(zeros)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.zeros(1 << BITS, bool)
        for at in range(0, len(ids), CHUNK):
            seen[ids[at : at + CHUNK]] = True
        symbols = np.flatnonzero(seen).astype(np.uint16)
        codes = np.zeros(1 << BITS, np.uint16)
        codes[symbols] = np.arange(len(symbols), dtype=np.uint16)
        current, planes, zeros = codes[ids], [], []
        for b in range(max(1, int(len(symbols) - 1).bit_length()) - 1, -1, -1):
            bit = (current & np.uint16(1 << b)) != 0
            off, on = split_stably(current, bit)
            planes.append(np.packbits(bit))
            zeros.append(len(off))
            current = np.concatenate((off, on))
        width = BLOCK_BITS // 8
        blocks = -(-len(ids) // BLOCK_BITS)
        ones = np.array([np.cumsum([0, *[int(np.bitwise_count(p[k * width : (k + 1) * width]).sum()) for k in range(blocks)]]) for p in planes], np.int64)
        return cls(len(ids), zeros, symbols, ones, lambda level, k: planes[level][k * width : (k + 1) * width])

    @property
    def blocks(self) -> int:
        return self.ones.shape[1] - 1

    def _bits(self, level: int, k: int) -> np.ndarray:
        return np.unpackbits(self.block(level, k), count=min(BLOCK_BITS, self.n - k * BLOCK_BITS))

    def _look(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bits at the places of a plane (0 at its end), and the ones before them."""
        bits, before = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        of = at // BLOCK_BITS
        for k in np.unique(of).tolist():
            here = np.flatnonzero(of == k)
            inside = at[here] - k * BLOCK_BITS
            before[here] = self.ones[level, k]
            if k == self.blocks:
                continue
            held = self._bits(level, k)
            upto = np.concatenate(([0], np.cumsum(held, dtype=np.int64)))
            before[here] += upto[inside]
            bits[here] = np.append(held, np.uint8(0))[inside]
        return bits, before

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable splits from the lowest plane up."""
        values = np.zeros(self.n, np.uint16)
        for level in range(self.depth - 1, -1, -1):
            packed = [self.block(level, k) for k in range(self.blocks)]
            bit = np.unpackbits(np.concatenate(packed) if packed else np.zeros(0, np.uint8), count=self.n).view(bool)
            z = self.zeros[level]
            values = merge_stably(values[:z], values[z:] | np.uint16(1 << (self.depth - 1 - level)), bit)
        return self.symbols[values]

    def access(self, positions) -> np.ndarray:
        at = np.asarray(positions, np.int64)
        out = np.zeros(len(at), np.uint16)
        for level in range(self.depth):
            bit, ones = self._look(level, at)
            out |= bit.astype(np.uint16) << np.uint16(self.depth - 1 - level)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return self.symbols[out]

    def _code(self, token: int) -> int | None:
        at = int(np.searchsorted(self.symbols, token))
        return at if at < len(self.symbols) and self.symbols[at] == token else None

    def _range(self, token: int, end: int) -> tuple[int, int]:
        code = self._code(token)
        if code is None:
            return 0, 0
        lo, hi = 0, end
        for level in range(self.depth):
            _, ones = self._look(level, np.array([lo, hi], np.int64))
            if code >> (self.depth - 1 - level) & 1:
                lo, hi = int(self.zeros[level] + ones[0]), int(self.zeros[level] + ones[1])
            else:
                lo, hi = int(lo - ones[0]), int(hi - ones[1])
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token in [0, end)."""
        lo, hi = self._range(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bits(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the nth (from 0) bits of the given value in a plane: the block by the directory, then inside it."""
        starts = np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n)
        before = self.ones[level] if bit else starts - self.ones[level]
        of = np.searchsorted(before, nth, "right") - 1
        out = np.zeros(len(nth), np.int64)
        for k in np.unique(of).tolist():
            here = np.flatnonzero(of == k)
            out[here] = k * BLOCK_BITS + np.flatnonzero(self._bits(level, k) == bit)[nth[here] - before[k]]
        return out

    def _upward(self, token: int, at: np.ndarray) -> np.ndarray:
        """From places below the last plane back to positions."""
        code = self._code(token)
        for level in range(self.depth - 1, -1, -1):
            if code >> (self.depth - 1 - level) & 1:
                at = self._select_bits(level, 1, at - self.zeros[level])
            else:
                at = self._select_bits(level, 0, at)
        return at

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        lo, hi = self._range(token, self.n)
        return int(self._upward(token, np.array([lo + k], np.int64))[0]) if 0 <= k < hi - lo else -1

    def occurrences(self, token: int) -> list[int]:
        """All positions of the token, in order."""
        lo, hi = self._range(token, self.n)
        return self._upward(token, np.arange(lo, hi, dtype=np.int64)).tolist() if hi > lo else []


def dump_shard(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, level: int = 1) -> Iterator[bytes]:
    """The shard's file, piece by piece."""
    matrix = WaveletMatrix.build(ids)
    squeeze = zstandard.ZstdCompressor(level=level).compress
    blocks = [squeeze(matrix.block(b, k).tobytes()) for b in range(matrix.depth) for k in range(matrix.blocks)]
    sizes = np.array([len(x) for x in blocks], "<i8")
    known = np.array([d is not None for d in doc_ids], bool)
    sections = [np.array([d if d is not None else 0 for d in doc_ids], "<i8"), np.packbits(known), lengths.astype("<i8"), matrix.symbols.astype("<u2"), matrix.ones.astype("<i8"), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype("<i8")]
    packed = [squeeze(x.tobytes()) for x in sections]
    header = json.dumps({"tokens": int(matrix.n), "docs": len(doc_ids), "zeros": matrix.zeros, "sections": [[len(p), x.nbytes] for p, x in zip(packed, sections, strict=True)]}).encode()
    yield MAGIC + struct.pack("<I", len(header)) + header
    yield from packed
    yield from blocks


class ShardFile:
    """A shard read by ranges: read(offset, length) gives bytes of the file.

    The header, documents and directory are read at once, blocks when they are
    asked for; the last few stay.
    """

    def __init__(self, read: Callable[[int, int], bytes], kept_blocks: int = 64):
        head = read(0, 12)
        if head[:8] != MAGIC:
            raise ValueError("no wavelet shard")
        size = struct.unpack("<I", head[8:12])[0]
        header = json.loads(read(12, size))
        at, expand = 12 + size, zstandard.ZstdDecompressor()
        rest, found = read(at, sum(n for n, _ in header["sections"])), []
        for packed, plain in header["sections"]:
            found.append(expand.decompress(rest[: packed], max_output_size=max(plain, 1)))
            rest = rest[packed:]
            at += packed
        ids = np.frombuffer(found[0], "<i8")
        known = np.unpackbits(np.frombuffer(found[1], np.uint8), count=header["docs"]).astype(bool)
        self.docs = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.lengths = np.frombuffer(found[2], "<i8")
        depth = len(header["zeros"])
        ones = np.frombuffer(found[4], "<i8").reshape(depth, -1)
        places, count = np.frombuffer(found[5], "<i8"), ones.shape[1] - 1

        @lru_cache(kept_blocks)
        def block(level: int, k: int) -> np.ndarray:
            i = level * count + k
            data = read(at + int(places[i]), int(places[i + 1] - places[i]))
            return np.frombuffer(expand.decompress(data, max_output_size=BLOCK_BITS // 8), np.uint8)

        self.matrix = WaveletMatrix(header["tokens"], header["zeros"], np.frombuffer(found[3], "<u2"), ones, block)


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself where it is printable in
    Latin-1, else the next one from U+0100 on."""
    spare = iter(range(256, 512))
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def cased_words(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased where that leaves the ids as they are.

    H and U+0331 have no composed form, h and U+0331 do, so a capital before a
    non-ASCII byte stays in a text with marks.  The marks that compose with
    ASCII letters are all in U+0300 to U+036F, and only U+0300 to U+037F begin
    with the bytes CC and CD.
    """
    if b"<" in text:
        return text.split()
    if b"\xcc" in text or b"\xcd" in text:
        return [w if CAPITAL_BEFORE_MARK.search(w) else w.lower() for w in text.split()]
    return text.lower().split()


class WordEncoder:
    """Encodes whole texts word by word through the tokenizers library, each word once while the memo holds it.

    A run of lower-case letters a-z and U+00DF-U+00FF is one token run that
    normalising leaves alone, so the library's model reads it directly; any
    other word takes the whole path.  Closing punctuation is a run of its own.
    """

    def __init__(self, vocabulary: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        if self._tokenizer.get_vocab_size() > 1 << BITS:
            raise ValueError(f"the vocabulary needs more than {BITS} bits")
        self._model = self._tokenizer.model
        self._symbols = dict(enumerate(byte_symbols()))
        self._ids = WordMemo(self._encode_word, memo_words)

    def _encode_word(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            return array("H", [t.id for t in self._model.tokenize(word.decode())]).tobytes()
        if LETTERS.fullmatch(word):
            text = word.decode("latin-1").translate(self._symbols)
            return array("H", [t.id for t in self._model.tokenize(text)]).tobytes()
        core = word.rstrip(CLOSING)
        # only after a letter or digit does a run of symbols begin
        if core and core != word and b"<" not in word and (core[-1:].isalnum() or LETTERS.fullmatch(core)):
            return self._ids[core] + self._ids[word[len(core) :]]
        return array("H", self._tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """UTF-8 texts -> ids as little-endian uint16.

        The vocabulary's normaliser composes and then lower-cases; only its added
        tokens, which hold "<", see case.  Lower-casing A-Z first is the same but
        for a capital with a combining mark (see cased_words).
        """
        find = self._ids.__getitem__
        gc.disable()  # only byte strings are made, no cycles
        try:
            return [b"".join(map(find, cased_words(t))) for t in texts]
        finally:
            gc.enable()


def encoder_for(vocabulary: str, memo_words: int) -> WordEncoder:
    return kept(("encoder", vocabulary, memo_words), lambda: WordEncoder(vocabulary, memo_words))


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", memo_words: int = MEMO_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write each range of document ids to one file or more; returns the manifest (part, seq, path, docs, tokens), already written."""
    # the text itself is the tie-break of repeated ids, so that reruns agree
    ranged = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part, seq = encoder_for(vocabulary, memo_words), np.array([end_id], "<u2").tobytes(), TaskContext.get().partitionId(), 0
        pieces, doc_ids, lengths, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            file = AtomicFile(folder, f"shard-{part:06d}-{seq:06d}", ".wm")
            for piece in dump_shard(np.frombuffer(b"".join(pieces), "<u2"), doc_ids, np.array(lengths, np.int64)):
                file.stream.write(piece)
            values = [[part], [seq], [file.commit()], [len(doc_ids)], [size]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()], strict=True)], ["part", "seq", "path", "docs", "tokens"])

        for batch in batches:
            codes = encoder.encode([t or b"" for t in batch.column(1).to_pylist()])
            for doc_id, code in zip(batch.column(0).to_pylist(), codes, strict=True):
                n = len(code) // 2 + 1
                if size and size + n > shard_tokens:
                    yield close()
                    pieces, doc_ids, lengths, size, seq = [], [], [], 0, seq + 1
                pieces += (code, end)
                lengths.append(n)
                doc_ids.append(doc_id)
                size += n
        if doc_ids:
            yield close()

    return written(ranged.mapInArrow(settled(write, keeps=True), "part int, seq int, path string, docs long, tokens long"), "wavelet-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32, path."""
    spark = manifest.sparkSession
    by_part, files, start, bases = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("files")).orderBy("part").collect(), 0, 0, []  # a row per writing task
    for r in by_part:
        bases.append((r["part"], start))
        start, files = start + r["tokens"], files + r["files"]
    within = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    based = manifest.withColumn("within", within).join(F.broadcast(spark.createDataFrame(bases, "part int, first long")), "part").select("path", (F.col("first") + F.col("within")).alias("base"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, base in zip(pdf["path"], pdf["base"], strict=True):
                with open_ranges(path) as source:
                    shard = ShardFile(source.read)
                    ids = shard.matrix.decode()
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(shard.docs, "Int64"), "start": begins + base, "n_tokens": shard.lengths, "ids_crc32": np.array(crcs, np.int64), "path": path})

    return based.repartition(max(1, min(files, MOST_READERS))).mapInPandas(settled(read), "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def tokenize_to_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Encode, write the shard files, and read every document back from them."""
    folder = folder or scratch_path(docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, folder, vocabulary, end_id, id_col, text_col, memo_words))
