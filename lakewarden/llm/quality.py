"""Quality classifier by importance resampling.

Generative models over hashed n-grams (words, runs of symbols, pairs of words)
are counted in one pass: of the raw corpus, all documents, and of the target,
the labelled documents of good quality that are not toxic.  Each is counted
twice, by occurrences and by documents that hold a feature.  A document's log
importance is

- the log ratio of the target's model to the raw one, that is the sum over its
  occurrences of log p_target - log p_raw, brought to the length of `nominal`
  features, as the plain sum follows length; and
- an extra term, `emphasis` times the sum over the features that it holds of the
  log ratio by documents where it falls below -`dead_zone`: a long text would
  else hide a few words that good texts never have.

Documents are sampled without replacement in proportion to importance **
(1 / temperature) by Gumbel top-k: a seeded Gumbel draw is added to the log weight
and the k largest keys are kept.  k is the number of documents whose weight
reaches the level that all but `miss` of the held-out good documents reach; the
k-th key is found by nested histograms.

Bounds: labels are a sample of at most `max_labels` rows by id hash, which is
broadcast; counts and weights cover every document.  The number of buckets grows
with the corpus's bytes, by a factor of two for every factor of four up to
2 ** MOST_GROWTH times (about 20 million buckets).  Counts stay on the executors,
which write the model into the shared folder and read it from there.

Defined results: a null or empty text has no features and no weight (null); it is
kept, beside the k that are drawn.  A label with a null in either column is not used.
Rows with one id get the same draw.  Without usable labels every ratio is 1 and
all documents are kept.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash60, packed, shuffle_width, written, written_at
from .files import open_store
from .mixing import find_thresholds
from .words import give_back_memory, gram_hashes, hashes_of, kept, settled

UNIGRAM_BITS, BIGRAM_BITS = 20, 18
#: Bytes of text up to which the models have the bits above, and how often their sizes may double beyond it.
BASE_BYTES, MOST_GROWTH = 1 << 28, 4
#: What a counting task holds: features of documents that it has not added up yet, and different buckets before it sends them on.
PENDING, MOST_HELD = 1_000_000, 4_000_000
KEY_RANGE = 1 << 52
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
SYMBOLS = re.compile(rb"[^a-z0-9\x80-\xff\s]+")
COUNTS = ("raw", "target", "raw_docs", "target_docs")
#: The four counts of a bucket in one long, 16 bits each; larger ones take several rows.
PACKED, SHIFTS = np.uint64((1 << 16) - 1), np.array([48, 32, 16, 0], np.uint64)


@dataclass(frozen=True)
class QualityParameters:
    pseudo: float = 3.0
    dead_zone: float = 1.0
    nominal: float = 100.0
    emphasis: float = 2.0
    temperature: float = 1.0
    miss: float = 0.005
    max_labels: int = 200_000
    seed: int = 2


def growth_of(text_bytes: int) -> int:
    """How often the models' sizes double: half as often as the corpus, as its vocabulary grows more slowly."""
    return min(MOST_GROWTH, max(0, math.ceil(math.log2(max(1, text_bytes) / BASE_BYTES) / 2)))


def bucket_count(growth: int) -> int:
    return (1 << (UNIGRAM_BITS + growth)) + (1 << (BIGRAM_BITS + growth))


def feature_buckets(text: bytes | None, growth: int = 0) -> np.ndarray:
    """Buckets of a text's words, its runs of symbols, and its pairs of neighbouring words.

    Symbols stand apart from the words they cling to, so that decorated words
    do not fill the buckets of rare plain ones.
    """
    low = (text or b"").lower()
    words = hashes_of(WORD.findall(low))
    single = np.concatenate((words, hashes_of(SYMBOLS.findall(low))))
    one = (gram_hashes(single, 1) >> np.uint64(64 - UNIGRAM_BITS - growth)).astype(np.int32)
    two = (gram_hashes(words, 2) >> np.uint64(64 - BIGRAM_BITS - growth)).astype(np.int32) + np.int32(1 << (UNIGRAM_BITS + growth))
    return np.concatenate((one, two))


def count_features(rows: DataFrame, growth: int = 0) -> DataFrame:
    """rows(text binary, target boolean) -> (bucket, raw, target, raw_docs, target_docs) sums over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, np.int32), np.zeros((len(COUNTS), 0))
        found: list[np.ndarray] = []
        times: list[np.ndarray] = []
        good: list[np.ndarray] = []
        size = 0

        def add() -> None:
            nonlocal held, sums
            held, at = np.unique(np.concatenate((held, *found)), return_inverse=True)
            n, fine = np.concatenate(times).astype(float), np.concatenate(good).astype(float)
            one = np.ones(len(n))
            sums = np.stack([np.bincount(at, np.concatenate((before, more)), len(held)) for before, more in zip(sums, (n, n * fine, one, fine), strict=True)])

        def rows_of() -> Iterator[pa.RecordBatch]:
            bucket, left = held, sums.astype(np.uint64)
            while len(bucket):  # more than once only where a count is over 16 bits
                now = np.minimum(left, PACKED)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array((now << SHIFTS[:, None]).sum(0, dtype=np.uint64).view(np.int64))], ["bucket", "packed"])
                left = left - now
                more = left.any(0)
                bucket, left = bucket[more], left[:, more]

        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                buckets, n = np.unique(feature_buckets(text.as_py(), growth), return_counts=True)
                found.append(buckets)
                times.append(n.astype(np.int32))
                good.append(np.full(len(buckets), target))
                size += len(buckets)
                if size > PENDING:
                    add()
                    found, times, good, size = [], [], [], 0
                    if len(held) > MOST_HELD:
                        yield from rows_of()
                        held, sums = held[:0], sums[:, :0]
        if found:
            add()
        yield from rows_of()

    # the four counts of a batch are one long while they are shuffled
    dealt = rows.mapInArrow(settled(count), "bucket int, packed long").repartition(shuffle_width(rows.sparkSession), "bucket")
    unpack = lambda shift: F.shiftrightunsigned("packed", int(shift)).bitwiseAND(F.lit(int(PACKED)).cast("long"))
    return dealt.groupBy("bucket").agg(*[F.sum(unpack(shift)).alias(n) for n, shift in zip(COUNTS, SHIFTS, strict=True)])


def log_ratio(raw: Column, target: Column, share: float, pseudo: float) -> Column:
    """Log ratio of the smoothed target model to the raw one; share: the target's part of all that was counted."""
    return (F.log((target + pseudo) / (raw * share + pseudo)) if share else F.lit(0.0)).cast("float")


def log_importance(found: np.ndarray, by_count: np.ndarray, by_document: np.ndarray, p: QualityParameters) -> float | None:
    """The log weight of a document with the given feature buckets; None if it has none."""
    if not len(found):
        return None
    held = by_document[np.unique(found)].astype(np.float64)
    return p.nominal * float(by_count[found].mean(dtype=np.float64)) + p.emphasis * float(np.minimum(held + p.dead_zone, 0.0).sum())


def load_model(uri: str, growth: int) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios by occurrences and by documents for each bucket; a worker reads them once."""

    def read() -> tuple[np.ndarray, np.ndarray]:
        store, path = open_store(uri)
        table = pq.read_table(path, filesystem=store)
        by_count, by_document = np.zeros(bucket_count(growth), np.float32), np.zeros(bucket_count(growth), np.float32)
        bucket = table.column("bucket").to_numpy()
        by_count[bucket], by_document[bucket] = table.column("by_count").to_numpy(), table.column("by_document").to_numpy()
        return by_count, by_document

    return kept(("quality", uri), read)


class QualityModel:
    """Log ratios by bucket, the level that good documents reach, and the cut of the sampling keys.

    rows: the documents with their log_weight, written once; with all their columns
    as `row` where `carry` is set, so that nobody has to weigh them again.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, parameters: QualityParameters = QualityParameters(), id_col: str = "doc_id", text_col: str = "text", carry: bool = False):
        self.parameters = parameters
        p = parameters
        usable = labels.select(F.col("doc_id").alias("l_id"), (F.col("quality") == 1).alias("fine"), (F.col("toxic") == 1).alias("toxic")).where("l_id IS NOT NULL AND fine IS NOT NULL AND toxic IS NOT NULL")
        usable = usable.groupBy("l_id").agg(F.bool_and(F.col("fine") & ~F.col("toxic")).alias("good")).withColumn("l_hash", hash60(F.lit(p.seed), F.col("l_id")))
        share = min(1.0, p.max_labels / max(1, usable.count()))
        # about max_labels rows; every fifth calibrates the level and stays out of the target model
        sample = usable.where(F.col("l_hash") < int(share * (1 << 60))).withColumn("held", F.col("l_hash") % 5 == 0)
        sample = written(sample.drop("l_hash"), "quality-labels")
        text = F.col(text_col).cast("binary")
        self.growth = growth_of(docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)
        lean = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
        marked = lean.join(F.broadcast(sample.where("good AND NOT held").select("l_id", "good")), F.col("doc_id") == F.col("l_id"), "left")
        counts = written(count_features(marked.select("text", F.coalesce("good", F.lit(False)).alias("target")), self.growth), "quality-counts")
        total = counts.agg(*[F.sum(n).alias(n) for n in COUNTS]).first()
        part = lambda a, b: (total[b] or 0) / total[a] if total[a] else 0.0
        self.ratios, self._uri = written_at(counts.select("bucket", log_ratio(F.col("raw"), F.col("target"), part("raw", "target"), p.pseudo).alias("by_count"), log_ratio(F.col("raw_docs"), F.col("target_docs"), part("raw_docs", "target_docs"), p.pseudo).alias("by_document")), "quality-model")
        weighed = packed(docs, doc_id=F.col(id_col), log_weight=self.log_weight(F.col(text_col))) if carry else lean.select("doc_id", self.log_weight(F.col("text")).alias("log_weight"))
        self.rows = written(weighed, "quality-weights")
        self.weights = self.rows.select("doc_id", "log_weight")
        held = self.weights.join(F.broadcast(sample.where("good AND held").select("l_id")), F.col("doc_id") == F.col("l_id"))
        level = held.agg(F.percentile_approx("log_weight", p.miss, 10_000).alias("level")).first()["level"]
        self.level = -float("inf") if level is None else level
        keyed = self.weights.withColumn("key", self.sampling_key())
        facts = keyed.agg(F.count(F.when(F.col("log_weight") >= self.level, 1)).alias("k"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
        self.k, self._hi = facts["k"], facts["hi"] or 0.0
        self._unit = max((self._hi - (facts["lo"] or 0.0)), 1e-9) / KEY_RANGE
        places = keyed.where("key IS NOT NULL").select(F.lit(None).cast("string").alias("source"), F.lit(1).cast("long").alias("size"), self._place(F.col("key")).alias("h"))
        self.cut = find_thresholds(places, {None: float(self.k)})[None]

    def log_weight(self, text: Column) -> Column:
        uri, growth, p = self._uri, self.growth, self.parameters

        @F.pandas_udf("double")
        def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            by_count, by_document = load_model(uri, growth)
            for texts in batches:
                yield pd.Series([log_importance(feature_buckets(t, growth), by_count, by_document, p) for t in texts], dtype="float64")
            give_back_memory()

        return weigh(text.cast("binary"))

    def sampling_key(self) -> Column:
        """The Gumbel-perturbed log weight, of columns log_weight and doc_id."""
        weight = F.col("log_weight")
        uniform = (hash60(F.lit(self.parameters.seed + 1), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("double") + 0.5) / float(1 << 60)
        return weight / self.parameters.temperature - F.log(-F.log(F.least(uniform, F.lit(1 - 1e-16))))

    def _place(self, key: Column) -> Column:
        """Keys from the largest down as integers, left-aligned in the histogram's 60 bits."""
        below = F.least(F.greatest((F.lit(self._hi) - key) / self._unit, F.lit(0.0)), F.lit(float(KEY_RANGE - 1)))
        return F.when(key.isNotNull(), (below.cast("long") * 256).cast("long"))

    def kept(self, key: Column) -> Column:
        return F.coalesce(self._place(key) < F.lit(self.cut), F.lit(True))


def resample_report(docs: DataFrame, labels: DataFrame, parameters: QualityParameters = QualityParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, log_weight, sampling_key, kept."""
    model = QualityModel(docs, labels, parameters, id_col, text_col)
    return model.weights.withColumn("sampling_key", model.sampling_key()).withColumn("kept", model.kept(F.col("sampling_key")))


def keep_sampled(docs: DataFrame, labels: DataFrame, parameters: QualityParameters = QualityParameters(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the sampling keeps, all columns; they are written once with their weights."""
    model = QualityModel(docs, labels, parameters, id_col, text_col, carry=True)
    return model.rows.where(model.kept(model.sampling_key())).select("row.*")
