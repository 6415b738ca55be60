"""Benchmark decontamination by winnowing.

Words are hashed once.  Every window of `span` words keeps the smallest of its
`k`-gram hashes (the leftmost of equals); with span - k + 1 grams a window, two
equal windows always keep the same gram at the same offset, so a shared span of
`span` words or more cannot be missed.  Documents' minima are joined with those
of the benchmark, and each hit is extended to its whole window by comparing the
words around the gram.  Overlapping windows make up longer passages.

An item with fewer words than `span`, but not none, is one window of its own
length and is looked up by the hash of that many words; all such lengths that the
benchmark has are looked up in one pass.

Scale: documents are never shuffled where the benchmark's distinct windows stay
under MAX_BROADCAST_GRAMS; beyond it the minima, not the texts, are shuffled.
Which items a window stands for is looked up for distinct (document, window)
pairs only, so a window shared by many items does not multiply the hits.

Defined results: a null or empty text has no words and no hits; so has an item.
Rows with the same id and text are reported alike; rows with the same id but
other text are judged apart.  Items with a null id mark words but are not
counted as items.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, packed, written

#: Everything but [\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z are lower-cased, which is done word by word.
#: Said positively, as Java matches a negated union of ranges several times slower.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: About 150 bytes each in a broadcast relation: 300 MB at most.
MAX_BROADCAST_GRAMS = 2_000_000


def word_array(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _lower(word: Column) -> Column:
    """A-Z only.  lower() does that, and fast, for words of single bytes; translate() looks up each character."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(_lower(w)))


def word_total(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _at(i: int) -> Column:
    return F.get(F.col("wh"), F.col("p") + i)


def _positions(rows: DataFrame, length: int) -> DataFrame:
    """rows(.., wh) -> one row per window start p, for texts of at least `length` words.

    The bound is in the generator: as a filter it would be pushed below the
    hashing of words, which would then be done twice.
    """
    starts = F.when(F.size("wh") >= length, F.sequence(F.lit(0), F.size("wh") - length)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("p", F.explode(starts))


def winnowed(rows: DataFrame, span: int, k: int) -> DataFrame:
    """rows(.., wh) -> one row per window: its start p, the smallest k-gram hash, with its offset mixed in, as m."""
    names = [f"_g{j}" for j in range(span - k + 1)]
    grams = _positions(rows, span).withColumns({name: F.xxhash64(*[_at(j + i) for i in range(k)]) for j, name in enumerate(names)})
    least = F.least(*names) if len(names) > 1 else F.col(names[0])
    offset = F.lit(len(names) - 1)
    for j in range(len(names) - 2, -1, -1):
        offset = F.when(F.col(names[j]) == F.col("m"), F.lit(j)).otherwise(offset)
    # one long for hash and offset, so that the join's table is keyed by a primitive
    return grams.withColumn("m", least).withColumn("m", F.col("m").bitwiseXOR(offset.cast("long"))).drop(*names)


def _short_windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows(.., wh) -> one row per window of each length: its start p, its length and its key gid, in one pass over the words."""
    starts = F.when(F.size("wh") > 0, F.sequence(F.lit(0), F.size("wh") - 1)).otherwise(F.array().cast("array<int>"))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: F.col("p") + n <= F.size("wh"))
    windows = rows.withColumn("p", F.explode(starts)).withColumn("length", F.explode(fitting))
    return windows.withColumn("gid", F.xxhash64("length", F.slice("wh", F.col("p") + 1, F.col("length"))))


class Benchmark:
    """The benchmark's distinct windows, written once: grams(length, m, gram, gid) and items(gid, item_id)."""

    def __init__(self, items: DataFrame, span: int = 10, k: int = 8, id_col: str = "item_id", text_col: str = "text"):
        if not 1 <= k <= span:
            raise ValueError("k must be from 1 to span")
        self.span, self.k = span, k
        rows = written(items.select(F.col(id_col).alias("item_id"), word_hashes(F.col(text_col)).alias("wh")).where("size(wh) > 0"), "benchmark-words")
        gram = F.slice("wh", F.col("p") + 1, F.lit(span))
        windows = winnowed(rows, span, k).select("item_id", F.lit(span).alias("length"), "m", gram.alias("gram"))
        short = rows.where(F.size("wh") < span).select("item_id", F.size("wh").alias("length"), F.lit(None).cast("long").alias("m"), F.col("wh").alias("gram"))
        self.windows = written(windows.unionByName(short).withColumn("gid", F.xxhash64("length", "gram")), "benchmark-windows")
        self.grams = self.windows.select("length", "m", "gram", "gid").distinct()
        self.items = self.windows.select("gid", "item_id").distinct()
        lengths = {r["length"]: r["n"] for r in self.grams.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `span` rows
        self.long_grams = lengths.pop(span, 0)
        self.short_grams = lengths

    def _joined(self, windows: DataFrame, on: list[str], n: int, length: int) -> DataFrame:
        """Windows that equal a gram: found by hash, extended to the whole window by comparing its words."""
        grams = self.grams.where(F.col("length") == length).select(*on, "gram", "gid")
        if n <= MAX_BROADCAST_GRAMS:
            own = F.slice("wh", F.col("p") + 1, F.lit(length))
            # not an equality: the planner would make it a join key and hash every window's words
            hits = windows.join(F.broadcast(grams), on).where((own <= F.col("gram")) & (own >= F.col("gram")))
        else:
            narrow = windows.select("doc_id", "text_hash", "p", *on, F.slice("wh", F.col("p") + 1, F.lit(length)).alias("own"))
            hits = narrow.join(grams, on).where(F.col("own") == F.col("gram"))
        return hits.select("doc_id", "text_hash", "p", F.lit(length).alias("length"), "gid")

    def hits(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, text_hash, p, length, gid): every window of a document that is a window of an item."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), word_hashes(F.col(text_col)).alias("wh"))
        out = None
        if self.long_grams:
            out = self._joined(winnowed(rows, self.span, self.k), ["m"], self.long_grams, self.span)
        if self.short_grams:
            grams = self.grams.where(F.col("length") < self.span).select("gid", "gram")
            side = F.broadcast(grams) if sum(self.short_grams.values()) <= MAX_BROADCAST_GRAMS else grams
            own = _short_windows(rows, sorted(self.short_grams)).select("doc_id", "text_hash", "p", "length", "gid", F.slice("wh", F.col("p") + 1, F.col("length")).alias("own"))
            more = own.join(side, "gid").where("own = gram").select("doc_id", "text_hash", "p", "length", "gid")
            out = more if out is None else out.unionByName(more)
        if out is None:
            out = rows.where("false").select("doc_id", "text_hash", F.lit(0).alias("p"), F.lit(0).alias("length"), F.lit(0).cast("long").alias("gid"))
        return out


def hit_words(hits: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_hit): words inside any hit window.  A partition of the window is one document's hits."""
    reach = hits.groupBy("doc_id", "text_hash", "p").agg(F.max("length").alias("length"))
    order = W.partitionBy("doc_id", "text_hash").orderBy("p")
    before = F.max(F.col("p") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("p") + F.col("length") - F.greatest(F.col("p"), F.coalesce(before, F.lit(0))))
    return reach.withColumn("fresh", fresh).groupBy("doc_id", "text_hash").agg(F.sum("fresh").cast("long").alias("n_hit"))


def contamination_report(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated."""
    benchmark = Benchmark(items, span, k)
    hits = written(benchmark.hits(docs, id_col, text_col), "benchmark-hits")
    key = ["doc_id", "text_hash"]
    found = (
        hits.select(*key, "gid").distinct().join(benchmark.items.where("item_id IS NOT NULL"), "gid").select(*key, "item_id").distinct()
        .groupBy(*key).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    )  # a document's items are at most the benchmark's
    words = hit_words(hits)
    facts = words.join(found, (words.doc_id.eqNullSafe(found.doc_id)) & (words.text_hash == found.text_hash), "left").select(words.doc_id.alias("h_id"), words.text_hash.alias("h_hash"), "n_hit", "n_items", "item_ids")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), word_total(F.col(text_col)).alias("n_words"))
    return base.join(facts, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, span: int = 10, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any hit, all columns kept."""
    hits = Benchmark(items, span, k).hits(docs, id_col, text_col).select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash")).distinct()
    hits = written(hits, "benchmark-hit-documents")
    rows = packed(docs, doc_id=F.col(id_col), text_hash=F.xxhash64(F.col(text_col)))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left_anti").select("row.*")
