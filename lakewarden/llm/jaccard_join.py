"""N-gram Jaccard self-join by a grouped prefix join.

A document's set is its distinct 5-word shingles, hashed to 64 bits.  Documents
with equal sets are one class.  Shingles are put in one global order, rarest
first; two sets of similarity t or more share a shingle among the first
n - ceil(t n) + 1 of each (their prefixes), so only classes that share a prefix
shingle are compared:

1. Document frequencies: each task sends its classes' shingles as one packed
   array for each hash range; a range's reducer counts them.  The
   hottest MAX_RANKED shingles and a sieve of those that occur again make the
   order; any common order is correct, a better one only leaves fewer candidates.
2. Prefixes are packed and sent by hash range likewise.  Classes with identical
   prefixes and size are collapsed there into one group; of each shingle's groups
   the one of least identifier leads, and (leader, group) pairs are kept: every
   two groups that share a shingle meet under its leader.  Groups are then
   expanded to their classes.
3. Each leader's classes are verified against each other by exact intersection
   sizes, in blocks of at most BLOCK classes a side.  A block returns a spanning
   forest of its links, so no pair list grows with the square of a group.
4. Components of the forests give the classes' components, hence the documents'.

A shingle in the prefix of more than HOT classes is not sent to one reducer:
its classes are chunked and every two chunks meet in a block of their own.

Defined results: a null text, or one without words, has the empty set, links with
nothing and is its own component; one of fewer words than n has its whole
sequence as its one shingle.  Repeated rows are equal sets.  A null id never
leads a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks, spanning_forest, with_chunks
from .common import packed, written
from .components import connected_components, dealt_apart
from .words import gram_hashes, hashed_words, settled

MAX_RANKED = 1_000_000
HOT = 50_000
SIEVE_BITS = 27
#: Bytes of text whose shingles make up one hash range, at least and, past MANY_RANGES of them, at most: a range's
#: reducer holds their codes of 8 or 12 bytes.
RANGE_BYTES, MOST_RANGE_BYTES, MANY_RANGES = 4 << 20, 64 << 20, 4096
#: Shingles that a task holds before it sends them on: at least, for each range, and at most.
FLUSH, FLUSH_A_RANGE, MOST_FLUSH = 1_000_000, 64, 8_000_000
PREFIX_SCHEMA = "kind int, span int, tokens binary, groups binary, grp long, hot long, df long, cls binary, doc_id long, text_hash long, n long"
#: Classes of a chunk, and shingles of its sets: a block of two chunks holds 32 MB of them at most, one very long text aside.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Documents whose ids are broadcast to pick the texts that need verifying, about 100 bytes each; beyond it they are joined.
MAX_BROADCAST_IDS = 200_000


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = hashed_words(text)
    if not len(words):
        return words
    if len(words) < n:
        return gram_hashes(words, len(words)) + np.uint64(len(words))
    return np.unique(gram_hashes(words, n))


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def prefix_size(n: int, percent: int) -> int:
    """n - ceil(n * percent / 100) + 1."""
    return n - -(-n * percent // 100) + 1


def _ranges(text_bytes: int) -> int:
    """Hash ranges by which packed arrays are reduced, by the size of the texts; a power of two."""
    fine, coarse = -(-text_bytes // RANGE_BYTES), -(-text_bytes // MOST_RANGE_BYTES)
    return 1 << max(4, (max(min(fine, MANY_RANGES), coarse) - 1).bit_length())


def _flush_at(bits: int) -> int:
    """How many shingles a task holds, so that a range still gets some of each batch."""
    return max(FLUSH, min(MOST_FLUSH, FLUSH_A_RANGE << bits))


def _slices(ordered: np.ndarray, bits: int) -> np.ndarray:
    """Where each range of the top `bits` begins in a sorted array, and its end."""
    if bits == 0:
        return np.array([0, len(ordered)])
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate((np.searchsorted(ordered, edges), [len(ordered)]))


def _below(ordered: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below a range's own, which identify a shingle there for counting."""
    return ((ordered << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _pack_shingles(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The shingles of a task's classes by hash range, each with the number of classes that have it: a
    shingle of very many documents is one entry of a batch."""
    seen: set[bytes] = set()
    held: list[np.ndarray] = []
    size, most = 0, _flush_at(bits)

    def flush() -> pa.RecordBatch:
        tokens, times = np.unique(np.concatenate(held), return_counts=True)
        cuts, low, times = _slices(tokens, bits), _below(tokens, bits), times.astype(np.uint32)
        spans = np.flatnonzero(np.diff(cuts))
        pack = lambda x: pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in spans], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(spans.astype(np.int32)), pack(low), pack(times)], ["span", "tokens", "times"])

    for batch in batches:
        for text in batch.column(0):
            shingles = shingle_set(text.as_py(), n)
            if not len(shingles) or (key := set_key(shingles)) in seen:
                continue
            seen.add(key)
            held.append(shingles)
            size += len(shingles)
            if size > most:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _add_counts(table: pa.Table, bits: int, sieve_bits: int) -> pa.Table:
    """One range's packed shingles -> a row for each of three classes or more (the 32 bits below the
    range's, and their number), and one row with the range's part of the sieve: a bit for each of two or more."""
    tokens, times = (np.concatenate([np.frombuffer(b.as_py(), np.uint32) for b in table.column(name)]) for name in ("tokens", "times"))
    order = np.argsort(tokens, kind="stable")
    tokens = tokens[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    total = np.add.reduceat(times[order].astype(np.int64), first)
    sieve = np.zeros(1 << (sieve_bits - bits), bool)
    sieve[tokens[first][total >= 2] >> np.uint32(32 - (sieve_bits - bits))] = True
    many = total >= 3
    found = tokens[first][many].astype(np.int64)
    span = table.column("span")[0].as_py()
    return pa.table({
        "span": pa.array(np.full(len(found) + 1, span, np.int32)), "low": pa.array([None, *found.tolist()], pa.int64()), "df": pa.array([None, *total[many].tolist()], pa.int64()),
        "sieve": pa.array([np.packbits(sieve).tobytes(), *[None] * len(found)], pa.binary()),
    })


class Order:
    """The global order of shingles, the same in every worker and of bounded size.

    Rare first: shingles outside the sieve, then those in it, then the ranked
    ones by frequency.  The sieve has 2 ** sieve_bits bits however many shingles
    there are; one that is in it by chance is in it for every document.
    """

    def __init__(self, tokens: np.ndarray, df: np.ndarray, sieve: np.ndarray, bits: int, sieve_bits: int):
        self.tokens, self.df, self.sieve, self.bits, self.sieve_bits = tokens, df, sieve, bits, sieve_bits
        self.weight = np.minimum(2 + np.log2(np.maximum(df, 1)) * 8, 255).astype(np.uint8)

    @classmethod
    def of(cls, counts: DataFrame, bits: int, sieve_bits: int, most: int) -> Order:
        by_df = {r["d"]: r["n"] for r in counts.where("df IS NOT NULL").groupBy(F.least("df", F.lit(100_000)).alias("d")).agg(F.count("*").alias("n")).collect()}  # 100,000 rows at most
        least, room = 100_001, most
        for d in sorted(by_df, reverse=True):
            if by_df[d] > room:
                break
            least, room = d, room - by_df[d]
        key = F.shiftleft(F.col("span").cast("long"), 32).bitwiseOR(F.col("low"))
        hot = counts.where(F.col("df") >= least).select(key.alias("key"), F.col("df").cast("int").alias("df")).toArrow()  # `most` rows at most
        key = hot.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        part = 1 << (sieve_bits - bits - 3)
        sieve = np.zeros(part << bits, np.uint8)
        for r in counts.where("sieve IS NOT NULL").select("span", "sieve").toLocalIterator():  # 2 ** (sieve_bits - 3) bytes in all
            sieve[r["span"] * part : (r["span"] + 1) * part] = np.frombuffer(r["sieve"], np.uint8)
        return cls(key[order], hot.column("df").to_numpy()[order], sieve, bits, sieve_bits)

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles are in the sieve, and the place of each of those among the ranked ones, or -1."""
        at = (shingles >> np.uint64(64 - self.sieve_bits)).astype(np.int64)
        inside = np.flatnonzero((self.sieve[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
        if not len(self.tokens):
            return inside, np.full(len(inside), -1, np.int64)
        key = shingles[inside] >> np.uint64(32 - self.bits)
        place = np.searchsorted(self.tokens, key)
        place[place == len(self.tokens)] = 0
        return inside, np.where(self.tokens[place] == key, place, -1)

    def prefixes(self, sets: list[np.ndarray], percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each set the first shingles of the order, and how many classes have each as far as it is ranked."""
        joined = np.concatenate(sets)
        inside, place = self.find(joined)
        rank = np.ones(len(inside), np.uint64)
        ranked = place >= 0
        rank[ranked] = self.weight[place[ranked]]
        key = joined >> np.uint64(8)
        key[inside] |= rank << np.uint64(56)
        df = np.ones(len(joined), np.int64)
        df[inside[ranked]] = self.df[place[ranked]]
        out, start = [], 0
        for s in sets:
            end = start + len(s)
            size = prefix_size(len(s), percent)
            chosen = np.argpartition(key[start:end], size - 1)[:size] if size < len(s) else np.arange(len(s))
            out.append((s[chosen], df[start:end][chosen]))
            start = end
        return out


def _pack_prefixes(batches: Iterator[pa.RecordBatch], n: int, bits: int, percent: int, order: Order, hot: int) -> Iterator[pa.RecordBatch]:
    """kind 0: prefixes by hash range, packed as 32-bit shingles and 64-bit groups; kind 1: groups of
    hot shingles, one by one; kind 2: the classes of groups; kind 3: facts of each document.

    Narrow numbers are safe: two shingles or groups taken for one add candidates, which are verified.
    """
    seen: set[bytes] = set()
    facts: list[tuple] = []
    waiting: list[tuple[bytes, np.ndarray]] = []
    size, most = 0, _flush_at(bits)

    def flush() -> pa.RecordBatch:
        sets = [s for _, s in waiting]
        tokens, groups, hots, members = [], [], [], []
        for (key, shingles), (chosen, df) in zip(waiting, order.prefixes(sets, percent) if sets else [], strict=True):
            # the group: an identical prefix and size
            group = xxhash.xxh3_64_intdigest(np.sort(chosen).tobytes() + len(shingles).to_bytes(8, "little"))
            members.append((group, key, len(shingles)))
            busy = df > hot
            hots += [(int(t), group, int(d)) for t, d in zip(chosen[busy].view(np.int64), df[busy], strict=True)]
            tokens.append(chosen[~busy])
            groups.append(group)
        joined = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        own = np.repeat(np.array(groups, np.uint64), [len(t) for t in tokens]) if tokens else np.zeros(0, np.uint64)
        by = np.argsort(joined, kind="stable")
        joined, own = joined[by], own[by]
        cuts, low = _slices(joined, bits), _below(joined, bits)
        spans = np.flatnonzero(np.diff(cuts)).tolist()
        m, h, g, f = len(spans), len(hots), len(members), len(facts)
        signed = lambda x: int(np.uint64(x).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([0] * m + [1] * h + [2] * g + [3] * f, pa.int32()),
                pa.array(spans + [None] * (h + g + f), pa.int32()),
                pa.array([low[cuts[s] : cuts[s + 1]].tobytes() for s in spans] + [None] * (h + g + f), pa.binary()),
                pa.array([own[cuts[s] : cuts[s + 1]].tobytes() for s in spans] + [None] * (h + g + f), pa.binary()),
                pa.array([None] * m + [signed(x[1]) for x in hots] + [signed(x[0]) for x in members] + [None] * f, pa.int64()),
                pa.array([None] * m + [x[0] for x in hots] + [None] * (g + f), pa.int64()),
                pa.array([None] * m + [x[2] for x in hots] + [None] * (g + f), pa.int64()),
                pa.array([None] * (m + h) + [x[1] for x in members] + [x[2] for x in facts], pa.binary()),
                pa.array([None] * (m + h + g) + [x[0] for x in facts], pa.int64()),
                pa.array([None] * (m + h + g) + [x[1] for x in facts], pa.int64()),
                pa.array([None] * (m + h) + [x[2] for x in members] + [x[3] for x in facts], pa.int64()),
            ],
            [c.split()[0] for c in PREFIX_SCHEMA.split(", ")],
        )

    for batch in batches:
        for doc_id, text, text_hash in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            shingles = shingle_set(text.as_py(), n)
            key = set_key(shingles)
            facts.append((doc_id, text_hash, key, len(shingles)))
            if len(shingles) and key not in seen:
                seen.add(key)
                waiting.append((key, shingles))
                size += len(shingles)
            if size > most or len(facts) > 20_000:
                yield flush()
                facts, waiting, size = [], [], 0
    if facts:
        yield flush()


def _lead(table: pa.Table) -> pa.Table:
    """One range's packed prefixes -> distinct (leader, group): each shingle's groups under the least of them."""
    tokens = np.concatenate([np.frombuffer(b.as_py(), np.uint32) for b in table.column("tokens")])
    groups = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table.column("groups")])
    # only shingles that occur again are worth sorting by group
    order = np.argsort(tokens, kind="stable")
    tokens, groups = tokens[order], groups[order]
    same = tokens[1:] == tokens[:-1]
    again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    tokens, groups = tokens[again], groups[again]
    order = np.lexsort((groups, tokens))
    tokens, groups = tokens[order], groups[order]
    starts = np.concatenate(([True], tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, bool)
    leader = groups[np.maximum.accumulate(np.where(starts, np.arange(len(tokens)), 0))] if len(tokens) else groups
    # a group sent by several tasks leads itself alone; such runs are dropped
    differs = np.flatnonzero(groups != leader)
    leads = np.unique(leader[differs])
    pairs = np.stack((np.concatenate((leader[differs], leads)), np.concatenate((groups[differs], leads))), 1)
    pairs = pairs[np.lexsort(pairs.T[::-1])]
    pairs = pairs[np.concatenate(([True], (pairs[1:] != pairs[:-1]).any(1)))] if len(pairs) else pairs
    return pa.table({"leader": pa.array(pairs[:, 0].astype(np.int64)), "grp": pa.array(pairs[:, 1].astype(np.int64))})


def forest(sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets; where sides differ (0, 1) only links across count.

    Intersection sizes come from one sparse incidence list: the sets that hold
    each shingle.  Sets already connected need not be compared again, but are
    counted all the same: a block is bounded.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    joined = np.concatenate(sets)
    own = np.repeat(np.arange(m, dtype=np.int32), n)
    dense = np.zeros((m, m), np.int32)
    order = np.argsort(joined, kind="stable")
    joined, own = joined[order], own[order]
    same = joined[1:] == joined[:-1]
    common = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(joined) else np.zeros(0, bool)
    starts = np.concatenate(([True], ~same))[common] if len(joined) else common
    code, own = np.cumsum(starts, dtype=np.int32) - 1, own[common]
    del order, joined, same, common
    if len(code):
        kinds = int(code[-1]) + 1
        step = min(kinds, max(1, (1 << 24) // m))
        cuts = np.searchsorted(code, np.arange(0, kinds + step, step))
        for at, lo, hi in zip(range(0, kinds, step), cuts[:-1], cuts[1:], strict=False):
            incidence = np.zeros((m, step), np.float32)
            incidence[own[lo:hi], code[lo:hi] - at] = 1
            dense += (incidence @ incidence.T).astype(np.int32)
    union = n[:, None] + n[None, :] - dense
    links = (100 * dense.astype(np.int64) >= percent * union) & (dense > 0)
    if sides.any():
        links &= sides[:, None] != sides[None, :]
    return spanning_forest(m, zip(*[x.tolist() for x in np.nonzero(np.triu(links, 1))], strict=True))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id."""
    return headed_components(docs, **options).drop("head_hash")


def headed_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, block: int = BLOCK, max_ranked: int = MAX_RANKED) -> DataFrame:
    """jaccard_components with head_hash: component_id and it name the one text that leads the component."""
    spark = docs.sparkSession
    bits = _ranges(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary"))).alias("n")).first()["n"] or 0).bit_length() - 1
    sieve_bits = max(SIEVE_BITS, bits + 3)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_hash"))

    shingles = texts.select("text").mapInArrow(settled(lambda batches: _pack_shingles(batches, n, bits)), "span int, tokens binary, times binary")
    counts = written(shingles.groupBy("span").applyInArrow(lambda table: _add_counts(table, bits, sieve_bits), "span int, low long, df long, sieve binary"), "shingle-frequencies")
    order = spark.sparkContext.broadcast(Order.of(counts, bits, sieve_bits, max_ranked))

    prefixes = written(texts.mapInArrow(settled(lambda batches: _pack_prefixes(batches, n, bits, percent, order.value, hot)), PREFIX_SCHEMA), "shingle-prefixes")
    facts = prefixes.where("kind = 3").select("doc_id", "text_hash", "cls", "n")
    led = prefixes.where("kind = 0").select("span", "tokens", "groups").groupBy("span").applyInArrow(_lead, "leader long, grp long").distinct()
    classes_of = prefixes.where("kind = 2").select("grp", "cls", "n").distinct()
    # a group of several classes is a candidate even if no other group shares its shingles
    own = classes_of.join(classes_of.groupBy("grp").agg(F.count("*").alias("m")).where("m > 1"), "grp").select(F.col("grp").alias("leader"), "cls", "n")
    under = led.join(classes_of, "grp").select("leader", "cls", "n").unionByName(own).distinct()
    under = written(under, "shingle-candidates")

    # blocks: a leader's classes in chunks, every chunk with itself and with each other one
    chunked = with_chunks(under, "leader", block, "n", BLOCK_SHINGLES)
    busy = prefixes.where("kind = 1").select("grp", "hot").distinct().join(classes_of, "grp").select(F.xxhash64(F.lit("hot"), F.col("hot")).alias("leader"), "cls", "n").distinct() if order.value.df.max(initial=0) > hot else None
    if busy is not None:
        busy = with_chunks(busy, "leader", block, "n", BLOCK_SHINGLES).select("leader", "cls", "chunks")
        chunked = chunked.select("leader", "cls", "chunks").unionByName(busy)
    members = in_blocks(chunked, "leader", "cls")

    # a class is represented by its least id, a null one only if it has no other, and a text of that id
    named = written(facts.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("least")), "shingle-classes")
    wanted = chunked.select("cls").distinct()
    first = written(named.join(wanted, "cls", "left_semi").select(F.col("least.doc_id").alias("f_id"), F.col("least.text_hash").alias("f_hash")), "shingle-representatives")
    side = F.broadcast(first) if first.count() <= MAX_BROADCAST_IDS else first
    chosen = texts.join(side, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash")), "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keys: list[bytes] = []
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(held, pa.binary())], ["cls", "shingles"])

        for batch in batches:
            for text in batch.column(0):
                shingles = shingle_set(text.as_py(), n)
                if (key := set_key(shingles)) in seen:
                    continue
                seen.add(key)
                keys.append(key)
                held.append(shingles.tobytes())
                size += len(shingles)
                if size > FLUSH:
                    yield flush()
                    keys, held, size = [], [], 0
        yield flush()

    # rows that repeat an id and text give a class once in each task; the verifier drops repeats within a block
    sets = chosen.select("text").mapInArrow(settled(to_sets), "cls binary, shingles binary")

    def verify(table: pa.Table) -> pa.Table:
        once = list({key: at for at, key in enumerate(table.column("cls").to_pylist())}.values())
        keys = [table.column("cls")[at].as_py() for at in once]
        side = np.array(table.column("side").to_pylist())[once]
        arrays = [np.frombuffer(table.column("shingles")[at].as_buffer(), np.uint64) for at in once]
        if table.column("i")[0].as_py() == table.column("j")[0].as_py():
            side[:] = 0
        found = forest(arrays, side, percent)
        return pa.table({"a": pa.array([keys[i] for i, _ in found], pa.binary()), "b": pa.array([keys[j] for _, j in found], pa.binary())})

    blocks = members.join(sets, "cls").groupBy("leader", "i", "j").applyInArrow(verify, "a binary, b binary")
    roots = connected_components(written(blocks, "shingle-links"))

    # classes of one component, and documents of one class
    whole = named.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = dealt_apart(whole.groupBy("component").agg(F.min("least").alias("head")).select("component", F.col("head.doc_id").alias("component_id"), F.col("head.text_hash").alias("head_hash")))
    # written, so that both sides of the join are exchanged as they are and a class of many copies can be split
    labelled = written(whole.join(least, "component").select("cls", "component_id", "head_hash"), "shingle-labels")
    return facts.join(labelled, "cls", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "head_hash")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, that of the least id, all columns kept; documents without words stay.

    Documents are told apart by id and text: of several texts of a component's least id, or of
    a component without ids, that of the least hash stays.  Repeated rows of it are reduced to one.
    """
    labelled = written(headed_components(docs, id_col=id_col, text_col=text_col, **options), "near-duplicates").where("n_shingles > 0")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("head_hash"))
    removed = labelled.where(~kept).select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash")).distinct()
    repeated = labelled.where(kept).groupBy(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash")).count().where("count > 1").drop("count")
    side = F.broadcast(removed) if removed.count() <= MAX_BROADCAST_IDS else removed
    rows = packed(docs, own_id=F.col(id_col).cast("long"), own_hash=F.xxhash64(text_col))
    left = rows.join(side, F.col("own_id").eqNullSafe(F.col("r_id")) & (F.col("own_hash") == F.col("r_hash")), "left_anti")
    if repeated.limit(1).count() == 0:
        return left.select("row.*")
    again = F.col("own_id").eqNullSafe(F.col("d_id")) & (F.col("own_hash") == F.col("d_hash"))
    once = left.join(repeated, again, "left_semi").dropDuplicates(["own_id", "own_hash"])
    return left.join(repeated, again, "left_anti").unionByName(once).select("row.*")
