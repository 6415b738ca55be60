"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected at random to a few blocks of 8 dimensions and each
block is decoded to the nearest point of the lattice E8; the blocks' points
together are a cell.  Every table has projections of its own.  A vector is filed
under its own cell and under the cells next to it that its residual leans to
(the minimal vectors of E8 closest to the residual, one block changed at a
time), so a pair on both sides of a wall still meets.

Vectors that share a cell meet under the cell's least member and are verified
against each other by exact cosine in double precision, in blocks of bounded
size; a block returns a spanning forest, whose components are the link
components.  Links are then counted inside components, again block by block and
without a list of pairs.  Blocks of a large component whose members must all link, or
cannot link, by the distances of their centres and their radii are not compared
vector by vector, so a tight family takes time in proportion to its size.

Vectors equal in label and components are one class with a multiplicity, so
copies are never compared with each other.

Defined results: a vector that is null, empty, zero, or holds null or non-finite
components, or whose label is null, links with nothing.  Vectors of different
lengths are not compared.  Rows with a null id link with nothing and have a null
component.  Rows equal in id, label and vector are counted as copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import in_blocks, spanning_forest, with_chunks
from .common import written
from .components import connected_components
from .words import mixed

TABLES = 6
PARTS = 2  # blocks of 8 dimensions in a table's cell
NEIGHBOURS = 2  # neighbouring cells filed for each block
REACH = 0.35  # distance, in lattice units, that a pair at the threshold has on average in one block
BLOCK = 1024
#: Links are counted in blocks so many times as large, in strips of so many rows: a vector is sent once for each block of its component's rows.
COUNT_BLOCKS, STRIP = 4, 512


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 (rows of 8), doubled so that they are integers."""

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        odd = np.flatnonzero(near.sum(1).astype(np.int64) & 1)
        gap = y[odd] - near[odd]
        worst = np.abs(gap).argmax(1)
        near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return near

    whole, half = even(x), even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return (2 * np.where(closer[:, None], half, whole)).astype(np.int64)


@cache
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [list(s) for s in product((1, -1), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out, np.int64)


@cache
def _projection(dimension: int, tables: int, parts: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, dimension)).standard_normal((dimension, tables * parts * 8)) / np.sqrt(dimension)


@cache
def _multipliers(parts: int) -> np.ndarray:
    return np.random.default_rng(88).integers(0, 1 << 63, parts * 8, dtype=np.uint64) | np.uint64(1)


def cells(unit: np.ndarray, threshold: float, tables: int = TABLES, parts: int = PARTS, neighbours: int = NEIGHBOURS, seed: int = 4) -> np.ndarray:
    """Keys of the cells under which each vector is filed: rows x (tables * (1 + parts * neighbours)), unsigned 64 bit."""
    n, dimension = unit.shape
    spread = np.sqrt(2 - 2 * threshold) * np.sqrt(8 / dimension)
    projected = (unit @ _projection(dimension, tables, parts, seed)) * (REACH / max(spread, 1e-9))
    roots, weights = minimal_vectors(), _multipliers(parts)
    keys = []
    with np.errstate(over="ignore"):
        for t in range(tables):
            points, steps = [], []
            for p in range(parts):
                at = 8 * (t * parts + p)
                y = projected[:, at : at + 8]
                point = nearest_e8(y)
                lean = (2 * y - point) @ roots.T
                nearest = np.argpartition(-lean, neighbours - 1, axis=1)[:, :neighbours] if neighbours else np.zeros((n, 0), np.int64)
                points.append(point)
                steps.append(roots[nearest])
            part_sums = [(points[p].view(np.uint64) * weights[8 * p : 8 * p + 8]).sum(1, dtype=np.uint64) for p in range(parts)]
            home = sum(part_sums[1:], part_sums[0])
            salt = np.uint64((t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            keys.append(mixed(home + salt))
            for p in range(parts):
                for k in range(neighbours):
                    step = (steps[p][:, k].view(np.uint64) * weights[8 * p : 8 * p + 8]).sum(1, dtype=np.uint64)
                    keys.append(mixed(home + step + salt))
    return np.stack(keys, 1)


def _unit(arrays: list[np.ndarray]) -> np.ndarray:
    x = np.array(arrays, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _vectors(column) -> list[np.ndarray]:
    return [np.asarray(v.values.to_numpy(zero_copy_only=False)) for v in column]


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    keys = ["label", "k1", "k2"]
    marked = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"), F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit(1), vector).alias("k2"), fit.alias("fit"))
    rows = written(marked.select("vec_id", *keys, "fit"), "lattice-rows")
    classes = written(marked.where("fit").groupBy(*keys).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "lattice-classes")

    def file_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _vectors(batch.column(2))
            label = np.array([hash(x) & 0x7FFFFFFFFFFFFFFF if not isinstance(x, str) else int.from_bytes(x.encode()[:8], "big") for x in batch.column(1).to_pylist()], np.uint64)
            lengths = np.array([len(v) for v in found])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                filed = cells(_unit([found[i] for i in at]), threshold, tables)
                with np.errstate(over="ignore"):
                    filed = mixed(filed + mixed(label[at] * np.uint64(2) + np.uint64(1))[:, None] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(length))
                nodes = batch.column(0).take(pa.array(np.repeat(at, filed.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(filed.ravel().view(np.int64)), nodes], ["cell", "node"])

    node_type = classes.schema["node"].dataType.simpleString()
    filed = written(classes.select("node", "label", "vector").mapInArrow(file_cells, f"cell long, node {node_type}"), "lattice-cells")
    leaders = filed.groupBy("cell").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader <> last").select("cell", "leader")
    under = written(filed.join(leaders, "cell").select("leader", "node").distinct(), "lattice-candidates")

    def verify(table: pa.Table) -> pa.Table:
        nodes, found, side = table.column("node"), _vectors(table.column("vector").combine_chunks()), np.array(table.column("side").to_pylist())
        label = table.column("label").to_pylist()
        links = _links(found, label, side, threshold)
        forest = spanning_forest(len(found), zip(*[x.tolist() for x in np.nonzero(np.triu(links, 1))], strict=True))
        return pa.table({"a": nodes.take(pa.array([i for i, _ in forest], pa.int64())), "b": nodes.take(pa.array([j for _, j in forest], pa.int64()))})

    carried = classes.select("node", "label", "vector", "copies")
    blocks = in_blocks(with_chunks(under, "leader", block), "leader", "node").join(carried, "node")
    edges = written(blocks.groupBy("leader", "i", "j").applyInArrow(verify, f"a {node_type}, b {node_type}"), "lattice-links")
    roots = written(connected_components(edges), "lattice-components")

    def count(table: pa.Table) -> pa.Table:
        # one component, so one label and length; a block's matrix is made in strips of rows
        unit, side = _unit(_vectors(table.column("vector").combine_chunks())), np.array(table.column("side").to_pylist())
        copies = np.array(table.column("copies").to_pylist(), np.float64)
        across = bool(side.any() and not side.all())
        n = np.zeros(len(unit))
        for at in range(0, len(unit), STRIP):
            strip = slice(at, at + STRIP)
            links = unit[strip] @ unit.T >= threshold
            if across:
                links &= side[strip, None] != side[None, :]
            links[np.arange(links.shape[0]), np.arange(at, at + links.shape[0])] = False
            n[strip] = links @ copies
        return pa.table({"node": table.column("node"), "n": pa.array(n.astype(np.int64))})

    placed = with_chunks(roots.select(F.col("component"), "node"), "component", COUNT_BLOCKS * block).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = written(placed, "lattice-chunks")
    open_, sure = _bounded_pairs(placed, carried, threshold)
    inside = placed.drop("chunks").join(open_, ["component", "chunk"]).join(carried, "node")
    compared = inside.groupBy("component", "i", "j").applyInArrow(count, f"node {node_type}, n long")
    known = placed.join(sure, ["component", "chunk"]).join(carried.select("node", "copies"), "node").select("node", (F.col("n") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("n"))
    counted = compared.unionByName(known).groupBy("node").agg(F.sum("n").alias("others"))
    facts = classes.select(*keys, "node", "copies").join(counted, "node", "left").join(roots, "node", "left")
    facts = facts.select(*[F.col(k).alias(f"f_{k}") for k in keys], (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    matched = rows.join(facts, rows.fit & (F.col("label") == F.col("f_label")) & (F.col("k1") == F.col("f_k1")) & (F.col("k2") == F.col("f_k2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return matched.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _bounded_pairs(placed: DataFrame, carried: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """placed(component, node, chunks, chunk) -> which pairs of chunks are to be compared vector by vector,
    open(component, chunk, i, j, side), and what the others add for certain, sure(component, chunk, n, own).

    A chunk of a large component is summed up as a centre, the greatest distance from
    it, and its copies.  Unit vectors link within sqrt(2 - 2 threshold): two chunks whose
    members all lie nearer than that link throughout, two that all lie farther not at all.
    """
    reach, slack = float(np.sqrt(2 - 2 * threshold)), 1e-9

    def summarise(table: pa.Table) -> pa.Table:
        unit = _unit(_vectors(table.column("vector").combine_chunks()))
        centre = unit.mean(0)
        radius = float(np.sqrt(((unit - centre) ** 2).sum(1).max()))
        return pa.table({"component": table.column("component").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius]), "copies": pa.array([sum(table.column("copies").to_pylist())], pa.int64())})

    kind = placed.schema["component"].dataType.simpleString()
    large = placed.where("chunks > 1").select("component", "chunk", "node").join(carried, "node")
    parts = written(large.groupBy("component", "chunk").applyInArrow(summarise, f"component {kind}, chunk int, centre array<double>, radius double, copies long"), "lattice-centres")
    a, b = parts.alias("a"), parts.alias("b")
    apart = F.sqrt(F.aggregate(F.zip_with("a.centre", "b.centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = F.col("a.radius") + F.col("b.radius")
    pairs = a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.chunk") <= F.col("b.chunk"))).select(
        F.col("a.component").alias("component"), F.col("a.chunk").alias("i"), F.col("b.chunk").alias("j"), F.col("a.copies").alias("n_i"), F.col("b.copies").alias("n_j"),
        F.when(apart + spread < reach - slack, "all").when(apart - spread > reach + slack, "none").otherwise("some").alias("links"),
    )
    pairs = written(pairs, "lattice-chunk-pairs")
    some = pairs.where("links = 'some'").select("component", "i", "j").unionByName(placed.where("chunks = 1").select("component", F.lit(0).alias("i"), F.lit(0).alias("j")).distinct())
    first = some.select("component", F.col("i").alias("chunk"), "i", "j", F.lit(0).alias("side"))
    open_ = first.unionByName(some.where("i < j").select("component", F.col("j").alias("chunk"), "i", "j", F.lit(1).alias("side")))
    whole = pairs.where("links = 'all'")
    gains = whole.select("component", F.col("i").alias("chunk"), F.col("n_j").alias("n"), (F.col("i") == F.col("j")).alias("own")).unionByName(whole.where("i < j").select("component", F.col("j").alias("chunk"), F.col("n_i").alias("n"), F.lit(False).alias("own")))
    return open_, gains.groupBy("component", "chunk").agg(F.sum("n").alias("n"), F.bool_or("own").alias("own"))


def _links(found: list[np.ndarray], labels: list, side: np.ndarray, threshold: float) -> np.ndarray:
    """Which vectors of a block link: equal label and length, cosine at the threshold, and across sides if there are two."""
    lengths = np.array([len(v) for v in found])
    links = np.zeros((len(found), len(found)), bool)
    _, codes = np.unique(np.array([f"{type(x).__name__}{x}" for x in labels]), return_inverse=True)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        unit = _unit([found[i] for i in at])
        links[np.ix_(at, at)] = (unit @ unit.T >= threshold) & (codes[at][:, None] == codes[at][None, :])
    if side.any() and not side.all():
        links &= side[:, None] != side[None, :]
    return links
