"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected onto many random directions. Two vectors whose cosine is at least the threshold lie at most
r = sqrt(2 - 2 * threshold) apart, so their projections onto a direction differ by about N(0, r / sqrt(d)): a window of
`WINDOW` such deviations around the query's projection holds the other with a known probability. Over `COUNTING` directions
the number of collisions of a pair is binomial, and the count that a pair must reach is calibrated to lose fewer than one in
10,000 pairs at the threshold (`least_count`). Pairs that reach it are verified by their cosine in double precision.

Counting every pair that collides on one direction would be quadratic, so counters are only kept where it pays: each of
several tables cuts some directions at once into windows of `WIDTH` deviations with random offsets, and pairs are
counted inside of a joint window, in blocks of at most `jaccard.BLOCK` a side, in the first table that joins them. For n
vectors, `design` takes as many directions as leave an unrelated vector `MATES` companions in its window, and as many tables as
join a pair at the threshold with probability `JOINED`: rows grow as n to the power 1.2, and recall stays the same.

Equal vectors form a class, named by 128 bits, and are compared once. Vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths neither. Others are scaled before they are squared, so very small and very
large ones link like all. Repeated rows count as copies. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph, jaccard, tokens

THRESHOLD = 0.95
WIDTH, MATES, JOINED = 5.0, 0.1, 0.998
COUNTING, WINDOW, RECALL = 64, 2.0, 0.9999
SEED = 20240901


def least_count(n: int = COUNTING, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall`."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for k in range(n, -1, -1):
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
    return 0


def design(n: int, threshold: float) -> tuple[int, int]:
    """Tables, and directions of each.

    In units of a pair's deviation r / sqrt(d), a pair at the threshold differs by N(0, 1) and unrelated unit vectors by
    N(0, sqrt(2) / r); within a window of width w at a random offset, N(0, s) stays with the probability `stays`.
    """
    r = math.sqrt(max(2 - 2 * threshold, 1e-6))

    def stays(s: float) -> float:
        z = WIDTH / s
        return math.erf(z / math.sqrt(2)) - math.sqrt(2 / math.pi) / z * (1 - math.exp(-z * z / 2))

    joint = max(4, math.ceil(math.log(max(n, 2) / MATES) / -math.log(stays(math.sqrt(2) / r))))
    return math.ceil(math.log(1 - JOINED) / math.log(1 - stays(1.0) ** joint)), joint


def directions(dim: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit directions (dim x count) and offsets of their windows, in windows."""
    rng = np.random.default_rng((SEED, dim))
    d = rng.standard_normal((count, dim)).T
    return d / np.linalg.norm(d, axis=0), np.random.default_rng((SEED, dim, 1)).random(count)


def cells_of(v: np.ndarray, direction: np.ndarray, offset: np.ndarray, tables: int, joint: int, threshold: float) -> np.ndarray:
    """The joint window of each table for unit vectors v, as longs."""
    dim = v.shape[1]
    w = np.floor(v @ direction / (WIDTH * deviation(dim, threshold)) + offset).astype(np.int64).astype(np.uint64).reshape(-1, tables, joint)
    h = np.full(w.shape[:2], dim, np.uint64)
    for k in range(joint):
        h = tokens._mix(h ^ w[:, :, k])
    return h.view(np.int64)


def deviation(dim: int, threshold: float) -> float:
    return math.sqrt(max(2 - 2 * threshold, 0) / dim)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = []
    for x in column:
        v = None
        if x.is_valid and len(x.values) and not x.values.null_count:
            v = np.asarray(x.values, np.float64)
            if not np.isfinite(v).all() or not v.any():
                v = None
        out.append(v)
    return out


def classes_of(rows: DataFrame) -> DataFrame:
    """vec_id, c and c2 (the vector's class; null: links with nothing), vec (doubles as bytes)."""
    schema = pa.schema([("vec_id", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            raw = [None if v is None else v.tobytes() for v in _vectors(batch.column(1))]
            names = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            c, c2 = ([None if x is None else int.from_bytes(x[k : k + 8], "little", signed=True) for x in names] for k in (0, 8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, pa.int64()), pa.array(c2, pa.int64()), pa.array(raw, pa.binary())], schema=schema)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, c long, c2 long, vec binary")


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw)).reshape(-1, dim)
    # scaled by the largest component first, so that squares of very small ones don't vanish
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spread(classes: DataFrame, tables: int, joint: int, threshold: float) -> DataFrame:
    """tree (the table), prefix (its joint window) and c for each class and table."""
    schema = pa.schema([("tree", pa.int32()), ("prefix", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for a in range(0, whole.num_rows, 2000):
                batch = whole.slice(a, 2000)
                raw, c = batch.column(1).to_pylist(), batch.column(0).to_numpy()
                sizes = np.array([len(x) // 8 for x in raw])
                for dim in np.unique(sizes).tolist():
                    if dim not in known:
                        known[dim] = directions(dim, tables * joint)
                    at = np.flatnonzero(sizes == dim)
                    cells = cells_of(_unit([raw[k] for k in at], dim), *known[dim], tables, joint, threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), pa.array(cells.reshape(-1)), pa.array(np.repeat(c[at], tables))], schema=schema)

    return classes.select("c", "vec").mapInArrow(run, "tree int, prefix long, c long")


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (c, links, root): vectors linked to c (copies counted), and a smaller linked class or c; several rows a class."""
    tables, joint = design(classes.count(), threshold)
    result = pa.schema([("c", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = least_count()
        known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for t in jaccard._groups(batches, 4):
            table, prefix, i, j, own, c = (t.column(k).to_numpy() for k in range(6))
            raw, copies = t.column(6).to_pylist(), t.column(7).to_numpy()
            dims = np.array([len(x) // 8 for x in raw])
            count: dict[int, int] = {}
            up: dict[int, int] = {}
            vec, proj, slot = {}, {}, np.zeros(len(raw), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                slot[at] = np.arange(len(at))
                vec[dim] = _unit([raw[k] for k in at], dim)
                if dim not in known:
                    known[dim] = (directions(dim, COUNTING)[0].astype(np.float32), *directions(dim, tables * joint))
                proj[dim] = vec[dim].astype(np.float32) @ known[dim][0]
            for left, right in jaccard._pairs((table, prefix, i, j), own, 50_000):
                for dim in np.unique(dims[left]).tolist():
                    mine = (dims[left] == dim) & (dims[right] == dim)
                    x, y = left[mine], right[mine]
                    near = np.abs(proj[dim][slot[x]] - proj[dim][slot[y]]) <= WINDOW * deviation(dim, threshold)
                    ok = near.sum(axis=1) >= need
                    x, y = x[ok], y[ok]
                    ok = np.einsum("ij,ij->i", vec[dim][slot[x]], vec[dim][slot[y]]) >= threshold
                    x, y = x[ok], y[ok]
                    if not len(x):
                        continue
                    # a pair counts in the first table that joins it
                    rows, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                    cells = cells_of(vec[dim][slot[rows]], *known[dim][1:], tables, joint, threshold)
                    ok = (cells[at[: len(x)]] == cells[at[len(x) :]]).argmax(axis=1) == table[x]
                    for p, q in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                        a, b = int(c[p]), int(c[q])
                        count[a] = count.get(a, 0) + int(copies[q])
                        count[b] = count.get(b, 0) + int(copies[p])
                        u, v = sorted((jaccard._top(up, a), jaccard._top(up, b)))
                        up[v] = u
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.int64()), pa.array(list(count.values()), pa.int64()), pa.array([jaccard._top(up, v) for v in count], pa.int64())], schema=result)

    keys = ["tree", "prefix", "i", "j"]
    members = jaccard.blocks(spread(classes, tables, joint, threshold), classes.select("c", "vec", "copies"))
    return members.repartition(*keys).sortWithinPartitions(*keys, "c").mapInArrow(run, "c long, links long, root long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row (vec_id, embedding)."""
    named, classes = common.classes(common.saved(classes_of(rows), "vectors"), [F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")])
    found = common.saved(links(classes, threshold), "links")
    roots = graph.components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    roots = common.saved(roots.join(classes.select(F.col("c").alias("node"), "rep"), "node"), "roots")
    low = roots.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("members"))
    roots = common.join_hot(roots, low, ["root"], "members", roots.count()).select(F.col("node").alias("c"), "component")
    facts = classes.select("c", "rep", "copies").join(found.groupBy("c").agg(F.sum("links").alias("links")), "c", "left").join(roots, "c", "left")
    out = common.join_hot(named.select("vec_id", "c"), facts, ["c"], "copies", named.count())
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings at a cosine of 0.95."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))
