"""Centroid clustering of embeddings by Lloyd's rounds on integers, with block-norm screening.

Each vector of `size` components becomes integers floor(scale * x). With it, the Euclidean norms of its consecutive segments are stored
once: the vector compressed to `BLOCKS` numbers. By Cauchy and Schwarz the product of two vectors is at most that of their compressed
forms, so |x|^2 + |c|^2 - 2 <norms(x), norms(c)> is a lower bound of their squared distance, for all centroids by one small matrix product.
A vector tries centroids from the least bound on and stops at the first bound above the best exact distance it has; only those
tried get an exact integer distance. Bounds are lowered by `SLACK` of the norms, more than doubles can err, so results are exact.

A round is one pass over the stored vectors: each task adds up its vectors by cluster, Spark adds up the tasks' sums, and only the
centroids, `clusters` x `size` integers, meet on the driver.

Left out are vectors that are null, of another length, or hold null or non-finite components. Repeated rows are rows; equal ids are told
apart by their components, a null id counts as an empty text. With fewer vectors than `clusters` each starts one. An empty table gives
an empty one. Extra columns are ignored. Components beyond `LARGEST` integers raise an error, as their distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, "1"
#: Segments of a vector, and rows that are compared at once.
BLOCKS, ROWS = 8, 4096
LARGEST, SLACK = 1 << 24, 1e-9


def matrix(column: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of `size` finite components, and these as a matrix of doubles."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls become NaN
    ok = np.isfinite(x).all(axis=1)
    return at[ok], x[ok]


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 32-bit integers."""
    v = np.floor(scale * x)
    if v.size and np.abs(v).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale} have no squared distances in a long")
    return v.astype(np.int32)


def block_norms(x: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """Norms of each row's segments, `blocks` at most."""
    x = x.astype(np.float64)
    starts = np.unique(np.arange(blocks) * x.shape[1] // blocks)
    return np.sqrt(np.add.reduceat(x * x, starts, axis=1))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, screened: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row of x; ties go to the smaller number. `screened` gets the number of exact distances."""
    n = len(x)
    other = block_norms(centroids)
    size = (norms * norms).sum(axis=1)[:, None] + (other * other).sum(axis=1)
    low = size * (1 - SLACK) - 2 * (norms @ other.T) - 1
    order = np.argsort(low, axis=1, kind="stable")
    best, cluster = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    rows = np.arange(n)
    for k in range(len(centroids)):
        j = order[rows, k]
        open_ = low[rows, j] <= best[rows]  # bounds ascend: what is closed once stays closed
        rows, j = rows[open_], j[open_]
        if not len(rows):
            break
        gap = x[rows].astype(np.int64) - centroids[j]
        d = np.einsum("ij,ij->i", gap, gap)
        if screened is not None:
            screened.append(len(rows))
        better = (d < best[rows]) | ((d == best[rows]) & (j < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], j[better]
    return cluster, best


def vectors_of(rows: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v (32-bit integers) and norms (doubles) of the vectors that count; both as bytes."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("norms", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(1), size)
            v = integers(x, scale)
            norms = block_norms(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in norms], pa.binary())], schema=schema)

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, v binary, norms binary")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            b = whole.slice(a, ROWS)
            v = np.frombuffer(b"".join(b.column("v").to_pylist()), np.int32).reshape(-1, size)
            yield b.column("vec_id"), v, np.frombuffer(b"".join(b.column("norms").to_pylist())).reshape(b.num_rows, -1)


def sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and sums of components of each cluster that isn't empty."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, v, norms in _blocks(batches, size):
            cluster, _ = nearest(v, norms, centroids)
            np.add.at(total, cluster, v)
            count += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = vectors.mapInArrow(run, "cluster int, n long, total array<long>")
    found = parts.select("cluster", "n", F.posexplode("total").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.collect():  # a row for each component of a centroid
        out.setdefault(r["cluster"], (r["n"], [0] * size))[1][r["place"]] = r["x"]
    return out


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v, norms in _blocks(batches, centroids.shape[1]):
            cluster, d = nearest(v, norms, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, size: int = SIZE, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of the rows (vec_id, embedding) that count, and the centroids' integers.

    The first centroids are the vectors with the least sha256 of `seed`:vec_id. A round moves each centroid to the floor of
    its vectors' mean; centroids without vectors stay.
    """
    vectors = common.saved(vectors_of(rows, size, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["v"] for r in vectors.select(order.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()]
    centroids = np.frombuffer(b"".join(map(bytes, first)), np.int32).reshape(-1, size).astype(np.int64)
    for _ in range(rounds if first else 0):
        for j, (n, total) in sums(vectors, centroids).items():
            centroids[j] = [x // n for x in total]
    return assign(vectors, centroids), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings with their inertia."""
    assigned, centroids = cluster(common.table(spark, sf_dir, "embeddings"))
    assigned = common.saved(assigned, "assigned")
    own = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # CLUSTERS rows at most
    facts = [(j, d, sum(own.values()), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in own.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same by full distances, in SQL."""
    ctes = [
        f"k AS (SELECT row_number() OVER () AS i, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE))))",
        f"x AS (SELECT i, unnest(range(1, {SIZE + 1})) AS p, unnest(v) AS x FROM k)",
        f"c0 AS (SELECT cluster, unnest(range(1, {SIZE + 1})) AS p, unnest(v) AS c FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS cluster, v FROM k) WHERE cluster < {CLUSTERS})",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS (SELECT i, cluster, d FROM (SELECT i, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{r} USING (p) GROUP BY i, cluster) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, cluster) = 1)")
        if r < ROUNDS:
            ctes.append(f"c{r + 1} AS (SELECT cluster, p, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT cluster, p, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM x JOIN a{r} USING (i) GROUP BY cluster, p) USING (cluster, p))")
    return f"""WITH {", ".join(ctes)}, s AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p)) AS h FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN k USING (i) JOIN s USING (cluster)"""


ORACLE = _sql()
