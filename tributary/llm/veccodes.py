"""Product codes of embeddings: weighted Lloyd over the distinct integer parts of each position.

Each vector becomes integers floor(scale * x) and is cut into `parts` equal consecutive parts. Equal parts of a position are one
distinct row with a weight, made by one grouping with partial sums, so a part that a third of all vectors hold is one row. Lloyd's rounds
run over the distinct rows: each task adds up its rows' weighted components by entry, Spark adds up the tasks' sums, and only the
codebooks, `parts` x `entries` rows, meet on the driver. Then codes and errors are joined back to the vectors' parts, hot ones by
broadcast (`common.join_hot`), and put together again by row.

Left out are vectors that are null, hold null or non-finite components, or have no `parts` equal parts (lengths that aren't a multiple of
it). Vectors of each length have codebooks of their own; more than `LENGTHS` lengths are an error. Repeated rows are rows; equal ids are
told apart by their components, null ids come last. With fewer vectors than entries each starts one. An empty table gives an empty one.
Columns that aren't named are ignored. Components beyond `clusters.LARGEST` integers raise an error, as their distances don't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, common

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Rows that are compared at once, and different lengths of vectors.
ROWS, LENGTHS = 2048, 64


def vectors_of(rows: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """The rows that count, without their embedding, and v, its integers as bytes."""
    extra = [c for c in rows.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(extra))
            out: list[bytes | None] = [None] * batch.num_rows
            for size in pc.unique(pc.list_value_length(column)).drop_null().to_pylist():
                if size and size % parts == 0:
                    at, x = clusters.matrix(column, size)
                    for i, r in zip(at.tolist(), clusters.integers(x, scale), strict=True):
                        out[i] = r.tobytes()
            v = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(extra)], v], names=[*extra, "v"]).filter(v.is_valid())

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*extra).schema), "v binary"])
    return rows.select(*extra, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, fields)


def parts_of(vectors: DataFrame, width: int, parts: int = PARTS) -> DataFrame:
    """rid, part, value: a row for each part of each vector; `width` integers a part."""
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    return vectors.select("rid", "v", part).select("rid", "part", F.expr(f"substring(v, part * {4 * width} + 1, {4 * width})").alias("value"))


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple]:
    """part, values (integers), weight, code and squared distance of distinct rows, some at a time."""
    width = books.shape[2]
    for whole in batches:
        for a in range(0, whole.num_rows, ROWS):
            b = whole.slice(a, ROWS)
            part = b.column("part").to_numpy()
            x = np.frombuffer(b"".join(b.column("value").to_pylist()), np.int32).reshape(-1, width).astype(np.int64)
            code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                d = np.zeros((len(at), books.shape[1]), np.int64)
                for k in range(width):
                    gap = x[at, k][:, None] - books[p, :, k]
                    d += gap * gap
                code[at] = d.argmin(axis=1)  # the lowest of equal ones
                error[at] = d[np.arange(len(at)), code[at]]
            yield b, part, x, b.column("weight").to_numpy(), code, error


def improved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one weighted round."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, part, x, weight, code, _ in _coded(batches, books):
            at = part.astype(np.int64) * entries + code
            np.add.at(count, at, weight)
            np.add.at(total, at, x * weight[:, None])
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["entry", "n", "total"])

    found = distinct.mapInArrow(run, "entry int, n long, total array<long>").select("entry", "n", F.posexplode("total").alias("place", "x"))
    out = books.copy()
    for r in found.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # as many rows as the codebooks have cells
        out[r["entry"] // entries, r["entry"] % entries, r["place"]] = r["x"] // r["n"]
    return out


def codes_of(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """part, value, weight, code, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, _, _, code, error in _coded(batches, books):
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("value"), b.column("weight"), pa.array(code.astype(np.int32)), pa.array(error)], names=["part", "value", "weight", "code", "error"])

    return distinct.select("part", "value", "weight").mapInArrow(run, "part int, value binary, weight long, code int, error long")


def _of_length(vectors: DataFrame, size: int, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    vectors = vectors.where(F.length("v") == 4 * size)
    width = size // parts
    first = [bytes(r["v"]) for r in vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    books = np.frombuffer(b"".join(first), np.int32).reshape(-1, parts, width).transpose(1, 0, 2).astype(np.int64)
    pieces = parts_of(vectors, width, parts)
    distinct = common.saved(pieces.groupBy("part", "value").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        books = improved(distinct, books)
    codes = common.saved(codes_of(distinct, books), "codes")
    total = codes.agg(F.sum("weight")).first()[0] or 0
    coded = common.join_hot(pieces, codes, ["part", "value"], "weight", total)
    return coded.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("part", "code"))).alias("codes"), F.sum("error").alias("error")), books  # `parts` codes a row


def compress(rows: DataFrame, keep: Sequence[str] = (), scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """vec_id, the columns `keep`, size (components), codes (an array of entries) and error of the rows (vec_id, embedding, ..) that
    count; and the codebooks (parts x entries x width) by size."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: 1 to 256 entries")
    # once written, row numbers stay
    vectors = common.saved(vectors_of(rows.select("vec_id", *keep, "embedding"), scale, parts).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sizes = sorted(r[0] // 4 for r in vectors.select(F.length("v")).distinct().limit(LENGTHS + 1).collect())
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    found = {size: _of_length(vectors, size, parts, entries, rounds) for size in sizes}
    named = vectors.select(*vectors.columns[:-2], (F.length("v") / 4).cast("int").alias("size"), "rid")
    empty = vectors.limit(0).selectExpr("rid", "cast(null AS array<struct<part: int, code: int>>) AS codes", "0L AS error")
    coded = reduce(DataFrame.unionByName, (df for df, _ in found.values()), empty)
    return named.join(coded, "rid").select(*named.columns[:-1], F.transform("codes", lambda c: c["code"]).alias("codes"), "error"), {size: b for size, (_, b) in found.items()}


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all embeddings, and the errors of each label."""
    rows = common.table(spark, sf_dir, "embeddings")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label"), "embedding")
    coded, books = compress(rows, ["label"])
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    coded = common.saved(coded.select("vec_id", "label", "size", code.alias("code"), "error"), "coded")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("members"))
    out = common.join_hot(coded, labels, ["label"], "members", coded.count())
    names = spark.createDataFrame([(size, digest(b)) for size, b in books.items()], "size int, codebooks_sha256 string")  # LENGTHS rows at most
    return out.join(F.broadcast(names), "size").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """The same over all vectors' parts, in SQL; for vectors of one length."""
    width = f"len(v) // {PARTS}"
    ctes = [
        f"k AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE))))",
        f"x AS (SELECT i, (p - 1) // w AS part, (p - 1) % w AS j, x FROM (SELECT i, {width} AS w, unnest(range(1, len(v) + 1)) AS p, unnest(v) AS x FROM k))",
        f"b0 AS (SELECT (p - 1) // w AS part, entry, (p - 1) % w AS j, c FROM (SELECT entry, {width} AS w, unnest(range(1, len(v) + 1)) AS p, unnest(v) AS c FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS entry, v FROM k) WHERE entry < {ENTRIES}))",
    ]
    for r in range(ROUNDS + 1):
        ctes.append(f"a{r} AS (SELECT i, part, entry, d FROM (SELECT i, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{r} USING (part, j) GROUP BY i, part, entry) QUALIFY row_number() OVER (PARTITION BY i, part ORDER BY d, entry) = 1)")
        if r < ROUNDS:
            ctes.append(f"b{r + 1} AS (SELECT part, entry, j, coalesce(m, c) AS c FROM b{r} LEFT JOIN (SELECT part, entry, j, CAST(floor(sum(x) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM x JOIN a{r} USING (i, part) GROUP BY part, entry, j) USING (part, entry, j))")
    return f"""WITH {", ".join(ctes)}, o AS (SELECT i, lower(string_agg(printf('%02x', entry), '' ORDER BY part)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY i),
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, j)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o JOIN k USING (i), h"""


ORACLE = _sql()
