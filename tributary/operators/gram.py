"""Sufficient statistics in one distributed pass: n, sums and products of all columns.

Few columns: sums of products inside of whole-stage code. Many: each partition accumulates one numpy matrix, and Spark adds the
matrices element by element, so nothing but a matrix of fixed size reaches the driver. Centre and scale first: products of
raw columns square the condition number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many columns, products are summed as expressions.
EXPRESSIONS = 12


@dataclass
class Gram:
    """Products of (1, columns) with themselves."""

    columns: tuple[str, ...]
    matrix: np.ndarray

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    def index(self, names: Sequence[str]) -> list[int]:
        at = {c: i + 1 for i, c in enumerate(self.columns)}
        return [at[c] for c in names]

    def affine(self, a: np.ndarray, b: np.ndarray) -> Gram:
        """The statistics of a * x + b, without reading data again."""
        t = np.zeros_like(self.matrix)
        t[0, 0] = 1
        t[1:, 0] = b
        t[1:, 1:] = np.diag(a)
        return Gram(self.columns, t @ self.matrix @ t.T)

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.columns, self.matrix + other.matrix)


def gram(df: DataFrame, columns: Sequence[str]) -> Gram:
    columns = tuple(columns)
    return _by_expressions(df, columns) if len(columns) <= EXPRESSIONS else _by_partitions(df, columns)


def _by_expressions(df: DataFrame, columns: tuple[str, ...]) -> Gram:
    k = len(columns)
    sums = [F.count(F.lit(1)).cast("double")] + [F.sum(c) for c in columns]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums)), *(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    m = np.zeros((k + 1, k + 1))
    m[0] = m[:, 0] = [float(row[i] or 0) for i in range(k + 1)]
    for (i, j), v in zip(pairs, row[k + 1 :], strict=True):
        m[i + 1, j + 1] = m[j + 1, i + 1] = float(v or 0)
    return Gram(columns, m)


def partial_grams(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, value): summed upper triangles of each key's products."""
    k, n_keys = len(columns), len(keys)
    upper = np.triu_indices(k + 1)

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def rows():
            for key, m in held.items():
                v = m[upper]
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(v), t) for x, t in zip(key, types, strict=True)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], names=[*keys, "i", "value"])

        types: list = []
        for b in batches:
            types = [b.schema.field(i).type for i in range(n_keys)]
            if not b.num_rows:
                continue
            x = np.column_stack([np.ones(b.num_rows), *(b.column(n_keys + i).to_numpy(zero_copy_only=False) for i in range(k))])
            if not n_keys:
                held[()] = held.get((), 0) + x.T @ x
                continue
            names = list(zip(*(b.column(i).to_pylist() for i in range(n_keys)), strict=True))
            groups: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                groups.setdefault(name, []).append(i)
            for name, at in groups.items():
                held[name] = held.get(name, 0) + x[at].T @ x[at]
            if len(held) * (k + 1) ** 2 > 4_000_000:  # bounded: give way to what Spark adds up
                yield from rows()
                held.clear()
        yield from rows()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), "i int", "value double"])
    return df.select(*keys, *(F.col(c).cast("double") for c in columns)).mapInArrow(run, fields).groupBy(*keys, "i").agg(F.sum("value").alias("value"))


def from_upper(values: np.ndarray, k: int) -> np.ndarray:
    m = np.zeros((k + 1, k + 1))
    m[np.triu_indices(k + 1)] = values
    return m + m.T - np.diag(np.diag(m))


def _by_partitions(df: DataFrame, columns: tuple[str, ...]) -> Gram:
    values = np.zeros((len(columns) + 1) * (len(columns) + 2) // 2)
    for r in partial_grams(df, columns).collect():  # as many rows as the triangle has cells
        values[r["i"]] = r["value"]
    return Gram(columns, from_upper(values, len(columns)))


def gram_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same as rows (a, b, value), '1' for the constant; a lazy plan."""
    names = ["1", *columns]
    cell = lambda c: F.lit(1.0) if c == "1" else F.col(c)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = df.agg(*(F.sum(cell(a) * cell(b)).alias(f"v{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(pairs)))
    return sums.select(F.inline(rows))
