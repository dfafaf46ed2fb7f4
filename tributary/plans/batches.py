"""Products of contiguous batches of rows, for fits that step batch by batch.

One pass numbers the rows in order of (segment, t), another adds up the products of each batch; the table is written down, a row a batch. A
fit replays it in order in each epoch. Steps depend on each other, so this is sequential by nature: the driver holds one batch's
products at a time, or all of them where they have `HELD` cells at most.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TrainingConfigurationError
from ..operators import gram as G
from ..sources import shared
from ..sources.panel import SEGMENT, TIME, numbered
from .solvers import Problem

HELD = 4_000_000


class Batches:
    """Iterates over (rows, xx, xy) of each batch, centred at the means of all rows; `columns` are p features, then the effects."""

    def __init__(self, rows: DataFrame, columns: Sequence[str], problem: Problem, size: int):
        if int(size) != size or size < 1:
            raise TrainingConfigurationError("a batch holds at least one row")
        self.p, self.k = len(problem.x_mean), len(columns)
        self.shift = np.eye(self.k + 1)
        self.shift[1:, 0] = -np.concatenate([problem.x_mean, problem.y_mean])
        placed = numbered(rows.select(SEGMENT, TIME, *columns), [SEGMENT, TIME])
        cells = G.partial_grams(placed.withColumn("__batch", F.floor(F.col("__n") / int(size))), columns, ["__batch"])
        # a fixed number of cells a batch
        self.table = shared.saved(cells.groupBy("__batch").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("cells")).select("__batch", F.transform("cells", lambda c: c["value"]).alias("cells")))
        few = self.table.count() * (self.k + 1) * (self.k + 2) // 2 <= HELD
        self.held = list(self._read()) if few else None

    def _read(self) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        for r in self.table.orderBy("__batch").toLocalIterator():
            m = self.shift @ G.from_upper(np.asarray(r["cells"]), self.k) @ self.shift.T
            yield float(m[0, 0]), m[1 : self.p + 1, 1 : self.p + 1], m[1 : self.p + 1, self.p + 1 :]

    def __iter__(self) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        return iter(self.held) if self.held is not None else self._read()
