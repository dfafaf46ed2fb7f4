"""Functions of a segment's rows, chunk by chunk: what a series' products with its own lags, folds or residuals need, without a task a series."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import shared
from ..sources.panel import SEGMENT, Panel, indexed
from . import lagging


class Chunks:
    """A panel's variables in chunks. `facts` has a row a segment: n, start (the first row's number), m0, m1, .. (means; NaN with a null).

    `longest` is the number of rows of the longest segment.
    """

    def __init__(self, panel: Panel, names: Sequence[str], chunk: int | None = None):
        self.panel, self.names, self.chunk = indexed(panel), list(names), chunk
        p = self.panel
        self.kind = p.df.schema[SEGMENT].dataType.simpleString()
        means = [F.avg(F.coalesce(v, F.lit(math.nan))).alias(f"m{i}") for i, v in enumerate(self.names)]
        self.facts = shared.saved(p.df.groupBy(SEGMENT).agg(F.count("*").alias("n"), F.min(p.index).alias("start"), *means))
        self.longest = self.facts.agg(F.max("n")).first()[0] or 0

    def over_chunks(self, f: Callable[[object, int, np.ndarray, int, int, Mapping], pd.DataFrame], depth: int, schema: str, facts: DataFrame | None = None) -> DataFrame:
        """f(segment, chunk, rows, own, first, facts) -> rows of `schema`, for each chunk.

        Rows come in order, `depth` rows of the segment before the chunk included: row `own` is the chunk's first, and the first of all is
        row `first` of its segment. `facts` has a row a segment, with start, and holds what f is to know of it.
        """
        facts = self.facts if facts is None else facts
        df, _ = lagging.chunked(self.panel, depth, self.chunk if self.chunk is None else max(self.chunk, depth + 1))
        index, count, extra = self.panel.index, len(self.names), [c for c in facts.columns if c != SEGMENT]
        values = [F.coalesce(v, F.lit(math.nan)).alias(f"x{i}") for i, v in enumerate(self.names)]
        rows = df.select(SEGMENT, "__chunk", "__own", F.col(index).cast("long").alias("__at"), *values)
        held = df.where("__own").select(F.col(SEGMENT).alias("__segment"), F.col("__chunk").alias("__part")).distinct()  # a row a chunk
        held = held.join(facts.withColumnRenamed(SEGMENT, "__segment"), "__segment")
        fields = StructType.fromDDL(schema).fieldNames()

        def one(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(right) or not len(left):  # a halo without rows after it
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in fields})
            left, known = left.sort_values("__at"), right.iloc[0]
            x = left[[f"x{i}" for i in range(count)]].to_numpy(float)
            return f(key[0], int(key[1]), x, int((~left["__own"]).sum()), int(left["__at"].iloc[0] - known["start"]), {c: known[c] for c in extra})

        return rows.groupBy(SEGMENT, "__chunk").cogroup(held.groupBy("__segment", "__part")).applyInPandas(one, schema)

    def summed(self, table: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
        """Arrays added up element by element, by segment and keys."""
        cells = table.select(SEGMENT, *keys, F.posexplode(values).alias("i", "v")).groupBy(SEGMENT, *keys, "i").agg(F.sum("v").alias("v"))
        return cells.groupBy(SEGMENT, *keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias(values))
