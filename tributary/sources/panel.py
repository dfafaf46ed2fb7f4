"""Panels: rows (segment_id, t, one column a variable), from frames, CSV files, tables or event streams.

Rows of Spark have no order, so a panel carries its own: t is unique in a segment. Lags never cross a segment.
"""

from __future__ import annotations

import csv
import os
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ColumnError, DataValidationError, EmptyDataError, SchemaMismatchError
from . import shared

SEGMENT, TIME = "segment_id", "t"


@dataclass(frozen=True)
class Panel:
    """A long table of segments and the order of its variables.

    `index` names a column (t, or one that isn't a variable) whose values are consecutive in each segment, if there is one; `whole` says
    that no variable is null or NaN. Both let a segment be cut into chunks without numbering its rows first (`indexed`).
    """

    df: DataFrame
    variables: tuple[str, ...]
    index: str | None = None
    whole: bool = False

    def with_df(self, df: DataFrame, index: str | None = None, whole: bool = False) -> Panel:
        return replace(self, df=df, index=index, whole=whole)

    @property
    def window(self):
        return Window.partitionBy(SEGMENT).orderBy(TIME)


def from_table(df: DataFrame, variables: Sequence[str], segment: str | Column | None = None, order: str | Column = TIME) -> Panel:
    """A panel of a table's columns as doubles; one segment if none is named. Only the named columns are read."""
    require_columns(df.columns, variables, "panel")
    key = F.lit(0) if segment is None else F.col(segment) if isinstance(segment, str) else segment
    at = F.col(order) if isinstance(order, str) else order
    return Panel(df.select(key.alias(SEGMENT), at.alias(TIME), *(F.col(v).cast("double").alias(v) for v in variables)), tuple(variables))


def from_frames(spark: SparkSession, frames, align: bool = False) -> Panel:
    """One pandas frame or a sequence of them, each a segment, rows in the order given.

    All must have the first one's columns (more are left out); with `align`, the union of columns is taken and gaps hold 0.
    """
    frames = [frames] if hasattr(frames, "columns") else list(frames)
    validate_frames(frames, align)
    names = list(dict.fromkeys(c for f in frames for c in f.columns)) if align else list(frames[0].columns)
    parts = []
    for i, f in enumerate(frames):
        f = f.reindex(columns=names, fill_value=0) if align else f[names]
        f = f.astype(float).reset_index(drop=True)
        f.insert(0, TIME, range(len(f)))
        f.insert(0, SEGMENT, i)
        parts.append(f)
    import pandas as pd

    schema = ", ".join([f"{SEGMENT} int", f"{TIME} long", *(f"`{n}` double" for n in names)])
    whole = not any(f.isna().to_numpy().any() for f in parts)
    return Panel(spark.createDataFrame(pd.concat(parts, ignore_index=True), schema), tuple(map(str, names)), TIME, whole)


def union_align(panels: Sequence[Panel]) -> Panel:
    """All panels in one, with the union of their variables in first-seen order; missing variables are 0."""
    if not panels:
        raise EmptyDataError("no panels")
    names = tuple(dict.fromkeys(v for p in panels for v in p.variables))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.df for p in panels))
    new = {v for v in names if any(v not in p.variables for p in panels)}
    return Panel(df.select(SEGMENT, TIME, *(F.coalesce(v, F.lit(0.0)).alias(v) if v in new else F.col(v) for v in names)), names)


def read_csv(spark: SparkSession, paths: str | Sequence[str], index_col: int | str | None = None, order: str | None = None, base: str = ".") -> Panel:
    """CSV files, one segment each, aligned to the union of their columns; the delimiter is sniffed from each header.

    `index_col` names a column (or its place) that isn't a variable. Without an order column, rows keep the order in which they lie in the
    file (of a folder: its files in order of their names), however many splits it is read in: each row's file, the offset of its
    split and its place in the split give its number.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise EmptyDataError("no CSV paths")
    panels = []
    for i, path in enumerate(paths):
        full = resolve(path, base)
        head = spark.read.text(full).first()
        if head is None:
            raise EmptyDataError(f"{full} is empty")
        try:
            sep = csv.Sniffer().sniff(head[0], ",;\t| ").delimiter
        except csv.Error:
            sep = ","
        names = [n.strip() for n in next(csv.reader([head[0]], delimiter=sep))]
        key = names[index_col] if isinstance(index_col, int) else index_col
        schema = ", ".join(f"`{n or '_index'}` {'string' if n == key and order is None else 'double'}" for n in names)
        df = spark.read.schema(schema).option("sep", sep).option("header", True).csv(full)
        variables = [n for n in names if n and n not in (key, order)]
        # rows of one split are read in order, so that these numbers ascend within it
        at = F.col(order).cast("long") if order else F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
        df = df.select(F.lit(i).alias(SEGMENT), at.alias(TIME), *variables)
        panels.append(Panel(df, tuple(variables)))
    return union_align(panels) if order else dense_time(union_align(panels))


def resolve(path: str, base: str = ".") -> str:
    """A path relative to a folder; missing local files raise FileNotFoundError."""
    if shared.remote(path):
        return path
    full = path if os.path.isabs(path) else os.path.join(base, path)
    if not os.path.exists(full):
        raise FileNotFoundError(full)
    return full


def numbered(df: DataFrame, keys: list[str], per: str | None = None) -> DataFrame:
    """df plus __n: 0, 1, .. in order of the keys, within each value of `per` or over all rows, without gathering either: rows are
    dealt by ranges of the keys, numbered where they lie, and moved up by the counts of the ranges before them."""
    import pyarrow as pa

    df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = None if per is None else df.columns.index(per)

    def number(batches):
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), object(), -1
        for b in batches:
            if at is None:
                places = range(n + 1, n + 1 + b.num_rows)
                n += b.num_rows
            else:
                places = []
                for s in b.column(at).to_pylist():
                    n = n + 1 if s == last else 0
                    last = s
                    places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "__part", "__place"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    # written down: counts and rows must come from the same ranges
    placed = shared.saved(df.mapInArrow(number, f"{fields}, __part int, __place long"))
    by = [] if per is None else [per]
    counts = placed.groupBy(*by, "__part").agg(F.count("*").alias("__c"))  # a row for each range (and value)
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__part", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    return placed.join(counts, [*by, "__part"]).select(*df.columns, (F.col("__place") + F.col("__before")).alias("__n"))


def dense_time(panel: Panel) -> Panel:
    """t becomes 0, 1, .. within each segment; no segment is gathered in one task."""
    out = numbered(panel.df.select(SEGMENT, TIME, *panel.variables), [SEGMENT, TIME], SEGMENT)
    return panel.with_df(out.select(SEGMENT, F.col("__n").alias(TIME), *panel.variables), TIME, panel.whole)


def indexed(panel: Panel) -> Panel:
    """The panel with a column of consecutive numbers in each segment: its own, or a new one next to t."""
    if panel.index:
        return panel
    out = numbered(panel.df.select(SEGMENT, TIME, *panel.variables), [SEGMENT, TIME], SEGMENT)
    return panel.with_df(out, "__n", panel.whole)


#: Up to so many rows, the first ones are found by a top-k; beyond it, all rows are numbered in place.
TOP_ROWS = 100_000


def head_sample(df: DataFrame, fraction: float = 1.0, most: int | None = None, segment: str = SEGMENT, order: str = TIME, total: int | None = None) -> DataFrame:
    """The first floor(fraction * n) rows (one at least), `most` at most, in order of (segment, t); not a random sample.

    Rows are only counted and ranked if something is to be left out.
    """
    if not 0 < fraction <= 1:
        raise DataValidationError("the fraction must be in (0, 1]")
    if most is not None and most < 1:
        raise DataValidationError("at least one row must stay")
    if fraction == 1 and most is None:
        return df
    n = df.count() if total is None else total
    keep = max(1, int(fraction * n))
    keep = keep if most is None else min(keep, most)
    if keep >= n:
        return df
    if keep <= TOP_ROWS:
        return df.orderBy(segment, order).limit(keep)
    return numbered(df, [segment, order], None).where(F.col("__n") < keep).drop("__n")


def require_columns(available: Sequence[str], required: Sequence[str], context: str) -> None:
    missing = [c for c in required if c not in set(available)]
    if missing:
        raise ColumnError(f"{context}: no columns {missing}; there are {list(available)}")


def check_roles(variables: Sequence[str], causes=None, effects=None, tested=None) -> tuple[list[str], list[str], list[str]]:
    """Causes, effects and tested causes; empty lists and None mean all, tested causes default to the causes."""
    listed = lambda x: None if x is None or len(x) == 0 else [x] if isinstance(x, str) else list(x)
    causes, effects = listed(causes) or list(variables), listed(effects) or list(variables)
    tested = listed(tested) or list(causes)
    unknown = {k: [v for v in x if v not in variables] for k, x in (("causes", causes), ("effects", effects), ("tested_causes", tested))}
    if any(unknown.values()):
        raise DataValidationError(f"unknown variables: {unknown}")
    return causes, effects, tested


def validate_frames(frames, align: bool = False) -> None:
    if not frames:
        raise EmptyDataError("no frames")
    first = None
    for i, f in enumerate(frames):
        if not hasattr(f, "columns"):
            raise DataValidationError(f"segment {i} is no frame")
        if f.shape[0] == 0 or f.shape[1] == 0:
            raise EmptyDataError(f"segment {i} is empty")
        first = list(f.columns) if first is None else first
        if not align and (missing := [c for c in first if c not in set(f.columns)]):
            raise SchemaMismatchError(f"segment {i} has no columns {missing}")


def drop_nulls(panel: Panel) -> Panel:
    """Without rows in which any variable is null or NaN."""
    if panel.whole:
        return panel
    return panel.with_df(panel.df.select(SEGMENT, TIME, *panel.variables).na.drop("any", subset=list(panel.variables)), whole=True)


def from_events(events: DataFrame, types: Sequence[str], unit: str = "hour", value: str = "value") -> Panel:
    """Sums of `value` per type and calendar unit, 0 where there is none, over all units between the first and the last event.

    One pass of conditional sums; the calendar is a sequence of as many rows as units, joined to the sums.
    """
    seconds = {"hour": 3600, "day": 86400}[unit]
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / seconds)
    sums = events.groupBy(bucket.alias(TIME)).agg(*(F.sum(F.when(F.col("event_type") == t, F.col(value))).alias(t) for t in types))
    ends = events.agg(F.min(bucket).alias("a"), F.max(bucket).alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b")).alias(TIME))
    df = calendar.join(sums, TIME, "left").select(F.lit(0).alias(SEGMENT), TIME, *(F.coalesce(F.round(t, 2), F.lit(0.0)).alias(t) for t in types))
    return Panel(df, tuple(types), TIME, True)
