"""How well a causality matrix meets the truth: long tables in, one row out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long(matrix: DataFrame, key: str = "effect", value: str = "value") -> DataFrame:
    """A wide matrix (first column: effect) as rows effect, cause, value."""
    causes = [c for c in matrix.columns if c != key]
    return matrix.unpivot([key], causes, "cause", value).withColumnRenamed(key, "effect")


def confusion(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, tn, fn over the pairs that both have; only exact 0 and 1 count, so a signed -1 counts nowhere."""
    both = truth.select("effect", "cause", F.col("value").alias("gt")).join(predicted.select("effect", "cause", F.col("value").alias("pred")), ["effect", "cause"])
    count = lambda p, g: F.count_if((F.col("pred") == p) & (F.col("gt") == g))
    return both.agg(count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 0).alias("tn"), count(0, 1).alias("fn"))


def shd(truth: DataFrame, predicted: DataFrame, double_edges: bool = False, compat: bool = True) -> DataFrame:
    """Structural Hamming distance over the union of all nodes (pairs that only one table has don't count).

    compat: the differences of a pair and of its reverse are added, sums above 1 count as 1, and half of the absolute sum is cut
    to an integer: a reversed edge cancels out, a spurious self-loop counts a half. Without compat, a pair of nodes counts once
    if its edges differ in either direction. `double_edges` counts each direction by itself.
    """
    both = truth.select("effect", "cause", F.col("value").alias("gt")).join(predicted.select("effect", "cause", F.col("value").alias("pred")), ["effect", "cause"])
    edge = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, 1).otherwise(0)
    diff = both.select("effect", "cause", (edge("pred") - edge("gt")).alias("d"))
    if double_edges:
        return diff.agg(F.coalesce(F.sum(F.abs("d")), F.lit(0)).cast("int").alias("shd"))
    if not compat:
        pairs = diff.groupBy(F.least("effect", "cause").alias("a"), F.greatest("effect", "cause").alias("b")).agg(F.max(F.abs("d")).alias("d"))
        return pairs.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("int").alias("shd"))
    # each row meets its reverse: emit both and add up, instead of a self-join
    ways = diff.select(F.inline(F.array(F.struct("effect", "cause", "d"), F.struct(F.col("cause").alias("effect"), F.col("effect").alias("cause"), F.col("d")))))
    sums = ways.groupBy("effect", "cause").agg(F.least(F.sum("d"), F.lit(1)).alias("s"))
    return sums.agg(F.floor(F.coalesce(F.sum(F.abs("s")), F.lit(0)) / 2).cast("int").alias("shd"))


def square(matrix: DataFrame) -> DataFrame:
    """The long matrix over all pairs of its nodes, 0 where it has no row, 1 where it isn't 0; as many rows as pairs of nodes."""
    nodes = matrix.select(F.col("effect").alias("n")).union(matrix.select("cause")).distinct()
    pairs = nodes.select(F.col("n").alias("effect")).crossJoin(nodes.select(F.col("n").alias("cause")))
    return pairs.join(matrix.select("effect", "cause", "value"), ["effect", "cause"], "left").select("effect", "cause", F.when(F.coalesce("value", F.lit(0)) != 0, 1).otherwise(0).alias("value"))


def scores(counts: DataFrame) -> DataFrame:
    """fdr, tpr, fpr, accuracy, precision, recall, f1 from tp, fp, tn, fn; 0 where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select("*", ratio(fp, tp + fp).alias("fdr"), recall.alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def evaluate(truth: DataFrame, predicted: DataFrame, double_edges: bool = False) -> DataFrame:
    """All counts, shd and scores in one row."""
    return scores(confusion(truth, predicted)).crossJoin(shd(truth, predicted, double_edges))


def binarised(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Signed matrices as 0 and 1."""
    return matrix.select(*(F.when(F.col(c) != 0, 1).otherwise(0).alias(c) if c in columns else F.col(c) for c in matrix.columns))
