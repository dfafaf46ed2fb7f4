"""Orders of differencing by unit-root tests, from sums: no series is gathered in one task.

A segment is cut into chunks with a halo (`lagging.chunked`). Each chunk gives a variable's products with its own lags, which Spark adds up;
one small row a series then holds all that its test needs.

* ADF: the regressions on 0, 1, .. lagged differences share one matrix of products. Entry (i, j) is the product of differences i and j rows
  back, which is the one of lag j - i but for rows at both ends of the series, so a chunk sends a number a lag, and the matrix
  is filled in from the series' first and last rows. Samples that begin before the common one get their rows back from the first rows.
* KPSS: a pass for the trend, one for residuals' products and partial sums (a chunk's own ones, moved by what lies before it), and
  one for the products of longer lags if the bandwidth asks for them.

A series with nulls or NaN has p-values that aren't numbers, which count as failed tests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import normal_cdf
from ..sources import shared
from ..sources.panel import SEGMENT, Panel
from . import lagging
from .chunks import Chunks

#: MacKinnon's (1994) response surface for a unit-root test with a constant: fixed values. Small p up to TAU_STAR, large above.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
#: Kwiatkowski et al. (1992): critical values of the test with a trend and their p-values: fixed values.
KPSS_LEVELS = ((0.119, 0.10), (0.146, 0.05), (0.176, 0.025), (0.216, 0.01))


def schwert(n: int) -> int:
    """The most lagged differences that are tried for n rows; negative if there are too few rows."""
    return min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)


def decide(n: int, span: Callable[[int], float], p: Callable[[int], float], test: str, max_order: int, alpha: float) -> int:
    """The first order whose test passes (ADF: p <= alpha, KPSS: p >= alpha), else the best; constant series need none."""
    tried: list[tuple[float, int]] = []
    for d in range(max_order + 1):
        if n - d < 4 or span(d) == 0:
            if d == 0 or not tried:
                return d
            break
        try:
            value = float(p(d))
        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):
            value = math.nan
        if not math.isfinite(value):
            value = 1.0 if test == "adf" else 0.0
        if value <= alpha if test == "adf" else value >= alpha:
            return d
        tried.append((value if test == "adf" else -value, d))
    return min(tried)[1] if tried else 0


# ADF


def adf_p(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    return normal_cdf(sum(c * tau**k for k, c in enumerate(SMALL_P if tau <= TAU_STAR else LARGE_P)))


def kpss_p(stat: float | None) -> float:
    """Within [0.01, 0.1]."""
    if stat is None or not math.isfinite(stat):
        return math.nan
    return float(np.interp(stat, [c for c, _ in KPSS_LEVELS], [p for _, p in KPSS_LEVELS]))


def lag_products(x: np.ndarray, at: int, begin: int, d: int, most: int, mean: float) -> np.ndarray:
    """Sums over rows `at`.. of a chunk, x being its rows and their halo: of the level before (less its mean) and its square, then of the
    difference times the one k rows back, and of the level times it, for k = 0..most. Nothing before row `begin` of x counts."""
    out = np.zeros(2 + 2 * (most + 1))
    at = max(at, begin)
    if at >= len(x):
        return out
    y, z = np.diff(x, d) - (mean if d == 0 else 0.0), np.diff(x, d + 1)
    level, step = y[at - 1 - d : len(y) - 1], z[at - 1 - d :]
    out[:2] = level.sum(), level @ level
    for k in range(most + 1):
        back = z[at - 1 - d - k : len(z) - k]
        out[2 + k], out[3 + most + k] = step @ back, level @ back
    return out


class Ends:
    """The first and last rows of a series of n, and its differences at these rows."""

    def __init__(self, n: int, head: np.ndarray, tail: np.ndarray):
        self.n, self.head, self.tail = n, head, tail

    def at(self, d: int, t: np.ndarray | int) -> np.ndarray:
        """Differences of order d at rows t, all of them near one end."""
        t = np.asarray(t)
        if not t.size or t.max() < len(self.head):
            return np.diff(self.head, d)[t - d]
        return np.diff(self.tail, d)[t - (self.n - len(self.tail)) - d]


def adf_products(ends: Ends, d: int, begin: int, end: int, most: int, mean: float) -> np.ndarray:
    """Products of (1, level before, differences 1..most rows back, difference) over rows begin.. < end of the head."""
    t = np.arange(begin, end)
    if not len(t):
        return np.zeros((most + 3, most + 3))
    cols = [np.ones(len(t)), ends.at(d, t - 1) - (mean if d == 0 else 0.0), *(ends.at(d + 1, t - k) for k in range(1, most + 1)), ends.at(d + 1, t)]
    m = np.column_stack(cols)
    return m.T @ m


def adf_matrix(sums: np.ndarray, ends: Ends, d: int, start: int, most: int) -> np.ndarray:
    """The same over all rows from `start` on, from `lag_products`' sums and the series' ends."""
    n, m = ends.n, most + 3
    out = np.zeros((m, m))
    if n <= start:
        return out
    place = [m - 1, *range(2, m - 1)]  # of the difference k rows back
    out[0, 0], out[0, 1], out[1, 1] = n - start, sums[0], sums[1]
    u = np.arange(1, most + 1)
    for k in range(most + 1):
        out[0, place[k]] = ends.at(d, n - 1 - k) - ends.at(d, start - 1 - k)
        out[1, place[k]] = sums[3 + most + k]
        i = u[: most - k]
        moved = ends.at(d + 1, start - i) * ends.at(d + 1, start - i - k) - ends.at(d + 1, n - i) * ends.at(d + 1, n - i - k)
        for j, v in enumerate(sums[2 + k] + np.concatenate([[0.0], np.cumsum(moved)])):
            out[min(place[j], place[j + k]), max(place[j], place[j + k])] = v
    return np.triu(out) + np.triu(out, 1).T


def nested(m: np.ndarray) -> list[float]:
    """Residual sums of squares of the last column on the first two, three, .. columns; dependent columns add nothing."""
    a, scale, out = m.copy(), np.diag(m).copy(), []
    for j in range(len(a) - 1):
        if a[j, j] > 1e-12 * scale[j]:
            a = a - np.outer(a[:, j], a[j]) / a[j, j]
        out.append(max(float(a[-1, -1]), 0.0))
    return out[1:]


def adf_statistic(m: np.ndarray) -> float:
    """tau of the level, from the products of (1, level, differences.., difference)."""
    x, y = m[:-1, :-1], m[:-1, -1]
    inverse = np.linalg.pinv(x, hermitian=True)
    beta = inverse @ y
    s2 = float(m[-1, -1] - beta @ y) / float(m[0, 0] - len(x))
    return float(beta[1]) / math.sqrt(s2 * float(inverse[1, 1]))


def adf_order(sums: np.ndarray, ends: Ends, d: int, start: int, most: int, mean: float) -> tuple[float, int]:
    """tau and the number of lagged differences, which minimises AIC up to Schwert's bound on the sample that all have."""
    if most < 0:
        raise ValueError("too short")
    n = ends.n
    first = d + 1 + most
    common = adf_matrix(sums, ends, d, start, most) + adf_products(ends, d, first, min(start, n), most, mean)
    rows = float(common[0, 0])
    aic = [rows * (math.log(2 * math.pi) + math.log(max(rss, 1e-300) / rows) + 1) + 2 * (k + 2) for k, rss in enumerate(nested(common))]
    lags = int(np.argmin(aic)) if all(map(math.isfinite, aic)) else 0
    at = [*range(lags + 2), most + 2]
    own = common[np.ix_(at, at)] + adf_products(ends, d, d + 1 + lags, min(first, n), lags, mean)
    return adf_statistic(own), lags


# KPSS


def residuals(x: np.ndarray, t: np.ndarray, d: int, level: float, slope: float) -> np.ndarray:
    """Differences of order d less their trend at rows t (from the first difference on, which is row 1)."""
    return np.diff(x, d) - level - slope * (t[d:] - d + 1)


def autoproducts(r: np.ndarray, at: int, lags: Sequence[int]) -> np.ndarray:
    """Sums over rows at.. of r times r k rows back, where there is such a row."""
    return np.array([float(r[max(at, k) :] @ r[max(at, k) - k : len(r) - k]) if max(at, k) < len(r) else 0.0 for k in lags])


def bandwidth(n: int, gamma: np.ndarray) -> int:
    """Hobijn et al. (1998), from the products of lags 0..n^(2/9)."""
    s0, s1 = float(gamma[0]) / n, 0.0
    for i, g in enumerate(gamma[1:], 1):
        c = float(g) / (n / 2)
        s0, s1 = s0 + c, s1 + i * c
    if s0 == 0 or not math.isfinite(s1 / s0):
        return -1
    return min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)


def kpss_statistic(n: int, gamma: np.ndarray, lags: int, squares: float) -> float:
    if lags < 0:
        return math.nan
    s2 = float(gamma[0]) + sum(2 * float(g) * (1 - i / (lags + 1)) for i, g in enumerate(gamma[1 : lags + 1], 1))
    return squares / n**2 / (s2 / n) if s2 else math.nan


class Series(Chunks):
    """The unit-root tests of a panel's series."""

    def __init__(self, panel: Panel, names: Sequence[str], max_order: int, chunk: int | None = None):
        super().__init__(panel, names, chunk)
        self.orders = max_order + 1

    def adf_table(self) -> DataFrame:
        """segment_id, variable, n, mean, span (of each order), sums (of each order), head, tail; a small row a series."""
        orders, names = self.orders, self.names
        most = max(schwert(self.longest), 0)
        schema = f"{SEGMENT} {self.kind}, variable int, sums array<double>, low array<double>, high array<double>, edge array<struct<t: long, x: double>>"

        def one(segment, chunk, x, own, first, known) -> pd.DataFrame:
            n = int(known["n"])
            lags = max(schwert(n), 0)
            start, out = lags + orders, []
            for i in range(len(names)):
                v, mean = x[:, i], float(known[f"m{i}"])
                sums, low, high = [], [], []
                for d in range(orders):
                    sums.append(lag_products(v, own, start - first, d, max(schwert(n - d), 0), mean))
                    y = np.diff(v, d)[max(own - d, 0) :]
                    low.append(y.min() if len(y) else math.inf)
                    high.append(y.max() if len(y) else -math.inf)
                t = first + np.arange(len(v))
                at = np.flatnonzero((np.arange(len(v)) >= own) & ((t < start) | (t >= n - lags - orders - 2)))
                out.append((segment, i, np.concatenate(sums).tolist(), low, high, [{"t": int(t[j]), "x": float(v[j])} for j in at]))
            return pd.DataFrame(out, columns=[SEGMENT, "variable", "sums", "low", "high", "edge"])

        # a series' first rows, and those that its lags look back on
        parts = shared.saved(self.over_chunks(one, most + orders + 2, schema, self.facts))
        ends = parts.where(F.size("edge") > 0).groupBy(SEGMENT, "variable").agg(F.array_sort(F.flatten(F.collect_list("edge"))).alias("edge"))
        spans = parts.select(SEGMENT, "variable", F.posexplode(F.arrays_zip("low", "high")).alias("d", "s")).groupBy(SEGMENT, "variable", "d").agg((F.max("s.high") - F.min("s.low")).alias("s"))
        spans = spans.groupBy(SEGMENT, "variable").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda c: c["s"]).alias("span"))
        means = F.array(*(f"m{i}" for i in range(len(names))))
        table = self.summed(parts, ["variable"], "sums").join(ends, [SEGMENT, "variable"]).join(spans, [SEGMENT, "variable"]).join(self.facts.select(SEGMENT, "n", means.alias("means")), SEGMENT)
        return table.select(SEGMENT, "variable", "n", F.get("means", F.col("variable")).alias("mean"), "span", "sums", "edge")

    def adf(self, max_order: int, alpha: float) -> DataFrame:
        """segment_id, variable, order."""
        names, orders = self.names, self.orders

        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    tests = adf_tests(r, orders)
                    out.append((r[0], names[r.variable], decide(int(r.n), lambda d, s=r.span: float(s[d]), lambda d, f=tests: adf_p(f(d)[0]), "adf", max_order, alpha)))
                yield pd.DataFrame(out, columns=[SEGMENT, "variable", "order"])

        return self.adf_table().mapInPandas(run, f"{SEGMENT} {self.kind}, variable string, order int")

    def adf_statistics(self) -> DataFrame:
        """segment_id, variable, d, lags, tau: the statistic of each order of differencing, null where there is none."""
        names, orders = self.names, self.orders

        def run(batches):
            for pdf in batches:
                out = []
                for r in pdf.itertuples(index=False):
                    tests = adf_tests(r, orders)
                    for d in range(orders):
                        try:
                            tau, lags = tests(d)
                        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):
                            tau, lags = None, None
                        out.append((r[0], names[r.variable], d, lags, tau))
                yield pd.DataFrame(out, columns=[SEGMENT, "variable", "d", "lags", "tau"])

        return self.adf_table().mapInPandas(run, f"{SEGMENT} {self.kind}, variable string, d int, lags int, tau double")

    def kpss_statistics(self) -> DataFrame:
        """segment_id, variable, d, n, lags, stat, span."""
        orders, names = self.orders, self.names
        kind = f"{SEGMENT} {self.kind}"

        def trend(segment, chunk, x, own, first, known) -> pd.DataFrame:
            out = []
            for i in range(len(names)):
                for d in range(orders):
                    y = np.diff(x[:, i], d)[max(own - d, 0) :]
                    n = int(known["n"]) - d
                    t = first + len(x) - len(y) + np.arange(len(y)) - d + 1 - (n + 1) / 2
                    out.append((segment, i, d, float(y.sum()), float(y @ t), float(y.min()) if len(y) else math.inf, float(y.max()) if len(y) else -math.inf))
            return pd.DataFrame(out, columns=[SEGMENT, "variable", "d", "y", "ty", "low", "high"])

        sums = self.over_chunks(trend, orders, f"{kind}, variable int, d int, y double, ty double, low double, high double", self.facts)
        means = F.array(*(f"m{i}" for i in range(len(names))))
        sums = sums.groupBy(SEGMENT, "variable", "d").agg(*(F.sum(c).alias(c) for c in ("y", "ty")), F.min("low").alias("low"), F.max("high").alias("high")).join(self.facts.select(SEGMENT, "n", means.alias("means")), SEGMENT)
        n = F.col("n") - F.col("d")
        slope = F.when(n > 1, F.col("ty") * 12 / (n * (n * n - 1.0))).otherwise(0.0)
        sums = sums.where(n > 0).select(SEGMENT, "variable", "d", n.alias("n"), slope.alias("slope"), (F.col("y") / n - slope * (n + 1) / 2).alias("level"), (F.col("high") - F.col("low")).alias("span"), F.isnan(F.get("means", F.col("variable"))).alias("gaps"))
        every = shared.saved(sums)
        trends = every.where("NOT gaps")
        width = int(max(self.longest, 1) ** (2 / 9))
        listed = trends.groupBy(SEGMENT).agg(F.collect_list(F.struct("variable", "d", "n", "level", "slope")).alias("trends"))  # of one segment's variables
        facts = self.facts.select(SEGMENT, "start").join(listed, SEGMENT)

        def partial(segment, chunk, x, own, first, known) -> pd.DataFrame:
            out, t = [], first + np.arange(len(x), dtype=float)
            for s in known["trends"]:
                d = s["d"]
                r = residuals(x[:, s["variable"]], t, d, s["level"], s["slope"])
                at = max(own - d, 0)
                run = np.cumsum(r[at:])
                gamma = autoproducts(r, at, range(int(s["n"] ** (2 / 9)) + 1))
                out.append((segment, s["variable"], d, chunk, len(run), float(run[-1]) if len(run) else 0.0, float(run.sum()), float(run @ run), gamma.tolist()))
            return pd.DataFrame(out, columns=[SEGMENT, "variable", "d", "chunk", "rows", "total", "p1", "p2", "gamma"])

        schema = f"{kind}, variable int, d int, chunk long, rows long, total double, p1 double, p2 double, gamma array<double>"
        parts = shared.saved(self.over_chunks(partial, width + orders, schema, facts))
        keys = [SEGMENT, "variable", "d"]
        before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
        moved = parts.withColumn("o", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
        squares = moved.groupBy(*keys).agg(F.sum(F.expr("p2 + 2 * o * p1 + rows * o * o")).alias("squares"))
        short = self.summed(parts, ["variable", "d"], "gamma").join(squares, keys).join(trends.select(*keys, "n", "span"), keys)
        lags = F.pandas_udf(lambda n, g: pd.Series([bandwidth(int(a), np.asarray(b)) for a, b in zip(n, g, strict=True)]), "int")
        short = shared.saved(short.withColumn("lags", lags("n", "gamma")))
        more = short.agg(F.max(F.when(F.col("lags") >= F.size("gamma"), F.col("lags")))).first()[0]
        if more is not None:
            wanted = trends.join(short.where(F.col("lags") >= F.size("gamma")).select(*keys, "lags", F.size("gamma").alias("known")), keys)
            listed = wanted.groupBy(SEGMENT).agg(F.collect_list(F.struct("variable", "d", "level", "slope", "known", "lags")).alias("trends"))

            def longer(segment, chunk, x, own, first, known) -> pd.DataFrame:
                out, t = [], first + np.arange(len(x), dtype=float)
                for s in known["trends"]:
                    r = residuals(x[:, s["variable"]], t, s["d"], s["level"], s["slope"])
                    out.append((segment, s["variable"], s["d"], autoproducts(r, max(own - s["d"], 0), range(s["known"], s["lags"] + 1)).tolist()))
                return pd.DataFrame(out, columns=[SEGMENT, "variable", "d", "more"])

            rest = self.over_chunks(longer, int(more) + orders, f"{kind}, variable int, d int, more array<double>", self.facts.select(SEGMENT, "start").join(listed, SEGMENT))
            short = short.join(self.summed(rest, ["variable", "d"], "more"), keys, "left").withColumn("gamma", F.when(F.col("more").isNull(), F.col("gamma")).otherwise(F.concat("gamma", "more")))

        def run(batches):
            for pdf in batches:
                stat = [None if g is None else kpss_statistic(int(n), np.asarray(g), int(k), float(s)) for n, g, k, s in zip(pdf["n"], pdf["gamma"], pdf["lags"], pdf["squares"], strict=True)]
                yield pd.DataFrame({SEGMENT: pdf[SEGMENT], "variable": [names[v] for v in pdf["variable"]], "d": pdf["d"], "n": pdf["n"], "lags": pdf["lags"], "stat": stat, "span": pdf["span"]})

        short = every.select(*keys, "n", "span").join(short.select(*keys, "gamma", "lags", "squares"), keys, "left")
        return short.mapInPandas(run, f"{kind}, variable string, d int, n long, lags int, stat double, span double")

    def kpss(self, max_order: int, alpha: float) -> DataFrame:
        """segment_id, variable, order."""
        tests = self.kpss_statistics().groupBy(SEGMENT, "variable").agg(F.array_sort(F.collect_list(F.struct("d", "n", "stat", "span"))).alias("tests"))  # an entry an order

        def run(batches):
            for pdf in batches:
                orders = [decide(int(t[0]["n"]), lambda d, t=t: t[d]["span"], lambda d, t=t: kpss_p(t[d]["stat"]), "kpss", max_order, alpha) for t in pdf["tests"]]
                yield pd.DataFrame({SEGMENT: pdf[SEGMENT], "variable": pdf["variable"], "order": orders})

        return tests.mapInPandas(run, f"{SEGMENT} {self.kind}, variable string, order int")


def _no_test(d: int):
    raise ValueError("a series with gaps")


def adf_tests(r, orders: int) -> Callable[[int], tuple[float, int]]:
    """d -> (tau, lags) of a row of `Series.adf_table`."""
    if not math.isfinite(r.mean):
        return _no_test
    n, edge = int(r.n), {e["t"]: e["x"] for e in r.edge}
    lags = max(schwert(n), 0)
    start = lags + orders
    head = np.array([edge[t] for t in range(min(start, n))])
    tail = np.array([edge[t] for t in range(max(n - lags - orders - 2, 0), n)])
    ends, sums, offset = Ends(n, head, tail), np.asarray(r.sums), 0
    parts = []
    for d in range(orders):
        size = 2 + 2 * (max(schwert(n - d), 0) + 1)
        parts.append(sums[offset : offset + size])
        offset += size
    return lambda d: adf_order(parts[d], ends, d, start, schwert(n - d), float(r.mean))


@dataclass
class StationarityTransformer:
    """Differences each variable by the largest order any segment needs; variables in `skip` are left as they are."""

    test: str = "adf"
    max_order: int = 5
    alpha: float = 0.05
    skip: Collection[str] = ()
    orders: dict[str, int] = field(default_factory=dict)

    def orders_table(self, panel: Panel, chunk: int | None = None) -> DataFrame:
        """segment_id, variable, order."""
        names = [v for v in panel.variables if v not in set(self.skip)]
        series = Series(panel, names, self.max_order, chunk)
        return (series.adf if self.test.lower() == "adf" else series.kpss)(self.max_order, self.alpha)

    def fit(self, panel: Panel, chunk: int | None = None) -> StationarityTransformer:
        self.orders = dict.fromkeys(panel.variables, 0)
        if self.max_order > 0 and any(v not in set(self.skip) for v in panel.variables):
            for r in self.orders_table(panel, chunk).groupBy("variable").agg(F.max("order").alias("order")).collect():
                self.orders[r["variable"]] = r["order"]
        return self

    def transform(self, panel: Panel, dropna: bool = True, chunk: int | None = None) -> Panel:
        return lagging.difference(panel, self.orders, dropna, chunk) if any(self.orders.values()) else panel

    def fit_transform(self, panel: Panel, dropna: bool = True, chunk: int | None = None) -> Panel:
        return self.fit(panel, chunk).transform(panel, dropna, chunk)

    def prepare_static(self, panel: Panel, effects: Sequence[str], causes: Sequence[str]) -> tuple[int, list[int], Panel]:
        """What older call sites ask for: the number of effects, the places of the causes, and the transformed panel."""
        return len(effects), [panel.variables.index(c) for c in causes], self.fit_transform(panel)
