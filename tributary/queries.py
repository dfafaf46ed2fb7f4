"""The engine's operators as queries over the driver's tables, and the same rows in SQL where SQL can express them.

The panel of most queries is hourly: the value of each type of event per hour, 0 where there is none.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import columns
from .operators import gram as G
from .operators import lagging, metrics, quantiles, scaling, stationarity
from .operators.chunks import Chunks
from .operators.stationarity import StationarityTransformer
from .plans import config, engine, inference, layout, robust, runner, selectors, solvers
from .sources import panel as P
from .sources import shared
from .streaming.gram_stream import GramStream
from .streaming.lag_stream import LagStream

TYPES = ("click", "error", "purchase", "signup", "view")
PAIR = ("click", "purchase")
DIGITS = 4
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, types=TYPES) -> P.Panel:
    return P.from_events(read(spark, sf_dir, "events").select("ts", "event_type", "value"), types)


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    # adding 0.0 turns -0.0 into 0.0
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns))


_sums = ", ".join(f"coalesce(round(sum(CASE WHEN event_type = '{t}' THEN value END), 2), 0.0) AS {t}" for t in TYPES)
_cols = ", ".join(TYPES)
PANEL = f"""b AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, event_type, value FROM events),
panel AS (SELECT 0 AS segment_id, c.t AS t, {_sums} FROM (SELECT unnest(generate_series((SELECT min(t) FROM b), (SELECT max(t) FROM b))) AS t) c LEFT JOIN b USING (t) GROUP BY c.t)"""


def _select(*columns: str) -> str:
    return ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in columns)


@query(f"WITH {PANEL} SELECT segment_id, t, {_cols} FROM panel")
def panel_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).df


@query("""WITH o AS (SELECT CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS t, o_totalprice AS p FROM orders), l AS (SELECT CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS t, l_quantity AS q, l_discount AS d FROM lineitem)
SELECT 0 AS segment_id, t, round(sum(p), 2) AS price, 0.0 AS quantity, 0.0 AS discount FROM o GROUP BY t UNION ALL SELECT 1, t, 0.0, round(sum(q), 2), round(sum(d), 2) FROM l GROUP BY t""")
def panel_union_align(spark, sf_dir):
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    a = read(spark, sf_dir, "orders").groupBy(day("o_orderdate").alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"))
    b = read(spark, sf_dir, "lineitem").groupBy(day("l_shipdate").alias("t")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 2).alias("discount"))
    return P.union_align([P.from_table(a, ["price"], F.lit(0)), P.from_table(b, ["quantity", "discount"], F.lit(1))]).df


@query(f"WITH {PANEL} SELECT segment_id, t, {_cols} FROM panel ORDER BY segment_id, t LIMIT (SELECT greatest(1, CAST(floor(0.25 * count(*)) AS BIGINT)) FROM panel)")
def panel_head_sample(spark, sf_dir):
    return P.head_sample(hourly(spark, sf_dir).df, 0.25)


@query("""WITH o AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, round(sum(CASE WHEN event_type = 'click' THEN value END), 2) AS click, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2) AS purchase FROM events GROUP BY 1)
SELECT 0 AS segment_id, t, click, purchase FROM o WHERE click IS NOT NULL AND purchase IS NOT NULL""")
def null_filter_panel(spark, sf_dir):
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    sums = read(spark, sf_dir, "events").groupBy(hour.alias("t")).agg(*(F.round(F.sum(F.when(F.col("event_type") == t, F.col("value"))), 2).alias(t) for t in PAIR))
    return P.drop_nulls(P.from_table(sums, PAIR)).df


def _diff_sql(order: int) -> str:
    expr = {1: "{c} - lag({c}, 1) OVER w", 2: "{c} - 2 * lag({c}, 1) OVER w + lag({c}, 2) OVER w"}[order]
    return f"WITH {PANEL}, d AS (SELECT segment_id, t, {', '.join(expr.format(c=c) + ' AS ' + c for c in TYPES)} FROM panel WINDOW w AS (PARTITION BY segment_id ORDER BY t)) SELECT segment_id, t, {_select(*TYPES)} FROM d WHERE click IS NOT NULL"


@query(_diff_sql(1))
def diff_order1(spark, sf_dir):
    return rounded(lagging.difference(hourly(spark, sf_dir), 1).df, *TYPES)


@query(_diff_sql(2))
def diff_order2(spark, sf_dir):
    return rounded(lagging.difference(hourly(spark, sf_dir), 2).df, *TYPES)


def _lag_sql(low: int, high: int, effects=(), table: str = "panel", names=TYPES, tail: str = "") -> str:
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag{k}" if k else f"{c} AS {c}_lag0" for c in names for k in range(low, high + 1))
    keep = ", ".join(["segment_id", "t", *effects, *(f"{c}_lag{k}" for c in names for k in range(low, high + 1))])
    return f"SELECT {keep} FROM (SELECT segment_id, t, {''.join(e + ', ' for e in effects)}{lags}, row_number() OVER w AS rn FROM {table} WINDOW w AS (PARTITION BY segment_id ORDER BY t)) WHERE rn > {high}{tail}"


@query(f"WITH {PANEL} {_lag_sql(1, 3)}")
def lag_features_1_3(spark, sf_dir):
    n = len(TYPES)
    return lagging.lag_features(hourly(spark, sf_dir), [1] * n, [3] * n)


@query(f"WITH {PANEL} {_lag_sql(0, 2)}")
def lag_features_zero(spark, sf_dir):
    n = len(TYPES)
    return lagging.lag_features(hourly(spark, sf_dir), [0] * n, [2] * n)


@query(f"WITH {PANEL} {_lag_sql(1, 2, PAIR)}")
def lag_targets_aligned(spark, sf_dir):
    n = len(TYPES)
    return lagging.lag_features(hourly(spark, sf_dir), [1] * n, [2] * n, PAIR)


@query(f"WITH {PANEL} {_lag_sql(1, 3)}")
def lag_features_chunked(spark, sf_dir):
    """The same features with the segment cut into chunks, as for one that no single task should sort."""
    n = len(TYPES)
    table = P.from_table(hourly(spark, sf_dir).df, TYPES)  # whose rows are numbered first
    return lagging.lag_features(table, [1] * n, [3] * n, chunk=24)


NATION = """m AS (SELECT n_nationkey AS segment_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS t, round(sum(o_totalprice), 2) AS price, CAST(count(*) AS DOUBLE) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""


def nation_panel(spark, sf_dir) -> P.Panel:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate") - 1).cast("long")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy(F.col("n_nationkey").alias("segment"), month.alias("t")).agg(F.round(F.sum("o_totalprice"), 2).alias("price"), F.count("*").cast("double").alias("n"))
    return P.from_table(rows, ["price", "n"], "segment")


@query(f"WITH {NATION} {_lag_sql(1, 2, ('price',), 'm', ('price', 'n'))}")
def segments_lag_by_nation(spark, sf_dir):
    return lagging.lag_features(nation_panel(spark, sf_dir), [1, 1], [2, 2], ["price"])


def _scaled(spark, sf_dir, kind: str) -> DataFrame:
    df = hourly(spark, sf_dir).df
    return rounded(scaling.scaler(kind).fit(df, TYPES).transform(df), *TYPES)


def _scale_sql(centre: str, scale: str) -> str:
    stats = ", ".join(f"{centre.format(c=c)} AS m_{c}, {scale.format(c=c)} AS s_{c}" for c in TYPES)
    out = ", ".join(f"round(({c} - m_{c}) / CASE WHEN abs(s_{c}) <= 1e-12 THEN 1 ELSE s_{c} END, {DIGITS}) + 0.0 AS {c}" for c in TYPES)
    return f"WITH {PANEL}, s AS (SELECT {stats} FROM panel) SELECT segment_id, t, {out} FROM panel CROSS JOIN s"


@query(_scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query(_scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query(_scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "robust")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_SHARES = (0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0)


@query("SELECT variable, CAST(p AS DOUBLE) AS p, round(CAST(v AS DOUBLE), 6) + 0.0 AS value FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, {p} AS p, quantile_cont(CAST({c} AS DOUBLE), {p}) AS v FROM lineitem" for c in _MEASURES for p in _SHARES) + ")")
def quantiles_of_lines(spark, sf_dir):
    """Exact quantiles of columns with many ties and with none, by narrowed ranges."""
    found = quantiles.exact_quantiles(read(spark, sf_dir, "lineitem").select(*_MEASURES), _MEASURES, _SHARES)
    return rounded(spark.createDataFrame([(c, p, v) for c, vs in zip(_MEASURES, found, strict=True) for p, v in zip(_SHARES, vs, strict=True)], "variable string, p double, value double"), "value", digits=6)


@query(_scale_sql("0 * min({c})", "max(abs({c}))"))
def scale_maxabs(spark, sf_dir):
    return _scaled(spark, sf_dir, "maxabs")


@query(f"WITH {PANEL} SELECT segment_id, t, {_select(*TYPES)} FROM panel")
def scale_inverse_roundtrip(spark, sf_dir):
    df = hourly(spark, sf_dir).df
    s = scaling.scaler("standard").fit(df, TYPES)
    return rounded(s.inverse_transform(s.transform(df)), *TYPES)


_pairs = [(a, b) for i, a in enumerate(("1", *TYPES)) for b in ("1", *TYPES)[i:]]


@query(f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a if a != '1' else '1.0'} * {b if b != '1' else '1.0'}), 2) AS value FROM panel" for a, b in _pairs))
def gram_matrix(spark, sf_dir):
    return rounded(G.gram_table(hourly(spark, sf_dir).df, TYPES), "value", digits=2)


CONFIG = layout.LagConfiguration(max_lag=3, use_lag_zero=True, custom_lags={"view": (2, 4)}, custom_pair_lags={("purchase", "click"): (1, 2)})


def _types(spark, sf_dir) -> list[str]:
    """The panel's variables, as the events have them."""
    return sorted(r[0] for r in read(spark, sf_dir, "events").select("event_type").distinct().collect())


def _layout(spark, sf_dir) -> layout.Layout:
    return layout.fixed(_types(spark, sf_dir), CONFIG)


_values = lambda names: ", ".join(f"('{x}')" for x in names)
_kinds = "(SELECT DISTINCT event_type AS {} FROM events)"


@query(f"""SELECT e AS effect, c AS cause, CAST(k AS INTEGER) AS lag, CAST(CASE WHEN e = 'purchase' AND c = 'click' THEN k IN (1, 2) WHEN e = c AND k = 0 THEN FALSE ELSE TRUE END AS INTEGER) AS active
FROM {_kinds.format('e')} CROSS JOIN {_kinds.format('c')} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) l(k) WHERE CASE WHEN c = 'view' THEN k BETWEEN 2 AND 4 ELSE k <= 3 END""")
def lag_mask_table(spark, sf_dir):
    return _layout(spark, sf_dir).mask_table(spark)


@query(f"SELECT CAST(row_number() OVER (ORDER BY c, k) - 1 AS INTEGER) AS place, c || '_lag' || k AS name FROM {_kinds.format('c')} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) l(k) WHERE CASE WHEN c = 'view' THEN k BETWEEN 2 AND 4 ELSE k <= 3 END")
def lag_feature_names(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(_layout(spark, sf_dir).names)), "place int, name string")


@query(f"SELECT c AS variable, CAST(CASE WHEN c = 'view' THEN 2 ELSE 0 END AS INTEGER) AS min_lag, CAST(CASE WHEN c = 'view' THEN 4 ELSE 3 END AS INTEGER) AS max_lag, CAST(CASE WHEN c = 'view' THEN 3 ELSE 4 END AS INTEGER) AS n_features FROM {_kinds.format('c')}")
def lag_summary(spark, sf_dir):
    return _layout(spark, sf_dir).summary_table(spark)


@query(f"SELECT effect, cause, CAST(sum(active) AS BIGINT) AS n_restrictions FROM ({ORACLES['lag_mask_table']}) GROUP BY effect, cause")
def restriction_counts(spark, sf_dir):
    return _layout(spark, sf_dir).mask_table(spark).groupBy("effect", "cause").agg(F.sum("active").alias("n_restrictions"))


AR_LAGS = (1, 2, 3)


def _moments(spark, sf_dir, longest: int) -> selectors.Moments:
    """The selectors' products of the hourly panel, which is one segment."""
    panel = hourly(spark, sf_dir)
    sums, head, k = selectors.segment_moments(panel, longest)
    cells = {r["i"]: r["value"] for r in sums.collect()}  # a fixed number of cells
    first = [r["x"] for r in head.orderBy("__rn").collect()]
    return selectors.Moments(G.from_upper(np.array([cells[i] for i in range(len(cells))]), k), np.array(first), len(TYPES), longest)


def _ar_table(spark, sf_dir) -> DataFrame:
    """The selectors' AIC and BIC of each variable on one of its own lags."""
    mo = _moments(spark, sf_dir, max(AR_LAGS))
    rows = [(c, k, *(selectors.ICLagSelector(max_lag=3, use_bic=bic).score(mo, i, [(i, k)]) for bic in (False, True))) for i, c in enumerate(TYPES) for k in AR_LAGS]
    return spark.createDataFrame(rows, "target string, lag int, aic double, bic double")


_ar_rows = " UNION ALL ".join(f"SELECT '{c}' AS target, {k} AS lag, {c} AS y, lag({c}, {k}) OVER (ORDER BY t) AS x FROM centred" for c in TYPES for k in AR_LAGS)
AR = f"""{PANEL}, centred AS (SELECT t, {', '.join(f'{c} - avg({c}) OVER () AS {c}' for c in TYPES)} FROM panel), r AS ({_ar_rows}),
g AS (SELECT target, lag, count(*) AS n, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM r WHERE x IS NOT NULL GROUP BY target, lag),
s AS (SELECT target, lag, 4 + n * ln((syy - sxy * sxy / sxx) / n) AS aic, 2 * ln(n) + n * ln((syy - sxy * sxy / sxx) / n) AS bic FROM g)"""


@query(f"WITH {AR} SELECT target, lag, round(aic, {DIGITS}) AS aic, round(bic, {DIGITS}) AS bic FROM s")
def ar_ic_scores(spark, sf_dir):
    return rounded(_ar_table(spark, sf_dir), "aic", "bic")


@query(f"WITH {AR} SELECT target, CAST(arg_min(lag, aic) AS INTEGER) AS best_lag FROM s GROUP BY target")
def ar_best_lag(spark, sf_dir):
    return _ar_table(spark, sf_dir).groupBy("target").agg(F.min_by("lag", F.struct("aic", "lag")).alias("best_lag"))


# One lag of each of two differenced series: the two-regressor fit has a closed form in SQL

_l1 = f"""{PANEL}, d AS (SELECT t, {', '.join(f'{c} - lag({c}, 1) OVER (ORDER BY t) AS {c}' for c in TYPES)} FROM panel), dd AS (SELECT * FROM d WHERE click IS NOT NULL),
l AS (SELECT {', '.join(f'{c}, lag({c}, 1) OVER (ORDER BY t) AS {c}_1' for c in TYPES)} FROM dd), z AS (SELECT * FROM l WHERE click_1 IS NOT NULL),
p AS ({' UNION ALL '.join(f"SELECT '{e}' AS effect, '{c}' AS cause, {e} AS y, {e}_1 AS a, {c}_1 AS b FROM z" for e in TYPES for c in TYPES if e != c)}),
s AS (SELECT effect, cause, count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(a) * count(*) AS aa, var_pop(b) * count(*) AS bb, covar_pop(y, a) * count(*) AS ya, covar_pop(y, b) * count(*) AS yb, covar_pop(a, b) * count(*) AS ab FROM p GROUP BY effect, cause),
f AS (SELECT effect, cause, n, yy - ya * ya / aa AS rss_r, yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / (aa * bb - ab * ab) AS rss_u, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS w FROM s)"""


def _pairwise(spark, sf_dir, lag: int | None = 1, **args) -> DataFrame:
    """The results' table of all pairs of differenced variables."""
    none = StationarityTransformer(max_order=0)
    return engine.PairwiseCausality().fit(lagging.difference(hourly(spark, sf_dir), 1), lag=lag, stationarity_transformer=none, **args).table


def _pair_lag1(spark, sf_dir) -> DataFrame:
    return _pairwise(spark, sf_dir).where("effect <> cause")


@query(f"WITH {_l1} SELECT effect, cause, round((rss_r - rss_u) / (rss_u / (n - 3)), {DIGITS}) AS f_stat FROM f")
def pairwise_f_lag1(spark, sf_dir):
    return _pair_lag1(spark, sf_dir).selectExpr("effect", "cause", f"round(f_test, {DIGITS}) AS f_stat")


@query(f"WITH {_l1} SELECT effect, cause, round(n * ln(rss_r / rss_u), {DIGITS}) AS lr_stat FROM f")
def pairwise_lr_lag1(spark, sf_dir):
    return _pair_lag1(spark, sf_dir).selectExpr("effect", "cause", f"round(lr_test, {DIGITS}) AS lr_stat")


@query(f"WITH {_l1} SELECT effect, cause, round(n * (rss_r - rss_u) / rss_u, {DIGITS}) AS chi2_stat FROM f")
def pairwise_chi2_stat_lag1(spark, sf_dir):
    return _pair_lag1(spark, sf_dir).selectExpr("effect", "cause", f"round(wald_test, {DIGITS}) AS chi2_stat")


@query(f"WITH {_l1} SELECT effect, cause, CAST(sign(w) AS INTEGER) AS direction FROM f")
def pairwise_sign_lag1(spark, sf_dir):
    return _pair_lag1(spark, sf_dir).select("effect", "cause", F.col("sign").cast("int").alias("direction"))


@query(f"WITH {_l1} SELECT effect, cause, round(rss_u / n, 3) AS base_error, round(rss_r / n, 3) AS ref_error FROM f")
def error_values_lag1(spark, sf_dir):
    return _pair_lag1(spark, sf_dir).selectExpr("effect", "cause", "round(base_error, 3) AS base_error", "round(ref_error, 3) AS ref_error")


@query(f"SELECT c AS effect, c AS cause, CAST(1 AS DOUBLE) AS p_value, CAST(0 AS DOUBLE) AS sign FROM (VALUES {_values(TYPES)}) v(c)")
def pairwise_self_pairs(spark, sf_dir):
    return _pairwise(spark, sf_dir).where("effect = cause").select("effect", "cause", "p_value", "sign")


@query(f"""WITH {PANEL}, c AS (SELECT t, click - avg(click) OVER () AS y FROM panel), l AS (SELECT t, y, lag(y, 1) OVER (ORDER BY t) AS x FROM c), k AS (SELECT *, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM l WHERE x IS NOT NULL),
f AS (SELECT *, least(i // (n // 5), 4) AS fold FROM k), v AS (SELECT unnest(generate_series(1, 4)) AS val),
m AS (SELECT val, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f, v WHERE fold < val GROUP BY val)
SELECT CAST(val AS INTEGER) AS fold, round(avg((y - a - b * x) * (y - a - b * x)), 3) AS mse FROM f JOIN m ON fold = val GROUP BY val""")
def cv_fold_errors_ar1(spark, sf_dir):
    """Forward-chaining errors of click on its own lag, fold by fold, from the selector's products."""

    def folds(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                errors = selectors.fold_moments(r, 1, 1, 5).fold_errors((0, (0, 1)))
                yield pd.DataFrame({"fold": range(1, 5), "mse": errors})

    table = selectors.fold_table(Chunks(hourly(spark, sf_dir, ("click",)), ["click"]), 1, 5, True)
    return rounded(table.mapInPandas(folds, "fold int, mse double"), "mse", digits=3)


# Matrices and metrics, from chi-squared statistics against a fixed critical value

CRITICAL = 1.0


def _matrix(spark, sf_dir, signed: bool = False) -> DataFrame:
    rows = _pair_lag1(spark, sf_dir).selectExpr("effect", "cause", "round(wald_test, 6) AS stat", "cast(sign AS int) AS direction")
    hit = F.when(F.col("stat") > CRITICAL, F.col("direction") if signed else F.lit(1)).otherwise(0)
    return rows.select("effect", "cause", hit.alias("value"))


_hit = f"WITH {_l1}, m AS (SELECT effect, cause, CAST(CASE WHEN round(n * (rss_r - rss_u) / rss_u, 6) > {CRITICAL} THEN {{}} ELSE 0 END AS INTEGER) AS value FROM f)"
#: The truth the metrics are held against: a type is caused by those before it in the alphabet.
_truth = f"truth AS (SELECT e AS effect, c AS cause, CAST(c < e AS INTEGER) AS gt FROM (VALUES {_values(TYPES)}) a(e) CROSS JOIN (VALUES {_values(TYPES)}) b(c) WHERE e <> c)"


def _gt(spark) -> DataFrame:
    return spark.createDataFrame([(e, c, int(c < e)) for e in TYPES for c in TYPES if e != c], "effect string, cause string, value int")


@query(_hit.format("1") + " SELECT effect, cause, value FROM m")
def threshold_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query(_hit.format("sign(w)") + " SELECT effect, cause, value FROM m")
def signed_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir, signed=True)


@query(_hit.format("1") + f" SELECT effect, {', '.join(f'''CAST(coalesce(max(CASE WHEN cause = '{c}' THEN value END), 0) AS INTEGER) AS {c}''' for c in TYPES)} FROM m GROUP BY effect")
def matrix_pivot(spark, sf_dir):
    return inference.wide(_matrix(spark, sf_dir), TYPES).na.fill(0)


_counts = "c AS (SELECT " + ", ".join(f"count(*) FILTER (value = {p} AND gt = {g}) AS {n}" for n, p, g in (("tp", 1, 1), ("fp", 1, 0), ("tn", 0, 0), ("fn", 0, 1))) + " FROM m JOIN truth USING (effect, cause))"


@query(f"{_hit.format('1')}, {_truth}, {_counts} SELECT * FROM c")
def confusion_counts(spark, sf_dir):
    return metrics.confusion(_gt(spark), _matrix(spark, sf_dir))


_ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0.0 END"


@query(f"{_hit.format('1')}, {_truth}, {_counts} SELECT *, " + ", ".join(f"round({_ratio(a, b)}, 6) AS {n}" for n, a, b in (("fdr", "fp", "tp + fp"), ("tpr", "tp", "tp + fn"), ("fpr", "fp", "fp + tn"), ("accuracy", "tp + tn", "tp + fp + tn + fn"), ("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("f1", "2 * tp", "2 * tp + fp + fn"))) + " FROM c")
def metric_scores(spark, sf_dir):
    return rounded(metrics.scores(metrics.confusion(_gt(spark), _matrix(spark, sf_dir))), "fdr", "tpr", "fpr", "accuracy", "precision", "recall", "f1", digits=6)


@query(f"{_hit.format('1')}, {_truth}, e1 AS (SELECT effect, cause, value - gt AS d FROM m JOIN truth USING (effect, cause)), s2 AS (SELECT a.effect, a.cause, least(a.d + b.d, 1) AS s FROM e1 a JOIN e1 b ON a.effect = b.cause AND a.cause = b.effect) SELECT CAST(floor(sum(abs(s)) / 2) AS INTEGER) AS shd FROM s2")
def shd_compat(spark, sf_dir):
    return metrics.shd(_gt(spark), _matrix(spark, sf_dir))


@query(f"{_hit.format('1')}, {_truth}, e1 AS (SELECT least(effect, cause) AS x, greatest(effect, cause) AS y, max(abs(value - gt)) AS d FROM m JOIN truth USING (effect, cause) GROUP BY 1, 2) SELECT CAST(sum(d) AS INTEGER) AS shd FROM e1")
def shd_standard(spark, sf_dir):
    return metrics.shd(_gt(spark), _matrix(spark, sf_dir), compat=False)


@query(f"{_hit.format('sign(w)')}, u AS (SELECT unnest([{', '.join(repr(t) for t in TYPES)}]) AS n) SELECT a.n AS effect, b.n AS cause, CAST(coalesce(value, 0) <> 0 AS INTEGER) AS value FROM u a CROSS JOIN u b LEFT JOIN m ON m.effect = a.n AND m.cause = b.n")
def square_matrix(spark, sf_dir):
    return metrics.square(_matrix(spark, sf_dir, signed=True))


_strong = f"WITH {_l1}, m AS (SELECT effect, cause, row_number() OVER (ORDER BY round(n * (rss_r - rss_u) / rss_u, 6) DESC, effect, cause) AS place FROM f)"


@query(f"{_strong} SELECT cause AS node FROM m WHERE place <= 3 EXCEPT SELECT effect FROM m WHERE place <= 3")
def pure_causes(spark, sf_dir):
    """What drives others among the three strongest pairs, and isn't driven."""
    rows = _pair_lag1(spark, sf_dir).selectExpr("effect", "cause", "round(wald_test, 6) AS stat")
    hits = rows.orderBy(F.desc("stat"), "effect", "cause").limit(3)
    return hits.select(F.col("cause").alias("node")).distinct().join(hits.select(F.col("effect").alias("node")), "node", "left_anti")


# Whole analyses, of differenced variables

_D = f"{PANEL}, d AS (SELECT t, {', '.join(f'{c} - lag({c}, 1) OVER (ORDER BY t) AS {c}' for c in TYPES)} FROM panel), dd AS (SELECT * FROM d WHERE click IS NOT NULL)"
_FIT = f"WITH RECURSIVE {_D}, {oracles.multitask(TYPES, TYPES, 2)}"
_FEATURES = oracles.lags(TYPES, 1, 2)


def _shown(**columns: str) -> str:
    return "SELECT effect, cause, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in columns.items()) + " FROM st"


@query(f"WITH {_l1}, x AS (SELECT effect, cause, n, (rss_r - rss_u) / (rss_u / (n - 3)) AS f, n * ln(rss_r / rss_u) AS lr FROM f) SELECT effect, cause, CAST(n - 3 AS INTEGER) AS residual_df, round(f, 4) AS f_test, round(lr, 4) AS lr_test FROM x")
def pairwise_degrees_lag1(spark, sf_dir):
    return _pair_lag1(spark, sf_dir).selectExpr("effect", "cause", "residual_df", "round(f_test, 4) AS f_test", "round(lr_test, 4) AS lr_test")


_chi = {2: "exp(-x / 2)", 4: "exp(-x / 2) * (1 + x / 2)", 6: "exp(-x / 2) * (1 + x / 2 + x * x / 8)"}
_tails = " UNION ALL ".join([*(f"SELECT 'chi2' AS family, x, {k} AS d1, 0 AS d2, {v} AS tail FROM g" for k, v in _chi.items()), *(f"SELECT 'f', x, 2, {d}, pow(1 + 2 * x / {d}, -{d} / 2.0) FROM g" for d in (3, 20, 700)), *(f"SELECT 'f', x, {d}, 2, 1 - pow({d} * x / ({d} * x + 2), {d} / 2.0) FROM g" for d in (1, 5, 40))])


@query(f"WITH g AS (SELECT o_orderkey % 200 / 8.0 AS x FROM orders GROUP BY 1) SELECT family, CAST(x AS DOUBLE) AS x, CAST(d1 AS INTEGER) AS d1, CAST(d2 AS INTEGER) AS d2, round(tail, 9) AS tail FROM ({_tails})")
def distribution_tails(spark, sf_dir):
    """Tails that have a closed form: even degrees of freedom of chi-squared, two degrees on one side of F."""
    g = read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 200 / 8.0).alias("x")).distinct()
    kinds = [("chi2", d, 0) for d in _chi] + [("f", 2, d) for d in (3, 20, 700)] + [("f", d, 2) for d in (1, 5, 40)]
    rows = g.select("x", F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(a).alias("d1"), F.lit(b).alias("d2")) for f, a, b in kinds))).alias("k")).select("k.family", "x", "k.d1", "k.d2")
    tail = F.when(F.col("family") == "f", columns.f_tail("x", "d1", "d2")).otherwise(columns.chi2_tail("x", "d1"))
    return rows.withColumn("tail", F.round(tail, 9))


def _robust(spark, sf_dir, loss: str) -> DataFrame:
    p = lagging.difference(hourly(spark, sf_dir), 1)
    lay = layout.fixed(TYPES, layout.LagConfiguration(max_lag=1))
    rows = lagging.lag_features(p, lay.min_lags, lay.max_lags, ["purchase"])
    w, b = robust.fit(rows, lay, ["purchase"], loss, delta=50.0)
    return rounded(spark.createDataFrame([("purchase", n, float(v)) for n, v in zip([*lay.names, "intercept"], [*w[0], b[0]], strict=True)], "effect string, feature string, weight double"), "weight")


_near = oracles.lags(TYPES, 1, 1)
_named = ", ".join(f"({k + 1}, '{n}')" for k, n in enumerate(["intercept", *_near]))


def _robust_sql(weight: str) -> str:
    fits = oracles.reweighted("z", _near, {"all": ("purchase", _near)}, weight, 101)
    return f"WITH RECURSIVE {PANEL}, d AS (SELECT t, {', '.join(f'{c} - lag({c}, 1) OVER (ORDER BY t) AS {c}' for c in TYPES)} FROM panel), dd AS (SELECT * FROM d WHERE click IS NOT NULL), z AS ({oracles.lagged('dd', TYPES, 1)}), {fits} SELECT 'purchase' AS effect, feature, round(b[k], {DIGITS}) + 0.0 AS weight FROM fitted, (VALUES {_named}) n(k, feature)"


@query(_robust_sql("CASE WHEN abs(r) <= 50 THEN 1.0 ELSE 50 / abs(r) END"))
def huber_fit(spark, sf_dir):
    return _robust(spark, sf_dir, "huber")


@query(_robust_sql("1 / greatest(abs(r), 1e-6)"))
def absolute_loss_fit(spark, sf_dir):
    return _robust(spark, sf_dir, "mae")


def _fit(spark, sf_dir, **args) -> inference.Results:
    defaults = {"lag_config": layout.LagConfiguration(max_lag=2), "stationarity_transformer": StationarityTransformer(max_order=0)}
    return engine.MultiTaskCausality(args.pop("backend", None)).fit(lagging.difference(hourly(spark, sf_dir), 1), **defaults | args)


def _statistics(df: DataFrame, *names: str) -> DataFrame:
    return rounded(df.select("effect", "cause", *names), *names, digits=6)


@query(f"{_FIT} SELECT effect, cause, round(e0, 6) AS base_error, round(e1, 6) AS ref_error, round(f, 6) AS f_test, round(p_f, 6) AS p_value, CAST(2 AS INTEGER) AS n_restrictions, CAST(df AS INTEGER) AS residual_df FROM st")
def multitask_f_test(spark, sf_dir):
    t = _fit(spark, sf_dir).table.select("effect", "cause", "base_error", "ref_error", "f_test", "p_value", "n_restrictions", "residual_df")
    return rounded(t, "base_error", "ref_error", "f_test", "p_value", digits=6)


_pivot = ", ".join(f"round(max(CASE WHEN cause = '{c}' THEN p_f END), 6) + 0.0 AS {c}" for c in TYPES)


@query(f"{_FIT} SELECT effect, {_pivot} FROM st GROUP BY effect")
def multitask_p_values(spark, sf_dir):
    return rounded(_fit(spark, sf_dir).matrix("p_value"), *TYPES, digits=6)


@query(f"{_FIT} {_shown(lr_test='lr', lr_p_value='p_lr')}")
def likelihood_ratio_test(spark, sf_dir):
    return _statistics(_fit(spark, sf_dir).table, "lr_test", "lr_p_value")


@query(f"{_FIT} {_shown(wald_test='wald', wald_p_value='p_wald', sign='sign')}")
def wald_test(spark, sf_dir):
    return _statistics(_fit(spark, sf_dir).table, "wald_test", "wald_p_value", "sign")


@query(f"{_FIT} {_shown(wald_p_value='p_lr')}")
def wald_p_values_compat(spark, sf_dir):
    """compat: the tail of the likelihood ratio."""
    api = engine.MultiTaskCausality(compat=True)
    r = api.fit(lagging.difference(hourly(spark, sf_dir), 1), lag_config=layout.LagConfiguration(max_lag=2), stationarity_transformer=StationarityTransformer(max_order=0))
    return _statistics(r.table, "wald_p_value")


@query(f"{_FIT} SELECT effect, cause, CAST(round(p_f, 6) < 0.4 AS INTEGER) AS value FROM st")
def result_by_f(spark, sf_dir):
    return _fit(spark, sf_dir).result(0.4, test="F_test")


@query(f"{_FIT} SELECT effect, cause, CASE WHEN round(p_wald, 6) < 0.4 THEN sign + 0.0 ELSE 0.0 END AS value FROM st")
def result_signed_by_wald(spark, sf_dir):
    return _fit(spark, sf_dir).result(0.4, with_sign=True, test="wald")


@query(f"{_FIT} SELECT effect, cause, CAST(round(p_lr, 6) < 0.4 AS INTEGER) AS value FROM st")
def result_by_likelihood_ratio(spark, sf_dir):
    return _fit(spark, sf_dir).result(0.4, test="likelihood_ratio")


@query(f"{_FIT} SELECT effect, cause, round(p_f, 6) + 0.0 AS p_value FROM st WHERE effect IN ('click', 'view') AND cause IN ('error', 'signup')".replace("/ (b.n * 5)", "/ (b.n * 2)"))
def tested_roles(spark, sf_dir):
    """Some effects and tested causes; all variables remain predictors."""
    return _statistics(_fit(spark, sf_dir, effects=["click", "view"], tested_causes=["error", "signup"]).table, "p_value")


def _weights_sql(fit: str, wherefrom: str = "w", value: str = "a[x][y]", tail: str = "") -> str:
    cells = ", ".join(f"('{e}', '{f}', {len(_FEATURES) + i + 1}, {j + 1})" for i, e in enumerate(TYPES) for j, f in enumerate(_FEATURES))
    return f"SELECT effect, feature, round({value}, {DIGITS}) + 0.0 AS weight FROM (VALUES {cells}) c(effect, feature, y, x), {wherefrom} WHERE fit = '{fit}'{tail}"


def _weights(spark, r: inference.Results, run: str = "base") -> DataFrame:
    names = r.extras["layout"].names
    rows = [(e, n, float(v)) for e, row in zip(r.effects, r.weights[run], strict=True) for n, v in zip(names, row, strict=True)]
    return rounded(spark.createDataFrame(rows, "effect string, feature string, weight double"), "weight")


@query(f"{_FIT} {_weights_sql('all')}")
def base_weights(spark, sf_dir):
    return _weights(spark, _fit(spark, sf_dir))


@query(f"{_FIT} {_weights_sql('click', value='CASE WHEN x <= 2 THEN 0 ELSE a[x][y] END')}")
def weights_without_click(spark, sf_dir):
    """The reference fit that omits a cause."""
    return _weights(spark, _fit(spark, sf_dir), "click")


@query(f"{_FIT} {_weights_sql('all', value='CASE WHEN effect = ' + repr('purchase') + ' AND (x > 8 OR x <= 2) THEN 0 ELSE a[x][y] END')}")
def projected_weights(spark, sf_dir):
    """The full system solved, then masked: purchase is driven neither by view nor by click, but its other weights stay as they were."""
    return _weights(spark, _fit(spark, sf_dir, relations={("purchase", "view"): "zero", ("purchase", "click"): "off"}, model_config={"projection": "projected", "initializer": "ols"}, backend="scikit-learn"))


@query(f"{_FIT} {_weights_sql('all', value='a[x][y] + 0.5 * list_sum(list_transform(range(1, 11), lambda g: a[x][g] * sign(a[g][y])))')}")
def l1_newton_fit(spark, sf_dir):
    """With a small L1 no weight changes its sign, and Newton steps end at least squares less the penalty's pull."""
    return _weights(spark, _fit(spark, sf_dir, regularizer_spec={"type": "l1", "l1": 0.5}))


_batch_cells = ", ".join(f"('{e}', '{f}', {len(_FEATURES) + i + 1}, {j + 1})" for i, e in enumerate(TYPES) for j, f in enumerate(_FEATURES))


@query(f"WITH RECURSIVE {_D}, {oracles.batch_weights(TYPES, 2, 360)} SELECT effect, feature, round(0.25 * b0.a[x][y] + 0.5 * b1.a[x][y], {DIGITS}) + 0.0 AS weight FROM (VALUES {_batch_cells}) c(effect, feature, y, x), b0, b1")
def minibatch_newton_fit(spark, sf_dir):
    """An epoch of half steps over two batches: a quarter of the first one's least squares and half of the second one's."""
    return _weights(spark, _fit(spark, sf_dir, model_config={"batch_size": 360, "learning_rate": 0.5, "max_iter": 1}))


@query(f"{_FIT} {_weights_sql('all')}")
def lbfgs_fit(spark, sf_dir):
    return _weights(spark, _fit(spark, sf_dir, backend="pytorch", model_config={"optimizer": {"type": "lbfgs", "lr": 1.0, "max_iter": 40}, "epochs": 5}))


@query(f"{_FIT} {_weights_sql('all')}")
def muon_fit(spark, sf_dir):
    """Orthogonalised steps keep their length, so the rate is halved where the loss stalls."""
    slower = {"type": "reduce_lr_on_plateau", "patience": 15, "factor": 0.5, "min_lr": 1e-12}
    return _weights(spark, _fit(spark, sf_dir, backend="pytorch", tested_causes=["click"], callbacks=[slower], model_config={"optimizer": {"type": "muon", "lr": 0.05, "nesterov": True}, "epochs": 3000}))


_loss_cells = {f"{e}:{c}": (e, [f for f in _FEATURES if not f.startswith(c)]) for e in PAIR for c in ("error", "view", "none")}
_loss_columns = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in (*_FEATURES, *PAIR))


@query(f"""WITH RECURSIVE {_D}, z AS ({oracles.lagged('dd', TYPES, 2)}), s AS (SELECT {_loss_columns} FROM z), {oracles.reweighted('s', _FEATURES, _loss_cells, 'CASE WHEN abs(r) <= 0.5 THEN 1.0 ELSE 0.5 / abs(r) END', 60)},
e AS (SELECT split_part(id, ':', 1) AS effect, split_part(id, ':', 2) AS cause, count(*) AS n, sum(pow(CASE split_part(id, ':', 1) WHEN '{PAIR[0]}' THEN ys[1] ELSE ys[2] END - list_dot_product(b, x), 2)) AS rss FROM fitted, v GROUP BY id),
st AS (SELECT o.effect, o.cause, o.n - {len(_FEATURES) + 1} AS df, o.n, greatest(o.rss - e.rss, 0) / 2 / (e.rss / (o.n - {len(_FEATURES) + 1})) AS f, o.n * ln(o.rss / e.rss) AS lr FROM e o JOIN e ON e.effect = o.effect AND e.cause = 'none' WHERE o.cause <> 'none')
SELECT effect, cause, round(f, 5) + 0.0 AS f_test, round(pow(1 + 2 * f / df, -df / 2.0), 5) + 0.0 AS p_value, round(lr, 5) + 0.0 AS lr_test FROM st""")
def huber_f_test(spark, sf_dir):
    """The tests of fits under a Huber loss, whose base and reference fits share their passes."""
    r = _fit(spark, sf_dir, effects=list(PAIR), tested_causes=["error", "view"], model_config={"loss": {"type": "huber", "delta": 0.5}, "max_iter": 60, "tol": 1e-10})
    return rounded(r.table.select("effect", "cause", "f_test", "p_value", "lr_test"), "f_test", "p_value", "lr_test", digits=5)


_c = "(abs(a[1][y]) + abs(a[2][y]))"
_purchase = f"CASE WHEN x > 8 THEN 0 WHEN x <= 2 AND {_c} < 0.5 THEN a[x][y] + CASE WHEN a[x][y] < 0 THEN -1 ELSE 1 END * (0.5 - {_c}) / 2 ELSE a[x][y] END"


@query(f"{_FIT} {_weights_sql('all', tail=chr(32) + 'AND effect <> ' + repr('purchase'))} UNION ALL {_weights_sql('view', value=_purchase, tail=chr(32) + 'AND effect = ' + repr('purchase'))}")
def relation_constrained_fit(spark, sf_dir):
    """purchase is not driven by view, and clicks' weights on it sum up to 0.5 at least."""
    return _weights(spark, _fit(spark, sf_dir, relations={("purchase", "view"): "zero", ("purchase", "click"): 0.5}))


_means = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in (*_FEATURES, *PAIR))


def _predicted(e: str) -> str:
    y = len(_FEATURES) + TYPES.index(e) + 1
    return f"round(m_{e} + s_{e} * (" + " + ".join(f"a[{j + 1}][{y}] * ({f} - m_{f}) / s_{f}" for j, f in enumerate(_FEATURES)) + f"), 3) + 0.0 AS {e}_pred"


@query(f"{_FIT}, g AS (SELECT {_means} FROM z) SELECT 0 AS segment_id, z.t, round(click, 3) + 0.0 AS click, round(purchase, 3) + 0.0 AS purchase, {_predicted('click')}, {_predicted('purchase')} FROM z, g, w WHERE fit = 'all'")
def fitted_predictions(spark, sf_dir):
    api = engine.MultiTaskCausality()
    r = api.fit(lagging.difference(hourly(spark, sf_dir), 1), effects=list(PAIR), lag_config=layout.LagConfiguration(max_lag=2), stationarity_transformer=StationarityTransformer(max_order=0))
    return rounded(api.predict(r), *PAIR, *(f"{e}_pred" for e in PAIR), digits=3)


@query(f"{_FIT} SELECT effect, cause, round(f, 6) + 0.0 AS f_test, round(p_f, 6) + 0.0 AS p_value FROM st")
def hyperparameter_search(spark, sf_dir):
    """Of rates and penalties, the search takes least squares, which has the lowest loss."""
    r = _fit(spark, sf_dir, hiperoptimalization_state=True, hiperoptimalization_conf={"type": "model", "sections": {"model": {"learning_rate": [0.1, 1.0]}, "regularizer": {"l1": [0.0, 1.0]}}})
    return _statistics(r.table, "f_test", "p_value")


_CASES = {"base_config": {"backend": "sklearn", "lag_config": {"max_lag": 2}}, "sweep": {"param_names": ["model_config.learning_rate", "model_config.max_iter"], "cases": [[1.0, 50], [0.1, 50], [0.1, 200]]}}
_cases = ", ".join(f"({i}, {rate}, {most})" for i, (rate, most) in enumerate(_CASES["sweep"]["cases"], 1))


@query(f"""{_FIT}, q AS (SELECT sum(e0) AS rss, 1.0 AS one FROM (SELECT DISTINCT effect, e0 FROM st)),
k AS (SELECT c.id, rate, most, k, rss + pow(1 - rate, 2 * k) * (one - rss) AS loss FROM (VALUES {_cases}) c(id, rate, most), q, (SELECT unnest(generate_series(1, 200)) AS k) WHERE k <= most),
e AS (SELECT *, abs(lag(loss) OVER (PARTITION BY id ORDER BY k) - loss) <= 1e-8 OR k = most AS done FROM k),
f AS (SELECT id, min(k) AS k FROM e WHERE done GROUP BY id)
SELECT CAST(id AS INTEGER) AS case_id, 'sklearn' AS backend, CAST(rate AS DOUBLE) AS learning_rate, CAST(most AS DOUBLE) AS max_iter, round(loss, 6) AS loss, CAST(k AS INTEGER) AS epochs FROM e JOIN f USING (id, k)""")
def sweep_summary(spark, sf_dir):
    """Cases of a group, on one set of sums: after k damped steps, weights are 1 - (1 - rate)^k of least squares."""
    p = lagging.difference(hourly(spark, sf_dir), 1)
    prepared, rows = None, []
    for i, (raw, swept) in enumerate(config.cases(_CASES), 1):
        case = config.normalised(raw)
        prepared = prepared or engine.prepare(p, list(TYPES), case["lag_config"], transformer=StationarityTransformer(max_order=0))
        r = engine.MultiTaskCausality(case["backend"]).fit(prepared_data=prepared, model_config=case["model_config"])
        rows.append((i, case["backend"], *map(float, swept.values()), round(r.extras["loss"], 6), int(r.extras["epochs"])))
    return spark.createDataFrame(rows, "case_id int, backend string, learning_rate double, max_iter double, loss double, epochs int")


# Selectors


def _selected(spark, sf_dir, selector, most: int = 4) -> DataFrame:
    p = lagging.difference(hourly(spark, sf_dir), 1)
    return selectors.select_layout(p, layout.LagConfiguration(max_lag=most), selector).mask_table(spark)


_mask_rows = "SELECT effect, cause, CAST(l.k AS INTEGER) AS lag, CAST(CASE WHEN l.k <= lags.lag THEN 1 ELSE 0 END AS INTEGER) AS active FROM lags, (SELECT unnest(generate_series(1, (SELECT max(lag) FROM lags))) AS k) l WHERE l.k <= (SELECT max(lag) FROM lags o WHERE o.cause = lags.cause)"


@query(f"WITH RECURSIVE {_D}, {oracles.ic_lags('dd', TYPES, 4, 2.0, 2.0)} {_mask_rows}")
def lag_selector_ic(spark, sf_dir):
    return _selected(spark, sf_dir, selectors.ICLagSelector(use_bic=True))


def _lag_table(spark, matrix) -> DataFrame:
    return spark.createDataFrame([(e, c, int(matrix[i, j])) for i, e in enumerate(TYPES) for j, c in enumerate(TYPES)], "effect string, cause string, lag int")


_own = " UNION ALL ".join(f"SELECT '{c}' AS target, {k} AS lag, ({oracles.pair_score('dd', c, k)}) AS s" for c in TYPES for k in (1, 2))
_other = " UNION ALL ".join(f"SELECT '{e}' AS target, '{c}' AS cause, {own} AS own, {k} AS lag, ({oracles.pair_score('dd', e, own, c, k)}) AS s" for e in TYPES for c in TYPES if c != e for own in (1, 2) for k in (1, 2))


@query(f"""WITH {_D}, a AS ({_own}), best AS (SELECT target, arg_min(lag, s) AS own, min(s) AS s FROM a GROUP BY target), o AS ({_other}),
p AS (SELECT o.target, o.cause, arg_min(o.lag, o.s) AS lag, min(o.s) AS s, any_value(best.s) AS own_s FROM o JOIN best ON o.target = best.target AND o.own = best.own GROUP BY o.target, o.cause)
SELECT target AS effect, target AS cause, CAST(own AS INTEGER) AS lag FROM best UNION ALL SELECT target, cause, CAST(CASE WHEN s < own_s THEN lag ELSE 1 END AS INTEGER) FROM p""")
def lag_selector_ic_unpruned(spark, sf_dir):
    p = lagging.difference(hourly(spark, sf_dir), 1)
    chosen = selectors.ICLagSelector(max_lag=2, min_lag=1, delta_min_ic=0.0, prune_lags=False)
    return _lag_table(spark, selectors.lag_matrix(p, chosen, range(len(TYPES))))


@query(f"WITH {_D}, {oracles.forward_lags('dd', TYPES, 4, 4)} {_mask_rows}")
def lag_selector_cv(spark, sf_dir):
    return _selected(spark, sf_dir, selectors.CVLagSelector(cv_folds=4))


@query(f"WITH {_D}, {oracles.forward_lags('dd', TYPES, 3, 5)} SELECT target, CAST(lag AS INTEGER) AS lag, round(s, 3) AS error FROM own")
def cv_errors_own_lags(spark, sf_dir):
    """The selector's forward-chaining errors of each variable on each of its own lags, in chunks of a week."""
    cut = Chunks(lagging.difference(hourly(spark, sf_dir), 1), TYPES, 168)

    def scored(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                mo = selectors.fold_moments(r, len(TYPES), 3, 5)
                yield pd.DataFrame([(c, k, mo.squared((i, (i, k)))) for i, c in enumerate(TYPES) for k in (1, 2, 3)], columns=["target", "lag", "error"])

    return rounded(selectors.fold_table(cut, 3, 5, True).mapInPandas(scored, "target string, lag int, error double"), "error", digits=3)


_errors = " UNION ALL ".join(f"SELECT '{c}' AS target, {k} AS lag, ({oracles.forward_errors('dd', c, k, 5)}) AS s" for c in TYPES for k in (1, 2, 3))


@query(f"WITH {_D}, a AS ({_errors}), best AS (SELECT target, arg_min(lag, s) AS own FROM a GROUP BY target) SELECT e AS effect, c AS cause, CAST(CASE WHEN e = c THEN own ELSE 1 END AS INTEGER) AS lag FROM (VALUES {_values(TYPES)}) x(e) CROSS JOIN (VALUES {_values(TYPES)}) y(c) JOIN best ON target = e")
def lag_selector_cv_own(spark, sf_dir):
    """Own lags by forward chaining; a threshold of one lets no other variable's lag improve on them."""
    p = lagging.difference(hourly(spark, sf_dir), 1)
    chosen = selectors.CVLagSelector(max_lag=3, min_lag=1, cv_folds=5, delta_min_rel_cv=1.0)
    return _lag_table(spark, selectors.lag_matrix(p, chosen, range(len(TYPES))))


@query(f"WITH RECURSIVE {_D}, {oracles.var_order(TYPES, 3)} SELECT e AS effect, c AS cause, CAST(k AS INTEGER) AS lag, CAST(1 AS INTEGER) AS active FROM (VALUES {_values(TYPES)}) x(e) CROSS JOIN (VALUES {_values(TYPES)}) y(c), (SELECT unnest(generate_series(1, (SELECT max(p) FROM orders))) AS k)")
def lag_selector_var(spark, sf_dir):
    return _selected(spark, sf_dir, selectors.VARLagSelector(), 3)


@query(f"WITH RECURSIVE {_D}, {oracles.common_var_order(TYPES, 3)} SELECT CAST(p AS INTEGER) AS lag FROM best")
def pairwise_var_order(spark, sf_dir):
    """The lag that the pairwise tests take if they are given none."""
    return _pairwise(spark, sf_dir, None, lag_max=3).select(F.col("n_restrictions").alias("lag")).distinct()


#: The normal score of p = 0.05.
_SCORE = -1.6448536269514722


@query(oracles.adf_orders(PANEL, TYPES, 5, stationarity.SMALL_P, stationarity.LARGE_P, stationarity.TAU_STAR, _SCORE))
def stationarity_adf_orders(spark, sf_dir):
    return StationarityTransformer("adf").orders_table(hourly(spark, sf_dir))


@query(oracles.adf_orders(PANEL, TYPES, 1, stationarity.SMALL_P, stationarity.LARGE_P, stationarity.TAU_STAR, _SCORE).rsplit("SELECT 0 AS segment_id", 1)[0] + "SELECT 0 AS segment_id, v AS variable, CAST(d AS INTEGER) AS d, CAST(lags AS INTEGER) AS lags, round(tau, 5) AS tau FROM tests")
def stationarity_adf_statistics(spark, sf_dir):
    """tau and the lagged differences that AIC takes, of the values and of their differences, in chunks of a week."""
    return rounded(stationarity.Series(hourly(spark, sf_dir), TYPES, 1, 168).adf_statistics(), "tau", digits=5)


@query(oracles.kpss_tests(PANEL, TYPES, 5) + oracles._first_passed("stat <= 0.146", "stat"))
def stationarity_kpss_orders(spark, sf_dir):
    return StationarityTransformer("kpss").orders_table(hourly(spark, sf_dir))


@query(oracles.kpss_tests(PANEL, TYPES, 1) + " SELECT 0 AS segment_id, v AS variable, CAST(d AS INTEGER) AS d, n, CAST(lags AS INTEGER) AS lags, round(stat, 7) AS stat FROM tests")
def stationarity_kpss_statistics(spark, sf_dir):
    """The statistic and its bandwidth, in chunks of a week."""
    return rounded(stationarity.Series(hourly(spark, sf_dir), TYPES, 1, 168).kpss_statistics().drop("span"), "stat", digits=7)


@query(_diff_sql(1).replace(f"round(view, {DIGITS})", f"round((SELECT view FROM panel p WHERE p.t = d.t), {DIGITS})"))
def stationarity_transform(spark, sf_dir):
    """Orders that were found (here: given) applied; a skipped variable stays as it is."""
    found = StationarityTransformer(skip=["view"], orders={c: int(c != "view") for c in TYPES})
    return rounded(found.transform(hourly(spark, sf_dir)).df, *TYPES)


_adam_cells = ", ".join(f"('{e}', '{f}', {i + 1}, {j + 1})" for i, e in enumerate(TYPES) for j, f in enumerate(_FEATURES))


@query(f"WITH RECURSIVE {_D}, z AS ({oracles.lagged('dd', TYPES, 2)}), m AS ({oracles.products([*_FEATURES, *TYPES], 'z')}), {oracles.adam_steps(len(_FEATURES), len(TYPES), 200, 0.01, '0.01 * (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)', 20)} SELECT effect, feature, round(w[i][k], {DIGITS}) + 0.0 AS weight FROM (VALUES {_adam_cells}) c(effect, feature, i, k), adam")
def lag_l1_adam_fit(spark, sf_dir):
    return _weights(spark, _fit(spark, sf_dir, backend="adam", regularizer_spec={"type": "lag_dependent_l1", "l1": 0.01}, model_config={"epochs": 200, "learning_rate": 0.01}, callbacks=[{"type": "early_stopping", "patience": 20}]))


# Scalers, files, configurations, streams


@query(f"WITH {PANEL} SELECT segment_id, t, {_select(*TYPES)} FROM panel")
def scale_none(spark, sf_dir):
    return _scaled(spark, sf_dir, "none")


@query(f"WITH {PANEL} SELECT CAST(0 AS INTEGER) AS segment_id, t, {_select(*TYPES)} FROM panel UNION ALL SELECT 1, t, {_select('click')}, 0.0, 0.0, 0.0, 0.0 FROM panel")
def csv_segments(spark, sf_dir):
    """Two segments of CSV with different delimiters and columns, read back and aligned."""
    folder, df = shared.folder(spark), hourly(spark, sf_dir).df
    for name, sep, names in (("a", ";", TYPES), ("b", "\t", ("click",))):
        df.select("t", *names).repartition(3).write.option("header", True).option("sep", sep).csv(f"{folder}/{name}")
    return rounded(P.read_csv(spark, [f"{folder}/a", f"{folder}/b"], order="t").df, *TYPES)


@query(f"WITH {PANEL} SELECT CAST(0 AS INTEGER) AS segment_id, row_number() OVER (ORDER BY t) - 1 AS t, {_select(*TYPES)} FROM panel")
def csv_file_order(spark, sf_dir):
    """Rows without any order column, as they lie in four files."""
    folder, df = shared.folder(spark), hourly(spark, sf_dir).df
    df.repartitionByRange(4, "t").sortWithinPartitions("t").select(*TYPES).write.option("header", True).csv(f"{folder}/rows")
    return rounded(P.read_csv(spark, f"{folder}/rows").df, *TYPES)


@query(_hit.format("1") + " SELECT effect, cause, CAST(value AS DOUBLE) AS value FROM m")
def matrix_file_roundtrip(spark, sf_dir):
    """A matrix written as a file of effects x causes, and read again."""
    path = f"{shared.folder(spark)}/{runner.file_name(1, 'newton', {'max_lag': 1}, 'causality')}"
    runner.write_matrix(inference.wide(_matrix(spark, sf_dir), TYPES), path)
    return runner.read_matrix(spark, path).where("value is not null")


_RUN = {
    "base_config": {"backend": "sklearn", "lag_config": {"max_lag": 2}, "stationarity_transformer": {"max_order": 0}},
    "sweep": {"param_names": ["model_config.max_iter"], "cases": [[1], [50]]},
}


def _run(spark, sf_dir) -> tuple[list[dict], str, str]:
    """A run as the command line does it: configurations are files of the driver's, data, truth and results lie in the shared folder."""
    folder = shared.folder(spark)
    lagging.difference(hourly(spark, sf_dir), 1).df.select("t", *TYPES).repartition(3).write.option("header", True).option("sep", ";").csv(f"{folder}/data")
    runner.write_rows(spark, ["effect", *TYPES], [[e, *(int(c < e) for c in TYPES)] for e in TYPES], f"{folder}/truth")
    with tempfile.TemporaryDirectory() as local:
        for name, x in (("group.json", _RUN), ("run.json", {"output_dir": f"{folder}/out", "ground_truth_path": f"{folder}/truth", "group_config_path": "group.json", "threshold": 0.4, "data": {"csv_paths": [f"{folder}/data"], "order_col": "t"}})):
            with open(os.path.join(local, name), "w", encoding="utf-8") as f:
                json.dump(x, f)
        return runner.run(spark, os.path.join(local, "run.json"), "matrices", "f"), f"{folder}/out", f"{folder}/truth"


_run_counts = ", ".join(f"count(*) FILTER (CAST(round(p_f, 6) < 0.4 AS INTEGER) = {p} AND CAST(cause < effect AS INTEGER) = {g}) AS {n}" for n, p, g in (("tp", 1, 1), ("fp", 1, 0), ("tn", 0, 0), ("fn", 0, 1)))


@query(f"{_FIT}, k AS (SELECT {_run_counts} FROM st) SELECT CAST(c AS INTEGER) AS case_id, 'OK' AS status, 'case_00' || c || '_sklearn_model_config.max_iter_' || CASE c WHEN 1 THEN 1 ELSE 50 END || '_p_value.csv' AS p_value_file, k.*, round((tp + tn) / 25.0, 6) + 0.0 AS accuracy FROM k, (VALUES (1), (2)) v(c)")
def runner_summary(spark, sf_dir):
    """The summary of a run over files: one step is least squares already, so both cases agree."""
    rows, _, _ = _run(spark, sf_dir)
    out = [(r["case_id"], r["status"], r.get("p_value_file"), r.get("tp"), r.get("fp"), r.get("tn"), r.get("fn"), r.get("accuracy")) for r in rows]
    return rounded(spark.createDataFrame(out, "case_id int, status string, p_value_file string, tp long, fp long, tn long, fn long, accuracy double"), "accuracy", digits=6)


@query(f"{_FIT}, k AS (SELECT {_run_counts} FROM st) SELECT CAST(c AS VARCHAR) AS case_id, k.* FROM k, (VALUES (1), (2)) v(c)")
def runner_recalculated(spark, sf_dir):
    """The same from the matrices that the run has saved."""
    _, out, truth = _run(spark, sf_dir)
    rows = runner.recalculate(spark, out, truth)
    return spark.createDataFrame([(r["case_id"], r["tp"], r["fp"], r["tn"], r["fn"]) for r in rows], "case_id string, tp long, fp long, tn long, fn long")


_runs = "SELECT 'base' AS run, avg(e0) * 5 AS rss FROM (SELECT DISTINCT effect, e0 FROM st) UNION ALL SELECT 'without_click', sum(e1) FROM st WHERE cause = 'click'"


@query(f"""{_FIT}, q AS ({_runs}), k AS (SELECT run, k, rss + pow(0.5, 2 * k) * (1.0 - rss) AS loss FROM q, (SELECT unnest(generate_series(1, 8)) AS k))
SELECT run, CAST(k AS INTEGER) AS epoch, round(loss, 6) AS loss, CAST(0.5 AS DOUBLE) AS rate FROM k""")
def training_log(spark, sf_dir):
    """Loss and rate of each epoch of the base fit, and of the one without click, from a callback that is cloned for each."""
    log = solvers.History()
    _fit(spark, sf_dir, tested_causes=["click"], callbacks=[log], model_config={"learning_rate": 0.5, "max_iter": 8})
    return rounded(spark.createDataFrame(log.rows, "run string, epoch int, loss double, rate double"), "loss", digits=6)


_edges = (-0.5, -0.25, -0.05, 0.0, 0.05)
_bins = ", ".join(f"({a}, {b})" for a, b in zip(("CAST('-infinity' AS DOUBLE)", *_edges), (*_edges, "CAST('infinity' AS DOUBLE)"), strict=True))


@query(f"""{_FIT}, v AS ({_weights_sql('all', value='a[x][y]').replace(f"round(a[x][y], {DIGITS}) + 0.0", "a[x][y]")}), e AS (SELECT k, (1 - pow(0.5, k)) * weight AS weight FROM v, (VALUES (2), (4), (6)) e(k))
SELECT 'base' AS run, CAST(k AS INTEGER) AS epoch, CAST(greatest(low, -9) AS DOUBLE) AS low, CAST(least(high, 9) AS DOUBLE) AS high, count(*) FILTER (weight >= low AND weight < high) AS n FROM e, (VALUES {_bins}) b(low, high) GROUP BY ALL""")
def weight_histograms(spark, sf_dir):
    """How many weights lie where, every other epoch of half steps; the outer bins are shown to nine."""
    log = solvers.History(every=2, edges=_edges)
    _fit(spark, sf_dir, tested_causes=["click"], callbacks=[log], model_config={"learning_rate": 0.5, "max_iter": 6, "tol": 0})
    rows = [(run, epoch, max(low, -9.0), min(high, 9.0), n) for run, epoch, low, high, n in log.histograms if run == "base"]
    return spark.createDataFrame(rows, "run string, epoch int, low double, high double, n long")


@query("SELECT CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS INTEGER) AS segment_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS t, CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(length(n_name) AS DOUBLE) AS letters FROM nation")
def frames_ingest(spark, sf_dir):
    """A segment a pandas frame."""
    rows = read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.length("n_name").alias("letters")).toPandas()  # 25 rows
    return P.from_frames(spark, [g.sort_values("n_nationkey")[["n_nationkey", "letters"]].astype(float) for _, g in rows.groupby("n_regionkey")]).df


@query(f"SELECT event_type AS effect, CAST(1 AS DOUBLE) AS click, CAST(count(*) AS DOUBLE) AS view FROM events GROUP BY event_type")
def matrix_columns(spark, sf_dir):
    """A matrix of ones with one column set: how many events each effect has."""
    counts = {r["event_type"]: float(r["count"]) for r in read(spark, sf_dir, "events").groupBy("event_type").count().collect()}
    return inference.set_column(inference.constant(spark, sorted(counts), ["click", "view"], 1.0), "view", counts)


_GROUP = '{"shared": 1, "base_config": {"backend": "pytorch", "lag_config": {"max_lag": 2}}, "sweep": {"param_names": ["lag_config.max_lag", "model_config.epochs", "backend"], "cases": [[3, 5, "sklearn"], [4, 10, "tensorflow"]]}}'


@query(f"WITH {PANEL} SELECT c.*, (SELECT count(*) FROM panel) - max_lag AS n_rows FROM (VALUES (1, 'sklearn', 3, 5, 'case_001_sklearn_lag_config.max_lag_3_model_config.epochs_5_p_value.csv'), (2, 'tensorflow', 4, 10, 'case_002_tensorflow_lag_config.max_lag_4_model_config.epochs_10_p_value.csv')) c(case_id, backend, max_lag, epochs, file)")
def config_cases(spark, sf_dir):
    """Cases of a group file, normalised, the names of their files, and the rows of the panel that each case's lags leave."""
    out, panel = [], hourly(spark, sf_dir)
    for i, (raw, params) in enumerate(config.cases(json.loads(_GROUP)), 1):
        case = config.normalised(raw)
        lags = layout.fixed(TYPES, case["lag_config"])
        n = lagging.lag_features(panel, lags.min_lags, lags.max_lags).count()
        out.append((i, case["backend"], case["lag_config"].max_lag, case["model_config"]["epochs"], runner.file_name(i, case["backend"], params, "p_value"), n))
    return spark.createDataFrame(out, "case_id int, backend string, max_lag int, epochs int, file string, n_rows long")


@query("SELECT effect, cause, CAST(least AS DOUBLE) AS least, (SELECT count(*) FROM events WHERE event_type = cause) AS n_events FROM (VALUES ('purchase', 'click', 0.5), ('view', 'error', NULL), ('signup', 'view', NULL), ('click', 'view', 0.25)) r(effect, cause, least)")
def config_relations(spark, sf_dir):
    """Relations of all forms: keys with any separator, and entries; a null minimum forbids. And the events that each is about."""
    found = config.relations({"purchase->click": 0.5, "view|error": "off"}) | config.relations([{"output": "signup", "input": "view", "zero": True}, {"effect": "click", "predictor": "view", "rule": {"min_abs_sum": 0.25}}])
    rules = spark.createDataFrame([(e, c, solvers.relation(v)) for (e, c), v in found.items()], "effect string, cause string, least double")
    counts = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cause")).agg(F.count("*").alias("n_events"))
    return counts.join(F.broadcast(rules), "cause").select("effect", "cause", "least", "n_events")  # as many rules as pairs at most


@query(ORACLES["gram_matrix"])
def streaming_gram(spark, sf_dir):
    """The panel's products from a stream of files, micro-batch by micro-batch."""
    folder, df = shared.folder(spark), hourly(spark, sf_dir).df
    df.repartition(3).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    sums = GramStream(TYPES, f"{folder}/sums")
    sums.start(stream, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return rounded(sums.table(spark), "value", digits=2)


_lagged = oracles.lags(PAIR, 1, 2)
_lag_pairs = [(a, b) for i, a in enumerate(("1", *_lagged, "purchase")) for b in ("1", *_lagged, "purchase")[i:]]


@query(f"WITH {PANEL}, z AS ({oracles.lagged('panel', PAIR, 2)}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a if a != '1' else '1.0'} * {b if b != '1' else '1.0'}), 2) AS value FROM z" for a, b in _lag_pairs))
def streaming_lag_gram(spark, sf_dir):
    """Products of lag features of a stream that stops half-way and restarts from its checkpoint."""
    folder, df = shared.folder(spark), hourly(spark, sf_dir, PAIR).df
    middle = df.agg(F.expr("cast((min(t) + max(t)) / 2 AS long)")).first()[0]
    lags = LagStream(PAIR, [1, 1], [2, 2], ["purchase"])
    sums = GramStream([*lags.names, "purchase"], f"{folder}/sums")
    for part in (df.where(F.col("t") <= middle), df.where(F.col("t") > middle)):
        part.repartitionByRange(2, "t").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
        rows = lags.features(stream).where("NOT late").drop("late")
        sums.start(rows, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    return rounded(sums.table(spark), "value", digits=2)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F statistics of all pairs of hourly, differenced event values at one lag."""
    return pairwise_f_lag1(spark, sf_dir)


