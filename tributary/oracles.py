"""SQL (DuckDB's) for fits: least squares by sweeping a matrix of products, one pivot a step, in a recursive query.

After pivots S are swept, the matrix holds minus the inverse of the products of S, the weights of all other columns on S, and what is
left of the others' products: residual sums of squares on the diagonal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def texts(values: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def lags(names: Sequence[str], low: int, high: int) -> list[str]:
    return [f"{c}_lag{k}" for c in names for k in range(low, high + 1)]


def lagged(table: str, names: Sequence[str], high: int, low: int = 1) -> str:
    """Rows of a table (t, names) with lags low..high of all names; those that lack any are left out."""
    own = ", ".join(f"lag({c}, {k}) OVER (ORDER BY t) AS {c}_lag{k}" for c in names for k in range(low, high + 1))
    return f"SELECT * FROM (SELECT t, {', '.join(names)}, {own}, row_number() OVER (ORDER BY t) AS rn FROM {table}) WHERE rn > {high}"


def products(columns: Sequence[str], table: str, scaled: bool = True) -> str:
    """One row: n, and a, the products of the centred columns, divided by their deviations if scaled."""
    one = "corr" if scaled else "covar_pop"
    rows = ", ".join("[" + ", ".join(f"{one}({a}, {b}) * count(*)" for b in columns) + "]" for a in columns)
    return f"SELECT count(*) AS n, [{rows}] AS a FROM {table}"


def swept(name: str, fits: Mapping[str, Sequence[int]], size: int, source: str = "m") -> str:
    """CTEs {name}_s, and {name} (fit, n, a, ld): each fit's columns swept; ld sums the logs of pivots over n from column `size` on."""
    rows = ", ".join(f"('{f}', CAST({list(p)} AS INTEGER[]))" for f, p in fits.items())
    cell = "CASE WHEN i = k AND j = k THEN -1 / a[k][k] WHEN i = k THEN a[k][j] / a[k][k] WHEN j = k THEN a[i][k] / a[k][k] ELSE a[i][j] - a[i][k] * a[k][j] / a[k][k] END"
    matrix = f"list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: {cell}))"
    return f"""{name}_s AS (SELECT fit, piv, 0 AS step, n, a, CAST(0 AS DOUBLE) AS ld FROM (VALUES {rows}) f(fit, piv), {source}
UNION ALL SELECT fit, piv, step + 1, n, {matrix} AS a, ld + CASE WHEN k > {size} THEN ln(a[k][k] / n) ELSE 0 END FROM (SELECT *, piv[step + 1] AS k FROM {name}_s WHERE step < len(piv))),
{name} AS (SELECT fit, n, a, ld FROM {name}_s WHERE step = len(piv))"""


def multitask(names: Sequence[str], effects: Sequence[str], high: int) -> str:
    """CTEs from dd (t, names) on: z, m, w (the fit with all columns, and one without each cause), st (all statistics of each pair)."""
    p, m = len(names) * high, len(effects)
    columns = [*lags(names, 1, high), *effects]
    every = list(range(1, p + 1))
    fits = {"all": every} | {c: [x for x in every if (x - 1) // high != i] for i, c in enumerate(names)}
    pairs = ", ".join(f"('{e}', '{c}', {p + i + 1}, {high * j + 1})" for i, e in enumerate(effects) for j, c in enumerate(names))
    if high != 2:
        raise ValueError("closed forms of the tails are for two lags")
    return f"""z AS ({lagged('dd', names, high)}), m AS ({products(columns, 'z')}), {swept('w', fits, p)},
r AS (SELECT effect, cause, b.n AS n, b.n - {p + 1} AS df, b.a[y][y] / (b.n * {m}) AS e0, o.a[y][y] / (b.n * {m}) AS e1, b.a[y][y] / (b.n - {p + 1}) AS s2, b.a[x][y] AS w1, b.a[x + 1][y] AS w2, -b.a[x][x] AS v11, -b.a[x][x + 1] AS v12, -b.a[x + 1][x + 1] AS v22
FROM (VALUES {pairs}) q(effect, cause, y, x) JOIN w b ON b.fit = 'all' JOIN w o ON o.fit = q.cause),
t1 AS (SELECT *, greatest(e1 - e0, 0) / 2 / (e0 / df) AS f, n * ln(e1 / e0) AS lr, (w1 * w1 * v22 - 2 * w1 * w2 * v12 + w2 * w2 * v11) / (v11 * v22 - v12 * v12) / s2 AS wald, sign(CASE WHEN abs(w2) > abs(w1) THEN w2 ELSE w1 END) AS sign FROM r),
st AS (SELECT *, pow(1 + 2 * f / df, -df / 2.0) AS p_f, exp(-lr / 2) AS p_lr, exp(-wald / 2) AS p_wald FROM t1)"""


def batch_weights(names: Sequence[str], high: int, size: int) -> str:
    """CTEs from dd on: b0, b1 (fit, n, a): least squares without a constant of two batches of rows, on columns scaled over all rows."""
    columns, p = [*lags(names, 1, high), *names], len(names) * high
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in columns)
    rows = ", ".join("[" + ", ".join(f"sum({a} * {b})" for b in columns) + "]" for a in columns)
    parts = ", ".join(f"m{i} AS (SELECT count(*) AS n, [{rows}] AS a FROM zs WHERE (row_number - 1) // {size} = {i}), {swept(f'b{i}', {'all': range(1, p + 1)}, p, f'm{i}')}" for i in (0, 1))
    return f"z AS ({lagged('dd', names, high)}), zs AS (SELECT row_number() OVER (ORDER BY t) AS row_number, {scaled} FROM z), {parts}"


def reweighted(table: str, features: Sequence[str], cells: Mapping[str, tuple[str, Sequence[str]]], weight: str, rounds: int) -> str:
    """CTEs: fitted (id, b), constant first, of each cell (effect, active features) after rounds of least squares with weights that are `weight`
    of the residual r; a round's solution comes from sweeping the weighted products."""
    p, effects = len(features) + 1, list(dict.fromkeys(e for e, _ in cells.values()))
    rows = ", ".join(f"('{i}', {effects.index(e) + 1}, CAST({[1, *(list(features).index(f) + 2 for f in active)]} AS INTEGER[]))" for i, (e, active) in cells.items())
    u = [*(f"x[{i}]" for i in range(1, p + 1)), "y"]
    matrix = "[" + ", ".join("[" + ", ".join(f"sum(w * {min(a, b)} * {max(a, b)})" for b in u) + "]" for a in u) + "]"
    inner = f"SELECT step, id, piv, {matrix} AS a FROM (SELECT *, CASE WHEN step = 0 THEN 1.0 ELSE {weight} END AS w FROM (SELECT step, id, piv, x, ys[yi] AS y, ys[yi] - list_dot_product(b, x) AS r FROM it, v WHERE step < {rounds})) GROUP BY step, id, piv"
    for k in range(1, p + 1):
        cell = f"CASE WHEN i = {k} AND j = {k} THEN -1 / a[{k}][{k}] WHEN i = {k} THEN a[{k}][j] / a[{k}][{k}] WHEN j = {k} THEN a[i][{k}] / a[{k}][{k}] ELSE a[i][j] - a[i][{k}] * a[{k}][j] / a[{k}][{k}] END"
        inner = f"SELECT step, id, piv, CASE WHEN list_contains(piv, {k}) THEN list_transform(range(1, {p + 2}), lambda i: list_transform(range(1, {p + 2}), lambda j: {cell})) ELSE a END AS a FROM ({inner})"
    solved = "[" + ", ".join(f"CASE WHEN list_contains(o.piv, {k}) THEN a[{k}][{p + 1}] ELSE 0 END" for k in range(1, p + 1)) + "]"
    return f"""v AS (SELECT [1.0, {", ".join(features)}] AS x, [{", ".join(effects)}] AS ys FROM {table}),
it AS (SELECT 0 AS step, id, yi, piv, CAST(list_transform(range({p}), lambda k: 0) AS DOUBLE[]) AS b FROM (VALUES {rows}) c(id, yi, piv)
UNION ALL SELECT o.step + 1, o.id, c.yi, o.piv, {solved} FROM ({inner}) o JOIN (VALUES {rows}) c(id, yi, piv) ON c.id = o.id),
fitted AS (SELECT id, b FROM it WHERE step = {rounds})"""


def adam_steps(p: int, m: int, epochs: int, rate: float, penalty: str, patience: int) -> str:
    """CTEs from m (n, a: products of p features and m effects) on: adam (w, m x p) after full-batch steps on the mean square; `penalty` is the
    penalty's weight on column k. They end where the loss hasn't improved for `patience` steps."""
    each = lambda cell: f"list_transform(range(1, {m + 1}), lambda i: list_transform(range(1, {p + 1}), lambda k: {cell}))"
    zero = f"CAST({each('0')} AS DOUBLE[][])"
    slope = each(f"2 * (list_sum(list_transform(range(1, {p + 1}), lambda q: w[i][q] * a[q][k])) - a[k][{p} + i]) / (n * {m}) + {penalty} * sign(w[i][k])")
    moved = each(f"w[i][k] - {rate} * (f[i][k] / (1 - pow(0.9, t + 1))) / (sqrt(s[i][k] / (1 - pow(0.999, t + 1))) + 1e-8)")
    return f"""steps AS (SELECT 0 AS t, {zero} AS w, {zero} AS f, {zero} AS s
UNION ALL SELECT t + 1, {moved}, f, s FROM (SELECT t, w, {each("0.9 * f[i][k] + 0.1 * g[i][k]")} AS f, {each("0.999 * s[i][k] + 0.001 * g[i][k] * g[i][k]")} AS s FROM (SELECT t, w, f, s, {slope} AS g FROM steps, m WHERE t < {epochs}))),
losses AS (SELECT t, w, list_sum(list_transform(range(1, {m + 1}), lambda i: (a[{p} + i][{p} + i] + list_sum(list_transform(range(1, {p + 1}), lambda k: w[i][k] * (list_sum(list_transform(range(1, {p + 1}), lambda q: w[i][q] * a[q][k])) - 2 * a[k][{p} + i])))) / (n * {m}) + list_sum(list_transform(range(1, {p + 1}), lambda k: {penalty} * abs(w[i][k]))))) AS loss FROM steps, m WHERE t > 0),
waits AS (SELECT t, w, t - max(CASE WHEN better THEN t END) OVER (ORDER BY t) AS waited FROM (SELECT t, w, coalesce(loss < min(loss) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS better FROM losses)),
adam AS (SELECT w FROM waits WHERE t = (SELECT coalesce(min(t) FILTER (waited >= {patience}), {epochs}) FROM waits))"""


def forward_errors(table: str, target: str, lag: int, folds: int) -> str:
    """The mean of the forward-chaining errors of target on its own lag; the first fold only trains, the last takes the remainder."""
    return f"""SELECT avg(e) AS err FROM (SELECT v, avg(pow(y - a - b * x, 2)) AS e FROM
(SELECT y, x, least(i // (n // {folds}), {folds - 1}) AS fold FROM (SELECT {target} AS y, lag({target}, {lag}) OVER (ORDER BY t) AS x, row_number() OVER (ORDER BY t) - 1 - {lag} AS i, count(*) OVER () - {lag} AS n FROM {table}) WHERE x IS NOT NULL) test
JOIN (SELECT v, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT y, x, least(i // (n // {folds}), {folds - 1}) AS fold FROM (SELECT {target} AS y, lag({target}, {lag}) OVER (ORDER BY t) AS x, row_number() OVER (ORDER BY t) - 1 - {lag} AS i, count(*) OVER () - {lag} AS n FROM {table}) WHERE x IS NOT NULL),
(SELECT unnest(generate_series(1, {folds - 1})) AS v) WHERE fold < v GROUP BY v) model ON test.fold = model.v GROUP BY v)"""


def forward_lags(table: str, names: Sequence[str], most: int, folds: int) -> str:
    """CTEs from a table (t, names) on: own (target, lag, s), the errors of each own lag, and lags (effect, cause, lag), which forward chaining takes."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS c, row_number() OVER (ORDER BY t) AS t, {c} AS x FROM {table}" for c in names)

    def errors(name: str, candidates: str) -> str:
        # y on a, and on b if there is another variable; a fold's model comes from the rows before it
        cov = lambda a, b: f"covar_pop({a}, {b})"
        return f"""{name}_r AS (SELECT id, y.t, y.x AS y, a.x AS a, coalesce(b.x, 0) AS b, least((y.t - 1 - m) // ((n - m) // {folds}), {folds - 1}) AS fold
FROM (SELECT *, greatest(own, k) AS m FROM ({candidates})) q JOIN x y ON y.c = target JOIN x a ON a.c = target AND a.t = y.t - own LEFT JOIN x b ON b.c = other AND b.t = y.t - k, (SELECT count(*) AS n FROM {table}) WHERE y.t > m),
{name}_c AS (SELECT id, v, avg(y) AS y, avg(a) AS a, avg(b) AS b, {cov("a", "a")} AS aa, {cov("b", "b")} AS bb, {cov("a", "b")} AS ab, {cov("y", "a")} AS ya, {cov("y", "b")} AS yb FROM {name}_r, (SELECT unnest(generate_series(1, {folds - 1})) AS v) WHERE fold < v GROUP BY id, v),
{name}_w AS (SELECT id, v, y AS my, a AS ma, b AS mb, CASE WHEN bb = 0 THEN ya / aa ELSE (ya * bb - yb * ab) / (aa * bb - ab * ab) END AS wa, CASE WHEN bb = 0 THEN 0 ELSE (yb * aa - ya * ab) / (aa * bb - ab * ab) END AS wb FROM {name}_c),
{name} AS (SELECT id, avg(e) AS s FROM (SELECT id, fold, avg(pow(y - my - wa * (a - ma) - wb * (b - mb), 2)) AS e FROM {name}_r JOIN {name}_w USING (id) WHERE fold = v GROUP BY id, fold) GROUP BY id)"""

    values = ", ".join(f"('{c}')" for c in names)
    return f"""x AS ({rows}), q1 AS (SELECT row_number() OVER () AS id, target, own, NULL AS other, 0 AS k FROM (VALUES {values}) n(target), (SELECT unnest(generate_series(1, {most})) AS own)),
{errors("e1", "SELECT * FROM q1")},
own AS (SELECT target, own AS lag, s FROM q1 JOIN e1 USING (id)), best AS (SELECT target, arg_min(lag, s) AS own, min(s) AS s FROM own GROUP BY target),
q2 AS (SELECT row_number() OVER () AS id, target, own, other, k, s AS own_s FROM best, (VALUES {values}) n(other), (SELECT unnest(generate_series(1, {most})) AS k) WHERE other <> target),
{errors("e2", "SELECT * FROM q2")},
lags AS (SELECT target AS effect, target AS cause, own AS lag FROM best UNION ALL SELECT target, other, CASE WHEN min(s) < any_value(own_s) THEN arg_min(k, s) ELSE 1 END FROM q2 JOIN e2 USING (id) GROUP BY target, other)"""


def pair_score(table: str, target: str, own: int, other: str | None = None, lag: int = 0) -> str:
    """AIC of target on its own lag, and on one lag of another variable, each with a constant, on the rows that have both."""
    most = max(own, lag)
    cells = f"{target} AS y, lag({target}, {own}) OVER (ORDER BY t) AS a" + (f", lag({other}, {lag}) OVER (ORDER BY t) AS b" if other else "") + ", row_number() OVER (ORDER BY t) AS rn"
    rows = f"(SELECT * FROM (SELECT {cells} FROM {table}) WHERE rn > {most})"
    if not other:
        return f"SELECT 4 + count(*) * ln((regr_syy(y, a) - pow(regr_sxy(y, a), 2) / regr_sxx(y, a)) / count(*)) FROM {rows}"
    s = {f"{u}{v}": f"covar_pop({u}, {v})" for u, v in ("yy", "aa", "bb", "ya", "yb", "ab")}
    rss = f"{s['yy']} - ({s['ya']} * {s['ya']} * {s['bb']} - 2 * {s['ya']} * {s['yb']} * {s['ab']} + {s['yb']} * {s['yb']} * {s['aa']}) / ({s['aa']} * {s['bb']} - {s['ab']} * {s['ab']})"
    return f"SELECT 6 + count(*) * ln({rss}) FROM {rows}"


def ic_lags(table: str, names: Sequence[str], most: int, delta: float, prune: float) -> str:
    """CTEs from a table (t, names) on: lags (effect, cause, lag) by BIC. An own lag, each other variable's lag next to it if it improves by
    delta, then one lag a step is shortened, the best first, while the score stays within `prune` of the last one."""
    d, size = len(names), most + 1
    columns = lags(names, 0, most)
    cells = ", ".join(f"{c} AS {c}_lag0" if k == 0 else f"lag({c}, {k}) OVER (ORDER BY t) AS {c}_lag{k}" for c in names for k in range(size))
    rows = ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) * count(*)" for b in columns) + "]" for a in columns)
    products = " UNION ALL ".join(f"SELECT {m} AS m, count(*) AS n, [{rows}] AS a FROM wide WHERE rn > {m}" for m in range(1, most + 1))
    at = lambda j, k: f"a[({j} - 1) * {size} + {k} + 1]"
    cell = lambda p, q: f"{at(*p)}[({q[0]} - 1) * {size} + {q[1]} + 1]"
    y, o, x = ("i", "0"), ("i", "own"), ("j", "k")
    one = f"2 * ln(n) + n * ln(({cell(y, y)} - pow({cell(y, ('i', 'k'))}, 2) / {cell(('i', 'k'), ('i', 'k'))}) / n)"
    two = f"({cell(y, y)} - (pow({cell(y, o)}, 2) * {cell(x, x)} - 2 * {cell(y, o)} * {cell(y, x)} * {cell(o, x)} + pow({cell(y, x)}, 2) * {cell(o, o)}) / ({cell(o, o)} * {cell(x, x)} - pow({cell(o, x)}, 2)))"
    best = "SELECT i, j, own_s AS s, 1 AS lag, scores FROM (SELECT i, j, any_value(own_s) AS own_s, list(s ORDER BY k) AS scores FROM pairs GROUP BY i, j)"
    for k in range(1, most + 1):
        best = f"SELECT i, j, CASE WHEN scores[{k}] < s - {delta} THEN scores[{k}] ELSE s END AS s, CASE WHEN scores[{k}] < s - {delta} THEN {k} ELSE lag END AS lag, scores FROM ({best})"

    def scored(source: str) -> str:
        # rows (i, l, ..) with the residual of i on the d lags l
        idx = f"list_append(list_transform(range(1, {d + 1}), lambda j: (j - 1) * {size} + l[j] + 1), (i - 1) * {size} + 1)"
        out = f"SELECT c.*, n, list_transform({idx}, lambda p: list_transform({idx}, lambda q: a[p][q])) AS z FROM ({source}) c JOIN mm ON mm.m = list_max(l)"
        for k in range(1, d + 1):
            sweep = f"list_transform(range(1, {d + 2}), lambda p: list_transform(range(1, {d + 2}), lambda q: z[p][q] - z[p][{k}] * z[{k}][q] / z[{k}][{k}]))"
            out = f"SELECT * EXCLUDE (z), list_transform({sweep}, lambda r, p: CASE WHEN p = {k} THEN z[{k}] ELSE r END) AS z FROM ({out})"
        return f"SELECT * EXCLUDE (z, n), {d + 1} * ln(n) + n * ln(z[{d + 1}][{d + 1}] / n) AS s FROM ({out})"

    shorter = f"SELECT i, step, now, list_transform(range(1, {d + 1}), lambda x: CASE WHEN x = j THEN l[x] - 1 ELSE l[x] END) AS l FROM st, (SELECT unnest(range(1, {d + 1})) AS j) WHERE l[j] > 1"
    labels = ", ".join(f"({k}, '{c}')" for k, c in enumerate(names, 1))
    return f"""wide AS (SELECT {cells}, row_number() OVER (ORDER BY t) AS rn FROM {table}), mm AS ({products}), ks AS (SELECT unnest(range(1, {size})) AS k), vs AS (SELECT unnest(range(1, {d + 1})) AS i),
best AS (SELECT i, arg_min(k, s) AS own, min(s) AS own_s FROM (SELECT i, k, {one} AS s FROM vs, ks JOIN mm ON m = k) GROUP BY i),
pairs AS (SELECT i, j, k, own_s, 3 * ln(n) + n * ln({two} / n) AS s FROM best, (SELECT i AS j FROM vs) v, ks JOIN mm ON m = greatest(own, k) WHERE i <> j),
first AS (SELECT i, list(lag ORDER BY j) AS l FROM (SELECT i, j, lag FROM ({best}) UNION ALL SELECT i, i, own FROM best) GROUP BY i),
st AS (SELECT i, 0 AS step, l, s AS now FROM ({scored('SELECT i, l FROM first')})
UNION ALL SELECT i, step + 1, arg_min(l, s), min(s) FROM ({scored(shorter)}) WHERE s <= now + {prune} GROUP BY i, step),
lags AS (SELECT e.name AS effect, c.name AS cause, l[c.k] AS lag FROM (SELECT i, arg_max(l, step) AS l FROM st GROUP BY i) JOIN (VALUES {labels}) e(k, name) ON e.k = i, (VALUES {labels}) c(k, name))"""


def var_order(names: Sequence[str], most: int) -> str:
    """CTEs from dd on: the order of a vector autoregression by each of four criteria, each order on its own sample: orders (name, p)."""
    d, out = len(names), []
    for p in range(1, most + 1):
        out.append(f"z{p} AS ({lagged('dd', names, p)}), m{p} AS ({products([*lags(names, 1, p), *names], f'z{p}', scaled=False)}), {swept(f'v{p}', {'all': range(1, d * p + d + 1)}, d * p, f'm{p}')}")
    rows = " UNION ALL ".join(f"SELECT {p} AS p, n, ld, {d * p + 1} AS r FROM v{p}" for p in range(1, most + 1))
    values = {"aic": f"ld + 2.0 / n * {d} * r", "bic": f"ld + ln(n) / n * {d} * r", "hqic": f"ld + 2 * ln(ln(n)) / n * {d} * r", "fpe": f"pow((n + r) / CAST(n - r AS DOUBLE), {d}) * exp(ld)"}
    return ",\n".join(out) + f",\nc AS ({rows}), orders AS (" + " UNION ALL ".join(f"SELECT '{k}' AS name, arg_min(p, {v}) AS p FROM c" for k, v in values.items()) + ")"


def common_var_order(names: Sequence[str], most: int) -> str:
    """CTEs from dd on: best (p), the order with the least AIC on the rows that have all lags."""
    d = len(names)
    fits = {str(p): [*(j * most + k for j in range(d) for k in range(1, p + 1)), *range(d * most + 1, d * most + d + 1)] for p in range(1, most + 1)}
    return f"z AS ({lagged('dd', names, most)}), m AS ({products([*lags(names, 1, most), *names], 'z', scaled=False)}), {swept('w', fits, d * most)},\nbest AS (SELECT arg_min(CAST(fit AS INTEGER), ld + 2.0 / n * {d} * ({d} * CAST(fit AS INTEGER) + 1)) AS p FROM w)"


def _differenced(table: str, names: Sequence[str], most: int) -> str:
    """CTEs from a table (t, names): y (v, d, t = 1, 2, .., x), differences of orders 0..most, and sizes (v, d, n)."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS v, t, {c} AS x FROM {table}" for c in names)
    out = [f"y0 AS (SELECT v, row_number() OVER (PARTITION BY v ORDER BY t) AS t, x FROM ({rows}))"]
    out += [f"y{d} AS (SELECT v, t - 1 AS t, x FROM (SELECT v, t, x - lag(x) OVER (PARTITION BY v ORDER BY t) AS x FROM y{d - 1}) WHERE x IS NOT NULL)" for d in range(1, most + 1)]
    return ", ".join(out) + ", y AS (" + " UNION ALL ".join(f"SELECT v, {d} AS d, t, x FROM y{d}" for d in range(most + 1)) + "), sizes AS (SELECT v, d, count(*) AS n FROM y GROUP BY v, d)"


def _first_passed(passed: str, score: str) -> str:
    """The first order of differencing that passes, else that of the least score, from tests (v, d, n, span, ..)."""
    usable = "n >= 4 AND span > 0"
    return f"""SELECT 0 AS segment_id, v AS variable, CAST(coalesce(min(d) FILTER ({usable} AND {passed}), arg_min(d, {score}) FILTER ({usable}), 0) AS INTEGER) AS "order" FROM tests GROUP BY v"""


def adf_orders(table: str, names: Sequence[str], most: int, small: Sequence[float], large: Sequence[float], star: float, quantile: float) -> str:
    """Orders by the augmented Dickey-Fuller test: a design in long form, its products swept column by column; p is monotone in its normal score."""
    cell = "CASE WHEN i = k AND j = k THEN -1 / a[k][k] WHEN i = k THEN a[k][j] / a[k][k] WHEN j = k THEN a[i][k] / a[k][k] ELSE a[i][j] - a[i][k] * a[k][j] / a[k][k] END"
    matrix = f"list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: {cell}))"

    def products(name: str, lags: str, source: str) -> str:
        # columns 1 (the level before), 2.. (lagged differences) and the last (the difference), centred over rows that have them all
        return f"""{name}_u AS (SELECT u.v, u.d, u.t, CASE WHEN i < 0 THEN {lags} + 2 ELSE i END AS i, x - avg(x) OVER (PARTITION BY u.v, u.d, i) AS x FROM u JOIN {source} o USING (v, d) WHERE u.t > {lags} + 1 AND i <= {lags} + 1),
{name}_g AS (SELECT a.v, a.d, a.i, b.i AS j, sum(a.x * b.x) AS g, count(*) AS n FROM {name}_u a JOIN {name}_u b USING (v, d, t) GROUP BY ALL),
{name}_m AS (SELECT v, d, any_value(n) AS n, list(r ORDER BY i) AS a FROM (SELECT v, d, i, any_value(n) AS n, list(g ORDER BY j) AS r FROM {name}_g GROUP BY v, d, i) GROUP BY v, d),
{name}_s AS (SELECT v, d, n, 0 AS k, a FROM {name}_m UNION ALL SELECT v, d, n, k, {matrix} FROM (SELECT v, d, n, k + 1 AS k, a FROM {name}_s WHERE k + 1 < len(a)))"""

    poly = lambda c: " + ".join(f"{x} * pow(tau, {i})" for i, x in enumerate(c))
    return f"""WITH RECURSIVE {table}, {_differenced('panel', names, most)},
o AS (SELECT v, d, n, least(CAST(ceil(12 * pow(n / 100.0, 0.25)) AS BIGINT), n // 2 - 2) AS most FROM sizes),
z AS (SELECT v, d, t, x, lag(x) OVER w AS level, x - lag(x) OVER w AS step FROM y WINDOW w AS (PARTITION BY v, d ORDER BY t)),
u AS (SELECT v, d, t, 1 AS i, level AS x FROM z WHERE t > 1 UNION ALL SELECT v, d, t, -1, step FROM z WHERE t > 1 UNION ALL SELECT z.v, z.d, z.t, k + 1, b.step FROM z JOIN o USING (v, d), LATERAL (SELECT unnest(generate_series(1, o.most)) AS k) JOIN z b ON b.v = z.v AND b.d = z.d AND b.t = z.t - k WHERE b.t > 1),
{products('c', 'o.most', 'o')},
best AS (SELECT v, d, arg_min(k - 1, n * (ln(2 * pi()) + ln(a[-1][-1] / n) + 1) + 2 * (k + 1)) AS lags FROM c_s WHERE k > 0 GROUP BY v, d),
{products('f', 'o.lags', 'best')},
taus AS (SELECT v, d, len(a) - 2 AS lags, a[1][-1] / sqrt(a[-1][-1] / (n - len(a)) * -a[1][1]) AS tau FROM f_s WHERE k = len(a) - 1),
tests AS (SELECT *, CASE WHEN tau <= {star} THEN {poly(small)} ELSE {poly(large)} END AS score FROM taus JOIN sizes USING (v, d) JOIN (SELECT v, d, max(x) - min(x) AS span FROM y GROUP BY v, d) USING (v, d))
{_first_passed(f'score <= {quantile}', 'score')}"""


def kpss_tests(table: str, names: Sequence[str], most: int) -> str:
    """CTEs on to tests (v, d, n, lags, stat, span) of the KPSS statistic around a trend."""
    return f"""WITH {table}, {_differenced('panel', names, most)},
line AS (SELECT v, d, regr_slope(x, t) AS b, regr_intercept(x, t) AS a, max(x) - min(x) AS span FROM y GROUP BY v, d),
r AS (SELECT v, d, t, x - a - b * t AS r FROM y JOIN line USING (v, d)),
p AS (SELECT v, d, sum(p * p) AS squares FROM (SELECT v, d, sum(r) OVER (PARTITION BY v, d ORDER BY t) AS p FROM r) GROUP BY v, d),
near AS (SELECT x.v, x.d, i, sum(x.r * b.r) AS g FROM r x JOIN sizes USING (v, d), LATERAL (SELECT unnest(generate_series(0, CAST(floor(pow(sizes.n, 2.0 / 9)) AS BIGINT))) AS i) JOIN r b ON b.v = x.v AND b.d = x.d AND b.t = x.t - i GROUP BY ALL),
s AS (SELECT v, d, sum(CASE WHEN i = 0 THEN g / n ELSE 2 * g / n END) AS s0, sum(2 * i * g / n) AS s1 FROM near JOIN sizes USING (v, d) GROUP BY v, d),
o AS (SELECT v, d, n, least(CAST(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)) AS BIGINT), n - 1) AS lags FROM s JOIN sizes USING (v, d)),
far AS (SELECT x.v, x.d, i, sum(x.r * b.r) AS g FROM r x JOIN o USING (v, d), LATERAL (SELECT unnest(generate_series(0, o.lags)) AS i) JOIN r b ON b.v = x.v AND b.d = x.d AND b.t = x.t - i GROUP BY ALL),
tests AS (SELECT v, d, n, lags, squares / n / n / (s2 / n) AS stat, span FROM (SELECT v, d, sum(CASE WHEN i = 0 THEN g ELSE 2 * g * (1 - i / (lags + 1.0)) END) AS s2 FROM far JOIN o USING (v, d) GROUP BY v, d) JOIN o USING (v, d) JOIN p USING (v, d) JOIN line USING (v, d))"""
