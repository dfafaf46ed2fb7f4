import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.llm import common, graph, jaccard, neardup


def sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def closure(n, edges):
    up = list(range(n))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        u, v = sorted((top(a), top(b)))
        up[v] = u
    return [top(v) for v in range(n)]


def texts():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    out = []
    for g in range(6):
        base = [word() for _ in range(120)]
        for k in range(12):
            w = list(base)
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(len(w))] = word()
            out.append(" ".join(w))
    out += [" ".join(word() for _ in range(50)) for _ in range(40)]
    out += [out[0]] * 5 + [out[0].upper() + "\n"] + [None, "", "  \n", "two words", "Two  words", "one", "one two three four five"]
    return out


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "VERIFY", 5)
    t = texts()
    s = sets(t)
    edges = [(a, b) for a in range(len(t)) for b in range(a) if s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    links = np.bincount(np.array(edges).ravel(), minlength=len(t))
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").selectExpr("*", "1 AS c", "2 AS n", "3 AS root").repartition(5)
    got = {r["doc_id"]: r for r in jaccard.join(df).collect()}
    roots = closure(len(t), edges)
    assert len(got) == len(t)
    for i in range(len(t)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], roots[i], roots[i] == i), i
    assert all(got[i]["class_id"] == 0 for i in range(112, 118))


def test_join_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "x " * 60000)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_links"], r["kept"]) for r in jaccard.join(df).collect())
    assert got == [("7", 1, True), ("7", 1, True), ("8", 0, True), ("None", 0, True)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_prefixes_shorten_until_recall_is_met(spark, monkeypatch):
    assert jaccard.first_depth() == 8 and jaccard.first_depth(0.5) < 4 and jaccard.first_depth(floor=0.9999) < 7
    looked, matched = [], jaccard.matched
    monkeypatch.setattr(jaccard, "matched", lambda classes, depth, first, threshold: looked.append(depth) or matched(classes, depth, first, threshold))
    near = lambda k, n: " ".join([*(f"w{k}x{i}" for i in range(60)), *(f"x{k}x{j}" for j in range(n))])

    def links(n):
        looked.clear()
        rows = [(2 * k + m, near(k, m * n)) for k in range(60) for m in (0, 1)]
        return jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").count()

    assert links(2) == 120 and looked == [8]  # alike: long prefixes will do
    assert links(13) >= 118 and looked[:2] == [8, 7]  # at the threshold: shorter ones


def test_classes_of_one_name_are_told_apart(spark, monkeypatch):
    many = jaccard.Shingler.many

    def few(self, t):
        s, bounds, keys, other = many(self, t)
        return s, bounds, keys % np.uint64(3), other

    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").repartition(3)
    key = lambda r: tuple(r)
    want = sorted(map(key, jaccard.join(df).collect()))
    monkeypatch.setattr(jaccard.Shingler, "many", few)
    assert sorted(map(key, jaccard.join(df).collect())) == want


def test_crafted_texts_are_told_apart(spark):
    # a Thue-Morse word and its complement collide under every polynomial hash modulo a power of two
    a = "a"
    for _ in range(12):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.join(df).collect()) == [(1, 1, 0), (2, 2, 0)]


def test_recall_at_the_similarity_threshold(spark):
    """Measured: of 1,500 pairs with a similarity of 0.80 to 0.82, hardly one is missed."""
    rng = np.random.default_rng(11)
    rows, linked = [], 0
    for k in range(1500):
        w = [f"w{x}" for x in rng.integers(0, 10**9, 49)]
        for m in range(5):  # one more word at a time, up to five at the end
            v = [*w, *(f"v{k}x{j}" for j in range(6 + m))]
            s, t = sets([" ".join(w), " ".join(v)])
            if 0.80 <= len(s & t) / len(s | t) < 0.82:
                rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
                linked += 1
                break
    assert linked == 1500
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.where("doc_id % 2 = 0 and n_links = 1").count() >= 0.997 * linked


def test_hot_keys_are_joined_whole(spark):
    many = spark.range(5000).selectExpr("id", "if(id % 10 = 9, null, if(id % 2 = 0, 7, id)) AS c")
    one = many.groupBy("c").agg(F.count("*").alias("n")).where("c is not null").withColumn("x", F.col("c") * 2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in (threshold, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            df = common.join_hot(many, one, ["c"], "n", 5000)
            plan = df._jdf.queryExecution().executedPlan().toString()
            got = {r["id"]: r for r in df.collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        if most == "-1":  # too large to be broadcast: dealt by the row's number as well
            assert "hashpartitioning(coalesce(__deal" in plan
        assert len(got) == 5000
        for i, r in got.items():
            c = None if i % 10 == 9 else 7 if i % 2 == 0 else i
            assert r["c"] == c and r["x"] == (None if c is None else 2 * c)


def test_whole_groups():
    rows = [(k, 0) for k in [1, 1, 2, 2, 2, 3, 5, 5, 5, 5, 6]]
    schema = pa.schema([("k", pa.int64()), ("v", pa.int64())])
    for cut in (1, 2, 3, 4, 11):
        batches = [pa.RecordBatch.from_pylist([{"k": a, "v": b} for a, b in rows[i : i + cut]], schema) for i in range(0, len(rows), cut)]
        seen = [t.column(0).to_pylist() for t in jaccard._groups(iter(batches), 1)]
        assert sum(seen, []) == [k for k, _ in rows]
        assert all(not set(a) & set(b) for a, b in zip(seen, seen[1:]))


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(120)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = closure(400, edges)
    nodes = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: roots[v] for v in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    rng = np.random.default_rng(5)
    x = [v.tolist() for v in rng.standard_normal((60, 32))]
    for k in range(8):
        base = np.array(x[k])
        for _ in range(5):
            x.append((base * 3 + rng.standard_normal(32) * rng.choice([0.1, 0.3, 0.6])).tolist())
    x += [x[0]] * 20 + [[scale * v for v in x[1]] for scale in (2e-200, 1e200, 5e-310)]
    n = len(x)
    a = np.array(x)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    c = a @ a.T
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(n, None, 0), (n + 1, [0.0] * 32, 0), (n + 2, [None] + [1.0] * 31, 0), (n + 3, [float("nan")] * 32, 0), (n + 4, [1.0, 2.0], 0), (n + 5, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS c", "2 AS vec")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    edges = [(i, j) for i in range(n) for j in range(i) if c[i, j] >= 0.95]
    links = np.bincount(np.array(edges).ravel(), minlength=n)
    roots = closure(n, edges)
    assert {(n - 1, 1), (n - 2, 1), (n - 3, 1)} <= set(edges)
    assert len(got) == n + 6
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"]) == (links[i], roots[i]), i
    for i in range(n, n + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    """Pairs with a cosine of 0.95 share a joint window and reach the count as often as calibrated."""
    rng = np.random.default_rng(2)
    d, pairs = 64, 800
    tables, joint = neardup.design(1000, 0.95)
    u = rng.standard_normal((pairs, d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.standard_normal((pairs, d))
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.951 * u + np.sqrt(1 - 0.951**2) * w
    known = neardup.directions(d, tables * joint)
    cells = [neardup.cells_of(z, *known, tables, joint, 0.95) for z in (u, v)]
    assert (cells[0] == cells[1]).any(axis=1).mean() >= 0.98
    p = neardup.directions(d, neardup.COUNTING)[0]
    count = (np.abs(u @ p - v @ p) <= neardup.WINDOW * neardup.deviation(d, 0.95)).sum(axis=1)
    assert (count >= neardup.least_count()).mean() >= 0.99


@pytest.mark.parametrize("recall", [0.9, 0.9999])
def test_least_count(recall):
    k = neardup.least_count(recall=recall)
    rng = np.random.default_rng(3)
    hits = (np.abs(rng.standard_normal((20000, neardup.COUNTING))) <= neardup.WINDOW).sum(axis=1)
    assert (hits >= k).mean() >= recall - 0.01 and (hits >= k + 2).mean() < recall + 0.1
