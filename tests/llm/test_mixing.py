import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tributary.llm import mixing



@pytest.fixture(scope="module")
def levels(spark):
    return {"domain": F.col("domain"), "lang": F.col("lang"), "source": F.col("source")}


def leaves(spark, rows):
    return spark.createDataFrame(rows, "a string, b string, tokens long")


def quotas(df):
    return {(r["a"], r["b"]): r["quota"] for r in df.collect()}


def test_shortage_goes_to_siblings_first(spark):
    df = leaves(spark, [("x", "1", 10), ("x", "2", 1000), ("y", "1", 1000), ("y", "2", 1000)])
    got = quotas(mixing.budgets(df, 400, ["a", "b"], {}))
    assert got == {("x", "1"): 10, ("x", "2"): 190, ("y", "1"): 100, ("y", "2"): 100}


def test_then_to_ancestors(spark):
    df = leaves(spark, [("x", "1", 10), ("x", "2", 20), ("y", "1", 1000), ("y", "2", 1000)])
    got = quotas(mixing.budgets(df, 401, ["a", "b"], {("x",): 3, ("y",): 1, ("y", "1"): 2}))
    assert got == {("x", "1"): 10, ("x", "2"): 20, ("y", "1"): 248, ("y", "2"): 123}
    assert sum(got.values()) == 401


def test_zero_weights_epochs_and_too_much(spark):
    df = leaves(spark, [("x", "1", 10), ("x", "2", 20), ("y", "1", 5)])
    assert quotas(mixing.budgets(df, 10**6, ["a", "b"], {("x", "2"): 0}, max_epochs=3)) == {("x", "1"): 30, ("x", "2"): 0, ("y", "1"): 15}
    assert set(quotas(mixing.budgets(df, 0, ["a", "b"], {})).values()) == {0}
    assert quotas(mixing.budgets(df.limit(0), 5, ["a", "b"], {})) == {}


def docs(spark):
    rows = []
    for i in range(300):
        rows.append((i, " ".join(f"w{i}_{k}" for k in range(i % 7)), "d0" if i % 3 else None, "en" if i % 2 else "de", "hot" if i < 200 else f"s{i % 4}", 1))
    rows += [(900, None, "d0", "en", "hot", 0), (901, "  x\n y ", "d1", None, None, 0), (901, "  x\n y ", "d1", None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, domain string, lang string, source string, n_chars int").selectExpr("*", "1 AS cut1", "2 AS h", "3 AS rest", "4 AS level_0")


def brute(rows, percent, epochs, seed, weights):
    seen = {(r["doc_id"], r["text"], r["domain"] or "", r["lang"] or "", r["source"] or "") for r in rows}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by_leaf = defaultdict(list)
    for d, t, *leaf in seen:
        by_leaf[tuple(leaf)].append((d, t, words(t)))
    tokens = {k: sum(n for *_, n in v) for k, v in by_leaf.items()}

    def fill(budget, prefix, nodes):
        k = len(prefix) + 1
        kids = sorted({n[:k] for n in nodes})
        cap = {c: sum(tokens[n] * epochs for n in nodes if n[:k] == c) for c in kids}
        full, left = set(), budget
        while True:
            w = sum(weights.get(c, 1) for c in kids if c not in full)
            new = [c for c in kids if c not in full and cap[c] * w <= weights.get(c, 1) * left]
            if not new:
                break
            c = min(new, key=lambda c: cap[c] / weights.get(c, 1))
            full.add(c)
            left -= cap[c]
        share = {c: cap[c] if c in full else weights.get(c, 1) * left // w for c in kids}
        odd = left - sum(share[c] for c in kids if c not in full)
        for c in [c for c in kids if c not in full][:odd]:
            share[c] += 1
        if k == 3:
            return share
        out = {}
        for c in kids:
            out |= fill(share[c], c, [n for n in nodes if n[:k] == c])
        return out

    total = sum(tokens.values())
    quota = fill(min(total * epochs, total * percent // 100), (), list(tokens))
    out = {}
    for leaf, own in by_leaf.items():
        t = tokens[leaf]
        e, rest = divmod(quota[leaf], t) if t else (0, 0)
        for d, text, n in sorted(own, key=lambda x: (hashlib.md5(f"{seed}:{e}:{x[0]}".encode()).hexdigest(), x[0])):
            p = max(0, min(n, rest))
            rest -= n
            out[d] = (n, e, p, e * n + p)
    return out


@pytest.mark.parametrize("percent", [30, 130])
def test_decisions_equal_brute_force(spark, levels, percent):
    weights = {("d0",): 3, ("d0", "en"): 2, ("d0", "en", "hot"): 5}
    df = docs(spark)
    got = {r["doc_id"]: (r["n_tokens"], r["epochs"], r["prefix_tokens"], r["taken"]) for r in mixing.decide(df, levels, weights, percent, 2, 5).collect()}
    assert got == brute(df.collect(), percent, 2, 5, weights)


def test_apply_cuts_and_repeats(spark, levels):
    df = docs(spark)
    decisions = mixing.decide(df, levels, {}, 150, 2, 5)
    want = {r["doc_id"]: r for r in decisions.collect()}
    out = mixing.apply(df, decisions, levels)
    assert out.columns == df.columns
    count = defaultdict(int)
    for r in out.collect():
        assert r["n_chars"] == len(r["text"])
        count[r["doc_id"]] += len(r["text"].split())
    for d, r in want.items():
        if d != 901:
            assert count[d] == r["taken"]
    assert mixing.decide(df.limit(0), levels, {}).count() == 0
    assert mixing.decide(df, levels, {}, 0).agg(F.sum("taken")).first()[0] == 0
