import math
import re
from collections import Counter

import numpy as np
import pytest

from tributary.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]


def brute(rows):
    c, pairs, begins = Counter(), Counter(), 0
    for _, t, held in rows:
        if not held:
            w = tokens(t)
            c.update(w)
            pairs.update(zip(["<"] + w[:-1], w))
            begins += 1
    n, v = sum(c.values()), len(c)
    out = []
    for d, t, held in rows:
        w, base, score = tokens(t), 0.0, 0.0
        for a, b in zip(["<"] + w[:-1], w):
            p = (c[b] + lm.ADD) / (n + lm.ADD * (v + 1)) if n else 1.0
            k = begins if a == "<" else c[a]
            base += math.log10(p)
            score += math.log10((pairs[a, b] + lm.MU * p) / (k + lm.MU)) if k else math.log10(p)
        out.append((d, held, len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def rows():
    rng = np.random.default_rng(1)
    words = ["The", "the", "cat", "Ünï", "a b", "x" * 50, "dog."]
    out = [(i, " ".join(rng.choice(words, rng.integers(0, 30))), bool(i % 4 == 0)) for i in range(80)]
    return [*out, (100, "", False), (100, "", False), (101, "\t\n ", True), (102, "new words only", True), (None, "the cat", False), (103, "the cat " * 4000, False)]


@pytest.mark.parametrize("size", [10**7, 300])
def test_equals_brute_force(spark, size):
    df = spark.createDataFrame(rows(), "doc_id long, text string, held_out boolean")
    got = sorted((tuple(r) for r in lm.score(df, block_bytes=size, order=2, range_bytes=size).collect()), key=repr)
    want = sorted(brute(rows()), key=repr)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[1:5])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_and_untrained(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, held_out boolean")
    assert lm.score(df.limit(0)).count() == 0
    got = lm.score(df.where("held_out")).collect()
    assert all(r["train_tokens"] == 0 and r["score"] == 0 for r in got) and len(got) == 22


def test_probabilities_sum_to_one():
    count = np.array([5, 3, 0])
    a = lm.Automaton(count, 4, np.array([0, 0, 1, 3]), np.array([1, 0, 0, 0]), np.array([3, 2, 3, 4]), 8, 2)
    p = 10**a.base
    for state in (0, 1, 3):
        _, gain = a.step(np.full(3, state), np.arange(3))
        assert (10**gain).sum() == pytest.approx(p.sum()) == pytest.approx(1.0)


@pytest.mark.parametrize("segment", [1, 3, 100])
def test_segments_do_not_matter(monkeypatch, segment):
    rng = np.random.default_rng(3)
    text = [" ".join(rng.choice(list("abcd"), n)) for n in (0, 1, 7, 50, 260)]
    h, doc = lm.Tokens()(text)
    held = np.zeros(len(text), bool)
    counts = {kind: (keys, n) for kind, keys, n in lm._asked(h, doc, held, 4)}
    import pyarrow as pa

    told = pa.table({"kind": [*counts, lm.BEGINS], "range": [0] * 5, "counts": [*(lm._small(n) for _, n in counts.values()), lm._small(np.array([5]))], "n": [len(h)] * 5, "v": [5] * 5})
    want = lm._score_block(list(range(5)), held, text, told, lm.Tokens(), 4)[-1]
    monkeypatch.setattr(lm, "SEGMENT", segment)
    assert np.allclose(lm._score_block(list(range(5)), held, text, told, lm.Tokens(), 4)[-1], want, rtol=1e-12)


def test_packed_keys_round_trip():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64))
    assert (lm._keys(lm._planes(keys)) == keys).all()
    for top in (3, 300, 70_000, 2**33):
        assert lm._large(lm._small(np.array([0, top]))).tolist() == [0, top]


def brute_of_order(rows, order):
    """The recursion over contexts as it is written down, shortest context first."""
    grams, contexts, words = Counter(), Counter(), Counter()
    for _, t, held in rows:
        w = [] if held else tokens(t)
        words.update(w)
        seq = ["<", *w]
        for i in range(1, len(seq)):
            for k in range(1, min(order - 1, i) + 1):
                contexts[tuple(seq[i - k : i])] += 1
                grams[tuple(seq[i - k : i + 1])] += 1
    n, v, out = sum(words.values()), len(words), []
    for d, t, _ in rows:
        seq, score = ["<", *tokens(t)], 0.0
        for i in range(1, len(seq)):
            p = (words[seq[i]] + lm.ADD) / (n + lm.ADD * (v + 1))
            for k in range(1, min(order - 1, i) + 1):
                if c := contexts[tuple(seq[i - k : i])]:
                    p = (grams[tuple(seq[i - k : i + 1])] + lm.MU * p) / (c + lm.MU)
            score += math.log10(p)
        out.append((str(d), len(seq) - 1, score))
    return sorted(out)


@pytest.mark.parametrize("order, size", [(2, 300), (3, 3000), (3, 10**7), (5, 900)])
def test_longer_contexts_equal_brute_force(spark, order, size):
    df = spark.createDataFrame(rows(), "doc_id long, text string, held_out boolean")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm.score(df.selectExpr("*", "1 AS block", "2 AS kind", "3 AS n", "4 AS v"), block_bytes=size, order=order, range_bytes=2 * size).collect())
    for a, b in zip(got, brute_of_order(rows(), order), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_query_is_of_order_three(spark, tmp_path):
    text = [(i, t, False) for i, (_, t, _) in enumerate(rows())]
    spark.createDataFrame([x[:2] for x in text], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(r["doc_id"]), r["held_out"], r["score"]) for r in lm.op3_lm_scoring(spark, str(tmp_path)).collect())
    held = {d: h for d, h, _ in got}
    for a, b in zip(got, brute_of_order([(d, t, held[str(d)]) for d, t, _ in text], 3), strict=True):
        assert a[0] == b[0] and a[2] == pytest.approx(b[2], rel=1e-9)


def test_packs_hold_their_rows():
    packs = [lm._pack([1, None], [True, False], ["é ü", ""]), lm._pack([], [], []), lm._pack([-5], [False], ["x" * 5000])]
    ids, held, texts = lm._unpack(packs)
    assert (ids, held.tolist(), texts) == ([1, None, -5], [True, False, False], ["é ü", "", "x" * 5000])
    assert lm._unpack([])[0] == []
