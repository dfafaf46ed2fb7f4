import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from tributary.llm import clusters, linefreq, registry, veccodes

VECTORS = "vec_id long, embedding array<double>, label int, cluster int, rid string, v string"


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def odd_vectors():
    rng = np.random.default_rng(5)
    some = np.round(rng.normal(size=(3, 64)), 2)
    rows = [(i, (some[i % 3] + np.round(rng.normal(0, 0.2, 64), 1)).tolist(), i % 4 if i % 5 else None, 7, "x", "y") for i in range(90)]
    rows += [(1000 + i, some[0].tolist(), 1, 7, "x", "y") for i in range(30)]  # copies
    rows += [rows[3], rows[3], (None, some[1].tolist(), 2, None, None, None), (None, some[1].tolist(), 2, None, None, None)]
    rows += [(k, v, 1, 1, "", "") for k, v in enumerate([None, [], [1.0] * 63, [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63, [None] + [1.0] * 63], 5000)]
    return rows


def usable(rows, sizes):
    return [r for r in rows if r[1] is not None and len(r[1]) in sizes and all(x is not None and math.isfinite(x) for x in r[1])]


def lloyd(points, centres, rounds):
    """Plain Lloyd on integers: (place of the centre, squared distance) of each point, and the centres."""
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = defaultdict(list)
        for p in points:
            own[near(p)[1]].append(p)
        for j, ps in own.items():
            centres[j] = [sum(x) // len(ps) for x in zip(*ps)]
    return [near(p)[::-1] for p in points], centres


def test_clusters_equal_plain_rounds(spark, tmp_path):
    rows = odd_vectors()
    got = registry.QUERIES["op11_centroid_clustering"](spark, table(spark, tmp_path, "embeddings", rows, VECTORS)).collect()
    kept = usable(rows, {64})
    points = [[math.floor(64 * x) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda k: (hashlib.sha256(f"1:{'' if kept[k][0] is None else kept[k][0]}".encode()).hexdigest(), np.array(points[k], np.int32).tobytes()))
    found, centres = lloyd(points, [points[k] for k in order[:16]], 3)
    inertia = defaultdict(int)
    for j, d in found:
        inertia[j] += d
    want = [(r[0], j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for r, (j, d) in zip(kept, found, strict=True)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_screening_is_exact_and_screens():
    rng = np.random.default_rng(1)
    for scale, n, k in ((8, 500, 40), (1 << 23, 200, 9), (1, 300, 300), (0, 20, 5)):
        x = np.rint(rng.normal(0, 1, (n, 64)) * scale * rng.choice([0.2, 1, 1, 3], (n, 1))).astype(np.int64).clip(-clusters.LARGEST, clusters.LARGEST)
        c = np.concatenate([x[: k // 2], np.rint(rng.normal(0, 1, (k - k // 2, 64)) * scale).astype(np.int64)])
        tried: list[int] = []
        cluster, best = clusters.nearest(x.astype(np.int32), clusters.block_norms(x), c, tried)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
        if scale == 8:
            assert sum(tried) < 0.75 * n * k  # others were ruled out by norms of blocks
    assert clusters.block_norms(np.ones((2, 5), np.int32)).shape == (2, 5)


def test_too_large_components_are_an_error():
    with pytest.raises(ValueError, match="long"):
        clusters.integers(np.full((1, 64), 1e30), 64)


def test_codes_equal_plain_rounds(spark, tmp_path):
    rows = odd_vectors()
    got = registry.QUERIES["op13_code_compression"](spark, table(spark, tmp_path, "embeddings", rows, VECTORS)).collect()
    kept = usable(rows, {64})
    points = [[math.floor(256 * x) for x in r[1]] for r in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, np.array(points[k], np.int32).tobytes()))[:64]
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(16):
        cut = [v[4 * p : 4 * p + 4] for v in points]
        found, book = lloyd(cut, [cut[k] for k in first], 2)
        books += [str(x) for entry in book for x in entry]
        for i, (j, d) in enumerate(found):
            codes[i] += f"{j:02x}"
            errors[i] += d
    label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        label[r[2]] += e
    h = hashlib.sha256(",".join(books).encode()).hexdigest()
    want = [(r[0], c, e, label[r[2]], h) for r, c, e in zip(kept, codes, errors, strict=True)]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)


def test_lengths_have_codebooks_of_their_own(spark):
    rows = [(i, [float(i % 3)] * (16 if i % 2 else 32), i) for i in range(12)] + [(99, [1.0] * 15, 0), (98, [], 0)]
    df, books = veccodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, size int"), entries=4)
    got = {r["vec_id"]: r for r in df.collect()}
    assert sorted(got) == list(range(12)) and set(books) == {16, 32} and books[16].shape == (16, 4, 1)
    assert all(r["size"] == (16 if i % 2 else 32) and r["error"] == 0 and len(r["codes"]) == 16 for i, r in got.items())
    with pytest.raises(ValueError):
        veccodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, size int"), entries=300)


def test_empty_tables(spark, tmp_path):
    folder = table(spark, tmp_path, "embeddings", [], VECTORS)
    table(spark, tmp_path, "documents", [], DOCS)
    for name in ("op11_centroid_clustering", "op12_line_frequency", "op13_code_compression"):
        assert registry.QUERIES[name](spark, folder).collect() == []


DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid int, host int, lines string, kept string"


def plain_repeats(words):
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(5)})


@pytest.mark.parametrize("seed", range(4))
def test_repeated_words(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 3, 4, 5, 6, 9, 40, 200):
        words = [b"w%d" % x for x in rng.integers(0, [2, 3, 9, 400][seed], n)]
        assert linefreq.repeated_words(words) == plain_repeats(words)
    many = [b"x%d" % (i % 20000) for i in range(20010)]  # too many different words for one number a window
    assert linefreq.repeated_words(many) == 20


def test_line_rules_on_odd_texts():
    assert linefreq.plain("") == (0, 0, 0, 0, 0)
    assert linefreq.plain("a b\n\n \na b\na  b\u00a0 \n\x0b\u2003# <>") == (8, 11, 3, 1, 0)  # other white space belongs to words
    assert linefreq.plain("é \U0001f600\n" * 3)[:4] == (6, 6, 0, 2)
    assert linefreq.lines("The  12 Cats\r\n\nthe 7\tcats ") == [(b"the 0 cats", 3), (b"", 0), (b"the 0 cats", 3)]
    long = "word " * 300_000 + "\n" + "x" * 1_000_000
    assert linefreq.plain(long)[0] == 300_001


def own(i, n):
    """n words that no other i has."""
    return " ".join(f"{chr(0x4E00 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


def docs_with_frequent_lines():
    text = lambda i: "\n".join([f"Page {i} of the site", own(i, 12), "Sign up for NEWS  now"])
    rows = [(i, text(i), "en", "a", 1, 1, 1, "l", "k") for i in range(20)]
    rows += [(100 + i, text(i), "en", "b", 1, 1, 1, "l", "k") for i in range(10)]  # ten documents of b: not above the limit
    rows += [(200, "sign up for news now\n" * 9 + "one two three four five", "en", "a", 1, 1, 1, "l", "k")]  # depleted
    rows += [(300 + i, "sign up for news now ok\nalpha beta gamma delta one two three four five six", "en", "c", 1, 1, 1, "l", "k") for i in range(30)]  # copies are one document
    rows += [(300, rows[-30][1], "en", "c", 1, 1, 1, "l", "k"), (None, None, None, None, None, None, None, None, None), (None, "", None, None, None, None, None, None, None)]
    return rows


def test_frequent_lines_go(spark, tmp_path):
    rows = docs_with_frequent_lines()
    folder = table(spark, tmp_path, "documents", rows, DOCS)
    got = registry.QUERIES["op12_line_frequency"](spark, folder).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(got) == len(rows) and len(by) == len(rows) - 3
    assert all(by[i]["kept"] and by[i]["n_removed_lines"] == 2 and by[i]["n_removed_words"] == 10 for i in range(20))  # "page 0 of the site" too
    assert all(by[i]["kept"] and by[i]["n_removed_lines"] == 0 for i in [*range(100, 110), *range(300, 330)])
    assert by[200]["base_failed"] and not by[200]["kept"] and by[200]["n_removed_words"] == 45 and by[200]["n_dup_lines"] == 8
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in got if r["doc_id"] is None)


def test_clean_texts(spark):
    rows = docs_with_frequent_lines()
    out = linefreq.clean(spark.createDataFrame(rows, DOCS))
    assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[3] == own(3, 12) and got[103] == rows[23][1] and 200 not in got and None not in got


def test_depleted_documents_go(spark):
    """A document that passes the plain rules, of which the frequent lines leave too little."""
    shared = [own(30 + k, 12) for k in range(3)]
    rows = [(i, "\n".join([*shared, own(i, 40 if i else 8)]), "en", "a", 1, 1, 1, "l", "k") for i in range(12)]
    facts, _ = linefreq.judged(spark.createDataFrame(rows, DOCS).selectExpr("monotonically_increasing_id() AS rid", "source AS host", "text", "doc_id"))
    got = {r["doc_id"]: r for r in facts.collect()}
    assert not got[0]["base_failed"] and not got[0]["kept"] and all(got[i]["kept"] for i in range(1, 12))
