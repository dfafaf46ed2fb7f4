"""The pipeline's stages on a small table, each against what it must do with its own input."""

import numpy as np
import pytest

import corpus_pipeline as C
from tributary.llm import registry


def table(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("etaoinshr"), rng.integers(2, 8)))
    base = [word() for _ in range(80)]
    rows = [(i, " ".join(word() for _ in range(rng.integers(5, 60))), "en", f"src{i % 6}") for i in range(60)]
    rows += [(100 + i, " ".join([*base[: 40 + i], "odd", *base[41 + i :]]), "en", "src1") for i in range(5)]
    rows += [(200 + i, " ".join(base) + " call +1 (743) 555-3824 now", "en", None) for i in range(3)]
    rows += [(310 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/"), 400)), "en", "src2") for i in range(3)] + [(320, "привет мир как дела", None, "src2")]
    rows += [(300, None, "en", "src0"), (301, "12 34 !!", "de", "src2"), (302, "", None, "src3"), (0, rows[0][1], "en", "src0"), (None, "no id here", "en", "src1")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, n = [docs], len(C.STAGES)
    for k, (name, f) in enumerate(C.STAGES):
        out = f(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        seen.append(spark.read.parquet(str(tmp_path / f"out{k}")))
        if k < n - 1:
            assert seen[-1].columns == docs.columns, name
    ids = [sorted(str(r["doc_id"]) for r in df.collect()) for df in seen]
    assert set(ids[0]) - set(ids[1]) == {"300", "301", "302", "310", "311", "312", "320"}
    assert "100" in ids[2] and not {"101", "102", "103", "104", "201"} & set(ids[2]) and ids[2].count("0") == 1 and "None" in ids[2]
    assert set(map(str, range(60))) <= set(ids[2])
    text = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    old = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert not any("555" in (t or "") for t in text.values())
    assert all(text[d] == t for d, t in old.items() if "555" not in t)
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert words(seen[4]) == words(seen[3]) * C.MIX_PERCENT // 100
    run = sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in C.run(spark, str(tmp_path)).collect())
    assert run == sorted((str(r["doc_id"]), r["piece"], r["ids_crc32"]) for r in seen[5].collect())


def test_odd_rows_and_columns(spark, tmp_path):
    """Very long and empty texts, ties, repeated rows, null ids and languages, and columns that the operators use themselves."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(500)]
    long = " ".join(rng.choice(words, 150_000))
    rows = [(1, long, "en", "s1"), (2, long, "en", "s1"), (2, long, "en", "s1"), (3, "", "en", None), (None, " ".join(words[:50]), None, "s2"), (None, " ".join(words[:50]), None, "s2"), (4, " ".join(words[50:90]), None, None), (5, " ".join(words[90:130]), "en", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = "score lang_pred c c2 h sig n rep copies root group kind range block entity term base hide spans grp piece length start domain level_0 tokens quota epochs taken cut1 digit nth nxt t a b x y members pairs others __text __id __hash __lang __score __m __n __spans __epochs __prefix __level_0 __hot __cold __deal __done"
    docs = docs.selectExpr("*", *(f"{i} AS {c}" for i, c in enumerate(clash.split())))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, ids = docs, []
    for name, f in C.STAGES[:-1]:
        now = C.common.saved(f(spark, now, str(tmp_path)), name)
        assert now.columns == docs.columns, name
        ids.append(sorted(str(r["doc_id"]) for r in now.select("doc_id").collect()))
        assert now.where(f"score <> 0 OR grp <> {clash.split().index('grp')}").count() == 0, name
    assert ids[0] == ["1", "2", "2", "4", "5", "None", "None"] and ids[1] == ids[2] == ["1", "4", "5", "None"]
    assert C.run(spark, str(tmp_path)).count() > 100


def test_empty(spark, tmp_path):
    docs = table(spark).limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 14)] == [1] * 13
    assert names["pipeline"] is C.run and set(registry.QUERIES) <= set(names)
    assert 4 <= len(C.STAGES) <= 5


def test_mixing_query_equals_its_sql(spark):
    import os

    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(registry.ORACLES["op1_source_mixing"]).fetchall()
    got = registry.QUERIES["op1_source_mixing"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_one_row_of_each_group_stays(spark):
    word = [f"word{i}" for i in range(60)]
    near = lambda k: " ".join([*word[:k], "odd", *word[k + 1 :]])
    far = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    rows = [(1, near(30)), (2, near(31)), (2, far[0])]  # 2 stays with its other text only
    rows += [(3, far[1]), (3, far[1] + " more"), (3, far[2])]  # near copies under one id, and another text
    rows += [(None, far[3]), (None, far[3]), (None, near(32)), (None, "short"), (None, "short")]
    rows = [(*r, "en", "src1", len(r[1])) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in C.deduplicate(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and (got.count((3, far[1])) + got.count((3, far[1] + " more"))) == 1
    assert {x for x in got if x[1] not in (far[1], far[1] + " more")} == {(1, near(30)), (2, far[0]), (3, far[2]), (None, far[3]), (None, "short")}
