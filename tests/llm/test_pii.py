import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tributary.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(digits) <= 19 and luhn(digits) or k == "phone" and 8 <= len(digits) <= 15:
                out.append((k, m.start(), m.end(), m[0]))
    return out


def texts():
    rng = np.random.default_rng(4)
    pieces = ["a.b@c.de", "x@y_z@w.de", "foo@bar@baz.com", "a@b.com_x@c.de", "a..b@c..d", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.02.3.0255", "00000000001.1.1.1", "4539 1488 0343 6467", "4539-1488--0343-6467", "45391488034364671", "+1 (743) 555-3824", "+49 (0) 30.123", "+1", "é", "\U0001f600", " ", "-", "@", "..", "12", "\n", "+", "word", "5500005555555559", "6011000990139424 4", "a@b.c.d-e."]
    out = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(400)]
    return [*out, None, "", "1" * 30000, "1 2 " * 8000, "a@" + "b." * 9000 + "c", "x" * 30000 + "@", "1." * 9000, "+1" + "(1)" * 9000]


def test_base_spans_equal_plain_matching(spark):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.scan(df).collect()}
    for i, x in enumerate(t):
        assert [(s["kind"], s["s"], s["e"], s["value"]) for s in got[i]["base"]] == base(x), (i, (x or "")[:100])


def corpus():
    rng = np.random.default_rng(6)
    common = [f"{a}{b}{c}" for a in "kmnp" for b in "aeio" for c in "rstl"]
    rows = [" ".join(rng.choice(common, 25)) for _ in range(120)]
    rows += [f"{' '.join(rng.choice(common, 12))} Zorbl quimby bob.{'x'}@mail.example {' '.join(rng.choice(common, 5))} zorbl, zorblish" for _ in range(5)]
    rows += [f"{' '.join(rng.choice(common, 8))} quimby" for _ in range(2)]
    return [*rows, rows[-3], None, ""]


def expected_terms(t):
    word = lambda x: {w for w in re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", x or "").lower())}
    n, df, ent, joint, support = len(t), Counter(), Counter(), Counter(), {}
    for x in t:
        own, e = word(x), {s[3].lower() for s in base(x)}
        df.update(own)
        ent.update(e)
        for a in e:
            for w in own:
                joint[a, w] += 1
                support.setdefault((a, w), set()).add(x)
    return {(a, w): 1 + math.log(j / df[w]) / math.log(n / ent[a]) for (a, w), j in joint.items() if len(support[a, w]) >= pii.MIN_SUPPORT and 1 + math.log(j / df[w]) / math.log(n / ent[a]) >= pii.ALPHA}


def test_disclosing_terms_equal_brute_force(spark):
    t = corpus()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    risky, _ = pii.disclosing(df, pii.texts_of(pii.scan(df)))
    got = {(r["entity"].split(":", 1)[1], r["term"]): r["strength"] for r in risky.collect()}
    want = expected_terms(t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert ("bob.x@mail.example", "zorbl") in got and ("bob.x@mail.example", "quimby") in got


def test_query_and_sanitised_texts(spark, tmp_path):
    t = corpus()
    rows = [(i, x, "en", "src1", len(x or "")) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS entity", "2 AS term", "3 AS base")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pii.op5_pii_sanitise(spark, str(tmp_path)).collect()}
    risky = {w for _, w in expected_terms(t)}
    for i, x in enumerate(t):
        want = [f"{k}:{s}:{e}" for k, s, e, _ in base(x)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and got[i]["n_email"] == len(want)
        if want:
            want += [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"(?i)(?<![^\W\d_])(?:%s)(?![^\W\d_])" % "|".join(sorted(risky)), x)]
        assert got[i]["spans"] == ",".join(want)
    out = pii.sanitise(df)
    assert out.columns == df.columns
    for r in out.collect():
        x = t[r["doc_id"]]
        if not base(x):
            assert r["text"] == x  # clean documents stay as they are
        else:
            assert "[EMAIL]" in r["text"] and "@" not in r["text"] and "zorbl" not in r["text"].lower() and r["n_chars"] == len(r["text"])
    assert pii.sanitise(df.limit(0)).count() == 0


def test_every_document_holds_the_entity(spark):
    df = spark.createDataFrame([(i, f"a@b.cd only text {i}") for i in range(5)] + [(9, "a@b.cd only text 0"), (9, "a@b.cd only text 0"), (None, "a@b.cd")], "doc_id long, text string")
    assert pii.sanitise(df).count() == 8


def test_many_spans_in_one_text(spark):
    """20,000 spans: time in proportion, and the text is put together right."""
    import time

    took = []
    for n in (1_000, 10_000):
        t = "".join(f"mail user{i}@host{i % 7}.example or call; " for i in range(n))
        df = spark.createDataFrame([(1, t), (2, "nothing here \U0001f600 at all")], "doc_id long, text string")
        at = time.perf_counter()
        got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
        took.append(time.perf_counter() - at)
        assert got[1] == "mail [EMAIL] or call; " * n and got[2] == "nothing here \U0001f600 at all"
        (row,) = pii.scan(df.where("doc_id = 1")).collect()
        assert [(s["s"], s["e"]) for s in row["base"]] == [(m.start(), m.end()) for m in re.finditer(PATTERNS["email"], t)]
    assert took[1] < 60 and took[1] < 30 * max(took[0], 1)


def test_parts_of_texts(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else chr(97 + i % 26) for i in range(5000))
    spans = [(0, 0), (0, 1), (0, 1024), (1, 1025), (1023, 1024), (1024, 2048), (1000, 4100), (4096, 5000), (5000, 5000)]
    df = spark.createDataFrame([(text, a, b) for a, b in spans], "text string, a int, b int")
    parts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{pii.PART}}}"), F.lit(0))
    assert [r[0] for r in df.select(pii._between(parts, F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in spans]
