import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import flac, langid


def plain_grams(text):
    out, words = Counter(), []
    word = ""
    for ch in (text or "") + " ":
        low = ch.lower() if len(ch.lower()) == 1 else ch
        if ch.isalpha():
            word += low
        elif word:
            words.append(word)
            word = ""
    for w in words:
        p = f" {w} "
        for n in range(1, langid.MAX_N + 1):
            for i in range(len(p) - n + 1):
                g = p[i : i + n]
                if g.strip() and (n > 1 or g != " "):
                    out[g] += 1
    return out


def key(g):
    k = 0
    for ch in g:
        k = k << langid.BITS | (1 if ch == " " else ord(ch))
    return k


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[: langid.PROFILE]]


TEXTS = [("en", "The cat and the dog, the cat!  The end."), ("en", "When the rain is there, then the thing is wet"), ("de", "Der Hund und die Katze; das Ende der Straße"), ("de", "Über den Wölfen ist die Ruhe nicht"), ("fr", "Le chat et le chien, c'était l'été")]


def test_grams():
    texts = ["The cat's É", "", "12 -- x", "a b"]
    k, d = langid.grams(*langid._texts(texts))
    for i, t in enumerate(texts):
        assert Counter(k[d == i].tolist()) == Counter({key(g): n for g, n in plain_grams(t).items()})


def test_predictions_equal_plain_rank_order(spark):
    asked = ["the dog is there", "die Katze nicht", "le chien et le chat", None, "12 !?", "", "zzz", "x " * 50000]
    rows = [(i, t, lang, 1.0) for i, (lang, t) in enumerate(TEXTS)] + [(100 + i, t, None, 1.0) for i, t in enumerate(asked)] + [(200, "the the", "en", 1.0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n double").selectExpr("*", "1 AS gram", "2 AS salt")
    profiles = {}
    for _, t, lang, _ in rows:
        if lang and t is not None:
            profiles.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {lang: {g: i for i, g in enumerate(ranked(c))} for lang, c in profiles.items()}
    from pyspark.sql import functions as F

    got = [(r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in langid.identify(df, F.lit(True)).collect()]
    assert len(got) == len(rows)
    for _, t, pred, score in got:
        mine = ranked(plain_grams(t))
        if not mine:
            assert (pred, score) == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(mine)) for lang, p in sorted(profiles.items())}
        best = min(far, key=lambda x: (far[x], x))
        assert pred == best and score == pytest.approx(1 - far[best] / langid.PROFILE / len(mine))
    none = langid.identify(df.where("lang is null"), F.lit(True)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(df.limit(0), F.lit(True)).count() == 0


def test_accuracy_on_held_out_documents(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    got = langid.op7_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def payloads():
    rng = np.random.default_rng(8)
    n = flac.BLOCK
    smooth = lambda f: (128 + 100 * f(np.arange(3 * n) / 40)).astype(np.uint8).tobytes()
    ramp = (np.arange(n) % 256).astype(np.uint8).tobytes()
    return [flac.payload(t) for t in (None, "", "a", "x" * n, "x" * (n + 1), "é ü 日本" * 300)] + [rng.integers(0, 256, 2 * n, np.uint8).tobytes(), bytes(n), smooth(np.sin), smooth(lambda x: x / x.max()), ramp, bytes([0, 255] * (n // 2)), bytes([0] * (n - 1) + [255])]


def test_round_trips():
    p = payloads()
    made = flac.encode_payloads(p)
    for a, s, (b, places) in zip(p, made, flac.decode_many(made), strict=True):
        pcm, index = flac.decode(s)
        assert a == b and places == index
        assert (pcm[0] + 128).astype(np.uint8).tobytes() == a and [x for x, _ in index] == list(range(0, len(a), flac.BLOCK))
        x, first = flac.seek(s, len(a) - 1)
        assert (x[0] + 128).astype(np.uint8).tobytes() == a[first:]
    kinds = {s[flac.stream_header(s)[2] + 6] for s in made}
    assert {0, 2} <= kinds and len(kinds) >= 4  # constant, verbatim, predictors


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", 3)
    df = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.identify(df, F.lit(True))
    assert langid.identify(df.where("doc_id < 3"), F.lit(True)).count() == 3


def test_damage_is_found():
    good = flac.encode_payloads([b"some text " * 115 + b"12"])[0]
    at = flac.stream_header(good)[2]
    for place in (at + 1, at + 5, at + 40, len(good) - 1):
        bad = good[:place] + bytes([good[place] ^ 4]) + good[place + 1 :]
        for read in (flac.decode, lambda s: flac.decode_many([s])):
            with pytest.raises(ValueError):
                read(bad)


def test_other_streams():
    """A stereo stream with an LPC subframe, mid/side, wasted bits and an escaped partition, put together bit by bit."""
    bits = []
    put = lambda v, n: bits.extend(v >> (n - 1 - i) & 1 for i in range(n))
    size = 16
    mid, side = np.arange(size) * 2 - 7, np.array([(-1) ** k * 2 * (k % 3) for k in range(size)])
    put(0xFFF8, 16)
    put(6, 4), put(0, 4), put(10, 4), put(1, 3), put(0, 1), put(0, 8), put(size - 1, 8)
    raw = np.packbits(bits).tobytes()
    put(flac.crc8(raw), 8)
    # mid: LPC of order 2 with weights 2, -1; residual 0 in an escaped partition of 1 bit
    put(0, 1), put(32 + 1, 6), put(0, 1)
    for v in mid[:2]:
        put(int(v) & 0xFF, 8)
    put(3, 4), put(0, 5), put(2, 4), put(0xF, 4)
    put(0, 2), put(0, 4), put(15, 4), put(1, 5)
    for _ in range(size - 2):
        put(0, 1)
    # side: one wasted bit, verbatim, 9 - 1 bits
    put(0, 1), put(1, 6), put(1, 1), put(1, 1)
    for v in side:
        put(int(v // 2) & 0xFF, 8)
    frame = np.packbits(bits).tobytes()
    flat = np.frombuffer(frame, np.uint8)
    frame += int(flac.crc16_many(flat, np.array([0]), np.array([len(flat)]))[0]).to_bytes(2)
    left, right = ((mid << 1 | side & 1) + side) >> 1, ((mid << 1 | side & 1) - side) >> 1
    low = 8000 << 44 | 1 << 41 | 7 << 36 | size
    info = size.to_bytes(2) * 2 + bytes(6) + low.to_bytes(8) + hashlib.md5(np.stack([left, right]).T.astype(np.int8).tobytes()).digest()
    stream = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3) + info + frame
    pcm, index = flac.decode(stream)
    assert pcm.tolist() == [left.tolist(), right.tolist()] and index == [(0, 42)]


def test_media_rows(spark):
    texts = ["some text", None, "", "some text", "y" * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "z")], "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS n_bytes")
    got = {r["doc_id"]: r for r in flac.features(flac.pcm_blocks(flac.media(df))).collect()}
    for i, t in enumerate(texts):
        p = flac.payload(t)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(t or ""), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    assert got[0]["media_sha256"] == got[3]["media_sha256"] and got[0]["feature"] == got[3]["feature"] and None in got
    assert flac.features(flac.pcm_blocks(flac.media(df.limit(0)))).count() == 0


def test_pcm_blocks(spark):
    """Blocks, stored and read again, hold all samples; decoding can begin at each block's offset."""
    texts = {1: "abc " * 20_000, 2: None, 3: "q" * 576 * 32}
    stored = flac.common.saved(flac.media(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "media")
    streams = {r["doc_id"]: bytes(r["media"]) for r in stored.collect()}
    rows = flac.common.saved(flac.pcm_blocks(stored, frames=16), "pcm").orderBy("doc_id", "first_sample").collect()
    for d, t in texts.items():
        own, payload = [r for r in rows if r["doc_id"] == d], flac.payload(t)
        assert b"".join(bytes(r["samples"]) for r in own) == payload and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
        info = flac.stream_header(streams[d])[0]
        for r in own:
            x, number, _ = flac.decode_frame(streams[d], r["byte_offset"], info)
            assert number * flac.BLOCK == r["first_sample"] and (x[0] + 128).astype(np.uint8).tobytes() == bytes(r["samples"])[: flac.BLOCK]
            assert len(r["samples"]) == r["n_frames"] * flac.BLOCK
    x = {d: np.frombuffer(flac.payload(t), np.uint8).astype(int) - 128 for d, t in texts.items()}
    want = {d: f"frames={len(v) // 576};level={np.abs(v).sum() // len(v)};crossings={int((np.signbit(v[1:]) != np.signbit(v[:-1])).sum())}" for d, v in x.items()}
    assert {r["doc_id"]: r["feature"] for r in flac.features(flac.pcm_blocks(stored, frames=3)).collect()} == want


def test_query_reads_what_it_stored(spark, tmp_path):
    from pathlib import Path

    texts = ["some text", None, "", "é ü 日本" * 300, "y" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(flac.common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("media-*"))
    df = flac.op10_flac_media(spark, str(tmp_path))
    (folder,) = set(shared.glob("media-*")) - before
    stored = {r["doc_id"]: bytes(r["media"]) for r in spark.read.parquet(str(folder)).collect()}
    assert [flac.decode_many([stored[i]])[0][0] for i in range(len(texts))] == [flac.payload(t) for t in texts]
    assert {r["doc_id"]: r["media_sha256"] for r in df.collect()} == {i: hashlib.sha256(s).hexdigest() for i, s in stored.items()}
    assert all(str(folder) in f for f in df.inputFiles())
