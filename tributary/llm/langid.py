"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (lengths 1 to `MAX_N`, words padded by a blank), counted
over all training documents. A document's own most frequent n-grams are compared to each profile by the out-of-place
distance: the sum of rank differences, `PROFILE` for an n-gram that the profile lacks. The nearest profile wins (ties: the
first in order); score = 1 - distance / largest possible distance.

Counting runs over code points with array operations and one small table per Arrow batch; Spark adds the tables. Ranks are
by count, then n-gram. What reaches the driver is a fixed number of rows per language (`SALTS` x `PROFILE`), whatever the
input, and more than `LANGS` languages are an error. A very long text is counted whole, in memory in proportion to it. Null text, and text without a letter: `und`, score 0. Null lang is never learned; without any profile all is `und`.
Every row is answered, repeated rows alike; extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_N, PROFILE, SALTS, LANGS = 3, 400, 8, 1000
UNKNOWN = "und"
BITS = 21
CHUNK_CHARS = 1_500_000


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0; kept by the worker."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (0xD800 <= c < 0xE000) or not (s := chr(c)).isalpha():
            continue
        low = s.lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(chars: np.ndarray, doc: np.ndarray, max_n: int = MAX_N) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams and the document of each; chars: letters or 0, doc: the document of each place, ascending.

    A word is a run of letters, with one blank on either side. An n-gram of n > 1 holds at least one letter, n = 1 only a letter.
    """
    blank = chars == 0
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))  # a run of others is one blank
    # a blank is symbol 1, so that n-grams of different lengths have different keys
    c, d = np.maximum(chars[keep], 1).astype(np.uint64), doc[keep]
    keys, docs = [c[c > 1]], [d[c > 1]]
    key = c
    for n in range(2, max_n + 1):
        if len(c) < n:
            break
        key = (key[:-1] << np.uint64(BITS)) | c[n - 1 :]
        # two blanks only meet across a letter, and none lies inside of an n-gram
        ok = d[: len(key)] == d[n - 1 :]
        for inner in range(1, n - 1):
            ok &= c[inner : inner + len(key)] > 1
        keys.append(key[ok])
        docs.append(d[: len(key)][ok])
    return np.concatenate(keys), np.concatenate(docs)


def _texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of texts end to end, a blank before and after each, and the text of each place."""
    joined = " " + "  ".join(texts) + " "
    chars = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return chars, np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])


def _pieces(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, total = 0, 0
    for i, t in enumerate(texts):
        if i > a and total + len(t) > CHUNK_CHARS:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


def gram_counts(rows: DataFrame) -> DataFrame:
    """Counts of all n-grams: lang, gram (its key as a long), n; rows: lang, text without nulls."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in _pieces(own):
                    key, _ = grams(*_texts(own[a:b]))
                    key, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(rows: DataFrame, size: int = PROFILE) -> tuple[list[str], np.ndarray]:
    """The languages in order, and for each the keys of its most frequent n-grams by rank (-1: none)."""
    counts = gram_counts(rows).withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    order = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= size).select("lang", "gram", "n").limit(LANGS * SALTS * size + 1).collect()
    if len({r["lang"] for r in top}) > LANGS:
        raise ValueError(f"more than {LANGS} languages: is `lang` a language?")
    best: dict[str, list[tuple[int, int]]] = {}
    for r in top:
        best.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    langs = sorted(best)
    out = np.full((len(langs), size), -1, np.int64)
    for i, lang in enumerate(langs):
        keys = [g for _, g in sorted(best[lang])[:size]]
        out[i, : len(keys)] = keys
    return langs, out


class Judge:
    """Out-of-place distances of documents to all profiles."""

    def __init__(self, langs: list[str], ranked: np.ndarray):
        self.langs, self.size = langs, ranked.shape[1] if ranked.size else 0
        keys = np.unique(ranked[ranked >= 0]).astype(np.uint64)
        self.keys = keys
        self.rank = np.full((len(langs), len(keys) + 1), -1, np.int64)  # the last column: an n-gram of no profile
        for i, own in enumerate(ranked):
            own = own[own >= 0].astype(np.uint64)
            self.rank[i, np.searchsorted(keys, own)] = np.arange(len(own))

    def place(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for a, b in _pieces([t or "" for t in texts]):
            x, y = self._judge([t or "" for t in texts[a:b]])
            langs += x
            scores += y
        return langs, scores

    def _judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        key, doc = grams(*_texts(texts))
        dense = np.unique(key)
        # one sort by (document, n-gram): both fit in 63 bits once n-grams are numbered
        pair = doc.astype(np.int64) * (len(dense) + 1) + np.searchsorted(dense, key)
        pair.sort()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(pair)))
        d, g = pair[first] // (len(dense) + 1), pair[first] % (len(dense) + 1)
        # by document, then count downwards, then n-gram
        top = int(count.max()) + 1 if len(count) else 1
        order = np.lexsort((g, d * top + (top - 1 - count)))
        d, g = d[order], g[order]
        begin = np.searchsorted(d, np.arange(len(texts) + 1))
        rank = np.arange(len(d)) - begin[d]
        keep = rank < self.size
        d, rank, where = d[keep], rank[keep], self.place(dense)[g[keep]] if len(dense) else np.zeros(0, np.int64)
        used = np.bincount(d, minlength=len(texts)) if len(d) else np.zeros(len(texts), np.int64)
        far = np.empty((len(self.langs), len(texts)), np.int64)
        for i in range(len(self.langs)):
            own = self.rank[i, where]
            far[i] = np.bincount(d, np.where(own < 0, self.size, np.abs(own - rank)), len(texts)).astype(np.int64)
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.langs:
            best = far.argmin(axis=0)
            for j in np.flatnonzero(used > 0).tolist():
                out[j] = self.langs[best[j]]
                scores[j] = 1.0 - float(far[best[j], j]) / float(self.size * used[j])
        return out, scores


def identify(docs: DataFrame, train: Column, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs (with text) plus the predicted language and its score; learns from the rows where `train` holds and lang is known."""
    learn = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs, ranked = profiles(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(langs, ranked)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            pred, score = judge.judge(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, pred_col, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{pred_col}` string, `{score_col}` double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = common.crc32_of_id() % 4
    langs = identify(docs, remainder != 2)
    return langs.select("doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score")
