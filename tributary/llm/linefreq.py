"""Quality rules: plain ones on each text, and lines that too many documents of a host share.

A line is normalised (lower case, a run of digits is 0, white space is one space) and named by 128 bits of its hash; a document is a
different text of a host, so copies count once. A line is too frequent if more than `LEAST_DOCUMENTS` documents of its host hold it, and
more than one in `SHARE` of them. Such lines are removed; a document is depleted, and rejected, if fewer than `LEFT` percent of its words, or fewer than
`LEAST_WORDS`, remain.

Texts pass through Python once, and give a row of counts and of the hashes of their lines. Counting is one grouping of hashes with
partial sums; frequent lines join the documents' lines, hot ones by broadcast (`common.join_hot`). Texts are shuffled only if the
cleaned texts are asked for (`clean`), which the verdict doesn't need.

A null text has no words and fails, a null host is a host of its own. Repeated rows are rows, and count as one document. Texts are read
whole at any length. Extra columns pass through whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, LEAST_WORDS, REPEATED = 5, 10, 20
#: A frequent line's documents, at least; one in SHARE of the host's; percent of the words that must remain.
LEAST_DOCUMENTS, SHARE, LEFT = 10, 100, 30
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\v\f\r"
DIGITS = re.compile("[0-9]+")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside of windows that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(number) == len(words):
        return 0
    one = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    ids, many = one[:n], len(number)
    for k in range(1, window):
        if many * len(number) >= 1 << 62:  # number what there is anew
            ids = np.unique(ids, return_inverse=True)[1]
            many = int(ids.max()) + 1
        ids, many = ids * len(number) + one[k : k + n], many * len(number)
    _, at, count = np.unique(ids, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[at] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def plain(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()  # splits at the same ASCII white space
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(SPACE):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), again, repeated_words(words)


def lines(text: str) -> list[tuple[bytes, int]]:
    """Each line's normal form and words, empty ones included."""
    out = []
    for line in DIGITS.sub("0", text.lower()).encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        out.append((b" ".join(words), len(words)))
    return out


def _key(line: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(line)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, t1 long, t2 long, lines array<struct<a: long, b: long, n: int, words: int>>"


def facts_of(rows: DataFrame) -> DataFrame:
    """rows (rid, host, doc, text; text not null) without text, plus FACTS: counts, a name of the text, and of each of its lines that
    has a word, with occurrences and words in all of them."""
    entry = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int32()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                counts, names, listed = [], [], []
                for text in batch.column(batch.num_columns - 1):
                    text = text.as_py()
                    counts.append(plain(text))
                    names.append(_key(text.encode("utf-8", "surrogatepass")))
                    own: dict[bytes, list[int]] = {}
                    for line, words in lines(text):
                        if words:
                            held = own.setdefault(line, [0, 0])
                            held[0] += 1
                            held[1] += words
                    listed.append([(*_key(line), n, words) for line, (n, words) in own.items()])
                cells = [pa.array(c, pa.int64()) for c in (*zip(*counts, strict=True), *zip(*names, strict=True))]
                keys = ("a", "b", "n", "words")
                cells.append(pa.array([[dict(zip(keys, x, strict=True)) for x in own] for own in listed], pa.list_(entry)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *cells], names=[*batch.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "t1", "t2", "lines"])

    kept = [c for c in rows.columns if c != "text"]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*kept).schema), FACTS])
    return rows.select(*kept, "text").mapInArrow(run, fields)


def frequent(facts: DataFrame, least: int = LEAST_DOCUMENTS, share: int = SHARE) -> DataFrame:
    """host, a, b: lines that more than `least` different texts of the host, and more than one in `share` of them, hold; and rows, how many rows hold them."""
    # copies of a text have the same lines, so one of them tells all
    texts = facts.groupBy("host", "t1", "t2").agg(F.first("lines").alias("lines"), F.count("*").alias("copies"))
    held = texts.select("host", "copies", F.explode("lines").alias("l")).groupBy("host", "l.a", "l.b").agg(F.count("*").alias("documents"), F.sum("copies").alias("rows"))
    held = common.saved(held.where(F.col("documents") > least), "lines")
    hosts = facts.select("host", "t1", "t2").distinct().groupBy("host").agg(F.count("*").alias("all"))
    hosts = held.groupBy("host").agg(F.count("*").alias("members")).join(hosts, "host")
    return common.join_hot(held, hosts, ["host"], "members", held.count()).where(F.col("documents") * share > F.col("all")).select("host", "a", "b", "rows")


def judged(rows: DataFrame, least: int = LEAST_DOCUMENTS, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """Two tables of rows (rid, host, text, ..): a row for each rid with the counts, n_removed_lines, n_removed_words, base_failed and kept
    instead of the text; and its too frequent lines (rid, a, b, n, words), a row for each different one."""
    facts = common.saved(facts_of(rows), "facts")
    bad = common.saved(frequent(facts, least, share), "frequent")
    total = facts.agg(F.sum(F.size("lines"))).first()[0] or 0
    own = facts.select("rid", "host", F.explode("lines").alias("l")).select("rid", "host", "l.*")
    gone = common.join_hot(own, bad, ["host", "a", "b"], "rows", total).where("rows is not null").select("rid", "a", "b", "n", "words")
    removed = gone.groupBy("rid").agg(F.sum("n").alias("__lines"), F.sum("words").alias("__words"))
    out = facts.drop("lines", "t1", "t2").join(removed, "rid", "left")
    none = F.lit(0).cast("long")
    out = out.withColumn("n_removed_lines", F.coalesce("__lines", none)).withColumn("n_removed_words", F.coalesce("__words", none)).drop("__lines", "__words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (left < LEAST_WORDS) | (100 * left < LEFT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~(failed | depleted)), gone


def clean(docs: DataFrame, host: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, share: int = SHARE) -> DataFrame:
    """The docs that are kept, their text without the lines that are too frequent; all columns as they were named."""
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = common.saved(docs.select(F.monotonically_increasing_id().alias("rid"), _host(host), _text(text), doc), "rows")
    facts, gone = judged(rows.select("rid", "host", "text"), least, share)
    own = gone.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("gone"))  # lines of one text
    kept = facts.where("kept").select("rid").join(own, "rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for whole, listed in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                bad = {(x["a"], x["b"]) for x in listed or ()}
                parts = zip(whole.split("\n"), lines(whole), strict=True)
                out.append("\n".join(line for line, (form, _) in parts if _key(form) not in bad) if bad else whole)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.string())], names=["rid", "cleaned"])

    texts = rows.select("rid", "text").join(kept, "rid").mapInArrow(run, "rid long, cleaned string")
    return rows.select("rid", "doc").join(texts, "rid").select(*(F.col("cleaned").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))


def _host(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).alias("host")


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit("")).alias("text")


def op12_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; their hosts are their sources."""
    rows = common.table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("rid"), "doc_id", _host("source"), _text("text"))
    return judged(rows)[0].select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")


_WORDS = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{_WORDS}') AS ws FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1), (SELECT unnest(range({WINDOW})) AS k) GROUP BY rid),
l AS (SELECT rid, host, t, p, line FROM (SELECT rid, host, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS p, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORDS}')),
u AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY rid),
x AS (SELECT rid, host, t, len(ws) AS words, array_to_string(ws, ' ') AS form FROM (SELECT rid, host, t, regexp_extract_all(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '{_WORDS}') AS ws FROM l)),
f AS (SELECT host, form FROM (SELECT host, form, count(DISTINCT t) AS n FROM x GROUP BY host, form) JOIN (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host) USING (host) WHERE n > {LEAST_DOCUMENTS} AND n * {SHARE} > docs),
m AS (SELECT rid, count(*) AS n, CAST(sum(words) AS BIGINT) AS words FROM x JOIN f USING (host, form) GROUP BY rid),
o AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(m.n, 0) AS n_removed_lines, coalesce(m.words, 0) AS n_removed_words
FROM d JOIN w USING (rid) LEFT JOIN u USING (rid) LEFT JOIN r USING (rid) LEFT JOIN m USING (rid)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM o)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, n_removed_lines, n_removed_words, base_failed, NOT (base_failed OR n_words - n_removed_words < {LEAST_WORDS} OR 100 * (n_words - n_removed_words) < {LEFT} * n_words) AS kept FROM v"""
