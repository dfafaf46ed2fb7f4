"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source). A node's children share its budget by their weights; a child
whose subtree holds too little gives its shortage to its siblings, in proportion to their weights, and only what all of a
node's descendants cannot hold goes to the node's own siblings: capacities are summed upwards first, and each family is
then filled like connected vessels. All sums are integers, so the whole budget is used, to the token, whenever the corpus
can hold it. What a leaf holds is its tokens times `max_epochs`.

A leaf's documents, in seeded order, then reordered by a new seed for each further epoch, form one stream; the leaf's
budget is a prefix of it. So each document is taken in full `epochs` times, and perhaps once more, in the epoch where the
prefix ends, in full or cut after `prefix_tokens` tokens.

Only DataFrame operations are used. A prefix sum over a leaf never sorts the leaf: it is cut at buckets of the order (two
hex digits of a hash at a time, twice), and only one bucket in 65,536 of each leaf is sorted. A leaf may hold any share of
the rows.

Null levels count as ''. A null or empty text has no tokens and is taken with the epochs around it. Rows with the same id,
text and leaf are one document. Weights may name any path; others have `default_weight`; weight 0 shuts a subtree. An
empty table, or a budget of 0, takes nothing. Extra columns are ignored, and kept by `apply`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LEVELS = ("domain", "lang", "source")
DOMAINS = ("web", "news", "books", "code")
WEIGHTS = {("web",): 50, ("news",): 20, ("books",): 20, ("code",): 10} | {(d, x): w for d in DOMAINS for x, w in (("en", 50), ("de", 20), ("fr", 20), ("es", 10))}
#: Of the query: the budget as a percentage of the corpus, passes over a document at most, seed.
PERCENT, MAX_EPOCHS, SEED = 60, 2, 7
#: The number of tokens in a text.
TOKENS = f"coalesce(regexp_count(text, '{common.WORD}'), 0)".replace("\\", "\\\\")
KEY = "\x1f"


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int], default: int) -> Column:
    flat = [F.lit(x) for path, w in weights.items() if len(path) == len(levels) for x in (KEY.join(path), w)]
    if not flat:
        return F.lit(default).cast("long")
    return F.coalesce(F.try_element_at(F.create_map(*flat), F.concat_ws(KEY, *levels)), F.lit(default)).cast("long")


def budgets(leaves: DataFrame, budget: int | Column, levels: Sequence[str], weights: Mapping[tuple[str, ...], int], max_epochs: int = 1, default_weight: int = 1) -> DataFrame:
    """Adds `quota`, each leaf's budget, to a table of leaves (levels, tokens); as many rows as leaves."""
    open_ = F.lit(True)
    for k in range(1, len(levels) + 1):
        leaves = leaves.withColumn(f"w{k}", _weight(levels[:k], weights, default_weight))
        open_ = open_ & (F.col(f"w{k}") > 0)
    leaves = leaves.withColumn("cap", F.when(open_, F.col("tokens") * max_epochs).otherwise(F.lit(0)).cast("long"))
    ask = F.lit(budget) if isinstance(budget, int) else budget
    parent = leaves.agg(F.sum("cap").alias("all"), F.sum("tokens").alias("tokens")).select(F.least(F.coalesce("all", F.lit(0)), F.greatest(F.coalesce(ask, F.lit(0)), F.lit(0))).cast("long").alias("budget"))
    for k in range(1, len(levels) + 1):
        up, own = list(levels[: k - 1]), list(levels[:k])
        nodes = leaves.groupBy(*own).agg(F.sum("cap").alias("cap"), F.first(f"w{k}").alias("w"))
        nodes = nodes.join(parent, up) if up else nodes.crossJoin(parent)  # the root is one row
        family = Window.partitionBy(*up)
        filling = family.orderBy((F.col("cap") / F.nullif("w", F.lit(0))).asc_nulls_last(), *own)
        dec = "cast({} as decimal(19,0))".format
        nodes = (
            nodes.withColumn("before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("rest_w", F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("full", F.expr(f"{dec('cap')} * {dec('rest_w')} <= {dec('w')} * {dec('budget - before')}"))
            .withColumn("left", F.col("budget") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(family))
            .withColumn("open_w", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0)).over(family))
            .withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr(f"{dec('w')} * {dec('left')} div {dec('nullif(open_w, 0)')}")))
            .withColumn("odd", F.col("left") - F.sum(F.when(~F.col("full"), F.col("share")).otherwise(0)).over(family))
            .withColumn("nth", F.sum(F.when(~F.col("full"), F.lit(1)).otherwise(0)).over(family.orderBy(*own)))
        )
        parent = nodes.select(*own, (F.col("share") + F.when(~F.col("full") & (F.col("nth") <= F.col("odd")), 1).otherwise(0)).cast("long").alias("budget"))
    return leaves.join(parent.withColumnRenamed("budget", "quota"), list(levels)).select(*levels, "tokens", "quota")


def _cut(rows: DataFrame, keys: list[str], digit: Column) -> DataFrame:
    """Of rows (keys, h, n, rest) in order of h: the bucket in which the first `rest` tokens end, and the tokens left for it."""
    sums = rows.groupBy(*keys, "rest", digit.alias("b")).agg(F.sum("n").alias("n"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys).orderBy("b")))
    at = (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest"))
    return sums.where(at).select(*keys, F.col("b").alias("cut"), (F.col("rest") - F.col("upto") + F.col("n")).alias("inner"))


def decide(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], int], percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED, default_weight: int = 1
) -> DataFrame:
    """Per document: doc_id, text_hash, the levels, n_tokens, epochs, prefix_tokens, taken (cut=true: the prefix ends in it)."""
    names = [f"level_{i}" for i in range(len(levels))]
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), *(F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values(), strict=True)), F.expr(TOKENS).cast("long").alias("n"))
    rows = common.saved(rows.dropDuplicates(["doc_id", "text_hash", *names]), "mixing")
    leaves = rows.groupBy(*names).agg(F.sum("n").alias("tokens"), F.count("*").alias("members"))
    plan = budgets(leaves, F.expr(f"cast(tokens as decimal(38,0)) * {int(percent)} div 100"), names, weights, max_epochs, default_weight)
    plan = plan.select(*names, F.expr("coalesce(quota div nullif(tokens, 0), 0)").alias("epochs"), F.expr("coalesce(quota % nullif(tokens, 0), 0)").alias("rest"))
    leaves, total = leaves.select(*names, "members"), rows.count()
    rows = common.join_hot(rows, plan.join(leaves, names), names, "members", total).drop("members").withColumn("h", F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), "epochs", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "UTF-8")))
    rows = common.saved(rows, "mixing")
    b1, b2 = F.substring("h", 1, 2), F.substring("h", 3, 2)
    live = rows.where("rest > 0")
    first = _cut(live, names, b1).withColumnsRenamed({"cut": "cut1", "inner": "rest1"})
    # the digit is part of the key, so that a hot leaf is dealt out
    edge = live.withColumn("cut1", b1).join(first, [*names, "cut1"]).drop("rest", "cut1").withColumnRenamed("rest1", "rest")
    second = _cut(edge, names, b2).withColumnsRenamed({"cut": "cut2", "inner": "rest2"})
    last = edge.withColumn("cut2", b2).join(second, [*names, "cut2"])
    order = Window.partitionBy(*names).orderBy("h", "doc_id", "text_hash")
    last = last.withColumn("room", F.col("rest2") - F.sum("n").over(order) + F.col("n"))
    last = last.select("doc_id", "text_hash", *names, F.greatest(F.lit(0), F.least("n", "room")).alias("inner_tokens"))
    cuts = first.select(*names, "cut1").join(second.select(*names, "cut2"), names, "left").join(leaves, names)
    rows = common.join_hot(rows, cuts, names, "members", total).join(last, ["doc_id", "text_hash", *names], "left")
    prefix = F.when(F.concat(b1, b2) < F.concat("cut1", "cut2"), F.col("n")).otherwise(F.coalesce("inner_tokens", F.lit(0))).cast("long")
    out = rows.withColumn("prefix_tokens", prefix)
    return out.select("doc_id", "text_hash", *(F.col(n).alias(a) for n, a in zip(names, levels, strict=True)), F.col("n").alias("n_tokens"), F.col("epochs").cast("long").alias("epochs"), "prefix_tokens", (F.col("epochs") * F.col("n") + F.col("prefix_tokens")).cast("long").alias("taken"))


def apply(docs: DataFrame, decisions: DataFrame, levels: Mapping[str, Column]) -> DataFrame:
    """The documents taken, as often as they are taken, texts cut where the prefix ends; columns as in docs."""
    names = [f"__level_{i}" for i in range(len(levels))]
    chosen = decisions.where("taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), *(F.col(a).alias(n) for a, n in zip(levels, names, strict=True)), F.col("n_tokens").alias("__n"), F.col("epochs").alias("__epochs"), F.col("prefix_tokens").alias("__prefix")
    )
    on = (F.col("__id").eqNullSafe(F.col("doc_id"))) & (F.col("__hash") == F.xxhash64("text"))
    for n, c in zip(names, levels.values(), strict=True):
        on = on & (F.col(n) == F.coalesce(c.cast("string"), F.lit("")))
    rows = docs.join(chosen, on)
    # a prefix keeps the white space before each of its words
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.when(F.col("__prefix") == F.col("__n"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("__prefix").cast("int")), ""))
    copies = F.concat(F.array_repeat(F.col("text"), F.col("__epochs").cast("int")), F.when(F.col("__prefix") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("__text", F.explode(copies)).select(*(F.col("__text").alias("text") if c == "text" else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def document_levels() -> dict[str, Column]:
    """The tree of `documents`: the domain follows from the number in the source's name."""
    number = F.coalesce(F.regexp_extract("source", "([0-9]{1,6})$", 1).try_cast("int"), F.lit(0)) % len(DOMAINS)
    return {"domain": F.element_at(F.array(*map(F.lit, DOMAINS)), number + 1), "lang": F.col("lang"), "source": F.col("source")}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is taken."""
    return decide(common.table(spark, sf_dir, "documents"), document_levels(), WEIGHTS).drop("text_hash")


def _oracle() -> str:
    word = common.WORD
    top = "CASE domain " + " ".join(f"WHEN '{p[0]}' THEN {w}" for p, w in WEIGHTS.items() if len(p) == 1) + " ELSE 1 END"
    mid = "CASE domain || '/' || lang " + " ".join(f"WHEN '{'/'.join(p)}' THEN {w}" for p, w in WEIGHTS.items() if len(p) == 2) + " ELSE 1 END"
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    sql = f"""WITH d AS (SELECT DISTINCT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  list_extract([{names}], (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,6}})$', 1), '') AS INT), 0) % 4) + 1) AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '{word}')) AS BIGINT) AS n FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) AS HUGEINT) * {MAX_EPOCHS} AS cap FROM d GROUP BY ALL),
p0 AS (SELECT least(sum(cap), sum(tokens) * {PERCENT} // 100) AS budget FROM leaves)"""
    for k, w in ((1, top), (2, mid), (3, "1")):
        own, up = ", ".join(LEVELS[:k]), ", ".join(LEVELS[: k - 1])
        by = f"PARTITION BY {up} " if up else ""
        sql += f""",
a{k} AS (SELECT {own}, sum(cap) AS cap, {w} AS w FROM leaves GROUP BY {own}),
b{k} AS (SELECT *, coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w
  FROM a{k} {'JOIN p' + str(k - 1) + ' USING (' + up + ')' if up else 'CROSS JOIN p0'} WINDOW f AS ({by}ORDER BY CAST(cap AS DOUBLE) / w, {own})),
c{k} AS (SELECT *, cap * rest_w <= w * (budget - before) AS full_ FROM b{k}),
e{k} AS (SELECT *, budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER f AS left_, sum(CASE WHEN full_ THEN 0 ELSE w END) OVER f AS open_w FROM c{k} WINDOW f AS ({by})),
f{k} AS (SELECT *, CASE WHEN full_ THEN cap ELSE w * left_ // nullif(open_w, 0) END AS share FROM e{k}),
g{k} AS (SELECT *, left_ - sum(CASE WHEN full_ THEN 0 ELSE share END) OVER ({by}) AS odd, sum(CASE WHEN full_ THEN 0 ELSE 1 END) OVER ({by}ORDER BY {own}) AS nth FROM f{k}),
p{k} AS (SELECT {own}, share + CASE WHEN NOT full_ AND nth <= odd THEN 1 ELSE 0 END AS budget FROM g{k})"""
    return sql + f""",
q AS (SELECT domain, lang, source, coalesce(budget // nullif(tokens, 0), 0) AS epochs, coalesce(budget % nullif(tokens, 0), 0) AS rest FROM leaves JOIN p3 USING (domain, lang, source)),
r AS (SELECT d.*, epochs, rest, md5('{SEED}:' || CAST(epochs AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM d JOIN q USING (domain, lang, source)),
s AS (SELECT *, greatest(0, least(n, rest - sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, text ROWS UNBOUNDED PRECEDING) + n)) AS prefix FROM r)
SELECT doc_id, domain, lang, source, n AS n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(prefix AS BIGINT) AS prefix_tokens, CAST(epochs * n + prefix AS BIGINT) AS taken FROM s"""


ORACLE = _oracle()
