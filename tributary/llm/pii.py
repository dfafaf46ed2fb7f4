"""Personal data: patterns, and information-theoretic sanitisation of what gives them away.

Base spans are emails, IP addresses, card numbers (Luhn) and phone numbers. Each distinct value is a protected entity. From
all documents, co-occurrence tells how strongly a term reveals an entity c: with p(.) as shares of documents,
PMI(c; t) = log(p(c, t) / (p(c) p(t))) bits of the IC(c) = -log p(c) bits that c holds. A term that shares at least
`MIN_SUPPORT` different texts with c discloses it if PMI >= ALPHA * IC; in c's documents its occurrences become spans of kind
`term`. From BETA * IC on they are removed, below that generalised to a placeholder.

Only DataFrame operations are used. Patterns run without backtracking or recursion on long texts: greedy parts that cannot
help by giving back are possessive, and an email is only tried where its run of characters begins. Positions are code points,
summed up from the gaps and matches of a split. Equal texts are looked at once and counted as often as they occur. Counts are
pre-aggregated before each shuffle; a hot entity's documents are never gathered, nor the copies of a text.

Null text counts as empty. Texts are told apart by a 64-bit hash; repeated rows get the same answer, and each counts as a
document. Time and memory are in proportion to a text's length and spans, but for a text's pairs of entities that recur and terms,
which are all counted. Extra columns are ignored, whatever their names; `sanitise` keeps them. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",  # shorter ones are dropped anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this cannot match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{3,}"
MIN_SUPPORT, ALPHA, BETA = 3, 0.8, 0.95
SHOWN = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
SPAN = "struct<kind:string,s:int,e:int,value:string>"
#: Items of a list that are handled at once, and characters of a text.
SLICE, PART = 64, 1024


def _scan(items: Column, made: str, step) -> Column:
    """Outputs of step(at, item) -> (next at, output or null) over an array in order, with `at` from 0 on; `made` is an output's type.

    Lists grow by copies, so they are made in slices of `SLICE` items, and the slices joined: time stays in proportion.
    """
    none = F.array().cast(f"array<{made}>")

    def inner(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(out.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], out)).alias("out"))

    def outer(whole: Column, acc: Column, i: Column) -> Column:
        own = F.slice(whole, i * SLICE + 1, F.lit(SLICE))
        return F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(acc["out"], x["out"]).alias("out")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{made}>>").alias("out"))

    def everything(whole: Column) -> Column:
        slices = F.when(F.size(whole) > 0, F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / SLICE).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(slices, zero, lambda acc, i: outer(whole, acc, i), lambda acc: F.flatten(acc["out"]))

    return _once(items, everything)


def _once(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it, in lambdas too."""
    return F.transform(F.array(value), f)[0]


def located(text: Column, pattern: str | Column, kind: str | Column) -> Column:
    """Spans (kind, s, e, value) of all matches, in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + F.length(x["gap"])
        e = s + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), s.alias("s"), e.alias("e"), x["hit"].alias("value"))
        return F.coalesce(e, at), F.when(x["hit"].isNotNull(), span)

    return _scan(pairs, SPAN, step)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + d

    n = F.length(digits)
    return n.between(16, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def _valid(kind: str):
    """The test that a match of this kind must pass."""
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    part = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255
    return {
        "email": lambda x: F.lit(True),
        "ip": lambda x: F.forall(F.split(x["value"], r"\."), part),
        "card": lambda x: _luhn(x["value"]),
        "phone": lambda x: F.length(digits(x)).between(8, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """All base spans of a non-null text, by kind as listed, then start."""
    found = []
    for kind in KINDS:
        spans = F.filter(located(text, PATTERNS[kind], kind), _valid(kind))
        maybe = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else F.regexp_like(text, F.lit(PATTERNS[kind]))
        found.append(F.when(maybe, spans).otherwise(F.array().cast(f"array<{SPAN}>")))
    return F.concat(*found)


def entity(x: Column) -> Column:
    """A span's value as its entity: digits for numbers, lower case for others."""
    value = F.when(x["kind"].isin("card", "phone"), F.regexp_replace(x["value"], "[^0-9]", "")).otherwise(F.lower(x["value"]))
    return F.concat(x["kind"], F.lit(":"), value)


def terms(text: Column) -> Column:
    """A text's distinct terms in lower case, without those of emails."""
    plain = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(plain), F.lit(TERM), F.lit(0)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (spans) and, where there are any, text; written to the shared folder."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return common.saved(rows.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "pii")


def texts_of(found: DataFrame) -> DataFrame:
    """The different texts that hold base spans: text_hash, m (how many rows), text, base; copies are merged before they are shuffled."""
    held = found.where(F.size("base") > 0).groupBy("text_hash").agg(F.count("*").alias("m"), F.first("text").alias("text"), F.first("base").alias("base"))
    return common.saved(held, "pii")


def disclosing(docs: DataFrame, texts: DataFrame, alpha: float = ALPHA, min_support: int = MIN_SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Terms that disclose entities (entity, term, joint documents, strength = PMI / IC), and the texts' entities and terms.

    An entity in fewer than `min_support` texts has no such terms, so only the others are paired with their texts' terms.
    """
    own = texts.select("text_hash", "m", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity"))
    share = own.groupBy("entity").agg(F.sum("m").alias("df_entity"), F.count("*").alias("texts")).where(F.col("texts") >= min_support)
    live = common.join_hot(own, share, ["entity"], "texts", own.count()).where("df_entity is not null").groupBy("text_hash").agg(F.collect_list("entity").alias("entities"))  # of one text
    live = common.saved(texts.join(live, "text_hash").select("text_hash", "m", "entities", terms(F.col("text")).alias("terms")), "pii")
    words = live.select("text_hash", "m", "terms", F.explode("entities").alias("entity")).select("text_hash", "m", "entity", F.explode("terms").alias("term"))
    joint = words.groupBy("entity", "term").agg(F.sum("m").alias("joint"), F.count("*").alias("support"))
    joint = common.saved(joint.where(F.col("support") >= min_support), "pii")
    pairs = joint.count()
    by = lambda key, facts: joint.groupBy(key).agg(F.count("*").alias("pairs")).join(facts, key)
    joint = common.join_hot(joint, by("entity", share.drop("texts")), ["entity"], "pairs", pairs).where("df_entity is not null").drop("pairs")
    everywhere = docs.select(F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df_term"))
    n = float(docs.count())
    strength = 1 + F.log(F.col("joint") / F.col("df_term")) / F.log(F.lit(n) / F.col("df_entity"))
    rated = common.join_hot(joint.where(F.col("df_entity") < n), by("term", everywhere), ["term"], "pairs", pairs).where("df_term is not null").select("entity", "term", "support", strength.alias("strength"))
    return common.saved(rated.where(F.col("strength") >= alpha), "pii"), words


def all_spans(docs: DataFrame, texts: DataFrame, alpha: float = ALPHA, beta: float = BETA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Per text with terms to hide: text_hash, m, term_spans (kind `term`; value: '' to remove, else the placeholder)."""
    risky, words = disclosing(docs, texts, alpha, min_support)
    every = risky.agg(F.coalesce(F.sum("support"), F.lit(0))).first()[0]
    per_text = common.join_hot(words, risky, ["entity", "term"], "support", every).where("strength is not null").groupBy("text_hash", "term").agg(F.max("strength").alias("strength")).groupBy("text_hash")
    per_text = per_text.agg(F.sort_array(F.collect_list("term")).alias("hide"), F.collect_set(F.when(F.col("strength") >= beta, F.col("term"))).alias("remove"))
    rows = texts.join(per_text, "text_hash")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("hide", "|"), F.lit(r")(?!\p{L})"))
    spans = F.filter(located(F.col("text"), pattern, "term"), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    spans = F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.when(F.array_contains("remove", F.lower(x["value"])), F.lit("")).otherwise(F.lit(SHOWN["term"])).alias("value")))
    return common.saved(rows.select("text_hash", "m", spans.alias("term_spans")), "pii")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _between(parts: Column, a: Column, b: Column) -> Column:
    """Characters a to b of a text that is cut into parts of PART characters; looks at no other part."""
    first, last = F.floor(a / PART).cast("int"), F.floor((b - 1) / PART).cast("int")
    whole = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(a >= b, F.lit("")).otherwise(F.substring(whole, a - first * PART + 1, b - a))


def sanitise(docs: DataFrame, alpha: float = ALPHA, beta: float = BETA, min_support: int = MIN_SUPPORT) -> DataFrame:
    """docs with all spans of their texts replaced or removed; other columns as they are, n_chars recounted."""
    texts = texts_of(scan(docs))
    hide = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.element_at(F.create_map(*(F.lit(y) for kv in SHOWN.items() for y in kv)), x["kind"]).alias("value")))
    both = F.concat(hide, F.coalesce("term_spans", F.array().cast(f"array<{SPAN}>")))
    spans = texts.select("text_hash", "m", "base").join(all_spans(docs, texts, alpha, beta, min_support).drop("m"), "text_hash", "left")
    spans = spans.select(F.col("text_hash").alias("__hash"), F.col("m").alias("__m"), F.sort_array(F.transform(both, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value")))).alias("__spans"))
    rows = common.join_hot(docs.withColumn("__hash", F.xxhash64("text")), spans, ["__hash"], "__m", docs.count())

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        part = F.struct(at.alias("a"), x["s"].alias("b"), x["value"].alias("value"))
        return F.greatest(at, x["e"]), F.when(x["s"] >= at, part)

    kept = _scan(F.col("__spans"), "struct<a:int,b:int,value:string>", step)
    # what is kept at the end: from the last span, replaced or not
    last = F.array_max(F.transform("__spans", lambda x: x["e"]))

    def put_together(parts: Column) -> Column:
        return F.concat(F.array_join(F.transform(kept, lambda x: F.concat(_between(parts, x["a"], x["b"]), x["value"])), ""), _between(parts, last, F.length("text")))

    clean = _once(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), put_together)
    clean = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean)
    rows = rows.withColumn("__clean", clean)
    return rows.select(*(F.col("__clean").alias("text") if c == "text" else F.when(F.col("__spans").isNull(), F.col(c)).otherwise(F.length("__clean")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def op5_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positions of all spans of each document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    rows = common.join_hot(found.drop("text"), all_spans(docs, texts_of(found)), ["text_hash"], "m", found.count())
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    everything = F.concat(F.col("base"), F.coalesce("term_spans", F.array().cast(f"array<{SPAN}>")))
    return rows.select("doc_id", *map(count, KINDS), F.sha2(F.encode(_listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _listed(everything).alias("spans"), F.size(F.coalesce("term_spans", F.array().cast(f"array<{SPAN}>"))).cast("long").alias("n_term"))
