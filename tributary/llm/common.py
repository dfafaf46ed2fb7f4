"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than one in HOT of all rows; so there are HOT of them at most.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A temporary one where it is unset, in local mode only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, label: str = "cut", codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_of_id(column: str = "doc_id"):
    """crc32 of the id written as decimal text; null ids count as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8"))


def join_hot(many: DataFrame, one: DataFrame, keys: Sequence[str], weight: str, total: int) -> DataFrame:
    """Left join of `many` to `one`, which has one row a key, without gathering a hot key's rows in one task.

    `weight` is the number of the key's rows in `many`, and `total` at least the sum of all weights: at most HOT keys have more
    than total / HOT rows. These are broadcast; the others are shuffled. Rows with a null key join nothing.
    """
    names = [c for c in one.columns if c not in keys]
    facts = F.struct(*names)
    hot = F.col(weight) * HOT > total
    rows = many.join(F.broadcast(one.where(hot).select(*keys, facts.alias("__hot"))), list(keys), "left")
    done = F.col("__hot").isNotNull()
    for k in keys:
        done = done | F.col(k).isNull()
    # rows that are done meet no row of `one`; they are dealt out by their number
    rows = rows.withColumn("__done", done).withColumn("__deal", F.when(F.col("__done"), F.monotonically_increasing_id()))
    to = [f"__to{i}" for i in range(len(keys))]
    # -1 as no constant that the optimizer knows, or it would not be a key of the shuffle
    cold = one.where(~hot).select(*(F.col(k).alias(t) for k, t in zip(keys, to, strict=True)), F.when(F.col(weight) > 0, F.lit(-1).cast("long")).alias("__none"), facts.alias("__cold"))
    on = F.coalesce("__deal", F.lit(-1)) == F.col("__none")
    for k, t in zip(keys, to, strict=True):
        on = on & (F.col(k) == F.col(t))
    got = F.coalesce("__hot", "__cold")
    return rows.join(cold, on, "left").select(*many.columns, *(got[c].alias(c) for c in names))


def classes(rows: DataFrame, aggregates: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """rows, and one row a class (c, c2, aggregates): c is half of a 128-bit name, c2 the other half, both null for rows of no class.

    Where texts of one c differ in c2, their rows get a new c made of both, until each c has one c2.
    """
    while True:
        found = saved(rows.where("c is not null").groupBy("c").agg(*aggregates, F.min("c2").alias("c2"), F.max("c2").alias("__high")), "classes")
        clash = found.where("c2 <> __high").select("c", F.lit(True).alias("__clash"))
        if clash.isEmpty():
            return rows, found.drop("__high")
        rows = saved(rows.join(clash, "c", "left").withColumn("c", F.when(F.col("__clash"), F.xxhash64("c", "c2")).otherwise(F.col("c"))).select(rows.columns), "renamed")
