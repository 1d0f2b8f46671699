"""Shared helpers: written intermediate tables, components, batch sizes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by spark.checkpoint.dir."""
    return shared_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files outlive a lost executor, unlike cached or locally checkpointed
    partitions."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, so that long texts fit in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows while the block runs, for rows of many MB."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


#: Bits of the bitmaps of ``maybe_in`` (8 MB at any number of ids).
BITMAP_BITS = 1 << 26


def maybe_in(df: DataFrame, key: str, ids: DataFrame, flag: str = "maybe_") -> DataFrame:
    """``df`` with a boolean column: false where ``key`` is surely not among
    the one column of ``ids`` (a null key is not).

    The ids become a bitmap of hashes whose size is fixed: 2,048 rows of 4 KB,
    which are broadcast. It keeps rows out of a later shuffle; an exact join
    decides on those that pass, and the more ids the more rows pass."""
    def bit(c):  # Spark numbers the bits of its bitmaps from 1
        return F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS)) + 1
    own = F.col(f"`{ids.columns[0]}`")
    maps = (ids.select(F.bitmap_bucket_number(bit(own)).alias("part_"), F.bitmap_bit_position(bit(own)).alias("bit_"))
            .groupBy("part_").agg(F.bitmap_construct_agg("bit_").alias("bits_")))
    at = F.bitmap_bit_position(bit(F.col(f"`{key}`")))
    byte = F.conv(F.hex(F.substring(F.col("bits_"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    test = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & F.col(f"`{key}`").isNotNull()
    return (df.join(F.broadcast(maps), F.bitmap_bucket_number(bit(F.col(f"`{key}`"))) == F.col("part_"), "left")
            .withColumn(flag, test).drop("part_", "bits_"))


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; only rows that the bitmap
    lets through are shuffled. Rows of a null key stay."""
    marked = maybe_in(df, key, ids)
    rest = marked.where("maybe_").drop("maybe_")
    gone = ids.select(F.col(f"`{ids.columns[0]}`").alias("gone_"))
    return (marked.where("NOT maybe_").drop("maybe_")
            .unionByName(rest.join(gone, F.col(f"`{key}`") == F.col("gone_"), "left_anti")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root
    the smallest node id reachable; only nodes with an edge to another node.

    Alternates large-star and small-star steps (each a grouped minimum and a
    join on the node), a logarithmic number of rounds on chains. Every round
    is a written table. Hot nodes are split by Spark's skew join: neighbours
    are never gathered into one row. Raises if it does not settle."""
    e = write_table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct("u", F.col("m").alias("v")))).alias("x"))
                 .select("x.*").where("u <> v").distinct())
        e = write_table(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
