"""Sharding by weighted rendezvous hashing.

Every (key, shard) pair gets a pseudo-random number u in (0, 1) from its hash; a record goes to the shard with the
smallest -ln(u) / weight. A new shard can only win records for itself, so it moves about weight / total weight of the
records and no record moves between the old shards.

Edge cases: a null key counts as the empty string; a null text has no bytes; equal rows land in the same shard with
neighbouring slots; very long texts only count by their bytes; an empty table gives an empty result; further columns are carried along, but the added
ones (shard, grown_shard, slot) replace those of their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_of


def race(key: Column, shard: int, weight: float = 1.0) -> Column:
    """The record's arrival time at a shard (smallest wins) with the shard's number behind it for ties."""
    if weight <= 0:
        raise ValueError("weights are positive")
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(shard)), 11) + 0.5) / float(2**53)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("time"), F.lit(shard).alias("shard"))


def rendezvous_shard(key: Column, shards: int, weights: Sequence[float] | None = None) -> Column:
    weights = weights or [1.0] * shards
    if len(weights) != shards or shards < 1:
        raise ValueError("one weight for each shard")
    return F.array_min(F.array(*(race(key, s, w) for s, w in enumerate(weights))))["shard"]


def with_slots(df: DataFrame, shard: str, order: Sequence[str], buckets: int = 4096) -> DataFrame:
    """Adds slot: positions within each shard, gapless from 0.

    Rows are numbered inside (shard, bucket) groups and each group starts where the counts of the groups before it end,
    so no task ever holds a whole shard. The groups' counts are at most shards x buckets rows.
    """
    b = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [shard, "__bucket"]
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = b.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.join(starts, keys).withColumn("slot", F.col("__start") + F.col("__rank") - 1).drop("__bucket", "__rank", "__start")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = 24, weights: Sequence[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """Adds shard, and grown_shard: where the record goes once one more shard of new_weight exists."""
    weights = list(weights or [1.0] * shards)
    return df.withColumn("shard", rendezvous_shard(F.col(key), shards, weights)).withColumn("grown_shard", rendezvous_shard(F.col(key), shards + 1, [*weights, new_weight]))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Writes one folder for each shard; rows of one shard are spread over as many files as tasks hold them."""
    assign_shards(df, **options).write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_of()) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    placed = with_slots(assign_shards(docs), "shard", ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
