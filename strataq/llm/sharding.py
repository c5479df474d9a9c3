"""Sharding: weighted rendezvous hashing of stable record keys (native).

Every (key, shard) pair has a hash u in (0, 1); the record goes to the shard
with the largest weight / -ln(u). A shard's hash does not depend on the other
shards, so an added shard takes rows only into itself and a removed shard
gives only its own rows away.

Defined results: a null key is a key of its own; a null text has size 1 (its
zero bytes plus 1) and the crc32 of the empty text; repeated rows get slots
of their own; an empty table gives an empty result; columns other than the
named key and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, stable_key, text_or_empty

#: Rows in one (shard, block) window at about this many rows.
BLOCK_ROWS = 50_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (int) of a key among len(weights) shards; ties go to the higher shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scored = []
    for i, w in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(2**53))
        scored.append(F.struct((F.lit(-float(w)) / F.log(u)).alias("s"), F.lit(i).alias("i")))
    return F.array_max(F.array(*scored))["i"]


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per record: key, size, text_crc32, shard, grown_shard, slot (gapless from 0 in each shard).

    Slots are counted in blocks of a shard (a hash of the key), so that no
    task holds a whole shard: block sizes are summed first and give offsets.
    """
    t = text_or_empty(text)
    slim = materialize(
        df.select(
            F.col(key).alias("key"),
            (F.octet_length(t).cast("long") + 1).alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            rendezvous(stable_key(F.col(key)), weights).alias("shard"),
            rendezvous(stable_key(F.col(key)), [*weights, grown_weight]).alias("grown_shard"),
        ),
        "shard",
    )
    blocks = max(1, slim.count() // (block_rows * len(weights)))
    placed = slim.withColumn("blk", F.pmod(F.xxhash64(stable_key(F.col("key")), F.lit("slot")), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("shard", "blk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("shard", "blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("shard", "blk").orderBy("key", "text_crc32", "size")
    return (
        placed.withColumn("r", F.row_number().over(inside))
        .join(offs, ["shard", "blk"])
        .select("key", "size", "text_crc32", "shard", "grown_shard", (F.col("off") + F.col("r") - 1).alias("slot"))
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
