"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle. A document's
virtual finish time is the running sum of its source's words divided by the
source's target; the mix serves documents in order of finish time and stops
at the total budget. A source whose target exceeds its size is served again
from its start, up to `max_repeat` times.

Targets: sources in code point order (null last) get the repeating weights
and share `budget_share` of all words; no target may exceed `max_repeat` times its
source's words: the excess is shared again by weight until none is above.

Running sums are taken in blocks (common.blocked_prefix), so a source that
holds most rows is spread over many tasks. The order is a range sort on the
finish time (blocks of equal width, sorted inside), cut at the budget. What a source has
sent in a pass is then a prefix of its shuffle, so the whole decision is one
cut for each source and pass, and rows are taken by comparing with it: no text
and no row moves for that.

Defined results: null text has size 0; documents of size 0 are listed with
taken 0; a null source is a source of its own; repeated rows queue
separately (order by shuffle hash of key and text, key, size, then a number); an empty table
gives an empty result. The same rows give the same mix on every run. Columns other than
the named ones are not read, and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, blocked_prefix, materialize, release, stable_key, text_or_empty

BLOCK_ROWS = 5_000


def source_plan(sized: DataFrame, weights: Sequence[float], budget_share: float, max_repeat: int) -> DataFrame:
    """One row per source: source, source_size, target.

    Water filling: a target is weight * level, or max_repeat * size if that is less. In the order of
    max_repeat * size / weight the capped sources are a prefix; the first source that its level leaves under the cap fixes it.
    """
    per = sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(budget_share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("w").over(rest))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(every)
    target = F.least(F.col("cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("w"))
    return per.select("source", "source_size", target.alias("target"))


def _in_order(df: DataFrame, key: str, text: str, source: str, seed: int, row: str) -> list:
    t = text_or_empty(text)
    return [
        F.col(source).cast("string").alias("source"),
        F.xxhash64(stable_key(F.col(key)), t, F.lit(seed)).alias("h"),
        F.col(key).alias("key"),
        F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"),
        F.col(row).alias("row"),
    ]


_ORDER = ["h", "key", "size", "row"]


def mix_plan(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeat: int = 3, seed: int = 7, block_rows: int = BLOCK_ROWS, row: str = "row") -> tuple[DataFrame, DataFrame]:
    """(sized, plan): the written rows (source, h, key, size, row), and for each source (source_size, target, cuts).

    `row` names a column of unique numbers. A row is taken as often as a cut is not before its (h, key, size, row).
    """
    sized = materialize(df.select(*_in_order(df, key, text, source, seed, row)), "mix")
    n, words = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    blocks = max(1, n // block_rows)
    plan = materialize(source_plan(sized, weights, budget_share, max_repeat), "mix-sources")
    width = float(2**64) / blocks
    s = plan.withColumnRenamed("source", "_s")
    placed = sized.where("size > 0").join(s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("blk", F.floor((F.col("h").cast("double") + float(2**63)) / F.lit(width)).cast("int"))
    queue = blocked_prefix(placed, ["source"], _ORDER, "size", "blk", "cum")
    # every served pass of a document, with its virtual finish time; 1.0 is when all targets are met
    share = F.when(F.col("target") > 0, (F.col("pass") * F.col("source_size") + F.col("cum")) / F.col("target"))
    served = (
        queue.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
        .withColumn("finish", share)
        .where(F.col("finish") <= F.lit(1.0) + F.col("size") / F.col("target"))
    )
    served = served.withColumn("bin", F.floor(F.least(F.col("finish"), F.lit(4.0)) * F.lit(blocks)).cast("int"))
    served = materialize(served.select("source", "pass", "finish", "bin", *_ORDER), "mix-served")
    ranked = blocked_prefix(served.withColumn("all", F.lit(0)), ["all"], ["finish", "source", "pass", *_ORDER], "size", "bin", "sent")
    cut = ranked.where(F.col("sent") <= F.lit(budget_share * float(words)))
    passes = cut.groupBy("source", "pass").agg(F.max(F.struct(*_ORDER)).alias("cut"))
    cuts = passes.groupBy(F.col("source").alias("_s")).agg(F.collect_list("cut").alias("cuts"))  # at most max_repeat cuts
    none = F.array().cast(cuts.schema["cuts"].dataType)
    out = materialize(plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", F.coalesce("cuts", none).alias("cuts")), "mix-plan")
    release(served, plan)
    return sized, out


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, h, key, size, row and others) with source_size, target and copies: how often the mix takes each.

    One row of the plan per source: Spark sends it to all tasks while it is under its broadcast bound, and splits hot
    sources of a sort-merge join beyond that.
    """
    at = F.struct(*_ORDER)
    copies = F.when(F.col("size") > 0, F.size(F.filter("cuts", lambda c: at <= c))).otherwise(0)
    s = plan.withColumnRenamed("source", "_s")
    return rows.join(s, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", copies).drop("_s", "cuts")


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeat: int = 3, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies, taken."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), F.monotonically_increasing_id().alias("row"))
    sized, plan = mix_plan(rows, "key", "text", "source", weights, budget_share, max_repeat, seed, block_rows)
    return with_copies(sized, plan).select("key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_rows(rows: DataFrame, key: str, text: str, source: str, row: str, out: str, **how) -> DataFrame:
    """Column `out` of rows, as often as the mix takes each; rows is a written table with unique numbers in `row`."""
    _, plan = mix_plan(rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(row).alias("row")), "key", "text", "source", **how)
    placed = rows.select(*_in_order(rows, key, text, source, how.get("seed", 7), row), F.col(out).alias("out"))
    taken = with_copies(placed, plan).where("copies > 0")
    return taken.select("out", F.explode(F.sequence(F.lit(1), "copies"))).select(F.col("out").alias(out))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")
