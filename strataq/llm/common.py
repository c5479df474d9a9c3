"""Helpers that the training-data operators share.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors), so that a lost
executor costs a re-read and never a broken lineage.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules, for Java's regular expressions.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one of our own in local mode (tests), else an error."""
    global _own_dir
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="strataq-")
    return _own_dir


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and return the written table."""
    at = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._strataq_path = at
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._strataq_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return what a Python worker has freed, in Arrow's pool and in the C heap, to the system: Spark keeps idle workers, and their free memory counts."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def tidy(batches: Iterator) -> Iterator:
    """The same batches; freed memory goes back after each and at the end."""
    try:
        for b in batches:
            yield b
            del b
            give_back()
    finally:
        give_back()


def n_shuffle(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _UPPER.lower())


def stable_key(col: Column) -> Column:
    """A record key as text; null has a key of its own."""
    return F.coalesce(col.cast("string"), F.lit("\x00null"))


def ragged_take(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenate values[s:s+n] over all (s, n)."""
    total = int(lens.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lens)
    return values[np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_slices(lens: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges whose lengths sum to about `most` bytes (a longer row stands alone)."""
    out, start, total = [], 0, 0
    for i, n in enumerate(lens.tolist()):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if len(lens):
        out.append((start, len(lens)))
    return out


def blocked_prefix(df: DataFrame, group: list[str], order: list[str], value: str, block: str, out: str, inclusive: bool = True) -> DataFrame:
    """Running sum of `value` in each group, without one task per group.

    `block` is an integer column that must not decrease along `order` inside
    a group. Sums of blocks (one row per group and block) give the offset of
    each block; a window inside (group, block) gives the rest.
    """
    from pyspark.sql import Window

    sums = df.groupBy(*group, block).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    g = [c for c in (*group, block)]
    offs = sums.select(*[F.col(c).alias(f"_o_{c}") for c in g], F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(*g).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_in", F.sum(value).over(inner))
    on = None
    for c in g:
        e = F.col(c).eqNullSafe(F.col(f"_o_{c}"))
        on = e if on is None else on & e
    total = F.col("_off") + F.col("_in") - (F.lit(0) if inclusive else F.col(value))
    return rows.join(offs, on).withColumn(out, total).drop("_off", "_in", *[f"_o_{c}" for c in g])
