"""Exact deduplication by Grace hashing.

1. Each input task folds its own rows in an open-addressing table that
   compares complete content (bounded bytes; the table is emptied when full).
   It writes one row per record without text, and one row per local group
   with the text, the group's size and its best record. So a text that a
   third of all records share reaches the next step once per task.
2. The local groups are dealt to buckets by content hash. A bucket whose
   distinct content exceeds the table budget is dealt again with another hash
   (its rows go to spill files in the shared folder), until every bucket fits
   or holds one text alone.
3. Each bucket is folded in a table of the same kind; its answers return to
   the records by local group id.

Equal means: identical after deleting space and U+0009..U+000D. The record
with the most code points in the original text stays, then the smallest key
(null last), then the first in the written order, so exactly one of repeated
rows with one key stays. Null text counts as empty; empty texts form one
group; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, n_shuffle, text_or_empty, tidy

#: Bytes of content that one table may hold.
TABLE_BYTES = 32 << 20
_BLANK = " \t\n\x0b\f\r"

_LEVEL0 = "rid long, key {key}, n_cp int, sha string, lid long, size int, n long, content binary"


class OpenTable:
    """Linear probing over a power-of-two slot array; equality is that of complete content."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots, self.mask, self.content, self.hashes, self.bytes = [-1] * 1024, 1023, [], [], 0

    def put(self, h: int, content: bytes) -> tuple[int, bool]:
        """(number of the content, whether it is new)."""
        i = h & self.mask
        while (k := self.slots[i]) >= 0:
            if self.hashes[k] == h and self.content[k] == content:
                return k, False
            i = (i + 1) & self.mask
        self.slots[i] = k = len(self.content)
        self.content.append(content)
        self.hashes.append(h)
        self.bytes += len(content) + 64
        if 2 * len(self.content) > self.mask:
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for k, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = k


def _rank(n_cp: int, key, rid: int) -> tuple:
    return (-n_cp, key is None, key if key is not None else 0, rid)


def _local_fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema, table_bytes: int) -> Iterator[pa.RecordBatch]:
    pid, seq, groups = TaskContext.get().partitionId() << 40, 0, 0
    table, best, count, shas = OpenTable(), [], [], []

    def flush() -> pa.RecordBatch:
        nonlocal groups, best, count, shas
        n = len(table.content)
        cols = [
            [b[3] for b in best], [None if b[1] else b[2] for b in best], [-b[0] for b in best], shas,
            list(range(pid + groups, pid + groups + n)), [len(c) for c in table.content], count, table.content,
        ]
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        groups += n
        table.clear()
        best, count, shas = [], [], []
        return out

    for batch in batches:
        rids, lids = [], []
        keys, cps, sha = (batch.column(i).to_pylist() for i in (0, 1, 2))
        content, own = batch.column(3), batch.column(4).to_pylist() if batch.num_columns > 4 else None
        for i, (key, n_cp, s) in enumerate(zip(keys, cps, sha, strict=True)):
            c, rid = content[i].as_py(), own[i] if own else pid + seq
            if table.bytes + len(c) > table_bytes and table.content:
                yield flush()
            k, new = table.put(int(s[:15], 16), c)
            r = _rank(n_cp, key, rid)
            if new:
                best.append(r)
                count.append(1)
                shas.append(s)
            else:
                best[k] = min(best[k], r)
                count[k] += 1
            rids.append(rid)
            lids.append(pid + groups + k)
            seq += 1
        none = [None] * len(rids)
        cols = [rids, keys, cps, sha, lids, none, none, none]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
    if table.content:
        yield flush()


def _fold_buckets(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: lid, keep_rid, keep_id, group_size for each local group."""
    table, best, count, rows, now = OpenTable(), [], [], [], None

    def flush() -> pa.RecordBatch:
        cols = [[x for x, _ in rows], [best[k][3] for _, k in rows], [None if best[k][1] else best[k][2] for _, k in rows], [count[k] for _, k in rows]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for batch in batches:
        bucket, lids, rids, keys, cps, sha, n = (batch.column(i).to_pylist() for i in range(7))
        content = batch.column(7)
        for i in range(len(lids)):
            if bucket[i] != now:
                if rows:
                    yield flush()
                table.clear()
                best, count, rows, now = [], [], [], bucket[i]
            k, new = table.put(int(sha[i][:15], 16), content[i].as_py())
            r = _rank(cps[i], keys[i], rids[i])
            if new:
                best.append(r)
                count.append(n[i])
            else:
                best[k] = min(best[k], r)
                count[k] += n[i]
            rows.append((lids[i], k))
    if rows:
        yield flush()


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _resolve(groups: DataFrame, key_type: str, budget: int, level: int = 0) -> DataFrame:
    spark = groups.sparkSession
    total = groups.agg(F.sum("size")).first()[0] or 0
    nb = max(n_shuffle(spark), -(-int(total) // budget))
    b = groups.withColumn("bucket", F.pmod(F.xxhash64("sha", F.lit(level)), F.lit(nb)).cast("int"))
    load = b.groupBy("bucket", "sha").agg(F.max("size").alias("size")).groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("texts"))
    over = load.where((F.col("bytes") > 2 * budget) & (F.col("texts") > 1)).select("bucket")
    rest = None
    if not over.isEmpty():
        spilled = materialize(b.join(over, "bucket", "left_semi").drop("bucket"), f"dedup-spill-{level + 1}")
        rest = _resolve(spilled, key_type, budget, level + 1)
        b = b.join(over, "bucket", "left_anti")
    dealt = b.select("bucket", "lid", "rid", "key", "n_cp", "sha", "n", "content").repartition(nb, "bucket").sortWithinPartitions("bucket")
    out = T.StructType.fromDDL(f"lid long, keep_rid long, keep_key {key_type}, group_size long")
    schema = _arrow(out)
    done = dealt.mapInArrow(lambda it: tidy(_fold_buckets(it, schema)), out)
    return done.unionByName(rest) if rest is not None else done


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES, row: str | None = None) -> DataFrame:
    """One row per record: key, keep_id, group_size, kept, text_sha256; with `row`, a column of unique longs in the written order, that column too."""
    t = text_or_empty(text)
    norm = F.translate(t, _BLANK, "")
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.char_length(t).alias("n_cp"), F.sha2(norm.cast("binary"), 256).alias("sha"), norm.cast("binary").alias("content"), *([F.col(row)] if row else []))
    out = T.StructType.fromDDL(_LEVEL0.format(key=key_type))
    schema = _arrow(out)
    level0 = materialize(rows.mapInArrow(lambda it: tidy(_local_fold(it, schema, table_bytes)), out), "dedup")
    resolved = _resolve(level0.where("n is not null"), key_type, table_bytes)
    members = level0.where("n is null").select("rid", "key", "lid", "sha")
    return members.join(resolved, "lid").select("key", F.col("keep_key").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"), *([F.col("rid").alias(row)] if row else []))


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("key", "doc_id")


#: The same result in DuckDB's SQL.
OP1_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n_cp,
         sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as h
  from documents
), w as (
  select doc_id, h, count(*) over (partition by h) as n,
         first_value(doc_id) over (partition by h order by n_cp desc, doc_id) as keep_id
  from t
)
select doc_id, keep_id, n::bigint as group_size, doc_id = keep_id as kept, h as text_sha256 from w
"""
