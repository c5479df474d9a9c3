"""Token-id files: Simple-8b word-aligned coding with escapes.

A file holds ids of consecutive documents as blocks. A block is

    magic b"S8B1" | u32 documents | u32 ids | u32 words | u32 escapes
    | documents x u32 end offsets (in ids) | escapes x u64 | words x u64

all little-endian. A word's low 4 bits select how many ids it packs and how
wide they are (SELECTORS); the ids follow from bit 4 upwards. Ids of up to 30 bits are
packed; a wider one is an escape: a word of selector ESCAPE holds its place and
the escape list, in order, its value. Ends of documents and of blocks give
random access without decoding other blocks; words of one selector are decoded
together.

Defined results: null text counts as empty and holds the end id only; a null
key sorts first; repeated rows stand side by side; an empty table gives an
empty dataset; columns other than the named key and text are not read.

The dataset is a table of blocks (file number, first position, payload)
written by Spark's committer to the shared folder, one file for each range of
keys in ascending order, so a lost executor or a repeated task leaves no
half-written or double file.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_shuffle, ragged_take, text_or_empty
from .pieces import Pieces, encoded, split

#: Fixed values of the format: (ids in a word, bits of each) by selector.
SELECTORS = ((0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 30))
ESCAPE = 0
MAGIC = b"S8B1"
#: Pieces that a worker numbers at once, and pieces that its dictionary keeps: bounds its memory.
PIECES_AT_ONCE, DICTIONARY = 1_000_000, 500_000
WIDEST = 30
_vocab: dict[str, tuple[Pieces, Callable]] = {}


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, escapes uint64) of non-negative ids.

    Greedy: at each place the selector that packs most of the coming ids. The
    reach of every selector at every place is found for all places at once.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    width = np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.int8)  # bits; at 2**53 and more rounding may add one, which is wide anyway
    least = int(width.min())
    best = np.zeros(n, np.int8)  # selector by place; 0: escape
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[s]
        if count > n or bits < least:
            continue
        bad = np.concatenate([[-1], np.flatnonzero(width > bits), [n]])
        runs = np.flatnonzero(np.diff(bad) > count)  # between two wide ids: at least `count` others
        if len(runs):
            turn = np.zeros(n + 1, np.int8)
            turn[bad[runs] + 1] = 1
            turn[bad[runs + 1] - count + 1] = -1
            best[np.cumsum(turn[:n], dtype=np.int8) > 0] = s
    step = np.array([1, *(c for c, _ in SELECTORS[1:])], np.uint8)[best].tobytes()
    at, places = 0, []
    while at < n:
        places.append(at)
        at += step[at]
    places = np.array(places)
    sel = best[places]
    words = sel.astype(np.uint64)
    for s in range(1, len(SELECTORS)):
        here = np.flatnonzero(sel == s)
        if len(here):
            count, bits = SELECTORS[s]
            first, word = places[here], words[here]
            for k in range(count):
                word |= ids[first + k] << np.uint64(bits * k + 4)
            words[here] = word
    return words, ids[places[sel == ESCAPE]]


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words, by selector."""
    sel = (words & np.uint64(15)).astype(np.int64)
    counts = np.array([1, *(c for c, _ in SELECTORS[1:])])[sel]
    starts = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for s in range(1, len(SELECTORS)):
        here = np.flatnonzero(sel == s)
        if len(here):
            count, bits = SELECTORS[s]
            vals = (words[here][:, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits) + np.uint64(4))) & np.uint64((1 << bits) - 1)
            out[starts[here][:, None] + np.arange(count)] = vals
    out[starts[sel == ESCAPE]] = escapes
    return out


def write_block(ids: np.ndarray, ends: np.ndarray) -> bytes:
    words, esc = pack(ids)
    head = np.array([len(ends), len(ids), len(words), len(esc)], "<u4").tobytes()
    return b"".join([MAGIC, head, ends.astype("<u4").tobytes(), esc.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, end offset of each document)."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, w, e = np.frombuffer(data, "<u4", 4, 4).tolist()
    ends = np.frombuffer(data, "<u4", docs, 20)
    esc = np.frombuffer(data, "<u8", e, 20 + 4 * docs)
    words = np.frombuffer(data, "<u8", w, 20 + 4 * docs + 8 * e)
    return unpack(words, esc, n), ends.astype(np.int64)


def _added(path: str) -> list[str]:
    """Contents of the tokenizer's added tokens."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _encoder(path: str) -> tuple[Pieces, Callable]:
    """The dictionary of pieces, and the encoding of one whole text."""
    if path not in _vocab:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        batch = getattr(tok, "encode_batch_fast", tok.encode_batch)

        def alone(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got = [x.ids for x in batch(words, add_special_tokens=False)]
            return np.array([i for x in got for i in x], np.int32), np.array([len(x) for x in got], np.int64)

        line = alone(["\n"])[0]

        def lines(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """The ids of pieces without white space past their start, as lines of one text: a line's end is a piece of its own."""
            ids = np.array(batch(["\n".join(words)], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(ids == line[0])
            if len(line) != 1 or len(ends) != len(words) - 1:
                return alone(words)
            return np.delete(ids, ends), np.diff(ends, prepend=-1, append=len(ids)) - 1

        def encode(words: list[str]):
            blank = np.fromiter(map(str.isspace, words), bool, len(words))
            ids, lens, order = [np.empty(0, np.int32)], [np.empty(0, np.int64)], []
            for at, how in ((np.flatnonzero(~blank), lines), (np.flatnonzero(blank), alone)):
                order.append(at)
                for i in range(0, len(at), 500):
                    a, b = how([words[k] for k in at[i : i + 500]])
                    ids.append(a)
                    lens.append(b)
            ids, lens, back = np.concatenate(ids), np.concatenate(lens), np.argsort(np.concatenate(order))
            return ragged_take(ids, (np.cumsum(lens) - lens)[back], lens[back]), lens[back], np.empty(0, np.uint8), np.zeros(len(words), np.int64)

        _vocab[path] = Pieces(encode, DICTIONARY), lambda t: alone([t])[0]
    return _vocab[path]


def encode_ids(df: DataFrame, key: str, text: str, path: str, end_id: int) -> DataFrame:
    """key, ids binary (with the end id; little-endian, 2 bytes each, or 4 if wide), wide.

    Texts go piece by piece. Those that hold an added token of the tokenizer (which goes before the split) and
    those that pieces.split() leaves to Python are encoded whole.
    """
    t = text_or_empty(text)
    pieces, left = split(text)
    held = reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in _added(path)], F.lit(False))
    rows = df.select(F.col(key).alias("key"), pieces.alias("pieces"), F.coalesce(left, F.when(held, t)).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, encode_whole = _encoder(path)
        for batch in batches:
            out, wide = [], []
            for (ids, _), whole in zip(encoded(batch.column(1), known, PIECES_AT_ONCE), batch.column(2), strict=True):
                one = np.append(encode_whole(whole.as_py()) if whole.is_valid else ids, np.int32(end_id))
                wide.append(bool(one.max() >= 1 << 16))
                out.append(one.astype("<u4" if wide[-1] else "<u2").tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary()), pa.array(wide, pa.bool_())], names=["key", "ids", "wide"])

    return rows.mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, ids binary, wide boolean")


def key_ranges(keys: DataFrame, files: int) -> list:
    """Least keys of the second and later of about `files` ranges of the keys (a value per file)."""
    cut = keys.select("key").where("key is not null").repartitionByRange(files, "key")
    low = cut.groupBy(F.spark_partition_id()).agg(F.min("key").alias("k")).collect()
    return sorted(r.k for r in low)[1:]


def write_token_files(ids: DataFrame, cuts: list, block_ids: int = 1 << 18, tag: str = "tokens") -> DataFrame:
    """Write (key, ids, wide) in ascending key order (null first) and return the dataset of blocks.

    `cuts` are the least keys of all files but the first. Columns: file int,
    block int, keys (of its documents), n_ids long, payload binary.
    """
    kind = ids.schema["key"].dataType.simpleString()
    at = F.when(F.col("key").isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("key")))) if cuts else F.lit(0)
    ordered = ids.withColumn("file", at.cast("int")).repartition(len(cuts) + 1, "file").sortWithinPartitions("file", F.col("key").asc_nulls_first(), "ids").select("key", "ids", "wide", "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, block, keys, parts, size = None, 0, [], [], 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for x in parts])
            cols = [[file], [block], [keys], [size], [write_block(np.concatenate(parts), ends)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(key_type), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "block", "keys", "n_ids", "payload"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, x, wide, f in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                one = np.frombuffer(x.as_py(), "<u4" if wide else "<u2")
                if parts and (f != file or size + len(one) > block_ids):
                    yield out()
                    block, keys, parts, size = block + 1 if f == file else 0, [], [], 0
                file = f
                keys.append(k)
                parts.append(one)
                size += len(one)
        if parts:
            yield out()

    return materialize(ordered.mapInArrow(run, f"file int, block int, keys array<{kind}>, n_ids long, payload binary"), tag)


def read_token_files(blocks: DataFrame) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32: decoded from the blocks."""
    sums = blocks.groupBy("file", "block").agg(F.sum("n_ids").alias("n"))
    by_file = sums.groupBy("file").agg(F.sum("n").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = by_file.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("f0"))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.withColumn("b0", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(files), "file").select("file", "block", (F.col("b0") + F.col("f0")).alias("first"))
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, ends = read_block(batch.column(1)[i].as_py())
                first = np.concatenate([[0], ends[:-1]])
                ids = ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first, ends, strict=True)]
                base = batch.column(2)[i].as_py()
                yield pa.record_batch([batch.column(0)[i].values, pa.array(first + base), pa.array(ends - first), pa.array(crc, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    at = blocks.select("file", "block", "keys", "payload").join(F.broadcast(offs) if _few(offs) else offs, ["file", "block"])
    return at.select("keys", "payload", "first").mapInArrow(run, f"key {kind}, start long, n_tokens long, ids_crc32 long")


def _few(offs: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of block offsets is small enough to send to every executor."""
    return offs.limit(most + 1).count() <= most


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = encode_ids(docs, "doc_id", "text", P.path("byte_bpe_50k.json"), 0)
    cuts = key_ranges(docs.select(F.col("doc_id").alias("key")), n_shuffle(spark))
    return read_token_files(write_token_files(ids, cuts)).withColumnRenamed("key", "doc_id")
