"""Embedding near-dedup by PCA-ordered tiled comparison.

Equal vectors (by a digest of 128 bits) form one class. Classes are sorted by the angle to the
leading principal axis and cut into blocks, written once; two blocks are compared only if their angle
ranges come within acos(threshold) (angles obey the triangle inequality, so nothing is
lost). Tasks read the pairs of blocks from the written table (a cartesian product), so vectors are
shuffled twice in all, however many blocks there are. In a tile one product in single precision, of the
leading dimensions and the suffix norms, bounds every cosine from above; pairs whose bound
reaches the threshold are computed in double precision. Pairs within 1e-9 of the threshold are decided
on the original vectors.

A tile returns, for each of its classes, a number of links and its local component, so
links are never expanded. Blocks hold a bounded number of bytes, so a
task's memory does not grow with the table.

Defined results: vectors that are null, empty, zero or have null or non-finite
components link with nothing; vectors of different lengths do not link; equal
vectors link with each other; a null id never names a component while another
can; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import materialize, release
from .components import connected_components

#: Most vectors and most bytes of a block; small tables have smaller ones, so that there are some BLOCKS of them.
BLOCK, BLOCK_BYTES, BLOCKS = 16384, 4 << 20, 12
LEADING = 32
#: Products that a tile holds at once.
AT_ONCE = 1 << 21
#: More than single precision can err in a product of unit vectors.
LOOSE = 1e-5


def _matrix(col: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).astype(np.float64).reshape(-1, dim)


def _usable(col: pa.Array, kind: str) -> list[bytes | None]:
    """The bytes of each vector; null where it is null, empty, zero or not finite. Zeros have no sign."""
    lens = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    if kind == "f8" and flat.type != pa.float64():
        flat = flat.cast(pa.float64(), safe=False)
    x = flat.to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
    ends = np.cumsum(lens)
    among = lambda on: np.diff(np.concatenate([[0], np.cumsum(on)])[np.concatenate([[0], ends])])
    ok = (lens > 0) & (among(~np.isfinite(x)) == 0) & (among(x != 0) > 0)
    return [x[e - n : e].tobytes() if o else None for o, n, e in zip(ok.tolist(), lens.tolist(), ends.tolist(), strict=True)]


def _digest(v: bytes | None) -> bytes | None:
    return None if v is None else hashlib.blake2b(v, digest_size=16).digest()


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(vectors: DataFrame, dim: int, kind: str) -> np.ndarray:
    """dim x dim axes by falling variance, from the second moments of all unit vectors (dim**2 numbers a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0), dim, kind))
                total += u.T @ u
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = vectors.select("v").mapInArrow(run, "m binary").toLocalIterator()
    total = np.zeros((dim, dim))
    for r in parts:
        total += np.frombuffer(bytes(r.m)).reshape(dim, dim)
    vals, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, np.argsort(-vals)])


def _bounds(y: np.ndarray, leading: int) -> np.ndarray:
    """Leading coordinates and the norm of the others: the product of two such rows is at least the cosine."""
    k = min(leading, y.shape[1])
    rest = np.sqrt(np.einsum("ij,ij->i", y[:, k:], y[:, k:]))
    return np.ascontiguousarray(np.concatenate([y[:, :k], rest[:, None]], axis=1).astype(np.float32))


def tile_links(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool, leading: int = LEADING, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of unit vectors a[i], b[j] with cosine >= threshold; i < j if both are the same block."""
    ya, yb = a @ axes, b @ axes
    wa, wb = _bounds(ya, leading), np.ascontiguousarray(_bounds(yb, leading).T)
    rows, exact = max(1, at_once // len(b)), max(1, at_once // a.shape[1])
    for r in range(0, len(a), rows):
        first = r + 1 if same else 0  # columns before it are met from the other side
        if first >= len(b):
            break
        hit = np.flatnonzero(wa[r : r + rows] @ wb[:, first:] >= np.float32(threshold - LOOSE))
        for h in range(0, len(hit), exact):
            i, j = np.divmod(hit[h : h + exact], len(b) - first)
            i, j = i + r, j + first
            if same:
                i, j = i[i < j], j[i < j]
            d = np.einsum("ij,ij->i", ya[i], yb[j])
            near = np.flatnonzero(np.abs(d - threshold) < 1e-9)
            d[near] = np.einsum("ij,ij->i", a[i[near]], b[j[near]])
            ok = d >= threshold
            yield i[ok], j[ok]


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    while len(i):
        x, y = label[i], label[j]
        on = x != y
        if not on.any():
            break
        i, j, x, y = i[on], j[on], x[on], y[on]
        m = np.minimum(x, y)
        np.minimum.at(label, x, m)
        np.minimum.at(label, y, m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def _blocks(t: pa.Table, axes: np.ndarray, dim: int, kind: str, size: int) -> pa.Table:
    v = np.frombuffer(b"".join(t.column("v").to_pylist()), kind).reshape(-1, dim)
    angle = np.concatenate([np.arccos(np.clip(_unit(v[i : i + size].astype(np.float64)) @ axes[:, 0], -1, 1)) for i in range(0, len(v), size)])
    cid, n, blk = (t.column(c).to_numpy() for c in ("cid", "n", "blk"))
    order = np.argsort(angle, kind="stable")
    rows = []
    for k, i in enumerate(range(0, len(order), size)):
        o = order[i : i + size]
        rows.append((f"{blk[0]}.{k}", angle[o[0]], angle[o[-1]], cid[o].tobytes(), n[o].tobytes(), v[o].tobytes()))
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["blk", "lo", "hi", "cids", "ns", "data"])


_BLOCKS = "blk string, lo double, hi double, cids binary, ns binary, data binary"


def _tile(row: dict, axes: np.ndarray, dim: int, kind: str, threshold: float) -> pa.RecordBatch:
    same = row["a_blk"] == row["b_blk"]
    sides = "a" if same else "ab"
    ids = [np.frombuffer(row[f"{s}_cids"], np.int64) for s in sides]
    ns = [np.frombuffer(row[f"{s}_ns"], np.int64) for s in sides]
    us = [_unit(np.frombuffer(row[f"{s}_data"], kind).astype(np.float64).reshape(-1, dim)) for s in sides]
    cid, n = np.concatenate(ids), np.concatenate(ns)
    shift = 0 if same else len(ids[0])
    label, got = np.arange(len(cid)), np.zeros(len(cid), np.int64)
    for i, j in tile_links(us[0], us[-1], axes, threshold, same):
        j = j + shift
        np.add.at(got, i, n[j])
        np.add.at(got, j, n[i])
        label = _join_labels(label, i, j)
    on = np.flatnonzero(got)
    return pa.record_batch([pa.array(cid[on]), pa.array(got[on]), pa.array(cid[label[on]])], names=["cid", "links", "root"])


def _dealt(classes: DataFrame, dim: int, kind: str, block: int, n: int) -> tuple[np.ndarray, DataFrame]:
    """The axes, and the written blocks of the n classes (cid, n, v) of one length."""
    axes = principal_axes(classes, dim, kind)
    block = min(block, max(1, BLOCK_BYTES // (dim * np.dtype(kind).itemsize)), max(1024, -(-n // BLOCKS)))
    main = np.ascontiguousarray(axes[:, 0])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([pa.array(_unit(_matrix(b.column(0), dim, kind)) @ main)], names=["p"])

    at = [i / -(-n // block) for i in range(1, -(-n // block))]
    cuts = np.unique(classes.select("v").mapInArrow(place, "p double").approxQuantile("p", at, 0.001)) if at else np.empty(0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                blk = np.searchsorted(cuts, _unit(_matrix(b.column(2), dim, kind)) @ main)
                yield pa.record_batch([pa.array(blk.astype(np.int32)), *b.columns], names=["blk", "cid", "n", "v"])

    dealt = classes.select("cid", "n", "v").mapInArrow(deal, "blk int, cid long, n long, v binary")
    return axes, materialize(dealt.groupBy("blk").applyInArrow(lambda t: _blocks(t, axes, dim, kind, block), _BLOCKS), "embed-blocks", "uncompressed")


def _block_links(blocks: DataFrame, axes: np.ndarray, dim: int, kind: str, threshold: float) -> DataFrame:
    """cid, links, root of all tiles."""
    reach = float(np.arccos(threshold)) + 1e-9
    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    near = (F.col("a_blk") <= F.col("b_blk")) & (F.col("b_lo") - F.col("a_hi") <= reach) & (F.col("a_lo") - F.col("b_hi") <= reach)
    tiles = side("a").join(side("b").hint("shuffle_replicate_nl"), near).drop("a_lo", "a_hi", "b_lo", "b_hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield _tile(b.slice(i, 1).to_pylist()[0], axes, dim, kind, threshold)

    return materialize(tiles.mapInArrow(run, "cid long, links long, root long"), "embed-links")


def embedding_dedup(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept."""
    read = df.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    kind = "f4" if isinstance(read.schema["v"].dataType.elementType, FloatType) else "f8"
    named = f"key {read.schema['key'].dataType.simpleString()}, digest binary"

    def run(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _usable(b.column(1), kind)
                cols = [b.column(0), pa.array([_digest(x) for x in v], pa.binary())] + [pa.array(v, pa.binary())] * whole
                yield pa.record_batch(cols, names=["key", "digest", "v"][: len(cols)])

    rows = materialize(read.mapInArrow(lambda bs: run(bs, False), named), "embed-rows")
    classes = read.mapInArrow(lambda bs: run(bs, True), named + ", v binary").where("digest is not null")
    classes = classes.groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "embed-classes")
    width = np.dtype(kind).itemsize
    dims = [(r[0] // width, r[1]) for r in classes.groupBy(F.octet_length("v").alias("bytes")).count().collect()]
    if not dims:
        return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    dealt = [(dim, *_dealt(classes.where(F.octet_length("v") == dim * width), dim, kind, block, n)) for dim, n in dims]
    names = materialize(classes.drop("v"), "embed-names")
    release(classes)
    links = None
    for dim, axes, blocks in dealt:
        part = _block_links(blocks, axes, dim, kind, threshold)
        release(blocks)
        links = part if links is None else links.unionByName(part)
    cc = connected_components(links.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    count = links.groupBy("cid").agg(F.sum("links").alias("links"))
    full = names.join(count, "cid", "left").join(cc.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = full.groupBy("label").agg(F.min("least").alias("component"))
    full = materialize(full.join(least, "label").select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"), "embed-result")
    out = rows.join(full, "digest", "left")
    comp = F.coalesce("component", "key")
    return out.select("key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.col("key").eqNullSafe(comp).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("key", "vec_id")
