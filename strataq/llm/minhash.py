"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: t bins. In round i < t every shingle is hashed to one bin and offers
the value (i, hash) there; a bin keeps the least. Later rounds i >= t serve
bin i - t alone, so every bin is filled after 2t rounds at most; most documents
are full after a few. Two sets agree in a bin with probability equal to their
Jaccard similarity, with concentration over bins. BANDS bands of ROWS bins give the
buckets. At similarity 0.75 a pair meets in some bucket with probability
1 - (1 - 0.75**6)**50, about 0.99994; more above.

Documents with equal shingle sets form one class (a 128-bit sum of the set);
all further work is on classes, which have numbers of their own. Only classes that share a bucket need
their sketch and full set: they are made from whole texts in a second reading, where a Bloom filter of
BLOOM_BITS bits (its size is fixed; at some 10**7 wanted classes it begins to let others by, which costs shuffle only) keeps the rest
of the texts out of the shuffle. Within a bucket not all pairs are made:

1. the class that shares most buckets is the bucket's hub; hub and members are
   compared, and links give components;
2. after a second round with other hubs, members of a bucket that are still in
   different components are compared: as pairs in small buckets, and in crowded ones
   by tiles of two blocks of members, which only links leave.

So a group of near copies costs pairs with its hubs only, and no pair whose
outcome could change the result is left out. A pair is compared when sizes
allow the threshold and at most 111 of the 300 sketch values differ (by four bits
of each: a pair at 0.75 differs in 70 on average, deviation 7.3: one in 10**7 is lost).
Comparing means intersecting the full shingle sets.

Defined results: a text without words (or null) has an empty set and is linked
with nothing; fewer than five words form one shingle; repeated rows are one
class; a null key never names a component while another key can; an empty
table gives an empty result; columns other than key and text are not read. A text of n bytes takes a
worker about 60 n bytes for a moment; texts go in slices of slice_bytes, a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, mix64, release, text_or_empty, tidy
from .components import connected_components

WORDS, ROWS, BANDS = 5, 6, 50
THRESHOLD = (75, 100)
#: Four bits of each bin, in longs; bins that may differ in a pair to be compared.
LONGS = -(-4 * ROWS * BANDS // 64)
SKETCH = [f"s{k}" for k in range(LONGS)]
MOST_DIFFER = 111
#: Buckets of more open members than this are compared by tiles of BLOCK members a side.
CROWD, BLOCK = 64, 512
#: Size of the Bloom filter of wanted texts: the bound on what is broadcast.
BLOOM_BITS = 1 << 25
_LUT = np.arange(256, dtype=np.uint8)
_LUT[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _P)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if len(_powers.get(key, ())) < n:
        with np.errstate(over="ignore"):
            _powers[key] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n + (n >> 2), base, np.uint64)]))
    return _powers[key][:n]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every lower-cased word, document of each) of texts data[offs[i]:offs[i+1]]."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low = _LUT[data]
    letter = ~_SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = np.flatnonzero(letter & np.concatenate([[True], ~letter[:-1] | edge[1:n]]))
    end = np.flatnonzero(letter & np.concatenate([~letter[1:] | edge[1:n], [True]])) + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[low] * _power(_P, n), dtype=np.uint64)])
        h = (sums[end] - sums[start]) * _power(_INV, n)[start] + (end - start).astype(np.uint64) * _BYTE[7]
    return mix64(h), np.searchsorted(offs, start, side="right") - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents in turn, offsets by document)."""
    docs = len(offs) - 1
    w, doc = word_hashes(data, offs)
    n = np.bincount(doc, minlength=docs)
    first = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        full = np.flatnonzero(doc[words - 1 :] == doc[: len(doc) - words + 1]) if len(doc) >= words else np.empty(0, np.int64)
        h = np.zeros(len(full), np.uint64)
        for k in range(words):
            h = mix64(h * _P + w[full + k])
        short = np.flatnonzero((n > 0) & (n < words))
        hs = n[short].astype(np.uint64) * _BYTE[3]
        for k in range(words - 1):
            on = n[short] > k
            hs[on] = mix64(hs[on] * _P + w[first[short][on] + k])
    h, doc = np.concatenate([h, hs]), np.concatenate([doc[full], short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=docs))])


def sketches(h: np.ndarray, offs: np.ndarray, t: int = ROWS * BANDS) -> np.ndarray:
    """(documents, t) sketch values of the shingle sets; a row of an empty set keeps the largest value."""
    docs = len(offs) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(docs * t, empty, np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(offs))
    for i in range(2 * t):
        if not len(h):
            break
        with np.errstate(over="ignore"):
            x = mix64(h ^ mix64(np.full(1, i + 1, np.uint64) * _P))
        v = (x & np.uint64(0xFFFFFFFFFF)) | np.uint64(i << 40)
        bins = ((x >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else np.full(len(h), i - t)
        np.minimum.at(out, doc * t + bins, v)
        if i < 8 or i % 8 == 0 or i >= t:
            open_ = (out.reshape(docs, t) == empty).any(axis=1)
            live = open_[doc]
            if not live.all():
                h, doc = h[live], doc[live]
    return out.reshape(docs, t)


def band_hashes(sk: np.ndarray, rows: int = ROWS) -> np.ndarray:
    docs, t = sk.shape
    parts = sk.reshape(docs, t // rows, rows)
    with np.errstate(over="ignore"):
        x = np.arange(1, t // rows + 1, dtype=np.uint64)[None, :] * _P + np.zeros((docs, 1), np.uint64)
        for k in range(rows):
            x = mix64(x * _P + parts[:, :, k])
    return x.view(np.int64)


def _buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column without nulls."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def _sketch_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = _buffer(batch.column(2))
        for i, j in byte_slices(np.diff(offs), most):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            h, so = shingle_sets(d, o)
            n = np.diff(so)
            sk = sketches(h, so)
            with np.errstate(over="ignore"):
                z = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
                z2 = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h ^ _BYTE[9]), dtype=np.uint64)])
                a = mix64((z[so[1:]] - z[so[:-1]]) + n.astype(np.uint64)).view(np.int64)
                b = (z2[so[1:]] - z2[so[:-1]]).view(np.int64)
            bands = band_hashes(sk)
            bo = pa.array(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32))
            yield pa.record_batch(
                [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n.astype(np.int64)), pa.array(a), pa.array(b), pa.ListArray.from_arrays(bo, pa.array(bands.ravel()))],
                names=["key", "th", "n", "a", "b", "bands"],
            )


def _bloom_places(th: np.ndarray) -> np.ndarray:
    """(texts, 4) bit places of 16-byte text hashes, given as rows of two uint64."""
    with np.errstate(over="ignore"):
        return ((th[:, :1] + np.arange(4, dtype=np.uint64)[None, :] * (th[:, 1:] | np.uint64(1))) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _hash_rows(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, 2)


def _bloom(nodes: DataFrame) -> np.ndarray:
    """The Bloom filter of nodes.th, BLOOM_BITS bits: its segments are set in tasks and gathered."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(np.unique(_bloom_places(_hash_rows(batch.column(0)))))], names=["p"])

    def segment(t: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 18, np.uint8)
        bits[t.column("p").to_numpy() & ((1 << 18) - 1)] = 1
        return pa.table({"s": t.column("s")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    at = nodes.select("th").mapInArrow(places, "p long").distinct()
    got = at.withColumn("s", F.shiftright("p", 18)).groupBy("s").applyInArrow(segment, "s long, bits binary").collect()
    out = np.zeros(BLOOM_BITS // 8, np.uint8)
    for r in got:
        out[r.s << 15 : (r.s + 1) << 15] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _set_batches(batches: Iterator[pa.RecordBatch], most: int, bloom: np.ndarray) -> Iterator[pa.RecordBatch]:
    """th, sketch bits and full shingle set of each wanted text, once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        p = _bloom_places(_hash_rows(batch.column(0)))
        keep = np.flatnonzero(((bloom[p >> 3] >> (7 - (p & 7))) & 1).all(axis=1))
        ids = batch.column(0).take(pa.array(keep)).to_pylist()
        keep = keep[[k for k, x in enumerate(ids) if x not in seen and not seen.add(x)]]
        if len(seen) > 300_000:
            seen.clear()
        texts, ids = batch.column(1).take(pa.array(keep)), batch.column(0).take(pa.array(keep))
        data, offs = _buffer(texts)
        for i, j in byte_slices(np.diff(offs), most):
            h, so = shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            sk = sketches(h, so)
            nib = np.zeros((j - i, 16 * LONGS), np.uint8)
            nib[:, : sk.shape[1]] = sk & np.uint64(15)
            bits = (nib[:, 0::2] << 4 | nib[:, 1::2]).view(np.int64)
            sets = [h[so[k] : so[k + 1]].tobytes() for k in range(j - i)]
            yield pa.record_batch([ids[i:j], *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(LONGS)), pa.array(sets, pa.binary())], names=["th", *SKETCH, "shingles"])


def _link_batches(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, sb = (batch.column(i) for i in range(4))
        hit = []
        for i in range(batch.num_rows):
            x, y = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            hit.append(den * both >= num * (len(x) + len(y) - both))
        m = pa.array(hit, pa.bool_())
        yield pa.record_batch([a.filter(m), b.filter(m)], names=["u", "v"])


def _sizes_fit(p: str, q: str) -> Column:
    """The set sizes allow the threshold."""
    num, den = THRESHOLD
    a, b = F.col(f"{p}.n"), F.col(f"{q}.n")
    return (F.least(a, b) * den) >= (F.greatest(a, b) * num)


def _sketches_near(p: str, q: str) -> Column:
    """At most MOST_DIFFER bins differ, by four bits of each."""
    differ = F.lit(0)
    for k in SKETCH:
        x = F.col(f"{p}.{k}").bitwiseXOR(F.col(f"{q}.{k}"))
        y = x.bitwiseOR(F.shiftright(x, 1))
        z = y.bitwiseOR(F.shiftright(y, 2)).bitwiseAND(F.lit(0x1111111111111111))
        differ = differ + F.bit_count(z)
    return differ <= MOST_DIFFER


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs (u, v) whose sketches are near: a sketch moves once a pair, not once a bucket."""
    sk = sets.select("nid", *SKETCH)
    both = pairs.alias("z").join(sk.alias("p"), F.col("z.u") == F.col("p.nid")).join(sk.alias("q"), F.col("z.v") == F.col("q.nid"))
    return both.where(_sketches_near("p", "q")).select("z.*")


def _sets(nodes: DataFrame, docs: DataFrame, slice_bytes: int) -> DataFrame:
    """nid, sketch and full sorted shingle set of each class that shares a bucket, from whole texts.

    Equal texts leave a task once, so a text that very many rows share stays small in the shuffle.
    """
    bloom = _bloom(nodes)
    kinds = f"th binary, {', '.join(f'{c} long' for c in SKETCH)}, shingles binary"
    found = docs.mapInArrow(lambda it: tidy(_set_batches(it, slice_bytes, bloom)), kinds).dropDuplicates(["th"])
    return materialize(found.join(nodes.select("nid", "th"), "th").drop("th"), "minhash-sets")


def _tile_links(t: pa.Table, num: int, den: int) -> pa.Table:
    """Links between (or in) the one or two blocks of a tile: sketches first, then full sets."""
    nid, label, blk, n = (t.column(c).to_numpy() for c in ("nid", "label", "blk", "n"))
    bits = np.stack([t.column(c).to_numpy() for c in SKETCH], axis=1).astype("<i8").view(np.uint8)
    nib = np.concatenate([bits >> 4, bits & 15], axis=1)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]
    same = blk.min() == blk.max()
    left, right = (np.arange(len(nid)),) * 2 if same else (np.flatnonzero(blk == blk.min()), np.flatnonzero(blk == blk.max()))
    u, v = [], []
    for i in left:
        r = right[right > i] if same else right
        r = r[(label[r] != label[i]) & (np.minimum(n[r], n[i]) * den >= np.maximum(n[r], n[i]) * num)]
        r = r[np.count_nonzero(nib[r] != nib[i], axis=1) <= MOST_DIFFER]
        for j in r.tolist():
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                u.append(nid[i])
                v.append(nid[j])
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _crowded_links(now: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of crowded buckets that are in different components, by tiles of blocks.

    Members are blocked by groups of overlapping buckets, about BLOCK in each; two blocks meet in a
    task if they share a bucket. Only links leave the task.
    """
    crowd = now.groupBy("bh").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD)
    hot = materialize(now.join(crowd, "bh"), "minhash-crowded")
    # members of buckets that overlap get one group: the most crowded bucket within two steps
    slots = hot.select("bh", "nid")
    at = hot.groupBy("nid").agg(F.max(F.struct("c", "bh")).alias("m"))
    for _ in range(2):
        of_bucket = slots.join(at, "nid").groupBy("bh").agg(F.max("m").alias("m"))
        at = materialize(slots.join(of_bucket, "bh").groupBy("nid").agg(F.max("m").alias("m")), "minhash-groups")
    size = at.groupBy("m").agg(F.count(F.lit(1)).alias("size"))
    sub = F.pmod(F.xxhash64("nid", F.lit(1)), F.ceil(F.col("size") / BLOCK))
    at = materialize(at.join(size, "m").select("nid", F.xxhash64("m.bh", sub).alias("blk")), "minhash-blocks")
    seen = hot.select("bh", "nid").join(at, "nid").select("bh", "blk").distinct()
    tiles = seen.select("bh", F.col("blk").alias("a")).join(seen.select("bh", F.col("blk").alias("b")), "bh").where("a <= b").select("a", "b").distinct()
    sides = tiles.select(F.xxhash64("a", "b").alias("tile"), F.explode(F.array_distinct(F.array("a", "b"))).alias("blk"))
    rows = at.join(hot.select("nid", "label", "n").dropDuplicates(["nid"]), "nid").join(sets, "nid")
    num, den = THRESHOLD
    return materialize(sides.join(rows, "blk").groupBy("tile").applyInArrow(lambda t: _tile_links(t, num, den), "u long, v long"), "minhash-links")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold."""
    one = pairs.join(sets.select(F.col("nid").alias("v"), F.col("shingles").alias("sv")), "v")
    two = one.join(sets.select(F.col("nid").alias("u"), F.col("shingles").alias("su")), "u").select("u", "v", "su", "sv")
    num, den = THRESHOLD
    return materialize(two.mapInArrow(lambda it: tidy(_link_batches(it, num, den)), "u long, v long"), "minhash-links")


def near_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", slice_bytes: int = 4 << 20, star_rounds: int = 2) -> DataFrame:
    """One row per document: key, n_shingles, component_id, kept."""
    kind = df.schema[key].dataType.simpleString()
    t = text_or_empty(text)
    docs = df.select(F.col(key).alias("key"), F.unhex(F.md5(t.cast("binary"))).alias("th"), t.alias("text"))
    rows = docs.mapInArrow(lambda it: tidy(_sketch_batches(it, slice_bytes)), f"key {kind}, th binary, n long, a long, b long, bands array<long>")
    rows = materialize(rows, "minhash-rows")
    firsts = [F.first(c).alias(c) for c in ("n", "bands")]
    classes = rows.where("n > 0").groupBy("a", "b").agg(F.min("th").alias("th"), *firsts)
    classes = materialize(classes.withColumn("nid", F.monotonically_increasing_id()), "minhash-classes")
    slots = classes.select("nid", F.explode("bands").alias("bh"))
    shared = slots.groupBy("bh").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    mem = materialize(slots.join(shared, "bh"), "minhash-buckets")
    weight = mem.groupBy("nid").agg(F.sum("c").alias("w"))
    nodes = materialize(weight.join(classes.select("nid", "th", "n"), "nid"), "minhash-nodes")
    members = materialize(mem.select("bh", "nid").join(nodes.select("nid", "n", "w"), "nid"), "minhash-members")
    release(mem)

    sets = _sets(nodes, docs.select("th", "text"), slice_bytes)
    links, done = None, None
    labels = nodes.select("nid", F.col("nid").alias("label"))

    def more(found: DataFrame) -> None:
        nonlocal links, labels
        links = found if links is None else links.unionByName(found)
        labels = materialize(_labels(nodes, links), "minhash-labels")

    for turn in range(star_rounds):
        now = _open(members, labels) if turn else members.withColumn("label", F.col("nid"))
        rank = F.xxhash64("nid", F.lit(turn)) if turn else F.col("w")
        pick = F.max(F.struct(rank.alias("w"), "nid", "n", "label"))
        hubs = now.groupBy("bh").agg(pick.alias("h")).select("bh", "h.*")
        star = hubs.alias("p").join(now.alias("q"), (F.col("p.bh") == F.col("q.bh")) & (F.col("p.nid") != F.col("q.nid")) & (F.col("p.label") != F.col("q.label")) & _sizes_fit("p", "q"))
        meet = star.groupBy(F.col("p.nid").alias("u"), F.col("q.nid").alias("v")).agg(F.max("p.w").alias("w"))
        # one hub for each member: pairs grow with the members, however many buckets a pair shares
        mine = _near(meet, sets).groupBy("v").agg(F.max(F.struct("w", "u")).alias("h"))
        cand = mine.groupBy(F.least("v", "h.u").alias("x"), F.greatest("v", "h.u").alias("y")).agg(F.min(F.struct(F.col("h.u").alias("u"), "v")).alias("p")).select("p.u", "p.v")
        cand = materialize(_not_in(cand, done), "minhash-pairs")
        if cand.isEmpty():
            break
        done = cand if done is None else done.unionByName(cand)
        more(_verify(cand, sets))
    now = _open(members, labels)
    few = now.join(now.groupBy("bh").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") <= CROWD).select("bh"), "bh").join(sets.select("nid", *SKETCH), "nid")
    every = few.alias("p").join(few.alias("q"), (F.col("p.bh") == F.col("q.bh")) & (F.col("p.nid") < F.col("q.nid")) & (F.col("p.label") != F.col("q.label")) & _sizes_fit("p", "q") & _sketches_near("p", "q"))
    cand = materialize(_not_in(every.select(F.col("p.nid").alias("u"), F.col("q.nid").alias("v")).distinct(), done), "minhash-pairs")
    if not cand.isEmpty():
        more(_verify(cand, sets))
        now = _open(members, labels)
    if not now.groupBy("bh").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CROWD).isEmpty():
        more(_crowded_links(now, sets))
    # classes that are not the first of their component, with that one's (a, b): few beside the rows
    ids = classes.select("nid", "a", "b")
    moved = labels.where("nid != label").join(ids, "nid").select("label", "a", "b")
    moved = materialize(moved.join(ids.select(F.col("nid").alias("label"), F.col("a").alias("ca"), F.col("b").alias("cb")), "label").drop("label"), "minhash-moved")
    slim = rows.select("key", "n", "a", "b").join(moved, ["a", "b"], "left")
    slim = slim.select("key", "n", *[F.when(F.col("n") > 0, F.coalesce(f"c{x}", x)).alias(x) for x in "ab"])
    least = slim.where("n > 0").groupBy("a", "b").agg(F.min("key").alias("least"))
    full = slim.join(least, ["a", "b"], "left")
    comp = F.coalesce("least", "key")
    release(nodes, members, sets, classes)
    return full.select("key", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("key").eqNullSafe(comp).alias("kept"))


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with labels, of the buckets that hold several components."""
    now = members.join(labels, "nid")
    mixed = now.groupBy("bh").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("bh")
    return materialize(now.join(mixed, "bh"), "minhash-open")


def _not_in(pairs: DataFrame, done: DataFrame | None) -> DataFrame:
    if done is None:
        return pairs
    gone = done.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"))
    return pairs.join(gone, (F.least("u", "v") == F.col("x")) & (F.greatest("u", "v") == F.col("y")), "left_anti")


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    cc = connected_components(links.select("u", "v"))
    return nodes.select("nid").join(cc.withColumnRenamed("node", "nid"), "nid", "left").select("nid", F.coalesce("label", "nid").alias("label"))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("key", "doc_id")
