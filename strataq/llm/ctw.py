"""LM scoring by context-tree weighting over bytes.

A text is its lower-cased (A-Z) words joined by single spaces and closed by an
end mark (byte 0xFF, never part of UTF-8; also the context before a text). Each byte is eight
binary decisions; every decision has a context tree over the DEPTH preceding bytes.
A node holds a Krichevsky-Trofimov estimate of its counts; the tree weights
all depths: Pw = 1/2 Pe + 1/2 prod(Pw of children), and the predictive mixture along a path
follows from these weights. The score is the sum of log10 probabilities of all bytes.

Nothing is capped and no table of the corpus reaches the driver:

1. texts are dealt to chunks of about CHUNK_BYTES by a hash of the key; a chunk
   writes its distinct (context, byte) grams and distinct words, with counts over
   training texts, as sorted arrays cut by key hash;
2. each hash part sums its arrays (all chunks), so a gram or word is stored once;
3. grams are dealt by their last two context bytes, so that each task
   holds whole subtrees; only the subtrees' roots, at most 256 x 255 numbers after
   summing, meet on the driver, which answers with the weights of the top;
4. every gram's log probability goes back to its hash part and on to the
   chunks that asked, which sum over their texts.

A chunk asks for grams of held-out texts too, so all grams are answered exactly.

Defined results: null text counts as empty: one end token, n_known 1 if a
training text exists; a null key is a training row with a key of its own;
repeated rows give repeated results; an empty table gives an empty result;
columns other than key and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, stable_key, text_or_empty
from .minhash import _LUT, _SPACE, _buffer, word_hashes

DEPTH = 5
CHUNK_BYTES = 6 << 20
END = 0xFF
_END_WORD = np.uint64(0x5851F42D4C957F2D)
_LG = np.array([math.lgamma(n + 0.5) for n in range(256)])
_LGI = np.array([0.0] + [math.lgamma(n) for n in range(1, 512)])


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    half = lambda n: np.where(n < 256, _LG[np.minimum(n, 255)], _stirling(np.maximum(n, 1) + 0.5))
    whole = lambda n: np.where(n < 512, _LGI[np.minimum(n, 511)], _stirling(np.maximum(n, 1).astype(float)))
    return half(a) + half(b) - whole(a + b + 1) - math.log(math.pi)


def canonical(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with an end mark after each text, offsets): lower-cased words joined by single spaces."""
    docs = len(offs) - 1
    b = _LUT[data]
    space = _SPACE[b]
    first = np.zeros(len(b) + 1, bool)
    first[offs] = True
    # a space stays if a word byte stands right before it in the same text and a word follows in it
    keep = ~space
    doc = np.repeat(np.arange(docs), np.diff(offs))
    if len(b):
        after = np.concatenate([[False], keep[:-1]]) & ~first[:-1]
        last_word = np.full(docs, -1)
        at = np.flatnonzero(keep)
        np.maximum.at(last_word, doc[at], at)
        keep |= space & after & (np.arange(len(b)) < last_word[doc])
    b = np.where(space, np.uint8(32), b)[keep]
    n = np.bincount(doc[keep], minlength=docs) + 1
    ends = np.cumsum(n)
    out = np.full(int(ends[-1]) if docs else 0, END, np.uint8)
    fill = np.ones(len(out), bool)
    fill[ends - 1] = False
    out[fill] = b
    return out, np.concatenate([[0], ends])


def grams(b: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """At each byte: its `depth` predecessors (end marks before the first) and itself, in a uint64.

    What stands before a text's start is the end mark of the text before it,
    so older bytes are masked to end marks as well.
    """
    x = b.astype(np.uint64)
    g = x.copy()
    blocked = np.zeros(len(b), bool)
    for k in range(1, depth + 1):
        prev = np.full(len(b), np.uint64(END))
        if len(b) > k:
            prev[k:] = x[:-k]
        prev[blocked] = END
        blocked |= prev == END
        g |= prev << np.uint64(8 * k)
    return g


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the end token last in each text, text of each)."""
    w, doc = word_hashes(data, offs)
    docs = np.arange(len(offs) - 1)
    return np.concatenate([w, np.full(len(docs), _END_WORD)]), np.concatenate([doc, docs])


def _parts(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(n)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    return np.diff(keys, prepend=np.uint64(0)).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint64), dtype=np.uint64)


def _features(t: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    data, offs = _buffer(t.column("text").combine_chunks())
    b, bo = canonical(data, offs)
    w, wd = _tokens(data, offs)
    return [(0, grams(b), np.repeat(np.arange(len(bo) - 1), np.diff(bo))), (1, w, wd)]


def _table(t: pa.Table) -> pa.Table:
    """Rows of a chunk in a fixed order, so that both passes see the same."""
    return t.sort_by([("key", "ascending"), ("text", "ascending")])


def _ask(t: pa.Table, parts: int) -> pa.Table:
    t = _table(t)
    chunk, rows = t.column("chunk")[0].as_py(), []
    train = t.column("train").to_numpy().astype(bool)
    for kind, keys, doc in _features(t):
        u, inv = np.unique(keys, return_inverse=True)
        n = np.bincount(inv, weights=train[doc], minlength=len(u)).astype(np.uint32)
        p = _parts(u, parts)
        order = np.argsort(p, kind="stable")
        cut = np.searchsorted(p[order], np.arange(parts + 1))
        for k in range(parts):
            o = order[cut[k] : cut[k + 1]]
            if len(o):
                rows.append((kind, k, chunk, _pack(u[o]), n[o].tobytes(), len(o)))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "part", "chunk", "keys", "counts", "size"])


def _sum(t: pa.Table, trees: int) -> pa.Table:
    kind, part = t.column("kind")[0].as_py(), t.column("part")[0].as_py()
    u, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    pending, size = [], 0

    def fold():
        nonlocal u, n, pending, size
        k = np.concatenate([u, *(x for x, _ in pending)])
        c = np.concatenate([n, *(y.astype(np.int64) for _, y in pending)])
        u, inv = np.unique(k, return_inverse=True)
        n = np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)
        pending, size = [], 0

    for a, b in zip(t.column("keys"), t.column("counts"), strict=True):
        pending.append((_unpack(a.as_py()), np.frombuffer(b.as_py(), np.uint32)))
        size += len(pending[-1][0])
        if size > 2_000_000:
            fold()
    fold()
    rows = []
    tree = _parts((u >> np.uint64(8)) & np.uint64(0xFFFF), trees) if kind == 0 else np.zeros(len(u), np.int64)
    for k in np.unique(tree).tolist():
        on = tree == k
        rows.append((kind, part, k, _pack(u[on]), n[on].tobytes(), int(n[on].sum()), int((n[on] > 0).sum())))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "part", "tree", "keys", "counts", "total", "known"])


class Subtrees:
    """Nodes of all depths from DEPTH down to 2 over the grams of one task, for one of the eight decisions."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bit: int) -> None:
        x = (keys & np.uint64(255)).astype(np.int64)
        one = (x >> (7 - bit)) & 1
        node = ((1 << bit) | (x >> (8 - bit))).astype(np.uint64)
        ctx = keys >> np.uint64(8)
        self.levels, inv = [], None
        for d in range(DEPTH, 1, -1):
            if inv is None:
                k, inv = np.unique((ctx << np.uint64(8)) | node, return_inverse=True)
                n0 = np.bincount(inv, weights=n * (one == 0), minlength=len(k)).astype(np.int64)
                n1 = np.bincount(inv, weights=n * one, minlength=len(k)).astype(np.int64)
                pe = log_kt(n0, n1)
                pw = pe
                self.leaf, self.one = inv, one
            else:
                low = (np.uint64(1) << np.uint64(8 * (d + 1))) - np.uint64(1)
                k, up = np.unique(self.levels[-1]["k"] & low, return_inverse=True)
                child = self.levels[-1]
                n0, n1 = (np.bincount(up, weights=child[c], minlength=len(k)).astype(np.int64) for c in ("n0", "n1"))
                pe = log_kt(n0, n1)
                pw = np.logaddexp(math.log(0.5) + pe, math.log(0.5) + np.bincount(up, weights=child["pw"], minlength=len(k)))
                child["up"] = up
            self.levels.append({"k": k, "n0": n0, "n1": n1, "pe": pe, "pw": pw})

    def log10(self, top: dict[str, np.ndarray]) -> np.ndarray:
        """log10 probability of the decision at every gram; top: S0, S1, A of the depth-1 nodes by key."""
        root = self.levels[-1]
        at = np.searchsorted(top["k"], root["k"] & np.uint64(0xFFFF))
        s0, s1, a = top["s0"][at], top["s1"][at], top["a"][at]
        for i in range(len(self.levels) - 1, -1, -1):
            v = self.levels[i]
            if i < len(self.levels) - 1:
                s0, s1, a = s0[v["up"]], s1[v["up"]], a[v["up"]]
            w = np.exp(math.log(0.5) + v["pe"] - v["pw"]) if i else np.ones(len(v["k"]))
            total = v["n0"] + v["n1"] + 1.0
            s0, s1, a = s0 + a * w * (v["n0"] + 0.5) / total, s1 + a * w * (v["n1"] + 0.5) / total, a * (1 - w)
        return np.log10(np.where(self.one == 1, s1[self.leaf], s0[self.leaf]))


def _gather(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    k = np.concatenate([_unpack(x.as_py()) for x in t.column("keys")])
    n = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in t.column("counts")])
    return k, n


def _roots(t: pa.Table) -> pa.Table:
    """Depth-2 nodes of a task summed to their depth-1 parents: k, n0, n1, log Pw of the children seen here."""
    keys, n = _gather(t)
    out = []
    for bit in range(8):
        v = Subtrees(keys, n, bit).levels[-1]
        k, inv = np.unique(v["k"] & np.uint64(0xFFFF), return_inverse=True)
        out.append((k.astype(np.int64), *(np.bincount(inv, weights=v[c], minlength=len(k)) for c in ("n0", "n1", "pw"))))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["k", "n0", "n1", "pw"])


def _top(rows: list) -> dict[str, np.ndarray]:
    """Predictive sums S0, S1 and remaining weight A below the depth-1 nodes."""
    k = np.array([r.k for r in rows], np.uint64)
    order = np.argsort(k)
    k = k[order]
    n0, n1, kids = (np.array([getattr(r, c) for r in rows], float)[order] for c in ("n0", "n1", "pw"))
    n0, n1 = n0.astype(np.int64), n1.astype(np.int64)
    half = math.log(0.5)
    pe = log_kt(n0, n1)
    pw = np.logaddexp(half + pe, half + kids)
    _, up = np.unique(k & np.uint64(255), return_inverse=True)
    r0, r1, rk = (np.bincount(up, weights=v) for v in (n0, n1, pw))
    re = log_kt(r0.astype(np.int64), r1.astype(np.int64))
    w = np.exp(half + re - np.logaddexp(half + re, half + rk))
    s0, s1, a = w * (r0 + 0.5) / (r0 + r1 + 1), w * (r1 + 0.5) / (r0 + r1 + 1), 1 - w
    s0, s1, a = s0[up], s1[up], a[up]
    w = np.exp(half + pe - pw)
    return {"k": k, "s0": s0 + a * w * (n0 + 0.5) / (n0 + n1 + 1), "s1": s1 + a * w * (n1 + 0.5) / (n0 + n1 + 1), "a": a * (1 - w)}


def _gram_scores(t: pa.Table, top: dict[str, np.ndarray]) -> pa.Table:
    part = np.repeat([x.as_py() for x in t.column("part")], [len(x.as_py()) // 8 for x in t.column("keys")])
    keys, n = _gather(t)
    score = np.zeros(len(keys))
    for bit in range(8):
        score += Subtrees(keys, n, bit).log10(top)
    rows = []
    for p in np.unique(part).tolist():
        on = np.flatnonzero(part == p)
        rows.append((0, int(p), _pack(keys[on]), score[on].astype(np.float32).tobytes()))
    return _answers(rows)


def _answers(rows: list) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "part", "keys", "vals"])


def _reply(asked: pa.Table, known: pa.Table) -> pa.Table:
    """For each chunk's keys of a part, the values in the same order."""
    kind = asked.column("kind")[0].as_py() if asked.num_rows else 0
    dtype = np.float32 if kind == 0 else np.int64
    k = np.concatenate([_unpack(x.as_py()) for x in known.column("keys")])
    v = np.concatenate([np.frombuffer(x.as_py(), dtype) for x in known.column("vals")])
    order = np.argsort(k)
    k, v = k[order], v[order]
    out = []
    for a in range(asked.num_rows):
        got = v[np.searchsorted(k, _unpack(asked.column("keys")[a].as_py()))]
        out.append((kind, asked.column("part")[a].as_py(), asked.column("chunk")[a].as_py(), got.astype(np.float32 if kind == 0 else np.uint32).tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "part", "chunk", "vals"])


def _score(t: pa.Table, replies: pa.Table, parts: int, total: int, vocab: int) -> pa.Table:
    t = _table(t)
    docs = t.num_rows
    sums = {}
    for kind, keys, doc in _features(t):
        u, inv = np.unique(keys, return_inverse=True)
        p = _parts(u, parts)
        order = np.argsort(p, kind="stable")
        cut = np.searchsorted(p[order], np.arange(parts + 1))
        vals = np.zeros(len(u))
        for i in range(replies.num_rows):
            if replies.column("kind")[i].as_py() == kind:
                k = replies.column("part")[i].as_py()
                vals[order[cut[k] : cut[k + 1]]] = np.frombuffer(replies.column("vals")[i].as_py(), np.float32 if kind == 0 else np.uint32)
        if kind == 0:
            sums["score"] = np.bincount(doc, weights=vals[inv], minlength=docs)
        else:
            c = vals[inv]
            sums["n_tokens"] = np.bincount(doc, minlength=docs)
            sums["n_known"] = np.bincount(doc, weights=c > 0, minlength=docs).astype(np.int64)
            sums["base_score"] = np.bincount(doc, weights=np.log10((c + 0.5) / (total + 0.5 * (vocab + 1))), minlength=docs)
    held = pa.array(~t.column("train").to_numpy().astype(bool))
    return pa.table([t.column("key"), held, pa.array(sums["n_tokens"]), pa.array(sums["n_known"]), pa.array(np.full(docs, total, np.int64)), pa.array(sums["base_score"]), pa.array(sums["score"])], names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def ctw_scores(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per text: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    t = text_or_empty(text)
    fold = F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))
    size = df.agg(F.sum(F.octet_length(t) + 1)).first()[0] or 0
    chunks = max(1, -(-int(size) // chunk_bytes))
    parts = max(4, chunks // 4)
    docs = df.select(F.pmod(F.xxhash64(stable_key(F.col(key)), F.lit(3)), F.lit(chunks)).alias("chunk"), F.col(key).alias("key"), t.alias("text"), F.coalesce(fold != held_fold, F.lit(True)).alias("train"))
    asked = materialize(docs.groupBy("chunk").applyInArrow(lambda g: _ask(g, parts), "kind int, part int, chunk long, keys binary, counts binary, size long"), "ctw-asked")
    sums = "kind int, part int, tree int, keys binary, counts binary, total long, known long"
    known = materialize(asked.groupBy("kind", "part").applyInArrow(lambda g: _sum(g, parts), sums), "ctw-known")
    words = known.where("kind = 1")
    n, v = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    trees = known.where("kind = 0").select("part", "tree", "keys", "counts")
    roots = trees.groupBy("tree").applyInArrow(_roots, "k long, n0 double, n1 double, pw double")
    top = _top(roots.groupBy("k").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("pw")).collect())
    scored = trees.groupBy("tree").applyInArrow(lambda g: _gram_scores(g, top), "kind int, part int, keys binary, vals binary")
    answers = scored.unionByName(words.select("kind", "part", "keys", F.col("counts").alias("vals")))
    back = "kind int, part int, chunk long, vals binary"
    replies = asked.select("kind", "part", "chunk", "keys").groupBy("kind", "part").cogroup(answers.groupBy("kind", "part")).applyInArrow(_reply, back)
    out = f"key {df.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda a, b: _score(a, b, parts, n, v), out)


def op4_ctw(spark, sf_dir: str) -> DataFrame:
    return ctw_scores(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("key", "doc_id")
