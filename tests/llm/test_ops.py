"""Every operator on small tables with nulls, ties, repeated rows, extra columns and no rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from strataq.llm import bpe, ctw, embedding_dedup, exact_dedup, language_id, license_scan, minhash, mixing, sharding, token_files
from strataq.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "the cat sat on the mat and looked at a very old dog while rain fell over all of the town today"
TEXTS = [
    BASE, BASE + " again", BASE.replace(" ", "\n"), BASE.upper(), None, "", "  \t\n", "one", "One  ", "two words", "Released under the MIT License. cc by",
    "GNU General Public License version 2 or later", "l'été à l'école des garçons naïfs", "der Bär läuft über die Straße und frißt", "1234 5678 !!", "😀 emoji  and space　x",
    "a" * 300, "word " * 4000, "gnu general public license gnu general public license", "'s 're don't  x",
]
ROWS = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "é"][i % 4], 0, "x") for i, t in enumerate(TEXTS)]
ROWS += [(3, BASE.upper(), "en", "a", 0, "x"), (None, BASE, "fr", "b", 0, "x"), (None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, size int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, bpe.encode_digest, ctw.ctw_scores, license_scan.license_scan, sharding.shard, mixing.mix, minhash.near_dedup])
def test_empty_table(none, f):
    assert f(none).count() == 0


@pytest.mark.parametrize("table_bytes", [1 << 20, 40])
def test_exact_dedup(docs, table_bytes):
    got = exact_dedup.exact_dedup(docs, table_bytes=table_bytes).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    want = {hashlib.sha256(k.encode()).hexdigest(): (len(v), min(v)) for k, v in groups.items()}
    assert len(got) == len(ROWS)
    for r in got:
        n, best = want[r.text_sha256]
        assert (r.group_size, r.keep_id) == (n, None if best[1] else best[2])
    assert sum(r.kept for r in got) == len(want)


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(80):
        n = int(rng.integers(0, 300))
        x = (rng.integers(0, 1 << 62, n) >> rng.integers(0, 62, n)).astype(np.uint64)
        w, e = token_files.pack(x)
        assert (token_files.unpack(w, e, n) == x).all()
    x = np.array([0, 1, 2**30 - 1, 2**30, 2**31, 2**53 + 1, 2**64 - 1], np.uint64)
    assert (token_files.unpack(*token_files.pack(x), len(x)) == x).all()
    block = token_files.write_block(x, np.array([3, 3, 7]))
    assert (token_files.read_block(block)[0] == x).all()
    with pytest.raises(ValueError):
        token_files.read_block(b"nope" + block)


def test_token_files(docs):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    ids = token_files.encode_ids(docs, "doc_id", "text", P.path("byte_bpe_50k.json"), 0)
    got = token_files.read_token_files(token_files.write_token_files(ids, token_files.key_ranges(ids, 4), block_ids=200)).orderBy("start").collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t, *_ in ROWS:
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want[i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert collections.Counter((r.key, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    keys = [-1 if r.key is None else r.key for r in got]
    assert keys == sorted(keys)


def test_bpe(docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter()
    for i, t, *_ in ROWS:
        x = enc.encode_ordinary(t or "")
        want[i, len(x), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())] += 1
    assert collections.Counter(tuple(r) for r in bpe.encode_digest(docs).collect()) == want
    back = bpe.decode(bpe.encode(docs)).collect()
    assert collections.Counter((r.key, bytes(r.bytes)) for r in back) == collections.Counter((i, (t or "").encode()) for i, t, *_ in ROWS)


def test_ctw_base(docs):
    got = {(r.key, r.n_tokens): r for r in ctw.ctw_scores(docs, chunk_bytes=2000).collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t, *_ in ROWS if not held(i) for w in [*words(t), 0])
    n, v = sum(c.values()), len(c)
    for i, t, *_ in ROWS:
        r, toks = got[i, len(words(t)) + 1], [*words(t), 0]
        assert (r.held_out, r.n_known, r.train_tokens) == (held(i), sum(c[w] > 0 for w in toks), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in toks))
        assert r.score < 0
    a, b = (ctw.ctw_scores(docs, chunk_bytes=k).orderBy("key", "n_tokens").collect() for k in (500, 1 << 20))
    assert [r.score for r in a] == pytest.approx([r.score for r in b], rel=1e-5)


def test_ctw_brute_force():
    keys = ctw.grams(*[ctw.canonical(np.frombuffer(b"abab abba  ab", np.uint8), np.array([0, 13]))[0]])
    u, n = np.unique(keys, return_counts=True)
    trees = [collections.defaultdict(lambda: [0, 0]) for _ in range(ctw.DEPTH + 1)]
    ways = lambda k: [(int(k) >> 8, (1 << j) | ((int(k) & 255) >> (8 - j)), (int(k) >> (7 - j)) & 1) for j in range(8)]
    for k, m in zip(u, n, strict=True):
        for cx, node, bit in ways(k):
            for d in range(ctw.DEPTH + 1):
                trees[d][cx & ((1 << 8 * d) - 1), node][bit] += int(m)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weight, kids = {}, collections.defaultdict(float)
    for d in range(ctw.DEPTH, -1, -1):
        up = collections.defaultdict(float)
        for (cx, node), (a, b) in trees[d].items():
            pe = kt(a, b)
            pw = pe if d == ctw.DEPTH else np.logaddexp(math.log(0.5) + pe, math.log(0.5) + kids[cx, node])
            weight[d, cx, node] = 1 if d == ctw.DEPTH else math.exp(math.log(0.5) + pe - pw)
            if d:
                up[cx & ((1 << 8 * (d - 1)) - 1), node] += pw
        kids = up
    import pyarrow as pa

    t = pa.table({"part": [0], "tree": [0], "keys": [ctw._pack(u)], "counts": [n.astype(np.int64).tobytes()]})
    top = ctw._top([type("R", (), r) for r in ctw._roots(t).to_pylist()])
    got = np.frombuffer(ctw._gram_scores(t, top).column("vals")[0].as_py(), np.float32)
    for k, g in zip(u, got, strict=True):
        total = 0.0
        for cx, node, bit in ways(k):
            rest, p = 1.0, 0.0
            for d in range(ctw.DEPTH + 1):
                key = cx & ((1 << 8 * d) - 1), node
                a = trees[d][key]
                w = weight[(d, *key)]
                p += rest * w * (a[bit] + 0.5) / (sum(a) + 1)
                rest *= 1 - w
            total += math.log10(p)
        assert g == pytest.approx(total, rel=1e-5)


def test_language_id(spark, docs, none):
    train = [(i, f"{a} {a} {b} der die und", "de", "s", 0, "") for i, (a, b) in enumerate([("haus", "baum"), ("straße", "schön")] * 40)]
    train += [(100 + i, f"{a} {b} the and of", "en", "s", 0, "") for i, (a, b) in enumerate([("house", "tree"), ("street", "nice")] * 40)]
    model = language_id.fit_model(spark.createDataFrame(train, SCHEMA))
    got = {r.row.text: r for r in language_id.identify(docs, model).collect()}
    assert {got[t].lang_pred for t in (None, "", "1234 5678 !!")} == {"und"} and got[""].rejected and got[""].score == 0
    assert got["der Bär läuft über die Straße und frißt"].lang_pred == "de" and got[BASE].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.fit_model(none)
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.identify(none, model).count() == 0


def test_license_scan(docs):
    got = license_scan.license_scan(docs).collect()
    assert len(got) == len(ROWS)
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w, at, labels = rx.findall((t or "").translate(LOW)), [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            here = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want[i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    by = {r.key: r for r in got if r.key is not None}
    assert by[11].labels == "gpl,gpl-2.0" and by[10].labels == "cc-by,mit" and by[7].labels == ""
    assert all(0 <= r.score <= 1 for r in got)


def test_sharding(docs):
    got = sharding.shard(docs, block_rows=1).collect()
    assert len(got) == len(ROWS)
    per = collections.defaultdict(list)
    for r in got:
        per[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert collections.Counter((r.key, r.size, r.text_crc32) for r in got) == want


def brute_targets(sizes, weights, budget, cap):
    """Share by weight, cap, share the excess again."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(budget)
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left, free = left - sum(out[i] for i in full), [i for i in free if i not in full]
    return out


def test_mixing_targets(spark):
    rng = np.random.default_rng(8)
    assert brute_targets([10, 1000, 1000], [5, 2, 1], 2010, 3)[0] == 30
    for _ in range(6):
        sizes = {s: int(n) for s, n in zip(["b", "a", "é", "z", None, "c"][: rng.integers(1, 7)], 10 ** rng.uniform(0, 4, 6), strict=False)}
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        share = float(rng.choice([0.3, 1.0, 2.0]))
        want = brute_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], share * sum(sizes.values()), 3)
        got = {r.source: r for r in mixing.source_plan(spark.createDataFrame(list(sizes.items()), "source string, size long"), (5, 2, 1), share, 3).collect()}
        assert [got[s].source_size for s in order] == [sizes[s] for s in order]
        assert [got[s].target for s in order] == pytest.approx(want)


def test_mixing(spark):
    rows = [(i if i % 9 else None, "w " * (i % 7), None, ["a", "b", None][i % 3], 0, "") for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, block_rows=50).collect()
    assert len(got) == 900 and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), block_rows=300).collect()), key=str)
    for s in ("a", "b", None):
        mine = [r for r in got if r.source == s]
        assert sum(r.size for r in mine) == mine[0].source_size and abs(sum(r.taken for r in mine) - mine[0].target) <= 14
    # plain weighted fair queueing over the written order of each queue
    sized, plan = mixing.mix_plan(df.withColumn("row", __import__("pyspark").sql.functions.monotonically_increasing_id()), block_rows=70)
    target, queues = {r.source: r for r in plan.collect()}, collections.defaultdict(list)
    for r in sized.collect():
        if r["size"]:
            queues[r.source].append(((r.h, r.key is not None, r.key or 0, r["size"], r.row), r["size"]))
    served = []
    for s, q in queues.items():
        cum = 0
        for k in range(3):
            for at, n in sorted(q):
                cum += n
                served.append((cum / target[s].target, s is not None, s or "", k, at, n))
    left, copies = sum(n for q in queues.values() for _, n in q), collections.Counter()
    for _, _, s, k, at, n in sorted(served):
        if n > left:
            break
        left -= n
        copies[at[-1]] += 1
    got = {r.row: r.copies for r in mixing.with_copies(sized, plan).collect()}
    assert {k: v for k, v in got.items() if v} == copies


def test_components(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(e, "u long, v long")).collect()}
    want = components(500, e)
    assert all(want[k] == v for k, v in got.items()) and {x for a, b in e if a != b for x in (a, b)} == set(got)


@pytest.mark.parametrize("crowd", [64, 2])
def test_near_dedup(spark, docs, crowd, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", crowd)
    rng = np.random.default_rng(2)
    texts = []
    for g in range(6):
        base = [f"w{g}x{k}" for k in rng.integers(0, 400, 120)]
        for _ in range(12):
            t = list(base)
            for k in rng.integers(0, 120, int(rng.integers(0, 9))):
                t[k] = f"z{rng.integers(0, 10**9)}"
            texts.append(" ".join(t))
    rows = ROWS + [(1000 + i, t, None, None, 0, "") for i, t in enumerate(texts)]
    got = minhash.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    sets = [shingles(r[1]) for r in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * (k := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - k)]
    comp = components(len(rows), edges)
    least = {}
    for (i, *_), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = collections.Counter((r[0], len(s), least.get(c, r[0])) for r, s, c in zip(rows, sets, comp, strict=True))
    assert collections.Counter((r.key, r.n_shingles, r.component_id) for r in got) == want


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 8)) * 0.15, x[:5], 2 * x[5:8]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * 8), (203, [1.0, None] + [0.0] * 6), (204, [float("nan")] * 8), (205, [1.0, 2.0]), (206, [1.0, 2.0]), (0, rows[0][1])]
    for block in (4096, 16):
        got = {(r.key, r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()}
        good = [(i, np.array(v)) for i, v in rows if v and i < 200 or i > 204]
        link = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
        n = [sum(link(v, w) for j, (_, w) in enumerate(good) if j != i) for i, (_, v) in enumerate(good)]
        comp = components(len(good), [(i, j) for i in range(len(good)) for j in range(i) if link(good[i][1], good[j][1])])
        least = {c: min(good[i][0] for i in range(len(good)) if comp[i] == c) for c in comp}
        want = {(i, k, least[c], least[c] == i) for (i, _), k, c in zip(good, n, comp, strict=True)} | {(i, 0, i, True) for i in range(200, 205)}
        assert got == want


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cols = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == cols and docs.count() > 0, name
    out = p.STAGES[-1][1](spark, docs, "")
    assert out.count() == docs.count()


def test_pipeline_keeps_rows_of_shared_and_null_ids(spark):
    import corpus_pipeline as p

    one = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(None, one(k)) for k in range(4)] + [(7, one(10)), (7, one(11)), (8, one(12))]
    rows += [(7, one(12)), (8, one(13)), (None, one(10).replace(" ", "\n")), (7, one(11)), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(3).cache()
    best = {}
    for i, t in rows:
        k, rank = re.sub(r"[\x20\x09-\x0D]", "", t or ""), (-len(t or ""), i is None, i or 0)
        if k not in best or rank < best[k][0]:
            best[k] = rank, i, t or ""
    want = collections.Counter((i, t) for _, i, t in best.values())
    got = p.drop_exact_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text or "") for r in got.collect()) == want

    # a near copy goes though its doc_id is that of a kept row, and the smallest doc_id stays (null last)
    near = [(7, one(20)), (3, one(20) + " more"), (7, one(21)), (None, one(22)), (None, one(22) + " more"), (None, one(23)), (9, one(23) + " more")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in near], docs.schema).repartition(3).cache()
    got = [(r.doc_id, r.text) for r in p.drop_near_copies(spark, docs, "").collect()]
    assert sorted((i, t) for i, t in got if i) == sorted([near[1], near[2], near[6]])
    assert len(got) == 4 and {t for i, t in got if i is None} < {near[3][1], near[4][1]}

    # one source under its target: every row is taken once, not once for each row of its doc_id
    got = p.mix_sources(spark, docs, "").collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(near)


def test_pieces_dictionary_shrinks():
    """A dictionary that drops pieces gives the results of one that keeps all."""
    import pyarrow as pa

    from strataq.llm.pieces import Pieces

    def encode(words):
        raw = [w.encode() for w in words]
        n = np.array([len(x) for x in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        return flat.astype(np.int32), n, flat, n

    rng, small = np.random.default_rng(3), Pieces(encode, 40)
    for _ in range(60):
        part = [f"p{k}" for k in np.minimum(rng.geometric(0.04, 60), 400)]
        ids, n, raw, m = small.of(pa.array(part))
        assert raw.tobytes().decode() == "".join(part) and n.tolist() == m.tolist() == [len(x) for x in part]
        assert ids.tolist() == list(raw) and (len(small.at) <= 40 or len(set(part)) > 40)
        assert list(small.at.values()) == list(range(len(small.lens))) and len(small.used) == len(small.lens)


def test_token_files_added_tokens(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    mark = "<|endoftext|>"
    texts = ["a <|endoftext|> b", mark, mark * 3, f"x{mark}y  {mark}\n\n{mark} z", f"{mark} \u0378 é 😀", "<|endoftext|", "< |endoftext|>", "<|ENDOFTEXT|>", "plain words", "", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    ids = token_files.encode_ids(df, "doc_id", "text", path, 0)
    got = {r.key: r for r in token_files.read_token_files(token_files.write_token_files(ids, [5], block_ids=10)).collect()}
    tok, start = Tokenizer.from_file(path), 0
    assert 50256 in tok.encode(texts[0], add_special_tokens=False).ids
    for i, t in rows:
        x = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())), t
        start += len(x)


def _some_match(tree, pick):
    """A text that the parsed regex matches; pick(n) chooses among n ways."""
    out = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "IN":
            out.append(chr(arg[pick(len(arg))][1]))
        elif op == "ANY":
            out.append("q")
        elif op == "SUBPATTERN":
            out.append(_some_match(arg[3], pick))
        elif op == "BRANCH":
            out.append(_some_match(arg[1][pick(len(arg[1]))], pick))
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += [_some_match(arg[2], pick) for _ in range(arg[0] + pick(min(int(arg[1]) - arg[0], 1) + 1))]
        else:
            assert op == "ASSERT", op
    return "".join(out)


def test_license_keywords_drop_nothing(spark):
    import random

    rng, texts = random.Random(5), ["This file is under MPL 2.0", "MPLv2", "Do What The Fuck You Want To Public License"]
    for _, _, kw, rx, _, _ in license_scan.rules():
        ways = {_some_match(re._parser.parse(rx), p) for p in (lambda n: 0, lambda n: n - 1, *[rng.randrange] * 4)}
        assert all(f" {kw}" in " " + w for w in ways), (kw, rx)
        texts += ["x " + w for w in sorted(ways)]
    got = {r.key: r.labels for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[1] == "mpl-2.0" and got[2] == "wtfpl"
    for i, t in enumerate(texts):
        j = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))) + " "
        # every rule, without the keywords; a span goes if one of at least its priority contains it
        spans = sorted((m.start(), -m.end(), -p, k, label) for k, label, _, rx, p, _ in license_scan.rules() for m in re.finditer(rx, j))
        kept = {s[4] for n, s in enumerate(spans) if not any(o[1] <= s[1] and o[2] <= s[2] for o in spans[:n])}
        kept |= {label for phrase, label in license_scan.BASE if f" {phrase} " in j}
        assert got[i] == ",".join(sorted(kept)), t


def test_license_clauses_with_long_names():
    holder = "university of california berkeley and lawrence livermore national laboratory"
    texts = {
        "bsd-3-clause": f" neither the name of the {holder} nor the names of its contributors may be used to endorse or promote products ",
        "proprietary": f" unauthorized copying of this file or of any part of it by anyone outside of {holder} is strictly prohibited ",
    }
    for label, t in texts.items():
        assert label in {r[1] for r in license_scan.rules() if re.search(r[3], t)}


def test_long_pieces(spark):
    import random

    import public_tokenizers as P
    import tiktoken

    worker = bpe.DuckBpe(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=worker.ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choice(parts) for _ in range(n)) for n in (257, 300, 3000) for parts in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "=", ["the", "ing", "--", "é", "x"])]
    ids, lens = worker.encode_pieces(["x", *words, "hello"])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])] == [enc._core_bpe.encode_single_piece(w.encode()) for w in ["x", *words, "hello"]]


def test_identify_with_clashing_names(spark):
    import corpus_pipeline as p

    rows = [(i, "the cat and the dog of the house", "en", "a", True, 0.5, "x", 2, 3, "k") for i in range(40)]
    rows += [(100 + i, "der hund und die katze", "de", "b", True, 0.5, "x", 2, 3, "k") for i in range(40)] + [(None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rejected boolean, score double, lang_pred string, copies int, _row long, k1 string")
    out = p.identify_language(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 80
    assert p.mix_sources(spark, docs, "").columns == docs.columns and p.drop_exact_copies(spark, docs, "").count() == 3
