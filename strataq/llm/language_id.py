"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords: hashed byte n-grams
(1 to 4, with word marks) of its lower-cased white-space words. A linear
softmax gives the languages. Embeddings and weights are trained together by
stochastic gradient descent in numpy, in one task, on a bounded sample of the
labelled rows: at most SAMPLE_PER_LANG documents of up to SAMPLE_DOC_BYTES bytes in each of the MOST_LANGS most
frequent languages, drawn by a hash of key and text. Only the weights (BUCKETS numbers a language) reach the driver.
A fifth of the sample is set aside: it fits the softmax temperature and the
rejection threshold.

Because the model is linear after averaging, a word adds a fixed vector of
logits; each batch scores its distinct words once and sums over documents. All
of every text counts.

Rejection: a document is rejected when it has no letter, or when its
calibrated probability is under the threshold, which is set so that at most
`reject_share` of the set-aside documents fall under it (and never above
`most_threshold`).

Defined results: null text or a text without a letter gives `und`, score 0,
rejected; repeated rows give equal results; an empty table gives an empty
result, and a table without labels gives `und` everywhere; the key picks the
sample only; other columns are not read for predictions, and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, mix64, stable_key, text_or_empty, tidy

SAMPLE_PER_LANG = 500
SAMPLE_DOC_BYTES = 1 << 20
MOST_LANGS = 100
#: Distinct words whose subwords are expanded together: bounds a worker's memory.
WORDS_AT_ONCE = 20_000
BUCKETS = 1 << 14
DIM = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every subword of every word, number of subwords by word)."""
    col = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), words.cast(pa.large_string()), pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]].astype(np.uint64)
    offs = offs - offs[0]
    n = np.diff(offs)
    word = np.repeat(np.arange(len(n)), n)
    left = offs[1:][word] - np.arange(len(data))  # bytes from here to the word's end
    grams, owners, h = [], [], np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, 5):
            at = np.flatnonzero(left >= k)
            h[at] = mix64(h[at] * _MIX + data[at + k - 1] + np.uint64(k))
            grams.append((h[at] & np.uint64(BUCKETS - 1)).astype(np.int32))
            owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], np.bincount(owner, minlength=len(n))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in turn, offsets by text)."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    offs = lists.offsets.to_numpy().astype(np.int64)
    return lists.values[offs[0] : offs[-1]], offs - offs[0]


def _word_sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    z = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(lens)
    return z[ends] - z[ends - lens]


class Model:
    def __init__(self, langs: list[str]) -> None:
        self.langs, self.logits, self.bias, self.temperature, self.threshold = langs, np.zeros((BUCKETS, len(langs))), np.zeros(len(langs)), 1.0, 0.0

    def raw(self, texts: pa.Array) -> np.ndarray:
        """Logits of each text: the average over its subwords, plus the bias."""
        flat, offs = _words(texts)
        d = flat.dictionary_encode()
        out = np.zeros((len(texts), len(self.langs)))
        if len(d.dictionary):
            per = np.empty((len(d.dictionary), len(self.langs) + 1))
            for a in range(0, len(per), WORDS_AT_ONCE):
                grams, n = subwords(d.dictionary[a : a + WORDS_AT_ONCE])
                per[a : a + len(n), :-1] = _word_sums(self.logits[grams], n)
                per[a : a + len(n), -1] = n
            z = np.concatenate([np.zeros((1, per.shape[1])), np.cumsum(per[d.indices.to_numpy(zero_copy_only=False)], axis=0)])
            s = z[offs[1:]] - z[offs[:-1]]
            out = s[:, :-1] / np.maximum(s[:, -1:], 1)
        return out + self.bias

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        z = self.raw(texts) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        p = z / z.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def _features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares of the subwords) of each text."""
    out = []
    flat, offs = _words(texts)
    for i in range(len(texts)):
        d = flat[offs[i] : offs[i + 1]].dictionary_encode()
        c = np.bincount(d.indices.to_numpy(zero_copy_only=False), minlength=len(d.dictionary))
        x = np.zeros(BUCKETS)
        for a in range(0, len(c), WORDS_AT_ONCE):
            g, n = subwords(d.dictionary[a : a + WORDS_AT_ONCE])
            x += np.bincount(g, weights=np.repeat(c[a : a + len(n)], n), minlength=BUCKETS)
        at = np.flatnonzero(x)
        out.append((at.astype(np.uint16), (x[at] / max(x.sum(), 1)).astype(np.float32)))
    return out


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 2.0, seed: int = 5, reject_share: float = 0.001, most_threshold: float = 0.6) -> Model:
    """Fit embeddings and softmax by SGD on _features(), then temperature and threshold on a set-aside fifth."""
    langs = sorted(set(labels))
    model = Model(langs)
    if not langs:
        return model
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    aside, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if len(fit) == 0:
        fit = order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    x = np.zeros((batch, BUCKETS), np.float32)
    steps, done = epochs * -(-len(fit) // batch), 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for k in range(0, len(fit), batch):
            rows = fit[k : k + batch]
            x[:] = 0
            for r, i in enumerate(rows):
                x[r, docs[i][0]] = docs[i][1]
            xb = x[: len(rows)]
            h = xb @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            lr = rate * (1 - done / steps)
            down = p @ out.T
            out -= lr * (h.T @ p)
            bias -= lr * p.sum(axis=0)
            emb -= lr * 30 * (xb.T @ down)
            done += 1
    model.logits, model.bias = emb @ out, bias.astype(np.float64)
    held = aside if len(aside) else fit
    z = np.stack([docs[i][1] @ model.logits[docs[i][0]] + model.bias for i in held])
    t = y[held]

    def loss(temp: float) -> float:
        q = z / temp
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(t)), t]).mean())

    model.temperature = min((float(x) for x in np.geomspace(0.2, 5, 33)), key=loss)
    q = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
    right = (q / q.sum(axis=1, keepdims=True)).max(axis=1)
    model.threshold = min(most_threshold, 0.95 * float(np.quantile(right, reject_share)))
    return model


def sample(df: DataFrame, key: str, text: str, lang: str, where: Column, per_lang: int) -> DataFrame:
    """(l, u, t): per_lang labelled rows of each language (all, if it has fewer), by a hash of key and text."""
    t = F.col(text)
    u = F.xxhash64(stable_key(F.col(key)), t, F.lit(11))
    rows = df.where(where & F.col(lang).isNotNull() & t.isNotNull() & (F.octet_length(t) <= SAMPLE_DOC_BYTES)).select(F.col(lang).cast("string").alias("l"), u.alias("u"), t.alias("t"))
    count = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGS).collect()
    # equal rows have one u and count once, so a repeated row cannot swell the sample
    at_most = {r.l: int(-(2**63) + min(1.0, 1.5 * per_lang / r["count"] + 20 / r["count"]) * (2**64 - 2**11)) for r in count}
    if not at_most:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for kv in sorted(at_most.items()) for x in kv])
    few = rows.where(F.col("u") <= F.element_at(share, F.col("l"))).dropDuplicates(["l", "u"])
    return few.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("u"))).where(F.col("n") <= per_lang).drop("n")


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def fit_model(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> Model:
    """The model of the rows that are not held out, trained in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels, marks = [], [], []
        for batch in batches:
            for i, j in byte_slices(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False), 1 << 20):
                docs += _features(batch.column(2)[i:j])
            labels += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        order = sorted(range(len(docs)), key=lambda i: (labels[i], marks[i]))
        m = train([docs[i] for i in order], [labels[i] for i in order])
        cols = [[m.langs], [m.logits.astype(np.float32).tobytes()], [m.bias.tolist()], [m.temperature], [m.threshold]]
        kinds = [pa.list_(pa.string()), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.float64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["langs", "logits", "bias", "temperature", "threshold"])

    rows = sample(df, key, text, lang, F.coalesce(~held_out(F.col(key)), F.lit(False)), per_lang)
    got = rows.coalesce(1).mapInArrow(lambda it: tidy(run(it)), "langs array<string>, logits binary, bias array<double>, temperature double, threshold double").collect()
    model = Model([])
    if got and got[0].langs:
        model = Model(list(got[0].langs))
        model.logits = np.frombuffer(bytes(got[0].logits), np.float32).reshape(BUCKETS, -1)
        model.bias, model.temperature, model.threshold = np.array(got[0].bias), got[0].temperature, got[0].threshold
    return model


def predicted(model: Model, text: str | Column = "text", slice_bytes: int = 1 << 20) -> Column:
    """struct<lang_pred, score, rejected> of a text column. Only the text is an input of the prediction."""
    t = text_or_empty(text)
    out = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def answers(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = np.array([*model.langs, "und"], object)
        for texts, letters in batches:
            has = letters.to_numpy(zero_copy_only=False).astype(bool)
            best, p = np.zeros(len(texts), int), np.zeros(len(texts))
            if model.langs:
                for i, j in byte_slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), slice_bytes):
                    best[i:j], p[i:j] = model.predict(texts[i:j])
            ok = has & bool(model.langs)
            best, p = np.where(ok, best, len(model.langs)), np.where(ok, p, 0.0)
            cols = [pa.array(names[best], pa.string()), pa.array(p), pa.array(~ok | (p < model.threshold))]
            yield pa.StructArray.from_arrays(cols, fields=list(out))

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from tidy(answers(batches))

    return predict(t, t.rlike(r"\p{L}"))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """row (a struct of all columns of df, whatever their names), lang_pred, score, rejected."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), predicted(model, text).alias("p")).select("row", "p.lang_pred", "p.score", "p.rejected")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = docs.select("doc_id", predicted(fit_model(docs)).alias("p"))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "p.lang_pred", "p.score", "p.rejected")
