"""Byte-level BPE encoding and decoding with DuckDB's recursive queries.

A Python worker keeps one DuckDB connection with two tables made from a rank
file: `merges` (left id, right id, merged id: every split of a token into two
tokens) and `vocab` (id, bytes as hex). The pieces that a batch has and the
worker has not seen become token-position rows, one per byte; the recursive
query joins neighbours with `merges` and contracts the leftmost pair of
minimum rank in every piece, until no piece has a pair left. A piece that is
a token itself is that token. Ordered aggregation over positions joins the ids' bytes again.

Each task works on its own rows only and holds no state that another task
needs, so a lost executor costs its tasks only.

Defined results: null text counts as empty and gives no ids; repeated rows
give repeated results; an empty table gives an empty result; other columns
are not read. Whole texts are encoded, however long; a piece of over LONG_PIECE
bytes (a run of letters without a break) goes in windows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, give_back, ragged_take
from .pieces import Pieces, encoded, encoded_here, split

#: Ids that decode() joins at once: bounds a worker's memory.
IDS_AT_ONCE = 1 << 20
#: Pieces of more bytes than this are encoded in windows of a fourth of it.
LONG_PIECE = 256
#: Pieces that a worker holds at once, beside DuckDB's tables.
PIECES_AT_ONCE = 300_000
_workers: dict[str, "DuckBpe"] = {}

#: Contract the leftmost minimum-rank pair of every live piece, until none has one.
#: A row is (piece, position, token, position and token of the next row); k orders pairs by rank, then position.
_ENCODE = """
with recursive s(w, p, t, q, nt, live) as (
  select w, p, t, lead(p) over o, lead(t) over o, true from byte_rows window o as (partition by w order by p)
  union all
  select w, p, t, q, nt, live from (
    with pairs as (
      select s.w, s.p, s.t, s.q, s.nt, g.m, case when g.m is not null then g.m::bigint * 4294967296 + s.p end as k
      from s left join merges g on g.l = s.t and g.r = s.nt where s.live
    ),
    least as (select w, min(k) as k from pairs group by w),
    turn as (
      select a.w, a.p, a.q, a.m, n.q as q2, n.nt as nt2
      from least join pairs a on a.w = least.w and a.k = least.k join pairs n on n.w = a.w and n.p = a.q
    )
    select a.w, a.p, case when a.p = c.p then c.m else a.t end as t, case when a.p = c.p then c.q2 else a.q end as q,
      case when a.p = c.p then c.nt2 when a.q = c.p then c.m else a.nt end as nt, c.w is not null as live
    from pairs a left join turn c on a.w = c.w
    where c.q is null or a.p <> c.q
  )
)
select w, t from s where not live order by w, p
"""
_DECODE = "select w, string_agg(hex, '' order by p) as hex from id_rows join vocab using (t) group by w order by w"


class DuckBpe:
    def __init__(self, path: str) -> None:
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        l, r, m = [], [], []
        for b, i in ranks.items():
            for k in range(1, len(b)):
                x, y = ranks.get(b[:k]), ranks.get(b[k:])
                if x is not None and y is not None:
                    l.append(x)
                    r.append(y)
                    m.append(i)
        self.n_bytes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        self.n_bytes[list(ranks.values())] = [len(x) for x in ranks]
        self.ranks, self.of_byte = ranks, np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        # temp_directory: nothing spills to a folder of the worker's
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        i32 = pa.int32()
        self._table("merges", l=pa.array(l, i32), r=pa.array(r, i32), m=pa.array(m, i32))
        self._table("vocab", t=pa.array(list(ranks.values()), i32), hex=pa.array([b.hex() for b in ranks]))

    def _table(self, name: str, **cols) -> None:
        self.db.register("_in", pa.table(cols))
        self.db.execute(f"create or replace table {name} as select * from _in")
        self.db.unregister("_in")

    def encode_pieces(self, words: list[str], at_once: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids in each). Words of like length go together, as they take like rounds."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        long = [k for k in np.flatnonzero(size > LONG_PIECE).tolist() if raw[k] not in self.ranks]
        order = np.argsort(size, kind="stable")
        order = order[~np.isin(order, long)]
        ids, lens = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for i in range(0, len(order), at_once):
            a, b = self._encode([raw[k] for k in order[i : i + at_once].tolist()])
            ids.append(a)
            lens.append(b)
        for k in long:
            ids.append(self._encode_long(raw[k]))
            lens.append(np.array([len(ids[-1])], np.int64))
        ids, lens, back = np.concatenate(ids), np.concatenate(lens), np.argsort(np.concatenate([order, long]).astype(np.int64))
        return ragged_take(ids, (np.cumsum(lens) - lens)[back], lens[back]), lens[back]

    def _encode(self, words: list[bytes], whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids in each); with `whole`, a word that is a token is that token."""
        known = np.array([self.ranks.get(w, -1) if whole else -1 for w in words], np.int32)
        rest = np.flatnonzero(known < 0)
        n = np.array([len(words[i]) for i in rest], np.int64)
        w = np.repeat(rest.astype(np.int32), n)
        p = np.arange(len(w), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        t = self.of_byte[np.frombuffer(b"".join(words[i] for i in rest), np.uint8)]
        done = np.flatnonzero(known >= 0)
        if len(rest):
            self._table("byte_rows", w=w, p=p.astype(np.int32), t=t)
            got = self.db.execute(_ENCODE).fetchnumpy()
            w = np.concatenate([np.asarray(got["w"]), done])
            t = np.concatenate([np.asarray(got["t"]), known[done]])
        else:
            w, t = done, known[done]
        order = np.argsort(w, kind="stable")
        return t[order].astype(np.int32), np.bincount(w, minlength=len(words)).astype(np.int64)

    def _spans(self, word: bytes, at: list[tuple[int, int]]) -> list[np.ndarray]:
        """The tokens of word[a:b] for each (a, b), as rows (start, end, id)."""
        ids, n = self._encode([word[a:b] for a, b in at], whole=False)
        out = []
        for (a, _), x in zip(at, np.split(ids, np.cumsum(n)[:-1]), strict=True):
            end = a + np.cumsum(self.n_bytes[x])
            out.append(np.stack([end - self.n_bytes[x], end, x.astype(np.int64)], axis=1))
        return out

    def _encode_long(self, word: bytes, window: int = LONG_PIECE // 4) -> np.ndarray:
        """The ids of a long piece, in time that grows with its length.

        Merges inside a stretch whose ends no merge crosses are those of the stretch alone. So a row of tokens is
        the encoding of its bytes exactly if every two neighbours are the encoding of theirs. Windows are encoded
        apart, and around each cut a span that reaches into both sides; where a window and a span hold the same token
        at the same place, the row may pass from one to the other. A cut without such tokens on both sides is
        tried with other spans, then all of it with wider windows.
        """
        if window >= len(word):
            return self._encode([word], whole=False)[0]
        cuts = list(range(window, len(word), window))
        parts = self._spans(word, list(zip([0, *cuts], [*cuts, len(word)], strict=True)))
        joins: list = [None] * len(cuts)
        for reach in (window // 2, window // 4, window // 8):
            open_ = [i for i in range(len(cuts)) if joins[i] is None]
            # a span begins and ends where a token of its window does, so that it is in step with it
            begin = [int(parts[i][np.searchsorted(parts[i][:-1, 0], cuts[i] - reach), 0]) for i in open_]
            end = [int(parts[i + 1][np.searchsorted(parts[i + 1][:-1, 1], cuts[i] + reach), 1]) for i in open_]
            for i, m in zip(open_, self._spans(word, list(zip(begin, end, strict=True))) if open_ else (), strict=True):
                rows = {tuple(x): k for k, x in enumerate(m.tolist())}
                left = next((k for k in range(len(parts[i]) - 1, -1, -1) if tuple(parts[i][k].tolist()) in rows), None)
                right = next((k for k, x in enumerate(parts[i + 1].tolist()) if tuple(x) in rows), None)
                if left is not None and right is not None:
                    a, b = rows[tuple(parts[i][left].tolist())], rows[tuple(parts[i + 1][right].tolist())]
                    joins[i] = left, m[a + 1 : b + 1, 2], right
        first, out = 0, []
        for i, j in enumerate(joins):
            if j is None or j[0] + 1 < first:
                return self._encode_long(word, 4 * window)
            out += [parts[i][first : j[0] + 1, 2], j[1]]
            first = j[2] + 1
        return np.concatenate([*out, parts[-1][first:, 2]]).astype(np.int32)

    def decode_rows(self, ids: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids, joined in order of position."""
        w = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
        p = np.arange(len(ids), dtype=np.int64) - np.repeat(np.cumsum(lens) - lens, lens)
        self._table("id_rows", w=w, p=p.astype(np.int32), t=ids.astype(np.int32))
        out = [b""] * len(lens)
        for i, h in self.db.execute(_DECODE).fetchall():
            out[i] = bytes.fromhex(h)
        return out

    def encode(self, words: list[str]):
        ids, lens = self.encode_pieces(words)
        raw = self.decode_rows(ids, lens)
        return ids, lens, np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)


def worker(path: str) -> tuple[DuckBpe, Pieces]:
    if path not in _workers:
        bpe = DuckBpe(path)
        _workers[path] = (bpe, Pieces(bpe.encode))
    return _workers[path]


def rank_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _map_pieces(df: DataFrame, key: str, text: str, row, out: str, path: str, pattern: str) -> DataFrame:
    """row(ids, raw) -> further values of one document."""
    pieces, left = split(text)
    rows = df.select(F.col(key).alias("key"), pieces.alias("pieces"), left.alias("left"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        rx, (_, known) = regex.compile(pattern), worker(path)
        for batch in batches:
            here = (encoded_here(t.as_py(), rx, known) if t.is_valid else None for t in batch.column(2))
            got = [row(*(h or x)) for x, h in zip(encoded(batch.column(1), known, PIECES_AT_ONCE), here, strict=True)]
            cols = zip(*got, strict=True) if batch.num_rows else ((),) * len(names)
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["key", *names])
            del batch, here, got, cols  # before the next batch comes, and what earlier operators left in this worker
            give_back()

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    more = to_arrow_schema(T.StructType.fromDDL(out))
    names, kinds = more.names, more.types
    return rows.mapInArrow(run, f"key {kind}, {out}")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, ids array<int>."""
    return _map_pieces(df, key, text, lambda ids, raw: (ids,), "ids array<int>", path or rank_path(), pattern or split_pattern())


def decode(df: DataFrame, key: str = "key", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key, bytes binary: the bytes of each row's ids (null ids: null)."""
    path = path or rank_path()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = worker(path)
        for batch in batches:
            lens = np.array([len(x) if x.is_valid else 0 for x in batch.column(1)], np.int64)
            for i, j in byte_slices(lens, IDS_AT_ONCE):
                col = batch.column(1)[i:j]
                raw = bpe.decode_rows(col.flatten().to_numpy(zero_copy_only=False).astype(np.int32), lens[i:j])
                yield pa.record_batch([batch.column(0)[i:j], pa.array([r if v else None for r, v in zip(raw, col.is_valid().to_pylist(), strict=True)], pa.binary())], names=["key", "bytes"])

    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, bytes binary")


def encode_digest(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """key, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (bytes of the ids)."""

    def row(ids: np.ndarray, raw: np.ndarray):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw.tobytes()).hexdigest()

    return _map_pieces(df, key, text, row, "n_tokens long, ids_sha256 string, decoded_sha256 string", path or rank_path(), pattern or split_pattern())


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("key", "doc_id")
