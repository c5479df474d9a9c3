"""Splitting text into pieces, and per-worker dictionaries of encoded pieces.

Byte-level BPE works on each piece by itself, so a distinct piece needs to be
encoded once. The JVM splits texts; a Python worker numbers the pieces, some
PIECES_AT_ONCE at a time, and encodes only those that its dictionary lacks.
Texts with code points that Java does not know and texts of over LONG_TEXT bytes are
left to Python, which splits them in stretches. When the dictionary would hold
more than `most` pieces, those that came once only go, and the least used beyond half of it:
that changes speed only, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import byte_slices, ragged_take, text_or_empty

#: Pieces that a worker holds at once unless told otherwise: bounds its memory.
PIECES_AT_ONCE = 300_000
#: Texts of more bytes than this are not split in the JVM.
LONG_TEXT = 4 << 20
#: Unicode's White_Space, as \s of the tokenizer libraries.
_SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
#: The byte-level split pattern in Java's syntax; runs that nothing follows are possessive.
JAVA_PATTERN = rf"'(?:[stmd]|re|ve|ll)| ?\p{{L}}++| ?\p{{N}}++| ?[^{_SPACE}\p{{L}}\p{{N}}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def split(text: str) -> tuple[Column, Column]:
    """(array<string> of the pieces in order, text left to Python): one of the two is null. A null text has no pieces."""
    t = text_or_empty(text)
    left = (F.octet_length(t) > LONG_TEXT) | ((F.octet_length(t) != F.char_length(t)) & t.rlike(r"\p{Cn}"))  # ASCII texts need no search
    return F.when(~left, F.regexp_extract_all(t, F.lit(JAVA_PATTERN), F.lit(0))), F.when(left, t)


class Pieces:
    """Dictionary of pieces: ids (int32) and, if the encoder gives them, decoded bytes, both ragged."""

    def __init__(self, encode: Callable, most: int = 200_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids, self.lens = np.empty(0, np.int32), np.empty(0, np.int64)
        self.raw, self.raw_lens = np.empty(0, np.uint8), np.empty(0, np.int64)
        self.used = np.empty(0, np.int64)  # slices that had the piece

    def shrink(self) -> None:
        """Keep pieces of two slices or more, the most used ones up to half of the room."""
        order = np.argsort(-self.used, kind="stable")[: self.most // 2]
        stay = np.sort(order[self.used[order] > 1])
        words = list(self.at)
        self.at = {words[k]: i for i, k in enumerate(stay.tolist())}
        ends, raw_ends = np.cumsum(self.lens), np.cumsum(self.raw_lens)
        self.ids = ragged_take(self.ids, (ends - self.lens)[stay], self.lens[stay])
        self.raw = ragged_take(self.raw, (raw_ends - self.raw_lens)[stay], self.raw_lens[stay])
        self.lens, self.raw_lens, self.used = self.lens[stay], self.raw_lens[stay], self.used[stay]

    def of(self, flat: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, ids in each, decoded bytes of all, bytes in each)."""
        d = flat.dictionary_encode()
        words = d.dictionary.to_numpy(zero_copy_only=False).tolist()  # far quicker than to_pylist()
        num = np.array([self.at.get(w, -1) for w in words], np.int64)
        new = [words[i] for i in np.flatnonzero(num < 0).tolist()]
        if self.at and len(self.at) + len(new) > self.most:
            self.shrink()
            if len(self.at) + sum(w not in self.at for w in words) > self.most:
                self.clear()
            num = np.array([self.at.get(w, -1) for w in words], np.int64)
            new = [words[i] for i in np.flatnonzero(num < 0).tolist()]
        if new:
            ids, lens, raw, raw_lens = self.encode(new)
            base = len(self.at)
            num[num < 0] = np.arange(base, base + len(new))
            self.at.update(zip(new, range(base, base + len(new)), strict=True))
            self.ids, self.lens = np.concatenate([self.ids, ids]), np.concatenate([self.lens, lens])
            self.raw, self.raw_lens = np.concatenate([self.raw, raw]), np.concatenate([self.raw_lens, raw_lens])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.int64)
        self.used[num] += 1
        k = d.indices.to_numpy(zero_copy_only=False)
        n = self.lens[num][k]
        ids = ragged_take(self.ids, (np.cumsum(self.lens) - self.lens)[num][k], n)
        if not len(self.raw):
            return ids, n, self.raw, np.zeros(len(k), np.int64)
        m = self.raw_lens[num][k]
        return ids, n, ragged_take(self.raw, (np.cumsum(self.raw_lens) - self.raw_lens)[num][k], m), m


def encoded(lists: pa.ListArray, known: Pieces, at_once: int = PIECES_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, decoded bytes) of each list of pieces in turn; a null list has none."""
    for a, b in byte_slices(pc.coalesce(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False) + 1, at_once):
        offs = lists[a:b].offsets.to_numpy().astype(np.int64)
        ids, n, raw, m = known.of(lists.values[offs[0] : offs[-1]])
        i, j = (np.concatenate([[0], np.cumsum(x)])[offs - offs[0]] for x in (n, m))
        for k in range(b - a):
            yield ids[i[k] : i[k + 1]], raw[j[k] : j[k + 1]]


def encoded_here(text: str, rx, known: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids, decoded bytes) of a text that Python splits, in stretches of PIECES_AT_ONCE pieces."""
    it, ids, raw = (m.group() for m in rx.finditer(text)), [np.empty(0, np.int32)], [np.empty(0, np.uint8)]
    while part := list(islice(it, PIECES_AT_ONCE)):
        got = known.of(pa.array(part, pa.string()))
        ids.append(got[0])
        raw.append(got[2])
    return np.concatenate(ids), np.concatenate(raw)
