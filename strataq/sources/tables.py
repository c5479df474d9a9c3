"""The id tables of containers as DataFrames.

Files are read by Spark's binaryFile source and scanned in Arrow batches: one row per logical dex with its verdict. Every
table is a further pass over the accepted dexes; each file is one task's work, so tables grow with files. A file is held whole by
its task (the source's limit of 2 GB a file holds). Dex numbers are dense over the accepted dexes in the order of (source, entry, slice).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.operators import dataflow, smali

from . import container, opcodes
from .dexfile import NO_INDEX, Dex
from .verifier import verify

#: Dexes that one session may number.
MOST_DEXES = 1 << 16
_SCAN = "source string, format string, is_apk boolean, has_manifest boolean, dex_count int, entry_ord int, entry string, slice_ord int, offset long, size long, valid boolean, reason string, bytes binary"
_SIBLING = "another dex in this v41 container failed verification, and a container dex cannot be loaded apart from its siblings"


def _arrow(ddl: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)
    return schema, to_arrow_schema(schema)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def image_verdicts(image: bytes, lenient: bool = False) -> list[tuple[int, int, str, bytes]]:
    """(offset, size, reason, bytes) of each logical dex; a container's dexes fall together."""
    got = []
    for off, size in container.slices(image):
        alone = int.from_bytes(image[off + 36 : off + 40], "little") < 120
        got.append((off, size, verify(image, off, lenient), alone))
    bad = any(r for _, _, r, _ in got)
    out = []
    for off, size, reason, alone in got:
        if bad and not reason and not alone:
            reason = _SIBLING
        out.append((off, size, reason, image[off : off + size] if alone else image))
    return out or [(0, 0, container.NO_SLICE, b"")]


def scan(spark: SparkSession, paths: list[str], lenient: bool = False) -> DataFrame:
    """One row per logical dex (one with slice_ord -1 for a file without images)."""
    schema, arrow = _arrow(_SCAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                facts = container.identify(raw)
                head = (path, facts["format"], facts["is_apk"], facts["has_manifest"], facts["dex_count"])
                images = container.images(raw)
                if not images:
                    yield _rows(arrow, [(*head, -1, "", -1, 0, 0, False, "no dex image", None)])
                for k, (entry, image) in enumerate(images):
                    for j, (off, size, reason, part) in enumerate(image_verdicts(image, lenient)):
                        yield _rows(arrow, [(*head, k, entry, j, off, size, not reason, reason, part if not reason else None)])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, schema)


class Session:
    """Containers in a given order, scanned once into the folder `at`; tables are DataFrames of (dex_id, ...)."""

    def __init__(self, spark: SparkSession, paths: list[str], at: str, lenient: bool = False) -> None:
        if not paths:
            raise ValueError("no sources")
        self.spark, self.at = spark, at
        scan(spark, paths, lenient).write.mode("overwrite").parquet(f"{at}/scan")
        self.scan = spark.read.schema(T.StructType.fromDDL(_SCAN)).parquet(f"{at}/scan")
        order = spark.createDataFrame([(p.rstrip("/").split("/")[-1], i) for i, p in enumerate(paths)], "file string, source_ord int")
        facts = self.scan.drop("bytes").withColumn("file", F.substring_index("source", "/", -1)).join(F.broadcast(order), "file").drop("file")
        # numbers only over verdicts, never over bytes: a session has at most MOST_DEXES of them
        place = Window.orderBy("source_ord", "entry_ord", "slice_ord")
        n = F.when(F.col("valid"), F.sum(F.col("valid").cast("int")).over(place) - 1)
        known = facts.withColumn("dex_id", n).withColumn("valid", F.col("valid") & (n < MOST_DEXES))
        known.withColumn("dex_id", F.when(F.col("valid"), F.col("dex_id")).otherwise(-1)).write.mode("overwrite").parquet(f"{at}/verdicts")
        self.verdicts = spark.read.parquet(f"{at}/verdicts")
        empty = self.verdicts.groupBy("source").agg(F.max("valid").alias("ok")).where("not ok").limit(1).collect()
        if empty:
            raise ValueError(f"no dex of {empty[0].source} can be loaded")

    def sources(self) -> DataFrame:
        return self.verdicts.select("source_ord", "source", "format", "is_apk", "has_manifest", "dex_count").distinct()

    def verify_report(self) -> DataFrame:
        return self.verdicts.select("dex_id", F.when(F.col("entry") == "", F.col("source")).otherwise(F.col("entry")).alias("name"), "valid", "reason", "source")

    def dex(self) -> DataFrame:
        """dex_id, source, entry, offset, size, bytes of the accepted dexes."""
        key = ["source", "entry_ord", "slice_ord"]
        ids = self.verdicts.where("dex_id >= 0").select("dex_id", *key)
        return self.scan.where("valid").join(ids, key).select("dex_id", "source", "entry", "offset", "size", "bytes")

    def table(self, ddl: str, rows: Callable[[Dex], Iterator[tuple]]) -> DataFrame:
        """dex_id and the columns of ddl: rows of every accepted dex."""
        schema, arrow = _arrow("dex_id int, " + ddl)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    dex_id, image, off = (batch.column(k)[i].as_py() for k in range(3))
                    head = off if image[:4] == b"dex\n" and len(image) > off and int.from_bytes(image[36:40], "little") >= 120 else 0
                    part = []
                    for r in rows(Dex(image, head)):
                        part.append((dex_id, *r))
                        if len(part) == 10_000:
                            yield _rows(arrow, part)
                            part = []
                    yield _rows(arrow, part)

        return self.dex().select(F.col("dex_id").cast("int"), "bytes", "offset").mapInArrow(run, schema)

    def strings(self) -> DataFrame:
        return self.table("string_id int, raw binary, value string", lambda d: ((i, d.raw(i), d.strings[i]) for i in range(d.n_strings)))

    def types(self) -> DataFrame:
        return self.table("type_id int, descriptor string", lambda d: iter(enumerate(d.types)))

    def fields(self) -> DataFrame:
        return self.table("field_id int, class_desc string, name string, type string", lambda d: ((i, *f) for i, f in enumerate(d.fields)))

    def methods(self) -> DataFrame:
        return self.table("method_id int, class_desc string, name string, proto string", lambda d: ((i, *m) for i, m in enumerate(d.methods)))

    def classes(self) -> DataFrame:
        def rows(d: Dex) -> Iterator[tuple]:
            for i in range(d.n_classes):
                cls, flags, sup, ifaces, src, *_ = d.class_def(i)
                yield cls, d.types[cls], flags, None if sup == NO_INDEX else d.types[sup], d.type_list(ifaces), None if src == NO_INDEX else d.strings[src]

        return self.table("type_id int, descriptor string, access_flags int, super string, interfaces array<string>, source_file string", rows)

    def members(self) -> DataFrame:
        def rows(d: Dex) -> Iterator[tuple]:
            for i in range(d.n_classes):
                c = d.class_def(i)
                for kind, k, flags, code in d.members(c[6]):
                    yield d.types[c[0]], kind, k, d.field_signature(k) if kind.endswith("field") else d.method_signature(k), flags, code > 0

        return self.table("class_desc string, kind string, member_id int, signature string, access_flags int, has_code boolean", rows)

    def static_strings(self) -> DataFrame:
        """Strings in initial values of static fields, nested ones too."""

        def found(d: Dex, v) -> Iterator[str]:
            if isinstance(v, tuple) and v[0] == "string":
                yield d.strings[v[1]]
            for x in v if isinstance(v, list) else v["elements"].values() if isinstance(v, dict) else ():
                yield from found(d, x)

        def rows(d: Dex) -> Iterator[tuple]:
            for i in range(d.n_classes):
                c = d.class_def(i)
                for pos, s in enumerate(s for v in d.static_values(c[7]) for s in found(d, v)):
                    yield d.types[c[0]], pos, s

        return self.table("class_desc string, pos int, value string", rows)

    def insns(self) -> DataFrame:
        """Instructions with an index: caller, byte offset, opcode, table and resolved text."""

        def rows(d: Dex) -> Iterator[tuple]:
            for caller, k, code, _ in bodies(d):
                at, units = 0, code["insns"]
                while at < len(units) and (w := opcodes.width(units, at)):
                    kind, i = d.operand(units, at) if units[at] not in (0x0100, 0x0200, 0x0300) else ("", 0)
                    if kind:
                        yield k, caller, 2 * at, units[at] & 0xFF, kind, d.resolved(kind, i)
                    at += w

        return self.table("method_id int, caller string, offset int, opcode int, kind string, ref string", rows)

    def call_sites(self) -> DataFrame:
        """One row per invoke instruction."""
        op = F.col("opcode")
        calls = op.between(0x6E, 0x72) | op.between(0x74, 0x78) | op.isin(0xFA, 0xFB)
        return self.insns().where(calls).select("dex_id", "method_id", "caller", "offset", "opcode", F.col("ref").alias("callee"))

    def call_args(self, depth: int = 2) -> DataFrame:
        """Call sites with the origin of every argument register."""

        def rows(d: Dex) -> Iterator[tuple]:
            for caller, k, code, flags in bodies(d):
                params = d.protos[_proto_of(d, k)][0]
                for s in dataflow.resolve(d, code, params, bool(flags & 0x8), depth):
                    yield k, caller, s["offset"], s["opcode"], s["callee"], s["args"]

        return self.table("method_id int, caller string, offset int, opcode int, callee string, args array<struct<reg: int, kind: string, value: string, crossed_branch: boolean>>", rows)

    def smali(self) -> DataFrame:
        return self.table("method_id int, signature string, smali string", lambda d: ((k, s, smali.method_smali(d, s, c)) for s, k, c, _ in bodies(d)))


def _proto_of(d: Dex, method: int) -> int:
    return int.from_bytes(d.b[d.methods_off + 8 * method + 2 : d.methods_off + 8 * method + 4], "little")


def bodies(d: Dex) -> Iterator[tuple[str, int, dict, int]]:
    """(signature, method id, code, access flags) of every method with a body."""
    for i in range(d.n_classes):
        for kind, k, flags, code in d.members(d.class_def(i)[6]):
            if kind.endswith("method") and code:
                yield d.method_signature(k), k, d.code(code), flags
