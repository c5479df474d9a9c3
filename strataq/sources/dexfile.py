"""Id tables, classes and code of one logical dex, read from its bytes."""

from __future__ import annotations

import struct
from array import array
from functools import cached_property

from . import opcodes
from .mutf8 import text

NO_INDEX = 0xFFFFFFFF


def uleb(b: bytes, p: int) -> tuple[int, int]:
    """(value, next place); at most five bytes."""
    v = 0
    for shift in range(0, 35, 7):
        x = b[p]
        p += 1
        v |= (x & 0x7F) << shift
        if x < 0x80:
            return v, p
    raise ValueError("uleb128 of more than five bytes")


def sleb(b: bytes, p: int) -> tuple[int, int]:
    v, p0 = 0, p
    v, p = uleb(b, p)
    bits = 7 * (p - p0)
    return (v - (1 << bits) if v >> (bits - 1) & 1 else v), p


class Dex:
    """base: the bytes that offsets count from (the slice, or a container's image); head: where the header stands in it."""

    def __init__(self, base: bytes, head: int = 0) -> None:
        self.b, self.head = base, head
        (self.file_size, self.header_size, self.endian, self.link_size, self.link_off, self.map_off) = struct.unpack_from("<6I", base, head + 32)
        sizes = struct.unpack_from("<14I", base, head + 56)
        self.n_strings, self.strings_off, self.n_types, self.types_off, self.n_protos, self.protos_off, self.n_fields, self.fields_off = sizes[:8]
        self.n_methods, self.methods_off, self.n_classes, self.classes_off, self.data_size, self.data_off = sizes[8:]

    def raw(self, i: int) -> bytes:
        """MUTF-8 bytes of a string."""
        p = struct.unpack_from("<I", self.b, self.strings_off + 4 * i)[0]
        _, p = uleb(self.b, p)
        return self.b[p : self.b.index(0, p)]

    @cached_property
    def strings(self) -> list[str]:
        return [text(self.raw(i)) for i in range(self.n_strings)]

    @cached_property
    def types(self) -> list[str]:
        return [self.strings[i] for i in struct.unpack_from(f"<{self.n_types}I", self.b, self.types_off)]

    def type_list(self, off: int) -> list[str]:
        if not off:
            return []
        n = struct.unpack_from("<I", self.b, off)[0]
        return [self.types[i] for i in struct.unpack_from(f"<{n}H", self.b, off + 4)]

    @cached_property
    def protos(self) -> list[tuple[list[str], str]]:
        out = []
        for i in range(self.n_protos):
            _, ret, off = struct.unpack_from("<3I", self.b, self.protos_off + 12 * i)
            out.append((self.type_list(off), self.types[ret]))
        return out

    def proto(self, i: int) -> str:
        params, ret = self.protos[i]
        return f"({''.join(params)}){ret}"

    @cached_property
    def fields(self) -> list[tuple[str, str, str]]:
        """(class, name, type)"""
        rows = (struct.unpack_from("<HHI", self.b, self.fields_off + 8 * i) for i in range(self.n_fields))
        return [(self.types[c], self.strings[n], self.types[t]) for c, t, n in rows]

    @cached_property
    def methods(self) -> list[tuple[str, str, str]]:
        """(class, name, proto)"""
        rows = (struct.unpack_from("<HHI", self.b, self.methods_off + 8 * i) for i in range(self.n_methods))
        return [(self.types[c], self.strings[n], self.proto(p)) for c, p, n in rows]

    def field_signature(self, i: int) -> str:
        c, n, t = self.fields[i]
        return f"{c}->{n}:{t}"

    def method_signature(self, i: int) -> str:
        c, n, p = self.methods[i]
        return f"{c}->{n}{p}"

    def class_def(self, i: int) -> tuple[int, ...]:
        """class, flags, super, interfaces, source file, annotations, class data, static values"""
        return struct.unpack_from("<8I", self.b, self.classes_off + 32 * i)

    def members(self, off: int) -> list[tuple[str, int, int, int]]:
        """(kind, id, access flags, code offset) of class data: static and instance fields, direct and virtual methods."""
        if not off:
            return []
        counts, p = [], off
        for _ in range(4):
            n, p = uleb(self.b, p)
            counts.append(n)
        out = []
        for kind, n in zip(("static_field", "instance_field", "direct_method", "virtual_method"), counts, strict=True):
            at = 0
            for _ in range(n):
                d, p = uleb(self.b, p)
                flags, p = uleb(self.b, p)
                code = 0
                if kind.endswith("method"):
                    code, p = uleb(self.b, p)
                at += d
                out.append((kind, at, flags, code))
        return out

    def code(self, off: int) -> dict:
        registers, ins, outs, n_tries, debug, size = struct.unpack_from("<4H2I", self.b, off)
        units = array("H", self.b[off + 16 : off + 16 + 2 * size])
        if len(units) != size:
            raise ValueError("code past the end")
        tries, p = [], off + 16 + 2 * size + (2 if n_tries and size % 2 else 0)
        handlers_at = p + 8 * n_tries
        for _ in range(n_tries):
            start, count, h = struct.unpack_from("<IHH", self.b, p)
            p += 8
            n, q = sleb(self.b, handlers_at + h)
            targets = []
            for _ in range(abs(n)):
                t, q = uleb(self.b, q)
                addr, q = uleb(self.b, q)
                targets.append((t, addr))
            if n <= 0:
                addr, q = uleb(self.b, q)
                targets.append((NO_INDEX, addr))
            tries.append((start, count, targets))
        return {"registers": registers, "ins": ins, "outs": outs, "insns": units, "tries": tries}

    def encoded_value(self, p: int, depth: int = 0):
        """(value, next place): int, float, str for names, list for arrays, dict for annotations, None."""
        if depth > 16:
            raise ValueError("encoded value nested too deep")
        head = self.b[p]
        kind, arg = head & 31, head >> 5
        p += 1
        if kind == 0x1C:
            n, p = uleb(self.b, p)
            out = []
            for _ in range(n):
                v, p = self.encoded_value(p, depth + 1)
                out.append(v)
            return out, p
        if kind == 0x1D:
            t, p = uleb(self.b, p)
            n, p = uleb(self.b, p)
            got = {}
            for _ in range(n):
                name, p = uleb(self.b, p)
                got[self.strings[name]], p = self.encoded_value(p, depth + 1)
            return {"type": self.types[t], "elements": got}, p
        if kind == 0x1E:
            return None, p
        if kind == 0x1F:
            return bool(arg), p
        x = self.b[p : p + arg + 1]
        if len(x) != arg + 1:
            raise ValueError("encoded value past the end")
        p += arg + 1
        if kind in (0x00, 0x02, 0x04, 0x06):
            return int.from_bytes(x, "little", signed=True), p
        if kind == 0x10:  # the stored bytes are the most significant
            return struct.unpack("<f", x.rjust(4, b"\0"))[0], p
        if kind == 0x11:
            return struct.unpack("<d", x.rjust(8, b"\0"))[0], p
        i = int.from_bytes(x, "little")
        if kind == 0x03:
            return i, p
        if kind == 0x17:
            return ("string", i), p
        if kind == 0x18:
            return ("type", self.types[i]), p
        if kind in (0x19, 0x1B):
            return ("field", self.field_signature(i)), p
        if kind == 0x1A:
            return ("method", self.method_signature(i)), p
        if kind == 0x15:
            return ("proto", self.proto(i)), p
        if kind == 0x16:
            return ("method_handle", i), p
        raise ValueError(f"unknown encoded value {kind:#x}")

    def static_values(self, off: int) -> list:
        if not off:
            return []
        n, p = uleb(self.b, off)
        out = []
        for _ in range(n):
            v, p = self.encoded_value(p)
            out.append(v)
        return out

    def operand(self, code: array, at: int) -> tuple[str, int]:
        """(table, index) of the instruction at `at`; an empty table if it has no index."""
        op = code[at] & 0xFF
        kind = opcodes.ref_kind(op)
        if not kind:
            return "", 0
        return kind, code[at + 1] | code[at + 2] << 16 if op == 0x1B else code[at + 1]

    def resolved(self, kind: str, i: int) -> str | None:
        """The text of an index; None if the table is not resolved or the index is out of it."""
        table = {"string": self.n_strings, "type": self.n_types, "field": self.n_fields, "method": self.n_methods, "proto": self.n_protos}
        if i >= table.get(kind, 0):
            return None
        return {"string": self.strings.__getitem__, "type": self.types.__getitem__, "field": self.field_signature, "method": self.method_signature, "proto": self.proto}[kind](i)
