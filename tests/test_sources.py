"""Container scan, verifier, id tables, argument origins and assembly text on assembled images."""

import struct

import pytest

from strataq.operators import dataflow, smali
from strataq.sources import container, mutf8, opcodes
from strataq.sources.dexfile import Dex
from strataq.sources.tables import Session, bodies, image_verdicts
from strataq.sources.verifier import verify

from .assembler import apk, dex

OBJ, STR = "Ljava/lang/Object;", "Ljava/lang/String;"
LOG = ("Landroid/util/Log;", "d", (STR, STR), "I")


def log_both(ids):
    """const-string v0; if-eqz v2 -> other; const-string v1 'yes'; goto call; other: const-string v1 'no'; call: Log.d(v0, v1); return-void"""
    return [0x001A, ids.s["tag"], 0x0238, 5, 0x011A, ids.s["yes"], 0x0328, 0x011A, ids.s["no"], 0x2071, ids.m[LOG], 0x0010, 0x000E]


def straight(ids):
    return [0x001A, ids.s["tag"], 0x0112, 0x2071, ids.m[LOG], 0x0010, 0x000E]


def one(name="La/B;", extra=()):
    methods = [("both", ["I"], "V", 9, 3, 1, log_both), ("plain", [], "V", 9, 2, 0, straight), ("none", [], "V", 0x401, 0, 0, None)]
    return dex([(name, OBJ, ["La/I;"], methods, [("f", "I", 2), ("S", STR, 9)])], [LOG], ["tag", "yes", "no", *extra])


def test_identify():
    d = one()
    assert container.identify(d) == {"format": "dex", "is_apk": False, "has_manifest": False, "dex_count": 1}
    assert container.identify(apk(d, d)) == {"format": "zip", "is_apk": True, "has_manifest": True, "dex_count": 2}
    assert container.identify(apk(d, d, manifest=False, names=["classes.dex", "classes3.dex"]))["dex_count"] == 1
    for bad in (None, b"", b"junk", b"PK\x03\x04junk"):
        assert container.identify(bad)["format"] == "unknown" and container.images(bad) == []


def test_slices():
    d = one()
    assert container.slices(d + d) == [(0, len(d)), (len(d), len(d))]
    assert container.slices(d + b"x" * 50) == [(0, len(d))] and container.slices(d[:100]) == []
    assert [r[2] for r in image_verdicts(d + d)] == ["", ""] and image_verdicts(b"short")[0][2] == container.NO_SLICE


def patched(d, at, fmt, v):
    b = bytearray(d)
    struct.pack_into(fmt, b, at, v)
    return bytes(b)


def test_verify():
    d = one(extra=["\u0000x", "é", "😀"])
    assert verify(d) == "" and verify(b"") == "Truncated header"
    want = {
        "Bad file magic": patched(d, 0, "<I", 0), "Unknown dex version": patched(d, 4, "<I", 0x00393930), "Bad header size": patched(d, 36, "<I", 100),
        "Unexpected endian_tag": patched(d, 40, "<I", 1), "Bad file size (past image)": patched(d, 32, "<I", len(d) + 4),
    }
    for reason, image in want.items():
        assert verify(image) == reason
    assert verify(patched(d, 56, "<I", 1 << 30)).startswith("List too long for string-ids")
    p = Dex(d)
    assert verify(patched(d, p.map_off + 4, "<H", 0x77)) == "Unknown map section type"
    # two strings exchanged; a type index out of range; a register and a string index out of range in code
    a, b = struct.unpack_from("<2I", d, p.strings_off)
    assert verify(patched(patched(d, p.strings_off, "<I", b), p.strings_off + 4, "<I", a)) == "Out of order string_ids"
    assert "out of range" in verify(patched(d, p.types_off, "<I", 9999))
    code = d.index(struct.pack("<HH", 0x001A, p.strings.index("tag")))
    assert verify(patched(d, code + 2, "<H", 9999)) == "Bad string index in code" and verify(patched(d, code + 2, "<H", 9999), lenient=True) == ""
    assert verify(patched(d, code, "<H", 0x091A)) == "Register out of range"
    for cut in range(0, len(d), 7):
        assert verify(d[:cut]) != ""
    for at in range(0, len(d), 3):  # never raises, whatever byte is changed
        verify(patched(d, at, "<B", d[at] ^ 0xFF))


def test_mutf8():
    assert mutf8.text(b"a\xc0\x80\xc3\xa9\xed\xa0\xbd\xed\xb8\x80") == "a\0é😀" and mutf8.units(b"\xed\xa0\xbd") == [0xD83D]
    for bad in (b"\xc1\x81", b"\xe0\x80\xa2", b"\xc3", b"\x80", b"\xf0\x9f\x98\x80", b"\0"):
        assert mutf8.units(bad) is None


def test_opcodes():
    names, forms = opcodes.names(), opcodes.formats()
    assert len(names) == len(forms) == 256
    for op, name in ((0x0E, "return-void"), (0x1A, "const-string"), (0x28, "goto"), (0x38, "if-eqz"), (0x44, "aget"), (0x52, "iget"), (0x6D, "sput-short"), (0x71, "invoke-static"), (0x78, "invoke-interface/range"), (0x81, "int-to-long"), (0x8F, "int-to-short"), (0x90, "add-int"), (0xAF, "rem-double"), (0xCF, "rem-double/2addr"), (0xD1, "rsub-int"), (0xE2, "ushr-int/lit8"), (0xFF, "const-method-type")):
        assert names[op] == name


def origins(d, depth):
    return {(s, r["offset"]): (r["callee"], r["args"]) for s, k, c, f in bodies(d) for r in dataflow.resolve(d, c, d.protos[0][0], bool(f & 8), depth)}


def test_argument_origins():
    d = Dex(one())
    got = origins(d, 2)
    (callee, args), (_, plain) = got["La/B;->both(I)V", 18], got["La/B;->plain()V", 6]
    assert callee == "Landroid/util/Log;->d(Ljava/lang/String;Ljava/lang/String;)I"
    assert args == [(0, "ConstString", "tag", False), (1, "Unknown", None, True)]
    assert plain == [(0, "ConstString", "tag", False), (1, "ConstNull", "0", False)]
    assert origins(d, 0)["La/B;->both(I)V", 18][1] == [(0, "Unknown", None, False), (1, "Unknown", None, False)]
    known = [{k: [a[1] != "Unknown" for a in v[1]] for k, v in origins(d, n).items()} for n in range(5)]
    for less, more in zip(known, known[1:], strict=False):
        assert less.keys() == more.keys() and all(all(y or not x for x, y in zip(less[k], more[k], strict=True)) for k in less)
    assert origins(d, -3) == origins(d, 0)


def test_smali():
    d = Dex(one(extra=['q"\n']))
    text = {s: smali.method_smali(d, s, c) for s, _, c, _ in bodies(d)}
    assert text["La/B;->plain()V"] == (
        'La/B;->plain()V\n    .registers 2\n    0x0: const-string v0, "tag"\n    0x4: const/4 v1, 0x0\n'
        "    0x6: invoke-static {v0, v1}, Landroid/util/Log;->d(Ljava/lang/String;Ljava/lang/String;)I\n    0xc: return-void\n"
    )
    assert "if-eqz v2, 0xe" in text["La/B;->both(I)V"] and "goto 0x12" in text["La/B;->both(I)V"]
    assert smali.escaped('q"\n\\') == '"q\\"\\x0a\\\\"'


def test_session(spark, tmp_path):
    a, b = one(), one("La/C;", ["more"])
    (tmp_path / "x.apk").write_bytes(apk(a, b"bad" * 100))
    (tmp_path / "y.bin").write_bytes(b + a)
    paths = [str(tmp_path / "y.bin"), str(tmp_path / "x.apk")]
    s = Session(spark, paths, str(tmp_path / "out"))
    report = [(r.dex_id, r.valid, r.reason) for r in s.verify_report().orderBy("source", "dex_id").collect()]
    assert sorted(r[0] for r in report) == [-1, 0, 1, 2] and [r[2] for r in report if not r[1]] == [container.NO_SLICE]
    assert {(r.source_ord, r.format, r.is_apk, r.dex_count) for r in s.sources().collect()} == {(0, "dex", False, 1), (1, "zip", True, 2)}
    classes = {(r.dex_id, r.descriptor, r.super, tuple(r.interfaces)) for r in s.classes().collect()}
    assert classes == {(0, "La/C;", OBJ, ("La/I;",)), (1, "La/B;", OBJ, ("La/I;",)), (2, "La/B;", OBJ, ("La/I;",))}
    members = [(r.kind, r.signature, r.has_code) for r in s.members().where("dex_id = 1").collect()]
    assert ("virtual_method", "La/B;->none()V", False) in members and ("static_field", "La/B;->S:Ljava/lang/String;", False) in members
    assert {r.value for r in s.strings().where("dex_id = 0").collect()} >= {"more", "tag"} and s.types().count() > 9 and s.fields().count() == 6
    calls = s.call_sites().collect()
    assert len(calls) == 6 and {c.callee for c in calls} == {"Landroid/util/Log;->d(Ljava/lang/String;Ljava/lang/String;)I"}
    sites = lambda depth: {(r.dex_id, r.caller, r.offset) for r in s.call_args(depth).collect()}
    assert sites(0) == sites(3) == {(c.dex_id, c.caller, c.offset) for c in calls}
    assert s.smali().where("smali like '%const-string v0, \"tag\"%'").count() == 6 and s.methods().count() == 12 and s.static_strings().count() == 0
    (tmp_path / "z.apk").write_bytes(apk(b"junk"))
    with pytest.raises(ValueError):
        Session(spark, [str(tmp_path / "z.apk")], str(tmp_path / "out2"))
    with pytest.raises(ValueError):
        Session(spark, [], str(tmp_path / "out3"))
