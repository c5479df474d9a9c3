"""Instruction formats and names, built from the families of the instruction set."""

from __future__ import annotations

from functools import cache

#: Runs of opcodes (last one, format), from 0 upwards.
_RUNS = "00 10x,01 12x,02 22x,03 32x,04 12x,05 22x,06 32x,07 12x,08 22x,09 32x,0d 11x,0e 10x,11 11x,12 11n,13 21s,14 31i,15 21h,16 21s,17 31i,18 51l,19 21h,1a 21c,1b 31c,1c 21c,1e 11x,1f 21c,20 22c,21 12x,22 21c,23 22c,24 35c,25 3rc,26 31t,27 11x,28 10t,29 20t,2a 30t,2c 31t,31 23x,37 22t,3d 21t,43 10x,51 23x,5f 22c,6d 21c,72 35c,73 10x,78 3rc,7a 10x,8f 12x,af 23x,cf 12x,d7 22s,e2 22b,f9 10x,fa 45cc,fb 4rcc,fc 35c,fd 3rc,ff 21c"
#: Families of names in order of opcode.
_KINDS = ("", "-wide", "-object", "-boolean", "-byte", "-char", "-short")
_MATH = ("add", "sub", "mul", "div", "rem", "and", "or", "xor", "shl", "shr", "ushr")


@cache
def formats() -> list[str]:
    out: list[str] = []
    for run in _RUNS.split(","):
        last, form = run.split()
        out += [form] * (int(last, 16) + 1 - len(out))
    return out


@cache
def names() -> list[str]:
    out = ["nop"]
    for k in _KINDS[:3]:
        out += [f"move{k}", f"move{k}/from16", f"move{k}/16"]
    out += ["move-result", "move-result-wide", "move-result-object", "move-exception", "return-void", "return", "return-wide", "return-object"]
    out += ["const/4", "const/16", "const", "const/high16", "const-wide/16", "const-wide/32", "const-wide", "const-wide/high16", "const-string", "const-string/jumbo", "const-class"]
    out += ["monitor-enter", "monitor-exit", "check-cast", "instance-of", "array-length", "new-instance", "new-array", "filled-new-array", "filled-new-array/range", "fill-array-data"]
    out += ["throw", "goto", "goto/16", "goto/32", "packed-switch", "sparse-switch", "cmpl-float", "cmpg-float", "cmpl-double", "cmpg-double", "cmp-long"]
    tests = ("eq", "ne", "lt", "ge", "gt", "le")
    out += [f"if-{t}" for t in tests] + [f"if-{t}z" for t in tests] + ["unused"] * 6
    for family in ("a", "i", "s"):
        out += [f"{family}{way}{k}" for way in ("get", "put") for k in _KINDS]
    calls = [f"invoke-{k}" for k in ("virtual", "super", "direct", "static", "interface")]
    out += [*calls, "unused", *(f"{c}/range" for c in calls), "unused", "unused"]
    out += ["neg-int", "not-int", "neg-long", "not-long", "neg-float", "neg-double"]
    prims = ("int", "long", "float", "double")
    out += [f"{a}-to-{b}" for a in prims for b in prims if a != b] + ["int-to-byte", "int-to-char", "int-to-short"]
    binary = [f"{m}-{p}" for p in prims for m in (_MATH if p in ("int", "long") else _MATH[:5])]
    out += binary + [f"{b}/2addr" for b in binary]
    lit = ("add", "rsub", "mul", "div", "rem", "and", "or", "xor")
    out += ["rsub-int" if m == "rsub" else f"{m}-int/lit16" for m in lit] + [f"{m}-int/lit8" for m in (*lit, "shl", "shr", "ushr")]
    out += ["unused"] * (0xFA - len(out))
    return out + ["invoke-polymorphic", "invoke-polymorphic/range", "invoke-custom", "invoke-custom/range", "const-method-handle", "const-method-type"]


def ref_kind(op: int) -> str:
    """The table that the index of an opcode points to; empty if it has none."""
    if op in (0x1A, 0x1B):
        return "string"
    if op in (0x1C, 0x1F, 0x20, 0x22, 0x23, 0x24, 0x25):
        return "type"
    if 0x52 <= op <= 0x6D:
        return "field"
    if is_invoke(op):
        return "method"
    return {0xFC: "call_site", 0xFD: "call_site", 0xFE: "method_handle", 0xFF: "proto"}.get(op, "")


def is_invoke(op: int) -> bool:
    """An invoke of a method (not of a call site)."""
    return 0x6E <= op <= 0x72 or 0x74 <= op <= 0x78 or op in (0xFA, 0xFB)


def width(code: memoryview | list, at: int) -> int:
    """Code units of the instruction or payload at `at`; 0 if it does not fit."""
    unit, left = code[at], len(code) - at
    op, n = unit & 0xFF, 0
    if op == 0 and unit in (0x0100, 0x0200, 0x0300):
        need = 4 if unit == 0x0300 else 2
        if left < need:
            return 0
        if unit == 0x0100:
            n = 4 + 2 * code[at + 1]
        elif unit == 0x0200:
            n = 2 + 4 * code[at + 1]
        else:
            n = 4 + ((code[at + 2] | code[at + 3] << 16) * code[at + 1] + 1) // 2
    else:
        n = int(formats()[op][0])
    return n if n <= left else 0
