"""Assembly text of a method: one line an instruction, with its byte offset and operands resolved or labelled."""

from __future__ import annotations

from strataq.sources import opcodes
from strataq.sources.verifier import Fault, registers, targets


def escaped(text: str) -> str:
    """A string literal: quotes and backslashes escaped, control characters as \\xNN."""
    out = []
    for c in text:
        out.append(f"\\x{ord(c):02x}" if c < " " else "\\" + c if c in '"\\' else c)
    return '"' + "".join(out) + '"'


def operand(dex, insns, at: int) -> str:
    kind, i = dex.operand(insns, at)
    if not kind:
        return ""
    got = dex.resolved(kind, i)
    if got is None:
        return f"{kind}@{i}"
    return escaped(got) if kind == "string" else got


def _literal(insns, at: int) -> str:
    op, form = insns[at] & 0xFF, opcodes.formats()[insns[at] & 0xFF]
    signed = lambda v, bits: v - (1 << bits) if v >> (bits - 1) & 1 else v
    if form == "11n":
        return hex(signed(insns[at] >> 12, 4))
    if form == "21s" or form == "22s":
        return hex(signed(insns[at + 1], 16))
    if form == "22b":
        return hex(signed(insns[at + 1] >> 8, 8))
    if form == "21h":
        return hex(signed(insns[at + 1] << (48 if op == 0x19 else 16), 64 if op == 0x19 else 32))
    if form == "31i":
        return hex(signed(insns[at + 1] | insns[at + 2] << 16, 32))
    if form == "51l":
        return hex(signed(sum(insns[at + 1 + k] << 16 * k for k in range(4)), 64))
    return ""


def line(dex, insns, at: int) -> str:
    unit = insns[at]
    if unit in (0x0100, 0x0200, 0x0300):
        return {0x0100: ".packed-switch", 0x0200: ".sparse-switch", 0x0300: ".array-data"}[unit]
    op = unit & 0xFF
    regs = ", ".join(f"v{r}" for r in registers(insns, at))
    if opcodes.formats()[op] in ("35c", "3rc", "45cc", "4rcc"):
        regs = "{" + regs + "}"
    try:
        jumps = [f"0x{2 * t:x}" for t in targets(insns, at)] if op not in (0x2B, 0x2C) else []
    except Fault:
        jumps = []
    more = [x for x in (regs, _literal(insns, at), operand(dex, insns, at), *jumps) if x]
    if op in (0xFA, 0xFB):
        more.append(dex.resolved("proto", insns[at + 3]) or f"proto@{insns[at + 3]}")
    return f"{opcodes.names()[op]} {', '.join(more)}".rstrip()


def method_smali(dex, signature: str, code: dict | None) -> str:
    """The text of a method; only its signature where it has no body."""
    if code is None:
        return signature + "\n"
    out, at, insns = [signature, f"    .registers {code['registers']}"], 0, code["insns"]
    while at < len(insns):
        out.append(f"    0x{2 * at:x}: {line(dex, insns, at)}")
        w = opcodes.width(insns, at)
        if not w:
            break
        at += w
    return "\n".join(out) + "\n"
