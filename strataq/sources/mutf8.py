"""Modified UTF-8: strict check, code units, display text."""

from __future__ import annotations


def units(raw: bytes) -> list[int] | None:
    """UTF-16 code units of canonical MUTF-8 (NUL as C0 80, supplementary characters as two units); None if it is malformed."""
    out, i, n = [], 0, len(raw)
    while i < n:
        a = raw[i]
        if 0 < a < 0x80:
            out.append(a)
            i += 1
            continue
        more = 1 if 0xC0 <= a < 0xE0 else 2 if 0xE0 <= a < 0xF0 else 0
        tail = raw[i + 1 : i + 1 + more]
        if not more or len(tail) < more or any(b & 0xC0 != 0x80 for b in tail):
            return None
        u = a & (0x1F if more == 1 else 0x0F)
        for b in tail:
            u = u << 6 | b & 0x3F
        if u < (0x80 if more == 1 else 0x800) and not (more == 1 and u == 0):
            return None
        out.append(u)
        i += 1 + more
    return out


def text(raw: bytes) -> str:
    """Display text: pairs are combined, a lone surrogate or a malformed string shows replacement characters."""
    u = units(raw)
    if u is None:
        return raw.decode("utf-8", "replace")
    return b"".join(x.to_bytes(2, "little") for x in u).decode("utf-16-le", "replace")
