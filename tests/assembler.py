"""A small assembler of valid dex images for tests."""

import struct
import zipfile
from io import BytesIO

NO = 0xFFFFFFFF


def uleb(v):
    out = b""
    while True:
        out += bytes([v & 127 | (128 if v > 127 else 0)])
        v >>= 7
        if not v:
            return out


def dex(classes, refs=(), extra_strings=()):
    """classes: [(descriptor, super, interfaces, [(name, proto params, return, flags, registers, ins, units(ids) or None)], [(field, type, flags)])];

    refs: [(class, name, params, return)]; units is a function of an object with string/type/method numbers.
    """
    shorty = lambda ps, r: "".join("L" if t[0] in "[L" else t for t in (r, *ps))
    strings, types, protos, methods, fields = set(extra_strings), set(), set(), set(), set()
    every = [(c[0], m[0], tuple(m[1]), m[2]) for c in classes for m in c[3]] + [(c, n, tuple(p), r) for c, n, p, r in refs]
    for c, n, ps, r in every:
        methods.add((c, n, ps, r))
        protos.add((ps, r))
        types |= {c, r, *ps}
        strings |= {n, shorty(ps, r)}
    for c in classes:
        types |= {c[0], c[1], *c[2]}
        for f, t, _ in c[4]:
            fields.add((c[0], f, t))
            types.add(t)
            strings.add(f)
    strings |= types
    S = sorted(strings, key=lambda s: s.encode("utf-16-be"))
    s_id = {s: i for i, s in enumerate(S)}
    Ty = sorted(types, key=lambda t: s_id[t])
    t_id = {t: i for i, t in enumerate(Ty)}
    P = sorted(protos, key=lambda p: (t_id[p[1]], [t_id[x] for x in p[0]]))
    p_id = {p: i for i, p in enumerate(P)}
    Fi = sorted(fields, key=lambda f: (t_id[f[0]], s_id[f[1]], t_id[f[2]]))
    f_id = {f: i for i, f in enumerate(Fi)}
    M = sorted(methods, key=lambda m: (t_id[m[0]], s_id[m[1]], p_id[m[2], m[3]]))
    m_id = {m: i for i, m in enumerate(M)}
    ids = type("Ids", (), {"s": s_id, "t": t_id, "f": f_id, "m": m_id})
    head = 112
    at_s = head
    at_t, n_c = at_s + 4 * len(S), len(classes)
    at_p = at_t + 4 * len(Ty)
    at_f = at_p + 12 * len(P)
    at_m = at_f + 8 * len(Fi)
    at_c = at_m + 8 * len(M)
    start = at_c + 32 * n_c
    data = bytearray()

    def put(b, align=4):
        while (start + len(data)) % align:
            data.append(0)
        at = start + len(data)
        data.extend(b)
        return at

    lists = {ps: put(struct.pack(f"<I{len(ps)}H", len(ps), *(t_id[x] for x in ps))) for ps in sorted({p[0] for p in P} | {tuple(c[2]) for c in classes}) if ps}
    items = {0x1001: (min(lists.values()), len(lists))} if lists else {}
    defs, codes, datas = b"", [], []
    for c in classes:
        for m in c[3]:
            if m[6] is not None:
                units = m[6](ids)
                codes.append(put(struct.pack(f"<4H2I{len(units)}H", m[4], m[5], 5, 0, 0, len(units), *[u & 0xFFFF for u in units])))
                m_id[c[0], m[0], tuple(m[1]), m[2], "code"] = codes[-1]
    if codes:
        items[0x2001] = (codes[0], len(codes))
    texts = [put(uleb(len(s.encode("utf-16-le")) // 2) + _mutf8(s) + b"\0", 1) for s in S]
    items[0x2002] = (texts[0], len(texts))
    for c in classes:
        own = sorted((f_id[c[0], f, t], fl) for f, t, fl in c[4])
        meths = sorted((m_id[c[0], m[0], tuple(m[1]), m[2]], m[3], m_id.get((c[0], m[0], tuple(m[1]), m[2], "code"), 0)) for m in c[3])
        direct = [x for x in meths if x[1] & 0xA or x[1] & 0x10000]
        virtual = [x for x in meths if x not in direct]
        b = uleb(len([f for f in own if f[1] & 8])) + uleb(len([f for f in own if not f[1] & 8])) + uleb(len(direct)) + uleb(len(virtual))
        for group in ([f for f in own if f[1] & 8], [f for f in own if not f[1] & 8], direct, virtual):
            last = 0
            for x in group:
                b += uleb(x[0] - last) + b"".join(map(uleb, x[1:]))
                last = x[0]
        datas.append(put(b, 1))
        defs += struct.pack("<8I", t_id[c[0]], 1, t_id[c[1]], lists.get(tuple(c[2]), 0), NO, 0, datas[-1], 0)
    if datas:
        items[0x2000] = (datas[0], len(datas))
    for k, off, n in ((0, 0, 1), (1, at_s, len(S)), (2, at_t, len(Ty)), (3, at_p, len(P)), (4, at_f, len(Fi)), (5, at_m, len(M)), (6, at_c, n_c)):
        if n:
            items[k] = (off, n)
    at_map = put(b"")
    items[0x1000] = (at_map, 1)
    order = sorted(items.items(), key=lambda x: x[1][0])
    put(struct.pack("<I", len(order)) + b"".join(struct.pack("<2H2I", k, 0, n, off) for k, (off, n) in order))
    size = start + len(data)
    z = lambda n, off: (n, off if n else 0)
    header = b"dex\n035\0" + bytes(24) + struct.pack("<6I", size, 112, 0x12345678, 0, 0, at_map)
    header += struct.pack("<14I", *z(len(S), at_s), *z(len(Ty), at_t), *z(len(P), at_p), *z(len(Fi), at_f), *z(len(M), at_m), *z(n_c, at_c), len(data), start)
    body = struct.pack(f"<{len(S)}I", *texts) + struct.pack(f"<{len(Ty)}I", *(s_id[t] for t in Ty))
    body += b"".join(struct.pack("<3I", s_id[shorty(*p)], t_id[p[1]], lists.get(p[0], 0)) for p in P)
    body += b"".join(struct.pack("<HHI", t_id[c], t_id[t], s_id[n]) for c, n, t in Fi)
    body += b"".join(struct.pack("<HHI", t_id[c], p_id[ps, r], s_id[n]) for c, n, ps, r in M)
    return header + body + defs + bytes(data)


def _mutf8(s):
    out = b""
    b = s.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(b), 2):
        u = b[i] << 8 | b[i + 1]
        out += bytes([u]) if 0 < u < 128 else bytes([0xC0 | u >> 6, 0x80 | u & 63]) if u < 0x800 else bytes([0xE0 | u >> 12, 0x80 | u >> 6 & 63, 0x80 | u & 63])
    return out


def apk(*images, manifest=True, names=None):
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if manifest:
            z.writestr("AndroidManifest.xml", b"x")
        for i, image in enumerate(images):
            z.writestr(names[i] if names else f"classes{i + 1 if i else ''}.dex", image)
    return out.getvalue()
