"""Minimal DEX files, byte by byte, by the public format: one class with one method."""

import struct


def leb(n: int) -> bytes:
    out = b""
    while True:
        n, low = n >> 7, n & 0x7F
        out += bytes([low | (0x80 if n else 0)])
        if not n:
            return out


def sleb(n: int) -> bytes:
    assert -64 <= n < 64
    return bytes([n & 0x7F])


def build(strings, types, protos=(), fields=(), methods=(), classes=()) -> bytes:
    """strings: texts; types: string indices; protos: (shorty, return type, parameter types); fields: (class, type, name); methods:
    (class, proto, name); classes: dicts of idx, super, flags, static, instance, direct, virtual (fields: (idx, flags); methods:
    (idx, flags, code) with code None or a dict of insns, registers, ins, tries and handlers) and annotations (types)."""
    n = [len(x) for x in (strings, types, protos, fields, methods, classes)]
    width = [4, 4, 12, 8, 8, 32]
    at = [0x70]
    for count, w in zip(n, width, strict=True):
        at.append(at[-1] + count * w)
    data, base = bytearray(), at[-1]

    def put(raw: bytes, align: int = 1) -> int:
        while (base + len(data)) % align:
            data.append(0)
        off = base + len(data)
        data.extend(raw)
        return off

    string_ids = b"".join(struct.pack("<I", put(leb(len(s)) + s.encode().replace(b"\0", b"\xc0\x80") + b"\0")) for s in strings)
    proto_ids = b""
    for shorty, ret, params in protos:
        off = put(struct.pack(f"<I{len(params)}H", len(params), *params), 4) if params else 0
        proto_ids += struct.pack("<III", shorty, ret, off)
    class_defs = b""
    for c in classes:
        def member_code(code):
            if code is None:
                return 0
            insns, tries = code["insns"], code.get("tries", ())
            raw = struct.pack("<HHHHII", code.get("registers", 2), code.get("ins", 0), 0, len(tries), 0, len(insns) // 2) + insns
            if tries:
                raw += b"\0" * (-len(raw) % 4)
                lists, offs = leb(len(code["handlers"])), []
                for typed, rest in code["handlers"]:
                    offs.append(len(lists))
                    lists += sleb(-len(typed) if rest is not None else len(typed)) + b"".join(leb(t) + leb(a) for t, a in typed) + (leb(rest) if rest is not None else b"")
                raw += b"".join(struct.pack("<IHH", a, k, offs[h]) for a, k, h in tries) + lists
            return put(raw, 4)

        def members(rows, coded):
            out, last = b"", 0
            for idx, flags, *code in rows:
                out += leb(idx - last) + leb(flags) + (leb(member_code(code[0])) if coded else b"")
                last = idx
            return out

        groups = [c.get(k, ()) for k in ("static", "instance", "direct", "virtual")]
        body = b"".join(members(g, k >= 2) for k, g in enumerate(groups))
        data_off = put(b"".join(leb(len(g)) for g in groups) + body)
        notes = 0
        if c.get("annotations"):
            items = [put(b"\x01" + leb(t) + leb(0)) for t in c["annotations"]]
            entry = put(struct.pack(f"<I{len(items)}I", len(items), *items), 4)
            notes = put(struct.pack("<IIII", entry, 0, 0, 0), 4)
        class_defs += struct.pack("<8I", c["idx"], c.get("flags", 1), c.get("super", 0xFFFFFFFF), 0, 0xFFFFFFFF, notes, data_off, 0)
    head = bytearray(b"dex\n035\0" + b"\0" * (0x70 - 8))
    struct.pack_into("<III", head, 0x20, base + len(data), 0x70, 0x12345678)
    for k, (count, off) in enumerate(zip(n, at, strict=False)):
        struct.pack_into("<II", head, 0x38 + 8 * k, count, off if count else 0)
    type_ids = b"".join(struct.pack("<I", t) for t in types)
    field_ids = b"".join(struct.pack("<HHI", *f) for f in fields)
    method_ids = b"".join(struct.pack("<HHI", *m) for m in methods)
    return bytes(head) + string_ids + type_ids + proto_ids + field_ids + method_ids + class_defs + bytes(data)


def simple(insns: bytes, **code) -> bytes:
    """class Simple extends Object with a direct method foo()V of the given code."""
    return build(
        ["V", "Ljava/lang/Object;", "LSimple;", "foo", "()V"], [0, 1, 2], [(0, 0, ())], methods=[(2, 0, 3)], classes=[{"idx": 2, "super": 1, "direct": [(0, 9, {"insns": insns} | code)]}]
    )
