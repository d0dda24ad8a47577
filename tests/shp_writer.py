"""Tiny shapefile writer for test fixtures (ESRI technical description)."""

import struct


def _bbox(pts):
    xs, ys = [p[0] for p in pts], [p[1] for p in pts]
    return min(xs), min(ys), max(xs), max(ys)


def write(base, shape_type, shapes, fields, records):
    """shapes: list of list-of-parts (each a list of (x, y)) or (x, y) for points."""
    contents = []
    for s in shapes:
        if shape_type == 1:
            contents.append(struct.pack("<i2d", 1, *s))
        else:
            pts = [p for part in s for p in part]
            starts, k = [], 0
            for part in s:
                starts.append(k)
                k += len(part)
            c = struct.pack("<i4d2i", shape_type, *_bbox(pts), len(s), len(pts))
            c += struct.pack(f"<{len(s)}i", *starts) + struct.pack(f"<{2 * len(pts)}d", *[v for p in pts for v in p])
            contents.append(c)
    allpts = [s if shape_type == 1 else p for s in shapes for p in ([s] if shape_type == 1 else [q for part in s for q in part])]
    bb = _bbox(allpts)
    shp_len = 100 + sum(8 + len(c) for c in contents)

    def header(length):
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, length // 2) + struct.pack("<2i", 1000, shape_type) \
            + struct.pack("<4d", *bb) + struct.pack("<4d", 0, 0, 0, 0)
    with open(base + ".shp", "wb") as f, open(base + ".shx", "wb") as x:
        f.write(header(shp_len))
        x.write(header(100 + 8 * len(contents)))
        off = 100
        for i, c in enumerate(contents):
            f.write(struct.pack(">2i", i + 1, len(c) // 2) + c)
            x.write(struct.pack(">2i", off // 2, len(c) // 2))
            off += 8 + len(c)
    widths = [w for _, w in fields]
    with open(base + ".dbf", "wb") as d:
        hlen = 32 + 32 * len(fields) + 1
        rlen = 1 + sum(widths)
        d.write(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(records), hlen, rlen))
        for name, w in fields:
            d.write(struct.pack("<11sc4xBB14x", name.encode().ljust(11, b"\x00"), b"C", w, 0))
        d.write(b"\x0D")
        for rec in records:
            d.write(b" " + b"".join(str(v).encode().ljust(w)[:w] for v, w in zip(rec, widths)))
        d.write(b"\x1A")
