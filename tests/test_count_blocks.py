"""Within a block, many windows are met at once, and to the same counts as one by one."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.operators import counts as N

SIDE, BLOCK = 1024.0, (12600, 4700)


def _run(kind, points, windows, by="date"):
    key = [pa.scalar(c) for c in BLOCK]
    out = N._counted(kind, SIDE, by, ["_wid", by, "n"] if by else ["_wid", "n"])(key, points, windows)
    return sorted(map(tuple, (r.values() for r in out.to_pylist())), key=str)


def _points(r, n):
    """Points of the block, many at whole numbers, so that outlines go through some."""
    x, y = (np.where(r.random(n) < 0.6, np.floor(v), v) for v in r.uniform(0, SIDE, (2, n)))
    dates = [f"d{k}" if k else None for k in r.integers(0, 4, n)]
    return pa.table({"_px": x + BLOCK[0] * SIDE, "_py": y + BLOCK[1] * SIDE, "_n": r.integers(1, 4, n), "date": pa.array(dates, pa.string())})


def _brute(points, inside):
    found = {}
    for wid, holds in enumerate(inside):
        for i in np.flatnonzero(holds):
            at = (wid, points["date"][int(i)].as_py())
            found[at] = found.get(at, 0) + points["_n"][int(i)].as_py()
    return sorted(((*k, n) for k, n in found.items()), key=str)


def _segments(r, n):
    """Lines of up to seven segments: level, upright, without length, far beyond the block."""
    out = []
    for i in range(n):
        p = np.floor(r.uniform(-200, SIDE + 200, (r.integers(2, 9), 2))) if i % 3 else r.uniform(-200, SIDE + 200, (3, 2))
        if i % 5 == 0:
            p[1] = p[0]
        elif i % 5 == 1:
            p[1, i % 2] = p[0, i % 2]
        elif i % 5 == 2:
            p[-1] += (1e5, 1e-3)
        p += np.array(BLOCK) * SIDE
        d = np.diff(p, axis=0)
        l2 = (d * d).sum(axis=1)
        out.append([dict(zip(("x1", "y1", "dx", "dy", "l2"), map(float, (*a, *v, q or 1.0)), strict=True)) for a, v, q in zip(p, d, l2, strict=False)])
    return out


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_lines_and_circles_of_a_block(monkeypatch, strict, few):
    if few:  # several batches, running sums with gaps
        monkeypatch.setattr(N, "MARKS", 500)
        monkeypatch.setattr(N, "MATRIX", 100)
        monkeypatch.setattr(N, "SUMS", 2000)
    r = np.random.default_rng(5)
    points, lists = _points(r, 3000), _segments(r, 60)
    x, y = points["_px"].to_numpy(), points["_py"].to_numpy()
    for radius in (3.0, 60.0, 3000.0):
        inside = []
        for s in lists:
            x1, y1, dx, dy, l2 = (np.array([g[f] for g in s])[:, None] for f in ("x1", "y1", "dx", "dy", "l2"))
            t = np.clip(((x - x1) * dx + (y - y1) * dy) / l2, 0.0, 1.0)
            d2 = ((x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2).min(axis=0)
            inside.append(d2 < radius * radius if strict else d2 <= radius * radius)
        assert _run(N.Line(radius, strict), points, pa.table({"_wid": range(60), "_list": lists})) == _brute(points, inside)
        cx, cy = np.array([[s[0]["x1"], s[0]["y1"]] for s in lists]).T
        d = [np.sqrt((x - a) ** 2 + (y - b) ** 2) for a, b in zip(cx, cy, strict=True)]
        assert _run(N.Circle(radius, strict), points, pa.table({"_wid": range(60), "_x": cx, "_y": cy})) == _brute(points, [v < radius if strict else v <= radius for v in d])


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("boundary", [False, True])
def test_polygons_of_a_block(monkeypatch, boundary, few):
    if few:
        monkeypatch.setattr(N, "MARKS", 500)
        monkeypatch.setattr(N, "MATRIX", 100)
        monkeypatch.setattr(N, "SUMS", 2000)
    r = np.random.default_rng(6)
    points, lists, inside = _points(r, 3000), [], []
    x, y = points["_px"].to_numpy(), points["_py"].to_numpy()
    for i in range(60):  # stars that cross themselves, squares, shells with a hole
        p = np.floor(r.uniform(0, SIDE, (r.integers(3, 8), 2))) if i % 2 else r.uniform(0, SIDE, 2) // 1 + 200 * np.array([(0, 0), (1, 0), (1, 1), (0, 1)])
        rings = [p] if i % 4 else [p, p[0] + 50 + 40 * np.array([(0, 0), (0, 1), (1, 1), (1, 0)])]
        e = np.concatenate([np.hstack([q, np.roll(q, -1, axis=0)]) for q in rings]) + np.tile(np.array(BLOCK) * SIDE, 2)
        x1, y1, x2, y2 = (e[:, k, None] for k in range(4))
        with np.errstate(all="ignore"):
            odd = (((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum(axis=0) % 2 == 1
        on = (((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1) == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))).any(axis=0)
        inside.append(odd | on if boundary else odd & ~on)
        lists.append([dict(zip(("x1", "y1", "x2", "y2"), map(float, v), strict=True)) for v in e])
    ys = [[v for g in s for v in (g["y1"], g["y2"])] for s in lists]
    xs = [[v for g in s for v in (g["x1"], g["x2"])] for s in lists]
    windows = pa.table({"_wid": range(60), "_par": pa.array([0] * 60, pa.int32()), "_list": lists, "_ups": pa.array([[]] * 60, pa.list_(pa.float64())),
                        "_x0": list(map(min, xs)), "_y0": list(map(min, ys)), "_x1": list(map(max, xs)), "_y1": list(map(max, ys))})
    assert _run(N.Polygon(boundary), points, windows) == _brute(points, inside)


@pytest.mark.parametrize("name", ["Line", "Polygon"])
def test_windows_are_not_met_one_by_one(monkeypatch, name):
    kind, calls = getattr(N, name), []
    holds = kind.holds
    monkeypatch.setattr(kind, "holds", lambda *a: calls.append(1) or holds(*a))
    r = np.random.default_rng(7)
    points, n = _points(r, 2000), 1000
    at = r.uniform(0, SIDE - 50, (n, 2)) + np.array(BLOCK) * SIDE
    if name == "Line":
        windows = pa.table({"_wid": range(n), "_list": [[{"x1": a, "y1": b, "dx": 40.0, "dy": 10.0, "l2": 1700.0}] for a, b in at]})
        found = _run(N.Line(20.0, True), points, windows)
    else:
        ring = [(0.0, 0.0), (50.0, 0.0), (20.0, 50.0), (0.0, 0.0)]
        lists = [[{"x1": a + p, "y1": b + q, "x2": a + u, "y2": b + v} for (p, q), (u, v) in zip(ring, ring[1:], strict=False)] for a, b in at]
        windows = pa.table({"_wid": range(n), "_par": pa.array([0] * n, pa.int32()), "_list": lists, "_ups": pa.array([[]] * n, pa.list_(pa.float64())),
                            "_x0": at[:, 0], "_y0": at[:, 1], "_x1": at[:, 0] + 50, "_y1": at[:, 1] + 50})
        found = _run(N.Polygon(False), points, windows)
    assert len(found) > n and 0 < len(calls) <= 20
