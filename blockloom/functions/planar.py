"""Planar geometry on numpy arrays, for the leaves that SQL expressions cannot state."""

from __future__ import annotations

import struct

import numpy as np

from blockloom.operators.nearby import RING, inside

PRECISION = 1e-12


def read_wkt(text: str) -> list[list[np.ndarray]]:
    """Parts of rings of a polygon or multipolygon text; rings are closed (n + 1, 2) arrays."""
    out: list[list[np.ndarray]] = []
    end = 0
    for m in RING.finditer(text):
        ring = np.array([[float(v) for v in p.split()[:2]] for p in m[1].split(",")])
        if len(ring) and (ring[0] != ring[-1]).any():
            ring = np.vstack([ring, ring[:1]])
        if not out or ")" in text[end : m.start()].replace(" ", "")[:1]:
            out.append([])
        out[-1].append(ring)
        end = m.end()
    return out


def area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


def part_area(part: list[np.ndarray]) -> float:
    return abs(area(part[0])) - sum(abs(area(r)) for r in part[1:])


def largest(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return max(parts, key=part_area)


def centroid(part: list[np.ndarray]) -> np.ndarray:
    base, top, weight = part[0][0], np.zeros(2), 0.0
    for k, ring in enumerate(part):
        p = ring - base
        c = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
        sign = (1 if k == 0 else -1) * (1 if c.sum() >= 0 else -1)
        top += sign * ((p[:-1] + p[1:]) * c[:, None]).sum(axis=0) / 6
        weight += sign * c.sum() / 2
    return base + (top / weight if abs(weight) > PRECISION else (part[0][:-1] - base).mean(axis=0))


def hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise corners of the convex hull."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list[np.ndarray] = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the smallest enclosing rectangle along a hull side, counter-clockwise from the lowest, leftmost one."""
    h = hull(points)
    base = h[0]
    h = h - base
    side = np.roll(h, -1, axis=0) - h
    side = side[np.hypot(*side.T) > PRECISION]
    if not len(side):
        return np.repeat(base[None], 4, axis=0)
    u = side / np.hypot(*side.T)[:, None]
    along, across = h @ u.T, h @ np.stack([-u[:, 1], u[:, 0]])
    sizes = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    k = int(np.argmin(np.round(sizes, 9)))
    a, b, v = along[:, k], across[:, k], np.array([-u[k, 1], u[k, 0]])
    corners = np.array([a.min() * u[k] + b.min() * v, a.max() * u[k] + b.min() * v, a.max() * u[k] + b.max() * v, a.min() * u[k] + b.max() * v])
    first = min(range(4), key=lambda i: (round(corners[i, 1], 6), round(corners[i, 0], 6)))
    return base + np.roll(corners, -first, axis=0)


def rectangle_axes(corners: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(long side, short side, long vector, short vector)."""
    a, b = corners[1] - corners[0], corners[3] - corners[0]
    la, lb = float(np.hypot(*a)), float(np.hypot(*b))
    return (la, lb, a, b) if la >= lb else (lb, la, b, a)


def unit(v: np.ndarray) -> np.ndarray:
    n = np.hypot(*v)
    return v / n if n > PRECISION else np.array([1.0, 0.0])


def reflex(ring: np.ndarray) -> int:
    p = ring[:-1] if area(ring) >= 0 else ring[:-1][::-1]
    a, b = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    return int((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] < 0).sum())


# fixed values: limits of the shape classes
CONVEX_SHARE, FULL_SHARE, OPEN_SHARE, OPEN_CORNERS, CROSS_CORNERS = 0.98, 0.8, 0.6, 3, 4
RECT, L_SHAPE, U_SHAPE, X_SHAPE = range(4)


def fill_share(part: list[np.ndarray]) -> float:
    """Area over the area of the smallest rectangle."""
    a, b, _, _ = rectangle_axes(least_rectangle(part[0]))
    return part_area(part) / max(a * b, 1e-9)


def shape_class(part: list[np.ndarray]) -> int:
    """Filled and convex: rectangle. Holes, or little filled with few inner corners: U. Many inner corners: X. Else L."""
    share, corners = fill_share(part), hull(part[0])
    round_hull = abs(area(np.vstack([corners, corners[:1]]))) if len(corners) > 2 else 0.0
    if part_area(part) >= CONVEX_SHARE * round_hull and share >= FULL_SHARE:
        return RECT
    inner = reflex(part[0])
    if len(part) > 1 or (share < OPEN_SHARE and inner <= OPEN_CORNERS):
        return U_SHAPE
    return X_SHAPE if inner >= CROSS_CORNERS else L_SHAPE


def clipped(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex, counter-clockwise window (open corner lists)."""
    out = subject
    for p, q in zip(window, np.roll(window, -1, axis=0)):
        if not len(out):
            break
        d = (q[0] - p[0]) * (out[:, 1] - p[1]) - (q[1] - p[1]) * (out[:, 0] - p[0])
        rows = []
        for i in range(len(out)):
            j = i - 1
            if (d[i] >= 0) != (d[j] >= 0):
                rows.append(out[j] + (out[i] - out[j]) * (d[j] / (d[j] - d[i])))
            if d[i] >= 0:
                rows.append(out[i])
        out = np.array(rows)
    return out


def overlap(part: list[np.ndarray], convex: np.ndarray) -> float:
    """Area of a polygon within a convex ring (its hull is taken)."""
    window = hull(convex)
    if len(window) < 3:
        return 0.0
    total = 0.0
    for k, ring in enumerate(part):
        c = clipped(ring[:-1], window)
        if len(c) > 2:
            total += (1 if k == 0 else -1) * abs(area(np.vstack([c, c[:1]])))
    return total


def cell_areas(parts: list[list[np.ndarray]], cell: float) -> tuple[np.ndarray, int, int]:
    """(areas, first row, first column): the area of the polygon in every cell of its box; cells at multiples of the size, counted from the origin.

    A cell's share of a ring is the sum over sides of the signed area between the side and the cell's left edge, within the cell.
    """
    points = np.vstack([r for part in parts for r in part])
    c0, r0 = (int(v) for v in np.floor(points.min(axis=0) / cell))
    c1, r1 = (int(v) for v in np.ceil(points.max(axis=0) / cell))
    out = np.zeros((max(r1 - r0, 1), max(c1 - c0, 1)))
    edges = np.arange(out.shape[1] + 1) * cell
    for part in parts:
        for k, ring in enumerate(part):
            left = np.zeros((len(out), len(edges)))
            p = ring - (c0 * cell, r0 * cell)
            for (ax, ay), (bx, by) in zip(p[:-1].tolist(), p[1:].tolist()):
                if ay == by:
                    continue
                lo, hi = int(min(ay, by) // cell), min(int(max(ay, by) // cell) + 1, len(out))
                y = np.clip(np.arange(lo, hi + 1) * cell, min(ay, by), max(ay, by))
                x = np.clip(ax + (y - ay) * ((bx - ax) / (by - ay)), min(ax, bx), max(ax, bx))
                x, high = np.minimum(x[:-1], x[1:])[:, None], np.maximum(x[:-1], x[1:])[:, None]
                width = np.where(high > x, high - x, 1.0)
                upto = np.clip(edges, x, high)
                mean = upto - (upto - x) ** 2 / (2 * width) + np.minimum(edges - x, 0.0)  # of the smaller of the side's x and each edge
                left[lo:hi] += (y[1:] - y[:-1])[:, None] * mean * (1.0 if by > ay else -1.0)
            out += (1 if k == 0 else -1) * np.abs(left[:, 1:] - left[:, :-1])
    return out, r0, c0


def meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of sides (x1, y1, x2, y2) of polygons touch, cross or hold one another."""
    ax, ay, bx, by = (a[:, None, k] for k in range(4))
    cx, cy, dx, dy = (b[None, :, k] for k in range(4))
    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    o1, o2 = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy)
    o3, o4 = turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    boxes = (np.maximum(ax, bx) >= np.minimum(cx, dx)) & (np.maximum(cx, dx) >= np.minimum(ax, bx)) & (np.maximum(ay, by) >= np.minimum(cy, dy)) & (np.maximum(cy, dy) >= np.minimum(ay, by))
    if (boxes & (o1 * o2 <= 0) & (o3 * o4 <= 0)).any():
        return True
    return bool(inside(b, a[:1, 0], a[:1, 1])[0] or inside(a, b[:1, 0], b[:1, 1])[0])


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker, without regard to other lines."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    todo = [(0, len(line) - 1)] if tolerance > 0 else []
    if tolerance <= 0:
        return line
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        u, rel = unit(line[j] - line[i]), line[i + 1 : j] - line[i]
        far = np.abs(u[0] * rel[:, 1] - u[1] * rel[:, 0]) if (line[j] != line[i]).any() else np.hypot(*rel.T)
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return line[keep]


def inner_point(part: list[np.ndarray]) -> np.ndarray:
    """The centroid if it is inside, else the middle of the widest chord at half height."""
    sides = np.vstack([np.hstack([r[:-1], r[1:]]) for r in part])
    c = centroid(part)
    if inside(sides, c[:1], c[1:])[0]:
        return c
    y = (part[0][:, 1].min() + part[0][:, 1].max()) / 2
    up = sides[(sides[:, 1] > y) != (sides[:, 3] > y)]
    x = np.sort(up[:, 0] + (y - up[:, 1]) * (up[:, 2] - up[:, 0]) / (up[:, 3] - up[:, 1]))
    k = int(np.argmax(x[1::2] - x[::2]))
    return np.array([(x[2 * k] + x[2 * k + 1]) / 2, y])


def write_wkb(parts: list[list[np.ndarray]]) -> bytes:
    """Little-endian WKB of a polygon (one part) or multipolygon."""
    def polygon(part):
        return struct.pack("<BII", 1, 3, len(part)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in part)

    return polygon(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


def read_wkb(data: bytes) -> list[list[np.ndarray]]:
    def polygon(at):
        order = "<" if data[at] == 1 else ">"
        n, at, out = struct.unpack_from(order + "I", data, at + 5)[0], at + 9, []
        for _ in range(n):
            k = struct.unpack_from(order + "I", data, at)[0]
            out.append(np.frombuffer(data, order + "f8", 2 * k, at + 4).reshape(-1, 2).astype(float))
            at += 4 + 16 * k
        return out, at

    order = "<" if data[0] == 1 else ">"
    kind, n = struct.unpack_from(order + "II", data, 1)
    if kind == 3:
        return [polygon(0)[0]]
    if kind != 6:
        raise ValueError(f"WKB type {kind} is not supported")
    parts, at = [], 9
    for _ in range(n):
        p, at = polygon(at)
        parts.append(p)
    return parts
