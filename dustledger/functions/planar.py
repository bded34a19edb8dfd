"""Edges and rings of many places at once, as numpy arrays inside a task.

Pairs are sought on a grid as in ``operators.rings`` and made a bounded number at a time. The formulas are those of ``overlay`` and ``geo``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs, or edges of pairs, that are held at a time.
MOST = 1 << 20


def expand(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, k): each row as often as its count says, with k from 0 in each."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def coded(*cols: np.ndarray) -> np.ndarray:
    """A number for each different row of ``cols``, from 0 in their order."""
    order = np.lexsort(cols[::-1])
    fresh = np.zeros(len(order), bool)
    for c in cols:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is linked to."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def slices(counts: np.ndarray, most: int = MOST) -> Iterator[slice]:
    """Consecutive rows whose counts sum up to ``most``, or single rows."""
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, stop)
        start = stop


def pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with a[i] = b[j], about ``MOST`` at a time."""
    order = np.argsort(b, kind="stable")
    first = np.searchsorted(b[order], a, "left")
    n = np.searchsorted(b[order], a, "right") - first
    for part in slices(n):
        row, k = expand(n[part])
        yield part.start + row, order[first[part][row] + k]


def _cells(value: np.ndarray, size: float) -> np.ndarray:
    return np.floor(value / size).astype(np.int64)


def listed(box: Sequence[np.ndarray], size: float, tile: Sequence[np.ndarray], n: int, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cx, cy): the cells that boxes (expanded) touch in their own tiles of n x n cells; a tile of None is everywhere."""
    lo = [_cells(v - margin, size) for v in box[:2]]
    hi = [_cells(v + margin, size) for v in box[2:]]
    if tile is not None:
        lo = [np.maximum(v, t * n) for v, t in zip(lo, tile)]
        hi = [np.minimum(v, t * n + n - 1) for v, t in zip(hi, tile)]
    wide, high = (np.maximum(b - a + 1, 0) for a, b in zip(lo, hi))
    row, k = expand(wide * high)
    return row, lo[0][row] + k % wide[row], lo[1][row] + k // wide[row]


def edge_box(e: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.minimum(e[0], e[2]), np.minimum(e[1], e[3]), np.maximum(e[0], e[2]), np.maximum(e[1], e[3])


def crossed(e: np.ndarray, size: float, tile: Sequence[np.ndarray] | None, n: int, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cx, cy): the cells of ``listed`` that edges (x0, y0, x1, y1) really cross or come within ``margin`` of (per axis)."""
    row, cx, cy = listed(edge_box(e), size, tile, n, margin)
    x0, y0, x1, y1 = e[:, row]
    dx, dy = x1 - x0, y1 - y0
    on = np.abs(dx * ((cy + 0.5) * size - y0) - dy * ((cx + 0.5) * size - x0)) <= (size / 2.0 + margin) * (np.abs(dx) + np.abs(dy)) + 1e-9
    return row[on], cx[on], cy[on]


def snap(value: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark does, halves away from zero."""
    return np.copysign(np.floor(np.abs(value) * 10.0**digits + 0.5), value) / 10.0**digits + 0.0


def side(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (e[2] - e[0]) * (y - e[1]) - (e[3] - e[1]) * (x - e[0])


def point_gap(px: np.ndarray, py: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Distance from points to edges."""
    dx, dy = e[2] - e[0], e[3] - e[1]
    len2 = dx * dx + dy * dy
    s = np.clip(((px - e[0]) * dx + (py - e[1]) * dy) / np.where(len2 > 0, len2, 1.0), 0.0, 1.0)
    ex, ey = px - (e[0] + s * dx), py - (e[1] + s * dy)
    return np.sqrt(ex * ex + ey * ey)


def edge_gap(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Distance of edges, 0 where they cross."""
    cross = (side(e, f[0], f[1]) * side(e, f[2], f[3]) < 0) & (side(f, e[0], e[1]) * side(f, e[2], e[3]) < 0)
    ends = np.minimum(np.minimum(point_gap(e[0], e[1], f), point_gap(e[2], e[3], f)), np.minimum(point_gap(f[0], f[1], e), point_gap(f[2], f[3], e)))
    return np.where(cross, 0.0, ends)


def _together(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    key = coded(*[np.concatenate(c) for c in zip(a, b)])
    return key[:len(a[0])], key[len(a[0]):]


def near_links(sid: np.ndarray, e: np.ndarray, tile: Sequence[np.ndarray], size: float, n: int, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(sid, smallest sid) of rings that chains of gaps of at most ``gap`` link inside a tile. ``e`` are pieces of edges.

    Rings that cross one cell of diagonal ``gap`` are within the gap of each other, so a heap is linked through such cells; only
    pieces of different components of that step are measured.
    """
    ids, who = np.unique(sid, return_inverse=True)
    row, *cell = crossed(e, gap / np.sqrt(2.0), None, 0)
    key = coded(*cell)
    head = np.full(int(key.max()) + 1 if len(key) else 0, len(ids))
    np.minimum.at(head, key, who[row])
    label = components(len(ids), who[row], head[key])
    a, *at_a = crossed(e, size, tile, n)
    b, *at_b = crossed(e, size, tile, n, gap)
    box, part, found = np.stack(edge_box(e)), label[who], []
    # the margin covers the rounding of the gap
    reach = gap + 1e-6
    for i, j in pairs(*_together(tuple(at_a), tuple(at_b))):
        i, j = a[i], b[j]
        some = part[i] < part[j]
        i, j = i[some], j[some]
        p, q = box[:, i], box[:, j]
        some = (p[2] + reach >= q[0]) & (q[2] + reach >= p[0]) & (p[3] + reach >= q[1]) & (q[3] + reach >= p[1])
        i, j = i[some], j[some]
        some = edge_gap(e[:, i], e[:, j]) <= gap
        found.append(np.unique(part[i[some]] * len(ids) + part[j[some]]))
    links = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    label = components(len(ids), links // len(ids), links % len(ids))[label]
    linked = np.flatnonzero(label != np.arange(len(ids)))
    return ids[linked], ids[label[linked]]


def cut_marks(group: np.ndarray, rid: np.ndarray, e: np.ndarray, tile: Sequence[np.ndarray], size: float, n: int, digits: int) -> Iterator[tuple[slice, tuple[np.ndarray, ...]]]:
    """Slices of edges with (row, t, x, y): where they are crossed or touched by edges of other rings of their group, inside a tile.

    A crossing is computed from the one of its edges that comes first by the coordinates, so that both meet in it.
    """
    eps = 10.0**-digits
    rank = coded(*e)
    box, row, *cell = np.stack(edge_box(e)), *crossed(e, size, tile, n, 2 * eps)
    key = coded(group[row], *cell)
    first = np.searchsorted(row, np.arange(len(rid) + 1))
    many = np.bincount(row, np.bincount(key)[key] if len(key) else None, len(rid)).astype(np.int64)
    for part in slices(many):
        out = [(np.empty(0, np.int64), *[np.empty(0)] * 3)]
        mine = slice(first[part.start], first[part.stop])
        for i, j in pairs(key[mine], key):
            i, j = row[mine][i], row[j]
            some = rid[i] != rid[j]
            i, j = i[some], j[some]
            p, q = box[:, i], box[:, j]
            some = (p[2] + 2 * eps >= q[0]) & (q[2] + 2 * eps >= p[0]) & (p[3] + 2 * eps >= q[1]) & (q[3] + 2 * eps >= p[1])
            i, j = i[some], j[some]
            a, b = e[:, i], e[:, j]
            dx, dy = a[2] - a[0], a[3] - a[1]
            a0, a1, b0, b1 = side(b, a[0], a[1]), side(b, a[2], a[3]), side(a, b[0], b[1]), side(a, b[2], b[3])
            c = np.flatnonzero((a0 * a1 < 0) & (b0 * b1 < 0))
            t, u, ours = a0[c] / (a0[c] - a1[c]), b0[c] / (b0[c] - b1[c]), rank[i[c]] < rank[j[c]]
            x, y = (snap(np.where(ours, a[k][c] + t * (a[k + 2] - a[k])[c], b[k][c] + u * (b[k + 2] - b[k])[c]), digits) for k in (0, 1))
            out.append((i[c], t, x, y))
            for s, x, y in ((b0, b[0], b[1]), (b1, b[2], b[3])):
                on = np.abs(s) <= np.sqrt(dx * dx + dy * dy) * eps
                out.append((i[on], (((x - a[0]) * dx + (y - a[1]) * dy) / (dx * dx + dy * dy))[on], x[on], y[on]))
        marks = tuple(np.concatenate(c) for c in zip(*out))
        on = (marks[1] > 0) & (marks[1] < 1)
        yield part, tuple(c[on] for c in marks)


def sub_edges(row: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, edges): edges cut at their marks; marks at one point count once, with the smallest t."""
    order = np.lexsort((t, y, x, row))
    row, t, x, y = row[order], t[order], x[order], y[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    row, t, x, y = row[fresh], t[fresh], x[fresh], y[fresh]
    order = np.lexsort((y, x, t, row))
    row, x, y = row[order], x[order], y[order]
    on = np.flatnonzero(row[1:] == row[:-1])
    return row[on], np.stack([x[on], y[on], x[on + 1], y[on + 1]])


def single_parts(group: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, edges): parts with rings on one side only, each once. With rings on both sides the union goes through a part."""
    ahead = (e[0] < e[2]) | ((e[0] == e[2]) & (e[1] < e[3]))
    key = coded(group, *np.where(ahead, e, e[[2, 3, 0, 1]]))
    _, row, n = np.unique(key, return_index=True, return_counts=True)
    k = np.bincount(key, ahead)
    row = row[(k == 0) | (k == n)]
    return row, e[:, row]


def covered(group: np.ndarray, x: np.ndarray, y: np.ndarray, ring_group: np.ndarray, start: np.ndarray, size_of: np.ndarray, rx: np.ndarray, ry: np.ndarray,
            tile: Sequence[np.ndarray], size: float, n: int, digits: int) -> np.ndarray:
    """Whether points lie inside a ring of their group and not on its line. Ring i has ``size_of[i]`` corners in rx, ry from ``start[i]`` on."""
    out = np.zeros(len(x), bool)
    if not len(x) or not len(start):
        return out
    at, k = expand(size_of)
    corner = start[at] + k
    follow = start[at] + (k + 1) % size_of[at]
    e = np.stack([rx[corner], ry[corner], rx[follow], ry[follow]])
    first = np.cumsum(size_of) - size_of
    box = [f.reduceat(v, first) for f, v in ((np.minimum, e[0]), (np.minimum, e[1]), (np.maximum, e[0]), (np.maximum, e[1]))]
    row, *cell = listed(box, size, tile, n)
    mine, theirs = _together((group, _cells(x, size), _cells(y, size)), (ring_group[row], *cell))
    order = np.argsort(theirs, kind="stable")
    begin = np.searchsorted(theirs[order], mine, "left")
    many = np.searchsorted(theirs[order], mine, "right") - begin
    # a few rings first: in a heap most points are covered by one of them and need no other
    left, at, wide = np.flatnonzero(many), 0, 1
    while len(left):
        take = np.minimum(many[left] - at, wide)
        for some in slices(take):
            i, k = expand(take[some])
            i = left[some][i]
            j = row[order[begin[i] + at + k]]
            within = (x[i] > box[0][j]) & (x[i] < box[2][j]) & (y[i] > box[1][j]) & (y[i] < box[3][j])
            i, j = i[within], j[within]
            for part in slices(size_of[j]):
                p, q = i[part], j[part]
                pair, k = expand(size_of[q])
                f = e[:, first[q][pair] + k]
                px, py = x[p][pair], y[p][pair]
                up = (f[1] > py) != (f[3] > py)
                hit = up & (px < (f[2] - f[0]) * (py - f[1]) / np.where(up, f[3] - f[1], 1.0) + f[0])
                on = np.bincount(pair, point_gap(px, py, f) <= 2 * 10.0**-digits, len(p)) > 0
                out[p[(np.bincount(pair, hit, len(p)) % 2 == 1) & ~on]] = True
        at, wide = at + wide, 2 * wide
        left = left[(many[left] > at) & ~out[left]]
    return out


def successors(group: np.ndarray, e: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For parts that end here the part that goes on from there around the same corner of the union, else -1.

    ``starts`` and ``ends`` tell which parts start and end in the place. Of the parts that leave a point the first one clockwise counts.
    """
    out, into = np.flatnonzero(starts), np.flatnonzero(ends)
    at_in, at_out = _together((group[into], e[2][into], e[3][into]), (group[out], e[0][out], e[1][out]))
    back = np.arctan2(e[1] - e[3], e[0] - e[2])
    to = np.arctan2(e[3] - e[1], e[2] - e[0])
    onward = np.full(len(group), -1)
    for i, j in pairs(at_in, at_out):
        i, j = into[i], out[j]
        order = np.lexsort((j, np.mod(back[i] - to[j] - 1e-12, 2 * np.pi), i))
        i, j = i[order], j[order]
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]
        onward[i[first]] = j[first]
    return onward


def simple_loops(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """Simple loops of one closed walk, cut where it meets a point again."""
    if len(set(points)) == len(points):
        return [points] if len(points) > 2 else []
    loops, walk, seen = [], [], {}
    for point in points:
        if point in seen:
            cut = seen[point]
            loops.append(walk[cut:])
            for old in walk[cut + 1:]:
                del seen[old]
            del walk[cut + 1:]
        else:
            seen[point] = len(walk)
            walk.append(point)
    return [loop for loop in [*loops, walk] if len(loop) > 2]


def walks(onward: np.ndarray, x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[list, list]:
    """(closed, open) walks along ``onward``: closed as (first part, points); open ones, from outside of the place until they leave it, as
    (first part, the part that leaves, the points before that part's start). Points are the starts of parts.
    """
    follow, place = onward.tolist(), list(zip(x.tolist(), y.tolist()))
    done = [False] * len(follow)
    closed, opened = [], []
    for first in np.flatnonzero(~starts).tolist():
        walk, at = [], first
        while follow[at] >= 0 and not done[at]:
            done[at] = True
            walk.append(place[at])
            at = follow[at]
        if done[at]:
            raise ValueError("an outline does not close")
        done[at] = True
        if walk:
            opened.append((first, at, walk))
    for first in range(len(follow)):
        if not done[first]:
            walk, at = [], first
            while follow[at] >= 0 and not done[at]:
                done[at] = True
                walk.append(place[at])
                at = follow[at]
            if at != first:
                raise ValueError("an outline does not close")
            closed.append((first, walk))
    return closed, opened
