"""Near 64-bit hashes in numpy: all pairs of two arrays within a distance, and forests that span them.

A pair within t bits has, of the m chunks of its hashes, one that differs by at most r_k bits, if the r_k add up to t + 1 - m. So
each array is sorted by the value of a chunk, and the hashes of one value meet those of the values within r_k bits. Which chunks,
or all with all, is chosen by cost; each way is complete.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np

BITS = 64
#: Nanoseconds for one comparison, to look up the hashes of one chunk value, one value near it, and to fetch one hash; for one near value of one hash, and one comparison, where hashes are looked up one by one.
PAIR_COST, CELL_COST, MASK_COST, FETCH_COST, LOOK_COST, SINGLE_COST = 1.4, 25_000, 12, 6, 10, 12
#: Comparisons at once, and columns of them; matches held before they are given on.
BLOCK, WIDE, HELD = 1 << 17, 1 << 16, 1 << 20
#: Most values near one of a chunk.
MOST_MASKS = 20_000
#: Chunk values this near are looked up first, as they hold most matches in few comparisons.
FIRST_RADIUS = 1


class Chunk(NamedTuple):
    shift: int
    width: int
    radius: int


def near_values(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(min(radius, width) + 1))


@functools.cache
def masks(width: int, radius: int, least: int = 0) -> np.ndarray:
    """All masks of ``least`` to ``radius`` bits, fewest first."""
    return np.array([sum(1 << b for b in on) for k in range(least, min(radius, width) + 1) for on in combinations(range(width), k)], np.int64)


def chunks(number: int, threshold: int) -> list[Chunk]:
    """``number`` chunks, the highest first, and how far one of them must be within if a pair is within ``threshold``."""
    out, shift, spare = [], BITS, threshold + 1 - number
    for k in range(number):
        width = shift // (number - k)
        shift -= width
        # what doesn't divide goes to the last ones: of a fingerprint, the first bits say least
        out.append(Chunk(shift, width, spare // number + (k >= number - spare % number)))
    return out


def cost(plan: list[Chunk], n_left: int, n_right: int, same: bool) -> float:
    """Nanoseconds; of no chunks, to compare all with all."""
    half = 2 if same else 1
    if not plan:
        return n_left * n_right / half * PAIR_COST
    return sum(min(_costs(c, near_values(c.width, c.radius), n_left, n_right, half)) for c in plan)


def _costs(c: Chunk, values: int, n_left: int, n_right: int, half: int) -> tuple[float, float]:
    """By chunk value, all of its hashes at once; by single hashes."""
    cells, share = min(n_left, 1 << c.width), values / (1 << c.width)
    by_value = cells * (CELL_COST + values * MASK_COST + n_right * share * FETCH_COST / half) + n_left * n_right * share * PAIR_COST / half
    return by_value, n_left * (values * LOOK_COST + n_right * share * SINGLE_COST / half)


def plan_for(threshold: int, n_left: int, n_right: int, same: bool) -> list[Chunk]:
    able = [p for p in (chunks(m, threshold) for m in range(3, min(threshold + 1, 8) + 1)) if max(near_values(c.width, c.radius) for c in p) <= MOST_MASKS]
    return min([[], *able], key=lambda p: cost(p, n_left, n_right, same))


def differing(x: np.ndarray, y: np.ndarray, c: Chunk) -> np.ndarray:
    return np.bitwise_count((x ^ y) >> np.uint64(c.shift) & np.uint64((1 << c.width) - 1))


class _Space:
    """Memory for one block, used again: fresh pages would cost more than the comparisons."""

    def __init__(self) -> None:
        self.bits, self.dist, self.within = np.empty(BLOCK + WIDE, np.uint64), np.empty(BLOCK + WIDE, np.uint8), np.empty(BLOCK + WIDE, bool)


def _hits(x: np.ndarray, y: np.ndarray, threshold: int, space: _Space) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for low in range(0, len(y), WIDE):
        some = y[low : low + WIDE]
        step = max(1, BLOCK // len(some))
        for at in range(0, len(x), step):
            rows = x[at : at + step, None]
            n = len(rows) * len(some)
            bits, dist, within = space.bits[:n], space.dist[:n], space.within[:n]
            np.bitwise_xor(rows, some, out=bits.reshape(len(rows), len(some)))
            np.bitwise_count(bits, out=dist)
            hit = np.flatnonzero(np.less_equal(dist, threshold, out=within))
            if len(hit):
                i, j = np.divmod(hit, len(some))
                yield i + at, j + low, dist[hit]


def _all(left: np.ndarray, right: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    space = _Space()
    for at in range(0, len(left), 256) if same else (0,):
        x, y = (left[at : at + 256], right[at:]) if same else (left, right)
        for i, j, d in _hits(x, y, threshold, space):
            keep = i < j if same else slice(None)
            yield i[keep] + at, j[keep] + at, d[keep]


def _in_chunk(left: np.ndarray, right: np.ndarray, threshold: int, same: bool, c: Chunk, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and distance of pairs whose chunk ``c`` differs by ``least`` to ``c.radius`` bits."""
    near = masks(c.width, c.radius, least)
    if not len(near) or not len(left) or not len(right):
        return
    kind = np.uint16 if c.width <= 16 else np.uint32
    of = lambda bits: (bits >> np.uint64(c.shift) & np.uint64((1 << c.width) - 1)).astype(kind)
    own, other = of(left), of(right)
    by_left, by_right = np.argsort(own, kind="stable"), np.argsort(other, kind="stable")
    x, y, own = left[by_left], right[by_right], own[by_left].astype(np.int64)
    count = np.bincount(other, minlength=1 << c.width)
    start = np.cumsum(count) - count
    by_value, by_hash = _costs(c, len(near), len(left), len(right), 2 if same else 1)
    found = _by_value(x, y, own, near, count, start, threshold, same) if by_value < by_hash else _by_hash(x, y, own, near, count, start, threshold, same)
    for i, j, d in found:
        p, q = by_left[i], by_right[j]
        if same and not least:  # the two of one value come in both orders
            keep = (p < q) | ((x[i] ^ y[j]) >> np.uint64(c.shift) & np.uint64((1 << c.width) - 1) != 0)
            p, q, d = p[keep], q[keep], d[keep]
        yield p, q, d


def _by_value(x: np.ndarray, y: np.ndarray, own: np.ndarray, near: np.ndarray, count: np.ndarray, start: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All hashes of a value against all of the values near it."""
    values, begins = np.unique(own, return_index=True)
    ends = [*begins[1:].tolist(), len(x)]
    numbers, space = np.arange(len(y)), _Space()
    for v, begin, end in zip(values.tolist(), begins.tolist(), ends):
        cells = near ^ v
        if same:
            cells = cells[cells >= v]
        n = count[cells]
        total = int(n.sum())
        if not total:
            continue
        at = np.repeat(start[cells] - (np.cumsum(n) - n), n) + numbers[:total]
        for i, j, d in _hits(x[begin:end], y[at], threshold, space):
            yield begin + i, at[j], d


def _by_hash(x: np.ndarray, y: np.ndarray, own: np.ndarray, near: np.ndarray, count: np.ndarray, start: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same hash by hash: cheaper where few hashes share a value."""
    low = 0
    step = most = max(1, BLOCK // len(near))
    while low < len(x):
        v = own[low : low + step]
        cells = near ^ v[:, None]
        n = count[cells]
        if same:
            n[cells < v[:, None]] = 0
        each = n.sum(axis=1)
        sums = np.cumsum(each)
        if sums[-1] > 4 * BLOCK and len(v) > 1:  # many share these values: fewer at once
            step = max(1, int(np.searchsorted(sums, 2 * BLOCK)))
            continue
        low, step = low + len(v), min(most, 2 * step)
        flat = n.ravel()
        has = np.flatnonzero(flat)
        n, cells = flat[has], cells.ravel()[has]
        j = np.repeat(start[cells] - (np.cumsum(n) - n), n) + np.arange(int(sums[-1]))
        i = np.repeat(np.arange(low - len(v), low), each)
        d = np.bitwise_count(x[i] ^ y[j])
        hit = np.flatnonzero(d <= threshold)
        if len(hit):
            yield i[hit], j[hit], d[hit]


def _gathered(found: Iterator[tuple]) -> Iterator[tuple]:
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def pairs(left: np.ndarray, right: np.ndarray, threshold: int, same: bool, some: list[Chunk] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of all pairs of left[i] and right[j] (uint64) within ``threshold``, each once, in bounded parts.

    ``same``: both are one array of different hashes, whose pairs have i <> j and come in one order. ``some``: only pairs of which one of these chunks is within its radius.
    """
    if not len(left) or not len(right):
        return
    plan = plan_for(threshold, len(left), len(right), same) if some is None else some if cost(some, len(left), len(right), same) < cost([], len(left), len(right), same) else []
    if not plan:
        for i, j, d in _gathered(_all(left, right, threshold, same)):
            if some is not None:
                keep = np.any([differing(left[i], right[j], c) <= c.radius for c in some], axis=0)
                i, j, d = i[keep], j[keep], d[keep]
            yield i, j, d
        return
    for k, c in enumerate(plan):
        for i, j, d in _gathered(_in_chunk(left, right, threshold, same, c)):
            # an earlier chunk has given the pair already if it is within its radius
            keep = np.all([differing(left[i], right[j], e) > e.radius for e in plan[:k]], axis=0) if k else slice(None)
            yield i[keep], j[keep], d[keep]


def forest(n: int, x: np.ndarray, y: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of edges (x, y) of nodes 0 to n - 1 that span what all of them join, earlier ones preferred (Borůvka), and each node's label.

    ``label``: what is joined already.
    """
    label, chosen = np.arange(n) if label is None else label, [np.zeros(0, np.int64)]
    live = np.arange(len(x))
    while True:
        a, b = label[x[live]], label[y[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            return np.sort(np.concatenate(chosen)), label
        best = np.full(n, len(x))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        at = np.flatnonzero(best < len(x))
        edge = best[at]
        chosen.append(np.unique(edge))
        to = label[x[edge]]
        to = np.where(to == at, label[y[edge]], to)
        parent = np.arange(n)
        parent[at] = to
        roots = at[(parent[to] == at) & (at < to)]  # two that chose the same edge
        parent[roots] = roots
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        label = parent[label]


class Spanning:
    """A spanning forest of edges that come in parts: nodes 0 to n - 1, levels ascending in worth; memory goes with n, not with the edges."""

    def __init__(self, n: int, levels: int = 1):
        self.n, self.levels = n, levels
        self.label = np.arange(n)
        none = np.zeros(0, np.int64)
        self.x, self.y, self.level = none, none, none
        self._new: list[tuple] = []
        self._held = 0

    def add(self, x: np.ndarray, y: np.ndarray, level: np.ndarray) -> None:
        # an edge between what is joined can only matter to a lower level
        keep = self.label[x] != self.label[y] if self.levels == 1 else x != y
        self._new.append((x[keep], y[keep], level[keep]))
        self._held += int(np.count_nonzero(keep))
        if self._held > max(HELD, self.n):
            self.settle()

    def settle(self) -> None:
        if not self._new:
            return
        x, y, level = (np.concatenate(c) for c in zip((self.x, self.y, self.level), *self._new))
        self._new, self._held = [], 0
        order = np.argsort(level, kind="stable") if self.levels > 1 else np.arange(len(x))
        x, y, level = x[order], y[order], level[order]
        kept, self.label = forest(self.n, x, y)
        self.x, self.y, self.level = x[kept], y[kept], level[kept]

    def dominant(self) -> int:
        return int(np.argmax(np.bincount(self.label, minlength=self.n)))


def spanning(left: np.ndarray, right: np.ndarray, left_key: np.ndarray, right_key: np.ndarray, thresholds: list[int], same: bool, some: list[Chunk] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, key, threshold): edges whose components at each of the ascending ``thresholds`` are those of all pairs (``pairs``) within it, each hash standing for its key.

    At one threshold, pairs of what is joined already needn't be looked at: once near chunk values have joined most hashes, only the others are compared with all.
    """
    ids, at = np.unique(np.concatenate((left_key, right_key)), return_inverse=True)
    of_left, of_right = at[: len(left)], at[len(left) :]
    steps, most = np.array(thresholds), thresholds[-1]
    state = Spanning(len(ids), len(thresholds))

    def take(found: Iterator[tuple], i_of: np.ndarray, j_of: np.ndarray) -> None:
        for i, j, d in _gathered(found):
            state.add(i_of[i], j_of[j], np.searchsorted(steps, d))

    if len(left) and len(right):
        plan = some if some is not None else plan_for(most, len(left), len(right), same)
        if len(thresholds) > 1 or not plan or max(c.radius for c in plan) <= FIRST_RADIUS or cost(plan, len(left), len(right), same) > cost([], len(left), len(right), same):
            take(pairs(left, right, most, same, some), of_left, of_right)
        else:
            for c in plan:
                take(_in_chunk(left, right, most, same, c._replace(radius=min(c.radius, FIRST_RADIUS))), of_left, of_right)
            for c in plan:
                if c.radius <= FIRST_RADIUS:
                    continue
                state.settle()
                main = state.dominant()
                out_left, out_right = np.flatnonzero(state.label[of_left] != main), np.flatnonzero(state.label[of_right] != main)
                ways = len(out_left) * len(right) + (0 if same else (len(left) - len(out_left)) * len(out_right))
                if ways < 0.7 * len(left) * len(right) / (2 if same else 1):
                    take(_in_chunk(left[out_left], right, most, False, c, FIRST_RADIUS + 1), of_left[out_left], of_right)
                    if not same and len(out_right):
                        rest = np.flatnonzero(state.label[of_left] == main)
                        take(_in_chunk(right[out_right], left[rest], most, False, c, FIRST_RADIUS + 1), of_right[out_right], of_left[rest])
                else:
                    take(_in_chunk(left, right, most, same, c, FIRST_RADIUS + 1), of_left, of_right)
    state.settle()
    return ids[state.x], ids[state.y], steps[state.level]
