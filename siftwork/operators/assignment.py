"""Optimal one-to-one assignment in numpy: shortest augmenting paths with potentials, O(n^3)."""

from __future__ import annotations

import numpy as np


def solve(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost that cover the shorter side."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in solve(cost.T))
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for r in range(n):
        dist = np.full(m, np.inf)
        via = np.full(m, -1)
        closed = np.zeros(m, bool)
        row, col, base = r, -1, 0.0
        while True:
            step = base + cost[row] - row_price[row] - col_price
            better = ~closed & (step < dist)
            dist[better], via[better] = step[better], col
            col = int(np.where(closed, np.inf, dist).argmin())
            base = dist[col]
            closed[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        done = np.flatnonzero(closed)
        for c in done:
            gain = base - dist[c]
            col_price[c] -= gain
            if owner[c] >= 0:
                row_price[owner[c]] += gain
        row_price[r] += base
        while col >= 0:  # flip the path
            before = via[col]
            owner[col] = r if before < 0 else owner[before]
            col = before
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def within(cost: np.ndarray, most: float) -> list[tuple[int, int]]:
    """The optimum, then without the pairs that cost more than `most`."""
    return [(r, c) for r, c in solve(cost) if cost[r, c] <= most]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlaps of boxes [n, 4] and [m, 4]."""
    a, b = np.asarray(a, float).reshape(-1, 4), np.asarray(b, float).reshape(-1, 4)
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.prod(np.clip(high - low, 0, None), axis=2)
    size = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    union = size(a)[:, None] + size(b)[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


def equal_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each group of equal rows of `x`, in order; the group of each row)."""
    order = np.lexsort(x.T[::-1])
    new = np.r_[True, (x[order][1:] != x[order][:-1]).any(axis=1)] if len(x) else np.zeros(0, bool)
    first = order[new]  # lexsort is stable, so that it is the smallest index
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    group = np.empty(len(x), int)
    group[order] = rank[np.cumsum(new) - 1]
    return np.sort(first), group


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, each number from low[k] up to high[k])."""
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def overlapping(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, overlap) of the boxes that overlap; along the axis that leaves less, only those near are looked at."""
    tries = []
    for k in (0, 1):
        order = np.argsort(b[:, k], kind="stable")
        begins, widest = b[order, k], max((b[:, k + 2] - b[:, k]).max(initial=0), 0)
        # A box that begins further back than the widest is wide has ended; rounding may cost one step.
        low = np.searchsorted(begins, np.nextafter(a[:, k] - widest, -np.inf) - 1e-9 * np.abs(a[:, k]), "left")
        tries.append((order, low, np.searchsorted(begins, a[:, k + 2], "left")))
    order, low, high = min(tries, key=lambda t: np.maximum(t[2] - t[1], 0).sum())
    i, j = _spread(low, high)
    j = order[j]
    p, q = a[i], b[j]
    inter = np.prod(np.clip(np.minimum(p[:, 2:], q[:, 2:]) - np.maximum(p[:, :2], q[:, :2]), 0, None), axis=1)
    met = inter > 0
    i, j, p, q, inter = i[met], j[met], p[met], q[met], inter[met]
    size = lambda x: np.prod(np.clip(x[:, 2:] - x[:, :2], 0, None), axis=1)
    return i, j, inter / (size(p) + size(q) - inter)


def components(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The component of each of n rows and m columns that edges (a, b) join: its smallest row; columns without an edge have n."""
    rows, cols = np.arange(n), np.full(m, n)
    while True:
        np.minimum.at(cols, b, rows[a])
        now = rows.copy()
        np.minimum.at(now, a, cols[b])
        now = np.minimum(now, now[now])
        if (now == rows).all():
            return rows, cols
        rows = now


def transport(cost: np.ndarray, supply: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Units from rows to columns of least total cost, where a unit that stays costs 1; solve() for rows and columns that count several times."""
    n, m = cost.shape
    cost = np.column_stack([cost, np.ones(n)])  # the last column is staying
    room = np.r_[room, supply.sum()]
    row_price, col_price = np.zeros(n), np.zeros(m + 1)
    flow, left = np.zeros((n, m + 1), int), supply.copy()
    for r in range(n):
        while left[r]:
            dist, via, closed = np.full(m + 1, np.inf), np.full(m + 1, -1), np.zeros(m + 1, bool)
            reached, source = np.full(n, np.inf), np.full(n, -1)  # of a row: its distance and the column that led to it
            reached[r], todo, base = 0.0, [r], 0.0
            while True:
                for i in todo:
                    step = base + cost[i] - row_price[i] - col_price
                    better = ~closed & (step < dist)
                    dist[better], via[better] = step[better], i
                col = int(np.where(closed, np.inf, dist).argmin())
                base, closed[col] = dist[col], True
                if room[col]:
                    break
                todo = [i for i in np.flatnonzero(flow[:, col]) if reached[i] == np.inf]
                reached[todo], source[todo] = base, col
            met = reached < np.inf
            row_price[met] += base - reached[met]
            col_price[closed] -= base - dist[closed]
            path, at = [], col
            while True:
                i = via[at]
                path.append((i, at, source[i]))
                if i == r:
                    break
                at = source[i]
            units = min(left[r], room[col], *[flow[i, back] for i, _, back in path[:-1]])
            for i, to, back in path:
                flow[i, to] += units
                if i != r:
                    flow[i, back] -= units
            left[r] -= units
            room[col] -= units
    return flow[:, :m]


def _by_cost(part: np.ndarray, cost: np.ndarray, group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of the groups that edges (part, group, cost) name: (part, place in the order of cost and member within it, member), and costs."""
    order = np.argsort(side, kind="stable")
    begins = np.searchsorted(side[order], np.arange(side.max(initial=-1) + 2))
    edge, at = _spread(begins[group], begins[group + 1])
    member = order[at]
    sort = np.lexsort((member, cost[edge], part[edge]))
    p = part[edge][sort]
    place = np.arange(len(p)) - np.searchsorted(p, p, "left")
    return p, place, member[sort], cost[edge][sort]


def solve_sparse(a: np.ndarray, b: np.ndarray, cost: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cost) of least total cost among edges (a, b, cost below 1) where all other pairs cost 1 or more.

    As a pair that costs 1 adds what leaving its row and column apart does, components of the edges are solved
    by themselves; the optimum of the whole matrix, without its pairs of cost 1. `rows` and `cols` are the groups of equal
    rows and columns, which the edges name. Among equal costs the smaller indexes are paired, within their component.
    """
    n, m = rows.max(initial=-1) + 1, cols.max(initial=-1) + 1
    part, other = components(a, b, n, m)
    has = np.zeros(n, bool)
    has[a] = True
    n_rows, n_cols = np.bincount(part[has], minlength=n), np.bincount(other[other < n], minlength=n)
    at, found = part[a], []
    for star, (hub, hubs), (leaf, leaves) in ((n_cols[at] == 1, (b, cols), (a, rows)), ((n_cols[at] > 1) & (n_rows[at] == 1), (a, rows), (b, cols))):
        # One group on a side: its members take the cheapest ones of the other side.
        if star.any():
            p, place, member, c = _by_cost(at[star], cost[star], leaf[star], leaves)
            one = np.unique(at[star], return_index=True)[1]
            q, spot, centre, _ = _by_cost(at[star][one], np.zeros(len(one)), hub[star][one], hubs)
            width = max(len(leaves), len(hubs)) + 1
            met = np.searchsorted(q * width + spot, p * width + place)
            ok = np.flatnonzero((met < len(q)) & ((q * width + spot)[np.minimum(met, len(q) - 1)] == p * width + place))
            pair = member[ok], centre[met[ok]]
            found.append((*(pair if leaf is a else pair[::-1]), c[ok]))
    rest = np.flatnonzero((n_cols[at] > 1) & (n_rows[at] > 1))
    rest = rest[np.argsort(at[rest], kind="stable")]
    if len(rest):
        sizes = np.bincount(rows, minlength=n), np.bincount(cols, minlength=m)
        members = [np.split(np.argsort(x, kind="stable"), np.cumsum(np.bincount(x))[:-1]) for x in (rows, cols)]
        for edges in np.split(rest, np.flatnonzero(np.diff(at[rest])) + 1):
            r, i = np.unique(a[edges], return_inverse=True)
            c, j = np.unique(b[edges], return_inverse=True)
            whole = np.ones((len(r), len(c)))
            whole[i, j] = cost[edges]
            flow = transport(whole, sizes[0][r], sizes[1][c])
            used = np.zeros(len(r), int), np.zeros(len(c), int)
            for x, y in zip(*np.nonzero(flow), strict=True):
                if whole[x, y] < 1:
                    k = flow[x, y]
                    found.append((members[0][r[x]][used[0][x] : used[0][x] + k], members[1][c[y]][used[1][y] : used[1][y] + k], np.full(k, whole[x, y])))
                    used[0][x] += k
                    used[1][y] += k
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
