"""NumPy kernels on bounded state: distance blocks, spanning trees, linkage, condensed trees, eigenpairs.

Operators hand these a block of a larger problem, or a model-sized one whose size they have checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

COSINE_EPS = 1e-8


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By the Gram identity, never below 0."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.maximum(out, 0, out=out)


#: Distances by differences are summed up in pieces of so many, which stay in a core's cache.
PIECE = 1 << 15


def _summed(a: np.ndarray, b: np.ndarray, each: Callable) -> np.ndarray:
    """The sum over features of each(difference, out=difference), for all pairs of rows."""
    out, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    step = max(1, PIECE // max(1, len(b)))
    for low in range(0, len(a), step):
        part, rows = out[low : low + step], np.ascontiguousarray(a[low : low + step].T)
        d = np.empty_like(part)
        for x, y in zip(rows, columns, strict=True):
            np.subtract(x[:, None], y[None, :], out=d)
            each(d, out=d)
            part += d
    return out


def exact_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By differences: exact zeros for equal rows."""
    return _summed(a, b, np.square)


def in_order(squares: np.ndarray) -> np.ndarray:
    """Sums of rows, added up in the order of features, as by `exact_squared`."""
    out = np.zeros(len(squares))
    for column in squares.T:
        out += column
    return out


def refined_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By the Gram identity, and by differences where it would lose more than six digits; in pieces as `_summed`."""
    p, q = (a * a).sum(1), (b * b).sum(1)
    if not (np.isfinite(p).all() and np.isfinite(q).all()):
        return exact_squared(a, b)
    out, columns = np.empty((len(a), len(b))), np.ascontiguousarray(b.T)
    step = max(8, 4 * PIECE // max(1, len(b)))
    for low in range(0, len(a), step):
        part, rows, size = out[low : low + step], a[low : low + step], p[low : low + step]
        np.matmul(-2 * rows, columns, out=part)
        part += size[:, None]
        part += q
        near = part < 1e-6 * (size.max() + q)
        count = np.count_nonzero(near)
        if count > 0.02 * near.size:
            part[:] = exact_squared(rows, b)
        elif count:
            i, j = np.nonzero(near)
            d = rows[i] - b[j]
            part[i, j] = (d * d).sum(1)
    return out


def refined_manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By twice the sums of the larger values less the sums of all, and by differences where that would lose digits."""
    most = np.abs(a).sum(1).max(initial=0) + np.abs(b).sum(1).max(initial=0)
    if not most * a.shape[1] < 1e6:
        return _summed(a, b, np.abs)
    out, columns, ones = np.empty((len(a), len(b))), np.ascontiguousarray(b.T), np.ones(a.shape[1])
    larger = np.empty_like(columns)
    for x, row in zip(a, out, strict=True):
        np.maximum(columns, x[:, None], out=larger)
        np.dot(ones, larger, out=row)
    out *= 2
    out -= a.sum(1)[:, None]
    out -= b.sum(1)
    i, j = np.nonzero(out < 1e-6 * most)
    if len(i) > 0.02 * out.size:
        return _summed(a, b, np.abs)
    out[i, j] = in_order(np.abs(a[i] - b[j]))
    return out


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean", plain_cosine: bool = False) -> np.ndarray:
    """plain_cosine: zero vectors have cosine distance 0, as agglomerative clustering takes it."""
    if metric == "euclidean":
        out = exact_squared(a, b)
        return np.sqrt(out, out=out)
    if metric == "manhattan":
        return _summed(a, b, np.abs)
    if metric == "cosine":
        scale = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        if not plain_cosine:
            scale += COSINE_EPS
            out = a @ b.T
            out /= scale
            return np.subtract(1, out, out=out)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(scale == 0, 0.0, np.maximum(0, 1 - (a @ b.T) / scale))
    raise ValueError(f"unknown metric {metric!r}")


def normalize_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, 1, size)


# --- spanning trees and hierarchies ---------------------------------------------------------------------------------


def spanning_tree(d: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges of the minimum spanning tree, grown from node 0; the first of equal candidates is taken."""
    n = len(d)
    near, parent, out = np.full(n, np.inf), np.full(n, -1), []
    inside = np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = (d[at] < near) & ~inside
        near[closer] = d[at][closer]
        parent[closer] = at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        if inside[at] or not np.isfinite(near[at]):
            raise ValueError("the graph is not connected")
        out.append((min(at, int(parent[at])), max(at, int(parent[at])), float(near[at])))
    return out


def cross_tree(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each edge of the minimum spanning tree of the graph between the rows and the columns of d."""
    n, m = d.shape
    columns = np.ascontiguousarray(d.T)
    # What is inside is at infinity in `near`, and in `least` no lower than -infinity lets in.
    near, parent = np.full(n + m, np.inf), np.zeros(n + m, np.int64)
    least, at, out = np.full(n + m, np.inf), 0, np.empty((n + m - 1, 2), np.int64)
    least[0] = -np.inf
    for k in range(n + m - 1):
        side, row = (slice(n, None), d[at]) if at < n else (slice(0, n), columns[at - n])
        closer = row < least[side]
        least[side][closer] = row[closer]
        near[side][closer] = row[closer]
        parent[side][closer] = at
        at = int(near.argmin())
        if not np.isfinite(near[at]):
            raise ValueError("the graph is not connected")
        out[k] = (parent[at], at - n) if at >= n else (at, parent[at] - n)
        near[at], least[at] = np.inf, -np.inf
    return out[:, 0], out[:, 1]


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest of edges i < j, equal weights by (i, j): in rounds each
    component takes its least edge."""
    order = np.lexsort((j, i, d))
    a, b, label, kept = i[order], j[order], np.arange(n), []
    places = np.arange(len(order))
    while len(places):
        x, y = label[a[places]], label[b[places]]
        apart = x != y
        places, x, y = places[apart], x[apart], y[apart]
        if not len(places):
            break
        least = np.full(n, -1)
        # Of equal indices the last one stays, which is the least edge.
        least[x[::-1]] = places[::-1]
        other = np.full(n, -1)
        other[y[::-1]] = places[::-1]
        least = np.where((least < 0) | (other >= 0) & (other < least), other, least)
        chosen = np.unique(least[least >= 0])
        kept.append(chosen)
        p, q = label[a[chosen]], label[b[chosen]]
        to = np.arange(n)
        while True:
            new = to.copy()
            np.minimum.at(new, p, to[q])
            np.minimum.at(new, q, to[p])
            new = new[new]
            if (new == to).all():
                break
            to = new
        label = to[label]
    return order[np.sort(np.concatenate(kept))] if kept else order[:0]


class Union:
    """Disjoint sets with path halving."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x


def single_linkage(edges: Iterable[tuple[int, int, float]], n: int) -> np.ndarray:
    """Rows (left, right, distance, size) of the hierarchy that edges in ascending weight build; ids from n are merges."""
    union, name, size, out = Union(2 * n), list(range(2 * n)), [1] * n + [0] * n, []
    for k, (a, b, w) in enumerate(sorted(edges, key=lambda e: e[2])):
        ra, rb = union.find(a), union.find(b)
        left, right = name[ra], name[rb]
        union.root[rb] = ra
        name[ra] = n + k
        size[n + k] = size[left] + size[right]
        out.append((left, right, w, size[n + k]))
    return np.array(out, float).reshape(-1, 4)


def linkage_update(kind: str, ik: np.ndarray, jk: np.ndarray, ij: float, ni: float, nj: float, nk: np.ndarray) -> np.ndarray:
    """Distances of the union of i and j to clusters k."""
    if kind == "single":
        return np.minimum(ik, jk)
    if kind == "complete":
        return np.maximum(ik, jk)
    if kind == "average":
        return (ni * ik + nj * jk) / (ni + nj)
    if kind == "ward":
        total = ni + nj + nk
        return np.sqrt(np.maximum(0, ((ni + nk) * ik * ik + (nj + nk) * jk * jk - nk * ij * ij) / total))
    raise ValueError(f"unknown linkage {kind!r}")


def neighbour_chain(d: np.ndarray, kind: str) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) in ascending distance, with ids from n for merges. d is used up. A chain starts at
    the lowest open cluster and follows nearest neighbours until two are each other's; ties go to where it came from."""
    return ordered_merges(chain_merges(d, kind), len(d))


def chain_merges(d: np.ndarray, kind: str, sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """(distance, low, high) in the order in which the chain finds them; the union goes by its higher number."""
    n = len(d)
    size, open_ = np.ones(n) if sizes is None else np.array(sizes, float), np.ones(n, bool)
    np.fill_diagonal(d, np.inf)
    chain: list[int] = []
    found: list[tuple[float, int, int]] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.argmax(open_)))
        while True:
            at = chain[-1]
            row = np.where(open_, d[at], np.inf)
            row[at] = np.inf
            best = int(np.argmin(row))
            if len(chain) > 1 and not row[best] < row[chain[-2]]:
                best = chain[-2]
            if len(chain) > 1 and best == chain[-2]:
                break
            chain.append(best)
        b, a = chain.pop(), chain.pop()
        low, high = min(a, b), max(a, b)
        found.append((float(d[a, b]), low, high))
        others = open_.copy()
        others[[low, high]] = False
        new = linkage_update(kind, d[low], d[high], float(d[low, high]), size[low], size[high], size)
        d[high, others] = new[others]
        d[others, high] = new[others]
        size[high] += size[low]
        open_[low] = False
    return found


def linkage_rows(x: np.ndarray, starts: np.ndarray, clusters: np.ndarray, kind: str, metric: str, most: int = 1 << 21) -> np.ndarray:
    """Distances of some clusters to all, a row for each of them. x has the points of cluster k from starts[k] on: for
    complete and average linkage from all pairs of points, for ward linkage (x, starts) are the means and the sizes."""
    if kind == "ward":
        d = refined_squared(x[clusters], x)
        own = starts[clusters][:, None]
        d *= 2 * own * starts / (own + starts)
        return np.sqrt(np.maximum(d, 0, out=d), out=d)
    ends = np.append(starts[1:], len(x))
    sizes, reduce = ends - starts, np.maximum if kind == "complete" else np.add
    out, step = np.zeros((len(clusters), len(starts))), max(1, most // len(x))
    rows = np.concatenate([np.arange(starts[k], ends[k]) for k in clusters])
    home = np.repeat(np.arange(len(clusters)), sizes[clusters])
    for low in range(0, len(rows), step):
        own, some = home[low : low + step], x[rows[low : low + step]]
        if metric == "euclidean":
            d = refined_squared(some, x)
            d = np.sqrt(d, out=d)
        else:
            d = distances(some, x, metric, plain_cosine=True)
        if len(starts) < len(x):
            d = reduce.reduceat(d, starts, 1)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        d = reduce.reduceat(d, first, 0)
        out[own[first]] = reduce(out[own[first]], d)
    return out if kind == "complete" else out / (sizes[clusters][:, None] * sizes)


#: Rounding of single precision.
SINGLE = 2.0**-24
#: Rows and columns of the blocks of a search in single precision.
SEARCHED = 512


def pair_linkage(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, kind: str, metric: str) -> np.ndarray:
    """Complete or average distances of pairs of clusters a[k] and b[k], which have the points from starts to ends."""
    reduce, p, q = np.maximum if kind == "complete" else np.add, ends - starts, ends - starts
    many, out = p[a] * q[b], np.empty(len(a))
    small = np.flatnonzero(many <= 256)
    done = np.concatenate(([0], np.cumsum(many[small])))
    at = 0
    while at < len(small):  # pairs of points one by one
        end = max(at + 1, int(np.searchsorted(done, done[at] + PIECE, "right")) - 1)
        some = small[at:end]
        size, first = many[some], done[at:end] - done[at]
        k = np.arange(size.sum()) - np.repeat(first, size)
        width = np.repeat(q[b[some]], size)
        i, j = x[np.repeat(starts[a[some]], size) + k // width], x[np.repeat(starts[b[some]], size) + k % width]
        if metric == "cosine":
            scale = np.sqrt((i * i).sum(1)) * np.sqrt((j * j).sum(1))
            d = np.where(scale == 0, 0.0, np.maximum(0, 1 - (i * j).sum(1) / np.where(scale == 0, 1, scale)))
        else:
            i -= j
            d = np.abs(i, out=i).sum(1) if metric == "manhattan" else np.sqrt(np.einsum("ij,ij->i", i, i))
        out[some] = reduce.reduceat(d, first)
        at = end
    for k in np.flatnonzero(many > 256).tolist():
        i, j, got = x[starts[a[k]] : ends[a[k]]], x[starts[b[k]] : ends[b[k]]], 0.0
        step = max(1, (1 << 20) // len(j))
        for low in range(0, len(i), step):
            d = np.sqrt(refined_squared(i[low : low + step], j)) if metric == "euclidean" else distances(i[low : low + step], j, metric, plain_cosine=True)
            got = max(got, float(d.max())) if kind == "complete" else got + float(d.sum())
        out[k] = got
    return out if kind == "complete" else out / many


class ClusterSearch:
    """The nearest clusters of some, by lower bounds of distances in single precision; what they leave is computed as by
    `pair_linkage`. x has the points of cluster k from starts[k] on."""

    def __init__(self, x: np.ndarray, starts: np.ndarray, kind: str, metric: str):
        self.x, self.starts, self.ends, self.kind, self.metric = x, starts, np.append(starts[1:], len(x)), kind, metric
        self.reduce, self.sizes = np.maximum if kind == "complete" else np.add, self.ends - starts
        self.scale, self.quick = 1.0, False
        if metric in ("euclidean", "manhattan"):
            y = x - x.mean(0)
            length = np.abs(y).sum(1) if metric == "manhattan" else np.sqrt((y * y).sum(1))
            self.scale = float(length.max(initial=0)) or 1.0
            self.quick = bool(np.isfinite(self.scale) and self.scale > 1e-150)
        if self.quick:
            y /= self.scale
            self.y = y.astype(np.float32)
            self.own = (self.y.sum(1, dtype=float) if metric == "manhattan" else (self.y.astype(float) ** 2).sum(1)).astype(np.float32)
            self.columns = np.ascontiguousarray(self.y.T)
            # Of scaled points sums of features are off by less than that.
            self.slack = np.float32((x.shape[1] + 16) * SINGLE * (4 if metric == "manhattan" else 2))
        else:
            self.scale = 1.0
        self.groups, self.space = self._groups(np.arange(len(starts))), np.empty(SEARCHED * SEARCHED, np.float32)

    def _groups(self, clusters: np.ndarray) -> list[tuple[int, int]]:
        """Clusters in groups of up to so many points, or of one."""
        done, out, at = np.concatenate(([0], np.cumsum(self.sizes[clusters]))), [], 0
        while at < len(clusters):
            end = max(at + 1, int(np.searchsorted(done, done[at] + SEARCHED, "right")) - 1)
            out.append((at, end))
            at = end
        return out

    def _low(self, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        """Lower bounds (complete euclidean: of squares) of distances of some points to those from low to high."""
        if not self.quick:
            return distances(self.x[rows], self.x[low:high], self.metric, plain_cosine=True) * (1 - 1e-9) - 1e-12
        if self.metric == "euclidean":
            # In an array that is used again: memory that is new for each block takes longer than the product.
            d = self.space[: len(rows) * (high - low)].reshape(len(rows), -1)
            np.matmul(self.y[rows] * np.float32(-2), self.columns[:, low:high], out=d)
            d += self.own[rows][:, None]
            d += self.own[low:high] - self.slack
            if self.kind == "complete":
                return d
            return np.sqrt(np.maximum(d, 0, out=d), out=d)
        columns, out, ones = np.ascontiguousarray(self.columns[:, low:high]), np.empty((len(rows), high - low), np.float32), np.full(len(self.columns), 2, np.float32)
        larger = np.empty_like(columns)
        for y, row in zip(self.y[rows], out, strict=True):
            np.maximum(columns, y[:, None], out=larger)
            np.dot(ones, larger, out=row)
        out -= self.own[rows][:, None]
        out -= self.own[low:high] + self.slack
        return np.maximum(out, 0, out=out)

    def rows(self, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
        """(k, distances to k and all that follow it) of clusters from low to high, in double precision."""
        for a, b in self._groups(np.arange(low, high)):
            some = np.arange(low + a, low + b)
            points = np.arange(self.starts[some[0]], self.ends[some[-1]])
            parts = [(max(g[0], low + a), g[1]) for g in self.groups if g[1] > low + a]
            d = np.hstack([self._bounds(some, points, self.starts[some] - points[0], g, True) for g in parts])
            yield from ((low + a + k, row[k:]) for k, row in enumerate(d))

    def _bounds(self, clusters: np.ndarray, rows: np.ndarray, first: np.ndarray, group: tuple[int, int], exact: bool = False) -> np.ndarray:
        """Lower bounds of distances of some clusters, whose points are rows from first on, to those of a group, or the
        distances."""
        start, end, out = int(self.starts[group[0]]), int(self.ends[group[1] - 1]), None
        many = self.starts[group[0] : group[1]] - start
        for i in range(0, len(rows), max(SEARCHED, len(rows) if len(first) > 1 else 0)):
            for low in range(start, end, max(SEARCHED, end - start if len(many) > 1 else 0)):
                piece = rows[i : i + SEARCHED] if len(first) == 1 else rows
                high = min(end, low + SEARCHED) if len(many) == 1 else end
                if not exact:
                    d = self._low(piece, low, high)
                elif self.metric == "euclidean":
                    d = np.sqrt(refined_squared(self.x[piece], self.x[low:high]))
                else:
                    d = distances(self.x[piece], self.x[low:high], self.metric, plain_cosine=True)
                if len(first) < len(rows):
                    both, d = d, d[first]
                    for c in np.flatnonzero(self.sizes[clusters] > 1).tolist():
                        self.reduce.reduce(both[first[c] : first[c] + self.sizes[clusters[c]]], 0, out=d[c])
                if len(many) < end - start:
                    d = self.reduce.reduceat(d, many, 1)
                out = d if out is None else self.reduce(out, d)
        if exact:
            return out / (self.sizes[clusters][:, None] * self.sizes[group[0] : group[1]]) if self.kind == "average" else out
        if self.kind == "average":
            own, other = ((1 - 2 * (size + 8) * SINGLE) / size for size in (self.sizes[clusters], self.sizes[group[0] : group[1]]))
            out *= own.astype(out.dtype)[:, None]
            out *= other.astype(out.dtype)
        return out

    def nearest(self, clusters: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each cluster up to t others (-1: none), their distances, and a bound below which no other one is."""
        made = [self._nearest(clusters[low:high], t) for low, high in self._groups(clusters)]
        return tuple(np.concatenate(c) for c in zip(*made, strict=True))

    def _nearest(self, clusters: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k, m = len(clusters), len(self.starts)
        rows = np.concatenate([np.arange(self.starts[c], self.ends[c]) for c in clusters.tolist()])
        first = np.cumsum(self.sizes[clusters]) - self.sizes[clusters]
        cut, held, count, seen = None, [], 0, t + 1 < m

        def least(held: list, n: int) -> tuple[np.ndarray, ...]:
            p, q, d = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(d.astype(float))
            order = order[np.argsort(p[order].astype(np.int16), kind="stable")]
            p, q, d = p[order], q[order], d[order]
            start = np.searchsorted(p, np.arange(k))
            some = np.arange(len(p)) - start[p] < n
            return p[some], q[some], d[some]

        for group in self.groups:
            d = self._bounds(clusters, rows, first, group)
            width = d.shape[1]
            if cut is None:
                cut = np.partition(d, t + 1, 1)[:, t + 1] if d.shape[1] > t + 1 else np.full(k, np.inf, d.dtype)
            at = np.flatnonzero(d <= cut[:, None])
            p, q = at // width, at % width + group[0]
            v = d.ravel()[at]
            other = clusters[p] != q
            held.append((p[other], q[other], v[other]))
            count += len(p)
            if seen and count > 4 * k * (t + 1):
                held = [least(held, t + 1)]
                p, _, v = held[0]
                full = np.bincount(p, minlength=k) == t + 1
                cut = np.where(full, v[np.minimum(np.searchsorted(p, np.arange(k), "right") - 1, len(v) - 1)], cut).astype(cut.dtype)
                count = len(p)
        p, q, v = least(held, t + 1)
        place = np.arange(len(p)) - np.searchsorted(p, np.arange(k))[p]
        ids, out, bound = np.full((k, t), -1, np.int32), np.full((k, t), np.inf), np.full(k, np.inf)
        last = place == t
        v = np.maximum(v[last], 0).astype(float) * (1 - 16 * SINGLE)
        bound[p[last]] = (np.sqrt(v) if self.quick and (self.kind, self.metric) == ("complete", "euclidean") else v) * self.scale
        p, q, place = p[~last], q[~last], place[~last]
        ids[p, place] = q
        out[p, place] = pair_linkage(self.x, self.starts, self.ends, clusters[p], q, self.kind, self.metric)
        # Where no listed one is surely the nearest, as among many equal ones, the whole row is computed.
        for r in np.flatnonzero(out.min(1) > bound).tolist():
            d = linkage_rows(self.x, self.starts, clusters[r : r + 1], self.kind, self.metric)[0]
            d[clusters[r]] = np.inf
            order = np.argsort(d, kind="stable")[: t + 1]
            ids[r], out[r], bound[r] = order[:t], d[order[:t]], d[order[t]]
        ids[out > bound[:, None]] = -1
        out[ids < 0] = np.inf
        return ids, out, bound


def list_merges(sizes: np.ndarray, kind: str, listed: Callable, exact: Callable, most: int, t: int) -> tuple[list[tuple[float, int, int]], np.ndarray]:
    """Merges (distance, low, high) by complete or average linkage of clusters that are each other's nearest, until `most`
    are left, and the cluster of each. listed(clusters, home): up to t of the nearest of each, as `ClusterSearch.nearest`;
    exact(a, b, home): distances of pairs. A union is no nearer than the nearer of its two clusters, so that lists go on
    to hold what is below their bounds, and a cluster is searched again only when its list has no such ones left."""
    n = len(sizes)
    sizes, home, live, left = np.array(sizes, float), np.arange(n), np.ones(n, bool), n
    ids, d, bound = np.full((n, t), -1, np.int32), np.full((n, t), np.inf), np.full(n, -np.inf)
    near, gap, found, touched = np.full(n, -1), np.full(n, np.inf), [], np.arange(n)
    while left > max(1, most):
        gap[touched] = d[touched].min(1)
        near[touched] = np.where((gap[touched] <= bound[touched]) & (gap[touched] < np.inf), np.where(d[touched] == gap[touched][:, None], ids[touched], n).min(1), -1)
        here = np.flatnonzero(live)
        some = here[near[here] >= 0]
        low = some[(near[near[some]] == some) & (some < near[some])]
        high = near[low]
        if not len(low):
            asked = here[near[here] < 0]
            if len(asked):
                ids[asked], d[asked], bound[asked] = listed(asked, home)
                touched = asked
                continue
            a = int(here[gap[here].argmin()])  # two ways of adding up the same distance can differ in a last digit
            low, high = np.array([min(a, near[a])]), np.array([max(a, near[a])])
        low, high = low[: left - 1], high[: left - 1]
        found += zip(gap[low].tolist(), low.tolist(), high.tolist(), strict=True)
        left -= len(low)
        to, merged, mate = np.arange(n), np.zeros(n, bool), np.arange(n)
        to[high], mate[low], live[high] = low, high, False
        merged[low] = merged[high] = True
        home = to[home]
        # Entries of merged clusters, and those that name one: the same union can be named by several of them.
        moved = merged[ids]
        moved |= merged[:, None]
        moved &= (ids >= 0) & (live | merged)[:, None]
        row, old, value = np.flatnonzero(moved).astype(np.int32) // t, ids[moved], d[moved]
        ids[moved], d[moved] = -1, np.inf
        key = to[row] * np.int64(n) + to[old]
        order = np.argsort(key, kind="stable").astype(np.int32)
        order = order[to[row[order]] != to[old[order]]]
        key, row, old, value = key[order], row[order], old[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        total, below = sizes.copy(), bound.copy()
        total[low] += sizes[high]
        if kind == "complete":
            bound[low] = np.maximum(bound[low], bound[high])
        else:
            bound[low] = (sizes[low] * bound[low] + sizes[high] * bound[high]) / total[low]
        if len(first):
            r, c, count = key[first] // n, key[first] % n, np.diff(np.append(first, len(key)))
            # Pairs of old clusters that there are for each of the two of a union, and those that its list knows.
            parts, mine = np.where(merged[c], 2, 1), np.add.reduceat((row == r.repeat(count)).astype(int), first)
            lack, lack_mate = parts > mine, merged[r] & (parts > count - mine)
            if kind == "complete":
                got = np.maximum.reduceat(value, first)
                least = np.maximum(got, np.maximum(np.where(lack, below[r], -np.inf), np.where(lack_mate, below[mate[r]], -np.inf)))
            else:
                weight = sizes[row] * sizes[old]
                every, known = total[r] * total[c], np.add.reduceat(weight, first)
                got = np.add.reduceat(weight * value, first)
                own = np.add.reduceat(np.where(row == r.repeat(count), weight, 0), first)
                rest, rest_mate = sizes[r] * total[c] - own, sizes[mate[r]] * total[c] - (known - own)
                least = (got + np.where(lack, rest, 0) * np.where(lack, below[r], 0) + np.where(lack_mate, rest_mate, 0) * np.where(lack_mate, below[mate[r]], 0)) / every
                got = got / every
            need = (lack | lack_mate) & (least <= bound[r])
            got[lack | lack_mate] = np.inf
            if need.any():
                pairs, back = np.unique(np.minimum(r, c)[need] * np.int64(n) + np.maximum(r, c)[need], return_inverse=True)
                got[need] = exact(pairs // n, pairs % n, home)[back]
            some = (got <= bound[r]) & (got < np.inf)
            r, c, got = r[some], c[some], got[some]
            # They go to free places; of a union's the t least are kept.
            order = np.lexsort((c, got, r))
            r, c, got = r[order], c[order], got[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            over = rank >= t
            np.minimum.at(bound, r[over], got[over])
            r, c, got, rank = r[~over], c[~over], got[~over], rank[~over]
            rows, back = np.unique(r, return_inverse=True)
            free = np.argsort(ids[rows] >= 0, 1, kind="stable")[back, rank]
            ids[r, free], d[r, free] = c, got
        sizes, touched = total, np.flatnonzero(live)
    return found, home


def ordered_merges(found: list[tuple[float, int, int]], n: int) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, distance, size) in ascending distance from (distance, a, b), where a and b are any of the points in
    the two clusters."""
    union, name, count, out = Union(n), list(range(n)), [1] * n, []
    for k, (w, a, b) in enumerate(sorted(found, key=lambda m: m[0])):
        ra, rb = union.find(a), union.find(b)
        left, right = sorted((name[ra], name[rb]))
        union.root[ra] = rb
        name[rb] = n + k
        count[rb] += count[ra]
        out.append((left, right, w, count[rb]))
    return out


def cut(merges: list[tuple[int, int, float, int]], n: int, n_clusters: int | None = None, threshold: float | None = None) -> np.ndarray:
    """Labels after the first n - n_clusters merges, or after those below the threshold; numbered by first appearance."""
    union = Union(n + len(merges))
    for k, (a, b, d, _) in enumerate(merges):
        if k < n - n_clusters if n_clusters is not None else d < threshold:
            union.root[union.find(a)] = union.root[union.find(b)] = n + k
    label: dict[int, int] = {}
    return np.array([label.setdefault(union.find(i), len(label)) for i in range(n)], np.int64)


# --- condensed trees ------------------------------------------------------------------------------------------------


@dataclass
class Condensed:
    """Edges parent -> child with lambda at which the child leaves and its size; ids from n are clusters, n the root."""

    parent: np.ndarray
    child: np.ndarray
    lam: np.ndarray
    size: np.ndarray
    n: int


def condense(tree: np.ndarray, min_size: int) -> Condensed:
    """Keep those splits of a single-linkage tree where both sides have min_size points; others let points fall out."""
    n = len(tree) + 1
    min_size = max(2, int(min_size))
    rows: list[tuple[int, int, float, int]] = []
    if n < 2:
        return Condensed(*(np.zeros(0, int) for _ in range(2)), np.zeros(0), np.zeros(0, int), n)
    left, right = tree[:, 0].astype(int).tolist(), tree[:, 1].astype(int).tolist()
    dist, sizes = tree[:, 2].tolist(), tree[:, 3].astype(int).tolist()
    count = lambda x: 1 if x < n else sizes[x - n]

    def leaves(top: int) -> list[int]:
        out, stack = [], [top]
        while stack:
            x = stack.pop()
            if x < n:
                out.append(x)
            else:
                stack += [right[x - n], left[x - n]]
        return out

    name, queue, new = {2 * n - 2: n}, [2 * n - 2], n + 1
    while queue:
        at = queue.pop(0)
        own = name[at]
        a, b, d = left[at - n], right[at - n], dist[at - n]
        lam = 1 / d if d > 0 else np.inf
        big = [count(a) >= min_size, count(b) >= min_size]
        for x, is_big in ((a, big[0]), (b, big[1])):
            if all(big):
                name[x] = new
                rows.append((own, new, lam, count(x)))
                new += 1
                if x >= n:
                    queue.append(x)
            elif is_big:
                name[x] = own
                if x >= n:
                    queue.append(x)
            else:
                rows += [(own, p, lam, 1) for p in leaves(x)]
    cols = list(zip(*rows, strict=True))
    return Condensed(np.array(cols[0]), np.array(cols[1]), np.array(cols[2], float), np.array(cols[3]), n)


def stabilities(c: Condensed) -> dict[int, float]:
    """For each cluster the sum over its edges of (lambda - its birth) times the size."""
    birth = {c.n: 0.0}
    birth.update({int(k): float(v) for k, v in zip(c.child, c.lam, strict=True) if k >= c.n})
    out = {k: 0.0 for k in birth}
    for p, lam, size in zip(c.parent.tolist(), c.lam.tolist(), c.size.tolist(), strict=True):
        b = birth[p]
        out[p] += 0.0 if lam == b else (lam - b) * size
    return out


def select_clusters(c: Condensed, method: str = "eom", epsilon: float = 0.0, single: bool = False) -> list[int]:
    """Ids of the flat clusters. The root is never one unless `single`, or unless a leaf selection finds no leaf."""
    score = stabilities(c)
    inner = c.child >= c.n
    up = {int(k): int(p) for p, k in zip(c.parent[inner], c.child[inner], strict=True)}
    birth = {int(k): float(v) for k, v in zip(c.child[inner], c.lam[inner], strict=True)}
    below: dict[int, list[int]] = {}
    for k, p in up.items():
        below.setdefault(p, []).append(k)
    every = sorted(score)
    chosen: set[int] = set()
    if method == "leaf":
        chosen = {k for k in every if k not in below and k != c.n} or {c.n}
    elif method == "eom":
        total = dict(score)
        flag = {k: True for k in every}
        for k in sorted(every, reverse=True):
            if k == c.n and not single:
                flag[k] = False
                continue
            inside = sum(total[x] for x in below.get(k, []))
            if below.get(k) and inside > score[k]:
                flag[k] = False
                total[k] = inside
            else:
                stack = list(below.get(k, []))
                while stack:
                    x = stack.pop()
                    flag[x] = False
                    stack += below.get(x, [])
        chosen = {k for k in every if flag[k]}
    else:
        raise ValueError(f"unknown selection {method!r}")
    if epsilon > 0 and chosen != {c.n}:
        out: set[int] = set()
        for k in sorted(chosen):
            top = k
            while top in up and (1 / birth[top] if birth[top] > 0 else np.inf) < epsilon:
                above = up[top]
                if above == c.n:
                    top = above if single else top
                    break
                top = above
            out.add(top)
        kept = set()
        for k in out:  # a cluster below a chosen one goes with it
            x = up.get(k)
            while x is not None and x not in out:
                x = up.get(x)
            if x is None:
                kept.add(k)
        chosen = kept
    return sorted(chosen)


def label_points(c: Condensed, clusters: list[int]) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Labels (-1: noise), probabilities, and the exemplar of each label: the first point of the largest lambda."""
    label = {k: i for i, k in enumerate(clusters)}
    up = {int(k): int(p) for p, k in zip(c.parent, c.child, strict=True)}
    home: dict[int, int] = {}
    for x in sorted(set(c.parent.tolist())):
        home[x] = x if x in label else home.get(up.get(x, -1), -1)
    labels, lam = np.full(c.n, -1), np.zeros(c.n)
    for p, k, v in zip(c.parent.tolist(), c.child.tolist(), c.lam.tolist(), strict=True):
        if k < c.n:
            top = home.get(p, -1)
            # The root as the one cluster keeps only what stays to the end of it.
            labels[k] = label.get(top, -1)
            lam[k] = v
    death: dict[int, float] = {}
    for p, v in zip(c.parent.tolist(), c.lam.tolist(), strict=True):
        death[p] = max(death.get(p, 0.0), v)
    if clusters == [c.n]:
        labels = np.where(lam >= death[c.n], labels, -1) if len(c.lam) else labels
    prob = np.zeros(c.n)
    exemplar: dict[int, int] = {}
    for i in range(c.n):
        if labels[i] >= 0:
            most = death.get(clusters[labels[i]], 0.0)
            prob[i] = 1.0 if most == 0 or not np.isfinite(lam[i]) else min(lam[i], most) / most
            best = exemplar.get(int(labels[i]))
            if best is None or lam[i] > lam[best]:
                exemplar[int(labels[i])] = i
    return labels, prob, exemplar


# --- eigenpairs -----------------------------------------------------------------------------------------------------


def fix_signs(vectors: np.ndarray) -> np.ndarray:
    """The component of largest size, the first of such, is positive in each column."""
    if not vectors.size:
        return vectors
    at = np.argmax(np.abs(vectors), 0)
    sign = np.sign(vectors[at, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def orthogonalize(v: np.ndarray, basis: list[np.ndarray] | np.ndarray) -> np.ndarray:
    for b in basis:
        v = v - (v @ b) * b
    return v


def lanczos(matvec: Callable[[np.ndarray], np.ndarray], n: int, k: int, tol: float = 1e-6, restarts: int = 10, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenpairs of a symmetric operator, with full orthogonalisation and restarts that keep the Ritz
    vectors found."""
    size = min(max(2 * k + 20, 4 * k), n, 200) if n > k else n
    size = min(n, max(size, k + 2))
    rng = np.random.RandomState(seed)
    # Rows are vectors, so that orthogonalising is two products.
    basis, images, m = np.zeros((size, n)), np.zeros((size, n)), 0
    start = rng.standard_normal(n)

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - (basis[:m] @ v) @ basis[:m]
        return v

    for _ in range(restarts * 5):
        v = apart(start)
        while m < size:
            norm = np.linalg.norm(v)
            if norm < 1e-10:
                v = apart(rng.standard_normal(n))
                norm = np.linalg.norm(v)
                if norm < 1e-10:
                    break
            basis[m] = v / norm
            images[m] = matvec(basis[m])
            m += 1
            v = apart(images[m - 1])
        product = basis[:m] @ images[:m].T
        values, small = np.linalg.eigh((product + product.T) / 2)
        vectors = (small[:, :k].T @ basis[:m]).T
        residual = (small[:, :k].T @ images[:m]).T - vectors * values[:k]
        worst = np.linalg.norm(residual, axis=0)
        if m == n or worst.max(initial=0) < tol:
            break
        # Go on from the best Ritz vectors and the residual of the worst of those wanted.
        best = small[:, : max(k + 2, size // 2)].T
        kept, made = best @ basis[:m], best @ images[:m]
        m = len(best)
        basis[:m], images[:m] = kept, made
        start = residual[:, int(np.argmax(worst))]
    return values[:k], fix_signs(vectors)


@dataclass(frozen=True)
class BlockOperator:
    """A symmetric operator of n rows that is best applied to many vectors at once; block and most are those of
    `block_lanczos`."""

    n: int
    matmat: Callable[[np.ndarray], np.ndarray]
    block: int = 96
    most: int = 384


def block_lanczos(operator: BlockOperator, k: int, block: int = 96, tol: float = 1e-6, most: int = 384, rounds: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenpairs: the space of a block of vectors and its images, with full orthogonalisation, and again
    from the best Ritz vectors when it has `most` vectors."""
    n, rng = operator.n, np.random.RandomState(seed)
    block = min(n, max(block, k + 8))
    q, images, v = np.zeros((n, 0)), np.zeros((n, 0)), rng.standard_normal((n, block))
    for _ in range(rounds):
        size = np.linalg.norm(v, axis=0)
        v = v / np.where(size > 0, size, 1)
        for _ in range(2):
            v = v - q @ (q.T @ v)
            v, r = np.linalg.qr(v)
            v = v[:, np.abs(np.diag(r)) > 1e-9]
        v = v[:, : n - q.shape[1]]
        if not v.shape[1]:
            v = rng.standard_normal((n, min(block, n - q.shape[1])))
            if not v.shape[1]:
                break
            continue
        q, images = np.hstack((q, v)), np.hstack((images, operator.matmat(v)))
        values, small = np.linalg.eigh((q.T @ images + images.T @ q) / 2)
        residual = images @ small[:, :k] - (q @ small[:, :k]) * values[:k]
        if q.shape[1] == n or q.shape[1] >= k and np.linalg.norm(residual, axis=0).max(initial=0) < tol:
            return values[:k], fix_signs(q @ small[:, :k])
        v = images[:, -v.shape[1] :]
        if q.shape[1] + block > most:
            best = small[:, : max(k + 2, most // 2)]
            v = images @ best[:, :block] - (q @ best[:, :block]) * values[: min(block, best.shape[1])]
            q, images = q @ best, images @ best
    raise np.linalg.LinAlgError("eigenvectors did not converge")


def symmetric_eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All eigenpairs, ascending, with fixed signs."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return values, fix_signs(vectors)


def smallest_eigenpairs(operator: np.ndarray | tuple[int, Callable] | BlockOperator, k: int, zero: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenpairs and as many more as there are near-zero ones, so that a null space is whole. A matrix
    of up to 2000 rows is solved whole; a larger one, or (n, matvec), by Lanczos. Of a block operator the k smallest."""
    if isinstance(operator, BlockOperator):
        return block_lanczos(operator, min(k, operator.n), operator.block, most=operator.most)
    n = operator[0] if isinstance(operator, tuple) else len(operator)
    if not isinstance(operator, tuple) and n <= 2000:
        values, vectors = symmetric_eigen(operator)
        c = int((values <= zero).sum())
        return values[: k + c], vectors[:, : k + c]
    matvec = operator[1] if isinstance(operator, tuple) else operator.__matmul__
    want = min(k + 1, n)
    while True:
        values, vectors = lanczos(matvec, n, want)
        c = int((values <= zero).sum())
        if c < want and k + c <= want or want >= n:
            return values[: k + c], vectors[:, : k + c]
        want = min(k + c, n) if k + c > want else min(2 * want, n)


def power_iteration(matrix: np.ndarray, k: int, iterations: int = 300, tol: float = 1e-12, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and eigenvectors (rows) of a symmetric positive matrix, by power iteration and
    deflation from seeded starts."""
    rng, m, values, vectors = np.random.RandomState(seed), matrix.astype(float).copy(), [], []
    for _ in range(k):
        v = rng.standard_normal(len(m))
        v /= np.linalg.norm(v) or 1
        for _ in range(iterations):
            w = m @ v
            size = np.linalg.norm(w)
            if size == 0:
                break
            w /= size
            done = np.abs(w - v).max() < tol
            v = w
            if done:
                break
        value = float(v @ m @ v)
        values.append(value)
        vectors.append(v)
        m = m - value * np.outer(v, v)
    return np.array(values), np.array(vectors).reshape(k, len(matrix))


@dataclass
class Knee:
    x: float | None
    index: int | None
    differences: list[float]


def find_knee(xs: list[float], ys: list[float], direction: str = "concave", sensitivity: float = 1.0) -> Knee:
    """The interior point that lies farthest from the chord between the ends, on scaled axes: below it for "concave"
    (falling and flattening) curves, above it for "convex" ones. None with fewer than three points, on a flat curve, or
    nearer than sensitivity / (n - 1)."""
    n = len(xs)
    if n < 3:
        return Knee(None, None, [])
    x, y = np.array(xs, float), np.array(ys, float)
    if x[-1] == x[0] or y.max() == y.min():
        return Knee(None, None, [0.0] * n)
    x, y = (x - x[0]) / (x[-1] - x[0]), (y - y.min()) / (y.max() - y.min())
    gap = y - (y[0] + (y[-1] - y[0]) * (x - x[0]) / (x[-1] - x[0]))
    away = (-gap if direction == "concave" else gap)[1:-1]
    at = 1 + int(np.argmax(away))
    if not away[at - 1] >= sensitivity / (n - 1):
        return Knee(None, None, gap.tolist())
    return Knee(xs[at], at, gap.tolist())
