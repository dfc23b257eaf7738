"""Agglomerative clustering and HDBSCAN.

Both need all distances of what they cluster at once. Up to a checked number of points the matrix and the sequential part
are one NumPy problem on the driver. Beyond it, single linkage is cut on the components of the edges below the cut, and
HDBSCAN's hierarchy is built on the spanning forest that rounds of joins find over mutual reachability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from galaxis.functions import kernels
from galaxis.operators import graph, medoids
from galaxis.sources import frames

#: Points whose matrix (n * n doubles) is held at once: 800 MB.
MOST_POINTS = 10_000
#: Points of a frame that are gathered to one matrix: 72 MB.
LOCAL_POINTS = 3000
LINKAGES = ("ward", "complete", "average", "single")
METRICS = ("euclidean", "manhattan", "cosine", "precomputed")


def _check_size(n: int) -> None:
    if n > MOST_POINTS:
        raise ValueError(f"{n} points need a matrix beyond the limit of {MOST_POINTS} points")


@dataclass(frozen=True)
class Agglomerative:
    """Exactly one of n_clusters and distance_threshold; merges at or above the threshold aren't done."""

    n_clusters: int | None = 2
    linkage: str = "ward"
    metric: str = "euclidean"
    distance_threshold: float | None = None

    def __post_init__(self) -> None:
        if (self.n_clusters is None) == (self.distance_threshold is None):
            raise ValueError("give exactly one of n_clusters and distance_threshold")
        if self.n_clusters is not None and (int(self.n_clusters) != self.n_clusters or self.n_clusters < 1):
            raise ValueError("n_clusters must be a positive integer")
        if self.distance_threshold is not None and not self.distance_threshold >= 0:
            raise ValueError("distance_threshold must not be negative")
        if self.linkage not in LINKAGES or self.metric not in METRICS:
            raise ValueError("unknown linkage or metric")
        if self.linkage == "ward" and self.metric != "euclidean":
            raise ValueError("ward linkage needs the euclidean metric")

    def fit_array(self, x: np.ndarray, ids: np.ndarray | None = None) -> AgglomerativeModel:
        """x: points, or the distances of a precomputed metric."""
        n = len(x)
        if n == 0:
            raise ValueError("there are no points")
        if self.n_clusters is not None and self.n_clusters > n:
            raise ValueError("n_clusters cannot exceed the number of samples")
        _check_size(n)
        d = x.astype(float).copy() if self.metric == "precomputed" else kernels.distances(x, x, self.metric, plain_cosine=True)
        merges = kernels.neighbour_chain(d, self.linkage)
        return AgglomerativeModel(self, np.arange(n) if ids is None else ids, kernels.cut(merges, n, self.n_clusters, self.distance_threshold), merges)

    def fit(self, points: DataFrame | graph.Distances, most: int = LOCAL_POINTS) -> AgglomerativeModel:
        """Of distances that are yet to be computed, those of more than `most` points are read in rounds; a long frame is
        gathered."""
        if isinstance(points, graph.Distances):
            if self.metric != "precomputed":
                raise ValueError("distances need the precomputed metric")
            if points.points.count() > most:
                return replace(replace(self, metric=points.metric).fit(points.points, most), params=self)
            points = points.long()
        if self.metric == "precomputed":
            ids, x = frames.square(points)
            return self.fit_array(x, ids)
        n, _ = frames.shape(points)
        if n <= most:
            ids, x = frames.matrix(points)
            return self.fit_array(x, ids)
        if self.n_clusters is not None and self.n_clusters > n:
            raise ValueError("n_clusters cannot exceed the number of samples")
        if self.linkage == "single":
            ids, found = _single_merges(points, self.metric)
        else:
            ids, found = (_merges_in_rounds if self.linkage == "ward" else _merges_by_lists)(points, self.linkage, self.metric, most)
        merges = kernels.ordered_merges(found, n)
        return AgglomerativeModel(self, ids, kernels.cut(merges, n, self.n_clusters, self.distance_threshold), merges)

    def fit_predict(self, points: DataFrame | graph.Distances, most: int = LOCAL_POINTS) -> DataFrame:
        """Labels of single linkage below a threshold need no tree beyond `most` points: they are components."""
        if self.linkage == "single" and self.distance_threshold is not None and self.metric != "precomputed" and frames.shape(points)[0] > most:
            return graph.near_components(points, graph.below_mask(self.metric, self.distance_threshold, True)).withColumnRenamed("component", "label")
        return self.fit(points).labels(points.sparkSession)


@dataclass(frozen=True)
class AgglomerativeModel:
    params: Agglomerative
    ids: np.ndarray
    labels_: np.ndarray
    merges: list[tuple[int, int, float, int]]

    @property
    def n_leaves_(self) -> int:
        return len(self.ids)

    @property
    def children_(self) -> np.ndarray:
        return np.array([m[:2] for m in self.merges], int).reshape(-1, 2)

    @property
    def distances_(self) -> np.ndarray:
        return np.array([m[2] for m in self.merges], float)

    def labels(self, spark: SparkSession) -> DataFrame:
        return frames.labelled(spark, self.ids, label=self.labels_.astype(np.int32))

    def merge_tree(self, spark: SparkSession) -> DataFrame:
        rows = [(k, int(a), int(b), float(d), int(s)) for k, (a, b, d, s) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "merge_id int, left long, right long, distance double, size long")

    def compute_medoids(self, points: DataFrame) -> DataFrame:
        if self.params.metric == "precomputed":
            raise ValueError("medoids need points, not distances")
        return medoids.select_medoids(points, self.labels(points.sparkSession), int(self.labels_.max()) + 1, self.params.metric)


Found = list[tuple[float, int, int]]


def _single_merges(points: DataFrame, metric: str) -> tuple[np.ndarray, Found]:
    """Single linkage merges along the edges of the minimum spanning tree."""
    edges = graph.spanning_forest(graph.pair_forest(points, lambda x, y: kernels.distances(x, y, metric, plain_cosine=True))).toArrow()
    ids = np.sort(points.select("id").toArrow().column("id").to_numpy())
    i, j = (np.searchsorted(ids, edges.column(c).to_numpy()).tolist() for c in "ij")
    return ids, sorted(zip(edges.column("d").to_pylist(), i, j, strict=True))


NEXT = T.StructType([T.StructField("k", T.LongType()), T.StructField("near", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("row", T.BinaryType())])


def _linked(spark: SparkSession, x: Broadcast, linkage: str, metric: str, order: np.ndarray | None, starts: np.ndarray, asked: np.ndarray, sizes: np.ndarray, rows: bool = False) -> pa.Table:
    """Of each cluster asked for its nearest one, the lowest of equal ones, or with `rows` all distances; by tasks over
    clusters of about equally many points together."""
    done = np.cumsum(sizes[asked])
    parts = np.unique(np.searchsorted(done, np.linspace(0, done[-1], 4 * spark.sparkContext.defaultParallelism + 1)[1:-1])).tolist()
    parts = list(zip([0, *parts], [*parts, len(asked)], strict=True))
    state = spark.sparkContext.broadcast((order, starts, asked, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, starts, asked, parts = state.value
        points = x.value if order is None else x.value[order]
        for batch in batches:
            for part in batch.column("id").to_pylist():
                some = asked[slice(*parts[part])]
                for low in range(0, len(some), 64):
                    k = some[low : low + 64]
                    d = kernels.linkage_rows(points, starts, k, linkage, metric)
                    d[np.arange(len(k)), k] = np.inf
                    near = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(near), pa.array(d[np.arange(len(k)), near]), pa.array([r.tobytes() if rows else None for r in d], pa.binary())], names=NEXT.names)

    out = spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, NEXT).toArrow()
    state.destroy()
    return out


def _merges_in_rounds(points: DataFrame, linkage: str, metric: str, most: int) -> tuple[np.ndarray, Found]:
    """Ward, complete and average linkage without a matrix of all points. Such linkages let any two clusters that are each
    other's nearest be merged at any time, so that a round finds nearest clusters in parallel and merges all such pairs;
    a nearest cluster stays so until it is merged. When `most` clusters are left their distances are one matrix, and
    the chain goes on with it. What all tasks hold is the points."""
    spark = points.sparkSession
    ids, x = frames.matrix(points)
    n, ward = len(x), linkage == "ward"
    # Equal points are merged at 0 first, as their ties would let few pairs be merged in a round.
    _, first, home = np.unique(x, axis=0, return_index=True, return_inverse=True)
    some = first[home.ravel()]
    found: Found = [(0.0, int(a), k) for k, a in enumerate(some.tolist()) if a != k] if metric != "cosine" else []
    rep, label = np.unique(some, return_inverse=True) if metric != "cosine" else (np.arange(n), np.arange(n))
    sizes, near, gap = np.bincount(label), np.full(len(rep), -1), np.zeros(len(rep))
    sent = None if ward else spark.sparkContext.broadcast(x)

    def linked(asked: np.ndarray, rows: bool = False) -> pa.Table:
        if not ward:
            order = np.argsort(label, kind="stable")
            return _linked(spark, sent, linkage, metric, order, np.concatenate(([0], np.cumsum(sizes)[:-1])), asked, sizes, rows)
        means = np.stack([np.bincount(label, c, len(rep)) for c in x.T], 1) / sizes[:, None]
        means = spark.sparkContext.broadcast(means)
        try:
            return _linked(spark, means, linkage, metric, None, sizes, asked, np.ones(len(rep), int), rows)
        finally:
            means.destroy()

    while len(rep) > max(1, most):
        got = linked(np.flatnonzero(near < 0))
        k = got.column("k").to_numpy()
        near[k], gap[k] = got.column("near").to_numpy(), got.column("d").to_numpy()
        here = np.arange(len(rep))
        low = np.flatnonzero((near[near] == here) & (here < near))
        if not len(low):  # two ways of adding up the same distance can differ in a last digit
            low = np.array([int(gap.argmin())])
            near[near[low]] = low
            low = np.minimum(low, near[low])
        low = low[: len(rep) - 1]
        high = near[low]
        found += zip(gap[low].tolist(), rep[low].tolist(), rep[high].tolist(), strict=True)
        gone, merged = np.zeros(len(rep), bool), np.zeros(len(rep), bool)
        gone[high], merged[low], merged[high] = True, True, True
        to = here.copy()
        to[high] = low
        new = np.cumsum(~gone) - 1
        label = new[to[label]]
        near = np.where(merged | merged[near], -1, new[near])[~gone]
        rep, gap, sizes = rep[~gone], gap[~gone], np.bincount(label)
    if len(rep) > 1:
        got = linked(np.arange(len(rep)), rows=True)
        d = np.empty((len(rep), len(rep)))
        for k, row in zip(got.column("k").to_pylist(), got.column("row"), strict=True):
            d[k] = np.frombuffer(row.as_buffer(), "<f8")
        found += [(w, int(rep[a]), int(rep[b])) for w, a, b in kernels.chain_merges(np.maximum(d, d.T), linkage, sizes)]
    if sent is not None:
        sent.destroy()
    return ids, found


#: Nearest clusters that are remembered of each, and pairs of points whose distances the driver computes itself.
LISTED, OWN_PAIRS = 24, 1 << 20
LISTS = T.StructType([T.StructField("k", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("d", T.BinaryType()), T.StructField("bound", T.DoubleType())])
VALUES = T.StructType([T.StructField("low", T.LongType()), T.StructField("d", T.BinaryType())])


def _parts(work: np.ndarray, tasks: int) -> list[tuple[int, int]]:
    """Ranges of about equal work."""
    done = np.cumsum(work)
    cuts = np.unique(np.searchsorted(done, np.linspace(0, done[-1], tasks + 1)[1:-1], "right")).tolist()
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(work)], strict=True) if a < b]


def _ordered(home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points in the order of their clusters, the clusters' names and where each starts."""
    order = np.argsort(home, kind="stable")
    names, starts = np.unique(home[order], return_index=True)
    return order, names, starts


def _merges_by_lists(points: DataFrame, linkage: str, metric: str, most: int, listed: int = LISTED, own_pairs: int = OWN_PAIRS) -> tuple[np.ndarray, Found]:
    """Complete and average linkage without a matrix of all points, by lists of nearest clusters that last for many merges
    (`kernels.list_merges`); tasks, which hold the points, make them anew. When `most` clusters are left their distances are
    one matrix, and the chain goes on with it."""
    spark = points.sparkSession
    ids, x = frames.matrix(points)
    # Equal points are merged at 0 first, as their ties would let few pairs be merged at once.
    _, first, back = np.unique(x, axis=0, return_index=True, return_inverse=True)
    base = first[back.ravel()] if metric != "cosine" else np.arange(len(x))
    found: Found = [(0.0, int(a), k) for k, a in enumerate(base.tolist()) if a != k]
    rep, slot = np.unique(base, return_inverse=True)
    sent = spark.sparkContext.broadcast(x)
    tasks = 4 * spark.sparkContext.defaultParallelism

    def run(state: tuple, parts: list, work: Callable, schema: T.StructType) -> pa.Table:
        held = spark.sparkContext.broadcast((*state, parts))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, *state, parts = held.value
            x = sent.value[order]
            for batch in batches:
                for part in batch.column("id").to_pylist():
                    yield from work(x, *state, *parts[part])

        out = spark.range(0, len(parts), 1, len(parts)).mapInArrow(each, schema).toArrow()
        held.destroy()
        return out

    def search(asked: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, names, starts = _ordered(home[slot])

        def work(x: np.ndarray, starts: np.ndarray, asked: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
            some = asked[low:high]
            near, d, bound = kernels.ClusterSearch(x, starts, linkage, metric).nearest(some, listed)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([r.tobytes() for r in near], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary()), pa.array(bound)], names=LISTS.names)

        at = np.searchsorted(names, asked)
        many = np.diff(np.append(starts, len(x)))[at]
        got = run((order, starts, at), _parts(many, min(tasks, 1 + int(many.sum()) // 128)), work, LISTS).sort_by("k")
        near, d = (np.frombuffer(b"".join(got.column(c).to_pylist()), t).reshape(-1, listed) for c, t in (("ids", "<i4"), ("d", "<f8")))
        return np.where(near >= 0, names[near], -1), d, got.column("bound").to_numpy()

    def exact(a: np.ndarray, b: np.ndarray, home: np.ndarray) -> np.ndarray:
        order, names, starts = _ordered(home[slot])
        a, b, ends = np.searchsorted(names, a), np.searchsorted(names, b), np.append(starts[1:], len(x))
        pairs = (ends - starts)[a] * (ends - starts)[b]
        if pairs.sum() <= own_pairs:
            used = np.unique(np.concatenate((a, b)))  # only the points of these clusters
            sizes = (ends - starts)[used]
            rows = np.concatenate([order[starts[k] : ends[k]] for k in used.tolist()])
            return kernels.pair_linkage(x[rows], np.cumsum(sizes) - sizes, np.cumsum(sizes), np.searchsorted(used, a), np.searchsorted(used, b), linkage, metric)

        def work(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
            d = kernels.pair_linkage(x, starts, ends, a[low:high], b[low:high], linkage, metric)
            yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([d.tobytes()], pa.binary())], names=VALUES.names)

        got = run((order, starts, ends, a, b), _parts(pairs + 1000, tasks), work, VALUES).sort_by("low")
        return np.frombuffer(b"".join(got.column("d").to_pylist()), "<f8")

    merges, home = kernels.list_merges(np.bincount(slot), linkage, search, exact, most, listed)
    found += [(w, int(rep[a]), int(rep[b])) for w, a, b in merges]
    order, names, starts = _ordered(home[slot])
    m, ends = len(names), np.append(starts[1:], len(x))
    if m > 1:

        def rows(x: np.ndarray, starts: np.ndarray, low: int, high: int) -> Iterator[pa.RecordBatch]:
            for k, d in kernels.ClusterSearch(x, starts, linkage, metric).rows(low, high):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([d.tobytes()], pa.binary())], names=VALUES.names)

        got = run((order, starts), _parts((ends - starts) * (len(x) - starts), tasks), rows, VALUES)
        d = np.zeros((m, m))
        for k, row in zip(got.column("low").to_pylist(), got.column("d"), strict=True):
            d[k, k:] = d[k:, k] = np.frombuffer(row.as_buffer(), "<f8")
        found += [(w, int(rep[names[a]]), int(rep[names[b]])) for w, a, b in kernels.chain_merges(d, linkage, ends - starts)]
    sent.destroy()
    return ids, found


def single_linkage_components(points: DataFrame, threshold: float, metric: str = "euclidean") -> DataFrame:
    """(id, label) of single linkage cut at a threshold, for any number of points: the components of nearer pairs."""
    return graph.near_components(points, graph.below_mask(metric, threshold)).withColumnRenamed("component", "label")


@dataclass(frozen=True)
class HDBSCAN:
    """Density clustering; -1 is noise. min_samples counts the point itself and is min_cluster_size by default."""

    min_cluster_size: int = 5
    min_samples: int | None = None
    metric: str = "euclidean"
    cluster_selection_method: str = "eom"
    cluster_selection_epsilon: float = 0.0

    def __post_init__(self) -> None:
        if int(self.min_cluster_size) != self.min_cluster_size or self.min_cluster_size < 2:
            raise ValueError("min_cluster_size must be an integer of at least 2")
        if self.min_samples is not None and (int(self.min_samples) != self.min_samples or self.min_samples < 1):
            raise ValueError("min_samples must be a positive integer")
        if self.metric not in ("euclidean", "manhattan", "precomputed"):
            raise ValueError("metric must be euclidean, manhattan or precomputed")
        if self.cluster_selection_method not in ("eom", "leaf") or self.cluster_selection_epsilon < 0:
            raise ValueError("cluster_selection_method must be eom or leaf, and epsilon not negative")

    def _from_tree(self, ids: np.ndarray, tree: np.ndarray) -> HDBSCANModel:
        condensed = kernels.condense(tree, self.min_cluster_size)
        clusters = kernels.select_clusters(condensed, self.cluster_selection_method, self.cluster_selection_epsilon)
        labels, prob, exemplar = kernels.label_points(condensed, clusters) if clusters and clusters != [condensed.n] else (np.full(len(ids), -1), np.zeros(len(ids)), {})
        return HDBSCANModel(self, ids, labels, prob, exemplar, tree, condensed)

    def fit_array(self, x: np.ndarray, ids: np.ndarray | None = None) -> HDBSCANModel:
        n = len(x)
        ids = np.arange(n) if ids is None else ids
        if n == 0:
            raise ValueError("there are no points")
        if n == 1:
            return HDBSCANModel(self, ids, np.array([-1]), np.zeros(1), {}, np.zeros((0, 4)), kernels.condense(np.zeros((0, 4)), 2))
        _check_size(n)
        d = x.astype(float) if self.metric == "precomputed" else kernels.distances(x, x, self.metric)
        k = min(self.min_samples or self.min_cluster_size, n)
        core = np.partition(d, k - 1, 1)[:, k - 1]
        reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
        return self._from_tree(ids, kernels.single_linkage(kernels.spanning_tree(reach), n))

    def fit(self, points: DataFrame, most: int = LOCAL_POINTS) -> HDBSCANModel:
        if self.metric == "precomputed":
            ids, x = frames.square(points)
            return self.fit_array(x, ids)
        n, _ = frames.shape(points)
        if n <= most:
            ids, x = frames.matrix(points)
            return self.fit_array(x, ids)
        return self._fit_spread(points, n)

    def _fit_spread(self, points: DataFrame, n: int) -> HDBSCANModel:
        """The spanning tree by pairs of blocks; only edges come to the driver."""
        cores = graph.core_distances(points, min(self.min_samples or self.min_cluster_size, n), self.metric)
        edges = graph.pair_forest(graph.with_feature(points, cores, "core"), graph.reach_value(self.metric))
        edges = graph.spanning_forest(edges).orderBy("d", "i", "j").toArrow()
        ids = np.sort(points.select("id").toArrow().column("id").to_numpy())
        i, j = (np.searchsorted(ids, edges.column(c).to_numpy()).tolist() for c in "ij")
        return self._from_tree(ids, kernels.single_linkage(list(zip(i, j, edges.column("d").to_pylist(), strict=True)), n))

    def fit_predict(self, points: DataFrame) -> DataFrame:
        return self.fit(points).result(points.sparkSession).select("id", "label")


@dataclass(frozen=True)
class HDBSCANModel:
    params: HDBSCAN
    ids: np.ndarray
    labels_: np.ndarray
    probabilities_: np.ndarray
    exemplars: dict[int, int]
    tree: np.ndarray
    condensed: kernels.Condensed

    @property
    def exemplar_indices_(self) -> dict[int, int]:
        """The id of each label's exemplar."""
        return {k: int(self.ids[i]) for k, i in self.exemplars.items()}

    def result(self, spark: SparkSession) -> DataFrame:
        """(id, label, probability)."""
        return frames.labelled(spark, self.ids, label=self.labels_.astype(np.int32), probability=self.probabilities_.astype(float))

    def condensed_tree(self, spark: SparkSession) -> DataFrame:
        c = self.condensed
        rows = [(int(p), int(k), float(v), int(s)) for p, k, v, s in zip(c.parent, c.child, c.lam, c.size, strict=True)]
        return spark.createDataFrame(rows, "parent long, child long, lambda double, child_size long")

    def single_linkage_tree(self, spark: SparkSession) -> DataFrame:
        rows = [(k, int(a), int(b), float(d), int(s)) for k, (a, b, d, s) in enumerate(self.tree)]
        return spark.createDataFrame(rows, "merge_id int, left long, right long, distance double, size long")
