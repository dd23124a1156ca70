"""K-means on standardised numeric columns, and the mean Euclidean silhouette.

All restarts advance together: a pass over the points assigns them to the centres of every restart and adds them up by restart
and centre. The silhouette takes all points: tiles that are near are multiplied with one another, those further apart meet by an
interpolation of the distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from ..types import numeric_columns

#: Points of a tile, and passes of a fit at most.
TILE, PASSES = 1024, 300
#: Knots of a tile's grid in each column.
KNOTS = 10
#: A fit is done when no centre moves further.
STILL = 1e-4


@dataclass
class Clusters:
    labels: DataFrame
    centroids: list[list[float]]
    inertia: float
    features: list[str]
    points: DataFrame  # (cluster, x), scaled

    @cached_property
    def silhouette(self) -> float | None:
        """Computed when it is asked for: labels and centroids do without."""
        return silhouette(self.points, len(self.centroids))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """Numbers between 0 and 1 drawn from hashes and a seed."""
    x = h.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    out = np.zeros((len(x), len(centres)))
    for d in range(x.shape[1]):
        out += (x[:, d, None] - centres[None, :, d]) ** 2
    return out


def _seeded(points: DataFrame, k: int, seeds: list[int]) -> list[np.ndarray]:
    """k-means++ for every seed: each next centre is drawn with a chance in proportion to its squared distance from those there
    are, one pass a centre: the point with the least exponential number of that rate."""
    centres: list[list[list[float]]] = [[] for _ in seeds]
    for step in range(k):
        known = [np.array(c) for c in centres]

        def draw(batches: Iterator[pa.RecordBatch], step=step, known=known) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                h, x = b.column("h").to_numpy(), _matrix(b.column("x"))
                for r, seed in enumerate(seeds):
                    rate = _squares(x, known[r]).min(axis=1) if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        late = -np.log(_uniform(h, 1000 * seed + step)) / rate
                    i = int(late.argmin())
                    if r not in best or (late[i], x[i].tolist()) < best[r]:
                        best[r] = (float(late[i]), x[i].tolist())
            rows = sorted(best.items())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int32()), pa.array([v[0] for _, v in rows], pa.float64()), pa.array([v[1] for _, v in rows], pa.list_(pa.float64()))], names=["r", "late", "x"])

        drawn = points.mapInArrow(draw, "r int, late double, x array<double>").groupBy("r").agg(F.min(F.struct("late", "x")).alias("m"))
        for row in drawn.collect():  # a row per restart
            centres[row.r].append(row.m.x)
    return [np.array(c) for c in centres]


def _pass(points: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per restart the number and the sum of the points nearest to each centre, and the squared distance of all."""
    width = next(iter(centres.values())).shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {r: (np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))) for r, c in centres.items()}
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else np.empty((0, width))
            for r, c in centres.items():
                d = _squares(x, c)
                own = d.argmin(axis=1) if len(x) else np.empty(0, np.int64)
                n, total, cost = held[r]
                n += np.bincount(own, minlength=len(c))
                cost += np.bincount(own, weights=d[np.arange(len(x)), own], minlength=len(c))
                for j in range(width):
                    total[:, j] += np.bincount(own, weights=x[:, j], minlength=len(c))
        rows = [(r, i, n[i], cost[i], *total[i]) for r, (n, total, cost) in held.items() for i in range(len(n))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    names = ["r", "i", "n", "cost", *(f"s{j}" for j in range(width))]
    sums = points.mapInArrow(add, "r bigint, i bigint, n double, cost double, " + ", ".join(f"s{j} double" for j in range(width)))
    got: dict[int, tuple[np.ndarray, np.ndarray, float]] = {r: (np.zeros(len(c)), np.zeros_like(c), 0.0) for r, c in centres.items()}
    for row in sorted(sums.groupBy("r", "i").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()):  # a row per restart and centre
        n, total, cost = got[row.r]
        n[row.i], total[row.i] = row.n, [row[f"s{j}"] for j in range(width)]
        got[row.r] = (n, total, cost + row.cost)
    return got


def _fitted(points: DataFrame, k: int, seeds: list[int]) -> tuple[np.ndarray, float]:
    """The centres with the least inertia of one fit per seed, and that inertia; of equal ones the first."""
    centres = dict(enumerate(_seeded(points, k, seeds)))
    still: set[int] = set()
    for _ in range(PASSES):
        moving = {r: c for r, c in centres.items() if r not in still}
        if not moving:
            break
        for r, (n, total, _) in _pass(points, moving).items():
            new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[r])
            if np.sqrt(((new - centres[r]) ** 2).sum(axis=1)).max() <= STILL:
                still.add(r)
            centres[r] = new
    cost = {r: x for r, (_, _, x) in _pass(points, centres).items()}
    best = min(cost, key=lambda r: (cost[r], r))
    return centres[best], cost[best]


def kmeans(df: DataFrame, k: int = 3, seeds: range = range(42, 52), order: str = "__row_id") -> Clusters | None:
    """The best of one fit per seed; None with fewer than k + 1 complete rows or no numeric column.

    Columns are scaled by their population deviation (a constant one by 1). labels: (order, cluster). Centroids are in
    the original scale.
    """
    columns = numeric_columns(df.schema, (order,))
    if not columns:
        return None
    clean = df.select(order, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna()
    stats = clean.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if stats["n"] < k + 1:
        return None
    mean, scale = [stats[f"m{i}"] for i in range(len(columns))], [stats[f"s{i}"] or 1.0 for i in range(len(columns))]
    scaled = clean.select(order, F.xxhash64(order).alias("h"), F.array(*[(F.col(c) - m) / s for c, m, s in zip(columns, mean, scale)]).alias("x"))
    points = checkpoint(scaled)
    centres, inertia = _fitted(points.select("h", "x"), k, list(seeds))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _squares(_matrix(b.column("x")), centres).argmin(axis=1) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), b.column("x")], names=["i", "cluster", "x"])

    kind = df.schema[order].dataType.simpleString()
    labels = checkpoint(points.select(F.col(order).alias("i"), "x").mapInArrow(label, f"i {kind}, cluster int, x array<double>"))
    centroids = [[float(x) * s + m for x, m, s in zip(c, mean, scale)] for c in centres]
    return Clusters(labels.select(F.col("i").alias(order), "cluster"), centroids, round(inertia, 6), columns, labels.select("cluster", "x"))


def _tiles(x: np.ndarray, most: int) -> list[np.ndarray]:
    """The points cut at the median of their widest column, again and again, until no tile has more than most."""
    todo, out = [np.arange(len(x))], []
    while todo:
        i = todo.pop()
        if len(i) <= most:
            out.append(i)
            continue
        half = len(i) // 2
        i = i[np.argpartition(x[i, int(np.ptp(x[i], axis=0).argmax())], half)]
        todo += [i[half:], i[:half]]
    return out


def _knots(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The grid of Chebyshev points of a box; a column without extent has one."""
    at = np.cos((2 * np.arange(KNOTS) + 1) * np.pi / (2 * KNOTS))
    axes = [(a + b) / 2 + (b - a) / 2 * at if b > a else np.array([a]) for a, b in zip(lo, hi)]
    return np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, len(lo))


def _shares(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """By point and knot: what a function's value at the knot counts in its interpolation at the point."""
    out, degree = np.ones((len(x), 1)), np.arange(KNOTS)
    at = np.cos(degree * ((2 * np.arange(KNOTS) + 1) * np.pi / (2 * KNOTS))[:, None]) * np.where(degree, 2, 1) / KNOTS
    for j in np.flatnonzero(hi > lo):
        t = np.clip((2 * x[:, j] - lo[j] - hi[j]) / (hi[j] - lo[j]), -1, 1)
        out = (out[:, :, None] * (np.cos(np.arccos(t)[:, None] * degree) @ at.T)[:, None, :]).reshape(len(x), -1)
    return out


def _sums(x: np.ndarray, y: np.ndarray, member: np.ndarray) -> np.ndarray:
    """For each x the sum of its distances from all y, weighted by the columns of member."""
    out = np.zeros((len(x), member.shape[1]))
    for j in range(0, len(y), 1024):
        for i in range(0, len(x), 128):
            total: np.ndarray | None = None
            for d in range(x.shape[1]):
                gap = np.subtract.outer(x[i : i + 128, d], y[j : j + 1024, d])
                gap *= gap
                total = gap if total is None else np.add(total, gap, out=total)
            out[i : i + 128] += np.sqrt(total, out=total) @ member[j : j + 1024]
    return out


def silhouette(points: DataFrame, k: int, seen: Callable[[int], None] | None = None) -> float | None:
    """Mean of (b - a) / max(a, b) of points (cluster, x), 0 for clusters of one; None with a single cluster.

    a and b are mean distances to the rest of the own cluster and to the nearest other one, over all points; equal points of a
    cluster are one with a weight. Points are cut into tiles. Tiles at least a diameter of the larger apart meet by the knots of
    a Chebyshev grid, by which the distance is interpolated from both sides (in two columns to 8e-9 of a distance at worst and
    4e-12 of a point's sum, as measured); others are multiplied point by point, as are tiles of few points or many columns. seen is told how many distances were computed.
    """
    sizes = {r.cluster: r.n for r in points.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row per cluster
    if len(sizes) < 2:
        return None
    count = np.array([sizes.get(c, 0) for c in range(k)], dtype=np.float64)
    most = max(TILE, round((500 * count.sum()) ** (1 / 3)))  # near pairs grow with it, pairs of tiles shrink

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("p").to_numpy(), b.column("cluster").to_numpy(), b.column("w").to_numpy(), _matrix(b.column("x"))) for b in batches if b.num_rows]
        if held:
            p, c, w, x = (np.concatenate(v) for v in zip(*held))
            for n, i in enumerate(_tiles(x, most)):
                row = (int(p[0]) << 32 | n, len(i), x[i].min(axis=0).tolist(), x[i].max(axis=0).tolist(), c[i].astype("<i4").tobytes(), w[i].astype("<f8").tobytes(), x[i].astype("<f8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 3))], names=["tile", "n", "lo", "hi", "c", "w", "x"])

    once = points.groupBy("cluster", "x").agg(F.count("*").cast("double").alias("w"))
    dealt = checkpoint(once.repartitionByRange("x").withColumn("p", F.spark_partition_id()))
    packed = checkpoint(dealt.mapInArrow(pack, "tile bigint, n bigint, lo array<double>, hi array<double>, c binary, w binary, x binary"))
    boxes = sorted(packed.select("tile", "n", "lo", "hi").collect())  # a row per tile
    place = {r.tile: i for i, r in enumerate(boxes)}
    lo, hi = np.array([r.lo for r in boxes]), np.array([r.hi for r in boxes])
    across = np.sqrt(((hi - lo) ** 2).sum(axis=1))
    plain = float(KNOTS) ** (hi > lo).sum(axis=1) > np.array([r.n for r in boxes])
    group = np.arange(len(boxes)) // max(16, -(-len(boxes) // 96))

    def near(t: int) -> np.ndarray:
        """Which tiles this one meets point by point."""
        gap = np.maximum(0, np.maximum(lo - hi[t], lo[t] - hi))
        return plain | plain[t] | (np.sqrt((gap**2).sum(axis=1)) < np.maximum(across, across[t])) | (np.arange(len(lo)) == t)

    def members(c: bytes, w: bytes) -> np.ndarray:
        return (np.frombuffer(c, "<i4")[:, None] == np.arange(k)) * np.frombuffer(w)[:, None]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each tile to the groups of tiles that need its points, and its knots to those that need these."""
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
        for b in batches:
            for tile, c, w, x in zip(*(b.column(n).to_pylist() for n in ("tile", "c", "w", "x"))):
                t = place[tile]
                close = near(t)
                for g in np.unique(group[close]):
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((int(g), t, c, w, x), kinds)], names=["g", "t", "c", "w", "x"])
                if not close.all():
                    at = np.frombuffer(x).reshape(-1, lo.shape[1])
                    whole = (_shares(at, lo[t], hi[t]).T @ members(c, w)).tobytes()
                    for g in np.unique(group[~close]):
                        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip((int(g), t, None, whole, None), kinds)], names=["g", "t", "c", "w", "x"])

    def score(rows: pa.Table) -> pa.Table:
        tiles, knots = {}, {}
        for t, c, w, x in zip(*(rows[n].to_pylist() for n in ("t", "c", "w", "x"))):
            if c is None:
                knots[t] = (_knots(lo[t], hi[t]), np.frombuffer(w).reshape(-1, k))
            else:
                tiles[t] = (np.frombuffer(c, "<i4"), np.frombuffer(w), np.frombuffer(x).reshape(-1, lo.shape[1]), members(c, w))
        total_s, total_n, looked = 0.0, 0.0, 0
        for t in np.flatnonzero(group == rows["g"][0].as_py()):
            own, w, x, _ = tiles[t]
            close = near(t)
            total = np.zeros((len(x), k))
            for u in np.flatnonzero(close):
                total += _sums(x, tiles[u][2], tiles[u][3])
                looked += len(x) * len(tiles[u][2])
            if not close.all():
                far = [knots[u] for u in np.flatnonzero(~close)]
                y, member = (np.concatenate(v) for v in zip(*far))
                at = _knots(lo[t], hi[t])
                total += _shares(x, lo[t], hi[t]) @ _sums(at, y, member)
                looked += len(at) * len(y)
            i = np.arange(len(own))
            with np.errstate(divide="ignore", invalid="ignore"):
                a = total[i, own] / (count[own] - 1)
                b = np.where((count > 0) & (np.arange(k) != own[:, None]), total / count, np.inf).min(axis=1)
                s = np.where(count[own] > 1, np.nan_to_num((b - a) / np.maximum(a, b)), 0.0)
            total_s, total_n = total_s + float(s @ w), total_n + float(w.sum())
        return pa.table({"s": [total_s], "n": [total_n], "looked": pa.array([looked], pa.int64())})

    sent = packed.mapInArrow(send, "g bigint, t bigint, c binary, w binary, x binary")
    got = sent.groupBy("g").applyInArrow(score, "s double, n double, looked bigint").agg(*[F.sum(c).alias(c) for c in ("s", "n", "looked")]).first()
    if seen is not None:
        seen(got.looked)
    return round(got.s / got.n, 6)
