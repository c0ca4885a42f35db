"""Distribution signatures over bags of 3-D points, and statistics-based colour transfer.

Points are long rows (item_id, p1, p2, p3) with values in 0..255 unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from prismar.operators.cuts import cut
from prismar.operators.search import by_blocks, half_up
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("p1", "p2", "p3")
BINS, COLORS, POINTS = 16, 32, 10_000


def clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))


def histogram(points: DataFrame, bins: int = BINS) -> DataFrame:
    """item_id, bin, value: counts in bins^3 cells over 0..256, at unit length, the empty ones left out."""
    cell = lambda c: F.least(F.floor(F.col(c) / (256 / bins)), F.lit(bins - 1))
    counts = points.groupBy("item_id", ((cell("p1") * bins + cell("p2")) * bins + cell("p3")).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("item_id")))
    return counts.select("item_id", "bin", (F.col("n") / length).alias("value"))


def dense(hist: DataFrame, size: int = BINS**3) -> DataFrame:
    """item_id, histogram: the array form of sparse bins."""
    sparse = hist.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "value"))).alias("m"))
    return sparse.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("histogram"))


def moments(points: DataFrame) -> DataFrame:
    """Mean, population deviation and skewness of each channel; no skewness where the deviation is below 1e-8."""
    out = []
    for c in CHANNELS:
        x = F.col(c)
        out += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std"), F.when(F.stddev_pop(x) > 1e-8, F.skewness(x)).otherwise(0.0).alias(f"{c}_skew")]
    return points.groupBy("item_id").agg(*out)


def subsample(points: DataFrame, most: int = POINTS) -> DataFrame:
    """At most `most` points of each item, the same ones at each run: those of smallest hash. Tasks keep that many before the exchange."""
    w = Window.partitionBy("item_id").orderBy(F.xxhash64(*CHANNELS, *(["point_id"] if "point_id" in points.columns else [])), *CHANNELS)
    return points.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")


def lloyd(x: np.ndarray, k: int, starts: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and shares of the best of `starts` runs of k-means."""
    rng, best = np.random.default_rng(seed), None
    for _ in range(starts):
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            d = (centres * centres).sum(axis=1) - 2 * x @ centres.T
            own = d.argmin(axis=1)
            n = np.bincount(own, minlength=len(centres))
            sums = np.stack([np.bincount(own, weights=x[:, c], minlength=len(centres)) for c in range(x.shape[1])], axis=1)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            if np.allclose(new, centres):
                break
            centres = new
        cost = float(((x - centres[own]) ** 2).sum())
        if best is None or cost < best[0]:
            best = (cost, centres, n / len(x))
    return best[1], best[2]


PALETTE = "array<struct<p1:double,p2:double,p3:double,w:double>>"


def dominant(points: DataFrame, k: int = COLORS, starts: int = 3, rounds: int = 100, seed: int = 42, most: int = POINTS) -> DataFrame:
    """item_id, dominant, reason: up to k centres with their shares, largest first, by k-means over at most `most` points of each item.

    An item with a null or non-finite value in a point kept has no palette, and a reason.
    """
    def run(key: tuple, found: pa.Table) -> pa.Table:
        out, reason = None, None
        if sum(found.column(c).null_count for c in CHANNELS) or not np.isfinite(x := np.stack([found.column(c).to_numpy() for c in CHANNELS], axis=1)).all():
            reason = "a point has a value that isn't a number"
        else:
            x = x[np.lexsort(x.T)]
            centres, share = lloyd(x, k, starts, rounds, seed)
            order = sorted(np.flatnonzero(share), key=lambda j: (-share[j], *centres[j]))
            out = [dict(zip((*CHANNELS, "w"), (*map(float, centres[j]), float(share[j])))) for j in order]
        kind = pa.schema([("item_id", pa.int64()), ("dominant", pa.list_(pa.struct([(c, pa.float64()) for c in (*CHANNELS, "w")]))), ("reason", pa.string())])
        return pa.Table.from_pylist([{"item_id": key[0].as_py(), "dominant": out, "reason": reason}], schema=kind)

    some = subsample(points, most).select(F.col("item_id").cast("long").alias("item_id"), *(F.col(c).cast("double").alias(c) for c in CHANNELS))
    return some.groupBy("item_id").applyInArrow(run, f"item_id long, dominant {PALETTE}, reason string")


def palette_job(points: DataFrame, **options) -> DataFrame:
    """item_id, bins (filled cells of the histogram), the moments, dominant, reason: all palette features of each item.

    An item whose extraction fails has null features and the reason.
    """
    colours = dominant(points, **options)
    bad = colours.where("reason is not null").select("item_id")
    good = points.join(bad, "item_id", "left_anti")
    hist = histogram(good).groupBy("item_id").agg(F.count(F.lit(1)).alias("bins"))
    return colours.join(hist, "item_id", "left").join(moments(good), "item_id", "left")


def top_share(palette: DataFrame, n: int) -> DataFrame:
    """The n heaviest rows (item_id, pos, w) of each item, weights scaled to 1."""
    w = Window.partitionBy("item_id")
    kept = palette.withColumn("pos", F.row_number().over(w.orderBy(F.desc("w"), "pos"))).where(F.col("pos") <= n)
    return kept.withColumn("w", F.col("w") / F.sum("w").over(w))


def strip(palette: DataFrame, width: int, fill_last: bool = True) -> DataFrame:
    """x0 and width of each colour of a strip: whole pixels of its share, the rest to the last one (or at least one pixel each)."""
    w = Window.partitionBy("item_id").orderBy("pos")
    own = F.floor(F.col("w") * width) if fill_last else F.greatest(F.lit(1), F.floor(F.col("w") * width))
    out = palette.withColumn("width", own).withColumn("x0", F.coalesce(F.sum("width").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if fill_last:
        last = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("pos"))) == 1
        out = out.withColumn("width", F.when(last, width - F.col("x0")).otherwise(F.col("width")))
    return out


def palettes(rows: DataFrame, key: str = "item_id") -> DataFrame:
    """key, palette: the (few) weighted points (p1, p2, p3, w) of each item as one array."""
    return rows.groupBy(key).agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in (*CHANNELS, "w")))).alias("palette"))


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Palettes as an array (items, points, 4); shorter ones are filled up with points of no weight."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4), column.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0))), 4))
    item = np.repeat(np.arange(len(sizes)), sizes)
    out[item, np.arange(len(item)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def axis_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean over channels of the W1 distances of all palettes in `a` to all in `b`: between the sorted supports, what one has more than the other."""
    out = np.zeros((len(a), len(b)))
    shape = (len(a), len(b), a.shape[1] + b.shape[1])
    for c in range(3):
        x, m = np.empty(shape), np.empty(shape)
        x[..., : a.shape[1]], x[..., a.shape[1] :] = a[:, None, :, c], b[None, :, :, c]
        m[..., : a.shape[1]], m[..., a.shape[1] :] = a[:, None, :, 3], -b[None, :, :, 3]
        order = np.argsort(x, axis=2, kind="stable")
        x, m = np.take_along_axis(x, order, 2), np.take_along_axis(m, order, 2)
        out += (np.abs(np.cumsum(m, axis=2))[..., :-1] * np.diff(x, axis=2)).sum(axis=2)
    return out / 3


def wasserstein(a: DataFrame, b: DataFrame, k: int | None = None, cells: int = 1 << 20) -> DataFrame:
    """query_id, rank, item_id, distance: the items (the k nearest, or all without a k) of each query by the mean over channels of the W1 distances of two
    weighted sets of equal mass (rows p1, p2, p3, w), in 6 places, ties to the smaller id.

    Query palettes go in blocks of bounded size to where the items' palettes lie, and are compared in tiles; with a k, a task keeps k rows a query.
    """
    items = palettes(b).select(F.col("item_id").cast("long").alias("item_id"), "palette")
    names = ["query_id", "item_id", "distance"]

    def work(block: pa.Table) -> tuple[Broadcast, DataFrame]:
        shared = b.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), stacked(block.column("palette"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = Nearest(len(ids), k) if k is not None else None
            for batch in batches:
                own, x = batch.column("item_id").to_numpy(), stacked(batch.column("palette"))
                step = max(1, cells // max(1, len(own) * (x.shape[1] + q.shape[1])))
                for at in range(0, len(ids) if len(own) else 0, step):
                    distances = half_up(axis_distances(q[at : at + step], x), 6)
                    if best is None:
                        some = ids[at : at + step]
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, len(own))), pa.array(np.tile(own, len(some))), pa.array(distances.ravel())], names)
                    else:
                        for i, d in enumerate(distances):
                            best.add(at + i, d, own)
            if best is not None:
                yield from best.rows(ids)

        return shared, items.mapInArrow(run, "query_id long, item_id long, distance double")

    queries = palettes(a, "query_id").select(F.col("query_id").cast("long").alias("query_id"), "palette")
    return nearest(by_blocks(queries, "query_id", work), k)


class Nearest:
    """The k nearest items of each query so far, by distance and then id."""

    def __init__(self, n: int, k: int, start: np.ndarray | None = None):
        self.k, self.start = k, np.full(n, np.inf) if start is None else start
        self.found: list[list[tuple[float, int]]] = [[] for _ in range(n)]

    def kth(self, q: int) -> float:
        own = self.found[q]
        return min(self.start[q], own[-1][0] if len(own) == self.k else np.inf)

    def add(self, q: int, distance: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(distance <= self.kth(q))
        if len(good):
            keep = good[np.lexsort((ids[good], distance[good]))[: self.k]]
            self.found[q] = sorted([*self.found[q], *zip(distance[keep].tolist(), ids[keep].tolist())])[: self.k]

    def rows(self, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = [(int(ids[q]), i, d) for q, own in enumerate(self.found) for d, i in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query_id", "item_id", "distance"])


def nearest(found: DataFrame, k: int | None) -> DataFrame:
    """Ranks by distance and then id; without a k all stay."""
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "item_id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "item_id", "distance")


def transport(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Exact earth mover's distance of two small weighted sets: successive cheapest augmenting paths."""
    cost = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    left, right, flow = wa.astype(float).copy(), wb.astype(float).copy(), np.zeros_like(cost)
    n, m = cost.shape
    while left.sum() > 1e-12 and right.sum() > 1e-12:
        dist = np.concatenate([np.where(left > 1e-12, 0.0, np.inf), np.full(m, np.inf)])
        back = np.full(n + m, -1)
        for _ in range(n + m):
            old = dist.copy()
            step = dist[:n, None] + cost
            j = step.argmin(axis=0)
            better = step[j, range(m)] < dist[n:] - 1e-12
            dist[n:][better], back[n:][better] = step[j, range(m)][better], j[better]
            undo = np.where(flow > 1e-12, dist[None, n:] - cost, np.inf)
            i = undo.argmin(axis=1)
            better = undo[range(n), i] < dist[:n] - 1e-12
            dist[:n][better], back[:n][better] = undo[range(n), i][better], n + i[better]
            if np.array_equal(old, dist):
                break
        end = int(np.where(right > 1e-12, dist[n:], np.inf).argmin())
        path, node = [], n + end
        while back[node] >= 0:
            path.append((int(back[node]), node))
            node = int(back[node])
        amount = min(left[node], right[end], *(flow[y, x - n] for x, y in path if x >= n))
        for x, y in path:
            if x < n:
                flow[x, y - n] += amount
            else:
                flow[y, x - n] -= amount
        left[node] -= amount
        right[end] -= amount
    return float((flow * cost).sum())


def centres(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid of each palette, and the mean distance of its points to it."""
    c = (p[..., :3] * p[..., 3:]).sum(axis=1)
    return c, (np.sqrt(((p[..., :3] - c[:, None]) ** 2).sum(axis=2)) * p[..., 3]).sum(axis=1)


def centroid_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the earth mover's distance of palettes of equal mass: the distance of their centroids."""
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


def channel_bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the earth mover's distance of a[i] and b[i], from below and above.

    Below: the length of the three channels' W1 distances (the mean way in a channel is no shorter, and a length of means no more than a mean length). Above: what
    the cheapest of the three plans costs that is best for one channel alone.
    """
    square, above = np.zeros(len(a)), np.full(len(a), np.inf)
    for c in range(3):
        x, y = (np.take_along_axis(p, np.argsort(p[..., c], axis=1, kind="stable")[..., None], 1) for p in (a, b))
        cx, cy = np.cumsum(x[..., 3], axis=1), np.cumsum(y[..., 3], axis=1)
        ends = np.sort(np.concatenate([cx, cy], axis=1), axis=1)
        mass = np.diff(ends, axis=1, prepend=0.0)
        middle = ends - mass / 2
        at = [np.minimum((sums[:, None, :] < middle[..., None]).sum(axis=2), sums.shape[1] - 1) for sums in (cx, cy)]
        way = np.take_along_axis(x, at[0][..., None], 1)[..., :3] - np.take_along_axis(y, at[1][..., None], 1)[..., :3]
        square += (mass * np.abs(way[..., c])).sum(axis=1) ** 2
        above = np.minimum(above, (mass * np.sqrt((way * way).sum(axis=2))).sum(axis=1))
    return np.sqrt(square), above


def emd(a: np.ndarray, b: np.ndarray) -> float:
    """Exact, in 6 places."""
    x, y = (p[p[:, 3] > 0] for p in (a, b))
    return round(transport(x[:, :3], x[:, 3], y[:, :3], y[:, 3]), 6)


class Refiner:
    """Exact distances of one batch of items where bounds leave open whether they count: among the k least, and (if `furthest`) the largest."""

    def __init__(self, queries: np.ndarray, k: int, kth: np.ndarray, low: np.ndarray, furthest: bool, chunk: int = 256):
        self.q, self.best, self.most, self.furthest, self.chunk = queries, Nearest(len(queries), k, kth), low.copy(), furthest, chunk
        self.solved, self.pairs = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        self.centre, self.spread = centres(queries)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        c, spread = centres(x)
        for q in range(len(self.q)):
            low = centroid_distances(self.centre[q : q + 1], c)[0]
            self.pairs[q] += len(ids)
            done = self.near(q, ids, x, low)
            if self.furthest:
                self.far(q, x, low + spread + self.spread[q], done)

    def near(self, q: int, ids: np.ndarray, x: np.ndarray, low: np.ndarray) -> dict[int, float]:
        done: dict[int, float] = {}
        order = np.argsort(low, kind="stable")
        for a in range(0, len(order), self.chunk):
            some = order[a : a + self.chunk]
            some = some[low[some] <= self.best.kth(q) + 1e-6]
            if not len(some):
                break
            below, _ = channel_bounds(np.repeat(self.q[q : q + 1], len(some), 0), x[some])
            for j, bound in sorted(zip(some.tolist(), below.tolist()), key=lambda t: t[1]):
                if bound > self.best.kth(q) + 1e-6:
                    break
                done[j] = emd(self.q[q], x[j])
                self.best.add(q, np.array([done[j]]), ids[j : j + 1])
        self.solved[q] += len(done)
        self.most[q] = max([self.most[q], *done.values()])
        return done

    def far(self, q: int, x: np.ndarray, high: np.ndarray, done: dict[int, float]) -> None:
        order = np.argsort(-high, kind="stable")
        for a in range(0, len(order), self.chunk):
            some = order[a : a + self.chunk]
            some = some[high[some] > self.most[q]]
            if not len(some):
                break
            some = np.array([j for j in some.tolist() if j not in done], np.int64)
            _, above = channel_bounds(np.repeat(self.q[q : q + 1], len(some), 0), x[some])
            for j, bound in sorted(zip(some.tolist(), above.tolist()), key=lambda t: -t[1]):
                if bound <= self.most[q]:
                    break
                self.most[q] = max(self.most[q], emd(self.q[q], x[j]))
                self.solved[q] += 1


def emd_search(items: DataFrame, queries: DataFrame, k: int = 20, furthest: bool = True) -> tuple[DataFrame, DataFrame]:
    """Two tables. Ranks: query_id, rank, item_id, distance, the k palettes (item_id, palette) nearest to each query's (query_id, palette) by exact earth
    mover's distance, in 6 places, ties to the smaller id. Report: query_id, furthest (the largest distance to any item; null unless asked for), pairs, refined.

    Query palettes go in blocks of bounded size. A first look takes centroids alone: a distance is no less than the centroids', and no more than that and both
    spreads, which gives all tasks a kth distance and a largest one to begin with. Then distances are worked out only for pairs whose bounds (of centroids, then of channels)
    leave them a place; no pair makes a row, and a task sends k rows a query.
    """
    some = items.where(F.size("palette") > 0).select(F.col("item_id").cast("long").alias("item_id"), "palette")
    spark = items.sparkSession

    def work(block: pa.Table) -> tuple[Broadcast, DataFrame]:
        ids, palettes_ = block.column("query_id").to_numpy(), stacked(block.column("palette"))
        shared = spark.sparkContext.broadcast((ids, palettes_))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, spread = centres(shared.value[1])
            ends, low = [np.zeros(0)] * len(c), np.zeros(len(c))
            for batch in batches:
                own, wide = centres(stacked(batch.column("palette")))
                for q in range(len(c) if len(own) else 0):
                    d = centroid_distances(c[q : q + 1], own)[0]
                    low[q] = max(low[q], d.max())
                    ends[q] = np.sort(np.concatenate([ends[q], d + wide + spread[q]]))[:k]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(c)), pa.int32()), pa.array(ends, pa.list_(pa.float64())), pa.array(low)], ["q", "ends", "low"])

        seen = some.mapInArrow(look, "q int, ends array<double>, low double").groupBy("q")
        kth, low = np.full(len(ids), np.inf), np.zeros(len(ids))
        for r in seen.agg(F.get(F.array_sort(F.flatten(F.collect_list("ends"))), F.lit(k - 1)).alias("kth"), F.max("low").alias("low")).collect():  # a row for each query of the block
            kth[r.q], low[r.q] = np.inf if r.kth is None else r.kth + 1e-6, max(0.0, r.low - 1e-6)
        start = spark.sparkContext.broadcast((kth, low))

        def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            own = Refiner(q, k, *start.value, furthest)
            for batch in batches:
                if batch.num_rows:
                    own.add(batch.column("item_id").to_numpy(), stacked(batch.column("palette")))
            none = pa.array([None] * len(names), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), none, pa.array(own.most), pa.array(own.solved), pa.array(own.pairs)], ["query_id", "item_id", "distance", "refined", "pairs"])
            for rows in own.best.rows(names):
                zero = pa.array([0] * rows.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns, zero, zero], ["query_id", "item_id", "distance", "refined", "pairs"])

        return shared, some.mapInArrow(refine, "query_id long, item_id long, distance double, refined long, pairs long")

    mine = queries.where(F.size("palette") > 0).select(F.col("query_id").cast("long").alias("query_id"), "palette")
    found = cut(by_blocks(mine, "query_id", work), "emd")
    far = F.max("distance") if furthest else F.lit(None).cast("double")
    report = found.where("item_id is null").groupBy("query_id").agg(far.alias("furthest"), F.sum("pairs").alias("pairs"), F.sum("refined").alias("refined"))
    return nearest(found.where("item_id is not null").select("query_id", "item_id", "distance"), k), report


def emd_top_k(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The ranks of emd_search()."""
    return emd_search(items, queries, k, furthest=False)[0]


def emd_scores(items: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, item_id, score: 1 - distance / (largest distance to any item + 1e-8) of the k nearest."""
    ranks, report = emd_search(items, queries, k)
    return ranks.join(report.select("query_id", "furthest"), "query_id").select("query_id", "rank", "item_id", (1 - F.col("distance") / (F.col("furthest") + 1e-8)).alias("score"))


def statistics(points: DataFrame, key: str = "item_id") -> DataFrame:
    return points.groupBy(key).agg(*(f(c).alias(f"{c}_{n}") for c in CHANNELS for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))))


def transfer(points: DataFrame, styles: DataFrame, strength: float = 1.0) -> DataFrame:
    """Each content item's points with the mean and deviation of each style item: item_id, style_id, point_id, p1, p2, p3 in 0..255.

    `styles` are (style_id, p1, p2, p3) points; one style to many targets, or many styles to one, by what is passed.
    """
    own = statistics(points).select("item_id", *(F.col(f"{c}_{n}").alias(f"{c}_c{n}") for c in CHANNELS for n in "ms"))
    both = points.join(own, "item_id").crossJoin(statistics(styles, "style_id"))
    out = []
    for c in CHANNELS:
        x = (F.col(c) - F.col(f"{c}_cm")) * F.col(f"{c}_s") / F.greatest(F.col(f"{c}_cs"), F.lit(1e-6)) + F.col(f"{c}_m")
        out.append(clip(x if strength >= 1 else x * strength + F.col(c) * (1 - strength)).alias(c))
    return both.select("item_id", "style_id", "point_id", *out)


def empirical_lut(pairs: DataFrame) -> DataFrame:
    """channel, value, mapped: the mean styled value of each original one (rows: channel, value, styled)."""
    return pairs.groupBy("channel", F.floor("value").cast("int").alias("value")).agg(F.avg("styled").alias("mapped"))


def apply_lut(points: DataFrame, lut: DataFrame) -> DataFrame:
    """Map values through the table (at most 256 rows a channel, so it is broadcast); unseen values stay; clipped and truncated."""
    key = F.floor("value").cast("int")
    table = F.broadcast(lut.withColumnRenamed("value", "v"))
    out = points.withColumn("v", key).join(table, ["channel", "v"], "left")
    return out.withColumn("value", F.floor(clip(F.coalesce("mapped", F.col("v").cast("double")))).cast("int")).drop("v", "mapped")
