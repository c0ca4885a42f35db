"""Exact top-k search (operator 5): a ball tree per shard, searched by branch and bound for blocks of queries.

The trees are built once and written. Leaves are visited by falling upper bound of the inner product, and the current kth score of each
query is shared: between the shards of a task as it goes on, and between all tasks by a first round that visits the best leaf of each shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismar.llm.common import materialize

LEAF, SHARD = 128, 16_384
INDEX = "size int, ids binary, data binary, centres binary, radius binary, spans binary, parents binary"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component. Vectors that are null, empty or hold null or non-finite components are left out, and so
    are rows without an id."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and vec_id is not null")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & (F.size("embedding") > 0)).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v"))


class BallTree:
    """Centres, radii, spans of rows and parents of the nodes over a shard's rows, parents first; leaves are spans of up to LEAF rows.

    Nodes are split at the median along their widest direction; rows lie in the order of the leaves.
    """

    def __init__(self, ids: np.ndarray, data: np.ndarray, centres: np.ndarray, radius: np.ndarray, spans: np.ndarray, parents: np.ndarray):
        self.ids, self.data, self.centres, self.radius, self.spans, self.parents = ids, data, centres, radius, spans, parents
        inner = np.zeros(len(parents), bool)
        inner[parents[1:]] = True
        self.leaves = np.flatnonzero(~inner)

    @classmethod
    def build(cls, ids: np.ndarray, data: np.ndarray) -> BallTree:
        x, order = data.astype(float), np.arange(len(data))
        centres, radius, spans, parents = [], [], [], []
        todo = [(0, len(data), 0)]
        while todo:
            a, b, parent = todo.pop()
            own = x[order[a:b]]
            centre = own.mean(axis=0)
            at = len(parents)
            centres.append(centre)
            radius.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            spans.append((a, b))
            parents.append(parent)
            spread = own.max(axis=0) - own.min(axis=0)
            if b - a > LEAF and spread.max() > 0:
                order[a:b] = order[a:b][np.argsort(own[:, int(spread.argmax())], kind="stable")]
                todo += [(a, (a + b) // 2, at), ((a + b) // 2, b, at)]
        return cls(ids[order], data[order], np.array(centres), np.array(radius), np.array(spans, np.int64), np.array(parents, np.int64))

    def bounds(self, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Queries x leaves: no row of the leaf has a larger inner product; a leaf's bound is at most those of the nodes above it."""
        at = queries @ self.centres.T
        reach = norms[:, None] * self.radius
        out = at + reach + 1e-6 * (1 + np.abs(at) + reach)
        for node in range(1, len(self.parents)):
            np.minimum(out[:, node], out[:, self.parents[node]], out=out[:, node])
        return out[:, self.leaves]


class Best:
    """The k best (score, vec_id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [[] for _ in range(n)]

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> float:
        """The query's kth score after these; -inf while it has fewer than k."""
        if len(ids) > self.k:
            scores_ = scores if scores.dtype == object else None
            keep = np.lexsort((ids, -scores))[: self.k] if scores_ is None else sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[: self.k]
            scores, ids = scores[keep], ids[keep]
        own = self.found[i] = sorted([*self.found[i], *zip((-scores).tolist(), ids.tolist())])[: self.k]
        return at_most(-own[-1][0]) if len(own) == self.k else -np.inf


def at_most(score: int) -> float:
    """The score as a double that isn't larger."""
    near = float(score)
    return near if near <= score else float(np.nextafter(near, -np.inf))


def search(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, best: Best, rounds: int | None = None) -> None:
    """Visit each query's leaves by falling bound for as long as they can hold a score of its kth or more (`rounds` leaves at most), and
    raise `kth` with what is found."""
    exact = max(float(np.abs(tree.data).max(initial=0)), 1.0) * max(float(np.abs(queries).max(initial=0)), 1.0) * tree.data.shape[1] < 2**53
    q, x = queries.astype(float), tree.data.astype(float)
    bounds = tree.bounds(q, np.sqrt((q * q).sum(axis=1)))
    order = np.argsort(-bounds, axis=1, kind="stable")
    live = np.arange(len(q))
    for step in range(min(order.shape[1], rounds or order.shape[1])):
        leaf = order[live, step]
        going = bounds[live, leaf] >= kth[live]
        live, leaf = live[going], leaf[going]
        if not len(live):
            return
        by_leaf = np.argsort(leaf, kind="stable")
        for who in np.split(live[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            a, b = tree.spans[tree.leaves[order[who[0], step]]]
            ids = tree.ids[a:b]
            scores = (q[who] @ x[a:b].T).astype(np.int64) if exact else queries[who].astype(object) @ tree.data[a:b].astype(object).T
            for i, row in zip(who.tolist(), scores):
                good = np.flatnonzero((row >= kth[i]) & (ids != query_ids[i]))
                if len(good):
                    kth[i] = max(kth[i], best.add(i, row[good], ids[good]))


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """A written row for each shard of up to `shard` vectors of one length, with its ball tree."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(size: int) -> pa.RecordBatch:
            got = held.pop(size)
            t = BallTree.build(np.concatenate([i for i, _ in got]), np.concatenate([d for _, d in got]))
            parts = (t.ids, t.data, t.centres, t.radius, t.spans, t.parents)
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], [f.split()[0] for f in INDEX.split(", ")])

        for batch in batches:
            v = batch.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == size)
                for k in range(0, len(pick), shard):
                    some = pick[k : k + shard]
                    held.setdefault(size, []).append((batch.column("vec_id").to_numpy()[some], v.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)))
                    if sum(len(i) for i, _ in held[size]) >= shard:
                        yield row(size)
        for size in list(held):
            yield row(size)

    return materialize(vectors.mapInArrow(build, INDEX), "ball-trees")


def read_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, BallTree]]:
    kinds = {"ids": np.int64, "data": np.int64, "centres": float, "radius": float, "spans": np.int64, "parents": np.int64}
    for batch in batches:
        for k in range(batch.num_rows):
            size = batch.column("size")[k].as_py()
            own = {n: np.frombuffer(batch.column(n)[k].as_buffer(), t) for n, t in kinds.items()}
            yield size, BallTree(own["ids"], own["data"].reshape(-1, size), own["centres"].reshape(-1, size), own["radius"], own["spans"].reshape(-1, 2), own["parents"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 16_384, tile: int = 1024, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product with each query, ties to the smaller vec_id.

    `vectors` and `queries` are (vec_id, v) tables of integers. Vectors of another length than the query's take no part; a repeated vec_id
    is a candidate at each row, but never for a query of the same id; a query id counts once. An empty table gives none.

    Memory: a block of at most `block` queries is broadcast at a time, and its results are written before the next if there are several; a
    task holds one shard of `shard` rows and works on tiles of `tile` queries, so that its largest arrays have tile x nodes numbers; beside
    these, k results for each query of the block.
    """
    spark = vectors.sparkSession
    index = build_index(vectors, shard)
    blocks = max(1, -(-queries.count() // block))
    kinds = "query_id long, vec_id long, score long"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def round_of(shared, rounds: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_size = shared.value
            state = {size: (kth.copy(), Best(len(ids), k)) for size, (ids, _, kth) in by_size.items()}
            for size, tree in read_trees(batches):
                if size in by_size:
                    ids, q, _ = by_size[size]
                    kth, best = state[size]
                    for a in range(0, len(ids), tile):
                        some, part = kth[a : a + tile], Best(0, k)
                        part.found = best.found[a : a + tile]
                        search(tree, ids[a : a + tile], q[a : a + tile], some, part, rounds)
                        best.found[a : a + tile] = part.found
            for size, (_, best) in state.items():
                out = [(int(by_size[size][0][i]), v, -s) for i, own in enumerate(best.found) for s, v in own]
                for a in range(0, len(out), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[a : a + 100_000])], ["query_id", "vec_id", "score"])

        found = index.mapInArrow(run, kinds)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    together = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        got = own.dropDuplicates(["vec_id"]).orderBy("vec_id").toArrow()  # `block` rows or so
        ids, v = got.column("vec_id").to_numpy(), got.column("v").combine_chunks()
        sizes = v.value_lengths().to_numpy(zero_copy_only=False)
        by_size = {}
        for size in np.unique(sizes).tolist():
            pick = np.flatnonzero(sizes == size)
            by_size[size] = (ids[pick], v.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), np.full(len(pick), -np.inf))
        first = spark.sparkContext.broadcast(by_size)
        reached = {r.query_id: r.kth for r in round_of(first, 1).groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
        first.destroy()
        shared = spark.sparkContext.broadcast({size: (i, q, np.array([at_most(reached[x]) if x in reached else -np.inf for x in i.tolist()])) for size, (i, q, _) in by_size.items()})
        part = round_of(shared, None)
        if blocks > 1:
            part = materialize(part, "topk-block")
            shared.destroy()
        together = part if together is None else together.unionByName(part)
    return together.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
