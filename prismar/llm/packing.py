"""Packing (operator 1): cutting-stock column generation over a histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismar.llm.common import materialize, slices
from prismar.llm.tokens import encoder, id_bytes, tokenizer_path

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, width: int, end_id: int = 1, tokenizer: str | None = None, slice_bytes: int = 4 << 20, cached: int = 400_000) -> DataFrame:
    """Tokenise each text, add `end_id`, and cut it into pieces of `width` ids and one shorter rest.

    A worker takes about `slice_bytes` of text at once and remembers about `cached` chunks; neither changes a piece.
    """
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, id_bytes, limit=cached)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", slice_bytes):
            rows: list[tuple] = []
            for doc, parts in zip(batch.column("doc_id").to_pylist(), own.values(batch.column("text").to_pylist())):
                ids = b"".join([*parts, end])
                n = len(ids) // 4
                for a in range(0, n, width):
                    part = ids[4 * a : 4 * (a + width)]
                    rows.append((doc, a, len(part) // 4, zlib.crc32(part), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of `sizes` (ascending) within `capacity`: (its price, how many of each)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := np.searchsorted(sizes, c, "right"):
            value = prices[:k] + best[c - sizes[:k]]
            j = int(value.argmax())
            if value[j] > best[c] + 1e-12:
                best[c], take[c] = value[j], j
    counts, c = np.zeros(len(sizes), int), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[capacity]), counts


def cutting_stock(demand: dict[int, int], capacity: int, gap: float = 0.001, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: pieces} and how often each is used; together they hold exactly the demanded pieces.

    The linear program over patterns is solved by revised simplex steps, whose entering pattern the knapsack prices at dual prices
    smoothed towards the best known ones; it stops within `gap` of their lower bound. The solution is rounded down, and the few pieces left over (a bounded number per pattern) are put together by first fit, longest first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n), int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / (capacity // sizes))
    centre = sizes / capacity  # the best dual prices so far: no pattern is worth more than one sequence at these
    bound = float(centre @ need)
    for step in range(rounds):
        dual, x = inverse.sum(axis=0), inverse @ need
        if x.sum() <= bound * (1 + gap):
            break
        smooth = 0.7 * centre + 0.3 * dual
        price, column = knapsack(sizes, smooth, capacity)
        if smooth @ need / price > bound:
            centre, bound = smooth / price, float(smooth @ need / price)
        if dual @ column <= 1 + 1e-7:
            price, column = knapsack(sizes, dual, capacity)
            if price <= 1 + 1e-7:
                break
        d = inverse @ column
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        if step % 32 == 31:  # a Newton step takes rounding errors away
            inverse = 2 * inverse - inverse @ (basis @ inverse)
    inverse = 2 * inverse - inverse @ (basis @ inverse)
    used = np.floor(inverse @ need + 1e-6).astype(int).clip(0)
    while ((left := need.astype(int) - basis.astype(int) @ used) < 0).any():  # rounding errors alone
        used[int(np.argmax(basis[int(left.argmin())] * (used > 0)))] -= 1
    plan = [({int(s): int(a) for s, a in zip(sizes, basis[:, k].astype(int)) if a}, int(used[k])) for k in range(m) if used[k]]
    while left.any():
        room, pattern = capacity, {}
        for k in range(m - 1, -1, -1):
            if take := min(int(left[k]), room // int(sizes[k])):
                pattern[int(sizes[k])], room, left[k] = take, room - take * int(sizes[k]), left[k] - take
        times = min((int(left[np.searchsorted(sizes, s)]) // a for s, a in pattern.items()), default=0)
        for s, a in pattern.items():
            left[np.searchsorted(sizes, s)] -= times * a
        plan.append((pattern, times + 1))
    return plan


def layout(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each class the rank ranges of its pieces: columns lo, pieces per sequence, first sequence, first slot."""
    at: dict[int, list] = {}
    filled: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for size in sorted(pattern, reverse=True):
            at.setdefault(size, []).append((filled.get(size, 0), pattern[size], sequence, slot))
            filled[size] = filled.get(size, 0) + pattern[size] * times
            slot += pattern[size]
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in at.items()}


def pack(docs: DataFrame, width: int = 2048, unit: int = 16, end_id: int = 1, tokenizer: str | None = None, rows_per_salt: int = 20_000, **memory: int) -> DataFrame:
    """Pack all documents into sequences of at most `width` ids; a row for each piece.

    Lengths are rounded up to multiples of `unit` for the linear program (at most width/unit classes, whatever the input);
    offsets use the exact lengths, so sequences have no gaps. Pieces of a class are ranked over salted parts of it, so a
    class that holds most rows is spread over tasks. A null or empty text is its end id; repeated rows are packed each; an empty table
    gives no rows; other columns are ignored. A text of any length is cut into as many pieces as it needs.
    `memory`: slice_bytes and cached of `pieces`.
    """
    cut = materialize(pieces(docs, width, end_id, tokenizer, **memory).withColumn("cls", F.ceil(F.col("length") / unit).cast("int")), "pieces")
    demand = {r.cls: r["count"] for r in cut.groupBy("cls").count().collect()}  # at most width/unit rows
    places = layout(cutting_stock(demand, width // unit))
    salts = max(64, sum(demand.values()) // rows_per_salt)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    offsets = salted.groupBy("cls", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("cls").orderBy("salt")) - F.col("n")).drop("n")
    order = Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["cls", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "rank"))
            sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                own = np.flatnonzero(cls == c)
                lo, each, first, at = places[int(c)][np.searchsorted(places[int(c)][:, 0], rank[own], "right") - 1].T
                k = rank[own] - lo
                sequence[own], slot[own] = first + k // each, at + k % each
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    placed = ranked.select(*names, "cls", "rank").mapInArrow(place, f"{PIECES}, sequence_id long, slot long")
    along = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.withColumn("offset", F.sum("length").over(along) - F.col("length")).drop("slot")
