"""Ranked lexical search by hashed sketches of maxima (operator 13).

A document's sketch has WIDTH coordinates; each holds the largest impact of the terms that hash to it. A query's weights times the sketch at its
terms' coordinates is therefore never below its score. Documents are rescored exactly by falling bound until the bound is below the k-th score.

The impact of a term rises with its occurrences, so the index stores the largest *count* in each coordinate (rounded up to one of 127 levels), before
the collection's size and mean length are known; the maxima of impacts follow from these without another pass over the texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismar.llm.common import WordHashes, materialize, slices

WIDTH, TILE, STEP = 4096, 1024, 64
_TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The counts that a coordinate can hold: each one to 64, then a quarter more each time; what is beyond the last has the impact's limit.
LEVELS = np.array([*range(65), *(int(64 * 1.25**k) for k in range(1, 62))], np.int64)
INDEX = "doc_id long, n long, slots array<short>, tops array<byte>, terms array<int>, counts array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text; bytes.lower acts on A-Z alone."""
    return _TERM.findall(text.lower()) if text else []


def impact(tf, length):
    """`length`: the document's m; 64-bit integers. The limit for any count is below a million."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * length)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(item_id, its distinct terms) in blocks of about `block_bytes` of text; the rows of an item are in one block."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null and item_id is not null").distinct()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        terms: dict[int, set[bytes]] = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():
            terms.setdefault(r.item_id, set()).update(terms_of(bytes(r.text)))
        yield [(i, sorted(t)) for i, t in sorted(terms.items()) if t]


def build_index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A written row for each row of `docs` with a term: its sketch over all its terms, and its counts of the terms in `vocabulary` (by number)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), shared.value
        names = known.keys()
        for batch in slices(batches, "text"):
            columns: list[list] = [[], [], [], [], [], []]
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = terms_of(t.as_py())
                if not words:
                    continue
                counted = Counter(words)
                hashes.trim()
                slot = np.fromiter(map(hashes.__getitem__, counted), np.uint64, len(counted)) % np.uint64(WIDTH)
                most = np.zeros(WIDTH, np.int64)
                np.maximum.at(most, slot.astype(np.int64), np.fromiter(counted.values(), np.int64, len(counted)))
                slots = np.flatnonzero(most)
                own = sorted((known[w], counted[w]) for w in counted.keys() & names)
                for c, x in zip(columns, (i, len(words), slots.astype(np.int16), np.searchsorted(LEVELS, most[slots]).astype(np.int8), [k for k, _ in own], [n for _, n in own])):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in INDEX.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    return materialize(rows.mapInArrow(build, INDEX), "max-sketches")


class Ranking:
    """The k best of a query so far: highest score first, then smallest id, rows without an id last."""

    def __init__(self, k: int, start: int):
        self.k, self.kth = k, max(1, start)
        self.score, self.missing, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.kth
        if good.any():
            score, missing, ids = (np.concatenate(x) for x in ((self.score, score[good]), (self.missing, missing[good]), (self.id, ids[good])))
            keep = np.lexsort((ids, missing, -score))[: self.k]
            self.score, self.missing, self.id = score[keep], missing[keep], ids[keep]
            if len(keep) == self.k:
                self.kth = max(self.kth, int(self.score[-1]))


class Searcher:
    """Ranks tiles of index rows for all queries of a block. `queries`: (term numbers ascending, their coordinates, weights) of each."""

    def __init__(self, queries: list, n_terms: int, n_docs: int, total: int, k: int, start: list[int]):
        self.queries, self.n_terms, self.n_docs, self.total = queries, n_terms, n_docs, total
        self.best = [Ranking(k, s) for s in start]
        self.sketch = np.zeros((WIDTH, TILE))
        self.rescored = self.pairs = 0

    def tile(self, batch: pa.RecordBatch) -> None:
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = lambda c: np.repeat(np.arange(batch.num_rows), batch.column(c).value_lengths().to_numpy(zero_copy_only=False))
        missing = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
        length = 50 + (50 * batch.column("n").to_numpy() * self.n_docs) // self.total
        slots, row, level = flat("slots"), place("slots"), flat("tops")
        top = impact(LEVELS[np.minimum(level, len(LEVELS) - 1)], length[row])
        self.sketch[slots, row] = np.where(level < len(LEVELS), top, 1_000_000)
        keys, counts = place("terms") * self.n_terms + flat("terms"), flat("counts")
        for (terms, at, weights), best in zip(self.queries, self.best):
            bound = weights @ self.sketch[at, : batch.num_rows]  # integers below 2**53, so exact
            open_ = np.flatnonzero(bound >= best.kth)
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            self.pairs += batch.num_rows
            for a in range(0, len(open_), STEP):
                some = open_[a : a + STEP]
                some = some[bound[some] >= best.kth]
                if not len(some):
                    break
                want = some[:, None] * self.n_terms + terms
                found = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
                tf = np.where(keys[found] == want, counts[found], 0) if len(keys) else np.zeros_like(want)
                best.add(impact(tf, length[some][:, None]) @ weights.astype(np.int64), missing[some], ids[some])
                self.rescored += len(some)
        self.sketch[slots, row] = 0


def search(docs: DataFrame, benchmark: DataFrame, k: int = 50, block_bytes: int = 8 << 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k rows of `docs` (doc_id, text) with the highest scores above 0 for each item of `benchmark` (item_id, text).

    Null and empty texts have no term and never rank; a repeated row of `docs` ranks once for each row; of equal scores the smaller doc_id comes
    first and rows without an id last. Rows of one item_id are one item with all their terms; items without an id or a term give nothing, and so do empty
    tables. Texts of any length are counted whole. Other columns are ignored.

    Items are taken in blocks of `block_bytes` (an item is never split); a block's terms are broadcast. No text is shuffled: the index rows stay where they
    are written, and a task sends k rows an item at most, none of them below the k-th score of a first round over a 32nd of the rows.
    """
    spark = docs.sparkSession
    blocks = []
    stream = item_blocks(benchmark, block_bytes)
    block = next(stream)
    while block is not None:
        following = next(stream, None)
        part = _search_block(docs, block, k)
        blocks.append(part if following is None and not blocks else materialize(part, "search-block"))
        block = following
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b)
    return out if blocks else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_block(docs: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: n for n, w in enumerate(sorted({w for _, t in items for w in t}))}
    index = build_index(docs, vocabulary)
    n_docs, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r.term: r.n for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more rows than the vocabulary
    hashes, queries = WordHashes(), []
    for _, terms in items:
        own = [(n, w) for n, w in sorted((vocabulary[w], w) for w in terms) if n in df]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[n] + 1))) for n, _ in own], float)
        queries.append((np.array([n for n, _ in own], np.int64), np.array([hashes[w] % WIDTH for _, w in own], np.int64), weights))
    ids, n_terms = [i for i, _ in items], max(1, len(vocabulary))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())

    def round_of(rows: DataFrame, start: list[int]) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, queries, start))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, own, lowest = shared.value
            ranks = Searcher(own, n_terms, n_docs, total, k, lowest)
            for batch in batches:
                for a in range(0, batch.num_rows, TILE):
                    ranks.tile(batch.slice(a, TILE))
            for i, best in zip(names, ranks.best):
                if len(best.id):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(best.id), pa.int64()), pa.array(best.id, pa.int64(), mask=best.missing), pa.array(best.score, pa.int64())], ["item_id", "doc_id", "score"])

        found = rows.mapInArrow(run, "item_id long, doc_id long, score long")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = round_of(index.where(F.pmod(F.xxhash64("doc_id", "n", "slots"), F.lit(32)) == 0), [0] * len(ids))
    reached = {r.item_id: r.kth for r in first.groupBy("item_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).collect()}
    return round_of(index, [reached.get(i, 0) for i in ids]).select("item_id", "rank", "doc_id", "score")
