"""Benchmark decontamination (operator 2): an FM-index for each training shard, searched backwards for test phrases.

A shard is a run of documents in one task. Words that occur in no test phrase can't lie inside an occurrence, so the indexed
text of a shard is its runs of phrase words, each closed by a separator; nothing that could match is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import materialize, slices

_TO_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HITS = "doc_id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<long>"


def item_words(text: bytes | None) -> list[bytes]:
    """Lower-case A-Z; words of digits, letters and whatever isn't ASCII."""
    return text.translate(_TO_SPACE).split() if text else []


class WaveletMatrix:
    """Rank and access over small integers, a bit vector with running counts for each binary digit."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1
            counts = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((bit, ones.astype(bool), counts, len(values) - int(counts[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(at)
        for bit, _, counts, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            start = np.where(one, zeros + counts[start], start - counts[start])
            at = np.where(one, zeros + counts[at], at - counts[at])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for bit, ones, counts, zeros in self.levels:
            one = ones[at]
            value |= one.astype(at.dtype) << bit
            at = np.where(one, zeros + counts[at], at - counts[at])
        return value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; each separator (0) differs from the others, so that comparisons end there."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + int(ends.sum()))
    width = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - width)] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Burrows-Wheeler transform in a wavelet matrix, with suffix positions sampled at every `step` and at run starts."""

    def __init__(self, text: np.ndarray, sigma: int, step: int = 16):
        order = suffix_array(text)
        self.n = len(text)
        before = text[order - 1]
        self.bwt = WaveletMatrix(before, sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.sampled = (order % step == 0) | (before == 0)
        self.position = np.where(self.sampled, order, -1)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases of one length, all stepped backwards together."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live] = self.first[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.bwt.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.where(low < high, high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        out, steps, live, now = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[now]
            out[live[done]] = self.position[now[done]] + steps
            live, now = live[~done], now[~done]
            symbol = self.bwt.access(now)
            now = self.first[symbol] + self.bwt.rank(symbol, now)
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of items, by length, and the items that each belongs to."""

    def __init__(self, items: list[tuple[int, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item, text in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item_words(text))
            for k in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(ids[k : k + width], set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[set]]] = {}
        for length in sorted({len(w) for w in owners}):
            own = [w for w in owners if len(w) == length]
            self.by_length[length] = (np.array(own, np.int64), [owners[w] for w in own])
        self.shortest = min(self.by_length, default=0)


def shard_hits(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set]]:
    """For each document of a shard, its merged spans of hit words and the items whose windows occur in it."""
    spans: list[list] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]
    lengths = np.array([len(d) for d in docs], np.int64)
    ids = np.concatenate([np.concatenate([d, [0]]) for d in docs]) if docs else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(docs)), lengths + 1)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1)
    ends = np.flatnonzero(ids == 0)
    runs = np.diff(np.concatenate([[-1], ends])) - 1
    keep = np.repeat(runs >= max(1, phrases.shortest), runs + 1)
    text, doc, place = ids[keep].astype(np.int64), doc[keep], place[keep]
    if not len(text) or not phrases.by_length:
        return spans, items
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    edge = np.zeros(len(text) + 1, np.int64)
    for length, (windows, owners) in phrases.by_length.items():
        low, high = index.search(windows)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        count = (high - low)[found]
        window = np.repeat(found, count)
        rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[found], count)
        at = index.locate(rows)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        pairs = np.unique(doc[at] * len(windows) + window)
        for d, w in zip((pairs // len(windows)).tolist(), (pairs % len(windows)).tolist()):
            items[d] |= owners[w]
    covered = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
    change = np.diff(covered)
    for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
        spans[doc[a]].append((int(place[a]), int(place[b - 1]) + 1))
    return spans, items


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """The test items in blocks of about `block_bytes`, so that what is broadcast has a bound however many there are."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null and item_id is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        yield [(r.item_id, bytes(r.text)) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]


def _merge(a: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(a):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = 8 << 20, shard_bytes: int = 16 << 20, with_key: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, spans (word offsets, merged), items (ascending ids) for each row of `docs`; with_key: and row, its key.

    No shuffle while the test items fit one block. More blocks are searched one after the other, and the spans of a row are
    merged by a key of the row. Null texts have no words; items without words or with a null id are never found; repeated rows each give a row. Texts of any
    length are searched whole, in shards of `shard_bytes` or of one longer text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def one(shared, keyed: bool) -> DataFrame:

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(shared.value, width)
            known = phrases.vocabulary.get
            for batch in slices(batches, "text", shard_bytes):
                ids = []
                for t in batch.column("text"):
                    words = item_words(t.as_py())
                    ids.append(np.fromiter((known(w, 0) for w in words), np.int32, len(words)))
                spans, items = shard_hits(ids, phrases)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "n_words": [len(x) for x in ids], "n_hit": [sum(b - a for a, b in s) for s in spans],
                    "spans": [[{"start": a, "end": b} for a, b in s] for s in spans], "items": [sorted(x) for x in items],
                    **({"row": batch.column("row")} if "row" in batch.schema.names else {}),
                }, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64())), *([("row", pa.int64())] if "row" in batch.schema.names else [])]))

        source = rows.withColumn("row", F.xxhash64("doc_id", "text")) if keyed else rows
        return source.mapInArrow(search, HITS + ", row long" * keyed)

    stream = item_blocks(benchmark, block_bytes)
    first = next(stream)
    rest = next(stream, None)
    if rest is None:
        return one(spark.sparkContext.broadcast(first), with_key)
    parts = []
    for block in chain([first, rest], stream):  # one block at a time is held by the driver and the executors
        shared = spark.sparkContext.broadcast(block)
        part = one(shared, True).groupBy("row", "doc_id", "n_words").agg(F.first("spans").alias("spans"), F.first("items").alias("items"), F.count(F.lit(1)).alias("n"))
        parts.append(materialize(part, "block-hits"))
        shared.destroy()
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    grouped = together.groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("n").alias("n"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_merge([(x["start"], x["end"]) for x in s]) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([*([batch.column("row")] * with_key), batch.column("doc_id"), batch.column("n_words"), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), batch.column("items")], [*(["row"] * with_key), "doc_id", "n_words", "n_hit", "spans", "items"])

    each = grouped.select("row", "doc_id", "n_words", F.explode(F.array_repeat(F.struct("spans", "items"), F.col("n").cast("int"))).alias("x"))
    return each.select("row", "doc_id", "n_words", "x.spans", "x.items").mapInArrow(merge, "row long, " * with_key + HITS)


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def digest(hits: DataFrame) -> DataFrame:
    """The contract's columns, derived from the operator's spans and items."""
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that the contamination rule rejects; other rows and columns are left as they are.

    Rows go by id and text: another text of the same id, or without an id, stays.
    """
    bad = materialize(find_hits(docs, benchmark, with_key=True, **options).where(is_contaminated()).select("row").distinct(), "contaminated")
    return docs.join(bad, F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("binary")) == bad["row"], "left_anti")


__all__ = ["FMIndex", "Phrases", "WaveletMatrix", "digest", "find_hits", "item_words", "remove_contaminated", "shard_hits", "suffix_array"]
