"""Line dedup (operator 7): a document loses the blocks of lines that it shares with an earlier one.

Overlapping documents are found through hashes of shared runs of lines, the shortest that reach the least number of words: a run is as rare as
the rarest of its lines, so that common lines alone make no pairs. Each run's first document owns it, and a document is aligned with the
owners of its runs. Any common block of two documents is covered by such runs (take the shortest from its start, to its end, and around
each line), and each of these has an owner no later than the earlier document; so the pairs, which are no more than there are runs, give
all the lines that aligning a document with every earlier one would give.

Each pair is aligned by patience diff over the shared runs: unique lines in the longest common order, grown over equal neighbours, and then what is left,
moved and repeated passages, in the later document's order. These blocks are what is reported and what goes. As moved and repeated passages go too, no
line of a shared run is ever left, and the lines that go could be told from the runs alone; the alignment tells to which of the owner's lines each belongs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import NO_ID, WordHashes, materialize, mix64, slices

BLOCKS = "array<struct<owner:bigint,first:int,theirs:int,lines:int>>"


def longest_rise(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that rises in both places (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, a) in enumerate(pairs):
        k = bisect_left(tops, a)
        back[i] = at[k - 1] if k else -1
        tops[k : k + 1] = [a]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned_blocks(pairs: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Common blocks (place in the later document, place in the earlier, lines) of two documents, given the places of their equal lines.

    Patience diff: lines that both have once are put in the longest common order, and each grows over equal neighbours. What is left (moved
    passages, and lines that one of them repeats) is taken in the later document's order and grows in the same way, each of its lines
    once, the earlier document's as often as needed; so the time is in proportion to the pairs, but for the sorting.
    """
    theirs: dict[int, list[int]] = {}
    uses: dict[int, int] = {}
    for b, a in sorted(pairs):
        theirs.setdefault(b, []).append(a)
        uses[a] = uses.get(a, 0) + 1
    free, blocks = set(theirs), []
    anchors = longest_rise([(b, own[0]) for b, own in theirs.items() if len(own) == 1 and uses[own[0]] == 1])
    for b, a in [*anchors, *((b, own[0]) for b, own in theirs.items())]:
        if b not in free:
            continue
        start, end = 0, 1
        while b + end in free and (b + end, a + end) in pairs:
            end += 1
        while b + start - 1 in free and (b + start - 1, a + start - 1) in pairs:
            start -= 1
        free.difference_update(range(b + start, b + end))
        blocks.append((b + start, a + start, end - start))
    return blocks


def shortest_runs(words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest runs of at least `min_words` words from each line on and up to each line, within documents.

    `words` are the word counts of the lines, `doc` their documents in rising order.
    """
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    ends = np.searchsorted(upto, upto[:-1] + min_words) - 1
    starts = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    first, last = np.concatenate([np.arange(n), starts]), np.concatenate([ends, np.arange(n)])
    good = (first >= 0) & (last < n)
    first, last = first[good], last[good]
    same = doc[first] == doc[last]
    both = np.unique(first[same] * n + last[same])
    return both // max(n, 1), both % max(n, 1)


def run_hashes(lines: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the line hashes of each run, in order."""
    out, live = np.zeros(len(first), np.uint64), np.arange(len(first))
    step = 0
    while len(live):
        out[live] = mix64(out[live] * np.uint64(0x9E3779B97F4A7C15) + lines[first[live] + step])
        step += 1
        live = live[first[live] + step <= last[live]]
    return out


def numbered(doc: np.ndarray, run: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each run among its document's equal runs, from 0 in the order of their first lines, and how many these are."""
    order = np.lexsort((first, run, doc))
    new = np.flatnonzero(np.concatenate([[True], (run[order][1:] != run[order][:-1]) | (doc[order][1:] != doc[order][:-1])])) if len(order) else order
    sizes = np.diff(np.concatenate([new, [len(order)]]))
    occ, times = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
    occ[order] = np.arange(len(order)) - np.repeat(new, sizes)
    times[order] = np.repeat(sizes, sizes)
    return occ, times


def line_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """run (hash), id and h (row key), at (the number of its first line, of those that aren't blank), places of its lines, occ (which of the document's
    runs of this hash it is) and times (how many there are): the shortest runs of at least `min_words` words of each document."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            found = [(k, p, line, n) for k, text in enumerate(batch.column("text").to_pylist()) for p, line, n in text_lines(text)]
            doc, place, lines, words = zip(*found) if found else ((), (), (), ())
            doc, place = np.array(doc, np.int64), np.array(place, np.int32)
            first, last = shortest_runs(np.array(words, np.int64), doc, min_words)
            run = run_hashes(np.fromiter(map(hashes.__getitem__, lines), np.uint64, len(lines)), first, last)
            hashes.trim(50_000)
            owner, begin = doc[first], np.searchsorted(doc, doc)
            sizes = last - first + 1
            ends = np.concatenate([[0], np.cumsum(sizes)])
            inside = place[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inside))
            yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), *(batch.column(c).take(pa.array(owner)) for c in ("id", "h")), pa.array((first - begin[first]).astype(np.int32)), places, *map(pa.array, numbered(owner, run, first))], ["run", "id", "h", "at", "places", "occ", "times"])

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(emit, "run long, id long, h long, at int, places array<int>, occ int, times int")


def text_lines(text: bytes) -> Iterator[tuple[int, bytes, int]]:
    """Place, trimmed line and number of words of each line that isn't blank; runs go on over blank lines, which go with them."""
    for place, line in enumerate(text.split(b"\n")):
        if line := line.strip():
            yield place, line, len(line.split())


def shared_blocks(docs: DataFrame, min_words: int) -> DataFrame:
    """id, h (row key), gone (the ranges of its lines that go), blocks (owner, first line, the owner's first line, lines) of each later document.

    A run goes from every document but its owner, however often they have it. A line's first document keeps it, since no earlier one
    has a run with it, so no line vanishes from the corpus.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = materialize(line_runs(docs, min_words), "runs")
    key = F.struct("id", "h")
    owners = runs.groupBy("run").agg(F.min(F.struct("id", "h", "at", F.element_at("places", 1).alias("place"), "times")).alias("o"), F.max(key).alias("latest"))
    owners = owners.where(F.struct("o.id", "o.h") != F.col("latest")).select("run", F.col("o.id").alias("owner"), F.col("o.h").alias("owner_h"), F.col("o.at").alias("theirs"), F.col("o.place").alias("place"), F.col("o.times").alias("own_times"))
    found = runs.join(owners, "run").where(F.struct("owner", "owner_h") < key).withColumn("which", F.least("occ", F.col("own_times") - 1))
    # where the owner has a run more than once, the one of the same number (or its last) is met, so that repeated lines line up
    again = runs.where("times > 1").select(F.col("run").alias("run_"), F.col("id").alias("id_"), F.col("h").alias("h_"), F.col("occ").alias("occ_"), F.col("at").alias("at_"), F.element_at("places", 1).alias("place_"))
    later = found.where("which > 0").join(again, (F.col("run") == F.col("run_")) & (F.col("owner") == F.col("id_")) & (F.col("owner_h") == F.col("h_")) & (F.col("which") == F.col("occ_")))
    columns = ["id", "h", "at", "places", "owner", "owner_h", "theirs", "place"]
    met = found.where("which = 0").select(columns).unionByName(later.withColumns({"theirs": F.col("at_"), "place": F.col("place_")}).select(columns)).distinct()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for k in range(0, b.num_rows, 1024) for r in b.slice(k, 1024).to_pylist())
        out: list[tuple] = []
        for (id_, h), own in groupby(rows, key=lambda r: (r["id"], r["h"])):
            ranges, blocks = [], []
            for (owner, _), found in groupby(own, key=lambda r: (r["owner"], r["owner_h"])):
                found = list(found)
                mine = {r["at"] + k: p for r in found for k, p in enumerate(r["places"])}
                first = {r["at"]: r["place"] for r in found}
                made = aligned_blocks({(r["at"] + k, r["theirs"] + k) for r in found for k in range(len(r["places"]))})
                taken = {b + k for b, _, n in made for k in range(n)}
                ranges += [(r["places"][0], r["places"][-1]) for r in found if all(r["at"] + k in taken for k in range(len(r["places"])))]
                blocks += [{"owner": None if owner == NO_ID else owner, "first": mine[b], "theirs": first.get(b), "lines": n} for b, _, n in sorted(made)]
            out.append((id_, h, joined(ranges), blocks))
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        yield batch_of(out)

    kind = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("gone", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("blocks", pa.list_(pa.struct([("owner", pa.int64()), ("first", pa.int32()), ("theirs", pa.int32()), ("lines", pa.int32())])))])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, kind)], schema=kind)

    dealt = met.repartition(parts, "id", "h").sortWithinPartitions("id", "h", "owner", "owner_h", "at")
    return dealt.mapInArrow(align, f"id long, h long, gone array<struct<first:int,last:int>>, blocks {BLOCKS}")


def joined(ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges of lines, those that touch or overlap made one."""
    out: list[dict] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], b)
        else:
            out.append({"first": a, "last": b})
    return out


def _rewritten(docs: DataFrame, min_words: int) -> DataFrame:
    """`docs` with the new text, __lines, __removed and __blocks."""
    found = materialize(shared_blocks(docs.select("doc_id", "text"), min_words), "shared-blocks").toDF("__id", "__h", "__gone", "__blocks")
    # a merge join at every size, since the blocks grow with the texts
    both = docs.join(found.hint("merge"), (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == found["__id"]) & (F.xxhash64(docs["text"]) == found["__h"]), "left")
    parts, gone = F.split("text", "\n", -1), F.col("__gone")
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["last"] + 1))
    ends = F.concat(F.transform(gone, lambda g: g["first"]), F.array(F.size(parts)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(parts, a + 1, b - a)))
    removed = F.aggregate(gone, F.lit(0), lambda n, g: n + g["last"] - g["first"] + 1)
    both = both.withColumn("__lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
    both = both.withColumn("__removed", F.coalesce(removed, F.lit(0)).cast("long"))
    return both.withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("__id", "__h", "__gone")


def dedup_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """`docs` with the common blocks of at least `min_words` words taken out of the later document of each pair, and
    n_lines, n_removed (lines), blocks (the aligned blocks: the earlier document, the first line here and there, null where it is inside
    a run, and the number of lines that aren't blank); columns of these names are replaced.

    Lines are compared without the white space at their ends. Blank lines don't count, but go where they lie inside a block.
    Order is that of doc_id (null first), then of a text hash. Null texts stay null; repeated rows (same id and text) are one
    document and get the same result; an empty table stays empty. Texts of any length are compared whole.
    """
    out = _rewritten(docs, min_words)
    blocks = F.coalesce("__blocks", F.array().cast(BLOCKS))
    return out.withColumn("n_lines", F.col("__lines")).withColumn("n_removed", F.col("__removed")).withColumn("blocks", blocks).drop("__lines", "__removed", "__blocks")


def dedup_documents(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """The same with the columns of `docs` alone, without the documents that lose all their words; n_chars, if there, follows the text."""
    out = _rewritten(docs, min_words)
    out = out.where((F.col("__removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)
