"""N-gram Jaccard join (operator 4): all documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts are cut into shingles once; their sets are a written table, and documents of equal sets are one class. Shingles are put in one global
order, those in many documents last; two similar classes share one of the first n - ceil(0.8 n) + 1 shingles of each, and classes that share
one are candidates of one another. Inside a candidate group the join skips by set relations: index lists are blocks of one position,
ordered by size, of which whole blocks are skipped; and the answers of a set that is highly similar to one already answered are derived
from that one's candidates and a look at the few shingles in which the two differ.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import WordHashes, connected_components, discard, materialize, mix64, slices, words_of

NUM, DEN, WIDTH, TABLE = 4, 5, 5, 25
PAIR_BYTES, TIMES = 40, 4  # of a pair of classes, with its sizes, in an exchange; how often all sets of a group may be sent without a look at its pairs
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def prefix_size(n):
    return n - (NUM * n + DEN - 1) // DEN + 1


def similar(shared, a, b):
    return DEN * shared >= NUM * (a + b - shared)


def shingle_sets(texts: list[bytes | None], hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than five words is one shingle, one without words none."""
    words = [words_of(t) for t in texts]
    lengths = [len(w) for w in words]
    flat = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(lengths))
    m = len(flat) - WIDTH + 1
    rolled = mix64(sum((flat[k : k + m] * _MUL[k] for k in range(1, WIDTH)), flat[:m] * _MUL[0])) if m > 0 else flat[:0]
    out, at = [], 0
    for n in lengths:
        if n >= WIDTH:
            out.append(np.unique(rolled[at : at + n - WIDTH + 1]))
        elif n:
            out.append(mix64(np.array([sum(int(flat[at + k]) * int(_MUL[k]) for k in range(n)) + n & (2**64 - 1)], np.uint64)))
        else:
            out.append(flat[:0])
        at += n
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, whatever its order."""
    a, b = np.bitwise_xor.reduce(mix64(s)), np.add.reduce(mix64(s ^ _MUL[1]))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def document_sets(rows: DataFrame, key: Callable[[np.ndarray], tuple[int, int]] = set_key, slice_bytes: int = 2 << 20, cached: int = 400_000) -> DataFrame:
    """doc_id, th (hash of the text), n, cid and h2 (set key), shingles (sorted 64-bit hashes) of each row (doc_id, th, text).

    A worker takes about `slice_bytes` of text at once and remembers about `cached` words; neither changes a set.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", slice_bytes):
            sets = shingle_sets([t.as_py() for t in batch.column("text")], hashes)
            hashes.trim(cached)
            keys = [key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "th", "n", "cid", "h2", "shingles"])

    return rows.mapInArrow(emit, "doc_id long, th long, n long, cid long, h2 long, shingles binary")


def separate_classes(sets: DataFrame) -> DataFrame:
    """`sets` (a written table) with a cid of its own for every pair (cid, h2): different sets that share a cid, which is 64 bits wide, get new ones from both hashes."""
    while True:
        clash = sets.where("n > 0").groupBy("cid").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).where("low != high").select("cid")
        if clash.isEmpty():
            return sets
        marked = sets.join(clash.withColumn("shared", F.lit(True)), "cid", "left")
        own = F.when(F.col("shared"), F.xxhash64("cid", "h2")).otherwise(F.col("cid"))
        apart = materialize(marked.withColumn("cid", own).select(sets.columns), "shingle-sets")
        discard(sets)
        sets = apart


def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(s.as_buffer(), "<u8") for s in batch.column("shingles")]


def by_key(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    rows = (r for b in batches for k in range(0, b.num_rows, 64) for r in b.slice(k, 64).to_pylist())
    for key, group in groupby(rows, key=lambda r: tuple(r[n] for n in names)):
        yield key, list(group)


def group_bits(shingles: int) -> int:
    """So many groups of shingles, as a power of two, that one has about a million."""
    return min(20, max(8, (shingles >> 20).bit_length()))


def shingle_levels(sets: DataFrame, parts: int, bits: int) -> np.ndarray:
    """A table of 2^TABLE small numbers, indexed by a shingle's top bits: about twice the binary logarithm of the number of
    documents that have it, counted over all documents; 0 for one document.

    Shingles that fall on one place get the larger number. Where too many places are taken, the lower numbers are left out. The
    table sets the order of shingles only, so neither changes any answer; its size, which is broadcast, is fixed.
    """
    share = 1 << (TABLE - bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", 8 << 20):
            key = np.sort(np.concatenate(sets_of(batch)) >> np.uint64(32 - bits))
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, count = key[begin], np.diff(np.concatenate([begin, [len(key)]]))
            group = (key >> np.uint64(32)).astype(np.int64)
            cuts = np.searchsorted(group, np.arange((1 << bits) + 1))
            rows = []
            for g in np.unique(group).tolist():
                k, c = key[cuts[g] : cuts[g + 1]].astype("<u4"), count[cuts[g] : cuts[g + 1]]
                rows.append((g, k[c == 1].tobytes(), k[c > 1].tobytes(), c[c > 1].astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["g", "once", "more", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g,), rows in by_key(batches, "g"):
            key = np.concatenate([np.frombuffer(r[n], "<u4") for r in rows for n in ("once", "more")])
            times = np.concatenate([x for r in rows for x in (np.ones(len(r["once"]) // 4, np.int64), np.frombuffer(r["counts"], "<u4"))])
            key, at = np.unique(key, return_inverse=True)
            count = np.bincount(at, weights=times).astype(np.int64)
            key, count = key[count > 1], count[count > 1]
            table = np.zeros(share, np.uint8)
            np.maximum.at(table, (key >> np.uint32(32 - (TABLE - bits))).astype(np.int64), np.rint(2 * np.log2(count)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())], ["g", "levels"])

    dealt = sets.select("shingles").mapInArrow(emit, "g int, once binary, more binary, counts binary").repartition(parts, "g").sortWithinPartitions("g")
    levels = np.zeros(1 << TABLE, np.uint8)
    for r in materialize(dealt.mapInArrow(gather, "g int, levels binary"), "levels").collect():  # 2^TABLE bytes in all
        levels[r.g * share : (r.g + 1) * share] = np.frombuffer(zlib.decompress(r.levels), np.uint8)
    taken = np.cumsum(np.bincount(levels, minlength=256)[:0:-1])[::-1]  # places of level 1 and more, 2 and more, ...
    low = 1 + int((taken > len(levels) * 0.4).sum())
    levels[levels < low] = 0
    return levels


def rarest_first(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set in the global order: by level, then by hash."""
    return s[np.argsort(levels[(s >> np.uint64(64 - TABLE)).astype(np.int64)], kind="stable")]


def runs_of(token: np.ndarray, cid: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """The lists of tokens in order of size, cut into runs whose neighbours' sizes allow a link.

    Gives the ordered columns, the class that begins each entry's run, and which entries stand for their run: the smallest and the largest
    of those whose sizes are within a factor of 1.2. Whatever can link with a run's entry by size can also link with one of these.
    """
    order = np.lexsort((cid, n, token))
    token, cid, n = token[order], cid[order], n[order].astype(np.int64)
    if not len(token):
        return token, cid, n, cid, np.zeros(0, bool)
    new = np.concatenate([[True], ~((token[1:] == token[:-1]) & (DEN * n[:-1] >= NUM * n[1:]))])
    start = np.flatnonzero(new)
    first = np.repeat(cid[start], np.diff(np.concatenate([start, [len(cid)]])))
    step = np.floor(np.log(n) / np.log(1.2))
    edge = new | np.concatenate([[True], step[1:] != step[:-1]])
    return token, cid, n, first, edge | np.concatenate([edge[1:], [True]])


def candidate_edges(sets: DataFrame, levels, parts: int, bits: int) -> DataFrame:
    """Edges between classes that share a prefix shingle and whose sizes allow a link: a class of a run is tied to the run's first.

    A task ties the runs that it sees itself and deals only the entries that stand for them, so that a shingle in very many classes
    sends a few entries a task; a list of m classes makes less than 2 m edges.
    """
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_by, slot = levels.value, 0
        for batch in slices(batches, "shingles", 8 << 20):
            seen, heads = set(), []
            for cid, s in zip(batch.column("cid").to_pylist(), sets_of(batch)):
                if len(s) and cid not in seen:
                    seen.add(cid)
                    head = rarest_first(s, order_by)[: prefix_size(len(s))]
                    heads.append((head, np.full(len(head), cid, np.int64), np.full(len(head), len(s), np.int32)))
            if not heads:
                continue
            token, cid, n, first, stands = runs_of(*(np.concatenate(x) for x in zip(*heads)))
            edges = np.unique(np.stack([first, cid])[:, first != cid], axis=1)
            token, cid, n = token[stands], cid[stands], n[stands].astype("<i4")
            group = (token >> np.uint64(64 - bits)).astype(np.int64)  # rises with the token
            key = ((token >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1
            rows = [(int(group[a]), *(x[a:b].tobytes() for x in (key, cid, n))) for a, b in zip([0, *ends], ends)]
            if edges.shape[1]:
                slot += 1
                rows.append((-slot, edges[0].tobytes(), edges[1].tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["g", "token", "cid", "n"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (g,), rows in by_key(batches, "g"):
            if g < 0:
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in ("token", "cid")], ["a", "b"])
                continue
            token, cid, n = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("token", "<u4"), ("cid", np.int64), ("n", "<i4")))
            _, cid, _, first, _ = runs_of(token, cid, n)
            edges = np.unique(np.stack([first, cid])[:, first != cid], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])

    dealt = sets.select("cid", "shingles").mapInArrow(emit, "g int, token binary, cid binary, n binary").repartition(parts, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(pair, "a long, b long")


def class_bitmap(nodes: DataFrame, bits: int, parts: int = 64) -> np.ndarray:
    """A bit for each hash of the classes in `nodes` (column node). Tasks' bitmaps are joined by part, so that the driver gets `bits` bits in all."""
    kind = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = mix64(batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(bits)
            np.bitwise_or.at(out, (h >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (h & np.uint64(7)).astype(np.uint8)))
        for k, own in enumerate(np.split(out, parts)):
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": [k], "bits": [zlib.compress(own.tobytes(), 1)]}, kind)

    def join(key: tuple, found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits // 8 // parts, np.uint8)
        for batch in found:
            for own in batch.column("bits"):
                out |= np.frombuffer(zlib.decompress(own.as_py()), np.uint8)
        yield pa.RecordBatch.from_pydict({"part": [key[0].as_py()], "bits": [zlib.compress(out.tobytes(), 1)]}, kind)

    out = np.zeros((parts, bits // 8 // parts), np.uint8)
    for r in nodes.select("node").mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(join, "part int, bits binary").collect():
        out[r.part] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return out.ravel()


class SetIndex:
    """Index lists over the prefix shingles of a group's sets, in blocks of one position each, ordered by size inside."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets)
        names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((flat, count[at], owner))  # rarest first, in each set
        at, starts = at[order], np.cumsum(self.sizes) - self.sizes
        position = np.arange(len(at)) - starts[owner]
        inside = position < prefix_size(self.sizes)[owner]
        self.heads = np.split(at[inside], np.cumsum(prefix_size(self.sizes))[:-1])
        token, place, entry = at[inside], position[inside], owner[inside]
        order = np.lexsort((self.sizes[entry], place, token))
        self.entry = entry[order]
        token, self.place = token[order], place[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (self.place[1:] != self.place[:-1])])
        self.begin = np.flatnonzero(new)
        self.end = np.concatenate([self.begin[1:], [len(token)]])
        self.block_place, self.largest = self.place[self.begin], self.sizes[self.entry[self.end - 1]]
        self.smallest = self.sizes[self.entry[self.begin]]
        self.list = np.searchsorted(token[self.begin], np.arange(len(names) + 1))  # a token's blocks
        self.skipped = self.read = 0

    def probe(self, x: int, places: np.ndarray, slack: int) -> np.ndarray:
        """The sets that meet x in one of the given places of its prefix and could share so much with x that a set up to `slack`
        shingles away from x, on either side, may be similar to them. Blocks whose position or sizes rule that out aren't read."""
        n = int(self.sizes[x])
        token = self.heads[x][places]
        a, b = self.list[token], self.list[token + 1]
        block = np.repeat(a, b - a) + _steps(b - a)
        p = np.repeat(places, b - a)
        # with y of m shingles: shared <= min(n - p, m - q) + slack, and similar to a set of n - slack or more
        most, q = n - p + slack, self.block_place[block]
        fits = lambda m: (DEN + NUM) * np.minimum(most, m - q + slack) >= NUM * (n - slack + m)
        low, high = NUM * (n - slack) / DEN, DEN * (n + slack) / NUM
        # the bound on m - q eases with m, that on n - p with a smaller m: the block's largest and smallest sizes decide
        live = ((DEN + NUM) * (self.largest[block] - q + slack) >= NUM * (n - slack + self.largest[block])) & ((DEN + NUM) * most >= NUM * (n - slack + self.smallest[block])) & (self.largest[block] >= low) & (self.smallest[block] <= high)
        self.read, self.skipped = self.read + int(live.sum()), self.skipped + int((~live).sum())
        block, most, q = block[live], most[live], q[live]
        count = self.end[block] - self.begin[block]
        y = self.entry[np.repeat(self.begin[block], count) + _steps(count)]
        most, q, m = np.repeat(most, count), np.repeat(q, count), self.sizes[y]
        return np.unique(y[fits(m) & (m >= low) & (m <= high)])

    def shared(self, x: int, y: int) -> int:
        return len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))


def _steps(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def spanning_links(sets: list[np.ndarray], index: SetIndex | None = None) -> list[tuple[int, int]]:
    """Links (pairs of places) that span each component of the exact similarity graph over `sets`.

    From a set the search goes on through those linked with it. An anchor probes its whole prefix, with room for sets that differ from
    it by `slack` shingles. A later set within that room takes the anchor's candidates that are still free and probes only the
    shingles of its own prefix that the anchor's hasn't: what it shares with a candidate follows from what the anchor shares with
    that one and from the shingles in which the two differ. A set beyond the room becomes an anchor itself.
    """
    index = index or SetIndex(sets)
    sizes, free = index.sizes, np.ones(len(sets), bool)
    links: list[tuple[int, int]] = []
    for root in range(len(sets)):
        if not free[root]:
            continue
        free[root], todo, anchor = False, [root], None
        while todo:
            x = todo.pop()
            if anchor is None or not anchor.near(x):
                anchor = Anchor(index, x)
            found = anchor.answers(x, free)
            links += [(x, y) for y in found]
            free[found] = False
            todo += found
    return links


class Anchor:
    """A set with its candidates and what it shares with them, from which the answers of highly similar sets are derived."""

    def __init__(self, index: SetIndex, x: int):
        self.index, self.x = index, x
        n = int(index.sizes[x])
        self.slack = n // 50
        found = index.probe(x, np.arange(prefix_size(n)), self.slack)
        self.candidates = found[found != x]
        self.common = np.full(len(self.candidates), -1, np.int64)

    def near(self, x: int) -> bool:
        return max(self.index.sizes[x], self.index.sizes[self.x]) - self.index.shared(self.x, x) <= self.slack

    def answers(self, x: int, free: np.ndarray) -> list[int]:
        """The free sets similar to x, which is the anchor or near it.

        Of a candidate, x holds what the anchor does, without what it has lost and with what it has gained against the anchor;
        only where these bounds leave it open are the differences looked up.
        """
        index, n = self.index, int(self.index.sizes[x])
        mine, theirs = index.sets[x], index.sets[self.x]
        lost, gained = np.setdiff1d(theirs, mine, assume_unique=True), np.setdiff1d(mine, theirs, assume_unique=True)
        at = np.flatnonzero(free[self.candidates])
        for k in at[self.common[at] < 0].tolist():
            self.common[k] = index.shared(self.x, int(self.candidates[k]))
        y, common = self.candidates[at], self.common[at]
        sure = similar(common - len(lost), n, index.sizes[y])
        out = y[sure].tolist()
        for k in np.flatnonzero(~sure & similar(common + len(gained), n, index.sizes[y])).tolist():
            other = index.sets[y[k]]
            if similar(int(common[k]) - _members(lost, other) + _members(gained, other), n, len(other)):
                out.append(int(y[k]))
        if x != self.x:
            own = np.flatnonzero(~np.isin(index.heads[x], index.heads[self.x]))
            fresh = index.probe(x, own, 0)
            fresh = fresh[free[fresh] & ~np.isin(fresh, self.candidates)]
            out += [y for y in fresh.tolist() if y != x and similar(index.shared(x, y), n, int(index.sizes[y]))]
        return out


def _members(some: np.ndarray, s: np.ndarray) -> int:
    return int((s[np.minimum(np.searchsorted(s, some), len(s) - 1)] == some).sum()) if len(some) else 0


def verify(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Exact links (a, b: classes) within each group of `keys`; rows hold cid and shingles."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, group in by_key(batches, *keys):
            sets = {r["cid"]: np.frombuffer(r["shingles"], "<u8") for r in group}
            names = sorted(sets)
            if len(names) > 1:
                out += [(names[a], names[b]) for a, b in spanning_links([sets[c] for c in names])]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    dealt = rows.select(*keys, "cid", "shingles").repartition(parts, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(check, "a long, b long")


def prefix_lists(large: DataFrame, outside: np.ndarray, places: int, levels, parts: int, bits: int) -> DataFrame:
    """A written table of the prefix shingles of the classes in `large`, by candidate group and group of shingles (comp, g): token, cid, n, and out, whether the class may be
    one of those in the bitmap `outside`. Sorted by comp and g in its files."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    marks = large.sparkSession.sparkContext.broadcast(outside)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_by, marked = levels.value, marks.value
        for batch in slices(batches, "shingles", 8 << 20):
            held: dict[int, dict[int, tuple]] = {}
            for comp, cid, s in zip(batch.column("comp").to_pylist(), batch.column("cid").to_pylist(), sets_of(batch)):
                h = int((mix64(np.array([cid], np.int64).view(np.uint64)) % np.uint64(places))[0])
                out = marked[h >> 3] >> (h & 7) & 1
                held.setdefault(comp, {})[cid] = (rarest_first(s, order_by)[: prefix_size(len(s))], len(s), out)
            rows = []
            for comp, own in held.items():
                size = [len(head) for head, *_ in own.values()]
                columns = np.concatenate([head for head, *_ in own.values()]), *(np.repeat(np.array(c, t), size) for c, t in ((list(own), "<i8"), ([n for _, n, _ in own.values()], "<i4"), ([o for *_, o in own.values()], np.uint8)))
                order = np.argsort(columns[0], kind="stable")
                token, cid, n, out = (c[order] for c in columns)
                group = (token >> np.uint64(64 - bits)).astype(np.int64)
                key = ((token >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                ends = (np.flatnonzero(np.diff(group, append=-1)) + 1).tolist()
                rows += [(comp, int(group[a]), *(x[a:b].tobytes() for x in (key, cid, n, out))) for a, b in zip([0, *ends], ends)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["comp", "g", "token", "cid", "n", "out"])

    dealt = large.select("comp", "cid", "shingles").mapInArrow(emit, "comp long, g int, token binary, cid binary, n binary, out binary")
    return materialize(dealt.repartition(parts, "comp", "g").sortWithinPartitions("comp", "g"), "prefix-lists")


def shared_runs(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """cid, n, out of the entries of one group of prefix_lists() whose token has others and one that may be outside, by token and size; and how many entries after
    each have its token and a size that allows a link."""
    token, cid, n, out = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("token", "<u4"), ("cid", "<i8"), ("n", "<i4"), ("out", np.uint8)))
    order = np.lexsort((cid, n, token))
    token, cid, n, out = token[order], cid[order], n[order].astype(np.int64), out[order] > 0
    again = np.concatenate([[False], (token[1:] == token[:-1]) & (cid[1:] == cid[:-1])])  # a class may come from several tasks
    token, cid, n, out = (c[~again] for c in (token, cid, n, out))
    _, run = np.unique(token, return_inverse=True)
    good = (np.bincount(run, out) > 0)[run] & (np.bincount(run) > 1)[run]
    cid, n, out, run = (c[good] for c in (cid, n, out, run))
    after = np.searchsorted((run << 33) + n, (run << 33) + n * DEN // NUM, side="right") - 1 - np.arange(len(n))
    return cid, n, out, after


def pair_counts(lists: DataFrame) -> DataFrame:
    """comp, pairs: at most how many rows near_pairs() has before they are put together."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (comp, _), rows in by_key(batches, "comp", "g"):
            yield pa.RecordBatch.from_arrays([pa.array([comp], pa.int64()), pa.array([int(shared_runs(rows)[3].sum())], pa.int64())], ["comp", "pairs"])

    return lists.repartition(F.col("comp"), F.col("g")).sortWithinPartitions("comp", "g").mapInArrow(count, "comp long, pairs long").groupBy("comp").agg(F.sum("pairs").alias("pairs"))


def near_pairs(lists: DataFrame, chunk: int = 1 << 18) -> DataFrame:
    """a, b (a < b), c: the pairs of classes, one of them outside, that share c prefix shingles, as many as similar ones of their sizes must.

    Of what one of two similar classes has in its prefix the other lacks no more than n - t shingles, where t is what they must share in all; the rest lies in the other's
    prefix too, for the one whose prefix ends first.
    """
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_key(batches, "comp", "g"):
            cid, n, out, after = shared_runs(rows)
            at = 0
            total = np.cumsum(after)
            while at < len(cid):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + chunk, side="right")))
                i = np.repeat(np.arange(at, end), after[at:end])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[at:end]) - after[at:end], after[at:end])
                some = out[i] | out[j]
                i, j = i[some], j[some]
                low = cid[i] < cid[j]
                i, j = np.where(low, i, j), np.where(low, j, i)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cid[i], cid[j], n[i], n[j])], ["a", "b", "na", "nb"])
                at = end

    dealt = lists.repartition(F.col("comp"), F.col("g")).sortWithinPartitions("comp", "g").mapInArrow(pair, "a long, b long, na long, nb long")
    counted = dealt.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    whole = F.ceil(NUM * (F.col("na") + F.col("nb")) / (NUM + DEN))
    return counted.where(F.col("c") >= whole + 1 - F.ceil(NUM * F.greatest("na", "nb") / DEN)).select("a", "b", "c")


def links_of_pairs(pairs: DataFrame, links: DataFrame, labels: DataFrame, picked: DataFrame, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that span with `links` what the similar ones of the written `pairs` do, and the tables that only they need. Of two components (`labels`) the pair that shares
    most is compared first; then what is still apart."""
    def apart(labels: DataFrame) -> DataFrame:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"l{c}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        la, lb = F.coalesce("la", "a"), F.coalesce("lb", "b")
        return both.select("a", "b", "c", F.least(la, lb).alias("la"), F.greatest(la, lb).alias("lb")).where("la != lb")

    def compared(some: DataFrame) -> DataFrame:
        sides = some.select("a", "b", F.explode(F.array("a", "b")).alias("cid"))
        return materialize(verify(picked.select("cid", "shingles").join(sides, "cid"), parts, "a", "b"), "pair-links")

    best = apart(labels).groupBy("la", "lb").agg(F.max_by(F.struct("a", "b"), "c").alias("p")).select("p.a", "p.b")
    first = compared(best)
    now = materialize(connected_components(links.unionByName(first), "labels"), "pair-labels")
    second = compared(apart(now))
    return first.unionByName(second), [first, now, second]


def class_links(sets: DataFrame, block: int, leaders: int, room: int = 1 << 20) -> tuple[DataFrame, list[DataFrame]]:
    """Links (a, b) that span the components of all classes of the written table `sets`, and the written tables that only they need.

    A candidate group of at most `block` classes and `room` shingles is compared in one task. A larger one is cut into blocks, each compared
    together with a few leaders of the group; classes that are then outside the group's largest component are compared with all its blocks.
    Where that sends the group's sets more than TIMES times, they are compared with those classes alone that share enough prefix shingles with them, if that takes fewer
    bytes: in a group that chance has linked nearly all classes are outside.
    """
    spark = sets.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = group_bits(sets.agg(F.sum("n")).first()[0] or 0)
    levels = spark.sparkContext.broadcast(shingle_levels(sets, parts, bits))
    groups = materialize(connected_components(candidate_edges(sets, levels, parts, bits), "candidates"), "candidate-groups")
    members = groups.select(F.col("node").alias("cid"), "comp").unionByName(groups.select(F.col("comp").alias("cid"), "comp").distinct())
    members = materialize(members, "members")
    discard(groups)
    places = int(min(1 << 27, max(1 << 16, 1 << int(16 * members.count() + 1).bit_length())))
    marks = spark.sparkContext.broadcast(class_bitmap(members.select(F.col("cid").alias("node")), places))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, seen = marks.value, set()
        for batch in batches:
            cid = batch.column("cid").to_numpy()
            h = mix64(cid.view(np.uint64)) % np.uint64(places)
            hit = (marked[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 > 0
            seen = seen if len(seen) < 100_000 else set()
            new = [k for k in np.flatnonzero(hit).tolist() if not (cid[k] in seen or seen.add(cid[k]))]  # copies are sent once
            yield batch.take(pa.array(new, pa.int64()))

    picked = sets.where("n > 0").select("cid", "n", "shingles").mapInArrow(pick, "cid long, n long, shingles binary").join(members.hint("merge"), "cid")
    picked = materialize(picked, "member-sets")  # a class may come from several tasks
    size = picked.select("comp", "cid", "n").distinct().groupBy("comp").agg(F.count(F.lit(1)).alias("m"), F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / room)).cast("int").alias("blocks"), F.sum("n").alias("shingles_in"))
    size = materialize(size, "group-sizes")
    spent = [members, picked, size]
    sized = picked.drop("n").join(size, "comp")
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    large = sized.where("blocks > 1")
    first = sized.withColumn("b", own)
    split = not size.where("blocks > 1").isEmpty()
    if split:
        lead = large.withColumn("h", F.xxhash64("cid", "comp")).where(F.pmod("h", F.greatest(F.lit(1), F.floor(F.col("m") / leaders))) == 0)
        first = first.unionByName(lead.drop("h").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    links = materialize(verify(first, parts, "comp", "b"), "links")
    spent.append(links)
    if split:
        labels = materialize(connected_components(links, "labels"), "block-labels")
        named = members.join(size.where("blocks > 1"), "comp").join(labels.withColumnRenamed("comp", "label"), F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid"))
        main = named.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("comp").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
        rest = materialize(named.join(main, "comp").where(F.col("label") != F.col("main")).select("cid", "comp", "m", "blocks", "shingles_in"), "outside")
        spent += [labels, rest]
        sent = rest.groupBy("comp").agg((2 * F.count(F.lit(1)) * F.first("blocks") / F.first("m")).alias("times"), (8 * F.first("shingles_in")).alias("size"))
        sent = materialize(sent.where(F.col("times") > TIMES), "sent-often")
        spent.append(sent)
        if not sent.isEmpty():
            out = class_bitmap(rest.select(F.col("cid").alias("node")), places)
            lists = prefix_lists(large.join(sent.select("comp"), "comp", "left_semi"), out, places, levels, parts, bits)
            fewer = materialize(pair_counts(lists).join(sent, "comp").where(F.col("pairs") * PAIR_BYTES < F.col("times") * F.col("size")).select("comp"), "by-pairs")
            pairs = materialize(near_pairs(lists.join(fewer, "comp", "left_semi")), "near-pairs")
            found, more = links_of_pairs(pairs, links, labels, picked, parts)
            spent += [lists, fewer, pairs, *more]
            links, rest = links.unionByName(found), rest.join(fewer, "comp", "left_anti")
        # as many rest parts as blocks would be for them
        left = rest.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) * F.first("blocks") / F.first("m")).cast("int").alias("rests"))
        theirs = large.join(left, "comp").withColumn("b", own).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
        mine = large.join(rest.select("cid", "comp"), ["cid", "comp"]).join(left, "comp").withColumn("r", F.pmod(F.xxhash64("cid"), F.col("rests")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        links = links.unionByName(verify(theirs.unionByName(mine), parts, "comp", "r", "b"))
    return links, spent


def set_components(docs: DataFrame, block: int = 1000, leaders: int = 32, key: Callable[[np.ndarray], tuple[int, int]] = set_key, **memory: int) -> DataFrame:
    """doc_id, th, n, cid, h2 and comp (the component's key, null without words) for each row of `docs`. `memory`: slice_bytes and cached of `document_sets`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    sets = separate_classes(materialize(document_sets(rows, key, **memory), "shingle-sets"))
    links, spent = class_links(sets, block, leaders)
    found = connected_components(links, "components")
    for t in spent:
        discard(t)
    signed = sets.select("doc_id", "th", "n", "cid", "h2").join(found, F.col("cid") == F.col("node"), "left")
    out = materialize(signed.withColumn("comp", F.when(F.col("n") > 0, F.coalesce("comp", "cid"))).drop("node"), "components-by-row")
    discard(sets)
    return out


def jaccard_classes(docs: DataFrame, block: int = 1000, leaders: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of `docs`: links over all documents, exactly.

    Repeated rows each give a row, and an id with several texts one for each; a row with a null id is never the smallest of its
    component, and links like any other. Null and empty texts and texts without words have no shingle and their own id as component.
    Texts of any length give their whole set, which one task holds.
    """
    found = set_components(docs, block, leaders)
    least = found.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = found.join(least, "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, **memory: int) -> DataFrame:
    """`docs` with one row of each component: that of the smallest id (null last), then of the smallest text hash; of repeated rows
    (same id and text) one stays. Rows without words all stay. `memory`: slice_bytes and cached of `document_sets`."""
    rows = set_components(docs, **memory).where("comp is not null").groupBy("comp", "doc_id", "th").agg(F.count(F.lit(1)).alias("copies"))
    rows = materialize(rows, "near-copies")
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("best"))
    marked = rows.join(best, "comp").withColumn("stays", F.struct(F.col("doc_id").isNull(), "doc_id", "th").eqNullSafe(F.col("best")))
    same = lambda d, m: d["doc_id"].cast("long").eqNullSafe(m["__id"]) & (F.xxhash64(d["text"]) == m["__th"])
    keys = lambda m: m.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    goes, many = keys(marked.where("not stays or copies > 1")), keys(marked.where("stays and copies > 1"))
    left = docs.join(goes.hint("merge"), same(docs, goes), "left_anti")
    again = docs.join(many, same(docs, many)).dropDuplicates(["__id", "__th"]).select(docs.columns)
    return left.unionByName(again)
