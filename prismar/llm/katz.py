"""Language-model scoring (operator 6): Katz backoff with Good-Turing discounts.

Order two; every word of the training part is a symbol of its own, and unseen words share what the unigrams give up, so that every token
of every text has a probability. The recursion is P(w | v): seen pair -> its discounted count over v's; else weight(v) times P(w); P(w)
of an unseen word -> its share of the unigrams' rest. Tables, all written: word counts; the texts as word ids, with a row id for each
document; pair counts in blocks by history (a frequent history is also dealt by word); histories with their weights.
Of the words, the most frequent (at most `vocab_limit`) are numbered and broadcast; pairs with any other word are dealt by word hash and
counted there in the same way, so the limit decides the way that a pair takes, not its probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import discard, materialize, slices, words_of
from prismar.llm.labelled import fold

END = b" end"  # no word has a space
FOLDS, HELD, CUT, GROUPS = 5, 1, 5, 1024
LIMIT = (1 << 20) - 2
HASHED = 1 << 63  # set in word hashes, never in ids
CODED = "first long, doc_id binary, no_id binary, held binary, lengths binary, ids binary, far binary"
DEALT = pa.schema([("g", pa.int32()), ("kind", pa.int32()), ("first", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
NAMES = [*(f"f{r}" for r in range(1, CUT + 2)), "big", "mass"]


def split_rows(docs: DataFrame) -> DataFrame:
    held = F.coalesce(fold("doc_id", FOLDS) == HELD, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).withColumn("held_out", held)


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) | HASHED


def unigrams(train: DataFrame) -> DataFrame:
    """h (word hash), c: counts of all training tokens, added up in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            h = np.fromiter(map(word_hash, seen), np.uint64, len(seen))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(list(seen.values()), pa.int64())], ["h", "c"])

        for batch in slices(batches, "text"):
            seen[END] += batch.num_rows
            for t in batch.column("text"):
                seen.update(words_of(t.as_py()))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    return train.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def discounts(coc: dict[int, int]) -> np.ndarray:
    """Good-Turing ratios d_1..d_CUT from counts of counts (Katz 1987); 1 beyond, half a count off where they don't hold."""
    out = np.ones(CUT + 2)
    n1, tail = coc.get(1, 0), (CUT + 1) * coc.get(CUT + 1, 0)
    for r in range(1, CUT + 1):
        n, more = coc.get(r, 0), coc.get(r + 1, 0)
        d = ((r + 1) * more / (r * n) - tail / n1) / (1 - tail / n1) if n and n1 and tail < n1 else -1
        out[r] = d if 0 < d <= 1 else 1 - 0.5 / r
    return out


class Vocabulary:
    """Sorted hashes and counts of the listed words; the id of any other word is `rare`."""

    def __init__(self, h: np.ndarray, c: np.ndarray, d: np.ndarray, total: int):
        order = np.argsort(h)
        self.h, self.c, self.total = h[order], c[order], total
        self.rare = len(h)
        self.start = self.rare + 1
        self.log_p = np.log10(np.concatenate([self.c * d[np.minimum(self.c, CUT + 1)] / total, [1.0]]))


class WordCodes:
    """word -> its id, or its hash where it has none; remembered for the words seen lately."""

    def __init__(self, listed: np.ndarray):
        self.listed, self.known = listed, {}

    def codes(self, words: list[list[bytes]], total: int) -> np.ndarray:
        if len(self.known) > 200_000:
            self.known = {}
        new = list(set(chain.from_iterable(words)).difference(self.known))
        code = np.fromiter(map(word_hash, new), np.uint64, len(new))
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, code), len(self.listed) - 1)
            code = np.where(self.listed[at] == code, at.astype(np.uint64), code)
        self.known.update(zip(new, code.tolist()))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.uint64, total)


def coded_texts(rows: DataFrame, listed, rare: int) -> DataFrame:
    """Slices of texts: row id of the first, the documents' ids and folds, their lengths, all tokens' ids, the hashes of those without."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, first = WordCodes(listed.value), TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 2 << 20):
            for k in range(0, batch.num_rows, 65_536):
                part = batch.slice(k, 65_536)
                words = [[*words_of(t.as_py()), END] for t in part.column("text")]
                lengths = np.fromiter(map(len, words), "<u4", len(words))
                code = codes.codes(words, int(lengths.sum()))
                far = code >= HASHED
                ids = np.where(far, rare, code).astype("<u4")
                no_id = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                own = np.array(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), "<i8")
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array([first]), *(pa.array([x.tobytes()], pa.binary()) for x in (own, no_id, held, lengths, ids, code[far].astype("<u8")))], ["first", "doc_id", "no_id", "held", "lengths", "ids", "far"])
                first += len(words)

    return rows.mapInArrow(emit, CODED)


class Slice:
    """A row of the coded texts as arrays: documents, histories v and words w of all tokens."""

    def __init__(self, row: dict, start: int):
        self.first = row["first"]
        self.held, self.lengths = np.frombuffer(row["held"], bool), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.w = np.frombuffer(row["ids"], "<u4").astype(np.int64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.v = self.shifted(self.w, start)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def shifted(self, x: np.ndarray, before) -> np.ndarray:
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.begin] = before
        return out


def slices_of(batches: Iterator[pa.RecordBatch], start: int) -> Iterator[tuple[dict, Slice]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
            yield row, Slice(row, start)


class Dealer:
    """The group of a pair, and its 32-bit key there: history / GROUPS above the 20 bits of the word."""

    def __init__(self, vocabulary: Vocabulary, salts: int, starts: int):
        counts = np.concatenate([vocabulary.c, [0, starts]])
        self.spread = np.maximum(salts, np.ceil(counts * 2.0 * GROUPS / max(1, vocabulary.total))).astype(np.int64)

    def groups(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return v % GROUPS + GROUPS * (((w * 2654435761) >> 7) % self.spread[v])


def narrow(counts: np.ndarray) -> bytes:
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def widened(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) == n else "<u4").astype(np.int64)


def pair_counts(coded: DataFrame, vocabulary, dealer, parts: int) -> DataFrame:
    """g, keys, counts: the pairs of the training part with their counts, a sorted block for each group."""
    start, rare = vocabulary.value.start, vocabulary.value.rare

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in slices_of(batches, start):
            keep = ~s.held[s.doc] & (s.v != rare) & (s.w != rare)
            v, w = s.v[keep], s.w[keep]
            key = np.sort((dealer.value.groups(v, w) << 31) | ((v // GROUPS) << 20) | w)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, count = key[begin], np.diff(np.concatenate([begin, [len(key)]]))
            ends = np.flatnonzero(np.diff(key >> 31, append=-1)) + 1 if len(key) else []
            rows = [(int(key[a] >> 31), (key[a:b] & 0x7FFFFFFF).astype("<u4").tobytes(), narrow(count[a:b])) for a, b in zip([0, *ends], ends)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["g", "keys", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(g: int, found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            keys = [np.frombuffer(k, "<u4") for k, _ in found]
            counts = np.concatenate([widened(c, len(k)) for k, (_, c) in zip(keys, found)])
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, weights=counts).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([key.tobytes()], pa.binary()), pa.array([narrow(total)], pa.binary())], ["g", "keys", "counts"])

        now, found = None, []
        for batch in batches:
            for g, k, c in zip(*(batch.column(n) for n in ("g", "keys", "counts"))):
                if g.as_py() != now and found:
                    yield block(now, found)
                    found = []
                now = g.as_py()
                found.append((k.as_py(), c.as_py()))
        if found:
            yield block(now, found)

    kinds = "g int, keys binary, counts binary"
    read = coded.select("first", "held", "lengths", "ids")
    return read.mapInArrow(emit, kinds).repartition(parts, "g").sortWithinPartitions("g").mapInArrow(gather, kinds)


def steps(rising: np.ndarray) -> bytes:
    """Rising numbers below 65,536 by their differences, in a byte each where that will do."""
    d = np.diff(rising, prepend=0)
    return d.astype("u1" if d.max(initial=0) < 256 else "<u2").tobytes()


def summed_up(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "u1" if len(raw) == n else "<u2"), dtype=np.int64)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """v, w and count of the pairs of each block."""
    for batch in batches:
        for g, k, c in zip(*(batch.column(n) for n in ("g", "keys", "counts"))):
            key = np.frombuffer(k.as_py(), "<u4").astype(np.int64)
            yield (key >> 20) * GROUPS + g.as_py() % GROUPS, key & 0xFFFFF, widened(c.as_py(), len(key))


def history_sums(pairs: DataFrame, vocabulary) -> DataFrame:
    """v, followers with counts 1..CUT+1 (f1..), the counts above CUT added up (big), and the lower-order mass of all followers (mass)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p1 = 10.0 ** vocabulary.value.log_p
        for v, w, c in blocks_of(batches):
            v, at = np.unique(v, return_inverse=True)
            cols = [*(np.bincount(at, weights=c == r) for r in range(1, CUT + 2)), np.bincount(at, weights=np.where(c > CUT, c, 0)), np.bincount(at, weights=p1[w])]
            yield pa.RecordBatch.from_arrays([pa.array(v), *(pa.array(x.astype(float)) for x in cols)], ["v", *NAMES])

    found = pairs.mapInArrow(add, "v long, " + ", ".join(f"{n} double" for n in NAMES))
    return found.groupBy("v").agg(*(F.sum(n).alias(n) for n in NAMES))


def frequent_pairs(pairs: DataFrame, least: int) -> DataFrame:
    """v, w, c of the pairs counted `least` times or more."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, w, c in blocks_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x[c >= least]) for x in (v, w, c)], ["v", "w", "c"])

    return pairs.mapInArrow(pick, "v long, w long, c long")


def far_pairs(coded: DataFrame, vocabulary) -> DataFrame:
    """row, held, v, w (ids), hv, hw (hashes, 0 for words with an id): the pairs with a word outside the broadcast vocabulary."""
    rare, start = vocabulary.value.rare, vocabulary.value.start

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, s in slices_of(batches, start):
            hw = np.zeros(len(s.w), np.int64)
            hw[s.w == rare] = np.frombuffer(row["far"], "<i8")
            hv = s.shifted(hw, 0)
            at = np.flatnonzero((s.v == rare) | (s.w == rare))
            doc = s.doc[at]
            yield pa.RecordBatch.from_arrays([pa.array(s.first + doc), pa.array(s.held[doc]), *(pa.array(x[at]) for x in (s.v, s.w, hv, hw))], ["row", "held", "v", "w", "hv", "hw"])

    return coded.select("first", "held", "lengths", "ids", "far").mapInArrow(emit, "row long, held boolean, v long, w long, hv long, hw long")


def listed_scores(coded: DataFrame, pairs: DataFrame, vocabulary, dealer, tables, parts: int) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base_score, score over the pairs of listed words.

    The most frequent pairs are scored where the text is, from a broadcast table; the others are dealt to their groups, scored by the
    group's block of pair counts, and summed by document there.
    """
    start, rare = vocabulary.value.start, vocabulary.value.rare
    total, types = tables.value["total"], tables.value["types"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, deal = tables.value, dealer.value
        base = np.concatenate([np.log10((vocabulary.value.c + 0.5) / (total + 0.5 * (types + 1))), [0.0]])
        for row, s in slices_of(batches, start):
            n = len(s.lengths)
            score = np.zeros(n)
            near = np.flatnonzero((s.v != rare) & (s.w != rare))
            v, w, doc = s.v[near], s.w[near], s.doc[near]
            if len(own["hot"]):
                pair = (v << 20) | w
                at = np.minimum(np.searchsorted(own["hot"], pair), len(own["hot"]) - 1)
                hot = own["hot"][at] == pair
                score += np.bincount(doc[hot], weights=own["hot_score"][at[hot]], minlength=n)
                v, w, doc = v[~hot], w[~hot], doc[~hot]
            group = deal.groups(v, w)
            order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 65_536 else group, kind="stable")
            group, key, doc = group[order], (((v // GROUPS) << 20) | w)[order].astype("<u4"), doc[order]
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1 if len(group) else []
            out = [(int(group[a]), 1, s.first, key[a:b].tobytes(), steps(doc[a:b]), None) for a, b in zip([0, *ends], ends)]
            known = np.bincount(s.doc, weights=s.w != rare, minlength=n)
            numbers = np.stack([s.lengths.astype(float), known, np.bincount(s.doc, weights=base[s.w], minlength=n), s.held.astype(float), score])
            out.append((-1 - (s.first & 0x3FF), 0, s.first, row["doc_id"], numbers.astype("<f8").tobytes(), row["no_id"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), DEALT)], schema=DEALT)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_p = tables.value, vocabulary.value.log_p
        sums: dict[int, np.ndarray] = {}
        now, held = None, 0
        key = known = np.zeros(0)
        for batch in batches:
            heads = []
            for g, kind, first, a, b, c in zip(*(batch.column(f.name).to_pylist() for f in DEALT)):
                if g < 0:
                    heads.append((0, 0, first, a, b, c))
                    continue
                if g != now:
                    now, key, known = g, np.zeros(0, np.int64), np.zeros(0)
                if not kind:
                    key = np.frombuffer(a, "<u4").astype(np.int64)
                    count, v = widened(b, len(key)), (key >> 20) * GROUPS + g % GROUPS
                    known = np.log10(count * own["d2"][np.minimum(count, CUT + 1)]) + own["log_n"][v]
                    continue
                k = np.frombuffer(a, "<u4").astype(np.int64)
                doc = summed_up(b, len(k))
                part = own["log_weight"][(k >> 20) * GROUPS + g % GROUPS] + log_p[k & 0xFFFFF]
                if len(key):
                    at = np.minimum(np.searchsorted(key, k), len(key) - 1)
                    part = np.where(key[at] == k, known[at], part)
                part = np.bincount(doc, weights=part)
                old = sums.get(first)
                if old is not None and len(old) >= len(part):
                    old[: len(part)] += part
                else:
                    if old is not None:
                        part[: len(old)] += old
                    held += len(part) - (0 if old is None else len(old))
                    sums[first] = part
            if heads or held > 2_000_000:
                yield _dealt([*heads, *((0, 1, f, None, s.astype("<f8").tobytes(), None) for f, s in (sums.items() if held > 2_000_000 else ()))])
                if held > 2_000_000:
                    sums, held = {}, 0
        yield _dealt([(0, 1, f, None, s.astype("<f8").tobytes(), None) for f, s in sums.items()])

    final = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(first: int, ids: bytes, numbers: np.ndarray, no_id: bytes) -> pa.RecordBatch:
            ids = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(no_id, bool))
            return pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(ids))), ids, pa.array(numbers[3] > 0), pa.array(numbers[0].astype(np.int64)), pa.array(numbers[1].astype(np.int64)), pa.array(numbers[2]), pa.array(numbers[4])], schema=final)

        head = None
        for batch in batches:
            for kind, first, a, b, c in zip(*(batch.column(n).to_pylist() for n in ("kind", "first", "a", "b", "c"))):
                if not kind:  # comes before its sums
                    if head:
                        yield done(*head)
                    head = (first, a, np.frombuffer(b, "<f8").reshape(5, -1).copy(), c)
                else:
                    more = np.frombuffer(b, "<f8")
                    head[2][4, : len(more)] += more
        if head:
            yield done(*head)

    kinds = "g int, kind int, first long, a binary, b binary, c binary"
    known = pairs.select("g", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("first"), F.col("keys").alias("a"), F.col("counts").alias("b"), F.lit(None).cast("binary").alias("c"))
    dealt = coded.drop("far").mapInArrow(emit, kinds).unionByName(known).repartition(parts, "g").sortWithinPartitions("g", "kind")
    sums = dealt.mapInArrow(evaluate, kinds).repartition(parts, "first").sortWithinPartitions("first", "kind")
    return sums.mapInArrow(finish, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(DEALT), DEALT)], schema=DEALT)


def katz_scores(docs: DataFrame, vocab_limit: int = LIMIT, pairs_per_group: int = 8_000_000, hot_share: float = 2.0**-14) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of `docs`.

    Rows of remainder 1 (crc32 of the id as text, modulo 5) are held out of training. Null and empty texts are their end token; repeated
    rows each give a row; a null id trains; an empty table gives none; other columns are ignored. `vocab_limit` (2^20 - 2 at most)
    bounds the words that are broadcast, and `hot_share` the pairs (1 / hot_share of them at most); neither changes a score. Texts of any
    length are counted and scored whole; a task holds one text at a time.
    """
    spark = docs.sparkSession
    rows = split_rows(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = materialize(unigrams(rows.where("not held_out")), "unigrams")
    # exact counts of counts where they matter; at most 4096 + 256 * 63 rows
    classes = words.groupBy(F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2("c") * 256)).alias("class")).agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), F.sum("c").alias("tokens"))
    sizes = sorted(((r.c, r.n, r.tokens) for r in classes.collect()), reverse=True)
    total, types = sum(t for *_, t in sizes), sum(n for _, n, _ in sizes)
    coc = {c: n for c, n, _ in sizes if c <= CUT + 1}
    least, kept = (sizes[0][2] + 1 if sizes else 1), 0
    for c, n, _ in sizes:
        if kept + n > min(vocab_limit, LIMIT):
            break
        least, kept = c, kept + n
    total_safe = max(total, 1)
    d1 = discounts(coc)
    listed = words.where(F.col("c") >= least).toArrow()
    own = Vocabulary(listed.column("h").to_numpy().view(np.uint64), listed.column("c").to_numpy(), d1, total_safe)
    unseen = max(sum(n * c * (1 - d1[c]) for c, n in coc.items() if c <= CUT) / total_safe if total else 1.0, 1e-12)
    log_unseen = math.log10(unseen / (coc.get(1, 0) + 1))
    vocabulary = spark.sparkContext.broadcast(own)
    dealer = spark.sparkContext.broadcast(Dealer(own, max(1, total // (GROUPS * pairs_per_group)), rows.where("not held_out").count()))
    coded = materialize(coded_texts(rows, spark.sparkContext.broadcast(own.h), own.rare), "coded-texts")
    pairs = materialize(pair_counts(coded, vocabulary, dealer, parts), "pair-counts")
    discard(words)
    far = FarPairs(coded, vocabulary, d1, total_safe, log_unseen, parts)
    sums = history_sums(pairs, vocabulary).unionByName(far.history_sums())
    stats = materialize(sums.groupBy("v").agg(*(F.sum(n).alias(n) for n in NAMES)), "histories")
    more, seen = far.counts_of_counts(), stats.agg(*(F.sum(f"f{r}").alias(f"f{r}") for r in range(1, CUT + 2))).first()
    d2 = discounts({r: int(seen[f"f{r}"] or 0) + more.get(r, 0) for r in range(1, CUT + 2)})
    weights = history_weights(stats, d2).toArrow()  # a row for each listed word at most
    own_tables = {k: np.zeros(own.start + 1) for k in ("log_n", "log_weight")}
    for k, x in own_tables.items():
        x[weights.column("v").to_numpy()] = weights.column(k).to_numpy()
    del weights
    hot = frequent_pairs(pairs, max(1, math.ceil(hot_share * total_safe))).toArrow()  # 1 / hot_share pairs at most
    v, w, c = (hot.column(n).to_numpy() for n in ("v", "w", "c"))
    order = np.argsort((v << 20) | w)
    own_tables |= {"hot": ((v << 20) | w)[order], "hot_score": (np.log10(c * d2[np.minimum(c, CUT + 1)]) + own_tables["log_n"][v])[order], "d2": d2, "total": total, "types": types}
    tables = spark.sparkContext.broadcast(own_tables)
    out = listed_scores(coded, pairs, vocabulary, dealer, tables, parts).join(far.scores(tables), "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more_score")).alias("score"))


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, least: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of a partition ordered by `key`, in pieces that hold all rows of each of their keys."""
    kept: dict[str, np.ndarray] = {}
    for batch in batches:
        new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        kept = {n: np.concatenate([kept[n], x]) for n, x in new.items()} if kept else new
        cut = int(np.searchsorted(kept[key], kept[key][-1])) if len(kept[key]) >= least else 0
        if cut:
            yield {n: x[:cut] for n, x in kept.items()}
            kept = {n: x[cut:] for n, x in kept.items()}
    if kept and len(kept[key]):
        yield kept


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """The number of each row's combination of values."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _counted(pair: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The training count of each row's pair, and which rows stand for a pair that has one."""
    train = np.bincount(pair, weights=~held).astype(np.int64)
    head = np.zeros(len(pair), bool)
    head[np.unique(pair, return_index=True)[1]] = True
    return train[pair], head & (train[pair] > 0)


def word_log_p(count: np.ndarray, d1: np.ndarray, total: int, log_unseen: float) -> np.ndarray:
    """Log-probability of words of these training counts."""
    return np.where(count > 0, np.log10(np.maximum(count, 1) * d1[np.minimum(count, CUT + 1)] / total), log_unseen)


class FarPairs:
    """Pairs with a word outside the broadcast vocabulary, counted where all the rows of such a word meet.

    First all tokens w of the kind meet by word, which gives their counts and those of their pairs; then all pairs after such a word v meet by
    v, with the counts of w. Both results are written; sums, weights and scores are read from them without another join.
    """

    def __init__(self, coded: DataFrame, vocabulary, d1: np.ndarray, total: int, log_unseen: float, parts: int):
        self.d1, self.total = d1, total
        rare = self.rare = vocabulary.value.rare
        far_p = self.log_p = partial(word_log_p, d1=d1, total=total, log_unseen=log_unseen)
        rows = materialize(far_pairs(coded, vocabulary), "far-rows")
        kinds = "row long, held boolean, v long, hv long, hw long, far long, c long, head boolean"

        def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in whole_keys(batches, "hw"):
                word = _numbered(r["hw"])
                far = np.bincount(word, weights=~r["held"]).astype(np.int64)[word]
                c, head = _counted(_numbered(r["v"], r["hv"], word), r["held"])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r["row"], r["held"], r["v"], r["hv"], r["hw"], far, c, head)], ["row", "held", "v", "hv", "hw", "far", "c", "head"])

        words = rows.where(F.col("w") == rare).select("row", "held", "v", "hv", "hw").repartition(parts, "hw").sortWithinPartitions("hw")
        self.words = materialize(words.mapInArrow(by_word, kinds), "far-words")
        names = [*NAMES[:CUT], "n", "mass"]

        def by_history(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            listed = vocabulary.value.log_p
            for r in whole_keys(batches, "hv"):
                v = _numbered(r["hv"])
                c, head = _counted(_numbered(r["w"], r["hw"], v), r["held"])
                low = np.where(r["w"] == rare, far_p(r["far"]), listed[r["w"]])
                sums = [*(np.bincount(v, weights=head & (c == k)) for k in range(1, CUT + 1)), np.bincount(v, weights=~r["held"]), np.bincount(v, weights=np.where(head, 10.0**low, 0))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r["row"], c, head, low, *(x[v] for x in sums))], ["row", "c", "head", "low", *names])

        after = self.words.where(F.col("v") == rare).select("row", "held", F.col("hv"), F.lit(rare).cast("long").alias("w"), "hw", "far")
        more = rows.where((F.col("v") == rare) & (F.col("w") != rare)).select("row", "held", "hv", "w", "hw", F.lit(0).cast("long").alias("far"))
        dealt = after.unionByName(more).repartition(parts, "hv").sortWithinPartitions("hv")
        self.histories = materialize(dealt.mapInArrow(by_history, "row long, c long, head boolean, low double, " + ", ".join(f"{n} double" for n in names)), "far-histories")
        discard(rows)

    def history_sums(self) -> DataFrame:
        """What the pairs of a listed history with such words add to its sums."""
        p = F.element_at(F.array(*(F.lit(float(x)) for x in self.d1[1:])), F.least("far", F.lit(CUT + 1)).cast("int")) * F.col("far") / float(self.total)
        sums = [F.sum((F.col("c") == r).cast("double")).alias(f"f{r}") for r in range(1, CUT + 2)]
        sums += [F.sum(F.when(F.col("c") > CUT, F.col("c").cast("double")).otherwise(0.0)).alias("big"), F.sum(p).alias("mass")]
        return self.words.where(F.col("head") & (F.col("v") != self.rare)).groupBy("v").agg(*sums)

    def counts_of_counts(self) -> dict[int, int]:
        """Of the pairs after a history of this kind."""
        found = self.histories.where(F.col("head") & (F.col("c") <= CUT + 1)).groupBy("c").count().collect()
        return {r.c: r["count"] for r in found}

    def scores(self, tables) -> DataFrame:
        """row, more_base, more_score, more_known: what these pairs add to each document."""
        rare, log_p, kinds = self.rare, self.log_p, "row long, base double, score double, known long"
        total, types = tables.value["total"], tables.value["types"]

        def after_listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = tables.value
            for batch in batches:
                row, v, far, c = (batch.column(n).to_numpy() for n in ("row", "v", "far", "c"))
                v_ = np.where(v == rare, 0, v)
                score = np.where(c > 0, np.log10(np.maximum(c, 1) * own["d2"][np.minimum(c, CUT + 1)]) + own["log_n"][v_], own["log_weight"][v_] + log_p(far))
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.log10((far + 0.5) / (total + 0.5 * (types + 1)))), pa.array(np.where(v == rare, 0.0, score)), pa.array((far > 0).astype(np.int64))], ["row", "base", "score", "known"])

        def after_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d2 = tables.value["d2"]
            for batch in batches:
                c, low, n, mass = (batch.column(x).to_numpy() for x in ("c", "low", "n", "mass"))
                seen = n - sum(k * (1 - d2[k]) * batch.column(f"f{k}").to_numpy() for k in range(1, CUT + 1))
                scale, weight = given_up(n, seen, mass)
                score = np.where(n > 0, np.where(c > 0, np.log10(np.maximum(c, 1) * d2[np.minimum(c, CUT + 1)] * scale / np.maximum(n, 1)), np.log10(weight) + low), low)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.zeros(len(c))), pa.array(score), pa.array(np.zeros(len(c), np.int64))], ["row", "base", "score", "known"])

        both = self.words.select("row", "v", "far", "c").mapInArrow(after_listed, kinds).unionByName(self.histories.drop("head", "held").mapInArrow(after_far, kinds))
        return both.groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("score").alias("more_score"), F.sum("known").alias("more_known"))


def history_weights(stats: DataFrame, d2: np.ndarray) -> DataFrame:
    """v, log_n (what a discounted count is worth), log_weight (of the lower order) of the summed histories."""
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(n).to_numpy() for n in NAMES}
            n = x["big"] + sum(r * x[f"f{r}"] for r in range(1, CUT + 1))
            scale, weight = given_up(n, n - sum(r * (1 - d2[r]) * x[f"f{r}"] for r in range(1, CUT + 1)), x["mass"])
            yield pa.RecordBatch.from_arrays([batch.column("v"), pa.array(np.log10(scale / np.maximum(n, 1))), pa.array(np.log10(weight))], ["v", "log_n", "log_weight"])

    return stats.mapInArrow(weigh, "v long, log_n double, log_weight double")


def given_up(n: np.ndarray, seen: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scale of the discounted counts, and the weight of the lower order, for histories of n tokens whose discounted counts add up to `seen`.

    A history whose counts are all above the cut gives up one count's worth.
    """
    n, seen = np.maximum(n, 1), np.maximum(seen, 1e-9)
    scale = np.where(1 - seen / n > 1e-9, 1.0, n / (n + 1) * n / seen)
    return scale, (1 - scale * seen / n) / np.maximum(1 - mass, 1e-12)
