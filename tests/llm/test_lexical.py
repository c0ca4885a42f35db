"""Operator 13 against brute force: nulls, empty and repeated rows, ties, clashing columns, long texts, blocks, few terms and many."""

import collections
import math
import random
import re

import pyarrow as pa
import pytest

rnd = random.Random(3)
WORDS = ["w%d" % int(300 * rnd.random() ** 3) for _ in range(20_000)]
ROWS = [(1, "Alpha beta GAMMA"), (2, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (3, None), (4, ""), (5, "... !"), (None, "alpha"), (None, "alpha beta"), (7, "épsilon Épsilon alpha"), (8, "x " * 30_000 + "rare"), (9, "rare"), (10, "rare"), (11, "q" * 100_000)]
ROWS += [(100 + k, " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 60)))) for k in range(400)]
ITEMS = [(1, "alpha beta"), (2, "rare, RARE"), (3, None), (4, ""), (5, "nothing here at_all zzz"), (6, "Épsilon"), (7, "alpha"), (7, "rare"), (None, "alpha"), *((20 + k, " ".join(rnd.choice(WORDS) for _ in range(12))) for k in range(20))]


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k):
    docs = [(i, collections.Counter(terms(t))) for i, t in rows if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    queries, out = collections.defaultdict(set), []
    for i, t in items:
        if i is not None:
            queries[i] |= set(terms(t))
    for item, own in queries.items():
        found = []
        for i, c in docs:
            m, score = 50 + (50 * sum(c.values()) * n) // total, 0
            for t in own & c.keys():
                df = sum(t in d for _, d in docs)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if lost else i, -s) for r, (s, lost, i) in enumerate(sorted(found)[:k])]
    return out


def key(r):
    return tuple(-1 if x is None else x for x in r)


@pytest.mark.parametrize(("k", "block"), [(50, 8 << 20), (3, 8 << 20), (5, 300)])
def test_search(spark, k, block):
    from prismar.llm import lexical
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "slots", "score", "rank", "item_id")}).repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "term")})
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, bench, k=k, block_bytes=block).collect()]
    assert sorted(map(key, got)) == sorted(map(key, brute(ROWS, ITEMS, k)))


def test_empty_tables(spark):
    from prismar.llm import lexical

    docs, bench = spark.createDataFrame(ROWS[:3], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.where("false"), bench).collect() == []
    assert lexical.search(docs, bench.where("false")).collect() == []


def test_bounds_hold_and_spare_rescoring(spark):
    from prismar.llm import lexical

    items = [(1, "w1 w2 w250"), (2, "w290 w17")]
    vocabulary = {w: n for n, w in enumerate(sorted({w.encode() for _, t in items for w in t.split()}))}
    index = lexical.build_index(spark.createDataFrame(ROWS[13:], "doc_id long, text string").repartition(1), vocabulary).toArrow().combine_chunks().to_batches()[0]
    queries = [(np_array([vocabulary[w] for w in sorted(t.encode().split())]), np_array([lexical.WordHashes()[w] % lexical.WIDTH for w in sorted(t.encode().split())]), np_array([9.0] * len(t.split()), float)) for _, t in items]
    total = sum(index.column("n").to_pylist())
    one = lexical.Searcher(queries, len(vocabulary), index.num_rows, total, 5, [0, 0])
    every = lexical.Searcher(queries, len(vocabulary), index.num_rows, total, index.num_rows, [0, 0])
    for s in (one, every):
        s.tile(index)
    assert one.rescored < one.pairs / 2
    for a, b in zip(one.best, every.best):
        assert a.id.tolist() == b.id[:5].tolist() and a.score.tolist() == b.score[:5].tolist()


def np_array(values, kind="int64"):
    import numpy as np

    return np.array(values, kind)


def test_levels_never_lie_below_a_count():
    import numpy as np
    from prismar.llm import lexical

    counts = np.array([1, 2, 64, 65, 79, 80, 81, 1000, 10**7, int(lexical.LEVELS[-1])])
    level = np.searchsorted(lexical.LEVELS, counts)
    assert (lexical.LEVELS[level] >= counts).all() and level.max() < 127 and len(lexical.LEVELS) < 127
    assert pa.array([len(lexical.LEVELS)], pa.int8())  # what stands for any larger count
