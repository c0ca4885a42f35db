"""Candidate groups of the Jaccard join that chance has linked: many classes, few of them similar."""

import random

import numpy as np


def linked_by_chance(n=200):
    """Texts of five passages; each passage is in two texts, so that all are one candidate group and none are similar. Every tenth has near copies."""
    rnd, word = random.Random(6), iter(range(10**9))
    ends = [i for i in range(n) for _ in range(5)]
    rnd.shuffle(ends)
    parts = [[] for _ in range(n)]
    for a, b in zip(ends[::2], ends[1::2]):
        passage = [f"w{next(word)}" for _ in range(30)]
        parts[a].append(passage)
        parts[b].append(passage)
    texts = [[w for p in own for w in p] for own in parts]
    for i in range(0, n, 10):
        for _ in range(12 if i == 50 else 2):
            copy = list(texts[i])
            copy[rnd.randrange(len(copy))] = f"w{next(word)}"
            texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_a_group_linked_by_chance_sends_each_set_a_few_times(spark, monkeypatch):
    from prismar.llm import jaccard

    docs = linked_by_chance()
    sets = [jaccard.shingle_sets([t.encode()], jaccard.WordHashes())[0] for _, t in docs]
    comp = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a + 1, len(docs)):
            if jaccard.similar(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b])):
                low = min(comp[a], comp[b])
                comp = [low if c in (comp[a], comp[b]) else c for c in comp]
    sent, plain = [], jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda rows, *a: sent.append(rows.count()) or plain(rows, *a))
    got = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=20, leaders=1).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(comp)) and len(set(comp)) == 200
    assert sum(sent) < 4 * len(docs), sent
