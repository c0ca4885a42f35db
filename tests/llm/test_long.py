"""Very long texts, whole: many words, one word without a space, equal lines, distinct words."""

import zlib

import numpy as np
import pytest

LONG = [(1, "alpha beta " * 120_000), (2, "q" * 200_000), (3, " ".join(f"w{k}" for k in range(60_000))), (4, "an equal line of ten words stands here again and again\n" * 20_000), (5, "short text"), (6, " ".join(f"w{k}" for k in range(60_000)) + " one more")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(LONG, "doc_id long, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_tokens_and_packing(docs):
    from prismar.llm import packing, tokens
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in LONG}
    assert {i: r.n_tokens for i, r in by_id(tokens.count_tokens(docs)).items()} == {i: len(x) for i, x in ids.items()}
    pieces = {}
    for r in packing.pack(docs).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, x in ids.items():
        x = [*x, 1]
        own = sorted(pieces[i])
        assert [s for s, *_ in own] == [0, *np.cumsum([n for _, n, *_ in own])[:-1].tolist()] and sum(n for _, n, *_ in own) == own[0][3] == len(x)
        assert all(crc == zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) for s, n, crc, _ in own)


def test_decontamination(spark, docs):
    from prismar.llm import decontam

    bench = spark.createDataFrame([(1, "alpha beta"), (2, " ".join(f"w{k}" for k in range(50_000, 50_020))), (3, "q" * 200_000)], "item_id long, text string")
    got = by_id(decontam.find_hits(docs, bench))
    assert {i: r.n_hit for i, r in got.items()} == {1: 240_000, 2: 1, 3: 20, 4: 0, 5: 0, 6: 20} and got[6]["items"] == [2]


def test_near_copies_and_lines(docs):
    from prismar.llm import jaccard, linededup

    got = by_id(jaccard.jaccard_classes(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {1: (2, 1), 2: (1, 2), 3: (59_996, 3), 4: (11, 4), 5: (1, 5), 6: (59_998, 3)}
    lines = by_id(linededup.dedup_lines(docs))
    assert all(lines[i].text == t for i, t in LONG)


def test_scores_of_whole_texts(spark, docs):
    from prismar.llm import katz, quality, toxicity

    got = by_id(katz.katz_scores(docs))
    assert {i: r.n_tokens for i, r in got.items()} == {1: 240_001, 2: 2, 3: 60_001, 4: 220_001, 5: 3, 6: 60_003} and all(np.isfinite(r.score) for r in got.values())
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in LONG], "doc_id long, quality int, toxic int")
    for scored in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        assert len(by_id(scored)) == len(LONG) and all(0 <= r.score <= 1 for r in scored.collect())


def test_search_and_pieces(spark, docs):
    import sentencepiece
    from prismar.llm import lexical, pieces

    bench = spark.createDataFrame([(1, "alpha"), (2, "w59999 more")], "item_id long, text string")
    assert [(r.item_id, r["rank"], r.doc_id) for r in sorted(lexical.search(docs, bench).collect())] == [(1, 1, 1), (2, 1, 6), (2, 2, 3)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert {i: list(r.ids) for i, r in by_id(pieces.encode(docs, end=False)).items()} == {i: library.encode(t) for i, t in LONG}
