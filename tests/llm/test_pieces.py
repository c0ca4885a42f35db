"""Operator 11 against the library on odd texts, random ones and whole tables."""

import hashlib
import random

import pytest

ODD = [None, "", " ", "a  b ", "\ta\n", "▁x▁▁y", "日本語 😀 é\u0000z", " " * 57, "a" * 1000, "\n\n\nab\n c", "<s></s><unk><0x41>", "ab" * 5000, "x​　y", " " * 37 + "word" + " " * 18, "word " * 20_000, "q" * 200_000]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from prismar.llm import pieces

    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_equal_the_library(spark, library):
    from prismar.llm import pieces
    from pyspark.sql import functions as F

    rows = [(k // 2 or None, t) for k, t in enumerate(ODD)] + [(5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "decoded", "n_tokens", "length")})
    want = []
    for i, t in rows:
        ids = [*library.encode(t or ""), library.eos_id()]
        want.append((i or 0, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest(docs).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.digest(docs.where("false")).collect() == []
    trips = [(r.doc_id or 0, list(r.ids), r.decoded) for r in pieces.round_trip(docs).collect()]
    whole = [(i or 0, [*library.encode(t or ""), library.eos_id()]) for i, t in rows]
    assert sorted(trips) == sorted((i, ids, library.decode(ids)) for i, ids in whole)


def test_encode_and_decode_apart(spark, library):
    from prismar.llm import pieces

    docs = spark.createDataFrame([(1, "one two  three\nfour"), (2, None)], "doc_id long, text string")
    ids = {r.doc_id: list(r.ids) for r in pieces.encode(docs, end=False).collect()}
    assert ids == {1: library.encode("one two  three\nfour"), 2: []}
    assert {r.doc_id: r.decoded for r in pieces.decode(pieces.encode(docs)).collect()} == {1: "one two  three\nfour", 2: ""}


def test_random_texts(library):
    from prismar.llm import pieces

    own, rnd, letters = pieces.encoder(pieces.model_path()), random.Random(7), "aabcdeé ▁\n日🙂thin.  ing"
    for _ in range(4000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))
        assert own.encode(text) == library.encode(text), text


def test_each_prefix_ends_in_the_last_piece_of_its_own_encoding(library):
    from prismar.llm import pieces

    own = pieces.encoder(pieces.model_path())
    text = own.model.normalize("unbelievable   thththing")
    table = own.prefix_table(text)
    for n in range(1, len(text) + 1):
        assert own.text[table[n]] == own.merged(text[:n])[-1]


def test_cuts_and_caches_change_nothing(library):
    from prismar.llm import pieces

    own = pieces.PrefixEncoder(pieces.model_path(), limit=2, longest=3)
    for text in ["a, b, c. d\ne  f " * 9, "thing, thing. Thing"]:
        assert own.encode(text) == library.encode(text)
        own.inside = {text[k : k + 2] for k in range(len(text))} | own.inside  # no cuts inside a chunk
        assert own.encode(text) == library.encode(text)


def test_words_are_chunks_of_their_own(library):
    from prismar.llm import pieces

    own = pieces.encoder(pieces.model_path())
    assert own.chunks("▁that.\n▁▁Then,x▁é.a▁b1,▁▁") == ["▁that", ".\n", "▁▁Then", ",", "x", "▁é.a", "▁b1,", "▁▁"]
    letters = "abzABZ"
    marks = [chr(c) for c in range(1, 128) if not chr(c).isalnum() and own.chunks("▁a" + chr(c)) != ["▁a" + chr(c)]]
    assert len(marks) > 20 and not any(x + m in p or m + x in p for p in own.rank for m in marks for x in letters)
    for text in ["that.\n Then,x é.a b1, ", "a\tb\x00c.d\n", "(one)[two]{three}'s don't x=1;y_2 U.S. 3.5% é-é", *(f"{a}{m}{a}{m}{m} {m}{a}\n" for m in marks for a in ("a", "Thing"))]:
        assert own.encode(text) == library.encode(text), text
