"""Every dealt operator against brute force on a small fixture, with nulls, empty and repeated rows, ties and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

LONG = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ROWS = [(1, LONG), (2, LONG + " phi"), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "ONE  two"), (8, LONG), (8, LONG), (9, "x " * 3000), (None, LONG),
        (10, "a<|endoftext|>b  c\n\n d"), (11, "first line of this text here\n" + LONG + "\nlast"), (12, LONG.upper() + "\nother words entirely at the end")]
BENCH = [(1, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), (2, None), (3, ""), (4, "one two"), (10, "not there at all")]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({c: F.lit(1) for c in ("rank", "cls", "gone", "n", "score", "start", "g", "n_lines", "rep")}).withColumn("n_chars", F.length("text").cast("long"))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def item_words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_words(t):
    return (t or "").encode().lower().split()


def test_token_counts(docs, none):
    from prismar.llm import tokens
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows(tokens.count_tokens(docs)))
    assert got == sorted((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    assert rows(tokens.count_tokens(none)) == []


@pytest.mark.parametrize("text", ["  a  b\n\n c ", " ", "x y　z\t \tq", "it's we'll  'S 12 3é", "\x1c \x1d a\x85 b", " lead", "trail ", "日本 語 😀 "])
def test_chunks_have_the_library_ids(text):
    from prismar.llm import tokens
    from tokenizers import Tokenizer

    own = tokens.encoder(tokens.tokenizer_path(), list)
    assert [i for p in own.values([text])[0] for i in p] == Tokenizer.from_file(tokens.tokenizer_path()).encode(text, add_special_tokens=False).ids


def test_packing(docs, none):
    from prismar.llm import packing, tokens
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path())
    got = rows(packing.pack(docs, width=64, unit=4))
    want = collections.Counter()
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 64):
            want[i, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()), len(ids)] += 1
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in got) == want
    at = collections.defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    assert rows(packing.pack(none)) == []


def test_cutting_stock_is_near_its_bound():
    from prismar.llm.packing import cutting_stock

    demand = {s: 40 + s % 7 for s in range(1, 65)}
    plan = cutting_stock(demand, 64)
    made = collections.Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            made[s] += n * times
    assert made == demand
    assert sum(t for _, t in plan) <= 1.05 * sum(s * n for s, n in demand.items()) / 64 + 64


@pytest.mark.parametrize("block", [8 << 20, 20])
def test_decontamination(spark, docs, none, block):
    from prismar.llm import decontam

    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in BENCH:
        w = item_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    want = []
    for i, t in ROWS:
        w, hit, items = item_words(t), set(), set()
        for p, own in windows.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items |= own
        sha = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        want.append((i or 0, len(w), len(hit), len(items), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = rows(decontam.digest(decontam.find_hits(docs, bench, block_bytes=block)))
    assert sorted((r["doc_id"] or 0, *(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))) for r in got) == sorted(want)
    assert rows(decontam.find_hits(none, bench)) == []
    texts = [(None, BENCH[0][1]), (None, "clean text"), (1, BENCH[0][1]), (1, "another clean text"), (1, BENCH[0][1]), (2, None)]
    left = rows(decontam.remove_contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench, block_bytes=block))
    assert collections.Counter((r["doc_id"], r["text"]) for r in left) == collections.Counter([(None, "clean text"), (1, "another clean text"), (2, None)])
    assert all(not r["n_hit"] for r in rows(decontam.find_hits(docs, bench.where("false"))))


def test_warc(spark):
    from prismar.llm import warc

    body = "é" * 700
    pages = [(1, "http://a.org/x", body), (2, "http://b.a.org/", body), (3, None, body), (4, "http://a.org/x", "short"), (5, "http://a.org/x", "short"), (6, "", None), (7, "bad\turl [", ""), (1, "http://a.org/x", body), (None, "u", "z")]
    from pyspark.sql import functions as F

    pages += [(k, f"http://long.org/{k}", "long page " * 200_000) for k in (20, 21)]
    odd = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "pid", "refers_to", "key", "file", "at", "size", "n")})
    got = rows(warc.round_trip(odd))
    revisit = lambda i, h: (h == body and i != 3) or i == 20
    want = [(i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if revisit(i, h) else "response", (21 if i == 20 else 3) if revisit(i, h) else 0) for i, _, h in pages]
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in got) == sorted(want)
    assert rows(warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"))) == []
    assert warc.reversed_host_key("http://www.A.org:80/x?y=1") == "org,a,www:80)/x?y=1"


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = plain_words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    return sets, comp


@pytest.mark.parametrize("block", [2000, 3])
def test_jaccard(spark, docs, none, block):
    from prismar.llm import jaccard

    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(80)]
    more = []
    for k in range(20, 50):  # a chain of near copies: neighbours link, ends don't
        base = list(base)
        base[int(rng.integers(80))] = f"v{k}"
        more.append((k, " ".join(base)))
    all_rows = [r for r in ROWS if r[0] is not None] + more
    sets, comp = brute_components(all_rows)
    got = rows(jaccard.jaccard_classes(spark.createDataFrame(all_rows, "doc_id long, text string"), block=block, leaders=1))
    assert len(got) == len(all_rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]])
    assert rows(jaccard.jaccard_classes(none)) == []
    assert {r["component_id"] for r in rows(jaccard.jaccard_classes(docs)) if r["doc_id"] is None} == {1}


def test_spanning_links_cover_the_exact_graph():
    from prismar.llm.jaccard import similar, spanning_links

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(60, int(rng.integers(20, 50)), replace=False).astype(np.uint64)) for _ in range(60)]
    exact = {(a, b) for a in range(60) for b in range(a) if similar(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
    links = spanning_links(sets)
    assert all((max(p), min(p)) in exact for p in links)
    comp = list(range(60))
    for a, b in links:
        comp = [comp[b] if c == comp[a] else c for c in comp]
    assert all(comp[a] == comp[b] for a, b in exact)


def test_answers_derived_from_a_similar_set_are_complete():
    from prismar.llm.jaccard import Anchor, SetIndex, similar

    rng = np.random.default_rng(8)
    base = np.arange(400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 400 - int(k), replace=False), rng.integers(1000, 1400, int(rng.integers(0, 90))).astype(np.uint64)])) for k in rng.integers(0, 60, 50)]
    for k in range(20):  # highly similar ones
        s = sets[k].copy()
        s[rng.integers(0, len(s), 3)] = rng.integers(2000, 2100, 3)
        sets.append(np.unique(s))
    index, derived = SetIndex(sets), 0
    for a in range(len(sets)):
        anchor = Anchor(index, a)
        for x in (x for x in range(len(sets)) if x == a or anchor.near(x)):
            free = np.ones(len(sets), bool)
            free[[a, x]] = False
            want = [y for y in range(len(sets)) if free[y] and similar(len(np.intersect1d(sets[x], sets[y])), len(sets[x]), len(sets[y]))]
            assert sorted(anchor.answers(x, free)) == want
            derived += x != a
    assert derived > 20 and index.skipped > 0


def test_near_copies_leave_one_row_each(spark):
    from prismar.llm import jaccard

    other = "some quite different text of more than five words"
    df = spark.createDataFrame([(8, LONG), (8, LONG), (None, LONG), (9, LONG), (8, other), (5, None), (5, None), (None, "")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["text"]) for r in rows(jaccard.drop_near_copies(df)))
    assert got == collections.Counter([(8, LONG), (8, other), (5, None), (5, None), (None, "")])
    comp = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows(jaccard.jaccard_classes(df))}
    assert comp[None, len(LONG.split()) - 4] == 8 and comp[9, len(LONG.split()) - 4] == 8


def test_topk(spark):
    from prismar.llm import topk

    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)] + [(400, None), (500, [1.0, None] + [0.0] * 4), (600, [math.nan] * 6), (700, [1.0, 2.0]), (800, []), (301, [0.5] * 6), (302, [0.5] * 6), (200, [0.5] * 6)]
    v = topk.quantised(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    good = [(i, [math.floor(1024 * x) for x in e]) for i, e in data if e and all(x is not None and math.isfinite(x) for x in e)]
    for block, tile, shard in ((16_384, 1024, 16_384), (2, 1, 200)):
        got = collections.defaultdict(list)
        for r in rows(topk.top_k(v, v.where("vec_id % 100 = 0 and vec_id <> 200"), 10, block=block, tile=tile, shard=shard)):
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        for q, e in good:
            if q % 100 == 0 and q != 200:
                best = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q and len(f) == len(e))[:10]
                assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_topk_of_nothing_and_of_huge_numbers(spark):
    from prismar.llm import topk

    bad = spark.createDataFrame([(None, [1.0, 2.0]), (1, None), (2, [math.inf, 0.0])], "vec_id long, embedding array<double>")
    v = topk.quantised(bad)
    assert rows(topk.top_k(v, v.where("vec_id % 100 = 0"))) == [] and rows(v) == []
    big = spark.createDataFrame([(k, [2**30 + k, 2**30 - 7 * k]) for k in range(300)], "vec_id long, v array<bigint>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in rows(topk.top_k(big, big.where("vec_id = 100"), 3))]
    score = lambda a, b: (2**30 + a) * (2**30 + b) + (2**30 - 7 * a) * (2**30 - 7 * b)
    best = sorted(((-score(100, k), k) for k in range(300) if k != 100))[:3]
    assert sorted(got, key=lambda r: -r[2]) == [(100, k, -s) for s, k in best]


def test_katz_counts(docs, none):
    from prismar.llm import katz

    got = rows(katz.katz_scores(docs))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, t in ROWS if not held(i) for w in [*plain_words(t), b" end"])
    n, v = sum(c.values()), len(c)
    want = sorted((i or 0, len(w := [*plain_words(t), b" end"]), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for i, t in ROWS)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    small = rows(katz.katz_scores(docs, vocab_limit=3))
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in small) == want
    assert rows(katz.katz_scores(none)) == []


def test_line_dedup(spark, docs, none):
    from prismar.llm import linededup

    passage = "\n".join(f"this is line {k} of a passage that two documents share" for k in range(6))
    more = [(100, "intro a\n" + passage + "\nend a"), (101, "intro b\n" + passage + "\nend b"), (102, "short\nthe same\nshort"), (103, "the same\nshort")]
    got = {r["doc_id"]: r for r in rows(linededup.dedup_lines(spark.createDataFrame(more, "doc_id long, text string")))}
    assert got[100]["text"] == more[0][1] and got[101]["text"] == "intro b\nend b" and got[101]["n_removed"] == 6
    assert got[102]["n_removed"] == got[103]["n_removed"] == 0
    assert [(b["owner"], b["first"], b["theirs"], b["lines"]) for b in got[101]["blocks"]] == [(100, 1, 1, 6)] and got[100]["blocks"] == []
    kept = rows(linededup.dedup_documents(docs))
    assert {r["doc_id"] for r in kept if r["text"] and LONG in r["text"]} == {None, 2}
    assert set(kept[0]) == set(docs.columns) and any(r["doc_id"] == 3 and r["text"] is None for r in kept)
    assert rows(linededup.dedup_lines(none)) == []


def katz_by_hand(texts, train):
    """P(w | v) as a function, from plain counts over the training texts."""
    from prismar.llm.katz import CUT, discounts

    uni, pairs = collections.Counter(), collections.Counter()
    for t in train:
        w = [*plain_words(t), b" end"]
        uni.update(w)
        pairs.update(zip([b" start", *w], w))
    d1, d2 = (discounts(collections.Counter(c.values())) for c in (uni, pairs))
    total = sum(uni.values())
    p1 = {w: c * d1[min(c, CUT + 1)] / total for w, c in uni.items()}
    unseen, after = 1 - sum(p1.values()), collections.defaultdict(dict)
    for (v, w), c in pairs.items():
        after[v][w] = c

    def p(w, v):
        low = p1.get(w, unseen / (sum(c == 1 for c in uni.values()) + 1))
        if v not in after:
            return low
        n = sum(after[v].values())
        seen = sum(c * d2[min(c, CUT + 1)] for c in after[v].values())
        scale = 1 if 1 - seen / n > 1e-9 else n / (n + 1) * n / seen
        if w in after[v]:
            c = after[v][w]
            return scale * c * d2[min(c, CUT + 1)] / n
        return (1 - scale * seen / n) / (1 - sum(p1[x] for x in after[v])) * low

    return p, uni, unseen, after


@pytest.mark.parametrize("limit", [(1 << 20) - 2, 30, 0])
def test_katz_gives_every_word_its_own_counts(spark, limit):
    from prismar.llm import katz

    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.4, 40) if k < 4000)) for i in range(120)] + [(500, None), (504, "never seen words")]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    p, uni, unseen, after = katz_by_hand(texts, [t for i, t in texts if not held(i)])
    for v in [*list(after)[:40], b"never"]:
        assert abs(sum(p(w, v) for w in uni) + p(b"never", v) / (unseen / (sum(c == 1 for c in uni.values()) + 1)) * unseen - 1) < 1e-9
    got = {r["doc_id"]: r["score"] for r in rows(katz.katz_scores(spark.createDataFrame(texts, "doc_id long, text string"), vocab_limit=limit))}
    for i, t in texts:
        w = [*plain_words(t), b" end"]
        assert got[i] == pytest.approx(sum(math.log10(p(x, v)) for v, x in zip([b" start", *w], w)), abs=1e-4)


def removed_by_all_pairs(texts, min_words=10):
    """id -> places that go: every common block of non-blank lines with every earlier document, by plain comparison."""
    docs = {i: [(p, x.strip(), len(x.split())) for p, x in enumerate(t.split("\n")) if x.strip()] for i, t in texts}
    gone = {i: set() for i in docs}
    for b in docs:
        for a in (a for a in docs if a < b):
            for i in range(len(docs[b])):
                for j in range(len(docs[a])):
                    n = 0
                    while i + n < len(docs[b]) and j + n < len(docs[a]) and docs[b][i + n][1] == docs[a][j + n][1]:
                        n += 1
                    if sum(x[2] for x in docs[b][i : i + n]) >= min_words:
                        gone[b] |= set(range(docs[b][i][0], docs[b][i + n - 1][0] + 1))
    return gone


def kept_lines(spark, texts):
    from prismar.llm import linededup

    return {r["doc_id"]: r["text"] for r in rows(linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")))}


def test_line_dedup_pairs_documents_that_own_none_of_their_lines(spark):
    block = [f"shared line number {k} here" for k in range(4)]
    texts = [(k, block[k]) for k in range(4)] + [(10, "\n".join(["own start", *block])), (11, "\n".join([*block, "own end"]))]
    got = kept_lines(spark, texts)
    assert got[10] == texts[4][1] and got[11] == "own end"


def test_line_dedup_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    pool = [" ".join(f"w{k}x{j}" for j in range(1 + k % 6)) for k in range(12)]
    texts = [(i, "\n".join(pool[int(k)] + "\n" * int(rng.integers(1, 8) == 1) for k in rng.integers(0, 12, int(rng.integers(1, 14))))) for i in range(40)]
    gone = removed_by_all_pairs(texts)
    assert kept_lines(spark, texts) == {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in texts}
    assert 0 < sum(map(len, gone.values())) < sum(len(t.split("\n")) for _, t in texts)


@pytest.mark.parametrize("early, late, left", [
    (["eight words are here in this line %d" % k for k in range(10)], ["eight words are here in this line %d" % k + "\n" for k in range(10)], [""]),  # blank lines between
    (["a line %d" % k for k in range(6)], ["a line %d" % k for k in range(6)], []),  # short lines alone
    (["the passage line number %d" % k for k in range(4)], ["the passage line number %d" % k for k in range(4)] * 2, []),  # twice in the later document
    (["windows ends of this line %d\r" % k for k in range(4)] + ["\r"], ["windows ends of this line %d\r\n\t" % k for k in range(4)], ["\t"]),
])
def test_line_dedup_finds_whole_passages(spark, early, late, left):
    got = kept_lines(spark, [(1, "\n".join(["first", *early])), (2, "\n".join(["second", *late, "end"]))])
    assert got[1] == "\n".join(["first", *early]) and got[2] == "\n".join(["second", *left, "end"])


def test_patience_blocks():
    from prismar.llm.linededup import aligned_blocks, longest_rise

    assert longest_rise([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    moved = aligned_blocks({(0, 20), (1, 21), (5, 10), (6, 11)})
    assert sorted(moved) == [(0, 20, 2), (5, 10, 2)]
    twice = aligned_blocks({(0, 3), (1, 4), (7, 3), (8, 4)})
    assert sorted(twice) == [(0, 3, 2), (7, 3, 2)]
    n = 20_000  # repeated lines, in time
    assert sum(k for *_, k in aligned_blocks({(b, b % 7) for b in range(n)})) == n


def test_maximal_segments():
    from prismar.llm.toxicity import maximal_segments

    s = np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float)
    assert [(a, b) for a, b, _ in maximal_segments(s)] == [(0, 1), (2, 3), (4, 11)]
    assert maximal_segments(np.array([-1.0, -2.0])) == []


def segments_by_definition(scores, start=0):
    """The segment of largest sum, and those left and right of it, for as long as they are positive."""
    best = max(((sum(scores[a:b]), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[1], -best[2]
    return [*segments_by_definition(scores[:a], start), (start + a, start + b), *segments_by_definition(scores[b:], start + b)]


def test_segments_are_all_maximal_ones():
    from prismar.llm.toxicity import maximal_segments

    rng = np.random.default_rng(9)
    for _ in range(200):
        s = rng.normal(-0.2, 1, int(rng.integers(0, 25)))
        assert [(a, b) for a, b, _ in maximal_segments(s)] == segments_by_definition(s.tolist())


def test_quality_features_are_means_of_context_vectors(spark):
    from prismar.llm import quality as Q

    texts = [(1, "one Two three two"), (2, "two, one!  four"), (3, None), (4, ""), (5, "x"), (6, "one one " * 5000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    listed = Q.frequent_words(df, 3)
    counts = collections.Counter(Q.word_key(w) for _, t in texts for w in (t or "").encode().split())
    assert set(listed.tolist()) == {h for h, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:3]}
    vectors, units = Q.unit_vectors(df, listed), Q.Units(listed)
    want = np.zeros((len(listed) + Q.RARE, Q.DIMS))
    index = Q.dense_index(len(want))
    for _, t in texts:
        w = units.of(t.encode() if t else None)[0].tolist()
        for a, b in zip(w, w[1:]):
            want[a] += index[b]
            want[b] += index[a]
    want /= np.sqrt((want**2).sum(axis=1, keepdims=True)) + 1e-9
    assert np.allclose(vectors[: len(want)], want, atol=1e-6)
    x = Q.Pooler(listed, vectors).features([t.encode() if t is not None else None for _, t in texts])
    for (_, t), row in zip(texts, x):
        w = units.of(t.encode() if t else None)[0]
        assert np.allclose(row[: Q.DIMS], want[w].mean(axis=0) if len(w) else 0, atol=1e-5)


def test_classifiers_take_odd_rows(spark):
    from prismar.llm import quality, toxicity
    from pyspark.sql import functions as F

    docs, labels = labelled(spark, 60)
    odd = docs.unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, "w1 vile"), (700, "word " * 200_000)], "doc_id long, text string"))
    odd = odd.withColumns({c: F.lit(1) for c in ("y", "score", "predicted", "unit", "t", "c", "w", "n", "block")})
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = rows(score(odd, labels.unionByName(labels)))
        assert len(got) == 67 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert len(rows(toxicity.remove_toxic(odd, labels))) <= 67


def labelled(spark, n=400):
    rng = np.random.default_rng(2)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 200, 40)]
        toxic, bad = i % 4 == 0, i % 3 == 0
        words[10:12] = ["vile", "rotten"] if toxic else words[10:12]
        docs.append((i, " ".join(w + "***" if bad else w for w in words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs + [(9000, None), (9001, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_weak_words_make_nothing_toxic(spark):
    """Words that are a little more frequent in toxic documents, in a sample that makes them significant, are no evidence."""
    from prismar.llm import toxicity

    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(4000):
        toxic = i % 5 == 0
        words = [f"w{k}" for k in rng.integers(0, 60, 30)] + [f"weak{k}" for k in range(25) if rng.random() < (0.45 if toxic else 0.3)]
        docs.append((i, " ".join([*words, *(["vile", "rotten"] if toxic else [])])))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = {r["doc_id"]: r["toxic"] for r in rows(labels)}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows(toxicity.score_toxicity(docs, labels)) if r["held_out"]]) > 0.99


@pytest.mark.parametrize("what", ["toxic", "quality"])
def test_classifiers_hold_out_well(spark, none, what):
    from prismar.llm import quality, toxicity

    docs, labels = labelled(spark)
    score = toxicity.score_toxicity if what == "toxic" else quality.score_quality
    truth = {r["doc_id"]: r[what] for r in rows(labels)}
    got = rows(score(docs, labels))
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == 402 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert rows(score(none, labels)) == [] and len(rows(score(docs, labels.where("false")))) == 402


def test_pipeline_stages(spark, docs, none, tmp_path):
    import corpus_pipeline

    base, labels = labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.unionByName(base, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in rows(corpus_pipeline.run(spark, str(tmp_path)))} >= {3, 4, 5}
    for _, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, none, str(tmp_path))) == []


def contaminated_by_hand(text, bench):
    w, hit = item_words(text), set()
    for _, t in bench:
        own = item_words(t)
        for k in range(max(1, len(own) - 12) if own else 0):
            phrase = own[k : k + 13]
            for at in range(len(w) - len(phrase) + 1):
                if w[at : at + len(phrase)] == phrase:
                    hit |= set(range(at, at + len(phrase)))
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows, the five together against plain comparisons. Of the learnt first stage, the scorer's own verdict is taken."""
    import corpus_pipeline
    from prismar.llm import tokens, toxicity
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    base, labels = labelled(spark, 160)
    texts = {r["doc_id"]: r["text"] for r in rows(base)}
    words = lambda n: [f"z{k}" for k in rng.integers(0, 500, n)]
    lines = lambda n, w=7: "\n".join(" ".join(words(w)) for _ in range(n))
    passage, long = lines(9), lines(12)
    for k in range(1100, 1112):
        texts[k] = lines(6) + ("\n" + passage if k % 3 == 0 else "") + "\n" + lines(4)
    texts |= {1120: long, 1121: long, 1122: long + "\nmore", 1123: long.replace("z", "Z", 5)}
    one = words(60)
    for k in range(1130, 1138):  # single long lines, near copies of one another
        one = [*one[:10], f"new{k}", *one[11:]]
        texts[k] = " ".join(one)
    texts |= {1140: "start " + BENCH[0][1] + " end", 1141: " ".join(words(400)) + " " + BENCH[0][1], 1142: None, 1143: "", 1144: "one two"}
    spark.createDataFrame([(i, t, 0 if t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    verdict = {r["doc_id"]: r["predicted"] for r in rows(toxicity.score_toxicity(docs, labels))}
    left = {i: t for i, t in texts.items() if not verdict[i]}
    assert 0 < len(left) < len(texts)
    want = [dict(left)]
    gone = removed_by_all_pairs([(i, t) for i, t in sorted(left.items()) if t is not None])
    cut = {i: t if t is None or not gone[i] else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]) for i, t in left.items()}
    cut = {i: t for i, t in cut.items() if not gone.get(i) or t.split()}
    want.append(cut)
    sets, comp = brute_components(sorted(cut.items()))
    want.append({i: t for i, t in cut.items() if not sets[i] or comp[i] == i})
    want.append({i: t for i, t in want[-1].items() if not contaminated_by_hand(t, BENCH)})
    assert all(len(a) > len(b) for a, b in zip(want, want[1:]))
    library = Tokenizer.from_file(tokens.tokenizer_path())
    pieces = set()
    for i, t in want[-1].items():
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        pieces |= {(i, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)}

    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "n_chars"], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r["doc_id"]: r["text"] for r in rows(docs)} == kept and docs.count() == len(kept), name
    packed = {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)))}
    assert packed == pieces == {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows(corpus_pipeline.run(spark, str(tmp_path)))}


def test_sets_that_share_a_key_are_told_apart(spark):
    from prismar.llm import jaccard

    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(6)]
    texts += [texts[0] + " tail", texts[3]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    half = lambda s: (int(jaccard.set_key(s)[0]) % 2, jaccard.set_key(s)[1])
    got = rows(jaccard.set_components(df, key=half))
    comp = {r["doc_id"]: r["comp"] for r in got}
    assert len({r["cid"] for r in got}) == 7 and len(set(comp.values())) == 6 and comp[0] == comp[6] and comp[3] == comp[7]


def test_repeated_lines_line_up_as_one_block(spark):
    from prismar.llm import linededup

    line = "one and the same line of ten words stands here again"
    texts = [(1, "\n".join(["first words", *[line] * 500, "last words"])), (2, "\n".join([*[line] * 500, "own end"])), (3, "\n".join(["x", "y", *[line] * 3]))]
    got = {r["doc_id"]: r for r in rows(linededup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got[1]["text"] == texts[0][1] and got[2]["text"] == "own end" and got[3]["text"] == "x\ny"
    assert [tuple(b[c] for c in ("owner", "first", "theirs", "lines")) for b in got[2]["blocks"]] == [(1, 0, 1, 500)]
    assert [tuple(b[c] for c in ("owner", "first", "theirs", "lines")) for b in got[3]["blocks"]] == [(1, 2, 1, 3)]
    more = {r["doc_id"]: r for r in rows(linededup.dedup_lines(spark.createDataFrame([(1, "\n".join([line] * 4)), (2, "\n".join([line] * 7))], "doc_id long, text string")))}
    assert more[2]["text"] == "" and sum(b["lines"] for b in more[2]["blocks"]) == 7 and max(b["lines"] for b in more[2]["blocks"]) == 4


def test_units_of_many_texts_are_those_of_each_token():
    import xxhash
    from prismar.llm import quality as Q

    texts = [None, "", "One, two  TWO\n\nthree", " \t", "aaa AAAb00 --- é\u00a0É $$ x", "...", "two \x1c\x85 one", ""]
    raw = [t.encode() if t is not None else None for t in texts]
    tokens = [t.split() if t else [] for t in raw]
    listed = np.array(sorted({Q.word_key(b"two"), Q.word_key(b"aaa"), Q.word_key(b"")}))
    place = {k: i for i, k in enumerate(listed.tolist())}
    words = [place.get(Q.word_key(t), 3 + Q.word_key(t) % Q.RARE) for own in tokens for t in own]
    shapes = [xxhash.xxh3_64_intdigest(Q._RUNS.sub(rb"\1+", t.translate(Q._SHAPE))) % Q.SHAPES for own in tokens for t in own]
    found = Q.Units(listed).of_all(raw)
    assert [x.tolist() for x in found] == [words, shapes, list(map(len, tokens))]
    assert [len(x) for x in Q.Units(listed[:0]).of_all([None, ""])] == [0, 0, 2]
