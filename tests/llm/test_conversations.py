"""Operator 12: every path by brute force for few rows, a plain recursion for many, cut in segments of any length."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub("[\x20\x09-\x0d]+$", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def best_path(symbols):
    """(cost, letters, repaired roles) by a recursion over rows; inserted roles are written in capitals."""
    @functools.cache
    def from_(k, s, free):
        ways = [(0, "", ())] if k == len(symbols) and s in (0, 3) else []
        for r in "ua":
            if free and (s, r) in STEP:
                c, w, t = from_(k, STEP[s, r], free - 1)
                ways.append((c + 3, "I" + w, (("I", r), *t)))
        if k < len(symbols):
            initial, gone, cut = symbols[k]
            c, w, t = from_(k + 1, s, 2)
            ways.append((c + 4, "D" + w, (("D", ""), *t)))
            for r in {initial, "u", "a"} if not gone else ():
                for letter, cost in ([("K", 0)] if r == initial else []) + ([("R", 3)] if r in "ua" and r else []):
                    if (s, r) in STEP:
                        c, w, t = from_(k + 1, STEP[s, r], 2)
                        ways.append((c + cost + 3 * cut, letter + w, ((letter, r), *t)))
        return min(ways, default=(10**9, "", ()))

    return from_(0, 0, 2)


def by_enumeration(symbols):
    ways = []
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    for fill in itertools.product(gaps, repeat=len(symbols) + 1):
        for edits in itertools.product(["K", "Ru", "Ra", "D"], repeat=len(symbols)):
            roles, letters, cost = fill[0], "I" * len(fill[0]), 3 * len(fill[0])
            for (initial, gone, cut), e, more in zip(symbols, edits, fill[1:]):
                if gone and e != "D":
                    break
                roles += {"K": initial, "D": ""}.get(e, e[1:]) + more
                letters += e[0] + "I" * len(more)
                cost += {"K": 0, "D": 4}.get(e, 3) + (3 if cut and e != "D" else 0) + 3 * len(more)
            else:
                if re.fullmatch("(s?(ua)+)?", roles):
                    ways.append((cost, letters))
    return min(ways)


def report(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        marks, initials = faults(own), [r[2][:1] for r in own]
        cost, letters, path = best_path(tuple((i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, marks)))
        left, lines = iter(own), []
        for letter, r in path:
            row = next(left) if letter != "I" else None
            if letter != "D":
                role = row[2] if letter == "K" else {"u": "user", "a": "assistant"}[r]
                lines.append(f"{role}:{row[3] if row else ''}")
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def random_symbols(rnd, n):
    return tuple((rnd.choice("suauaux "), rnd.random() < 0.2, rnd.random() < 0.2) for _ in range(n))


def test_scalar_weights_find_the_least_of_all_paths():
    from prismar.llm.conversations import segment

    rnd = random.Random(1)
    for n in (0, 1, 1, 1, 2, 2, 2, 2, 2, 3, 3):
        symbols = random_symbols(rnd, n)
        paths = segment(list(symbols), (0,), True)
        got = min(paths[0, t] for t in (0, 3) if (0, t) in paths)
        assert got == by_enumeration(symbols) == best_path(symbols)[:2]


@pytest.mark.parametrize("size", [1, 2, 7])
def test_segments_put_together_are_the_whole(size):
    from prismar.llm.conversations import Chain, cut_letters, replay, segment

    rnd = random.Random(size)
    for _ in range(150):
        symbols = random_symbols(rnd, rnd.randrange(1, 24))
        parts = [symbols[a : a + size] for a in range(0, len(symbols), size)]
        chain = Chain()
        for p in parts:
            chain.add(segment(list(p), range(4), False))
        cost, letters, ends = chain.result()
        want = best_path(symbols)
        assert (cost, letters) == want[:2]
        made = []
        for p, own, state in zip(parts, cut_letters(letters, map(len, parts)), [0, *ends]):
            made += [t["role"][0] for t in replay(own, [(i + "x", "") for i, _, _ in p], state)]
        assert made == [r for letter, r in want[2] if letter != "D"]


def conversation_rows():
    rnd = random.Random(5)
    texts = ["Fine.", "Right!", "cut off", " \t\n", "", "Why? ", "say this again.", None, "ends. é"]
    rows = [(c, t, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rnd.choice(texts)) for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(None, None, "user", "Hi."), (None, None, "assistant", "Ho."), (None, 3, "user", "Hi."), (50, None, None, None), (51, 2**40, "user", "q?")]
    rows += [(c, 0, "user", "gone") for c in range(60, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += [(300, t // 3, "assistant" if t % 2 else "user", f"Turn {t}." if t % 7 else "Same.") for t in range(90)]
    rows += [(400, 5, "user", "Copies.")] * 30 + [(401, 1, "user", "long " * 100_000 + "."), (401, 2, "assistant", "end " * 100_000)]
    return rows


@pytest.mark.parametrize("long", [3, 512])
def test_digest(spark, long):
    from prismar.llm import conversations
    from pyspark.sql import functions as F

    rows = conversation_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("copies", "kind", "seg", "part", "audit")}).repartition(5)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = conversations.digest(df, long)
    assert got.columns == columns
    order = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(report(rows), key=order)
    assert conversations.digest(df.where("false")).collect() == []


def test_a_long_conversation_is_cut_over_ranges(spark):
    from prismar.llm import conversations

    rows = [(7, t, "user" if t % 2 else "assistant", f"Turn {t}" + "." * (t % 5 > 0)) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = conversations.ordered(conversations.damage(df))
        from pyspark.sql import functions as F

        assert parts.groupBy(F.spark_partition_id()).count().count() == 4
        got = [tuple(r) for r in conversations.digest(df, 32).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == report(rows)
