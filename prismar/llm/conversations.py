"""Conversation structure repair (operator 12): the cheapest edits that make the roles an optional system turn and then user-assistant pairs.

Every path of edits has one integer as its weight: the cost in the high digits, and below it the letters of its edits, one digit of a fixed width for
each place, the first letter highest and zeros at the end. The plain minimum of these integers is thus the cheapest path and, of equal ones,
the one whose letters are least; a pass over the rows with the four states of the role automaton finds it.

A long conversation is cut into segments. A segment has one such minimum for each state that it may begin and end in, and they are put together in
order. That is exact: of two paths through a segment with the same states and cost neither's letters begin the other's, since letters alone fix the cost.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import materialize

#: Costs of the edits, their letters in ASCII order as digits above zero, and the automaton of `(s?(ua)+)?` (3 and 0 accept).
RENAME, DELETE, INSERT, MEND = 3, 4, 3, 3
LETTERS = " DIKR"
D, I, K, R = 1, 2, 3, 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
WHITE, STOPS = " \t\n\v\f\r", ".!?"
BITS, LONG = 3, 512
TURNS = "array<struct<role:string,text:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
PIECES = f"conv_id long, part int, seg int, turns {TURNS}"
PART = ("conv_id long, part int, seg int, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, "
        f"distinct long, low_turn long, high_turn long, costs array<long>, audits array<string>, turns {TURNS}")  # fmt: skip


def _spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage_kind() -> Column:
    return F.crc32(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn"))) % 20


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the damaged rows, by crc32 of `conv_id:turn`; null roles and texts become one space."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"), damage_kind().alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def segment(rows: list[tuple[str, bool, bool]], starts: Iterable[int], opening: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(begin, end) -> (cost, letters) of the best path through `rows` of (role initial, must go, truncated).

    `opening`: turns may be inserted before the first row too; elsewhere the segment before has done that.
    """
    width = 3 * len(rows) + 2
    place = [1 << BITS * (width - 1 - p) for p in range(width)]
    cost = 1 << BITS * width
    out = {}

    def inserted(best: dict[int, tuple[int, int]]) -> None:
        for end, begins in ((2, (0, 1, 3)), (3, (2,))):
            for s in begins:
                if s in best:
                    w, p = best[s]
                    if p < width:
                        w += INSERT * cost + I * place[p]
                        if end not in best or w < best[end][0]:
                            best[end] = (w, p + 1)

    for start in starts:
        best = {start: (0, 0)}
        if opening:
            inserted(best)
        for initial, gone, truncated in rows:
            now: dict[int, tuple[int, int]] = {}
            for s, (w, p) in best.items():
                edges = [(s, DELETE * cost + D * place[p])]
                if not gone:
                    extra = MEND * cost if truncated else 0
                    if (s, initial) in NEXT:
                        edges.append((NEXT[s, initial], extra + K * place[p]))
                    edges += [(NEXT[s, r], extra + RENAME * cost + R * place[p]) for r in ROLE if (s, r) in NEXT]
                for end, more in edges:
                    if end not in now or w + more < now[end][0]:
                        now[end] = (w + more, p + 1)
            inserted(now)
            best = now
        for end, (w, p) in best.items():
            digits = (w & (cost - 1)) >> BITS * (width - p)
            out[start, end] = (w >> BITS * width, "".join(LETTERS[digits >> BITS * k & 7] for k in range(p - 1, -1, -1)))
    return out


class Chain:
    """Puts segments together in order. What all live paths begin with is set aside, so that it is neither compared nor copied again."""

    def __init__(self):
        self.head: list[str] = []
        self.best = {s: (cost, letters, b"") for (_, s), (cost, letters) in segment([], (0,), True).items()}

    def add(self, paths: dict[tuple[int, int], tuple[int, str]]) -> None:
        now: dict[int, tuple[int, str, bytes]] = {}
        for (s, t), (cost, letters) in paths.items():
            if s in self.best:
                way = (self.best[s][0] + cost, self.best[s][1] + letters, self.best[s][2] + bytes([t]))
                if t not in now or way < now[t]:
                    now[t] = way
        # What is possible after a system turn is so after an assistant's, and so is what is possible with nothing kept, for one deleted system turn more.
        for s, margin in ((1, 0), (0, DELETE)):
            if s in now and 3 in now and now[s][0] > now[3][0] + margin:
                del now[s]
        common = len(os.path.commonprefix([w for _, w, _ in now.values()]))
        if common:
            self.head.append(next(iter(now.values()))[1][:common])
        self.best = {s: (c, w[common:], ends) for s, (c, w, ends) in now.items()}

    def result(self) -> tuple[int, str, bytes]:
        """Cost, letters, and the state after each segment."""
        cost, letters, ends = min(self.best[s] for s in (0, 3) if s in self.best)
        return cost, "".join(self.head) + letters, ends


def replay(letters: str, rows: Iterable[tuple[str | None, str | None]], state: int) -> list[dict]:
    """The repaired turns of the rows under these edits, from `state` on."""
    left, out = iter(rows), []
    for edit in letters:
        role, text = next(left) if edit != "I" else (None, "")
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else ("a" if state == 2 else "u")
        out.append({"role": role if edit == "K" else ROLE[initial], "text": text})
        state = NEXT[state, initial]
    return out


def cut_letters(letters: str, sizes: Iterable[int]) -> Iterator[str]:
    """The letters of each segment of so many rows; insertions between two segments belong to the first one."""
    at = 0
    sizes = list(sizes)
    for k, n in enumerate(sizes):
        begin = at
        while n:
            n -= letters[at] != "I"
            at += 1
        while at < len(letters) and (letters[at] == "I" or k == len(sizes) - 1):
            at += 1
        yield letters[begin:at]


class Segments:
    """Cuts a partition's sorted rows into conversations, and these into segments of at most `long` rows; yields rows of PART."""

    def __init__(self, part: int, long: int):
        self.part, self.long, self.seg = part, long, 0
        self.key, self.first, self.seen = None, True, False
        self.split = False
        self.clear()

    def clear(self) -> None:
        self.rows, self.faults, self.texts, self.turns = [], dict.fromkeys(COUNTS, 0), [], []

    def row(self, key, turn, role: str, text: str, seen: bool, copies: int) -> Iterator[dict]:
        if not self.seen or key != self.key:
            if self.seen:
                yield self.flush(self.first or self.split)
                self.first = False
            self.key, self.seen, self.split = key, True, False
        body = text.rstrip(WHITE)
        for c in range(copies):
            if len(self.rows) >= self.long:
                self.split = True
                yield self.flush(True)
            fault = "blank" if not body else "duplicate" if seen or c else "truncated" if body[-1] not in STOPS else None
            if fault:
                self.faults[fault] += 1
            if self.rows and self.rows[-1][0] + role[:1] not in LEGAL:
                self.faults["illegal"] += 1
            gone = fault in ("blank", "duplicate")
            self.rows.append((role[:1], gone, fault == "truncated"))
            self.texts.append((None, None) if gone else (role, text))
            self.turns.append(turn)

    def end(self) -> Iterator[dict]:
        if self.seen:
            yield self.flush(True)  # the next partition may go on with it

    def flush(self, open_: bool) -> dict:
        known = [t for t in self.turns if t is not None]
        out = {"conv_id": self.key, "part": self.part, "seg": self.seg, "whole": not open_, "n": len(self.rows), **self.faults, "head": self.rows[0][0], "tail": self.rows[-1][0],
               "low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known)), "low_turn": self.turns[0], "high_turn": self.turns[-1]}
        if open_:
            paths = segment(self.rows, range(4), False)
            cells = [paths.get((s, t), (None, None)) for s in range(4) for t in range(4)]
            out |= {"costs": [c for c, _ in cells], "audits": [a for _, a in cells], "turns": [{"role": r, "text": t} for r, t in self.texts]}
        else:
            paths = segment(self.rows, (0,), True)
            cost, letters = min(paths[0, t] for t in (0, 3) if (0, t) in paths)
            out |= {"costs": [cost], "audits": [letters], "turns": replay(letters, self.texts, 0)}
        self.seg += 1
        self.clear()
        return out


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 200, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += sum(len(t["text"] or "") for t in r.get("turns") or ())
        if len(held) == size or weight > limit:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def ordered(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number, and whether role and text have been in the conversation before; sorted and dealt by range.

    A range is cut inside a conversation where that is long. The order is by turn (nulls first), then role and text, so that copies lie side by side.
    """
    each = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said, at = F.md5(F.concat_ws("\n", F.length("role").cast("string"), "role", "text")), F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    each = each.withColumn("said", said)
    first = each.groupBy(F.col("conv_id").alias("own"), F.col("said").alias("words")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
    marked = each.join(first, each["conv_id"].eqNullSafe(F.col("own")) & (F.col("said") == F.col("words")), "left")
    marked = marked.select("conv_id", "turn", "role", "text", "copies", F.coalesce(F.col("first") < at, F.lit(False)).alias("seen"))
    dealt = marked.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def repair(rows: DataFrame, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Two tables: a report for each conversation of `rows` (conv_id, turn, role, text, and how many copies of the row there are), and pieces of long ones.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and turns, the repaired (role, text) in order. turns is null for a conversation
    that was cut into segments (of over `long` rows, or at the edge of a range); its turns are then in the pieces: conv_id, part, seg, turns, in the order of part and seg.

    Rows of one conversation with equal turns are taken in the order of role and text. A null conv_id is one conversation of its own, null turns come first, roles
    and texts must not be null (damage() sees to that); roles other than system, user and assistant can't be kept as they are; texts of any length
    are kept whole. An empty table gives two empty ones. Memory: a task holds one segment, or the letters of one conversation.
    """
    parts = ordered(rows)
    schema = _schema(PART)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Segments(TaskContext.get().partitionId(), long)

        def made() -> Iterator[dict]:
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen", "copies"))):
                    yield from own.row(*r)
            yield from own.end()

        yield from _batches(made(), schema)

    table = materialize(parts.mapInArrow(cut, PART), "conversation-parts")
    gaps = lambda high, low, distinct: F.coalesce(F.col(high) - F.col(low) + 1 - F.col(distinct), F.lit(0)).alias("gaps")
    whole = table.where("whole").select("conv_id", gaps("high", "low", "distinct"), *COUNTS, F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), "turns")

    found = f"conv_id long, part int, seg int, letters string, state int, low long, high long, distinct long, cost long, audit string, {', '.join(f'{c} long' for c in COUNTS)}"
    found_schema = _schema(found)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((out for own in _conversations(batches) for out in _chained(own)), found_schema)

    cut_up = table.where("not whole")
    edges = materialize(_by_conversation(cut_up.drop("turns")).mapInArrow(chain, found), "conversation-chains")
    longer = edges.where("part < 0").select("conv_id", gaps("high", "low", "distinct"), *COUNTS, "cost", "audit", F.lit(None).cast(TURNS).alias("turns"))

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                turns = replay(r["letters"], ((t["role"], t["text"]) for t in r["turns"]), r["state"])
                yield from _batches(iter([{k: r[k] for k in ("conv_id", "part", "seg")} | {"turns": turns}]), pieces_schema)

    pieces_schema = _schema(PIECES)
    pieces = edges.where("part >= 0").select("part", "seg", "letters", "state").join(cut_up.select("conv_id", "part", "seg", "turns"), ["part", "seg"])
    return whole.unionByName(longer), pieces.select("conv_id", "part", "seg", "turns", "letters", "state").mapInArrow(repaired, PIECES)


def _by_conversation(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seg")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[dict]]:
    """The sorted rows of each conversation, one after the other; nothing is held."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for _, own in groupby(rows, key=lambda r: r["conv_id"]):
        yield own


def _chained(segments: Iterator[dict]) -> Iterator[dict]:
    """The report of a conversation (part -1), then the letters and the first state of each of its segments."""
    chain, places, total, before = Chain(), [], dict.fromkeys((*COUNTS, "distinct"), 0) | {"low": None, "high": None}, None
    for r in segments:
        chain.add({(k // 4, k % 4): (c, r["audits"][k]) for k, c in enumerate(r["costs"]) if c is not None})
        places.append((r["part"], r["seg"], r["n"]))
        for c in (*COUNTS, "distinct"):
            total[c] += r[c]
        if before:
            total["illegal"] += before["tail"] + r["head"] not in LEGAL
            total["distinct"] -= r["low_turn"] is not None and before["high_turn"] == r["low_turn"]
        for c, pick in (("low", min), ("high", max)):
            total[c] = pick((x for x in (total[c], r[c]) if x is not None), default=None)
        before = {"tail": r["tail"], "high_turn": r["high_turn"]}
        key = r["conv_id"]
    cost, audit, ends = chain.result()
    yield {"conv_id": key, "part": -1, "seg": -1, "cost": cost, "audit": audit, **total}
    for (part, seg, _), letters, state in zip(places, cut_letters(audit, [n for *_, n in places]), [0, *ends]):
        yield {"conv_id": key, "part": part, "seg": seg, "letters": letters, "state": state}


def digest(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage(), those with no row left too."""
    report, pieces = repair(damage(conversations), long)
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    sha = F.sha2(F.array_join(F.transform("turns", line), "\n"), 256).alias("repaired_sha256")
    whole = report.where("turns is not null").select("*", sha).drop("turns")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _conversations(batches):
            state, first, key = hashlib.sha256(), True, None
            for r in own:
                key = r["conv_id"]
                for t in r["turns"]:
                    state.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode())
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([state.hexdigest()])], ["own", "repaired_sha256"])

    shas = _by_conversation(pieces).mapInArrow(hashed, "own long, repaired_sha256 string")
    longer = report.where("turns is null").drop("turns").join(shas, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    nothing = hashlib.sha256(b"").hexdigest()
    kept = F.max(F.when(damage_kind() != 0, 1).otherwise(0)).alias("kept")
    gone = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(kept).where("kept = 0")
    zeros = gone.select("conv_id", *(F.lit(0).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")), F.lit("").alias("audit"), F.lit(nothing).alias("repaired_sha256"))
    return whole.unionByName(longer).unionByName(zeros)
