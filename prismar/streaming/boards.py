"""Session folds as streams with keyed state (M1, M2).

Events may come in any order and in any batches: what is kept of an item is enough to tell its state under every order. A user's items are spread
over BUCKETS groups, and events for all of them (clear, all_on, all_off) go to each group, so that one user isn't one task's. The groups lie in SHARDS x PAGES
pages by hash. A call from Spark and a look into its state cost far more than the events of one user, so a shard is a call and a page is a state entry: a batch
reads and writes the pages of the users that it has events of.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKETS, SHARDS, PAGES = 8, 256, 32
WHOLE = ("clear", "all_on", "all_off")
BOARD = "user_id long, item string, since_at long, since_id long"
PICKED = "user_id long, item string, selected boolean"
NEVER = (-(2**63), -(2**63))


def keyed(events: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """shard, page, user_id (as text, since pandas has no whole numbers beside nulls), bucket, at (microseconds, or the number that ts is), event_id, action, item of
    the events with one of `actions`."""
    own = F.array(F.pmod(F.xxhash64("item"), F.lit(BUCKETS)).cast("int"))
    bucket = F.explode(F.when(F.col("action").isin(*WHOLE), F.sequence(F.lit(0), F.lit(BUCKETS - 1))).otherwise(own)).alias("bucket")
    at = F.col("ts").cast("long") if dict(events.dtypes)["ts"] in ("int", "bigint") else F.unix_micros(F.col("ts").cast("timestamp"))
    found = events.where(F.col("action").isin(*actions)).select("user_id", bucket, at.alias("at"), "event_id", "action", "item")
    place = F.pmod(F.xxhash64("user_id", "bucket"), F.lit(SHARDS * PAGES)).cast("int")
    return found.select((place % SHARDS).alias("shard"), F.floor(place / SHARDS).cast("int").alias("page"), F.col("user_id").cast("string").alias("user_id"), "bucket", "at", "event_id", "action", "item")


def _rows(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    return [((int(at), int(i)), action, item) for f in frames for at, i, action, item in f[["at", "event_id", "action", "item"]].itertuples(index=False, name=None)]


def _pairs(flat) -> list[tuple[int, int]]:
    flat = [int(x) for x in flat]
    return list(zip(flat[::2], flat[1::2]))


class Board(StatefulProcessor):
    """An item's last removal and the additions after it, and the group's last clear. Emits each touched item with the first addition that still counts, or none.

    `late`: microseconds after which an event is no longer expected. Of the additions before that only the first is kept, so that an item's state has a bound; None keeps all.
    """

    def __init__(self, late: int | None = None):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cleared = handle.getValueState("cleared", "at long, id long")
        self.newest = handle.getValueState("newest", "at long")
        self.items = handle.getMapState("items", "item string", "removed array<long>, adds array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.frame(self.fold(key[0], _rows(rows)))

    def fold(self, user: int, events: list[tuple]) -> list[tuple]:
        before = tuple(self.cleared.get()) if self.cleared.exists() else NEVER
        cleared = max([before, *(t for t, a, _ in events if a == "clear")])
        newest = max([self.newest.get()[0] if self.newest.exists() else NEVER[0], *(t[0] for t, *_ in events)])
        self.newest.update((newest,))
        held: dict[str, list] = {}
        if cleared != before:
            self.cleared.update(cleared)
            held = {k[0]: [*_pairs(v[0]), _pairs(v[1])] for k, v in self.items.iterator()}
        for t, action, item in events:
            if action == "clear":
                continue
            if item not in held:
                found = self.items.getValue((item,)) if self.items.containsKey((item,)) else None
                held[item] = [*_pairs(found[0]), _pairs(found[1])] if found else [NEVER, []]
            if action == "remove":
                held[item][0] = max(held[item][0], t)
            else:
                held[item][1].append(t)
        out = []
        for item, (removed, adds) in held.items():
            adds = sorted({t for t in adds if t > max(removed, cleared)})
            if self.late is not None:
                old = sum(t[0] < newest - self.late for t in adds)
                adds = adds[:1] + adds[max(old, 1) :]
            if adds or removed > cleared:
                self.items.updateValue((item,), (list(removed), [x for t in adds for x in t]))
            elif self.items.containsKey((item,)):
                self.items.removeKey((item,))
            out.append((user, item, *(adds[0] if adds else (None, None))))
        return out

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user_id", "item", "since_at", "since_id"]).astype({"user_id": "Int64", "since_at": "Int64", "since_id": "Int64"})

    def close(self) -> None:
        pass


class Selection(StatefulProcessor):
    """An item's last on or off, and the group's last all_on or all_off. Emits each touched item with whether it is selected now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bulk = handle.getValueState("bulk", "at long, id long, action string")
        self.items = handle.getMapState("items", "item string", "at long, id long, action string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.frame(self.fold(key[0], _rows(rows)))

    def fold(self, user: int, events: list[tuple]) -> list[tuple]:
        before = tuple(self.bulk.get()) if self.bulk.exists() else (*NEVER, "")
        bulk = max([before, *((*t, a) for t, a, _ in events if a in WHOLE)])
        held: dict[str, tuple] = {}
        if bulk != before:
            self.bulk.update(bulk)
            held = {k[0]: tuple(v) for k, v in self.items.iterator()}
        for t, action, item in events:
            if action not in WHOLE:
                if item not in held:
                    held[item] = tuple(self.items.getValue((item,))) if self.items.containsKey((item,)) else (*NEVER, "")
                held[item] = max(held[item], (*t, action))
                self.items.updateValue((item,), held[item])
        return [(user, item, own[2] == "on" if own[:2] > bulk[:2] else bulk[2] == "all_on") for item, own in held.items()]

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user_id", "item", "selected"]).astype({"user_id": "Int64"})

    def close(self) -> None:
        pass


class Held:
    """A group's part of a page, with the methods of the states that a fold asks for: plain lists by name, and by key in a map."""

    def __init__(self, states: dict[str, list]):
        self.states = states

    def getValueState(self, name: str, schema: str) -> HeldValue:  # noqa: N802
        return HeldValue(self.states.setdefault(name, []))

    def getMapState(self, name: str, key: str, value: str) -> HeldMap:  # noqa: N802
        return HeldMap(self.states.setdefault(name, []))


class HeldValue:
    def __init__(self, value: list):
        self.value = value

    def exists(self) -> bool:
        return bool(self.value)

    def get(self) -> tuple:
        return tuple(self.value)

    def update(self, value: tuple) -> None:
        self.value[:] = value


class HeldMap:
    """Entries [key, value] of a list that is kept up to date; keys are single strings or null."""

    def __init__(self, entries: list[list]):
        self.entries = entries
        self.at = {e[0]: n for n, e in enumerate(entries)}

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return key[0] in self.at

    def getValue(self, key: tuple) -> Any:  # noqa: N802
        return self.entries[self.at[key[0]]][1]

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        if key[0] in self.at:
            self.entries[self.at[key[0]]][1] = list(value)
        else:
            self.at[key[0]] = len(self.entries)
            self.entries.append([key[0], list(value)])

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        place, last = self.at.pop(key[0]), self.entries.pop()
        if place < len(self.entries):
            self.entries[place], self.at[last[0]] = last, place

    def iterator(self) -> Iterator[tuple]:
        return iter([((k,), v) for k, v in self.entries])


class Paged(StatefulProcessor):
    """A fold over all groups of a shard. A page is one state entry, the JSON of its groups' states; one is held at a time, beside the shard's events of the batch."""

    def __init__(self, fold: Callable[[], Board | Selection], rows: int = 10_000):
        self.make, self.rows = fold, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("pages", "page int", "groups string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events: dict[int, dict[tuple, list]] = {}
        for f in rows:
            for page, user, bucket, at, i, action, item in zip(*(f[c].tolist() for c in ("page", "user_id", "bucket", "at", "event_id", "action", "item"))):
                events.setdefault(page, {}).setdefault((user, bucket), []).append(((int(at), int(i)), action, item))
        fold, out = self.make(), []
        for page in sorted(events):
            found = self.pages.getValue((page,))
            groups = {(user, bucket): states for user, bucket, states in json.loads(found[0])} if found else {}
            for (user, bucket), own in events.pop(page).items():
                fold.init(Held(groups.setdefault((user, bucket), {})))
                out += fold.fold(None if user is None else int(user), own)
            self.pages.updateValue((page,), (json.dumps([[*group, states] for group, states in groups.items()], separators=(",", ":")),))
            if len(out) >= self.rows:
                yield fold.frame(out)
                out = []
        yield fold.frame(out)

    def close(self) -> None:
        pass


def stream_moodboards(events: DataFrame, late: int | None = None) -> DataFrame:
    """user_id, item, since_at, since_id of each item that a batch touches (since: null when it isn't on the board), from a stream of (ts, event_id, user_id, action, item)."""
    return keyed(events, ("add", "remove", "clear")).groupBy("shard").transformWithStateInPandas(statefulProcessor=Paged(lambda: Board(late)), outputStructType=BOARD, outputMode="Update", timeMode="None")


def stream_selection(events: DataFrame) -> DataFrame:
    """user_id, item, selected of each item that a batch touches."""
    return keyed(events, ("on", "off", "all_on", "all_off")).groupBy("shard").transformWithStateInPandas(statefulProcessor=Paged(Selection), outputStructType=PICKED, outputMode="Update", timeMode="None")


def board_of(latest: DataFrame) -> DataFrame:
    """user_id, pos, item from the last row of each item."""
    order = Window.partitionBy("user_id").orderBy("since_at", "since_id")
    return latest.where("since_at is not null").select("user_id", (F.row_number().over(order) - 1).alias("pos"), "item")
