"""Streams against their batch forms: shuffled micro-batches, forced replays, contents that come twice."""

import random
from pathlib import Path

import pytest

LOG = [(t, t, 1, a, i) for t, (a, i) in enumerate([("add", "A"), ("add", "B"), ("add", "A"), ("remove", "A"), ("add", "A")])] + [(t, t, 2, a, i) for t, (a, i) in enumerate([("add", "A"), ("clear", None), ("add", "B")])]
EVENTS = "ts long, event_id long, user_id long, action string, item string"


def random_log(actions, n=400):
    rnd = random.Random(4)
    return [(t // 2, t, rnd.randrange(4), a, None if a in ("clear", "all_on", "all_off") else rnd.choice("ABCDEFGH")) for t in range(n) for a in [rnd.choice(actions)]]


def shuffled(spark, log, folder, files=4):
    own = log[:]
    random.Random(5).shuffle(own)
    for k in range(files):
        spark.createDataFrame(own[k::files], EVENTS).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(folder)


def boards_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.pos)):
        out.setdefault(r.user_id, []).append(r.item)
    return out


@pytest.mark.parametrize("late", [None, 10**9])
def test_moodboard_stream_equals_batch(spark, tmp_path, late):
    from prismar.streaming import boards, commits, sessions

    log = LOG + [(t, i + 100, u + 10, a, x) for t, i, u, a, x in random_log(["add", "add", "add", "remove", "clear"])]
    whole = boards_of(sessions.moodboards(spark.createDataFrame(log, EVENTS)).collect())
    assert whole[1] == ["B", "A"] and whole[2] == ["B"] and len(whole) > 4
    stream = boards.stream_moodboards(shuffled(spark, log, f"{tmp_path}/log"), late)
    commits.commit(stream, f"{tmp_path}/out", f"{tmp_path}/check", "update").awaitTermination()
    assert boards_of(boards.board_of(commits.latest(spark, f"{tmp_path}/out", "user_id", "item")).collect()) == whole
    assert len(list(Path(tmp_path, "out").glob("batch=*"))) == 4


def test_what_is_late_is_bounded():
    from prismar.streaming.boards import Board

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    class Map(dict):
        getValue, containsKey, removeKey, updateValue = dict.get, dict.__contains__, dict.pop, dict.__setitem__  # noqa: N815

        def iterator(self):
            return iter(list(self.items()))

    import pandas as pd

    board = Board(late=5)
    board.cleared, board.newest, board.items = Value(), Value(), Map()
    for t in range(100):
        frame = pd.DataFrame([(t, t, "add", "A")], columns=["at", "event_id", "action", "item"])
        out = next(board.handleInputRows((1, 0), iter([frame]), None))
    assert out.since_at.tolist() == [0] and len(board.items["A",][1]) <= 2 * 8


def test_selection_stream_equals_batch(spark, tmp_path):
    from prismar.streaming import boards, commits, sessions

    log = random_log(["on", "off", "on", "off", "all_on", "all_off"])
    whole = {tuple(r) for r in sessions.selection(spark.createDataFrame(log, EVENTS)).collect()}
    stream = boards.stream_selection(shuffled(spark, log, f"{tmp_path}/log"))
    commits.commit(stream, f"{tmp_path}/out", f"{tmp_path}/check", "update").awaitTermination()
    assert {(r.user_id, r.item) for r in commits.latest(spark, f"{tmp_path}/out", "user_id", "item").where("selected").collect()} == whole and whole


def test_ingest_takes_each_content_once_also_when_replayed(spark, tmp_path):
    from prismar.streaming import commits

    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", "2").load(f"{tmp_path}/in")
        commits.ingest(stream, f"{tmp_path}/out", "m", lambda d: d.selectExpr("*", "length(content) AS n"), f"{tmp_path}/check").awaitTermination()
        return sorted((r.content_md5, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    for n, text in (("a", "x"), ("b", "yy"), ("c", "x")):
        (tmp_path / "in" / n).write_text(text)
    first = run()
    assert sorted(n for _, n in first) == [1, 2]
    for n, text in (("d", "yy"), ("e", "zzz")):
        (tmp_path / "in" / n).write_text(text)
    second = run()
    assert sorted(n for _, n in second) == [1, 2, 3]
    last = max(Path(tmp_path, "check", "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)  # as if the driver had been lost after the batch was written and before it was noted
    assert run() == second
    before = {p: p.stat().st_mtime for p in Path(tmp_path, "out").rglob("*.parquet")}
    assert run() == second and before == {p: p.stat().st_mtime for p in Path(tmp_path, "out").rglob("*.parquet")}
