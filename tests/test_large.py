"""What only larger tables showed, on small ones made for it."""

import duckdb
from prismar import catalog


def held_against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the tables (lists of rows, schema) written below `folder`."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = con.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


def test_envelope_rounds_halves_as_its_sql(spark, tmp_path):
    rows = [(2 * u + i, 2 * u + i, u, "view", v, "") for u, (a, b) in enumerate([(0.41, 6.4), (-0.41, 6.4), (0.82, 12.8), (float("nan"), 1.0), (-0.0, 0.0)]) for i, v in enumerate((a, b))]
    got, want = held_against_sql(spark, tmp_path, "V2", events=(rows, "event_id long, ts long, user_id long, event_type string, value double, props string"))
    assert repr(got) == repr(want) and got[0][1][0] == 0.064062


EVENTS = "ts long, event_id long, user_id long, action string, item string"


def test_streams_look_into_their_state_once_a_page(spark, tmp_path):
    """Of many users' events a batch reads and writes as many state entries as there are pages."""
    import pandas as pd
    from prismar.streaming import boards

    class Pages(dict):
        asked = 0

        def getValue(self, key):  # noqa: N802
            self.asked += 1
            return self.get(key)

        updateValue = dict.__setitem__  # noqa: N815

    for fold, action in ((boards.Board, "add"), (boards.Selection, "on")):
        own = boards.Paged(fold)
        own.pages = Pages()
        for t in range(2):
            frame = pd.DataFrame([(u % 3, str(u), u % 8, t, t * 1000 + u, action, "A") for u in range(900)], columns=["page", "user_id", "bucket", "at", "event_id", "action", "item"])
            out = pd.concat(own.handleInputRows((0,), iter([frame[:500], frame[500:]]), None))
            assert sorted(out.user_id) == list(range(900)) and (fold is boards.Selection or set(out.since_at) == {0})
        assert own.pages.asked == 2 * 3 and len(own.pages) == 3


def test_streams_of_more_users_than_pages_equal_batch(spark, tmp_path):
    from prismar.streaming import boards, commits, sessions

    log = [(t, t, 2**60 + t * 7919 % 700, ("add", "remove", "add", "clear")[t * t % 11 % 4], "ABC"[t % 3]) for t in range(3000)]
    names = {"add": "on", "remove": "off", "clear": "all_on"}
    for k, (batch, stream, keep) in enumerate(((sessions.moodboards, boards.stream_moodboards, boards.board_of), (sessions.selection, boards.stream_selection, lambda d: d.where("selected").select("user_id", "item")))):
        own = log if k == 0 else [(*e[:3], names[e[3]], e[4]) for e in log]
        spark.createDataFrame(own, EVENTS).repartition(3).write.parquet(f"{tmp_path}/{k}/log")
        found = stream(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/{k}/log"))
        commits.commit(found, f"{tmp_path}/{k}/out", f"{tmp_path}/{k}/check", "update").awaitTermination()
        got = keep(commits.latest(spark, f"{tmp_path}/{k}/out", "user_id", "item"))
        want = batch(spark.createDataFrame(own, EVENTS)).select(*got.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_streams_take_events_without_a_user_or_an_item(spark, tmp_path):
    from prismar.streaming import boards, commits

    log = [(1, 1, None, "on", "A"), (2, 2, 2**60 + 1, "on", None), (3, 3, 2**60 + 1, "off", "A"), (4, 4, 2**60 + 1, "all_on", None)]
    spark.createDataFrame(log, EVENTS).repartition(2).write.parquet(f"{tmp_path}/log")
    found = boards.stream_selection(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/log"))
    commits.commit(found, f"{tmp_path}/out", f"{tmp_path}/check", "update").awaitTermination()
    got = commits.latest(spark, f"{tmp_path}/out", "user_id", "item").collect()
    assert {(r.user_id, r.item, r.selected) for r in got} == {(None, "A", True), (2**60 + 1, None, True), (2**60 + 1, "A", True)}


def test_palettes_meet_their_centres_by_chunks(spark):
    """The distances of a chunk of points are one array, not an expression a point; draws are Spark's own hashes."""
    import numpy as np
    from prismar.operators import palettes
    from pyspark.sql import functions as F

    x = np.array([[5.0, 175.00000000000003, -0.0], [0.1, -7.5, 1e9], [250.0, 0.0, 240.0]])
    rows = spark.createDataFrame([(2**40 + 3, *map(float, r)) for r in x], "item_id long, p1 double, p2 double, p3 double").coalesce(1)
    assert [r[0] for r in rows.select(F.xxhash64("item_id", "p1", "p2", "p3", F.lit(43))).collect()] == palettes.hashed(2**40 + 3, x, 43).tolist()
    many = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("item_id"), *((F.col("id") * m % 251).cast("double").alias(p) for p, m in (("p1", 1), ("p2", 7), ("p3", 31))), F.lit(2).alias("w"))
    chunks = palettes.chunked(many, 1024)
    sizes = [(r.item_id, r.n, len(r.x), len(r.w)) for r in chunks.collect()]
    assert sum(n for _, n, *_ in sizes) == 5000 and max(n for _, n, *_ in sizes) <= 1024 and len(sizes) < 1050 and all(x == 24 * n and w == 8 * n for _, n, x, w in sizes)
    given = spark.createDataFrame([(1, [(4, 10.0, 10.0, 10.0), (7, 200.0, 200.0, 200.0)])], f"item_id long, centres {palettes.CENTRES}")
    got = {r.pos: (r.n, r.p1) for r in palettes.lloyd_step(many, given, 1, 2).collect()}
    p = np.array([[i * m % 251 for m in (1, 7, 31)] for i in range(4000)], float)
    far = ((p - 10) ** 2).sum(axis=1) > ((p - 200) ** 2).sum(axis=1)
    assert got == {4: (2 * (~far).sum(), p[~far, 0].mean()), 7: (2 * far.sum(), p[far, 0].mean())}
