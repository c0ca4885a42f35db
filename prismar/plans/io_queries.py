"""Queries over files, listings, manifests, sessions, encoders and waveforms."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from prismar.functions.vectors import half_up
from prismar.operators import audio, encode, images
from prismar.operators import points as P
from prismar.operators import raster as R
from prismar.operators.cuts import shared_dir
from prismar.plans.point_queries import pts
from prismar.registry import query, table
from prismar.sources import media, sinks
from prismar.streaming import boards, commits, sessions
from pyspark.sql import functions as F

FILES = "SELECT 'latent_space_' || lower(n_name) || '_' || CASE WHEN n_nationkey % 2 = 0 THEN 'image' ELSE 'audio' END || '_' || (2 + n_nationkey % 2) || 'd.pkl' AS file_name FROM nation UNION ALL SELECT 'index_' || lower(n_name) || '_' || CASE WHEN n_nationkey % 3 = 0 THEN 'image' ELSE 'audio' END || '.pkl' FROM nation"
CAT = rf"SELECT name, modality, dims, name || '::' || dims || 'd::' || modality AS label FROM (SELECT DISTINCT regexp_extract(file_name, '^latent_space_(.+)_(image|audio)_([23])d', 1) AS name, regexp_extract(file_name, '^latent_space_(.+)_(image|audio)_([23])d', 2) AS modality, CAST(nullif(regexp_extract(file_name, '^latent_space_(.+)_(image|audio)_([23])d', 3), '') AS INTEGER) AS dims FROM ({FILES})) a JOIN (SELECT DISTINCT regexp_extract(file_name, '^index_(.+)_(image|audio)\.', 1) AS name, regexp_extract(file_name, '^index_(.+)_(image|audio)\.', 2) AS modality FROM ({FILES})) b USING (name, modality) WHERE name <> ''"


def files(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.lower("n_name")
    kind = lambda m: F.when(k % m == 0, "image").otherwise("audio")
    a = n.select(F.concat(F.lit("latent_space_"), name, F.lit("_"), kind(2), F.lit("_"), (2 + k % 2).cast("string"), F.lit("d.pkl")).alias("file_name"))
    return a.unionByName(n.select(F.concat(F.lit("index_"), name, F.lit("_"), kind(3), F.lit(".pkl")).alias("file_name")))


@query("S4", "SELECT trim(l) AS label FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> ''")
def s4(spark, sf_dir):
    return media.labels_of(table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value")))


@query("S8", "SELECT vec_id, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(label AS VARCHAR) AS label FROM embeddings")
def s8(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return media.scan_latent(e.select("vec_id", F.element_at("embedding", 1).alias("x"), F.element_at("embedding", 2).alias("y"), "label"))


@query("S9", CAT)
def s9(spark, sf_dir):
    return media.catalogue(files(spark, sf_dir))


@query("S10", f"SELECT c.*, coalesce(length(name) % 2 = 0, false) AS has_palette, coalesce(length(name) % 3 = 0, false) AS has_style FROM ({CAT}) c")
def s10(spark, sf_dir):
    sets = media.catalogue(files(spark, sf_dir))
    listed = [sets.where(F.length("name") % m == 0).select("name", F.lit(f).alias("feature")) for m, f in ((2, "palette"), (3, "style"))]
    return media.availability(sets, listed[0].unionByName(listed[1]))


@query("W4", "SELECT key, path, substr(md5(path), 1, 8) || '_' || list_last(string_split(path, '/')) AS target, false AS collides FROM (SELECT CASE WHEN page_id % 4 = 0 THEN 'group::g' || page_id ELSE url || '#' || page_id END AS key, CASE WHEN page_id % 4 = 0 THEN url || '#' || page_id || CASE WHEN page_id % 8 = 0 THEN '/b' ELSE '/a' END ELSE url || '#' || page_id END AS path FROM pages)")
def w4(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("u", F.concat("url", F.lit("#"), "page_id"))
    grouped = F.col("page_id") % 4 == 0
    groups = p.where(grouped).select(F.concat(F.lit("g"), "page_id").alias("gid"), (F.col("page_id") % 8 == 0).cast("int").alias("cursor"), F.array(F.concat("u", F.lit("/a")), F.concat("u", F.lit("/b"))).alias("paths"))
    return sinks.export_manifest(p.select(F.when(grouped, F.concat(F.lit("group::g"), "page_id")).otherwise(F.col("u")).alias("key")), groups)


@query("W5", "SELECT doc_id AS scene, printf('%02d_original.jpg', doc_id) AS original, printf('%02d_poetry.jpg', doc_id) AS poetry, (doc_id + 1) || '. ' || text AS line FROM documents")
def w5(spark, sf_dir):
    return sinks.story_manifest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("scene"), "text"))


@query("W6", "WITH t AS (SELECT DISTINCT url, list_last(string_split(url, '/')) AS target FROM pages), c AS (SELECT target, count(*) > 1 AS collides FROM t GROUP BY target) SELECT p.url AS key, p.url AS path, c.target, collides FROM pages p JOIN c ON c.target = list_last(string_split(p.url, '/'))")
def w6(spark, sf_dir):
    none = spark.createDataFrame([], "gid string, cursor int, paths array<string>")
    return sinks.export_manifest(table(spark, sf_dir, "pages").select(F.col("url").alias("key")), none, "basename")


@query("W7", "SELECT DISTINCT 'ext_' || substr(md5(text), 1, 12) || '.jpg' AS name FROM documents")
def w7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(sinks.content_name(F.col("text").cast("binary"), F.col("source")).alias("name")).distinct()


@query("W8", "SELECT DISTINCT md5(text) AS content_md5 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)")
def w8(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("content_md5", F.md5("text"))
    return sinks.not_yet_built(d, d.where("doc_id % 2 = 0"), "content_md5").select("content_md5")


@query("W9", "SELECT o_orderkey, 'order' || o_orderkey || '_from_customer' || o_custkey || '_lab_' || strftime(CAST(o_orderdate AS TIMESTAMP), '%Y%m%d_%H%M%S') || '.png' AS name FROM orders")
def w9(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = sinks.derived_name(F.concat(F.lit("in/order"), "o_orderkey", F.lit(".png")), F.concat(F.lit("customer"), "o_custkey", F.lit(".jpg")), F.lit("lab"), F.col("o_orderdate").cast("timestamp"))
    return o.select("o_orderkey", name.alias("name"))


@query("E7")
def e7(spark, sf_dir):
    return encode.hash_encode(table(spark, sf_dir, "documents"), "doc_id", "text")


_half = lambda y, x: " + ".join(f"CAST(embedding[{8 * (4 * y + i) + 4 * x + j + 1}] AS DOUBLE)" for i in range(4) for j in range(4))
_as_float = lambda x, n: f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 6) + 0.0 AS {n}"


def parts_of(df, key, *names):
    """A column for each place of the embedding."""
    return df.select(key, *((F.round(F.element_at("embedding", k + 1).cast("double"), 6) + 0.0).alias(n) for k, n in enumerate(names)))


@query("E1", f"SELECT vec_id, {', '.join(_as_float(f'({_half(y, x)}) / 16', f'm{2 * y + x}') for y in (0, 1) for x in (0, 1))} FROM embeddings")
def e1(spark, sf_dir):
    """Vectors read as 8 x 8 images, by a plug-in without weights."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "image")
    return parts_of(encode.encode(e, encode.block_means(), "image", shape=[64]), "vec_id", "m0", "m1", "m2", "m3")


_letters = lambda text: ", ".join(f"CAST(length({text}) - length(replace({text}, '{c}', '')) AS DOUBLE) + 0.0 AS {c}" for c in "aeio")


@query("E2", f"SELECT doc_id, {_letters('text')} FROM documents")
def e2(spark, sf_dir):
    return parts_of(encode.encode(table(spark, sf_dir, "documents"), encode.letter_counts("aeio"), "text", batch_size=64), "doc_id", *"aeio")


@query("E3", f"SELECT vec_id, {_as_float('list_min(embedding)', 'low')}, {_as_float('list_max(embedding)', 'high')} FROM embeddings")
def e3(spark, sf_dir):
    """Vectors read as waveforms."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "samples")
    return parts_of(encode.encode(e, encode.extremes(), "samples", shape=[64]), "vec_id", "low", "high")


@query("E4", "SELECT conv_id, turn, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) + 0.0 AS e FROM conversations WHERE text IS NOT NULL")
def e4(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return parts_of(encode.encode(c, encode.letter_counts("e"), "text", batch_size=64).withColumn("key", F.struct("conv_id", "turn")), "key", "e").select("key.*", "e")


@query("E6", f"SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'image' ELSE 'audio' END AS modality, CASE WHEN vec_id % 2 = 0 THEN round(CAST(CAST(({_half(0, 0)}) / 16 AS FLOAT) AS DOUBLE), 6) ELSE round(CAST(list_min(embedding) AS DOUBLE), 6) END + 0.0 AS first FROM embeddings")
def e6(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.when(F.col("vec_id") % 2 == 0, "image").otherwise("audio").alias("modality"))
    found = encode.encode_by_modality(e, {"image": encode.block_means(), "audio": encode.extremes()}, "x", shape=[64])
    return found.select("vec_id", "modality", (F.round(F.element_at("embedding", 1).cast("double"), 6) + 0.0).alias("first"))


@query("E5")
def e5(spark, sf_dir):
    return encode.label_matrix(table(spark, sf_dir, "documents").select(F.col("source").alias("label")))


EVENTS = "SELECT ts, event_id, user_id, CASE event_type WHEN 'purchase' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'clear' ELSE 'other' END AS action, 'item' || CAST(floor(value) AS BIGINT) % 5 AS item FROM events"


def events(spark, sf_dir, names):
    e = table(spark, sf_dir, "events")
    action = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in names.items()), F.lit("other"))
    return e.select("ts", "event_id", "user_id", action.alias("action"), F.concat(F.lit("item"), (F.floor("value") % 5).cast("string")).alias("item"))


BOARD_EVENTS = {"purchase": "add", "error": "remove", "signup": "clear"}
SELECTION_EVENTS = {"purchase": "on", "error": "off", "signup": "all_on", "view": "all_off"}
M1 = f"WITH e AS ({EVENTS}), c AS (SELECT user_id, max(row(ts, event_id)) AS c FROM e WHERE action = 'clear' GROUP BY 1), l AS (SELECT e.*, row(ts, event_id) AS t FROM e LEFT JOIN c USING (user_id) WHERE c IS NULL OR row(ts, event_id) > c), g AS (SELECT user_id, item, max(t) AS r FROM l WHERE action = 'remove' GROUP BY ALL), k AS (SELECT l.user_id, l.item, min(t) AS s FROM l LEFT JOIN g ON g.user_id = l.user_id AND g.item = l.item WHERE action = 'add' AND (r IS NULL OR t > r) GROUP BY ALL) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS INTEGER) AS pos, item FROM k"


@query("M1", M1)
def m1(spark, sf_dir):
    return sessions.moodboards(events(spark, sf_dir, BOARD_EVENTS))


M2 = "WITH e AS (SELECT row(ts, event_id) AS t, user_id, CASE event_type WHEN 'purchase' THEN 'on' WHEN 'error' THEN 'off' WHEN 'signup' THEN 'all_on' WHEN 'view' THEN 'all_off' ELSE 'other' END AS a, 'item' || CAST(floor(value) AS BIGINT) % 5 AS item FROM events), b AS (SELECT user_id, max(t) AS bt, arg_max(a, t) AS b FROM e WHERE a IN ('all_on', 'all_off') GROUP BY 1), o AS (SELECT user_id, item, max(t) AS ot, arg_max(a, t) AS o FROM e WHERE a IN ('on', 'off') GROUP BY ALL) SELECT o.user_id, item FROM o LEFT JOIN b USING (user_id) WHERE CASE WHEN bt IS NULL OR ot > bt THEN o = 'on' ELSE b = 'all_on' END"


@query("M2", M2)
def m2(spark, sf_dir):
    return sessions.selection(events(spark, sf_dir, SELECTION_EVENTS))


def streamed(spark, batch, files=4):
    """`batch` as a stream of `files` files, its rows dealt to them by hash: each is one micro-batch, and their order isn't that of the events."""
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    batch.repartition(files, F.xxhash64(*batch.columns)).write.parquet(path)
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", "1").parquet(path)


def committed(spark, stream, mode="update"):
    """The folder to which a stream has committed all its batches."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    commits.commit(stream, f"{path}/out", f"{path}/check", mode).awaitTermination()
    return f"{path}/out"


@query("M1_stream", M1)
def m1_stream(spark, sf_dir):
    out = committed(spark, boards.stream_moodboards(streamed(spark, events(spark, sf_dir, BOARD_EVENTS))))
    return boards.board_of(commits.latest(spark, out, "user_id", "item"))


@query("M2_stream", M2)
def m2_stream(spark, sf_dir):
    out = committed(spark, boards.stream_selection(streamed(spark, events(spark, sf_dir, SELECTION_EVENTS))))
    return commits.latest(spark, out, "user_id", "item").where("selected").select("user_id", "item")


@query("X1", f"SELECT DISTINCT content_md5, e FROM (SELECT md5(text) AS content_md5, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) + 0.0 AS e FROM documents WHERE text IS NOT NULL)")
def x1(spark, sf_dir):
    """Documents arrive as a stream of files; each content is encoded and ingested once."""
    docs = streamed(spark, table(spark, sf_dir, "documents").select("doc_id", "text").where("text is not null"))
    path = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    encoded = lambda rows: encode.encode(rows, encode.letter_counts("e"), "text")
    commits.ingest(docs, f"{path}/out", "letters", encoded, f"{path}/check", "text").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("content_md5", F.element_at("embedding", 1).cast("double").alias("e"))


WAVE = "SELECT user_id, list(CAST(value AS DOUBLE) ORDER BY ts, event_id) AS x FROM events WHERE value IS NOT NULL GROUP BY user_id"


@query("V2", f"SELECT user_id, list_transform(range(8), lambda i: round(x[CAST(floor(i * (len(x) - 1) / 7) AS INTEGER) + 1] / CASE WHEN m > 0 THEN m ELSE 1 END, 6) + 0.0) AS envelope FROM (SELECT user_id, x, list_max(list_transform(x, lambda v: abs(v))) AS m FROM ({WAVE}))")
def v2(spark, sf_dir):
    """A user's log is as long as it likes, so only the wanted samples of it are gathered."""
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.struct("ts", "event_id").alias("at"), F.col("value").cast("double").alias("v"))
    found = audio.envelope_of_rows(e, "user_id", "at", "v", 8)
    return found.select("user_id", F.transform("envelope", lambda v: half_up(v, 6) + 0.0).alias("envelope"))


@query("V3")
def v3(spark, sf_dir):
    """Each user's log as a signal, in pieces of 64 frames."""
    return audio.spectrogram_of_rows(table(spark, sf_dir, "events"), "user_id", ("ts", "event_id"), "value", 8000, n_fft=64, hop=16, mels=8, frames=64)


@query("P7")
def p7(spark, sf_dir):
    """All palette features of each bag, joined by item; a bag with a point that has no third value fails, with its reason."""
    p = pts(spark, sf_dir)
    return P.palette_job(p.withColumn("p3", F.when((F.col("item_id") % 40 != 0) | (F.col("p1") > 5), F.col("p3"))))


def _byte(e):
    return F.floor((F.least(F.greatest(e, F.lit(-1.0)), F.lit(1.0)) + 1) * 127).cast("int")


def bitmaps(spark, sf_dir):
    """item_id, content: the bytes of a picture file (BMP) of 8 x 8 pixels for each vector, grey levels from its places; every seventh is cut off in its head."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: _byte(x.cast("double"))).alias("g"))

    def write(batches):
        for batch in batches:
            files = []
            for i, g in zip(batch.column("item_id").to_pylist(), batch.column("g").to_pylist()):
                rows = [g[8 * y : 8 * y + 8] for y in range(7, -1, -1)]
                body = b"".join(bytes(v for p in row for v in (p, p, p)) for row in rows)
                whole = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body
                files.append(whole[:20] if i % 7 == 0 else whole)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(files, pa.binary())], ["item_id", "content"])

    return e.mapInArrow(write, "item_id long, content binary")


def put_files(files, folder, ext="bmp"):
    """Write each row's content to folder/<item_id>.<ext>."""
    def put(rows):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{root}/{r.item_id}.{ext}") as out:
                out.write(bytes(r.content))

    files.foreachPartition(put)


_LEVEL = "floor((least(greatest(CAST(e AS DOUBLE), -1e0), 1e0) + 1) * 127)"
_Y = f"(CASE WHEN {_LEVEL}/255e0 > 0.04045e0 THEN pow(({_LEVEL}/255e0 + 0.055e0) / 1.055e0, 2.4e0) ELSE {_LEVEL}/255e0/12.92e0 END)"
LIGHT = f"least(greatest(floor((CASE WHEN {_Y} > 0.008856e0 THEN 116 * pow({_Y}, 1e0/3) - 16 ELSE 903.3e0 * {_Y} END) * 255e0 / 100 + 0.5e0), 0e0), 255e0) * 100e0 / 255"


@query("P7_images", f"SELECT item_id, 'features' AS kind, round(avg(l), 4) + 0.0 AS light, round(stddev_pop(l), 4) + 0.0 AS spread, count(DISTINCT least(floor(l * 255 / 100 / 16), 15)) AS bins FROM (SELECT vec_id AS item_id, {LIGHT} AS l FROM (SELECT vec_id, unnest(embedding) AS e FROM embeddings WHERE vec_id % 7 <> 0)) GROUP BY item_id UNION ALL SELECT vec_id, 'rejects', NULL, NULL, NULL FROM embeddings WHERE vec_id % 7 = 0")
def p7_images(spark, sf_dir):
    """Pictures are written from the vectors, scanned, and taken through the whole palette job in one pass; broken files are in the rejects."""
    folder = f"{shared_dir(spark)}/pictures-{uuid.uuid4().hex}"
    put_files(bitmaps(spark, sf_dir), f"{folder}/in")
    number = F.regexp_extract("path", r"([0-9]+)\.bmp$", 1).cast("long")
    found, rejects = images.palette_sink(media.scan_images(spark, f"{folder}/in").withColumn("item_id", number), f"{folder}/out", colors=4)
    good = found.select("item_id", F.lit("features").alias("kind"), *((F.round(c, 4) + 0.0).alias(n) for c, n in (("p1_mean", "light"), ("p1_std", "spread"))), F.size("histogram").cast("long").alias("bins"))
    return good.unionByName(rejects.select("item_id", F.lit("rejects").alias("kind")), allowMissingColumns=True)


@query("W1", "SELECT vec_id AS item_id, 'set' || label AS dataset, CASE WHEN vec_id % 2 = 0 THEN 'image' ELSE 'audio' END AS modality, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS first FROM embeddings")
def w1(spark, sf_dir):
    """The vectors are written by data set and modality, and read back."""
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    kinds = (F.concat(F.lit("set"), "label").alias("dataset"), F.when(F.col("vec_id") % 2 == 0, "image").otherwise("audio").alias("modality"))
    sinks.write_embeddings(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", *kinds), path)
    first = F.round(F.element_at("embedding", 1).cast("double"), 6) + 0.0
    return spark.read.parquet(path).select("item_id", F.col("dataset").cast("string").alias("dataset"), "modality", first.alias("first"))


@query("W2", "SELECT vec_id AS item_id, round(CAST(embedding[2] AS DOUBLE), 6) + 0.0 AS value FROM embeddings WHERE vec_id % 3 <> 0")
def w2(spark, sf_dir):
    """Of a feature that a third of the items lack, only the rest is written."""
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    value = F.when(F.col("vec_id") % 3 != 0, F.round(F.element_at("embedding", 2).cast("double"), 6) + 0.0)
    sinks.write_features(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), value.alias("value")), "value", path)
    return media.scan_features(spark, path, "value")


@query("W3", "SELECT vec_id AS item_id, CAST(embedding[1] AS FLOAT) AS x, CAST(embedding[2] AS FLOAT) AS y, CAST(label AS INTEGER) AS cluster_id, 'C' || label AS label FROM embeddings")
def w3(spark, sf_dir):
    """A latent table is written and scanned with its types."""
    path = f"{shared_dir(spark)}/latent-{uuid.uuid4().hex}"
    x, y = (F.element_at("embedding", k).cast("double") for k in (1, 2))
    sinks.write_latent(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), x.alias("x"), y.alias("y"), F.col("label").cast("int").alias("cluster_id"), F.concat(F.lit("C"), "label").alias("label")), path)
    return media.scan_latent(spark.read.parquet(path))


def pictures(spark, sf_dir):
    """The folder of the picture files made from the vectors."""
    folder = f"{shared_dir(spark)}/pictures-{uuid.uuid4().hex}"
    put_files(bitmaps(spark, sf_dir), folder)
    return folder


def numbered(files):
    return files.withColumn("item_id", F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long"))


GREY = f"SELECT vec_id AS item_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {_LEVEL} AS g, {LIGHT} AS l FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(64)) AS i FROM embeddings WHERE vec_id % 7 <> 0)"


@query("S1", "SELECT vec_id AS item_id, 'bmp' AS ext, CASE WHEN vec_id % 7 = 0 THEN 20 ELSE 246 END AS length FROM embeddings")
def s1(spark, sf_dir):
    """Files of a modality, found by name; their content isn't read."""
    return numbered(media.discover(spark, pictures(spark, sf_dir), "image")).select("item_id", "ext", "length")


@query("S2", f"SELECT item_id, 8 AS height, CAST(max(g) FILTER (y = 0 AND x = 0) AS INTEGER) AS first, CAST(sum(g) AS BIGINT) AS total FROM ({GREY}) GROUP BY item_id UNION ALL SELECT vec_id, -1, NULL, NULL FROM embeddings WHERE vec_id % 7 = 0")
def s2(spark, sf_dir):
    """Decoded pictures: height, first byte and the sum of one channel; a broken file has height -1."""
    found = numbered(media.scan_images(spark, pictures(spark, sf_dir)))
    sums = R.pixels(found).groupBy("item_id").agg(F.max(F.when((F.col("y") == 0) & (F.col("x") == 0), F.col("b"))).alias("first"), F.sum("b").alias("total"))
    return found.select("item_id", "height").join(sums, "item_id", "left")


@query("P2", f"SELECT item_id, y, x, round(l, 6) + 0.0 AS light FROM ({GREY})")
def p2(spark, sf_dir):
    """A point for each pixel of the pictures that can be decoded; a grey one has no colour."""
    points = R.lab_points(numbered(media.scan_images(spark, pictures(spark, sf_dir)))).where("abs(p2) < 1 AND abs(p3) < 1")
    return points.select("item_id", "point_id.y", "point_id.x", (F.round("p1", 6) + 0.0).alias("light"))


@query("V1", f"SELECT item_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(round_even(avg(g), 0) AS INTEGER) AS value FROM ({GREY}) GROUP BY ALL")
def v1(spark, sf_dir):
    """Thumbnails of 4 x 4 pixels by area averaging."""
    small = R.resize(numbered(media.scan_images(spark, pictures(spark, sf_dir))), 4, pad=True)
    return R.pixels(small).select("item_id", "y", F.col("x").cast("int").alias("x"), F.col("b").alias("value"))


@query("S3", "SELECT vec_id AS item_id, 8000 AS sr, list_transform(embedding, lambda e: round(floor(CAST(e AS DOUBLE) * 32767) / 32768, 6) + 0.0) AS samples FROM embeddings")
def s3(spark, sf_dir):
    """Sound files are written from the vectors and scanned at their own rate."""
    folder = f"{shared_dir(spark)}/sounds-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 32767).cast("int")).alias("v"))

    def write(batches):
        for batch in batches:
            heads = [struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * len(v), b"WAVE", b"fmt ", 16, 1, 1, 8000, 16000, 2, 16, b"data", 2 * len(v)) for v in batch.column("v").to_pylist()]
            bodies = [struct.pack(f"<{len(v)}h", *v) for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([h + b for h, b in zip(heads, bodies)], pa.binary())], ["item_id", "content"])

    put_files(e.mapInArrow(write, "item_id long, content binary"), folder, "wav")
    found = numbered(media.scan_audio(spark, folder, None))
    return found.select("item_id", "sr", F.transform("samples", lambda x: F.round(x.cast("double"), 6) + 0.0).alias("samples"))


@query("S5", "SELECT r_name AS label, n_name AS term FROM nation JOIN region ON r_regionkey = n_regionkey")
def s5(spark, sf_dir):
    """A dictionary of labels with their terms is written as a file and read."""
    folder = f"{shared_dir(spark)}/dictionary-{uuid.uuid4().hex}"
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entries = both.groupBy("r_name").agg(F.collect_list("n_name").alias("terms"))
    as_map = entries.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "terms"))).alias("m"))  # as many entries as there are regions
    as_map.select(F.to_json("m").alias("value")).coalesce(1).write.text(folder)
    return media.read_dictionary(spark, folder)
