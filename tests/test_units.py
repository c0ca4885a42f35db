"""Hand-computed values, media fixtures written with the standard library, and properties."""

import math
import struct
import wave
import zlib

import numpy as np
import pytest


def write_png(path, rgb):
    h, w = len(rgb), len(rgb[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rgb)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def write_wav(path, channels, rate=8000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(len(channels)), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.stack(channels, axis=1).astype("<i2").tobytes())


def test_media_scan(spark, tmp_path):
    from prismar.operators import raster
    from prismar.sources import media
    from pyspark.sql import functions as F

    (tmp_path / "in" / "sub").mkdir(parents=True)
    write_png(tmp_path / "in" / "a b+c.PNG", [[(10, 20, 30)] * 4] * 2)
    (tmp_path / "in" / "sub" / "bad.png").write_bytes(b"no image")
    (tmp_path / "in" / "notes.txt").write_text("x")
    found = media.discover(spark, str(tmp_path / "in"), "image")
    assert sorted(r.ext for r in found.collect()) == ["png", "png"] and "content" not in found.columns
    images = media.scan_images(spark, str(tmp_path / "in")).where(F.lower("path").endswith(".png"))
    by = {r.path.rsplit("/", 1)[1]: r for r in images.collect()}
    assert by["bad.png"].height == -1 and bytes(by["a b+c.PNG"].data[:3]) == bytes([30, 20, 10])
    small = raster.resize(images.withColumn("item_id", F.lit(1)), 2).collect()
    assert [(r.height, r.width) for r in small] == [(1, 2)]
    with pytest.raises(ValueError):
        media.discover(spark, str(tmp_path), "video")
    with pytest.raises(FileNotFoundError):
        media.require_rows(found.where("false"), "images")


def test_audio_scan(spark, tmp_path):
    from prismar.sources import media

    n = np.arange(8000)
    write_wav(tmp_path / "sine.wav", [10_000 * np.sin(2 * np.pi * 440 * n / 8000)])
    write_wav(tmp_path / "stereo.wav", [np.full(100, 1000), np.full(100, 3000)])
    (tmp_path / "broken.wav").write_bytes(b"RIFF")
    got = {r.path.rsplit("/", 1)[1]: r for r in media.scan_audio(spark, str(tmp_path), 16000, 0.5, True).collect()}
    assert got["broken.wav"].samples is None and got["sine.wav"].sr == 16000
    assert len(got["sine.wav"].samples) == len(got["stereo.wav"].samples) == 8000
    assert got["stereo.wav"].samples[0] == pytest.approx(2000 / 32768)


def test_moments_and_histogram(spark):
    from prismar.operators import points

    df = spark.createDataFrame([(1, v, 5.0, 5.0) for v in (1.0, 2.0, 2.0, 9.0)], "item_id long, p1 double, p2 double, p3 double")
    m = points.moments(df).first()
    assert (m.p1_mean, m.p1_std, m.p1_skew, m.p2_skew) == pytest.approx((3.5, 3.2015621, 1.0970254, 0), abs=1e-6)
    assert points.histogram(df).first().value == 1.0


def test_distances_between_palettes(spark):
    from prismar.operators import points

    one = lambda key, x: spark.createDataFrame([(1, x, 0.0, 0.0, 1.0)], f"{key} long, p1 double, p2 double, p3 double, w double")
    assert points.wasserstein(one("query_id", 0.0), one("item_id", 3.0)).first().distance == pytest.approx(1.0)
    rng = np.random.default_rng(0)
    a, b = rng.random((5, 3)), rng.random((5, 3))
    w = np.full(5, 0.2)
    import itertools

    best = min(sum(np.linalg.norm(a[i] - b[p[i]]) for i in range(5)) / 5 for p in itertools.permutations(range(5)))
    assert points.transport(a, w, b, w) == pytest.approx(best)
    assert points.transport(a, w, b, w) >= np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)) - 1e-9


def test_lbp_of_a_flat_raster(spark):
    from prismar.operators import raster

    flat = spark.createDataFrame([(1, y, x, 1.0) for y in range(3) for x in range(3)], "item_id long, y int, x int, v double")
    codes = {(r.y, r.x): r.code for r in raster.lbp_codes(flat).collect()}
    assert codes[1, 1] == 255 and sum(codes.values()) == 255


def test_spectrogram_peaks_at_its_tone():
    from prismar.operators.audio import mel_spectrogram

    x = np.sin(2 * math.pi * 1000 * np.arange(8000) / 8000)
    m = mel_spectrogram(x, 8000, 256, 64, 32)
    assert m.shape[0] == 32 and m.max() == 255 and m.min() == 0


def test_export_copies_the_selected_files(spark, tmp_path):
    from prismar.sources import media, sinks

    (tmp_path / "in").mkdir()
    for name in ("a b+c.png", "d.png", "e.jpg"):
        (tmp_path / "in" / name).write_bytes(name.encode() * 1000)
    paths = sorted(r.path for r in media.discover(spark, str(tmp_path / "in"), "image").collect())
    selected = spark.createDataFrame([(paths[0],), ("group::g",)], "key string")
    groups = spark.createDataFrame([("g", 5, paths[1:])], "gid string, cursor int, paths array<string>")  # a cursor past the end is the last
    manifest = sinks.export_manifest(selected, groups)
    assert sinks.copy_files(manifest, f"file://{tmp_path}/out") == 2
    written = {p.name.split("_", 1)[1]: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    assert written == {"a b+c.png": b"a b+c.png" * 1000, "e.jpg": b"e.jpg" * 1000}
    assert [r.target for r in sinks.export_manifest(selected, groups, "basename").collect()] == ["a b+c.png"]


def test_embedding_table_round_trip(spark, tmp_path):
    from prismar.sources import sinks

    rows = [(1, "x", "image", [1.0, 2.0]), (2, "y", "audio", None)]
    df = spark.createDataFrame(rows, "item_id long, dataset string, modality string, embedding array<float>")
    sinks.write_embeddings(df, f"{tmp_path}/vectors")
    sinks.write_features(df, "embedding", f"{tmp_path}/features")
    back = spark.read.parquet(f"{tmp_path}/vectors").where("modality = 'image'").collect()
    assert [(r.item_id, r.dataset, r.embedding) for r in back] == [(1, "x", [1.0, 2.0])]
    assert [r.item_id for r in spark.read.parquet(f"{tmp_path}/features").collect()] == [1]


def test_story_is_one_ordered_file(spark, tmp_path):
    from prismar.sources import sinks

    sinks.write_story(spark.createDataFrame([(1, "second"), (0, "first")], "scene int, text string"), f"{tmp_path}/story")
    parts = list((tmp_path / "story").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text() == "1. first\n2. second\n"


def test_labels_and_dictionaries(spark, tmp_path):
    from prismar.sources import media

    (tmp_path / "labels.txt").write_text(" rain \n\nwind\n")
    (tmp_path / "d.json").write_text('{"rain": ["wet", "drops"], "wind": "gust"}')
    (tmp_path / "d.csv").write_text("label,term\nrain, wet \nwind,gust\n")
    names = lambda df: sorted(tuple(r) for r in df.collect())
    assert names(media.read_labels(spark, str(tmp_path / "labels.txt"))) == names(media.read_labels(spark, "rain, wind ,")) == [("rain",), ("wind",)]
    assert media.labels_version(media.read_labels(spark, "rain,wind")) == media.labels_version(media.read_labels(spark, "wind,rain"))
    assert names(media.read_dictionary(spark, str(tmp_path / "d.json"))) == [("rain", "drops"), ("rain", "wet"), ("wind", "gust")]
    assert names(media.read_dictionary(spark, str(tmp_path / "d.csv"))) == [("rain", "wet"), ("wind", "gust")]


def test_pixels_become_lab_points(spark):
    from prismar.operators import raster

    image = [(1, 2, 2, 3, bytes([255, 255, 255] * 3 + [0, 0, 255]))]  # three white pixels and a red one, blue first
    df = spark.createDataFrame(image, "item_id long, height int, width int, nChannels int, data binary")
    got = sorted((round(r.p1), round(r.p2), round(r.p3)) for r in raster.lab_points(df).collect())
    assert got[1:] == [(100, 0, 0)] * 3 and got[0][0] == pytest.approx(53, abs=1) and got[0][1] == pytest.approx(80, abs=1)
    assert raster.lab_points(df, 3).count() == 3


def test_latent_and_feature_tables(spark, tmp_path):
    from prismar.sources import media, sinks

    df = spark.createDataFrame([(1, "a", 1.0, 2.0, 3, "x"), (2, "b", 3.0, 4.0, 5, None)], "item_id long, path string, x double, y double, cluster_id int, label string")
    sinks.write_latent(df, f"{tmp_path}/latent")
    back = media.scan_latent(spark.read.parquet(f"{tmp_path}/latent"))
    assert dict(back.dtypes)["x"] == "float" and sorted((r.item_id, r.x, r.label) for r in back.collect()) == [(1, 1.0, "x"), (2, 3.0, None)]
    assert media.scan_features(spark, f"{tmp_path}/latent", "x").columns == ["item_id", "x"]
    for path, feature in ((f"{tmp_path}/none", "x"), (f"{tmp_path}/latent", "gram")):
        with pytest.raises(media.FeatureAbsent):
            media.scan_features(spark, path, feature)
    vectors = df.selectExpr("item_id", "path", "array(x, y) AS embedding", "CASE WHEN item_id = 1 THEN 'p' ELSE 'q' END AS dataset", "'image' AS modality")
    sinks.write_embeddings(vectors, f"{tmp_path}/vectors")
    found = media.scan_embeddings(spark, f"{tmp_path}/vectors", "q", "image")
    assert [r.item_id for r in found.collect()] == [2]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "isnotnull(dataset" in plan and "PushedFilters: []" in plan


def test_unknown_modality_fails(spark):
    from prismar.operators import encode

    df = spark.createDataFrame([("image", [0.0] * 64), ("video", [0.0] * 64)], "modality string, x array<float>")
    with pytest.raises(Exception, match="unknown modality: video"):
        encode.encode_by_modality(df, {"image": encode.block_means()}, "x", shape=[64]).collect()
    some = spark.createDataFrame([(1, None), (2, "see")], "id long, text string")
    assert sorted((r.id, r.embedding) for r in encode.encode(some, encode.letter_counts("e"), "text").collect()) == [(1, None), (2, [2.0])]


def test_corpus_twins_equal_all_pairs(spark):
    from prismar.operators import groups

    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    dense = rng.normal(size=16) + 0.004 * rng.normal(size=(10_000, 16))  # all within the threshold of each other
    chain = np.stack([np.cos(np.arange(60) * 0.3), np.sin(np.arange(60) * 0.3), *np.zeros((14, 60))], axis=1)  # a ring of links
    x = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), base[:20], dense, chain, np.zeros((2, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99_999, None)], "item_id long, embedding array<double>").repartition(4)
    got = {r.item_id: r.comp for r in groups.corpus_twins(df, 0.05, tile=256).collect()}
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    first = groups.closed(lambda i: (np.round(1 - unit @ unit[i], 9) <= 0.05) & (np.arange(len(x)) != i), len(x))
    first[-2:] = [len(x) - 2, len(x) - 1]  # zero vectors: their two rows are equal, and so one class
    assert {i: got[i] for i in range(len(x) - 2)} == dict(enumerate(first[:-2].tolist()))
    assert got[len(x) - 1] == got[len(x) - 2] == len(x) - 2 and got[99_999] == 99_999


def test_dense_cells_are_cut_into_tiles(spark):
    from prismar.operators import groups
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=8) + 0.01 * rng.normal(size=(3000, 8)), rng.normal(size=(200, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, v array<double>")
    reach = 0.3
    pivots = groups.pivots_of(df, len(x), reach)
    assert (np.sort(pivots[1] @ pivots[1].T, axis=1)[:, -2] < 1 - reach * reach / 8).all()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tiles = groups.deal(df, pivots, reach, 100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tiles.agg(F.max(F.size("ids")), F.sum(F.size("ids"))).first() == (100, len(x))
    assert tiles.groupBy(F.shiftright("tile", 32)).count().count() > 1  # the dense cell is several tasks' too
    n, cores = tiles.count(), tiles.where("core").count()
    assert cores >= 25 and groups.near_tiles(tiles, reach).count() < n * n / 6  # of the dense spot's tiles no two are compared


def test_knn_in_small_tiles_and_blocks(spark):
    from prismar.operators import search

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(80, 4)), np.ones((30, 4))])  # equal vectors tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    q = df.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    whole = sorted(tuple(r) for r in search.knn_join(df, q, 5).collect())
    assert whole == sorted(tuple(r) for r in search.knn_join(df, q, 5, block_rows=3, cells=50).collect())
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 9)
    assert [(i, r, j) for i, r, j, _ in whole] == [(i, r + 1, j) for i in range(0, 110, 10) for r, j in enumerate(sorted(range(110), key=lambda j: (d[i, j], j))[:5])]


def test_vectors_are_compressed(spark, monkeypatch):
    from prismar.operators import cluster, rangefinder

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>")
    for exact in (1024, 10):
        monkeypatch.setattr(rangefinder, "EXACT", exact)
        out, model, kept = cluster.compress(df, 3, extra=4)
        y = np.array([r.compressed for r in sorted(out.collect())])
        assert kept == pytest.approx(1) and np.allclose(((y[:, None] - y[None]) ** 2).sum(axis=2), ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert cluster.compress(df, 50)[1] is None
    stored = out.withColumnRenamed("compressed", "gram")
    query = df.where("item_id = 7").toDF("query_id", "gram")
    best = sorted(cluster.gram_search(stored, query, model, k=3).collect(), key=lambda r: r.rank)
    assert len(best) == 3 and best[0].item_id == 7 and best[0].score == pytest.approx(1)
    with pytest.raises(LookupError):
        cluster.gram_search(df, query)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "item_id long, embedding array<double>")
    flat, model, _ = cluster.compress(same, 2)
    assert all(np.allclose(r.compressed, 0) for r in flat.collect())


def test_range_finder_keeps_nearly_all_that_can_be_kept(spark):
    from prismar.operators import cluster

    rng = np.random.default_rng(4)
    decay = 1 / (1 + np.arange(300)) ** 0.7
    x = (rng.normal(size=(1200, 300)) * decay) @ np.linalg.qr(rng.normal(size=(5000, 300)))[0].T + 0.01 * rng.normal(size=(1200, 5000)) + rng.normal(size=5000)
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "item_id long, embedding array<float>").repartition(5)
    dims = 64
    out, model, kept = cluster.compress(df, dims)
    c = x - x.mean(axis=0)
    whole = np.linalg.svd(c, compute_uv=False) ** 2
    exact, y = whole[:dims].sum() / whole.sum(), np.array([r.compressed for r in out.collect()])
    assert kept == pytest.approx(exact, rel=0.01) and (y * y).sum() / whole.sum() == pytest.approx(exact, rel=0.01)
    assert np.allclose(model["components"] @ model["components"].T, np.eye(dims), atol=1e-8) and np.allclose(model["mean"], x.mean(axis=0), atol=1e-4)


def test_palette_of_a_broken_item_has_a_reason(spark):
    from prismar.operators import points

    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (1, 9.0, 2.0, 3.0), (2, 1.0, None, 0.0)], "item_id long, p1 double, p2 double, p3 double")
    got = {r.item_id: r for r in points.palette_job(df).collect()}
    assert got[1].reason is None and [p.w for p in got[1].dominant] == [0.5, 0.5] and got[1].bins == 1
    assert got[2].reason and got[2].dominant is None and got[2].p1_mean is None


def test_emd_search_equals_all_pairs_and_solves_few(spark):
    from prismar.operators import points

    rng = np.random.default_rng(6)
    bags = []
    for i in range(260):
        n, centre = rng.integers(1, 7), rng.choice([20.0, 120.0, 220.0], 3)
        w = rng.random(n) + 0.05
        bags.append((int(i), np.column_stack([centre + 15 * rng.normal(size=(n, 3)), w / w.sum()]).tolist()))
    bags += [(300 + i, bags[0][1]) for i in range(30)] + [(400, [])]  # ties, and no palette
    items = spark.createDataFrame(bags, "item_id long, palette array<array<double>>").repartition(3)
    asked = items.where("item_id % 40 = 0").withColumnRenamed("item_id", "query_id")
    ranks, report = points.emd_search(items, asked, 5)
    stack = {i: np.array(p) for i, p in bags if p}
    want, far = [], {}
    for q in (i for i in stack if i % 40 == 0):
        found = sorted((points.emd(stack[q], stack[i]), i) for i in stack)
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(found[:5])]
        far[q] = found[-1][0]
    got = sorted(tuple(r) for r in ranks.collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)
    rows = {r.query_id: r for r in report.collect()}
    assert {q: rows[q].furthest for q in far} == pytest.approx(far, abs=2e-6)
    assert sum(r.refined for r in rows.values()) < 0.5 * sum(r.pairs for r in rows.values()) and rows[0].pairs == len(stack)
    scores = {(r.query_id, r.item_id): r.score for r in points.emd_scores(items, asked, 5).collect()}
    assert scores[40, 40] == pytest.approx(1) and len(scores) == len(want)


def test_bounds_enclose_the_exact_distance():
    from prismar.operators import points

    rng = np.random.default_rng(8)
    a, b = (np.concatenate([255 * rng.random((60, 5, 3)), rng.dirichlet(np.ones(5), 60)[..., None]], axis=2) for _ in range(2))
    exact = np.array([points.transport(x[:, :3], x[:, 3], y[:, :3], y[:, 3]) for x, y in zip(a, b)])
    (ca, sa), (cb, sb) = points.centres(a), points.centres(b)
    centre = np.sqrt(((ca - cb) ** 2).sum(axis=1))
    below, above = points.channel_bounds(a, b)
    assert (centre <= below + 1e-9).all() and (below <= exact + 1e-9).all() and (exact <= above + 1e-9).all() and (exact <= centre + sa + sb + 1e-9).all()


def test_dominant_points_of_bags_of_any_size(spark):
    from prismar.operators import palettes

    rng = np.random.default_rng(9)
    centres = np.array([[20.0, 20, 20], [200, 20, 20], [20, 200, 20], [120, 120, 240]])
    own = rng.choice(4, 15_000, p=[0.4, 0.3, 0.2, 0.1])
    big = np.round(centres[own] + 3 * rng.normal(size=(15_000, 3)), 1)
    rows = [(1, *map(float, x)) for x in big] + [(2, 5.0, 5.0, 5.0)] * 7 + [(2, 9.0, 5.0, 5.0)] * 3 + [(3, None, 1.0, 1.0), (3, float("nan"), 1.0, 1.0), (4, 1.0, 2.0, 3.0), (4, float("inf"), 2.0, 3.0)]
    got = {r.item_id: r.dominant for r in palettes.dominant_all(spark.createDataFrame(rows, "item_id long, p1 double, p2 double, p3 double").repartition(3), k=4).collect()}
    assert sorted(got) == [1, 2, 4] and [(c.p1, c.w) for c in got[2]] == [(5.0, 0.7), (9.0, 0.3)] and [tuple(c) for c in got[4]] == [(1.0, 2.0, 3.0, 1.0)]
    for j, c in enumerate(got[1]):
        assert np.allclose([c.p1, c.p2, c.p3], big[own == j].mean(axis=0), atol=0.5) and c.w == pytest.approx((own == j).mean(), abs=0.01)


def wav(samples, rate, width=2):
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"".join(int(v * ((1 << (8 * width - 1)) - 1)).to_bytes(width, "little", signed=True) for v in samples))
    return out.getvalue()


def test_resampling_keeps_what_fits_and_drops_what_does_not():
    from prismar.sources.media import decode_wav

    t = np.arange(24_000) / 48_000
    for tone, kept in ((1000, 1.0), (5000, 1.0), (15_000, 0.0)):
        rate, x = decode_wav(wav(0.5 * np.sin(2 * math.pi * tone * t), 48_000), 16_000, None, False)
        power = np.mean(np.square(x[200:-200])) / 0.125
        assert rate == 16_000 and len(x) == 8000 and (power < 0.01 if not kept else power == pytest.approx(1, abs=0.01))
    rate, x = decode_wav(wav(0.5 * np.sin(2 * math.pi * 440 * np.arange(8820) / 44_100), 44_100), 48_000, None, False)
    assert rate == 48_000 and np.allclose(x[300:-300], 0.5 * np.sin(2 * math.pi * 440 * np.arange(300, len(x) - 300) / 48_000), atol=0.002)


def test_samples_of_three_bytes():
    from prismar.sources.media import decode_wav

    values = [0.0, 0.5, -0.5, 0.999, -0.999]
    assert np.allclose(decode_wav(wav(values, 8000, 3), None, None, False)[1], values, atol=1e-5)


def test_smoothing_a_chain_lowers_the_energy_each_round(spark):
    from prismar.operators import smoothing

    start = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.0, 0.0), (2, 0.0, 6.0), (3, 5.0, 5.0)], "item_id long, x double, y double")
    graph = spark.createDataFrame([(a, b, 1.0) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))], "a long, b long, weight double")
    one = {r.item_id: (r.x, r.y) for r in smoothing.smooth(start, graph, 0.5, rounds=1).collect()}
    assert one == {0: (4.5, 0.0), 1: (4.5, 1.5), 2: (4.5, 3.0), 3: (5.0, 5.0)}
    trace = []
    many = {r.item_id: (r.x, r.y) for r in smoothing.smooth(start, graph, 0.5, rounds=30, tolerance=1e-3, trace=trace).collect()}
    assert len(trace) > 3 and all(b < a for a, b in zip(trace, trace[1:])) and trace[-1] == pytest.approx(trace[-2], rel=1e-4)
    assert many[1][0] == pytest.approx(0.5 * 9 + 0.25 * (many[0][0] + many[2][0]), abs=0.01) and many[3] == (5.0, 5.0)


def test_smooth_layout_draws_neighbours_together(spark):
    from prismar.operators import cluster, smoothing

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, (np.eye(8)[i % 2] + 0.4 * rng.normal(size=8)).tolist()) for i in range(60)], "item_id long, embedding array<double>")
    spread = lambda rows: sum(np.var([[r.x, r.y] for r in rows if r.item_id % 2 == g], axis=0).sum() for g in (0, 1))
    assert spread(smoothing.smooth_layout(df, 2, 5, rounds=4).collect()) < 0.7 * spread(cluster.layout(df, 2).collect())


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    from prismar.sources import layout

    for n in ("one", "two"):
        rows = spark.range(2000).selectExpr("id AS item_id", f"id * 2 AS {n}")
        layout.write_bucketed(rows, f"bucketed_{n}", 4, path=f"{tmp_path}/{n}")
    both = layout.bucketed(spark, "bucketed_one").join(layout.bucketed(spark, "bucketed_two").hint("merge"), "item_id")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and both.count() == 2000
    grouped = both.groupBy("item_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in grouped
    for n in ("one", "two"):
        layout.drop(spark, f"bucketed_{n}")


def test_a_failure_anywhere_is_a_row_of_the_rejects(spark, tmp_path):
    from prismar.operators import images, raster

    pixels = bytes([255, 255, 255] * 3 + [0, 0, 255])
    rows = [(1, "a", 2, 2, 3, pixels), (2, "b", -1, -1, -1, b""), (3, "c", 2, 2, 3, b"short"), (4, "d", 2, 2, 1, bytes(4)), (5, None, None, None, None, None), (6, "f", 1, 1, 7, bytes(7))]
    df = spark.createDataFrame(rows, "item_id long, path string, height int, width int, nChannels int, data binary")
    found, rejects = images.palette_sink(df, f"file://{tmp_path}/out", colors=2)
    good = {r.item_id: r for r in found.collect()}
    assert sorted(good) == [1, 4] and {r.item_id: r.stage for r in rejects.collect()} == {2: "decode", 3: "decode", 5: "decode", 6: "decode"}
    assert [round(c.w, 2) for c in good[1].dominant] == [0.75, 0.25] and good[4].p1_mean == 0 and sum(v * v for v in good[1].histogram.values()) == pytest.approx(1)
    by_columns = sorted((r.p1, r.p2, r.p3) for r in raster.lab_points(df.where("item_id = 1")).collect())
    assert np.allclose(by_columns, sorted(map(tuple, images.lab(np.frombuffer(pixels, np.uint8).reshape(-1, 3).astype(float)))))


def test_pieces_of_a_spectrogram_are_the_whole(spark):
    from prismar.operators import audio

    rng = np.random.default_rng(3)
    signals = {1: rng.normal(size=3001), 2: np.sin(np.arange(700) / 5), 3: rng.normal(size=20), 4: rng.normal(size=128 * 4)}
    rows = [(k, t, float(v)) for k, x in signals.items() for t, v in enumerate(x)] + [(1, 10**6, None), (9, 1, None)]
    df = spark.createDataFrame(rows, "user_id long, ts long, value double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = audio.spectrogram_of_rows(df, "user_id", ("ts",), "value", 8000, n_fft=64, hop=16, mels=12, frames=8).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.user_id for r in got} == set(signals)
    for k, x in signals.items():
        own = [np.array(r.mel) for r in sorted(got, key=lambda r: r.piece) if r.user_id == k]
        assert len(own) > 1 or len(x) < 100
        assert np.array_equal(np.concatenate(own, axis=1), audio.mel_spectrogram(x, 8000, 64, 16, 12))


@pytest.mark.parametrize("odd", [None, [1.0, float("nan")], [1.0, float("inf")], [1.0, None], [1.0]])
def test_everything_is_one_cluster_where_no_fit_can_be_made(spark, odd):
    from prismar.operators import cluster

    rows = [(i, [float(i % 2), 1.0 - i % 2]) for i in range(6)]
    schema = "item_id long, embedding array<double>"
    assert len({r.cluster_id for r in cluster.kmeans(spark.createDataFrame(rows, schema), 2).collect()}) == 2
    got = cluster.kmeans(spark.createDataFrame([*rows, (9, odd)], schema), 2).collect()
    assert {r.cluster_id for r in got} == {0} and len(got) == 7


@pytest.mark.parametrize("block", [None, 2])
def test_fallback_search_ranks_every_item(spark, block, monkeypatch):
    from prismar.operators import search
    from pyspark.sql import functions as F

    e = np.random.default_rng(3).normal(size=(60, 4))
    e[7] = e[8]
    items = spark.createDataFrame([(k, v.tolist(), v[:2].tolist() if k % 3 else None) for k, v in enumerate(e)], "item_id long, a array<double>, b array<double>")
    queries = items.where("item_id in (1, 2, 4)").select(F.col("item_id").alias("query_id"), "a", "b", F.when(F.col("item_id") == 1, "a").otherwise("none").alias("wanted"))
    if block:
        whole = search.by_blocks
        monkeypatch.setattr(search, "by_blocks", lambda q, key, work, rows=None: whole(q, key, work, block))
    found = search.with_fallback_method(items, queries, "b").collect()
    cosine = lambda x, y: round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9)
    want = []
    for q, method, width, some in ((1, "a", 4, range(60)), *((q, "b", 2, [k for k in range(60) if k % 3]) for q in (2, 4))):
        scores = sorted((-cosine(e[q, :width], e[k, :width]), k) for k in some)
        want += [(q, r, k, -s, method) for r, (s, k) in enumerate(scores, 1)]
    assert sorted((r.query_id, r.rank, r.item_id, r.score, r.method_used) for r in found) == sorted(want)
    assert search.with_fallback_method(items, queries.where("false"), "b").collect() == []
    assert search.with_fallback_method(items, queries, "b", 5).count() == 15


def test_channel_distances_rank_every_item(spark):
    from prismar.operators import points

    rng = np.random.default_rng(5)
    bags = {k: np.concatenate([rng.integers(0, 9, (3, 3)), np.full((3, 1), 1 / 3)], axis=1) for k in range(45)}
    bags[11] = bags[10]
    rows = [(k, *map(float, p)) for k, bag in bags.items() for p in bag]
    items = spark.createDataFrame(rows, "item_id long, p1 double, p2 double, p3 double, w double")
    queries = items.where("item_id < 2").withColumnRenamed("item_id", "query_id")
    want = []
    for q in (0, 1):  # of equal weights: the mean gap of the sorted values
        d = {k: math.floor(sum(np.abs(np.sort(bags[q][:, c]) - np.sort(bag[:, c])).mean() for c in range(3)) / 3 * 1e6 + 0.5) / 1e6 for k, bag in bags.items()}
        want += [(q, r, k, d[k]) for r, k in enumerate(sorted(d, key=lambda k: (d[k], k)), 1)]
    found = [(r.query_id, r.rank, r.item_id, r.distance) for r in points.wasserstein(queries, items, cells=200).collect()]
    assert sorted(found) == sorted(want)
    assert sorted(tuple(r) for r in points.wasserstein(queries, items, 7).collect()) == sorted(r for r in want if r[1] <= 7)
