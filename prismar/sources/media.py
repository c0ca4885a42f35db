"""Media discovery, image and audio scans, label lists, dictionaries, catalogue and typed scans."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from prismar.functions.strings import extension
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each modality.
EXTENSIONS = {"image": ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"), "audio": ("wav", "mp3", "flac", "ogg", "m4a", "aac")}
FEATURES = ("palette", "style")


def discover(spark: SparkSession, path: str, modality: str) -> DataFrame:
    """path, ext, length, modified of the files of a modality, found recursively; the content isn't read. Case doesn't matter."""
    if modality not in EXTENSIONS:
        raise ValueError(f"unknown modality: {modality}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.substring(extension(F.col("path")), 2, 10).alias("ext"), "length", F.col("modificationTime").alias("modified"))
    return out.where(F.col("ext").isin(*EXTENSIONS[modality]))


def require_rows(found: DataFrame, what: str) -> DataFrame:
    if found.limit(1).count() == 0:
        raise FileNotFoundError(f"no {what} found")
    return found


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, nChannels, data (BGR); a file that can't be decoded has height -1."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    origin = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))
    return raw.select(F.regexp_replace(origin, "^file:/*", "file:/").alias("path"), "height", "width", "nChannels", "data")


def resample(x: np.ndarray, rate: int, target: int, zeros: int = 24, piece: int = 1 << 14) -> np.ndarray:
    """`x` at another rate, by a windowed sinc that passes nothing above half of the lower rate. The filter has one phase for each of target / gcd places between samples."""
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    cut = min(1.0, target / rate) * 0.95  # the rest is the filter's slope
    half = int(np.ceil(zeros / cut))
    taps = np.arange(-half, half + 1)
    at = taps[None] - np.arange(up)[:, None] / up
    window = np.where(np.abs(at) <= half, np.i0(8.6 * np.sqrt(np.maximum(1 - (at / half) ** 2, 0))) / np.i0(8.6), 0)
    phases = cut * np.sinc(cut * at) * window
    phases /= phases.sum(axis=1, keepdims=True)
    padded, n = np.pad(x, half, mode="edge"), round(len(x) * target / rate)  # so that a level stays one to the ends
    out = np.empty(n)
    for a in range(0, n, piece):
        k = np.arange(a, min(n, a + piece)) * down
        out[a : a + piece] = (padded[np.minimum(k // up, len(x) - 1)[:, None] + taps + half] * phases[k % up]).sum(axis=1)
    return out


def decode_wav(content: bytes, target: int | None, seconds: float | None, pad: bool) -> tuple[int, list[float]] | None:
    try:
        with wave.open(io.BytesIO(content)) as w:
            rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 3:  # three bytes, the sign in the last one
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = b[:, 0] | b[:, 1] << 8 | b[:, 2].astype(np.int8).astype(np.int32) << 16
    else:
        values = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
    x = values.astype(float).reshape(-1, channels).mean(axis=1)
    x = (x - 128) / 128 if width == 1 else x / (1 << (8 * width - 1))
    if target and target != rate and len(x):
        x, rate = resample(x, rate, target), target
    if seconds is not None:
        n = int(seconds * rate)
        x = np.pad(x[:n], (0, max(0, n - len(x)) if pad else 0))
    return rate, x.astype(np.float32).tolist()


def scan_audio(spark: SparkSession, path: str, target: int | None = 48000, seconds: float | None = None, pad: bool = False) -> DataFrame:
    """path, sr, samples (mono floats) of PCM WAV files; null samples where a file can't be decoded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(extension(F.col("path")) == ".wav")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [decode_wav(c, target, seconds, pad) or (None, None) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["path", "sr", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, sr int, samples array<float>")


def labels_of(lines: DataFrame) -> DataFrame:
    """label of trimmed, non-empty lines (column value)."""
    return lines.select(F.trim("value").alias("label")).where("label != ''")


def read_labels(spark: SparkSession, source: str) -> DataFrame:
    """A text file, a label a line, or an inline list with commas."""
    if "," in source or "/" not in source:
        return labels_of(spark.range(1).select(F.explode(F.split(F.lit(source), ",")).alias("value")))
    return labels_of(spark.read.text(source))


def labels_version(labels: DataFrame) -> str:
    """md5 over the (small) sorted label list."""
    return labels.agg(F.md5(F.concat_ws("\n", F.array_sort(F.collect_list("label")))).alias("v")).first().v


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """label, term from JSON {label: term or [terms]} or a CSV of label,term."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True).select(F.trim("label").alias("label"), F.trim("term").alias("term")).where("term != ''")
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "raw"))
    terms = F.coalesce(F.from_json("raw", "array<string>"), F.array("raw"))
    return entries.select("label", F.explode(terms).alias("term"))


class FeatureAbsent(LookupError):
    """A data set has no table of the feature asked for, or the table has no such column."""


def scan_features(spark: SparkSession, path: str, *features: str) -> DataFrame:
    """item_id and the named features of a written table; only their columns are read."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FeatureAbsent(f"no feature table at {path}") from e
    missing = [f for f in features if f not in found.columns]
    if missing:
        raise FeatureAbsent(f"{path} has no {', '.join(missing)}")
    return found.select("item_id", *features)


def scan_embeddings(spark: SparkSession, path: str, dataset: str, modality: str) -> DataFrame:
    """item_id, path and embedding of one data set and modality; other partitions aren't listed for reading."""
    found = spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("modality") == modality))
    return found.drop("dataset", "modality")


def catalogue(names: DataFrame) -> DataFrame:
    """name, modality, dims, label: data sets that have both a latent table and an index among file names (column file_name)."""
    latent, index = r"^latent_space_(.+)_(image|audio)_([23])d", r"^index_(.+)_(image|audio)\."
    a = names.select(*(F.regexp_extract("file_name", latent, k).alias(n) for k, n in ((1, "name"), (2, "modality"), (3, "dims")))).where("name != ''")
    b = names.select(*(F.regexp_extract("file_name", index, k).alias(n) for k, n in ((1, "name"), (2, "modality")))).where("name != ''")
    out = a.distinct().join(b.distinct(), ["name", "modality"]).withColumn("dims", F.col("dims").cast("int"))
    return out.withColumn("label", F.concat_ws("::", "name", F.concat("dims", F.lit("d")), "modality")).orderBy("label")


def availability(sets: DataFrame, features: DataFrame) -> DataFrame:
    """The catalogue with has_palette and has_style from a listing (name, feature)."""
    have = features.groupBy("name").agg(*(F.max((F.col("feature") == f).cast("int")).alias(f"__{f}") for f in FEATURES))
    return sets.join(have, "name", "left").select(sets["*"], *(F.coalesce(F.col(f"__{f}") == 1, F.lit(False)).alias(f"has_{f}") for f in FEATURES))


def scan_latent(raw: DataFrame) -> DataFrame:
    casts = {c: "float" for c in ("x", "y", "z") if c in raw.columns} | {c: "string" for c in ("label", "path") if c in raw.columns}
    return raw.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})
