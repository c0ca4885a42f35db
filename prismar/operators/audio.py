"""Waveform envelopes and mel spectrograms (V2, V3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from prismar.operators.cuts import cut
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def envelope(samples: Column, width: int) -> Column:
    """`width` evenly spaced samples, divided by the largest magnitude (zeros stay)."""
    x = samples.cast("array<double>")
    peak = F.array_max(F.transform(x, F.abs))
    place = lambda i: F.floor(i * (F.size(x) - 1) / max(1, width - 1)).cast("int") + 1
    return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.element_at(x, place(i)) / F.when(peak > 0, peak).otherwise(1.0)))


def envelope_of_rows(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    """key, envelope as above, of samples that are rows: numbered in order by a window that spills, of which `width` a key are gathered."""
    w = Window.partitionBy(key)
    numbered = rows.withColumn("__n", F.row_number().over(w.orderBy(order)) - 1).withColumn("__size", F.count(F.lit(1)).over(w)).withColumn("__peak", F.max(F.abs(F.col(value))).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.floor(i * (F.col("__size") - 1) / max(1, width - 1)).cast("int"))
    places = numbered.withColumn("__w", wanted).where(F.array_contains("__w", F.col("__n"))).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    picked = places.where(F.element_at("__w", F.col("__i") + 1) == F.col("__n"))
    samples = picked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__i", (F.col(value) / F.when(F.col("__peak") > 0, F.col("__peak")).otherwise(1.0)).alias("x")))).alias("s"))
    return samples.select(key, F.transform("s", lambda s: s["x"]).alias("envelope"))


def mel_filters(rate: int, n_fft: int, mels: int) -> np.ndarray:
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = to_hz(np.linspace(to_mel(0), to_mel(rate / 2), mels + 2))
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up, down = (f - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.clip(np.minimum(up, down), 0, None) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_decibels(frames: np.ndarray, rate: int, n_fft: int, mels: int) -> np.ndarray:
    """mels x frames: power mel of windowed frames (a row each), in decibels."""
    power = mel_filters(rate, n_fft, mels) @ (np.abs(np.fft.rfft(frames * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2).T
    return 10 * np.log10(np.maximum(power, 1e-10))


def scaled(db: np.ndarray, low: float, high: float) -> np.ndarray:
    """0..255 between the lowest and the highest value, 80 below the highest at most; low bands last."""
    low = max(low, high - 80)
    return np.rint((np.maximum(db, low) - low) / (high - low if high > low else 1) * 255).astype(int)[::-1]


def mel_spectrogram(x: np.ndarray, rate: int, n_fft: int = 1024, hop: int = 256, mels: int = 96) -> np.ndarray:
    """mels x frames of 0..255, low bands last: power mel in decibels below its peak (80 at most), min-max scaled."""
    padded = np.pad(x, n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    db = mel_decibels(np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop], rate, n_fft, mels)
    return scaled(db, db.min(), db.max())


def numbered_rows(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """`rows` with n, the number of each in its key's order (from 0), and total, its key's rows. Rows are dealt by range and counted in the tasks, so that a key with
    most of the rows is many tasks'."""
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumns({"part": F.spark_partition_id(), "in_part": F.monotonically_increasing_id()})
    table = cut(dealt, "numbered")
    sizes = table.groupBy(key, "part").agg(F.count(F.lit(1)).alias("size"), F.min("in_part").alias("first"))
    own = Window.partitionBy(key)
    before = F.coalesce(F.sum("size").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(key, "part", "first", before.alias("before"), F.sum("size").over(own).alias("total"))
    return table.join(starts, [key, "part"]).withColumn("n", F.col("in_part") - F.col("first") + F.col("before")).drop("part", "in_part", "first", "before")


def spectrogram_of_rows(rows: DataFrame, key: str, order: tuple[str, ...], value: str, rate: int, n_fft: int = 1024, hop: int = 256, mels: int = 96, frames: int = 256) -> DataFrame:
    """key, piece, mel: what mel_spectrogram() gives for each key's samples (rows in `order`), `frames` columns a piece; pieces side by side are the whole.

    A task holds the samples of one piece and a window's length to either side; a signal of any length is never brought together. Null samples are left out.
    """
    span, edge = frames * hop, n_fft
    some = numbered_rows(rows.where(F.col(value).isNotNull()).select(key, *order, F.col(value).cast("double").alias("x")), key, *order)
    last = F.floor(F.floor(F.col("total") / hop) / frames)
    low, high = F.greatest(F.lit(0), F.floor((F.col("n") - edge) / span)), F.least(last, F.floor((F.col("n") + edge) / span))
    dealt = some.where(low <= high).select(key, F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("piece"), "n", "x", "total")

    def transform(group: tuple, found: pa.Table) -> pa.Table:
        n, x, total = (found.column(c).to_numpy() for c in ("n", "x", "total"))
        piece, total, order_ = group[1].as_py(), int(total[0]), np.argsort(n)
        n, x = n[order_], x[order_]
        at = np.arange(piece * frames, min((piece + 1) * frames, 1 + total // hop))[:, None] * hop - n_fft // 2 + np.arange(n_fft)
        inside = (at >= 0) & (at < total)
        at = np.where(at < 0, -at, np.where(at >= total, 2 * (total - 1) - at, at))
        if total <= n_fft // 2:
            at = np.where(inside, at, n[0])
        signal = x[np.clip(at - n[0], 0, len(x) - 1)]
        db = mel_decibels(signal if total > n_fft // 2 else np.where(inside, signal, 0.0), rate, n_fft, mels)
        return pa.Table.from_pydict({key: [group[0].as_py()], "piece": [piece], "db": [db.ravel()], "low": [db.min()], "high": [db.max()]}, kind)

    kind = pa.schema([(key, pa.int64()), ("piece", pa.int64()), ("db", pa.list_(pa.float64())), ("low", pa.float64()), ("high", pa.float64())])
    pieces = cut(dealt.withColumn(key, F.col(key).cast("long")).groupBy(key, "piece").applyInArrow(transform, f"{key} long, piece long, db array<double>, low double, high double"), "pieces")
    ends = pieces.groupBy(key).agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scaled(np.array(d).reshape(mels, -1), low, high).tolist() for d, low, high in zip(*(batch.column(c).to_pylist() for c in ("db", "low", "high")))]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("piece"), pa.array(out, pa.list_(pa.list_(pa.int32())))], [key, "piece", "mel"])

    return pieces.drop("low", "high").join(ends, key).select(key, "piece", "db", "low", "high").mapInArrow(scale, f"{key} long, piece long, mel array<array<int>>")


def spectrograms(audio: DataFrame, **options) -> DataFrame:
    """item_id, mel (array of bands) from item_id, sr, samples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [mel_spectrogram(np.array(s, float), r, **options).tolist() if s else None for r, s in zip(batch.column("sr").to_pylist(), batch.column("samples").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["item_id", "mel"])

    return audio.select(F.col("item_id").cast("long").alias("item_id"), "sr", "samples").mapInArrow(run, "item_id long, mel array<array<int>>")
