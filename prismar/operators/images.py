"""Palette features straight from decoded images, with a table of rejects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from prismar.functions.colors import TO_XYZ, WHITE
from prismar.operators.points import BINS, CHANNELS, COLORS, POINTS, lloyd
from prismar.operators.raster import downscale
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONGEST = 128
MOMENTS = [f"{c}_{n}" for c in CHANNELS for n in ("mean", "std", "skew")]
COLUMNS = f"kind string, item_id long, path string, histogram map<int,double>, dominant array<struct<p1:double,p2:double,p3:double,w:double>>, {', '.join(f'{m} double' for m in MOMENTS)}, stage string, error string"


class Rejected(ValueError):
    """An image that a stage can't use."""

    def __init__(self, stage: str, error: str):
        super().__init__(error)
        self.stage = stage


def lab(bgr: np.ndarray) -> np.ndarray:
    """n x 3 CIELAB values of 8-bit pixels, rounded on the 8-bit grid as the column form does."""
    x = bgr[:, ::-1] / 255.0
    linear = np.where(x > 0.04045, ((x + 0.055) / 1.055) ** 2.4, x / 12.92)
    t = linear @ np.array(TO_XYZ).T / np.array(WHITE)
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[:, 1] > 0.008856, 116 * f[:, 1] - 16, 903.3 * t[:, 1])
    grid = lambda c: np.clip(np.floor(c + 0.5), 0, 255)
    return np.stack([grid(light * 255 / 100) * 100 / 255, grid(500 * (f[:, 0] - f[:, 1]) + 128) - 128, grid(200 * (f[:, 1] - f[:, 2]) + 128) - 128], axis=1)


def decoded(height: int, width: int, channels: int, data: bytes | None) -> np.ndarray:
    """The image as height x width x 3."""
    if height is None or height <= 0 or not width or width <= 0:
        raise Rejected("decode", "the file can't be decoded")
    if channels not in (1, 3, 4) or data is None or len(data) != height * width * channels:
        raise Rejected("decode", f"{channels} channels and {0 if data is None else len(data)} bytes for {height} x {width}")
    image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(image, 3, axis=2) if channels == 1 else image[..., :3]


def features(image: np.ndarray, colors: int, most: int, seed: int) -> dict:
    """Sparse unit histogram, dominant points and moments of one image."""
    points = lab(downscale(image, LONGEST).reshape(-1, 3).astype(float))
    if len(points) > most:
        points = points[np.sort(np.random.default_rng(seed).choice(len(points), most, replace=False))]
    if not np.isfinite(points).all():
        raise Rejected("points", "a point has a value that isn't a number")
    scaled = np.column_stack([points[:, 0] * 255 / 100, points[:, 1:] + 128])
    cell = np.minimum(np.floor(scaled / (256 / BINS)), BINS - 1).astype(int) @ np.array([BINS * BINS, BINS, 1])
    bins, n = np.unique(cell, return_counts=True)
    centres, share = lloyd(points[np.lexsort(points.T)], colors, 3, 100, seed)
    order = sorted(np.flatnonzero(share), key=lambda j: (-share[j], *centres[j]))
    out = {"histogram": list(zip(bins.tolist(), (n / np.sqrt((n * n).sum())).tolist())), "dominant": [dict(zip((*CHANNELS, "w"), (*map(float, centres[j]), float(share[j])))) for j in order]}
    mean, std = points.mean(axis=0), points.std(axis=0)
    skew = np.where(std > 1e-8, ((points - mean) ** 3).mean(axis=0) / np.where(std > 1e-8, std, 1) ** 3, 0.0)
    return out | {f"{c}_{name}": float(v[k]) for name, v in (("mean", mean), ("std", std), ("skew", skew)) for k, c in enumerate(CHANNELS)}


def palette_rows(images: DataFrame, colors: int = COLORS, most: int = POINTS, seed: int = 42) -> DataFrame:
    """A row for each image (item_id, path, height, width, nChannels, data): kind `features` with all palette features, or `rejects` with the stage that failed and why."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                rows = []
                for r in batch.slice(at, 16).to_pylist():
                    own = {"item_id": r["item_id"], "path": r["path"]}
                    try:
                        own |= {"kind": "features"} | features(decoded(r["height"], r["width"], r["nChannels"], r["data"]), colors, most, seed)
                    except Rejected as e:
                        own |= {"kind": "rejects", "stage": e.stage, "error": str(e)}
                    except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                        own |= {"kind": "rejects", "stage": "features", "error": f"{type(e).__name__}: {e}"}
                    rows.append(own)
                yield pa.RecordBatch.from_pylist(rows, schema)

    point = pa.struct([(c, pa.float64()) for c in (*CHANNELS, "w")])
    schema = pa.schema([("kind", pa.string()), ("item_id", pa.int64()), ("path", pa.string()), ("histogram", pa.map_(pa.int32(), pa.float64())), ("dominant", pa.list_(point)), *((m, pa.float64()) for m in MOMENTS), ("stage", pa.string()), ("error", pa.string())])
    return images.select(F.col("item_id").cast("long").alias("item_id"), "path", "height", "width", "nChannels", "data").mapInArrow(run, COLUMNS)


def palette_sink(images: DataFrame, target: str, **options) -> tuple[DataFrame, DataFrame]:
    """(features, rejects): both written by one pass over the images, to two folders of `target`; so a failure anywhere in the chain is a row."""
    spark: SparkSession = images.sparkSession
    palette_rows(images, **options).write.mode("overwrite").partitionBy("kind").parquet(target)
    names = [c.rsplit(" ", 1)[0] for c in ("stage", "error")]
    written = spark.read.option("basePath", target).schema(COLUMNS.removeprefix("kind string, ") + ", kind string").parquet(target)
    return written.where("kind = 'features'").drop("kind", *names), written.where("kind = 'rejects'").select("item_id", "path", *names)
