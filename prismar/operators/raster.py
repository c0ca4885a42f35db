"""Raster and feature-map signatures over long tables (item_id, y, x, v), and resizing in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from prismar.functions.colors import rgb_to_lab
from prismar.operators.points import POINTS, subsample
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, ORIENTATIONS = 4, 16
#: Sobel kernels by (dy, dx): (weight in x, weight in y).
SOBEL = {(-1, -1): (-1, -1), (-1, 0): (0, -2), (-1, 1): (1, -1), (0, -1): (-2, 0), (0, 1): (2, 0), (1, -1): (-1, 1), (1, 0): (0, 2), (1, 1): (1, 1)}
#: Neighbour offsets (dy, dx) of bits 0..7: from +x by rising angle, y downwards.
NEIGHBOURS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def area_weights(n: int, m: int) -> np.ndarray:
    """m x n weights of box averaging n samples into m."""
    edge = np.linspace(0, n, m + 1)
    cover = np.clip(np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n)), 0, None)
    return cover / cover.sum(axis=1, keepdims=True)


def downscale(image: np.ndarray, longest: int) -> np.ndarray:
    """Area averaging to a longest side; never upwards."""
    h, w = image.shape[:2]
    scale = longest / max(h, w)
    if scale >= 1:
        return image
    rows, cols = area_weights(h, max(1, round(h * scale))), area_weights(w, max(1, round(w * scale)))
    return np.rint(np.einsum("ih,hwc,jw->ijc", rows, image.astype(float), cols)).astype(np.uint8)


def letterbox(image: np.ndarray, side: int) -> np.ndarray:
    small = downscale(image, side)
    out = np.zeros((side, side, image.shape[2]), np.uint8)
    y, x = (side - small.shape[0]) // 2, (side - small.shape[1]) // 2
    out[y : y + small.shape[0], x : x + small.shape[1]] = small
    return out


def resize(images: DataFrame, longest: int, pad: bool = False) -> DataFrame:
    """Rows (item_id, height, width, nChannels, data: BGR bytes) made smaller, or letterboxed to a square; broken rows are left out."""
    kind = "item_id long, height int, width int, nChannels int, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["height"] and r["height"] > 0:
                    x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                    x = letterbox(x, longest) if pad else downscale(x, longest)
                    out.append({"item_id": r["item_id"], "height": x.shape[0], "width": x.shape[1], "nChannels": x.shape[2], "data": x.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("item_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary())]))

    return images.select("item_id", "height", "width", "nChannels", "data").mapInArrow(run, kind)


def pixels(images: DataFrame) -> DataFrame:
    """item_id, y, x, b, g, r of (downscaled) images."""
    cells = F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1))
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), F.col("i") * F.col("nChannels") + k, F.lit(1))), 16, 10).cast("int")
    rows = images.where("height > 0").withColumn("i", cells)
    return rows.select("item_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), *(F.when(F.col("nChannels") >= 3, byte(k)).otherwise(byte(1)).alias(n) for k, n in ((1, "b"), (2, "g"), (3, "r"))))


def lab_points(images: DataFrame, most: int = POINTS) -> DataFrame:
    """item_id, point_id, p1, p2, p3: the CIELAB values of at most `most` pixels of each (downscaled) image, the same ones at each run."""
    light, a, b = rgb_to_lab(*(F.col(c).cast("double") for c in ("r", "g", "b")))
    rows = pixels(images).select("item_id", F.struct("y", "x").alias("point_id"), light.alias("p1"), a.alias("p2"), b.alias("p3"))
    return subsample(rows, most)


def block_mean(raster: DataFrame, factor: int) -> DataFrame:
    return raster.groupBy("item_id", F.floor(F.col("y") / factor).alias("y"), F.floor(F.col("x") / factor).alias("x")).agg(F.avg("v").alias("v"))


def by_image(raster: DataFrame, fields: str, work: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """item_id and the columns that `work` gives for each item's pixels (a 2-D array), a row for each of their places.

    One exchange brings an item's pixels (item_id, y, x, v) together; images are made smaller first (P1), so an item is bounded. A pixel that
    isn't there counts as 0.
    """
    whole = raster.where("v is not null").groupBy("item_id").agg(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, ends = batch.column("p").flatten(), batch.column("p").offsets.to_numpy()
            y, x, v = (p.field(k).to_numpy() for k in range(3))
            found, sizes = [], []
            for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0]):
                image = np.zeros((y[a:b].max() + 1, x[a:b].max() + 1))
                image[y[a:b], x[a:b]] = v[a:b]
                found.append(work(image))
                sizes.append(len(found[-1][0]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("item_id").to_numpy(), sizes)), *(pa.array(np.concatenate(c)) for c in zip(*found))], ["item_id", *names])

    names = [f.split()[0] for f in fields.split(", ")]
    return whole.select(F.col("item_id").cast("long").alias("item_id"), "p").mapInArrow(run, f"item_id long, {fields}")


def shifted(image: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """Each pixel's neighbour at (dy, dx); beyond the border the image is reflected without repeating its edge."""
    h, w = image.shape
    y, x = (np.abs(np.arange(n) + d) for n, d in ((h, dy), (w, dx)))
    return image[np.where(y < h, y, 2 * h - 2 - y) % h][:, np.where(x < w, x, 2 * w - 2 - x) % w]


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = {o: shifted(image, *o) for o in SOBEL}
    return tuple(sum(ws[k] * near[o] for o, ws in SOBEL.items() if ws[k]) for k in (0, 1))


def places(image: np.ndarray) -> list[np.ndarray]:
    y, x = np.indices(image.shape, np.int32)
    return [y.ravel(), x.ravel()]


def cells(image: np.ndarray) -> np.ndarray:
    """Index of the GRID x GRID cell of each pixel; -1 in the rest rows and columns, and where the image has fewer pixels than cells."""
    h, w = image.shape
    if h < GRID or w < GRID:
        return np.full(image.shape, -1)
    y, x = np.arange(h) // (h // GRID), np.arange(w) // (w // GRID)
    return np.where((y < GRID)[:, None] & (x < GRID), y[:, None] * GRID + x, -1)


def cell_sums(cell: np.ndarray, bins: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """GRID^2 x n sums of `weights`."""
    inside = cell >= 0
    return np.bincount(cell[inside] * n + bins[inside], weights=weights[inside], minlength=GRID * GRID * n).reshape(-1, n)


def listed(values: np.ndarray) -> tuple[np.ndarray, ...]:
    """cell, bin and value of what isn't 0."""
    cell, place = np.nonzero(values > 0)
    return cell.astype(np.int32), place.astype(np.int32), values[cell, place]


def sobel(raster: DataFrame) -> DataFrame:
    """item_id, y, x, gx, gy."""
    return by_image(raster, "y int, x int, gx double, gy double", lambda i: (*places(i), *(g.ravel() for g in gradients(i))))


def edge_histogram(raster: DataFrame) -> DataFrame:
    """item_id, cell, bin, value: orientations over 0..180 degrees weighted by magnitude, each cell at unit length; zeros are left out."""
    def work(image: np.ndarray) -> tuple[np.ndarray, ...]:
        gx, gy = gradients(image)
        angle = np.round((np.degrees(np.arctan2(gy, gx)) + 180.0) % 180.0, 9)
        bins = np.minimum(np.floor(angle / (180.0 / ORIENTATIONS)), ORIENTATIONS - 1).astype(np.int64)
        sums = cell_sums(cells(image), bins, ORIENTATIONS, np.sqrt(gx * gx + gy * gy))
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return listed(sums / np.where(length > 1e-8, length, 1.0))

    return by_image(raster, "cell int, bin int, value double", work)


def lbp(image: np.ndarray) -> np.ndarray:
    """Bit p where neighbour p isn't below the centre; 0 on the border."""
    codes = sum((shifted(image, *o) >= image).astype(np.int32) << p for p, o in enumerate(NEIGHBOURS))
    codes[[0, -1]] = codes[:, [0, -1]] = 0
    return codes


def lbp_codes(raster: DataFrame) -> DataFrame:
    """item_id, y, x, code."""
    return by_image(raster, "y int, x int, code int", lambda i: (*places(i), lbp(i).ravel()))


def lbp_histogram(raster: DataFrame) -> DataFrame:
    """item_id, cell, bin, value: shares of uniform codes by their number of ones (0..8), all others in bin 9; zeros are left out."""
    def work(image: np.ndarray) -> tuple[np.ndarray, ...]:
        codes = lbp(image)
        ones = np.bitwise_count(codes).astype(np.int64)
        uniform = np.bitwise_count(codes ^ ((codes >> 1) | ((codes & 1) << 7))) <= 2
        sums = cell_sums(cells(image), np.where(uniform, ones, 9), 10, np.ones(image.shape))
        return listed(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1))

    return by_image(raster, "cell int, bin int, value double", work)


def gram(maps: DataFrame) -> DataFrame:
    """item_id, layer, c1, c2 (c1 <= c2), value: F F^T / (c h w) of feature maps (item_id, layer, c, pos, v), one exchange by item."""
    def work(f: np.ndarray) -> tuple[np.ndarray, ...]:
        layers, channels, n = (int(f[:, k].max()) + 1 for k in range(3))
        full = np.zeros((layers, channels, n))
        full[tuple(f[:, k].astype(int) for k in range(3))] = f[:, 3]
        out = []
        for layer in np.unique(f[:, 0]).astype(int).tolist():
            own = f[f[:, 0] == layer]
            c, m = int(own[:, 1].max()) + 1, int(own[:, 2].max()) + 1
            x = full[layer, :c, :m]
            i, j = np.triu_indices(c)
            out.append((np.full(len(i), layer, np.int32), i.astype(np.int32), j.astype(np.int32), (x @ x.T / (c * m))[i, j]))
        return tuple(np.concatenate(c) for c in zip(*out))

    names = ("layer", "c", "pos", "v")
    whole = maps.where("v is not null").groupBy("item_id").agg(F.collect_list(F.array(*(F.col(n).cast("double") for n in names))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column("p").flatten().flatten().to_numpy().reshape(-1, 4), batch.column("p").offsets.to_numpy()
            found = [work(flat[a:b]) for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("item_id").to_numpy(), [len(f[0]) for f in found])), *(pa.array(np.concatenate(c)) for c in zip(*found))], ["item_id", "layer", "c1", "c2", "value"])

    return whole.select(F.col("item_id").cast("long").alias("item_id"), "p").mapInArrow(run, "item_id long, layer int, c1 int, c2 int, value double")


def style_features(rasters: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """item_id, edge, lbp[, gram] as maps from place to value, joined by item; an item without feature maps has a null gram."""
    as_map = lambda df, key, name: df.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), F.col("value").alias("v")))).alias(name))
    out = as_map(edge_histogram(rasters), F.col("cell") * ORIENTATIONS + F.col("bin"), "edge").join(as_map(lbp_histogram(rasters), F.col("cell") * 10 + F.col("bin"), "lbp"), "item_id", "full")
    return out if maps is None else out.join(as_map(gram(maps), F.concat_ws(":", "layer", "c1", "c2"), "gram"), "item_id", "left")
