"""Quality (operator 8): random-indexing word vectors, pooled, and a two-layer network with calibrated temperature.

The WORDS most frequent words of all documents have a vector of their own each; any other word has that of one of RARE classes, by its hash. Word
shapes (1,024 classes by hash) have vectors too. A unit's vector is the sum, over all documents, of its neighbours' sparse index vectors.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import slices
from prismar.llm.labelled import scored, training_rows

FOLDS, HELD = 3, 1
WORDS, RARE, SHAPES, DIMS, ONES = 1 << 14, 1024, 1024, 64, 4
BLOCKS = 64
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_MARKS = b".,;:!?\"'()|*%#$&"


def word_key(token: bytes) -> int:
    """A hash of the token's word, without case and the punctuation around it."""
    return xxhash.xxh3_64_intdigest(token.lower().strip(_MARKS)) & (2**63 - 1)


def word_keys(tokens: bytes) -> np.ndarray:
    """word_key() of each of some tokens, one a line."""
    words = [t.strip(_MARKS) for t in tokens.lower().split(b"\n")] if tokens else []
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & np.uint64(2**63 - 1)).astype(np.int64)


def distinct_tokens(texts: list[bytes | None]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The different tokens of some texts, one a line, the place among these of every token in turn, and how many tokens each text has (as bytes.split())."""
    lists = pc.ascii_split_whitespace(pa.array([t or b"" for t in texts], pa.binary()).view(pa.string()))
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at an end of a text leaves an empty one
    sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()])
    found = flat.filter(pa.array(full)).dictionary_encode()
    lines = pc.binary_join(pa.ListArray.from_arrays([0, len(found.dictionary)], found.dictionary.view(pa.binary())), b"\n")
    return lines[0].as_py(), found.indices.to_numpy(), sizes


class Shapes(dict):
    """Token with A, a and 0 for letters and digits -> shape unit: the hash of it with runs as one."""

    def __missing__(self, token: bytes) -> int:
        value = self[token] = xxhash.xxh3_64_intdigest(_RUNS.sub(rb"\1+", token)) % SHAPES
        return value


class Units:
    """Word and shape units of tokens; each different token of the texts in hand is looked up once."""

    def __init__(self, listed: np.ndarray):
        self.listed, self.shapes = listed, Shapes()

    def of_all(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word and shape units of all tokens in turn, and how many tokens each text has."""
        tokens, place, sizes = distinct_tokens(texts)
        keys = word_keys(tokens)
        word = len(self.listed) + keys % RARE
        if len(self.listed):
            at = np.minimum(np.searchsorted(self.listed, keys), len(self.listed) - 1)
            word = np.where(self.listed[at] == keys, at, word)
        if len(self.shapes) > 100_000:
            self.shapes.clear()
        written = tokens.translate(_SHAPE).split(b"\n") if tokens else []
        shape = np.fromiter(map(self.shapes.__getitem__, written), np.int64, len(written))
        return word[place], shape[place], sizes

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Word and shape units of a text."""
        return self.of_all([text])[:2]


def frequent_words(docs: DataFrame, most: int = WORDS) -> np.ndarray:
    """The keys of the most frequent words of all documents; counts are added up in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, "text"):
            tokens, place, _ = distinct_tokens(batch.column("text").to_pylist())
            parts.append((word_keys(tokens), np.bincount(place)))
            if sum(len(k) for k, _ in parts) > 800_000:
                parts = [added(parts)]
                if len(parts[0][0]) > 400_000:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, parts.pop())), ["w", "n"])
        if parts:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, added(parts))), ["w", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return np.array(sorted(r.w for r in counts.orderBy(F.desc("n"), "w").limit(most).collect()), np.int64)


def index_vectors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (n x ONES) of each unit's sparse ternary index vector; they depend on its number alone."""
    h = np.arange(n * ONES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    h ^= h >> np.uint64(31)
    return (h % np.uint64(DIMS)).astype(np.int64).reshape(n, ONES), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0).reshape(n, ONES)


def dense_index(n: int) -> np.ndarray:
    place, sign = index_vectors(n)
    return np.bincount((np.arange(n)[:, None] * DIMS + place).ravel(), weights=sign.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def context_sums(before: np.ndarray, after: np.ndarray, n: int, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """n x DIMS: each unit's sum of its neighbours' index vectors, over pairs of units that stand side by side."""
    unit, other = np.concatenate([before, after]), np.concatenate([after, before])
    out = np.zeros(n * DIMS)
    for k in range(ONES):
        out += np.bincount(unit * DIMS + place[other, k], weights=sign[other, k], minlength=n * DIMS)
    return out.reshape(n, DIMS)


def unit_vectors(docs: DataFrame, listed: np.ndarray) -> np.ndarray:
    """Context vectors of the word units and then of the shape units, over all documents, at unit length.

    A task sends its sums once, compressed, in BLOCKS blocks; they are added up by block and part of the tasks, one at a time, and these sums by block.
    """
    words = len(listed) + RARE
    n = words + SHAPES

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, sums, shapes = Units(listed), np.zeros((words, DIMS)), np.zeros(SHAPES * SHAPES)
        index = index_vectors(words)
        for batch in slices(batches, "text"):
            own, shape, sizes = units.of_all(batch.column("text").to_pylist())
            ends = np.cumsum(sizes)
            beside = np.ones(max(0, len(own) - 1), bool)
            beside[ends[(ends > 0) & (ends < len(own))] - 1] = False  # the last of a text and the first of the next
            sums += context_sums(own[:-1][beside], own[1:][beside], words, *index)
            shapes += np.bincount(shape[:-1][beside] * SHAPES + shape[1:][beside], minlength=SHAPES * SHAPES)
        shapes = shapes.reshape(SHAPES, SHAPES)
        sums = np.concatenate([sums, (shapes + shapes.T) @ dense_index(SHAPES)])
        salt = TaskContext.get().partitionId() % 64
        for k, part in enumerate(np.array_split(sums, BLOCKS)):
            yield pa.RecordBatch.from_pydict({"block": [k], "salt": [salt], "sums": [zlib.compress(part.astype("<i4").tobytes(), 1)]}, kind)

    kind = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in parts:
            for own in batch.column("sums"):
                raw = zlib.decompress(own.as_py())
                total = total + np.frombuffer(raw, "<i4" if len(raw) == 4 * sizes[key[0].as_py()] else "<i8").astype("<i8")
        yield pa.RecordBatch.from_pydict({"block": [key[0].as_py()], "salt": [0], "sums": [zlib.compress(total.tobytes(), 1)]}, kind)

    sizes = [x.size for x in np.array_split(np.zeros((n, DIMS), bool), BLOCKS)]
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(learn, "block int, salt int, sums binary")
    for by in (("block", "salt"), ("block",)):
        rows = rows.groupBy(*by).applyInArrow(add, "block int, salt int, sums binary")
    found = sorted((r.block, bytes(r.sums)) for r in rows.collect())  # n x DIMS numbers
    out = np.concatenate([np.frombuffer(zlib.decompress(s), "<i8") for _, s in found]).reshape(n, DIMS).astype(float) if found else np.zeros((n, DIMS))
    return (out / (np.sqrt((out * out).sum(axis=1, keepdims=True)) + 1e-9)).astype(np.float32)


class Pooler:
    """A text's features: mean word vector, mean shape vector, mean shape index vector, and five numbers on length and repetition."""

    def __init__(self, listed: np.ndarray, vectors: np.ndarray):
        self.units, self.words = Units(listed), vectors[:-SHAPES]
        self.both = np.concatenate([vectors[-SHAPES:], dense_index(SHAPES)], axis=1).astype(float)

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        mean, extra = np.zeros((len(texts), DIMS), np.float32), np.zeros((len(texts), 5), np.float32)
        count = np.zeros((len(texts), SHAPES))  # in double, so that a row's place in a batch doesn't show
        own, shape, sizes = self.units.of_all(texts)
        ends = np.cumsum(sizes)
        for i, t in enumerate(texts):
            words, shapes = own[ends[i] - sizes[i] : ends[i]], shape[ends[i] - sizes[i] : ends[i]]
            if n := len(words):
                count[i] = np.bincount(shapes, minlength=SHAPES) / n
                used, times = np.unique(words, return_counts=True)
                mean[i] = sum(times[a : a + 4096].astype(np.float32) @ self.words[used[a : a + 4096]] for a in range(0, len(used), 4096)) / n
                lines = [x for x in t.split(b"\n") if x]
                extra[i] = (np.log1p(n), len(used) / n, len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), len(t) / n / 10)
        return np.concatenate([mean, (count @ self.both).astype(np.float32), extra], axis=1)


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 7) -> dict:
    """Two layers, trained by Adam on four fifths of the rows; the temperature is the one of least loss on the other fifth."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - mean) / std).astype(np.float32)
    order = rng.permutation(len(x))
    cut = max(1, len(x) * 4 // 5)
    fit, held = order[:cut], order[cut:] if cut < len(x) else order
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / np.sqrt(hidden), hidden), "b2": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            a, t = x[rows], y[rows]
            h = np.tanh(a @ p["w1"] + p["b1"])
            d = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -30, 30))) - t) / len(rows)
            back = np.outer(d, p["w2"]) * (1 - h * h)
            grad = {"w1": a.T @ back + 1e-4 * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + 1e-4 * p["w2"], "b2": d.sum(keepdims=True)}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = p | {"mean": mean, "std": std, "temperature": 1.0}
    z, t = logits(model, x[held], scaled=True), y[held]
    losses = {c: float(np.mean(np.logaddexp(0, z / c) - t * z / c)) for c in np.geomspace(0.25, 8, 41)}
    return model | {"temperature": min(losses, key=losses.get)}


def logits(model: dict, x: np.ndarray, scaled: bool = False) -> np.ndarray:
    x = x if scaled else (x - model["mean"]) / model["std"]
    return (np.tanh(x @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]) / model["temperature"]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000) -> tuple[np.ndarray, np.ndarray, dict | None]:
    """Words and vectors from all documents; the network from at most `max_labelled` labelled ones, in one task of bounded size."""
    listed = frequent_words(docs)
    vectors = unit_vectors(docs, listed)
    shared = docs.sparkSession.sparkContext.broadcast((listed, vectors))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooler = Pooler(*shared.value)
        for batch in slices(batches, "text"):
            x = pooler.features([t.as_py() for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("y"), batch.column("doc_id")], ["x", "y", "doc_id"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((d, x, y) for b in batches for d, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_id", "x", "y"))))
        if len(rows) > 1:
            model = train_network(np.stack([np.frombuffer(x, np.float32) for _, x, _ in rows]), np.array([min(1, max(0, y)) for *_, y in rows], np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    train = training_rows(docs, labels, "quality", FOLDS, HELD, max_labelled).mapInArrow(pool, "x binary, y int, doc_id long")
    found = train.repartition(1).mapInArrow(learn, "model binary").collect()
    return listed, vectors, pickle.loads(bytes(found[0].model)) if found else None


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Null and empty texts are scored as texts without words; repeated
    rows each give a row; texts of any length are pooled whole; with fewer than two labelled rows every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, vectors, model = shared.value
        pooler = Pooler(listed, vectors)
        for batch in slices(batches, "text"):
            x = pooler.features([t.as_py() for t in batch.column("text")]).astype(float)
            p = np.round(1 / (1 + np.exp(-np.clip(logits(model, x), -30, 30))), 9) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return scored(docs, FOLDS, HELD, lambda rows: rows.mapInArrow(run, "doc_id long, score double"))
