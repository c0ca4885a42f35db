"""Toxicity (operator 9): maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import materialize, slices
from prismar.llm.decontam import item_words
from prismar.llm.labelled import scored, training_rows

FOLDS, HELD = 5, 0
SEGMENTS = "array<struct<start:int,end:int,score:double,evalue:double>>"
_SEGMENT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evalue", pa.float64())]))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence in linear time (Ruzzo and Tompa 1999).

    Only positions with a positive score open or close a segment; what lies between them enters through running sums.
    """
    hot = np.flatnonzero(scores > 0)
    if not len(hot):
        return []
    total = np.cumsum(scores)
    stack: list[list] = []  # start, end, sum before it, sum with it, the nearest entry with a smaller sum before it
    for i in hot.tolist():
        left, right = float(total[i] - scores[i]), float(total[i])
        entry = [i, i + 1, left, right, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= entry[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= entry[3]:
                entry[4] = j
                stack.append(entry)
                break
            entry = [stack[j][0], entry[1], stack[j][2], entry[3], -1]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


class Lexicon(dict):
    """word -> score. A word without an entry of its own takes that of its longest listed prefix, else the neutral score."""

    def __init__(self, words: dict[bytes, float], prefixes: dict[str, float], neutral: float):
        super().__init__(words)
        self.words, self.prefixes, self.neutral = words, prefixes, neutral

    def __missing__(self, word: bytes) -> float:
        text = word.decode("utf-8", "replace")
        value = next((self.prefixes[text[:k]] for k in range(min(7, len(text) - 1), 2, -1) if text[:k] in self.prefixes), self.neutral)
        self[word] = value
        return value

    def trim(self, limit: int = 400_000) -> None:
        if len(self) > limit + len(self.words):
            self.clear()
            self.update(self.words)


def unit_counts(train: DataFrame) -> DataFrame:
    """unit, kind (w: word, p: its prefixes of 3 to 7 letters), t, c: toxic and clean documents' counts, each word once a document."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[dict, dict] = ({}, {})

        def out() -> pa.RecordBatch:
            words = list(dict.fromkeys([*seen[0], *seen[1]]))
            rows = [pa.array([w.decode("utf-8", "replace") for w in words]), *(pa.array([seen[y].get(w, 0) for w in words], pa.int64()) for y in (1, 0))]
            seen[0].clear(), seen[1].clear()
            return pa.RecordBatch.from_arrays(rows, ["unit", "t", "c"])

        for batch in slices(batches, "text"):
            for text, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                mine = seen[1 if y else 0]
                for w in set(item_words(text.as_py())):
                    mine[w] = mine.get(w, 0) + 1
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield out()
        yield out()

    words = train.mapInArrow(count, "unit string, t long, c long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    words = materialize(words, "toxic-words")
    heads = words.select(F.explode(F.transform(F.sequence(F.lit(3), F.lit(7)), lambda k: F.when(F.length("unit") > k, F.substring(F.col("unit"), F.lit(1), k)))).alias("unit"), "t", "c").where("unit is not null")
    heads = heads.groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    return words.withColumn("kind", F.lit("w")).unionByName(heads.withColumn("kind", F.lit("p")))


def log_odds(units: DataFrame, prior: float, effect: float) -> DataFrame:
    """Log-odds with an informative Dirichlet prior, `prior` times the counts of the whole corpus, and their z-scores over `effect`: how
    surely a unit's odds are more than e^effect times as high in toxic documents. A bound on z over 0 alone would let ever weaker
    units in as the sample grows."""
    total = {r.kind: r for r in units.groupBy("kind").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).collect()}
    if not total or not total["w"].t or not total["w"].c:
        return units.withColumn("delta", F.lit(0.0)).withColumn("z", F.lit(0.0)).where("false")
    t_all = F.when(F.col("kind") == "w", float(total["w"].t)).otherwise(float(total["p"].t if "p" in total else 1))
    c_all = F.when(F.col("kind") == "w", float(total["w"].c)).otherwise(float(total["p"].c if "p" in total else 1))
    a = prior * (F.col("t") + F.col("c"))
    t, c, more = F.col("t") + a, F.col("c") + a, prior * (t_all + c_all)
    delta = F.log(t / (t_all + more - t)) - F.log(c / (c_all + more - c))
    return units.withColumn("delta", delta).withColumn("z", (delta - effect) / F.sqrt(1 / t + 1 / c))


class Model:
    """Lexicon, background constants and the logistic map from the normalised segment score to a probability."""

    def __init__(self, words: dict, prefixes: dict, rate: float, lam: float, k: float):
        self.words, self.prefixes, self.neutral, self.lam, self.k = words, prefixes, math.log(1 - rate), lam, k
        self.bias, self.slope = -2.0, 0.5

    def lexicon(self) -> Lexicon:
        return Lexicon(self.words, self.prefixes, self.neutral)

    def segments(self, lexicon: Lexicon, text: bytes | None) -> tuple[list[tuple[int, int, float, float]], float, int]:
        """Segments with their E-values, the normalised score x of the document, and its number of words."""
        words = item_words(text)
        scores = np.fromiter(map(lexicon.__getitem__, words), float, len(words))
        found = [(a, b, s, self.k * len(words) * math.exp(-self.lam * s)) for a, b, s in maximal_segments(scores)]
        if not found:
            return [], -1.0, len(words)
        tail = sum(math.log1p(1 / max(e, 1e-12)) for *_, e in found)  # each passage adds what its E-value tells against chance
        return found, min(tail, 40.0), len(words)

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-(self.bias + self.slope * x)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 200_000, prior: float = 0.05, rate: float = 0.1, effect: float = 1.0, least_z: float = 2.0) -> Model:
    """Learn from at most `max_labelled` labelled documents outside the held-out fold (a documented bound of the fitted model; scoring covers
    all rows). The lexicon has every unit of theirs whose z over `effect` is `least_z` or more, so that sample bounds its size too.

    The background of the extreme-value statistics is how often each word score turns up in the clean documents, counted by token, and how many
    segments they have.
    """
    train = training_rows(docs, labels, "toxic", FOLDS, HELD, max_labelled)
    top = log_odds(unit_counts(train), prior, effect).where(F.col("z") >= least_z).collect()
    gain = lambda d: math.log((1 - rate) + rate * math.exp(min(d, 30.0)))
    words = {r.unit.encode(): g for r in top if r.kind == "w" and (g := gain(r.delta)) > 0}
    prefixes = {r.unit: g for r in top if r.kind == "p" and (g := gain(r.delta)) > 0}
    model = Model(words, prefixes, rate, 1.0, 0.1)
    spark = docs.sparkSession
    lexicon_only, kinds = spark.sparkContext.broadcast(model), pa.schema([("score", pa.float64()), ("tokens", pa.int64()), ("segments", pa.int64())])

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, segments = lexicon_only.value, Counter(), 0
        lexicon = own.lexicon()
        for batch in slices(batches, "text"):
            for text in batch.column("text"):
                scores = np.fromiter(map(lexicon.__getitem__, item_words(text.as_py())), float)
                hot = np.round(scores[scores > 0], 2)
                seen.update(dict(zip(*(x.tolist() for x in np.unique(hot, return_counts=True)))))
                seen[own.neutral] += len(scores) - len(hot)
                segments += len(maximal_segments(scores))
            lexicon.trim()
        yield pa.RecordBatch.from_pydict({"score": list(seen), "tokens": list(seen.values()), "segments": [segments, *[0] * (len(seen) - 1)] if seen else []}, kinds)

    clean = train.where("y = 0").mapInArrow(background, "score double, tokens long, segments long").groupBy("score").agg(F.sum("tokens").alias("tokens"), F.sum("segments").alias("segments")).collect()  # a row for each hundredth
    tokens, segments = sum(r.tokens for r in clean) or 1, sum(r.segments for r in clean)
    model.lam = _lambda([(r.score, (r.tokens + 0.01) / tokens) for r in clean if r.score > 0] or [(1.0, 0.01 / tokens)], model.neutral)
    least = min((r.score for r in clean if r.score > 0), default=1.0)
    model.k = (segments + 0.5) / (tokens * math.exp(-model.lam * least))
    shared = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        lexicon = own.lexicon()
        for batch in slices(batches, "text"):
            x = [round(own.segments(lexicon, t.as_py())[1], 1) for t in batch.column("text")]
            lexicon.trim()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column("y")], ["x", "y"])

    rows = train.mapInArrow(features, "x double, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("docs")).collect()  # at most a row for each tenth up to 40
    model.bias, model.slope = _logistic([(r.x, int(bool(r.y)), r.docs) for r in rows])
    return model


def _lambda(gains: list[tuple[float, float]], neutral: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the background, by bisection."""
    rest = 1 - sum(p for _, p in gains)
    f = lambda x: rest * math.exp(x * neutral) + sum(p * math.exp(min(x * g, 700)) for g, p in gains) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 20:
        high *= 1.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(0.05, low)


def _logistic(rows: list[tuple[float, int, int]], ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Weighted one-variable logistic regression by damped Newton steps."""
    if not rows or len({y for _, y, _ in rows}) < 2:
        return (-6.0, 0.0) if not rows or not rows[0][1] else (6.0, 0.0)
    x, y, w = (np.array(c, float) for c in zip(*rows))
    w = w / w.sum()
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g0, g1 = (w * (y - p)).sum(), (w * (y - p) * x).sum() - ridge * 1e-2 * b
        h = w * p * (1 - p) + 1e-9
        h00, h01, h11 = h.sum(), (h * x).sum(), (h * x * x).sum() + ridge * 1e-2
        det = h00 * h11 - h01 * h01 + 1e-12
        a, b = a + np.clip((h11 * g0 - h01 * g1) / det, -2, 2), b + np.clip((h00 * g1 - h01 * g0) / det, -2, 2)
    return float(a), float(max(b, 0.0))


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words and the toxic segments (word offsets, score, E-value) of each row.

    Null and empty texts have no segment and the score of such texts; repeated rows each give a row; texts of any length are scanned whole; without labels of
    both classes scores are constant.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon = model.lexicon()
        for batch in slices(batches, "text"):
            got = [model.segments(lexicon, t.as_py()) for t in batch.column("text")]
            lexicon.trim()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([model.probability(x) for _, x, _ in got], pa.float64()), pa.array([n for *_, n in got], pa.int64()),
                pa.array([[dict(zip(("start", "end", "score", "evalue"), s)) for s in segments if s[3] < 0.05] for segments, *_ in got], _SEGMENT)], ["doc_id", "score", "n_words", "segments"])

    return scored(docs, FOLDS, HELD, lambda rows: rows.mapInArrow(run, f"doc_id long, score double, n_words long, segments {SEGMENTS}"))


def remove_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without the rows predicted toxic. The scorer runs beside the row, so the text isn't shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    fields = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        lexicon = model.lexicon()
        for batch in slices(batches, "text"):
            good = [model.probability(model.segments(lexicon, t.as_py().encode() if t.is_valid else None)[1]) < 0.5 for t in batch.column("text")]
            lexicon.trim()
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, fields)
