"""SentencePiece encoding and decoding by a table of prefixes (operator 11), for merge-type models.

A text is the unique chain of pieces in which every two neighbours are compatible: merging the two apart from the rest gives back just these
two. So the last piece of each prefix is the one piece that ends there (an automaton finds them all) and is compatible with the last
piece of the prefix before it. One pass stores that piece for each prefix, and the ids are then read from the end backwards.

That holds for any scores, equal ones too: inside a chain merges happen in the order that they have in each pair by itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import slices

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # fixed value: the letter that stands for a space in pieces
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_LETTERS = "A-Za-z"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixEncoder:
    """Encodes chunks by their prefix table and remembers the short ones.

    A text is cut only between letters that no piece has side by side (before spaces, and between A-Z and marks, as that is fast). Short chunks seen
    lately are kept in two generations. Models with user-defined or unused pieces, or with a letter in a piece that is no piece itself, are refused.
    """

    def __init__(self, path: str, limit: int = 450_000, longest: int = 64):
        import ahocorasick
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m, plain = self.model, []
        for i in range(m.get_piece_size()):
            if m.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)):
                plain.append(i)
        self.text = {i: m.id_to_piece(i) for i in plain}
        self.rank = {self.text[i]: (-m.get_score(i), i) for i in plain}
        letters = set(chain.from_iterable(self.rank))
        if not letters <= self.rank.keys():
            raise ValueError("a letter inside a piece is no piece itself")
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(map(m.is_byte, self.bytes))
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.known, self.shift = {}, m.get_piece_size().bit_length()
        self.length = {i: len(p) for i, p in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            if self.merged(p) == [p]:  # others never come out of merging
                self.automaton.add_word(p, (i, len(p) - 1))
        self.automaton.make_automaton()
        self.cut_spaces = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        mixed = {c for p in self.inside for c, d in (p, p[::-1]) if re.match(f"[{_LETTERS}]", d)}
        marks = "".join(re.escape(c) for c in map(chr, range(1, 128)) if not c.isalnum() and c not in mixed)
        word, end = f"{SPACE}*+[{_LETTERS}]++", f"{SPACE}]|\\Z)"
        self.runs = re.compile(f"{word}(?=[{marks}{end}|[{marks}]++(?=[{_LETTERS}{end}|{_RUNS.pattern}") if marks else _RUNS
        self.limit, self.longest, self.cache, self.older = limit, longest, {}, {}

    def merged(self, text: str) -> list[str]:
        """Plain merging of a short string, best score first and then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                found = self.rank.get(parts[k] + parts[k + 1])
                if found and (best is None or found[0] < best):
                    best, at = found[0], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        found = self.known[a << self.shift | b] = self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]
        return found

    def prefix_table(self, text: str) -> list[int]:
        """For each prefix (by length, from 1), its last piece; below 0: ~letter, for a letter that the model doesn't have."""
        last = [-1, *[~ord(c) for c in text]]
        done, known, shift = 0, self.known.get, self.shift
        for end, (piece, more) in self.automaton.iter(text):
            if end >= done:
                before = last[end - more]
                if before >= 0:
                    fits = known(before << shift | piece)
                    if not (self.compatible(before, piece) if fits is None else fits):
                        continue
                last[end + 1] = piece
                done = end + 1
        return last

    def fresh(self, text: str) -> tuple[int, ...]:
        last, at, out = self.prefix_table(text), len(text), []
        while at:
            piece = last[at]
            if piece >= 0:
                out.append(piece)
                at -= self.length[piece]
            else:
                at -= 1
                out.extend([self.bytes[b] for b in reversed(text[at].encode())] if self.fallback else [self.model.unk_id()])
        return tuple(out[::-1])

    def chunk(self, text: str) -> tuple[int, ...]:
        """The ids of a chunk that isn't in the young generation."""
        found = self.older.get(text)
        if found is None:
            joined = [*map(self.inside.__contains__, map(add, text, text[1:]))]
            if False in joined:
                cuts = [k for k, one in enumerate(joined, 1) if not one]
                get, chunk = self.cache.get, self.chunk
                found = tuple(chain.from_iterable([get(p) or chunk(p) for p in [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]]))
            else:
                found = self.fresh(text)
        if len(text) <= self.longest:
            self.cache[text] = found
        return found

    def chunks(self, normal: str) -> list[str]:
        """The pieces of a normalised text that are encoded apart."""
        if not self.cut_spaces:
            return [normal] if normal else []
        return self.runs.findall(normal)

    def encode(self, text: str) -> list[int]:
        if len(self.cache) > self.limit:
            self.cache, self.older = {}, self.cache
        if len(self.known) > 4 * self.limit:
            self.known.clear()
        get, chunk = self.cache.get, self.chunk
        return list(chain.from_iterable([get(c) or chunk(c) for c in self.chunks(self.model.normalize(text))]))


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder, kept from task to task with what it has learnt."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str | None = None, end: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, with the end id last if `end`) of each row of `docs` (doc_id, text).

    Null and empty texts have the end id alone; repeated rows each give a row; texts of any length are encoded whole, in memory that grows with the
    text; other columns are ignored. Each row is worked out by itself, so nothing is shuffled and no row is anyone's hot key.
    """
    return _run(docs, model, end, "ids array<int>", lambda own, ids: [pa.array(ids, pa.list_(pa.int32()))])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, decoded: the text that the model's own decoder makes of `ids`; null ids: empty."""
    path = model or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path).model
        for batch in batches:
            texts = [own.decode(i) if i else "" for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, decoded: encode() with the end id and decode() in one pass; rows as there."""
    return _run(docs, model, True, "ids array<int>, decoded string", lambda own, ids: [pa.array(ids, pa.list_(pa.int32())), pa.array(map(own.decode, ids), pa.string())])


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of round_trip(), worked out where the ids are, so that only digests leave the task."""
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    written: list[str] = []

    def finish(own, ids: list[list[int]]) -> list[pa.Array]:
        if not written:
            written.extend(map(str, range(own.get_piece_size())))
        return [pa.array(map(len, ids), pa.int64()), pa.array([sha(" ".join([written[k] for k in i])) for i in ids]), pa.array([sha(own.decode(i)) for i in ids])]

    return _run(docs, model, True, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)


def _run(docs: DataFrame, model: str | None, end: bool, columns: str, finish: Callable[[object, list[list[int]]], list[pa.Array]]) -> DataFrame:
    """doc_id and the `columns` that `finish` makes of the decoder and the ids of some rows."""
    path, names = model or model_path(), ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        tail = [own.model.eos_id()] if end else []
        for batch in slices(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *finish(own.model, [own.encode(t or "") + tail for t in batch.column("text").to_pylist()])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {columns}")
