"""Token counts (operator 10) and the chunk encoder that packing shares.

A space between two characters that aren't white space always starts a new pre-token of the byte-level
pattern, so a text can be cut there into chunks which are encoded apart: the ids of the text are
those of its first chunk and then those of " " + chunk for each other one. Added special strings are
recognised before that, as the library does.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismar.llm.common import slices

TOKENIZER, SAMPLE = "byte_bpe_50k.json", 20_000
#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_DOUBLE, _CUT = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


def chunks_of(text: str) -> list[str]:
    """The text's chunks; all but the first stand for the chunk with the space before it."""
    return _CUT.split(text) if _DOUBLE.search(text) else text.split(" ")


class ChunkEncoder:
    """Looks chunks up in worker caches; what is missing there is encoded by merge ranks.

    The ranks are those of the tokenizer file itself, and so are the ids (tests hold both against the tokenizers library);
    `tiktoken` merges a short chunk in half the time that the library takes for it.
    """

    def __init__(self, path: str, make, table: dict | None = None, limit: int = 400_000):
        import tiktoken

        model = json.loads(Path(path).read_text())
        added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.ids = {w: i for w, i in model["model"]["vocab"].items() if w not in added}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in w): i for w, i in self.ids.items()}
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added, self.special = added, list(added)
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.make, self.limit, self.table = make, limit, table or {}
        self.cache: dict = dict(self.table)
        self.first: dict = {}

    def encode(self, texts: list[str]) -> list:
        merge, make, added = self.merge, self.make, self.added
        return [make([added[t]] if t in added else merge(t)) for t in texts]

    def split(self, text: str) -> list[tuple[bool, list[str]]]:
        """Segments of the text: (is a special string, chunks)."""
        if self.pattern and any(s in text for s in self.special):
            return [(bool(k % 2), [p] if k % 2 else chunks_of(p)) for k, p in enumerate(self.pattern.split(text)) if p]
        return [(False, chunks_of(text))] if text else []

    def values(self, texts: list[str | None]) -> list[list]:
        """For each text, the values of its chunks in order."""
        parts = [self.split(t or "") for t in texts]
        if len(self.cache) > self.limit + len(self.table):
            self.cache = dict(self.table)
        if len(self.first) > self.limit:
            self.first = {}
        need, heads = set(), set()
        for segments in parts:
            for special, chunks in segments:
                heads.add(chunks[0])
                need.update(chunks[1:])
        need = [c for c in need if c not in self.cache]
        heads = [c for c in heads if c not in self.first]
        self.cache.update(zip(need, self.encode([" " + c for c in need])))
        self.first.update(zip(heads, self.encode(heads)))
        get, first = self.cache.__getitem__, self.first.__getitem__
        out = []
        for segments in parts:
            got = []
            for _, chunks in segments:
                got.append(first(chunks[0]))
                got.extend(map(get, chunks[1:]))
            out.append(got)
        return out


def id_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else b"".join(i.to_bytes(4, "little") for i in ids)


_ENCODERS: dict = {}


def encoder(path: str, make, table: dict | None = None, version: str = "", limit: int = 400_000) -> ChunkEncoder:
    """The worker's encoder, kept from task to task with what it has learnt, which is dropped when it is over `limit` chunks."""
    key = (path, make.__name__)
    if key not in _ENCODERS or _ENCODERS[key].version != version:
        _ENCODERS[key] = ChunkEncoder(path, make, table)
        _ENCODERS[key].version = version
    _ENCODERS[key].limit = limit
    return _ENCODERS[key]


def frequent_chunks(docs: DataFrame, table_size: int, sample: int = SAMPLE, text: str = "text") -> list[str]:
    """The most frequent chunks, at most `table_size`, of about `sample` documents (those of smallest id hash, rows without an id by their text's).

    What is frequent decides where a length is looked up, never what it is, so a bounded sample will do: only its chunks, counted in
    each task first, are added up over tasks.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches, text):
            for t in batch.column(text).to_pylist():
                if t:
                    seen.update(chunks_of(t)[1:])
        yield pa.RecordBatch.from_pydict({"chunk": list(seen), "n": list(seen.values())}, pa.schema([("chunk", pa.string()), ("n", pa.int64())]))

    share = min(1.0, sample / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col(text))), F.lit(1 << 20)) < int(share * (1 << 20)))
    counted = picked.select(text).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return [r.chunk for r in counted.orderBy(F.desc("n"), "chunk").limit(table_size).collect()]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, table_size: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of `docs` (doc_id, text).

    Two tiers: a table of at most `table_size` frequent chunk lengths is broadcast (its size is the bound); other chunks are
    encoded once per worker cache. Null and empty texts have no tokens; repeated rows each give a row; texts of any length are counted
    whole; other columns are ignored.
    """
    path = tokenizer or tokenizer_path()
    top = frequent_chunks(docs, table_size)
    version = uuid.uuid4().hex
    lengths = dict(zip(top, encoder(path, len, version=version).encode([" " + c for c in top])))
    shared = docs.sparkSession.sparkContext.broadcast(lengths)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, len, shared.value, version)
        for batch in slices(batches, "text"):
            n = [sum(v) for v in own.values(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
