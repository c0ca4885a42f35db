"""The training-data pipeline: toxicity, line dedup, near copies, benchmark decontamination, packing."""

from __future__ import annotations

from prismar.llm import decontam, jaccard, linededup, packing, toxicity
from prismar.llm.common import materialize, table
from pyspark.sql import DataFrame, SparkSession

#: The same Python workers serve all stages, and what one stage took is seldom given back before the next: each takes little text at once and remembers few words.
SMALL = {"slice_bytes": 1 << 19, "cached": 50_000}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the segment scorer predicts toxic."""
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; a document goes when nothing is left of it."""
    return linededup.dedup_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.drop_near_copies(docs, **SMALL)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the contamination rule rejects."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), shard_bytes=4 << 20)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed piece of what is left."""
    return packing.pack(docs, **SMALL)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard", drop_near_copies), ("decontamination", decontaminate), ("packing", pack)]

#: SQL can't express learning, alignment or packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
