"""The corpus pipeline: five stages, each on all that its predecessor kept.

toxicity        documents scored toxic go
jaccard         one document of each group of near duplicates (word 5-grams,
                similarity of 0.8 or more) stays: the one with the smallest id
repeats         of a passage of 50 words or more that documents share, the copy
                in the document with the smallest id stays
decontaminate   documents that hold a benchmark item go
sentencepiece   each text's sampled piece ids

Rows with a null id or text stay through the filters (nothing is found in
them); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubes.functions.storage import discard, materialise
from nubes.llm import decontaminate, jaccard, repeats, segment, toxicity
from nubes.llm.common import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_ordinary(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, n=5, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = segment.encode_pieces(docs.select("doc_id", "text"), drop_text=True)
    return ids.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard", jaccard_stage),
    ("repeats", repeats_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A model's scores, sampled ids and multi-set similarities are no SQL; the
#: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
