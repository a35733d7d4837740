"""A corpus pipeline of five of the operators in :mod:`colophon.llm`.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``; where a text
changes, ``n_chars`` follows it.  Extra columns of ``docs`` are dropped, null
texts count as empty, repeated rows are handled as the operators' docstrings
say, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from colophon.llm.common import keep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Stages on word shingles: five words, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_NUM, SIMILAR_DEN = 5, 80, 100


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the threshold; learns from all labelled documents."""
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.clean(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops frequent lines from all documents but the last that holds them."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates; rows without an id are in no group."""
    docs = docs.select(*COLUMNS)
    groups = jaccard_join.near_components(docs.select("doc_id", "text"), words=SHINGLE_WORDS, num=SIMILAR_NUM, den=SIMILAR_DEN)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's words towards its target; a row for each pass over a document."""
    docs = docs.select(*COLUMNS)
    plan = keep(mixing.plan_mix(docs.select("doc_id", "text", "source")), "mix-plan")
    mixed = mixing.apply_mix(docs, plan)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the mix and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokeniser cannot be expressed in SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, f"stage-{name}")
    return docs
