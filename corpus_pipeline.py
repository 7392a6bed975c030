"""The corpus pipeline: stages that read and return tables with the columns of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crestline.llm import mixing, neardup, packing, substring, toxicity
from crestline.llm.common import pipeline_stage, table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar doesn't reject; its labels are those of the tables."""
    with pipeline_stage(docs):
        return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component, that of the first document."""
    with pipeline_stage(docs):
        return neardup.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has."""
    with pipeline_stage(docs):
        return substring.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the mix of sources. Parquet does not promise that order to its
    readers: ``packed`` computes the places again and follows them."""
    with pipeline_stage(docs):
        return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in training sequences, whose numbers follow the mix."""
    with pipeline_stage(docs):
        return in_mix_order(docs)


def in_mix_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` packed with ``options`` in the order of the mix. Only numbers move: a document's place in
    the mix goes to its pieces by the number of its row."""
    parts = written(packing.pieces(docs, with_source=True), "pieces")
    places = mixing.interleaved(parts.filter("piece = 0").select("row", "doc_id", "source")).select("row", "position")
    return packing.pack(parts.join(places, "row"), **options)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("near-duplicates", near_duplicates),
    ("repeated-passages", repeated_passages),
    ("source-mix", source_mix),
    ("packing", packed),
]
#: Learned scores, signatures and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
