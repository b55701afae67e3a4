"""The corpus pipeline: quality rules, near-duplicates, repeated passages, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import doubling, mixing, packing, quality, queries, simhash
from lodestat.llm.common import documents, written

#: Pieces of one packed sequence, and its sum of squared lengths. A longer piece than ATTENTION allows has a sequence of its own.
MOST_DOCS, ATTENTION = 6, 0.9 * 1024**2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base filter or the fitted votes reject go; null texts have no words and go with them."""
    return quality.quality_filter(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups by links of Jaccard similarity 0.8 or more between sets of five-word shingles; one row of each stays."""
    return simhash.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of a 20-word window that starts earlier too go; a text of which all goes stays as an empty row."""
    return doubling.without_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the weights of their sources, each once for every time that its blocks are taken, twice at most."""
    return mixing.mixed_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """At most MOST_DOCS pieces and ATTENTION of squared lengths in a sequence, beside its 1024 tokens."""
    return packing.pack_documents(docs, queries.tokenizer_path(), max_docs=MOST_DOCS, max_attention=ATTENTION)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("source mix", mix_stage),
    ("best-fit packing", packing_stage),
]

#: Jaccard links, tokenizer ids and the fitted vote model are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if i < len(STAGES) - 1:
            rows = written(rows, name.replace(" ", "-"))
    return rows
