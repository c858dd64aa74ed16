"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination,
mixing and sharding, each stage over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontamination, mixing, near_dup, sharding, toxicity
from spanloom.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the lexicon is learned from the
    labelled rows that may be used for training.

    Null and empty texts count as empty; rows without a doc_id, repeated rows
    and very long texts are judged by their whole text; columns stay as they
    are, whatever their names; an empty table gives an empty result.
    """
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"))
    lexicon = toxicity.fit(docs.select("doc_id", "text"), labels)
    return toxicity.reject_toxic(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least
    doc_id.

    Null texts count as empty, and all empty ones are equal; rows without a
    doc_id come last in their group; repeated rows collapse; columns stay as
    they are; an empty table gives an empty result.
    """
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null and empty texts stay; each row is judged by its own text, whatever its
    doc_id; items without an item_id count too; columns stay as they are; an
    empty table on either side changes nothing.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it.

    Null texts have no words; a null source is a source, the last; a source
    without words gives nothing; repeated rows decide alike; columns stay as
    they are; an empty table gives an empty result.
    """
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row along the Hilbert curve.

    Null texts count as empty, null sources and languages have their own place;
    equal rows have slots of their own; an empty table gives an empty result.
    """
    return sharding.assign(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL expresses neither the learned lexicon nor order MinHash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
