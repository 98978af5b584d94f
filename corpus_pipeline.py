"""From raw documents to training shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

A null text counts as empty: it is scored as such, is like no other text, holds no benchmark item and has no
tokens. Texts are read whole, whatever their length. Repeated rows are decided alike; the second stage
keeps one of them if they have words. Ties go to the row that is smallest by id, then by its other columns' hash. Columns of
any name pass through. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helpcorpus.llm.common import TABLES, cleared, read, written
from helpcorpus.llm.decontaminate import decontaminated
from helpcorpus.llm.jaccard import one_of_each
from helpcorpus.llm.mixing import mixed_rows
from helpcorpus.llm.sharding import shuffle_shards
from helpcorpus.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the weakly supervised classifier calls toxic."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents whose five-word shingles are similar by 0.8 or more."""
    return one_of_each(docs, k=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage like a benchmark item."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and those of small sources again, up to twice, as their source's weight asks."""
    return mixed_rows(docs, max_repeats=2.0)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in a seeded order, dealt to 16 shards; a column of docs with the name of one of the new ones gives way to it."""
    return shuffle_shards(docs, 16, names=("size", None, None, "shard", "slot"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("benchmark_decontamination", drop_leaks), ("source_mixing", mix_sources), ("sharding", deal_shards)]

#: The classifier and the shuffles have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each read again from what the one before wrote; a stage's own tables go when it is done."""
    docs, earlier = read(spark, sf_dir, "documents"), list(TABLES)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            cleared(spark, keep=[*earlier, TABLES[-1]])
    return docs
