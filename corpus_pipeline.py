"""A corpus made ready for training: what is toxic goes, near-duplicates go, personal data is masked, sources are mixed, texts are encoded.

STAGES are run in order, each on what the one before has left: written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm.bpe import encode_documents
from tidepanel.llm.common import arrow_batches, cut, set_aside, table
from tidepanel.llm.mixing import mixed
from tidepanel.llm.ngram_join import one_of_each
from tidepanel.llm.pii import redact
from tidepanel.llm.toxicity import score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, doesn't call toxic, with all their columns, also those that
    are called like the classifier's. Documents without text or labels are judged like others; repeated rows alike; none, if there are none."""
    arrow_batches(spark, 1000)
    apart, back = set_aside(docs, ["held_out", "score", "predicted", "worst"])
    return score_toxicity(apart, table(spark, sf_dir, "labels")).where("predicted = 0").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id (null last); documents without words stay."""
    arrow_batches(spark, 500)
    return one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, one row for each row; null texts stay null."""
    arrow_batches(spark, 1000)
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice. A null source is one of its own; texts without words
    are taken while their turn comes."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to; a null text has none."""
    arrow_batches(spark, 500)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("personal_data", mask_personal_data), ("mixing", mix_sources), ("encoding", encode)]

#: No SQL: the classifier, the graph search and the merges have no such form; a test holds run() against a plain version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut(docs) if k else docs, sf_dir)
    return docs
