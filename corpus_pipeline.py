"""A corpus from documents: classify, check by rules, fold near-duplicates, mix sources, encode.

Every stage takes the columns of documents, whatever else there is, and any rows: null and empty texts, repeated rows and ids, none at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetwise.llm import mixing, piece_codec, quality_cnn, quality_rules, simhash
from sheetwise.llm.common import materialize, read_table, remove_work, work_mark


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on labels of docs, doesn't reject. Without labels it scores 0.5 and all go."""
    return quality_cnn.keep_good(docs, quality_cnn.fit(docs, read_table(spark, sf_dir, "labels")))


def check(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that keep to the threshold table; null and empty texts go."""
    return quality_rules.keep_by_rules(docs)


def fold(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest doc_id; repeated rows are copies."""
    return simhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, a null source being one of its own; empty texts are taken like others."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of digests for each row; a null text is an empty one."""
    import public_tokenizers

    return piece_codec.digest_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality classifier", classify), ("quality rules", check), ("near-duplicates", fold), ("mixing", mix), ("encoding", encode)]
#: The classifier and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written as Parquet to the shared folder and read again; what it wrote for itself is then deleted."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        mark = work_mark()
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
        remove_work(spark, mark, keep_last=True)
    return STAGES[-1][1](spark, docs, sf_dir)
