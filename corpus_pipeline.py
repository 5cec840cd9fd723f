"""A corpus pipeline of five of the operators in siftworks.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from siftworks.llm import line_dedup, pareto_mix, simhash_gray, sp_tokenizer, toxicity_fm
from siftworks.llm.common import bounded_batches, checkpoint_dir, documents, drop_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go.

    Null and empty texts have the base score and stay, texts of any length are scored whole, equal texts are treated alike. Without labels
    of both kinds nothing is learned: without toxic ones all stay. An empty table stays empty; all columns stay, whatever their names.
    """
    bounded_batches(spark)
    return toxicity_fm.keep_clean(docs, toxicity_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat a line kept elsewhere go; all documents stay.

    Null and empty texts stay as they are; a text that loses all lines is empty. Lines of any length are compared whole. Ties go to the least
    (doc_id, line); rows that repeat id and text keep the same lines. An empty table stays empty; all columns stay, n_chars follows the text.
    """
    bounded_batches(spark)
    return line_dedup.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least doc_id.

    Null and empty texts are one group. Of rows that repeat the least id one stays, that of the least text hash; rows without an id stay. Texts
    of any length count whole. An empty table stays empty; all columns stay, whatever their names.
    """
    bounded_batches(spark)
    return simhash_gray.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled or repeated to their source's share of words.

    Null sources are one source; texts without a word, null ones too, stay once. Repeated rows share their copies; ties in rank go by doc_id. Texts
    of any length count whole. An empty table stays empty; all columns stay, whatever their names.
    """
    bounded_batches(spark)
    return pareto_mix.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become tokens: their number and hash, whether they decode to the text, and whether the other library makes the same.

    Null and empty texts have no tokens; repeated rows give equal rows; texts of any length are encoded whole. An empty table gives an
    empty result. Columns other than doc_id and text are not looked at.
    """
    bounded_batches(spark)
    return sp_tokenizer.token_report(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("SimHash near-dedup", drop_near_duplicates), ("mixing sources to target weights", mix_sources), ("SentencePiece encoding and decoding", tokenize)]

# Trained scores, bit-wise fingerprints and tokens have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What is between them is kept under the shared checkpoint folder until the next stage is written."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if before is not None:
            drop_table(before)
        docs = before = spark.read.parquet(f"{folder}/{k}")
    return docs
