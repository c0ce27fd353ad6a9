"""From raw documents to token ids: five stages, each one of the training-data operators.

Every stage takes the whole table that the one before kept and returns the
columns of documents; the last returns the encoded table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emendra.llm import byte_bpe, decontaminate, exact_dedup, near_copies, toxicity
from emendra.llm.common import one_row_per, own_names, shared_folder, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict to be toxic."""
    model = toxicity.fit_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def _one_of_each(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """One row of `docs` for each of `winners` (doc_id, sha: the digest of the text); null ids are equal here. Texts are dealt out once."""
    id_, sha = own_names(docs, "id", "sha")
    plain = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = exact_dedup.with_digest(docs, sha).withColumn(id_, plain)
    kept = keyed.join(winners.select(plain.alias(id_), F.col("sha").alias(sha)), [id_, sha], "left_semi")
    return one_row_per(kept, id_, sha).select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text that is equal after lower-casing A-Z: the one with the largest id."""
    kept = exact_dedup.exact_dedup(docs.select("doc_id", "text")).where("kept")
    return _one_of_each(docs, kept.select("doc_id", F.col("text_sha256").alias("sha")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; null ids come last.

    Near copies have a five-word Jaccard similarity of 0.8 or more, directly or
    over others. SimHash finds most; an exact join finds those that are further
    apart than its radius; all are verified.
    """
    classes = near_copies.near_copy_classes(docs.select("doc_id", "text"))
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "sha")).alias("first"))
    return _one_of_each(docs, first.select("first.doc_id", "first.sha"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of ten words with the benchmark."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): token ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
    coded = byte_bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level bpe", encode),
]

#: Neither the classifier nor SimHash fingerprints can be said in SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written as Parquet to the shared folder and read again.

    A stage's folder is deleted once the next stage is written; the last one stays, as the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            _delete(spark, f"{folder}/{number - 1}")
    return docs
