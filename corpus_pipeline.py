"""A corpus pipeline out of the operators of ``tidemark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again for the next one. All stages but the last return the columns of their documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, quality, secrets, simhash
from tidemark.llm._common import free_name, remainder, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It learns from labels of four fifths of the ids."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the document with the least id, documents without an id last.

    Near is as in ``op3_simhash``, whose contract the stage follows: shingles of three words and at most
    3 of 64 bits apart. Most copies of a similarity of 0.8 to 0.95 are further apart and stay (see the README).

    Rows are told apart by id and content, so rows without an id or with the same one are documents
    of their own, and of rows that are wholly equal one stays. The choice is made on ids and hashes;
    texts are shuffled once, for the rows that stay.
    """
    key = free_name(docs.columns, "row_key")
    readable = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema]
    content = F.xxhash64(*[x for c in readable for x in (c.isNull(), c)])
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), content.alias("content")))
    found = simhash.near_duplicates(keyed, id_col=key)
    firsts = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key))
    return keyed.join(firsts, key, "left_semi").dropDuplicates([key]).drop(key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a window of a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``<secret>`` in place of secrets; a null text becomes an empty one."""
    clean = secrets.redact_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("BPE encoding", encoding_stage),
]
#: Most stages are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them go to the shared folder named in ``spark.checkpoint.dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
