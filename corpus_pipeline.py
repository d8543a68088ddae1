"""A corpus pipeline of five stages over documents, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingmill.llm import bpe, exact_dedup, mixing, quality, queries, simhash_dedup
from listingmill.llm.common import drop_rows, new_path, with_row_key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Defined cases: a null or empty text has the score of one that neither dictionary fits better;
    texts of any length are scored whole; null and repeated ids are scored row by row; an empty
    table stays empty; other columns, of any name, are passed on.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the largest id, of each group of equal texts.

    Defined cases: a null text equals the empty one; a null id is smaller than any id; of rows that
    share text and id one stays, and rows that share an id alone stay each by its own text; an empty table
    stays empty; other columns, of any name, are passed on.
    """
    rows, key = with_row_key(docs)
    return drop_rows(rows, key, exact_dedup.exact_duplicates(rows, row_col=key).where("NOT kept").select("row"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Shingles, links and groups are those that the contract of op 4 states. Defined cases: null and
    blank texts are one group; a null id is larger than any id; of rows that share the smallest id
    one stays; an empty table stays empty; other columns, of any name, are passed on.
    """
    rows, key = with_row_key(docs)
    return drop_rows(rows, key, simhash_dedup.near_duplicates(rows, row_col=key).where("NOT kept").select("row"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that rake the corpus to the target weights.

    Defined cases: null source or language counts as a value without target; a null text has no
    tokens; rows that share an id, or have none, are drawn alike; an empty table stays empty;
    other columns, of any name, are passed on.
    """
    return mixing.sampled(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the ids and the text decoded from them of every document that is left.

    Defined cases: a null text has no tokens; texts of any length are encoded whole; null and
    repeated ids each get a row; an empty table gives an empty result; other columns are not read.
    """
    out = bpe.encode(docs, queries.vocabulary(), decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Compression, SimHash, raking and BPE have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
