"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on every document that its predecessor kept;
`run` writes each stage's result as Parquet in the shared folder and reads it again for the next.
All stages but the last return the columns of documents; the last adds the ids of the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfinder.llm import mixing, neardup, pieces, quality, secrets
from wayfinder.functions.scratch import Scratch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the decision list learned from the labels.

    Each row is judged by itself: rows that repeat or tie go or stay together, a null or empty text
    goes, a null id is judged but never learned from, a text of any length is read whole. Columns
    of any name are kept; an empty table stays empty.
    """
    rules = quality.learn_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, rules).where("_wf_stats.kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates by five-word shingles.

    Rows that share an id are documents of their own if their texts are unlike, and else one of
    them, by a fixed order, stays. A null id and a document without words stay. Texts of any length
    are compared whole, columns of any name are kept, an empty table stays empty.
    """
    return neardup.deduplicate(docs, shingle=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in a text replaced by a mark and n_chars counted again.

    Rows that repeat are marked alike; null and empty texts stay as they are, as do null ids and
    columns of any name. Texts of any length are scanned whole; an empty table stays empty.
    """
    return secrets.redact_documents(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, drawn by weights from their quality labels.

    A null source is a source of its own; a null id is drawn as the empty one; rows without words
    are in no mix. Rows that tie share what is left at a source's cut-off, so reruns agree. Columns
    of any name are kept; an empty table stays empty.
    """
    return mixing.mix(docs, mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, n_tokens, n_bytes and round_trip, which replace columns of their names.

    A null text has null ids, an empty one none; each row is encoded by itself, whole.
    """
    return pieces.encode(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing to target weights", mixing_weights),
    ("sentencepiece encoding", piece_encoding),
]

#: The decision list is learned from the data, which SQL cannot express; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
