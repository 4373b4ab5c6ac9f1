"""From raw documents to tokens: select, deduplicate, decontaminate, redact, encode.

Every stage takes all that the one before kept; a filtering stage returns the columns of documents. Nulls in any
column, empty texts, repeated rows and empty tables go through as the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaweave.llm import bpe, decontam, jaccard, quality, secrets
from areaweave.llm._common import remove, written
from areaweave.llm.queries import tokenizer_path


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps: those beyond the line at which the model with heavier rare grades is undecided."""
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score(docs, model, keep_col="__keep").where("__keep").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: that of least id, of equal ones the first by its other columns."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` follows the text where a mask changed it."""
    found = secrets.redact(secrets.find(docs))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document by id with its source and language, its number of tokens, and the packed ids."""
    made = bpe.encode(docs, tokenizer_path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])
    return made.select("doc_id", "lang", "source", (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), "ids_le")


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("BPE encoding", encode_tokens),
]

#: The classifier and the tokenizer can't be told in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage wrote goes once the next one has written; what the last one reads stays until the session ends.
    """
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs, new = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if old:
            remove(spark, old)
        old = new
    return STAGES[-1][1](spark, docs, sf_dir)
