"""The corpus pipeline: raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm.decontaminate import find_leaks
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_groups import keep_one_of_each_group
from tidemark.llm.quality_knn import quality_votes
from tidemark.llm.token_output import token_table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: SQL can express neither the votes of the classifier nor the draws of the mixture.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbours' votes accept, with all their columns.

    A NULL or empty text, or one under three bytes, has no vote and goes; repeated
    rows are kept or go alike; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_votes(docs, labels).where("quality_keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies, and all others in no group.

    Rows without a doc_id or a word are in no group and stay; rows that share a doc_id
    stay or go together; other columns pass; an empty table stays empty.
    """
    return keep_one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, with all their columns.

    NULL and empty texts hold none and stay; repeated rows are treated alike; an empty
    table stays empty.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark).where("size(leaked_items) = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the mixture as documents: doc_id is that of the first document in the block,
    so that it repeats where a document fills several blocks or a source is used again.

    Rows without a doc_id, a text or a token bring nothing; repeated rows are packed
    each time; the columns are those of documents, others are left out.
    """
    blocks = mix_sources(docs)
    return blocks.select(F.col("doc_ids")[0].alias("doc_id"), "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the text, all other columns beside them; NULL for a NULL text."""
    return token_table(spark, docs, VOCABULARY)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cluster.written(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
