"""One document of each group of near copies.

Groups are the connected components of the pairs of the n-gram Jaccard join, found
by alternating large-star and small-star steps: each links a node's neighbours to
the smallest of them, until nothing changes.  Edges are numbers only; each round is
written to the shared folder, which ends its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.llm.arrow import fresh
from tidemark.llm.ngram_jaccard import ngram_jaccard_edges


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (node, other) with node > other to those of one step."""
    if large:
        both = edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
    else:
        both = edges
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    joined = both.join(least, "node")
    if large:
        made = joined.where("other > node").select(F.col("other").alias("node"), F.col("least").alias("other"))
    else:
        made = joined.select(F.col("other").alias("node"), F.col("least").alias("other")).union(least.select("node", F.col("least").alias("other")))
    return made.where("node > other").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """``doc_id, root`` of every node that isn't its component's smallest, from pairs ``doc_a, doc_b``."""
    spark = pairs.sparkSession
    edges = pairs.select(F.greatest("doc_a", "doc_b").alias("node"), F.least("doc_a", "doc_b").alias("other")).where("node > other").distinct()
    edges = cluster.written(spark, edges, "edges")
    before = None
    while True:
        edges = cluster.written(spark, _star(_star(edges, True), False), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("node").alias("doc_id"), F.col("other").alias("root"))
        before = state


def keep_one_of_each_group(docs: DataFrame, n: int = 5, threshold: float = 0.4) -> DataFrame:
    """``docs`` without those documents whose group of near copies has a smaller doc_id.

    Groups are connected: a document goes too when it is near one that is near the
    smallest.  Texts that are NULL or have no word, and rows without a doc_id, are in
    no group and stay; rows that share a doc_id stay or go together.  Other columns
    pass unchanged; an empty table stays empty.
    """
    id_ = fresh("gone")
    gone = components(ngram_jaccard_edges(docs, n, threshold)).select(F.col("doc_id").alias(id_))
    return docs.join(cluster.written(docs.sparkSession, gone, "gone"), F.col("doc_id").cast("bigint") == F.col(id_), "left_anti")
