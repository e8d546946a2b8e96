"""Recordings to a timeline of who is active when."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.config import Chunks, ClusterOptions, Grid, Options, Thresholds
from tidemark.functions import grid as G
from tidemark.operators import activity, linkage, overlap_add, timeline, vectors, windowing
from tidemark.operators.scorer import BandSegmenter, Embedder, Segmenter, SpectrumEmbedder, embed_chunks, score_chunks

KEYS = ["file_id"]


def long_scores(scores: DataFrame) -> DataFrame:
    """``file_id, chunk_idx, frame_idx, spk, score``"""
    frames = scores.select("file_id", "chunk_idx", F.posexplode("frames").alias("frame_idx", "__row"))
    return frames.select("file_id", "chunk_idx", "frame_idx", F.posexplode("__row").alias("spk", "score"))


def assign_clusters(embeddings: DataFrame, options: ClusterOptions) -> DataFrame:
    """``file_id, chunk_idx, spk, cluster`` of every class of every chunk.

    Vectors that are present are clustered by file; then all are given to the nearest
    centroid, missing ones to cluster 0.  With ``constrained`` the classes of a chunk go
    to different clusters, -2 where none is left.
    """
    present = vectors.drop_missing(embeddings, "v")
    if options.max_embeddings is not None:
        rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.xxhash64("chunk_idx", "spk"), "chunk_idx", "spk"))
        present = present.withColumn("__r", rank).where(F.col("__r") <= options.max_embeddings).drop("__r")
    labels = linkage.cluster_groups(
        present, "file_id", ["chunk_idx", "spk"], "v", threshold=options.threshold, method=options.method, least_size=options.min_cluster_size, num=options.num_clusters, least=options.min_clusters, most=options.max_clusters, centroid_space=options.centroid_space
    )
    means = vectors.centroids(present.join(labels, ["file_id", "chunk_idx", "spk"]), ["file_id", "cluster"], "v")
    if not options.constrained:
        return vectors.assign_nearest(embeddings, means, ["chunk_idx", "spk"], "v", KEYS).select("file_id", "chunk_idx", "spk", "cluster")
    from tidemark.functions.arrays import cosine_distance

    soft = embeddings.join(means, "file_id").select("file_id", "chunk_idx", "spk", "cluster", (2 - cosine_distance("v", "centroid")).alias("s"))
    return linkage.constrained_assign(soft, ["file_id", "chunk_idx"], "spk", "cluster", "s")


def diarization(activations: DataFrame, counts: DataFrame, frame: Grid, origin: float) -> DataFrame:
    """``file_id, frame, cluster, active``: the counted number of clusters in each frame.

    activations lie on the grid from 0, counts on that from ``origin``; both are cropped
    to what they share, and frame 0 is the first shared one.
    """
    first = max(0, math.ceil((origin - frame.duration - frame.start) / frame.step))
    ends = counts.groupBy("file_id").agg((F.max("frame") + 1).alias("__n"))
    last = F.floor((F.lit(origin) + F.col("__n") * F.lit(frame.step) - F.lit(frame.start)) / F.lit(frame.step))
    shared = activations.join(ends, "file_id").where(F.col("frame").between(F.lit(first), last)).withColumn("frame", F.col("frame") - first).drop("__n")
    grid = shared.select("file_id", "frame").distinct().join(counts, ["file_id", "frame"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return timeline.top_by_count(shared, grid, KEYS)


def reconstruct(scores: DataFrame, assigned: DataFrame, counts: DataFrame, chunk: Grid, frame: Grid, frames: int, origin: float) -> DataFrame:
    """Scores by cluster, added up over chunks, then ``diarization``."""
    pooled = overlap_add.max_pool(scores, assigned, KEYS, "spk", "score")
    added = overlap_add.overlap_add(pooled, KEYS, "score", chunk, frame, frames, ["cluster"], skip_average=True, missing=0.0)
    return diarization(added, counts, frame, origin)


class Diarizer:
    """The whole plan, from blocks of samples (``file_id, blk, samples``) to intervals."""

    def __init__(self, options: Options | None = None, segmenter: Segmenter | None = None, embedder: Embedder | None = None) -> None:
        self.options = options or Options()
        shape = self.options.chunks
        self.segmenter = segmenter or BandSegmenter(shape.frames, shape.classes)
        self.embedder = embedder or SpectrumEmbedder()

    def run(self, blocks: DataFrame) -> DataFrame:
        """``file_id, start, end, label``"""
        shape: Chunks = self.options.chunks
        limits: Thresholds = self.options.thresholds
        chunk = Grid(step=shape.step / shape.rate, duration=shape.window / shape.rate)
        # 16.875 ms for a 5 s chunk of 293 frames; in general a chunk's frames leave a margin
        step = 0.016875 * (shape.window / shape.rate) / 5.0 * 293 / shape.frames
        frame = Grid(step=step, duration=step)

        chunks = windowing.block_chunks(blocks, "file_id", "blk", "samples", shape.window // shape.step, shape.step)
        # models are the dearest step and their results are used several times: they run once
        spark = blocks.sparkSession
        scores = long_scores(cluster.written(spark, score_chunks(chunks, self.segmenter, shape), "scores"))
        active = activity.hysteresis(scores, ["file_id", "chunk_idx", "spk"], "frame_idx", "score", limits.onset, limits.offset, initial=False)
        counts = overlap_add.active_count(active, KEYS, "on", chunk, frame, shape.frames, limits.trim)
        clean = activity.clean_masks(active, ["file_id", "chunk_idx", "frame_idx"])
        least = math.ceil(shape.frames * limits.min_samples / shape.window)
        used = activity.used_masks(clean, ["file_id", "chunk_idx", "spk"], least)
        by_class = used.groupBy("file_id", "chunk_idx", "spk").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_idx", "used"))), lambda x: x["used"]).alias("m"))
        masks = by_class.groupBy("file_id", "chunk_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("spk", "m"))), lambda x: x["m"]).alias("masks"))
        embedded = embed_chunks(chunks.join(masks, ["file_id", "chunk_idx"]), self.embedder, shape, limits.min_samples, self.options.clustering.batch32)
        embeddings = cluster.written(spark, embedded, "embeddings")
        assigned = assign_clusters(embeddings, self.options.clustering)
        totals = activity.activity_totals(active, ["file_id", "chunk_idx", "spk"])
        assigned = activity.mark_inactive(assigned, totals, ["file_id", "chunk_idx", "spk"])
        origin = limits.trim[0] * chunk.duration
        final = reconstruct(scores, assigned, counts, chunk, frame, shape.frames, origin)
        return self.intervals(final, frame, origin)

    def intervals(self, final: DataFrame, frame: Grid, origin: float) -> DataFrame:
        limits = self.options.thresholds
        first = max(0, math.ceil((origin - frame.duration) / frame.step))
        grid = Grid(step=frame.step, duration=frame.duration, start=first * frame.step)
        keys = ["file_id", "cluster"]
        on = activity.hysteresis(final, keys, "frame", "active", limits.final_onset, limits.final_offset, initial=False)
        found = timeline.runs(on, keys, "frame", "on", G.frame_middle("frame", grid))
        if limits.min_duration_off > 0:
            found = timeline.close_gaps(found, keys, limits.min_duration_off)
        if limits.min_duration_on > 0:
            found = timeline.drop_short(found, limits.min_duration_on)
        named = found.select("file_id", "start", "end", F.concat(F.lit("Speaker_"), F.col("cluster").cast("string")).alias("label"))
        return named.orderBy("file_id", "start", "end", "label")
