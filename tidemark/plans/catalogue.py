"""Every operator as a query over the driver's tables, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import cluster
from tidemark.config import ClusterOptions, Grid, Options
from tidemark.functions import arrays as A
from tidemark.functions import grid as G
from tidemark.functions import segments as S
from tidemark.functions import spectral
from tidemark.operators import activity, intervals, linkage, overlap_add, timeline, vectors, windowing
from tidemark.plans import diarize
from tidemark.sources import wav
from tidemark.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CHUNK = Grid(step=4.0, duration=10.0)
FRAME = Grid(step=1.37, duration=1.37)
FINE = Grid(step=0.016875, duration=0.016875)


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, frame, value, event_type``: each user's events in order."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint")
    return events.select("user_id", frame.alias("frame"), "value", "event_type")


SEQ = "seq AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, event_type FROM events)"
LENS = "lens AS (SELECT user_id, max(frame) + 1 AS n FROM seq GROUP BY user_id)"


def _slid(step: int) -> str:
    return f"""{SEQ}, {LENS},
grid AS (SELECT user_id, unnest(range(0, CAST(1 + ceil(greatest(n - 10, 0) / {step}e0) AS BIGINT))) AS c FROM lens),
sc AS (SELECT g.user_id, g.c AS chunk_idx, s.frame - g.c * {step} AS frame_idx, s.value FROM grid g
       JOIN seq s ON s.user_id = g.user_id AND s.frame >= g.c * {step} AND s.frame < g.c * {step} + 10)"""


# grids and windows


@query(f"""WITH {SEQ}, {LENS},
grid AS (SELECT user_id, unnest(range(0, CAST(1 + ceil(greatest(n - 10, 0) / 2e0) AS BIGINT))) AS c FROM lens)
SELECT user_id, CAST(c AS INTEGER) AS chunk_idx, c * 0.5e0 AS start, c * 0.5e0 + 2.5e0 AS "end" FROM grid""")
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return windowing.chunk_grid(lengths, ["user_id"], "n", 10, 2, rate=4.0)


@query("""SELECT event_id, CAST(greatest(0e0, CAST(round_even((value - 0e0 - 0.0084375e0) / 0.016875e0, 0) AS DOUBLE)) AS BIGINT) AS frame,
0e0 + (event_id % 1000) * 0.016875e0 AS window_start, (0e0 + (event_id % 1000) * 0.016875e0) + 0.016875e0 AS window_end FROM events""")
def closest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = G.window_at(F.col("event_id") % 1000, FINE)
    return table(spark, sf_dir, "events").select("event_id", G.closest_frame("value", FINE).alias("frame"), w["start"].alias("window_start"), w["end"].alias("window_end"))


@query("""WITH s AS (SELECT event_id, value AS a, value + (event_id % 100) / 10e0 AS b FROM events),
r AS (SELECT event_id, CAST(greatest(0e0, CAST(round_even((a - 0e0 - 0.685e0) / 1.37e0, 0) AS DOUBLE)) AS BIGINT) AS first, CAST(floor(greatest(b - a, 0e0) / 1.37e0) + 1 AS BIGINT) AS n FROM s)
SELECT event_id, first, n, round(CASE WHEN first = 0 THEN 0e0 ELSE 0e0 + (first - 0.5e0) * 1.37e0 + 0.685e0 END, 6) AS start,
round(0e0 + (first - 0.5e0) * 1.37e0 + 0.685e0 + n * 1.37e0, 6) AS "end" FROM r""")
def segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("a"), (F.col("value") + (F.col("event_id") % 100) / F.lit(10.0)).alias("b"))
    ranged = events.select("event_id", G.segment_to_range("a", "b", FRAME).alias("r")).select("event_id", "r.first", "r.n")
    s = G.range_to_segment("first", "n", FRAME)
    return ranged.select("event_id", "first", "n", F.round(s["start"], 6).alias("start"), F.round(s["end"], 6).alias("end"))


def slid(spark: SparkSession, sf_dir: str, step: int) -> DataFrame:
    return windowing.slide(sequence(spark, sf_dir), ["user_id"], "frame", ["value"], 10, step)


@query(f"""WITH {_slid(2)} SELECT user_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(frame_idx AS INTEGER) AS frame_idx, value FROM sc""")
def slide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slid(spark, sf_dir, 2)


@query(f"""WITH {_slid(2)}, c AS (SELECT DISTINCT user_id, chunk_idx FROM sc), k AS (SELECT *, unnest(range(0, 10)) AS frame_idx FROM c)
SELECT k.user_id, CAST(k.chunk_idx AS INTEGER) AS chunk_idx, CAST(k.frame_idx AS INTEGER) AS frame_idx, coalesce(sc.value, 0e0) AS score
FROM k LEFT JOIN sc ON sc.user_id = k.user_id AND sc.chunk_idx = k.chunk_idx AND sc.frame_idx = k.frame_idx""")
def chunk_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = windowing.chunk_arrays(slid(spark, sf_dir, 2), ["user_id"], "value", 10)
    return padded.select("user_id", "chunk_idx", F.posexplode("frames").alias("frame_idx", "score"))


def user_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id, xs, mask``: a user's values, and which of them are over 50."""
    rows = sequence(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda x: x["value"]).alias("xs"), F.transform("s", lambda x: x["value"] > 50).alias("mask"))


@query(f"""WITH {SEQ}, u AS (SELECT DISTINCT user_id FROM seq), k AS (SELECT user_id, unnest(range(0, 8)) AS k FROM u)
SELECT k.user_id, CAST(k.k AS INTEGER) AS k, coalesce(s.value, 0e0) AS x FROM k LEFT JOIN seq s ON s.user_id = k.user_id AND s.frame = k.k + k.user_id % 7 - 3""")
def crop_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_arrays(spark, sf_dir).select("user_id", F.posexplode(A.crop_padded("xs", F.col("user_id") % 7 - 3, 8)).alias("k", "x"))


@query(f"""WITH {_slid(2)} SELECT user_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, CAST(frame_idx - 2 AS INTEGER) AS frame_idx, value FROM sc WHERE frame_idx >= 2 AND frame_idx < 9""")
def trim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowing.trim(slid(spark, sf_dir, 2), 10, 0.2, 0.1)


@query(f"""WITH {SEQ} SELECT user_id, frame - greatest(CAST(ceil((10e0 - 1.37e0 - 0e0) / 1.37e0) AS BIGINT), 0) AS frame, value FROM seq
WHERE frame BETWEEN greatest(CAST(ceil((10e0 - 1.37e0 - 0e0) / 1.37e0) AS BIGINT), 0) AND CAST(floor((30e0 - 0e0) / 1.37e0) AS BIGINT)""")
def crop_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence(spark, sf_dir).withColumn("a", F.lit(10.0)).withColumn("b", F.lit(30.0))
    return windowing.crop(rows, "frame", "a", "b", FRAME).select("user_id", "frame", "value")


@query(f"""WITH {SEQ}, {LENS}, w AS (SELECT user_id, n, CAST(floor((n - 4e0) / 2e0) AS BIGINT) AS m FROM lens WHERE n >= 4),
x AS (SELECT user_id, unnest(range(0, m + 1)) * 2e0 AS start FROM w UNION ALL SELECT user_id, n - 4e0 FROM w WHERE m * 2 + 4 < n)
SELECT user_id, start, start + 4e0 AS "end" FROM x""")
def slide_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = sequence(spark, sf_dir).groupBy("user_id").agg(F.lit(0.0).alias("start"), (F.max("frame") + 1).cast("double").alias("end"))
    return windowing.slide_support(support, ["user_id"], Grid(step=2.0, duration=4.0), align_last=True)


@query(f"""WITH {SEQ} SELECT user_id, frame // 32 AS batch_id, (frame // 3) AS chunk, frame % 3 AS spk, max(value) OVER (PARTITION BY user_id, frame // 32) AS batch_max FROM seq""")
def batch_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windowing.batches(sequence(spark, sf_dir), "frame", 32)
    rows = rows.withColumn("batch_max", F.max("value").over(Window.partitionBy("user_id", "batch_id")))
    return windowing.fold(rows, "frame", 3, "chunk", "spk").select("user_id", "batch_id", "chunk", "spk", "batch_max")


@query(f"""WITH {SEQ}, {LENS}, k AS (SELECT user_id, n, unnest(range(0, 25)) AS j FROM lens)
SELECT k.user_id, CAST(k.j AS INTEGER) AS j, s.value > 50 AS on_ FROM k JOIN seq s ON s.user_id = k.user_id AND s.frame = CAST(floor(k.j * k.n / 25e0) AS BIGINT)""")
def mask_upsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_arrays(spark, sf_dir).select("user_id", F.posexplode(A.upsample_mask("mask", 25)).alias("j", "on_"))


@query(f"""WITH {SEQ}, g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY frame) - 1 AS k, value AS x FROM seq WHERE value > 50)
SELECT s.user_id, CAST(s.frame AS INTEGER) AS k, coalesce(g.x, 0e0) AS x FROM seq s LEFT JOIN g ON g.user_id = s.user_id AND g.k = s.frame""")
def masked_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_arrays(spark, sf_dir).select("user_id", F.posexplode(A.gather_padded("xs", "mask")).alias("k", "x"))


@query(f"""WITH {SEQ} SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, frame) - 1 AS INTEGER) AS rank, CAST(frame AS INTEGER) AS frame FROM seq""")
def argsort_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_arrays(spark, sf_dir).select("user_id", F.posexplode(A.argsort("xs")).alias("rank", "frame"))


@query(f"""WITH {SEQ} SELECT user_id, CAST(arg_min(frame, (-value, frame)) AS INTEGER) AS best, CAST(count(*) FILTER (value > 50) AS INTEGER) AS n_on FROM seq GROUP BY user_id""")
def argmax_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_arrays(spark, sf_dir).select("user_id", A.argmax("xs").cast("int").alias("best"), F.size(A.nonzero("mask")).alias("n_on"))


# activity


@query(f"""WITH {SEQ}, w AS (SELECT *, CASE WHEN value > 50 THEN 1 WHEN value < 50 THEN 0 END AS c, CAST(first_value(value) OVER (PARTITION BY user_id ORDER BY frame) >= 50 AS INTEGER) AS i FROM seq)
SELECT user_id, frame, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), i) AS active FROM w""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.hysteresis(sequence(spark, sf_dir), ["user_id"], "frame", "value", 50).select("user_id", "frame", F.col("on").alias("active"))


HYST = f"""{SEQ}, w AS (SELECT *, CASE WHEN value > 50 THEN 1 WHEN value < 20 THEN 0 END AS c, CAST(first_value(value) OVER (PARTITION BY user_id ORDER BY frame) >= 35 AS INTEGER) AS i FROM seq),
hy AS (SELECT user_id, frame, coalesce(last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), i) AS active FROM w)"""


def two_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.hysteresis(sequence(spark, sf_dir), ["user_id"], "frame", "value", 50, 20)


@query(f"WITH {HYST} SELECT user_id, frame, active FROM hy")
def hysteresis_two_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_threshold(spark, sf_dir).select("user_id", "frame", F.col("on").alias("active"))


@query(f"WITH {HYST} SELECT user_id, frame, CAST(sum(active) OVER (PARTITION BY user_id ORDER BY frame) AS BIGINT) AS n FROM hy")
def cumulative_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return two_threshold(spark, sf_dir).select("user_id", "frame", F.sum("on").over(order).alias("n"))


DAYS = """act AS (SELECT user_id, CAST(day(ts) AS INTEGER) AS day, event_type, CAST(max(value) > {0} AS INTEGER) AS on_, max(value) AS peak FROM events GROUP BY user_id, day(ts), event_type)"""


def by_day(spark: SparkSession, sf_dir: str, threshold: float) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").alias("day"), "event_type").agg(F.max("value").alias("peak"))
    return events.withColumn("on", (F.col("peak") > threshold).cast("int"))


@query(f"""WITH {DAYS.format(50)} SELECT user_id, day, event_type, on_, CASE WHEN sum(on_) OVER (PARTITION BY user_id, day) < 2 THEN on_ ELSE 0 END AS clean FROM act""")
def overlap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.clean_masks(by_day(spark, sf_dir, 50), ["user_id", "day"]).select("user_id", "day", "event_type", F.col("on").alias("on_"), "clean")


@query(f"""WITH {DAYS.format(50)}, c AS (SELECT *, CASE WHEN sum(on_) OVER (PARTITION BY user_id, day) < 2 THEN on_ ELSE 0 END AS clean FROM act)
SELECT user_id, day, event_type, CASE WHEN sum(clean) OVER (PARTITION BY user_id, event_type) > 3 THEN clean ELSE on_ END AS used FROM c""")
def used_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = activity.clean_masks(by_day(spark, sf_dir, 50), ["user_id", "day"])
    return activity.used_masks(clean, ["user_id", "event_type"], 3).select("user_id", "day", "event_type", "used")


@query(f"""WITH {DAYS.format(50)} SELECT user_id, event_type, CAST(sum(on_) AS BIGINT) AS n_active, CASE WHEN sum(on_) >= 4 THEN max(peak) END AS peak FROM act GROUP BY user_id, event_type""")
def too_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_day(spark, sf_dir, 50)
    totals = rows.groupBy("user_id", "event_type").agg(F.sum("on").alias("n_active"), F.max("peak").alias("peak"))
    return activity.drop_short_rows(totals, "peak", 4)


@query(f"""WITH {DAYS.format(100)} SELECT user_id, event_type, CASE WHEN sum(on_) = 0 THEN -2 ELSE CAST(user_id % 5 AS INTEGER) END AS cluster FROM act GROUP BY user_id, event_type""")
def inactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = by_day(spark, sf_dir, 100)
    keys = ["user_id", "event_type"]
    assigned = rows.select(*keys, (F.col("user_id") % 5).cast("int").alias("cluster")).distinct()
    return activity.mark_inactive(assigned, activity.activity_totals(rows, keys), keys)


# overlap-add

START = "CAST(greatest(0e0, CAST(round_even((({0}e0 + chunk_idx * 4e0) - {0}e0 - 0.685e0) / 1.37e0, 0) AS DOUBLE)) AS BIGINT)"
END = "CAST(round_even((({0}e0 + chunk_idx * 4e0 + {1}e0) - {0}e0 - 0.685e0) / 1.37e0, 0) AS BIGINT)"


@query(f"""WITH {_slid(4)}, p AS (SELECT user_id, {START.format(0)} + frame_idx AS frame, value FROM sc)
SELECT user_id, frame, round(sum(value) / count(value), 6) AS value FROM p GROUP BY user_id, frame""")
def overlap_add_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = overlap_add.overlap_add(slid(spark, sf_dir, 4), ["user_id"], "value", CHUNK, FRAME, 10)
    return got.withColumn("value", F.round("value", 6))


@query(f"""WITH {_slid(4)}, p AS (SELECT user_id, {START.format(0)} + frame_idx AS frame, {END.format(0, 10)} AS fin, value FROM sc),
t AS (SELECT user_id, frame, sum(value) AS v FROM p GROUP BY user_id, frame), e AS (SELECT user_id, unnest(range(0, greatest(max(frame), max(fin)) + 1)) AS frame FROM p GROUP BY user_id)
SELECT e.user_id, e.frame, round(coalesce(t.v, 0e0), 6) AS value FROM e LEFT JOIN t ON t.user_id = e.user_id AND t.frame = e.frame""")
def overlap_add_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = overlap_add.overlap_add(slid(spark, sf_dir, 4), ["user_id"], "value", CHUNK, FRAME, 10, skip_average=True, missing=0.0)
    return got.withColumn("value", F.round("value", 6))


@query(f"""WITH {_slid(4)}, p AS (SELECT user_id, {START.format(0)} + frame_idx AS frame, value, 0.54e0 - 0.46e0 * cos(2 * pi() * frame_idx / 9e0) AS w FROM sc)
SELECT user_id, frame, round(sum(value * w) / sum(w), 6) AS value FROM p GROUP BY user_id, frame""")
def overlap_add_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = overlap_add.overlap_add(slid(spark, sf_dir, 4), ["user_id"], "value", CHUNK, FRAME, 10, hamming=True)
    return got.withColumn("value", F.round("value", 6))


@query(f"""WITH {_slid(4)}, s AS (SELECT user_id, chunk_idx, {END.format(1, 8)} AS fin, frame_idx - 1 AS f, CAST(value > 20 AS INTEGER) + CAST(value > 50 AS INTEGER) + CAST(value > 100 AS INTEGER) AS n FROM sc WHERE frame_idx >= 1 AND frame_idx < 9),
p AS (SELECT user_id, {START.format(1)} + f AS frame, fin, n FROM s), m AS (SELECT user_id, frame, CAST(sum(n) AS DOUBLE) / count(*) AS m FROM p GROUP BY user_id, frame),
e AS (SELECT user_id, unnest(range(0, greatest(max(frame), max(fin)) + 1)) AS frame FROM p GROUP BY user_id)
SELECT e.user_id, e.frame, CAST(round_even(coalesce(m.m, 0e0), 0) AS INTEGER) AS n FROM e LEFT JOIN m ON m.user_id = e.user_id AND m.frame = e.frame""")
def speaker_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*[F.struct(F.lit(k).alias("class"), (F.col("value") > t).cast("int").alias("on")) for k, t in enumerate((20, 50, 100))])
    long = slid(spark, sf_dir, 4).select("user_id", "chunk_idx", "frame_idx", F.explode(levels).alias("x")).select("user_id", "chunk_idx", "frame_idx", "x.class", "x.on")
    return overlap_add.active_count(long, ["user_id"], "on", CHUNK, FRAME, 10)


POOL = """sc AS (SELECT CAST(user_id % 4 AS INTEGER) AS file_id, CAST(day(ts) AS INTEGER) AS chunk_idx, CAST(hour(ts) AS INTEGER) AS frame_idx, CAST(user_id // 4 AS INTEGER) AS spk, max(value) AS score FROM events GROUP BY ALL),
pool AS (SELECT file_id, chunk_idx, frame_idx, spk % 3 AS cluster, max(score) AS score FROM sc WHERE (spk + chunk_idx) % 7 <> 0 GROUP BY ALL)"""


def pooled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    scores = events.groupBy((F.col("user_id") % 4).cast("int").alias("file_id"), F.dayofmonth("ts").alias("chunk_idx"), F.hour("ts").alias("frame_idx"), F.floor(F.col("user_id") / 4).cast("int").alias("spk")).agg(F.max("value").alias("score"))
    cluster = F.when((F.col("spk") + F.col("chunk_idx")) % 7 == 0, -2).otherwise(F.col("spk") % 3)
    assigned = scores.select("file_id", "chunk_idx", "spk", cluster.alias("cluster")).distinct()
    return scores, overlap_add.max_pool(scores, assigned, ["file_id"], "spk", "score")


@query(f"WITH {POOL} SELECT file_id, chunk_idx, frame_idx, cluster, score FROM pool")
def maxpool_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooled(spark, sf_dir)[1]


@query(f"""WITH {POOL}, n AS (SELECT file_id, chunk_idx * 24 + frame_idx AS frame, count(DISTINCT spk) FILTER (score > 100) AS n FROM sc GROUP BY ALL),
r AS (SELECT p.file_id, p.chunk_idx * 24 + p.frame_idx AS frame, p.cluster, n.n, row_number() OVER (PARTITION BY p.file_id, p.chunk_idx, p.frame_idx ORDER BY p.score DESC, p.cluster) AS k
FROM pool p JOIN n ON n.file_id = p.file_id AND n.frame = p.chunk_idx * 24 + p.frame_idx)
SELECT file_id, frame, cluster, CAST(k <= least(n, 3) AS INTEGER) AS active FROM r""")
def topk_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, pool = pooled(spark, sf_dir)
    at = (F.col("chunk_idx") * 24 + F.col("frame_idx")).alias("frame")
    counts = scores.groupBy("file_id", at).agg(F.count_distinct(F.when(F.col("score") > 100, F.col("spk"))).alias("n"))
    acts = pool.select("file_id", at, "cluster", F.col("score").alias("value"))
    return timeline.top_by_count(acts, counts, ["file_id"], most=3).select("file_id", "frame", "cluster", "active")


# runs, gaps and the timeline

RUNS = f"""{HYST}, ch AS (SELECT *, active <> coalesce(lag(active) OVER (PARTITION BY user_id ORDER BY frame), 0) AS new, CAST(max(frame) OVER (PARTITION BY user_id) AS DOUBLE) AS final FROM hy),
ed AS (SELECT *, lead(CAST(frame AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY frame) AS nx FROM ch WHERE new),
ru AS (SELECT user_id, CAST(frame AS DOUBLE) AS s, coalesce(nx, final) AS e FROM ed WHERE active = 1)"""
MERGED = f"""{RUNS}, re AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ru),
il AS (SELECT *, sum(CASE WHEN greatest(s - reach, 0) < 3 AND reach IS NOT NULL THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM re),
me AS (SELECT user_id, min(s) AS s, max(e) AS e FROM il GROUP BY user_id, g)"""


def found_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.runs(two_threshold(spark, sf_dir), ["user_id"], "frame", "on", "frame")


def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.close_gaps(found_runs(spark, sf_dir), ["user_id"], 3.0)


@query(f'WITH {RUNS} SELECT user_id, s AS start, e AS "end" FROM ru')
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_runs(spark, sf_dir)


@query(f'WITH {MERGED} SELECT user_id, s AS start, e AS "end" FROM me')
def collar_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged_runs(spark, sf_dir)


@query(f'WITH {MERGED} SELECT user_id, s AS start, e AS "end" FROM me WHERE e - s >= 5')
def drop_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.drop_short(merged_runs(spark, sf_dir), 5.0)


CLOCK = "printf(' %02d:%02d:%02d.000', CAST({0} AS BIGINT) // 3600, CAST({0} AS BIGINT) // 60 % 60, CAST({0} AS BIGINT) % 60)"


@query(f"""WITH {MERGED} SELECT user_id, s AS start, e AS "end", 'Speaker_' || user_id % 3 AS label, CASE WHEN e - s <= 1e-6 THEN '[]' ELSE '[' || {CLOCK.format("s")} || ' --> ' || {CLOCK.format("e")} || ']' END AS text FROM me""")
def timeline_(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = merged_runs(spark, sf_dir).withColumn("label", F.concat(F.lit("Speaker_"), (F.col("user_id") % 3).cast("string")))
    return timeline.timeline(named, ["user_id"], "label")


QUERIES["timeline"], ORACLE["timeline"] = QUERIES.pop("timeline_"), ORACLE.pop("timeline_")


@query(f"""WITH {MERGED} SELECT user_id, CAST(count(*) AS INTEGER) AS n, min(s) AS first_start, max(e) AS last_end FROM me GROUP BY user_id""")
def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = timeline.tracks(merged_runs(spark, sf_dir), [], "user_id")
    return got.select("user_id", F.size("segments").alias("n"), F.col("segments")[0]["start"].alias("first_start"), F.array_max(F.transform("segments", lambda x: x["end"])).alias("last_end"))


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS r FROM c)
SELECT conv_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM g GROUP BY conv_id, role, r""")
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.label_runs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


# interval algebra

ORDER_DAYS = """o AS (SELECT o_orderkey, o_custkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS d FROM orders),
l AS (SELECT l_orderkey, CAST(min(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS a, CAST(max(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS DOUBLE) AS b FROM lineitem GROUP BY l_orderkey)"""


def _day(column: str) -> F.Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1992-01-01").cast("date")).cast("double")


@query(f"""WITH {ORDER_DAYS}, x AS (SELECT o_orderkey, d AS s1, d + 30 AS e1, a AS s2, b AS e2 FROM o JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, greatest(s1, s2) AS both_start, least(e1, e2) AS both_end, CASE WHEN e2 - s2 <= 1e-6 THEN s1 ELSE least(s1, s2) END AS all_start, CASE WHEN e2 - s2 <= 1e-6 THEN e1 ELSE greatest(e1, e2) END AS all_end,
greatest(greatest(s1, s2) - least(e1, e2), 0e0) AS gap, s1 <= s2 AND e1 >= e2 AS inside, (s1 < s2 AND s2 < e1 - 1e-6) OR (s1 > s2 AND s1 < e2 - 1e-6) OR s1 = s2 AS meets,
CASE WHEN e2 - s2 <= 1e-6 THEN 0e0 ELSE e2 - s2 END AS days, (s2 + e2) / 2 AS middle, e2 - s2 <= 1e-6 AS nothing FROM x""")
def interval_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(_day("l_shipdate")).alias("s2"), F.max(_day("l_shipdate")).alias("e2"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _day("o_orderdate").alias("d")).join(shipped, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.select("o_orderkey", S.segment("d", F.col("d") + 30).alias("a"), S.segment("s2", "e2").alias("b"))
    a, b = F.col("a"), F.col("b")
    both, whole = S.intersection(a, b), S.union(a, b)
    return rows.select(
        "o_orderkey", both["start"].alias("both_start"), both["end"].alias("both_end"), whole["start"].alias("all_start"), whole["end"].alias("all_end"), S.gap_length(a, b).alias("gap"),
        S.contains(a, b).alias("inside"), S.intersects(a, b).alias("meets"), S.duration(b).alias("days"), S.middle(b).alias("middle"), S.is_empty(b).alias("nothing"),
    )


@query(f"""WITH {ORDER_DAYS} SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b, least(x.d, y.d) + 20 - greatest(x.d, y.d) AS days FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.d < y.d + 20 AND y.d < x.d + 20""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", _day("o_orderdate").alias("d"))
    left = orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("d").alias("s1"), (F.col("d") + 20).alias("e1"))
    right = orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("d").alias("s2"), (F.col("d") + 20).alias("e2"))
    met = intervals.overlap_join(left, right, ["o_custkey"], 20.0, ("s1", "e1", "s2", "e2")).where("a < b")
    return met.select("o_custkey", "a", "b", (F.least("e1", "e2") - F.greatest("s1", "s2")).alias("days"))


@query("""SELECT conv_id, turn, CAST(len(string_split(text, '. ')) AS INTEGER) AS parts, len(string_split(text, '. ')[-1]) = 0 AS open_end FROM conversations""")
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = A.split_text("text", ". ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(parts).alias("parts"), (F.element_at(parts, -1) == "").alias("open_end"))


# vectors

LONG = "x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)"
CENTRE = f"{LONG}, m AS (SELECT label, d, avg(CAST(v AS DOUBLE)) AS m, count(*) AS n FROM x GROUP BY label, d), ce AS (SELECT label AS cluster, list(m ORDER BY d) AS centroid FROM m GROUP BY label)"


@query(f"WITH {CENTRE} SELECT label, CAST(d AS INTEGER) AS d, round(m, 6) AS m, n FROM m")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.centroids(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return means.select("label", "n", F.posexplode("centroid").alias("d", "m")).withColumn("m", F.round("m", 6))


@query(f"""WITH {LONG}, n AS (SELECT vec_id, sqrt(sum(CAST(v AS DOUBLE) * v)) AS l FROM x GROUP BY vec_id) SELECT x.vec_id, CAST(d AS INTEGER) AS d, round(CAST(v AS DOUBLE) / l, 6) AS v FROM x JOIN n ON n.vec_id = x.vec_id""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.normalise("embedding")).alias("d", "v")).withColumn("v", F.round("v", 6))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_distance(a.v, b.v), 6) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id""")
def pairwise_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "embeddings")
    return vectors.pairwise(few, ["label"], "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.label AS a, b.label AS b, round(min(list_distance(a.v, b.v)), 6) AS distance FROM e a JOIN e b ON a.label < b.label GROUP BY a.label, b.label""")
def cluster_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = table(spark, sf_dir, "embeddings")
    return vectors.cluster_distances(few, [], "vec_id", "embedding", "label").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {CENTRE} SELECT vec_id, cluster, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), centroid), 6) AS distance FROM embeddings, ce""")
def cosine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    means = vectors.centroids(e, ["label"], "embedding").withColumnRenamed("label", "cluster")
    return vectors.cosine_matrix(e, means, "vec_id", "cluster", "embedding", "centroid").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {CENTRE}, s AS (SELECT vec_id, cluster, 2 - list_cosine_distance(CAST(embedding AS DOUBLE[]), centroid) AS s FROM embeddings, ce)
SELECT vec_id, cluster, round(s, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) = 1""")
def assign_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    means = vectors.centroids(e, ["label"], "embedding").withColumnRenamed("label", "cluster")
    return vectors.assign_nearest(e, means, ["vec_id"], "embedding").withColumn("similarity", F.round("similarity", 6))


SMALL = """c AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 100 + label ELSE label END AS cluster, embedding FROM embeddings),
x AS (SELECT cluster, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM c), m AS (SELECT cluster, d, avg(CAST(v AS DOUBLE)) AS m, count(*) AS n FROM x GROUP BY cluster, d),
k AS (SELECT cluster, max(n) AS n, list(m ORDER BY d) AS v FROM m GROUP BY cluster),
t AS (SELECT s.cluster, b.cluster AS target FROM k s, k b WHERE s.n < 20 AND b.n >= 20 QUALIFY row_number() OVER (PARTITION BY s.cluster ORDER BY list_cosine_distance(s.v, b.v), b.cluster) = 1 UNION ALL SELECT cluster, cluster FROM k WHERE n >= 20)"""


def small_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("vec_id") % 10 == 0, F.col("label") + 100).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", c.alias("cluster"), "embedding")
    return vectors.small_to_large(rows, "embedding", 20).select("vec_id", "cluster", "target")


@query(f"WITH {SMALL} SELECT c.vec_id, c.cluster, coalesce(t.target, 0) AS target FROM c LEFT JOIN t ON t.cluster = c.cluster")
def small_to_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_clusters(spark, sf_dir)


@query("""WITH c AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 100 + label ELSE label END AS cluster FROM embeddings)
SELECT vec_id, CAST(dense_rank() OVER (ORDER BY cluster) - 1 AS INTEGER) AS cluster FROM c""")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.renumber(small_clusters(spark, sf_dir).select("vec_id", "cluster"), "cluster")


@query("""SELECT label, count(*) AS n, CAST(least(15, greatest(1, CAST(round_even(0.1e0 * count(*), 0) AS INTEGER))) AS INTEGER) AS least FROM embeddings GROUP BY label""")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.cluster_sizes(table(spark, sf_dir, "embeddings"), "label").withColumn("least", A.min_cluster_size("n"))


@query("""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ed AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM v a JOIN v b ON a.label = b.label WHERE list_distance(a.v, b.v) <= 0.95e0),
r(label, i, j) AS (SELECT label, i, j FROM ed UNION SELECT r.label, r.i, ed.j FROM r JOIN ed ON ed.label = r.label AND ed.i = r.j)
SELECT label, i AS vec_id, min(j) AS root FROM r GROUP BY label, i""")
def single_link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    flat = linkage.flat_clusters(e, "label", "vec_id", "embedding", 0.95, "single")
    return flat.select("label", "vec_id", F.min("vec_id").over(Window.partitionBy("label", "cluster")).alias("root"))


@query()
def linkage_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.dendrogram(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


@query()
def fcluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.flat_clusters(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 1.0)


@query()
def cluster_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("file_id", F.col("vec_id") % 2)
    return linkage.cluster_groups(e, "file_id", ["vec_id"], "embedding", threshold=1.0, num=4)


@query(f"""WITH {CENTRE}, s AS (SELECT vec_id // 3 AS chunk_idx, vec_id % 3 AS spk, cluster, 2 - list_cosine_distance(CAST(embedding AS DOUBLE[]), centroid) AS s FROM embeddings, ce WHERE cluster < 4),
best AS (SELECT a.chunk_idx, a.cluster AS k0, b.cluster AS k1, c.cluster AS k2 FROM s a
LEFT JOIN s b ON b.chunk_idx = a.chunk_idx AND b.spk = 1 AND b.cluster <> a.cluster
LEFT JOIN s c ON c.chunk_idx = a.chunk_idx AND c.spk = 2 AND c.cluster <> a.cluster AND c.cluster <> b.cluster
WHERE a.spk = 0 QUALIFY row_number() OVER (PARTITION BY a.chunk_idx ORDER BY a.s + coalesce(b.s, 0) + coalesce(c.s, 0) DESC) = 1)
SELECT CAST(chunk_idx AS BIGINT) AS chunk_idx, CAST(spk AS BIGINT) AS spk, CAST(cluster AS INTEGER) AS cluster FROM (SELECT chunk_idx, 0 AS spk, k0 AS cluster FROM best
UNION ALL SELECT chunk_idx, 1, k1 FROM best WHERE k1 IS NOT NULL UNION ALL SELECT chunk_idx, 2, k2 FROM best WHERE k2 IS NOT NULL)""")
def constrained_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    means = vectors.centroids(e, ["label"], "embedding").where("label < 4").withColumnRenamed("label", "cluster")
    d = vectors.cosine_matrix(e, means, "vec_id", "cluster", "embedding", "centroid")
    rows = d.select(F.floor(F.col("vec_id") / 3).alias("chunk_idx"), (F.col("vec_id") % 3).alias("spk"), "cluster", (2 - F.col("distance")).alias("s"))
    return linkage.constrained_assign(rows, ["chunk_idx"], "spk", "cluster", "s")


@query()
def downsample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.downsample(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["vec_id"], 100, seed=5)


# samples and spectra


def _rows_kernel(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], names: tuple[str, str, str]) -> DataFrame:
    """``user_id, row, column, x``: the matrix a kernel makes of each user's values."""

    def run(batches):
        for batch in batches:
            for user, xs in zip(batch.column("user_id"), batch.column("xs")):
                m = kernel(np.asarray(xs.as_py(), np.float64))
                i, j = np.indices(m.shape)
                yield pa.RecordBatch.from_arrays([pa.array([user.as_py()] * m.size, pa.int64()), pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(m.ravel())], names=["user_id", *names])

    return rows.select("user_id", "xs").mapInArrow(run, f"user_id bigint, {names[0]} int, {names[1]} int, {names[2]} double")


@query(f"""WITH {SEQ}, {LENS}, f AS (SELECT user_id, unnest(range(0, n // 8 + 1)) AS f FROM lens), b AS (SELECT unnest(range(0, 9)) AS b),
p AS (SELECT f.user_id, f.f, b.b, sum(s.value * (0.54e0 - 0.46e0 * cos(2 * pi() * (s.frame - f.f * 8 + 8) / 16e0)) * cos(2 * pi() * b.b * (s.frame - f.f * 8 + 8) / 16e0)) AS re,
sum(s.value * (0.54e0 - 0.46e0 * cos(2 * pi() * (s.frame - f.f * 8 + 8) / 16e0)) * sin(2 * pi() * b.b * (s.frame - f.f * 8 + 8) / 16e0)) AS im
FROM f CROSS JOIN b JOIN seq s ON s.user_id = f.user_id AND s.frame >= f.f * 8 - 8 AND s.frame < f.f * 8 + 8 GROUP BY f.user_id, f.f, b.b)
SELECT user_id, CAST(f AS INTEGER) AS frame, CAST(b AS INTEGER) AS bin, round(sqrt(re * re + im * im), 4) AS magnitude FROM p""")
def stft_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _rows_kernel(user_arrays(spark, sf_dir), lambda x: np.sqrt(spectral.power(spectral.stft(x, 16, 8))), ("frame", "bin", "magnitude"))
    return got.withColumn("magnitude", F.round("magnitude", 4))


@query()
def mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_kernel(user_arrays(spark, sf_dir), lambda x: spectral.log_mel(x, 4, 16_000, 64, 16), ("frame", "band", "level"))


@query()
def mean_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_kernel(user_arrays(spark, sf_dir), lambda x: spectral.mean_normalise(spectral.log_mel(x, 4, 16_000, 64, 16), 0.5), ("frame", "band", "level"))


@query()
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows_kernel(user_arrays(spark, sf_dir), lambda x: spectral.resample(x, 3, 2)[:, None], ("k", "channel", "x")).drop("channel")


@query(f"""WITH {SEQ} SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(frame // 16 AS INTEGER) AS blk, CAST(count(*) AS INTEGER) AS n, round(sum(CAST(CAST(round(value * 10, 0) AS INTEGER) / 32768e0 AS DOUBLE)), 6) AS total FROM seq GROUP BY user_id, frame // 16""")
def wav_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' values as 16-bit files, scanned back into blocks."""

    def encode(batches):
        for batch in batches:
            for user, xs in zip(batch.column("user_id"), batch.column("xs")):
                content = wav.encode(np.rint(np.asarray(xs.as_py(), np.float64)))
                yield pa.RecordBatch.from_arrays([pa.array([str(user.as_py())]), pa.array([content], pa.binary())], names=["path", "content"])

    rows = user_arrays(spark, sf_dir).select("user_id", F.transform("xs", lambda x: F.round(x * 10, 0)).alias("xs"))
    blocks = wav.read_wav(rows.mapInArrow(encode, "path string, content binary"), 16_000, 16)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return blocks.select("file_id", "blk", F.size("samples").alias("n"), F.round(total, 6).alias("total"))


@query()
def stub_diarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of four users sounds for half a second, its kind as pitch and its value as loudness."""
    rows = sequence(spark, sf_dir).where("user_id < 4")
    pitch = F.when(F.col("event_type") == "click", 400.0).when(F.col("event_type") == "view", 1100.0).otherwise(1700.0)
    loud = F.when(F.col("value") > 50, 0.3).otherwise(0.0)
    samples = F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda k: (F.col("loud") * F.sin(2 * np.pi * F.col("pitch") * k / 16_000)).cast("float"))
    blocks = rows.withColumn("loud", loud).withColumn("pitch", pitch).select(F.col("user_id").cast("string").alias("file_id"), F.col("frame").cast("int").alias("blk"), samples.alias("samples"))
    blocks = cluster.written(spark, blocks, "blocks")
    options = Options(clustering=ClusterOptions(threshold=0.9, min_cluster_size=3))
    return diarize.Diarizer(options).run(blocks)


# times, indices and texts of rows


@query(f"""WITH {SEQ} SELECT user_id, frame, round((frame * 1.37e0 + (frame * 1.37e0 + 1.37e0)) / 2, 6) AS middle, round(frame * 0.016875e0, 6) AS duration,
CAST(floor(greatest(value, 0) / 0.016875e0) + 1 AS BIGINT) AS cover, CAST(floor((value - 0.016875e0) / 0.016875e0) + 1 AS BIGINT) AS strict,
CAST(floor((value + 0.016875e0) / 0.016875e0) AS BIGINT) AS loose, CAST(round_even(value / 0.016875e0, 0) AS BIGINT) AS center FROM seq""")
def grid_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [G.samples("value", FINE, mode).cast("bigint").alias(mode) for mode in ("strict", "loose", "center")]
    lengths = [F.round(G.frame_middle("frame", FRAME), 6).alias("middle"), F.round(G.samples_to_duration("frame", FINE), 6).alias("duration"), G.duration_to_samples("value", FINE).cast("bigint").alias("cover")]
    return sequence(spark, sf_dir).select("user_id", "frame", *lengths, *counts)


@query("""SELECT DISTINCT user_id, CAST(ceil((300e0 - 1e0) / 0.25e0) AS BIGINT) AS n FROM events""")
def grid_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", G.grid_length(Grid(step=0.25, duration=1.0, start=1.0, end=300.0)).alias("n"))


@query(f"""WITH {SEQ} SELECT user_id, frame, CAST(frame AS DOUBLE) AS start, CAST(frame + 2 AS DOUBLE) AS "end", round(frame * 0.5e0 + 0.01e0, 1) AS near,
abs(frame * 0.1e0 - frame / 10e0) < 2.220446049250313e-16 AS same, printf('[%.2f -- %.2f] --> Speaker_%s', frame * 0.5e0, frame * 0.5e0 + 1.25e0, CAST(user_id AS VARCHAR)) AS line FROM seq""")
def segment_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments through JSON and back, rounded, and as lines of the console."""
    at = F.col("frame") * 0.5
    back = S.from_json(S.to_json(S.segment(F.col("frame").cast("double"), (F.col("frame") + 2).cast("double"))))
    near = S.rounded(S.segment(at + 0.01, at + 1.0), 1)["start"].alias("near")
    return sequence(spark, sf_dir).select("user_id", "frame", back["start"].alias("start"), back["end"].alias("end"), near, A.same(F.col("frame") * 0.1, F.col("frame") / 10).alias("same"), S.result_line(at, at + 1.25, "user_id").alias("line"))


@query(f"""WITH {SEQ} SELECT user_id, frame, value FROM seq""")
def fold_unfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence(spark, sf_dir).select("user_id", "frame", "value")
    return windowing.unfold(windowing.fold(rows, "frame", 7, "row", "place"), "row", "place", 7, "frame")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)
SELECT vec_id, count(*) FILTER (v > 0) AS n, coalesce(CAST(sum(d) FILTER (v > 0) AS BIGINT), 0) AS places, round(sum(round(CAST(v AS DOUBLE) * 1000) / 32768e0), 6) AS scaled,
coalesce(CAST(nullif(any_value(label), 3) AS DOUBLE), 0e0) AS filled FROM x GROUP BY vec_id""")
def element_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of positive elements, elements as PCM samples, and missing labels as 0."""
    places = A.nonzero(F.transform("embedding", lambda x: x > 0))
    scaled = A.scale_pcm(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(places).cast("bigint").alias("n"),
        F.aggregate(places, F.lit(0).cast("bigint"), lambda a, i: a + i).alias("places"),
        F.round(F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x), 6).alias("scaled"),
        A.nan_to(F.when(F.col("label") != 3, F.col("label"))).alias("filled"),
    )


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT a.vec_id AS i, b.vec_id AS j, CAST(n * a.vec_id - a.vec_id * (a.vec_id + 1) // 2 + b.vec_id - a.vec_id - 1 AS BIGINT) AS place
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id CROSS JOIN n""")
def condensed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the pairs of a label in the condensed distances of all vectors."""
    e = table(spark, sf_dir, "embeddings")
    pairs = vectors.pairs(e, ["label"], "vec_id").select("i", "j")
    return pairs.crossJoin(e.agg(F.count(F.lit(1)).alias("n"))).select("i", "j", A.condensed_index("n", "i", "j").cast("bigint").alias("place"))


# streams


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given once its source is used up, as Parquet in the shared folder."""
    spark = stream.sparkSession
    path = cluster.new_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(path)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return stream.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


@query("""WITH w AS (SELECT event_type, value, unnest(range(0, 4)) AS k, epoch_us(ts) AS t FROM events)
SELECT event_type, (t // 21600000000 - k) * 21600 AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _drained(online.sliding(_event_stream(spark, sf_dir), ["event_type"], "ts", "value", "24 hours", "6 hours", "1 hour"), "complete")
    return got.select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""SELECT event_type, epoch_us(ts) // 21600000000 * 21600 AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _drained(online.tumbling(_event_stream(spark, sf_dir), ["event_type"], "ts", "value", "6 hours", "1 hour"), "complete")
    return got.select("event_type", F.unix_seconds("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 43200000000 THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM g)
SELECT user_id, min(t) AS start, max(t) AS "end" FROM i GROUP BY user_id, g""")
def stream_close_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _event_stream(spark, sf_dir).select("user_id", F.col("ts").alias("start"), F.col("ts").alias("end"))
    got = _drained(online.close_gaps(points, ["user_id"], 43_200_000_000, "1 hour"), "complete")
    return got.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))


@query("""WITH p AS (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 AS passed FROM events),
e AS (SELECT user_id, epoch_us(ts) AS t, value, CASE WHEN value > 50 THEN 1 WHEN value < 20 THEN 0 END AS mark FROM events, p WHERE epoch_us(ts) <= passed),
h AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, value ROWS UNBOUNDED PRECEDING), 0) AS active FROM e),
c AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY user_id ORDER BY t, value), 0) AS before FROM h),
n AS (SELECT user_id, t AS start, active, lead(t) OVER (PARTITION BY user_id ORDER BY t, value) AS e FROM c WHERE active <> before)
SELECT user_id, start, e AS "end" FROM n WHERE active = 1 AND e IS NOT NULL""")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _drained(online.active_runs(_event_stream(spark, sf_dir), "user_id", "ts", "value", 50, 20, "1 hour"), "append")
    return got.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"))
