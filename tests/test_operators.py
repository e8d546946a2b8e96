from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import ClusterOptions, Grid, Options
from tidemark.functions import arrays as A
from tidemark.functions import grid as G
from tidemark.functions import segments as S
from tidemark.functions import spectral
from tidemark.operators import activity, intervals, overlap_add, timeline, vectors, windowing
from tidemark.plans import diarize
from tidemark.sources import dumps, wav


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_chunk_counts(spark):
    for n, many in {640: 1, 79_999: 1, 80_000: 1, 80_001: 2, 88_000: 2, 88_001: 3, 160_000: 11}.items():
        assert one(spark, G.chunk_count(F.lit(n), 80_000, 8_000))[0] == many


def test_frames_halves_to_even(spark):
    grid = Grid(step=1.0, duration=1.0)
    values = [0.5, 1.2, 1.5, 2.0, 2.5, 3.0, 3.5, -4.0]
    got = one(spark, *[G.closest_frame(F.lit(v), grid).alias(f"c{i}") for i, v in enumerate(values)])
    assert list(got) == [max(0, round(v - 0.5)) for v in values]


def test_ranges_and_lengths(spark):
    grid = Grid(step=0.5, duration=5.0, end=20.0)
    s, d, n = one(spark, G.range_to_segment(F.lit(3), F.lit(2), grid), G.samples_to_duration(F.lit(4), grid), G.grid_length(grid))
    assert (s.start, s.end, d, n) == (3.75, 4.75, 4.25, 40)
    assert one(spark, G.window_or_null(F.lit(40), grid))[0] is None
    assert one(spark, *[G.samples(F.lit(10.0), grid, m) for m in ("strict", "loose", "center")])[:] == (11, 30, 20)
    with pytest.raises(Exception, match="infinite"):
        spark.range(1).select(G.grid_length(Grid(step=1, duration=1))).collect()
    with pytest.raises(ValueError):
        Grid(step=0, duration=1)


def test_interval_algebra(spark):
    seg = lambda a, b: S.segment(F.lit(float(a)), F.lit(float(b)))
    both, all_, gap, none = one(spark, S.intersection(seg(0, 10), seg(5, 15)), S.union(seg(0, 10), seg(15, 20)), S.gap(seg(0, 10), seg(15, 20)), S.union(seg(3, 3), seg(5, 6)))
    assert [tuple(x) for x in (both, all_, gap, none)] == [(5, 10), (0, 20), (10, 15), (5, 6)]
    flags = one(spark, S.contains(seg(0, 10), seg(0, 10)), S.contains(seg(0, 5), seg(0, 10)), S.overlaps(seg(0, 5), F.lit(5.0)), S.intersects(seg(0, 5), seg(5, 6)), S.intersects(seg(0, 5), seg(0, 1)), S.is_empty(seg(2, 1)))
    assert list(flags) == [True, False, True, False, True, True]
    with pytest.raises(Exception, match="empty"):
        spark.range(1).select(S.gap(seg(1, 1), seg(2, 3))).collect()
    texts = one(spark, S.text(seg(1337, 1337.42)), S.text(seg(1, 1)), S.clock(F.lit(-3661.5)), S.result_line(F.lit(1.234), F.lit(2.0), F.lit(3)))
    assert list(texts) == ["[ 00:22:17.000 -->  00:22:17.420]", "[]", "-01:01:01.500", "[1.23 -- 2.00] --> Speaker_3"]
    back = one(spark, S.from_json(S.to_json(seg(1.5, 2.25))))[0]
    assert (back.start, back.end) == (1.5, 2.25)


def test_arrays(spark):
    v = lambda *x: F.array(*[F.lit(None if e is None else float(e)) for e in x])
    row = one(
        spark, A.norm(v(3, 4)), A.cosine_distance(v(1, 0), v(0, 2)), A.cosine_distance(v(0, 0), v(1, 1)), A.has_nan(v(1, math.nan)), A.argmax(v(math.nan, 2, 2)), A.argmax(v(math.nan)),
        A.argsort(v(3, 1, 3, 0)), A.condensed_index(F.lit(5), F.lit(3), F.lit(1)), A.nan_to(F.lit(math.nan)), A.normalise(v(0, 0)), A.same(F.lit(0.1), F.lit(0.1)),
        A.cumulative(F.array(F.lit(True), F.lit(False), F.lit(True))), A.parse_row(F.lit("1.5,nan,True,False,")), A.number_text(F.lit(0.0)),
    )
    assert list(row)[:5] == [5.0, 1.0, None, True, 1] and list(row)[5:12] == [0, [3, 1, 0, 2], 5, 0.0, [0, 0], True, [1, 1, 2]]
    assert row[12][0] == 1.5 and math.isnan(row[12][1]) and row[12][2:] == [1.0, 0.0] and row[13] == "0.0"


def slow_hysteresis(xs, on, off, initial=None):
    state = (xs[0] >= (on + off) / 2) if initial is None else initial
    out = []
    for x in xs:
        state = True if x > on else False if x < off else state
        out.append(int(state))
    return out


def slow_runs(active, t):
    out, start = [], t[0] if active[0] else None
    for j in range(1, len(active)):
        if start is not None and not active[j]:
            out.append((start, t[j]))
            start = None
        elif start is None and active[j]:
            start = t[j]
    return out + ([(start, t[-1])] if start is not None else [])


def slow_close(rows, collar):
    out = []
    for s, e in sorted(rows):
        if out and max(0, s - out[-1][1]) < collar:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("initial", [None, True, False])
def test_hysteresis_runs_and_gaps(spark, initial):
    rng = random.Random(1)
    series = {k: [rng.choice([0.1, 0.3, 0.4, 0.5, 0.6, 0.9]) for _ in range(rng.randint(1, 40))] for k in range(12)}
    rows = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "k int, i int, x double")
    on = activity.hysteresis(rows, ["k"], "i", "x", 0.5, 0.4, initial)
    got = {}
    for r in on.orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.on)
    assert got == {k: slow_hysteresis(xs, 0.5, 0.4, initial) for k, xs in series.items()}
    found = timeline.runs(on, ["k"], "i", "on", "i")
    expected = {(k, float(s), float(e)) for k, a in got.items() for s, e in slow_runs(a, list(range(len(a))))}
    assert {tuple(r) for r in found.collect()} == expected
    for collar in (0.0, 2.0, 3.0):
        merged = timeline.close_gaps(found, ["k"], collar)
        want = {(k, s, e) for k in series for s, e in slow_close([x[1:] for x in expected if x[0] == k], collar)}
        assert {tuple(r) for r in merged.collect()} == want
        assert {tuple(r) for r in timeline.close_gaps(merged, ["k"], collar).collect()} == want


def test_nan_scores_are_silence(spark):
    rows = spark.createDataFrame([(0, 0.9), (1, math.nan), (2, None), (3, 0.9)], "i int, x double").withColumn("k", F.lit(1))
    assert [r.on for r in activity.hysteresis(rows, ["k"], "i", "x", 0.5).orderBy("i").collect()] == [1, 0, 0, 1]


def test_overlap_add_loop(spark):
    rng = random.Random(2)
    chunk, frame = Grid(step=0.5, duration=5.0), Grid(step=0.016875, duration=0.016875)
    scores = {(c, j, k): rng.choice([rng.random(), math.nan]) for c in range(4) for j in range(293) for k in range(2)}
    rows = spark.createDataFrame([("f", c, j, k, x) for (c, j, k), x in scores.items()], "file_id string, chunk_idx int, frame_idx int, cls int, x double")
    total, many = {}, {}
    got = {(r.frame, r.cls): r.value for r in overlap_add.overlap_add(rows, ["file_id"], "x", chunk, frame, 293, ["cls"], missing=-1.0).collect()}
    offsets = [0, 29, 59, 88]
    for (c, j, k), x in scores.items():
        key = (offsets[c] + j, k)
        if not math.isnan(x):
            total[key] = total.get(key, 0) + x
            many[key] = many.get(key, 0) + 1
    assert len(got) == 2 * 386  # up to the frame closest to 6.5 s
    for key, v in got.items():
        assert abs(v - (total[key] / many[key] if key in many else -1.0)) < 1e-9


def test_geometry_of_one_and_two_chunks(spark):
    """Counts lie on 238 frames for one chunk, 267 for two."""
    chunk, frame = Grid(step=0.5, duration=5.0), Grid(step=0.016875, duration=0.016875)
    for chunks, frames in ((1, 238), (2, 267)):
        rows = spark.range(chunks * 293).select(F.lit("f").alias("file_id"), F.floor(F.col("id") / 293).cast("int").alias("chunk_idx"), (F.col("id") % 293).cast("int").alias("frame_idx"), F.lit(1).alias("on"))
        counts = overlap_add.active_count(rows, ["file_id"], "on", chunk, frame, 293)
        assert counts.count() == frames and counts.agg(F.max("n")).first()[0] == 1


def test_selection_and_ties(spark):
    acts = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (0, 2, 0.9), (1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.0)], "frame int, cluster int, value double").withColumn("file_id", F.lit("f"))
    counts = spark.createDataFrame([("f", 0, 2), ("f", 1, 9)], "file_id string, frame int, n int")
    got = {(r.frame, r.cluster): r.active for r in timeline.top_by_count(acts, counts, ["file_id"]).collect()}
    assert got == {(0, 0): 1, (0, 1): 0, (0, 2): 1, (1, 0): 1, (1, 1): 1, (1, 2): 1}


def test_overlap_join_loop(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), i, float(s), float(s + rng.randint(0, 30))) for i, s in ((i, rng.randint(-40, 60)) for i in range(60))]
    a = spark.createDataFrame(rows, "k int, a int, s double, e double")
    b = spark.createDataFrame(rows, "k int, b int, t double, u double")
    got = {(r.a, r.b) for r in intervals.overlap_join(a, b, ["k"], 7.0, ("s", "e", "t", "u")).collect()}
    assert got == {(i, j) for k, i, s, e in rows for m, j, t, u in rows if k == m and s < u and t < e and s < e and t < u}
    assert intervals.overlap_join(a, b, ["k"], 7.0, ("s", "e", "t", "u")).count() == len(got)


def test_missing_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [math.nan, 1.0]), (3, [0.0, 0.0]), (4, [0.0, 3.0])], "i int, v array<double>")
    centre = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, centroid array<double>")
    got = {r.i: (r.cluster, r.similarity) for r in vectors.assign_nearest(rows, centre, ["i"], "v").collect()}
    assert got == {0: (0, 2.0), 1: (0, None), 2: (0, None), 3: (0, None), 4: (1, 2.0)}
    assert [r.i for r in vectors.drop_missing(rows, "v").orderBy("i").collect()] == [0, 3, 4]
    assert vectors.downsample(rows, ["i"], 3, 1).count() == 3


def test_slide_edges(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(21)] + [("b", 0, 5.0)], "k string, i int, x double")
    got = windowing.slide(rows, ["k"], "i", ["x"], 10, 5)
    per = {(r.k, r.chunk_idx): r.n for r in got.groupBy("k", "chunk_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per == {("a", 0): 10, ("a", 1): 10, ("a", 2): 10, ("a", 3): 6, ("b", 0): 1}
    back = windowing.unfold(windowing.fold(rows, "i", 3, "o", "n"), "o", "n", 3, "i")
    assert sorted((r.k, r.i) for r in back.collect()) == sorted((r.k, r.i) for r in rows.collect())


def test_blocks_to_chunks(spark):
    x = list(range(23))
    blocks = spark.createDataFrame([("f", b, [float(v) for v in x[b * 4 : b * 4 + 4]]) for b in range(6)], "file_id string, blk int, samples array<float>")
    got = {r.chunk_idx: r.samples for r in windowing.block_chunks(blocks, "file_id", "blk", "samples", 3, 4).collect()}
    assert got == {c: [float(v) for v in x[c * 4 : c * 4 + 12]] for c in range(4)}


def test_wav_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = (rng.random(20_000) * 60_000 - 30_000).astype(np.int16)
    (tmp_path / "a.wav").write_bytes(wav.encode(x))
    stereo = np.stack([x[:500], -x[:500]], 1)
    content = wav.encode(stereo.ravel(), rate=8_000, channels=2)
    (tmp_path / "b.wav").write_bytes(content[:36] + b"LIST" + (5).to_bytes(4, "little") + b"hello\0" + content[36:])
    (tmp_path / "c.wav").write_bytes(wav.encode((x[:100] // 256).astype(np.int8), bits=8))
    found = wav.files(spark, str(tmp_path))
    heads = {r.file_id.rsplit("/", 1)[1]: r for r in wav.headers(found).collect()}
    assert (heads["a.wav"].num_samples, heads["b.wav"].channels, heads["b.wav"].num_samples, heads["c.wav"].bits) == (20_000, 2, 500, 8)
    blocks = wav.read_wav(found)
    rows = {(r.file_id.rsplit("/", 1)[1], r.blk): r.samples for r in blocks.collect()}
    assert [len(rows["a.wav", k]) for k in range(3)] == [8000, 8000, 4000] and len(rows["b.wav", 0]) == 1000
    assert np.allclose(np.concatenate([rows["a.wav", k] for k in range(3)]), x / 32768) and np.allclose(rows["b.wav", 0], 0)
    assert np.allclose(rows["c.wav", 0], (x[:100] // 256) / 128)
    out = wav.write_wav(blocks.where("file_id like '%a.wav'"), str(tmp_path / "out")).collect()
    assert np.array_equal(wav.parse((tmp_path / "out" / "a.wav").read_bytes())[1], x) and out[0].num_samples == 20_000
    with pytest.raises(ValueError, match="both"):
        wav.write_wav(spark.createDataFrame([("/x/a/r.wav", 0, [0.1]), ("/x/b/r.wav", 0, [0.2])], wav.BLOCK_SCHEMA), str(tmp_path / "clash"))
    with wav.StreamWriter(str(tmp_path / "s.wav")) as w:
        w.write(x[:100])
        w.write(x[100:300])
    assert np.array_equal(wav.parse((tmp_path / "s.wav").read_bytes())[1], x[:300])
    for bad in (b"", b"RIFF", wav.encode(x, bits=16).replace(b"data", b"none")):
        with pytest.raises(ValueError):
            wav.parse(bad)


def test_spectra():
    x = np.random.default_rng(1).standard_normal(80_000)
    s = spectral.stft(x)
    assert s.shape == (501, 201)
    t, k = 100, 37
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(400) / 400)
    part = np.pad(x, 200)[t * 160 : t * 160 + 400] * window
    assert abs(s[t, k] - (part * np.exp(-2j * np.pi * k * np.arange(400) / 400)).sum()) < 1e-8
    assert spectral.log_mel(x).shape == (501, 80)
    assert np.allclose(spectral.mean_normalise(np.arange(10.0)[:, None], 0.5)[:5].mean(), 0)
    tone = np.sin(2 * np.pi * 440 * np.arange(44_100) / 44_100)
    got = spectral.resample(tone, 44_100, 16_000)
    assert len(got) == 16_000 and np.abs(got - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))[200:-200].max() < 1e-2


def test_dumps(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 0.5, math.nan]), (1, [0.0, 123456.0, -2.5])], "i int, v array<double>")
    dumps.write_dump(rows.coalesce(1), ["i"], "v", str(tmp_path / "d"))
    back = [r["values"] for r in dumps.read_dump(spark, str(tmp_path / "d")).orderBy("row").collect()]
    assert back[1] == [0.0, 123456.0, -2.5] and back[0][:2] == [1.0, 0.5] and math.isnan(back[0][2])
    a = spark.createDataFrame([(0, 1.0), (1, math.nan), (2, 3.0), (3, 4.0)], "i int, x double")
    b = spark.createDataFrame([(0, 1.0005), (1, math.nan), (2, 3.1), (4, 4.0)], "i int, x double")
    assert sorted(r.i for r in dumps.compare(a, b, ["i"], "x").collect()) == [2, 3, 4]


def test_two_tones_end_to_end(spark):
    """Two sources in turn: their changes are found within the resolution of the chunks."""
    rate, rng = 16_000, np.random.default_rng(5)
    t = np.arange(6 * rate) / rate
    parts = [0.4 * np.sin(2 * np.pi * 300 * t), 0.4 * np.sin(2 * np.pi * 1500 * t)]
    x = np.concatenate([parts[0], np.zeros(2 * rate), parts[1], np.zeros(2 * rate), parts[0]]) + 1e-4 * rng.standard_normal(22 * rate)
    blocks = spark.createDataFrame([("f", int(b), x[b * 8000 : b * 8000 + 8000].astype(np.float32).tolist()) for b in range(len(x) // 8000)], "file_id string, blk int, samples array<float>")
    found = diarize.Diarizer(Options(clustering=ClusterOptions(threshold=0.5, min_cluster_size=3))).run(blocks).collect()
    assert found and [tuple(r) for r in found] == sorted(tuple(r) for r in found)
    covered = lambda a, b: sum(max(0, min(r.end, b) - max(r.start, a)) for r in found)
    assert covered(0.5, 5.5) > 4 and covered(8.5, 13.5) > 4 and covered(6.5, 7.5) < 0.6
    label = lambda a, b: max({r.label for r in found}, key=lambda n: sum(max(0, min(r.end, b) - max(r.start, a)) for r in found if r.label == n))
    assert label(0, 6) == label(16, 22) != label(8, 14)
