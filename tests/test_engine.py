"""Known answers and brute force for what SQL can't express."""

import itertools
import random

import numpy as np
import pytest

from turnweave.functions import geometry, powerset
from turnweave.operators import assignment, clustering, frames, intervals, metadata, metrics
from turnweave.plans import inference, pipelines
from turnweave.sources import formats

TARGET = ["00 10 10 11 11 01 01", "00 00 10 10 10 10 00"]
PRED = ["00 10 00 11 01 11 10", "00 00 01 01 01 11 10"]


def grid(spark, chunks):
    rows = [("f", c, f, k, float(v)) for c, line in enumerate(chunks) for f, bits in enumerate(line.split()) for k, v in enumerate(bits)]
    return spark.createDataFrame(rows, "uri string, chunk long, frame long, k long, score double")


def test_diarization_error_known_answers(spark):
    t, p = grid(spark, TARGET), grid(spark, PRED)
    by_chunk = {r.chunk: r for r in metrics.der(t, p, reduce=["chunk"]).collect()}
    parts = lambda r: (r.false_alarm, r.missed_detection, r.confusion, r.total)
    assert parts(by_chunk[0]) == (1, 2, 1, 8) and parts(by_chunk[1]) == (2, 0, 0, 4)
    whole = metrics.der(t, p).first()
    assert parts(whole) == (3, 2, 1, 12) and whole.diarization_error_rate == pytest.approx(0.5)


def test_segmentation_error_over_whole_chunk_equals_der(spark):
    t, p = grid(spark, TARGET), grid(spark, PRED)
    a, b = metrics.segmentation_error(t, p, 7).first(), metrics.der(t, p).first()
    assert a.diarization_error_rate == pytest.approx(b.diarization_error_rate)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = map(int, rng.integers(1, 6, 2))
        cost = rng.integers(0, 9, (n, m)).astype(float)
        pairs = assignment.solve(cost)
        best = min(sum(cost[r, c] for r, c in zip(rows, cols)) for rows in itertools.combinations(range(n), min(n, m)) for cols in itertools.permutations(range(m), min(n, m)))
        assert len(pairs) == min(n, m) and sum(cost[r, c] for r, c in pairs) == best


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_permutation_is_recovered(order):
    y = np.random.default_rng(1).random((10, 3))
    back, found, _ = assignment.permute(y, y[:, order])
    assert np.allclose(back, y) and [order[c] for c in found] == [0, 1, 2]


def test_permutation_with_fewer_and_more_classes():
    y = np.random.default_rng(2).random((10, 3))
    _, found, _ = assignment.permute(y, y[:, [2, 0]])
    assert found == [1, None, 0]
    back, _, _ = assignment.permute(y[:, [1, 2]], y)
    assert np.allclose(back, y[:, [1, 2]])


def test_greedy_mapping_takes_the_largest_first():
    assert assignment.solve_greedy(np.array([[5.0, 4.0], [4.0, 0.0]])) == [(0, 0)]
    assert assignment.solve(-np.array([[5.0, 4.0], [4.0, 0.0]])) == [(0, 1), (1, 0)]


def test_constrained_argmax(spark):
    rows = [("f", 0, 0, 0, 0.9), ("f", 0, 0, 1, 0.8), ("f", 0, 1, 0, 0.8), ("f", 0, 1, 1, 0.1), ("f", 0, 2, 0, 0.0), ("f", 0, 2, 1, 0.0)]
    df = spark.createDataFrame(rows, "uri string, chunk long, speaker long, cluster long, score double")
    got = {r.speaker: r.cluster for r in assignment.constrained_argmax(df).collect()}
    assert got == {0: 1, 1: 0, 2: None}


@pytest.mark.parametrize("n,most", [(n, m) for n in (2, 3, 4) for m in range(1, n + 1)])
def test_powerset_round_trip(n, most):
    sets = powerset.members(n, most)
    assert len(sets) == powerset.num_classes(n, most) and sets[0] == ()
    for p, moved in powerset.permutation_mapping(n, most).items():
        for k, m in enumerate(sets):
            assert set(sets[moved[k]]) == {p.index(i) for i in m}


def test_powerset_spark_round_trip(spark):
    sets = powerset.members(3, 2)
    rows = [("f", f, k, int(k in m)) for f, m in enumerate(sets) for k in range(3)]
    df = spark.createDataFrame(rows, "uri string, frame long, k int, score int")
    got = {r.frame: r.ps_class for r in powerset.to_powerset(df, spark, 3, 2).collect()}
    assert got == {i: i for i in range(len(sets))}


def test_stats_pool_known_answers(spark):
    x = [[[2.0, 4.0], [2.0, 4.0]], [[1.0, 1.0], [1.0, 1.0]]]
    w = [[0.5, 0.01], [0.2, 0.1]]
    rows = [(b, f, t, x[b][f][t], w[b][t]) for b in range(2) for f in range(2) for t in range(2)]
    df = spark.createDataFrame(rows, "b int, f int, frame int, x double, w double")
    plain = {(r.b, r.f): (round(r["mean"], 4), round(r["std"], 4)) for r in frames.stats_pool(df, ["b", "f"], weight=None).collect()}
    assert plain == {(0, 0): (3, 1.4142), (0, 1): (3, 1.4142), (1, 0): (1, 0), (1, 1): (1, 0)}
    weighted = {(r.b, r.f): (round(r["mean"], 4), round(r["std"], 4)) for r in frames.stats_pool(df, ["b", "f"]).collect()}
    assert weighted == {(0, 0): (2.0392, 1.4142), (0, 1): (2.0392, 1.4142), (1, 0): (1, 0), (1, 1): (1, 0)}
    none = frames.stats_pool(df.withColumn("w", df.w * 0), ["b", "f"]).first()
    assert (none["mean"], none["std"]) == (0, 0)


def test_hysteresis_known_answer(spark):
    y = [0.1, 0.6, 0.45, 0.3, 0.2, 0.55, 0.9, 0.45]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(y)], "uri string, frame long, score double")
    got = [int(r.active) for r in frames.hysteresis(df, 0.5, 0.4).orderBy("frame").collect()]
    assert got == [0, 1, 1, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("collar,expected", [(0, [(0, 2), (2.3, 3), (5, 6)]), (0.5, [(0, 3), (5, 6)])])
def test_support_known_answers(spark, collar, expected):
    df = spark.createDataFrame([("f", "a", s, e) for s, e in [(0.0, 1.0), (0.5, 2.0), (2.3, 3.0), (5.0, 6.0)]], "uri string, label string, start double, end double")
    assert sorted((r.start, r.end) for r in intervals.support(df, collar=collar).collect()) == expected


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [("f", i, float(a := rng.randint(0, 60)), a + rng.choice([0.0, 1.0, 7.0, 30.0])) for i in range(40)]
    df = spark.createDataFrame(rows, "uri string, i int, start double, end double")
    for kind, test in {"overlap": lambda x, y: x[2] < y[3] and x[3] > y[2], "touch": lambda x, y: x[2] <= y[3] and x[3] >= y[2], "contains": lambda x, y: x[2] <= y[2] and x[3] >= y[3]}.items():
        got = sorted((r.i, r.r_i) for r in intervals.interval_join(df, df, ["uri"], 10, kind).collect())
        assert got == sorted((x[1], y[1]) for x in rows for y in rows if test(x, y)), kind


def points(spark):
    return spark.createDataFrame([("u", 0, 10, "view", 0), ("u", 5, 5, "click", 1), ("u", 10, 10, "click", 2), ("u", 7, 12, "click", 3)], "uri string, start long, end long, label string, track long")


def test_crop_keeps_segments_without_length(spark):
    s = points(spark)
    got = intervals.crop(intervals.subset(s, ["click"]), intervals.subset(s, ["view"]), 4).select("track", "start", "end")
    assert sorted(map(tuple, got.collect())) == [(1, 5, 5), (3, 7, 10)]


def test_label_intersection_keeps_segments_without_length(spark):
    got = intervals.label_intersection(points(spark).where("track < 2"), ["click", "view"], "both", 4)
    assert sorted(map(tuple, got.collect())) == [("u", "both", 5, 5)]


def test_overlap_with_segments_without_length(spark):
    s = points(spark)
    pairs = intervals.clipped(intervals.interval_join(s, s, ["uri"], 4).where("track < r_track"))
    assert sorted(map(tuple, pairs.select("track", "r_track", "start", "end").collect())) == [(0, 1, 5, 5), (0, 3, 7, 10), (2, 3, 10, 10)]


@pytest.mark.parametrize("shape", [(1, 1), (2, 5), (5, 5), (4, 7)])
def test_matrices_side_by_side(shape):
    rng = np.random.default_rng(3)
    cost = np.concatenate([rng.random((60, *shape)), -rng.integers(0, 3, (60, *shape)).astype(float)])
    for row, one in zip(assignment.solve_many(cost).tolist(), cost, strict=True):
        assert list(enumerate(row)) == assignment.solve(one)


def test_many_files_take_few_python_calls(spark, monkeypatch):
    """A mapping of thousands of files is solved in batches of files, not file by file."""
    rows = [(f"f{k}", a, b, float((k * 7 + ord(a) * 3 + ord(b) * 5) % 11)) for k in range(3000) for a in "abc" for b in "xy"]
    df = spark.createDataFrame(rows, "uri string, label string, r_label string, together double")
    m = assignment._mapping(df, False)
    assert "FlatMapGroupsInPandas" not in m._jdf.queryExecution().toString()
    got = {}
    for r in m.collect():
        got[r["uri"]] = got.get(r["uri"], 0.0) + r["together"]
    gain = {(u, a, b): g for u, a, b, g in rows}
    for k in range(0, 3000, 37):
        best = max(gain[f"f{k}", a, "x"] + gain[f"f{k}", b, "y"] for a in "abc" for b in "abc" if a != b)
        assert got.get(f"f{k}", 0.0) == best


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "uri string, label string, start double, end double")
    assert intervals.support(none).count() == 0 == intervals.gaps(none).count()
    assert intervals.interval_join(none, none, ["uri"], 1).count() == 0
    assert metrics.diarization_error(none, none, None, 1).count() == 0


def test_diarization_error_of_segments(spark):
    kinds = "uri string, label string, start double, end double"
    ref = spark.createDataFrame([("f", "a", 0.0, 10.0), ("f", "b", 10.0, 20.0)], kinds)
    hyp = spark.createDataFrame([("f", "x", 0.0, 12.0), ("f", "y", 12.0, 18.0)], kinds)
    r = metrics.diarization_error(ref, hyp, None, 5).first()
    assert (r.false_alarm, r.missed_detection, r.confusion, r.total) == (0, 2, 2, 20)
    r = metrics.diarization_error(ref, hyp, None, 5, collar=4).first()
    assert (r.false_alarm, r.missed_detection, r.confusion, r.total) == (0, 0, 0, 12)
    assert metrics.jaccard_error(ref, hyp, 5).first().jaccard_error_rate == pytest.approx((2 / 12 + 4 / 10) / 2)
    best = metrics.optimal(metrics.best_collar(ref, hyp, [1, 3], 5).withColumnRenamed("collar", "threshold")).first()
    assert best.threshold == 0


def linkage_by_definition(x, method):
    """Merges of the closest clusters by their distance as defined on the points."""
    def dist(a, b):
        d = [np.linalg.norm(x[i] - x[j]) for i in a for j in b]
        return {"single": min, "complete": max, "average": np.mean}[method](d) if method != "centroid" else np.linalg.norm(x[a].mean(0) - x[b].mean(0))

    clusters, heights = [[i] for i in range(len(x))], []
    while len(clusters) > 1:
        h, i, j = min((dist(a, b), i, j) for i, a in enumerate(clusters) for j, b in enumerate(clusters) if i < j)
        heights.append(h)
        clusters[i] = clusters[i] + clusters.pop(j)
    return heights


@pytest.mark.parametrize("method", ["single", "complete", "average", "centroid"])
def test_linkage(method):
    x = np.random.default_rng(4).random((12, 3))
    assert np.allclose(clustering.linkage(x, method)[:, 2], linkage_by_definition(x, method))


def test_agglomerative_regression():
    x = np.array([[1.0, 1, 1, 1], [1, 2, 1, 2]])
    got = clustering.Agglomerative("centroid", 0.0, 0).cluster(x, num=2)
    assert got.tolist() == [0, 1]


def test_kmeans_and_vbx_find_clear_groups():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.02, (20, 8)) + np.eye(8)[k] for k in range(3)])
    truth = np.repeat(range(3), 20)
    for got in (clustering.KMeans().cluster(x, num=3), clustering.Vbx(clustering.Plda.identity(8, 10.0), fa=1.0, fb=1.0).cluster(x)):
        assert len(set(zip(got, truth))) == 3 == len(set(got))


def test_vbx_bound_rises():
    rng = np.random.default_rng(6)
    gamma = rng.random((30, 4))
    _, _, bound = clustering.vbx(rng.normal(size=(30, 5)), np.full(5, 2.0), gamma / gamma.sum(1, keepdims=True))
    assert all(b >= a - 1e-6 for a, b in zip(bound, bound[1:]))


def test_isotonic(spark, tmp_path):
    df = spark.createDataFrame([(0.1, 0.0), (0.2, 0.0), (0.3, 1.0), (0.4, 0.0), (0.5, 1.0)], "score double, y double")
    c = clustering.Isotonic.fit(df)
    c.save(str(tmp_path / "c.json"))
    c = clustering.Isotonic.load(str(tmp_path / "c.json"))
    got = [r.v for r in df.unionByName(spark.createDataFrame([(None, 0.0)], df.schema)).select(c.column().alias("v")).collect()]
    assert got[:5] == sorted(got[:5]) and got[5] == 2.0


def test_geometry():
    layers = [geometry.Conv(k, s) for k, s in zip((251, 3, 5, 3, 5, 3), (10, 3, 1, 3, 1, 3))]
    assert geometry.num_frames(160_000, layers) == 589
    assert (geometry.receptive_size(layers), geometry.receptive_step(layers)) == (991, 270)
    field = geometry.receptive_field(layers, 16_000)
    assert (field.start, field.duration, field.step) == (0, 0.0619375, 0.016875)


def test_samples_do_not_depend_on_partitions(spark):
    rows = [(f"u{i % 5}", float(i), 3.0 + i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "uri string, start double, duration double")
    draw = lambda d, seed: sorted(map(tuple, metadata.sample_chunks(d, 200, 2.0, seed).collect()))
    first = draw(df.repartition(1), 1)
    assert first == draw(df.repartition(7), 1) and first != draw(df, 2) and len(first) == 200


def test_class_balanced(spark):
    rows = [("a", "u", 0.0, 10.0), ("b", "u", 10.0, 11.0), ("b", "v", 0.0, 9.0)]
    df = spark.createDataFrame(rows, "label string, uri string, start double, end double")
    got = metadata.class_balanced(df, 8, 1.0, 3).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"a": 8, "b": 8}


def test_formats(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER trñ 1 1.440 11.872 <NA> <NA> MÉO069 <NA> <NA>\n\nSPEAKER b 1 0 1 <NA> <NA> x <NA> <NA>\n")
    (tmp_path / "a.stm").write_text("s 1 Ann 6.68 7.16 Hello there?\n")
    (tmp_path / "a.uem").write_text("b NA 0.000 30.000\n")
    rttm = formats.read_rttm(spark, str(tmp_path / "a.rttm"))
    assert [(r.uri, r.start, round(r.end, 3), r.label) for r in rttm.orderBy("uri").collect()] == [("b", 0, 1, "x"), ("trñ", 1.44, 13.312, "MÉO069")]
    assert formats.read_stm(spark, str(tmp_path / "a.stm")).first().text == "Hello there?"
    assert formats.read_uem(spark, str(tmp_path / "a.uem")).first().end == 30
    formats.write_rttm(rttm, str(tmp_path / "out"))
    again = formats.read_rttm(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rttm.collect()))
    with pytest.raises(Exception):
        formats.write_rttm(rttm, str(tmp_path / "out"))
    turns = formats.read_turns_json(formats.json_documents(rttm))
    assert turns.count() == 2
    total = formats.report(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "uri string, total double"), ["total"])
    assert {r.uri: r.total for r in total.collect()} == {"a": 1, "b": 2, "TOTAL": 3}


def test_audio(spark, tmp_path):
    import wave

    x = (np.sin(np.arange(100)) * 10_000).astype("<i2")
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(10)
        w.writeframes(x.tobytes())
    audio = formats.read_wav(spark, str(tmp_path / "x.wav"))
    row = audio.first()
    assert row.uri == "x" and np.allclose(row.samples, x / 32768)
    from pyspark.sql import functions as F

    cut = audio.select(formats.crop_samples(F.col("samples"), F.col("sample_rate"), -0.5, 1.0, pad=True).alias("s")).first().s
    assert cut[:5] == [0.0] * 5 and np.allclose(cut[5:], x[:10] / 32768)
    chunks = inference.audio_chunks(audio, 3.0, 2.0).collect()
    assert [len(r.samples) for r in chunks] == [30] * len(chunks) and len(chunks) == 5
    scores = inference.infer(audio, lambda s: s.map(lambda v: [abs(v[0]), abs(v[1])]), 2, 3.0, 2.0, skip_aggregation=True)
    assert scores.count() == 10


def test_pipelines(spark, sf):
    chunks, emb = pipelines.sample_scores(spark, sf)
    steps = []
    p = pipelines.DiarizationParams(frames_per_chunk=24, chunk_step=6.0, frame_step=1.0, clustering=clustering.Agglomerative(threshold=0.9, min_cluster_size=2))
    out = pipelines.diarize(chunks, emb, p, lambda name, df: steps.append(name))
    assert steps == ["speaker_counting", "embeddings", "clustering", "discrete_diarization"]
    rows = out.exclusive.collect()
    overlapping = [(a, b) for a, b in itertools.combinations(rows, 2) if a.uri == b.uri and a.start < b.end - 1e-9 and b.start < a.end - 1e-9]
    assert out.diarization.count() and not overlapping
    files = spark.createDataFrame([("a",), ("a",)], "uri string")
    with pytest.raises(ValueError):
        pipelines.run_batch(files, lambda: None)


def test_streamed_hysteresis_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"u{k}", i, rng.random()) for i in range(40) for k in range(3)]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], "uri string, frame long, score double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from turnweave.streaming.ordered import hysteresis_stream

    stream = spark.readStream.schema("uri string, frame long, score double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = hysteresis_stream(stream, 0.7, 0.3).writeStream.format("memory").queryName("hys").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = frames.hysteresis(spark.createDataFrame(rows, "uri string, frame long, score double"), 0.7, 0.3)
    got = {(r.uri, r.frame): r.active for r in spark.sql("SELECT * FROM hys").collect()}
    assert got == {(r.uri, r.frame): r.active for r in batch.collect()}


def test_every_window_with_a_valid_partner_gets_one(spark):
    rng = random.Random(8)
    windows, speakers, segments = [], {}, []
    for uri in ("crowded", "mixed", "lone"):
        for w in range({"crowded": 60, "mixed": 40, "lone": 1}[uri]):
            labels = {"a"} if uri == "crowded" and w not in (7, 31) else set(rng.sample("abcde", rng.choice([0, 0, 1, 2, 3])))
            windows.append((uri, w, w * 10.0, w * 10.0 + 10))
            segments += [(uri, x, w * 10.0 + 1, w * 10.0 + 9) for x in labels]
            speakers[uri, w] = labels
    w = spark.createDataFrame(windows, "uri string, window long, start double, end double").repartition(3)
    s = spark.createDataFrame(segments, "uri string, label string, start double, end double")
    for most in (1, 3):
        valid = {
            (u, i): {j for (v, j), b in speakers.items() if v == u and j != i and not a & b and len(a) + len(b) <= most}
            for (u, i), a in speakers.items()
        }
        got = {}
        for r in metadata.mixture_partners(w, s, most, 50.0, 5).collect():
            assert (r.uri, r.window) not in got
            got[r.uri, r.window] = r.partner
        assert set(got) == {k for k, v in valid.items() if v}
        assert all(p in valid[k] for k, p in got.items())
    again = metadata.mixture_partners(w.repartition(7), s, most, 50.0, 5).collect()
    assert {(r.uri, r.window): r.partner for r in again} == got
