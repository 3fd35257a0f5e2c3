"""Files, parameters, samples and pipelines against known answers and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnweave.operators import assignment, clustering, frames, metadata, metrics
from turnweave.plans import config, inference, pipelines
from turnweave.sources import formats


def test_channels_and_resampling(spark):
    t = np.arange(800) / 8000
    tone = np.sin(2 * np.pi * 200 * t)
    df = spark.createDataFrame([("a", 8000, 0, tone.tolist()), ("a", 8000, 1, [0.0] * 800)], "uri string, sample_rate int, channel int, samples array<double>")
    half = formats.resample(formats.select_channel(df, 0), 4000).first()
    assert half.sample_rate == 4000 and len(half.samples) == 400
    assert np.abs(np.array(half.samples)[30:-30] - tone[::2][30:-30]).max() < 0.02
    up = np.array(formats.resample(formats.select_channel(df, 0), 16000).first().samples)
    assert len(up) == 1600 and np.abs(up[60:-60:2] - tone[30:-30]).max() < 0.02
    assert np.allclose(formats.select_channel(df, "downmix").first().samples, tone / 2)
    assert formats.select_channel(df, "random", 3).count() == 1
    assert formats.resample(formats.select_channel(df, 0), 8000).first().samples == tone.tolist()


def test_files_are_validated_and_prepared(spark):
    df = spark.createDataFrame([("x/y/trñ.wav", None, 1), ("b.flac", "own", 1)], "path string, uri string, channel int")
    out = formats.prepare_files(df, {"size": F.length("path")}, preload=True)
    assert sorted((r.uri, r["size"]) for r in out.collect()) == [("own", 6), ("trñ", 11)] and "channel" not in out.columns
    with pytest.raises(Exception, match="neither path nor samples"):
        formats.validate_files(spark.createDataFrame([(None, "u")], "path string, uri string")).collect()
    bad = spark.createDataFrame([("u", [0.1], 8000, 3)], "uri string, samples array<double>, sample_rate int, channels int")
    with pytest.raises(Exception, match="more channels"):
        formats.validate_files(bad).collect()
    assert formats.with_paths(df.select("uri").where("uri = 'own'"), "/data/{uri}.wav").first().path == "/data/own.wav"
    assert formats.sample_segments(spark).count() == 6


def test_protocol(spark, tmp_path):
    for name, text in (("train.lst", "a\nb\n"), ("dev.lst", "c\n"), ("train.rttm", "SPEAKER a 1 0 1 <NA> <NA> x <NA> <NA>\n")):
        (tmp_path / name).write_text(text)
    conf = {"train": {"uri": str(tmp_path / "train.lst"), "annotation": str(tmp_path / "train.rttm"), "audio": "w/{uri}.wav"}, "development": {"uri": str(tmp_path / "dev.lst")}}
    both = formats.read_subsets(spark, {k: {x: y for x, y in v.items() if x != "audio"} for k, v in conf.items()}, ["train", "development"])
    assert sorted((r.uri, r.subset) for r in both["files"].collect()) == [("a", "train"), ("b", "train"), ("c", "development")]
    tables = {k: formats.read_protocol(spark, conf, k) for k in conf}
    assert sorted(r.path for r in tables["train"]["files"].collect()) == ["w/a.wav", "w/b.wav"]
    got = formats.check_protocol(tables)
    assert got["has_validation"] and got["scopes"] == ["file"] and not got["has_classes"] and "train.annotated" in got["missing"]
    with pytest.raises(ValueError):
        formats.check_protocol({"development": tables["development"]})


def test_space_journal_and_tasks(tmp_path):
    space = config.Space({"a": config.Uniform(0, 1), "b": config.Integer(1, 2), "c": 5}).freeze(b=2)
    assert space.instantiate(a=0.5) == {"a": 0.5, "b": 2, "c": 5}
    for wrong in ({}, {"a": 1, "b": 1}):
        with pytest.raises(ValueError):
            space.instantiate(**wrong)
    assert all(t["b"] == 2 and 0 <= t["a"] <= 1 for t in space.trials(5))
    journal = config.Journal(str(tmp_path / "j"))
    assert [journal.add({"x": x}, loss) for x, loss in ((1, 3.0), (2, 3.0), (3, 1.0))] == [True, False, True]
    again = config.Journal(str(tmp_path / "j"))
    assert len(again.trials()) == 3 and again.best() == {"params": {"x": 3}, "loss": 1.0}
    assert config.per_task({"a": 1, "b": (2, 3)}, lambda v: v * 2) == {"a": 2, "b": (4, 6)}


def test_numbers_follow_the_order_over_many_ranges(spark):
    words = [f"w{k:05d}" for k in range(500)]
    random.Random(1).shuffle(words)
    df = spark.createDataFrame([(w,) for w in words], "label string").repartition(7)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = {r.label: r.idx for r in metadata.dictionary(df, "label").collect()}
        assert got == {w: k for k, w in enumerate(sorted(words))}
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_balanced_samples(spark):
    rows = [(f"u{k}", k % 3, None if k % 2 else "x", float(k), 10.0 + k) for k in range(20)] + [("s", 9, "x", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "uri string, domain int, place string, start double, duration double")
    got = metadata.balanced_samples(df, ["domain", "place"], 100, 5.0, 3).collect()
    counts = {}
    for r in got:
        counts[r.domain, r.place] = counts.get((r.domain, r.place), 0) + 1
        home = next(x for x in rows if x[0] == r.uri)
        assert (home[1], home[2]) == (r.domain, r.place) and home[3] <= r.start <= home[3] + home[4] - 5
    assert len(got) == 100 and len(counts) == 6 and set(counts.values()) == {16, 17}


def test_class_balanced_varies_and_pads(spark):
    turns = spark.createDataFrame([("a", "u", 0.0, 2.0), ("b", "u", 5.0, 50.0)], "label string, uri string, start double, end double")
    got = metadata.class_balanced(turns, 64, 10.0, 1, least=4.0, batch=16).collect()
    assert len(got) == 128
    for r in got:
        assert (r.start == 0 and r.duration == 2 and 0 <= r.pad <= 8) if r.label == "a" else (r.pad == 0 and 5 <= r.start <= 50 - r.duration and 4 <= r.duration <= 10)
    assert len({round(r.duration, 9) for r in got if r.label == "b"}) == 4


def test_det_curve_over_many_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 400) / 7, int(rng.random() < 0.4)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "score double, y int").repartition(50)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = {t: (sum(s > t for s in neg) / len(neg), sum(s <= t for s in pos) / len(pos)) for t in {s for s, _ in rows}}
    area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        got = {r.threshold: (r.fpr, r.fnr) for r in metrics.det_curve(df).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[t], want[t]) for t in want)
        assert abs(metrics.auroc(df).first().auroc - area) < 1e-9
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_isotonic_expression_equals_interpolation(spark):
    model = clustering.Isotonic((0.0, 0.0, 1.0, 2.5, 4.0), (0.1, 0.1, 0.3, 0.3, 0.9))
    xs = [-1.0, 0.0, 0.25, 1.0, 1.7, 2.5, 3.9, 4.0, 9.0]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "score double")
    got = [r.p for r in df.select("score", model.column().alias("p")).collect()]
    assert np.allclose(got, [*np.interp(xs, [0.0, 1.0, 2.5, 4.0], [0.1, 0.3, 0.3, 0.9]), 2.0, 2.0])


def test_binarize_breaks_where_frames_are_missing(spark):
    rows = [("f", k, 1.0) for k in (0, 1, 2, 10, 11)] + [("f", 12, 0.0)]
    df = spark.createDataFrame(rows, "uri string, frame long, score double")
    got = sorted((r.start, r.end) for r in frames.binarize(df, 0.5, 0.5, 1.0, 1.0).collect())
    assert got == [(0.5, 2.5), (10.5, 12.5)]


def test_permutation_graph_equals_brute_force(spark):
    rng = random.Random(4)
    n, duration, step = 10, 5.0, 1.0
    y = {(c, f, k): float(rng.random() < 0.4) for c in range(6) for f in range(n) for k in range(2)}
    df = spark.createDataFrame([("u", c, f, k, v) for (c, f, k), v in y.items()], "uri string, chunk long, frame long, k long, score double")
    got = {(r.chunk, r.k, r.r_chunk, r.r_k): r.cost for r in assignment.permutation_graph(df, n, duration, step).collect()}
    want = {}
    for c, o in itertools.permutations(range(6), 2):
        if abs(c - o) > 4:
            continue
        shift = round((o - c) * n * step / duration)
        both = [(f, f - shift) for f in range(n) if 0 <= f - shift < n]
        costs = {(k, j): np.mean([(y[c, f, k] - y[o, g, j]) ** 2 for f, g in both]) for k in range(2) for j in range(2)}
        best = min(sum(costs[k, p[k]] for k in range(2)) for p in ((0, 1), (1, 0)))
        want[c, o] = (best, costs, both)
    assert {(c, o) for c, _, o, _ in got} <= set(want)
    for (c, o), (best, costs, both) in want.items():
        mine = [(k, j) for a, k, b, j in got if (a, b) == (c, o)]
        assert all(abs(got[c, k, o, j] - costs[k, j]) < 1e-9 for k, j in mine)
        if len(mine) == 2:
            assert abs(sum(costs[p] for p in mine) - best) < 1e-9
        assert all(max(y[c, f, k] for f, _ in both) > 0.5 and max(y[o, g, j] for _, g in both) > 0.5 for k, j in mine)
    assert got


def test_permute_with_a_cost_of_ones_own():
    a = np.array([[0.0, 1], [1, 0], [1, 1]])
    out, order, costs = assignment.permute(a, a[:, ::-1], lambda x, y: float(np.abs(x - y).max()))
    assert order == [1, 0] and np.array_equal(out, a) and costs.shape == (2, 2)


def python_diarization(chunks, clusters, n, step, speakers):
    """Counts, activations and the active clusters of each frame, as plain loops."""
    total, seen, act = {}, {}, {}
    for c, grid in chunks.items():
        for f in range(n):
            at = c * step + f
            total[at] = total.get(at, 0) + sum(grid[k][f] for k in grid)
            seen[at] = seen.get(at, 0) + 1
            by = {}
            for k in grid:
                if clusters.get((c, k)) is not None:
                    by[clusters[c, k]] = max(by.get(clusters[c, k], 0), grid[k][f])
            for j, v in by.items():
                act[at, j] = act.get((at, j), 0) + v
    out = {}
    for at in range(min(total), max(total) + 1):
        count = int(np.rint(total.get(at, 0) / seen[at])) if at in seen else 0
        width = max(speakers, count)
        order = sorted(range(width), key=lambda j: (-act.get((at, j), 0), j))
        out[at] = set(order[:count])
    return out


def test_diarization_equals_brute_force(spark):
    rng = random.Random(9)
    n, step = 6, 3
    chunks, rows, emb = {}, [], []
    centres = np.eye(3, 8) * 5
    who = {}
    for c in range(7):
        chunks[c] = {}
        for k in range(2):
            a = rng.randint(0, n)
            on = [1.0 if rng.random() < 0.7 and a <= f + 2 else 0.0 for f in range(n)]
            chunks[c][k] = on
            who[c, k] = rng.randint(0, 2)
            rows += [("u", c, f, k, v) for f, v in enumerate(on)]
            emb.append(("u", c, k, (centres[who[c, k]] + 0.01 * np.array([rng.random() for _ in range(8)])).tolist()))
    seg = spark.createDataFrame(rows, "uri string, chunk long, frame long, k long, score double")
    e = spark.createDataFrame(emb, "uri string, chunk long, speaker long, embedding array<double>")
    p = pipelines.DiarizationParams(frames_per_chunk=n, chunk_step=float(step), frame_step=1.0, min_active_ratio=0.0, clustering=clustering.Agglomerative(threshold=0.5, min_cluster_size=1))
    done = pipelines.diarize(seg, e, p)
    usable = frames.active_embeddings(seg, e, n, 0.0)
    trained = clustering.cluster(usable, p.clustering)
    hard = {(r.chunk, r.speaker): r.cluster for r in frames.inactive(seg, clustering.assign(e, trained)).collect()}
    speakers = max(v for v in hard.values() if v is not None) + 1
    want = python_diarization(chunks, hard, n, step, speakers)
    last = max(want)
    for df, most in ((done.diarization, None), (done.exclusive, 1)):
        on = {at: set() for at in want}
        for r in df.collect():
            k = int(r.label[-2:])
            for at in want:
                if r.start <= at + 0.5 < r.end:
                    on[at].add(k)
        for at in range(last):  # the last frame's middle ends the signal
            if most is None:
                assert on[at] == want[at], at
            else:
                assert len(on[at]) <= 1 and on[at] <= want[at] and bool(on[at]) == bool(want[at])
    assert {r.cluster for r in done.centroids.collect()} >= set(range(speakers))
    sources = seg.withColumn("score", F.col("score") * (F.col("k") + 1.0))
    out = pipelines.separate(seg, sources, e, p, n, 1.0).sources.collect()
    spoken = {int(r.label[-2:]) for r in done.diarization.collect()}
    assert out and {r.k for r in out} <= spoken and all(abs(r.normalised) <= 1 + 1e-9 for r in out)


def test_evaluate_and_collars(spark):
    ref = spark.createDataFrame([("u", 0.0, 10.0, "a"), ("u", 10.0, 20.0, "b")], "uri string, start double, end double, label string")
    rows = [("u", f, k, float((f < 10) == (k == 1))) for f in range(20) for k in range(2)]
    scores = spark.createDataFrame(rows, "uri string, frame long, k long, score double")
    got = {r.uri: r for r in pipelines.evaluate(ref, scores, None, 1.0, 0.0, 20).collect()}
    assert got["u"].confusion <= 2 and got["u"].false_alarm == 0 and "TOTAL" in got
    uem = spark.createDataFrame([("u", 0.0, 5.0)], "uri string, start double, end double")
    assert {r.uri: r.total for r in pipelines.evaluate(ref, scores, uem, 1.0, 0.0, 20).collect()}["u"] == 5
    hyp = spark.createDataFrame([("u", 1.0, 10.0, "a"), ("u", 10.0, 20.0, "b")], "uri string, start double, end double, label string")
    assert metrics.macro_f(ref, hyp, 30.0).first().f_measure < 1
    assert metrics.macro_f(ref, hyp, 30.0, collar=2.0).first().f_measure == 1


def test_whole_windows_and_parts(spark):
    audio = spark.createDataFrame([("a", 10, [float(i) for i in range(40)])], "uri string, sample_rate int, samples array<double>")
    mean = lambda s: s.map(lambda v: [float(sum(v)), float(len(v))])
    assert sorted((r.k, r.score) for r in inference.infer_whole(audio, mean, 2).collect()) == [(0, 780.0), (1, 40.0)]
    parts = spark.createDataFrame([("a", 1.0, 2.0), ("a", 0.0, 0.5)], "uri string, start double, end double")
    got = {(r.start, r.k): r.score for r in inference.infer_crop(audio, parts, mean, 2).collect()}
    assert got == {(1.0, 0): 145.0, (1.0, 1): 10.0, (0.0, 0): 10.0, (0.0, 1): 5.0}


def test_optimise_command(spark, tmp_path):
    from turnweave.__main__ import main

    scores = spark.createDataFrame([("f", i, 0.5 if 3 <= i < 6 else 0.02) for i in range(10)], "uri string, frame long, score double")
    scores.write.parquet(str(tmp_path / "scores"))
    (tmp_path / "r.rttm").write_text("SPEAKER f 1 3.5 3.0 <NA> <NA> x <NA> <NA>\n")
    main(["optimise", str(tmp_path / "scores"), str(tmp_path / "r.rttm"), str(tmp_path / "best"), "--trials", "6", "--step", "1", "--duration", "1"])
    journal = config.Journal(str(tmp_path / "best"))
    assert len(journal.trials()) == 6 and journal.best()["loss"] == 0 and journal.best()["params"]["onset"] < 0.5
