"""Configuration, targets, batches and the command line."""

import pytest

from turnweave.__main__ import main
from turnweave.operators import preparation
from turnweave.plans import config
from turnweave.sources import formats

KINDS = "uri string, label string, start double, end double"


def test_models_are_resolved():
    given = {"a": "$model/seg", "b": ["$model/emb@v2", 3], "c": {"d": "plain"}}
    got = config.resolve_models(given, "m", "sub/", "v1")
    assert got["a"]["subfolder"] == "sub/seg" and got["a"]["revision"] == "v1"
    assert got["b"][0]["subfolder"] == "sub/emb" and got["b"][0]["revision"] == "v2" and got["b"][1] == 3
    assert got["c"] == {"d": "plain"} and given["a"] == "$model/seg"


def test_parameters():
    space = {"t": config.Uniform(0, 1), "n": config.Integer(1, 3), "m": config.Categorical(("x", "y")), "f": 5}
    first = list(config.draw(space, 20, 1))
    assert first == list(config.draw(space, 20, 1)) and all(0 <= p["t"] <= 1 and p["n"] in (1, 2, 3) and p["f"] == 5 for p in first)
    assert len(config.grid(a=[1, 2], b=[3, 4])) == 4


def test_oracle_segmentation(spark):
    segments = spark.createDataFrame([("f", "a", 0.0, 3.0), ("f", "b", 2.0, 9.0)], KINDS)
    chunks = spark.createDataFrame([("f", 0, 0.0, 5.0), ("f", 1, 5.0, 10.0)], "uri string, chunk long, start double, end double")
    rows = preparation.oracle_segmentation(segments, chunks, 1.0, 5, 4.0).collect()
    on = {(r.chunk, r.k): sorted(x.frame for x in rows if (x.chunk, x.k) == (r.chunk, r.k) and x.score) for r in rows}
    assert on == {(0, 0): [0, 1, 2, 3], (0, 1): [2, 3, 4], (1, 0): [], (1, 1): [0, 1, 2, 3, 4]}
    one = preparation.oracle_segmentation(segments, chunks, 1.0, 5, 4.0, 1).collect()
    assert sum(r.score for r in one if r.chunk == 0) == 4 and {r.k for r in one} == {0}
    three = preparation.oracle_segmentation(segments, chunks, 1.0, 5, 4.0, 3).collect()
    assert {r.k for r in three} == {0, 1, 2} and not any(r.score for r in three if r.k == 2)


def test_batches(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0]), (1, [4.0])], "batch int, samples array<double>")
    got = sorted((r.batch, r.samples) for r in preparation.collate(df).collect())
    assert got == [(0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [4.0])]
    pair = spark.createDataFrame([([1.0, 2.0], [3.0], ["a"], ["b"])], "samples array<double>, r_samples array<double>, labels array<string>, r_labels array<string>")
    assert tuple(preparation.mix(pair).first()) == ([4.0, 2.0], ["a", "b"])
    mid = preparation.centre(spark.createDataFrame([("f", "a", 0.0, 10.0), ("f", "a", 0.0, 2.0)], KINDS), 4.0)
    assert sorted((r.start, r.end) for r in mid.collect()) == [(0, 2), (3, 7)]


def test_prepared_tables(spark, tmp_path):
    df = spark.createDataFrame([("f", "a", 0.0, 1.0)], KINDS)
    preparation.write_prepared({"annotations": df}, str(tmp_path / "p"), "one")
    assert preparation.read_prepared(spark, str(tmp_path / "p"), "one")["annotations"].count() == 1
    with pytest.raises(ValueError):
        preparation.read_prepared(spark, str(tmp_path / "p"), "two")


def test_command_line(spark, tmp_path):
    scores = spark.createDataFrame([("f", i, float(3 <= i < 6)) for i in range(10)], "uri string, frame long, score double")
    scores.write.parquet(str(tmp_path / "scores"))
    main(["apply", str(tmp_path / "scores"), str(tmp_path / "out"), "--step", "1", "--duration", "1"])
    r = formats.read_rttm(spark, str(tmp_path / "out")).first()
    assert (r.uri, r.start, r.end, r.label) == ("f", 3.5, 6.5, "SPEECH")
    main(["benchmark", str(tmp_path / "out"), str(tmp_path / "out"), str(tmp_path / "report")])
    total = spark.read.csv(str(tmp_path / "report/errors"), header=True, inferSchema=True).where("uri = 'TOTAL'").first()
    assert total.diarization_error_rate == 0 and total.total == 3
