"""Evaluation metrics as mergeable sums: components first, ratios from their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnweave.operators.assignment import optimal_mapping, permute_frames
from turnweave.operators.intervals import clipped, covered, crop, interval_join, support

PARTS = ("false_alarm", "missed_detection", "confusion", "total")
TINY = 1e-8


def frame_errors(target: DataFrame, pred: DataFrame, thresholds: Sequence[float] = (0.5,), keys: Sequence[str] = ("uri", "chunk"), mapping: DataFrame | None = None) -> DataFrame:
    """keys, frame, threshold and the four parts. Classes of ``pred`` are brought into the target's order first (``mapping``: keys, k, r_k; else as they are); above the threshold counts."""
    p = pred.select(*keys, "frame", F.col("k").alias("r_k"), F.col("score").alias("p"))
    if mapping is not None:
        p = p.join(mapping, [*keys, "r_k"]).drop("r_k")
    else:
        p = p.withColumnRenamed("r_k", "k")
    rows = target.select(*keys, "frame", "k", F.col("score").alias("t")).join(p, [*keys, "frame", "k"], "full")
    rows = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, map(float, thresholds)))))
    t = F.coalesce(F.col("t"), F.lit(0.0))
    h = F.when(F.coalesce(F.col("p"), F.lit(0.0)) > F.col("threshold"), 1.0).otherwise(0.0)
    sums = rows.groupBy(*keys, "frame", "threshold").agg(F.sum(t).alias("t"), F.sum(h).alias("h"), F.sum(F.when(h != t, h).otherwise(0.0)).alias("d"))
    fa, miss = F.greatest(F.lit(0.0), F.col("h") - F.col("t")), F.greatest(F.lit(0.0), F.col("t") - F.col("h"))
    return sums.select(*keys, "frame", "threshold", fa.alias("false_alarm"), miss.alias("missed_detection"), (F.col("d") - fa).alias("confusion"), F.col("t").alias("total"))


def total_errors(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in PARTS])


def ratios() -> dict[str, Column]:
    """Every ratio of the four parts, by name."""
    fa, miss, conf, total = (F.col(c) for c in PARTS)
    return {
        "diarization_error_rate": (fa + miss + conf) / (total + TINY),
        "speaker_confusion_rate": conf / (total + TINY),
        "false_alarm_rate": fa / (total + TINY),
        "missed_detection_rate": miss / (total + TINY),
        "detection_error_rate": (fa + miss) / (total + TINY),
        "precision": (total - miss - conf) / (total - miss + TINY),
        "recall": (total - miss - conf) / (total + TINY),
    }


def with_ratios(parts: DataFrame) -> DataFrame:
    return parts.withColumns(ratios())


def der(target: DataFrame, pred: DataFrame, thresholds: Sequence[float] = (0.5,), keys: Sequence[str] = ("uri", "chunk"), reduce: Sequence[str] = ()) -> DataFrame:
    """Diarization error with the best order of classes for each group of ``keys``, summed over ``reduce``."""
    parts = frame_errors(target, pred, thresholds, keys, permute_frames(target, pred, tuple(keys)))
    return with_ratios(total_errors(parts, [*reduce, "threshold"]))


def optimal(rates: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The row of the threshold with the least error; ties: the lowest threshold."""
    best = F.min_by(F.struct(*rates.columns), F.struct("diarization_error_rate", "threshold"))
    return rates.groupBy(*keys).agg(best.alias("b")).select("b.*")


def thresholds(n: int = 51) -> list[float]:
    return [i / (n - 1) for i in range(n)]


def segmentation_error(target: DataFrame, pred: DataFrame, window: int, step: int | None = None, threshold: float = 0.5) -> DataFrame:
    """Errors with an order of classes of its own for every window of frames; frames after the last whole window don't count."""
    step = step or max(1, window // 2)
    last = target.groupBy("uri", "chunk").agg(F.max("frame").alias("_n"))

    def windows(df: DataFrame) -> DataFrame:
        lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame") - window + 1) / step).cast("long"))
        hi = F.least(F.floor((F.col("_n") + 1 - window) / step), F.floor(F.col("frame") / step)).cast("long")
        return df.join(last, ["uri", "chunk"]).where(lo <= hi).withColumn("window", F.explode(F.sequence(lo, hi))).drop("_n")

    t, p, keys = windows(target), windows(pred), ["uri", "chunk", "window"]
    return with_ratios(total_errors(frame_errors(t, p, [threshold], keys, permute_frames(t, p, tuple(keys)))))


# -- segments

def atoms(reference: DataFrame, hypothesis: DataFrame, uem: DataFrame | None, bucket: float, collar: float = 0.0) -> DataFrame:
    """Stretches of time of a uri between any two borders: start, end, refs and hyps (sorted arrays of labels).

    With a collar, half of it on both sides of each of the reference's borders is left out."""
    bounds = reference.select("uri", F.explode(F.array("start", "end")).alias("t")).unionByName(hypothesis.select("uri", F.explode(F.array("start", "end")).alias("t")))
    if uem is not None:
        bounds = bounds.unionByName(uem.select("uri", F.explode(F.array("start", "end")).alias("t")))
    if collar:
        edges = reference.select("uri", F.explode(F.array("start", "end")).alias("t"))
        bounds = bounds.unionByName(edges.select("uri", F.explode(F.array(F.col("t") - collar / 2, F.col("t") + collar / 2)).alias("t")))
    following = F.lead("t").over(W.partitionBy("uri").orderBy("t"))
    cells = bounds.distinct().select("uri", F.col("t").alias("start"), following.alias("end")).where("end is not null")
    if uem is not None:
        cells = covered(cells, uem, bucket)
    if collar:
        no = edges.select("uri", (F.col("t") - collar / 2).alias("start"), (F.col("t") + collar / 2).alias("end"))
        inside = interval_join(support(no, ["uri"]), cells, ["uri"], bucket, "contains").select("uri", F.col("r_start").alias("start"), F.col("r_end").alias("end"))
        cells = cells.join(inside, ["uri", "start", "end"], "left_anti")

    def labels(df: DataFrame, name: str) -> DataFrame:
        held = interval_join(df.select("uri", "label", "start", "end"), cells, ["uri"], bucket, "contains")
        return held.groupBy("uri", F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.array_sort(F.collect_set("label")).alias(name))

    none = F.array().cast("array<string>")
    out = cells.join(labels(reference, "refs"), ["uri", "start", "end"], "left").join(labels(hypothesis, "hyps"), ["uri", "start", "end"], "left")
    return out.withColumns({"refs": F.coalesce("refs", none), "hyps": F.coalesce("hyps", none)})


def segment_errors(cells: DataFrame, skip_overlap: bool = False) -> DataFrame:
    """The four parts of each uri from ``atoms`` whose hypothesis has the reference's labels."""
    if skip_overlap:
        cells = cells.where(F.size("refs") < 2)
    d = F.col("end") - F.col("start")
    r, h = F.size("refs"), F.size("hyps")
    right = F.size(F.array_intersect("refs", "hyps"))
    zero = F.lit(0)
    return cells.groupBy("uri").agg(F.sum(d * F.greatest(zero, h - r)).alias("false_alarm"), F.sum(d * F.greatest(zero, r - h)).alias("missed_detection"), F.sum(d * (F.least(r, h) - right)).alias("confusion"), F.sum(d * r).alias("total"))


def mapped(hypothesis: DataFrame, mapping: DataFrame) -> DataFrame:
    """The hypothesis under the reference's labels; labels without a counterpart get a name that none has."""
    m = mapping.select("uri", F.col("r_label").alias("label"), F.col("label").alias("_to"))
    return hypothesis.join(m, ["uri", "label"], "left").withColumn("label", F.coalesce("_to", F.concat(F.lit("\u0001"), "label"))).drop("_to")


def diarization_error(reference: DataFrame, hypothesis: DataFrame, uem: DataFrame | None, bucket: float, collar: float = 0.0, skip_overlap: bool = False, mapping: DataFrame | None = None) -> DataFrame:
    """Per uri the four parts and ratios, under the given mapping or the optimal one."""
    if mapping is None:
        mapping = optimal_mapping(reference, hypothesis, bucket)
    return with_ratios(segment_errors(atoms(reference, mapped(hypothesis, mapping), uem, bucket, collar), skip_overlap))


def identification_error(reference: DataFrame, hypothesis: DataFrame, uem: DataFrame | None, bucket: float, collar: float = 0.0) -> DataFrame:
    """As the diarization error with the labels as they are."""
    return with_ratios(segment_errors(atoms(reference, hypothesis, uem, bucket, collar)))


def jaccard_error(reference: DataFrame, hypothesis: DataFrame, bucket: float) -> DataFrame:
    """Per uri the mean over reference labels of 1 - time together / time of either, for the optimal mapping."""
    time = lambda df: support(df).groupBy("uri", "label").agg(F.sum(F.col("end") - F.col("start")).alias("d"))
    r, h = support(reference), support(hypothesis)
    best = optimal_mapping(r, h, bucket)
    rows = time(r).join(best, ["uri", "label"], "left").join(time(h).select("uri", F.col("label").alias("r_label"), F.col("d").alias("e")), ["uri", "r_label"], "left")
    shared = F.coalesce(F.col("together"), F.lit(0.0))
    return rows.groupBy("uri").agg(F.avg(1 - shared / (F.col("d") + F.coalesce(F.col("e"), F.lit(0)) - shared)).alias("jaccard_error_rate"))


def sliding_error(reference: DataFrame, hypothesis: DataFrame, uem: DataFrame, window: float, bucket: float, mapping: DataFrame | None = None) -> DataFrame:
    """Diarization error over windows with half of them in common: uri and window name a file of their own."""
    step = window / 2
    n = F.greatest(F.lit(0), F.floor((F.col("end") - F.col("start") - window) / step)).cast("long")
    cells = uem.select("uri", F.col("start").alias("_s"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("window"), "start", "end")
    cells = cells.select("uri", "window", (F.col("_s") + F.col("window") * step).alias("start"), F.least(F.col("end"), F.col("_s") + F.col("window") * step + window).alias("end"))
    named = cells.select(F.col("uri"), "start", "end", F.format_string("%s#%d", "uri", "window").alias("name"))

    def parts(df: DataFrame) -> DataFrame:
        return clipped(interval_join(named, df.select("uri", "label", "start", "end"), ["uri"], bucket)).select(F.col("name").alias("uri"), F.col("r_label").alias("label"), "start", "end")

    return diarization_error(parts(reference), parts(hypothesis), named.select(F.col("name").alias("uri"), "start", "end"), bucket, mapping=mapping)


def detection(reference: DataFrame, hypothesis: DataFrame, uem: DataFrame | None, bucket: float, keys: Sequence[str] = ("uri",)) -> DataFrame:
    """Per key: true positives, false alarm, missed detection and total time of activity as such, with precision, recall, F and error rate."""
    r, h = support(reference, keys), support(hypothesis, keys)
    if uem is not None:
        r, h = crop(r, uem, bucket), crop(h, uem, bucket)
    time = lambda df, name: df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))
    hit = time(clipped(interval_join(r.select(*keys, "start", "end"), h.select(*keys, "start", "end"), keys, bucket)), "hit")
    out = time(r, "total").join(time(h, "found"), list(keys), "full").join(hit, list(keys), "left").na.fill(0, ["total", "found", "hit"])
    hit_, found, total = F.col("hit").cast("double"), F.col("found").cast("double"), F.col("total").cast("double")
    p, q = F.when(found > 0, hit_ / found).otherwise(1.0), F.when(total > 0, hit_ / total).otherwise(1.0)
    f = F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0)
    return out.select(*keys, "hit", (F.col("found") - F.col("hit")).alias("false_alarm"), (F.col("total") - F.col("hit")).alias("missed_detection"), "total", p.alias("precision"), q.alias("recall"), f.alias("f_measure"))


def macro_f(reference: DataFrame, hypothesis: DataFrame, bucket: float, beta: float = 1.0, collar: float = 0.0) -> DataFrame:
    """The unweighted mean over labels of each label's F, from its times over all files; half of the collar on both sides of a label's own borders in the reference is left out."""
    keys = ("uri", "label")
    if collar:
        edges = support(reference, keys).select(*keys, F.explode(F.array("start", "end")).alias("t"))
        no = support(edges.select(*keys, (F.col("t") - collar / 2).alias("start"), (F.col("t") + collar / 2).alias("end")), keys)
        reference, hypothesis = (_without(support(df, keys), no, keys, bucket) for df in (reference, hypothesis))
    rows = detection(reference, hypothesis, None, bucket, keys).groupBy("label").agg(*[F.sum(c).cast("double").alias(c) for c in ("hit", "false_alarm", "missed_detection")])
    b = beta * beta
    f = (1 + b) * F.col("hit") / ((1 + b) * F.col("hit") + b * F.col("missed_detection") + F.col("false_alarm"))
    return rows.agg(F.avg(f).alias("f_measure"))


def _without(segments: DataFrame, no: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """What the merged stretches ``no`` leave of merged segments."""
    hit = interval_join(segments.select(*keys, "start", "end"), no.select(*keys, "start", "end"), keys, bucket)
    cut = hit.groupBy(*keys, "start", "end").agg(F.array_sort(F.collect_list(F.struct("r_start", "r_end"))).alias("_no"))
    rows = segments.select(*keys, "start", "end").join(cut, [*keys, "start", "end"], "left").withColumn("_no", F.coalesce("_no", F.array()))
    begins = F.concat(F.array("start"), F.transform("_no", lambda x: x["r_end"]))
    ends = F.concat(F.transform("_no", lambda x: x["r_start"]), F.array("end"))
    free = rows.select(*keys, F.explode(F.arrays_zip(begins.alias("a"), ends.alias("b"))).alias("f")).select(*keys, F.col("f.a").alias("start"), F.col("f.b").alias("end"))
    return free.where("start < end")


# -- scores of trials

def _running(by: DataFrame, counts: Sequence[str], parts: int = 64) -> DataFrame:
    """Sums of ``counts`` over all lower thresholds (``_b`` and the column's name): by ranges between approximate quantiles, so that no task has all thresholds. A range follows from the threshold alone, so it is the same wherever it is computed."""
    cuts = sorted(set(by.select(F.col("threshold").cast("double").alias("t")).approxQuantile("t", [k / parts for k in range(1, parts)], 0.25 / parts)))
    part = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<double>"), lambda c: c < F.col("threshold")))
    ranged = by.withColumn("_part", part)
    whole = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in counts]).select("_part", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"_a{c}") for c in counts])
    w = W.partitionBy("_part").orderBy("threshold").rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.withColumns({f"_w{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts}).join(F.broadcast(before), "_part")  # at most ``parts`` rows
    return rows.withColumns({f"_b{c}": F.col(f"_a{c}") + F.col(f"_w{c}") for c in counts})


def _by_score(trials: DataFrame, score: Column, truth: str) -> DataFrame:
    return trials.groupBy(score.alias("threshold")).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(truth) == 1, 0).otherwise(1)).alias("neg"))


def det_curve(trials: DataFrame, score: str = "score", truth: str = "y", distances: bool = False) -> DataFrame:
    """One row for each distinct score: rates of false positives and false negatives if all above it are accepted."""
    by = _by_score(trials, -F.col(score) if distances else F.col(score), truth)
    n = by.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = _running(by, ("pos", "neg")).crossJoin(F.broadcast(n))  # one row
    fn, tn = F.col("_bpos") + F.col("pos"), F.col("_bneg") + F.col("neg")
    return rows.select("threshold", ((F.col("n") - tn) / F.col("n")).alias("fpr"), (fn / F.col("p")).alias("fnr"))


def equal_error_rate(trials: DataFrame, score: str = "score", truth: str = "y", distances: bool = False) -> DataFrame:
    """The mean of both rates where they differ least; ties: the lowest threshold."""
    curve = det_curve(trials, score, truth, distances)
    best = F.min_by(F.struct("threshold", "fpr", "fnr"), F.struct(F.round(F.abs(F.col("fpr") - F.col("fnr")), 12), "threshold"))
    return curve.agg(best.alias("b")).select(F.col("b.threshold").alias("threshold"), ((F.col("b.fpr") + F.col("b.fnr")) / 2).alias("eer"))


def auroc(trials: DataFrame, score: str = "score", truth: str = "y") -> DataFrame:
    """Area under the curve from the same sums: each positive counts the negatives below it and half of its equals."""
    rows = _running(_by_score(trials, F.col(score), truth), ("neg",))
    return rows.agg((F.sum(F.col("pos") * (F.col("_bneg") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auroc"))


def macro_auroc(scores: DataFrame, classes: Sequence, score: str = "score", truth: str = "y", key: str = "k") -> DataFrame:
    """Multi-label or multi-class (one against the rest): the mean over the classes of each class's area; classes without a positive or a negative are left out. ``classes`` is a short, given list."""
    one = None
    for c in classes:
        area = auroc(scores.where(F.col(key) == c), score, truth)
        one = area if one is None else one.unionByName(area)
    return one.agg(F.avg("auroc").alias("auroc"))


def decimated(frames: DataFrame, every: int = 10) -> DataFrame:
    """Every tenth frame, as the validation of models keeps them."""
    return frames.where(F.col("frame") % every == 0)


def count_confusion(counts: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return counts.groupBy(true, pred).agg(F.count(F.lit(1)).alias("files"))


def count_summary(counts: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    return counts.agg(F.avg(F.when(F.col(true) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"), F.avg(F.abs(F.col(true) - F.col(pred))).alias("mean_abs_error"))


def interpolated_weights(weights: DataFrame, source: int, target: int, keys: Sequence[str] = ("uri", "chunk")) -> DataFrame:
    """Weights (keys, frame, w) of ``source`` frames on ``target`` frames, linear between the middles of neighbours and constant outside."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(source - 1.0), (F.col("t") + 0.5) * source / target - 0.5))
    grid = weights.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(target - 1).cast("long"))))
    grid = grid.withColumn("_x", at).withColumn("_lo", F.floor("_x").cast("long")).withColumn("_hi", F.least(F.col("_lo") + 1, F.lit(source - 1).cast("long")))
    side = lambda name, w: weights.select(*keys, F.col("frame").alias(name), F.col("w").alias(w))
    rows = grid.join(side("_lo", "_a"), [*keys, "_lo"]).join(side("_hi", "_b"), [*keys, "_hi"])
    return rows.select(*keys, F.col("t").alias("frame"), (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.col("_lo"))).alias("w"))


def known_targets(rows: DataFrame, target: str = "y") -> DataFrame:
    """Rows whose target is known: -1 and null stand for none, and count in no loss and no metric."""
    return rows.where(F.col(target).isNotNull() & (F.col(target) != -1))


def weighted_loss(rows: DataFrame, kind: str, weight: str | None = None) -> DataFrame:
    """Binary cross entropy (mean over rows), squared error or negative log-likelihood (over the weights) of y against p."""
    y, p, w = F.col("y"), F.col("p"), F.col(weight) if weight else F.lit(1.0)
    if kind == "bce":
        return rows.agg((F.sum(w * -(y * F.log(p) + (1 - y) * F.log(1 - p))) / F.count(F.lit(1))).alias("loss"))
    one = (y - p) ** 2 if kind == "mse" else -p
    return rows.agg((F.sum(w * one) / F.sum(w)).alias("loss"))


def search_collar(reference: DataFrame, hypothesis: DataFrame, most: float, bucket: float, rounds: int = 4, points: int = 9, mapping: DataFrame | None = None) -> tuple[float, float]:
    """The collar between 0 and ``most`` with the least total error, and that error: a grid of ``points`` collars in one plan, then finer grids around the best for some rounds. 0 is tried first and kept on ties."""
    lo, hi, best = 0.0, float(most), (0.0, float("inf"))
    for _ in range(rounds):
        grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
        found = sorted((r.diarization_error_rate, r.collar) for r in best_collar(reference, hypothesis, grid, bucket, mapping).collect())  # a row for each point
        if found[0][0] < best[1]:
            best = (found[0][1], found[0][0])
        width = (hi - lo) / (points - 1)
        lo, hi = max(0.0, best[0] - width), min(float(most), best[0] + width)
    return best


def best_collar(reference: DataFrame, hypothesis: DataFrame, collars: Sequence[float], bucket: float, mapping: DataFrame | None = None) -> DataFrame:
    """Error of the hypothesis with gaps filled up to each collar; 0 is always tried and kept on ties. One plan: a collar and a file name one file."""
    hyps = None
    for c in sorted({0, *collars}):
        one = support(hypothesis, ("uri", "label"), c).withColumn("collar", F.lit(float(c)))
        hyps = one if hyps is None else hyps.unionByName(one)
    key = lambda: F.format_string("%s#%s", "uri", "collar").alias("uri")
    grid = hyps.select("collar").distinct()
    refs = support(reference).crossJoin(F.broadcast(grid))
    at = lambda df: df.select(key(), "label", "start", "end")
    parts = diarization_error(at(refs), at(hyps), None, bucket, mapping=mapping)
    return with_ratios(parts.withColumn("collar", F.element_at(F.split("uri", "#"), -1).cast("double")).groupBy("collar").agg(*[F.sum(c).alias(c) for c in PARTS]))
