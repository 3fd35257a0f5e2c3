"""Frame algebra on long relations.

``frames``: uri, frame, [k,] score. ``chunk_frames``: uri, chunk, frame, k, score. Missing scores are
nulls. All windows are partitioned by uri (and k), so consecutive operators share one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnweave.functions.scalars import hamming

EPSILON = 1e-12


def dense_grid(keys: DataFrame, n: int) -> DataFrame:
    return keys.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def chunk_starts(n: int, window: int, step: int) -> list[tuple[int, int]]:
    """(chunk, first frame) of the complete chunks, and of one padded chunk if frames are left over or the signal is short."""
    starts = list(range(0, max(n - window + 1, 0), step))
    if n < window or (n - window) % step:
        starts.append(starts[-1] + step if starts else 0)
    return list(enumerate(starts))


def slide(frames: DataFrame, window: int, step: int, n: int, extra: Sequence[str] = ()) -> DataFrame:
    """Each frame in every chunk that covers it: chunk, frame within the chunk. A frame's chunks are a range, so nothing is joined or shuffled."""
    last = len(chunk_starts(n, window, step)) - 1
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("frame") - window + 1) / step).cast("long"))
    hi = F.least(F.lit(last).cast("long"), F.floor(F.col("frame") / step).cast("long"))
    rows = frames.where(lo <= hi).withColumn("chunk", F.explode(F.sequence(lo, hi)))
    return rows.select("uri", *extra, "chunk", (F.col("frame") - F.col("chunk") * step).alias("frame"), "score")


def overlap_add(chunks: DataFrame, frames_per_chunk: int, chunk_step: float, frame_step: float, warm_up: tuple[float, float] = (0.0, 0.0), use_hamming: bool = False, epsilon: float = EPSILON, skip_average: bool = False, keys: Sequence[str] = ("uri", "k")) -> DataFrame:
    """Scores of chunks on the frames of the file: the weighted mean, or the sum, of all that cover a frame.

    A frame inside the warm-up weighs epsilon. Null scores weigh nothing; a frame with none but nulls
    is null. Chunks lie at chunk * chunk_step, frames at frame * frame_step."""
    n = frames_per_chunk
    weight: Column = hamming(F.col("frame"), n) if use_hamming else F.lit(1.0)
    left, right = round(warm_up[0] * n), round(warm_up[1] * n)
    if left or right:
        weight = weight * F.when((F.col("frame") >= left) & (F.col("frame") < n - right), 1.0).otherwise(epsilon)
    weight = F.when(F.col("score").isNotNull(), weight)
    at = (F.rint(F.col("chunk") * chunk_step / frame_step) + F.col("frame")).cast("long")
    sums = chunks.select(*keys, at.alias("frame"), weight.alias("_w"), (weight * F.col("score")).alias("_ws")).groupBy(*keys, "frame").agg(F.sum("_ws").alias("_ws"), F.sum("_w").alias("_w"))
    score = F.col("_ws") if skip_average else F.col("_ws") / F.greatest(F.col("_w"), F.lit(epsilon))
    return sums.select(*keys, "frame", score.alias("score"))


def fill_missing(scores: DataFrame, grid: DataFrame, missing: float | None, keys: Sequence[str] = ("uri", "k")) -> DataFrame:
    """Scores on a whole grid; frames without a score get ``missing``."""
    out = grid.join(scores, [*keys, "frame"], "left")
    return out if missing is None else out.withColumn("score", F.coalesce("score", F.lit(missing)))


def trim(chunks: DataFrame, frames_per_chunk: int, warm_up: tuple[float, float]) -> DataFrame:
    """Chunks without their warm-up frames, renumbered from 0."""
    left, right = round(frames_per_chunk * warm_up[0]), round(frames_per_chunk * warm_up[1])
    return chunks.where((F.col("frame") >= left) & (F.col("frame") < frames_per_chunk - right)).withColumn("frame", F.col("frame") - left)


def warm_up_weights(frames: DataFrame, n: int, warm_up: tuple[float, float]) -> DataFrame:
    """weight 0 on the warm-up frames; a right warm-up that rounds to none has no effect."""
    left, right = round(n * warm_up[0]), round(n * warm_up[1])
    return frames.withColumn("weight", F.when((F.col("frame") >= left) & (F.col("frame") < n - right), 1.0).otherwise(0.0))


def speaker_count(chunks: DataFrame, frames_per_chunk: int, chunk_step: float, frame_step: float, warm_up: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Speakers at each frame: the mean over chunks of the sums over speakers, rounded half to even."""
    sums = trim(chunks, frames_per_chunk, warm_up).groupBy("uri", "chunk", "frame").agg(F.sum("score").alias("score"))
    n = frames_per_chunk - round(frames_per_chunk * warm_up[0]) - round(frames_per_chunk * warm_up[1])
    out = overlap_add(sums, n, chunk_step, frame_step, keys=("uri",))
    shift = round(frames_per_chunk * warm_up[0])
    return out.select("uri", (F.col("frame") + shift).alias("frame"), F.rint("score").cast("int").alias("count"))


def hysteresis(frames: DataFrame, onset: float, offset: float | None = None, initial: bool | None = False, keys: Sequence[str] = ("uri",)) -> DataFrame:
    """active: on above the onset, off below the offset, else as before; at first as ``initial`` (None: whether the first score is in the upper half). Nulls count as 0."""
    offset = onset if offset is None else offset
    order = W.partitionBy(*keys).orderBy("frame")
    y = F.coalesce("score", F.lit(0.0))
    state = F.when(y > onset, True).when(y < offset, False)
    start = F.lit(initial) if initial is not None else F.first(y).over(order.rowsBetween(W.unboundedPreceding, 0)) >= (onset + offset) / 2
    return frames.withColumn("active", F.coalesce(F.last(state, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), start))


def binarize(frames: DataFrame, onset: float, offset: float | None, step: float, duration: float, start: float = 0.0, pad_onset: float = 0.0, pad_offset: float = 0.0, min_duration_on: float = 0.0, min_duration_off: float = 0.0, keys: Sequence[str] = ("uri",)) -> DataFrame:
    """Scores to segments between the middles of the first frame on and the first frame off; the last one ends at the last middle. A null score holds the state. Where frames are missing the signal ends and begins anew: what is on there ends at the middle of the last frame before."""
    from turnweave.operators.intervals import drop_short, support

    offset = onset if offset is None else offset
    order = W.partitionBy(*keys).orderBy("frame")
    # parts of the file between missing frames; one exchange by the keys serves all windows
    jump = F.when(F.col("frame") - F.lag("frame").over(order) > 1, 1).otherwise(0)
    rows = frames.withColumn("_jump", jump).withColumn("_part", F.sum("_jump").over(order.rowsBetween(W.unboundedPreceding, 0)))
    order = W.partitionBy(*keys, "_part").orderBy("frame")
    held = order.rowsBetween(W.unboundedPreceding, 0)
    state = F.when(F.col("score") > onset, 1).when(F.col("score") < offset, 0)
    rows = rows.select(*keys, "_part", "frame", F.coalesce(F.last(state, ignorenulls=True).over(held), F.lit(0)).alias("_on"))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_on") != F.coalesce(F.lag("_on").over(order), F.lit(-1)), 1).otherwise(0)).over(held))
    runs = rows.groupBy(*keys, "_part", "_run").agg(F.min("frame").alias("_a"), F.max("frame").alias("_b"), F.max("_on").alias("_on"))
    following = F.lead("_a").over(W.partitionBy(*keys, "_part").orderBy("_run"))
    middle = lambda c: start + c * step + duration / 2
    out = runs.withColumn("_next", F.coalesce(following, F.col("_b"))).where("_on = 1").select(*keys, (middle(F.col("_a")) - pad_onset).alias("start"), (middle(F.col("_next")) + pad_offset).alias("end"))
    if pad_onset > 0 or pad_offset > 0 or min_duration_off > 0:
        out = support(out, keys, min_duration_off)
    return drop_short(out, min_duration_on) if min_duration_on > 0 else out


def top_count(activations: DataFrame, counts: DataFrame) -> DataFrame:
    """The ``count`` highest activations of each frame are active, even at 0; ties: the lowest k first."""
    rank = F.row_number().over(W.partitionBy("uri", "frame").orderBy(F.desc("score"), "k"))
    return activations.join(counts, ["uri", "frame"]).withColumn("active", (rank <= F.col("count")).cast("int")).drop("count")


def dense_counts(counts: DataFrame) -> DataFrame:
    """Counts on every frame between the first and the last of a file; frames without a count have 0."""
    ends = counts.groupBy("uri").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    grid = ends.select("uri", F.explode(F.sequence("a", "b")).alias("frame"))
    return grid.join(counts, ["uri", "frame"], "left").select("uri", "frame", F.coalesce("count", F.lit(0)).alias("count"))


def padded_activations(activations: DataFrame, counts: DataFrame) -> DataFrame:
    """Activations of the classes 0 to the highest, or as many as the largest count, on every frame that has a count; 0 where there are none."""
    highest = activations.groupBy("uri").agg((F.max("k") + 1).alias("n"))
    most = counts.groupBy("uri").agg(F.max("count").alias("m")).join(highest, "uri", "left").select("uri", F.greatest(F.coalesce("n", F.lit(0)), F.col("m")).cast("long").alias("n")).where("n > 0")
    grid = counts.select("uri", "frame").join(most, "uri").select("uri", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"), "frame")
    return fill_missing(activations.select("uri", F.col("k").cast("long").alias("k"), "frame", "score"), grid, 0.0)


def within(frames: DataFrame, uem: DataFrame, step: float, duration: float) -> DataFrame:
    """The frames whose middle lies in a stretch of the uem (uri, start, end); stretches that overlap count once. A stretch's frames are a range, so the join is on uri and frame."""
    a = F.greatest(F.lit(0), F.ceil((F.col("start") - duration / 2) / step)).cast("long")
    b = (F.ceil((F.col("end") - duration / 2) / step) - 1).cast("long")
    told = uem.where(a <= b).select("uri", F.explode(F.sequence(a, b)).alias("frame")).distinct()
    return frames.join(told, ["uri", "frame"], "left_semi")


def exclusive(counts: DataFrame) -> DataFrame:
    return counts.withColumn("count", F.least("count", F.lit(1)))


def reconstruct(chunks: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per chunk, frame and cluster the highest score of its local speakers; unassigned ones go."""
    a = assignments.where("cluster is not null").select("uri", "chunk", F.col("speaker").alias("k"), "cluster")
    return chunks.join(a, ["uri", "chunk", "k"]).groupBy("uri", "chunk", "frame", F.col("cluster").alias("k")).agg(F.max("score").alias("score"))


def any_class(chunks: DataFrame, keys: Sequence[str] = ("uri", "chunk", "frame")) -> DataFrame:
    return chunks.groupBy(*keys).agg(F.max("score").alias("score"))


def peaks(frames: DataFrame, alpha: float, order: int) -> DataFrame:
    """Strict local maxima over ``order`` frames on both sides that are above alpha; frames nearer than that to an end are none."""
    w = W.partitionBy("uri").orderBy("frame")
    y = F.col("score")
    n = lambda a, b: F.count(F.lit(1)).over(w.rowsBetween(a, b))
    rows = frames.withColumns({"_l": F.max("score").over(w.rowsBetween(-order, -1)), "_r": F.max("score").over(w.rowsBetween(1, order)), "_nl": n(-order, -1), "_nr": n(1, order)})
    return rows.where((y > F.col("_l")) & (y > F.col("_r")) & (y > alpha) & (F.col("_nl") == order) & (F.col("_nr") == order)).drop("_l", "_r", "_nl", "_nr")


def peak_segments(frames: DataFrame, alpha: float, order: int, step: float, duration: float) -> DataFrame:
    """The file cut at its peaks: from the first start over the peaks' middles to the last end."""
    found = peaks(frames, alpha, order).select("uri", (F.col("frame") * step + duration / 2).alias("t"))
    ends = frames.groupBy("uri").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("uri", F.explode(F.array(F.col("a") * step, F.col("b") * step + duration)).alias("t"))
    cuts = found.unionByName(ends)
    following = F.lead("t").over(W.partitionBy("uri").orderBy("t"))
    return cuts.select("uri", F.col("t").alias("start"), following.alias("end")).where("end > start")


def dilate(frames: DataFrame, collar: int, keys: Sequence[str] = ("uri", "k")) -> DataFrame:
    """active where any frame from ``collar`` before to ``collar - 1`` after is."""
    w = W.partitionBy(*keys).orderBy("frame").rowsBetween(-collar, max(collar - 1, 0))
    return frames.withColumn("active", F.max("active").over(w))


def running_centre(frames: DataFrame, half: int, keys: Sequence[str] = ("uri",)) -> DataFrame:
    return frames.withColumn("centred", F.col("score") - F.avg("score").over(W.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half)))


def peak_normalise(frames: DataFrame, keys: Sequence[str] = ("uri",)) -> DataFrame:
    return frames.withColumn("normalised", F.col("score") / (F.max(F.abs("score")).over(W.partitionBy(*keys)) + 1e-8))


def stats_pool(x: DataFrame, keys: Sequence[str], value: str = "x", weight: str | None = "w") -> DataFrame:
    """Weighted mean and deviation in one pass of sums; without weights the sample deviation."""
    if weight is None:
        return x.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    w, v = F.col(weight).cast("double"), F.col(value).cast("double")
    s = x.groupBy(*keys).agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_w2"), F.sum(w * v).alias("_wx"), F.sum(w * v * v).alias("_wxx"))
    total = F.col("_w") + 1e-8
    mean = F.col("_wx") / total
    spread = F.greatest(F.col("_wxx") - 2 * mean * F.col("_wx") + mean * mean * F.col("_w"), F.lit(0.0))
    return s.select(*keys, mean.alias("mean"), F.sqrt(spread / (total - F.col("_w2") / total + 1e-8)).alias("std"))


def nearest_weights(weights: DataFrame, source: int, target: int, keys: Sequence[str]) -> DataFrame:
    """Weights on another number of frames, each from the nearest frame before."""
    return weights.withColumn("_t", F.explode(F.sequence(F.ceil(F.col("frame") * target / source).cast("long"), (F.ceil((F.col("frame") + 1) * target / source) - 1).cast("long")))).where("_t >= 0").select(*keys, F.col("_t").alias("frame"), "w") if target >= source else dense_pick(weights, source, target, keys)


def dense_pick(weights: DataFrame, source: int, target: int, keys: Sequence[str]) -> DataFrame:
    wanted = F.ceil(F.col("frame") * target / source).cast("long")
    return weights.withColumn("_t", wanted).where(F.floor(F.col("_t") * source / target) == F.col("frame")).where(F.col("_t") < target).select(*keys, F.col("_t").alias("frame"), "w")


def rasterise(segments: DataFrame, step: float, n: int, receptive: float = 0.0, origin: float = 0.0) -> DataFrame:
    """Frames on which each label is active: from the rounded first to the rounded last index, both included, half to even."""
    index = lambda c: F.rint((F.greatest(F.col(c), F.lit(origin)) - origin - receptive / 2) / step)
    a = F.greatest(F.lit(0), index("start")).cast("long")
    b = F.least(F.lit(n - 1), index("end")).cast("long")
    return segments.where((F.col("end") > origin) & (a <= b)).select("uri", "label", F.explode(F.sequence(a, b)).alias("frame")).distinct()


def inactive(chunks: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assignments of speakers without activity over their chunk become null."""
    active = chunks.groupBy("uri", "chunk", F.col("k").alias("speaker")).agg(F.sum("score").alias("_s"))
    return assignments.join(active, ["uri", "chunk", "speaker"], "left").withColumn("cluster", F.when(F.col("_s") > 0, F.col("cluster"))).drop("_s")


def clean_frames(chunks: DataFrame, min_frames: float) -> DataFrame:
    """Masks without overlapped frames; speakers with too few clean frames keep their whole mask."""
    rows = chunks.withColumn("_n", F.sum("score").over(W.partitionBy("uri", "chunk", "frame")))
    clean = F.when(F.col("_n") < 2, F.col("score")).otherwise(F.lit(0.0))
    rows = rows.withColumn("_c", clean)
    kept = F.sum("_c").over(W.partitionBy("uri", "chunk", "k"))
    return rows.withColumn("mask", F.when(kept > min_frames, F.col("_c")).otherwise(F.col("score"))).drop("_n", "_c")


def active_embeddings(chunks: DataFrame, embeddings: DataFrame, frames_per_chunk: int, min_ratio: float = 0.2) -> DataFrame:
    """Embeddings without missing values of speakers who are alone on enough frames of their chunk."""
    rows = chunks.withColumn("_n", F.sum("score").over(W.partitionBy("uri", "chunk", "frame")))
    alone = rows.groupBy("uri", "chunk", F.col("k").alias("speaker")).agg(F.sum(F.when(F.col("_n") == 1, F.col("score")).otherwise(0.0)).alias("_alone"))
    valid = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return embeddings.join(alone.where(F.col("_alone") >= min_ratio * frames_per_chunk), ["uri", "chunk", "speaker"]).where(valid).drop("_alone")


def most_talkative(chunks: DataFrame, n: int) -> DataFrame:
    """The n speakers of each chunk with the most activity; ties: the lowest first."""
    total = chunks.groupBy("uri", "chunk", "k").agg(F.sum("score").alias("_s"))
    rank = F.row_number().over(W.partitionBy("uri", "chunk").orderBy(F.desc("_s"), "k"))
    return chunks.join(total.withColumn("_r", rank).where(F.col("_r") <= n).select("uri", "chunk", "k"), ["uri", "chunk", "k"])
