"""Pipelines from given scores and embeddings to segments. Models enter as score tables or through a
user's function; nothing neural is built here."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.operators import assignment, clustering, frames, intervals, metrics, preparation
from turnweave.plans.config import Journal
from turnweave.sources import adapters


@dataclass(frozen=True)
class ActivityParams:
    """Fixed defaults of the activity detector, in seconds."""

    onset: float = 0.767
    offset: float = 0.377
    min_duration_on: float = 0.136
    min_duration_off: float = 0.067


Hook = Callable[[str, DataFrame], None]


def _tell(hook: Hook | None, step: str, df: DataFrame) -> DataFrame:
    if hook:
        hook(step, df)
    return df


def activity_detection(scores: DataFrame, params: ActivityParams, step: float, duration: float, label: str = "SPEECH") -> DataFrame:
    """Scores of each file to segments of one label; several classes count by their highest score."""
    one = frames.any_class(scores, ("uri", "frame")) if "k" in scores.columns else scores
    out = frames.binarize(one, params.onset, params.offset, step, duration, min_duration_on=params.min_duration_on, min_duration_off=params.min_duration_off)
    return out.withColumn("label", F.lit(label))


def oracle_activity(annotation: DataFrame, label: str = "SPEECH") -> DataFrame:
    return intervals.support(annotation, ["uri"]).withColumn("label", F.lit(label))


def multilabel(scores: DataFrame, classes: dict[str, tuple[int, ActivityParams]], step: float, duration: float) -> DataFrame:
    """A detector for each class, with its own parameters; the union of their segments."""
    return intervals.update(*[activity_detection(scores.where(F.col("k") == k).drop("k"), p, step, duration, name) for name, (k, p) in classes.items()])


@dataclass(frozen=True)
class DiarizationParams:
    frames_per_chunk: int = 589
    chunk_step: float = 1.0
    frame_step: float = 0.016875
    frame_duration: float | None = None
    min_active_ratio: float = 0.2
    min_duration_off: float = 0.0
    clustering: object = field(default_factory=clustering.Agglomerative)
    constrained: bool = False
    num_speakers: int | None = None
    min_speakers: int | None = None
    max_speakers: int | None = None


@dataclass(frozen=True)
class Diarization:
    diarization: DataFrame
    exclusive: DataFrame
    centroids: DataFrame


def diarize(segmentation: DataFrame, embeddings: DataFrame, p: DiarizationParams, hook: Hook | None = None) -> Diarization:
    """Binary scores of chunks and embeddings of their speakers to diarization, exclusive diarization (one speaker at a time) and centroids.

    Activations of the clusters are computed once and serve both."""
    least, most = intervals.number_bounds(p.num_speakers, p.min_speakers, p.max_speakers)
    counts = _tell(hook, "speaker_counting", frames.speaker_count(segmentation, p.frames_per_chunk, p.chunk_step, p.frame_step))
    if most != float("inf"):
        counts = counts.withColumn("count", F.least("count", F.lit(most)))
    usable = _tell(hook, "embeddings", frames.active_embeddings(segmentation, embeddings, p.frames_per_chunk, p.min_active_ratio))
    trained = clustering.cluster(usable, p.clustering, num=p.num_speakers, least=p.min_speakers, most=p.max_speakers)
    hard = clustering.assign(embeddings, trained, p.constrained)
    hard = _tell(hook, "clustering", frames.inactive(segmentation, hard))
    clustered = frames.reconstruct(segmentation, hard)
    added = frames.overlap_add(clustered, p.frames_per_chunk, p.chunk_step, p.frame_step, skip_average=True)
    counts = frames.dense_counts(counts)
    activations = _tell(hook, "discrete_diarization", frames.padded_activations(added, counts))

    def segments(c: DataFrame) -> DataFrame:
        active = frames.top_count(activations, c).withColumn("score", F.col("active").cast("double"))
        found = frames.binarize(active, 0.5, 0.5, p.frame_step, p.frame_duration or p.frame_step, min_duration_off=p.min_duration_off, keys=("uri", "k"))
        return found.select("uri", F.format_string("SPEAKER_%02d", F.col("k")).alias("label"), "start", "end")

    centres = clustering.centroids(usable.join(trained, ["uri", "chunk", "speaker"]))
    return Diarization(segments(counts), segments(frames.exclusive(counts)), clustering.reordered_centroids(centres, activations))


@dataclass(frozen=True)
class Separation:
    diarization: Diarization
    sources: DataFrame


def separate(segmentation: DataFrame, sources: DataFrame, embeddings: DataFrame, p: DiarizationParams, source_frames: int, source_step: float, collar: int = 0, hook: Hook | None = None) -> Separation:
    """Diarization, and a source for each speaker from the separated signals of the chunks (uri, chunk, frame, k, score): signals of one cluster are added up under a Hamming window, silenced where the speaker isn't active within ``collar`` frames, and scaled by their peak. Speakers who are never active have no source."""
    done = diarize(segmentation, embeddings, p, hook)
    usable = frames.active_embeddings(segmentation, embeddings, p.frames_per_chunk, p.min_active_ratio)
    trained = clustering.cluster(usable, p.clustering, num=p.num_speakers, least=p.min_speakers, most=p.max_speakers)
    hard = frames.inactive(segmentation, clustering.assign(embeddings, trained, p.constrained))
    mine = sources.join(hard.where("cluster is not null").select("uri", "chunk", F.col("speaker").alias("k"), "cluster"), ["uri", "chunk", "k"]).drop("k").withColumnRenamed("cluster", "k")
    whole = _tell(hook, "separation", frames.overlap_add(mine, source_frames, p.chunk_step, source_step, use_hamming=True))
    spoken = done.diarization.withColumn("k", F.regexp_extract("label", r"([0-9]+)$", 1).cast("long"))
    width = p.frame_duration or p.frame_step
    a, b = F.ceil((F.col("start") - width / 2) / source_step).cast("long"), F.floor((F.col("end") - width / 2) / source_step).cast("long")
    active = spoken.where(a <= b).select("uri", "k", F.explode(F.sequence(a, b)).alias("frame")).distinct().withColumn("_on", F.lit(1))
    grid = whole.join(active.select("uri", "k").distinct(), ["uri", "k"], "left_semi")
    on = grid.select("uri", "k", "frame").join(active, ["uri", "k", "frame"], "left").select("uri", "k", "frame", F.coalesce("_on", F.lit(0)).alias("active"))
    return Separation(done, preparation.leakage_free(grid, on, collar))


def evaluate(reference: DataFrame, scores: DataFrame, uem: DataFrame | None, step: float, duration: float, n: int, onset: float = 0.5) -> DataFrame:
    """Scores of classes (uri, frame, k, score) made binary and compared, frame by frame within the uem, with the reference in its best order of classes: the parts and ratios of each file, and a TOTAL row."""
    labels = reference.select("uri", "label").distinct().withColumn("k", (F.row_number().over(Window.partitionBy("uri").orderBy("label")) - 1).cast("long"))
    target = frames.rasterise(reference, step, n, duration).join(labels, ["uri", "label"]).select("uri", F.lit(0).cast("long").alias("chunk"), "frame", "k", F.lit(1.0).alias("score"))
    pred = scores.select("uri", F.lit(0).cast("long").alias("chunk"), "frame", F.col("k").cast("long").alias("k"), F.when(F.col("score") > onset, 1.0).otherwise(0.0).alias("score"))
    grid = lambda df: frames.fill_missing(df.drop("chunk"), pred.select("uri", "frame").distinct().join(df.select("uri", "k").distinct(), "uri"), 0.0).withColumn("chunk", F.lit(0).cast("long"))
    target, pred = grid(target), grid(pred)
    if uem is not None:
        target, pred = (frames.within(df, uem, step, duration) for df in (target, pred))
    mapping = assignment.permute_frames(target, pred)
    parts = metrics.total_errors(metrics.frame_errors(target, pred, [0.5], mapping=mapping), ["uri"])
    from turnweave.sources.formats import report

    return metrics.with_ratios(report(parts, list(metrics.PARTS)))


def run_batch(files: DataFrame, pipeline: Callable[..., DataFrame], *args, **params) -> DataFrame:
    """A pipeline over a batch of files, each named once."""
    repeated = intervals.duplicates(files).limit(1).collect()
    if repeated:
        raise ValueError(f"uri {repeated[0].uri} stands for several files")
    return pipeline(*args, **params)


def benchmark(reference: DataFrame, hypothesis: DataFrame, uem: DataFrame | None, bucket: float) -> dict[str, DataFrame]:
    """Errors of each file with their total, and the confusion of numbers of speakers."""
    from turnweave.sources.formats import report

    parts = metrics.diarization_error(reference, hypothesis, uem, bucket)
    count = lambda df, name: df.groupBy("uri").agg(F.countDistinct("label").alias(name))
    numbers = count(reference, "true").join(count(hypothesis, "pred"), "uri", "left").na.fill(0, ["pred"])
    return {"errors": metrics.with_ratios(report(parts, list(metrics.PARTS))), "speaker_counts": metrics.count_confusion(numbers), "speaker_summary": metrics.count_summary(numbers)}


def speed(rows: DataFrame, processing: str = "processing", playing: str = "duration") -> DataFrame:
    """Seconds for an hour, and how many times real time."""
    a, b = F.sum(processing), F.sum(playing)
    return rows.agg((3600 * a / b).alias("seconds_per_hour"), (b / a).alias("times_real_time"), a.alias("total"))


def optimise(grid: Sequence[dict], run: Callable[..., DataFrame], loss: Callable[[DataFrame], float], limit: int | None = None, journal: Journal | None = None) -> tuple[dict, float]:
    """The parameters of a grid with the least loss; ties: the first. Inputs that trials share should be persisted by the caller. A journal keeps every trial and the best."""
    best: tuple[dict, float] | None = None
    for params in list(grid)[:limit]:
        value = loss(run(**params))
        if journal:
            journal.add(params, value)
        if best is None or value < best[1]:
            best = (params, value)
    if best is None:
        raise ValueError("no parameters")
    return best


def sample_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Binary chunk scores and embeddings over the same chunks from the sample tables: ten chunks of each uri, five speakers."""
    emb = adapters.embeddings(spark, sf_dir)
    who = emb.select("uri", "chunk", F.col("speaker").alias("k"), "vec_id")
    grid = who.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    on = F.pmod(F.xxhash64("vec_id", F.expr("frame div 6")), F.lit(5)) < 1
    return grid.select("uri", "chunk", "frame", "k", F.when(on, 1.0).otherwise(0.0).alias("score")), emb
