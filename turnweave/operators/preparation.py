"""Targets and batches for training, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnweave.operators.intervals import interval_join


def chunk_targets(chunks: DataFrame, segments: DataFrame, step: float, n: int, bucket: float, receptive: float = 0.0) -> DataFrame:
    """(uri, chunk, start, end) to (uri, chunk, label, frame): the frames of each chunk on which a label is active, indices rounded half to even, both ends included."""
    pairs = interval_join(chunks, segments.select("uri", "label", "start", "end"), ["uri"], bucket)
    index = lambda t: F.rint((t - F.col("start") - receptive / 2) / step)
    a = F.greatest(F.lit(0), index(F.greatest("start", "r_start"))).cast("long")
    b = F.least(F.lit(n - 1), index(F.least("end", "r_end"))).cast("long")
    return pairs.where(a <= b).select("uri", "chunk", F.col("r_label").alias("label"), F.explode(F.sequence(a, b)).alias("frame")).distinct()


def oracle_segmentation(segments: DataFrame, chunks: DataFrame, step: float, n: int, bucket: float, num_speakers: int | None = None) -> DataFrame:
    """chunk_frames (uri, chunk, frame, k, score) that a perfect model would give: a frame is 1 where its label is active. More speakers than labels: the rest are silent. Fewer: the most talkative of each chunk, most first."""
    labels = segments.select("uri", "label").distinct().withColumn("k", (F.row_number().over(W.partitionBy("uri").orderBy("label")) - 1).cast("long"))
    on = chunk_targets(chunks, segments, step, n, bucket).join(labels, ["uri", "label"]).select("uri", "chunk", "frame", "k", F.lit(1.0).alias("score"))
    if num_speakers is not None:
        total = on.groupBy("uri", "chunk", "k").agg(F.sum("score").alias("_s"))
        rank = (F.row_number().over(W.partitionBy("uri", "chunk").orderBy(F.desc("_s"), "k")) - 1).cast("long")
        many = labels.groupBy("uri").agg((F.max("k") + 1 > num_speakers).alias("_many"))
        order = total.withColumn("_r", rank).join(many, "uri")
        on = on.join(order.select("uri", "chunk", "k", F.when(F.col("_many"), F.col("_r")).otherwise(F.col("k")).alias("_k")), ["uri", "chunk", "k"]).where(F.col("_k") < num_speakers).select("uri", "chunk", "frame", F.col("_k").alias("k"), "score")
        classes = chunks.select("uri", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(num_speakers - 1).cast("long"))).alias("k"))
    else:
        classes = chunks.select("uri", "chunk").join(labels.select("uri", "k"), "uri")
    grid = classes.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return grid.join(on, ["uri", "chunk", "frame", "k"], "left").select("uri", "chunk", "frame", "k", F.coalesce("score", F.lit(0.0)).alias("score"))


def collate(batches: DataFrame, value: str = "samples", keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """Arrays padded with zeros on the right to the longest of their batch."""
    longest = F.max(F.size(value)).over(W.partitionBy(*keys))
    return batches.withColumn(value, F.concat(F.col(value), F.array_repeat(F.lit(0.0), longest - F.size(value))))


def mix(pairs: DataFrame, a: str = "samples", b: str = "r_samples", a_labels: str = "labels", b_labels: str = "r_labels") -> DataFrame:
    """Sums of paired chunks with the labels of both."""
    return pairs.withColumn(a, F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))).withColumn(a_labels, F.concat(a_labels, b_labels)).drop(b, b_labels)


def centre(regions: DataFrame, duration: float) -> DataFrame:
    """The middle of each region, or all of a shorter one."""
    length = F.col("end") - F.col("start")
    a = F.col("start") + F.greatest(F.lit(0), (length - duration) / 2)
    return regions.withColumns({"start": a, "end": a + F.least(length, F.lit(duration))})


def drop_crowded(chunks: DataFrame, most: int) -> DataFrame:
    """Chunks with at most so many active classes."""
    n = chunks.where("score > 0").groupBy("uri", "chunk").agg(F.countDistinct("k").alias("_n"))
    return chunks.join(n.where(F.col("_n") > most).select("uri", "chunk"), ["uri", "chunk"], "left_anti")


def verification_trials(trials: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(uri1, uri2, y) with the cosine distance of their embeddings; one embedding a file, computed once."""
    from turnweave.functions.scalars import cosine_distance

    one, two = (embeddings.select(F.col("uri").alias(f"uri{i}"), F.col("embedding").alias(f"_e{i}")) for i in (1, 2))
    return trials.join(one, "uri1").join(two, "uri2").withColumn("distance", cosine_distance(F.col("_e1"), F.col("_e2"))).drop("_e1", "_e2")


def leakage_free(sources: DataFrame, activity: DataFrame, collar: int) -> DataFrame:
    """Source frames (uri, frame, k, score) silenced where their speaker isn't active within the collar, then scaled by each source's peak."""
    from turnweave.operators.frames import dilate, peak_normalise

    wide = dilate(activity, collar) if collar > 0 else activity
    kept = sources.join(wide.select("uri", "frame", "k", "active"), ["uri", "frame", "k"], "left").withColumn("score", F.col("score") * F.coalesce("active", F.lit(0)))
    return peak_normalise(kept.drop("active"), ("uri", "k"))


def batched(rows: DataFrame, size: int, order: list[str], fill: dict[str, Column] | None = None, keys: tuple[str, ...] = ("uri",)) -> DataFrame:
    """Rows of each group in batches of a size: ``batch`` and ``place``. With ``fill`` the last batch is made whole by rows with these values."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    out = rows.withColumn("_n", number).withColumns({"batch": F.floor(F.col("_n") / size).cast("long"), "place": (F.col("_n") % size).cast("int")}).drop("_n")
    if fill is None:
        return out
    last = out.groupBy(*keys).agg(F.max(F.struct("batch", "place")).alias("_l")).where(F.col("_l.place") < size - 1)
    extra = last.select(*keys, F.col("_l.batch").alias("batch"), F.explode(F.sequence(F.col("_l.place") + 1, F.lit(size - 1))).alias("place"))
    rest = {c: fill.get(c, F.lit(None)).cast(rows.schema[c].dataType) for c in rows.columns if c not in keys}
    return out.unionByName(extra.withColumns(rest))


def file_embeddings(frames: DataFrame, activity: DataFrame | None = None, power: float = 3.0) -> DataFrame:
    """One embedding a file from those of its frames (uri, frame, embedding): the mean, weighted by a power of the activity's score where one is given."""
    rows = frames.withColumn("w", F.lit(1.0)) if activity is None else frames.join(activity.select("uri", "frame", (F.col("score") ** power).alias("w")), ["uri", "frame"])
    sums = rows.select("uri", "w", F.posexplode("embedding").alias("pos", "v")).groupBy("uri", "pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    return sums.groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))


def write_prepared(tables: dict[str, DataFrame], path: str, protocol: str) -> None:
    """The tables of a star schema as Parquet, with the protocol's name; an existing folder is left alone."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(protocol, sorted(tables))], "protocol string, tables array<string>").write.mode("errorifexists").parquet(f"{path}/manifest")


def read_prepared(spark: SparkSession, path: str, protocol: str) -> dict[str, DataFrame]:
    row = spark.read.parquet(f"{path}/manifest").first()
    if row.protocol != protocol:
        raise ValueError(f"prepared for {row.protocol}, not for {protocol}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in row.tables}
