"""Metadata of a corpus as a star schema, and sampling that doesn't depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from turnweave.functions.scalars import uniform
from turnweave.operators.intervals import interval_join
from turnweave.runtime import materialise


def dictionary(df: DataFrame, column: str, scope: Sequence[str] = ()) -> DataFrame:
    """Numbers for the distinct values of a column, in their order, within a scope; without one, by ranges with the sizes of those before (``numbered``)."""
    values = df.select(*scope, column).where(F.col(column).isNotNull()).distinct()
    if not scope:
        return numbered(values, column).withColumn("idx", F.col("idx").cast("int"))
    return values.withColumn("idx", (F.row_number().over(W.partitionBy(*scope).orderBy(column)) - 1).cast("int"))


def numbered(values: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct values with their place in the order of all. Ranges of values are sorted each for itself and written; their sizes, one row a range, give the number that each begins with."""
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = values.repartitionByRange(column).sortWithinPartitions(column).select("*", F.spark_partition_id().alias("_part"), local.alias("_at"))
    parts = materialise(parts, "numbered")
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def star_files(files: DataFrame, regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files with their number, annotated time and the numbers of their metadata; -1 where missing."""
    ids = files.select("uri").distinct().transform(numbered, "uri", "file_id")
    time = regions.groupBy("uri").agg(F.sum("duration").alias("annotated"))
    out = files.join(ids, "uri").join(time, "uri", "left").withColumn("annotated", F.coalesce("annotated", F.lit(0)))
    for k in keys:
        d = dictionary(files, k).withColumnRenamed("idx", f"{k}_idx")
        out = out.join(d, k, "left").withColumn(f"{k}_idx", F.coalesce(f"{k}_idx", F.lit(-1))).drop(k)
    return out


def star_annotations(segments: DataFrame, file_scope: bool = True) -> DataFrame:
    """Segments with the number of their label within the file and within all."""
    in_file = dictionary(segments, "label", ["uri"]).withColumnRenamed("idx", "file_label_idx")
    overall = dictionary(segments, "label").withColumnRenamed("idx", "global_label_idx")
    return segments.join(in_file, ["uri", "label"]).join(overall, "label").select("uri", "start", "end", "file_label_idx", "global_label_idx")


def class_matrix(files: DataFrame, annotated: DataFrame, classes: Sequence[str]) -> DataFrame:
    """For each file and class whether it was annotated at all; extra classes are ignored."""
    grid = files.select("uri", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    known = annotated.select("uri", F.col("label").alias("class")).distinct().withColumn("_k", F.lit(True))
    return grid.join(known, ["uri", "class"], "left").select("uri", "class", F.col("_k").isNotNull().alias("annotated"))


def windowed_speakers(regions: DataFrame, segments: DataFrame, duration: float, bucket: float) -> DataFrame:
    """Distinct labels in windows of a duration, a quarter of it apart, within each region; touching counts."""
    step = duration / 4
    kind = segments.schema["start"].dataType
    n = F.floor((F.col("end") - F.col("start") - duration) / step).cast("long")
    windows = regions.where(F.col("end") - F.col("start") >= duration).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    windows = windows.select("uri", (F.col("start") + F.col("_i") * step).cast(kind).alias("start"), (F.col("start") + F.col("_i") * step + duration).cast(kind).alias("end"))
    pairs = interval_join(windows, segments.select("uri", "label", "start", "end"), ["uri"], bucket, "touch")
    counts = pairs.groupBy("uri", "start", "end").agg(F.countDistinct("r_label").alias("n"))
    return windows.join(counts, ["uri", "start", "end"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def max_speakers(counts: DataFrame, share: float = 0.97) -> DataFrame:
    """The least number of speakers that covers more than the share of the windows; at least 2."""
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("windows"))
    run = F.sum("windows").over(W.partitionBy(F.lit(0)).orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("windows").over(W.partitionBy(F.lit(0)))
    return by.withColumn("_s", run / total).where(F.col("_s") > share).agg(F.greatest(F.min("n"), F.lit(2)).cast("long").alias("max_speakers"))


def validation_grid(regions: DataFrame, duration: float) -> DataFrame:
    """Consecutive chunks that fit a region: uri, start, duration, chunk."""
    n = F.floor(F.col("duration") / duration).cast("long")
    return regions.where(n > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).select("uri", (F.col("start") + F.col("chunk") * duration).alias("start"), F.lit(duration).alias("duration"), "chunk")


def weighted_cdf(regions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Regions with the bounds of their share of the time of their group."""
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    run = F.sum("duration").over(w.orderBy("uri", "start").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("duration").over(w)
    return regions.withColumns({"cdf_hi": run / total, "cdf_lo": (run - F.col("duration")) / total})


def sample_chunks(regions: DataFrame, n: int, duration: float, seed: int) -> DataFrame:
    """n chunks: a file by its time, a region of it by its time, a place within at random. The numbers depend on the seed and the sample alone.

    A first level picks among files' totals (one row a file), the second within a file."""
    spark = regions.sparkSession
    usable = regions.where(F.col("duration") >= duration)
    files = weighted_cdf(usable.groupBy("uri").agg(F.sum("duration").alias("duration")).withColumn("start", F.lit(0)))
    bins = 1024
    cells = files.withColumn("_b", F.explode(F.sequence(F.floor(F.col("cdf_lo") * bins).cast("long"), F.floor(F.col("cdf_hi") * bins).cast("long"))))
    ids = spark.range(n).select(F.col("id").alias("sample")).withColumns({"u1": uniform(seed, F.col("sample"), F.lit(1)), "u2": uniform(seed, F.col("sample"), F.lit(2)), "u3": uniform(seed, F.col("sample"), F.lit(3))})
    picked = ids.withColumn("_b", F.floor(F.col("u1") * bins).cast("long")).join(cells.select("_b", "uri", "cdf_lo", "cdf_hi"), "_b").where((F.col("u1") >= F.col("cdf_lo")) & (F.col("u1") < F.col("cdf_hi"))).select("sample", "uri", "u2", "u3")
    inner = weighted_cdf(usable, ["uri"])
    rows = picked.join(inner, "uri").where((F.col("u2") >= F.col("cdf_lo")) & (F.col("u2") < F.col("cdf_hi")))
    return rows.select("sample", "uri", (F.col("start") + F.col("u3") * (F.col("duration") - duration)).alias("start"), F.lit(duration).alias("duration"))


def balanced_samples(regions: DataFrame, keys: Sequence[str], n: int, duration: float, seed: int) -> DataFrame:
    """Samples spread evenly over the combinations of metadata keys, within each a region by its time and a place at random: one plan for all combinations. Nulls make a combination of their own."""
    usable = regions.where(F.col("duration") >= duration).withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    combos = numbered(usable.select("_key").distinct(), "_key", "_i")
    share = F.floor(F.lit(n) / F.col("_m")) + (F.col("_i") < F.lit(n) % F.col("_m")).cast("long")
    combos = combos.crossJoin(F.broadcast(combos.agg(F.count(F.lit(1)).alias("_m"))))  # one row
    ids = combos.withColumn("_s", share).where("_s > 0").withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s") - 1)))
    ids = ids.select("_key", "sample", uniform(seed, F.col("_key"), F.col("sample"), F.lit(1)).alias("u1"), uniform(seed, F.col("_key"), F.col("sample"), F.lit(2)).alias("u2"))
    rows = ids.join(weighted_cdf(usable, ["_key"]), "_key").where((F.col("u1") >= F.col("cdf_lo")) & (F.col("u1") < F.col("cdf_hi")))
    return rows.select("sample", *keys, "uri", (F.col("start") + F.col("u2") * (F.col("duration") - duration)).alias("start"), F.lit(duration).alias("duration"))


def training_length(regions: DataFrame, duration: float, batch: int, most: float | None = None) -> DataFrame:
    """Samples in a pass over the training set: all annotated time over a chunk's (the mean of ``duration`` and ``most`` where chunks vary), at least a batch."""
    mean = duration if most is None else (duration + most) / 2
    return regions.agg(F.greatest(F.lit(batch).cast("long"), F.ceil(F.sum("duration") / mean).cast("long")).alias("length"))


def extra_classes(annotated: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Labels of the annotation that are no class, and whether each class is met at all: label, kept."""
    met = annotated.select("label").distinct()
    told = annotated.sparkSession.createDataFrame([(c,) for c in classes], "label string")
    return met.join(told.withColumn("kept", F.lit(True)), "label", "left").select("label", F.col("kept").isNotNull().alias("kept"))


def class_balanced(turns: DataFrame, per_class: int, duration: float, seed: int, least: float | None = None, batch: int = 32) -> DataFrame:
    """The same number of chunks for each label, turns weighted by their time. With ``least``, each batch of samples has a duration of its own between it and ``duration``. A turn shorter than its chunk stands at a random place in it: ``pad`` is the silence before it."""
    inner = weighted_cdf(turns.select("label", "uri", "start", (F.col("end") - F.col("start")).alias("duration")), ["label"])
    ids = turns.select("label").distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))))
    ids = ids.withColumns({"u1": uniform(seed, F.col("label"), F.col("sample")), "u2": uniform(seed + 1, F.col("label"), F.col("sample"))})
    rows = ids.join(inner, "label").where((F.col("u1") >= F.col("cdf_lo")) & (F.col("u1") < F.col("cdf_hi")))
    length = F.lit(float(duration)) if least is None else F.lit(float(least)) + uniform(seed + 2, F.floor(F.col("sample") / batch)) * (duration - least)
    rows = rows.withColumn("_len", length)
    room = F.col("duration") - F.col("_len")
    return rows.select("label", "sample", "uri", (F.col("start") + F.col("u2") * F.greatest(room, F.lit(0))).alias("start"), F.least(F.col("_len"), F.col("duration")).alias("duration"), (F.col("u2") * F.greatest(-room, F.lit(0))).alias("pad"))


def mixture_partners(windows: DataFrame, segments: DataFrame, most: int, bucket: float, seed: int) -> DataFrame:
    """For each window that has any, one other window of the file that shares no speaker and keeps the total within ``most``, drawn by a hash of the window among all such; windows without speakers take part.

    Windows are counted by their set of speakers; pairs are made of a file's distinct sets, and each window draws a number among those of the sets that fit its own."""
    label = segments.schema["label"].dataType
    met = interval_join(windows.select("uri", "window", "start", "end"), segments.select("uri", "label", "start", "end"), ["uri"], bucket).groupBy("uri", "window").agg(F.array_sort(F.collect_set("r_label")).alias("speakers"))
    rows = windows.select("uri", "window").join(met, ["uri", "window"], "left").withColumn("speakers", F.coalesce("speakers", F.array().cast(ArrayType(label))))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("uri", "speakers").orderBy("window")) - 1)
    sets = rows.groupBy("uri", "speakers").agg(F.count(F.lit(1)).alias("k"))
    pairs = sets.select("uri", "speakers").join(sets.select("uri", F.col("speakers").alias("theirs"), "k"), "uri").where(~F.arrays_overlap("speakers", "theirs") & (F.size("speakers") + F.size("theirs") <= most))
    # a set without speakers fits itself, but a window doesn't
    pairs = pairs.withColumn("k", F.col("k") - (F.col("speakers") == F.col("theirs")).cast("long")).where("k > 0")
    run = W.partitionBy("uri", "speakers").orderBy("theirs").rowsBetween(W.unboundedPreceding, 0)
    fits = pairs.withColumn("lo", F.sum("k").over(run) - F.col("k")).groupBy("uri", "speakers").agg(F.sum("k").alias("n"), F.collect_list(F.struct("lo", "k", "theirs")).alias("fits"))
    drawn = rows.join(fits, ["uri", "speakers"]).withColumn("r", F.floor(uniform(seed, F.col("window")) * F.col("n")))
    drawn = drawn.withColumn("pick", F.filter("fits", lambda x: (x["lo"] <= F.col("r")) & (F.col("r") < x["lo"] + x["k"]))[0])
    at = F.col("r") - F.col("pick.lo")
    at = at + ((F.col("pick.theirs") == F.col("speakers")) & (at >= F.col("rank"))).cast("long")
    drawn = drawn.select("uri", "window", F.col("pick.theirs").alias("speakers"), at.alias("rank"))
    return drawn.join(rows.select("uri", F.col("window").alias("partner"), "speakers", "rank"), ["uri", "speakers", "rank"]).select("uri", "window", "partner")
