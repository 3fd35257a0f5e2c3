"""The sample tables as the engine's relations. Times are integer milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
EPOCH_MS = 1_704_067_200_000
HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as turns: uri, start, end, label, track."""
    # whole milliseconds of 1970, as ``div`` cuts towards zero: from EPOCH it would round up what lies before it
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 1000") - EPOCH_MS
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("uri"), start.alias("start"), F.round(F.col("value") * 100).cast("long").alias("_d"), F.col("event_type").alias("label"), F.col("event_id").alias("track"))
    return rows.select("uri", "start", (F.col("start") + F.col("_d") * 6000).alias("end"), "label", "track")


LABELS = ("click", "error", "purchase", "signup", "view")


def hypothesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same turns, some dropped, some with the next label, all moved a little."""
    rows = segments(spark, sf_dir).where("track % 11 <> 0")
    at = F.array_position(F.array(*map(F.lit, LABELS)), F.col("label"))
    other = F.element_at(F.array(*map(F.lit, LABELS)), (at % len(LABELS) + 1).cast("int"))
    label = F.when(F.col("track") % 7 == 0, other).otherwise(F.col("label"))
    shift = (F.col("track") % 5) * 60_000
    return rows.select("uri", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"), label.alias("label"), "track")


def frames(spark: SparkSession, sf_dir: str, n: int = 720) -> DataFrame:
    """Hourly scores of each uri, on a full grid: uri, frame, score."""
    events = table(spark, sf_dir, "events")
    hour = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts) div 3600000000")
    sums = events.groupBy(F.col("user_id").cast("string").alias("uri"), hour.alias("frame")).agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("v"))
    grid = events.select(F.col("user_id").cast("string").alias("uri")).distinct().select("uri", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("frame"))
    return grid.join(sums, ["uri", "frame"], "left").select("uri", "frame", F.least(F.lit(1.0), F.coalesce(F.floor(F.col("v") * 50).cast("long"), F.lit(0)) / 10000).alias("score"))


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as turns in characters: uri, start, end, label, track."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))
    end = F.sum("n").over(w)
    return rows.select(F.col("conv_id").cast("string").alias("uri"), (end - F.col("n")).alias("start"), end.alias("end"), F.col("role").alias("label"), F.col("turn").alias("track"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.expr("vec_id div 50").cast("string").alias("uri"), F.expr("(vec_id % 50) div 5").alias("chunk"), (F.col("vec_id") % 5).alias("speaker"), "embedding", "label", "vec_id")


def label_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly scores of each label where there are any: uri, frame, k (place of the label), score."""
    hour = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{EPOCH}', ts) div 3600000000")
    k = F.array_position(F.array(*map(F.lit, LABELS)), F.col("event_type")) - 1
    sums = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("uri"), hour.alias("frame"), k.alias("k")).agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("v"))
    return sums.select("uri", "frame", "k", F.least(F.lit(1.0), F.floor(F.col("v") * 50).cast("long") / 10000).alias("score"))
