"""Readers and writers of annotation files and audio."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.scalars import uniform
from turnweave.runtime import ship_package


def _fields(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))
    return rows.where((F.size("f") > 1) | (F.col("f")[0] != ""))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    rows = _fields(spark, path).where(f[0] == "SPEAKER")
    return rows.select(f[1].alias("uri"), f[2].cast("int").alias("channel"), f[3].cast("double").alias("start"), (f[3].cast("double") + f[4].cast("double")).alias("end"), f[7].alias("label"))


def read_uem(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _fields(spark, path).select(f[0].alias("uri"), f[1].alias("channel"), f[2].cast("double").alias("start"), f[3].cast("double").alias("end"))


def read_lst(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(F.col("f")[0].alias("uri"))


def read_stm(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return _fields(spark, path).select(f[0].alias("session"), f[1].alias("channel"), f[2].alias("speaker"), f[3].cast("double").alias("start"), f[4].cast("double").alias("end"), F.array_join(F.slice(f, 6, F.greatest(F.size(f) - 5, F.lit(0))), " ").alias("text"))


def read_protocol(spark: SparkSession, config: dict, subset: str) -> dict[str, DataFrame]:
    """files, annotation and annotated of a subset whose entry names an lst, rttm and uem path; a template under ``audio`` gives each file's path."""
    entry = config[subset]
    out = {"files": read_lst(spark, entry["uri"]).withColumn("subset", F.lit(subset))}
    if "audio" in entry:
        out["files"] = with_paths(out["files"], entry["audio"])
    if "annotation" in entry:
        out["annotation"] = read_rttm(spark, entry["annotation"])
    if "annotated" in entry:
        out["annotated"] = read_uem(spark, entry["annotated"])
    return out


def read_subsets(spark: SparkSession, config: dict, subsets: list[str]) -> dict[str, DataFrame]:
    """The tables of several subsets, one after the other, each row with its subset."""
    out: dict[str, DataFrame] = {}
    for subset in subsets:
        for name, df in read_protocol(spark, config, subset).items():
            one = df.withColumn("subset", F.lit(subset))
            out[name] = one if name not in out else out[name].unionByName(one)
    return out


def read_turns_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """Turns from JSON arrays of start, end, speaker; one row each, in order."""
    turns = F.from_json(column, "array<struct<start:double,end:double,speaker:string>>")
    return rows.select("uri", F.posexplode(turns).alias("track", "t")).select("uri", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("track").cast("string").alias("track"), F.col("t.speaker").alias("label"))


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """16-bit PCM files: uri, sample_rate, channel, samples in [-1, 1)."""
    ship_package(spark)

    def decode(parts):
        import numpy as np

        for pdf in parts:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()) / 32768.0
                    rows += [(p.rsplit("/", 1)[-1].rsplit(".", 1)[0], w.getframerate(), c, x[:, c].tolist()) for c in range(w.getnchannels())]
            yield pd.DataFrame(rows, columns=["uri", "sample_rate", "channel", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "uri string, sample_rate int, channel int, samples array<double>")


def downmix(audio: DataFrame) -> DataFrame:
    """The mean of a file's channels."""
    rows = audio.select("uri", "sample_rate", F.posexplode("samples").alias("i", "v")).groupBy("uri", "sample_rate", "i").agg(F.avg("v").alias("v"))
    return rows.groupBy("uri", "sample_rate").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("samples"))


def select_channel(audio: DataFrame, channel: int | str, seed: int = 0) -> DataFrame:
    """One channel of each file by its number, ``random`` (by a hash of the uri) or the mean of all with ``downmix``."""
    if channel == "downmix":
        return downmix(audio)
    if channel == "random":
        number = audio.groupBy("uri").agg((F.max("channel") + 1).alias("_n"))
        rows = audio.join(number, "uri").where(F.col("channel") == F.floor(uniform(seed, F.col("uri")) * F.col("_n")))
        return rows.drop("_n", "channel")
    return audio.where(F.col("channel") == channel).drop("channel")


def sinc_kernel(rate: int, target: int, width: int = 6, rolloff: float = 0.99):
    """Taps (one row for each of the target's phases) of a band-limited interpolation under a Hann window, and how many samples they reach to the left."""
    import numpy as np

    band = min(rate, target) * rolloff
    reach = int(np.ceil(width * rate / band))
    t = (np.arange(-reach, reach + rate) / rate)[None, :] - (np.arange(target) / target)[:, None]
    x = np.clip(t * band, -width, width)
    return np.sinc(x) * np.cos(x * np.pi / width / 2) ** 2 * band / rate, reach


def resample(audio: DataFrame, target: int) -> DataFrame:
    """Samples at another rate: ceil(n * target / rate) of them. Files at the target rate stay as they are."""
    ship_package(audio.sparkSession)

    @F.pandas_udf("array<double>")
    def convert(samples: pd.Series, rates: pd.Series) -> pd.Series:
        import math

        import numpy as np

        out = []
        for x, rate in zip(samples, rates, strict=True):
            if x is None or rate == target:
                out.append(x)
                continue
            g = math.gcd(int(rate), target)
            a, b = int(rate) // g, target // g
            taps, reach = sinc_kernel(a, b)
            n = -(-len(x) * b // a)
            padded = np.concatenate([np.zeros(reach), np.asarray(x, float), np.zeros(reach + a + a)])
            frames = np.lib.stride_tricks.sliding_window_view(padded, taps.shape[1])[::a]
            out.append((frames @ taps.T).reshape(-1)[:n].tolist())
        return pd.Series(out)

    return audio.withColumn("samples", convert("samples", "sample_rate")).withColumn("sample_rate", F.lit(target))


def validate_files(files: DataFrame) -> DataFrame:
    """Files with a uri: the given one, else the path's stem, else ``waveform``. Each needs a path, or samples with their rate; a file with neither, or with more channels than samples, is an error."""
    has = lambda c: F.col(c) if c in files.columns else F.lit(None)
    stem = F.regexp_extract(has("path").cast("string"), r"([^/]+?)(\.[^./]*)?$", 1)
    uri = F.coalesce(has("uri").cast("string"), F.when(has("path").isNotNull(), stem), F.lit("waveform"))
    fault = F.when(has("path").isNull() & has("samples").isNull(), F.lit("neither path nor samples"))
    if "samples" in files.columns:
        fault = fault.when(F.col("samples").isNotNull() & has("sample_rate").isNull(), F.lit("samples without a rate"))
        if "channels" in files.columns:
            fault = fault.when(F.col("channels") > F.size("samples"), F.lit("more channels than samples"))
    return files.withColumn("uri", F.when(fault.isNull(), uri).otherwise(F.raise_error(F.concat(F.lit("bad file: "), fault)).cast("string")))


def prepare_files(files: DataFrame, lazy: dict[str, Column] | None = None, preload: bool = False) -> DataFrame:
    """Validated files with further columns, computed only where something reads them; ``preload`` keeps them in memory or on disk. The channel goes."""
    out = validate_files(files).withColumns(lazy or {}).drop("channel")
    return out.persist() if preload else out


def with_paths(files: DataFrame, template: str, column: str = "path") -> DataFrame:
    """The path of each file by a template with ``{uri}`` (and any other column in braces)."""
    path = F.lit(template)
    for c in files.columns:
        path = F.replace(path, F.lit("{" + c + "}"), F.col(c).cast("string"))
    return files.withColumn(column, path)


def sample_segments(spark: SparkSession) -> DataFrame:
    """A small annotated file: two speakers in 30 seconds who overlap twice."""
    turns = [(1.0, 4.5, "alice"), (4.2, 9.0, "bob"), (9.5, 14.0, "alice"), (14.0, 15.25, "bob"), (15.0, 22.0, "alice"), (23.5, 29.75, "bob")]
    return spark.createDataFrame([("sample", a, b, str(k), who) for k, (a, b, who) in enumerate(turns)], "uri string, start double, end double, track string, label string")


def check_protocol(tables: dict[str, dict[str, DataFrame]], classes: list[str] | None = None) -> dict[str, object]:
    """What a protocol (tables of files, annotation, annotated for each subset) offers: whether it has a validation subset, the scope of its labels, whether classes are given, what is missing. Without files to train on it is an error."""
    train = tables.get("train", {})
    if "files" not in train or not train["files"].limit(1).count():
        raise ValueError("no files to train on")
    missing = sorted(f"{s}.{name}" for s, t in tables.items() for name in ("files", "annotation", "annotated") if name not in t)
    scopes = sorted(r[0] for r in train["files"].select("scope").distinct().collect()) if "scope" in train["files"].columns else ["file"]
    return {"has_validation": bool(tables.get("development", {}).get("files") is not None and tables["development"]["files"].limit(1).count()), "scopes": scopes, "has_classes": classes is not None, "missing": missing}


def duration(samples: Column, rate: Column) -> Column:
    return F.size(samples) / rate


def crop_samples(samples: Column, rate: Column, start: float, end: float, pad: bool = False) -> Column:
    """Samples from start to end in seconds. Outside the signal: zeros with ``pad``, else an error; one sample is tolerated."""
    a, n = F.floor(F.lit(start) * rate).cast("int"), F.rint(F.lit(end - start) * rate).cast("int")
    size = F.size(samples)
    inside = F.slice(samples, F.greatest(a, F.lit(0)) + 1, F.greatest(F.least(a + n, size) - F.greatest(a, F.lit(0)), F.lit(0)))
    left = F.array_repeat(F.lit(0.0), F.least(F.greatest(-a, F.lit(0)), n))
    right = F.array_repeat(F.lit(0.0), F.greatest(F.least(a + n - size, n), F.lit(0)))
    whole = F.concat(left, inside, right)
    return whole if pad else F.when((a >= 0) & (a + n <= size + 1), whole).otherwise(F.raise_error(F.lit("requested chunk lies outside of the file")).cast("array<double>"))


def rttm_line() -> Column:
    return F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "uri", F.col("start").cast("double"), (F.col("end") - F.col("start")).cast("double"), "label")


def rttm_lines(segments: DataFrame) -> DataFrame:
    """One line for each turn; start and end in seconds."""
    return segments.select(rttm_line().alias("line"))


def write_rttm(segments: DataFrame, path: str, by_file: bool = False) -> None:
    """Lines as text, all together or in a folder for each uri; never overwrites."""
    if by_file:
        segments.select("uri", rttm_line().alias("value")).write.mode("errorifexists").partitionBy("uri").text(path)
    else:
        rttm_lines(segments).write.mode("errorifexists").text(path)


def json_documents(segments: DataFrame, digits: int = 3) -> DataFrame:
    """Per uri a JSON array of turns (start, end, speaker) in order, times rounded."""
    turn = F.struct(F.round("start", digits).alias("start"), F.round("end", digits).alias("end"), F.col("label").alias("speaker"))
    return segments.groupBy("uri").agg(F.to_json(F.sort_array(F.collect_list(turn))).alias("json"))


def write_json(segments: DataFrame, path: str) -> None:
    json_documents(segments).write.mode("errorifexists").json(path)


def report(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Rows of each file and a TOTAL row of their sums."""
    return parts.rollup("uri").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("uri", F.coalesce("uri", F.lit("TOTAL")))


def write_speed(speed: DataFrame, path: str) -> None:
    """The one row of ``pipelines.speed`` as JSON."""
    speed.write.mode("errorifexists").json(path)


def write_report(parts: DataFrame, sums: list[str], path: str) -> None:
    report(parts, sums).write.mode("errorifexists").csv(path, header=True)
