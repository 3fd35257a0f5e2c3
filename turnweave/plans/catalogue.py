"""Registered queries of the segment engine, and the SQL that each must equal."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import powerset
from turnweave.functions.scalars import log_softmax
from turnweave.operators import assignment, clustering, frames, intervals, metadata, metrics, preparation
from turnweave.plans import pipelines
from turnweave.sources import adapters as A
from turnweave.sources import formats

HOUR, DAY = A.HOUR, 24 * A.HOUR
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- relations in SQL

SEG = """seg AS (SELECT CAST(user_id AS VARCHAR) AS uri, epoch_us(ts) // 1000 - 1704067200000 AS s,
  epoch_us(ts) // 1000 - 1704067200000 + CAST(round(value * 100) AS BIGINT) * 6000 AS e, event_type AS label, event_id AS track FROM events)"""
HYP = """hyp AS (SELECT uri, s + (track % 5) * 60000 AS s, e + (track % 5) * 60000 AS e,
  CASE WHEN track % 7 = 0 THEN ['click','error','purchase','signup','view'][list_position(['click','error','purchase','signup','view'], label) % 5 + 1] ELSE label END AS label, track
  FROM seg WHERE track % 11 <> 0)"""
FRM = """frm AS (SELECT g.uri, g.frame, least(1.0, coalesce(CAST(floor(v * 50) AS BIGINT), 0) / 10000) AS score
  FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uri, unnest(range(720)) AS frame FROM events) g
  LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS uri, (epoch_us(ts) - 1704067200000000) // 3600000000 AS frame, sum(CAST(value AS DECIMAL(18,4))) AS v FROM events GROUP BY 1, 2) x
  ON g.uri = x.uri AND g.frame = x.frame)"""
LFR = """lfr AS (SELECT CAST(user_id AS VARCHAR) AS uri, (epoch_us(ts) - 1704067200000000) // 3600000000 AS frame, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS BIGINT) AS k,
  least(1.0, CAST(floor(sum(CAST(value AS DECIMAL(18,4))) * 50) AS BIGINT) / 10000) AS score FROM events GROUP BY 1, 2, 3)"""
DLG = """dlg AS (SELECT CAST(conv_id AS VARCHAR) AS uri, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, role AS label, turn AS track FROM
  (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS e FROM conversations))"""
EMB = """emb AS (SELECT CAST(vec_id // 50 AS VARCHAR) AS uri, (vec_id % 50) // 5 AS chunk, vec_id % 5 AS speaker, embedding, label, vec_id FROM embeddings)"""
CHK = """chk AS (SELECT uri, c AS chunk, frame - c * 6 AS frame, score FROM frm, range(117) r(c) WHERE frame >= c * 6 AND frame < c * 6 + 24)"""


def support_sql(name: str, source: str, keys: str = "uri, label", collar: int = 0) -> str:
    new = f"s - m >= {collar}" if collar else "s - m > 0"
    return f"""{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN m IS NULL OR {new} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i
  FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {source})) GROUP BY {keys}, i)"""


def q(last: str, *parts: str) -> str:
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + last


OUT = 's AS "start", e AS "end"'

# -- segments


@query(q("SELECT uri, label, CAST(sum(e - s) AS BIGINT) AS duration, count(*) AS turns FROM sup GROUP BY uri, label", SEG, support_sql("sup", "seg")))
def seg_speaking_time(spark: SparkSession, d: str) -> DataFrame:
    return intervals.speaking_time(intervals.support(A.segments(spark, d)))


@query(q(f"SELECT uri, label, {OUT} FROM sup", SEG, support_sql("sup", "seg")))
def seg_support(spark, d):
    return intervals.support(A.segments(spark, d))


@query(q(f"SELECT uri, label, {OUT} FROM sup", SEG, support_sql("sup", "seg", collar=HOUR)))
def seg_support_collar(spark, d):
    return intervals.support(A.segments(spark, d), collar=HOUR)


@query(q(f"SELECT uri, label, {OUT} FROM sup WHERE e - s >= {3 * HOUR}", SEG, support_sql("sup", "seg", collar=HOUR)))
def seg_drop_short(spark, d):
    return intervals.drop_short(intervals.support(A.segments(spark, d), collar=HOUR), 3 * HOUR)


@query(q("SELECT a.uri, a.track, b.track AS r_track, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM seg a JOIN seg b ON a.uri = b.uri AND a.s < b.e AND a.e > b.s AND a.track < b.track", SEG))
def seg_overlap_join(spark, d):
    s = A.segments(spark, d)
    pairs = intervals.interval_join(s, s, ["uri"], DAY).where("track < r_track")
    return intervals.clipped(pairs).select("uri", "track", "r_track", (F.col("end") - F.col("start")).alias("shared"))


@query(q("SELECT a.uri, a.track, b.track AS r_track FROM seg a JOIN seg b ON a.uri = b.uri AND a.s <= b.e AND a.e >= b.s AND a.track < b.track", SEG))
def seg_touch_join(spark, d):
    s = A.segments(spark, d)
    return intervals.interval_join(s, s, ["uri"], DAY, "touch").where("track < r_track").select("uri", "track", "r_track")


@query(q("SELECT a.uri, a.track, b.track AS r_track FROM seg a JOIN seg b ON a.uri = b.uri AND a.s <= b.s AND a.e >= b.e AND a.track <> b.track", SEG))
def seg_contain_join(spark, d):
    s = A.segments(spark, d)
    return intervals.interval_join(s, s, ["uri"], DAY, "contains").where("track <> r_track").select("uri", "track", "r_track")


@query(q("SELECT seg.uri, seg.track, greatest(seg.s, u.s) AS \"start\", least(seg.e, u.e) AS \"end\" FROM seg JOIN u ON seg.uri = u.uri AND seg.s < u.e AND seg.e > u.s WHERE seg.label = 'view'", SEG, "c AS (SELECT * FROM seg WHERE label = 'click')", support_sql("u", "c", "uri")))
def seg_crop(spark, d):
    s = A.segments(spark, d)
    return intervals.crop(intervals.subset(s, ["view"]), intervals.support(intervals.subset(s, ["click"]), ["uri"]), DAY).select("uri", "track", "start", "end")


@query(q('SELECT uri, label, track, greatest(s, 1000000000) AS "start", least(e, 2000000000) AS "end" FROM seg WHERE s < 2000000000 AND e > 1000000000', SEG))
def seg_crop_window(spark, d):
    return intervals.crop_window(A.segments(spark, d), 1_000_000_000, 2_000_000_000)


@query(q(f'SELECT uri, m AS "start", s AS "end" FROM (SELECT *, lag(e) OVER (PARTITION BY uri ORDER BY s) AS m FROM sup) WHERE s - m > {6 * HOUR}', SEG, support_sql("sup", "seg", "uri")))
def seg_gaps(spark, d):
    return intervals.gaps(A.segments(spark, d), min_duration=6 * HOUR)


@query(q(f"SELECT uri, 'active' AS label, {OUT} FROM sup", SEG, "x AS (SELECT * FROM seg WHERE label IN ('click', 'view'))", support_sql("sup", "x", "uri")))
def seg_label_union(spark, d):
    return intervals.label_union(A.segments(spark, d), ["click", "view"], "active")


BOTH = [SEG, "x AS (SELECT * FROM seg WHERE label = 'click')", "y AS (SELECT * FROM seg WHERE label = 'view')", support_sql("sx", "x", "uri"), support_sql("sy", "y", "uri")]


@query(q("SELECT sx.uri, 'both' AS label, greatest(sx.s, sy.s) AS \"start\", least(sx.e, sy.e) AS \"end\" FROM sx JOIN sy ON sx.uri = sy.uri AND sx.s < sy.e AND sx.e > sy.s", *BOTH))
def seg_label_intersection(spark, d):
    return intervals.label_intersection(A.segments(spark, d), ["click", "view"], "both", DAY)


@query(q("SELECT uri, label, count(*) AS turns FROM (SELECT uri, CASE label WHEN 'signup' THEN 'enter' WHEN 'purchase' THEN 'buy' ELSE label END AS label FROM seg) GROUP BY 1, 2", SEG))
def seg_rename(spark, d):
    return intervals.rename(A.segments(spark, d), {"signup": "enter", "purchase": "buy"}).groupBy("uri", "label").agg(F.count(F.lit(1)).alias("turns"))


@query(q("SELECT f.uri FROM (SELECT DISTINCT uri FROM dlg) f LEFT JOIN (SELECT uri, count(DISTINCT label) AS n FROM dlg GROUP BY 1) c USING (uri) WHERE n IS NULL OR n BETWEEN 1 AND 2", DLG))
def seg_filter_num_speakers(spark, d):
    s = A.dialogue(spark, d)
    return intervals.filter_number_of_speakers(s.select("uri").distinct(), s, most=2)


@query(q(f'SELECT g.uri, label, greatest(g.s, x.s) AS "start", least(g.e, x.e) AS "end" FROM sup g JOIN x ON g.uri = x.uri WHERE greatest(g.s, x.s) < least(g.e, x.e)', SEG, f"grid AS (SELECT uri, label, CAST(floor(s / {HOUR}.0 + 0.5) * {HOUR} AS BIGINT) AS s, CAST(floor(e / {HOUR}.0 + 0.5) * {HOUR} AS BIGINT) AS e FROM seg)", "g2 AS (SELECT * FROM grid WHERE s < e)", support_sql("sup", "g2"), "x AS (SELECT uri, min(s) AS s, max(e) AS e FROM seg GROUP BY uri)"))
def seg_snap_grid(spark, d):
    return intervals.snap(A.segments(spark, d), HOUR)


@query(q("SELECT a.uri, greatest(a.s, b.s) AS \"start\", least(a.e, b.e) AS \"end\" FROM a JOIN b USING (uri) WHERE greatest(a.s, b.s) < least(a.e, b.e)", SEG, "a AS (SELECT uri, min(s) AS s, max(e) AS e FROM seg WHERE label = 'click' GROUP BY uri)", "b AS (SELECT uri, min(s) AS s, max(e) AS e FROM seg WHERE label = 'error' GROUP BY uri)"))
def seg_extent(spark, d):
    s = A.segments(spark, d)
    return intervals.extent_intersection(intervals.subset(s, ["click"]), intervals.subset(s, ["error"]))


@query(q("SELECT uri, label, track, s AS \"start\", e AS \"end\" FROM seg WHERE label = 'purchase' AND EXISTS (SELECT 1 FROM u WHERE u.uri = seg.uri AND u.s <= seg.s AND u.e >= seg.e)", SEG, "c AS (SELECT * FROM seg WHERE label IN ('click', 'view', 'error'))", support_sql("u", "c", "uri")))
def seg_covered(spark, d):
    s = A.segments(spark, d)
    return intervals.covered(intervals.subset(s, ["purchase"]), intervals.subset(s, ["click", "view", "error"]), DAY)


@query(q("SELECT format('SPEAKER {} 1 {:.3f} {:.3f} <NA> <NA> {} <NA> <NA>', uri, s / 1000.0, (e - s) / 1000.0, label) AS line FROM sup", SEG, support_sql("sup", "seg")))
def seg_rttm(spark, d):
    s = intervals.support(A.segments(spark, d))
    return formats.rttm_lines(s.select("uri", "label", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end")))


@query(q("SELECT uri, round(s / 1000.0, 3) AS \"start\", round(e / 1000.0, 3) AS \"end\", CAST(row_number() OVER (PARTITION BY uri ORDER BY s, e, label) - 1 AS VARCHAR) AS track, label FROM sup", SEG, support_sql("sup", "seg")))
def seg_json(spark, d):
    s = intervals.support(A.segments(spark, d))
    docs = formats.json_documents(s.select("uri", "label", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end")))
    return formats.read_turns_json(docs)


@query(q("SELECT uri, label, count(*) AS turns, CAST(sum(e - s) AS BIGINT) AS duration FROM dlg GROUP BY 1, 2", DLG))
def dlg_turns(spark, d):
    return intervals.speaking_time(A.dialogue(spark, d))


@query(q("SELECT dlg.uri, n.name AS label, track FROM dlg JOIN (SELECT uri, label, format('SPEAKER_{:02d}', row_number() OVER (PARTITION BY uri ORDER BY label) - 1) AS name FROM (SELECT DISTINCT uri, label FROM dlg)) n USING (uri, label)", DLG))
def dlg_speaker_numbers(spark, d):
    return intervals.number_speakers(A.dialogue(spark, d)).select("uri", "label", "track")


# -- frames


@query(q(f"SELECT DISTINCT uri, label, unnest(range(greatest(0, CAST(round_even(s / {HOUR}.0, 0) AS BIGINT)), least(719, CAST(round_even(e / {HOUR}.0, 0) AS BIGINT)) + 1)) AS frame FROM seg", SEG))
def frm_rasterise(spark, d):
    return frames.rasterise(A.segments(spark, d), HOUR, 720)


def _chunks(spark, d):
    return frames.slide(A.frames(spark, d), 24, 6, 720)


@query(q("SELECT uri, chunk, count(*) AS frames, round(sum(score), 4) AS total FROM chk GROUP BY 1, 2", FRM, CHK))
def frm_chunks(spark, d):
    return _chunks(spark, d).groupBy("uri", "chunk").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("score"), 4).alias("total"))


@query(q("SELECT uri, chunk * 6 + frame AS frame, round(avg(score), 6) AS score FROM chk GROUP BY 1, 2", FRM, CHK))
def frm_overlap_add(spark, d):
    return frames.overlap_add(_chunks(spark, d), 24, 6.0, 1.0, keys=("uri",)).withColumn("score", F.round("score", 6))


WEIGHT = "((0.54 - 0.46 * cos(2 * pi() * frame / 23)) * CASE WHEN frame >= 2 AND frame < 22 THEN 1.0 ELSE 1e-12 END)"


@query(q(f"SELECT uri, chunk * 6 + frame AS frame, round(sum({WEIGHT} * score) / greatest(sum({WEIGHT}), 1e-12), 6) AS score FROM chk GROUP BY 1, 2", FRM, CHK))
def frm_overlap_add_hamming(spark, d):
    return frames.overlap_add(_chunks(spark, d), 24, 6.0, 1.0, (0.1, 0.1), True, keys=("uri",)).withColumn("score", F.round("score", 6))


@query(q("SELECT uri, chunk, frame - 2 AS frame, score FROM chk WHERE frame >= 2 AND frame < 22", FRM, CHK))
def frm_trim(spark, d):
    return frames.trim(_chunks(spark, d), 24, (0.1, 0.1))


LCHK = "lchk AS (SELECT uri, c AS chunk, frame - c * 6 AS frame, k, CAST(CASE WHEN score > 0.1 THEN 1 ELSE 0 END AS DOUBLE) AS score FROM lfr, range(117) r(c) WHERE frame >= c * 6 AND frame < c * 6 + 24)"


def _label_chunks(spark, d):
    rows = frames.slide(A.label_frames(spark, d), 24, 6, 720, ["k"])
    return rows.withColumn("score", F.when(F.col("score") > 0.1, 1.0).otherwise(0.0))


@query(q("SELECT uri, chunk * 6 + frame AS frame, CAST(round_even(avg(n), 0) AS INTEGER) AS count FROM (SELECT uri, chunk, frame, sum(score) AS n FROM lchk GROUP BY 1, 2, 3) GROUP BY 1, 2", LFR, LCHK))
def frm_speaker_count(spark, d):
    return frames.speaker_count(_label_chunks(spark, d), 24, 6.0, 1.0)


HYS = "hys AS (SELECT *, coalesce(last_value(CASE WHEN score > 0.2 THEN true WHEN score < 0.05 THEN false END IGNORE NULLS) OVER (PARTITION BY uri ORDER BY frame ROWS UNBOUNDED PRECEDING), false) AS active FROM frm)"


@query(q("SELECT * FROM hys", FRM, HYS))
def frm_hysteresis(spark, d):
    return frames.hysteresis(A.frames(spark, d), 0.2, 0.05)


RUNS = """runs AS (SELECT uri, r, min(frame) AS a, max(frame) AS b, bool_or(active) AS active FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> active THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY frame ROWS UNBOUNDED PRECEDING) AS r
  FROM (SELECT *, lag(active) OVER (PARTITION BY uri ORDER BY frame) AS p FROM hys)) GROUP BY uri, r),
bin AS (SELECT uri, a + 0.5 AS s, coalesce(n, b) + 0.5 AS e FROM (SELECT *, lead(a) OVER (PARTITION BY uri ORDER BY r) AS n FROM runs) WHERE active)"""


@query(q('SELECT uri, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end" FROM bin', FRM, HYS, RUNS))
def frm_binarize(spark, d):
    return frames.binarize(A.frames(spark, d), 0.2, 0.05, 1.0, 1.0)


@query(q('SELECT uri, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end" FROM sup WHERE e - s >= 2', FRM, HYS, RUNS, support_sql("sup", "bin", "uri", 4)))
def frm_binarize_filled(spark, d):
    return frames.binarize(A.frames(spark, d), 0.2, 0.05, 1.0, 1.0, min_duration_on=2.0, min_duration_off=4.0)


CNT = "cnt AS (SELECT uri, frame, CAST(sum(CASE WHEN score > 0.1 THEN 1 ELSE 0 END) AS INTEGER) AS count FROM lfr GROUP BY 1, 2)"


def _counts(spark, d):
    return A.label_frames(spark, d).groupBy("uri", "frame").agg(F.sum(F.when(F.col("score") > 0.1, 1).otherwise(0)).cast("int").alias("count"))


@query(q("SELECT uri, frame, k, score, CAST(row_number() OVER (PARTITION BY uri, frame ORDER BY score DESC, k) <= count AS INTEGER) AS active FROM lfr JOIN cnt USING (uri, frame)", LFR, CNT))
def frm_top_count(spark, d):
    return frames.top_count(A.label_frames(spark, d), _counts(spark, d)).select("uri", "frame", "k", "score", "active")


@query(q("SELECT uri, frame, k FROM (SELECT *, row_number() OVER (PARTITION BY uri, frame ORDER BY score DESC, k) <= least(count, 1) AS active FROM lfr JOIN cnt USING (uri, frame)) WHERE active", LFR, CNT))
def frm_exclusive(spark, d):
    return frames.top_count(A.label_frames(spark, d), frames.exclusive(_counts(spark, d))).where("active = 1").select("uri", "frame", "k")


PEAK = "(SELECT *, max(score) OVER (PARTITION BY uri ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, max(score) OVER (PARTITION BY uri ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM frm)"


@query(q(f"SELECT uri, frame, score FROM {PEAK} WHERE score > l AND score > r AND score > 0.1 AND frame BETWEEN 3 AND 716", FRM))
def frm_peaks(spark, d):
    return frames.peaks(A.frames(spark, d), 0.1, 3)


@query(q(f'SELECT uri, s AS "start", e AS "end" FROM (SELECT uri, t AS s, lead(t) OVER (PARTITION BY uri ORDER BY t) AS e FROM (SELECT uri, CAST(frame + 0.5 AS DOUBLE) AS t FROM {PEAK} WHERE score > l AND score > r AND score > 0.1 AND frame BETWEEN 3 AND 716 UNION ALL SELECT DISTINCT uri, unnest([0.0::DOUBLE, 720.0::DOUBLE]) FROM frm)) WHERE e > s', FRM))
def frm_peak_segments(spark, d):
    return frames.peak_segments(A.frames(spark, d), 0.1, 3, 1.0, 1.0)


@query(q("SELECT uri, frame, max(active) OVER (PARTITION BY uri ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS active FROM (SELECT uri, frame, CAST(score > 0.2 AS INTEGER) AS active FROM frm)", FRM))
def frm_dilate(spark, d):
    return frames.dilate(A.frames(spark, d).select("uri", "frame", (F.col("score") > 0.2).cast("int").alias("active")), 2, ("uri",))


@query(q("SELECT uri, frame, round(score - avg(score) OVER (PARTITION BY uri ORDER BY frame ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 9) AS centred FROM frm", FRM))
def frm_running_centre(spark, d):
    return frames.running_centre(A.frames(spark, d), 12).select("uri", "frame", F.round("centred", 9).alias("centred"))


@query(q("SELECT uri, frame, round(score / (max(abs(score)) OVER (PARTITION BY uri) + 1e-8), 6) AS normalised FROM frm", FRM))
def frm_peak_normalise(spark, d):
    return frames.peak_normalise(A.frames(spark, d)).select("uri", "frame", F.round("normalised", 6).alias("normalised"))


@query(q("SELECT uri, round(m, 6) AS mean, round(sqrt(greatest(0, wxx - 2 * m * wx + m * m * w) / (v - w2 / v + 1e-8)), 5) AS std FROM (SELECT *, w + 1e-8 AS v, wx / (w + 1e-8) AS m FROM (SELECT uri, sum(w) AS w, sum(w * w) AS w2, sum(w * score) AS wx, sum(w * score * score) AS wxx FROM (SELECT *, CASE WHEN frame % 24 >= 8 THEN 1.0::DOUBLE ELSE 0.25 END AS w FROM frm) GROUP BY uri))", FRM))
def frm_stats_pool(spark, d):
    x = A.frames(spark, d).withColumn("w", F.when(F.col("frame") % 24 >= 8, 1.0).otherwise(0.25))
    return frames.stats_pool(x, ["uri"], "score").select("uri", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@query(q("SELECT uri, chunk, frame, k % 2 AS k, max(score) AS score FROM lchk WHERE k < 4 GROUP BY 1, 2, 3, 4", LFR, LCHK))
def frm_reconstruct(spark, d):
    chunks = _label_chunks(spark, d)
    a = chunks.select("uri", "chunk", F.col("k").alias("speaker")).distinct().withColumn("cluster", F.when(F.col("speaker") < 4, F.col("speaker") % 2))
    return frames.reconstruct(chunks, a)


@query(q("SELECT uri, chunk, k FROM (SELECT *, row_number() OVER (PARTITION BY uri, chunk ORDER BY n DESC, k) AS r FROM (SELECT uri, chunk, k, sum(score) AS n FROM lchk GROUP BY 1, 2, 3)) WHERE r <= 2", LFR, LCHK))
def frm_most_talkative(spark, d):
    return frames.most_talkative(_label_chunks(spark, d), 2).select("uri", "chunk", "k").distinct()


# -- metrics

ATOMS = """cut AS (SELECT DISTINCT uri, t FROM (SELECT uri, unnest([s, e]) AS t FROM seg UNION ALL SELECT uri, unnest([s, e]) FROM hyp)),
cells AS (SELECT * FROM (SELECT uri, t AS s, lead(t) OVER (PARTITION BY uri ORDER BY t) AS e FROM cut) WHERE e IS NOT NULL),
rl AS (SELECT c.uri, c.s, c.e, list_sort(list(DISTINCT x.label)) AS l FROM cells c JOIN seg x ON x.uri = c.uri AND x.s <= c.s AND x.e >= c.e GROUP BY 1, 2, 3),
hl AS (SELECT c.uri, c.s, c.e, list_sort(list(DISTINCT x.label)) AS l FROM cells c JOIN hyp x ON x.uri = c.uri AND x.s <= c.s AND x.e >= c.e GROUP BY 1, 2, 3),
atom AS (SELECT c.*, coalesce(rl.l, []) AS r, coalesce(hl.l, []) AS h FROM cells c LEFT JOIN rl USING (uri, s, e) LEFT JOIN hl USING (uri, s, e)),
part AS (SELECT uri, sum((e - s) * greatest(0, len(h) - len(r))) AS fa, sum((e - s) * greatest(0, len(r) - len(h))) AS miss, sum((e - s) * (least(len(r), len(h)) - len(list_intersect(r, h)))) AS conf, sum((e - s) * len(r)) AS total FROM atom GROUP BY uri)"""
BIG = "CAST(fa AS BIGINT) AS false_alarm, CAST(miss AS BIGINT) AS missed_detection, CAST(conf AS BIGINT) AS confusion, CAST(total AS BIGINT) AS total"


@query(q(f"SELECT uri, {BIG}, round((fa + miss + conf) / (total + 1e-8), 6) AS diarization_error_rate FROM part", SEG, HYP, ATOMS))
def met_identification_error(spark, d):
    out = metrics.identification_error(A.segments(spark, d), A.hypothesis(spark, d), None, DAY)
    return out.select("uri", *metrics.PARTS, F.round("diarization_error_rate", 6).alias("diarization_error_rate"))


PERM = "perm(p) AS (VALUES " + ", ".join(f"([{', '.join(map(repr, p))}])" for p in permutations(A.LABELS)) + ")"
TOGETHER = """tog AS (SELECT a.uri, a.label AS x, b.label AS y, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS t FROM seg a JOIN hyp b ON a.uri = b.uri AND a.s < b.e AND a.e > b.s GROUP BY 1, 2, 3),
best AS (SELECT uri, max(t) AS t FROM (SELECT uri, p, sum(t) AS t FROM tog, perm WHERE y = p[list_position(['click','error','purchase','signup','view'], x)] GROUP BY 1, 2) GROUP BY 1)"""


@query(q("SELECT uri, CAST(t AS DOUBLE) AS together FROM best", SEG, HYP, PERM, TOGETHER))
def met_optimal_mapping(spark, d):
    m = assignment.optimal_mapping(A.segments(spark, d), A.hypothesis(spark, d), DAY)
    return m.groupBy("uri").agg(F.sum("together").alias("together"))


NAMES = "['click','error','purchase','signup','view']"
BESTP = f"bestp AS (SELECT uri, arg_max(p, t) AS p FROM (SELECT uri, p, sum(t) AS t FROM tog, perm WHERE y = p[list_position({NAMES}, x)] GROUP BY 1, 2) GROUP BY 1)"
DERP = f"""derp AS (SELECT uri, sum((e - s) * greatest(0, len(h) - len(r))) AS fa, sum((e - s) * greatest(0, len(r) - len(h))) AS miss,
  sum((e - s) * (least(len(r), len(h)) - len(list_intersect(h, list_transform(r, lambda x: coalesce(p[list_position({NAMES}, x)], '-')))))) AS conf, sum((e - s) * len(r)) AS total FROM atom LEFT JOIN bestp USING (uri) GROUP BY uri)"""


@query(q(f"SELECT uri, {BIG}, round((fa + miss + conf) / (total + 1e-8), 6) AS diarization_error_rate FROM derp", SEG, HYP, ATOMS, PERM, TOGETHER, BESTP, DERP))
def met_diarization_error(spark, d):
    out = metrics.diarization_error(A.segments(spark, d), A.hypothesis(spark, d), None, DAY)
    return out.select("uri", *metrics.PARTS, F.round("diarization_error_rate", 6).alias("diarization_error_rate"))


JER = f"""stog AS (SELECT a.uri, a.label AS x, b.label AS y, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS t FROM supr a JOIN suph b ON a.uri = b.uri AND a.s < b.e AND a.e > b.s GROUP BY 1, 2, 3),
sbest AS (SELECT uri, arg_max(p, t) AS p FROM (SELECT uri, p, sum(t) AS t FROM stog, perm WHERE y = p[list_position({NAMES}, x)] GROUP BY 1, 2) GROUP BY 1),
rt AS (SELECT uri, label AS x, sum(e - s) AS d FROM supr GROUP BY 1, 2), ht AS (SELECT uri, label AS y, sum(e - s) AS e FROM suph GROUP BY 1, 2)"""


@query(q(f"SELECT uri, round(avg(1 - coalesce(t, 0) / (d + coalesce(e, 0) - coalesce(t, 0))), 6) AS jaccard_error_rate FROM (SELECT uri, x, d, p[list_position({NAMES}, x)] AS y FROM rt LEFT JOIN sbest USING (uri)) LEFT JOIN stog USING (uri, x, y) LEFT JOIN ht USING (uri, y) GROUP BY uri", SEG, HYP, support_sql("supr", "seg"), support_sql("suph", "hyp"), PERM, JER))
def met_jaccard_error(spark, d):
    return metrics.jaccard_error(A.segments(spark, d), A.hypothesis(spark, d), DAY).select("uri", F.round("jaccard_error_rate", 6).alias("jaccard_error_rate"))


#: One pair a step: the largest of what is left.
GREEDY = ["tog AS (SELECT a.uri, a.label AS x, b.label AS y, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS t FROM seg a JOIN hyp b ON a.uri = b.uri AND a.s < b.e AND a.e > b.s GROUP BY 1, 2, 3)", "left0 AS (SELECT * FROM tog)"]
for _step in range(5):
    GREEDY += [
        f"pick{_step} AS (SELECT uri, x, y, t FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY t DESC, x, y) AS r FROM left{_step}) WHERE r = 1)",
        f"left{_step + 1} AS (SELECT l.* FROM left{_step} l JOIN pick{_step} p USING (uri) WHERE l.x <> p.x AND l.y <> p.y)",
    ]


@query(q(" UNION ALL ".join(f"SELECT uri, x AS label, y AS r_label, CAST(t AS DOUBLE) AS together FROM pick{k}" for k in range(5)), SEG, HYP, *GREEDY))
def met_greedy_mapping(spark, d):
    return assignment.greedy_mapping(A.segments(spark, d), A.hypothesis(spark, d), DAY)


@query(q("SELECT coalesce(uri, 'TOTAL') AS uri, CAST(sum(fa) AS BIGINT) AS false_alarm, CAST(sum(miss) AS BIGINT) AS missed_detection, CAST(sum(conf) AS BIGINT) AS confusion, CAST(sum(total) AS BIGINT) AS total FROM part GROUP BY ROLLUP (uri)", SEG, HYP, ATOMS))
def met_report(spark, d):
    return formats.report(metrics.identification_error(A.segments(spark, d), A.hypothesis(spark, d), None, DAY), list(metrics.PARTS))


DET = """sr AS (SELECT * FROM supr), sh AS (SELECT * FROM suph),
tr AS (SELECT uri, sum(e - s) AS total FROM sr GROUP BY 1), th AS (SELECT uri, sum(e - s) AS found FROM sh GROUP BY 1),
hit AS (SELECT sr.uri, sum(least(sr.e, sh.e) - greatest(sr.s, sh.s)) AS hit FROM sr JOIN sh ON sr.uri = sh.uri AND sr.s < sh.e AND sr.e > sh.s GROUP BY 1),
det AS (SELECT uri, coalesce(hit, 0) AS hit, coalesce(found, 0) AS found, coalesce(total, 0) AS total FROM tr FULL JOIN th USING (uri) LEFT JOIN hit USING (uri))"""


@query(q("SELECT uri, CAST(hit AS BIGINT) AS hit, CAST(found - hit AS BIGINT) AS false_alarm, CAST(total - hit AS BIGINT) AS missed_detection, CAST(total AS BIGINT) AS total, round(hit / found, 6) AS precision, round(hit / total, 6) AS recall, round(2 * hit / (found + total), 6) AS f_measure FROM det", SEG, HYP, support_sql("supr", "seg", "uri"), support_sql("suph", "hyp", "uri"), DET))
def met_detection(spark, d):
    out = metrics.detection(A.segments(spark, d), A.hypothesis(spark, d), None, DAY)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f_measure")})


MAC = """tr AS (SELECT label, sum(e - s) AS total FROM supr GROUP BY 1), th AS (SELECT label, sum(e - s) AS found FROM suph GROUP BY 1),
hit AS (SELECT supr.label, sum(least(supr.e, suph.e) - greatest(supr.s, suph.s)) AS hit FROM supr JOIN suph ON supr.uri = suph.uri AND supr.label = suph.label AND supr.s < suph.e AND supr.e > suph.s GROUP BY 1)"""


@query(q("SELECT round(avg(2 * hit / (found + total)), 6) AS f_measure FROM tr JOIN th USING (label) JOIN hit USING (label)", SEG, HYP, support_sql("supr", "seg"), support_sql("suph", "hyp"), MAC))
def met_macro_f(spark, d):
    return metrics.macro_f(A.segments(spark, d), A.hypothesis(spark, d), DAY).select(F.round("f_measure", 6).alias("f_measure"))


TRI = "tri AS (SELECT n_chars AS score, quality AS y FROM labels JOIN documents USING (doc_id))"


def _trials(spark, d):
    return A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("y"))


@query(q("SELECT threshold, round((fpr + fnr) / 2, 6) AS eer FROM (SELECT *, row_number() OVER (ORDER BY round(abs(fpr - fnr), 12), threshold) AS r FROM (SELECT threshold, (SELECT count(*) FROM tri WHERE y = 0 AND score > threshold) / (SELECT count(*) FROM tri WHERE y = 0) AS fpr, (SELECT count(*) FROM tri WHERE y = 1 AND score <= threshold) / (SELECT count(*) FROM tri WHERE y = 1) AS fnr FROM (SELECT DISTINCT score AS threshold FROM tri))) WHERE r = 1", TRI))
def met_eer(spark, d):
    return metrics.equal_error_rate(_trials(spark, d)).select("threshold", F.round("eer", 6).alias("eer"))


@query(q("SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM tri a, tri b WHERE a.y = 1 AND b.y = 0", TRI))
def met_auroc(spark, d):
    return metrics.auroc(_trials(spark, d)).select(F.round("auroc", 6).alias("auroc"))


NUM = 'num AS (SELECT uri, t AS "true", coalesce(p, 0) AS pred FROM (SELECT uri, count(DISTINCT label) AS t FROM seg WHERE e - s > 20000000 GROUP BY 1) LEFT JOIN (SELECT uri, count(DISTINCT label) AS p FROM hyp WHERE e - s > 40000000 GROUP BY 1) USING (uri))'


def _numbers(spark, d):
    count = lambda df, least, name: df.where(F.col("end") - F.col("start") > least).groupBy("uri").agg(F.countDistinct("label").alias(name))
    return count(A.segments(spark, d), 20_000_000, "true").join(count(A.hypothesis(spark, d), 40_000_000, "pred"), "uri", "left").na.fill(0, ["pred"])


@query(q('SELECT "true", pred, count(*) AS files FROM num GROUP BY 1, 2', SEG, HYP, NUM))
def met_count_confusion(spark, d):
    return metrics.count_confusion(_numbers(spark, d))


@query(q('SELECT round(avg(CASE WHEN "true" = pred THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy, round(avg(abs("true" - pred)), 6) AS mean_abs_error FROM num', SEG, HYP, NUM))
def met_count_summary(spark, d):
    s = metrics.count_summary(_numbers(spark, d))
    return s.select(F.round("accuracy", 6).alias("accuracy"), F.round("mean_abs_error", 6).alias("mean_abs_error"))


FERR = """fe AS (SELECT uri, th AS threshold, frame, sum(t) AS t, sum(h) AS h, sum(CASE WHEN h <> t THEN h ELSE 0 END) AS x FROM (SELECT uri, frame, th, CASE WHEN score > 0.3 THEN 1.0 ELSE 0.0 END AS t, CASE WHEN score > th THEN 1.0 ELSE 0.0 END AS h FROM lfr, (SELECT CAST(unnest(range(51)) AS DOUBLE) / 50 AS th)) GROUP BY 1, 2, 3),
fs AS (SELECT threshold, sum(greatest(0, h - t)) AS fa, sum(greatest(0, t - h)) AS miss, sum(x - greatest(0, h - t)) AS conf, sum(t) AS total FROM fe GROUP BY 1)"""


def _frame_rates(spark, d):
    f = A.label_frames(spark, d).withColumn("chunk", F.lit(0))
    target = f.withColumn("score", F.when(F.col("score") > 0.3, 1.0).otherwise(0.0))
    return metrics.with_ratios(metrics.total_errors(metrics.frame_errors(target, f, metrics.thresholds()), ["threshold"]))


@query(q("SELECT threshold, CAST(fa AS DOUBLE) AS false_alarm, CAST(miss AS DOUBLE) AS missed_detection, CAST(conf AS DOUBLE) AS confusion, CAST(total AS DOUBLE) AS total, round((fa + miss + conf) / (total + 1e-8), 6) AS diarization_error_rate FROM fs", LFR, FERR))
def met_frame_errors(spark, d):
    return _frame_rates(spark, d).select("threshold", *metrics.PARTS, F.round("diarization_error_rate", 6).alias("diarization_error_rate"))


@query(q("SELECT min(threshold) AS threshold, round(min(r), 6) AS diarization_error_rate FROM (SELECT threshold, (fa + miss + conf) / (total + 1e-8) AS r FROM fs) WHERE r = (SELECT min((fa + miss + conf) / (total + 1e-8)) FROM fs)", LFR, FERR))
def met_optimal_threshold(spark, d):
    return metrics.optimal(_frame_rates(spark, d)).select("threshold", F.round("diarization_error_rate", 6).alias("diarization_error_rate"))


# -- powersets, embeddings


@query(q("SELECT uri, frame, k, CAST(list_contains(m, k) AS INTEGER) AS score FROM (SELECT uri, frame, arg_max(ps, (score, -ps)) AS ps FROM (SELECT uri, frame, k AS ps, score FROM lfr) GROUP BY 1, 2) JOIN (VALUES (0, []::INTEGER[]), (1, [0]), (2, [1]), (3, [2]), (4, [0, 1]), (5, [0, 2]), (6, [1, 2])) t(ps, m) USING (ps), (SELECT unnest([0, 1, 2]) AS k)", LFR))
def pow_to_multilabel(spark, d):
    s = A.label_frames(spark, d).select("uri", "frame", F.col("k").cast("int").alias("ps_class"), "score")
    return powerset.to_multilabel(s, spark, 3, 2)


SETS = "(VALUES " + ", ".join(f"({list(m)}::INTEGER[], {k})" for k, m in enumerate(powerset.members(5, 2))) + ") p(m, ps_class)"


@query(q(f"SELECT uri, frame, ps_class FROM (SELECT uri, frame, coalesce(list_sort(list(CAST(k AS INTEGER)) FILTER (score > 0.1)), []) AS l FROM lfr GROUP BY 1, 2) JOIN {SETS} ON l[1:2] = m", LFR))
def pow_to_powerset(spark, d):
    s = A.label_frames(spark, d).select("uri", "frame", F.col("k").cast("int").alias("k"), F.when(F.col("score") > 0.1, 1).otherwise(0).alias("score"))
    return powerset.to_powerset(s, spark, 5, 2)


@query(q("SELECT uri, frame, k, round(sum(x), 6) AS score FROM (SELECT uri, frame, CAST(t.k AS INTEGER) AS k, CASE WHEN list_contains(m, t.k) THEN exp(score - 1) ELSE 0 END AS x FROM (SELECT uri, frame, k AS ps, score FROM lfr) JOIN (VALUES (0, []::INTEGER[]), (1, [0]), (2, [1]), (3, [2]), (4, [0, 1])) v(ps, m) USING (ps), (SELECT unnest([0, 1, 2]) AS k) t) GROUP BY 1, 2, 3", LFR))
def pow_soft_multilabel(spark, d):
    s = A.label_frames(spark, d).select("uri", "frame", F.col("k").cast("int").alias("ps_class"), (F.col("score") - 1).alias("score"))
    out = powerset.to_multilabel(s, spark, 3, 2, soft=True)
    return out.select("uri", "frame", F.col("k").cast("int").alias("k"), F.round("score", 6).alias("score"))


CEN = "cen AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query(q("SELECT label, i - 1 AS pos, round(c[i], 6) AS value FROM (SELECT label, c, unnest(range(1, len(c) + 1)) AS i FROM cen)", CEN))
def emb_centroids(spark, d):
    c = clustering.centroids(A.table(spark, d, "embeddings"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "v")).select("label", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


UCEN = "ucen AS (SELECT uri, label AS cluster, list(m ORDER BY i) AS c FROM (SELECT uri, label, i, avg(CAST(v AS DOUBLE)) AS m FROM (SELECT uri, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM emb) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
SOFT = "soft AS (SELECT e.uri, e.chunk, e.speaker, e.vec_id, c.cluster, 1 + list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c) AS score FROM emb e JOIN ucen c USING (uri))"


def _soft(spark, d):
    e = A.embeddings(spark, d)
    centres = clustering.centroids(e.withColumnRenamed("label", "cluster"))
    return clustering.soft_assignment(e, centres)


@query(q("SELECT vec_id, cluster, round(score, 6) AS score FROM soft", EMB, UCEN, SOFT))
def emb_soft_assignment(spark, d):
    return _soft(spark, d).select("vec_id", "cluster", F.round("score", 6).alias("score"))


@query(q("SELECT uri, chunk, speaker, cluster FROM (SELECT *, row_number() OVER (PARTITION BY uri, chunk, speaker ORDER BY score DESC, cluster) AS r FROM soft) WHERE r = 1", EMB, UCEN, SOFT))
def emb_nearest_centroid(spark, d):
    return clustering.hard_assignment(_soft(spark, d))


@query(q("SELECT uri1, uri2, CAST(a.label = b.label AS INTEGER) AS y, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS distance FROM (SELECT vec_id AS uri1, vec_id + 7 AS uri2 FROM embeddings) JOIN embeddings a ON a.vec_id = uri1 JOIN embeddings b ON b.vec_id = uri2"))
def emb_trials(spark, d):
    e = A.table(spark, d, "embeddings").withColumnRenamed("vec_id", "uri")
    labels = lambda name: e.select(F.col("uri").alias(name), F.col("label").alias(f"_{name}"))
    pairs = e.select(F.col("uri").alias("uri1"), (F.col("uri") + 7).alias("uri2"))
    trials = pairs.join(labels("uri1"), "uri1").join(labels("uri2"), "uri2").select("uri1", "uri2", (F.col("_uri1") == F.col("_uri2")).cast("int").alias("y"))
    return preparation.verification_trials(trials, e.select("uri", "embedding")).withColumn("distance", F.round("distance", 6))


@query(q("SELECT uri, i - 1 AS pos, round(sum(w * v) / sum(w), 6) AS value FROM (SELECT label AS uri, pow((vec_id % 9 + 1) / 10, 3) AS w, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2"))
def emb_weighted_file(spark, d):
    e = A.table(spark, d, "embeddings").select(F.col("label").alias("uri"), F.col("vec_id").alias("frame"), "embedding")
    out = preparation.file_embeddings(e, e.select("uri", "frame", ((F.col("frame") % 9 + 1) / 10).alias("score")))
    return out.select("uri", F.posexplode("embedding").alias("pos", "v")).select("uri", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


@query(q("SELECT uri, cluster, i - 1 AS pos, round(CASE WHEN c IS NULL THEN 0 ELSE c[i] END, 6) AS value FROM (SELECT uri, cluster, c FROM (SELECT uri, unnest(range(10)) AS cluster FROM (SELECT DISTINCT uri FROM emb)) LEFT JOIN ucen USING (uri, cluster)), (SELECT unnest(range(1, 65)) AS i)", EMB, UCEN))
def emb_reordered_centroids(spark, d):
    e = A.embeddings(spark, d)
    centres = clustering.centroids(e.withColumnRenamed("label", "cluster").withColumn("cluster", F.col("cluster").cast("long")))
    classes = e.select("uri").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    out = clustering.reordered_centroids(centres, classes)
    return out.select("uri", "cluster", F.posexplode("centroid").alias("pos", "v")).select("uri", "cluster", F.col("pos").cast("long").alias("pos"), F.round("v", 6).alias("value"))


FIVE = "five(p) AS (VALUES " + ", ".join(f"([{', '.join(map(str, x))}])" for x in permutations(range(5), 3)) + ")"


@query(q("SELECT soft5.uri, soft5.chunk, speaker, CASE WHEN list_position(p, speaker) > 0 THEN list_position(p, speaker) - 1 END AS cluster FROM (SELECT DISTINCT uri, chunk, speaker FROM soft3) soft5 JOIN (SELECT uri, chunk, arg_max(p, t) AS p FROM (SELECT uri, chunk, p, sum(score) AS t FROM soft3, five WHERE p[cluster + 1] = speaker GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (uri, chunk)", EMB, "soft3 AS (SELECT uri, chunk, speaker, k AS cluster, 1.0 + CAST(embedding[k + 1] AS DOUBLE) AS score FROM emb, (SELECT unnest([0, 1, 2]) AS k))", FIVE))
def asg_constrained(spark, d):
    e = A.embeddings(spark, d)
    soft = e.select("uri", "chunk", "speaker", F.posexplode(F.slice("embedding", 1, 3)).alias("cluster", "v"))
    return assignment.constrained_argmax(soft.select("uri", "chunk", "speaker", F.col("cluster").cast("long").alias("cluster"), (1.0 + F.col("v").cast("double")).alias("score")))


# -- metadata and sampling


@query(q(f'SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY s, e) - 1 AS region, s AS "start", e - s AS duration FROM sup WHERE e - s >= {6 * HOUR}', SEG, support_sql("sup", "seg", "uri")))
def meta_regions(spark, d):
    return intervals.regions(intervals.support(A.segments(spark, d), ["uri"]), 6 * HOUR)


@query(q('SELECT uri, s AS "start", e AS "end", CAST(dense_rank() OVER (PARTITION BY uri ORDER BY label) - 1 AS INTEGER) AS file_label_idx, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS global_label_idx FROM seg', SEG))
def meta_annotations(spark, d):
    return metadata.star_annotations(A.segments(spark, d))


@query(q("SELECT uri, class, EXISTS (SELECT 1 FROM dlg WHERE dlg.uri = f.uri AND label = class) AS annotated FROM (SELECT DISTINCT uri FROM dlg) f, (SELECT unnest(['user', 'system', 'tool']) AS class)", DLG))
def meta_class_matrix(spark, d):
    s = A.dialogue(spark, d)
    return metadata.class_matrix(s.select("uri").distinct(), s, ["user", "system", "tool"])


WIN = f"""reg AS (SELECT uri, min(s) AS s, max(e) AS e FROM seg GROUP BY uri),
win AS (SELECT uri, s + unnest(range(0, (e - s - {DAY}) // {DAY // 4} + 1)) * {DAY // 4} AS s FROM reg WHERE e - s >= {DAY}),
cn AS (SELECT n, count(*) AS w FROM (SELECT win.uri, win.s, count(DISTINCT label) AS n FROM win LEFT JOIN seg x ON x.uri = win.uri AND x.s <= win.s + {DAY} AND x.e >= win.s GROUP BY 1, 2) GROUP BY 1)"""


@query(q("SELECT CAST(greatest(2, min(n)) AS BIGINT) AS max_speakers FROM (SELECT n, sum(w) OVER (ORDER BY n) / (SELECT sum(w) FROM cn) AS c FROM cn) WHERE c > 0.97", SEG, WIN))
def meta_max_speakers(spark, d):
    s = A.segments(spark, d)
    return metadata.max_speakers(metadata.windowed_speakers(intervals.extent(s), s, DAY, DAY))


@query(q(f'SELECT uri, s + i * {HOUR} AS "start", {HOUR} AS duration, i AS chunk FROM (SELECT *, unnest(range((e - s) // {HOUR})) AS i FROM sup WHERE e - s >= {6 * HOUR})', SEG, support_sql("sup", "seg", "uri")))
def smp_validation_grid(spark, d):
    return metadata.validation_grid(intervals.regions(intervals.support(A.segments(spark, d), ["uri"]), 6 * HOUR), HOUR)


@query(q('SELECT uri, s AS "start", round(sum(e - s) OVER (PARTITION BY uri ORDER BY s ROWS UNBOUNDED PRECEDING) / sum(e - s) OVER (PARTITION BY uri), 6) AS cdf FROM sup', SEG, support_sql("sup", "seg", "uri")))
def smp_weighted_cdf(spark, d):
    r = intervals.support(A.segments(spark, d), ["uri"]).withColumn("duration", F.col("end") - F.col("start"))
    return metadata.weighted_cdf(r, ["uri"]).select("uri", "start", F.round("cdf_hi", 6).alias("cdf"))


@query(q('SELECT uri, s + greatest(0, (e - s - 7200000) / 2) AS "start", s + greatest(0, (e - s - 7200000) / 2) + least(e - s, 7200000) AS "end" FROM sup', SEG, support_sql("sup", "seg", "uri")))
def smp_centre(spark, d):
    return preparation.centre(intervals.support(A.segments(spark, d), ["uri"]), 7_200_000).select("uri", "start", "end")


@query(q(f"SELECT CAST(greatest(32, ceil(sum(e - s) / {HOUR}.0)) AS BIGINT) AS length FROM sup WHERE e - s >= {6 * HOUR}", SEG, support_sql("sup", "seg", "uri")))
def smp_training_length(spark, d):
    return metadata.training_length(intervals.regions(intervals.support(A.segments(spark, d), ["uri"]), 6 * HOUR), HOUR, 32)


@query(q("SELECT DISTINCT label, label IN ('user', 'tool') AS kept FROM dlg", DLG))
def meta_extra_classes(spark, d):
    return metadata.extra_classes(A.dialogue(spark, d), ["user", "tool", "nobody"])


@query(q(f"SELECT uri, label, count(*) AS turns, CAST(sum(e - s) AS BIGINT) AS duration FROM seg WHERE e - s > {HOUR} GROUP BY 1, 2", SEG))
def meta_class_turns(spark, d):
    return intervals.class_turns(A.segments(spark, d), HOUR)


@query(q("SELECT uri, file_id, coalesce(annotated, 0) AS annotated, coalesce(idx, -1) AS source_idx FROM (SELECT doc_id AS uri, row_number() OVER (ORDER BY doc_id) - 1 AS file_id, source FROM documents) LEFT JOIN (SELECT doc_id AS uri, sum(quality + 1) AS annotated FROM labels GROUP BY 1) USING (uri) LEFT JOIN (SELECT source, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) USING (source)"))
def meta_star_files(spark, d):
    files = A.table(spark, d, "documents").select(F.col("doc_id").alias("uri"), "source")
    regions = A.table(spark, d, "labels").select(F.col("doc_id").alias("uri"), (F.col("quality") + 1).alias("duration"))
    return metadata.star_files(files, regions, ["source"]).select("uri", "file_id", "annotated", "source_idx")


@query(q("SELECT uri, count(*) AS n FROM dlg GROUP BY uri HAVING count(*) > 1", DLG))
def meta_duplicates(spark, d):
    return intervals.duplicates(A.dialogue(spark, d))


@query(q("SELECT uri, track, CAST((r - 1) // 4 AS BIGINT) AS batch, CAST((r - 1) % 4 AS INTEGER) AS place FROM (SELECT uri, track, row_number() OVER (PARTITION BY uri ORDER BY track) AS r FROM dlg) UNION ALL SELECT uri, -1, b, unnest(range(p + 1, 4)) FROM (SELECT uri, (count(*) - 1) // 4 AS b, (count(*) - 1) % 4 AS p FROM dlg GROUP BY uri)", DLG))
def prep_batched(spark, d):
    rows = A.dialogue(spark, d).select("uri", "track")
    return preparation.batched(rows, 4, ["track"], {"track": F.lit(-1)})


@query(q("SELECT uri, track, CAST(n * (n + 1) / 2 AS DOUBLE) AS total, CAST(max(n) OVER (PARTITION BY uri) AS INTEGER) AS n FROM (SELECT uri, track, least(e - s, 5) AS n FROM dlg)", DLG))
def prep_collate(spark, d):
    samples = F.transform(F.sequence(F.lit(1), F.least(F.col("end") - F.col("start"), F.lit(5)).cast("int")), lambda i: i.cast("double"))
    rows = A.dialogue(spark, d).select("uri", "track", F.when(F.col("end") > F.col("start"), samples).otherwise(F.array().cast("array<double>")).alias("samples"))
    out = preparation.collate(rows, keys=("uri",))
    return out.select("uri", "track", F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("samples").alias("n"))


PCH = f"pch AS (SELECT uri, c AS chunk, c * {DAY} AS s, (c + 1) * {DAY} AS e FROM (SELECT DISTINCT uri FROM seg), range(30) r(c))"
PTG = f"ptg AS (SELECT DISTINCT uri, chunk, label, unnest(range(a, b + 1)) AS frame FROM (SELECT c.uri, c.chunk, x.label, greatest(0, CAST(round_even((greatest(c.s, x.s) - c.s) / {HOUR}.0, 0) AS BIGINT)) AS a, least(23, CAST(round_even((least(c.e, x.e) - c.s) / {HOUR}.0, 0) AS BIGINT)) AS b FROM pch c JOIN seg x ON c.uri = x.uri AND c.s < x.e AND c.e > x.s) WHERE a <= b)"


def _day_chunks(spark, d):
    uris = A.segments(spark, d).select("uri").distinct()
    rows = uris.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    return rows.select("uri", "chunk", (F.col("chunk") * DAY).alias("start"), ((F.col("chunk") + 1) * DAY).alias("end"))


@query(q("SELECT * FROM ptg", SEG, PCH, PTG))
def prep_targets(spark, d):
    return preparation.chunk_targets(_day_chunks(spark, d), A.segments(spark, d), HOUR, 24, DAY)


@query(q("SELECT g.uri, g.chunk, g.frame, g.k, CASE WHEN ptg.label IS NULL THEN 0.0::DOUBLE ELSE 1.0 END AS score FROM (SELECT uri, chunk, unnest(range(24)) AS frame, label, k FROM pch JOIN lab USING (uri)) g LEFT JOIN ptg USING (uri, chunk, frame, label)", SEG, PCH, PTG, "lab AS (SELECT uri, label, row_number() OVER (PARTITION BY uri ORDER BY label) - 1 AS k FROM (SELECT DISTINCT uri, label FROM seg))"))
def prep_oracle_segmentation(spark, d):
    return preparation.oracle_segmentation(A.segments(spark, d), _day_chunks(spark, d), HOUR, 24, DAY)


# -- more frames


@query(q("SELECT uri, frame, max(score) AS score FROM lfr GROUP BY 1, 2", LFR))
def frm_any_class(spark, d):
    return frames.any_class(A.label_frames(spark, d), ("uri", "frame"))


@query(q("SELECT uri, frame, k, round(score - ln(sum(exp(score)) OVER (PARTITION BY uri, frame)), 9) AS score FROM lfr", LFR))
def frm_log_softmax(spark, d):
    w = Window.partitionBy("uri", "frame")
    return A.label_frames(spark, d).select("uri", "frame", "k", F.round(log_softmax(F.col("score"), w), 9).alias("score"))


@query(q("SELECT uri, chunk, k AS speaker, CASE WHEN sum(score) > 0 THEN k % 2 END AS cluster FROM lchk GROUP BY 1, 2, 3, k", LFR, LCHK))
def frm_inactive(spark, d):
    chunks = _label_chunks(spark, d)
    a = chunks.select("uri", "chunk", F.col("k").alias("speaker")).distinct().withColumn("cluster", F.col("speaker") % 2)
    return frames.inactive(chunks, a)


@query(q("SELECT uri, chunk, frame, k, CASE WHEN sum(c) OVER (PARTITION BY uri, chunk, k) > 1 THEN c ELSE score END AS mask FROM (SELECT *, CASE WHEN sum(score) OVER (PARTITION BY uri, chunk, frame) < 2 THEN score ELSE 0.0 END AS c FROM lchk)", LFR, LCHK))
def frm_clean(spark, d):
    return frames.clean_frames(_label_chunks(spark, d), 1).select("uri", "chunk", "frame", "k", "mask")


@query(q("SELECT uri, chunk, speaker, i FROM (SELECT uri, chunk, k AS speaker, k AS i, sum(CASE WHEN n = 1 THEN score ELSE 0 END) AS alone FROM (SELECT *, sum(score) OVER (PARTITION BY uri, chunk, frame) AS n FROM lchk) GROUP BY 1, 2, 3, 4) WHERE alone >= 0.1 * 24 AND i <> 3", LFR, LCHK))
def frm_active_embeddings(spark, d):
    chunks = _label_chunks(spark, d)
    value = F.when(F.col("k") == 3, F.lit(float("nan"))).otherwise(F.col("k").cast("double"))
    e = chunks.select("uri", "chunk", F.col("k").alias("speaker"), F.array(value).alias("embedding")).distinct()
    return frames.active_embeddings(chunks, e, 24, 0.1).select("uri", "chunk", "speaker", F.col("embedding")[0].cast("long").alias("i"))


@query(q("SELECT uri, chunk, frame, k, score FROM lchk WHERE (uri, chunk) NOT IN (SELECT (uri, chunk) FROM lchk WHERE score > 0 GROUP BY uri, chunk HAVING count(DISTINCT k) > 3)", LFR, LCHK))
def prep_drop_crowded(spark, d):
    return preparation.drop_crowded(_label_chunks(spark, d), 3).select("uri", "chunk", "frame", "k", "score")


@query(q("SELECT uri, chunk, frame, score, CASE WHEN frame >= 2 AND frame < 22 THEN 1.0::DOUBLE ELSE 0.0 END AS weight FROM chk", FRM, CHK))
def frm_warm_up(spark, d):
    return frames.warm_up_weights(_chunks(spark, d), 24, (0.1, 0.1))


@query(q(f"SELECT frm.* FROM frm WHERE EXISTS (SELECT 1 FROM sup WHERE sup.uri = frm.uri AND frame * {HOUR} + {HOUR // 2} >= sup.s AND frame * {HOUR} + {HOUR // 2} < sup.e)", FRM, SEG, support_sql("sup", "seg", "uri")))
def frm_within(spark, d):
    return frames.within(A.frames(spark, d), intervals.support(A.segments(spark, d), ["uri"]), HOUR, HOUR)


@query(q("SELECT uri, frame, coalesce(count, 0) AS count FROM (SELECT uri, unnest(range(min(frame), max(frame) + 1)) AS frame FROM cnt GROUP BY uri) LEFT JOIN cnt USING (uri, frame)", LFR, CNT))
def frm_dense_counts(spark, d):
    return frames.dense_counts(_counts(spark, d))


@query(q("SELECT g.uri, g.k, g.frame, coalesce(score, 0.0) AS score FROM (SELECT uri, frame, unnest(range(n)) AS k FROM cnt JOIN (SELECT uri, greatest(max(k) + 1, max(count)) AS n FROM lfr JOIN cnt USING (uri, frame) GROUP BY uri) USING (uri)) g LEFT JOIN lfr USING (uri, frame, k)", LFR, CNT))
def frm_padded(spark, d):
    return frames.padded_activations(A.label_frames(spark, d), _counts(spark, d))


@query(q("SELECT uri, t AS frame, round(a.score + (b.score - a.score) * (x - lo), 9) AS w FROM (SELECT uri, t, greatest(0.0, least(719.0, (t + 0.5) * 720 / 100 - 0.5)) AS x, CAST(floor(greatest(0.0, least(719.0, (t + 0.5) * 720 / 100 - 0.5))) AS BIGINT) AS lo FROM (SELECT DISTINCT uri FROM frm), range(100) r(t)) g JOIN frm a USING (uri) JOIN frm b USING (uri) WHERE a.frame = lo AND b.frame = least(lo + 1, 719)", FRM))
def frm_interpolated_weights(spark, d):
    w = A.frames(spark, d).select("uri", "frame", F.col("score").alias("w"))
    return metrics.interpolated_weights(w, 720, 100, ("uri",)).withColumn("w", F.round("w", 9))


# -- more metrics


@query(q("SELECT threshold, round((SELECT count(*) FROM tri WHERE y = 0 AND score > threshold) / (SELECT count(*) FROM tri WHERE y = 0), 9) AS fpr, round((SELECT count(*) FROM tri WHERE y = 1 AND score <= threshold) / (SELECT count(*) FROM tri WHERE y = 1), 9) AS fnr FROM (SELECT DISTINCT score AS threshold FROM tri)", TRI))
def met_det_curve(spark, d):
    return metrics.det_curve(_trials(spark, d)).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("fnr", 9).alias("fnr"))


@query(q("SELECT round(avg(a), 6) AS auroc FROM (SELECT k, avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS a FROM ml p JOIN ml n USING (k) WHERE p.y = 1 AND n.y = 0 GROUP BY k)", "ml AS (SELECT n_chars AS score, quality AS y, 0 AS k FROM labels JOIN documents USING (doc_id) UNION ALL SELECT n_chars, toxic, 1 FROM labels JOIN documents USING (doc_id))"))
def met_macro_auroc(spark, d):
    rows = A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    both = rows.select(F.col("n_chars").alias("score"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("y")) for k, c in enumerate(("quality", "toxic"))])).alias("s"))
    return metrics.macro_auroc(both.select("score", "s.k", "s.y"), [0, 1]).select(F.round("auroc", 6).alias("auroc"))


LOSS = "los AS (SELECT quality AS y, least(0.99, greatest(0.01, n_chars / 20000)) AS p, 1.0 + toxic AS w FROM labels JOIN documents USING (doc_id) WHERE quality <> -1)"


@query(q("SELECT 'bce' AS kind, round(sum(w * -(y * ln(p) + (1 - y) * ln(1 - p))) / count(*), 6) AS loss FROM los UNION ALL SELECT 'mse', round(sum(w * (y - p) * (y - p)) / sum(w), 6) FROM los UNION ALL SELECT 'nll', round(sum(w * -p) / sum(w), 6) FROM los", LOSS))
def met_losses(spark, d):
    rows = A.table(spark, d, "labels").join(A.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = metrics.known_targets(rows.select(F.col("quality").alias("y"), F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / 20000)).alias("p"), (1.0 + F.col("toxic")).alias("w")))
    out = None
    for kind in ("bce", "mse", "nll"):
        one = metrics.weighted_loss(rows, kind, "w").select(F.lit(kind).alias("kind"), F.round("loss", 6).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query(q(f"SELECT uri, {BIG}, round((fa + miss + conf) / (total + 1e-8), 6) AS diarization_error_rate FROM swp", SEG, HYP, "u AS (SELECT uri, min(s) AS s, max(e) AS e FROM seg GROUP BY 1)", f"w AS (SELECT uri, k, s + k * {DAY} AS s, least(e, s + k * {DAY} + {2 * DAY}) AS e FROM (SELECT *, unnest(range(0, greatest(0, (e - s - {2 * DAY}) // {DAY}) + 1)) AS k FROM u))", "sw AS (SELECT w.uri || '#' || k AS uri, greatest(w.s, x.s) AS s, least(w.e, x.e) AS e, label FROM w JOIN seg x ON w.uri = x.uri AND w.s < x.e AND w.e > x.s)", "hw AS (SELECT w.uri || '#' || k AS uri, greatest(w.s, x.s) AS s, least(w.e, x.e) AS e, label FROM w JOIN hyp x ON w.uri = x.uri AND w.s < x.e AND w.e > x.s)", ATOMS.replace("FROM seg ", "FROM sw ").replace("FROM hyp)", "FROM hw UNION ALL SELECT uri || '#' || k, unnest([s, e]) FROM w)").replace("JOIN seg x", "JOIN sw x").replace("JOIN hyp x", "JOIN hw x").replace("part AS", "swp_unused AS"), PERM, TOGETHER.replace("FROM seg a JOIN hyp b", "FROM sw a JOIN hw b"), BESTP, DERP.replace("derp AS", "swp AS")))
def met_sliding_error(spark, d):
    s = A.segments(spark, d)
    out = metrics.sliding_error(s, A.hypothesis(spark, d), intervals.extent(s), 2 * DAY, DAY)
    return out.select("uri", *[F.col(c).cast("long").alias(c) for c in metrics.PARTS], F.round("diarization_error_rate", 6).alias("diarization_error_rate"))


# -- pipelines


@query(q(f'SELECT uri, CAST(s AS DOUBLE) AS "start", CAST(e AS DOUBLE) AS "end", \'SPEECH\' AS label FROM sup WHERE e - s >= 2', FRM, HYS, RUNS, support_sql("sup", "bin", "uri", 4)))
def pipe_activity(spark, d):
    return pipelines.activity_detection(A.frames(spark, d), pipelines.ActivityParams(0.2, 0.05, 2.0, 4.0), 1.0, 1.0)


@query(q("SELECT uri, CAST(s AS DOUBLE) AS \"start\", CAST(e AS DOUBLE) AS \"end\", label FROM (" + " UNION ALL ".join(f"SELECT uri, a + 0.5 AS s, coalesce(n, b) + 0.5 AS e, '{name}' AS label FROM (SELECT *, CASE WHEN lead(a) OVER (PARTITION BY uri ORDER BY a) = b + 1 THEN b + 1 END AS n FROM (SELECT uri, r, on_, min(frame) AS a, max(frame) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY uri ORDER BY frame) AS r FROM (SELECT uri, frame, score > 0.2 AS on_, CASE WHEN lag(frame) OVER w = frame - 1 AND lag(score > 0.2) OVER w = (score > 0.2) THEN 0 ELSE 1 END AS new FROM lfr WHERE k = {k} WINDOW w AS (PARTITION BY uri ORDER BY frame))) GROUP BY 1, 2, 3)) WHERE on_" for k, name in ((0, "click"), (4, "view"))) + ")", LFR))
def pipe_multilabel(spark, d):
    p = pipelines.ActivityParams(0.2, 0.2, 0.0, 0.0)
    scores = A.label_frames(spark, d).withColumn("score", F.when(F.col("score") == 0.2, 0.19).otherwise(F.col("score")))
    return pipelines.multilabel(scores, {"click": (0, p), "view": (4, p)}, 1.0, 1.0)


@query("SELECT round(3600 * sum(amount) / sum(total), 6) AS seconds_per_hour, round(sum(total) / sum(amount), 6) AS times_real_time, CAST(sum(amount) AS DOUBLE) AS total FROM (SELECT length(text) AS amount, 1000 AS total FROM conversations WHERE text IS NOT NULL)")
def pipe_speed(spark, d):
    rows = A.table(spark, d, "conversations").where("text is not null").select(F.length("text").cast("double").alias("processing"), F.lit(1000.0).alias("duration"))
    out = pipelines.speed(rows)
    return out.select(F.round("seconds_per_hour", 6).alias("seconds_per_hour"), F.round("times_real_time", 6).alias("times_real_time"), "total")


# -- what SQL can't express: tests hold these against brute force


@query()
def cls_agglomerative(spark, d):
    return clustering.cluster(A.embeddings(spark, d), clustering.Agglomerative(threshold=1.0, min_cluster_size=2))


@query()
def cls_kmeans(spark, d):
    return clustering.cluster(A.embeddings(spark, d), clustering.KMeans(), num=10)


@query()
def cls_vbx(spark, d):
    return clustering.cluster(A.embeddings(spark, d), clustering.Vbx(clustering.Plda.identity(64, 4.0)))


@query()
def cls_constrained(spark, d):
    e = A.embeddings(spark, d)
    trained = clustering.cluster(e, clustering.Agglomerative(threshold=1.0, min_cluster_size=2))
    return clustering.assign(e, trained, constrained=True)


@query()
def smp_chunks(spark, d):
    r = intervals.regions(intervals.support(A.segments(spark, d), ["uri"]), 6 * HOUR)
    return metadata.sample_chunks(r, 1000, HOUR, 1)


@query()
def pipe_diarization(spark, d):
    chunks, emb = pipelines.sample_scores(spark, d)
    return pipelines.diarize(chunks, emb, pipelines.DiarizationParams(frames_per_chunk=24, chunk_step=6.0, frame_step=1.0, clustering=clustering.Agglomerative(threshold=0.9, min_cluster_size=2))).diarization
