"""URL filters: host-suffix and path-prefix expressions, joined on short hash prefixes.

Each URL is expanded into every host suffix (at label borders) times every path prefix whose length
some rule has; the 32-bit prefix of an expression's digest meets the rules in an equi-join, the full
digest then confirms the hit, and the longest rule wins (ties: the longer host, then block).

The rules are broadcast only while their number stays under ``broadcast_rules``; beyond it the join
is shuffled, with the pages' side salted so that a host that a third of the pages share is split.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and
gets the default verdict. Repeated rows give repeated results; a null id is carried through. Other
columns of the input, whatever their names, are ignored. Without rules every URL gets the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.common import table

#: Fixed by the contract of the query: verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
SALTS = 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    """Of host, a zero byte, path: no two different expressions are written alike."""
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, broadcast_rules: int = 200_000) -> DataFrame:
    """id, host, path, rule, verdict of each row. ``rules``: verdict, host, path; of rules with the same host and path, block stays."""
    spark = pages.sparkSession
    known = rules.where("host is not null and path is not null").groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    digest = _digest(F.col("r_host"), F.col("r_path"))
    known = known.select(
        _short(digest).alias("short"),
        digest.alias("r_digest"),
        F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule")).alias("fit"),
        F.length("r_path").alias("r_size"),
    )
    stats = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set("r_size").alias("sizes")).first()
    sizes = sorted(stats.sizes)

    parts = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = url_parts(F.col("_url"))
    # rows of the same id, host and path become one with a count: what follows can group by them
    rows = parts.select("_id", host.alias("_host"), path.alias("_path")).groupBy("_id", "_host", "_path").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    labels = F.split("_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    fitting = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.length("_path"))
    each = rows.withColumn("_suffix", F.explode(suffixes)).withColumn("_size", F.explode_outer(fitting))
    each = each.withColumn("_digest", _digest(F.col("_suffix"), F.expr("substring(_path, 1, _size)"))).withColumn("short", _short(F.col("_digest"))).drop("_suffix", "_size")
    if stats.n <= broadcast_rules:
        hits = each.join(F.broadcast(known), "short", "left")
    else:
        salt = F.pmod(F.xxhash64("_id", "_path"), F.lit(SALTS)).cast("int")
        salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = each.withColumn("_salt", salt).join(salted, ["short", "_salt"], "left")
    fit = F.when(F.col("_digest") == F.col("r_digest"), F.col("fit"))
    best = hits.groupBy("_id", "_host", "_path", "_n").agg(F.max(fit).alias("_best"))
    out = best.withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.col("_n"))))
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark, RULES))


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), q AS (
  SELECT row_number() OVER () AS r, page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM p
), rules(verdict, h, x) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT q.r, max_by(h || x, length(h || x)) AS rule, max_by(verdict, length(h || x)) AS verdict
  FROM q JOIN rules ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, x)
  GROUP BY q.r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN fit USING (r)
"""
