"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct shingles; with similarity at least t, two sets share all but
``e = n - ceil(t n)`` members of either. Members are ordered, rare ones first, frequent ones last,
each class by its hash. Then

* the first ``e + 1`` members of two linked sets have one in common. A set whose ``e + 1`` are all
  rare is indexed under each of them alone;
* any other set takes its first ``e + k`` members, k = max(2, e + 1), is indexed under each rare one
  alone and under combinations of two frequent ones at most ``REACH`` places apart. Two such sets
  share k members there; as at most ``e`` of either are its own, two shared members in a row stand
  so close in both, and they are either a rare one or such a combination.

Which members are frequent is counted over all documents and only steers the cost: a member under
which more than ``frequent`` sets stand becomes frequent, and sets that hold it among their first
are indexed anew until none is left. No link depends on it.

Sets that are equal become one first. Under a key of at most ``BUCKET`` sets all pairs whose sizes
allow a link are candidates; a histogram of the hashes bounds each pair's overlap from above, and
what is left is verified on the whole sets.

Keys of more sets come from groups of near copies. Such a group is compared by its differences, with
rows in proportion to its members: with D(A) the members that A and the group's pivot don't share,
``|A ^ B| = |D(A)| + |D(B)| - 2 |D(A) & D(B)|``, so A and B are linked if and only if

    2 |D(A) & D(B)| (p + q) >= W(A) + W(B),    W(A) = |D(A)| (p + q) - n(A) (q - p),    t = p / q.

* Sets with W(A) + W(B) <= 0 are linked whatever they share; then both are linked with the set of
  least W, so one link from each to that set tells all of these.
* Likewise, among the sets that hold one member x of the differences, links that one shared member
  makes certain are all told by the set of least W among them.
* Any further link takes s >= 2 shared members of the differences. Only members that some other set
  holds count, the rarest of the group first; with m of them and a set needing at least s, at most
  m - s are its own, and sets with m < s are done. The rest are indexed as above: under rare members
  alone and combinations of frequent ones, as far apart as no pair can be missed (``_reach``). As s
  follows from both sets' W, the sets of a group are put in classes of W by powers of two, and a set
  is indexed for each class that can hold a partner, by the s that the class's least W asks for.
  Crowded keys of this index are groups again, with a pivot of their own; after ``DEPTH`` such steps,
  rounds of ``PIVOTS`` pivots are compared with all sets of the group not yet known to be in the
  pivot's component, until each set has been one.

The result is membership, not the number of links: a group of near copies has as many links as the
square of its size, and they are never made one by one.

Defined results: words are cut at ASCII white space, A-Z lower-cased; fewer words than ``width`` make
one shingle; a null or blank text has no shingle and is linked with nothing; rows with a null id take
no part and get a null component; repeated rows share their id's component; ties of a pivot or of the
least W go to the smallest id. A text of any length is taken whole, in memory that follows its own
length. Words and shingles are compared by 64-bit hashes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnweave.llm.common import lower_ascii, map_batches, table, word_hashes
from turnweave.llm.components import components
from turnweave.runtime import drop_materialised, free_shuffles, materialise, shuffles_freed

BUCKET, PIVOTS, REACH, DEPTH = 64, 64, 4, 4
#: Times that the index is built anew at most; members still crowded then go to the rounds of pivots.
ROUNDS = 6
#: Frequent members that are told to all tasks: 8 bytes each. The most frequent come first; any that
#: are over the bound are treated as rare, which costs time only.
MOST_FREQUENT = 200_000
#: Shared members of the differences that combinations reckon with at most, and combinations of a set
#: beyond which its group is indexed under single members.
SHARED, MANY = 64, 50_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set as ascending 64-bit hashes."""
    h = word_hashes(lower_ascii(text or ""))
    if not len(h):
        return np.empty(0, np.uint64)
    n, size = max(1, len(h) - width + 1), min(width, len(h))
    out = h[:n] * np.uint64(2 * size + 1)
    for j in range(1, size):
        out = _mix(out) * np.uint64(0xC2B2AE3D27D4EB4F) + h[j : j + n]
    out = np.sort(_mix(out))
    return out[np.append(True, out[1:] != out[:-1])]


def _least_overlap(n: int, t: Fraction) -> int:
    return -(-n * t.numerator // t.denominator)


def index_keys(s: np.ndarray, frequent: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rare members, and combinations of frequent ones, under which a set stands; and the rare members to be counted: some beyond those, as these take the places of members that become frequent."""
    n = len(s)
    e = n - _least_overlap(n, t)
    none = np.empty(0, np.uint64)
    if not len(frequent):
        return s[: e + 1], none, s[: 2 * e + 2]
    place = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    known = frequent[place] == s
    rare = s[~known]
    if len(rare) > e:
        return rare[: e + 1], none, rare[: 2 * e + 2]
    return rare, combinations_of(s[known][: e + max(2, e + 1) - len(rare)]), rare


def combinations_of(members: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Hashes of the pairs of members at most ``reach`` places apart."""
    return np.concatenate([np.empty(0, np.uint64), *(_mix(_mix(members[:-d]) + members[d:] * np.uint64(0x9E3779B97F4A7C15)) for d in range(1, min(reach, len(members) - 1) + 1))])


def _reach(own: int, shared: int) -> int:
    """How far apart the members of a combination may stand in a set with at most ``own`` members that the other lacks, where both share ``shared`` at least.

    Of the first m = min(shared, SHARED) shared members, m - 1 pairs are neighbours. A pair has this many of the set's own members between it at most (m - 2) // 2 times, and likewise in the other set, so some pair is near enough in both."""
    return own // ((min(shared, SHARED) - 2) // 2 + 1) + 1


def difference_keys(x: np.ndarray, often: np.ndarray, needed: int, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rare members, and combinations of frequent ones, under which a set stands that shares ``needed`` of its members x (rare ones first) or more with any other it is linked with."""
    spare = len(x) - needed
    rare, frequent = x[~often], x[often]
    alone, own = rare[: spare + 1], spare - len(rare)
    if own < 0:
        return alone, x[:0]
    if single:
        return np.concatenate([alone, frequent[: own + 1]]), x[:0]
    return alone, combinations_of(frequent[: own + SHARED], _reach(own, needed))


def histogram(s: np.ndarray) -> bytes:
    """Counts of the members by their low bits, about eight to a count; 255 stands for any more."""
    bins = 1 << max(4, (len(s) >> 3).bit_length())
    return np.minimum(np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int | None:
    """At most so many members can two sets share; None if a count is full."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if x.max() == 255 or y.max() == 255:
        return None
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(0), y.reshape(-1, n).sum(0)).sum())


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(arrays)) if arrays else np.empty(0, np.int64)))


def _index(docs: DataFrame, width: int, t: Fraction, frequent: np.ndarray, sketch: bool = True) -> DataFrame:
    """Per row: id, n, members to be counted, of which the first ``n_rare`` are the rare keys, combined keys; with ``sketch`` also the digest of the set and its histogram."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, width) for x in batch.column(1).to_pylist()]
        keys = [index_keys(s, held.value, t) if len(s) else (s, s, s) for s in sets]
        drawn = [pa.array([hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in sets], pa.binary()), pa.array([histogram(s) for s in sets], pa.binary())] if sketch else []
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([len(k[0]) for k in keys], pa.int32()), *(_lists([k[j] for k in keys]) for j in (1, 2)), *drawn],
            names=["id", "n", "n_rare", "combined", "counted", "digest", "hist"][: 5 + len(drawn)],
        )

    return map_batches(docs, each, "id long, n long, n_rare int, combined array<long>, counted array<long>" + ", digest binary, hist binary" * sketch)


def _rare() -> Column:
    """The rare keys of a row of ``_index``: not stored twice, as they begin the members to be counted."""
    return F.slice("counted", F.lit(1), F.col("n_rare"))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, width) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["id", "members"])

    return map_batches(docs, each, "id long, members array<long>")


def _fits(n: Column, m: Column, t: Fraction) -> Column:
    """Whether sets of these sizes can be linked."""
    return F.least(n, m) * t.denominator >= F.greatest(n, m) * t.numerator


def _bounded(pairs: DataFrame, heads: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that the histograms allow."""
    x = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("hist").alias("ha"))
    y = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("hist").alias("hb"))
    p, q = t.numerator, t.denominator

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, na, ha, nb, hb = (c.to_pylist() for c in batch.columns)
        keep = []
        for n, h, m, g in zip(na, ha, nb, hb, strict=True):
            most = overlap_bound(h, g)
            keep.append(most is None or most * q >= p * (n + m - most))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(pairs.join(x, "a").join(y, "b").select("a", "b", "na", "ha", "nb", "hb"), each, "a long, b long")


def _near(df: DataFrame, ids: DataFrame, how: str = "left_semi", limit: int = 1_000_000) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids`` (or isn't): told to all tasks while they are at most ``limit`` (8 bytes each), else shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= limit else ids, "id", how)


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose whole sets (id, members) are similar enough."""
    x, y = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return materialise(pairs.join(x, "a").join(y, "b").where(both * t.denominator >= (F.size("x") + F.size("y") - both) * t.numerator).select("a", "b"), "verified")


def _verified_from_text(pairs: DataFrame, rows: DataFrame, width: int, t: Fraction) -> DataFrame:
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "verify_ids")
    sets = materialise(_sets(_near(rows, ids), width).dropDuplicates(["id"]), "verify_sets")
    out = _verified(pairs, sets, t)
    drop_materialised(sets)
    drop_materialised(ids)
    return out


def _crowded_and_pairs(keys: DataFrame, t: Fraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (key, combined, id, n, told, w, m): the rows under keys of several sets, those under crowded ones, and the candidate pairs (a, b) of the others. Two sets that are told already, or whose m members can't make up for the sum of their w, need not meet."""
    each = 2 * (t.numerator + t.denominator)
    counts = materialise(keys.groupBy("key", "combined").agg(F.count(F.lit(1)).alias("sets"), F.min("told").alias("all_told")).where("sets > 1 and not all_told").drop("all_told"), "counts")
    free_shuffles(keys.sparkSession)
    index = materialise(keys.join(counts, ["key", "combined"]), "keys")
    drop_materialised(counts)
    free_shuffles(keys.sparkSession)
    buckets = index.where(F.col("sets") <= BUCKET).groupBy("key", "combined").agg(F.array_sort(F.collect_list(F.struct("n", "id", "told", "w", "m"))).alias("m"))
    fits = lambda x, y: (y["n"] * t.numerator <= x["n"] * t.denominator) & ~(x["told"] & y["told"]) & (x["w"] + y["w"] <= each * F.least(x["m"], y["m"]))
    paired = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, BUCKET), lambda y: fits(x, y)), lambda y: F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b")))))
    return index, index.where(F.col("sets") > BUCKET).select("key", "combined", "id", "n"), buckets.select(F.explode(paired).alias("p")).select("p.a", "p.b").where("a <> b").distinct()


def similar_components(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text", frequent: int = 16) -> DataFrame:
    """Per row: id, n_shingles, component_id."""
    with shuffles_freed(docs.sparkSession):
        return _similar_components(docs, width, similarity, id_col, text_col, frequent)


def _similar_components(docs: DataFrame, width: int, t: Fraction, id_col: str, text_col: str, frequent: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = materialise(_index(rows, width, t, np.empty(0, np.uint64)), "index")
    classes = base.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("head"))
    heads = materialise(base.select("id", "n", "digest").join(classes, "digest", "left").select("id", "n", "head"), "heads")
    leaders = materialise(heads.where("id = head").select("id").distinct(), "leaders")
    own, temporary = _reindexed(base, rows, leaders, width, t, frequent)
    own = own.select("id", "n", _rare().alias("rare"), "combined")
    one = lambda column, combined: F.transform(column, lambda k: F.struct(k.alias("key"), F.lit(combined).alias("combined")))
    keys = own.select("id", "n", F.explode(F.concat(one("rare", False), one("combined", True))).alias("k")).select("k.key", "k.combined", "id", "n", F.lit(False).alias("told"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("m"))
    index, large, pairs = _crowded_and_pairs(keys, t)
    sketches = materialise(_near(base.select("id", "n", "hist"), index.select("id").distinct()).dropDuplicates(["id"]), "sketches")
    for x in (base, leaders, *temporary):
        drop_materialised(x)
    pairs = materialise(_bounded(pairs, sketches, t), "pairs")
    free_shuffles(docs.sparkSession)
    links = _verified_from_text(pairs, rows, width, t)
    drop_materialised(pairs)
    large = materialise(large, "large")
    drop_materialised(index)
    free_shuffles(docs.sparkSession)

    told, depth = [links], 0
    while depth < DEPTH and large.limit(1).count():
        found, large = _differences(large, rows, width, t)
        told.append(found)
        free_shuffles(docs.sparkSession)
        depth += 1
    if depth:
        links = materialise(reduce(DataFrame.unionByName, told), "links")
        for x in told:
            drop_materialised(x)
    comps = components(links)
    if large.limit(1).count():
        comps = _pivot_rounds(large, links, comps, sketches, rows, width, t)
    for x in (links, large, sketches):
        drop_materialised(x)
    out = heads.join(comps, heads["head"] == comps["node"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "head", "id")).alias("component_id"))


def _reindexed(base: DataFrame, rows: DataFrame, leaders: DataFrame, width: int, t: Fraction, frequent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The leaders' rows of the index with the frequent members told apart, and the tables it reads besides."""
    known = np.empty(0, np.uint64)
    again = touched = None
    for _ in range(ROUNDS):
        # all rows are counted once; after that only sets that held a frequent member have new first members
        often = (_near(base, leaders) if again is None else again).select(F.explode("counted").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > frequent)
        new = often.orderBy(F.desc("sets"), "key").limit(MOST_FREQUENT - len(known)).toPandas()
        if not (new["sets"] > BUCKET).any():
            break
        known = np.unique(np.concatenate([known, new["key"].to_numpy(np.int64).view(np.uint64)]))
        told = F.broadcast(base.sparkSession.createDataFrame(new[["key"]], "key long"))
        hit = base.select("id", F.explode(_rare()).alias("key")).join(told, "key", "left_semi").select("id")
        hit = materialise((hit if touched is None else hit.unionByName(touched)).distinct(), "touched")
        for x in (again, touched):
            if x is not None:
                drop_materialised(x)
        touched = hit
        again = materialise(_index(_near(_near(rows, leaders), touched), width, t, known, sketch=False), "again")
        del often, new, told, hit
        free_shuffles(base.sparkSession)
    own = _near(base.drop("digest", "hist"), leaders)
    if again is None:
        return own, []
    return _near(own, touched, "left_anti").unionByName(again), [again, touched]


def _groups(large: DataFrame) -> DataFrame:
    """(g, id, n, k): sets under crowded keys, those that share a key in one group, with the number of their keys. Each set stands behind its least key, and a key is linked with the least keys of its sets: keys are joined, which are fewer than their rows."""
    node = F.xxhash64("key", "combined")
    first = F.min("node").over(W.partitionBy("id"))
    groups = components(large.select("id", node.alias("node")).select("node", first.alias("first")), "node", "first")
    ids = large.groupBy("id").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min(node).alias("first"))
    return materialise(ids.join(groups, ids["first"] == groups["node"], "left").select(F.coalesce("component", "first").alias("g"), "id", "n", "k"), "groups")


def _differences(large: DataFrame, rows: DataFrame, width: int, t: Fraction) -> tuple[DataFrame, DataFrame]:
    """Links that tell all links of the groups which differences from a pivot decide, and the crowded rows that are left."""
    p, q = t.numerator, t.denominator
    members = _groups(large)
    ids = members.select("id")
    sets = materialise(_sets(_near(rows, ids), width).dropDuplicates(["id"]), "sets")
    crowd = sets.join(members, "id")
    central = members.groupBy("g").agg(F.min(F.struct((-F.col("k")).alias("k"), "id")).alias("p")).select("g", F.col("p.id").alias("id"))
    pivots = materialise(sets.join(central, "id").select("g", F.col("members").alias("pivot")), "pivots")
    few = pivots.count() <= 256

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart, weight = [], []
        sizes = batch.column(2).to_numpy()
        for n, x, y in zip(sizes.tolist(), batch.column(3), batch.column(4), strict=True):
            d = np.setxor1d(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True)
            apart.append(d.view(np.uint64))
            weight.append(len(d) * (p + q) - n * (q - p))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64()), _lists(apart)], names=["g", "id", "n", "w", "apart"])

    joined = crowd.join(F.broadcast(pivots) if few else pivots, "g").select("g", "id", "n", "members", "pivot")
    apart = materialise(map_batches(joined, each, "g long, id long, n long, w long, apart array<long>"), "apart")
    lowest = F.min(F.struct("w", "id"))
    best = apart.groupBy("g").agg(lowest.alias("best"))
    best = materialise(best.select("g", F.col("best.w").alias("bw"), F.col("best.id").alias("bid")), "best")
    told = F.broadcast(best) if few else best
    link = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    stars = apart.join(told, "g").where("id <> bid and w + bw <= 0").select(*link("id", "bid"))
    # members of the differences that several sets hold, with the least of these sets
    flat = apart.select("g", "id", "n", "w", F.explode("apart").alias("x"))
    shared = flat.groupBy("g", "x").agg(F.count(F.lit(1)).alias("sets"), lowest.alias("least")).where("sets > 1")
    shared = materialise(shared.select("g", "x", "sets", F.col("least.w").alias("lw"), F.col("least.id").alias("lid")), "shared")
    held = materialise(flat.join(shared, ["g", "x"]), "held")
    ones = held.where((F.col("id") != F.col("lid")) & (F.col("w") + F.col("lw") <= 2 * (p + q))).select(*link("id", "lid")).distinct()
    links = materialise(stars.unionByName(ones).distinct(), "told")
    # what takes two shared members or more
    lists = held.groupBy("g", "id", "n", "w").agg(F.array_sort(F.collect_list(F.struct("sets", "x"))).alias("m")).join(told, "g")
    needed = F.greatest(F.lit(2).cast("long"), F.ceil((F.col("w") + F.col("bw")) / (2 * (p + q))).cast("long"))
    lists = lists.withColumn("needed", needed).where(F.size("m") >= F.col("needed"))
    level = F.when(F.col("w") <= 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.log2(F.col("w") / (p + q))).cast("int")))
    lists = lists.select("g", "id", "n", (F.col("w") + F.col("bw") <= 0).alias("told"), "w", level.alias("c"), F.col("needed").cast("int").alias("needed"), F.transform("m", lambda v: v["x"]).alias("x"), F.transform("m", lambda v: v["sets"] > BUCKET).alias("often"))
    lists = materialise(lists, "lists")
    own = F.size("x") - F.col("needed") - F.size(F.filter("often", lambda v: ~v))
    most = F.when(own >= 0, (own + SHARED) * F.floor(own / (F.floor((F.least("needed", F.lit(SHARED)) - 2) / 2) + 1) + 1)).otherwise(0)
    by_class = lists.groupBy("g", "c").agg(F.min("w").alias("w"), F.max(F.size("x")).alias("m"), F.max(most).alias("most"))
    classes = by_class.groupBy("g").agg((F.max("most") > MANY).alias("single"), F.collect_list(F.struct("c", "w", "m")).alias("classes"))

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        rare, combined = [], []
        columns = [batch.column(k).to_pylist() for k in (0, 4, 5)]
        for g, w, c, x, often, single, partners in zip(*columns, batch.column(6), batch.column(7), batch.column(8).to_pylist(), batch.column(9).to_pylist(), strict=True):
            x, often = x.values.to_numpy().view(np.uint64), np.array(often.as_py(), bool)
            mine: tuple[list, list] = ([], [])
            for other in partners:
                least = max(2, -(-(w + other["w"]) // (2 * (p + q))))
                if least > min(len(x), other["m"]):
                    continue
                salt = _mix(_mix(np.array([g], np.int64).view(np.uint64)) + np.uint64(64 * min(c, other["c"]) + max(c, other["c"])))
                for kept, keys in zip(mine, difference_keys(x, often, least, single), strict=True):
                    kept.append(_mix(keys + salt))
            rare.append(np.concatenate([x[:0], *mine[0]]))
            combined.append(np.concatenate([x[:0], *mine[1]]))
        return pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array([len(x) for x in batch.column(6)], pa.int32()), _lists(rare), _lists(combined)], names=["id", "n", "told", "w", "m", "rare", "combined"])

    wide = lists.join(F.broadcast(classes) if few else classes, "g").select("g", "id", "n", "told", "w", "c", "x", "often", "single", "classes")
    one = lambda column, combined: F.transform(column, lambda k: F.struct(k.alias("key"), F.lit(combined).alias("combined")))
    keys = map_batches(wide, keyed, "id long, n long, told boolean, w long, m int, rare array<long>, combined array<long>").select("id", "n", "told", "w", "m", F.explode(F.concat(one("rare", False), one("combined", True))).alias("k")).select("k.key", "k.combined", "id", "n", "told", "w", "m")
    index, left, pairs = _crowded_and_pairs(materialise(keys, "near_keys"), t)
    out = materialise(links.unionByName(_verified(pairs, sets, t)), "links")
    left = materialise(left, "large")
    for x in (large, members, sets, pivots, apart, best, shared, held, links, lists, index):
        drop_materialised(x)
    return out, left


def _pivot_rounds(large: DataFrame, links: DataFrame, comps: DataFrame, sketches: DataFrame, rows: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Components with the links under keys that stay crowded. A group's sets are dealt by a hash into PIVOTS parts; in each round the next set of every part, in order of ids, is the pivot for all sets of the group that aren't in its component. A group whose sets are all in one component is done."""
    members = _groups(large).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)))
    after: DataFrame | None = None
    while True:
        named = members.join(comps, members["id"] == comps["node"], "left").select("g", "part", "id", "n", F.coalesce("component", "id").alias("c"))
        parted = named.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
        rest = named if after is None else named.join(after, ["g", "part"], "left").where("last is null or id > last").drop("last")
        next_one = F.min(F.struct(F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("c").alias("pc"))).alias("p")
        pivots = materialise(rest.join(parted, "g", "left_semi").groupBy("g", "part").agg(next_one).select("g", "part", "p.*"), "pivots")
        if not pivots.limit(1).count():
            return comps
        pairs = named.drop("part").join(pivots.drop("part"), "g").where((F.col("id") != F.col("pid")) & (F.col("c") != F.col("pc")) & _fits(F.col("n"), F.col("pn"), t))
        pairs = materialise(_bounded(pairs.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct(), sketches, t), "pairs")
        found = _verified_from_text(pairs, rows, width, t)
        drop_materialised(pairs)
        if found.limit(1).count():
            links = materialise(links.unionByName(found), "links")
            comps = components(links)
        done = pivots.select("g", "part", F.col("pid").alias("last"))
        after = materialise(done if after is None else after.unionByName(done).groupBy("g", "part").agg(F.max("last").alias("last")), "after")
        drop_materialised(pivots)


def filter_documents(docs: DataFrame, width: int = 5, similarity: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked documents the one with the smallest id, all columns unchanged; of rows that share id and text, one. Rows that share an id alone are documents of their own, in the order of their texts' digests. Rows without an id stay."""
    columns, key = docs.columns, id_col
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        docs = docs.withColumn("_digest", F.coalesce(F.sha2(text_col, 256), F.lit("")))
        named = F.col(id_col).isNotNull()
        # numbers in the order of (id, digest): a sorted table's parts follow each other
        numbers = docs.where(named).select(id_col, "_digest").distinct().orderBy(id_col, "_digest").withColumn("_row", F.monotonically_increasing_id())
        numbers = materialise(numbers, "numbers")
        docs = docs.where(named).dropDuplicates([id_col, "_digest"]).join(numbers, [id_col, "_digest"]).unionByName(docs.where(~named).withColumn("_row", F.lit(None).cast("long")))
        key = "_row"
    with shuffles_freed(docs.sparkSession):
        comps = materialise(similar_components(docs, width, similarity, key, text_col).select(F.col(key).alias("id"), F.col("component_id").alias("c")).where("id is not null"), "components")
    gone = comps.where("c <> id").select(F.col("id").alias(key)).distinct()
    return docs.join(F.broadcast(gone) if gone.count() <= 1_000_000 else gone, key, "left_anti").select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), 3, Fraction(9, 10))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS r FROM links
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
), least AS (
  SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
