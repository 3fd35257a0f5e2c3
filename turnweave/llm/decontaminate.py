"""Benchmark decontamination by spaced seeds.

Texts are cut into tokens (runs of letters, digits and other characters above ASCII, in lower case).
A seed hashes the six tokens that a fixed mask keeps out of eight or nine neighbours and ignores the
others. Between them the two masks hit every run of 13 tokens with at most two substitutions. Items of
9 to 12 tokens give fewer places: they have further masks, by their length, so that every set of
substitutions that leaves 80 % of their tokens is hit.

Items become a table, and so do their seeds; a bitmap of the seeds (of a fixed size at most) is told to
all tasks, with 4,096 bits a seed while that fits, so that few places pass by chance. One pass over the documents keeps, of each, the neighbourhoods of the places whose seeds the
bitmap holds; these seeds are joined with the benchmark's, salted where the benchmark is too large to
be told, so that a passage that very many documents hold is spread. Each hit fixes an item, and how far
it is shifted against the document; there the item is compared token by token: an overlap is a stretch
of windows of 13 tokens (the whole item if it is shorter), each with at least 80 % equal tokens, that
touch or overlap. Items of fewer than nine tokens must be equal. Neither the benchmark nor the hashes of
the documents go through the driver.

Documents are known by the digest of their text, on which alone the result depends: copies are compared
once, and each row gets what its text has.

Defined results: null or empty texts and items overlap with nothing; every row of the documents and of
the benchmark counts for itself, whatever ids they share, null ids as any other; of the overlaps of a
document's row with an item's row the one with the most equal tokens is given, ties: the first in the
document, then the first in the item. Texts of any length are taken whole. Extra columns are ignored by
``find_overlaps`` and kept by ``filter_documents``. An empty table gives no hits.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.bitmap import bitmap_of, marked
from turnweave.llm.common import Hashes, map_batches, table
from turnweave.runtime import drop_materialised, materialise

TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Kept places; together they hit every 13 tokens with two or fewer substitutions.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
LENGTH, SHARE = 13, 0.8
SPAN = max(m[-1] for m in MASKS) + 1
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9, 0x2545F4914F6CDD1D], np.uint64)
#: Rows that are told to all tasks at most, and parts of each key of the benchmark beyond that.
TOLD, SALTS = 1_000_000, 16


_HASHES = Hashes()


def tokens(text: str | None) -> np.ndarray:
    found = TOKEN.findall((text or "").lower().encode())
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return h * ODD[6]


def _seeds(t: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hashes of the kept places at each start."""
    n = len(t) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, len(mask) * 0x10000 + mask[-1], np.uint64) * ODD[8]
    for k, j in enumerate(mask):
        out += t[j : j + n] * ODD[k]
    return _mix(out)


def needed(n: int) -> int:
    """Equal tokens that an item of n tokens, or a window of LENGTH of a longer one, must have."""
    width = min(LENGTH, n)
    return width if n < SPAN else int(np.ceil(SHARE * width))


@lru_cache
def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks for items of n tokens: the fixed ones, and for fewer than LENGTH tokens those that hit what substitutions the fixed ones miss, the most at a time."""
    if n < SPAN:
        return (tuple(range(n)),) if n else ()
    if n >= LENGTH:
        return MASKS
    missed = set(combinations(range(n), n - needed(n)))

    def hit(mask: tuple[int, ...]) -> set[tuple[int, ...]]:
        return {w for w in missed if any(all(o + j not in w for j in mask) for o in range(n - mask[-1]))}

    out = list(MASKS)
    for mask in MASKS:
        missed -= hit(mask)
    more = [(0, *rest) for rest in combinations(range(1, n), len(MASKS[0]) - 1)]
    while missed:
        out.append(max(more, key=lambda m: len(hit(m))))
        missed -= hit(out[-1])
    return tuple(out)


def overlaps_at(t: np.ndarray, base: int, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(equal, first and end token in the document) of the stretches in which the item, ``shift`` tokens on, equals tokens t of the document, which begin at ``base``."""
    a, b = max(0, base - shift), min(len(item), base + len(t) - shift)
    width = min(LENGTH, len(item))
    if b - a < width or not width:
        return []
    same = t[shift + a - base : shift + b - base] == item[a:b]
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(sums[width:] - sums[:-width] >= needed(len(item)))
    if not len(good):
        return []
    cuts = np.flatnonzero(np.diff(good) > width) + 1
    return [(int(sums[e + width] - sums[f]), shift + a + int(f), shift + a + int(e) + width) for f, e in ((x[0], x[-1]) for x in np.split(good, cuts))]


def item_seeds(item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an item's seeds, and their places."""
    found = [_seeds(item, m) for m in masks_of(len(item))]
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate([np.arange(len(h)) for h in found])


def _benchmark(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Items (k, item id, tokens) and their seeds (hash, k, place, n: tokens of the item if few)."""
    rows = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        items = [tokens(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), _lists(items)], names=["item", "tokens"])

    items = map_batches(rows, each, f"item {rows.schema['item'].dataType.simpleString()}, tokens array<long>").where(F.size("tokens") > 0)
    items = materialise(items.select(F.monotonically_increasing_id().alias("k"), "item", "tokens"), "items")

    def seeds(batch: pa.RecordBatch) -> pa.RecordBatch:
        ks, hashes, places, sizes = [], [], [], []
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.values.to_numpy().view(np.uint64)
            h, at = item_seeds(t)
            ks.append(np.full(len(h), k))
            hashes.append(h)
            places.append(at)
            sizes.append(np.full(len(h), min(len(t), LENGTH)))
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), join(ks), join(places), join(sizes)], names=["hash", "k", "place", "n"])

    return items, materialise(map_batches(items.select("k", "tokens"), seeds, "hash long, k long, place long, n long"), "seeds")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)))


def _regions(rows: DataFrame, bits: np.ndarray, masks: list[tuple[int, ...]]) -> DataFrame:
    """(row, region, base, tokens, at, hashes): of each document, around the places whose seeds the bitmap holds, the tokens from a window before to a window after; places that are near each other share a region."""
    held = rows.sparkSession.sparkContext.broadcast((bits, masks))
    reach = 2 * LENGTH

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bitmap, known = held.value
        out: list[tuple] = []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            t = tokens(text)
            places, hashes = [], []
            for m in known:
                h = _seeds(t, m)
                at = np.flatnonzero(marked(bitmap, h))
                places.append(at)
                hashes.append(h[at])
            at = np.concatenate(places)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, h = at[order], np.concatenate(hashes)[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(at) > 2 * reach) + 1, [len(at)]])
            for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                base = max(0, int(at[a]) - reach)
                out.append((row, r, base, t[base : int(at[b - 1]) + reach], at[a:b], h[a:b]))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:3]), _lists(list(cols[3])), _lists([x.astype(np.int64) for x in cols[4]]), _lists(list(cols[5]))], names=["row", "region", "base", "tokens", "at", "hashes"])

    return map_batches(rows, each, "row binary, region long, base long, tokens array<long>, at array<long>, hashes array<long>")


def _joined(df: DataFrame, other: DataFrame, key: str, rows: int) -> DataFrame:
    """An inner join in which one key may have very many rows of ``df``: ``other`` is told to all tasks while it is small (``rows``, by its own size), else both are dealt by key and salt."""
    if rows <= TOLD:
        return df.join(F.broadcast(other), key)
    salted = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64("row", "region"), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _overlaps(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """Of rows (row, text) and items the best overlap: row, k, item, first_token, end_token, equal_tokens, share."""
    items, seeds = _benchmark(benchmark, item_col, item_text_col)
    n_seeds = seeds.count()
    few = [r.n for r in seeds.select("n").distinct().collect()]  # at most LENGTH numbers
    masks = list(dict.fromkeys(m for n in sorted(few, reverse=True) for m in masks_of(n)))
    kind = items.schema["item"].dataType.simpleString()
    if not n_seeds:
        return rows.sparkSession.createDataFrame([], f"row binary, k long, item {kind}, first_token long, end_token long, equal_tokens long, share double")
    regions = materialise(_regions(rows, bitmap_of(seeds, "hash", 4096), masks).dropDuplicates(["row", "region"]), "regions")
    places = F.explode(F.arrays_zip("at", "hashes")).alias("p")
    hits = regions.select("row", "region", places).select("row", "region", F.col("p.at").alias("at"), F.col("p.hashes").alias("hash"))
    met = _joined(hits, seeds.select("hash", "k", "place"), "hash", n_seeds).select("row", "region", "k", (F.col("at") - F.col("place")).alias("shift")).distinct()
    # a region's alignments with the items, then the region's tokens, once for all of them
    pairs = met.groupBy("row", "region", "k").agg(F.collect_set("shift").alias("shifts")).join(regions.select("row", "region", "base", "tokens"), ["row", "region"])
    pairs = _joined(pairs, items.select("k", F.col("tokens").alias("item_tokens")), "k", n_seeds)

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, k, base, shifts = (batch.column(c).to_pylist() for c in ("row", "k", "base", "shifts"))
        out = []
        for i, (t, item) in enumerate(zip(batch.column("tokens"), batch.column("item_tokens"), strict=True)):
            t, item = t.values.to_numpy(), item.values.to_numpy()
            found = [x for s in shifts[i] for x in overlaps_at(t, base[i], item, s)]
            if found:
                equal, first, end = min(found, key=lambda x: (-x[0], x[1], x[2]))
                out.append((row[i], k[i], first, end, equal, equal / len(item)))
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.float64())], names=["row", "k", "first_token", "end_token", "equal_tokens", "share"])

    found = map_batches(pairs.select("row", "k", "base", "shifts", "tokens", "item_tokens"), verify, "row binary, k long, first_token long, end_token long, equal_tokens long, share double")
    best = F.min(F.struct((-F.col("equal_tokens")).alias("e"), "first_token", "end_token", "equal_tokens", "share")).alias("b")
    out = found.groupBy("row", "k").agg(best).select("row", "k", "b.first_token", "b.end_token", "b.equal_tokens", "b.share")
    out = materialise(out.join(F.broadcast(items.select("k", "item")) if n_seeds <= TOLD else items.select("k", "item"), "k"), "overlaps")
    for x in (regions, seeds, items):
        drop_materialised(x)
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document's row and item's row that overlap: ids, first_token, end_token, equal_tokens, share."""
    rows = docs.select(_digest(text_col).alias("row"), F.col(text_col).alias("text"), F.col(id_col).alias("doc"))
    found = _overlaps(rows.select("row", "text"), benchmark, item_col, item_text_col)
    few = found.count() <= TOLD
    hit = found.select("row", F.col("item").alias(item_col), "first_token", "end_token", "equal_tokens", "share")
    return rows.select("row", F.col("doc").alias(id_col)).join(F.broadcast(hit) if few else hit, "row").drop("row")


def filter_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that overlap with no item, all their columns unchanged."""
    rows = docs.select(_digest(text_col).alias("_row"), *docs.columns)
    found = _overlaps(rows.select(F.col("_row").alias("row"), F.col(text_col).alias("text")), benchmark, item_col, item_text_col)
    gone = found.select(F.col("row").alias("_row")).distinct()
    return rows.join(F.broadcast(gone) if gone.count() <= TOLD else gone, "_row", "left_anti").drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.withColumn("share", F.round("share", 6))
