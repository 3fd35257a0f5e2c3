"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier: in a document of a
smaller id, or in the same one before. To sort the suffixes of just those places that can repeat:

1. Each window of LENGTH bytes holds as many grams of ``GRAM`` bytes as fit; the least of their hashes
   (the first among equals) is its anchor. Equal windows have equal anchors at equal places, so a
   window whose anchor's gram occurs once repeats nowhere. Windows in a row with the same anchor form
   a context, their bytes. Grams are counted over all documents.
2. Contexts that are equal as a whole (by a cryptographic digest of 128 bits) are one class; its first
   occurrence stands for it, and all windows of the others repeat. Very common passages shrink to one
   context here, before any text is shuffled.
3. Where a gram has several classes, their contexts are cut to the windows whose hash is met again, and
   the suffixes of what is left are sorted by induction with common-prefix values (``induced``), one
   shard of grams at a time, in ``MEMORY`` bytes of its task and scratch files beyond. Neighbours with
   LENGTH bytes in common are equal windows; all but the earliest repeat.
4. A gram whose classes hold more than ``HOT`` bytes is not sorted in one shard: its windows are dealt
   by the digest of their LENGTH bytes, and of equal ones all but the earliest repeat. So no
   gram makes a shard large.

The repeated windows go back to their documents as ranges, and each document is cut and digested.

Order: ids ascending, null first; rows with the same id by a hash of the text; rows with the same id
and text are one occurrence, and each gets its result. Null texts count as empty. Texts shorter than
LENGTH bytes keep everything; longer ones, of any length, are taken whole, one text at a time. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnweave.llm.bitmap import bitmap_of, marked
from turnweave.llm.common import forget, map_batches, powers, slices, table
from turnweave.llm.induced import Store, sorted_suffixes
from turnweave.runtime import drop_materialised, materialise, ship_package

LENGTH, GRAM = 100, 32
#: Lists of contexts or spans are told to all tasks up to so many (24 bytes each), else joined.
TOLD = 2_000_000
#: Bytes of contexts in a shard, about. Grams with more bytes of classes than this are dealt by windows.
SHARD = HOT = 2 << 20
#: Bytes of memory that the sort of a shard takes for its arrays; what is beyond lies in scratch files.
MEMORY = 128 << 20
#: Contexts whose windows are hashed at once; a context holds at most 2 * LENGTH - GRAM bytes.
BLOCK = 8192
PIECE = 1 << 22
_MUL = [pow(0x9E3779B97F4A7C15 | 1, 1 << k, 1 << 64) for k in range(5)]
_LOW = np.uint64((1 << 24) - 1)


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the gram, first window, number of windows) of each context of a text's bytes."""
    grams, first, count = [], [], []
    last = len(raw) - LENGTH + 1
    for at in range(0, max(last, 0), PIECE):
        part = raw[at : at + PIECE + LENGTH - 1]
        h = part.astype(np.uint64) + np.uint64(1)
        for k in range(5):  # strings of 2, 4, 8, 16, 32 bytes
            s = 1 << k
            h = h[:-s] * np.uint64(_MUL[k]) + h[s:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        n = len(v) - (LENGTH - GRAM)  # windows
        width = 1
        while 2 * width <= LENGTH - GRAM + 1:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[:n], v[LENGTH - GRAM + 1 - width :][:n])
        place = v & _LOW
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        least = h[place[starts].astype(np.int64)] * np.uint64(0x94D049BB133111EB)  # least hashes crowd at the low end: spread them
        grams.append((least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15))
        first.append(starts + at)
        count.append(np.diff(np.append(starts, n)))
    if not grams:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(grams), np.concatenate(first), np.concatenate(count)


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _grams(rows: DataFrame) -> DataFrame:
    """A row for each gram of each batch of documents, its own repetitions counted."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams = np.sort(np.concatenate([anchors(_bytes(t))[0] for t in batch.column("text").to_pylist()]))
        starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(grams[starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(grams))).astype(np.int64))], names=["gram", "n"])

    return map_batches(rows.select("text"), each, "gram long, n long")


def _contexts(rows: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """Contexts of the grams marked: gram, digest of the bytes, id, h, first window, windows."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = held.value
        out = []
        for k, text in enumerate(batch.column("text").to_pylist()):
            raw = (text or "").encode()
            grams, first, count = anchors(np.frombuffer(raw, np.uint8))
            keep = marked(known, grams)
            grams, first, count = grams[keep], first[keep], count[keep]
            digests = [_digest(raw[a : a + n + LENGTH - 1]) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
            out.append((np.full(len(grams), k), grams, digests, first, count))
        where, grams, digests, first, count = zip(*out, strict=True)
        take = pa.array(np.concatenate(where))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(grams).view(np.int64)), pa.array([d for x in digests for d in x], pa.binary()), batch.column("id").take(take), batch.column("h").take(take), pa.array(np.concatenate(first).astype(np.int64)), pa.array(np.concatenate(count).astype(np.int64))],
            names=["gram", "digest", "id", "h", "first", "windows"],
        )

    return map_batches(rows.select("text", "id", "h"), each, "gram long, digest binary, id long, h long, first long, windows long")


def _with_text(ranges: DataFrame, n: int, rows: DataFrame, how: str) -> DataFrame:
    """Documents with an array of what ``ranges`` (id, h, list) holds for them."""
    match = ranges.select(F.col("id").alias("id_"), F.col("h").alias("h_"), "list")
    match = F.broadcast(match) if n <= TOLD else match
    return rows.join(match, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), how).drop("id_", "h_")


def _cut_out(docs: DataFrame) -> DataFrame:
    """The bytes of the contexts listed."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for k, (text, contexts) in enumerate(zip(batch.column("text").to_pylist(), batch.column("list").to_pylist(), strict=True)):
            raw = (text or "").encode()
            rows += [(k, c["gram"], c["first"], c["windows"], raw[c["first"] : c["first"] + c["windows"] + LENGTH - 1]) for c in contexts]
        k, gram, first, windows, data = zip(*rows, strict=True) if rows else [()] * 5
        take = pa.array(k, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), batch.column("id").take(take), batch.column("h").take(take), pa.array(first, pa.int64()), pa.array(windows, pa.int64()), pa.array(data, pa.binary())], names=["gram", "id", "h", "first", "windows", "data"])

    return map_batches(docs.select("text", "id", "h", "list"), each, "gram long, id long, h long, first long, windows long, data binary")


def _windows(docs: DataFrame) -> DataFrame:
    """A row for each window of the contexts listed: digest of its bytes, id, h, the context's first window, its own place."""
    ship_package(docs.sparkSession)

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for k, (text, contexts) in enumerate(zip(batch.column("text").to_pylist(), batch.column("list").to_pylist(), strict=True)):
            raw = (text or "").encode()
            for c in contexts:
                for at in range(c["first"], c["first"] + c["windows"]):
                    yield k, _digest(raw[at : at + LENGTH]), c["first"], at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for some in batched(rows(batch), 20_000):
                k, digest, context, first = zip(*some, strict=True)
                take = pa.array(k, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), batch.column("id").take(take), batch.column("h").take(take), pa.array(context, pa.int64()), pa.array(first, pa.int64())], names=["digest", "id", "h", "context", "first"])

    return docs.select("text", "id", "h", "list").mapInArrow(run, "digest binary, id long, h long, context long, first long")


def _dealt_windows(docs: DataFrame) -> DataFrame:
    """Ranges (id, h, first, windows) of the windows listed that start earlier too: one shuffle by digests, whose rows are sorted on disk where they are many. A context gives at most LENGTH - GRAM + 1 windows, joined to runs."""
    number = F.row_number().over(W.partitionBy("digest").orderBy("id", "h", "first"))
    again = _windows(docs).withColumn("r", number).where("r > 1").groupBy("id", "h", "context").agg(F.collect_list("first").alias("list"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        take, first, windows = [], [], []
        for k, places in enumerate(batch.column("list").to_pylist()):
            for at in sorted(places):
                if take and take[-1] == k and at == first[-1] + windows[-1]:
                    windows[-1] += 1
                else:
                    take.append(k)
                    first.append(at)
                    windows.append(1)
        rows = pa.array(take, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("h").take(rows), pa.array(first, pa.int64()), pa.array(windows, pa.int64())], names=["id", "h", "first", "windows"])

    return map_batches(again.select("id", "h", "list"), each, "id long, h long, first long, windows long")


def repeats_of(contexts: pa.Table, memory: int = MEMORY, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows) of the runs of windows that a context repeats of an earlier one, by sorting all their suffixes."""
    data = contexts.column("data").to_pylist()
    sizes = np.array([len(d) for d in data], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    store = Store(memory, folder)
    text = store.array(int(begins[-1]), np.uint16)
    for k in range(0, len(data), BLOCK):  # bytes plus one; 0 ends a context
        part = data[k : k + BLOCK]
        a, b = begins[k], begins[min(k + BLOCK, len(data))]
        text[a:b] = np.frombuffer(b"\0".join([*part, b""]), np.uint8).astype(np.uint16) + 1
        text[begins[k + 1 : k + 1 + len(part)] - 1] = 0
    del data
    first = contexts.column("first").to_numpy()
    ids, hashes = contexts.column("id").to_pylist(), contexts.column("h").to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, hashes[k]))
    rank = np.empty(len(ids), np.int64)
    last, r = None, -1
    for k in order:
        if (key := (ids[k], hashes[k])) != last:
            r, last = r + 1, key
        rank[k] = r
    found = []
    group: list[np.ndarray] = []

    def settle() -> None:
        """All but the earliest of the equal windows gathered."""
        pos = np.concatenate(group) if group else np.empty(0, np.int64)
        group.clear()
        if len(pos) < 2:
            return
        c = np.searchsorted(begins, pos, "right") - 1
        at = first[c] + pos - begins[c]
        found.append(pos[np.lexsort((at, rank[c]))[1:]])

    for pos, common in sorted_suffixes(text, LENGTH, store=store):
        borders = np.flatnonzero(common < LENGTH)
        if not len(borders):
            group.append(pos)
            continue
        group.append(pos[: borders[0]])
        settle()
        # whole groups within the block, all at once
        ends = np.append(borders[1:], len(pos))
        size = ends - borders
        inner = np.zeros(len(pos), bool)
        for_many = size[:-1] > 1
        if for_many.any():
            number = np.searchsorted(borders, np.arange(len(pos)), "right")
            inner[borders[0] : borders[-1]] = np.repeat(for_many, size[:-1])
            p, g = pos[inner], number[inner]
            c = np.searchsorted(begins, p, "right") - 1
            by = np.lexsort((first[c] + p - begins[c], rank[c], g))
            g = g[by]
            found.append(p[by][1:][g[1:] == g[:-1]])
        group.append(pos[borders[-1] :])
    settle()
    if not found:
        return (np.empty(0, np.int64),) * 3
    pos = np.sort(np.concatenate(found))
    # suffixes that reach a context's end are no windows: they equal only others that do
    pos = pos[begins[np.searchsorted(begins, pos, "right")] - 1 - pos >= LENGTH]
    if not len(pos):
        return (np.empty(0, np.int64),) * 3
    starts = np.flatnonzero(np.append(True, pos[1:] != pos[:-1] + 1))
    c = np.searchsorted(begins, pos[starts], "right") - 1
    return c, first[c] + pos[starts] - begins[c], np.diff(np.append(starts, len(pos)))


def _window_hashes(data: list[bytes], windows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of the contexts, BLOCK contexts at a time."""
    out = []
    for k in range(0, len(data), BLOCK):
        n = windows[k : k + BLOCK]
        text = np.frombuffer(b"".join(data[k : k + BLOCK]), np.uint8)
        up, down = powers(len(text) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        at = np.repeat(np.arange(len(n)) * (LENGTH - 1), n) + np.arange(n.sum())
        h = (sums[at + LENGTH] - sums[at]) * down[at]
        out.append((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))
    return np.concatenate(out)


def trimmed(shard: pa.Table) -> pa.Table:
    """The contexts of a shard cut to the span of their windows whose hash is met more than once in the shard. Equal windows have equal hashes, so what goes repeats nothing; what stays is left to the sort."""
    data = shard.column("data").to_pylist()
    windows = shard.column("windows").to_numpy()
    h = _window_hashes(data, windows)
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    del order
    twice = twice[np.append(True, twice[1:] != twice[:-1])] if len(twice) else twice
    hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h) if len(twice) else np.empty(0, np.int64)
    ends = np.cumsum(windows)
    c = np.searchsorted(ends, hit, "right")
    keep = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.empty(0, np.int64)
    begins = (ends - windows)[c[keep]]
    a = hit[keep] - begins
    b = hit[np.append(keep[1:], len(hit)) - 1] - begins + 1 if len(keep) else a
    rows = shard.take(pa.array(c[keep]))
    first = rows.column("first").to_numpy() + a
    cut = [data[k][i : j + LENGTH - 1] for k, i, j in zip(c[keep].tolist(), a.tolist(), b.tolist(), strict=True)]
    return pa.table({"id": rows.column("id"), "h": rows.column("h"), "first": pa.array(first, pa.int64()), "windows": pa.array(b - a, pa.int64()), "data": pa.array(cut, pa.binary())})


def _sorted_shards(contexts: DataFrame, shards: int) -> DataFrame:
    """Ranges (id, h, first, windows) of repeated windows; a shard is all contexts of its grams, none of which holds more than HOT bytes."""
    ship_package(contexts.sparkSession)
    schema = "id long, h long, first long, windows long"

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        shard = trimmed(pa.Table.from_batches(got))
        got.clear()
        if not len(shard):
            return
        c, first, windows = repeats_of(shard)
        take = pa.array(c)
        yield from pa.table({"id": shard.column("id").take(take), "h": shard.column("h").take(take), "first": pa.array(first, pa.int64()), "windows": pa.array(windows, pa.int64())}).combine_chunks().to_batches(max_chunksize=100_000)
        forget()

    return contexts.repartition(shards, "gram").mapInArrow(sort, schema)


def repeated_windows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows as (id, h, text), and all ranges (id, h, first, windows) of windows that start earlier too."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    repeats = rows.groupBy("id", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count() > 0
    # a gram that occurs once, in all, can't repeat
    counts = materialise(_grams(rows).groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "grams")
    found = materialise(_contexts(rows, bitmap_of(counts)), "contexts")
    # rows with the same id and text are one occurrence
    one = F.struct("id", "h", "first")
    classes = found.groupBy("gram", "digest").agg(F.min(one).alias("least"), F.max(one).alias("most"), F.first("windows").alias("windows"))
    classes = materialise(classes, "classes")
    # of classes with several occurrences, all but the first
    again = found.join(classes.where("least <> most").select("gram", "digest", "least"), ["gram", "digest"]).where(~one.eqNullSafe(F.col("least"))).select("id", "h", "first", "windows")
    # grams with several classes: the first occurrences of each
    mixed = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), (F.sum(F.col("windows") + LENGTH) > HOT).alias("hot")).where("k > 1").select("gram", "hot")
    wanted = classes.join(mixed, "gram").select("gram", "hot", "least.id", "least.h", "least.first", "windows")
    lists = [F.collect_list(F.when(hot, F.struct("gram", "first", "windows"))).alias(name) for name, hot in (("list", ~F.col("hot")), ("hot", F.col("hot")))]
    wanted = materialise(wanted.groupBy("id", "h").agg(*lists), "wanted")
    size = wanted.agg(F.sum(F.size("list")).alias("n"), F.sum(F.size("hot")).alias("n_hot"), F.sum(F.aggregate("list", F.lit(0).cast("long"), lambda a, c: a + c["windows"] + LENGTH)).alias("bytes")).first()
    ranges = again
    texts = rows.dropDuplicates(["id", "h"]) if repeats else rows
    if size.n_hot:
        hot = wanted.where(F.size("hot") > 0).select("id", "h", F.col("hot").alias("list"))
        ranges = ranges.unionByName(_dealt_windows(_with_text(hot, size.n_hot, texts, "inner")))
    if size.n:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size.bytes // SHARD) + 1)
        cold = wanted.where(F.size("list") > 0).select("id", "h", "list")
        cut = _cut_out(_with_text(cold, size.n, texts, "inner"))
        ranges = ranges.unionByName(_sorted_shards(cut, shards))
    ranges = materialise(ranges.distinct() if repeats else ranges, "ranges")
    for x in (counts, found, classes, wanted):
        drop_materialised(x)
    return rows, ranges


def _spans(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the ranges of windows cover."""
    out: list[list[int]] = []
    for a, n in sorted((r["first"], r["windows"]) for r in ranges):
        b = a + n + LENGTH - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merged(ranges: DataFrame) -> DataFrame:
    """(id, h, list of first byte and end): each document's ranges of windows as spans of bytes. The ranges of a document are as many as its contexts at most."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"first": a, "end": b} for a, b in _spans(x)] for x in batch.column("list").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))], names=["id", "h", "list"])

    grouped = ranges.groupBy("id", "h").agg(F.collect_list(F.struct("first", "windows")).alias("list"))
    return map_batches(grouped, each, "id long, h long, list array<struct<first:long,end:long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and kept: the remaining bytes."""
    rows, ranges = repeated_windows(docs, id_col, text_col)
    spans = materialise(_merged(ranges), "spans")
    drop_materialised(ranges)
    n = spans.agg(F.sum(F.size("list")).alias("n")).first().n or 0

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("list").to_pylist(), strict=True):
            raw, found = text.encode(), found or []
            kept = b"".join(raw[a:b] for a, b in zip([0, *(x["end"] for x in found)], [*(x["first"] for x in found), len(raw)], strict=True))
            out.append((len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return map_batches(_with_text(spans, n, rows, "left").select("id", "text", "list"), each, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
