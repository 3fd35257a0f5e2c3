"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from turnweave.runtime import ship_package

#: Words of the contracts: runs of bytes other than these six.
WHITE = " \t\n\v\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text: ``bytes.split`` cuts at just these six bytes."""
    return text.encode().split()


def lower_ascii(text: str) -> bytes:
    """The text's bytes with A-Z lower-cased: ``bytes.lower`` leaves all other bytes alone."""
    return text.encode().lower()


_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes(dict):
    """64-bit hashes of words. At most ``limit`` words of up to 40 bytes are kept; beyond that all are forgotten."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit
        MEMOS.append(self.clear)

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h


#: What a task calls at its end, so that a reused Python worker keeps nothing from one stage to the next.
MEMOS: list[Callable[[], None]] = []
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE.encode())] = True
_PRIME, _SMALL = (1 << 31) - 1, 0x2545F491
#: Bytes whose words are hashed at once; a longer word is hashed alone.
PIECE = 1 << 20
_MODULAR = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _modular_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo a prime of 31 bits."""
    if len(_MODULAR[0]) < n:
        size = 1 << max(16, n.bit_length())
        for k, x in enumerate((_SMALL, pow(_SMALL, -1, _PRIME))):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:  # twice as many each time
                out[done : 2 * done] = out[:done] * np.uint64(pow(x, done, _PRIME)) % np.uint64(_PRIME)
                done *= 2
            _MODULAR[k] = out
    return _MODULAR[0][:n], _MODULAR[1][:n]


def _piece_hashes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    white = _IS_WHITE[b]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    wide = b.astype(np.uint64) + np.uint64(1)
    up, down = powers(len(b))
    sums = np.cumsum(wide * up)
    h = (sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64)
    up, down = _modular_powers(len(b))
    sums = np.cumsum(wide * up)  # below 2**39 each, so that a piece's sum fits
    small = (sums[ends - 1] - sums[starts - 1]) % np.uint64(_PRIME) * down[starts] % np.uint64(_PRIME)
    h = (h ^ (small << np.uint64(33)) ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + small
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, without a loop over words: polynomials over the bytes modulo 2**64 and modulo a prime, from running sums. Some words (Thue-Morse strings) have the same polynomial modulo any power of two; the prime tells these apart."""
    if len(raw) <= PIECE:
        return _piece_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            cut = max(raw.rfind(bytes([w]), at, end) for w in WHITE.encode()) + 1
            if cut <= at:  # a word longer than a piece
                end = min((k for w in WHITE.encode() if (k := raw.find(bytes([w]), at)) >= 0), default=len(raw))
                out.append(np.array([xxhash.xxh3_64_intdigest(raw[at:end])], np.uint64))
                at = end
                continue
            end = cut
        out.append(_piece_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


#: Bytes of a slice of a batch; a single larger row is a slice of its own.
SLICE = 4 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes."""
    if batch.num_rows < 2 or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def forget() -> None:
    for f in MEMOS:
        f()
    pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``each`` to slices of the rows' Arrow batches, so that memory follows ``SLICE`` (or the longest row), not the number of rows that Spark puts in a batch."""
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get(BATCH_ROWS)) > 1000:  # Spark's buffers hold whole batches, on both sides
        spark.conf.set(BATCH_ROWS, "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch):
                    yield each(part)
        finally:
            forget()

    return df.mapInArrow(run, schema)
