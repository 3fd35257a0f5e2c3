"""Token ids in binary files: one zstandard frame per document, a trailing seek table.

File layout (all numbers little-endian), readable by any zstandard decoder as the documents' ids in
a row:

* one independent frame per document: its ids, each of ``width`` (2 or 4) bytes;
* a skippable frame (magic 0x184D2A50): ``width`` u32, the number of documents u32, then a
  zstandard frame with a validity byte and the i64 id of each document;
* a skippable frame (magic 0x184D2A5E): the seek table of the public seekable format, for each frame
  before it the compressed size, the size and the low 32 bits of XXH64 of the content, then the
  number of frames, the flag byte 0x80 and 0x8F92EAB1.

Writers write under a name of their own for every attempt; only files that the manifest names count,
so lost executors and second attempts leave nothing that a reader would see. Ids are dealt by range,
one file per range, and a file is written as a stream: a task holds one Arrow batch and the table.

Defined results: a null text counts as empty, and an empty text has the end id alone. Documents stand
in ascending order of id, nulls first; equal ids by a hash of the text, then the text. Extra columns
are ignored. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.common import MEMOS, forget, slices, table, words
from turnweave.llm.memo import MemoEncoder
from turnweave.runtime import scratch_path, ship_package

#: Bytes of input for a file, about.
FILE_BYTES = 256 << 20
INDEX_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END_ID = 2


#: Chunks of printable ASCII and Latin letters (what is in none, and how special tokens begin), which the vocabulary's normaliser only lower-cases,
#: and the pieces that its splitter makes of them, as of several chunks with spaces between them.
NOT_PLAIN = re.compile("[^ !-~À-ÖØ-öø-ÿ]|<\\|")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^ a-zß-öø-ÿ0-9]+")


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> MemoEncoder:
    """Encodes texts by their chunks between white space, each distinct chunk once, and plain chunks
    by their pieces in lower case, each distinct piece once.

    Sound for vocabularies whose normaliser and splitter never join or look across ASCII white space,
    and that drop it; ``tests/llm`` holds it against the library over whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    last = np.array([bool(suffix) and (tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(tokenizer.get_vocab_size())])

    def learn(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces as one text, parted by spaces: tokens that end a word tell whose they are, or their places where these don't. A space is a piece without ids."""
        ids, sizes = [], []
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            text, own = " ".join(part), np.fromiter(map(" ".__ne__, part), bool, len(part))
            got = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends, size = np.flatnonzero(last[got]), np.zeros(len(part), np.int64)
            if len(ends) == own.sum():
                size[own] = np.diff(ends, prepend=-1)
            else:
                starts = [a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets]
                size = np.diff(np.searchsorted(starts, np.cumsum([len(p) + 1 for p in part])), prepend=0)
            ids.append(got)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    pieces = MemoEncoder(PIECES.findall, learn, 300_000)

    def encode_new(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = b" ".join(chunks).decode()
        texts = text.split(" ")
        plain, sizes = np.ones(len(texts), bool), np.zeros(len(texts), np.int64)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        plain[np.searchsorted(ends, [x.start() for x in NOT_PLAIN.finditer(text)], "right")] = False
        if not plain.all():
            text = " ".join([t for t, x in zip(texts, plain.tolist(), strict=True) if x])
        found = PIECES.findall(text.lower())
        ids, each = pieces.encode_spans(found)
        if plain.any():  # the pieces up to a space are those of one chunk
            borders = np.fromiter(map(" ".__eq__, found), bool, len(found))
            sizes[plain] = np.diff(np.append(np.cumsum(each)[borders], len(ids)), prepend=0)
        if plain.all():
            return ids, sizes
        others = [x.ids for x in tokenizer.encode_batch_fast([t for t, x in zip(texts, plain.tolist(), strict=True) if not x], add_special_tokens=False)]
        sizes[~plain] = list(map(len, others))
        out, own = np.empty(sizes.sum(), np.uint32), np.repeat(plain, sizes)
        out[own], out[~own] = ids, list(chain.from_iterable(others))
        return out, sizes

    return MemoEncoder(words, encode_new)


def whole_text_encoder(path: str) -> Callable[[list[str]], list[np.ndarray]]:
    """For vocabularies that ``ChunkEncoder`` doesn't suit."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [np.array(x.ids, np.uint32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """Appends documents to a file; ``close`` adds the index and the seek table."""

    def __init__(self, stream, width: int = 2, level: int = 3):
        self.stream, self.width, self.pack = stream, width, zstandard.ZstdCompressor(level=level)
        self.entries, self.docs, self.known, self.n_ids = [], [], bytearray(), 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> (8 * self.width):
            raise ValueError(f"id {int(ids.max())} doesn't fit in {self.width} bytes")
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self.pack.compress(raw)
        self.stream.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.known.append(doc_id is not None)
        self.docs.append(doc_id or 0)
        self.n_ids += len(ids)

    def close(self) -> None:
        index = struct.pack("<II", self.width, len(self.docs)) + self.pack.compress(bytes(self.known) + np.array(self.docs, "<i8").tobytes())
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        entries = np.array([*self.entries, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], "<u4").tobytes()
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.entries) + 1, 0x80, END_MAGIC))
        self.stream.close()


class Reader:
    """Reads a file's table, then only the frames asked for."""

    def __init__(self, stream):
        self.stream, self.unpack = stream, zstandard.ZstdDecompressor()
        size = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != END_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        self.table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        index = self._at(int(self.starts[n - 1]) + 8, int(self.table[n - 1, 0]) - 8)
        self.width, self.n = struct.unpack("<II", index[:8])
        raw = self.unpack.decompress(index[8:])
        self.known, self.docs = np.frombuffer(raw[: self.n], bool), np.frombuffer(raw[self.n :], "<i8")

    def _at(self, start: int, size: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(size)

    def _ids(self, k: int, frame: bytes) -> np.ndarray:
        raw = self.unpack.decompress(frame, max_output_size=int(self.table[k, 1])) if self.table[k, 1] else b""
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: wrong checksum")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document: one seek, one frame."""
        return self._ids(k, self._at(int(self.starts[k]), int(self.table[k, 0])))

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with this id, by binary search."""
        first = int((~self.known).sum())
        ids = self.docs[first:]
        return list(range(first + int(np.searchsorted(ids, doc_id)), first + int(np.searchsorted(ids, doc_id, "right"))))

    def all(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        """All documents in order, read in blocks of whole frames."""
        k = 0
        while k < self.n:
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + block, "right")) - 1)
            end = min(end, self.n)
            data, base = self._at(int(self.starts[k]), int(self.starts[end] - self.starts[k])), int(self.starts[k])
            for j in range(k, end):
                yield self._ids(j, data[int(self.starts[j]) - base : int(self.starts[j + 1]) - base])
            k = end


@dataclass(frozen=True)
class TokenFile:
    part: int
    path: str
    n_docs: int
    n_ids: int
    start: int


def write_token_files(docs: DataFrame, out: str, vocabulary: str, end_id: int = END_ID, width: int | None = None, by_chunk: bool = False, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[TokenFile]:
    """Encode, write one file per range of ids under the folder ``out``, return the manifest in order of ids: a row per file, never per document. Ids are as wide as the vocabulary asks for unless ``width`` says otherwise; ``by_chunk`` is for vocabularies that ``chunk_encoder`` suits. As many files as shuffle partitions, or more where the planner's estimate of the input is over FILE_BYTES for each."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship_package(spark)
    width = width or (2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4)
    if not files:
        estimate = int(docs.select(id_col, text_col)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), estimate // FILE_BYTES if estimate < 1 << 60 else 0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hashed = F.xxhash64("text")
    rows = rows.repartitionByRange(files, "id", hashed).sortWithinPartitions("id", hashed, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(vocabulary).encode_many if by_chunk else whole_text_encoder(vocabulary)
        writer = path = None
        for batch in (part for whole in batches for part in slices(whole)):
            if writer is None:
                store, root = open_store(out)
                store.create_dir(root, recursive=True)
                path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                writer = Writer(store.open_output_stream(f"{root}/{path}", compression=None), width)
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k in range(0, len(ids), 256):
                for doc_id, tokens in zip(ids[k : k + 256], encode(texts.slice(k, 256).to_pylist()), strict=True):
                    writer.add(doc_id, np.append(tokens, np.uint32(end_id)))
        forget()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_ids": pa.array([writer.n_ids], pa.int64())})

    manifest, start = [], 0
    for r in sorted(rows.mapInArrow(write, "part int, path string, n_docs long, n_ids long").collect()):
        manifest.append(TokenFile(r.part, f"{out}/{r.path}", r.n_docs, r.n_ids, start))
        start += r.n_ids
    return manifest


def read_token_files(spark: SparkSession, manifest: list[TokenFile], with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, start, n_tokens, ids_crc32 and, if asked for, ids. A task per file; a file is streamed."""
    ship_package(spark)
    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                store, path = open_store(manifest[k].path)
                with store.open_input_file(path) as stream:
                    reader, at, out, held = Reader(stream), manifest[k].start, [], 0
                    for j, ids in enumerate(reader.all()):
                        out.append((int(reader.docs[j]) if reader.known[j] else None, at, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                        at += len(ids)
                        held += len(ids)
                        if len(out) == 2000 or held > 1 << 22:
                            yield _batch(out, with_ids, id_col)
                            out, held = [], 0
                    if out:
                        yield _batch(out, with_ids, id_col)

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(read, schema)


def _batch(rows: list[tuple], with_ids: bool, id_col: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + ([pa.array(cols[4], pa.list_(pa.int32()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), by_chunk=True)
    return read_token_files(spark, manifest, with_ids=False)
