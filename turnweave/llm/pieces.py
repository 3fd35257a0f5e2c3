"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the lattice of pieces character by character. It keeps the boundaries within
one longest piece of the current place, each with its best path; whenever the paths of all of them
meet in one boundary, everything before it is final: its ids are put out and forgotten.

* ``unigram`` models: the best path has the highest sum of scores (ties: the longer last piece).
* ``bpe`` models: a path is right if each two neighbouring pieces stay as they are when merged anew
  (a sequence is the result of the merges just if that holds for every pair), so each boundary has
  at most one path and the search gives exactly the ids that merging by score gives.

A place between two characters that stand side by side in no piece is a boundary of every path. Texts
are cut there (before spaces, around line ends), and each distinct span is searched once.

Characters without a piece become byte pieces, or the unknown id in models without them. The model's
normaliser must be the identity, with a dummy prefix, as the given vocabulary has it.

Defined results: null gives null ids; an empty text gives no ids. Decoding gives the text back unless
it holds U+2581, which decodes to a space. Ids, null or repeated, are carried through row by row;
extra columns are ignored by ``encode_documents``.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from turnweave.llm.common import MEMOS, map_batches, table
from turnweave.llm.memo import MemoEncoder

SPACE = "▁"
#: Characters of new spans that are cut at once; a longer span is cut alone.
BLOCK = 1 << 20
SPANS = re.compile(r"[ ▁]*[^ ▁\n]+|\n|[ ▁]+")


class _Node:
    """A boundary with its best path: the last piece and the boundary before."""

    __slots__ = ("at", "piece", "parent", "score")

    def __init__(self, at: int, piece: int, parent: "_Node | None", score: float):
        self.at, self.piece, self.parent, self.score = at, piece, parent, score


class PieceModel:
    def __init__(self, path: str, kind: str = "bpe", memo: int = 150_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.kind = kind
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        own = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in own}
        self.longest = max(map(len, self.ids))
        self.prefixes = {p[:k]: -1 for p in self.ids for k in range(1, len(p) + 1)} | self.ids  # -1: no piece itself
        self.trie = self._trie()
        self.neighbours = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._beside = self._neighbour_bits()
        self._byte_of = np.full(n, -1, np.int16)
        self._byte_of[list(self.byte_ids.values())] = list(self.byte_ids)
        self.surface = np.array([" ⁇ " if i == self.unknown else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)], object)
        self._is_special = np.array([model.is_control(i) for i in range(n)])
        self._pairs: dict[int, bool] = {}  # follows from the vocabulary, so it outlasts the tasks
        self._alone: dict[int, bool] = {}
        self._parts: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}
        self.memo_size = memo
        self.memo = MemoEncoder(SPANS.findall, self.encode_spans, memo, keep=True)
        MEMOS.append(self._forget_parts)

    def _trie(self) -> dict[str, tuple]:
        """The pieces by characters: each leads to a piece (-1: none) and the characters that may follow."""
        followers: dict[str, dict] = {"": {}}
        nothing: dict = {}
        longer = {p[:-1] for p in self.prefixes}
        for p in sorted(self.prefixes, key=len):
            own = followers[p] = {} if p in longer else nothing
            followers[p[:-1]][p[-1]] = (self.prefixes[p], own)
        return followers[""]

    # -- merging, for single pieces and pairs of them

    def merge(self, text: str) -> list[str]:
        """The pieces by merging neighbours, the highest score first, from the left among equals."""
        parts = list(text)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (p := self.ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-self.scores[p], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if right[i] != j or parts[i] + parts[j] != joined or not parts[i]:
                continue
            parts[i], parts[j] = joined, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -2
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p]

    def _stays(self, a: int, b: int) -> bool:
        """Whether pieces a and b, a = -1 for none, stay as they are when their text is merged anew."""
        if a < 0:
            if (known := self._alone.get(b)) is None:
                known = self._alone[b] = self.merge(self.pieces[b]) == [self.pieces[b]]
            return known
        key = a * len(self.pieces) + b
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > 2 * self.memo_size:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return known

    # -- the search

    def _short_search(self, text: str) -> tuple[int, ...]:
        """``search`` for merges over so short a run that no ids would be put out before its end: the best path of each boundary as its last piece and the boundary before. As a boundary has one path at most, whichever reaches it first is the best; boundaries are taken from the farthest, and those that the whole run's path doesn't need are left."""
        trie, pairs, stays, count = self.trie, self._pairs, self._stays, len(self.pieces)
        n = len(text)
        last, before = [-2] * (n + 1), [0] * (n + 1)
        last[0] = -1
        ahead: list[tuple[int, int, int]] = []  # a piece, where it ends and begins
        i, a = 0, -1
        while i < n:
            following = trie
            for j, char in enumerate(text[i:] if i else text, i + 1):
                found = following.get(char)
                if found is None:
                    break
                piece, following = found
                if piece >= 0 and last[j] == -2:
                    ahead.append((piece, j, i))
            while ahead:
                piece, i, k = ahead.pop()
                if last[i] == -2:
                    a = last[k]
                    ok = pairs.get(a * count + piece) if a >= 0 else None
                    if stays(a, piece) if ok is None else ok:
                        last[i], before[i] = piece, k
                        break
            else:
                raise ValueError("no path")
        out, j = [], n
        while j:
            out.append(last[j])
            j = before[j]
        return tuple(out[::-1])

    def search(self, text: str) -> Iterator[int]:
        """Ids of a run of characters that all have pieces, as soon as they are final."""
        bpe, longest, prefixes = self.kind == "bpe", self.longest, self.prefixes
        root = _Node(0, -1, None, 0.0)
        live: dict[int, _Node] = {0: root}  # boundaries from the current place to one longest piece ahead
        n = len(text)
        for i in range(n):
            node = live.pop(i, None)
            if node is not None:
                for j in range(i + 1, min(i + longest, n) + 1):
                    piece = prefixes.get(text[i:j])
                    if piece is None:
                        break
                    if piece < 0:
                        continue
                    if bpe:
                        if j not in live and self._stays(node.piece, piece):
                            live[j] = _Node(j, piece, node, 0.0)
                    else:
                        score = node.score + self.scores[piece]
                        if j not in live or score > live[j].score:
                            live[j] = _Node(j, piece, node, score)
            if i % (4 * longest) == 4 * longest - 1 and live:
                meet = self._meet(list(live.values()))
                yield from self._path(root, meet)
                meet.parent = None
                root = meet
        if n not in live:
            raise ValueError("no path")
        yield from self._path(root, live[n])

    @staticmethod
    def _meet(nodes: list[_Node]) -> _Node:
        """The last boundary that all paths share: step back from the farthest until one is left."""
        heap = [(-x.at, k, x) for k, x in enumerate(nodes)]
        heapq.heapify(heap)
        while len({id(x) for _, _, x in heap}) > 1:
            at, k, x = heap[0]
            heapq.heapreplace(heap, (-x.parent.at, k, x.parent))
        return heap[0][2]

    @staticmethod
    def _path(root: _Node, node: _Node) -> list[int]:
        out = []
        while node is not root:
            out.append(node.piece)
            node = node.parent
        return out[::-1]

    def _neighbour_bits(self) -> tuple[np.ndarray, int, np.ndarray]:
        """A number for each character that stands beside another in a piece (0: none), how many numbers there are, and a bit for each two of them: whether they do."""
        chars = sorted({c for two in self.neighbours for c in two})
        number = np.zeros(0x110000, np.int32)
        number[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        bits = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        twos = number[[[ord(c) for c in two] for two in self.neighbours]].reshape(-1, 2)
        bits[twos[:, 0], twos[:, 1]] = True
        return number, len(bits), np.packbits(bits)

    def encode_spans(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans, spaces not yet replaced, in a row, and how many are whose."""
        ends = np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))
        block = ends // BLOCK
        edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(spans)]
        done = [self._encode_block(spans[a:b]) for a, b in zip(edges, edges[1:])]
        return np.concatenate([np.empty(0, np.uint32), *(x for x, _ in done)]), np.concatenate([np.empty(0, np.int64), *(x for _, x in done)])

    def _encode_block(self, spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_spans`` of all spans at once: laid end to end, and cut between them and where no piece can lie across."""
        lengths = np.fromiter(map(len, spans), np.int64, len(spans))
        ends = np.cumsum(lengths)
        text = "".join(spans).replace(" ", SPACE)
        number, count, bits = self._beside
        n = number[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        two = n[:-1].astype(np.int64) * count + n[1:]
        cut = np.ones(len(text) + 1, bool)
        cut[1:-1] = bits[two >> 3] << (two & 7).astype(np.uint8) & 128 == 0
        cut[ends] = True
        cuts = np.flatnonzero(cut)
        at = cuts.tolist()
        found = [self._part(text[a:b]) for a, b in zip(at, at[1:])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), np.add.reduceat(sizes, np.searchsorted(cuts, ends - lengths))

    def encode_span(self, span: str) -> list[int]:
        return self.encode_spans([span])[0].tolist()

    def _part(self, part: str) -> tuple[int, ...]:
        known = self._parts.get(part)
        if known is None:
            known = self._older.get(part)
            if known is None:
                known = self._encode_part(part)
            if len(part) <= 64:
                if len(self._parts) > self.memo_size // 2:  # parts not met since the last time go
                    self._parts, self._older = {}, self._parts
                self._parts[part] = known
        return known

    def _encode_part(self, part: str) -> tuple[int, ...]:
        if len(part) == 1 and part not in self.ids:
            return self._unknown(part)
        return self._short_search(part) if self.kind == "bpe" and len(part) < 4 * self.longest else tuple(self.search(part))

    def _forget_parts(self) -> None:
        self._parts, self._older = {}, {}

    def _unknown(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte_ids[b] for b in char.encode()) if self.byte_ids else (self.unknown,)

    # -- texts

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray | None]:
        got = iter(self.memo.encode_many([f" {t}" for t in texts if t]))
        empty = np.empty(0, np.uint32)
        return [None if t is None else next(got) if t else empty for t in texts]

    def decode(self, ids: np.ndarray | None) -> str | None:
        if ids is None:
            return None
        ids = ids[~self._is_special[ids]]
        parts, values = self.surface[ids], self._byte_of[ids]
        at = np.flatnonzero(values >= 0)
        if len(at):
            raw = values[at].astype(np.uint8).tobytes()
            starts = np.flatnonzero(np.diff(at, prepend=-2) > 1).tolist()  # of runs of byte pieces
            parts[at] = ""
            parts[at[starts]] = [raw[a:b].decode(errors="replace") for a, b in zip(starts, [*starts[1:], len(raw)])]
        text = "".join(parts.tolist())
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str, kind: str = "bpe") -> PieceModel:
    return PieceModel(path, kind)


def encode_documents(docs: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids, n_ids, ids_crc32 (of the ids as little-endian u32) and whether decoding gives the text back."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = piece_model(model, kind)
        texts = batch.column(1).to_pylist()
        ids, same, crc = [], [], []
        for k in range(0, len(texts), 256):
            part = texts[k : k + 256]
            got = m.encode_many(part)
            ids += got
            crc += [None if x is None else zlib.crc32(x.astype("<u4").tobytes()) for x in got]
            same += [m.decode(x) == t for x, t in zip(got, part, strict=True)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([None if x is None else x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())],
            names=[id_col, "ids", "n_ids", "ids_crc32", "round_trip"],
        )

    kind_of = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), each, f"`{id_col}` {kind_of}, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean")


def decode_documents(rows: DataFrame, model: str, kind: str = "bpe", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = piece_model(model, kind)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(None if x is None else np.array(x, np.int64)) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return map_batches(rows.select(id_col, ids_col), each, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_model())
