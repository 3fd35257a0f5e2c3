"""Token counts that follow edits.

A document is held as a segment tree over its pre-tokens: blocks of at most ``BLOCK`` pre-tokens with
their lengths and token counts are the leaves, and each inner node has the sums of its subtree. An
edit descends to the blocks that it touches, splits and encodes only the text from a little before it
(a pre-token looks at most three characters ahead) up to the first old border after it where old and
new splits meet again (from a border on, the split depends on what follows alone), and renews the
sums on the way up. What stays is never encoded again.

``count_tokens`` builds the trees and edits them in one pass. ``build_trees`` writes them out as a table,
a row for each leaf, and ``edit_trees`` applies a table of edits to stored trees: only the trees of
edited documents are read into a task, and only what an edit touches is split and encoded again.

Counts are those of byte-level BPE with the given vocabulary, special strings taken as ordinary text.

Defined results: a null text counts as empty, with no tokens; ids, null or repeated, are carried
through row by row; extra columns are ignored; texts of any length are held whole, one at a time; edits (start, end, text) are in code points, may touch
but not overlap, and are taken from the last to the first; null edits are none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.llm.common import MEMOS, map_batches, table
from turnweave.runtime import materialise

BLOCK = 256
LOOK_AHEAD = 3


class PreTokens:
    """Splits texts and counts the tokens of pre-tokens, each distinct one once (at most about ``limit`` are kept)."""

    def __init__(self, vocabulary: str, pattern: str, limit: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(pattern).findall
        self.find = regex.compile(pattern).finditer
        self.known: dict[str, int] = {}
        self.limit = limit
        MEMOS.append(self.known.clear)

    def learn(self, parts: Iterable[str]) -> None:
        if len(self.known) > self.limit:
            self.known.clear()
        if new := list(set(parts).difference(self.known)):
            self.known.update(zip(new, (len(x) for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))

    def counts(self, parts: list[str]) -> list[int]:
        try:
            return list(map(self.known.__getitem__, parts))
        except KeyError:
            self.learn(parts)
            return list(map(self.known.__getitem__, parts))


class _Block:
    __slots__ = ("text", "sizes", "counts")

    def __init__(self, text: str, sizes: list[int], counts: list[int]):
        self.text, self.sizes, self.counts = text, sizes, counts


class TokenTree:
    """The tree of one document. ``encoded`` is the number of pre-tokens encoded since it was built."""

    def __init__(self, pre: PreTokens, text: str | None):
        self.pre, self.encoded = pre, 0
        self._plant(self._blocks(pre.split(text or "")))

    @classmethod
    def of_blocks(cls, pre: PreTokens, blocks: list[_Block]) -> "TokenTree":
        """A stored tree: nothing is split or encoded."""
        tree = cls.__new__(cls)
        tree.pre, tree.encoded = pre, 0
        tree._plant(blocks)
        return tree

    def _blocks(self, parts: list[str]) -> list[_Block]:
        counts = self.pre.counts(parts)
        return [_Block("".join(p := parts[k : k + BLOCK]), list(map(len, p)), counts[k : k + BLOCK]) for k in range(0, len(parts), BLOCK)]

    def _plant(self, blocks: list[_Block]) -> None:
        self.blocks = blocks
        self.width = 1 << max(0, len(blocks) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, b in enumerate(blocks):
            self.chars[self.width + k], self.tokens[self.width + k] = len(b.text), sum(b.counts)
        for k in range(self.width - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def _renew(self, k: int) -> None:
        """Sums from block k up to the root."""
        b, node = self.blocks[k], self.width + k
        self.chars[node], self.tokens[node] = len(b.text), sum(b.counts)
        while node := node >> 1:
            self._sum(node)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(b.text for b in self.blocks)

    def _locate(self, at: int) -> tuple[int, int]:
        """The block that holds a character, and where the block starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if start + self.chars[node] <= at and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.width, len(self.blocks) - 1), start

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace characters start to end by ``text``."""
        if not self.blocks:
            self._plant(self._blocks(parts := self.pre.split(text)))
            self.encoded += len(parts)
            return
        back = max(0, start - LOOK_AHEAD - 1)
        first, base = self._locate(back)
        last, last_base = self._locate(max(start, end - 1))
        # the border from which the text is split again: the last one at or before what looks ahead into the edit
        ends = [0, *accumulate(self.blocks[first].sizes)]
        k = max(0, bisect_right(ends, back - base) - 1)
        k = max(0, k - 1)
        begin = base + ends[k]
        old, held_base = [], base  # old borders at or after the end of the edit
        held, j = [], first
        at, more = base, 1
        while j < len(self.blocks):
            held.append(self.blocks[j].text)
            for size in self.blocks[j].sizes:
                if at >= end:
                    old.append(at)
                at += size
            j += 1
            # twice as many blocks each time, so that splits that meet late are tried a few times only
            if j > last and (j - last >= more or j == len(self.blocks)):
                more *= 2
                done = self._resplit("".join(held), begin - held_base, start - held_base, end - held_base, text, [x - held_base for x in old], j == len(self.blocks), at - held_base)
                if done:
                    break
        parts, resumed = done
        self.encoded += len(parts)
        head = self.blocks[first]
        sizes, counts = head.sizes[:k], head.counts[:k]
        new = self.pre.counts(parts)
        body = "".join(held)[: begin - held_base] + "".join(parts)
        sizes, counts = sizes + list(map(len, parts)), counts + new
        at = held_base
        for b in self.blocks[first:j]:
            for size, count in zip(b.sizes, b.counts, strict=True):
                if at - held_base >= resumed:
                    sizes.append(size)
                    counts.append(count)
                at += size
        body += "".join(held)[resumed:]
        if j - first == 1 and 0 < len(sizes) <= 2 * BLOCK:
            self.blocks[first] = _Block(body, sizes, counts)
            self._renew(first)
            return
        fresh, place = [], 0
        n = j - first
        fits = n <= len(sizes) <= 2 * BLOCK * n  # as many leaves as before
        borders = [len(sizes) * k // n for k in range(n + 1)] if fits else [*range(0, len(sizes), BLOCK), len(sizes)]
        for i, i_end in zip(borders, borders[1:]):
            size = sum(sizes[i:i_end])
            fresh.append(_Block(body[place : place + size], sizes[i:i_end], counts[i:i_end]))
            place += size
        if fits:
            self.blocks[first:j] = fresh
            for k in range(first, j):
                self._renew(k)
            return
        self._plant(self.blocks[:first] + fresh + self.blocks[j:])

    def _resplit(self, held: str, begin: int, start: int, end: int, text: str, old: list[int], is_end: bool, size: int) -> tuple[list[str], int] | None:
        """Pre-tokens from ``begin`` until a new border meets an old one after the edit, and where it lies in the old text; None if more text is needed."""
        new = held[:start] + text + held[end:]
        shift = start + len(text) - end
        borders, parts = set(old), []
        safe = len(new) if is_end else len(new) - LOOK_AHEAD - 1
        for m in self.pre.find(new, begin):
            if m.end() > safe:
                return None
            parts.append(m.group())
            if m.end() - shift in borders and m.end() >= start + len(text):
                return parts, m.end() - shift
        return (parts, size) if is_end else None


@lru_cache(maxsize=2)
def pre_tokens(vocabulary: str, pattern: str) -> PreTokens:
    return PreTokens(vocabulary, pattern)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits: str | Callable[[str], list[dict]] | None = None) -> DataFrame:
    """Per row: id, n_pretokens, n_tokens and, after the edits (a column of arrays of start, end, text, or what a function makes of the text), n_edits, n_tokens_after, n_encoded: how many pre-tokens the edits made it encode."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pre = pre_tokens(vocabulary, pattern)
        texts = batch.column(1).to_pylist()
        changed = batch.column(2).to_pylist() if isinstance(edits, str) else [edits(t) if edits and t else None for t in texts]
        rows = []
        for text, changes in zip(texts, changed, strict=True):
            tree = TokenTree(pre, text)
            row = [sum(len(b.sizes) for b in tree.blocks), tree.n_tokens, len(changes or [])]
            for c in sorted(changes or [], key=lambda c: (c["start"], c["end"]), reverse=True):
                tree.edit(c["start"], c["end"], c["text"])
            rows.append((*row, tree.n_tokens, tree.encoded))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=[id_col, "n_pretokens", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"])

    cols = [F.col(id_col), F.col(text_col), *([F.col(edits)] if isinstance(edits, str) else [])]
    return map_batches(docs.select(*cols), each, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_pretokens long, n_tokens long, n_edits long, n_tokens_after long, n_encoded long")


TREE = "row long, block int, n_chars long, n_tokens long, text string, sizes array<int>, counts array<int>"


def _leaves(tree: TokenTree) -> list[tuple]:
    return [(k, len(b.text), sum(b.counts), b.text, b.sizes, b.counts) for k, b in enumerate(tree.blocks or [_Block("", [], [])])]


def build_trees(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each leaf: id, row (a hash of the text, which tells rows of one id apart), block, n_chars, n_tokens, text, sizes and counts of its pre-tokens. An empty text has one empty leaf; rows that share id and text give their leaves each."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("row"), F.col(text_col))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pre = pre_tokens(vocabulary, pattern)
        at, out = [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            leaves = _leaves(TokenTree(pre, text))
            at += [k] * len(leaves)
            out += leaves
        take = pa.array(at, pa.int64())
        block, chars, tokens, texts, sizes, counts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(block, pa.int32()), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            names=[id_col, "row", "block", "n_chars", "n_tokens", "text", "sizes", "counts"],
        )

    return map_batches(rows, each, f"`{id_col}` {kind}, {TREE}")


def tree_counts(trees: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document's row: id, row, n_chars, n_tokens, from the leaves' sums alone."""
    return trees.groupBy(id_col, "row").agg(F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Trees of distinct documents' rows after a table of edits (id, start, end, text), and of each edited row its id, row, n_tokens, n_edits, n_encoded. Trees without edits pass by unread; edits without a tree are ignored. Edits are as in ``count_tokens`` and hold for all rows of their id."""
    kind = trees.schema[id_col].dataType.simpleString()
    per_id = edits.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "text")).alias("edits"))
    whole = trees.dropDuplicates([id_col, "row", "block"])
    leaf = F.struct("block", "text", "sizes", "counts")
    touched = whole.join(per_id.select(id_col), id_col, "left_semi").groupBy(id_col, "row").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))
    rows = touched.join(per_id, id_col).select(id_col, "row", "leaves", "edits")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pre = pre_tokens(vocabulary, pattern)
        at, out, told = [], [], []
        for k, (leaves, changes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            tree = TokenTree.of_blocks(pre, [_Block(x["text"], x["sizes"], x["counts"]) for x in leaves if x["sizes"]])
            for c in sorted(changes, key=lambda c: (c["start"], c["end"]), reverse=True):
                tree.edit(c["start"], c["end"], c["text"])
            new = _leaves(tree)
            at += [k] * len(new)
            out += new
            told += [(tree.n_tokens, len(changes), tree.encoded)] * len(new)
        take = pa.array(at, pa.int64())
        block, chars, tokens, texts, sizes, counts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(block, pa.int32()), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), *(pa.array(c, pa.int64()) for c in zip(*told, strict=True))],
            names=[id_col, "row", "block", "n_chars", "n_tokens", "text", "sizes", "counts", "all_tokens", "n_edits", "n_encoded"],
        )

    done = materialise(map_batches(rows, each, f"`{id_col}` {kind}, {TREE}, all_tokens long, n_edits long, n_encoded long"), "trees")
    summary = done.where("block = 0").select(id_col, "row", F.col("all_tokens").alias("n_tokens"), "n_edits", "n_encoded")
    rest = whole.join(per_id.select(id_col), id_col, "left_anti")
    return rest.unionByName(done.drop("all_tokens", "n_edits", "n_encoded")), summary


def digit_edits(text: str) -> list[dict]:
    """Edits that write every run of digits as 0."""
    return [{"start": m.start(), "end": m.end(), "text": "0"} for m in re.finditer("[0-9]+", text)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, edits=digit_edits)
