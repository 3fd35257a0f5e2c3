"""Encoding texts by spans that never influence each other, each distinct span once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import chain, count, islice

import numpy as np

from turnweave.llm.common import MEMOS


def _numbered(kept: list = ()) -> defaultdict:
    """Numbers for spans as they first appear, after those of ``kept``."""
    return defaultdict(count(len(kept)).__next__, zip(kept, range(len(kept))))


class MemoEncoder:
    """``split`` cuts a text into spans, ``encode_new`` encodes spans not met before (their ids one by one, or all ids in a row and how many are whose). At most about ``limit`` spans of ``size`` characters in all are kept: beyond that, and at the end of a task, all are forgotten; with ``keep``, which pays where encoding is slow, the most used outlast a full memo."""

    def __init__(self, split: Callable[[str], list], encode_new: Callable[[list], Iterable | tuple[np.ndarray, np.ndarray]], limit: int = 200_000, size: int = 8 << 20, keep: bool = False):
        self.split, self.encode_new, self.limit, self.size, self.keep = split, encode_new, limit, size, keep
        self.forget()
        MEMOS.append(self.forget)

    def forget(self) -> None:
        self.numbers = _numbered()
        self.ids = np.empty(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.uses = np.empty(0, np.int64)
        self.held = 0

    def _shrink(self) -> None:
        """Keep the spans met again and again, at most half of what may be held; forget the others."""
        spans = list(self.numbers)
        best = np.argsort(-self.uses, kind="stable")[: self.limit // 2]
        best = best[self.uses[best] > 1]
        lengths = np.cumsum([len(spans[k]) for k in best.tolist()])
        best = np.sort(best[: np.searchsorted(lengths, self.size // 2, "right")])
        kept, sizes = [spans[k] for k in best.tolist()], np.diff(self.at)[best]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.at[best] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        uses = self.uses[best] >> 1
        self.forget()
        self.numbers = _numbered(kept)
        self.ids, self.at, self.uses, self.held = ids, np.append(0, ends), uses, sum(map(len, kept))

    def _learn(self) -> None:
        if new := list(islice(self.numbers, len(self.at) - 1, None)):
            got = self.encode_new(new)
            if not isinstance(got, tuple):  # the ids of each span: laid end to end
                got = list(got)
                sizes = list(map(len, got))
                got = np.fromiter(chain.from_iterable(got), np.uint32, sum(sizes)), np.array(sizes, np.int64)
            self.ids = np.concatenate([self.ids, got[0]])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(got[1])])
            self.held += sum(map(len, new))

    def _make_room(self) -> None:
        if len(self.numbers) > self.limit or self.held > self.size:
            self._shrink() if self.keep else self.forget()

    def _ids_of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans of these numbers in a row, and how many are whose."""
        sizes = self.at[n + 1] - self.at[n]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.at[n] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode_spans(self, spans: list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the spans in a row, and how many are whose."""
        self._make_room()
        n = np.fromiter(map(self.numbers.__getitem__, spans), np.int64, len(spans))
        self._learn()
        return self._ids_of(n)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        self._make_room()
        numbers = []
        for text in texts:
            spans = self.split(text)
            numbers.append(np.fromiter(map(self.numbers.__getitem__, spans), np.int64, len(spans)))
        self._learn()
        if self.keep and numbers:
            met = np.bincount(np.concatenate(numbers), minlength=len(self.numbers))
            met[: len(self.uses)] += self.uses
            self.uses = met
        return [self._ids_of(n)[0] for n in numbers]
