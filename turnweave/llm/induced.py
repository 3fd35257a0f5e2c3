"""External induced sorting of suffixes with common-prefix values.

The suffixes that begin a rising run (LMS suffixes) are put in order first: their substrings are
ordered by one induction and named, and the string of names, half the text or less, is sorted by the
same means in turn, until all names differ or the string fits in what is left of the memory. Two inductions then give the order of all suffixes:
larger-to-follow suffixes from the left, smaller-to-follow ones from the right.

Each induction runs over a priority queue: the entries of a character lie one after the other, first
in, first out, and the characters in order, in arrays of a ``Store``. An entry is a tuple: the place of
the suffix, the common prefix with the entry before, the length of its run of equal characters, and
the characters before it, packed (four of 16 bits or two of 32). A suffix popped pushes the suffix one
character longer under the first of these; whether that one belongs to this induction follows from
the two characters alone, so the text is read only for the tuple of an LMS suffix and where the packed
characters are used up. The common prefix pushed is the least value met since the queue's last entry,
plus one.

A store's arrays are in memory up to ``memory`` bytes, beyond that mapped from unnamed files of the
task's temporary folder, which are scratch of this one task and end with it; text, tuples, names and
orders all lie there, and work goes in blocks of ``BLOCK`` entries. Queues of characters with few
entries, as strings of names have them, are popped several at a time, as long as none pushes into
another of these. Common prefixes are followed up to ``cap`` characters (at most 254), and so is the
order: suffixes with that much in common may stand in either order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
#: Bytes that sorting a string of names in memory takes for each of them. A string that doesn't fit is sorted by induction again.
HELD = 64


class Store:
    """Arrays in memory while they fit, else in files."""

    def __init__(self, memory: int, folder: str | None = None):
        self.left, self.folder, self.spilled = memory, folder, 0

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(n, dtype)
        self.spilled += size
        with tempfile.TemporaryFile(dir=self.folder) as f:
            f.truncate(size)
            return np.memmap(f, dtype, "r+", shape=(n,))

    def free(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if not isinstance(a, np.memmap):
                self.left += a.nbytes


class _Text:
    """Characters, and what the tuples hold of them."""

    def __init__(self, t: np.ndarray):
        self.t, self.n = t, len(t)
        self.top = 1 + max(int(t[a : a + BLOCK].max()) for a in range(0, len(t), BLOCK))
        self.bits, self.most = (16, 4) if self.top <= 1 << 16 else (32, 2)
        self.mask = np.uint64((1 << self.bits) - 1)

    def before(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters before each place, the nearest in the low bits, and how many there are."""
        packed = np.zeros(len(pos), np.uint64)
        for j in range(min(self.most, self.n)):
            at = pos - 1 - j
            packed |= np.where(at >= 0, self.t[np.maximum(at, 0)].astype(np.uint64), np.uint64(0)) << np.uint64(j * self.bits)
        return packed, np.minimum(pos, self.most).astype(np.uint8)


class Tuples:
    """Columns of entries: place, common prefix, run, characters before, their number."""

    KINDS = (np.int64, np.uint8, np.uint8, np.uint64, np.uint8)

    def __init__(self, store: Store, n: int):
        self.store = store
        self.columns = [store.array(n, k) for k in self.KINDS]

    def free(self) -> None:
        self.store.free(*self.columns)

    def get(self, at) -> list[np.ndarray]:
        return [np.asarray(c[at]) for c in self.columns]

    def put(self, at, values) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c[at] = v


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Of the suffixes at a and at b, pair by pair, up to ``cap``."""
    out = np.zeros(len(a), np.uint8)
    alive = np.arange(len(a))
    n = len(t)
    for k in range(cap):
        x, y = a[alive] + k, b[alive] + k
        same = (x < n) & (y < n)
        same[same] = t[x[same]] == t[y[same]]
        alive = alive[same]
        if not len(alive):
            break
        out[alive] = k + 1
    return out


class _Carry:
    """Least value since the last entry of each queue."""

    def __init__(self, n: int):
        self.least = np.zeros(n, np.uint8)

    def take(self, values: np.ndarray, at: np.ndarray, target: np.ndarray, cap: int) -> np.ndarray:
        """For entries from places ``at`` (ascending) of a block with ``values`` to queues ``target``: one more than the least value since each queue's last entry."""
        first = np.minimum.accumulate(values)
        if not len(at):
            np.minimum(self.least, first[-1], out=self.least)
            return np.empty(0, np.uint8)
        order = np.argsort(target, kind="stable")
        t, q = target[order], at[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        got = np.empty(len(t), np.uint8)
        got[new] = np.minimum(self.least[t[new]], first[q[new]])
        later = np.flatnonzero(~new)
        if len(later):
            lo, hi = q[later - 1] + 1, q[later]
            level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1  # floor of the binary logarithm
            table, ans = values, np.empty(len(later), np.uint8)
            for k in range(int(level.max()) + 1):
                if k:
                    table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
                m = level == k
                ans[m] = np.minimum(table[lo[m]], table[hi[m] - (1 << k) + 1])
            got[later] = ans
        rest = np.append(np.minimum.accumulate(values[::-1])[::-1], np.uint8(255))
        last = np.ones(len(t), bool)
        last[:-1] = new[1:]
        np.minimum(self.least, first[-1], out=self.least)
        self.least[t[last]] = rest[q[last] + 1]
        out = np.empty(len(t), np.uint8)
        out[order] = np.minimum(got, cap - 1) + 1
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class _Scan:
    """One pass from the right: the LMS places in order, and how many suffixes of both types each character begins."""

    def __init__(self, text: _Text, store: Store, cap: int):
        t, n = text.t, text.n
        self.larger, self.smaller = np.zeros(text.top, np.int64), np.zeros(text.top, np.int64)
        place, run = store.array(n // 2 + 1, np.int64), store.array(n // 2 + 1, np.uint8)
        free, after, after_run, waiting = len(place), False, 0, None
        for b in range(n, 0, -BLOCK):
            a = max(0, b - BLOCK)
            x = np.asarray(t[a : min(b + 1, n)]).astype(np.int64)
            step = np.zeros(b - a + 1, np.int8)
            step[: len(x) - 1] = np.sign(np.diff(x))
            if b == n:
                step[b - a - 1] = -1
            step[b - a] = 1 if after else -1
            known = np.flatnonzero(step)
            small = step[known[np.searchsorted(known, np.arange(b - a))]] > 0
            x = x[: b - a]
            ends = np.flatnonzero(np.append(x[1:] != x[:-1], True))
            length = ends[np.searchsorted(ends, np.arange(b - a))] - np.arange(b - a) + 1
            if b < n and x[-1] == t[b]:
                length[ends[-2] + 1 if len(ends) > 1 else 0 :] += after_run
            self.larger += np.bincount(x[~small], minlength=text.top)
            self.smaller += np.bincount(x[small], minlength=text.top)
            lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
            found, runs = lms + a, np.minimum(length[lms], cap)
            if waiting is not None and not small[-1]:
                found, runs = np.append(found, b), np.append(runs, waiting)
            free -= len(found)
            place[free : free + len(found)], run[free : free + len(found)] = found, runs
            waiting = min(int(length[0]), cap) if small[0] else None
            after, after_run = bool(small[0]), min(int(length[0]), cap)
        self.place, self.run, self.held = place[free:], run[free:], (place, run)


class _Induction:
    """The two passes over the tuples of the LMS suffixes, which stand in order of their first characters."""

    def __init__(self, text: _Text, scan: _Scan, store: Store, cap: int):
        self.text, self.cap, self.store = text, cap, store
        self.larger, self.smaller = Tuples(store, int(scan.larger.sum())), Tuples(store, int(scan.smaller.sum()))
        self.begin_l, self.begin_s = (np.cumsum(c) - c for c in (scan.larger, scan.smaller))
        self.end_l, self.end_s = self.begin_l.copy(), self.begin_s.copy()

    def free(self) -> None:
        self.larger.free()
        self.smaller.free()

    def _push(self, char: np.ndarray, entries: list[np.ndarray], from_smaller: np.ndarray | bool, rising: bool, carry: _Carry, limit: int | None = None) -> int | None:
        """Push what the entries, in order, lead to. With a ``limit`` (the last of several queues) those are left that come after the first queue into which one of them leads, and this queue is returned."""
        pos, values, run, packed, known = entries
        empty = np.flatnonzero((known == 0) & (pos > 0))
        if len(empty):
            packed, known = packed.copy(), known.copy()
            packed[empty], known[empty] = self.text.before(pos[empty])
        target = (packed & self.text.mask).astype(np.int64)
        want = (target >= char) if rising else np.where(from_smaller, target <= char, target < char)
        at = np.flatnonzero(want & (pos > 0))
        goal = target[at]
        met = None
        if limit is not None and len(inside := goal[goal <= limit if rising else goal >= limit]):
            met = int(inside.min() if rising else inside.max())
            n = int(np.searchsorted(char if rising else -char, met if rising else -met))
            if not n:
                return met
            values, at = values[:n], at[: np.searchsorted(at, n)]
            goal = target[at]
        got = carry.take(values, at, goal, self.cap)
        order = np.argsort(goal, kind="stable")
        at, goal, got = at[order], goal[order], got[order]
        into, end = (self.larger, self.end_l) if rising else (self.smaller, self.end_s)
        queues, first, sizes = np.unique(goal, return_index=True, return_counts=True)
        where = np.repeat(end[queues] - first, sizes) + np.arange(len(goal))
        longer = np.where(goal == char[at], np.minimum(run[at], self.cap - 1) + 1, 1).astype(np.uint8)
        into.put(where, (pos[at] - 1, got, longer, packed[at] >> np.uint64(self.text.bits), known[at] - 1))
        end[queues] += sizes
        return met

    def rise(self, seeds: Tuples, edges: np.ndarray) -> None:
        """From the left: all larger-to-follow suffixes."""
        carry, top = _Carry(self.text.top), self.text.top
        end = np.array([self.text.n], np.int64)
        self._push(np.array([-1]), [end, np.zeros(1, np.uint8), np.zeros(1, np.uint8), *self.text.before(end)], False, True, carry)
        c, wide = 0, 64
        while c < top:
            stop = min(top, c + wide)
            load = np.cumsum(self.end_l[c:stop] - self.begin_l[c:stop] + edges[c + 1 : stop + 1] - edges[c:stop])
            stop = c + max(1, int(np.searchsorted(load, BLOCK, "right")))
            if stop > c + 1:
                met = self._rise_some(c, stop, seeds, edges, carry)
                if met is None:
                    c, wide = stop, min(2 * wide, 4096)
                    continue
                wide, c = max(2, 2 * (met - c)), met
            self._rise_one(c, seeds, edges, carry)
            c += 1

    def _rise_some(self, c: int, stop: int, seeds: Tuples, edges: np.ndarray, carry: _Carry) -> int | None:
        n_l, n_s = self.end_l[c:stop] - self.begin_l[c:stop], np.diff(edges[c : stop + 1])
        at = _ranges(self.begin_l[c:stop], n_l)
        entries = [np.concatenate(x) for x in zip(self.larger.get(at), seeds.get(slice(edges[c], edges[stop])), strict=True)]
        if not len(entries[0]):
            return None
        char = np.concatenate([np.repeat(np.arange(c, stop), n_l), np.repeat(np.arange(c, stop), n_s)])
        ends_l, ends_s = np.cumsum(n_l), np.cumsum(n_s)
        has_l, has_s = n_l > 0, n_s > 0
        values, run = entries[1], entries[2]
        values[(ends_l - n_l)[has_l]] = 0
        first = len(at) + (ends_s - n_s)[has_s]
        values[first] = np.where(has_l[has_s], np.minimum(run[np.maximum(ends_l - 1, 0)][has_s], run[first]), 0)
        order = np.argsort(2 * char + (np.arange(len(char)) >= len(at)), kind="stable")
        return self._push(char[order], [x[order] for x in entries], False, True, carry, stop - 1)

    def _rise_one(self, c: int, seeds: Tuples, edges: np.ndarray, carry: _Carry) -> None:
        read = self.begin_l[c]
        while read < self.end_l[c]:
            stop = min(self.end_l[c], read + BLOCK)
            entries = self.larger.get(slice(read, stop))
            if read == self.begin_l[c]:
                entries[1] = np.concatenate([[np.uint8(0)], entries[1][1:]])
            self._push(np.full(stop - read, c), entries, False, True, carry)
            read = stop
        for a in range(edges[c], edges[c + 1], BLOCK):
            b = min(a + BLOCK, edges[c + 1])
            entries = seeds.get(slice(a, b))
            if a == edges[c]:
                border = min(self.larger.columns[2][read - 1], entries[2][0]) if read > self.begin_l[c] else 0
                entries[1] = np.concatenate([[np.uint8(border)], entries[1][1:]])
            self._push(np.full(b - a, c), entries, False, True, carry)

    def fall(self) -> None:
        """From the right: all smaller-to-follow suffixes, each queue from its highest entry down. Values are then those with the entry above."""
        carry = _Carry(self.text.top)
        c, wide = self.text.top, 64  # queues below c are left
        while c > 0:
            low = max(0, c - wide)
            load = np.cumsum((self.end_s[low:c] - self.begin_s[low:c] + self.end_l[low:c] - self.begin_l[low:c])[::-1])
            low = c - max(1, int(np.searchsorted(load, BLOCK, "right")))
            if low < c - 1:
                met = self._fall_some(low, c, carry)
                if met is None:
                    c, wide = low, min(2 * wide, 4096)
                    continue
                wide, c = max(2, 2 * (c - 1 - met)), met + 1
            self._fall_one(c - 1, carry)
            c -= 1

    def _fall_some(self, low: int, c: int, carry: _Carry) -> int | None:
        queues = np.arange(c - 1, low - 1, -1)
        n_s, n_l = (self.end_s - self.begin_s)[queues], (self.end_l - self.begin_l)[queues]
        at_s = _ranges(self.begin_s[queues], n_s)
        at_l = _ranges(self.end_l[queues] - n_l, n_l)
        ends_l, ends_s = np.cumsum(n_l), np.cumsum(n_s)
        # each queue's larger entries from the last to the first
        at_l = at_l[np.repeat(2 * ends_l - n_l - 1, n_l) - np.arange(len(at_l))] if len(at_l) else at_l
        smaller, larger = self.smaller.get(at_s), self.larger.get(at_l)
        if not len(at_s) + len(at_l):
            return None
        has_l, has_s = n_l > 0, n_s > 0
        smaller[1][(ends_s - n_s)[has_s]] = 0
        values = np.concatenate([[np.uint8(0)], larger[1][:-1]]) if len(at_l) else larger[1]
        first = (ends_l - n_l)[has_l]
        if len(first):
            lowest = smaller[2][np.maximum(ends_s - 1, 0)][has_l] if len(at_s) else np.zeros(len(first), np.uint8)
            values[first] = np.where(has_s[has_l], np.minimum(lowest, larger[2][first]), 0)
        larger[1] = values
        entries = [np.concatenate(x) for x in zip(smaller, larger, strict=True)]
        char = np.concatenate([np.repeat(queues, n_s), np.repeat(queues, n_l)])
        of_larger = np.arange(len(char)) >= len(at_s)
        order = np.argsort(2 * (c - 1 - char) + of_larger, kind="stable")
        return self._push(char[order], [x[order] for x in entries], ~of_larger[order], False, carry, low)

    def _fall_one(self, c: int, carry: _Carry) -> None:
        read = self.begin_s[c]
        while read < self.end_s[c]:
            stop = min(self.end_s[c], read + BLOCK)
            entries = self.smaller.get(slice(read, stop))
            if read == self.begin_s[c]:
                entries[1] = np.concatenate([[np.uint8(0)], entries[1][1:]])
            self._push(np.full(stop - read, c), entries, True, False, carry)
            read = stop
        above = self.end_l[c]
        while above > self.begin_l[c]:
            a = max(self.begin_l[c], above - BLOCK)
            entries = [x[::-1] for x in self.larger.get(slice(a, above))]
            if above < self.end_l[c]:
                border = self.larger.columns[1][above]
            else:
                border = min(self.smaller.columns[2][read - 1], entries[2][0]) if read > self.begin_s[c] else 0
            entries[1] = np.concatenate([[np.uint8(border)], entries[1][:-1]])
            self._push(np.full(above - a, c), entries, False, False, carry)
            above = a

    def ordered(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(whether smaller-to-follow, places, common prefixes with the suffix before), ascending, in blocks."""
        c = 0
        while c < self.text.top:
            load = np.cumsum(self.end_l[c : c + BLOCK] - self.begin_l[c : c + BLOCK] + self.end_s[c : c + BLOCK] - self.begin_s[c : c + BLOCK])
            stop = c + max(1, int(np.searchsorted(load, BLOCK, "right")))
            yield from self._some(c, stop) if load[stop - c - 1] <= BLOCK else self._one(c)
            c = stop

    def _some(self, c: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n_l, n_s = (self.end_l - self.begin_l)[c:stop], (self.end_s - self.begin_s)[c:stop]
        ends_l, ends_s = np.cumsum(n_l), np.cumsum(n_s)
        at_l, at_s = _ranges(self.begin_l[c:stop], n_l), _ranges(self.begin_s[c:stop], n_s)
        if not len(at_l) + len(at_s):
            return
        larger = [np.asarray(x[at_l]) for x in self.larger.columns[:3]]
        larger[1][(ends_l - n_l)[n_l > 0]] = 0
        if len(at_s):
            at_s = at_s[np.repeat(2 * ends_s - n_s - 1, n_s) - np.arange(len(at_s))]
        smaller = [np.asarray(x[at_s]) for x in self.smaller.columns[:3]]
        # an entry's own value is that with the one above, which the next of the ascending order has
        values = np.concatenate([[np.uint8(0)], smaller[1][:-1]]) if len(at_s) else smaller[1]
        has = n_s > 0
        first = (ends_s - n_s)[has]
        if len(first):
            highest = larger[2][np.maximum(ends_l - 1, 0)][has] if len(at_l) else np.zeros(len(first), np.uint8)
            values[first] = np.where(n_l[has] > 0, np.minimum(highest, smaller[2][first]), 0)
        queues = np.arange(c, stop)
        order = np.argsort(np.concatenate([2 * np.repeat(queues, n_l), 2 * np.repeat(queues, n_s) + 1]), kind="stable")
        yield order >= len(at_l), np.concatenate([larger[0], smaller[0]])[order], np.concatenate([larger[1], values])[order]

    def _one(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b, s, e = self.begin_l[c], self.end_l[c], self.begin_s[c], self.end_s[c]
        for k in range(a, b, BLOCK):
            pos, values = (np.asarray(x[k : min(b, k + BLOCK)]) for x in self.larger.columns[:2])
            yield np.zeros(len(pos), bool), pos, values if k > a else np.concatenate([[np.uint8(0)], values[1:]])
        while e > s:
            k = max(s, e - BLOCK)
            pos, values = (np.asarray(x[k:e])[::-1] for x in self.smaller.columns[:2])
            if e < self.end_s[c]:
                border = self.smaller.columns[1][e]
            else:
                border = min(self.larger.columns[2][b - 1], self.smaller.columns[2][e - 1]) if b > a else 0
            yield np.ones(len(pos), bool), pos, np.concatenate([[np.uint8(border)], values[:-1]])
            e = k


def _sorted_seeds(text: _Text, scan: _Scan, store: Store, cap: int) -> Tuples:
    """Tuples of the LMS suffixes in order, with their common prefixes."""
    lms, n = scan.place, len(scan.place)
    rank = store.array(n, np.int64)  # places in ``lms``, in order of the suffixes
    if n > 1:
        edges = _edges(text, lms)
        fill = edges[:-1].copy()
        seeds = Tuples(store, n)
        for a in range(0, n, BLOCK):  # dealt by their first characters
            pos = np.asarray(lms[a : a + BLOCK])
            char = text.t[pos].astype(np.int64)
            order = np.argsort(char, kind="stable")
            queues, first, sizes = np.unique(char[order], return_index=True, return_counts=True)
            where = np.repeat(fill[queues] - first, sizes) + np.arange(len(order))
            pos = pos[order]
            seeds.put(where, (pos, np.zeros(len(pos), np.uint8), np.asarray(scan.run[a : a + BLOCK])[order], *text.before(pos)))
            fill[queues] += sizes
        induction = _Induction(text, scan, store, 1)
        induction.rise(seeds, edges)
        induction.fall()
        seeds.free()
        names = store.array(n, np.int64 if n >= 1 << 31 else np.int32)
        name, last = -1, None
        for smaller, pos, _ in induction.ordered():
            pos = pos[smaller]
            at = np.searchsorted(lms, pos)
            at = at[np.asarray(lms[np.minimum(at, n - 1)]) == pos]  # those that begin a rising run
            if not len(at):
                continue
            at = at if last is None else np.append(last, at)
            size = np.asarray(lms[np.minimum(at + 1, n - 1)]) - lms[at] + 1
            size[at == n - 1] = text.n - lms[n - 1]
            x, y = at[:-1], at[1:]
            long = int(min(size.max(), cap))
            same = (size[:-1] == size[1:]) & (common_prefixes(text.t, lms[x], lms[y], long) >= np.minimum(size[:-1], long))
            if last is None:
                name = 0
                names[at[0]] = 0
            names[y] = name + np.cumsum(~same)
            name, last = int(names[at[-1]]), at[-1]
        induction.free()
        if name + 1 == n or cap <= 2:  # the names alone tell the order
            fill = np.zeros(name + 1, np.int64)
            for a in range(0, n, BLOCK):
                fill += np.bincount(names[a : a + BLOCK], minlength=name + 1)
            fill = np.cumsum(fill) - fill
            for a in range(0, n, BLOCK):
                part = np.asarray(names[a : a + BLOCK])
                order = np.argsort(part, kind="stable")
                queues, first, sizes = np.unique(part[order], return_index=True, return_counts=True)
                rank[np.repeat(fill[queues] - first, sizes) + np.arange(len(part))] = a + order
                fill[queues] += sizes
        elif HELD * n <= store.left:  # what memory holds is sorted there
            rank[:] = np.argsort(_doubled(np.asarray(names), (cap + 1) // 2), kind="stable")
        else:  # each equal name takes two equal characters at least
            k = 0
            for pos, _ in _suffixes(names, (cap + 1) // 2, store):
                rank[k : k + len(pos)] = pos
                k += len(pos)
        store.free(names)
    out, before = Tuples(store, n), None
    for a in range(0, n, BLOCK):
        at = np.asarray(rank[a : a + BLOCK])
        pos = np.asarray(lms[at])
        beside = np.append(pos[:1] if before is None else before, pos[:-1])
        common = common_prefixes(text.t, beside, pos, cap)
        if before is None:
            common[0] = 0
        out.put(slice(a, a + len(pos)), (pos, common, scan.run[at], *text.before(pos)))
        before = pos[-1]
    store.free(rank)
    return out


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names by their first ``cap``, twice as many each time."""
    rank, step = names.astype(np.int64), 1
    while step < cap and rank.max() + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1]
        step *= 2
    return rank


def _edges(text: _Text, pos: np.ndarray) -> np.ndarray:
    counts = np.zeros(text.top, np.int64)
    for a in range(0, len(pos), BLOCK):
        counts += np.bincount(text.t[np.asarray(pos[a : a + BLOCK])], minlength=text.top)
    return np.concatenate([[0], np.cumsum(counts)])


def _suffixes(t: np.ndarray, cap: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    text = _Text(t)
    cap = min(cap, 254)
    scan = _Scan(text, store, cap)
    seeds = _sorted_seeds(text, scan, store, cap)
    induction = _Induction(text, scan, store, cap)
    induction.rise(seeds, _edges(text, scan.place))
    induction.fall()
    seeds.free()
    store.free(*scan.held)
    for _, pos, values in induction.ordered():
        yield pos, values
    induction.free()


def sorted_suffixes(t: np.ndarray, cap: int, memory: int = 512 << 20, folder: str | None = None, store: Store | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (places, common prefix with the suffix before) of all suffixes of ``t`` (numbers from 0; an array in memory or mapped from a file), in order up to ``cap`` characters."""
    if len(t):
        yield from _suffixes(t, cap, store or Store(memory, folder))
