"""External induced sorting of suffixes with their common prefixes.

A suffix is of type L if the next one is smaller, else of type S; S suffixes behind an L suffix (S*) are the sample. Equal
stretches between sample places get equal names, the text of names is sorted by the same means, and then all L suffixes
follow from the sample and all S suffixes from the L suffixes: a priority queue holds tuples (first symbol, position,
symbol before, length of the first run, common prefix with the tuple before), and what it yields is put back one position
to the left. Naming is the same induction from sample places that are only known by their first symbol.

Tuples leave the queue in batches: as many from the front as no tuple that they induce could precede. A common prefix
is one more than the least common prefix between the two suffixes' sources, which a table of minima over the batch
gives; it is kept up to a cap, so that it takes a byte. The queue keeps sorted runs, and those beyond its memory are on
disk, as are results. Scratch files have no name and belong to one task alone, like what Spark spills: whoever runs the
task again makes them again.
"""

from __future__ import annotations

import os
import tempfile
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np

ITEM = np.dtype({"names": ["key", "pos", "prev", "run", "lcp"], "formats": [np.int32, np.int32, np.int32, np.uint8, np.uint8], "offsets": [0, 4, 8, 12, 13], "itemsize": 16})
#: The same bytes as one number, as numpy moves numbers faster than records.
WHOLE = np.complex128
#: Tuples that a queue keeps in memory; texts of names up to this length are sorted in memory.
MEMORY = 1 << 18
#: A common prefix of stretches that are equal as far as they are known.
SAME = 255
#: In place of the symbol before: an S suffix of the sample, and nothing to induce.
SAMPLE, NONE = np.int32(2**31 - 1), np.int32(2**31 - 2)


def _take(items: np.ndarray, order: np.ndarray) -> np.ndarray:
    return items.view(WHOLE)[order].view(ITEM)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate([p.view(WHOLE) for p in parts]).view(ITEM)


class Scratch:
    """Arrays of one task, those of more than `limit` bytes in files."""

    def __init__(self, limit: int):
        self.limit = limit
        self.folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        self.files = 0

    def keep(self, a: np.ndarray) -> np.ndarray:
        if a.nbytes <= self.limit:
            return a
        self.files += 1
        with tempfile.TemporaryFile(dir=self.folder) as f:
            a.tofile(f)
            f.flush()
            return np.memmap(f, a.dtype, "r+", shape=a.shape)


class Rows:
    """Rows that are appended, then read as one array."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.parts, self.held, self.done = scratch, [], 0, []

    def append(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.held += rows.nbytes
        if self.held > self.scratch.limit:
            self.done.append(self.scratch.keep(_joined(self.parts)))
            self.parts, self.held = [], 0

    def blocks(self) -> list[np.ndarray]:
        return self.done + ([_joined(self.parts)] if self.parts else [])


class Minima:
    """Least values of ranges of an array of bytes."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.table = np.empty((max(1, n.bit_length()), n), np.uint8)
        self.table[0] = values
        for k in range(1, len(self.table)):
            half = 1 << (k - 1)
            self.table[k] = self.table[k - 1]
            np.minimum(self.table[k - 1, : n - half], self.table[k - 1, half:], out=self.table[k, : n - half])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each non-empty [low, high)."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, low], self.table[k, high - (1 << k)])


class Queue:
    """A priority queue of tuples by key; equal keys leave as they came. Tuples may only be added behind what has left."""

    def __init__(self, scratch: Scratch, memory: int, narrow: bool = False):
        """narrow: all keys fit into 16 bits."""
        self.narrow = narrow
        self.scratch, self.memory, self.near = scratch, memory, max(16, min(1 << 12, memory // 8))
        self.head, self.at, self.limit = np.empty(0, ITEM), 0, -1
        self.fresh, self.n_fresh, self.runs, self.left = [], 0, [], 0

    def push(self, items: np.ndarray) -> None:
        self.left += len(items)
        close = items["key"] < self.limit
        if close.any():
            self.head, self.at = self._sorted([self.head[self.at :], _take(items, close)]), 0
            items = _take(items, ~close)
            if len(self.head) > 2 * self.near:  # keep the front short, as each batch goes through it
                key = self.head["key"]
                cut = bisect_left(key, key[self.near]) or bisect_right(key, key[0])
                if cut < len(key):
                    self.limit = int(key[cut])
                    self._add(self.head[cut:])
                    self.head = self.head[:cut]
        if len(items):
            self._add(items)

    def _add(self, items: np.ndarray) -> None:
        self.fresh.append(items)
        self.n_fresh += len(items)
        if self.n_fresh > self.memory // 4:
            self._settle()

    def peek(self, n: int) -> np.ndarray:
        """The first tuples, n at most; none only if the queue is empty."""
        if self.at == len(self.head) and self.left:
            self._refill()
        return self.head[self.at : self.at + n]

    def drop(self, n: int) -> None:
        self.at += n
        self.left -= n

    def _sorted(self, parts: list[np.ndarray]) -> np.ndarray:
        both = _joined(parts)
        key = both["key"]
        if self.narrow or len(key) > 1000 and key.max() < 1 << 16 and key.min() >= 0:  # sorted by digits
            key = key.astype(np.uint16)
        return _take(both, np.argsort(key, kind="stable"))

    def _settle(self) -> None:
        """Makes a run of what was added; runs of like size are merged while they fit into memory."""
        if self.fresh:
            self.runs.append(self._sorted(self.fresh))
            self.fresh, self.n_fresh = [], 0
        self.runs = [r for r in self.runs if len(r)]
        while len(self.runs) > 1 and 2 * len(self.runs[-1]) >= len(self.runs[-2]) and len(self.runs[-1]) + len(self.runs[-2]) <= self.memory:
            last = self.runs.pop()
            self.runs[-1] = self._sorted([self.runs[-1], last])
        if self.runs:
            self.runs[-1] = self.scratch.keep(self.runs[-1]) if not isinstance(self.runs[-1], np.memmap) else self.runs[-1]

    def _refill(self) -> None:
        """Takes the tuples with the least keys from all runs; of a key with very many, the first that came."""
        self._settle()
        runs = self.runs
        if sum(map(len, runs)) <= self.near:
            self.limit, counts = max(int(r["key"][-1]) for r in runs) + 1, list(map(len, runs))
        else:
            step = max(1, self.near // len(runs))
            self.limit = min(int(r["key"][step]) for r in runs if len(r) > step)
            counts = [bisect_left(r["key"], self.limit) for r in runs]
            if not any(counts):
                counts, room = [bisect_right(r["key"], self.limit) for r in runs], 4 * self.near
                if sum(counts) <= room:
                    self.limit += 1
                for k, c in enumerate(counts):
                    counts[k] = min(c, room)
                    room -= counts[k]
        self.head, self.at = self._sorted([r[:c] for r, c in zip(runs, counts, strict=True)]), 0
        self.runs = [r[c:] for r, c in zip(runs, counts, strict=True)]


def _more(cap: int) -> np.ndarray:
    """Common prefixes that are one symbol longer, by what they are."""
    out = np.minimum(np.arange(256) + 1, cap).astype(np.uint8)
    out[SAME] = SAME
    return out


class Sorter:
    """Suffixes of a text of symbols: those below `ends` end strings, occur once each, and descend from left to right to 0, the last."""

    def __init__(self, text: np.ndarray, ends: int, cap: int, memory: int, scratch: Scratch):
        self.text, self.ends, self.cap, self.memory, self.scratch = text, ends, cap, memory, scratch
        self.size = int(text.max()) + 1
        self.narrow = self.size <= 1 << 15  # twice a symbol fits into 16 bits
        self.more = _more(cap)

    def _before(self, pos: np.ndarray, symbol: np.ndarray, backwards: bool, strict: bool) -> np.ndarray:
        """Keys of the suffixes one to the left, if they are of the type that is induced."""
        left = self.text[pos - 1]  # of the first symbol the last one, which is 0 and induces nothing
        if not backwards:
            return np.where(left >= symbol, left, NONE)
        out = np.int32(self.size - 1) - left
        out[left < self.ends] = NONE
        out[left >= symbol if strict else left > symbol] = SAMPLE
        return out

    def _induce(self, seeds: list[np.ndarray], backwards: bool) -> Rows:
        """Tuples of the other type, in order, from sorted seeds; of equal keys the induced ones go first."""
        queue, out, window = Queue(self.scratch, self.memory, self.narrow), Rows(self.scratch), 1024
        seeds = [s for s in seeds if len(s)]
        block, at = 0, 0  # of the seeds
        last = (-1, False, 0)  # key, seed?, run of the last tuple
        opened = -1  # the key of the last tuple, and for each key induced from it the least common prefix since then
        known, least = np.empty(0, np.int32), np.empty(0, np.uint8)
        while True:
            items = queue.peek(window)
            own = seeds[block][at : at + window] if block < len(seeds) else np.empty(0, ITEM)
            if not len(items) and not len(own):
                return out
            if len(items) and len(own) and own["key"][0] <= items["key"][-1]:
                both = _joined([items, own])
                rank = both["key"].astype(np.int64) * 2
                rank[len(items) :] += 1
                order = np.argsort(rank.astype(np.uint16) if self.narrow else rank, kind="stable")
                batch, rank = _take(both, order), rank[order]
            else:  # one kind is before the other
                batch = _joined([items, own]) if len(items) else own
                rank = batch["key"].astype(np.int64) * 2
                rank[len(items) :] += 1
            # no tuple may leave before one that is not in sight, or that an earlier one of the batch induces
            bound = np.empty(len(batch), np.int64)
            bound[0] = 2**32
            np.minimum.accumulate(batch["prev"][:-1].astype(np.int64) * 2, out=bound[1:])
            if len(items) < queue.left:
                np.minimum(bound, 2 * int(items[-1]["key"]), out=bound)
            if len(own) and (block + 1 < len(seeds) or at + len(own) < len(seeds[block])):
                np.minimum(bound, 2 * int(own[-1]["key"]) + 1, out=bound)
            over = rank > bound
            n = int(over.argmax()) if over.any() else len(batch)
            window = min(max(256, 2 * n), 1 << 16)
            queue.near = max(16, min(4 * window, self.memory // 8))  # a few batches
            batch, seed = batch[:n], (rank[:n] & 1).astype(bool)
            taken = int(seed.sum())
            queue.drop(n - taken)
            at += taken
            if block < len(seeds) and at == len(seeds[block]):
                block, at = block + 1, 0

            key, run = batch["key"], batch["run"]
            lcp = batch["lcp"].copy()
            before_key = np.append(np.int32(last[0]), key[:-1])
            border = seed & ~np.append(last[1], seed[:-1]) & (key == before_key)
            lcp[border] = np.minimum(run, np.append(np.uint8(last[2]), run[:-1]))[border]
            lcp[key != before_key] = 0
            last = (int(key[-1]), bool(seed[-1]), int(run[-1]))
            if taken < n:
                done = _take(batch, ~seed)
                done["lcp"] = lcp[~seed]
                out.append(done)

            stays = key[0] == opened
            src = np.flatnonzero(batch["prev"] < NONE)
            if len(src):
                to = batch["prev"][src]
                by = np.argsort(to.astype(np.uint16) if self.narrow else to, kind="stable")
                to_sorted, from_ = to[by], src[by]
                minima = Minima(lcp)
                low = np.empty(len(src), np.int64)
                low[1:] = from_[:-1] + 1
                first = np.append(True, to_sorted[1:] != to_sorted[:-1])
                low[first] = 0
                value = minima(low, from_ + 1)
                if stays and len(known):
                    f = np.flatnonzero(first)
                    where = np.minimum(np.searchsorted(known, to_sorted[f]), len(known) - 1)
                    found = (known[where] == to_sorted[f]) & (key[from_[f]] == opened)
                    value[f] = np.where(found, np.minimum(value[f], least[where]), 0)
                else:
                    value[first] = 0
                new = np.empty(len(src), ITEM)
                new["key"], new["pos"] = to, batch["pos"][src] - 1
                new["run"] = np.where(to == key[src], self.more[run[src]], np.uint8(1))
                new["lcp"][by] = self.more[value]
                new["prev"] = self._before(new["pos"], np.int32(self.size - 1) - to if backwards else to, backwards, False)
                queue.push(new)
            # carry on for the key that the batch ends in
            if stays and key[-1] == opened:
                least = np.minimum(least, lcp.min())
            else:
                known, least = known[:0], least[:0]
            opened = int(key[-1])
            if len(src):
                ends = np.flatnonzero(np.append(to_sorted[1:] != to_sorted[:-1], True) & (key[from_] == opened))
                if len(ends):
                    tail = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(SAME))  # least from each place on
                    k, v = to_sorted[ends], tail[from_[ends] + 1]
                    if len(known):
                        where = np.minimum(np.searchsorted(k, known), len(k) - 1)
                        old = k[where] != known
                        known, least = np.concatenate([known[old], k]), np.concatenate([least[old], v])
                        by = np.argsort(known)
                        known, least = known[by], least[by]
                    else:
                        known, least = k, v

    def _types(self) -> tuple[np.ndarray, np.ndarray]:
        """Sample positions in the order of the text, and the lengths of the runs of equal symbols that begin there."""
        t, n = self.text, len(self.text)
        places, runs, turn, after = [], [], n - 1, True  # where the run at hand ends; whether the suffix to the right is S
        for high in range(n, 0, -max(4, self.memory)):
            low = max(0, high - max(4, self.memory))
            part = np.asarray(t[low : high + 1], np.int64)
            here, there = part[: high - low], part[1 : high - low + 1]
            last_one = np.ones(high - low - len(there), bool)  # of the text, which is S
            differs = np.append(here[: len(there)] != there, last_one)
            to = np.where(differs, np.arange(low, high), n)
            if not differs[-1]:
                to[-1] = turn
            ends = np.minimum.accumulate(to[::-1])[::-1]
            small = np.append(here[: len(there)] < there, last_one)
            inside = ends < high
            kind = np.where(inside, small[np.minimum(ends, high - 1) - low], after)
            turn, after = int(ends[0]), bool(kind[0])
            left = int(t[low - 1]) if low else -1
            before = np.append(left, here[:-1])
            star = kind & (before > here)
            where = np.flatnonzero(star)
            places.append((where + low).astype(np.int64))
            runs.append(np.minimum(ends[where] - where - low + 1, self.cap).astype(np.uint8))
        return np.concatenate(places[::-1]), np.concatenate(runs[::-1])

    def _seeds(self, pos: np.ndarray, run: np.ndarray, lcp) -> list[np.ndarray]:
        out = Rows(self.scratch)
        for a in range(0, len(pos), self.memory):
            own = np.empty(len(pos[a : a + self.memory]), ITEM)
            own["pos"], own["run"], own["lcp"] = pos[a : a + self.memory], run[a : a + self.memory], lcp[a : a + self.memory]
            own["key"] = self.text[own["pos"]]
            own["prev"] = self._before(own["pos"], own["key"], False, False)
            out.append(own)
        return out.blocks()

    def _by_symbol(self, seeds: list[np.ndarray]) -> list[np.ndarray]:
        """Seeds in the order of their first symbols and, as they are of type S, falling first runs; equal ones are the same so far."""
        both = self.size * (self.cap + 1) < 2**31
        if not both:
            seeds = self._drained(seeds, lambda s: self.cap - s["run"].astype(np.int32))
        out, last = Rows(self.scratch), (-1, 0)
        for own in self._drained(seeds, lambda s: self.text[s["pos"]].astype(np.int32) * (self.cap + 1) + self.cap - s["run"] if both else self.text[s["pos"]]):
            own["key"] = self.text[own["pos"]]
            one, run = np.append(np.int32(last[0]), own["key"][:-1]) == own["key"], np.append(np.uint8(last[1]), own["run"][:-1])
            own["lcp"] = np.where(one, np.where(run == own["run"], SAME, own["run"]), 0)
            last = own["key"][-1], own["run"][-1]
            out.append(own)
        return out.blocks()

    def _drained(self, seeds, key) -> Iterator[np.ndarray]:
        """Seeds by a key, through a queue of their own."""
        queue = Queue(self.scratch, self.memory)
        for s in seeds:
            own = np.array(s)
            own["key"] = key(own)
            queue.push(own)
        while queue.left:
            own = queue.peek(self.memory).copy()
            queue.drop(len(own))
            yield own

    def _reversed(self, smaller: Rows) -> list[np.ndarray]:
        """L tuples from the greatest to the least, as seeds of the S tuples."""
        out, blocks, carried = Rows(self.scratch), smaller.blocks(), 0
        for block in blocks[::-1]:
            own = np.array(block[::-1])
            own["lcp"] = np.append(np.uint8(carried), own["lcp"][:-1])
            carried = block["lcp"][0]
            symbol = own["key"].copy()
            own["prev"] = self._before(own["pos"], symbol, True, True)
            own["key"] = self.size - 1 - symbol
            out.append(own)
        return out.blocks()

    def _both(self, seeds: list[np.ndarray]) -> tuple[Rows, Rows]:
        larger = self._induce(seeds, False)
        return larger, self._induce(self._reversed(larger), True)

    def _ascending(self, rows: Rows) -> Iterator[np.ndarray]:
        """S tuples from the least to the greatest, their keys symbols again."""
        blocks = rows.blocks()
        for k in range(len(blocks) - 1, -1, -1):
            own = np.array(blocks[k][::-1])
            # the common prefix with the smaller neighbour is the one that the smaller neighbour was given
            own["lcp"] = np.append(np.uint8(blocks[k + 1]["lcp"][0] if k + 1 < len(blocks) else 0), own["lcp"][:-1])
            own["key"] = self.size - 1 - own["key"]
            yield own

    def _sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sample positions in the order of their suffixes, runs, and common prefixes with the one before."""
        pos, run = self._types()
        _, larger = self._both(self._by_symbol(self._seeds(pos, run, np.zeros(len(pos), np.uint8))))
        ends = np.flatnonzero(self.text[pos] < self.ends)[::-1]  # they descend
        order, lcp, carried = [pos[ends]], [np.zeros(len(ends), np.uint8)], SAME
        for own in self._ascending(larger):
            mark = np.flatnonzero(own["prev"] == SAMPLE)
            if not len(mark):
                carried = min(carried, int(own["lcp"].min()))
                continue
            least = np.minimum.reduceat(own["lcp"][: mark[-1] + 1], np.append(0, mark[:-1] + 1))
            least[0] = min(carried, int(least[0]))
            carried = int(own["lcp"][mark[-1] + 1 :].min(initial=SAME))
            order.append(own["pos"][mark].astype(np.int64))
            lcp.append(least)
        order, lcp = np.concatenate(order), np.concatenate(lcp)
        lcp[: len(ends) + 1] = 0
        name = np.cumsum(lcp != SAME, dtype=np.int64) - 1
        where = np.searchsorted(pos, order)
        if name[-1] + 1 == len(order):
            return order, run[where], lcp
        names = np.empty(len(pos), np.int32)
        names[where] = name
        names = self.scratch.keep(names)
        apart = Minima(lcp[lcp != SAME])
        del order, lcp, where, name, own
        sub, common = (np.concatenate(x) for x in zip(*sort(names, 1, self.cap, self.memory, self.scratch), strict=True))
        sub = np.append(len(pos) - 1, sub).astype(np.int64)
        common = np.append(0, common).astype(np.int64)
        lcp = np.zeros(len(sub), np.uint8)
        some = np.flatnonzero((common < self.cap) & (np.arange(len(sub)) > 0))
        i, j, l = sub[some - 1], sub[some], common[some]
        a, b = names[i + l].astype(np.int64), names[j + l].astype(np.int64)
        lcp[some] = np.minimum(pos[j + l] - pos[j] + apart(a + 1, b + 1), self.cap)
        lcp[common >= self.cap] = self.cap
        return pos[sub], run[sub], lcp

    def __call__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of all suffixes but the ends in order, and common prefixes with the one before, in blocks of whole symbols."""
        larger, rows = self._both(self._seeds(*self._sample()))
        smaller = self._ascending(rows)
        lows = (b[b["key"] >= self.ends] for b in larger.blocks())  # the end of an empty string is an L suffix
        yield from _merged(lows, smaller, self.size)


def _merged(lows: Iterator[np.ndarray], highs: Iterator[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """L tuples and S tuples by symbol, L first, in blocks that end where a symbol ends."""
    held = [np.empty(0, ITEM), np.empty(0, ITEM)]
    streams, over = [lows, highs], [False, False]
    while not all(over) or len(held[0]) or len(held[1]):
        bound = size
        for s in range(2):
            while not over[s] and (not len(held[s]) or held[s]["key"][0] == held[s]["key"][-1]):
                own = next(streams[s], None)
                over[s] = own is None
                held[s] = held[s] if own is None else _joined([held[s], own])
            if not over[s]:
                bound = min(bound, int(held[s]["key"][-1]))  # more of this symbol may come
        cuts = [bisect_left(h["key"], bound) for h in held]
        low, high = held[0][: cuts[0]], held[1][: cuts[1]]
        held = [held[0][cuts[0] :], held[1][cuts[1] :]]
        both = _joined([low, high])
        kind = np.repeat([False, True], [len(low), len(high)])
        order = np.argsort(both["key"].astype(np.int64) * 2 + kind, kind="stable")
        both, kind = _take(both, order), kind[order]
        lcp = both["lcp"].copy()
        if len(both):
            same = np.append(False, both["key"][1:] == both["key"][:-1])
            border = np.append(False, kind[1:] & ~kind[:-1]) & same
            lcp[border] = np.minimum(both["run"], np.append(np.uint8(0), both["run"][:-1]))[border]
            lcp[~same] = 0
            yield both["pos"], lcp


def _in_memory(text: np.ndarray, ends: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by doubling, for texts that fit into memory."""
    n = len(text)
    rank = np.unique(np.asarray(text), return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank.astype(np.int32)], 1
    order = np.argsort(rank, kind="stable")
    while rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        width *= 2
        if width <= cap:
            ranks.append(rank.astype(np.int32))
    order = order[np.asarray(text)[order] >= ends]
    i, j, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, len(order) - 1), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        fits = (i < n) & (j < n)
        same = fits & (ranks[level][np.minimum(i, n - 1)] == ranks[level][np.minimum(j, n - 1)])
        step = same * (1 << level)
        lcp, i, j = lcp + step, i + step, j + step
    return order, np.append(np.zeros(min(1, len(order)), np.int64), np.minimum(lcp, cap)).astype(np.uint8)


def sort(text: np.ndarray, ends: int, cap: int = 100, memory: int = MEMORY, scratch: Scratch | None = None, inside: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefixes up to cap) of the suffixes in order, in blocks; `ends` symbols end strings.

    The first common prefix of a block is 0. cap is 254 at most. With inside, short texts are sorted in memory.
    """
    if len(text) <= ends:
        return
    if inside and len(text) <= memory:
        yield _in_memory(text, ends, cap)
    else:
        yield from Sorter(text, ends, cap, memory, scratch or Scratch(2 * ITEM.itemsize * memory))()


def joined(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text of all strings, each with an end of its own, and where each starts."""
    m = len(strings)
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.empty(starts[-1], np.int32)
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    text[:] = data
    text += m
    text[starts[1:] - 1] = np.arange(m - 1, -1, -1)
    return text, starts
