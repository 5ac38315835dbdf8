"""Suffix sorting with common prefixes by external induction.

The text is divided where its suffixes stop falling and begin to rise. The pieces between these places, the seeds, are
sorted and named; the string of names, much shorter, is sorted in the same way, recursively, until one fits into
memory. Two inductions then bring all suffixes in order: each suffix that is popped from a priority queue puts the one
that starts a symbol earlier into the queue, and how much the two share with their neighbours follows from what those
popped in between share.

What waits in a queue is a tuple: where a suffix starts, how much it shares with the tuple before it, and the aligned
word of the text that holds the symbols before its start, so that the text is read once for each word and not for each
symbol. Within a symbol a queue is first-in-first-out, so it is a list of runs for each symbol and a heap of symbols.
Runs move to a temporary file when they outgrow a bound on memory, as do all arrays that grow with the text; the file
vanishes with the task. Text, queues, pieces and names are thus all on disk where a text is far larger than memory.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes that a sort works in, about: a quarter for each set of queues; an array of more than an eighth is mapped to a file.
MEMORY = 192 << 20
#: Tuples that are worked on at once, at most.
CHUNK = 1 << 18

Columns = tuple[np.ndarray, ...]
Ordered = Iterator[tuple[np.ndarray, np.ndarray]]


def room(n: int, kind: type, memory: int) -> np.ndarray:
    """An array of n zeros, mapped to a temporary file if it is large beside memory."""
    if n * np.dtype(kind).itemsize <= memory // 8:
        return np.zeros(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


class Queues:
    """First-in-first-out queues of tuples, one for each symbol, and the order of the symbols that have any."""

    def __init__(self, memory: int, falling: bool = False):
        self.runs: dict[int, list] = {}
        self.heap: list[int] = []
        self.sign = -1 if falling else 1
        self.memory, self.held, self.file, self.spilled = memory, 0, None, 0

    def put(self, symbols: np.ndarray, *columns: np.ndarray) -> None:
        """Appends tuples to the queues of their symbols, which ascend."""
        cut = np.flatnonzero(np.diff(symbols)) + 1
        for i, j in zip([0, *cut.tolist()] if len(symbols) else [], [*cut.tolist(), len(symbols)], strict=True):
            self.append(int(symbols[i]), tuple(c[i:j] for c in columns))

    def append(self, symbol: int, columns: Columns) -> None:
        if symbol not in self.runs:
            self.runs[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        # a copy, so that a small run does not hold the large array that it was cut from
        self.runs[symbol].append(tuple(c.copy() for c in columns))
        self.held += sum(c.nbytes for c in columns)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for runs in self.runs.values():
            for k, run in enumerate(runs):
                if isinstance(run, tuple):
                    runs[k] = [self.file.tell(), len(run[0]), [c.dtype for c in run]]
                    for c in run:
                        c.tofile(self.file)
        self.spilled += self.held
        self.held = 0

    def _read(self, run) -> Columns:
        if isinstance(run, tuple):
            self.held -= sum(c.nbytes for c in run)
            return run
        self.file.seek(run[0])
        return tuple(np.fromfile(self.file, kind, run[1]) for kind in run[2])

    def first(self) -> int | None:
        """The next symbol that has a queue."""
        return self.sign * self.heap[0] if self.heap else None

    def take(self, symbol: int, backwards: bool = False) -> Iterator[Columns]:
        """A symbol's tuples in chunks, in the order they came or against it; what is appended meanwhile comes too. The queue is gone then."""
        if symbol not in self.runs:
            return
        runs = self.runs[symbol]
        while runs:
            some, n = [], 0
            while runs and (not some or n < CHUNK):
                some.append(self._read(runs.pop() if backwards else runs.pop(0)))
                n += len(some[-1][0])
            whole = tuple(np.concatenate([c[::-1] if backwards else c for c in parts]) for parts in zip(*some, strict=True))
            for i in range(0, n, CHUNK):
                yield tuple(c[i : i + CHUNK] for c in whole)
        del self.runs[symbol]
        if self.heap and self.heap[0] == self.sign * symbol:
            heapq.heappop(self.heap)
        else:
            self.heap.remove(self.sign * symbol)
            heapq.heapify(self.heap)


class Least:
    """Least values of ranges of one array."""

    def __init__(self, values: np.ndarray, longest: int):
        self.rows = [values]
        width = 1
        while 2 * width <= longest:
            last = self.rows[-1]
            row = last.copy()
            np.minimum(last[:-width], last[width:], out=row[: len(last) - width])
            self.rows.append(row)
            width *= 2
        self.flat = np.concatenate(self.rows)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least from start to end - 1, which is not before start."""
        level = np.frexp((end - start).astype(np.float64))[1].astype(np.int64) - 1
        base = level * len(self.rows[0])
        return np.minimum(self.flat[base + start], self.flat[base + end - (1 << level)])


class Level:
    """One text of the recursion: whole numbers of a fixed width."""

    def __init__(self, text: np.ndarray, symbols: int, most: int, memory: int):
        self.n, self.symbols, self.most, self.memory = len(text), symbols, most, memory
        self.bits = 8 * text.dtype.itemsize
        self.per = 64 // self.bits
        padded = room(-(-self.n // self.per) * self.per, text.dtype, memory)
        padded[: self.n] = text
        self.text, self.words, self.mapped = padded, padded.view("<u8"), isinstance(padded, np.memmap)
        self.mask = np.uint64((1 << self.bits) - 1)

    def at(self, array: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Values at places; a mapped array is read in the order of places."""
        if not self.mapped:
            return array[places]
        order = np.argsort(places, kind="stable")
        out = np.empty(len(places), array.dtype)
        out[order] = array[places[order]]
        return out

    def word_before(self, start: np.ndarray) -> np.ndarray:
        return self.at(self.words, np.maximum(start - 1, 0) // self.per)

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """How many symbols the suffixes at a and b share, up to most, if they are known to share some."""
        out = np.zeros(len(a), np.int64) if known is None else known.astype(np.int64)
        left = np.flatnonzero(out < self.most)
        while len(left):
            x, y = a[left] + out[left], b[left] + out[left]
            inside = np.maximum(x, y) < self.n
            left, x, y = left[inside], x[inside], y[inside]
            left = left[self.at(self.text, x) == self.at(self.text, y)]
            out[left] += 1
            left = left[out[left] < self.most]
        return np.minimum(out, self.most).astype(np.uint8)

    def seeds(self) -> np.ndarray:
        """Where a rising suffix follows a falling one, ascending. The end counts as smaller than all symbols."""
        found, rises, after, rising_after = [], False, None, False
        for hi in range(self.n, 0, -8 * CHUNK):
            lo = max(hi - 8 * CHUNK, 0)
            part = np.asarray(self.text[lo:hi])
            change = np.flatnonzero(part[1:] != part[:-1])
            ends = np.append(change, len(part) - 1)
            if after is not None and part[-1] != after:
                rises = bool(part[-1] < after)
            up = np.append(part[change] < part[change + 1], rises)
            kinds = np.repeat(up, np.diff(ends, prepend=-1))
            # the part's first suffix is judged with the part before
            if not kinds[-1] and rising_after:
                found.append(np.array([hi]))
            found.append(np.flatnonzero(kinds[1:] & ~kinds[:-1])[::-1] + lo + 1)
            rises = rising_after = bool(kinds[0])
            after = part[0]
        every = np.concatenate(found)[::-1] if found else np.zeros(0, np.int64)
        out = room(len(every), np.int64, self.memory)
        out[:] = every
        return out

    def piece_words(self, start: np.ndarray, size: np.ndarray, k: int, pad: np.ndarray) -> np.ndarray:
        """The k-th word of each piece, its first symbol highest, with pad beyond its size."""
        out = np.zeros(len(start), np.uint64)
        for i in range(self.per * k, self.per * (k + 1)):
            symbol = self.at(self.text, np.minimum(start + i, self.n - 1)).astype(np.uint64)
            out = (out << np.uint64(self.bits)) | np.where(i < size, symbol, pad)
        return out

    def named(self, seeds: np.ndarray) -> tuple[np.ndarray, int]:
        """A number from 1 for each piece, in the order of pieces, equal for equal ones, and how many there are.

        A piece runs to the next seed's symbol. Of two of which one begins the other, the shorter is the larger, as the
        suffix at its end rises and the other's falls. The last piece runs to the end and equals none.
        """
        m = len(seeds)
        names = room(m, np.uint32, self.memory)
        by_symbol = Queues(self.memory // 4)
        for i in range(0, m, CHUNK):
            index = np.arange(i, min(i + CHUNK, m))
            symbol = self.at(self.text, seeds[index])
            order = np.argsort(symbol, kind="stable")
            by_symbol.put(symbol[order], index[order])
        last = 0
        while by_symbol.heap:
            some: list[np.ndarray] = []
            # neighbouring symbols together, up to a chunk
            while by_symbol.heap and sum(map(len, some)) < CHUNK:
                some += [x[0] for x in by_symbol.take(by_symbol.first())]
            index = np.concatenate(some)
            start = seeds[index]
            size = np.where(index < m - 1, seeds[np.minimum(index + 1, m - 1)] + 1, self.n) - start
            pad = np.where(index < m - 1, self.mask, np.uint64(0))
            label = self._ranked(start, size, pad)
            new = np.zeros(len(index) + 1, np.int64)
            new[label] = 1
            new = np.cumsum(new)
            names[index] = (last + new[label]).astype(np.uint32)
            last += int(new[-1])
        return names, last

    def _ranked(self, start: np.ndarray, size: np.ndarray, pad: np.ndarray) -> np.ndarray:
        """For each piece how many are smaller, word by word for those that are still equal."""
        label, k = np.zeros(len(start), np.int64), 0
        left = np.arange(len(start))
        while len(left):
            words = self.piece_words(start[left], size[left], k, pad[left])
            order = np.lexsort((words, label[left])) if k else np.argsort(words)
            left, words = left[order], words[order]
            group = label[left]
            new_group = np.concatenate(([True], group[1:] != group[:-1]))
            new = new_group | np.concatenate(([True], words[1:] != words[:-1]))
            place = np.arange(len(left))
            begin, group_begin = (np.maximum.accumulate(np.where(x, place, 0)) for x in (new, new_group))
            label[left] = group + begin - group_begin
            single = new & np.append(new[1:], True)
            k += 1
            # all pieces of one group have one size: what is beyond it shows in its words
            left = left[~single & (size[left] >= self.per * k)]
        return label

    def ordered_seeds(self, seeds: np.ndarray) -> Ordered:
        """The seeds in the order of their suffixes, with what each shares with the one before."""
        names, many = self.named(seeds)
        m = len(seeds)
        if many == m:
            order = room(m, np.int64, self.memory)
            for i in range(0, m, CHUNK):
                order[names[i : i + CHUNK] - 1] = np.arange(i, min(i + CHUNK, m))
            found = ((order[i : i + CHUNK], np.zeros(min(CHUNK, m - i), np.uint8)) for i in range(0, m, CHUNK))
        elif 64 * m <= self.memory:
            found = iter([doubled(np.asarray(names), self.most)])
        else:
            found = suffixes(names, many + 1, self.most, self.memory)
        before = None
        for index, shared in found:
            other = np.concatenate(([before if before is not None else index[0]], index[:-1]))
            # the names that both have in common, in symbols of this level; then symbol by symbol
            to = index + shared
            known = np.where(to < m, seeds[np.minimum(to, m - 1)], self.n) - seeds[index]
            start, prior = seeds[index], seeds[other]
            common = self.common(start, prior, np.minimum(known, self.most))
            if before is None:
                common[0] = 0
            before = index[-1]
            yield start, common

    def induced(self, seeds: Ordered, falling: Queues, rising: Queues) -> None:
        """Fills falling and rising with all suffixes of the two kinds by first symbol, in the order that that of the seeds induces.

        Tuples in falling are in ascending order, those in rising in descending order.
        """
        waiting = Queues(self.memory // 4)
        for start, common in seeds:
            symbol = self.at(self.text, start)
            # seeds come in order, so their symbols ascend
            waiting.put(symbol, start, common, self.word_before(start))
        queues = Queues(self.memory // 4)
        last = np.array([self.n - 1])
        queues.put(self.text[last], last, np.zeros(1, np.uint8), self.word_before(last))
        tails = Tails(self.symbols, self.most)
        while queues.heap or waiting.heap:
            c = min(x for x in (queues.first(), waiting.first()) if x is not None)
            tails.reset()
            end = None
            for start, common, word in queues.take(c):
                if end is None:
                    common[0] = 0
                falling.append(c, (start, common, word))
                self._pop(queues, tails, c, start, common, word, np.greater_equal)
                end = start[-1:]
            fresh = True
            for start, common, word in waiting.take(c):
                if fresh:
                    common[0] = self.common(start[:1], end)[0] if end is not None else 0
                    fresh = False
                self._pop(queues, tails, c, start, common, word, np.greater)
        kept = Queues(self.memory // 4)
        queues = Queues(self.memory // 4, falling=True)
        below = Queues(self.memory // 4, falling=True)
        below.runs, below.heap, below.file, below.held = falling.runs, [-x for x in falling.runs], falling.file, falling.held
        heapq.heapify(below.heap)
        while queues.heap or below.heap:
            c = max(x for x in (queues.first(), below.first()) if x is not None)
            tails.reset()
            end = None
            for start, common, word in queues.take(c):
                if end is None:
                    common[0] = 0
                rising.append(c, (start, common))
                self._pop(queues, tails, c, start, common, word, np.less_equal)
                end = start[-1:]
            above = None
            for start, common, word in below.take(c, backwards=True):
                kept.append(c, (start, common))
                # against the order, what a tuple shares with the one before is what that one said
                if above is None:
                    above = self.common(start[:1], end)[0] if end is not None else 0
                shared = np.concatenate((np.array([above], np.uint8), common[:-1]))
                above = common[-1]
                self._pop(queues, tails, c, start, shared, word, np.less)
        falling.runs, falling.heap, falling.file, falling.held = kept.runs, kept.heap, kept.file, kept.held
        falling.spilled += kept.spilled + queues.spilled

    def _pop(self, queues: Queues, tails: Tails, symbol: int, start: np.ndarray, common: np.ndarray, word: np.ndarray, goes) -> None:
        """Puts the suffixes that start one symbol earlier than popped ones into the queues of their symbols, where goes(it, symbol)."""
        shift = ((start - 1) % self.per * self.bits).astype(np.uint64)
        before = ((word >> shift) & self.mask).astype(np.int64)
        chosen = np.flatnonzero(goes(before, symbol) & (start > 0))
        if len(chosen):
            order = np.argsort(before[chosen].astype(np.uint8 if self.bits == 8 else np.uint32), kind="stable")
            chosen = chosen[order]
            target = before[chosen]
            earlier = start[chosen] - 1
            held = word[chosen]
            fetch = np.flatnonzero((earlier % self.per == 0) & (earlier > 0))
            held[fetch] = self.word_before(earlier[fetch])
            queues.put(target, earlier, tails.shared(target, chosen, common), held)
        else:
            tails.passed(common)


class Tails:
    """What lies between the last popped suffix that put one into a symbol's queue and the next: the least that those in between share."""

    def __init__(self, symbols: int, most: int):
        self.value, self.live, self.most = np.zeros(symbols, np.uint8), np.zeros(0, np.int64), most

    def reset(self) -> None:
        """Suffixes of different symbols share nothing."""
        self.value[self.live] = 0
        self.live = np.zeros(0, np.int64)

    def passed(self, common: np.ndarray) -> None:
        self.value[self.live] = np.minimum(self.value[self.live], common.min())

    def shared(self, target: np.ndarray, source: np.ndarray, common: np.ndarray) -> np.ndarray:
        """What each induced suffix shares with the one before it in its target's queue: one symbol more than their sources do."""
        n = len(common)
        first = np.concatenate(([True], target[1:] != target[:-1]))
        last = np.append(first[1:], True)
        begin = np.flatnonzero(first)
        out = np.empty(len(target), np.uint8)
        ahead = np.minimum.accumulate(common)
        out[begin] = np.minimum(ahead[source[begin]], self.value[target[begin]])
        rest = np.flatnonzero(~first)
        if len(rest):
            a, b = source[rest - 1] + 1, source[rest] + 1
            out[rest] = Least(common, int((b - a).max())).of(a, b)
        self.value[self.live] = np.minimum(self.value[self.live], ahead[-1])
        behind = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
        ends = np.flatnonzero(last)
        own = target[ends]
        self.value[own] = behind[np.minimum(source[ends] + 1, n)]
        self.live = np.union1d(self.live, own)
        return np.minimum(out.astype(np.int64) + 1, self.most).astype(np.uint8)


def doubled(names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a string's suffixes by their first symbols, at least most, in memory, and what each shares with the one before.

    Ranks by 1, 2, 4, ... symbols; only what is still equal is sorted again. The ranks of all rounds give what is shared.
    """
    n = len(names)
    order = np.argsort(names, kind="stable").astype(np.int32)
    key = names[order]
    begin = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), np.arange(n, dtype=np.int32), np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[order] = begin
    ranks, width = [rank], 1
    while width < most:
        size = np.bincount(rank, minlength=n)
        place = np.flatnonzero(size[rank[order]] > 1)
        if not len(place):
            break
        left = order[place]
        second = np.where(left + width < n, rank[np.minimum(left + width, n - 1)] + 1, 0)
        group = rank[left]
        sub = np.argsort(group.astype(np.int64) * (n + 1) + second)
        left, second, group = left[sub], second[sub], group[sub]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        order[place] = left
        rank = rank.copy()
        rank[left] = np.maximum.accumulate(np.where(new, place, 0))
        ranks.append(rank)
        width *= 2
    shared = np.zeros(n, np.int64)
    order = order.astype(np.int64)
    x, y = order[1:], order[:-1]
    off = np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = x + off, y + off
        inside = np.maximum(a, b) < n
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        off += np.where(same, 1 << k, 0)
    shared[1:] = off
    return order, np.minimum(shared, most).astype(np.uint8)


def suffixes(text: np.ndarray, symbols: int = 256, most: int = 100, memory: int = MEMORY, about: dict | None = None) -> Ordered:
    """Starts of all suffixes in ascending order of their first most symbols, in chunks, and how many each shares with the one before, up to most (under 255).

    text holds numbers of 1 or 4 bytes below symbols; those of one byte stay below 255. An empty text gives nothing.
    about takes the bytes that queues wrote to disk.
    """
    if not len(text):
        return
    level = Level(text, symbols, most, memory)
    seeds = level.seeds()
    falling, rising = Queues(memory // 4), Queues(memory // 4)
    level.induced(level.ordered_seeds(seeds) if len(seeds) else iter(()), falling, rising)
    if about is not None:
        about["spilled"] = about.get("spilled", 0) + falling.spilled + rising.spilled
    for c in sorted({*falling.runs, *rising.runs}):
        end = None
        # falling suffixes were kept against their order, rising ones came so
        for start, common in falling.take(c, backwards=True):
            end = start[-1:]
            yield start, common
        above = None
        for start, common in _ahead(rising.take(c, backwards=True)):
            if above is None:
                common[0] = level.common(start[:1], end)[0] if end is not None else 0
                above = True
            yield start, common


def _ahead(chunks: Iterable[Columns]) -> Ordered:
    """Chunks against the order in which they say what they share: each tuple takes what the one before it said."""
    said = 0
    for start, common in chunks:
        yield start, np.concatenate((np.array([said], np.uint8), common[:-1]))
        said = common[-1]
