"""Removal of every byte that a repeated 100-byte string covers, first occurrences excepted, by suffix sorting of shards.

A corpus is far larger than what one machine can sort, and shards by document would miss what repeats across them. So
shards are cut by content. Of every 81 neighbouring 20-byte strings the one with the least hash is an anchor; each
100-byte string holds the anchor of its own 81, and equal strings hold equal ones. What surrounds an anchor (80 bytes
to the left, 100 from its start on) is its context and holds all strings that belong to it.

1. Each task deals its anchors into buckets: hash, digest of the context, document and place, a few bytes each.
2. A bucket's anchors that occur once fall away. Where a context was seen earlier, all of it is a repeat. A string
   with an anchor holds 40 bytes more on one side of it, so what shares neither those 60 bytes with another context of
   the anchor falls away as well. The rest are edges: contexts of which some strings may repeat.
3. Only edges' contexts are gathered by anchor. Each such shard is suffix-sorted by external induction (induced.py),
   and neighbours that share 100 bytes are repeats of the earliest of their run.
4. An anchor with very many contexts would make one shard of many documents. Its contexts are split into their strings,
   which is as long a context as there is: each batch keeps its first of equal ones, hashes tell which of these occur
   in more than one batch, and only such strings are gathered, by hash, and suffix-sorted as well.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Rolling, materialize, mix, pack, shuffle_partitions, small_batches, text_bytes, unpacked
from tidemark.llm.induced import MEMORY, suffixes

#: Length of a repeat; of an anchor; the anchors among which one is chosen, which is also how far a context goes left, and one more.
LENGTH, ANCHOR = 100, 20
CHOICE = LENGTH - ANCHOR + 1
#: Bytes beside an anchor of which every string with it holds those of one side.
SIDE = (LENGTH - ANCHOR) // 2
#: Contexts of one anchor in a bucket from which they are split into strings; contexts of one anchor that a bucket may get from all tasks, and the most and least from a task's chunk.
HOT, MANY, HOT_LOCAL = 4096, 1 << 22, (32, 1024)
#: Repeats that a task holds before it deals them out.
DEALT = 1 << 20
#: Anchors that a task holds before it deals them out; bytes that it works on at once (under 2**22).
CHUNK, PIECE = 700_000, 1 << 21
_PLACE = np.uint64((1 << 22) - 1)
_NO_ID = -(1 << 63)

FULL, EDGE, HOT_EDGE, MARK = 0, 1, 2, 3
Columns = dict[str, np.ndarray]


def unpack(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers of all rows of a packed column, end to end."""
    parts = [unpacked(x, kind) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def dealt(bucket: np.ndarray, columns: Columns) -> pa.RecordBatch:
    """One row for each bucket, with each column's numbers packed."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    key = bucket[order]
    cut = np.flatnonzero(np.diff(key, prepend=-1))
    ends = [*cut[1:].tolist(), len(key)]
    out = [pa.array(key[cut], pa.int32())]
    for values in columns.values():
        values = values[order]
        out.append(pa.array([pack(values[i:j]) for i, j in zip(cut.tolist(), ends, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns])


def schema(columns: dict[str, type]) -> str:
    return "bucket int" + "".join(f", {name} binary" for name in columns)


ASKED = {"h": np.uint64, "context": np.uint64, "before": np.uint16, "after": np.uint16, "id": np.int64, "tie": np.int64, "at": np.int64, "kind": np.uint8}
TOLD = {"id": np.int64, "tie": np.int64, "start": np.int64, "end": np.int64, "kind": np.uint8}
SHARD = {"h": np.uint64, "id": np.int64, "tie": np.int64, "at": np.int64, "left": np.uint8, "size": np.uint8, "bytes": np.uint8}
STRINGS = {"h": np.uint64, "id": np.int64, "tie": np.int64, "at": np.int64, "again": np.uint8}


def _home(id_: np.ndarray, tie: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(id_.view(np.uint64) ^ tie.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def anchors_of(data: np.ndarray, offsets: np.ndarray, before: int = 0, after: int = 0) -> tuple[np.ndarray, ...]:
    """Anchors of texts that lie end to end (under 2**22 bytes): place, text, hash, digest of the context, and hashes with 40 bytes to the left and to the right (0 where there are fewer).

    Strings that reach into the first before or the last after bytes choose none: these only complete the contexts.
    """
    n = len(data)
    empty = np.zeros(0, np.int64)
    sizes = np.diff(offsets)
    if n < LENGTH or sizes.max(initial=0) < LENGTH:
        return empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.astype(np.uint16), empty.astype(np.uint16)
    rolling = Rolling(data)
    start = np.arange(n - ANCHOR + 1)
    h = rolling.of(start, start + ANCHOR)
    key = (h & ~_PLACE) | start.astype(np.uint64)
    rows = -(-n // CHOICE) + 1
    padded = np.full(rows * CHOICE, np.iinfo(np.uint64).max)
    padded[: len(key)] = key
    blocks = padded.reshape(rows, CHOICE)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - LENGTH + 1], ahead[CHOICE - 1 : n - LENGTH + CHOICE])
    # strings that begin in the last 99 bytes of a text reach into the next one
    valid = np.zeros(n + 1, np.int32)
    whole = sizes >= LENGTH
    np.add.at(valid, offsets[:-1][whole], 1)
    np.add.at(valid, offsets[1:][whole] - LENGTH + 1, -1)
    inside = np.cumsum(valid)[: len(least)] > 0
    inside[:before] = False
    inside[max(n - after - LENGTH + 1, 0) :] = False
    chosen = np.zeros(n, bool)
    chosen[(least[inside] & _PLACE).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    text = np.searchsorted(offsets, at, side="right") - 1
    left = np.minimum(at - offsets[text], CHOICE - 1)
    right = np.minimum(at + LENGTH, offsets[text + 1])
    # 64 bits of a cryptographic digest name a context; how far it goes to the left is part of it
    raw = data.tobytes()
    digest = np.frombuffer(b"".join([hashlib.blake2b(raw[i:j], digest_size=8).digest() for i, j in zip((at - left).tolist(), right.tolist(), strict=True)]), np.uint64)
    sides = []
    for a, b in ((at - SIDE, at + ANCHOR), (at, at + ANCHOR + SIDE)):
        inside = (a >= offsets[text]) & (b <= offsets[text + 1])
        sides.append(np.where(inside, rolling.of(np.where(inside, a, 0), np.where(inside, b, 0)) & np.uint64(0xFFFF) | np.uint64(1), 0).astype(np.uint16))
    return at, text, h[at], digest ^ mix(left.astype(np.uint64)), *sides


def segments(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, first text, place of the bytes in that text, bytes before and after that only complete contexts).

    Whole texts of about PIECE bytes, or parts of a longer one that overlap by one string less a byte, each with as much of what lies around it as contexts reach.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        if offsets[at + 1] - offsets[at] > PIECE:
            begin, end = int(offsets[at]), int(offsets[at + 1])
            for lo in range(begin, end - LENGTH + 1, PIECE - LENGTH + 1):
                hi = min(lo + PIECE, end)
                a, b = max(lo - (CHOICE - 1), begin), min(hi + LENGTH, end)
                yield data[a:b], np.array([0, b - a]), at, a - begin, lo - a, b - hi
            at += 1
            continue
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, 0, 0, 0
        at = to


def _ask(buckets: int, homes: int, hot_local: int):
    """Deals anchors out; told: what a task's own chunk settles, of kind FULL or HOT_EDGE, by home."""

    def flush(parts, names):
        h, context, before, after, name, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        # an anchor's text is a number in the order of ids and ties, which takes less memory than both of them
        ids, ties = (np.concatenate(x) for x in zip(*names, strict=True))
        order = np.lexsort((ties, ids))
        ids, ties = ids[order], ties[order]
        number = np.empty(len(order), np.int32)
        number[order] = np.cumsum(np.concatenate(([False], (ids[1:] != ids[:-1]) | (ties[1:] != ties[:-1]))))
        first = np.searchsorted(number[order], np.arange(number.max() + 1))
        ids, ties = ids[first], ties[first]
        name = number[name]
        order = np.lexsort((at, name, context, h))
        h, context, before, after, name, at = (x[order] for x in (h, context, before, after, name, at))
        del order
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new = new_h | np.concatenate(([True], context[1:] != context[:-1]))
        group = np.cumsum(new_h) - 1
        hot = np.bincount(group, new)[group] > hot_local
        del group
        again = np.concatenate(([False], ~new[1:] & ((name[1:] != name[:-1]) | (at[1:] != at[:-1]))))
        kind = np.where(new, np.where(hot, HOT_EDGE, EDGE), FULL).astype(np.uint8)
        keep = new | again
        mark = new_h & hot

        def of(which):
            return {"h": h[which], "context": context[which], "before": before[which], "after": after[which], "id": ids[name[which]], "tie": ties[name[which]], "at": at[which], "kind": kind[which]}

        told = keep & (kind != EDGE)
        if told.any():
            every = of(told)
            yield dealt(_home(every["id"], every["tie"], homes), every), True
        asked = keep & (kind == EDGE)
        every = of(np.concatenate((np.flatnonzero(asked), np.flatnonzero(mark))))
        every["kind"][asked.sum() :] = MARK
        if len(every["h"]):
            yield dealt((every["h"] >> np.uint64(16)).astype(np.int64) % buckets, every), False

    def ask(batches):
        parts, names, rows, held = [], [], 0, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            own = np.array(batch.column("id")), np.array(batch.column("tie"))
            names.append(own)
            for piece, cut, first, base, before, after in segments(data, offsets):
                at, text, h, context, *sides = anchors_of(piece, cut, before, after)
                parts.append((h & np.uint64((1 << 48) - 1), context, *sides, (rows + first + text).astype(np.int32), at - cut[text] + base))
                held += len(at)
                if held >= CHUNK:
                    yield from named(flush(parts, names))
                    parts, names, rows, held = [], [own], 0, 0
            rows += batch.num_rows
        if held:
            yield from named(flush(parts, names))

    def named(batches):
        for batch, told in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([told] * batch.num_rows)], [*batch.schema.names, "told"])

    return ask


def _told(homes: int, id_, tie, start, end, kind) -> pa.Table:
    return pa.Table.from_batches([dealt(_home(id_, tie, homes), {"id": id_, "tie": tie, "start": start, "end": end, "kind": kind})]) if len(id_) else pa.table({"bucket": pa.array([], pa.int32()), **{k: pa.array([], pa.binary()) for k in TOLD}})


def _answer(homes: int):
    """What a bucket's anchors turn out to be: repeats, edges, or nothing (no row)."""

    def answer(table: pa.Table) -> pa.Table:
        c = {k: unpack(table, k, kind) for k, kind in ASKED.items()}
        order = np.lexsort((c["at"], c["tie"], c["id"], c["context"], c["kind"] == MARK, c["h"]))
        h, context, before, after, id_, tie, at, kind = (c[k][order] for k in ASKED)
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        group = np.cumsum(new_h) - 1
        real = kind != MARK
        new = (new_h | np.concatenate(([True], context[1:] != context[:-1]))) & real
        # contexts that share a side with another context of their anchor
        shares = np.zeros(len(h), bool)
        for side in (before, after):
            own = np.flatnonzero(new & (side > 0))
            own = own[np.lexsort((side[own], group[own]))]
            same = (group[own][1:] == group[own][:-1]) & (side[own][1:] == side[own][:-1])
            shares[own[1:][same]] = shares[own[:-1][same]] = True
        marked = np.bincount(group, ~real)[group] > 0
        hot = marked | (np.bincount(group, shares)[group] > HOT)
        same = np.concatenate(([False], (id_[1:] == id_[:-1]) & (tie[1:] == tie[:-1]) & (at[1:] == at[:-1]) & ~new[1:]))
        out = np.where(new, np.where(hot, HOT_EDGE, EDGE), FULL).astype(np.uint8)
        keep = real & ~same & (~new | marked | shares)
        id_, tie, at, out = id_[keep], tie[keep], at[keep], out[keep]
        return _told(homes, id_, tie, *_reach(at), out)

    return answer


def _reach(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at - (CHOICE - 1), at + LENGTH


def _settled(homes: int):
    def settled(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            id_, tie, at, kind = (unpack(table, k, ASKED[k]) for k in ("id", "tie", "at", "kind"))
            if len(id_):
                yield from _told(homes, id_, tie, *_reach(at), kind).to_batches()

    return settled


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in ascending order; touching ones become one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def _by_document(table: pa.Table) -> pa.Table:
    """One row for each document of a home bucket: the spans that are repeats and the places of its edges."""
    id_, tie, start, end, kind = (unpack(table, k, v) for k, v in TOLD.items())
    order = np.lexsort((tie, id_))
    id_, tie, start, end, kind = id_[order], tie[order], start[order], end[order], kind[order]
    cut = np.flatnonzero(np.concatenate(([True], (id_[1:] != id_[:-1]) | (tie[1:] != tie[:-1]))))
    spans, edges, hot = [], [], []
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(id_)], strict=True):
        k = kind[i:j]
        full = k == FULL
        spans.append(np.stack(merged(start[i:j][full], end[i:j][full])).tobytes() if full.any() else None)
        for into, which in ((edges, EDGE), (hot, HOT_EDGE)):
            into.append((np.unique(end[i:j][k == which]) - LENGTH).tobytes() if (k == which).any() else None)
    return pa.table({"id": id_[cut], "tie": tie[cut], "spans": pa.array(spans, pa.binary()), "edges": pa.array(edges, pa.binary()), "hot": pa.array(hot, pa.binary())})


def _contexts(data: np.ndarray, parts: list[tuple], buckets: int) -> pa.RecordBatch:
    """Contexts for the shards, a row for each bucket: hash, document, place, bytes to the left, size, and where its bytes begin."""
    h, id_, tie, at, left, size, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
    bucket = (h >> np.uint64(16)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    h, id_, tie, at, left, size, begin, bucket = (x[order] for x in (h, id_, tie, at, left, size, begin, bucket))
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True):
        shard = b"".join([data[b : b + s].tobytes() for b, s in zip(begin[i:j].tolist(), size[i:j].tolist(), strict=True)])
        rows.append([*(pack(x[i:j]) for x in (h, id_, tie, at, left.astype(np.uint8), size.astype(np.uint8))), shard])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(7))], ["bucket", *SHARD])


_GATHERED = schema(SHARD) + ", again binary, kind int"


def _gather(buckets: int, homes: int):
    """Of kind 0 edges' contexts for the shards; 1 the batch's strings of hot ones, the first of equal ones; 2 the others, which are repeats. The columns that a row doesn't have are null."""
    names = ["bucket", *SHARD, "again"]

    def row(batch, kind):
        have = {n: batch.column(n) for n in batch.schema.names}
        return pa.RecordBatch.from_arrays([have.get(n, pa.nulls(batch.num_rows, pa.binary())) for n in names] + [pa.array([kind] * batch.num_rows, pa.int32())], [*names, "kind"])

    def split(data, strings):
        h, id_, tie, at, begin = (np.concatenate(x) for x in zip(*strings, strict=True))
        order = np.lexsort((at, tie, id_, h))
        h, id_, tie, at, begin = (x[order] for x in (h, id_, tie, at, begin))
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = np.flatnonzero(~new & ((id_ != id_[first]) | (tie != tie[first]) | (at != at[first])))
        # equal hashes are repeats if the bytes are; a string that only has another's hash stands for itself
        view, equal = np.lib.stride_tricks.sliding_window_view(data, LENGTH), np.ones(len(later), bool)
        for i in range(0, len(later), 1 << 15):
            part = later[i : i + (1 << 15)]
            equal[i : i + len(part)] = (view[begin[part]] == view[begin[first[part]]]).all(axis=1)
        alone = later[~equal]
        later = later[equal]
        again = np.zeros(len(h), np.uint8)
        again[first[alone]] = again[alone] = 1
        sent = np.sort(np.concatenate((np.flatnonzero(new), alone)))
        yield row(dealt((h[sent] >> np.uint64(16)).astype(np.int64) % buckets, {"h": h[sent], "id": id_[sent], "tie": tie[sent], "at": at[sent], "again": again[sent]}), 1)
        if len(later):
            yield row(dealt(_home(id_[later], tie[later], homes), {"id": id_[later], "tie": tie[later], "at": at[later]}), 2)

    def gather(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, ties = np.array(batch.column("id")), np.array(batch.column("tie"))
            places = {k: batch.column(k) for k in ("edges", "hot")}
            parts: list[tuple] = []
            strings: list[tuple] = []
            for i in range(batch.num_rows):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                if (blob := places["edges"][i].as_buffer()) is not None:
                    at = np.frombuffer(blob, np.int64) + lo
                    left = np.minimum(at - lo, CHOICE - 1)
                    right = np.minimum(at + LENGTH, hi)
                    parts.append((mixed(data, at), np.full(len(at), ids[i]), np.full(len(at), ties[i]), at - lo, left, right - at + left, at - left))
                if (blob := places["hot"][i].as_buffer()) is not None:
                    at = np.frombuffer(blob, np.int64)
                    first, last = merged(np.maximum(at - (CHOICE - 1), 0), np.minimum(at, hi - lo - LENGTH) + 1)
                    keep = last > first
                    starts = np.concatenate([np.arange(a, b) for a, b in zip(first[keep], last[keep], strict=True)]) if keep.any() else np.zeros(0, np.int64)
                    if len(starts):
                        base = int(starts[0])
                        rolling = Rolling(data[lo + base : lo + int(starts[-1]) + LENGTH])
                        strings.append((rolling.of(starts - base, starts - base + LENGTH), np.full(len(starts), ids[i]), np.full(len(starts), ties[i]), starts, lo + starts))
            if parts:
                yield row(_contexts(data, parts, buckets), 0)
            if strings:
                yield from split(data, strings)

    return gather


def _gather_strings(buckets: int):
    """The strings at given places of texts (edges), as contexts without anything to the left."""

    def gather(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            parts = []
            for i in range(batch.num_rows):
                at = np.frombuffer(batch.column("edges")[i].as_buffer(), np.int64)
                lo, n = int(offsets[i]), len(at)
                h = Rolling(data[lo : int(offsets[i + 1])]).of(at, at + LENGTH)
                parts.append((h, np.full(n, batch.column("id")[i].as_py()), np.full(n, batch.column("tie")[i].as_py()), at, np.zeros(n, np.int64), np.full(n, LENGTH), at + lo))
            if parts:
                yield _contexts(data, parts, buckets)

    return gather


def mixed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The anchors' 48-bit hashes, which only bring equal ones together."""
    grams = np.lib.stride_tricks.sliding_window_view(data, ANCHOR)[at].astype(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(ANCHOR):
        h = h * np.uint64(0x100000001B3) + grams[:, k] + np.uint64(1)
    return mix(h) & np.uint64((1 << 48) - 1)


def _sort_shard(homes: int, memory: int):
    """Suffix-sorts the contexts of a shard and tells each string that an earlier one equals."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, n = [], 0
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                about.append([unpack(table, k, SHARD[k]) for k in ("id", "tie", "at", "left", "size")])
                # each context and a zero after it; bytes are one more than they were, and none is 255 in UTF-8
                size, owned = about[-1][4].astype(np.int64), [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("bytes")]
                whole = np.zeros(int(size.sum()) + len(size), np.uint8)
                whole[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = np.concatenate(owned) + 1 if owned else 0
                whole.tofile(file)
                n += len(whole)
            if not n:
                return
            text = np.memmap(file, np.uint8, "r", shape=(n,))
            id_, tie, at, left, size = (np.concatenate(x) for x in zip(*about, strict=True))
            begin = np.cumsum(size, dtype=np.int64) + np.arange(len(size)) - size
            runs, found, held = Runs(id_, tie), [], 0
            for start, shared in suffixes(text, 256, LENGTH, memory):
                own = np.searchsorted(begin, start, side="right") - 1
                # what goes beyond a context's end is no string, though the contexts that follow may go on alike
                whole = begin[own] + size[own] - start >= LENGTH
                who, place = runs.later(own, at[own] - left[own] + start - begin[own], whole & (shared >= LENGTH))
                found.append((who, place))
                held += len(who)
                if held > DEALT:
                    yield from dealt_out(id_, tie, found)
                    found, held = [], 0
            if held:
                yield from dealt_out(id_, tie, found)

    def dealt_out(id_, tie, found):
        who, place = (np.concatenate(x) for x in zip(*found, strict=True))
        # neighbouring strings of a text become one span
        order = np.lexsort((place, who))
        who, place = who[order], place[order]
        new = np.concatenate(([True], (who[1:] != who[:-1]) | (place[1:] > place[:-1] + LENGTH)))
        start, end = place[new], place[np.append(np.flatnonzero(new)[1:] - 1, len(place) - 1)] + LENGTH
        who = who[new]
        return _told(homes, id_[who], tie[who], start, end, np.zeros(len(who), np.uint8)).to_batches()

    return sort


class Runs:
    """Of runs of equal strings all but the earliest, as they come in chunks; what is left of the last run is its earliest."""

    def __init__(self, id_: np.ndarray, tie: np.ndarray):
        self.id, self.tie = id_, tie
        self.best = None

    def later(self, own: np.ndarray, place: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and place of repeats. goes_on: whether a string equals the one before it."""
        if goes_on[0] and self.best is not None:
            own, place, goes_on = np.append(self.best[0], own), np.append(self.best[1], place), np.append(False, goes_on)
        run = np.cumsum(~goes_on)
        last = np.flatnonzero(run == run[-1])
        rank = last[np.lexsort((place[last], self.tie[own[last]], self.id[own[last]]))[0]]
        self.best = own[rank], place[rank]
        some = np.flatnonzero(goes_on | np.append(goes_on[1:], False))
        own, place, run = own[some], place[some], run[some]
        rank = np.lexsort((place, self.tie[own], self.id[own], run))
        own, place, run = own[rank], place[rank], run[rank]
        first = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
        # contexts overlap: the same place of the same text is no repeat
        x = np.flatnonzero((self.id[own] != self.id[own[lead]]) | (self.tie[own] != self.tie[own[lead]]) | (place != place[lead]))
        return own[x], place[x]


def _repeated(homes: int):
    """Strings whose hash another batch has too: to be compared byte by byte."""

    def repeated(table: pa.Table) -> pa.Table:
        h, id_, tie, at, again = (unpack(table, k, kind) for k, kind in STRINGS.items())
        _, which, many = np.unique(h, return_inverse=True, return_counts=True)
        keep = (many[which] > 1) | (again > 0)
        id_, tie, at = id_[keep], tie[keep], at[keep]
        return _told(homes, id_, tie, at, at + LENGTH, np.full(len(at), EDGE, np.uint8))

    return repeated


def _strings_settled(homes: int):
    def settled(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            id_, tie, at = (unpack(table, k, STRINGS[k]) for k in ("id", "tie", "at"))
            if len(id_):
                yield from _told(homes, id_, tie, at, at + LENGTH, np.zeros(len(id_), np.uint8)).to_batches()

    return settled


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs with the columns id and tie that name a text, and two tables (id, tie, spans): what to remove, as packed starts and ends.

    Order is that of doc_id (null first), then of the first 64 bits of the text's SHA-256; where no id is null or comes
    twice, it names a text alone. A span may reach beyond the text's ends.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # the digest's first 64 bits; with the highest one turned, signed numbers have its order
    tie = F.conv(F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(_NO_ID))
    alike = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    tie = tie if alike.limit(1).count() else F.lit(0).cast("long")
    docs = docs.withColumns({"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "tie": tie})
    long_enough = docs.where(F.octet_length("text") >= LENGTH).select("id", "tie", "text")
    # a bucket's answers go to the homes of their documents: at most a row for each pair, or for each answer
    homes = max(shuffle_partitions(spark), docs.rdd.getNumPartitions())
    buckets = 4 * homes
    asked = materialize(long_enough.mapInArrow(_ask(buckets, homes, min(max(MANY // homes, HOT_LOCAL[0]), HOT_LOCAL[1])), schema(ASKED) + ", told boolean"), "anchors")
    told = asked.where("told").drop("told").mapInArrow(_settled(homes), schema(TOLD))
    answered = asked.where("not told").drop("told").groupBy("bucket").applyInArrow(_answer(homes), schema(TOLD))
    per_doc = "id long, tie long, spans binary, edges binary, hot binary"
    marks = materialize(told.unionByName(answered).groupBy("bucket").applyInArrow(_by_document, per_doc), "marks")
    edged = long_enough.join(marks.where("edges is not null or hot is not null").select("id", "tie", "edges", "hot"), ["id", "tie"]).select("id", "tie", "text", "edges", "hot")
    gathered = materialize(edged.mapInArrow(_gather(buckets, homes), _GATHERED), "contexts")
    strings = gathered.where("kind = 1").select("bucket", *STRINGS).groupBy("bucket").applyInArrow(_repeated(homes), schema(TOLD))
    doubted = materialize(strings.groupBy("bucket").applyInArrow(_by_document, per_doc), "strings").select("id", "tie", "edges")
    contexts = gathered.where("kind = 0").select("bucket", *SHARD)
    contexts = contexts.unionByName(long_enough.join(doubted, ["id", "tie"]).select("id", "tie", "text", "edges").mapInArrow(_gather_strings(buckets), schema(SHARD)))
    sorted_ = contexts.groupBy("bucket").applyInArrow(_sort_shard(homes, MEMORY), schema(TOLD))
    locals_ = gathered.where("kind = 2").select("bucket", "id", "tie", "at").mapInArrow(_strings_settled(homes), schema(TOLD))
    found = sorted_.unionByName(locals_).groupBy("bucket").applyInArrow(_by_document, per_doc)
    return docs, marks.where("spans is not null").select("id", "tie", "spans"), materialize(found.select("id", "tie", "spans"), "found")


def _spans_of(batch: pa.RecordBatch, i: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    both = [np.frombuffer(b, np.int64).reshape(2, -1) for name in ("spans", "more") if (b := batch.column(name)[i].as_buffer()) is not None]
    if not both:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = np.concatenate(both, axis=1)
    return merged(np.maximum(start, 0), np.minimum(end, size))


def _cut(batches):
    """What is left of each text; with cut characters kept whole as a text column, else by its digest."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        rows = []
        for i in range(batch.num_rows):
            own = data[offsets[i] : offsets[i + 1]]
            start, end = _spans_of(batch, i, len(own))
            keep = np.ones(len(own), bool)
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                keep[a:b] = False
            kept = own[keep].tobytes()
            # a character of which some bytes stay stays whole
            tails = (own & 0xC0) == 0x80
            whole = keep
            if tails.any() and not keep.all():
                character = np.cumsum(~tails) - 1
                whole = np.bincount(character, keep)[character] > 0
            rows.append((len(own), len(own) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), own[whole].tobytes().decode("utf-8", "replace")))
        n, removed, spans, digest, text = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(text)], ["id", "tie", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


_NOTHING = hashlib.sha256(b"").hexdigest()
_CUT = "id long, tie long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"


def _removed(docs: DataFrame) -> DataFrame:
    docs, spans, more = repeated_spans(docs)
    return docs.join(spans, ["id", "tie"], "left").join(more.withColumnRenamed("spans", "more"), ["id", "tie"], "left")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs.

    docs needs doc_id (integer, null sorts first) and text (null counts as empty); other columns are ignored. Texts
    under 100 bytes lose nothing. Rows that repeat both doc_id and text: the first keeps what it has, the others are
    repeats of it and lose all. Different texts of one doc_id are ordered by their SHA-256. An empty table gives no rows.
    """
    cut = _removed(docs).select("id", "tie", "text", "spans", "more").mapInArrow(_cut, _CUT).drop("text")
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    once = cut.groupBy("id", "tie", *columns).agg(F.count("*").alias("rows"))
    every = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    return every.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_NOTHING)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeats cut out of text and n_chars counted anew; rows of which nothing is left go.

    A character that is cut in the middle stays. The other columns pass unchanged; rows that repeat doc_id and text
    come once. Texts that were null or empty stay as they are.
    """
    names = docs.columns
    cut = _removed(docs).dropDuplicates(["id", "tie"])
    held = [c for c in names if c not in ("text", "n_chars")]

    def shorten(batches):
        for batch in batches:
            out = next(iter(_cut([batch])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), out.column("text"), out.column("n_removed"), batch.column("id"), batch.column("tie")], [*held, "kept_text", "n_removed", "id", "tie"])

    kinds = dict(docs.dtypes)
    left = cut.select(*held, "id", "tie", "text", "spans", "more").mapInArrow(shorten, ", ".join(f"`{c}` {kinds[c]}" for c in held) + ", kept_text string, n_removed long, id long, tie long")
    left = left.where("n_removed = 0 or length(kept_text) > 0").withColumnRenamed("kept_text", "text")
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else left.select(*names)
