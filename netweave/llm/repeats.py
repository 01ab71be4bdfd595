"""Exact repeats of byte strings across documents, by a run-length index.

A window of ``LENGTH`` bytes is assigned to its minimizer, the 16-byte string in it with the smallest hash; equal windows
have equal minimizers, wherever they stand. Consecutive windows of one minimizer form a stretch of text. Stretches of
minimizers that two different texts share are brought together by minimizer; no other text moves. Common words make long
minimizers common too, so it is not the minimizer itself that must be shared: a window holds either the ``GRAM`` bytes up
to the end of its minimizer or the ``GRAM`` from its begin on, and only windows that hold such a string of two texts go.

A task holds the different stretches of its minimizers, in the order of the documents that have them first, and builds
their run-length index: the Burrows-Wheeler transform of their concatenation, compressed to runs, and for the head of
each run a sample, the length of its match with the row before. Suffix order and text are let go once it is built. The
stretches are then streamed through the index, many at a time, each from its end to its begin by LF steps over the runs:
that gives the row of every position. A position whose row isn't at the head of a run has the neighbour of the position
to its left, moved along by one, and a match shorter by one; so the samples that a stretch comes upon are the matching
statistics of all its positions. Rows that match the row before in ``LENGTH`` bytes or more are one group; a window is a
repeat if its group has a member in a document with a smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from netweave.llm.words import mix, running_hash, text_chunks, tidied
from netweave.operators.skew import join_counted
from netweave.plans.session import materialise

LENGTH = 50
K = 16
#: Bytes that a window has at least on one side of its minimizer, the minimizer included.
GRAM = K + (LENGTH - K) // 2
#: Bytes of corpus for each task that looks for shared minimizers, and for each that holds an index.
SHARE_BYTES, INDEX_BYTES = 64 << 20, 4 << 20
_CHUNK = 1 << 20
_PLACE_BITS = 24  # of the place of a minimizer in its chunk; a longer text is cut into overlapping parts
_PART = 1 << 23


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first byte, end, minimizer hash, place of the minimizer, and 32-bit hashes of the ``GRAM`` bytes up to its end
    and from its begin on (0 where the stretch doesn't hold them), of each stretch of windows with one minimizer, in text order."""
    n, span = len(data), LENGTH - K + 1
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, np.zeros(0, np.uint64), none, np.zeros((2, 0), np.uint32))
    if n < LENGTH:
        return nothing
    total, scale = running_hash(data)
    grams = mix((total[K:] - total[:-K]) * scale[: n - K + 1])
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # ties go to the place further left
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    place = (best & low).astype(np.int64)
    lengths = np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)
    some = lengths >= LENGTH
    np.add.at(inside, offsets[:-1][some], 1)
    np.add.at(inside, offsets[1:][some] - LENGTH + 1, -1)
    valid = np.cumsum(inside)[: len(place)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    new[offsets[:-1][some]] = True
    first = np.flatnonzero(new)
    if not len(first):
        return nothing
    last_of = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    owner = np.searchsorted(offsets, first, "right") - 1
    while True:  # empty texts share their offset with the next one
        empty = lengths[owner] == 0
        if not empty.any():
            break
        owner[empty] -= 1
    end, at = last_of + LENGTH, place[first]
    sides = np.zeros((2, len(first)), np.uint32)
    for side, begin in zip(sides, (at + K - GRAM, at), strict=True):
        held = (begin >= first) & (begin + GRAM <= end)
        b = begin[held]
        side[held] = np.maximum(mix((total[b + GRAM] - total[b]) * scale[b]) >> np.uint64(32), 1)
    return owner, first, end, grams[at], at, sides


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, byte shift, bytes and offsets; a very long text comes in parts that overlap by a window less a byte."""
    if len(data) <= _PART:
        yield 0, 0, data, offsets
        return
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        for at in range(a, max(a + 1, b - LENGTH + 1), _PART):
            piece = data[at : min(b, at + _PART + LENGTH - 1)]
            yield row, int(at - a), piece, np.array([0, len(piece)], np.int64)


def all_stretches(texts: pa.Array, chunk_bytes: int = _CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """Per chunk of a column: first row, and owner, start, end, minimizer of its stretches, starts within the text, the
    hashes of their sides, and ``(data, base, place)``: the chunk's bytes, and the text's first one and the minimizer's there."""
    for first, data, offsets in text_chunks(texts, chunk_bytes):
        for row, shift, piece, bounds in _parts(data, offsets):
            owner, start, end, name, place, sides = stretches(piece, bounds)
            base = (bounds[:-1][owner] if len(owner) else owner) - shift
            yield first + row, owner, start - base, end - base, name, sides, (piece, base, place - base)


class _Suffixes:
    """The suffixes of stretches, each followed by a separator of its own, in order: what the index is made from."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        count, lengths = len(bounds) - 1, np.diff(bounds)
        # letters are numbered as they occur, 0 is the separator; separators differ by place, as ties are ordered
        n = len(data) + count
        self.text = np.zeros(n, np.uint16)
        used = np.flatnonzero(np.bincount(data, minlength=256))
        letter = np.zeros(256, np.uint16)
        letter[used] = np.arange(1, len(used) + 1)
        self.bits = int(len(used)).bit_length()
        self.per_key = 63 // max(1, self.bits)
        keep = np.ones(n, bool)
        ends = bounds[:-1] + np.arange(count) + lengths
        keep[ends] = False
        self.text[keep] = letter[data]
        self.rest = np.repeat(ends, lengths + 1) - np.arange(n)  # letters up to the separator
        self.order = self._sorted()

    def _keys(self) -> np.ndarray:
        """The first letters of each suffix as one number, nothing from beyond its separator."""
        n, out = len(self.text), np.zeros(len(self.text), np.uint64)
        for j in range(self.per_key):
            letter = np.zeros(n, np.uint64)
            letter[: max(0, n - j)] = self.text[j:]
            letter[self.rest < j] = 0
            out = (out << np.uint64(self.bits)) | letter
        return out

    def _sorted(self) -> np.ndarray:
        n = len(self.text)
        key = self.key = self._keys()
        order = np.argsort(key)  # ties are seen to below
        depth = self.per_key
        longest = int(self.rest.max()) + 1
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        head = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(head, np.diff(np.append(head, n)))
        while depth < longest:
            # slots whose suffix still ties with a neighbour; groups stay where they are and are sorted within
            tied = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(tied):
                break
            at = order[tied]
            follow = np.where(self.rest[at] >= depth, rank[np.minimum(at + depth, n - 1)] + 1, 0)
            both = np.lexsort((at, follow, rank[at])) if n >= 1 << 31 else np.argsort((rank[at] << 32) | follow)
            at, follow = at[both], follow[both]
            order[tied] = at
            group = rank[at]
            fresh = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
            new[tied] = fresh
            start = np.flatnonzero(fresh)
            rank[at] = np.repeat(tied[start], np.diff(np.append(start, len(at))))
            depth *= 2
        # what still ties is equal up to its separator: in text order, as the separators are
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if len(tied):
            at = order[tied]
            order[tied] = at[np.lexsort((at, rank[at]))]
        return order

    def match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to the nearer separator."""
        n, out = len(self.text), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        at = 0
        while len(live):
            x, y = a[live] + at, b[live] + at
            inside = (x < n) & (y < n) & (self.rest[a[live]] >= at) & (self.rest[b[live]] >= at)
            live, x, y = live[inside], x[inside], y[inside]
            differ = self.key[x] ^ self.key[y]
            same = differ == 0
            # letters before the first that differs
            lead = np.zeros(len(live), np.int64)
            for j in range(self.per_key):
                lead += (differ >> np.uint64(self.bits * (self.per_key - 1 - j))) == 0
            out[live] = at + lead
            live = live[same]
            at += self.per_key
        return np.minimum(out, np.minimum(self.rest[a], self.rest[b]))


class RunLengthIndex:
    """A Burrows-Wheeler transform in runs, and a sample at the head of each: nothing that grows but with the runs.

    ``run_letter``, ``run_begin`` (one more than runs): letter and first row of each run; every separator is a run by
    itself. ``sample``: how long the head of a run matches the row before it. ``shift``: what an LF step adds to a row of
    the run. Rows 0 to ``count`` - 1 are the separators, in the order of the stretches.
    """

    #: Stretches that are streamed together.
    TOGETHER = 1 << 14

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """``data``: all stretches; ``bounds``: where each begins, and the end."""
        made = _Suffixes(data, bounds)
        order, n = made.order, len(made.text)
        before = order - 1
        letters = np.where(before >= 0, made.text[before], 0)
        heads = np.flatnonzero(np.append(True, letters[1:] != letters[:-1]) | (letters == 0))
        self.rows, self.count = n, len(bounds) - 1
        self.run_letter = letters[heads]
        self.run_begin = np.append(heads, n)
        self.sample = np.zeros(len(heads), np.int32)
        follows = heads > 0
        self.sample[follows] = made.match(order[heads[follows]], order[heads[follows] - 1])
        # letters keep their order from the last column to the first
        length, by_letter = np.diff(self.run_begin), np.argsort(self.run_letter, kind="stable")
        first = np.empty(len(heads), np.int64)
        first[by_letter] = np.cumsum(length[by_letter]) - length[by_letter]
        self.shift = first - heads
        # a run at or before every so many rows, as many as there are runs at most
        self.stride = max(0, int(n // max(1, len(heads))).bit_length())
        marks = np.arange(0, n, 1 << self.stride)
        self.near = np.searchsorted(heads, marks, "right").astype(np.int32) - 1

    def run_of(self, row: np.ndarray) -> np.ndarray:
        """The run of each row."""
        run = self.near[row >> self.stride]
        for _ in range(3):
            run = run + (self.run_begin[run + 1] <= row)
        left = np.flatnonzero(self.run_begin[run + 1] <= row)
        if len(left):
            run[left] = np.searchsorted(self.run_begin, row[left], "right") - 1
        return run

    def matching_statistics(self, first: int, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches from ``first`` on, of the given lengths: stretch, start, row, and match with the row before, of all their windows."""
        who = np.flatnonzero(lengths >= window)
        row = first + who
        run = self.run_of(row)
        deepest = int(lengths[who].max()) if len(who) else 0
        rows = np.zeros((max(0, deepest - window + 1), len(who)), np.int64)
        seen = np.full(rows.shape, -1, np.int32)
        live = np.arange(len(who))
        for back in range(1, deepest + 1):
            if back > window:
                on = lengths[who[live]] >= back
                live, row, run = live[on], row[on], run[on]
            row = row + self.shift[run]
            run = self.run_of(row)
            if back >= window:
                rows[back - window, live] = row
                seen[back - window, live] = np.where(self.run_begin[run] == row, self.sample[run], -1)
        # from the begin of each stretch, whose letter before is a separator and so a sample, to its end
        match = np.zeros(len(who), np.int32)
        for at in range(len(rows) - 1, -1, -1):
            match = np.where(seen[at] >= 0, seen[at], match - 1)
            seen[at] = match
        back, which = np.nonzero(np.arange(window, deepest + 1)[:, None] <= lengths[who][None, :]) if len(who) else (np.zeros(0, int), np.zeros(0, int))
        return first + who[which], lengths[who[which]] - back - window, rows[back, which], seen[back, which]

    def stream(self, lengths: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``matching_statistics`` of all stretches, some at a time."""
        for first in range(0, self.count, self.TOGETHER):
            yield self.matching_statistics(first, lengths[first : first + self.TOGETHER], window)


def repeated_windows(data: np.ndarray, bounds: np.ndarray, document: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each byte, whether the window that begins there is inside its stretch and also in one of a smaller document.

    ``document``: for each stretch, the smallest id that has it.
    """
    index = RunLengthIndex(data, bounds)
    rank = np.unique(document, return_inverse=True)[1].astype(np.int32)
    matches = np.zeros(index.rows + 1, bool)  # the row before is alike in a whole window
    owner, place, rows = [], [], []
    for stretch, start, row, match in index.stream(np.diff(bounds), length):
        matches[row[match >= length]] = True
        owner.append(stretch.astype(np.int32))
        place.append((bounds[stretch] + start).astype(np.int32 if len(data) < 1 << 31 else np.int64))
        rows.append(row.astype(np.int32 if index.rows < 1 << 31 else np.int64))
    owner, place, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, place, rows))
    some = matches[rows] | matches[rows + 1]
    owner, place, rows = owner[some], place[some], rows[some]
    members = np.flatnonzero(matches[:-1] | matches[1:])
    group = (np.cumsum(~matches[members]) - 1)[np.searchsorted(members, rows)]
    least = np.full(int(group.max()) + 1 if len(group) else 0, np.iinfo(np.int32).max, np.int32)
    np.minimum.at(least, group, rank[owner])
    found = np.zeros(len(data), bool)
    found[place[least[group] < rank[owner]]] = True
    return found


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _rows_by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value of ``key`` and the places that have it, in order."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True):
        yield int(ranked[a]), order[a:b]


def _share(n_p: int):
    """Rows of texts to rows ``p, ts, ids, parts, counts, lefts, rights``: the sides of the minimizers of a chunk, by task that compares them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, ident = batch.column("t").to_numpy(), batch.column("id").to_numpy()
            for first, owner, start, _, name, (left, right), _ in all_stretches(batch.column("b")):
                row, part = owner + first, start // _PART
                out: list[tuple] = []
                for p, at in _rows_by(((name >> np.uint64(40)) % np.uint64(n_p)).astype(np.int64)):
                    entry = row[at] * (1 << 24) + part[at]
                    edge = np.flatnonzero(np.append(True, entry[1:] != entry[:-1]))
                    head = at[edge]
                    out.append((p, _pack(t[row[head]], "<i8"), _pack(ident[row[head]], "<i8"), _pack(part[head], "<i4"), _pack(np.diff(np.append(edge, len(at))), "<i4"), _pack(left[at], "<u4"), _pack(right[at], "<u4")))
                yield pa.record_batch([pa.array([r[i] for r in out], pa.int32() if not i else pa.binary()) for i in range(7)], ["p", "ts", "ids", "parts", "counts", "lefts", "rights"])

    return run


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(raw: bytes) -> bytes:
    return pa.decompress(raw[4:], decompressed_size=int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True)


def _of_two(name: np.ndarray, take: np.ndarray, which: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """For each name whether it is one that two different texts have; 0 is none, and only what ``take`` marks counts."""
    flag = take & (name > 0)
    mine = name[flag]
    pairs = np.sort((mine.astype(np.uint64) << np.uint64(32)) | which[entry[flag]].astype(np.uint64))
    if len(pairs):
        heads = np.flatnonzero(np.append(True, pairs[1:] >> np.uint64(32) != pairs[:-1] >> np.uint64(32)))
        several = pairs[heads] != pairs[np.append(heads[1:], len(pairs)) - 1]
        shared = (pairs[heads[several]] >> np.uint64(32)).astype(np.uint32)  # sorted, as the pairs were
        del pairs
        flag[flag] = shared[np.minimum(np.searchsorted(shared, mine), len(shared) - 1)] == mine if len(shared) else False
    return flag


def _spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers ``begin[i]`` to ``begin[i] + count[i] - 1`` for each i."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _shared(n_d: int):
    """The sides of minimizers that two different texts have, two bits for each of an entry's, in few packed rows."""

    def run(group: pa.Table) -> pa.Table:
        t, ident, part, count = (_joined(group.column(c), k) for c, k in (("ts", "<i8"), ("ids", "<i8"), ("parts", "<i4"), ("counts", "<i4")))
        count = count.astype(np.int64)
        entry = np.repeat(np.arange(len(t)), count)
        which = np.unique(t, return_inverse=True)[1]
        # of equal texts the one with the smallest id stands for all
        least = np.full(which.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, which, ident)
        take = (ident == least[which])[entry]
        flag = np.zeros((len(entry), 2), bool)
        for i, side in enumerate(("lefts", "rights")):
            flag[:, i] = _of_two(_joined(group.column(side), "<u4"), take, which, entry)
        hit = np.flatnonzero(np.bincount(entry, flag.any(1), minlength=len(t)) > 0)
        begin = np.cumsum(count) - count
        p, out = group.column("p")[0].as_py(), []
        for d, at in _rows_by((mix(t[hit].view(np.uint64) ^ ident[hit].view(np.uint64)) % np.uint64(n_d)).astype(np.int64)):
            e = hit[at]
            size = (2 * count[e] + 7) // 8  # an entry begins at a byte
            bits = np.zeros(8 * int(size.sum()), bool)
            bits[_spread(8 * (np.cumsum(size) - size), 2 * count[e])] = flag.reshape(-1)[_spread(2 * begin[e], 2 * count[e])]
            out.append((d, p, _pack(t[e], "<i8"), _pack(ident[e], "<i8"), _pack(part[e], "<i4"), _pack(size, "<i4"), _squeeze(np.packbits(bits).tobytes())))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["d", "p", "ts", "ids", "parts", "sizes", "bits"])

    return run


def _flags(group: pa.Table) -> pa.Table:
    """Packed rows to a row for each text: ``s, id, flags``."""
    t, ident, part, size = (_joined(group.column(c), k) for c, k in (("ts", "<i8"), ("ids", "<i8"), ("parts", "<i4"), ("sizes", "<i4")))
    held = [len(x) // 8 for x in group.column("ts").to_pylist()]
    p = np.repeat(group.column("p").to_numpy(), held)
    raw = b"".join(_unsqueeze(x) for x in group.column("bits").to_pylist())
    begin = np.cumsum(size) - size
    order = np.lexsort((p, part, t, ident))
    new = np.append(True, (t[order][1:] != t[order][:-1]) | (ident[order][1:] != ident[order][:-1]))
    edge = np.flatnonzero(new)
    bits = [raw[b : b + n] for b, n in zip(begin[order].tolist(), size[order].tolist(), strict=True)]
    entries = pa.StructArray.from_arrays([pa.array(part[order], pa.int32()), pa.array(p[order], pa.int32()), pa.array(bits, pa.binary())], ["part", "p", "bits"])
    flags = pa.ListArray.from_arrays(pa.array(np.append(edge, len(order)), pa.int32()), entries)
    head = order[edge]
    return pa.table({"s": pa.array(t[head] & 0xFFFFFFFF, pa.int64()), "id": pa.array(ident[head], pa.int64()), "flags": flags})


def _flagged(flags: pa.Array, row: np.ndarray, part: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The two bits of each stretch, by its text, part and task, from the rows of ``_flags``; none where a task found nothing."""
    found = np.zeros((len(row), 2), bool)
    length = flags.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entries = flags.flatten()  # nulls have no entries
    bits = entries.field("bits")
    raw = np.frombuffer(b"".join(bits.to_pylist()), np.uint8)
    if not len(row) or not len(raw):
        return found
    size = np.array(pa.compute.binary_length(bits), np.int64)
    at = 8 * (np.cumsum(size) - size)
    # tasks within a part of a text: one number for each
    wide = int(max(p.max(), entries.field("p").to_numpy().max())) + 1
    key = lambda row, part, p: (row.astype(np.int64) * (1 << 24) + part) * wide + p
    asked = key(np.repeat(np.arange(len(length)), length), entries.field("part").to_numpy(), entries.field("p").to_numpy())
    order = np.argsort(asked)
    asked, at = asked[order], at[order]
    mine = key(row, part, p)
    by_task = np.argsort(mine, kind="stable")
    ranked = mine[by_task]
    edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    number = np.arange(len(ranked)) - np.repeat(edge, np.diff(np.append(edge, len(ranked))))
    place = np.minimum(np.searchsorted(asked, ranked), len(asked) - 1)
    known = asked[place] == ranked
    first = (at[place] + 2 * number)[known]
    unpacked = np.unpackbits(raw) > 0
    found[by_task[known]] = np.column_stack([unpacked[first], unpacked[first + 1]])
    return found


def _emit(n_p: int, n_q: int):
    """Texts with their flags to rows ``q, ss, ids, starts, lengths, data``: the stretches of shared minimizers, no longer
    than their windows that hold a shared side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, ident, flags = batch.column("s").to_numpy(), batch.column("id").to_numpy(), batch.column("flags")
            for first, owner, start, end, name, _, (data, base, place) in all_stretches(batch.column("b"), 2 * _CHUNK):
                row, part = owner + first, start // _PART
                p = ((name >> np.uint64(40)) % np.uint64(n_p)).astype(np.int64)
                count = int(owner.max()) + 1 if len(owner) else 0
                left, right = _flagged(flags.slice(first, count), owner, part, p).T
                start = np.where(left, start, np.maximum(start, place + GRAM - LENGTH))
                end = np.where(right, end, np.minimum(end, place + K - GRAM + LENGTH))
                kept = np.flatnonzero((left | right) & (end - start >= LENGTH))
                out = []
                raw = data.tobytes()
                for q, at in _rows_by((mix(name[kept] + np.uint64(1)) % np.uint64(n_q)).astype(np.int64)):
                    x = kept[at]
                    size = end[x] - start[x]
                    held = b"".join(raw[s : s + n] for s, n in zip((start + base)[x].tolist(), size.tolist(), strict=True))
                    out.append((q, _pack(t[row[x]], "<u4"), _pack(ident[row[x]], "<i8"), _pack(start[x], "<u4"), _pack(size, "<u1"), _squeeze(held)))
                yield pa.record_batch([pa.array([r[i] for r in out], pa.int32() if not i else pa.binary()) for i in range(6)], ["q", "ss", "ids", "starts", "lengths", "data"])

    return run


def _mark(group: pa.Table) -> pa.Table:
    """``s, id, starts, ends``: the bytes of each text that its stretches here show to be repeats."""
    t, ident, start, size = (_joined(group.column(c), k).astype(np.int64) for c, k in (("ss", "<u4"), ("ids", "<i8"), ("starts", "<u4"), ("lengths", "<u1")))
    data = np.frombuffer(b"".join(_unsqueeze(x) for x in group.column("data").to_pylist()), np.uint8)
    begin = np.cumsum(size) - size
    total, scale = running_hash(data)
    name = mix((total[begin + size] - total[begin]) * scale[begin] + size.astype(np.uint64))
    del total
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ident)
    rank = np.argsort(least, kind="stable")  # the order of the documents that have them first
    lengths = size[one[rank]]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    text = data[np.repeat(begin[one[rank]] - bounds[:-1], lengths) + np.arange(bounds[-1])]
    found = repeated_windows(text, bounds, least[rank])
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    # runs of repeated windows in each different stretch
    head = found & ~np.append(False, found[:-1])
    head[bounds[:-1]] = found[bounds[:-1]]
    tail = found & ~np.append(found[1:], False)
    last = bounds[1:] - 1
    tail[last] = found[last]
    run_a, run_b = np.flatnonzero(head), np.flatnonzero(tail) + LENGTH
    of = np.searchsorted(bounds, run_a, "right") - 1
    run_at = np.searchsorted(of, np.arange(len(rank) + 1))
    first = np.flatnonzero(ident == least[which])
    slot = place[which[first]]
    n = run_at[slot + 1] - run_at[slot]
    runs = np.repeat(run_at[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    who = np.repeat(first, n)
    shift = np.repeat(start[first] - bounds[slot], n)
    later = np.flatnonzero(ident > least[which])
    row = np.concatenate([who, later])
    a = np.concatenate([run_a[runs] + shift, start[later]])
    b = np.concatenate([run_b[runs] + shift, start[later] + size[later]])
    order = np.lexsort((a, t[row], ident[row]))
    row, a, b = row[order], a[order], b[order]
    edge = np.flatnonzero(np.append(True, (t[row][1:] != t[row][:-1]) | (ident[row][1:] != ident[row][:-1]))) if len(row) else np.zeros(0, np.int64)
    lists = np.append(edge, len(row)).astype(np.int32)
    as_list = lambda x: pa.ListArray.from_arrays(pa.array(lists), pa.array(x, pa.int64()))
    return pa.table({"s": pa.array(t[row[edge]], pa.int64()), "id": pa.array(ident[row[edge]], pa.int64()), "starts": as_list(a), "ends": as_list(b)})


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or adjoining intervals."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    edge = np.flatnonzero(new)
    return starts[edge], reach[np.append(edge[1:], len(starts)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            spans, kept = [], []
            for text, copy, starts, ends in zip(*(part.column(c).to_pylist() for c in ("b", "copy", "starts", "ends")), strict=True):
                a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if copy:
                    a, b = np.array([0]), np.array([len(text)])
                elif starts:
                    a, b = _merged(np.concatenate(starts).astype(np.int64), np.concatenate(ends).astype(np.int64))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(text)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([part.column("doc_id"), pa.array([len(x) for x in part.column("b").to_pylist()], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, share_bytes: int = SHARE_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row of ``docs`` (``doc_id, text``; other columns are ignored).

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller ``doc_id``;
    strings don't run across documents and are judged on the texts as they came in. ``spans``: the maximal runs removed
    (``start, end`` in bytes), ``kept``: the bytes left, in UTF-8 unless a character was cut. A null text is empty. A
    null id is larger than any other; rows with the same id don't judge each other. A text of any length is taken whole,
    in parts that overlap. An empty table gives an empty result.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1).cast("long"))
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("t"), ident.alias("id"), text.cast("binary").alias("b"))
    rows = materialise(base.select("t", "id", F.octet_length("b").alias("n")), "rows")
    size = rows.agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")).first()
    total = size["bytes"] or 0
    n_p, n_q = -(-total // share_bytes) + 1, -(-total // index_bytes) + 1
    minimizers = base.select("t", "id", "b").mapInArrow(tidied(_share(n_p)), "p int, ts binary, ids binary, parts binary, counts binary, lefts binary, rights binary")
    shared = minimizers.groupBy("p").applyInArrow(_shared(n_p), "d int, p int, ts binary, ids binary, parts binary, sizes binary, bits binary")
    flags = materialise(shared.groupBy("d").applyInArrow(_flags, "s long, id long, flags array<struct<part:int,p:int,bits:binary>>"), "flags")
    # both joins deal the texts out alike, so that they are shuffled once and read twice; beside the id, 32 bits of the
    # text's hash tell apart the few texts that share an id
    keyed = base.select("doc_id", F.col("t").bitwiseAND(0xFFFFFFFF).alias("s"), "id", "b")
    held = keyed.join(flags.hint("merge"), ["s", "id"], "left")
    sent = held.where("flags is not null").select("s", "id", "b", "flags").mapInArrow(tidied(_emit(n_p, n_q)), "q int, ss binary, ids binary, starts binary, lengths binary, data binary")
    marks = sent.groupBy("q").applyInArrow(_mark, "s long, id long, starts array<long>, ends array<long>")
    marks = marks.groupBy("s", "id").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    # a text that a smaller id has as well goes whole
    classes = rows.where(F.col("n") >= LENGTH).groupBy("t").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("held")).where("first < last").drop("last")
    copies = join_counted(rows.where(F.col("n") >= LENGTH), classes, "t", "held", size["rows"]).where("id > first").select(F.col("t").bitwiseAND(0xFFFFFFFF).alias("s"), "id", F.lit(True).alias("copy")).distinct()
    known = marks.join(copies, ["s", "id"], "full_outer")
    cut = keyed.join(known.hint("merge"), ["s", "id"], "left").select("doc_id", "b", "copy", "starts", "ends")
    kind_of = docs.schema["doc_id"].dataType.simpleString()
    return cut.mapInArrow(tidied(_cut), f"doc_id {kind_of}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
