"""Removal of repeated byte strings, by prefix doubling over sparse suffixes.

A string of ``least`` bytes (50) counts as repeated if it also starts in a
document with a smaller id.  Prefix doubling names every suffix by its first 16
bytes and then by pairs of names at an offset: two names of 16 bytes 16 apart
are one of 32, two of 32 that overlap, 18 apart, are one of 50: the
threshold.  After each step Spark sorts the names, and suffixes whose name
is unique are dropped.  A name is a hash of its pair and not the pair's place
in the sorted order: only equality matters, and nothing has to be sent back.

A sort of all suffixes would move some twenty times the input, so it starts from
the suffixes that the text itself picks: of any 35 neighbouring positions the
one with the least 16-byte name (the leftmost of equals).  Equal 50-byte strings
pick the same place in themselves, so no repeat is lost, and about one
position in eighteen takes part.

1. Names of 16 bytes: Spark sorts (name, document) rows; a picked position
   whose name occurs in no other document is dropped.
2. Names of the whole context: all windows of 50 bytes that picked a position
   form one string.  If a smaller document has the same one, all are repeated.
3. For the first document of each context, names of 32 bytes to the right and
   to the left (every window covers one of them): unique ones are dropped.
4. Names of 50 bytes for the windows that are left: the threshold.

Contexts and windows have names of 128 bits, made of two independent names of
16 bytes; shorter names only decide what is dropped, where a chance collision
costs work and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 50
#: Bytes of the first name, picked from REACH positions: NAME + REACH - 1 = LEAST.
NAME = 16
REACH = LEAST - NAME + 1
SIDE = 2 * NAME
_BACK = SIDE - NAME
#: From the first name of SIDE bytes in LEAST to the second; they overlap.
_NEXT = LEAST - SIDE
#: Bytes of text that are taken at a time, and of these named at a time (fewer than _SPOT can tell apart).
CHUNK, BLOCK = 1 << 21, 1 << 16
#: Rows whose runs are united at a time.
GATHERED = 1 << 18
#: A name with more rows in a batch is hot.
HOT = 8

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Of the two independent names: factors of the first and of the second 8 bytes.
_FACTORS = [(_C1, np.uint64(0xD6E8FEB86659FD93)), (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))]
#: Low bits of a name that give way to its place in a block: the least of these is the leftmost of equal names.
_SPOT, _NONE = np.uint64((1 << 18) - 1), np.uint64(2**64 - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= _C2
    h ^= h >> np.uint64(29)
    return h


def _name(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Names of 16 bytes, given as two numbers of 8; never 0."""
    one, two = _FACTORS[seed]
    h = a * one
    h ^= h >> np.uint64(32)
    h += b * two  # without a factor, a few changed bytes of one half make up for those of the other
    h *= _C3
    h ^= h >> np.uint64(29)
    h *= _C2
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    return h


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two names."""
    return _mix(_mix(a * _C1 + _C3) + b * _C2)


def _slide(x: np.ndarray, n: int, of) -> np.ndarray:
    """of() over each n neighbours, by doubling."""
    size = 1
    while 2 * size <= n:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


class Texts:
    """The bytes of a batch's texts, end to end."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.bounds = offsets - offsets[0]
        self.size = len(data)
        self.data = np.concatenate([data, np.zeros(128, np.uint8)])
        #: The 8 bytes from each position as one number, without a copy.
        self.words = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))

    def of(self, k: int) -> np.ndarray:
        return self.data[self.bounds[k] : self.bounds[k + 1]]

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def ends(self, a: int, b: int) -> np.ndarray:
        """For each position from a to b, where its text ends."""
        low, high = int(np.searchsorted(self.bounds, a, "right")) - 1, int(np.searchsorted(self.bounds, b, "left"))
        return np.repeat(self.bounds[low + 1 : high + 1], np.diff(np.clip(self.bounds[low : high + 1], a, b)))

    def names(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two names of the 16 bytes from each of these positions."""
        a, b = self.words[at], self.words[at + 8]
        return _name(a, b), _name(a, b, 1)


def picked(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions that some window of LEAST bytes picks, in order, with the first
    and the last window that does, and their names."""
    parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for a in range(0, texts.size, BLOCK):
        b = min(a + BLOCK, texts.size)
        words = texts.words[a : b + REACH + 8].copy()
        h = _name(words[:-8], words[8:])[: b - a + REACH - 1]
        least = _slide((h & ~_SPOT) | np.arange(len(h), dtype=np.uint64), REACH, np.minimum)
        least[np.arange(a + LEAST, b + LEAST) > texts.ends(a, b)] = _NONE
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], b - a) - 1
        spot = least[first]
        ok = spot != _NONE
        spot = (spot[ok] & _SPOT).astype(np.int64)
        parts.append((a + spot, a + first[ok], a + last[ok], h[spot]))
    at, first, last, names = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(at) == 0:
        return at, first, last, names
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))  # a position may be picked from two blocks
    return at[start], first[start], last[np.append(start[1:], len(at)) - 1], names[start]


def contexts(texts: Texts, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """For picked positions with their windows: the name of what the windows
    cover, in two halves, and the names of 32 bytes to the right and to the left."""
    parts = [(np.zeros(0, np.uint64),) * 4]
    for k in range(0, len(at), 1 << 14):
        p, base, final = (x[k : k + (1 << 14)] for x in (at, first, last))
        size = final - base + LEAST
        g = _mix(size.astype(np.uint64) * _C3 + (p - base).astype(np.uint64) * _C1)
        g = [g, g]
        for j in range(0, LEAST + REACH - NAME, NAME):
            named = texts.names(np.minimum(base + j, base + size - NAME))
            more = [_pair(one, n16) for one, n16 in zip(g, named, strict=True)]
            g = more if j + NAME <= LEAST else [np.where(j + NAME <= size, new, old) for new, old in zip(more, g, strict=True)]
        ua, ub = (_pair(one, n16) for one, n16 in zip(g, texts.names(base + size - NAME), strict=True))
        before, here, after = (texts.names(x)[0] for x in (np.maximum(p - _BACK, 0), p, p + _BACK))
        parts.append((ua, ub, _pair(here, after), _pair(before, here)))
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about CHUNK bytes of text; a longer text stands alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _list_bounds(lists: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])


def _starts(*names: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([n[1:] != n[:-1] for n in names])]))


def _over(values: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """A value of each run for each of its rows."""
    return np.repeat(values, np.diff(np.append(start, n)))


# A ``place`` is a number whose two lowest bits tell what the row is, and whose
# other bits tell a position and its windows: each column less is less for Spark
# to move, sort and pass to Python.
#
#: Rows of a sort by name: an occurrence; one that shares its name with another
#: document of its own batch, and so need not be sorted; one of two rows, with
#: the least and the greatest id, that stand for these in the sort.  Beside
#: them: windows that are known to be repeated.
_PLAIN, _SURE, _STANDS, _DONE = 0, 1, 2, 3


def _picked_place(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A position with the first and the last window that picks it: both start at most REACH - 1 bytes before it."""
    return (at << 14) | ((at - first) << 8) | ((at - last) << 2)


def _picked_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 14
    return at, at - ((place >> 8) & 63), at - ((place >> 2) & 63)


def _split_hot(name: np.ndarray, ids: np.ndarray, rest: list[np.ndarray], spread: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(name, [ids, *rest], kind): what a batch sends to the sort by name.  A name with more
    than HOT rows from several documents is sent by two rows, and its own rows under ``spread``:
    a hot one costs the sort a few rows for each batch."""
    if len(name) == 0:
        return name, [ids, *rest], np.zeros(0, np.int64)
    order = np.argsort(name)
    name, spread, ids, *rest = (x[order] for x in (name, spread, ids, *rest))
    start = _starts(name)
    low, high = np.minimum.reduceat(ids, start), np.maximum.reduceat(ids, start)
    hot = (low != high) & (np.diff(np.append(start, len(name))) > HOT)
    sure = _over(hot, start, len(name))
    # Both ends of the range of ids: either may be the one that another batch lacks.
    stands, ends = np.repeat(start[hot], 2), np.stack([low[hot], high[hot]], 1).ravel()
    names = np.concatenate([np.where(sure, spread, name), name[stands]])
    kind = np.concatenate([np.where(sure, _SURE, _PLAIN), np.full(len(stands), _STANDS)])
    return names, [np.concatenate([ids, ends]), *(np.concatenate([x, x[stands]]) for x in rest)], kind


def _suffixes(keys: list[str]):
    """(name, keys, place) of picked positions."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                texts = Texts(part["text"])
                at, first, last, names = picked(texts)
                if len(at) == 0:
                    continue
                owner = texts.owner(at)
                base = texts.bounds[owner]
                ids, *rest = (part[k].to_numpy(zero_copy_only=False)[owner] for k in keys)
                spread = _mix(ids.view(np.uint64) * _C1 + (at - base).astype(np.uint64))
                names, own, kind = _split_hot(names, ids, [*rest, _picked_place(at - base, first - base, last - base)], spread)
                own[-1] |= kind
                yield pa.RecordBatch.from_arrays([_long(x) for x in (names, *own)], names=["name", *keys, "place"])

    return rows


def _gathered(chunks: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Chunks of columns, joined to some GATHERED rows."""
    held, n = [], 0
    for chunk in chunks:
        if len(chunk[0]) == 0:
            continue
        held.append(chunk)
        n += len(chunk[0])
        if n >= GATHERED:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _sorted_by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole names, of rows sorted by the first column.  A name is
    taken up again with the next batch by its last rows."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if len(rows[0]) == 0:
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        held = [x[cut:] for x in rows]
        if cut:
            yield [x[:cut] for x in rows]
    if held is not None and len(held[0]):
        yield held


def _shared(keys: list[str]):
    """(keys, place) of occurrences of names that two documents have, from rows sorted by name."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, *rest, place in _sorted_by_name(batches):
            start = _starts(name)
            kind = place & 3
            free = kind != _SURE
            low = np.minimum.reduceat(np.where(free, ids, np.iinfo(np.int64).max), start)
            high = np.maximum.reduceat(np.where(free, ids, np.iinfo(np.int64).min), start)
            ok = (kind == _SURE) | (_over(low < high, start, len(name)) & (kind == _PLAIN))
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (ids, *rest, place & ~3)], names=[*keys, "place"])

    return kept


def _least_first(na: np.ndarray, nb: np.ndarray, ids: np.ndarray, rest: list[np.ndarray]) -> list[np.ndarray]:
    """The rows (name halves, ids, ...) of a batch with the last column, a place,
    marked 1 except where a smaller document of the batch has the same name.
    Such rows are done with and get a name of their own, so a hot name costs the
    sort no more than a few rows for each batch."""
    order, start = _by_name(na, nb)
    na, nb, ids, *rest = (x[order] for x in (na, nb, ids, *rest))
    rep = ids == _over(np.minimum.reduceat(ids, start), start, len(ids))
    spread = _mix(ids.view(np.uint64) * _C1 + np.arange(len(ids), dtype=np.uint64))
    return [np.where(rep, na, spread), np.where(rep, nb, np.uint64(0)), ids, *rest[:-1], rest[-1] | rep]


def _by_name(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by names in two halves, and where each name starts in it."""
    order = np.argsort(na)
    a, b = na[order], nb[order]
    start = _starts(a)
    if len(start) < len(a):  # equal first halves rarely have unequal second ones
        within = np.ones(len(a), bool)
        within[start] = False
        if (within[1:] & (b[1:] != b[:-1])).any():
            order = np.lexsort((nb, na))
            start = _starts(na[order], nb[order])
    return order, start


def _contexts(keys: list[str]):
    """(ua, ub, keys, place, right, left): a row for each position that a window picks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                texts = Texts(part["text"])
                row = np.repeat(np.arange(part.num_rows), np.diff(_list_bounds(part["places"])))
                place = part["places"].flatten().to_numpy(zero_copy_only=False)
                if len(place) == 0:
                    continue
                base = texts.bounds[row]
                ua, ub, right, left = contexts(texts, *(x + base for x in _picked_of(place)))
                ids, *rest = (part[k].to_numpy(zero_copy_only=False)[row] for k in keys)
                ua, ub, *own, right, left, place = _least_first(ua, ub, ids, [*rest, right, left, place])
                yield pa.RecordBatch.from_arrays([_long(x) for x in (ua, ub, *own, place, right, left)], names=["ua", "ub", *keys, "place", "right", "left"])

    return rows


def _ranked(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """From rows sorted by the first half of their name (two columns; then doc_id):
    the other columns, and which rows are marked in column ``place`` and in the least document of their name."""
    for rows in _sorted_by_name(batches):
        order, start = _by_name(rows[0], rows[1])
        rows = [x[order] for x in rows]
        rep, ids = (rows[place] & 1).astype(bool), rows[2]
        least = np.minimum.reduceat(np.where(rep, ids, np.iinfo(np.int64).max), start)
        yield rows[2:], rep & (ids == _over(least, start, len(ids)))


def _united(own: list[np.ndarray], first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Columns of the maximal runs of each document's [first, end)."""
    if len(first) == 0:
        return [*own, first, end]
    order = np.lexsort((first, *own[::-1]))
    own, first, end = [x[order] for x in own], first[order], end[order]
    start = _starts(*own)
    group = _over(np.arange(len(start)), start, len(first)) << 32
    most = np.maximum.accumulate(group + end)
    new = np.flatnonzero(np.concatenate([[True], (group + first)[1:] > most[:-1]]))
    return [*(x[new] for x in own), first[new], (most - group)[np.append(new[1:], len(first)) - 1]]


def _first_of_context(keys: list[str]):
    """(name, keys, first, last, kind) from rows sorted by context: windows that a smaller document
    has too (_DONE), and for the others the names of the 32 bytes that they share."""
    columns, n = ["name", *keys, "first", "last", "kind"], len(keys)

    def batch_of(name: np.ndarray, own: list[np.ndarray], first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_long(name), *(pa.array(x) for x in own), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(kind.astype(np.int8))], names=columns)

    def sides(rows: list[np.ndarray], firsts: np.ndarray) -> pa.RecordBatch:
        *own, place, right, left = (x[firsts] for x in rows)
        at, first, last = _picked_of(place)
        # Windows from `at - _BACK` on cover the 32 bytes to the right, earlier ones those to the left.
        low, high = np.concatenate([np.maximum(first, at - _BACK), first]), np.concatenate([last, np.minimum(last, at - _BACK - 1)])
        ok = low <= high
        name, low, high, ids, *rest = (x[ok] for x in (np.concatenate([right, left]), low, high, *(np.concatenate([x, x]) for x in own)))
        spread = _mix(ids.view(np.uint64) * _C1 + low.astype(np.uint64)).view(np.int64)
        name, own, kind = _split_hot(name, ids, [*rest, low, high], spread)
        return batch_of(name, own[:-2], own[-2], own[-1], kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *rows, firsts in _gathered([*rows, firsts] for rows, firsts in _ranked(batches, n + 2)):
            yield sides(rows, firsts)
            *own, place, _, _ = (x[~firsts] for x in rows)
            _, first, last = _picked_of(place)
            *own, first, end = _united(own, first, last + LEAST)
            yield batch_of(np.zeros(len(first), np.int64), own, first, end - LEAST, np.full(len(first), _DONE))

    return rows


def _windows(keys: list[str]):
    """(na, nb, keys, place): a row for each window of the runs, with its name."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                texts = Texts(part["text"])
                row = np.repeat(np.arange(part.num_rows), np.diff(_list_bounds(part["runs"])))
                runs = part["runs"].flatten().to_numpy(zero_copy_only=False)
                first, n = runs >> 8, ((runs >> 2) & 63) + 1
                own = [part[k].to_numpy(zero_copy_only=False) for k in keys]
                owner = np.repeat(row, n)
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                for k in range(0, len(at), 1 << 17):
                    w, o = at[k : k + (1 << 17)], owner[k : k + (1 << 17)]
                    named = [texts.names(texts.bounds[o] + w + j) for j in (0, _BACK, _NEXT, _NEXT + _BACK)]
                    # Names of 50 bytes: two names of 32, each of two names of 16 with no byte between them.
                    na, nb = (_pair(_pair(a, b), _pair(c, d)) for a, b, c, d in zip(*named, strict=True))
                    ids, *rest = (x[o] for x in own)
                    yield pa.RecordBatch.from_arrays([_long(x) for x in _least_first(na, nb, ids, [*rest, w << 2])], names=["na", "nb", *keys, "place"])

    return rows


def _repeated_windows(keys: list[str]):
    """(keys, first, end) from rows sorted by window: what windows cover that a smaller document has too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *own, place in _gathered([x[~firsts] for x in rows] for rows, firsts in _ranked(batches, len(keys) + 2)):
            *own, first, end = _united(own, place >> 2, (place >> 2) + LEAST)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], names=[*keys, "first", "end"])

    return rows


def _merged(first: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of a union of [first, end)."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return list(zip(first[new].tolist(), end[np.append(new[1:] - 1, len(end) - 1)].tolist(), strict=True))


def _cut(with_text: bool):
    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = Texts(batch["text"])
            bounds = _list_bounds(batch["runs"])
            runs = batch["runs"].flatten().to_numpy(zero_copy_only=False)
            first, end = runs >> 32, runs & 0xFFFFFFFF
            sizes, removed, spans, digests, kept_texts = [], [], [], [], []
            for k in range(batch.num_rows):
                data = texts.of(k).tobytes()
                cuts = _merged(first[bounds[k] : bounds[k + 1]], end[bounds[k] : bounds[k + 1]]) if bounds[k] < bounds[k + 1] else []
                kept, done = [], 0
                for a, b in cuts:
                    kept.append(data[done:a])
                    done = b
                left = b"".join([*kept, data[done:]])
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(len(cuts))
                if with_text:
                    kept_texts.append(left)
                else:
                    digests.append(hashlib.sha256(left).hexdigest())
            last = pa.array(kept_texts, pa.binary()) if with_text else pa.array(digests, pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), last], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if with_text else "kept_sha256"])

    return results


def repeated_runs(docs: DataFrame, repeated_ids: bool = True) -> DataFrame:
    """(doc_id, version, first, end): ranges of repeated bytes, not yet merged.

    ``docs`` has doc_id, text and version, which tells rows apart that share an
    id but not a text; without ``repeated_ids`` version is neither needed nor
    returned.  Null ids must be gone.
    """
    keys = _keys(repeated_ids)
    own = ", ".join(f"{k} long" for k in keys)
    docs = docs.select(*keys, "text")
    gathered = F.collect_set if repeated_ids else F.collect_list  # repeated rows have the same places

    def places_of_shared(rows: DataFrame, name: str) -> DataFrame:
        """A row per document: the places of names that another document has too."""
        kept = rows.repartition("name").sortWithinPartitions("name").mapInArrow(_shared(keys), f"{own}, place long")
        return common.written(kept.groupBy(*keys).agg(gathered("place").alias("places")), name)

    places = places_of_shared(docs.mapInArrow(_suffixes(keys), f"name long, {own}, place long"), "suffix-places")

    # Sorts are by one number, which Spark does by radix; equal first halves of names are told apart afterwards.
    named = docs.join(places, keys).select(*keys, "text", "places").mapInArrow(_contexts(keys), f"ua long, ub long, {own}, place long, right long, left long")
    ranked = named.repartition("ua").sortWithinPartitions("ua").mapInArrow(_first_of_context(keys), f"name long, {own}, first int, last int, kind byte")
    ranked = common.written(ranked, "suffix-contexts")
    whole = ranked.where(F.col("kind") == _DONE).select(*keys, "first", (F.col("last") + LEAST).alias("end"))

    run = F.shiftleft(F.col("first").cast("long"), 8) + F.shiftleft(F.col("last") - F.col("first"), 2) + F.col("kind")
    open_ = places_of_shared(ranked.where(F.col("kind") != _DONE).select("name", *keys, run.alias("place")), "suffix-open")
    windows = docs.join(open_, keys).select(*keys, "text", F.col("places").alias("runs")).mapInArrow(_windows(keys), f"na long, nb long, {own}, place long")
    single = windows.repartition("na").sortWithinPartitions("na").mapInArrow(_repeated_windows(keys), f"{own}, first int, end int")
    return whole.unionByName(common.written(single, "suffix-windows"))


def _keys(repeated_ids: bool) -> list[str]:
    return ["doc_id", "version"] if repeated_ids else ["doc_id"]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256,
    or with ``with_text`` the kept bytes (``kept``, binary).

    Removes each byte of a 50-byte string that also starts in a document with a
    smaller id.  A null text counts as empty; a document without an id takes no
    part and stays whole; rows that share an id do not count against each other.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared_ids = not own.groupBy("doc_id").count().where("doc_id is not null and count > 1").isEmpty()
    keys = _keys(shared_ids)
    if shared_ids:
        own = own.withColumn("version", F.xxhash64("text"))
    run = F.shiftleft(F.col("first").cast("long"), 32) + F.col("end")
    runs = repeated_runs(own.where("doc_id is not null"), shared_ids).groupBy(*keys).agg((F.collect_set if shared_ids else F.collect_list)(run).alias("runs"))
    last = "kept binary" if with_text else "kept_sha256 string"
    return own.join(runs, keys, "left").select("doc_id", "text", "runs").mapInArrow(_cut(with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
