"""Exact substring dedup with suffix arrays by linear grouping.

A byte goes if a LENGTH-byte string over it also starts in a document with a
smaller id. Texts are dealt into blocks by a hash. Every LENGTH-byte window is
filed under its minimizer, the gram of least hash in it, so equal windows are
filed alike; windows in a row with one minimizer make up one stretch of text.
Blocks tell which minimizers they have, hear which ones others have, too, and
send only stretches under those. Where one minimizer has differing stretches,
a suffix array over them finds the windows they share. All comparisons are of
bytes; hashes only decide what meets.

The suffix array is built without renaming: suffixes are put in groups by
their longest Lyndon prefix, groups are taken in descending order and extend
the groups of the previous smaller suffixes, and one last pass writes out the
order of each group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a string whose repeats go, and of the gram that files it.
LENGTH, GRAM = 50, 20
#: Step of the sides looked at around a gram, and the bytes on both sides that must agree then.
STEP = 5
SIDES = LENGTH - GRAM - STEP + 1
#: Text bytes of a block, of a bucket's share, of what numpy works on at once and of one suffix array.
BLOCK_BYTES, BUCKET_BYTES, PIECE_BYTES, SORT_BYTES = 4 << 20, 4 << 20, 1 << 17, 1 << 17
#: Blocks that have a minimizer beyond which its stretches are filed in parts.
SPLIT_BLOCKS = 1024
#: Low bits of the number that ranks a gram that hold its place; the rest are hash bits.
PLACE_BITS = 24


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in order. The last item must be the unique smallest.

    ``group[i]`` is where the group of suffix i begins in ``order``; groups
    are ordered by it. ``smaller[i]`` is the nearest suffix to the left that
    is smaller, known as soon as i's group is taken.
    """
    n = len(text)
    starts = [0] * (max(text) + 2)
    for x in text:
        starts[x + 1] += 1
    for x in range(1, len(starts)):
        starts[x] += starts[x - 1]
    group, size, fill = [starts[x] for x in text], [0] * (n + 1), starts[:]
    order, place, smaller = [0] * n, [0] * n, [-1] * n
    for i, x in enumerate(text):
        place[i], order[fill[x]] = fill[x], i
        fill[x] += 1
        size[starts[x]] += 1

    end = n
    while end > 0:
        now = group[order[end - 1]]
        hits: dict[int, int] = {}
        for s in sorted(order[now:end]) if end - now > 1 else (order[now],):
            p = s - 1
            while p >= 0 and group[p] >= now:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        end = now
        by_count: dict[int, list[int]] = {}
        for p, count in hits.items():
            if count in by_count:
                by_count[count].append(p)
            else:
                by_count[count] = [p]
        for count in sorted(by_count, reverse=True) if len(by_count) > 1 else by_count:
            leaving: dict[int, int] = {}
            for p in by_count[count]:  # to the back of their groups
                old = group[p]
                gone = leaving.get(old, 0)
                leaving[old] = gone + 1
                last, at = old + size[old] - 1 - gone, place[p]
                other = order[last]
                order[at], place[other], order[last], place[p] = other, at, p, last
            for old, gone in leaving.items():  # and out, as groups of their own behind them
                if stay := size[old] - gone:
                    size[old], size[old + stay] = stay, gone
                    for at in range(old + stay, old + stay + gone):
                        group[order[at]] = old + stay

    out, front, done = [0] * n, list(range(n + 1)), bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            at = front[group[j]]
            front[group[j]] = at + 1
            out[at], done[j] = j, 1
            j = smaller[j]
    return out


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, built by doubling."""
    part, size, base = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
    whole, have, left = None, 0, GRAM
    power = {1: base}
    while True:
        if left & 1:
            if whole is None:
                whole, have = part, size
            else:
                n = len(raw) - have - size + 1
                whole, have = whole[:n] * np.uint64(power[size]) + part[have : have + n], have + size
        left >>= 1
        if not left:
            break
        n = len(raw) - 2 * size + 1
        part = part[:n] * np.uint64(power[size]) + part[size : size + n]
        power[2 * size] = power[size] ** 2 % (1 << 64)
        size *= 2
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return whole ^ (whole >> np.uint64(29))


_BASE = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def stretches(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, length, minimizer's hash, hash of the whole, gram's offset, text number) of each stretch.

    ``bounds`` are the places where texts begin in ``raw``, with the end. No
    window crosses one.
    """
    if len(raw) < LENGTH:
        return tuple(np.zeros(0, t) for t in KINDS)
    hashes = _gram_hashes(raw)
    rank = hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    least, width, wide = rank, 1, LENGTH - GRAM + 1
    while 2 * width <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    inside = np.arange(len(at)) + LENGTH <= bounds[text + 1]
    fresh, final = inside.copy(), inside.copy()
    change = at[1:] != at[:-1]
    fresh[1:] &= change | ~inside[:-1]
    final[:-1] &= change | ~inside[1:]
    first = np.flatnonzero(fresh)
    end = np.flatnonzero(final) + LENGTH
    filed = hashes[at[first]] * np.uint64(0x94D049BB133111EB)  # least hashes are small ones; spread them over all buckets
    filed ^= filed >> np.uint64(32)
    up, down = _powers(1 << (len(raw) - 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    whole = (sums[end] - sums[first]) * down[first]
    return first, end - first, filed * np.uint64(_BASE), whole ^ (whole >> np.uint64(32)), at[first] - first, text[first]


#: Types of the six columns of ``stretches``.
KINDS = (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in few bytes: byte planes, compressed."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes()) for a in arrays]
    return zstandard.compress(pickle.dumps(planes), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(-1, n).T).reshape(-1).view(t) if n else np.zeros(0, t) for t, n, b in pickle.loads(zstandard.decompress(blob))]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of pieces given by start and size, one piece after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts, sizes)


def _differ(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For pairs of pieces of one size: whether their bytes differ."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        unequal = raw[_spread(a[part], sizes[part])] != raw[_spread(b[part], sizes[part])]
        out[part] = np.logical_or.reduceat(unequal, np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
    return out


def _hash(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of the bytes of short pieces, byte by byte."""
    out, by = sizes.astype(np.uint64), np.argsort(-sizes, kind="stable")
    starts, sizes, hashes = starts[by], sizes[by], out[by]
    for k in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(-sizes, -k, "left"))  # pieces of more than k bytes come first
        hashes[:n] = (hashes[:n] ^ raw[starts[:n] + k]) * np.uint64(_BASE)
        hashes[:n] ^= hashes[:n] >> np.uint64(32)
    out[by] = hashes
    return out


def distinct(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, h: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by minimizer that puts equal stretches together, and where each distinct one begins in it.

    Hashes bring them together and bytes are compared; stretches that only
    share their hashes are told apart.
    """
    whole = whole.copy()
    while True:
        order = np.lexsort((sizes, whole, h))
        head = np.ones(len(order), bool)
        x, y = order[1:], order[:-1]
        head[1:] = (h[x] != h[y]) | (whole[x] != whole[y]) | (sizes[x] != sizes[y])
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        rest = np.flatnonzero(~head)
        wrong = order[rest][_differ(raw, starts[order[rest]], starts[first[rest]], sizes[order[rest]])]
        if not len(wrong):
            return order, np.flatnonzero(head)
        whole[wrong] += np.uint64(1)


class Filed(NamedTuple):
    """What of a block is filed where; ``code`` names a stretch, or a part of one, within its block."""

    start: np.ndarray
    size: np.ndarray
    h: np.ndarray
    whole: np.ndarray
    offset: np.ndarray
    text: np.ndarray
    code: np.ndarray


#: Codes that a stretch has: its own and one for each part.
CODES = 8


class Block:
    """The texts of a block in canonical order, and their stretches. Rows without id come last and have none."""

    def __init__(self, table: pa.Table):
        ids, texts = table["__id"].to_pylist(), table["__text"].to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.ids = np.array([ids[i] for i in self.order if ids[i] is not None], np.int64)
        named = self.texts[: len(self.ids)]
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in named], dtype=np.int64)])
        self.raw = np.frombuffer(b"".join(named), np.uint8)
        parts = [tuple(np.zeros(0, t) for t in KINDS), *self._pieces()]
        self.start, self.size, self.h, self.whole, self.offset, self.text = (np.concatenate(c) for c in zip(*parts, strict=True))

    def filed(self, wanted: np.ndarray | None, hot: np.ndarray) -> "Filed":
        """Stretches under the wanted minimizers (None: all), those under hot ones in parts.

        One very common gram would bring countless stretches together. A part
        has the windows that begin i to i + STEP - 1 bytes before the gram and
        is filed under the bytes that all such windows share, so that each
        window of the stretch is in one part and meets its equals there.
        """
        split = _among(self.h, hot)
        plain = np.flatnonzero(~split if wanted is None else ~split & _among(self.h, wanted))
        rows = [(self.start[plain], self.size[plain], self.h[plain], self.whole[plain], self.offset[plain], self.text[plain], plain * CODES)]
        for k, i in enumerate(range(0, LENGTH - GRAM + 1, STEP), 1):
            if not split.any():
                break
            at, gram, size = np.flatnonzero(split), self.offset[split], self.size[split]
            lo, hi = np.maximum(0, gram - min(i + STEP - 1, LENGTH - GRAM)), np.minimum(size, gram + LENGTH - i)
            fits = hi - lo >= LENGTH
            at, gram, lo, hi = at[fits], gram[fits], lo[fits], hi[fits]
            start, size = self.start[at] + lo, hi - lo
            shared = _hash(self.raw, self.start[at] + gram - i, np.full(len(at), GRAM + SIDES))
            rows.append((start, size, shared ^ (self.h[at] * np.uint64(2 * k + 1)), _hash(self.raw, start, size), gram - lo, self.text[at], at * CODES + k))
        return Filed(*(np.concatenate(c) for c in zip(*rows, strict=True)))

    def _pieces(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Stretches of texts put together, and of parts of a long text that overlap by one window less a byte."""
        step, lo = 8 * PIECE_BYTES, 0
        for i in range(1, len(self.bounds)):
            a, b = int(self.bounds[lo]), int(self.bounds[i])
            if i + 1 < len(self.bounds) and int(self.bounds[i + 1]) - a <= PIECE_BYTES:
                continue
            if i - lo > 1 or b - a <= step:
                spans = [(a, b, self.bounds[lo : i + 1] - a)]
            else:
                spans = [(x, y := min(b, x + step + LENGTH - 1), np.array([0, y - x])) for x in range(a, b - LENGTH + 1, step)]
            for x, y, bounds in spans:
                start, *rest, text = stretches(self.raw[x:y], bounds)
                yield start + x, *rest, text + lo
            lo = i


def _minimizers(buckets: int):
    """Block to (bucket, block, blob): its minimizers, and which of them two ids have."""

    def run(key, table):
        block = Block(table)
        by = np.argsort(block.h, kind="stable")
        h, d = block.h[by], block.ids[block.text[by]]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
        several = np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new) if len(h) else np.zeros(0, bool)
        h = h[new]
        return _dealt(key[0].as_py(), h, buckets, lambda a, b: pack(np.diff(h[a:b], prepend=np.uint64(0)), several[a:b]))

    return run


def _dealt(block: int, h: np.ndarray, buckets: int, blob) -> pa.Table:
    """Rows (bucket, block, blob) for sorted hashes cut by equal ranges."""
    cuts = np.searchsorted(h, np.array([(k << 64) // buckets for k in range(buckets)], np.uint64))
    cuts = [*cuts.tolist(), len(h)]
    rows = [(k, block, blob(a, b)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


DEALT = "bucket int, block int, blob binary"


def _among(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which hashes stand in a sorted array."""
    if not len(wanted):
        return np.zeros(len(h), bool)
    near = np.searchsorted(wanted, h)
    near[near == len(wanted)] = 0
    return wanted[near] == h


def _sharer(split_blocks: int):
    """Bucket to (block, blob): the block's minimizers that more than one id has, and which of them very many blocks have."""

    def run(key, table):
        blocks, own, several = table["block"].to_pylist(), [], []
        for blob in table["blob"].to_pylist():
            h, s = unpack(blob)
            own.append(np.cumsum(h, dtype=np.uint64))
            several.append(s)
        every, which = np.sort(np.concatenate(own)), np.unique(np.concatenate([h[s] for h, s in zip(own, several, strict=True)]))
        heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        times, every = np.diff(np.r_[heads, len(every)]), every[heads]
        wanted, hot = every[(times > 1) | _among(every, which)], every[times > split_blocks]
        rows = [(b, pack(np.diff(x, prepend=np.uint64(0)), _among(x, hot))) for b, h in zip(blocks, own, strict=True) if len(x := h[_among(h, wanted)])]
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _senders(buckets: int):
    """Block and its shared minimizers to (bucket, block, blob): the distinct stretches under those."""

    def run(key, table, shared):
        if not table.num_rows or not shared.num_rows:
            return _dealt(-1, np.zeros(0, np.uint64), buckets, None)
        h, hot = (np.concatenate(c) for c in zip(*((np.cumsum(d, dtype=np.uint64), flag) for d, flag in map(unpack, shared["blob"].to_pylist())), strict=True))
        by, block = np.argsort(h), Block(table)
        f = block.filed(h[by], np.sort(h[hot]))
        order, heads = distinct(block.raw, f.start, f.size, f.h, f.whole)
        one, ids = order[heads], block.ids[f.text[order]]
        least, several = np.minimum.reduceat(ids, heads), np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)

        def blob(a: int, b: int) -> bytes:
            i = one[a:b]
            columns = (f.code[i], f.offset[i].astype(np.uint8), least[a:b], several[a:b], f.size[i].astype(np.uint8))
            return pack(np.diff(f.h[i], prepend=np.uint64(0)), *columns, block.raw[_spread(f.start[i], f.size[i])])

        return _dealt(key[0].as_py(), f.h[one], buckets, blob)

    return run


def _may_share(group: list[tuple[bytes, int]]) -> list[tuple[int, int] | None]:
    """For each (stretch, gram's offset): the part that could hold a window of another one, or None.

    A window that begins ``a`` bytes before the gram has, for the multiple i of
    STEP below a, the i bytes on the left of the gram and the SIDES - i on its
    right in common with every other such window. What lies outside of all
    windows for which another stretch agrees so far is in no common window.
    """
    seen: dict[tuple[int, bytes], int] = {}
    for s, o in group:
        for i in range(0, min(o, LENGTH - GRAM) + 1, STEP):
            if len(s) >= o + GRAM + SIDES - i:
                key = (i, s[o - i : o + GRAM + SIDES - i])
                seen[key] = seen.get(key, 0) + 1
    parts = []
    for s, o in group:
        fits = [i for i in range(0, min(o, LENGTH - GRAM) + 1, STEP) if seen.get((i, s[o - i : o + GRAM + SIDES - i]), 0) > 1]
        lo, hi = (max(0, o - fits[-1] - STEP + 1), min(len(s), o + LENGTH - fits[0])) if fits else (0, 0)
        parts.append((lo, hi) if hi - lo >= LENGTH else None)
    return parts


def least_ids(parts: list[bytes], ids: list[int]) -> list[np.ndarray]:
    """For each window of each part: the smallest id of a part that has this window."""
    text: list[int] = []
    begin = []
    for part in parts:
        begin.append(len(text))
        text += [b + 2 for b in part]
        text.append(1)
    text.append(0)
    counts = np.array([len(p) - LENGTH + 1 for p in parts])
    owner = np.full(len(text), -1, np.int64)
    for i, (b, c) in enumerate(zip(begin, counts.tolist(), strict=True)):
        owner[b : b + c] = i
    order = np.array(suffix_array(text))
    order = order[owner[order] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(np.array(text, np.int16), LENGTH)
    new = np.ones(len(order), bool)
    for lo in range(1, len(order), 1 << 14):
        hi = min(len(order), lo + (1 << 14))
        new[lo:hi] = (rows[order[lo:hi]] != rows[order[lo - 1 : hi - 1]]).any(1)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(np.array(ids, np.int64)[owner[order]], heads)
    found = np.empty(len(text), np.int64)
    found[order] = np.repeat(least, np.diff(np.r_[heads, len(order)]))
    return [found[b : b + c] for b, c in zip(begin, counts.tolist(), strict=True)]


def _runs(stretch: list[bytes], offset: list[int], least: np.ndarray, groups: list[tuple[int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of windows (first, last, smallest id) of stretches in groups that share a minimizer.

    Stretches without any window in common with another one are left out.
    """
    found: dict[int, list[tuple[int, int, int]]] = {}
    waiting: list[tuple[int, int, int]] = []
    parts_of: dict[bytes, int] = {}  # part of a waiting stretch: smallest id
    size = 0

    def sort_waiting() -> None:
        nonlocal size
        mins_of = dict(zip(parts_of, least_ids(list(parts_of), list(parts_of.values())), strict=True))
        for i, lo, hi in waiting:
            mins = mins_of[stretch[i][lo:hi]]
            heads = np.flatnonzero(np.r_[True, mins[1:] != mins[:-1]]).tolist()
            runs = [(lo + a, lo + b - 1, int(mins[a])) for a, b in zip(heads, [*heads[1:], len(mins)], strict=True)]
            own, last = int(least[i]), len(stretch[i]) - LENGTH
            found[i] = [r for r in ((0, lo - 1, own), *runs, (hi - LENGTH + 1, last, own)) if r[0] <= r[1]]
        waiting.clear()
        parts_of.clear()
        size = 0

    for a, b in groups:
        for i, part in enumerate(_may_share(list(zip(stretch[a:b], offset[a:b], strict=True))), a):
            if part is not None:
                waiting.append((i, *part))
                text = stretch[i][part[0] : part[1]]
                size += 0 if text in parts_of else len(text)
                parts_of[text] = min(parts_of.get(text, int(least[i])), int(least[i]))
        if size >= SORT_BYTES:
            sort_waiting()
    if waiting:
        sort_waiting()
    return found


def _resolve(key, table):
    """Bucket to (block, blob): for each sent stretch the smallest id of each of its windows."""
    blocks = table["block"].to_pylist()
    columns = [unpack(b) for b in table["blob"].to_pylist()]
    h = np.concatenate([np.cumsum(c[0], dtype=np.uint64) for c in columns])
    number, offset, least, several, size, raw = (np.concatenate([c[k] for c in columns]) for k in range(1, 7))
    owner = np.repeat(np.arange(len(blocks)), [len(c[0]) for c in columns])
    size = size.astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    order, heads = distinct(raw, starts, size, h, _hash(raw, starts, size))
    one = order[heads]
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
    smallest = np.minimum.reduceat(least[order], heads)
    edges = np.flatnonzero(np.r_[True, h[one][1:] != h[one][:-1], True])
    crowd = np.diff(edges) > 1
    mixed = [(int(a), int(b)) for a, b in zip(edges[:-1][crowd], edges[1:][crowd], strict=True)]
    flat = np.concatenate([np.arange(a, b) for a, b in mixed] or [np.zeros(0, np.int64)])
    text = raw.tobytes()
    strings = [text[s : s + n] for s, n in zip(starts[one[flat]].tolist(), size[one[flat]].tolist(), strict=True)]
    cuts = np.concatenate([[0], np.cumsum([b - a for a, b in mixed], dtype=np.int64)]).tolist()
    found = _runs(strings, offset[one[flat]].tolist(), smallest[flat], list(zip(cuts[:-1], cuts[1:], strict=True)))

    count = np.ones(len(one), np.int64)
    special = sorted(found)
    count[flat[special]] = [len(found[i]) for i in special]
    begin = np.concatenate([[0], np.cumsum(count)])
    first, last, lowest = np.zeros(begin[-1], np.int64), np.repeat(size[one] - LENGTH, count), np.repeat(smallest, count)
    if special:
        at = _spread(begin[flat[special]], count[flat[special]])
        first[at], last[at], lowest[at] = np.array([r for i in special for r in found[i]], np.int64).T

    run = _spread(begin[which], count[which])
    entry = np.repeat(np.arange(len(which)), count[which])
    keep = (lowest[run] < least[entry]) | several[entry]
    run, entry = run[keep], entry[keep]
    ends = np.searchsorted(owner[entry], np.arange(len(blocks) + 1)).tolist()
    rows = [(b, pack(number[entry[x:y]], first[run[x:y]].astype(np.uint8), last[run[x:y]].astype(np.uint8), lowest[run[x:y]])) for b, x, y in zip(blocks, ends, ends[1:], strict=False) if y > x]
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _removed(block: Block, answers: list[bytes]) -> np.ndarray:
    """Which bytes of the block's texts go."""
    depth = np.zeros(len(block.raw) + 1, np.int32)
    if answers:
        number, first, last, lowest = (np.concatenate(c) for c in zip(*map(unpack, answers), strict=True))
        order = np.argsort(number, kind="stable")
        number, first, last, lowest = number[order], first[order].astype(np.int64), last[order].astype(np.int64), lowest[order]
        codes, begin, count = np.unique(number, return_index=True, return_counts=True)
        f = block.filed(None, np.unique(block.h[codes[codes % CODES > 0] // CODES]))
        place = np.argsort(f.code)
        reps = place[np.searchsorted(f.code[place], codes)]
        by = np.argsort(f.whole[reps], kind="stable")
        marks = f.whole[reps[by]]
        pick = np.flatnonzero(_among(f.whole, np.unique(marks)))
        lo, hi = np.searchsorted(marks, f.whole[pick], "left"), np.searchsorted(marks, f.whole[pick], "right")
        pick, like = np.repeat(pick, hi - lo), by[_spread(lo, hi - lo)]  # hashes that two distinct stretches share give both
        fits = (f.size[pick] == f.size[reps[like]]) & (f.h[pick] == f.h[reps[like]])
        pick, like = pick[fits], like[fits]
        fits = ~_differ(block.raw, f.start[pick], f.start[reps[like]], f.size[pick])
        pick, like = pick[fits], like[fits]
        run, pick = _spread(begin[like], count[like]), np.repeat(pick, count[like])
        goes = lowest[run] < block.ids[f.text[pick]]
        run, pick = run[goes], pick[goes]
        np.add.at(depth, f.start[pick] + first[run], 1)
        np.subtract.at(depth, f.start[pick] + last[run] + LENGTH, 1)
    return np.cumsum(depth[:-1]) > 0


def _whole(text: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask with every character of which a byte goes."""
    heads = np.flatnonzero((text & 0xC0) != 0x80)
    if not len(heads) or heads[0]:
        heads = np.r_[0, heads]
    return np.repeat(np.logical_or.reduceat(mask, heads), np.diff(np.r_[heads, len(text)]))


def _apply(others: list[str], characters: bool):
    """Block and its answers to the documents with what is left of them."""

    def run(key, table, answers):
        block = Block(table)
        gone = _removed(block, answers["blob"].to_pylist())
        kept, removed, spans = [], [], []
        for i, text in enumerate(block.texts):
            mask = gone[block.bounds[i] : block.bounds[i + 1]] if i < len(block.ids) else gone[:0]
            if characters and mask.any():
                mask = _whole(np.frombuffer(text, np.uint8), mask)
            n = int(np.count_nonzero(mask))
            kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if n else text)
            removed.append(n)
            spans.append(int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if n else 0)
        out = table.take(pa.array(block.order, pa.int64())).select(others)
        for name, values, kind in (("n_bytes", [len(t) for t in block.texts], pa.int64()), ("n_removed", removed, pa.int64()), ("n_spans", spans, pa.int64()), ("kept", kept, pa.binary())):
            out = out.append_column("__" + name, pa.array(values, kind))
        return out

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, split_blocks: int = SPLIT_BLOCKS, characters: bool = False) -> DataFrame:
    """All rows with ``__n_bytes``, ``__n_removed``, ``__n_spans`` and ``__kept`` (binary) beside their columns.

    Ids are integers. Null text counts as empty; texts of fewer than LENGTH
    bytes lose nothing. Rows that share an id take nothing from each other;
    rows without id neither lose bytes nor cost others any. The text column
    itself is left out. The shuffles of the texts are one and the same; what
    is sent between blocks and buckets is bounded by the number of blocks for
    any one stretch, however many documents have it; a minimizer that more
    than ``split_blocks`` blocks have is split by the bytes around it. With
    ``characters`` a character of which a byte goes is removed whole.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks, buckets = max(1, -(-size // block_bytes)), max(1, -(-size // BUCKET_BYTES))
    others = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    dealt = docs.select(*others, F.col(id_col).cast("long").alias("__id"), text.alias("__text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("__block"))
    texts = dealt.groupBy("__block")
    own = texts.applyInArrow(_minimizers(buckets), DEALT)
    shared = own.groupBy("bucket").applyInArrow(_sharer(split_blocks), "block int, blob binary")
    sent = texts.cogroup(shared.groupBy("block")).applyInArrow(_senders(buckets), DEALT)
    answers = sent.groupBy("bucket").applyInArrow(_resolve, "block int, blob binary")
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "__n_bytes long, __n_removed long, __n_spans long, __kept binary"])
    return texts.cogroup(answers.groupBy("block")).applyInArrow(_apply(others, characters), schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeats cut out of their text; characters cut in half go whole, all others stay. A null text becomes an empty one."""
    left = remove_repeats(docs, id_col, text_col, characters=True)
    kept = left.withColumn(text_col, F.col("__kept").cast("string"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length(text_col)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(*docs.columns)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeats of 50 bytes in all documents."""
    left = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return left.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.sha2("__kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, s, substr(x, 2 * s + 1, {2 * LENGTH}) AS k FROM (SELECT r, doc_id, x, unnest(range(0, greatest(len(x) // 2 - {LENGTH - 1}, 0))) AS s FROM d WHERE doc_id IS NOT NULL)),
f AS (SELECT k, min(doc_id) AS m FROM w GROUP BY k),
hit AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + {LENGTH}, true)::INT AS fresh FROM w JOIN f USING (k) WHERE m < doc_id),
run AS (SELECT r, min(s) AS a, max(s) + {LENGTH} AS b FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM hit) GROUP BY r, g),
gap AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM run),
cut AS (SELECT r, count(*) AS n, sum(b - a) AS gone, max(b) AS last, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
