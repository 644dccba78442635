"""Suffix order and common prefixes of a shard by external induced sorting.

Suffixes are of type S (smaller than their successor) or L. The S suffixes that follow an L suffix are the seeds; their order
comes from naming the substrings between them and, if names repeat, from sorting the sequence of names the same way. Two
inductions follow: seeds give the order of all L suffixes, these give the order of all S suffixes. In each, entries leave a
priority queue in suffix order and insert the suffix one position before them, if it has the type at hand.

The queue is monotone, so every symbol owns a stretch of slots that is filled from the front and read once in order. Slots
live in files: an entry is a position and the length of the prefix it shares with the entry before it. Entries are taken in
runs that do not insert anything into themselves, and handled as arrays. Shared lengths are carried along: what two
neighbours of one symbol share is one more than the least shared length between the entries that inserted them.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

from tallyhouse.llm.common import powers

RUN = 1 << 16  # entries taken from the queue at a time at most
FEW = 1 << 19  # a sequence of names of at most this length is ordered by doubling: the end of the recursion
IN_MEMORY = 1 << 20  # slots below which no file is made


class Slots:
    """The queue's slots: ``positions`` (-1 where still empty) and, if asked for, ``shared``; files in ``folder``."""

    def __init__(self, n: int, folder: Path, with_shared: bool) -> None:
        def space(kind: type) -> np.ndarray:
            if n < IN_MEMORY:
                return np.zeros(n, kind)
            with tempfile.NamedTemporaryFile(dir=folder) as file:  # the mapping outlives the name
                file.truncate(n * np.dtype(kind).itemsize)
                return np.memmap(file.name, kind, "r+", shape=(n,))

        self.positions = space(np.int32)
        for at in range(0, n, RUN):
            self.positions[at : at + RUN] = -1
        self.shared = space(np.int16) if with_shared else None


def s_types(symbols: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the last one, a unique least symbol, is."""
    change = np.flatnonzero(symbols[1:] != symbols[:-1])
    out = np.ones(len(symbols), bool)
    if len(change):
        out[: change[-1] + 1] = np.repeat(symbols[change] < symbols[change + 1], np.diff(change, prepend=-1))
    return out


def _least_between(shared: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``shared[first..last]`` (both ends in) for many ranges, by a table of power-of-two ranges."""
    out = np.empty(len(first), shared.dtype)
    level = np.maximum(np.frexp((last - first + 1).astype(float))[1] - 1, 0)
    table = shared
    for k in range(int(level.max(initial=0)) + 1):
        here = level == k
        if here.any():
            out[here] = np.minimum(table[first[here]], table[last[here] - (1 << k) + 1])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def induce(
    symbols: np.ndarray, n_symbols: int, wanted: np.ndarray, seeds: np.ndarray, folder: Path,
    seed_shared: np.ndarray | None = None, compare=None, length: int = 0, blank: int = -1,
) -> Slots:
    """Slots with all seeds and all ``wanted`` suffixes in ascending order; those of a symbol come before its seeds.

    ``seeds`` are ordered. With ``seed_shared`` (what each seed shares with the one before) shared lengths are carried, up to
    ``length``; ``compare(a, b)`` gives that of single pairs. Suffixes that start with the symbol ``blank`` share nothing.
    """
    seed_symbols = symbols[seeds]
    n_seeds = np.bincount(seed_symbols, minlength=n_symbols)
    n_induced = np.bincount(symbols[wanted], minlength=n_symbols)
    ends = np.cumsum(n_seeds + n_induced)
    head = ends - n_seeds - n_induced  # next free slot of each symbol
    slots = Slots(int(ends[-1]), folder, seed_shared is not None)
    seed_first = np.cumsum(n_seeds) - n_seeds
    places = (ends - n_seeds)[seed_symbols] + np.arange(len(seeds)) - seed_first[seed_symbols]
    slots.positions[places] = seeds
    carried = seed_shared is not None
    if carried:
        slots.shared[places] = seed_shared
        edge = places[(np.diff(seed_symbols, prepend=-1) != 0)]  # first seed of each symbol
        slots.shared[edge] = 0
        after_induced = (ends - n_seeds)[(n_seeds > 0) & (n_induced > 0)]  # seeds whose neighbour is an induced entry
        is_border = np.zeros(int(ends[-1]) + 1, bool)
        is_border[after_induced] = True
        least = np.full(n_symbols, -1, np.int16)  # since the last insertion under a symbol; -1: nothing inserted yet
    total, at, size = int(ends[-1]), 0, 256
    previous = -1
    while at < total:
        here = np.asarray(slots.positions[at : at + size]).astype(np.int64)
        empty = np.flatnonzero(here < 0)
        if len(empty):
            here = here[: empty[0]]
        before = here - 1
        able = before >= 0
        able[able] = wanted[before[able]]
        source = np.flatnonzero(able)
        target = symbols[before[source]]
        order = np.argsort(target, kind="stable")
        sorted_target = target[order]
        first = np.flatnonzero(np.diff(sorted_target, prepend=-1) != 0)
        sizes = np.diff(np.append(first, len(order)))
        rank = np.arange(len(order)) - np.repeat(first, sizes)
        slot = np.empty(len(order), np.int64)
        slot[order] = head[sorted_target] + rank
        # The longest run that inserts nothing into itself.
        nearest = np.full(len(here), total + size, np.int64)
        nearest[source] = slot
        bad = np.flatnonzero(np.minimum.accumulate(nearest) < at + 1 + np.arange(len(here)))
        if len(bad):
            here = here[: bad[0]]
            keep = source < bad[0]
            inside = keep[order]
            source, slot = source[keep], slot[keep]
            order = (np.cumsum(keep) - 1)[order[inside]]
            sorted_target = sorted_target[inside]
            first = np.flatnonzero(np.diff(sorted_target, prepend=-1) != 0)
        slots.positions[slot] = here[source] - 1
        if carried:
            shared = np.asarray(slots.shared[at : at + len(here)])
            for k in np.flatnonzero(is_border[at : at + len(here)]):
                other = here[k - 1] if k else previous
                slots.shared[at + k] = shared[k] = compare(np.array([other]), here[k : k + 1])[0]
            ordered = source[order]
            since = np.empty(len(order), np.int64)
            since[1:] = ordered[:-1] + 1
            since[first] = 0
            value = _least_between(shared, since, ordered) if len(order) else np.zeros(0, np.int16)
            value[first] = np.minimum(value[first], least[sorted_target[first]])
            value = np.minimum(value + 1, length).astype(np.int16)
            value[sorted_target == blank] = 0
            slots.shared[slot[order]] = value
            np.minimum(least, shared.min(), out=least)
            last = ordered[np.append(first[1:], len(order)) - 1] if len(order) else ordered
            tail = np.minimum.accumulate(np.append(shared, np.int16(length))[::-1])[::-1]
            least[sorted_target[first]] = tail[last + 1]
        head[sorted_target[first]] += np.diff(np.append(first, len(order)))
        at += len(here)
        previous = int(here[-1])
        size = min(RUN, max(256, 2 * len(here)))
    return slots


def _tied(ranks: np.ndarray) -> np.ndarray:
    """Places of an ascending list whose value also stands next to them."""
    same = ranks[1:] == ranks[:-1]
    out = np.zeros(len(ranks), bool)
    out[1:] |= same
    out[:-1] |= same
    return np.flatnonzero(out)


def _split(order: np.ndarray, ranks: np.ndarray, places: np.ndarray, keys: np.ndarray) -> None:
    """Sorts the members of groups that stand at ``places`` of the order by ``keys`` and ranks them anew, in place.

    The rank of a member is the place of the first of its group.
    """
    own = order[places]
    sort = np.lexsort((keys, ranks[own]))
    own, keys, old = own[sort], keys[sort], ranks[own[sort]]
    first = np.ones(len(own), bool)
    first[1:] = (old[1:] != old[:-1]) | (keys[1:] != keys[:-1])
    order[places] = own
    ranks[own] = places[np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))]


def _names(symbols: np.ndarray, n_symbols: int, types: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in order, of the substrings from each seed to the next; equal substrings share a name.

    A symbol counts with its type, so that no substring is the beginning of another; an ended one is followed by zeros.
    """
    lengths = np.append(np.diff(seeds) + 1, 1)
    bits = (2 * n_symbols + 1).bit_length()
    per = max(1, 62 // bits)

    def word(of: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros(len(of), np.int64)
        at, left = seeds[of] + step, lengths[of] - step
        for k in range(per):
            there = np.minimum(at + k, len(symbols) - 1)
            out = (out << bits) | np.where(left > k, 2 * symbols[there].astype(np.int64) + types[there] + 1, 0)
        return out

    keys = word(np.arange(len(seeds)), 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    ranks = np.empty(len(seeds), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(np.diff(keys, prepend=-1) != 0, np.arange(len(keys)), 0))
    step = per
    while True:
        places = _tied(ranks[order])
        places = places[lengths[order[places]] > step]
        if not len(places):
            break
        _split(order, ranks, places, word(order[places], step))
        step += per
    dense = np.cumsum(np.diff(ranks[order], prepend=-1) != 0) - 1
    names = np.empty(len(seeds), np.int64)
    names[order] = dense
    return names, int(dense[-1]) + 1


def suffix_order(symbols: np.ndarray, n_symbols: int, folder: Path) -> np.ndarray:
    """All suffixes in ascending order; the last symbol has to be the unique least one."""
    types = s_types(symbols)
    seeds = ordered_seeds(symbols, n_symbols, types, folder)
    lower = induce(symbols, n_symbols, ~types, seeds, folder)
    upper = _descending(symbols, n_symbols, types, lower, folder)
    return np.asarray(upper.positions)[::-1].astype(np.int64)


def ordered_seeds(symbols: np.ndarray, n_symbols: int, types: np.ndarray, folder: Path) -> np.ndarray:
    seeds = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    if len(seeds) < 2:
        return seeds if len(seeds) else np.array([len(symbols) - 1])
    names, n = _names(symbols, n_symbols, types, seeds)
    if n == len(seeds):
        return seeds[np.argsort(names)]
    if len(seeds) <= FEW:
        return seeds[_doubled(names)]
    return seeds[suffix_order(names.astype(np.int32), n, folder)]


def _doubled(ranks: np.ndarray) -> np.ndarray:
    """All suffixes in ascending order by ranks of prefixes of doubled length; the last symbol is the unique least one."""
    order, step, n = np.argsort(ranks, kind="stable"), 1, len(ranks)
    ranks = np.searchsorted(ranks[order], ranks)
    while len(places := _tied(ranks[order])):
        _split(order, ranks, places, ranks[np.minimum(order[places] + step, n - 1)])
        step *= 2
    return order


def _descending(
    symbols: np.ndarray, n_symbols: int, types: np.ndarray, lower: Slots, folder: Path, compare=None, length: int = 0,
    blank: int = -1,
) -> Slots:
    """All suffixes in descending order, from the slots with the L suffixes."""
    last = len(symbols) - 1
    wanted = types.copy()
    wanted[last] = False  # has no successor to come from
    positions = np.asarray(lower.positions)
    is_l = ~types[positions]
    seeds = np.append(positions[is_l][::-1].astype(np.int64), last)
    shared = None
    if lower.shared is not None:
        shared = np.zeros(len(seeds), np.int16)
        shared[1:-1] = np.asarray(lower.shared)[is_l][::-1][:-1]
    flipped = (n_symbols - 1 - symbols).astype(symbols.dtype)
    return induce(flipped, n_symbols, wanted, seeds, folder, shared, compare, length, n_symbols - 1 - blank)


def repeated_starts(texts: list[bytes], length: int) -> np.ndarray:
    """Positions in the texts end to end (one byte between two) where a string of ``length`` bytes starts that also starts
    elsewhere; strings do not cross from one text into the next."""
    whole = np.frombuffer(b"\0".join(texts) + b"\0\0", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes + 1) - 1
    # Symbols: 0 the end, 1 between texts, bytes from 2 on.
    symbols = whole.astype(np.int16) + 2
    symbols[stops] = 1
    symbols[-1] = 0
    left = np.empty(len(whole), np.int32)  # bytes to the end of the text
    left[:-1] = np.repeat(stops, sizes + 1) - np.arange(len(whole) - 1)
    left[-1] = 0
    base = 0x9E3779B97F4A7C15 | 1
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(symbols.astype(np.uint64) * powers(len(whole), base), out=sums[1:])
    inverse = powers(len(whole), pow(base, -1, 1 << 64))

    def equal(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (sums[a + n] - sums[a]) * inverse[a] == (sums[b + n] - sums[b]) * inverse[b]

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shared length of suffix pairs, at most ``length``: halving steps on the sums of both prefixes."""
        top = np.minimum(np.minimum(left[a], left[b]), length).astype(np.int64)

        out = top.copy()
        open_ = np.flatnonzero(~equal(a, b, top))
        low, high, a, b = np.zeros(len(open_), np.int64), top[open_], a[open_], b[open_]
        while len(open_):
            middle = (low + high) // 2
            same = equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle)
            done = high - low <= 1
            out[open_[done]] = low[done]
            open_, low, high, a, b = (x[~done] for x in (open_, low, high, a, b))
        return out.astype(np.int16)

    with tempfile.TemporaryDirectory() as name:
        folder, n = Path(name), 258
        types = s_types(symbols)
        seeds = ordered_seeds(symbols, n, types, folder)
        shared = np.zeros(len(seeds), np.int16)
        for at in range(1, len(seeds), RUN):
            pairs = seeds[at - 1 : at + RUN]
            shared[at : at + RUN] = compare(pairs[:-1], pairs[1:])
        lower = induce(symbols, n, ~types, seeds, folder, shared, compare, length, 1)
        order = _descending(symbols, n, types, lower, folder, compare, length, 1)
        found = []
        for at in range(0, len(symbols), RUN):
            near = np.flatnonzero(np.asarray(order.shared[at : at + RUN]) >= length) + at
            found += [order.positions[near], order.positions[near - 1]]
    hit = np.zeros(len(symbols), bool)
    hit[np.concatenate(found)] = True
    return np.flatnonzero(hit)
