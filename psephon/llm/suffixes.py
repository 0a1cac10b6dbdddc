"""External induced suffix sorting with common prefixes.

``sort`` orders all suffixes of an integer text by induction. Its own sorted sample, the suffixes that begin at a
leftmost smaller symbol, comes from a recursive sort of the text of their names (of ``BASE`` names or fewer: from
ranks of doubled lengths, in memory). Then two passes induce the rest: ascending for suffixes larger than their successor,
descending for the smaller ones. A pass is a merge of a monotone priority queue with what is sorted already; an item that
comes out puts its predecessor back in.

The queue holds tuples (symbol, place, common prefix with the tuple before it under the same symbol). It is cut
into ranges of symbols; what goes to a later range is appended there, and beyond a part of ``memory`` the ranges'
tails are written to an unnamed scratch file. Only the range in front is held sorted. Tuples of one symbol leave in
the order in which they came, which is their order as suffixes.

Everything else that is as long as the text (the text itself, kinds and runs of its symbols, sorted places, common
prefixes, names) is an array of ``room``: in memory while it is small against ``memory``, and else in an unnamed scratch
file; such arrays are made and read in chunks. So memory is bounded by ``memory`` and the front range, however long the
text is.

Items leave in blocks: as many as no item of the block can overtake (an item pushed by the block comes after all
of them), so that a block is a few numpy operations whatever its length.

The common prefix of two neighbouring induced suffixes is one more than the least common prefix along the
neighbouring sources between theirs; a running minimum for each symbol carries it. Where two kinds of suffixes
meet under one symbol, it is the shorter of their runs of that symbol.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes that a sort may hold; ranges of a queue; items that leave together at most.
MEMORY, RANGES, BLOCK = 64 << 20, 512, 1 << 14
#: A text of names of so many items at most needs no further induction.
BASE = 1 << 18
FAR = np.int64(1) << 40


def room(n: int, dtype, memory: int) -> np.ndarray:
    """An array of ``n``: in memory if it takes a sixteenth of it at most, else in an unnamed scratch file."""
    if n * np.dtype(dtype).itemsize <= memory // 16:
        return np.empty(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=(n,))


def chunks(n: int, memory: int) -> Iterator[tuple[int, int]]:
    step = max(256, memory // 256)
    return ((a, min(n, a + step)) for a in range(0, n, step))


class RangeQueue:
    """Monotone priority queue of (symbol, place, common prefix): first by symbol, then in order of arrival."""

    def __init__(self, symbols: np.ndarray, memory: int = MEMORY):
        """``symbols``: all that will be pushed, or a sample of them, for even ranges."""
        cuts = np.quantile(symbols, np.linspace(0, 1, RANGES + 1)[1:-1], method="lower") if len(symbols) else np.zeros(0, np.int64)
        self.edges = np.unique(cuts.astype(np.int64))
        self.tails: list[list[np.ndarray]] = [[] for _ in range(len(self.edges) + 1)]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in self.tails]
        self.front, self.at, self.end = np.empty((0, 3), np.int64), 0, 0
        self.range, self.held, self.memory, self.scratch = -1, 0, memory, None

    def push(self, items: np.ndarray) -> None:
        to = np.searchsorted(self.edges, items[:, 0], "right")
        now = to <= self.range
        if now.any():
            new = items[now]
            if self.end + len(new) > len(self.front):
                rest = self.front[self.at : self.end]
                self.front, self.at, self.end = np.empty((2 * (len(rest) + len(new)) + 64, 3), np.int64), 0, len(rest)
                self.front[: len(rest)] = rest
            self.front[self.end : self.end + len(new)] = new
            self.end += len(new)
            if not 0 < self.range < len(self.edges) or self.edges[self.range] - self.edges[self.range - 1] > 1:
                own = self.front[self.at : self.end]  # a range of one symbol needs no sorting
                own[:] = own[np.argsort(own[:, 0], kind="stable")]
            items, to = items[~now], to[~now]
        if len(items):
            order = np.argsort(to, kind="stable")
            items, to = items[order], to[order]
            edges = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(to)], strict=True):
                self.tails[to[a]].append(items[a:b])
            self.held += items.nbytes
            if self.held > self.memory:
                self.spill()

    def spill(self) -> None:
        if self.scratch is None:
            self.scratch = tempfile.TemporaryFile()
        self.scratch.seek(0, 2)
        for tail, places in zip(self.tails, self.spilled, strict=True):
            if tail:
                raw = np.concatenate(tail).tobytes()
                places.append((self.scratch.tell(), len(raw)))
                self.scratch.write(raw)
                tail.clear()
        self.held = 0

    def head(self, most: int) -> np.ndarray:
        """Up to ``most`` least items, without taking them."""
        while self.at >= self.end and self.range + 1 < len(self.tails):
            self.range += 1
            parts = []
            for place, size in self.spilled[self.range]:
                self.scratch.seek(place)
                parts.append(np.frombuffer(self.scratch.read(size), np.int64).reshape(-1, 3))
            parts += self.tails[self.range]
            self.held -= sum(p.nbytes for p in self.tails[self.range])
            self.tails[self.range], self.spilled[self.range] = [], []
            both = np.concatenate(parts) if parts else np.empty((0, 3), np.int64)
            self.front, self.at, self.end = both[np.argsort(both[:, 0], kind="stable")], 0, len(both)
        return self.front[self.at : min(self.end, self.at + most)].copy()

    def take(self, n: int) -> None:
        self.at += n

    def close(self) -> None:
        if self.scratch is not None:
            self.scratch.close()


def runs(text: np.ndarray, memory: int) -> np.ndarray:
    """How many equal symbols stand from each place on."""
    out = room(len(text), np.int32, memory)
    for a, b in reversed(list(chunks(len(text), memory))):
        own = np.asarray(text[a:b])
        ends = np.append(np.flatnonzero(own[1:] != own[:-1]), len(own) - 1)
        size = ends[np.searchsorted(ends, np.arange(len(own)))] + 1 - np.arange(len(own))
        if b < len(text) and text[b] == own[-1]:  # the last run goes on in the next chunk
            size[int(ends[-2]) + 1 if len(ends) > 1 else 0 :] += int(out[b])
        out[a:b] = size
    return out


def smaller(text: np.ndarray, run: np.ndarray, memory: int) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last one, a symbol that is less than all others, counts so."""
    out = room(len(text), bool, memory)
    for a, b in chunks(len(text), memory):
        after = np.minimum(np.arange(a, b) + run[a:b], len(text) - 1)
        out[a:b] = text[after] > text[a:b]
    out[-1] = True
    return out


def sample_places(small: np.ndarray, memory: int) -> np.ndarray:
    """Places of leftmost smaller symbols; the last place, if there is none."""
    found = [np.flatnonzero(small[max(a, 1) : b] & ~small[max(a, 1) - 1 : b - 1]) + max(a, 1) for a, b in chunks(len(small), memory)]
    out, at = room(max(1, sum(map(len, found))), np.int64, memory), 0
    out[0] = len(small) - 1
    for own in found:
        out[at : at + len(own)] = own
        at += len(own)
    return out


def by_symbol(text: np.ndarray, places: np.ndarray, memory: int) -> np.ndarray:
    """Places in order of their symbols, by a queue that can spill."""
    queue = RangeQueue(np.asarray(text[places[:: max(1, len(places) // 100_000)]]), memory // 4)
    for a, b in chunks(len(places), memory):
        queue.push(np.column_stack([text[places[a:b]], places[a:b], np.zeros(b - a, np.int64)]).astype(np.int64))
    out, at = room(len(places), np.int64, memory), 0
    while len(head := queue.head(BLOCK)):
        out[at : at + len(head)] = head[:, 1]
        at += len(head)
        queue.take(len(head))
    queue.close()
    return out


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of ``values[a:b]`` for each pair, by a table of powers of two (a < b)."""
    table = [values]
    while 2 << len(table) - 1 <= len(values):
        last, step = table[-1], 1 << len(table) - 1
        table.append(np.minimum(last[:-step], last[step:]))
    level = np.frexp((b - a).astype(np.float64))[1] - 1
    out = np.empty(len(a), np.int64)
    for k in np.unique(level).tolist():
        m = level == k
        out[m] = np.minimum(table[k][a[m]], table[k][b[m] - (1 << k)])
    return out


def merged_pass(text, run, given, given_prefix, of_kind, total: int, sign: int, prefixes: bool, memory: int):
    """One induction. ``given``: places of the sorted sources, in the pass's order; ``given_prefix``: with the one before.

    ``sign`` 1 goes up and induces larger suffixes, -1 goes down and induces smaller ones. Returns the ``total`` induced
    places in the pass's order, and their common prefix with the one before under the same symbol.
    """
    size, top = len(given), int(text.max(initial=0))

    def symbols(places: np.ndarray) -> np.ndarray:
        found = np.asarray(text[places], np.int64)
        return found if sign > 0 else top - found

    step = max(1, len(text) // 100_000)
    sampled = np.arange(0, len(text), step)
    queue = RangeQueue(symbols(sampled[of_kind[sampled]]), memory // 4)
    least = np.full(top + 1, FAR) if prefixes else None
    out, out_prefix = room(total, np.int64, memory), room(total if prefixes else 0, np.int64, memory)
    at, filled, block, last = 0, 0, 256, None
    while True:
        mine, theirs = queue.head(block), slice(at, at + block)
        their_places = np.asarray(given[theirs])
        g_symbol = symbols(their_places)
        if not len(mine) and not len(g_symbol):
            break
        # Merge: under one symbol the queue's items come first. Past the shorter of two full heads nothing is known.
        symbol = np.concatenate([mine[:, 0], g_symbol])
        known = min([h[-1] for h in (mine[:, 0], g_symbol) if len(h) == block], default=top + 1)
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        is_given = order >= len(mine)
        place = np.concatenate([mine[:, 1], their_places])[order]
        if len(mine) < block:
            ok = len(symbol)
        else:  # more queue items may be due under the last known symbol: given ones of it must wait
            ok = int(np.searchsorted(symbol, mine[-1, 0], "left") + (symbol == mine[-1, 0])[~is_given | (symbol != mine[-1, 0])].sum()) if known == mine[-1, 0] else len(symbol)
        if len(g_symbol) == block:
            ok = min(ok, int(np.searchsorted(symbol, g_symbol[-1], "right")))
        before = place - 1
        pushes = (before >= 0) & of_kind[before]
        target = np.where(pushes, symbols(before), top + 1)
        earliest = np.minimum.accumulate(np.append(top + 1, target[:-1]))
        unsafe = np.flatnonzero((symbol > earliest) | ((symbol == earliest) & is_given))
        n = max(1, min(ok, int(unsafe[0]) if len(unsafe) else len(symbol)))
        symbol, place, is_given, pushes, target, before = (v[:n] for v in (symbol, place, is_given, pushes, target, before))
        n_given = int(is_given.sum())
        if prefixes:
            carried = np.concatenate([mine[:, 2], given_prefix[theirs]])[order][:n]
            p_symbol, p_place, p_given = (np.append(v, w[:-1]) for v, w in zip(last or (-1, 0, False), (symbol, place, is_given), strict=True))
            shared = np.where(symbol != p_symbol, 0, np.where(is_given == p_given.astype(bool), carried, np.minimum(run[place], run[p_place.astype(np.int64)])))
            last = (symbol[-1:], place[-1:], is_given[-1:])
        taken = place[~is_given]
        out[filled : filled + len(taken)] = taken
        if prefixes:
            out_prefix[filled : filled + len(taken)] = np.where(symbol == p_symbol, carried, 0)[~is_given]
        filled += len(taken)
        push_at = np.flatnonzero(pushes)
        items = np.column_stack([target[push_at], before[push_at], np.zeros(len(push_at), np.int64)])
        if prefixes:
            if len(push_at):
                by = np.argsort(items[:, 0], kind="stable")
                t, k = items[by, 0], push_at[by]
                new = np.append(True, t[1:] != t[:-1])
                prior = np.append(0, k[:-1] + 1)
                prior[new] = 0
                value = least_between(shared, prior, k + 1)
                value[new] = np.minimum(value[new], least[t[new]])
                items[by, 2] = value + 1
                np.minimum(least, shared.min(), out=least)
                final = np.append(new[1:], True)
                tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], FAR)
                least[t[final]] = tail[k[final] + 1]
            else:
                np.minimum(least, shared.min(), out=least)
        queue.take(n - n_given)
        at += n_given
        if len(items):
            queue.push(items)
        block = min(BLOCK, block * 2) if n >= block // 2 else max(256, block // 2)
    queue.close()
    if (at, filled) != (size, total):
        raise RuntimeError("the text's last symbol is not less than all others")
    return out, out_prefix


def induced(text: np.ndarray, run: np.ndarray, small: np.ndarray, sample: np.ndarray, sample_prefix: np.ndarray, prefixes: bool, memory: int):
    """All suffixes from the sorted sample: (larger ones, their prefixes, smaller ones, their prefixes), ascending."""
    n_small = sum(int(np.count_nonzero(small[a:b])) for a, b in chunks(len(text), memory))
    large, large_prefix = merged_pass(text, run, sample, sample_prefix, Inverse(small), len(text) - n_small, 1, prefixes, memory)
    # Going down, an item's neighbour before it is the one above: shift the prefixes.
    down_prefix = room(len(large_prefix), np.int64, memory)
    down_prefix[:1], down_prefix[1:] = 0, large_prefix[:0:-1]
    little, little_prefix = merged_pass(text, run, large[::-1], down_prefix, small, n_small - 1, -1, prefixes, memory)
    # The last suffix has no successor that could induce it; it is less than all others.
    up, up_prefix = room(n_small, np.int64, memory), room(n_small if prefixes else 0, np.int64, memory)
    up[0], up[1:] = len(text) - 1, little[::-1]
    if prefixes:
        up_prefix[:2], up_prefix[2:] = 0, little_prefix[:0:-1]
    return large, large_prefix, up, up_prefix


class Inverse:
    """A mask turned round, place by place."""

    def __init__(self, mask: np.ndarray):
        self.mask = mask

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        return ~self.mask[places]


def agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at ``a`` and ``b``, known from ``start`` symbols on, not looked for beyond ``stop``."""
    out = start.copy()
    live = np.flatnonzero((start < stop) & (np.maximum(a, b) + start < len(text)))
    while len(live):
        same = text[a[live] + out[live]] == text[b[live] + out[live]]
        live = live[same]
        out[live] += 1
        live = live[(out[live] < stop[live]) & (np.maximum(a[live], b[live]) + out[live] < len(text))]
    return out


def merge_kinds(text, large, large_prefix, little, little_prefix, run, prefixes: bool, memory: int):
    """One order from both kinds: under one symbol, larger-than-successor suffixes come first."""
    kinds = []
    for own in (large, little):
        symbol = room(len(own), text.dtype, memory)
        for a, b in chunks(len(own), memory):
            symbol[a:b] = text[own[a:b]]
        kinds.append(symbol)
    order = room(len(text), np.int64, memory)
    prefix = room(len(text), np.int64, memory) if prefixes else None
    for own, own_prefix, mine, other, side in ((large, large_prefix, *kinds, "left"), (little, little_prefix, *kinds[::-1], "right")):
        for a, b in chunks(len(own), memory):
            before = np.searchsorted(other, mine[a:b], side)  # of the other kind, what comes before
            order[np.arange(a, b) + before] = own[a:b]
            if not prefixes:
                continue
            shared = np.asarray(own_prefix[a:b]).copy()
            first = np.append(a == 0 or mine[a - 1] != mine[a], mine[a + 1 : b] != mine[a : b - 1])
            shared[first] = 0
            if side == "right":  # the first of its kind under a symbol, after the last of the other kind
                seam = np.flatnonzero(first & (before > 0))
                seam = seam[other[before[seam] - 1] == mine[a:b][seam]]
                shared[seam] = np.minimum(run[own[a:b][seam]], run[large[before[seam] - 1]])
            prefix[np.arange(a, b) + before] = shared
    return order, prefix


def doubled(text: np.ndarray) -> np.ndarray:
    """Suffix order of a short text by doubling: ranks of 1, 2, 4 ... symbols."""
    rank, step, n = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, len(text)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def named(text: np.ndarray, starts: np.ndarray, ordered: np.ndarray, memory: int) -> tuple[np.ndarray, bool]:
    """The text of names of the sample's pieces (up to the next sample place) from their order, and whether all differ."""
    number = room(len(text), np.int32, memory)  # of each sample place, its number; then its name
    length = room(len(starts), np.int32, memory)
    for a, b in chunks(len(starts), memory):
        number[starts[a:b]] = np.arange(a, b)
        length[a:b] = np.append(starts[a + 1 : b + 1] - starts[a : min(b, len(starts) - 1)] + 1, [1] if b == len(starts) else [])
    names, last = room(len(starts), np.int32, memory), 0
    for a, b in chunks(len(ordered), memory):
        here, before = ordered[a:b], ordered[max(a, 1) - 1 : b - 1]
        here_size, before_size = length[number[here]], length[number[before]]
        same = (here_size[len(here) - len(before) :] == before_size) & (before_size > 1)
        at = np.flatnonzero(same)
        size = before_size[at].astype(np.int64)
        same[at] = agree(text, before[at], here[len(here) - len(before) :][at], np.zeros(len(at), np.int64), size) == size
        # Equal symbols can still end on different slopes only at the end of the text, whose symbol is unique.
        name = last + np.cumsum(np.append(np.zeros(len(here) - len(before), bool), ~same))
        names[number[here]] = name
        last = int(name[-1])
    return names, last + 1 == len(starts)


def sort(text: np.ndarray, prefixes: bool = True, cap: int = 1 << 30, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffix array of ``text`` and common prefixes of neighbours (exact below ``cap``, at least ``cap`` from there on).

    The last symbol must be less than all others.
    """
    n = len(text)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if not prefixes and n <= BASE:
        return doubled(np.asarray(text)), None
    run = runs(text, memory)
    small = smaller(text, run, memory)
    starts = sample_places(small, memory)
    # The order of the sample's pieces, by one induction from their first symbols.
    rough = induced(text, run, small, by_symbol(text, starts, memory), np.zeros(0, np.int64), False, memory)[2]
    is_start = room(n, bool, memory)
    is_start[:] = False
    is_start[starts] = True
    ordered, at = room(len(starts), np.int64, memory), 0
    for a, b in chunks(len(rough), memory):
        own = rough[a:b][is_start[rough[a:b]]]
        ordered[at : at + len(own)] = own
        at += len(own)
    del rough, is_start
    names, differ = named(text, starts, ordered, memory)
    if differ:
        sample = ordered
    else:
        inner, sample = sort(names, False, cap, memory)[0], room(len(starts), np.int64, memory)
        for a, b in chunks(len(starts), memory):
            sample[a:b] = starts[inner[a:b]]
    sample_prefix = room(len(sample) if prefixes else 0, np.int64, memory)
    if prefixes:
        sample_prefix[0] = 0
        for a, b in chunks(len(sample) - 1, memory):
            sample_prefix[a + 1 : b + 1] = agree(text, sample[a:b], sample[a + 1 : b + 1], np.zeros(b - a, np.int64), np.full(b - a, cap))
    return merge_kinds(text, *induced(text, run, small, sample, sample_prefix, prefixes, memory), run, prefixes, memory)
