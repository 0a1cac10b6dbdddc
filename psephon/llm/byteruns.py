"""Suffix-array dedup: remove every byte that a ``length``-byte string covers which also starts anywhere else.

A suffix array of the whole corpus would be many times its size, and almost all of it would order suffixes that
repeat nothing. So the corpus is first cut into *shards* that can be sorted alone:

1. Every ``length``-byte string has a seed, its ``GRAM``-byte string of least hash (the leftmost of equals), so equal
   strings have equal seeds. Consecutive strings with one seed are a *run*; a run's bytes are its *context*. A batch
   sends (seed, digest of context), each once; the bucket that owns a seed replies which contexts repeat as a whole,
   and which differ from others of their seed. Nothing is sorted for seeds that occur once or in equal contexts. Nor
   for starts that cannot repeat: by distance from its seed a run is cut into ``PIECES`` pieces at most; what all
   strings of a piece have in common, its core, is digested too, and a piece whose core no other context has repeats
   nothing.
2. Contexts that differ, one copy of each, cut to the pieces that are left, go to their seed's bucket, which keeps them
   in a scratch file. There, suffixes are sorted by external induced sorting (``suffixes``), with common prefixes: a
   string repeats where the suffix that begins there shares ``length`` bytes or more with a neighbour. What is sorted
   together is bounded whatever a seed holds: a hot seed is cut by distance and core until it is small enough
   (``split``). The starts go back to the batches as bits.
3. A batch unites the strings that repeat, removes what they cover, and digests the rest.

Copies are compared, never expanded into pairs: a passage of a third of all documents arrives once from each batch
in round one, and as one context in round two.

Defined results. Null text: empty. Fewer bytes than ``length``: nothing removed. Repeated rows and copies repeat each
other and lose all strings. Null ids: like others. An empty table gives an empty result. Very long texts are read
whole. Other columns do not matter. Seeds and contexts are told apart by 64-bit digests, strings within a shard
byte by byte.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm import exchange as x
from psephon.llm import suffixes

GRAM = 32
#: What a bucket says of a context: nothing repeats; repeats as a whole; send it; repeats as a whole and send it.
#: A reply is this in two bits, and above them a bit for each piece that another context may share.
NOTHING, WHOLE, SEND, WHOLE_SEND = range(4)
PIECES = 6
#: One 64-bit value for each byte, and the factor of the rolling hash.
BYTES = x.mixed(np.arange(1, 257, dtype=np.uint64) * x.GOLDEN)
FACTOR = np.uint64(0xD1342543DE82EF95)
STEP = 1 << 20
#: Bytes of contexts that are sorted together at most (or two copies of one string, if they are more).
PART_BYTES = 1 << 18


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each ``GRAM`` bytes, by doubling: 1, 2, 4 ... bytes."""
    h, size, power = BYTES[data], 1, int(FACTOR)
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = size * 2, power * power % (1 << 64)
    return x.mixed(h)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_in(body: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one text: first start, number of starts, seed, place of the seed."""
    n, width = len(body) - length + 1, length - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    data = np.frombuffer(body, np.uint8)
    firsts, seeds = [], []
    for at in range(0, n, STEP):  # long texts in steps; a run that a step cuts is joined below
        h = gram_hashes(data[at : min(n, at + STEP) + length - 1])
        # High bits of the hash, then the place: least values are unique, and the leftmost of equals is least.
        ranked = (h & ~np.uint64(0x3FFFFF)) | np.arange(len(h), dtype=np.uint64)
        place = (least_of(ranked, width) & np.uint64(0x3FFFFF)).astype(np.int64)
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        firsts.append(new + at)
        # Least hashes have small leading bits, which deal seeds to buckets: mixed again, they are even.
        seeds.append((place[new] + at, x.mixed(h[place[new]] + x.GOLDEN)))
    first, where, seed = np.concatenate(firsts), np.concatenate([s[0] for s in seeds]), np.concatenate([s[1] for s in seeds])
    keep = np.append(True, where[1:] != where[:-1])
    first, seed = first[keep], seed[keep]
    return first, np.diff(np.append(first, n)), seed, where[keep]


class Runs:
    """All runs of a batch, and its distinct (seed, context) entries in order."""

    def __init__(self, table: pa.Table, length: int):
        self.shown, _, self.bodies, _ = x.ordered(table)
        parts = [runs_in(b, length) for b in self.bodies]
        self.doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        none = np.empty(0, np.int64)
        self.first, self.count, self.place = (np.concatenate([p[k] for p in parts]) if parts else none for k in (0, 1, 3))
        seed = np.concatenate([p[2] for p in parts]) if parts else np.empty(0, np.uint64)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(self.bodies[d][a : a + c + length - 1]) for d, a, c in zip(self.doc.tolist(), self.first.tolist(), self.count.tolist(), strict=True)), np.uint64, len(seed))
        order = np.lexsort((digest, seed))
        s, d = seed[order], digest[order]
        new = np.append(True, (s[1:] != s[:-1]) | (d[1:] != d[:-1])) if len(s) else np.empty(0, bool)
        self.entry_of = np.empty(len(s), np.int64)
        self.entry_of[order] = np.cumsum(new) - 1
        self.example = order[new]
        self.seeds, self.digests = s[new], d[new]
        self.several = np.bincount(self.entry_of, minlength=len(self.seeds)) > 1 if len(s) else np.empty(0, bool)
        self.length, self.piece = length, -(-(length - GRAM + 1) // PIECES)

    def cores(self) -> list[np.ndarray]:
        """For each piece, the digests of the entries' cores (0: the run has no start there)."""
        out = np.zeros((PIECES, len(self.example)), np.uint64)
        wide = self.length - self.piece + 1
        e = self.example
        for k, (d, place, first, count) in enumerate(zip(self.doc[e].tolist(), self.place[e].tolist(), self.first[e].tolist(), self.count[e].tolist(), strict=True)):
            body = self.bodies[d]
            for p in range((place - first - count + 1) // self.piece, (place - first) // self.piece + 1):
                at = place - p * self.piece
                out[p, k] = xxhash.xxh3_64_intdigest(body[at : at + wide]) | 1
        return list(out)

    def hull(self, entry: int, mask: int) -> tuple[int, int]:
        """Distances (most, number) from the seed of the starts between the first and last piece of the mask."""
        run = self.example[entry]
        most = int(self.place[run] - self.first[run])
        high = min(most, mask.bit_length() * self.piece - 1)
        low = max(most - int(self.count[run]) + 1, ((mask & -mask).bit_length() - 1) * self.piece)
        return high, high - low + 1

    def context(self, entry: int, mask: int) -> bytes:
        run = self.example[entry]
        high, count = self.hull(entry, mask)
        first = self.place[run] - high
        return self.bodies[self.doc[run]][first : first + count + self.length - 1]


def packed_contexts(runs: Runs, said: np.ndarray, batch: int, n: int):
    """Contexts that buckets asked for: (batch, bucket, seeds, sizes, distances of their first starts, whether to reply, bytes)."""
    asked = np.flatnonzero(said & 3 >= SEND)
    bounds = x.bucket_bounds(runs.seeds[asked], n)
    for b in np.flatnonzero(np.diff(bounds)):
        own = asked[bounds[b] : bounds[b + 1]]
        contexts = [runs.context(e, int(said[e]) >> 2) for e in own.tolist()]
        sizes = np.array([len(c) for c in contexts], np.uint32)
        highs = np.array([runs.hull(e, int(said[e]) >> 2)[0] for e in own.tolist()], np.uint32)
        yield batch, int(b), b"".join([np.uint64(len(own)).tobytes(), runs.seeds[own].tobytes(), sizes.tobytes(), highs.tobytes(), (said[own] & 3 == SEND).tobytes(), *contexts])


class Shard:
    """Contexts of a bucket, in a scratch file, with their seeds and the distances of their first starts from them."""

    def __init__(self, rows: Iterator[tuple[int, memoryview]], length: int):
        self.length, self.scratch, end = length, tempfile.TemporaryFile(), 0
        columns: list[tuple] = []
        for batch, body in rows:
            n = int(np.frombuffer(body, np.uint64, 1)[0])
            seeds, sizes, highs, wanted = (np.frombuffer(body, t, n, 8 + k * n).copy() for t, k in ((np.uint64, 0), (np.uint32, 8), (np.uint32, 12), (bool, 16)))
            self.scratch.write(body[8 + 17 * n :])
            sizes = sizes.astype(np.int64)
            columns.append((np.full(n, batch), seeds, sizes, highs.astype(np.int64), wanted, end + np.cumsum(sizes) - sizes))
            end += int(sizes.sum())
        columns.sort(key=lambda c: int(c[0][0]))  # a batch sends one row
        self.batch, self.seed, self.size, self.high, self.wanted, self.at = (np.concatenate(c) for c in zip(*columns, strict=True))
        self.scratch.flush()
        self.map = mmap.mmap(self.scratch.fileno(), end, access=mmap.ACCESS_READ)
        self.view = memoryview(self.map)
        self.count = self.size - length + 1
        self.hit_at = np.cumsum(self.count) - self.count
        self.hits = np.memmap(tempfile.TemporaryFile(), bool, "w+", shape=(int(self.count.sum()),))

    def split(self, own: np.ndarray, a: int, b: int):
        """Independent parts of one seed's contexts ``own``: lists of (context, first start, starts, equal ones as pairs).

        Equal strings have their seed at the same distance, so starts at distances [a, b) are compared only with
        each other; and all of them contain their context's core, so contexts with different cores have nothing in
        common, and one with a core of its own repeats nothing. What is left is halved until its distinct contents,
        two copies of those that repeat, are ``PART_BYTES`` at most; at one distance the core is the string. A
        digest that is the same by chance only makes a part larger.
        """
        length, view = self.length, self.view
        own = own[(self.high[own] >= a) & (self.high[own] - self.count[own] < b - 1)]
        if len(own) < 2:
            return
        core_at, wide = self.at[own] + self.high[own] - a, length - (b - 1 - a)
        core = np.fromiter((xxhash.xxh3_64_intdigest(view[p : p + wide]) for p in core_at.tolist()), np.uint64, len(own))
        order = np.argsort(core, kind="stable")
        own, core = own[order], core[order]
        edges = np.append(np.flatnonzero(np.append(True, core[1:] != core[:-1])), len(core))
        for group in (own[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if j - i > 1):
            high = np.minimum(self.high[group], b - 1)
            first = self.high[group] - high
            count = high - np.maximum(self.high[group] - self.count[group] + 1, a) + 1
            start, size = self.at[group] + first, count + length - 1
            digest = np.fromiter((xxhash.xxh3_64_intdigest(view[p : p + n]) for p, n in zip(start.tolist(), size.tolist(), strict=True)), np.uint64, len(group))
            by = np.lexsort((digest, count, high))
            new = np.append(True, (digest[by][1:] != digest[by][:-1]) | (count[by][1:] != count[by][:-1]) | (high[by][1:] != high[by][:-1]))
            copies = np.bincount(np.cumsum(new) - 1)
            if b - a > 1 and int((size[by][new] * np.minimum(copies, 2)).sum()) > PART_BYTES:
                middle = (a + b) // 2
                yield from self.split(group, a, middle)
                yield from self.split(group, middle, b)
                continue
            items: list[tuple[int, int, int, list]] = []
            for k, fresh in zip(by.tolist(), new.tolist(), strict=True):
                me = int(group[k]), int(first[k])
                lead = None if fresh else items[top]
                if lead is not None and self.content(*lead[:3]) == self.content(*me, lead[2]):
                    if len(lead[3]) == 0:
                        items.append((*me, lead[2], []))
                    lead[3].append(me)
                else:
                    if fresh:
                        top = len(items)
                    items.append((*me, int(count[k]), []))
            yield items

    def content(self, context: int, first: int, count: int) -> memoryview:
        at = int(self.at[context]) + first
        return self.view[at : at + count + self.length - 1]

    def parts(self):
        """Parts of whole seeds, ``PART_BYTES`` together; those of a seed that has more are split."""
        order = np.argsort(self.seed, kind="stable")
        seed = self.seed[order]
        edges = np.append(np.flatnonzero(np.append(True, seed[1:] != seed[:-1])), len(seed))
        part, held = [], 0
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = order[i:j]
            if j - i < 2:
                continue
            if int(self.size[own].sum()) <= PART_BYTES:
                pieces = [[(e, 0, int(self.count[e]), []) for e in own.tolist()]]
            else:
                pieces = self.split(own, 0, self.length - GRAM + 1)
            for piece in pieces:
                size = sum(count + self.length - 1 for _, _, count, _ in piece)
                if part and held + size > PART_BYTES:
                    yield part
                    part, held = [], 0
                part, held = part + piece, held + size
        if part:
            yield part

    def sort(self) -> None:
        """Marks all starts of strings that repeat."""
        for part in self.parts():
            found = repeated_starts([self.content(*item[:3]) for item in part], self.length)
            for (context, first, count, equal), hit in zip(part, found, strict=True):
                for c, f in [(context, first), *equal]:
                    at = int(self.hit_at[c]) + f
                    self.hits[at : at + count] |= hit

    def replies(self):
        """(batch, bits of the starts of its contexts that wait for a reply)."""
        edges = np.append(np.flatnonzero(np.append(True, self.batch[1:] != self.batch[:-1])), len(self.batch))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            bits = [self.hits[self.hit_at[e] : self.hit_at[e] + self.count[e]] for e in range(i, j) if self.wanted[e]]
            if bits:
                yield int(self.batch[i]), np.packbits(np.concatenate(bits)).tobytes()


def repeated_starts(contexts: list, length: int, memory: int | None = None) -> list[np.ndarray]:
    """For each context (bytes), which of its starts begin a string that begins in another place of the shard too."""
    if len(contexts) < 2:
        return [np.zeros(len(c) - length + 1, bool) for c in contexts]
    memory = memory or suffixes.MEMORY
    sizes = np.array([len(c) for c in contexts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = suffixes.room(int(sizes.sum()) + len(sizes) + 1, np.int32, memory)
    for c, b in zip(contexts, begins.tolist(), strict=True):
        text[b : b + len(c)] = np.frombuffer(c, np.uint8)
        text[b : b + len(c)] += 2
        text[b + len(c)] = 1  # symbol 1 parts contexts, symbol 0 ends the text
    text[-1] = 0
    order, prefix = suffixes.sort(text, True, length, memory)
    hit = suffixes.room(len(text), bool, memory)
    hit[:] = False
    for a, b in suffixes.chunks(len(order) - 1, memory):
        far = prefix[a + 1 : b + 1] >= length
        hit[order[a + 1 : b + 1][far]] = True
        hit[order[a:b][far]] = True
    return [np.asarray(hit[b : b + s - length + 1]) for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def byte_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): ``spans`` are the removed runs [start, end) of bytes."""
    if length < 2 * GRAM:
        raise ValueError(f"strings need {2 * GRAM} bytes or more")
    n, m = x.unit_counts(docs)
    batches = x.batched(docs, n, id_col, text_col)

    def send(key, table):
        r = Runs(table, length)
        return x.packed_table(x.deal(key[0].as_py(), m, r.seeds, r.digests, r.several, *r.cores()))

    def compare(key, table):
        rows, sizes, (seeds, digests, several, *cores) = x.unpack(table, np.uint64, np.uint64, bool, *[np.uint64] * PIECES)
        batch_of = np.repeat(rows, sizes)
        order = np.lexsort((batch_of, digests, seeds))
        s, d = seeds[order], digests[order]
        new_seed = np.append(True, s[1:] != s[:-1])
        new = new_seed | np.append(True, d[1:] != d[:-1])
        context, seed = np.cumsum(new) - 1, np.cumsum(new_seed) - 1
        repeats = (np.bincount(context, several[order]) > 0) | (np.bincount(context) > 1)
        seed_of_context = seed[new]
        once = np.bincount(seed_of_context, ~repeats)[seed_of_context] > 0
        alone = np.bincount(seed_of_context)[seed_of_context] == 1
        mask = np.zeros(len(seed_of_context), np.int64)
        for p, core in enumerate(cores):
            c = core[order][new]
            by = np.lexsort((c, seed_of_context))
            same = (c[by][1:] == c[by][:-1]) & (seed_of_context[by][1:] == seed_of_context[by][:-1]) & (c[by][1:] > 0)
            mask[by[1:][same]] |= 1 << p
            mask[by[:-1][same]] |= 1 << p
        once &= mask > 0
        answer = np.where(repeats, np.where(once, WHOLE_SEND, WHOLE), np.where(alone | (mask == 0), NOTHING, SEND))
        answer = (answer | np.where(answer >= SEND, mask << 2, 0))[context]
        late = (answer & 3 == WHOLE_SEND) & ~new
        answer[late] = WHOLE  # the first batch sends it
        out = np.empty(len(seeds), np.uint8)
        out[order] = answer
        return x.packed_table(x.reply_rows(rows, sizes, key[0].as_py(), out))

    def send_contexts(key, table, replies):
        r = Runs(table, length)
        return x.packed_table(packed_contexts(r, x.replies_for(replies, r.seeds, m, np.uint8), key[0].as_py(), m))

    def sort_shard(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.as_py(), memoryview(body.as_buffer())) for t in tables for b, body in zip(t.column("batch"), t.column("body"), strict=True))
        shard = Shard(rows, length)
        shard.sort()
        for b, bits in shard.replies():
            yield from x.packed_table([(b, key[0].as_py(), bits)]).to_batches()

    def cut(key, table, replies):
        r = Runs(table, length)
        second = np.asarray(replies.column("second"))
        said = x.replies_for(replies.filter(pa.array(~second)), r.seeds, m, np.uint8)
        # Starts that repeat, for each entry that was sent to be compared, in the order in which it was sent.
        asked = np.flatnonzero(said & 3 >= SEND)
        bounds, starts = x.bucket_bounds(r.seeds[asked], m), {}
        late = replies.filter(pa.array(second))
        for b, body in zip(late.column("bucket").to_pylist(), late.column("body").to_pylist(), strict=True):
            own = [e for e in asked[bounds[b] : bounds[b + 1]].tolist() if said[e] & 3 == SEND]
            hulls = [r.hull(e, int(said[e]) >> 2) for e in own]
            counts = [c for _, c in hulls]
            hit, at = np.unpackbits(np.frombuffer(body, np.uint8), count=sum(counts)).astype(bool), 0
            for e, (high, c) in zip(own, hulls, strict=True):
                starts[e] = high, np.flatnonzero(hit[at : at + c])
                at += c
        what = said[r.entry_of] & 3
        bounds = np.searchsorted(r.doc, np.arange(len(r.bodies) + 1))
        rows = []
        for i, body in enumerate(r.bodies):
            own = slice(bounds[i], bounds[i + 1])
            kinds = what[own]
            if not kinds.any():
                rows.append((len(body), 0, [], body))
                continue
            change = np.zeros(len(body) + 1, np.int32)
            for first, count, place, kind, entry in zip(r.first[own].tolist(), r.count[own].tolist(), r.place[own].tolist(), kinds.tolist(), r.entry_of[own].tolist(), strict=True):
                if kind in (WHOLE, WHOLE_SEND):
                    change[first] += 1
                    change[first + count + length - 1] -= 1
                elif kind == SEND and entry in starts:
                    at = place - starts[entry][0] + starts[entry][1]
                    change[at] += 1
                    change[at + length] -= 1
            gone = np.cumsum(change)[:-1] > 0
            edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            rows.append((len(body), int(gone.sum()), [{"start": a, "end": b} for a, b in edges.tolist()], np.frombuffer(body, np.uint8)[~gone].tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table([r.shown, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    said = batches.groupBy("batch").applyInArrow(send, x.KEYS).groupBy("bucket").applyInArrow(compare, x.KEYS)
    contexts = batches.groupBy("batch").cogroup(said.groupBy("batch")).applyInArrow(send_contexts, x.KEYS)
    # Contexts are few bytes and much work: partitions as they are, not put together by size.
    shards = contexts.repartition(m, "bucket").groupBy("bucket").applyInArrow(sort_shard, x.KEYS)
    replies = said.withColumn("second", F.lit(False)).unionByName(shards.withColumn("second", F.lit(True)))
    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
