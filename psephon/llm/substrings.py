"""Substring dedup by seed and extend, on words.

Seeds are winnowed anchors: of every window of words, the hash of its least ``SEED``-word run, the rightmost of
equals. Equal windows choose equal runs at equal places, so a window that occurs in two documents has a seed that
occurs in both. Round one joins documents on seeds: a batch sends each of its seeds once, and learns which occur
in another document. Round two extends: for each place of a shared seed, the batch sends the words around it, as far as
windows with that seed reach. The bucket of a seed extends all its places together, word by word to the right and word by
word to the left: after each word, places that agree so far stay in one group. Places that agree on j words to the left
and on the rest of a window to the right share that window; it holds in an earlier document if a place of its group
does. Shared windows of a document run together into maximal repeats, which are removed.

Neither round forms pairs: a passage that a third of all documents share costs one entry from each batch for each
surrounding that differs. A bucket makes one reply to each batch at most, however many documents share a seed, and both
rounds that read the replies read the same ones.

Defined results. Null text: no words. Fewer words than a window: nothing removed. Null id: after all others, so
such a document never takes a window from one with an id, and two with null ids take nothing from each other.
Repeated rows with one id have no smaller id between them: neither loses words to the other. An empty table
gives an empty result. Other columns are ignored, whatever their names. Words are told apart by 64-bit hashes, each
word of a window by its own.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm import exchange as x

SEED = 5


class Windows:
    """A batch's words, windows and seeds; the same each time it is made from the same documents."""

    def __init__(self, table: pa.Table, window: int):
        self.shown, self.ids, bodies, _ = x.ordered(table)
        self.words, self.counts = x.split_words(bodies, lower=False)
        self.window, self.h = window, x.hashes(self.words)
        doc = np.repeat(np.arange(len(bodies)), self.counts)
        n = max(0, len(self.words) - window + 1)
        self.starts = np.flatnonzero(doc[:n] == doc[window - 1 : window - 1 + n])
        self.doc = doc[self.starts]
        # Mixed again: least hashes have small leading bits, which would deal them all to a few buckets.
        runs = x.runs_of(self.h, SEED)
        best, at = runs[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - SEED + 1):
            less = runs[j : j + n] <= best
            best[less] = runs[j : j + n][less]
            at[less] = j
        places = self.starts + at[self.starts]
        first = np.append(True, places[1:] != places[:-1]) | np.append(True, self.doc[1:] != self.doc[:-1]) if len(places) else np.empty(0, bool)
        own = x.mixed(best[self.starts][first] + x.GOLDEN) & ~np.uint64(1)
        self.seeds, self.seed_of_place = np.unique(own, return_inverse=True)
        self.place_of_start = np.cumsum(first) - 1
        self.first_start, self.place = self.starts[first], places[first]
        self.n_starts = np.bincount(self.place_of_start, minlength=len(own))
        self.id_of_place = self.ids[self.doc[first]]
        low, high = np.full(len(self.seeds), x.NO_ID), np.full(len(self.seeds), np.iinfo(np.int64).min)
        np.minimum.at(low, self.seed_of_place, self.id_of_place)
        np.maximum.at(high, self.seed_of_place, self.id_of_place)
        self.several = low != high

    def surroundings(self, shared: np.ndarray) -> None:
        """Entries: what is around the places of shared seeds, each once, with the least id in the batch that has it."""
        kept = np.flatnonzero(shared[self.seed_of_place])
        self.entry_of_place = np.full(len(self.place), -1)
        found: dict[tuple[int, int, bytes], list[int]] = {}
        columns = (self.seed_of_place[kept], self.first_start[kept], self.n_starts[kept], self.place[kept])
        for k, seed, a, n, p in zip(kept.tolist(), *(c.tolist() for c in columns), strict=True):
            found.setdefault((seed, p - a, self.h[a : a + n + self.window - 1].tobytes()), []).append(k)
        self.entries = sorted(found)  # by seed
        self.least = np.empty(len(found), np.int64)
        for e, key in enumerate(self.entries):
            self.entry_of_place[found[key]] = e
            self.least[e] = self.id_of_place[found[key]].min()
        self.entry_seed = self.seeds[[key[0] for key in self.entries]] if found else np.empty(0, np.uint64)
        self.entry_n = np.array([len(key[2]) // 8 - self.window + 1 for key in self.entries], np.int64)
        self.hit_at = np.cumsum(self.entry_n) - self.entry_n

    def sent(self, batch: int, m: int):
        """(batch, bucket, packed): least ids, words to the left of the seed, numbers of windows, words."""
        bounds = x.bucket_bounds(self.entry_seed, m)
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[b], bounds[b + 1])
            left = np.array([key[1] for key in self.entries[own]], np.uint8)
            head = [np.uint64(len(left)), self.least[own], left, self.entry_n[own].astype(np.uint8)]
            yield batch, b, b"".join([*(v.tobytes() for v in head), *(key[2] for key in self.entries[own])])

    def gone(self, replies: pa.Table, m: int) -> np.ndarray:
        """Starts of windows that hold in a document of a smaller id."""
        earlier, bounds = np.zeros(int(self.entry_n.sum()), bool), x.bucket_bounds(self.entry_seed, m)
        for b, body in zip(replies.column("bucket").to_pylist(), replies.column("body").to_pylist(), strict=True):
            size = int(self.entry_n[bounds[b] : bounds[b + 1]].sum())
            at = int(self.hit_at[bounds[b]])
            earlier[at : at + size] = np.unpackbits(np.frombuffer(body, np.uint8), count=size).astype(bool)
        if not len(self.starts):
            return self.starts
        place = self.place_of_start
        entry = self.entry_of_place[place]
        ok = np.flatnonzero(entry >= 0)
        place, entry = place[ok], entry[ok]
        hit = earlier[self.hit_at[entry] + self.starts[ok] - self.first_start[place]] | (self.least[entry] < self.id_of_place[place])
        return self.starts[ok[hit]]


def refined(rank: np.ndarray, has: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Groups of entries that agree in one word more; -1 for those that have none."""
    out = np.full(len(rank), -1)
    out[has] = np.unique(rank[has] << 32 | code, return_inverse=True)[1]
    return out


def earlier_windows(least: np.ndarray, left: np.ndarray, n: np.ndarray, words: np.ndarray, window: int) -> np.ndarray:
    """For all windows of all entries, in order: whether an entry of a smaller id has the window too.

    An entry's words begin ``left`` words before its seed; its windows begin with each of the first ``n`` words.
    """
    code = np.unique(words, return_inverse=True)[1].astype(np.int64)
    size = n + window - 1
    seed_at = np.cumsum(size) - size + left
    end = np.cumsum(size)
    everyone = np.zeros(len(least), np.int64)
    to_right, to_left = [everyone], [everyone]
    for k in range(window):
        has = (to_right[-1] >= 0) & (seed_at + k < end)
        to_right.append(refined(to_right[-1], has, code[seed_at[has] + k]))
    for k in range(1, window - SEED + 1):
        has = (to_left[-1] >= 0) & (k <= left)
        to_left.append(refined(to_left[-1], has, code[seed_at[has] - k]))
    out, hit_at = np.zeros(int(n.sum()), bool), np.cumsum(n) - n
    for k in range(window - SEED + 1):  # windows with k words before the seed
        own = np.flatnonzero((k <= left) & (left - k < n))
        if len(own):
            _, group = np.unique(to_left[k][own] << 32 | to_right[window - k][own], return_inverse=True)
            first = np.full(group.max() + 1, x.NO_ID)
            np.minimum.at(first, group, least[own])
            out[hit_at[own] + left[own] - k] = first[group] < least[own]
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): ``spans`` are the removed runs [start, end) of words; ``kept`` is UTF-8."""
    if not SEED < window < 256:
        raise ValueError(f"a window needs over {SEED} words, and fewer than 256")
    n, m = x.unit_counts(docs)
    batches = x.batched(docs, n, id_col, text_col)

    def send_seeds(key, table):
        w = Windows(table, window)
        return x.packed_table(x.deal(key[0].as_py(), m, w.seeds | w.several))

    def shared_seeds(key, table):
        rows, sizes, (keys,) = x.unpack(table, np.uint64)
        _, inverse, counts = np.unique(keys >> np.uint64(1), return_inverse=True, return_counts=True)
        several = (np.bincount(inverse, keys & np.uint64(1)) > 0) | (counts > 1)
        return x.packed_table(x.reply_rows(rows, sizes, key[0].as_py(), several[inverse]))

    def send_surroundings(key, table, replies):
        w = Windows(table, window)
        w.surroundings(x.replies_for(replies, w.seeds, m, bool))
        return x.packed_table(w.sent(key[0].as_py(), m))

    def extend(key, table):
        parts: list[list[np.ndarray]] = [[], [], [], []]
        sizes = []
        for body in table.column("body").to_pylist():
            count = int(np.frombuffer(body, np.uint64, 1)[0])
            at = 8
            for part, kind in zip(parts, (np.int64, np.uint8, np.uint8), strict=False):
                part.append(np.frombuffer(body, kind, count, at).astype(np.int64))
                at += count * np.dtype(kind).itemsize
            parts[3].append(np.frombuffer(body, np.uint64, -1, at))
            sizes.append(int(parts[2][-1].sum()))
        hits = earlier_windows(*(np.concatenate(p) for p in parts), window)
        return x.packed_table(x.reply_rows(np.asarray(table.column("batch")), np.array(sizes), key[0].as_py(), hits))

    def cut(key, table, replies):
        w = Windows(table, window)
        is_second = np.asarray(replies.column("second"))
        w.surroundings(x.replies_for(replies.filter(pa.array(~is_second)), w.seeds, m, bool))
        gone = w.gone(replies.filter(pa.array(is_second)), m)
        change = np.zeros(len(w.words) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + window, -1)
        removed = np.cumsum(change)[:-1] > 0
        ends = np.cumsum(w.counts)
        rows = []
        for end, count in zip(ends.tolist(), w.counts.tolist(), strict=True):
            own, words = removed[end - count : end], w.words[end - count : end]
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
            rows.append((count, int(own.sum()), [{"start": a, "end": b} for a, b in edges.tolist()], b" ".join(compress(words, ~own) if len(edges) else words)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table([w.shown, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    # Dealt by batch once: both rounds that read the replies share the exchange, and a union of parts that are dealt alike stays so.
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seeds = batches.groupBy("batch").applyInArrow(send_seeds, x.KEYS).groupBy("bucket").applyInArrow(shared_seeds, x.KEYS).repartition(width, "batch")
    surroundings = batches.groupBy("batch").cogroup(seeds.groupBy("batch")).applyInArrow(send_surroundings, x.KEYS)
    earlier = surroundings.groupBy("bucket").applyInArrow(extend, x.KEYS).repartition(width, "batch")
    replies = seeds.withColumn("second", F.lit(False)).unionByName(earlier.withColumn("second", F.lit(True)))
    return batches.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
