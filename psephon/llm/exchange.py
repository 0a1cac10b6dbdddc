"""Shared plumbing of the corpus operators: document batches, and packed exchanges of 64-bit keys.

Most operators here ask one question about many small keys (word windows, byte windows, n-grams): what
does the rest of the corpus hold under this key? A row for each key would cost far more than the key, so

* documents are dealt into *batches* by a hash of id and text (a batch holds a megabyte or two);
* a batch reduces its own keys first (a key that occurs a thousand times in a batch is sent once), cuts
  the sorted keys into *buckets* by their leading bits, and sends one packed row for each bucket;
* a bucket sees every batch's share of its keys, so it can count or compare them, and replies to each batch
  with an array aligned to the keys that the batch sent;
* the batch, computed anew from the same documents in the same order, joins replies to keys by position.

A hot key reaches its bucket at most once from each batch. The number of batches and of buckets follows the
bytes of the input and Spark's own shuffle width, so neither grows in size with the corpus. A batch sorts
its documents by (id, text) before anything else: a recomputed batch (a lost executor) yields the same keys
in the same order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephon.sources import files

#: Bytes of (compressed) input for each batch and for each bucket, and how many of both for each shuffle partition at
#: least. Buckets are fewer: a batch sends a row to each, and rows of a few keys would cost more than the keys.
BATCH_BYTES, BUCKET_BYTES, PER_PARTITION = 1_500_000, 8_000_000, 2
#: Bytes of text that pass through a worker together.
SLICE_BYTES = 4_000_000
#: Stands for a null id in comparisons: a null id comes after all others.
NO_ID = np.iinfo(np.int64).max
KEYS = "batch int, bucket int, body binary"
#: 2**64 divided by the golden ratio, and the two multipliers of the 64-bit finaliser of MurmurHash3.
GOLDEN, MIX_1, MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def plan_bytes(df: DataFrame) -> int:
    """Bytes that Spark expects ``df`` to read; counted from the rows where Spark has no figure."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    row = df.agg(*[F.sum(F.octet_length(F.col(c).cast("string"))) for c in df.columns]).first()
    return sum(x or 0 for x in row)


def unit_counts(df: DataFrame) -> tuple[int, int]:
    """How many batches, and how many buckets, an input of this size is dealt into."""
    width, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return max(PER_PARTITION * width, size // BATCH_BYTES + 1), max(PER_PARTITION * width, size // BUCKET_BYTES + 1)


def shared_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder that the cluster names; only where none is named (tests), at one of our own."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(files.shared_folder(spark))


def batched(docs: DataFrame, n: int, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    """(batch, doc_id, body, extra...): whole texts as UTF-8 bytes; other columns of ``docs`` are left behind.

    Rows without an id, or with one id and different texts, go to different batches.
    """
    key, body = F.col(id_col).cast("long"), F.col(text_col).cast("binary")
    return docs.select(F.pmod(F.xxhash64(key, body), F.lit(n)).cast("int").alias("batch"), key.alias("doc_id"), body.alias("body"), *extra)


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that no slice has over ``most`` bytes of text, but for a single longer text."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), np.int64)
        start = 0
        while start < len(sizes):
            stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def ordered(table: pa.Table) -> tuple[pa.Array, np.ndarray, list[bytes], list[int]]:
    """A batch in its fixed order: ids as given, ids with ``NO_ID`` for null, texts (null: empty), and the order itself."""
    ids = np.asarray(pc.fill_null(table.column("doc_id"), int(NO_ID)), np.int64)
    bodies = [x or b"" for x in table.column("body").to_pylist()]
    order = sorted(range(len(bodies)), key=lambda i: (ids[i], bodies[i]))
    return table.column("doc_id").combine_chunks().take(pa.array(order, pa.int64())), ids[order], [bodies[i] for i in order], order


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word. (A memo of words would cost more time than the hashes, and memory.)"""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX_1
    x ^= x >> np.uint64(33)
    x *= MIX_2
    x ^= x >> np.uint64(33)
    return x


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive entries of ``h`` (an entry for each start that has ``k``)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= GOLDEN
        acc += h[j : j + n]
    return mixed(acc)


def split_words(bodies: list[bytes], lower: bool) -> tuple[list[bytes], np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one list, and how many each text has. ASCII letters only are lowered."""
    words: list[bytes] = []
    counts = np.empty(len(bodies), np.int64)
    for i, body in enumerate(bodies):
        own = (body.lower() if lower else body).split()
        counts[i] = len(own)
        words += own
    return words, counts


def bucket_bounds(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` buckets begins in sorted ``keys``; a bucket is a range of the leading 32 bits."""
    edges = np.array([(b << 32) // n + bool((b << 32) % n) << 32 for b in range(n)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def deal(batch: int, n: int, keys: np.ndarray, *beside: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(batch, bucket, packed) for each bucket that gets some of the sorted keys; ``beside`` are aligned to them."""
    bounds = bucket_bounds(keys, n)
    for b in np.flatnonzero(np.diff(bounds)):
        s = slice(bounds[b], bounds[b + 1])
        yield batch, int(b), b"".join(x[s].tobytes() for x in (keys, *beside))


def packed_table(rows, kinds: str = KEYS) -> pa.Table:
    names, types = zip(*(x.split() for x in kinds.split(", ")), strict=True)
    as_arrow = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    return pa.table([pa.array(c, as_arrow[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def unpack(table: pa.Table, *dtypes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All keys that a bucket got: batch of each row, keys of each row, and the columns, rows one after another."""
    sizes, width = [], sum(np.dtype(d).itemsize for d in dtypes)
    columns: list[list[np.ndarray]] = [[] for _ in dtypes]
    bodies = table.column("body").to_pylist()
    for body in bodies:
        n, at = len(body) // width, 0
        sizes.append(n)
        for column, d in zip(columns, dtypes, strict=True):
            column.append(np.frombuffer(body, d, n, at))
            at += n * np.dtype(d).itemsize
    return np.asarray(table.column("batch")), np.array(sizes, np.int64), [np.concatenate(c) if c else np.empty(0, d) for c, d in zip(columns, dtypes, strict=True)]


def reply_rows(batches: np.ndarray, sizes: np.ndarray, bucket: int, answers: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """An answer array for each row that the bucket got, aligned to its keys. All-zero answers are left out."""
    at = 0
    for batch, n in zip(batches.tolist(), sizes.tolist(), strict=True):
        if (own := answers[at : at + n]).any():
            yield batch, bucket, (np.packbits(own) if own.dtype == bool else own).tobytes()
        at += n


def replies_for(table: pa.Table, keys: np.ndarray, n: int, dtype) -> np.ndarray:
    """The buckets' answers, aligned to the batch's sorted ``keys``; zero where none came."""
    out, bounds = np.zeros(len(keys), dtype), bucket_bounds(keys, n)
    for b, body in zip(table.column("bucket").to_pylist(), table.column("body").to_pylist(), strict=True):
        size = bounds[b + 1] - bounds[b]
        out[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(body, np.uint8), count=size).astype(bool) if dtype is bool else np.frombuffer(body, dtype, size)
    return out


def pack_small(values: np.ndarray, width: int = 1) -> bytes:
    """Unsigned 64-bit values in ``width`` bytes each; those that need more, and the greatest of the width, are put behind."""
    most = (1 << 8 * width) - 1
    large = values >= np.uint64(most)
    low = np.where(large, np.uint64(most), values).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.array([len(values), int(large.sum())], "<u4").tobytes() + np.ascontiguousarray(low).tobytes() + values[large].astype("<u8").tobytes()


def unpack_small(body: bytes, at: int = 0, width: int = 1) -> tuple[np.ndarray, int]:
    """What ``pack_small`` packed, and where it ends."""
    n, n_large = np.frombuffer(body, "<u4", 2, at).tolist()
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(body, np.uint8, n * width, at + 8).reshape(n, width)
    out, at = low.view("<u8").ravel(), at + 8 + n * width
    out[out == (1 << 8 * width) - 1] = np.frombuffer(body, "<u8", n_large, at)
    return out, at + 8 * n_large


def pack_counted(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys, as differences of six bytes, and their counts, of one byte."""
    return pack_small(np.diff(keys, prepend=np.uint64(0)), 6) + pack_small(counts)


def unpack_counted(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, at = unpack_small(body, 0, 6)
    return np.cumsum(steps, dtype=np.uint64), unpack_small(body, at)[0]
