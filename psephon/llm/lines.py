"""Line dedup by overlapping three-line windows.

Every ``span`` consecutive lines of a document are hashed. A window that also begins at an earlier place of the
corpus (a smaller id, or further up in the same document) is a later occurrence: its lines are covered, and the
covered positions of a document, merged, are removed. Windows are judged on the input. First places are found
by one packed exchange: a batch sends each window once, with its least id (and that text's digest), and learns whether
another batch has it earlier.

Defined results. Null text: one empty line, as an empty text has. Fewer lines than a window: kept whole. Null
id: after all others. Repeated ids: rows with one id are taken in order of a digest of their text, and the later loses.
An empty table gives an empty result. Other columns do not matter. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm import exchange as x



class LineWindows:
    def __init__(self, table: pa.Table, span: int):
        _, ids, bodies, order = x.ordered(table)
        digests = x.hashes(bodies)
        by = np.lexsort((digests, ids))
        self.order, bodies, self.ids, self.digests = [order[k] for k in by.tolist()], [bodies[k] for k in by.tolist()], ids[by], digests[by]
        split = [body.split(b"\n") for body in bodies]
        self.lines = [line for own in split for line in own]
        self.counts = np.array([len(own) for own in split], np.int64)
        h = x.hashes(self.lines)
        doc = np.repeat(np.arange(len(bodies)), self.counts)
        n = max(0, len(h) - span + 1)
        self.starts = np.flatnonzero(doc[:n] == doc[span - 1 : span - 1 + n])
        self.keys, first, self.key_of = np.unique(x.runs_of(h, span)[self.starts] if n else np.empty(0, np.uint64), return_index=True, return_inverse=True)
        least = doc[self.starts[first]] if len(self.keys) else np.empty(0, np.int64)
        self.least, self.least_digest = self.ids[least], self.digests[least]
        self.repeat = np.arange(len(self.starts)) != first[self.key_of] if len(self.keys) else np.empty(0, bool)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): ``kept`` is what is left of the text, lines joined by line feeds."""
    return _run(docs, id_col, text_col, span, None)


def line_dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 3) -> DataFrame:
    """``docs`` with the text cut; all columns stay as they are but the text (and ``n_chars``, where there is one)."""
    return _run(docs, id_col, text_col, span, docs.columns)


def _run(docs: DataFrame, id_col: str, text_col: str, span: int, columns: list[str] | None) -> DataFrame:
    n, m = x.unit_counts(docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col]).alias("row") if columns else None
    batches = x.batched(docs, n, id_col, text_col)
    full = x.batched(docs, n, id_col, text_col, whole) if columns else batches

    def send(key, table):
        w = LineWindows(table, span)
        return x.packed_table(x.deal(key[0].as_py(), m, w.keys, w.least, w.least_digest))

    def resolve(key, table):
        rows, sizes, (keys, least, digest) = x.unpack(table, np.uint64, np.int64, np.uint64)
        order = np.lexsort((digest, least, keys))
        earlier = np.empty(len(keys), bool)  # all but the first of each key; one text is in one batch
        earlier[order] = np.append(False, keys[order][1:] == keys[order][:-1])[: len(keys)]
        return x.packed_table(x.reply_rows(rows, sizes, key[0].as_py(), earlier))

    def cut(key, table, replies):
        w = LineWindows(table, span)
        gone = w.starts[x.replies_for(replies, w.keys, m, bool)[w.key_of] | w.repeat] if len(w.starts) else w.starts
        change = np.zeros(len(w.lines) + 1, np.int64)
        np.add.at(change, gone, 1)
        np.add.at(change, gone + span, -1)
        kept = np.cumsum(change)[:-1] == 0
        n_removed, texts, end = [], [], 0
        for count in w.counts.tolist():
            own, end = kept[end : end + count], end + count
            n_removed.append(count - int(own.sum()))
            texts.append(b"\n".join(compress(w.lines[end - count : end], own)))
        taken = table.take(pa.array(w.order, pa.int64()))
        if columns:
            null = taken.column("body").is_null().to_pylist()
            return pa.table([taken.column("row").combine_chunks(), pa.array([None if x_ else t for x_, t in zip(null, texts, strict=True)], pa.binary())], names=["row", "kept"])
        return pa.table([taken.column("doc_id").combine_chunks(), pa.array(w.counts), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "n_lines", "n_removed", "kept"])

    replies = batches.groupBy("batch").applyInArrow(send, x.KEYS).groupBy("bucket").applyInArrow(resolve, x.KEYS)
    schema = f"row {dict(full.dtypes)['row']}, kept binary" if columns else "doc_id long, n_lines long, n_removed long, kept binary"
    out = full.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(cut, schema)
    if not columns:
        return out
    text = F.decode("kept", "UTF-8")
    return out.select(*[text.alias(c) if c == text_col else F.length(text).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in columns])
