"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur in a document with up to k = m // ``per_error`` edits (single-character
insertions, deletions, replacements). Cut into k + 1 pieces, an item that occurs with k edits has a piece that
occurs unchanged. All pieces go into one Aho-Corasick automaton, a document is read once, and each piece hit
marks the stretch of text where its item may end. Myers' bit-parallel algorithm then runs over the merged
stretches and gives the least edit distance of the item to any substring there.

Case and the kind and amount of white space do not count: both sides are lower-cased, and white space becomes
one space. Items are sent to the workers in blocks of bounded size, each block against all documents.

An item of fewer than ``least`` characters has no room for errors: it has to occur unchanged, and as words of its own
(no letter or digit beside it, but in scripts without spaces).

Defined results. Null or empty texts and items match nothing. Null ids are reported as they are. Repeated items: each is reported. Repeated documents: each row is
judged. Empty tables give empty results. Very long texts are read whole. Other columns are ignored by ``matches``
and kept as they are by ``clean``.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm.exchange import slices

#: Characters of items that go to the workers at once. Their automaton takes some tens of bytes for each.
BLOCK_CHARS = 2_000_000
#: From here on scripts are mostly written without spaces.
UNSPACED = "\u2e80"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` consecutive pieces, as equal in length as can be, with where each begins."""
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Pattern:
    """Myers' bit vectors of one item: ``best`` is the least distance of the item to a substring."""

    def __init__(self, item: str):
        self.size, self.masks = len(item), {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> int:
        """Least distance over all ends in ``text``; stops early at 0; over ``most`` counts as ``most + 1``."""
        every, top = (1 << self.size) - 1, 1 << self.size - 1
        up, down, score, least = every, 0, self.size, min(self.size, most + 1)
        for c in text:
            match = self.masks.get(c, 0)
            diagonal = (((match & up) + up) ^ up) | match | down
            right_up, right_down = down | (every & ~(diagonal | up)), up & diagonal
            if right_up & top:
                score += 1
            elif right_down & top:
                score -= 1
            right_up, right_down = (right_up << 1) & every, (right_down << 1) & every
            up, down = right_down | (every & ~(diagonal | right_up)), right_up & diagonal
            if score < least:
                least = score
                if not least:
                    break
        return least


def apart(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` is no part of a longer word."""
    seams = [text[k - 1 : k + 1] for k in (start, end) if 0 < k < len(text)]
    return not any(a.isalnum() and b.isalnum() and a < UNSPACED and b < UNSPACED for a, b in seams)


class Matcher:
    """A block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str]], per_error: int, least: int):
        self.items, where = [], {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            errors = len(text) // per_error if len(text) >= least else -1
            for at, piece in pieces(text, max(errors, 0)):
                where.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, errors, Pattern(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int]]:
        """(item, distance) of each item that occurs in ``text`` within its budget."""
        if not self.items or not text:
            return []
        text, spots = plain(text), {}
        for end, (size, places) in self.automaton.iter(text):
            for item, at in places:
                spots.setdefault(item, []).append(end + 1 - size - at)
        out = []
        for item, starts in sorted(spots.items()):
            item_id, errors, pattern = self.items[item]
            if errors < 0:
                if any(apart(text, start, start + pattern.size) for start in starts):
                    out.append((item_id, 0))
                continue
            found, a, b = errors + 1, None, None
            for start in sorted(starts):
                low, high = max(0, start - errors), start + pattern.size + errors
                if b is not None and low <= b:
                    b = max(b, high)
                    continue
                if b is not None:
                    found = min(found, pattern.best(text[a:b], errors))
                    if not found:
                        break
                a, b = low, high
            if found:
                found = min(found, pattern.best(text[a:b], errors))
            if found <= errors:
                out.append((item_id, found))
        return out


def _matchers(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, per_error: int, least: int):
    """A broadcast block of items after another; a block's size is bounded, so is what the driver holds."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = total // BLOCK_CHARS + 1
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield docs.sparkSession.sparkContext.broadcast(([(r.i, r.t) for r in own.orderBy("i", "t").toLocalIterator()], per_error, least))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", per_error: int = 20, least: int = 20) -> DataFrame:
    """(doc_id, item_id, distance) of each document that has an item within its budget of edits."""
    texts, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), None
    for sent in _matchers(docs, benchmark, item_col, item_text, per_error, least):

        def run(batches, sent=sent):
            matcher = Matcher(*sent.value)
            for part in slices(batches, "text"):
                rows = [(i, *hit) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for hit in matcher.find(t)]
                columns = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance"])

        found = texts.mapInArrow(run, "doc_id long, item_id long, distance long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", per_error: int = 20, least: int = 20) -> DataFrame:
    """``docs`` without the documents that have an item; all columns stay as they are."""
    for sent in _matchers(docs, benchmark, item_col, item_text, per_error, least):

        def run(batches, sent=sent):
            matcher = Matcher(*sent.value)
            for part in slices(batches, text_col):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array(np.array([not matcher.find(t) for t in texts], bool)))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
