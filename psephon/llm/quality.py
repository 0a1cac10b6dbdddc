"""Quality classifier: gated attention over a document's passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded by a learned embedding of its byte pairs,
hashed into ``PAIRS`` buckets, and of a few figures of its form; gated attention gives it a weight among the document's
passages, and a logistic output scores the weighted sum. Only documents have labels; encoding and attention are learned
from them together. Neither labels nor language, source or id are inputs.

The weights are fitted on the driver, on a bounded sample of the labelled rows outside the held-out fold: the ``SAMPLE``
of least hashed id, with all passages of their texts. Every document is scored over its whole text.

Defined results. Null and empty texts: one passage without words, which is scored like any other. Null ids: not
held out; never in the sample. Repeated labels of an id: each that differs is an example; of several texts of an id the
least is. Without any labels (or with one class only) the score is the smoothed share of good labels. Very long texts:
more passages. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm import exchange as x
from psephon.llm.exchange import slices

PASSAGE, SAMPLE, PAIRS = 50, 2000, 512
WIDTH, GATE, STEPS, RATE, DECAY = 16, 8, 120, 0.02, 1e-3

#: Bucket of each pair of bytes.
BUCKET = (x.mixed(np.arange(1, 65537, dtype=np.uint64) * x.GOLDEN) % np.uint64(PAIRS)).astype(np.int64)
#: Kind of each byte: control and space, capital, small letter, digit, other ASCII, beyond ASCII.
KIND = np.array([5 if b >= 128 else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 0 if b <= 32 else 4 for b in range(256)])
N_FIGURES = 6 + 6
N_FEATURES = PAIRS + N_FIGURES


def passage_features(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage of all texts (root shares of byte pairs, then figures), and how many passages each text has."""
    words, counts = x.split_words(bodies, lower=False)
    n_passages = np.maximum(1, -(-counts // PASSAGE))
    total = int(n_passages.sum())
    doc_of_word = np.repeat(np.arange(len(bodies)), counts)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = (np.cumsum(n_passages) - n_passages)[doc_of_word] + place // PASSAGE
    per = np.maximum(np.bincount(passage, minlength=total), 1).astype(np.float64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)  # a space after each word
    of = np.repeat(passage, size + 1)
    after = np.append(data[1:], 32)[: len(data)]
    after[np.flatnonzero(np.append(of[1:] != of[:-1], True)[: len(of)])] = 32  # what follows a passage is not its own
    pairs = np.bincount(of * PAIRS + BUCKET[data << 8 | after], minlength=total * PAIRS).reshape(total, PAIRS)
    n_bytes = np.maximum(pairs.sum(1), 1)[:, None]
    kinds = np.bincount(of * 6 + KIND[data], minlength=total * 6).reshape(total, 6) / n_bytes
    h = x.hashes(words)
    same = np.append(False, (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])) if len(h) else np.empty(0, bool)
    distinct = np.unique(x.mixed(h ^ (passage.astype(np.uint64) * x.GOLDEN)), return_index=True)[1]
    first = data[np.cumsum(size + 1) - size - 1]

    def share(value: np.ndarray) -> np.ndarray:
        return np.bincount(passage, value, minlength=total) / per

    figures = [share(same), np.bincount(passage[distinct], minlength=total) / per, share(KIND[first] == 1), np.minimum(share(size), 20) / 10, share(size > 15), np.log1p(np.bincount(passage, minlength=total)) / 4]
    return np.column_stack([np.sqrt(pairs / n_bytes), kinds, *figures]).astype(np.float32), n_passages


class GatedAttention:
    """h = tanh(Ex + e); a = softmax over a bag of w . (tanh(Vh) * sigmoid(Uh)); score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        shapes = {"E": (N_FEATURES, WIDTH), "e": (WIDTH,), "V": (WIDTH, GATE), "U": (WIDTH, GATE), "w": (GATE,), "c": (WIDTH,), "d": ()}
        spread = {"E": N_FEATURES**-0.5}
        self.p = {k: r.normal(0, spread.get(k, 0.3), s).astype(np.float32) if k not in "ed" else np.zeros(s, np.float32) for k, s in shapes.items()}
        self.mean, self.scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
        self.constant: float | None = None

    def forward(self, rows: np.ndarray, sizes: np.ndarray):
        p = self.p
        z = np.clip((rows - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (t * s) @ p["w"]
        starts, bag = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        weight = np.exp(logit - np.maximum.reduceat(logit, starts)[bag])
        weight /= np.add.reduceat(weight, starts)[bag]
        pooled = np.add.reduceat(weight[:, None] * h, starts)
        return z, h, t, s, weight, bag, starts, pooled, 1 / (1 + np.exp(-(pooled @ p["c"] + p["d"])))

    def score(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(sizes), self.constant)
        return self.forward(rows, sizes)[-1] if len(sizes) else np.empty(0)

    def fit(self, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> GatedAttention:
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float((labels.sum() + 1) / (len(labels) + 2))
            return self
        self.mean, self.scale = rows.mean(0), rows.std(0) + np.float32(1e-3)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            p, g = self.p, self.gradients(rows, sizes, labels)
            for k in p:
                grad = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v2[k] = 0.999 * v2[k] + 0.001 * grad * grad
                p[k] = (p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def gradients(self, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log-loss, by weight."""
        p = self.p
        z, h, t, s, a, bag, starts, pooled, score = self.forward(rows, sizes)
        out = ((score - labels) / len(labels)).astype(rows.dtype)
        g = {"c": pooled.T @ out, "d": out.sum()}
        into = out[bag, None] * p["c"]
        along = (into * h).sum(1)
        d_logit = a * (along - np.add.reduceat(a * along, starts)[bag])
        g["w"] = (t * s).T @ d_logit
        gate = d_logit[:, None] * p["w"]
        d_t, d_s = gate * s * (1 - t * t), gate * t * s * (1 - s)
        g["V"], g["U"] = h.T @ d_t, h.T @ d_s
        d_h = (a[:, None] * into + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        g["E"], g["e"] = z.T @ d_h, d_h.sum(0)
        return g


def is_held_out(id_col: str, folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2) -> GatedAttention:
    """The classifier, from a bounded sample of the labelled documents outside the fold."""
    chosen = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("double").alias("y")).dropna().filter(~is_held_out("i", folds, fold))
    chosen = chosen.distinct().orderBy(F.xxhash64("i"), "i", "y").limit(SAMPLE)
    pairs = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("binary").alias("body")).join(F.broadcast(chosen), "i")  # SAMPLE rows at most
    pairs = pairs.groupBy("i", "y").agg(F.min(F.coalesce("body", F.lit(b""))).alias("body"))

    def encode(batches):
        for part in slices(batches, "body"):
            rows, sizes = passage_features(part.column(2).to_pylist())
            cuts = np.split(rows.astype(np.float16), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["i", "y", "rows"])

    got = sorted((r.i, r.y, bytes(r.rows)) for r in pairs.select("i", "y", "body").mapInArrow(encode, "i long, y double, rows binary").toLocalIterator())
    bags = [np.frombuffer(r, np.float16).reshape(-1, N_FEATURES) for _, _, r in got]
    rows = np.concatenate(bags).astype(np.float32) if bags else np.empty((0, N_FEATURES), np.float32)
    return GatedAttention().fit(rows, np.array([len(b) for b in bags], np.int64), np.array([y for _, y, _ in got]))


def scorer(model: GatedAttention):
    """Scores of a list of texts, to six places (what the company of other texts can change is beyond them)."""
    return lambda bodies: np.round(model.score(*passage_features(bodies)).astype(np.float64), 6) if bodies else np.empty(0)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    of = scorer(fit(docs, labels, id_col, text_col))

    def run(batches):
        for part in slices(batches, "body", 2_000_000):
            out = of([b or b"" for b in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("body"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns stay as they are."""
    of = scorer(fit(docs, labels, id_col, text_col))

    def run(batches):
        for part in slices(batches, text_col, 2_000_000):
            texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
            yield part.filter(pa.array(of([(t or "").encode() for t in texts]) >= threshold))

    return docs.mapInArrow(run, docs.schema)
