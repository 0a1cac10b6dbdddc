"""N-gram Jaccard join by prefixes under several global orders, and the components of its links.

Every text becomes the set of its distinct ``k``-word shingles. Two documents link when ``100 * |A and B| >= percent
* |A or B|``. Texts with equal sets are one class, a node of the graph; classes are found by a 64-bit digest of the set.

Under any global order of shingles, linked sets share members of their prefixes, for few members of a linked set are
outside the other. There are three orders. The first puts frequent shingles last (the class of a shingle's frequency, from
a sketch that every shingle of every document is counted into) and orders shingles of one class by hash; its prefix of
``|A| - ceil(t |A|) + 1`` members is what candidates are looked up by. So a passage that many documents share does not
generate candidates, unless a document has little else. The second and third are hash orders of their own; their prefix
is all that a set has in the first quarter of the order. As it ends at one place for all sets, two prefixes of linked sets
differ in no more members than the sets may, so they have to share more than half (``need``).

1. The first order's prefixes go, packed, to buckets. A bucket makes *lists*: the nodes with one prefix shingle, cut
   where no two sizes can link. Equal lists are kept once. Lists, not pairs, are what is shuffled.
2. Each list's least node is paired with the others (a list of n gives n - 1 pairs). A pair is a candidate if the
   prefixes under the second and under the third order, sent as 16-bit values, share enough too. Only then are texts
   moved and whole sets compared. Components of the links follow.
3. The lists of one least node make a *cluster*. Clusters that still span components are cut into tiles of two blocks
   of at most ``BLOCK`` nodes. In a tile, counts of shared members are kept in a matrix: of the second and third
   orders' prefixes, and then, for nodes that have a partner of another component after both, of the whole sets. A tile
   returns a spanning forest of its links, never its pairs.

Linked sets share a prefix shingle of the first order, so both are in one list and in its cluster: the components are
exact. Copies are one node, and clusters within one component (most groups of near copies) are left out.

Defined results. Null or empty texts: an empty set, component their own id, links with nothing. Fewer words than a
shingle: the whole sequence is one. Null ids: take part, report a null id, and give the component no name. Rows are
told apart by id and a digest of the text, so null or repeated ids with different texts are nodes of their own.
Repeated rows: each is reported. An empty table gives an empty result. Very long texts are read whole. Other
columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm import exchange as x
from psephon.llm.exchange import slices
from psephon.llm.components import components

#: The frequency sketch: counters, and parts in which it is summed. The orders' seeds.
COUNTERS, PARTS = 1 << 18, 64
ORDERS = tuple(np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0))
SLICE_BYTES = 2_000_000
#: Rows of 24 bytes (rows that stand for nodes of candidate pairs) that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Nodes in each of a tile's two blocks, about.
BLOCK = 768


def shingle_sets(bodies: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    words, counts = x.split_words(bodies, lower=True)
    h = x.hashes(words)
    runs = x.runs_of(h, k)
    out, start = [], 0
    for count in counts.tolist():
        if count >= k:
            out.append(np.unique(runs[start : start + count - k + 1]))
        elif count:
            out.append(x.runs_of(h[start : start + count], count) ^ np.uint64(count))
        else:
            out.append(np.empty(0, np.uint64))
        start += count
    return out


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def counter_of(shingles: np.ndarray) -> np.ndarray:
    return (x.mixed(shingles) >> np.uint64(64 - 18)).astype(np.int64)


def in_order(own: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The set's prefix under the first order, as 64-bit tokens."""
    n = len(own)
    size = n - -(-percent * n // 100) + 1
    keys = (rank[counter_of(own)].astype(np.uint64) << np.uint64(58)) | (x.mixed(own ^ ORDERS[0]) >> np.uint64(6))
    return np.sort(keys)[:size] if n else own


def near(own: np.ndarray, order: int) -> np.ndarray:
    """The prefix under the second or third order, the first quarter of all hashes, as sorted distinct 16-bit values."""
    m = x.mixed(own ^ ORDERS[order])
    return np.unique((m[m < np.uint64(1 << 62)] >> np.uint64(46)).astype(np.uint16))


def need(p, q, n_p, n_q, percent: int):
    """How many values the prefixes (``p`` and ``q`` distinct ones) of linked sets (``n_p`` and ``n_q`` members) share at least.

    Linked sets differ in so many members at most, and so do parts of them that end at one place, and their images.
    """
    differ = n_p + n_q - 2 * -(-percent * (n_p + n_q) // (100 + percent))
    return (p + q - differ + 1) // 2


def may_link(p: bytes, q: bytes, n_p: int, n_q: int, percent: int) -> bool:
    """Whether two packed prefixes allow a link."""
    a, b = np.frombuffer(p, np.uint16), np.frombuffer(q, np.uint16)
    return len(np.intersect1d(a, b, assume_unique=True)) >= need(len(a), len(b), n_p, n_q, percent)


def bodies_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, body): ``key`` digests the text, in the JVM; id and key tell rows apart."""
    body = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("body"))


def sets_and_sketch(bodies: DataFrame, k: int) -> DataFrame:
    """One pass: (doc_id, key, node, n, second, third) of each document, and partial frequency sketches (part, counts).

    ``second`` and ``third`` are the prefixes under those orders.
    """
    names = ["doc_id", "key", "node", "n", "second", "third", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for part in slices(batches, "body", SLICE_BYTES):
            sets = shingle_sets([b or b"" for b in part.column(2).to_pylist()], k)
            if sets:
                total += np.bincount(counter_of(np.concatenate(sets)), minlength=COUNTERS)
            columns = ([node_of(s) if len(s) else None for s in sets], [len(s) for s in sets], *([near(s, order).tobytes() for s in sets] for order in (1, 2)))
            own = [pa.array(c, t) for c, t in zip(columns, kinds[2:6], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own, pa.nulls(len(sets), kinds[6]), pa.nulls(len(sets), kinds[7])], names=names)
        if total.any():
            rows = [pa.array(range(PARTS), kinds[6]), pa.array([c.tobytes() for c in np.split(total, PARTS)], kinds[7])]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(PARTS, t) for t in kinds[:6]], *rows], names=names)

    return bodies.mapInArrow(run, "doc_id long, key long, node long, n long, second binary, third binary, part int, counts binary")


def frequency_ranks(sketches: DataFrame) -> np.ndarray:
    """Rank (0: usual) of each counter: powers of two over the mean. ``COUNTERS`` numbers, however large the corpus."""

    def add(key, table):
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([sum(np.frombuffer(b, np.int64) for b in table.column("counts").to_pylist()).tobytes()], pa.binary())], names=["part", "counts"])

    rows = sketches.groupBy("part").applyInArrow(add, "part int, counts binary").collect()  # PARTS rows of fixed size
    counts = np.zeros(COUNTERS, np.int64)
    for r in rows:
        counts[r.part * (COUNTERS // PARTS) : (r.part + 1) * (COUNTERS // PARTS)] = np.frombuffer(r.counts, np.int64)
    mean = counts.mean()
    return np.clip(np.floor(np.log2((counts + 1) / (1 + mean + 3 * np.sqrt(mean)))) + 1, 0, 31).astype(np.uint8)


def lists_of(bodies: DataFrame, ranks, k: int, percent: int, n_units: int) -> DataFrame:
    """(list, members): packed (node, size) of the nodes with one prefix shingle of the first order."""

    def send(batches):
        for part in slices(batches, "body", SLICE_BYTES):
            nodes = {node_of(s): s for s in shingle_sets([b or b"" for b in part.column(0).to_pylist()], k) if len(s)}
            if not nodes:
                continue
            tokens = [x.mixed(in_order(s, ranks.value, percent)) for s in nodes.values()]
            size = np.array([len(t) for t in tokens])
            node = np.repeat(np.fromiter(nodes, np.int64, len(nodes)), size)
            n = np.repeat(np.array([len(s) for s in nodes.values()], np.uint32), size)
            tokens = np.concatenate(tokens)
            order = np.argsort(tokens)
            rows = list(x.deal(0, n_units, tokens[order], node[order], n[order]))
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "packed"])

    def meet(key, table):
        columns: list[list[np.ndarray]] = [[], [], []]
        for body in table.column("packed").to_pylist():
            n = len(body) // 20
            for c, d, at in zip(columns, (np.uint64, np.int64, np.uint32), (0, 8 * n, 16 * n), strict=True):
                c.append(np.frombuffer(body, d, n, at))
        token, node, size = (np.concatenate(c) for c in columns)
        order = np.lexsort((node, size, token))
        token, node, size = token[order], node[order], size[order].astype(np.int64)
        fresh = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node, size = token[fresh], node[fresh], size[fresh]
        cut = np.append(True, (token[1:] != token[:-1]) | (100 * size[:-1] < percent * size[1:]))
        edges = np.append(np.flatnonzero(cut), len(token))
        out: dict[int, bytes] = {}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                members = node[a:b].tobytes() + size[a:b].tobytes()
                out[xxhash.xxh3_64_intdigest(members) - (1 << 63)] = members
        return pa.table([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["list", "members"])

    sent = bodies.select("body").mapInArrow(send, "bucket int, packed binary")
    return sent.groupBy("bucket").applyInArrow(meet, "list long, members binary").dropDuplicates(["list"])


def unpacked(members: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(members) // 16
    return np.frombuffer(members, np.int64, n), np.frombuffer(members, np.int64, n, 8 * n)


def star_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: each list's least node with every other member whose size allows a link."""

    def run(batches):
        for batch in batches:
            for members in batch.column(0).to_pylist():
                node, size = unpacked(members)
                hub = int(node.argmin())
                ok = 100 * np.minimum(size, size[hub]) >= percent * np.maximum(size, size[hub])
                ok[hub] = False
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(ok.sum()), node[hub])), pa.array(node[ok])], names=["a", "b"])

    return lists.select("members").mapInArrow(run, "a long, b long").distinct()


def cluster_rows(lists: DataFrame) -> DataFrame:
    """(hub, node): the members of all lists of one least node."""

    def run(batches):
        for batch in batches:
            for members in batch.column(0).to_pylist():
                node, _ = unpacked(members)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), node.min())), pa.array(node)], names=["hub", "node"])

    return lists.select("members").mapInArrow(run, "hub long, node long").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share. Members of few sets are counted pair by pair, others by matrix products."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    value = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    starts = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(value)))
    out = np.zeros((m, m), np.float32)
    for size in np.unique(sizes[sizes > 1]).tolist():
        own = owner[starts[sizes == size][:, None] + np.arange(size)]
        if size < 24:
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)]
                out += np.bincount((part[:, :, None] * m + part[:, None, :]).ravel(), minlength=m * m).reshape(m, m)
    common = np.flatnonzero(sizes >= 24)
    for at in range(0, len(common), 512):
        grid = np.zeros((m, 512), np.float32)
        for k, c in enumerate(common[at : at + 512].tolist()):
            grid[owner[starts[c] : starts[c] + sizes[c]], k] = 1
        out += grid @ grid.T
    return out


def forest(links: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is not joined yet, from a matrix of links."""
    group, out = labels.copy(), []
    for a in range(len(group)):
        for b in np.flatnonzero(links[a] & (group != group[a])).tolist():
            if group[a] != group[b]:
                group[group == group[b]] = group[a]
                out.append((a, b))
    return out


def cluster_links(lists: DataFrame, found: DataFrame, bodies: DataFrame, keepers: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between different components within clusters, as many as it takes to join them."""
    rows = cluster_rows(lists).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = rows.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).filter("low < high")
    rows = rows.join(spans.select("hub", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "hub")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiled = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    tiled = tiled.select("hub", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "component")

    def possible(n, labels, *orders):
        """Pairs of different components that all orders' prefixes allow to link, as a matrix."""
        may = labels[:, None] != labels[None, :]
        for own in orders:
            size = np.array([len(p) for p in own], np.int64)
            may &= overlaps(own) >= need(size[:, None], size[None, :], n[:, None], n[None, :], percent)
        return may

    def shortlist(key, table):
        """The tile's nodes that have such a partner: only their texts are moved."""
        own = ([np.frombuffer(q, np.uint16) for q in table.column(c).to_pylist()] for c in ("second", "third"))
        may = possible(np.asarray(table.column("n")), np.asarray(table.column("component")), *own)
        return table.filter(pa.array(may.any(1))).select(["hub", "i", "j", "node", "component"])

    tiled = tiled.join(keepers.select("node", "n", "second", "third"), "node").groupBy("hub", "i", "j").applyInArrow(shortlist, "hub long, i int, j int, node long, component long").checkpoint()
    texts = node_texts(tiled.select("node").distinct(), bodies, keepers)

    def judge(key, table):
        ids, labels = np.asarray(table.column("node")), np.asarray(table.column("component"))
        sets = shingle_sets([t or b"" for t in table.column("body").to_pylist()], k)
        labels = np.unique(labels, return_inverse=True)[1]
        n = np.array([len(own) for own in sets], np.int64)
        shared, both = overlaps(sets), n[:, None] + n[None, :]
        links = (labels[:, None] != labels[None, :]) & (100 * shared >= percent * (both - shared))
        pairs = forest(links, labels)
        return pa.table([pa.array([ids[p[side]] for p in pairs], pa.int64()) for side in (0, 1)], names=["a", "b"])

    return tiled.join(texts, "node").groupBy("hub", "i", "j").applyInArrow(judge, "a long, b long")


def node_texts(nodes: DataFrame, bodies: DataFrame, keepers: DataFrame) -> DataFrame:
    """(node, body) of the rows that stand for some nodes, each node once however often its row is repeated."""
    needed = nodes.join(keepers.select("node", F.col("row.doc_id").alias("of"), F.col("row.key").alias("of_key")), "node").checkpoint()
    if needed.count() <= BROADCAST_ROWS:  # else a shuffle join of all texts
        needed = F.broadcast(needed)
    mine = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    return bodies.join(needed, mine).groupBy("node").agg(F.first("body").alias("body"))


def candidates(pairs: DataFrame, keepers: DataFrame, percent: int) -> DataFrame:
    """Those pairs that share enough of their prefixes under the second and under the third order."""
    sides = [keepers.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "second", "third")]) for s in "ab"]

    def run(batches):
        for batch in batches:
            _, _, n_a, n_b, *packed = (c.to_pylist() for c in batch.columns)
            mask = [may_link(p, q, i, j, percent) and may_link(r, t, i, j, percent) for i, j, p, q, r, t in zip(n_a, n_b, *packed, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "second_a", "second_b", "third_a", "third_b")
    return joined.mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, bodies: DataFrame, keepers: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs whose whole sets link. ``pairs`` is checkpointed.

    Texts, which compress, are what is moved to the pairs; sets are made again where pairs meet.
    """
    texts = node_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), bodies, keepers)
    left = texts.select(F.col("node").alias("a"), F.col("body").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("body").alias("tb"))

    def verify(batches):
        for batch in batches:
            for part in slices(batch_of_pairs(batch), "both", SLICE_BYTES):
                ids = [part.column(0).to_pylist(), part.column(1).to_pylist()]
                bodies = {node: t for side in (0, 1) for node, t in zip(ids[side], part.column(2 + side).to_pylist(), strict=True)}
                sets = dict(zip(bodies, shingle_sets(list(bodies.values()), k), strict=True))
                ok = []
                for a, b in zip(*ids, strict=True):
                    both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    ok.append(100 * both >= percent * (len(sets[a]) + len(sets[b]) - both))
                mask = pa.array(ok, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], names=["a", "b"])

    def batch_of_pairs(batch):
        """One batch, with the column by whose size it is cut."""
        both = pa.array([s + t for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, both], names=["a", "b", "ta", "tb", "both"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def jaccard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, node, component) of every document: ``key`` digests its text, ``component`` is a node."""
    spark = docs.sparkSession
    x.shared_dir(spark)
    bodies = bodies_of(docs, id_col, text_col)
    passed = sets_and_sketch(bodies, k).checkpoint()
    rows = passed.filter("part IS NULL")
    ranks = spark.sparkContext.broadcast(frequency_ranks(passed.filter("part IS NOT NULL").select("part", "counts")))
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    keepers = rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(least).alias("row"), *[F.first(c).alias(c) for c in ("n", "second", "third")]).checkpoint()

    lists = lists_of(bodies, ranks, k, percent, x.unit_counts(docs)[1]).checkpoint()
    stars = star_pairs(lists, percent).checkpoint()
    links = linked(candidates(stars, keepers, percent).checkpoint(), bodies, keepers, k, percent).distinct().checkpoint()
    found = components(links).checkpoint()
    links = links.unionByName(cluster_links(lists, found, bodies, keepers, k, percent))
    found = components(links)

    named = keepers.select("node", F.col("row.doc_id").alias("keeper")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("keeper").alias("component_id"))
    named = named.join(least, "component").select(F.col("node").alias("of"), "component", "component_id")
    out = rows.select("doc_id", "key", "node", "n").join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), "node", "component")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, node) of every document."""
    return jaccard_rows(docs, id_col, text_col, k, percent).drop("key", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, null last, then of the least digest of its text.

    Of rows with that id and that text one stays, any (the first that is met, should other columns differ). Rows
    without words are no group, so each of them stays.
    """
    rows = jaccard_rows(docs, id_col, text_col, k, percent).filter("node IS NOT NULL")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    # A row for each text of an id, with the number of its copies: map-side sums. Texts are joined to what goes, not to what stays.
    distinct = rows.groupBy("doc_id", "key", "component").agg(F.count("*").alias("copies"))
    best = distinct.groupBy("component").agg(F.min(own).alias("best"))
    judged = distinct.join(best, "component").withColumn("stays", (F.col("best") == own)).filter("copies > 1 OR NOT stays")
    judged = judged.select(F.col("doc_id").alias("gone_id__"), F.col("key").alias("gone_key__"), "stays").checkpoint()
    if judged.count() <= BROADCAST_ROWS:  # else shuffle joins
        judged = F.broadcast(judged)
    body = F.col(text_col).cast("binary")
    on = F.col(id_col).cast("long").eqNullSafe(F.col("gone_id__")) & (F.xxhash64(body) == F.col("gone_key__"))
    # Rows without words are no nodes, and so never judged.
    several = docs.join(judged.filter("stays").drop("stays"), on)
    firsts = several.groupBy("gone_id__", "gone_key__").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row__"))
    return docs.join(judged, on, "left_anti").unionByName(firsts.select("row__.*"))
