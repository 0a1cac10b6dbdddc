"""Dedup operators against brute force, on awkward rows."""

import re
import time
from collections import Counter, defaultdict

import numpy as np
import xxhash

from psephon.llm import byteruns, components, exchange, jaccard, lines, substrings

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BIG = 1 << 62


def collected(df, *columns):
    return sorted((tuple(bytes(r[c]) if isinstance(r[c], bytearray) else r[c] for c in columns) for r in df.collect()), key=str)


def test_substrings(docs, rows):
    first, words = {}, [(BIG if i is None else i, i, WORD.findall((t or "").encode())) for i, t in rows]
    for key, _, w in words:
        for a in range(len(w) - 12):
            first[tuple(w[a : a + 13])] = min(first.get(tuple(w[a : a + 13]), BIG), key)
    want = []
    for key, i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < key:
                gone[a : a + 13] = [True] * 13
        want.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert collected(substrings.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=str)


def test_substring_replies_are_made_once(docs):
    """Both rounds that read the replies of the first read one exchange; a round makes a row for each message at most."""
    got = substrings.substring_dedup(docs)
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    made = [line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line]
    assert [sum(f"{name}(" in line for line in made) for name in ("send_seeds", "shared_seeds", "extend")] == [1, 1, 1]


def test_bytes(docs, rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[a : a + 200] for _, b in texts for a in range(len(b) - 199))
    want = []
    for i, b in texts:
        gone = [False] * len(b)
        for a in range(len(b) - 199):
            if seen[b[a : a + 200]] > 1:
                gone[a : a + 200] = [True] * 200
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        want.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = byteruns.byte_dedup(docs).selectExpr("*", "size(spans) AS n_spans")
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(want, key=str)


def test_bytes_in_steps(spark, monkeypatch):
    """Runs that a step cuts are joined: results do not depend on the step."""
    body = ("abc def ghi jkl " * 30 + "".join(chr(97 + i * i % 26) for i in range(1500))).encode()
    whole = byteruns.runs_in(body, 200)
    for step in (1, 7, 100):
        monkeypatch.setattr(byteruns, "STEP", step)
        assert all((a == b).all() for a, b in zip(whole, byteruns.runs_in(body, 200), strict=True))


def test_hot_seed_is_sorted_in_bounded_parts(monkeypatch):
    """A passage in many surroundings, some of which repeat: one seed's contexts exceed a part many times."""
    r, length = np.random.default_rng(5), 200
    passage = r.integers(0, 256, 260, np.uint8).tobytes()
    sides = [r.integers(0, 3, 90, np.uint8).tobytes() for _ in range(150)]
    texts = [sides[i] + passage + sides[(i * 7) % 150][: 20 + i % 60] for i in range(150)]
    texts += [b"?" * (i % 5) + t[5:] for i, t in enumerate(texts[:60])]
    runs = {}
    for t in texts:
        for first, count, seed, place in zip(*byteruns.runs_in(t, length), strict=True):
            runs.setdefault(int(seed), []).append((int(place - first), t[first : first + count + length - 1]))
    seed, own = max(runs.items(), key=lambda item: sum(len(c) for _, c in item[1]))
    n = len(own)
    assert sum(len(c) for _, c in own) > 10 * 4096
    head = [np.uint64(n), np.full(n, seed, np.uint64), np.array([len(c) for _, c in own], np.uint32), np.array([h for h, _ in own], np.uint32), np.ones(n, bool)]
    monkeypatch.setattr(byteruns, "PART_BYTES", 4096)
    sorted_, plain = [], byteruns.repeated_starts
    monkeypatch.setattr(byteruns, "repeated_starts", lambda contexts, k: sorted_.append(sum(map(len, contexts))) or plain(contexts, k))
    shard = byteruns.Shard(iter([(3, memoryview(b"".join([*(v.tobytes() for v in head), *(c for _, c in own)])))]), length)
    shard.sort()
    seen = Counter(c[a : a + length] for _, c in own for a in range(len(c) - length + 1))
    want = [seen[c[a : a + length]] > 1 for _, c in own for a in range(len(c) - length + 1)]
    assert any(want) and not all(want)
    assert shard.hits.tolist() == want and max(sorted_) <= 4096
    [(batch, bits)] = shard.replies()
    assert batch == 3 and np.unpackbits(np.frombuffer(bits, np.uint8), count=len(want)).astype(bool).tolist() == want


def test_bytes_beyond_memory(docs, rows, monkeypatch):
    """The whole operator with a sort that may hold a few kilobytes: shards are sorted in scratch files."""
    rng = np.random.default_rng(9)
    passage = "".join(chr(97 + k) for k in rng.integers(0, 26, 600))
    texts = [f"{'x' * (i % 7)}{passage[: 400 + i % 200]} {i} {passage[i % 150 :]}".encode() for i in range(40)]
    seen = Counter(t[a : a + 200] for t in texts for a in range(len(t) - 199))
    want = [[seen[t[a : a + 200]] > 1 for a in range(len(t) - 199)] for t in texts]
    monkeypatch.setattr(byteruns.suffixes, "BASE", 100)
    assert [h.tolist() for h in byteruns.repeated_starts(texts, 200, 30_000)] == want


def test_seeds_are_dealt_evenly():
    body = np.random.default_rng(3).integers(0, 256, 200_000, np.uint8).tobytes()
    seeds = np.sort(byteruns.runs_in(body, 200)[2])
    sizes = np.diff(exchange.bucket_bounds(seeds, 16))
    assert sizes.max() < 2 * len(seeds) / 16


def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda k: (BIG if rows[k][0] is None else rows[k][0], xxhash.xxh3_64_intdigest((rows[k][1] or "").encode())))
    seen, out = set(), [None] * len(rows)
    for k in order:
        own = (rows[k][1] or "").encode().split(b"\n")
        gone = [False] * len(own)
        for a in range(len(own) - 2):
            key = tuple(own[a : a + 3])
            if key in seen:
                gone[a : a + 3] = [True] * 3
            seen.add(key)
        out[k] = (rows[k][0], len(own), sum(gone), b"\n".join(x for x, g in zip(own, gone, strict=True) if not g))
    return out


def test_lines(docs, rows):
    assert collected(lines.line_dedup(docs), "doc_id", "n_lines", "n_removed", "kept") == sorted(brute_lines(rows), key=str)


def test_lines_keep_columns(docs, rows):
    got = lines.line_dedup_documents(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    want = [(i, None if t is None else k[3].decode()) for (i, t), k in zip(rows, brute_lines(rows), strict=True)]
    assert collected(got, "doc_id", "text") == sorted(want, key=str)
    assert {r.row for r in got.collect()} == {"clash"}


def brute_components(rows):
    def shingles(t):
        w = WORD.findall((t or "").encode().lower())
        return frozenset(tuple(w[a : a + 5]) for a in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = defaultdict(lambda: BIG)
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(least[g], i)
    return [(i, len(s), (i if not s else least[g] if least[g] < BIG else None)) for (i, _), s, g in zip(rows, sets, group, strict=True)]


def test_jaccard(docs, rows):
    assert collected(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=str)


def test_jaccard_chains(spark):
    """Chains of near copies, whose ends do not link, and one passage that all documents share."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[k:] + [f"n{j}" for j in range(k)])) for k in range(0, 40, 2)]
    rows += [(100 + k, " ".join([*base[:30], *[f"d{k}_{j}" for j in range(40)]])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(jaccard.jaccard_components(df), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=str)


def test_jaccard_without_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert collected(jaccard.jaccard_components(docs), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows), key=str)


def brute_groups(rows):
    """Rows by component: the rows themselves, not their ids."""
    alone = [(k, t) for k, (_, t) in enumerate(rows)]
    return [c for _, _, c in brute_components(alone)]


def kept_of(rows):
    """One row of each group, by (id, null last): the others of its texts do not matter here, but how many rows there are."""
    groups = defaultdict(list)
    for (i, t), c in zip(rows, brute_groups(rows), strict=True):
        groups[c if (t or "").split() else object()].append(i)
    return Counter(min(ids, key=lambda i: BIG if i is None else i) for ids in groups.values())


def test_keep_one(docs, rows):
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert Counter(r.doc_id for r in got.collect()) == kept_of(rows)


def test_keep_one_by_rows(spark):
    """Repeated rows, one id with several texts, null ids: one row of each group stays."""
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(4, a), (4, a), (7, a), (4, b), (3, b), (None, a), (None, b + " x"), (None, b + " x"), (None, "other words that are in no other text"), (8, ""), (8, ""), (None, None)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.collect())) == Counter([(4, a), (3, b), (None, b + " x"), (None, "other words that are in no other text"), (8, ""), (8, ""), (None, None)])
    assert Counter(i for i, _ in map(tuple, got.collect())) == kept_of(rows)


def test_jaccard_many_null_ids(spark):
    """Near copies without ids, and exact ones, are no hot key."""
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*base, f"n{k % 4000}"])) for k in range(5000)] + [(5, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    got = jaccard.jaccard_components(df).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(5, 5001)]
    assert time.perf_counter() - began < 120


def test_prefix_filters_lose_nothing():
    """Sets that link pass the second and third orders, also where 16-bit values collide; sets that share little do not."""
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 5, 9, 40, 300, 30_000):
        for _ in range(30):
            base = np.unique(r.integers(0, 1 << 63, n, np.uint64))
            out = int(r.integers(0, 1 + n // 5))
            other = np.unique(np.append(base[out:], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 8)), np.uint64)))
            both = len(np.intersect1d(base, other))
            if 100 * both >= 80 * (len(base) + len(other) - both):
                for order in (1, 2):
                    p, q = (jaccard.near(s, order).tobytes() for s in (base, other))
                    assert jaccard.may_link(p, q, len(base), len(other), 80)
    a, b = (np.unique(r.integers(0, 1 << 63, 300, np.uint64)) for _ in range(2))
    b[:100] = a[:100]
    assert not jaccard.may_link(jaccard.near(a, 1).tobytes(), jaccard.near(b, 1).tobytes(), 300, 300, 80)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 3), (9, 8), (7, 9), (None, 1), (20, 10), (10, 20), *[(i, i + 1) for i in range(100, 140)]]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, **{i: 100 for i in range(100, 141)}}


def test_empty_tables(empty):
    for f in (substrings.substring_dedup, byteruns.byte_dedup, lines.line_dedup, jaccard.jaccard_components, lines.line_dedup_documents, jaccard.keep_one):
        assert f(empty).count() == 0
