"""Decontamination, language model, classifier, URL filters, pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from psephon.llm import bpe, decontaminate, lm, quality, urls
from tests.llm.conftest import SENTENCES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def distance_to_substring(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers():
    r = random.Random(3)
    for _ in range(200):
        item = "".join(r.choice("ab c") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("ab c") for _ in range(r.randint(0, 120)))
        want = distance_to_substring(item, text)
        assert decontaminate.Pattern(item).best(text, 1000) == want
        assert decontaminate.Pattern(item).best(text, 3) == min(want, 4)


def edited(text, n, seed):
    r, out = random.Random(seed), list(text)
    for _ in range(n):
        at = r.randrange(len(out))
        out[at : at + 1] = r.choice(([], ["q"], [out[at], "z"]))
    return "".join(out)


def test_matches(spark, docs, empty, monkeypatch):
    items = [(1, SENTENCES[0]), (2, SENTENCES[1].title()), (3, None), (4, ""), (5, "short"), (7, "One  Two"), (8, "漢字"), (1, SENTENCES[0]), (None, SENTENCES[2]), (6, SENTENCES[3])]
    extra = [(50 + k, "before " + edited(SENTENCES[k % 4], k, k) + " after") for k in range(12)]
    texts = spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want, hit = [], set()
    for r in texts.collect():
        for i, t in items:
            item, text = decontaminate.plain(t), decontaminate.plain(r.text)
            if len(item) >= 20 and text:
                d = distance_to_substring(item, text) if len(text) < 2000 else len(item)
                if d <= len(item) // 20:
                    want.append((r.doc_id, i, d))
                    hit.add(r.text)
            elif item and re.search(rf"(?<![a-z0-9]){re.escape(item)}(?![a-z0-9])", text):
                want.append((r.doc_id, i, 0))
                hit.add(r.text)
    for block in (decontaminate.BLOCK_CHARS, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        got = [tuple(r) for r in decontaminate.matches(texts, bench).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        dirty = {(i,) for i, _, _ in want}
        kept = decontaminate.clean(texts, bench).collect()
        assert Counter(r.text for r in kept) == Counter(r.text for r in texts.collect() if decontaminate.plain(r.text) not in {decontaminate.plain(t) for t in hit})
        assert dirty
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def brute_lm(rows, held, priors=(500.0, 500.0), least=3):
    c, pairs, triples = Counter(), Counter(), Counter()
    split = [(i, [b"\t", *WORD.findall((t or "").encode().lower()), b"\n"]) for i, t in rows]
    for i, w in split:
        if not held(i):
            c.update(w)
            pairs.update(zip(w, w[1:], strict=False))
            triples.update(zip(w, w[1:], w[2:], strict=False))
    n, v, out = sum(c.values()) - c[b"\t"], len(c) - (b"\t" in c), []
    for i, w in split:
        base, full = 0.0, 0.0
        for k in range(1, len(w)):
            root = (c[w[k]] + 1) / (n + v + 1)
            base += math.log10((c[w[k]] + 1) / (n + 1 * (v + 1)))
            p = (pairs[w[k - 1], w[k]] + priors[0] * root) / (c[w[k - 1]] + priors[0])
            if k > 1 and pairs[w[k - 2], w[k - 1]] >= max(least, n / 100_000):
                p = (triples[w[k - 2], w[k - 1], w[k]] + priors[1] * p) / (pairs[w[k - 2], w[k - 1]] + priors[1])
            full += math.log10(p)
        out.append((i, held(i), len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, round(base, 6), round(full, 6)))
    return out


def lm_rows(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()]


def test_lm(spark, docs, rows, empty, monkeypatch):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    assert sorted(lm_rows(lm.score(docs)), key=str) == sorted(brute_lm(rows, held), key=str)
    assert lm.score(empty).count() == 0
    # Stretches of few tokens, and texts all held out.
    monkeypatch.setattr(lm, "STRETCH", 3)
    r = random.Random(8)
    many = [(i, prose(r, r.randint(0, 40))) for i in range(300)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    assert sorted(lm_rows(lm.score(df)), key=str) == sorted(brute_lm(many, held), key=str)
    alone = [(i, t) for i, t in many if held(i)]
    assert sorted(lm_rows(lm.score(df.filter(df.doc_id.isin([i for i, _ in alone])))), key=str) == sorted(brute_lm(alone, held), key=str)


def test_lm_whole(spark, docs, rows, empty):
    """Every pair that was seen is a state: rare pairs, pairs of one batch alone, pairs that only held-out texts share."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    r = random.Random(10)
    rare = [(i, " ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 12)))) for i in range(300)]
    rare += [(300 + i, f"only{i} here{i} and{i} only{i} here{i} and{i}") for i in range(20)] + [(320 + i, "held out pairs meet") for i in range(20)]
    df = spark.createDataFrame(rare, "doc_id long, text string").repartition(3)
    want = sorted(brute_lm(rare, held, least=1), key=str)
    assert sorted(lm_rows(lm.score(df, share=None)), key=str) == want
    assert want != sorted(brute_lm(rare, held), key=str) == sorted(lm_rows(lm.score(df)), key=str)
    assert sorted(lm_rows(lm.score(docs, share=None)), key=str) == sorted(brute_lm(rows, held, least=1), key=str)
    assert lm.score(empty, share=None).count() == 0


def test_lm_order_three_helps_held_out_texts(spark):
    """Held-out texts of one source are likelier under the automaton than under the base, and under triples than without."""
    r = random.Random(9)
    phrases = ["the old mill by the river was closed", "small boats left the harbour before dawn", "every road in the valley was covered"]
    rows = [(i, " ".join(r.choice(phrases) for _ in range(12))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base, full, pairs_only = (df_.filter("held_out").agg({c: "avg"}).first()[0] for df_, c in ((lm.score(df), "base_score"), (lm.score(df), "score"), (lm.score(df, share=1), "score")))
    assert base < pairs_only < full


def test_lm_is_a_distribution():
    """What leaves a state sums to one, over known tokens and one unknown."""
    import pyarrow as pa

    texts = ["a b a b a b c", "a b c d", "b a b", "a b c a b c a b d"]
    t = lm.Tokens(pa.table([pa.array(range(4), pa.int64()), pa.array([x.encode() for x in texts], pa.binary()), pa.array([False] * 4)], names=["doc_id", "body", "held_out"]))
    triples = lm.Triples(t, t.own, 3)
    known = {w: i for i, w in zip(t.token_of.tolist(), t.tokens.tolist(), strict=True)}
    begin = t.token_of[t.stop - t.sizes][0]
    n, v = len(t.read), len(known) - 1
    model = lm.Automaton(t, t.own, triples, triples.own, n, v, (5.0, 2.0))
    tokens = np.array([i for i in known.values() if i != begin])
    pairs = np.unique(t.pair_of[t.pair_of >= 0])
    end = t.token_of[t.stop - 1][0]  # nothing follows an end
    kept = [model.width + p for p in pairs if triples.is_state[p] and model.shorter[p] != end]
    assert kept
    for state in [*tokens[tokens != end].tolist(), begin, *kept]:
        weight, _ = model.step(np.full(len(tokens), state), tokens)
        fallen = model.fail[state] if state < model.width else model.fail[state] + model.fail[model.shorter[state - model.width]]
        assert (10**weight).sum() + 10 ** (fallen + math.log10(1 / (n + v + 1))) == pytest.approx(1)


def prose(r, n):
    return " ".join(r.choice(["the", "river", "of", "mornings", "and", "quietly", "went", "over", "hills,", "they", "said.", "Small"]) for _ in range(n))


def corpus(n=400):
    r, rows, labels = random.Random(11), [], []
    for i in range(n):
        bad = i % 3 == 0
        text = prose(r, r.randint(20, 300))
        if bad:
            text = r.choice([" ".join(w + "%%%" for w in text.split()), " ".join(w.upper() + "!!" for w in text.split()), " | ".join(text.split()), " ".join(["same"] * 120)])
        rows.append((i, text))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality(spark, docs):
    rows, labels = corpus()
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (9999, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(d, y).collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == labels[i][1] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert len(quality.score(docs, y).collect()) == docs.count()
    assert quality.score(docs.limit(0), y).count() == 0
    lone = quality.score(docs, y.limit(0)).collect()
    assert {r.score for r in lone} == {0.5}
    kept = quality.keep_good(d, y)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_attention_gradients():
    """Of every weight matrix, against differences of the loss; and fitting fits."""
    r = np.random.default_rng(0)
    rows, sizes, y = r.normal(size=(9, quality.N_FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    model = quality.GatedAttention()
    model.p = {k: np.asarray(np.asarray(v, np.float64) + r.normal(0, 0.1, np.shape(v))) for k, v in model.p.items()}

    def loss():
        p = model.score(rows, sizes)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(rows, sizes, y)
    for k, v in model.p.items():
        for at in {tuple(int(r.integers(0, n)) for n in np.shape(v)) for _ in range(12)}:
            kept, values = model.p[k], []
            for step in (1e-5, -1e-5):
                model.p[k] = kept.copy()
                model.p[k][at] += step
                values.append(loss())
            model.p[k] = kept
            assert np.asarray(found[k])[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)
    fitted = quality.GatedAttention().fit(rows.astype(np.float32), sizes, y)
    assert np.abs(fitted.score(rows, sizes) - y).max() < 0.05


def plain_features(words):
    """Features of one passage, counted one by one."""
    body = b"".join(w + b" " for w in words)
    pairs, kinds = np.zeros(quality.PAIRS), np.zeros(6)
    for a, b in zip(body, body[1:] + b" ", strict=False):
        pairs[quality.BUCKET[a << 8 | b]] += 1
        kinds[0 if a <= 32 else 5 if a >= 128 else 1 if chr(a).isupper() else 2 if chr(a).islower() else 3 if chr(a).isdigit() else 4] += 1
    n, k = max(len(words), 1), max(len(body), 1)
    figures = [sum(v == w for v, w in zip(words, words[1:], strict=False)) / n, len(set(words)) / n, sum(65 <= w[0] <= 90 for w in words) / n, min(sum(map(len, words)) / n, 20) / 10, sum(len(w) > 15 for w in words) / n, math.log1p(len(words)) / 4]
    return np.concatenate([np.sqrt(pairs / k), kinds / k, figures])


def test_quality_document_by_document(spark, docs, rows):
    """The whole query against features and attention that are computed for one document at a time."""
    many, labels = corpus(200)
    d, y = spark.createDataFrame(many, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, p = quality.fit(d, y), None
    p = model.p
    got = {(r.doc_id, r.score) for r in quality.score(docs.select("doc_id", "text"), y.limit(0)).collect()}
    assert {s for _, s in got} == {0.5}
    of = quality.scorer(model)
    for _, text in [*rows, *many[:60]]:
        words = WORD.findall((text or "").encode())
        z = np.array([plain_features(words[a : a + quality.PASSAGE]) for a in range(0, max(len(words), 1), quality.PASSAGE)])
        h = np.tanh(np.clip((z - model.mean) / model.scale, -6, 6) @ p["E"] + p["e"])
        logit = [sum(p["w"][g] * np.tanh(v @ p["V"][:, g]) / (1 + np.exp(-(v @ p["U"][:, g]))) for g in range(quality.GATE)) for v in h]
        weight = np.exp(np.array(logit) - max(logit))
        pooled = (weight[:, None] * h).sum(0) / weight.sum()
        assert of([(text or "").encode()])[0] == pytest.approx(1 / (1 + np.exp(-(pooled @ p["c"] + p["d"]))), abs=1e-4)
    scored = {r.doc_id: r.score for r in quality.score(d, y).collect()}
    assert all(scored[i] == pytest.approx(of([t.encode()])[0], abs=1e-5) for i, t in many)


PAGES = [
    (1, "http://a.example.org/es/5"), (2, "http://a.example.org/en/12?x=/fr/"), (3, "https://example.org/en/2"), (4, "http://b.com/fr/9#z"), (5, "http://b.com/de/9"), (6, "http://c.net/de/1"),
    (7, None), (8, "no scheme"), (9, "http://"), (10, "HTTP://Mixed.Example.ORG"), (11, "http://c.net/de/2/"), (12, "http://notorg/x"), (None, "http://b.com/en/9"), (5, "http://b.com/de/9"), (13, "ftp://x.org?a://b"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "h") for i, u in PAGES], "page_id long, url string, host string, verdict string")
    got = [tuple(r)[:5] for r in urls.judge(pages, urls.RULES).collect()]
    assert len(got) == len(PAGES)
    by_id = {i: (h, p, rule, v) for i, h, p, rule, v in got}
    assert by_id[1] == ("a.example.org", "/es/5", "example.org/es/", "block") and by_id[2][2:] == ("example.org/en/1", "block")
    assert by_id[3][2:] == ("org/", "allow") and by_id[4][2:] == ("com/fr/", "allow") and by_id[5][2:] == ("com/de/", "block")
    assert by_id[7][:3] == by_id[8][:3] == ("", "", None) and by_id[10][:3] == ("mixed.example.org", "", None) and by_id[12][2] is None and by_id[13][:3] == ("x.org", "", None)
    assert {v for *_, v in got} <= {"allow", "block"} and by_id[6][3] == "block"
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0
    assert {r.verdict for r in urls.judge(pages, []).collect()} == {"block"}


def test_templates_do_not_hang_on_density_or_depth(spark):
    """Repeated rows, query strings and common sub-pages leave variable segments variable; so does a deep path."""
    names = [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    thin = [f"http://h.org/blog/{n}" for n in names] + [f"http://h.org/a/b/c/d/e/{n}" for n in names]
    dense = [u + q for u in thin for q in ("", "?page=1", "?page=2", "")]
    dense += [f"http://u.org/user/{n}/{leaf}" for n in names for leaf in ("posts", "about", "likes")]
    dense += [f"http://s.org/{s}/{s}-{n}" for s in ("news", "sport") for n in names]

    def templates(some):
        pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
        return {(r.host, r.path): r.template for r in urls.judge(pages, urls.RULES).collect()}

    got = templates(dense)
    assert set(got.values()) == {"/blog/*", "/a/b/c/d/e/*", "/user/*/posts", "/user/*/about", "/user/*/likes", "/news/*", "/sport/*"}
    assert templates(thin).items() <= got.items()


def test_branches_are_merged_bottom_up(spark):
    """Pages without labels are judged with their neighbours below one prefix, not with the whole host."""
    rules = [("block", "h.net", "/bad/x"), ("allow", "h.net", "/good/x")]
    made = [f"http://h.net/{p}?{k}" for p in ("bad/xa", "bad/xb", "good/xa") for k in range(10)]
    made += ["http://h.net/bad/zz", "http://h.net/good/ww", "http://h.net/good/ww/deep/er", "http://h.net/other"]
    got = {r.path: r.verdict for r in urls.judge(spark.createDataFrame(list(enumerate(made)), "page_id long, url string"), rules).collect()}
    assert got == {"/bad/xa": "block", "/bad/xb": "block", "/good/xa": "allow", "/bad/zz": "block", "/good/ww": "allow", "/good/ww/deep/er": "allow", "/other": "block"}


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_dedup import brute_components, brute_lines

    rows, labels = corpus(120)
    rows += [(1000 + k, SENTENCES[k % 4] + f" tail {k}\n{SENTENCES[(k + 1) % 4]}\nsame\nlines") for k in range(12)]
    rows += [(2000, SENTENCES[0] * 3), (2001, SENTENCES[0] * 3), (2002, None), (2003, "")]
    items = [(0, SENTENCES[2])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("predicted = 1").collect()}
    left = [(i, t) for i, t in rows if i in good]
    left = [(i, None if t is None else k[3].decode()) for (i, t), k in zip(left, brute_lines(left), strict=True)]
    left = [(i, t) for (i, t), c in zip(left, brute_components(left), strict=True) if c[2] == i]
    left = [(i, t) for i, t in left if not t or distance_to_substring(decontaminate.plain(SENTENCES[2]), decontaminate.plain(t)) > len(SENTENCES[2]) // 20]
    assert set(got) == {i for i, _ in left} and 0 < len(left) < len(rows)
    from psephon.llm.registry import vocabulary

    raw, pattern = vocabulary()
    encoder = bpe.Encoder(bpe.read_ranks(raw), bpe.class_differences(pattern))
    assert all(got[i].n_tokens == len(encoder.encode(t or "")) // 4 for i, t in left)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
