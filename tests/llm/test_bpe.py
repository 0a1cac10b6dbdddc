import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from psephon.llm import bpe
from psephon.llm.registry import vocabulary


@pytest.fixture(scope="module")
def tools():
    raw, pattern = vocabulary()
    ranks = bpe.read_ranks(raw)
    return bpe.Encoder(ranks, bpe.class_differences(pattern)), bpe.Decoder(ranks), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ALPHABET = [" ", "  ", "\n", "\t", "a", "e", "th", "ing", "é", "ß", "漢", "字", "1", "23", "!", "...", "%%%", "'s", "'", "\u0558", "\u088f", "😀", "\u00a0", "\u2003", "\x1c", "\x85", "🏽", "\u0301", "\u208f", "Ж", "न", "\r\n", "<|endoftext|>"]


def test_like_the_library(tools):
    encoder, decoder, theirs = tools
    r = random.Random(5)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(500)] + ["ab" * 3000, "x" * 3000, "a b. c, d" * 50]
    for text in texts:
        ids = np.frombuffer(encoder.encode(text), "<u4")
        assert ids.tolist() == theirs.encode_ordinary(text), repr(text)
        assert decoder.decode(ids) == text.encode()


def test_full_table(tools, monkeypatch):
    """A table of arcs and a memo that overflow, and long pretokens that pass alone, change nothing."""
    for name, value in {"ARCS": 5, "MEMO_BYTES": 1000, "LONG": 6, "LOOK": 8}.items():
        monkeypatch.setattr(bpe, name, value)
    encoder = bpe.Encoder(bpe.read_ranks(vocabulary()[0]), bpe.class_differences(public_tokenizers.PATTERN), tools[0].transducer.t)
    r = random.Random(3)
    texts = ["unbelievable transformations, indeed", "aaaaabbbbbaaaaab zzzq", "naïveté überfällig", "x" * 99]
    texts += ["".join(r.choice("aeinorst") for _ in range(60)) + " " + "".join(r.choice("ab") for _ in range(50)) for _ in range(200)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tools[2].encode_ordinary(text)


def test_long_pretoken(tools):
    """Tokens come out on the way, and what is held is bounded."""
    r = random.Random(4)
    word = "".join(r.choice("abcdefghinorst") for _ in range(50_000)).encode()
    chunks = list(tools[0].transducer.stream(word))
    assert np.concatenate(chunks).tolist() == tools[2].encode_ordinary(word.decode())
    assert max(map(len, chunks)) <= bpe.LOOK + 200
    same = list(tools[0].transducer.stream(b"a" * 20_000))
    assert np.concatenate(same).tolist() == tools[2].encode_ordinary("a" * 20_000)


def test_blank_lines(tools):
    r = random.Random(6)
    words = ["the", "Über", "x1", "don't", "end.", "漢字"]
    for _ in range(300):
        text = "".join(r.choice(words) + r.choice([" ", " ", "\n", "\n\n", "  ", " \n", "\t", "\r\n", "\u00a0"]) for _ in range(20))
        assert np.frombuffer(tools[0].encode(text), "<u4").tolist() == tools[2].encode_ordinary(text)
        assert np.frombuffer(tools[0].encode(text.strip()), "<u4").tolist() == tools[2].encode_ordinary(text.strip())


def test_streaming_decoder(tools):
    _, decoder, theirs = tools
    text = "a漢é😀\u0301ß" * 5
    chunks = list(decoder.stream(np.array(theirs.encode_ordinary(text), np.uint32)))
    assert b"".join(chunks).decode() == text
    for c in chunks:
        c.decode()  # whole characters only
    machine = bpe.Utf8Stream()
    broken = b"\xe6\xbcA\xff\xf0\x9f\x98\x80\xc3"
    assert b"".join([machine.feed(broken[i : i + 1]) for i in range(len(broken))]) + machine.finish() == broken


def test_query(docs, rows, empty, tools):
    got = sorted(map(str, bpe.round_trip(docs, *vocabulary()).collect()))
    want = []
    for i, t in rows:
        ids = tools[2].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={i}, n_tokens={n}, ids_sha256='{a}', decoded_sha256='{b}')" for i, n, a, b in want)
    assert bpe.round_trip(empty, *vocabulary()).count() == 0
