import numpy as np
import pytest

from psephon.llm import suffixes


def naive(text):
    text = list(text)
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("seed", range(40))
def test_sort(seed, monkeypatch):
    """Random, periodic and run-heavy texts; small blocks and a queue that spills."""
    r = np.random.default_rng(seed)
    monkeypatch.setattr(suffixes, "BLOCK", 256)
    monkeypatch.setattr(suffixes, "BASE", 10 if seed % 2 else 1 << 18)
    text = r.integers(1, r.integers(2, 9), r.integers(0, 400))
    if seed % 3 == 0:
        text = np.tile(text[:7], int(r.integers(1, 40)))
    if seed % 5 == 0:
        text = np.repeat(text, 4)
    text = np.append(text, 0)
    order, shared = suffixes.sort(text, memory=int(r.integers(50, 4000)))
    assert (order.tolist(), shared.tolist()) == naive(text)


def test_queue_spills_and_keeps_order():
    q = suffixes.RangeQueue(np.arange(1000), memory=100)
    items = np.column_stack([np.arange(1000) % 37 * 20, np.arange(1000), np.zeros(1000)]).astype(np.int64)
    q.push(items[:500])
    q.push(items[500:])
    assert q.scratch is not None
    out = []
    while len(head := q.head(64)):
        out += head[:, :2].tolist()
        q.take(len(head))
    assert out == sorted(items[:, :2].tolist())


def test_empty():
    order, shared = suffixes.sort(np.array([0]))
    assert order.tolist() == [0] and shared.tolist() == [0]


def test_texts_beyond_memory(monkeypatch):
    """A text many times larger than the memory: arrays and queues are in scratch files, and the order is the same."""
    r = np.random.default_rng(2)
    piece = r.integers(2, 60, 3000)
    text = np.concatenate([piece, r.integers(2, 60, 9000), piece[500:2500], np.full(300, 7), piece, [0]]).astype(np.int32)
    monkeypatch.setattr(suffixes, "BASE", 50)
    files, plain = [], suffixes.room
    monkeypatch.setattr(suffixes, "room", lambda n, dtype, memory: files.append(isinstance(got := plain(n, dtype, memory), np.memmap)) or got)
    order, shared = suffixes.sort(text, True, 200, memory=20_000)
    assert sum(files) > 20
    want_order, want = naive(text.tolist()) if len(text) < 1000 else (sorted(range(len(text)), key=lambda i: text[i:].astype(">u2").tobytes()), None)
    assert order.tolist() == want_order
    for a, b, k in list(zip(want_order, want_order[1:], shared[1:].tolist(), strict=False))[::7]:
        size = min(len(text) - max(a, b), 200)
        differ = np.flatnonzero(text[a : a + size] != text[b : b + size])
        assert min(k, 200) == (differ[0] if len(differ) else size)
