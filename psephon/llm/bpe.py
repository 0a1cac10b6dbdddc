"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

**Encoding.** By the local property of BPE a token sequence is the merge result of its bytes if and only if each
adjacent pair is the merge result of its own bytes, so every prefix of a pretoken has one tokenisation, and a byte
that is read settles which entry ends there. ``Tables`` are compiled from the merges once: the trie of entries, the
two halves of each, and which neighbours a merge across the seam would join (``partners``). A state of
``Transducer`` holds the places from which an entry may still be under way, each as a trie node and the *claim* of the
token before that place: the neighbours that this token would not leave alone, among those which still can follow.
Claims shrink with every byte, mostly to nothing, so a state forgets the words that led to it and the table of arcs
stays small. An arc gives the next state and the token that ends at the byte. States and arcs are made when first
met; when there are over ``ARCS``, they are forgotten together.

Many pretokens pass in lockstep, a byte of each at a time, by array lookups in the table of arcs; their tokens are
read off backwards at their ends. A long pretoken passes alone (``stream``): tokens that all open places agree on are
given out on the way, so that lookahead and memory are bounded by the longest entry and not by the pretoken.

**Decoding.** ``Utf8Stream`` takes token bytes as they come and gives out whole characters; a character that
a token boundary cuts is held until its last byte arrives. Ill-formed bytes become U+FFFD in text, and stay
as they are in bytes.

Nulls: a null text is empty (no ids; both digests are those of the empty string). Empty texts likewise. Null
or repeated ids: each row is handled on its own. Very long texts are read whole, word by word. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm.exchange import slices

#: Arcs of a transducer; bytes of words, and of their ids, that a worker's memo holds at most.
ARCS, MEMO_BYTES = 400_000, 12_000_000
#: Pretokens of more bytes pass alone; bytes of such a one between two looks for settled tokens.
LONG, LOOK = 512, 4096
#: Texts that pass through a worker together, in bytes.
SLICE_BYTES = 1_500_000
NEVER = 1 << 40


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Vocabulary file of lines ``base64 rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merged(ranks: dict[bytes, int], body: bytes, below: float = float("inf")) -> list[bytes]:
    """Plain BPE of a short string with merges of rank under ``below``; used on single entries only."""
    parts = [body[i : i + 1] for i in range(len(body))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Tables:
    """What the merges compile to, as arrays; made once and sent to the workers.

    ``halves``: by token, the two tokens whose merge makes it (-1: a byte, or an entry that merges never make).
    ``whole``: by token, whether BPE of its bytes is the token itself.
    ``edges``, ``nodes``: the trie as sorted 256 node + byte, and the node that each leads to; by node its ``entry`` (-1:
    none), ``depth``, and ``end``: its subtree are the nodes from it up to there; ``node_of`` by token.
    ``seams``: for each two entries that concatenate to an entry, sorted: 256 left + first byte of the right one, the
    least rank from which the left one can meet the right one, the right one, and the greatest rank of a merge on the
    right side before which the seam would be merged.
    """

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values(), default=-1) + 1
        self.size = np.zeros(top, np.int64)
        self.halves, self.whole = np.full((top, 2), -1, np.int64), np.zeros(top, bool)
        latest: dict[int, int] = {}  # rank by which a token that merges make is undone
        for token, rank in ranks.items():
            self.size[rank] = len(token)
            parts = merged(ranks, token, rank) if len(token) > 1 else []
            if len(parts) == 2:
                self.halves[rank] = ranks[parts[0]], ranks[parts[1]]
                latest[rank] = rank
            self.whole[rank] = len(token) == 1 or len(parts) == 2
        seams = []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    seams.append((left << 8 | token[cut], max(rank, latest.get(right, -1)), right, max(rank, latest.get(left, -1))))
        self.seams = np.array(sorted(seams), np.int64).reshape(-1, 4)
        trie: dict[int, int] = {}
        entry, depth = [-1], [0]
        self.node_of = np.zeros(top, np.int64)
        for token, rank in sorted(ranks.items()):  # in this order nodes are numbered in preorder
            node = 0
            for k, byte in enumerate(token):
                node = trie.setdefault(node << 8 | byte, len(entry))
                if node == len(entry):
                    entry.append(-1)
                    depth.append(k + 1)
            entry[node], self.node_of[rank] = rank, node
        edges = np.array(sorted(trie.items()), np.int64).reshape(-1, 2)
        self.edges, self.nodes, self.entry, self.depth = edges[:, 0], edges[:, 1], np.array(entry, np.int64), np.array(depth, np.int64)
        #: Where the preorder leaves the subtree of each node.
        self.end = np.arange(1, len(entry) + 1)
        parent = np.zeros(len(entry), np.int64)
        parent[self.nodes] = self.edges >> 8
        for node in range(len(entry) - 1, 0, -1):
            self.end[parent[node]] = max(self.end[parent[node]], self.end[node])


class ArcTable:
    """Open addressing from 256 state + byte to 2**32 state + token, for arrays of keys."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 where there is none."""
        slot, mask = self.slot(keys), len(self.keys) - 1
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def one(self, key: int) -> int:
        mask, keys = len(self.keys) - 1, self.keys
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while (found := int(keys[slot])) != key:
            if found < 0:
                return -1
            slot = (slot + 1) & mask
        return int(self.values[slot])

    def put(self, key: int, value: int) -> None:
        if 2 * self.n >= len(self.keys):
            old_keys, old_values = self.keys, self.values
            self.__init__(self.bits + 1)
            for k in np.flatnonzero(old_keys >= 0).tolist():
                self.put(int(old_keys[k]), int(old_values[k]))
        mask = len(self.keys) - 1
        slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] >= 0:
            slot = (slot + 1) & mask
        self.keys[slot], self.values[slot], self.n = key, value, self.n + 1


#: What a token leaves alone entirely.
FREE: tuple = ()


class Transducer:
    """Tokens of pretokens, by one pass over their bytes.

    A state: the open places but the present one, earliest first, as (node, claim); and the spine of the token that
    ends at the present place. A *claim* is a sorted tuple of (neighbour, rank): the token would be merged with what
    begins with that neighbour unless the neighbour's own merge came before that rank. A *spine* says the same of all
    neighbours in short: (part, rank) for the token and its right halves, where the part has neighbours that it meets
    by that rank, and that is before the part became a half.
    """

    def __init__(self, tables: Tables):
        self.t = t = tables
        self.trie = dict(zip(t.edges.tolist(), t.nodes.tolist(), strict=True))
        self.entry, self.end, self.whole, self.node_of = t.entry.tolist(), t.end.tolist(), t.whole.tolist(), t.node_of.tolist()
        self.longest = int(t.size.max(initial=1))
        self.seam_keys = t.seams[:, 0]
        lefts = self.seam_keys >> 8
        order = np.lexsort((t.seams[:, 1], lefts))
        self.by_left, self.meets = lefts[order], t.seams[order, 1]
        self.forget()

    def forget(self) -> None:
        self.states: list[tuple] = [((), FREE)]
        self.numbers = {self.states[0]: 0}
        self.arcs, self.spines, self.claims = ArcTable(), {}, {}

    def spine(self, token: int) -> tuple:
        if token not in self.spines:
            out, part, until = [], token, NEVER
            while part >= 0:
                a, b = np.searchsorted(self.by_left, [part, part + 1]).tolist()
                k = a + int(np.searchsorted(self.meets[a:b], until))
                if k > a:
                    out.append((part, int(self.meets[k - 1])))
                until, part = part, int(self.t.halves[part, 1])
            self.spines[token] = tuple(out)
        return self.spines[token]

    def claim(self, spine: tuple, byte: int) -> tuple:
        """The claim on what begins with ``byte``."""
        key = spine, byte
        if spine and key not in self.claims:
            least: dict[int, int] = {}
            for part, last in spine:
                a, b = np.searchsorted(self.seam_keys, [part << 8 | byte, (part << 8 | byte) + 1]).tolist()
                for _, meets, right, until in self.t.seams[a:b].tolist():
                    if meets <= last and until < least.get(right, NEVER):
                        least[right] = until
            self.claims[key] = tuple(sorted(least.items()))
        return self.claims[key] if spine else FREE

    def narrowed(self, claim: tuple, node: int) -> tuple:
        """The part of a claim whose neighbours can still begin what follows: those on the way to a node or beyond it."""
        end = self.end[node]
        return tuple([c for c in claim if (at := self.node_of[c[0]]) <= node < self.end[at] or node <= at < end])

    def stands(self, claim: tuple, token: int) -> bool:
        """Whether the token before leaves ``token`` alone: no left part of it, as long as it was one, is claimed."""
        claimed, part, until = dict(claim), token, NEVER
        while part >= 0:
            if claimed.get(part, NEVER + 1) <= until:
                return False
            until, part = part, int(self.t.halves[part, 0])
        return True

    def learn(self, key: int) -> int:
        """The arc of 256 state + byte: one step of the subset construction."""
        (open_, spine), byte = self.states[key >> 8], key & 255
        token, still = -1, []
        for node, claim in (*open_, (0, self.claim(spine, byte))):
            to = self.trie.get(node << 8 | byte)
            if to is None:
                continue
            if token < 0 <= (found := self.entry[to]) and self.whole[found] and (not claim or self.stands(claim, found)):
                token = found
            if self.end[to] > to + 1:
                still.append((to, self.narrowed(claim, to) if claim else FREE))
        if token < 0:
            raise ValueError("the vocabulary lacks a single byte")
        state = tuple(still), self.spine(token)
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        value = number << 32 | token
        self.arcs.put(key, value)
        return value

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pretoken."""
        if self.arcs.n > ARCS:
            self.forget()
        if max(map(len, pieces), default=0) <= LONG:
            return self.lockstep(pieces)
        short = iter(self.lockstep([p for p in pieces if len(p) <= LONG]))
        return [next(short) if len(p) <= LONG else b"".join(ids.tobytes() for ids in self.stream(p)) for p in pieces]

    def lockstep(self, pieces: list[bytes]) -> list[bytes]:
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        start, size = (np.cumsum(size) - size)[order], size[order]
        last, state = np.empty(len(data), np.int64), np.zeros(len(pieces), np.int64)
        live = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left").tolist()  # pieces of over p bytes come first
        for p, n in enumerate(live):
            at = start[:n] + p
            keys = (state[:n] << 8) + data[at]
            values = self.arcs.get(keys)
            lacking = np.flatnonzero(values < 0)
            if len(lacking):
                new, which = np.unique(keys[lacking], return_inverse=True)
                values[lacking] = np.array([self.learn(k) for k in new.tolist()])[which]
            state[:n], last[at] = values >> 32, values & 0xFFFFFFFF
        # Backwards: the token that ends at the end, the one before it, and so on.
        end, who, rounds = start + size, np.flatnonzero(size), []
        count = np.zeros(len(pieces), np.int64)
        while len(who):
            token = last[end[who] - 1]
            rounds.append((who, token))
            count[who] += 1
            end[who] -= self.t.size[token]
            who = who[end[who] > start[who]]
        stop = np.cumsum(count)
        ids = np.empty(int(count.sum()), "<u4")
        for k, (who, token) in enumerate(rounds):
            ids[stop[who] - 1 - k] = token
        back = np.empty(len(pieces), np.int64)
        back[order] = np.arange(len(pieces))
        body, stop, count = ids.tobytes(), 4 * stop[back], 4 * count[back]
        return [body[a:b] for a, b in zip((stop - count).tolist(), stop.tolist(), strict=True)]

    def stream(self, piece: Iterable[int]) -> Iterator[np.ndarray]:
        """Ids of one pretoken, given out as soon as later bytes cannot change them (looked at now and then)."""
        state, last, size, depth = 0, [], self.t.size.tolist(), self.t.depth  # last: by place, the token that ends there

        def way(at: int) -> list[int]:
            """Places between tokens, from ``at`` back to the last settled one."""
            out = [at]
            while at > 0:
                at -= size[last[at - 1]]
                out.append(at)
            return out

        look = LOOK
        for byte in piece:
            value = self.arcs.one(state << 8 | byte)
            if value < 0:
                value = self.learn(state << 8 | byte)
            state = value >> 32
            last.append(value & 0xFFFFFFFF)
            if len(last) >= look:
                here = way(len(last))
                agreed = set(here)
                for node, _ in self.states[state][0]:
                    agreed &= set(way(len(last) - int(depth[node])))
                settled = max(agreed)
                yield np.array([last[k - 1] for k in here[::-1] if 0 < k <= settled], "<u4")
                del last[:settled]
                look = len(last) + LOOK
                if self.arcs.n > 2 * ARCS:  # the state stays, under a new number
                    now = self.states[state]
                    self.forget()
                    state = self.numbers.setdefault(now, len(self.states))
                    if state == len(self.states):
                        self.states.append(now)
        yield np.array([last[k - 1] for k in way(len(last))[::-1] if k > 0], "<u4")


def class_differences(pattern: str) -> str:
    """``pattern`` for the ``regex`` module with the library's Unicode letters and digits.

    The two know different versions of Unicode. What the library takes for letters and digits is asked of it
    once, with an encoding of single bytes over every code point.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes((b,)): b for b in range(256)}
    for name in ("L", "N"):
        theirs = set(bytes(tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}+", mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        ours = set("".join(regex.findall(rf"\p{{{name}}}+", every)))
        if not theirs <= ours:
            raise RuntimeError("the regex module is older than the tokenizer library")
        spans: list[list[int]] = []
        for c in sorted(map(ord, ours - theirs)):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
        if spans:
            lacking = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
            inside = rf"[^\s\p{{L}}\p{{N}}]"
            pattern = pattern.replace(inside, "\0").replace(rf"\p{{{name}}}", rf"(?:(?![{lacking}])\p{{{name}}})").replace("\0", inside)
            pattern = pattern.replace(inside, rf"(?:{inside}|[{lacking}])") if name == "L" else pattern.replace(rf"(?:{inside}", rf"(?:{inside}|[{lacking}]") if f"(?:{inside}" in pattern else pattern.replace(inside, rf"(?:{inside}|[{lacking}])")
    return pattern


#: White space as Python sees it (no less than what the pattern sees), other than the plain space and the line feed.
ODD = {chr(c) for c in range(0x110000) if chr(c).isspace()} - {" ", "\n"}
ASCII_ODD = sorted(c for c in ODD if c.isascii())
#: Marks that often follow a word.
MARKS = ".,;:"
#: A space between two characters that are no white space.
PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Encoder:
    """Whole texts to ids (little-endian unsigned 32-bit), with a bounded memo of words.

    Texts are cut before each space, and around each line feed, that stands between two characters that are no
    white space. No match of the pattern goes across such a place: a space begins a match or belongs to a run
    of white space, and here that run is one character. What lies between two such places goes to the pattern, so
    blank lines or doubled spaces only make the two words beside them one.

    The memo has two generations: what is not used while the younger one fills up is dropped.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, tables: Tables | None = None):
        self.transducer, self.find = Transducer(tables or Tables(ranks)), regex.compile(pattern).findall
        self.entries = {t.decode(): r.to_bytes(4, "little") for t, r in ranks.items() if Decoder.complete(t)}
        self.young, self.old, self.held = {"": b""}, {}, 0
        # Whether the pattern takes letters with a space before them, and a mark after them, for matches of their own.
        self.plain = all(self.find(lead + "ab" + mark) == [lead + "ab", *mark] for lead in ("", " ") for mark in ("", *MARKS))

    def parts(self, text: str) -> list[str]:
        if text.isascii():
            odd = any(c in text for c in ASCII_ODD)
        else:
            odd = not ODD.isdisjoint(text)
        if odd or "\0" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n":
            first, *rest = PLAIN_SPACE.split(text)
            return [first, *[" " + w for w in rest]]
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def learn(self, words: list[str]) -> None:
        """Ids of words that the memo lacks."""
        single, several = [], []
        for word in words:
            if self.plain and word.isascii():
                bare = word[1:] if word[0] == " " else word
                if bare.isalpha():  # such a word is one match
                    single.append(word)
                    continue
                if bare[:-1].isalpha() and bare[-1] in MARKS:  # and then a mark is another
                    several.append((word, (word[:-1], word[-1])))
                    continue
            several.append((word, self.find(word)))
        pieces = dict.fromkeys(single)
        for _, own in several:
            pieces.update(dict.fromkeys(own))
        # As the library does, a pretoken that is an entry is that entry, even if merges never make it.
        new = [p for p in pieces if p not in self.entries]
        ids = dict(zip(new, self.transducer.encode([p.encode() for p in new]), strict=True))
        find, entry = ids.get, self.entries.get
        self.young.update([(w, find(w) or entry(w)) for w in single])
        self.young.update([(w, b"".join([find(p) or entry(p) for p in own])) for w, own in several])
        self.held += 250 * len(words) + 5 * sum(map(len, words))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMO_BYTES:
            self.young, self.old, self.held = {"": b""}, self.young, 0
        out, late, lacking = [], [], set()
        for text in texts:
            parts = self.parts(text)
            found = list(map(self.young.get, parts))
            if None in found:
                late.append((len(out), parts))
                lacking.update([w for w, f in zip(parts, found, strict=True) if f is None])
                out.append(b"")
            else:
                out.append(b"".join(found))
        again = [w for w in lacking if w in self.old]
        self.young.update([(w, self.old[w]) for w in again])
        self.held += 250 * len(again) + 5 * sum(map(len, again))
        self.learn([w for w in lacking if w not in self.old])
        for k, parts in late:
            out[k] = b"".join(map(self.young.__getitem__, parts))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Utf8Stream:
    """Incremental UTF-8: bytes in, whole characters out. State: bytes held, how many are due, the next one's range."""

    def __init__(self):
        self.held, self.due, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> bytes:
        """Bytes of all characters that are complete (or known to be ill-formed) by now."""
        out = bytearray()
        for byte in data:
            if self.due:
                if self.low <= byte <= self.high:
                    self.held.append(byte)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out += self.held
                        self.held.clear()
                    continue
                out += self.finish()
            if byte < 0x80 or byte < 0xC2 or byte > 0xF4:
                out.append(byte)
                continue
            self.held.append(byte)
            self.due = 1 + (byte >= 0xE0) + (byte >= 0xF0)
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        return bytes(out)

    def finish(self) -> bytes:
        """What a cut leaves of a character."""
        out = bytes(self.held)
        self.held.clear()
        self.due, self.low, self.high = 0, 0x80, 0xBF
        return out


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.closed = np.array([self.complete(t) for t in self.tokens])

    @staticmethod
    def complete(token: bytes) -> bool:
        try:
            token.decode()
        except UnicodeDecodeError:
            return False
        return True

    def stream(self, ids: np.ndarray) -> Iterator[bytes]:
        """Chunks of whole characters. Runs of tokens that are whole characters pass without the machine."""
        machine, tokens = Utf8Stream(), self.tokens
        open_at = np.flatnonzero(~self.closed[ids])
        done = 0
        for at in open_at.tolist():
            if at > done:
                if machine.held:
                    yield machine.finish()
                yield b"".join(map(tokens.__getitem__, ids[done:at].tolist()))
            if out := machine.feed(tokens[ids[at]]):
                yield out
            done = at + 1
        if machine.held:
            if done < len(ids):
                yield machine.finish()
        if done < len(ids):
            yield b"".join(map(tokens.__getitem__, ids[done:].tolist()))
        yield machine.finish()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.stream(ids))


@functools.lru_cache(maxsize=1)
def compiled(raw: bytes) -> Tables:
    return Tables(read_ranks(raw))


#: The worker's encoder and decoder by vocabulary and pattern: one of each, bounded by ``ARCS`` and ``MEMO_BYTES``.
_own: dict = {}


def encoder(raw: bytes, pattern: str, tables: Tables) -> Encoder:
    key = hashlib.sha256(raw).digest(), pattern
    if _own.get("encodes") != key:
        _own.update(encodes=key, encoder=Encoder(read_ranks(raw), pattern, tables))
    return _own["encoder"]


def decoder(raw: bytes) -> Decoder:
    key = hashlib.sha256(raw).digest()
    if _own.get("decodes") != key:
        _own.update(decodes=key, decoder=Decoder(read_ranks(raw)))
    return _own["decoder"]


def send_vocabulary(docs: DataFrame, vocabulary: bytes, pattern: str):
    if len(vocabulary) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB is not sent to every worker")
    return docs.sparkSession.sparkContext.broadcast((vocabulary, class_differences(pattern), compiled(vocabulary)))


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids as packed little-endian unsigned 32-bit integers."""
    sent = send_vocabulary(docs, vocabulary, pattern)

    def run(batches):
        own = encoder(*sent.value)
        for part in slices(batches, "text", SLICE_BYTES):
            ids = own.encode_all([x or "" for x in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """Adds ``decoded``, the bytes that the ids stand for, to a table with ``ids``."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own = decoder(sent.value)
        for part in slices(batches, "ids", SLICE_BYTES):
            at = part.schema.get_field_index("ids")
            out = [own.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*encoded.dtypes, ("decoded", "binary")]))


def round_trip(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, then decoded, in one pass."""
    sent = send_vocabulary(docs, vocabulary, pattern)

    def run(batches):
        encodes, decodes = encoder(*sent.value), decoder(sent.value[0])
        for part in slices(batches, "text", SLICE_BYTES):
            rows = []
            for ids in encodes.encode_all([x or "" for x in part.column(1).to_pylist()]):
                back = hashlib.sha256()
                for chunk in decodes.stream(np.frombuffer(ids, "<u4")):
                    back.update(chunk)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
