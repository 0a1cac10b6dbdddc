"""Media columns as baseline JPEG: writer, marker parser, Huffman scan decoder, DC-only luminance thumbnails.

**Reading.** ``parse`` walks the markers of a baseline JPEG (SOI, APPn, DQT, SOF0, DHT, DRI, SOS, RSTn, EOI).
``scan`` Huffman-decodes the entropy-coded data of any baseline image (grey or interleaved components, any
sampling, any tables): restart intervals are independent, so they are decoded in lockstep, one symbol of each
interval at a time, as numpy vectors. ``thumbnail`` reconstructs one luminance pixel for each block from the
DC coefficient alone. Dimensions, an average hash and a difference hash of the thumbnail are the features.

**Storing bytes.** JPEG's samples are lossy, its quantised coefficients are not; they are the format's unit here.
``store`` puts one byte into each coefficient of a grey image of 9 blocks a row with a quantiser of ones: byte b
becomes b - 128 below 128 and b - 127 from there on, so that no coefficient is zero and no run or end-of-block
code is needed. A row of blocks holds 576 bytes and is one restart interval. The Huffman tables are fixed. A
payload that is longer than an image can be (8,191 rows of blocks) goes into as many images as it takes, one
after another.

Defined results. Null and empty texts: one row of padding. Every text is stored whole, however long. Equal texts
give equal media and features. Null and repeated ids: each row on its own. Other columns are ignored. Broken
media have nulls and an ``error``.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephon.llm.exchange import slices

#: Bytes in a row of blocks, blocks in a row, rows of blocks in an image at most.
UNIT, ACROSS, ROWS = 576, 9, 8191
SLICE_BYTES = 1_000_000


def code_table(lengths: dict[int, int]) -> tuple[bytes, bytes]:
    """BITS and HUFFVAL of a Huffman table from the code length of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes(sum(lengths[s] == n for s in order) for n in range(1, 17)), bytes(order)


#: Code lengths of the writer: DC categories 0 to 9 and AC (run 0, size 1 to 8), shorter for what text needs.
DC_LENGTHS = {0: 5, 1: 5, 2: 5, 3: 4, 4: 3, 5: 3, 6: 2, 7: 3, 8: 5, 9: 6}
AC_LENGTHS = {1: 7, 2: 6, 3: 4, 4: 4, 5: 2, 6: 2, 7: 2, 8: 8}


def codes_of(bits: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol (T.81, annex C)."""
    out, code, at = {}, 0, 0
    for length, count in enumerate(bits, 1):
        for symbol in values[at : at + count]:
            out[symbol] = code, length
            code += 1
        at += count
        code <<= 1
    return out


@functools.cache
def lookup_of(bits: bytes, values: bytes) -> np.ndarray:
    """By the next 16 bits: code length << 8 | symbol; 0 where no code begins so."""
    table = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in codes_of(bits, values).items():
        if length:
            table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


@functools.cache
def writer_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code and length, bits of the magnitude included, of each DC difference and AC value, indexed from -511."""
    out = []
    for lengths in (DC_LENGTHS, AC_LENGTHS):
        codes = codes_of(*code_table(lengths))
        word, size = np.zeros(1023, np.int64), np.zeros(1023, np.int64)
        for v in range(-511, 512):
            category = abs(v).bit_length()
            if category in codes:
                code, length = codes[category]
                word[v + 511] = code << category | (v if v >= 0 else v + (1 << category) - 1)
                size[v + 511] = length + category
        out += [word, size]
    return tuple(out)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def head(rows: int) -> bytes:
    """All markers before the scan of a grey image of ``rows`` rows of blocks."""
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xDB, b"\0" + b"\1" * 64),
            segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ACROSS * 8, 1, 1, 0x11, 0)),
            segment(0xC4, b"\x00" + b"".join(code_table(DC_LENGTHS))),
            segment(0xC4, b"\x10" + b"".join(code_table(AC_LENGTHS))),
            segment(0xDD, struct.pack(">H", ACROSS)),
            segment(0xDA, b"\1\1\0\0\x3f\0"),
        ]
    )


def pack_rows(payload: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each row of 576 bytes, stuffed, without restart markers."""
    dc_word, dc_size, ac_word, ac_size = writer_tables()
    value = payload.reshape(-1, UNIT).astype(np.int16)
    value = value - 128 + (value >= 128)
    n = len(value)
    blocks = value.reshape(n, ACROSS, 64)
    word, size = ac_word[value + 511], ac_size[value + 511]
    diff = np.diff(blocks[:, :, 0], axis=1, prepend=0).astype(np.int64) + 511
    word.reshape(n, ACROSS, 64)[:, :, 0], size.reshape(n, ACROSS, 64)[:, :, 0] = dc_word[diff], dc_size[diff]
    end = np.cumsum(size, axis=1)
    bits = end[:, -1]
    width = (bits + 7) // 8
    base = np.cumsum(width) - width
    begin = end - size + base[:, None] * 8
    # A symbol has 24 bits at most: with its offset in a byte, it lies in four bytes.
    window = (word << (32 - size - (begin & 7))).ravel()
    first = (begin >> 3).ravel()
    out = np.zeros(int(width.sum()) + 4, np.int64)
    for k in range(4):
        out += np.bincount(first + k, (window >> (24 - 8 * k)) & 255, len(out)).astype(np.int64)
    last = base + width - 1
    out[last] |= (1 << (width * 8 - bits)) - 1
    data = out[:-4].astype(np.uint8).tobytes()
    return [data[a : a + w].replace(b"\xff", b"\xff\0") for a, w in zip(base.tolist(), width.tolist(), strict=True)]


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def store(payloads: list[bytes]) -> list[bytes]:
    """Media of each payload (a positive multiple of 576 bytes)."""
    rows = pack_rows(np.frombuffer(b"".join(payloads), np.uint8))
    out, at = [], 0
    for p in payloads:
        images = []
        for start in range(0, len(p) // UNIT, ROWS):
            own = rows[at + start : at + min(start + ROWS, len(p) // UNIT)]
            scan_data = b"".join(y for i, r in enumerate(own) for y in ((bytes((0xFF, 0xD0 + (i - 1) % 8)), r) if i else (r,)))
            images += [head(len(own)), scan_data, b"\xff\xd9"]
        at += len(p) // UNIT
        out.append(b"".join(images))
    return out


class Image:
    """Frame header, tables and restart intervals (unstuffed) of one baseline JPEG."""

    def __init__(self):
        self.height = self.width = self.restart = 0
        self.quantisers: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.components: list[tuple[int, int, int, int]] = []
        self.tables: list[tuple[int, int]] = []
        self.intervals: list[bytes] = []

    @property
    def sampling(self) -> tuple[int, int]:
        return max(c[1] for c in self.components), max(c[2] for c in self.components)

    @property
    def units(self) -> int:
        """MCUs of the image."""
        if len(self.components) == 1:
            return -(-self.height // 8) * -(-self.width // 8)
        h, v = self.sampling
        return -(-self.height // (8 * v)) * -(-self.width // (8 * h))

    @property
    def layout(self) -> list[int]:
        """Component of each block of an MCU."""
        return [0] if len(self.components) == 1 else [i for i, c in enumerate(self.components) for _ in range(c[1] * c[2])]

    def key(self):
        """Images with equal keys can be decoded in lockstep."""
        return tuple(self.layout), tuple((self.huffman[d], self.huffman[16 + a]) for d, a in self.tables)


def parse(media: bytes, at: int = 0) -> tuple[Image, int]:
    """The image that begins at ``at``, and where it ends."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of an image")
    image, at = Image(), at + 2
    while True:
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                image.quantisers[body[0] & 15] = table.astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                image.huffman[body[0]] = body[1:17], body[17 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not image.height or not image.width:
                raise ValueError("not a baseline frame of known size")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if body[0] != len(image.components):
                raise ValueError("a scan of some components only is not handled")
            image.tables = [(body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    start = at
    while True:
        cut = media.find(b"\xff", at)
        if cut < 0 or cut + 1 >= len(media):
            raise ValueError("the scan does not end")
        after = media[cut + 1]
        if after == 0 or after == 0xFF:
            at = cut + 1 + (after == 0)
            continue
        image.intervals.append(media[start:cut].replace(b"\xff\0", b"\xff"))
        start = at = cut + 2
        if not 0xD0 <= after <= 0xD7:
            return image, at


def images_of(media: bytes) -> list[Image]:
    if not media:
        raise ValueError("no start of an image")
    out, at = [], 0
    while at < len(media):
        image, at = parse(media, at)
        out.append(image)
    return out


def scan(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients, in zigzag order, of all blocks of each image (images with one key). Lockstep over restart intervals."""
    layout = images[0].layout
    tables = [(lookup_of(*images[0].huffman[d]), lookup_of(*images[0].huffman[16 + a])) for d, a in images[0].tables]
    data, units = [], []
    for image in images:
        each = image.restart or image.units
        want = [min(each, image.units - i * each) for i in range(-(-image.units // each))]
        if len(image.intervals) != len(want):
            raise ValueError("restart intervals are missing")
        data += image.intervals
        units += want
    units_ = np.array(units, np.int64)
    order = np.argsort(-units_, kind="stable")
    sizes = np.array([len(d) for d in data], np.int64)
    begin = np.cumsum(sizes + 8) - sizes - 8
    stream = np.frombuffer(b"".join(y for d in data for y in (d, b"\xff" * 8)) + b"\xff" * 8, np.uint8)
    # The next 32 bits from each byte on.
    wide = stream[:-4].astype(np.int64)
    word = (wide[:-3] << 32) | (wide[1:-2] << 24) | (wide[2:-1] << 16) | (wide[3:] << 8) | stream[4:-3]
    position, stop = begin[order] * 8, ((begin + sizes) * 8)[order]
    blocks = np.cumsum(units_ * len(layout)) - units_ * len(layout)
    out = np.zeros((int(units_.sum()) * len(layout), 64), np.int16)
    previous = np.zeros((len(images[0].components), len(data)), np.int64)

    def take(where: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, run and value at each place; the place moves on."""
        p = position[where]
        bits = (word[p >> 3] >> (24 - (p & 7))) & 0xFFFF
        found = table[bits].astype(np.int64)
        if not found.all():
            raise ValueError("bits that are no code")
        symbol = found & 255
        p += found >> 8
        size = symbol & 15
        bits = (word[p >> 3] >> (40 - (p & 7) - size)) & ((1 << size) - 1)
        position[where] = p + size
        return symbol, symbol >> 4, np.where(bits >> np.maximum(size - 1, 0) & 1, bits, bits - (1 << size) + 1) * (size > 0)

    for unit in range(int(units_.max(initial=0))):
        live = np.arange(int((units_ > unit).sum()))
        for k, c in enumerate(layout):
            dc, ac = tables[c]
            row = blocks[order[live]] + unit * len(layout) + k
            _, _, value = take(live, dc)
            previous[c, live] += value
            out[row, 0] = previous[c, live]
            todo, at = live, np.zeros(len(live), np.int64)
            while len(todo):
                symbol, run, value = take(todo, ac)
                at = at + run + 1
                if (at[symbol != 0] > 63).any():
                    raise ValueError("a block is too long")
                put = (symbol & 15) > 0
                if put.all():
                    out[row, at] = value
                    on = at < 63
                else:
                    out[row[put], at[put]] = value[put]
                    on = (at < 63) & (symbol != 0)
                if not on.all():
                    todo, at, row = todo[on], at[on], row[on]
    if (position > stop).any():
        raise ValueError("an interval is too short")
    cuts = np.cumsum([i.units * len(layout) for i in images])[:-1]
    return np.split(out, cuts)


def luminance(image: Image, blocks: np.ndarray) -> np.ndarray:
    """DC-only picture: a pixel (0 to 255) for each luminance block, cropped to the frame."""
    layout, (_, h, v, q) = image.layout, image.components[0]
    step = int(image.quantisers[q][0])
    if len(image.components) == 1:
        h = v = 1
        wide, high = -(-image.width // 8), -(-image.height // 8)
    else:
        most_h, most_v = image.sampling
        wide, high = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
    own = blocks.reshape(-1, len(layout), 64)[:, : h * v, 0].astype(np.int64)
    pixels = np.clip((own * step + 4 >> 3) + 128, 0, 255)
    grid = pixels.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
    return grid.astype(np.uint8)


def resized(picture: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over ``rows`` x ``columns`` cells; a picture with fewer pixels than cells repeats them."""
    total = np.pad(np.cumsum(np.cumsum(picture, 0, dtype=np.int64), 1), ((1, 0), (1, 0)))
    r0, c0 = (np.arange(n) * size // n for n, size in ((rows, picture.shape[0]), (columns, picture.shape[1])))
    r1, c1 = (np.maximum(start + 1, (np.arange(1, n + 1) * size) // n) for start, n, size in ((r0, rows, picture.shape[0]), (c0, columns, picture.shape[1])))
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    return sums / np.outer(r1 - r0, c1 - c0)


def hashes(picture: np.ndarray) -> tuple[str, str]:
    """Average hash (8 x 8 cells) and difference hash (8 x 9 cells), 64 bits each, as hex."""
    cells = resized(picture, 8, 8)
    steps = resized(picture, 8, 9)
    return tuple(np.packbits(b).tobytes().hex() for b in (cells > cells.mean(), steps[:, 1:] > steps[:, :-1]))


def read(media: list[bytes]) -> list[tuple[list[Image], list[np.ndarray]]]:
    """Parsed images and coefficients of each media value; images with the same tables are decoded together."""
    parsed = [images_of(m) for m in media]
    groups: dict = {}
    for i, own in enumerate(parsed):
        for j, image in enumerate(own):
            groups.setdefault(image.key(), []).append((i, j))
    out = [(own, [np.empty(0)] * len(own)) for own in parsed]
    for places in groups.values():
        for (i, j), blocks in zip(places, scan([parsed[i][j] for i, j in places]), strict=True):
            out[i][1][j] = blocks
    return out


def payload_of(blocks: list[np.ndarray]) -> bytes:
    """The bytes that ``store`` put into these coefficients."""
    value = np.concatenate(blocks).ravel()
    return (value + 128 - (value > 0)).astype(np.uint8).tobytes()


def features(images: list[Image], blocks: list[np.ndarray]) -> str:
    """Dimensions and thumbnail hashes: ``width x height : average hash : difference hash``, images joined by commas."""
    return ",".join(":".join((f"{im.width}x{im.height}", *hashes(luminance(im, b)))) for im, b in zip(images, blocks, strict=True))


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as JPEG."""

    def run(batches):
        for part in slices(batches, "body", SLICE_BYTES):
            texts = [t or b"" for t in part.column(1).to_pylist()]
            media = store([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_each(media: list[bytes]) -> list[tuple | str]:
    """As ``read``, with what is wrong in place of a value that cannot be read."""
    try:
        return read(media)
    except (ValueError, LookupError, struct.error) as e:  # the last two: segments that are cut, tables that are missing
        if len(media) == 1:
            return [str(e) or type(e).__name__]
        half = len(media) // 2
        return read_each(media[:half]) + read_each(media[half:])


def read_media(stored: DataFrame) -> DataFrame:
    """Adds what the stored bytes tell: payload figures, dimensions and thumbnail hashes (null for null media).

    Media that are no baseline JPEG, or broken, have nulls and the reason as ``error``, which is null for others.
    """

    def run(batches):
        for part in slices(batches, "media", SLICE_BYTES):
            media = part.column(part.schema.get_field_index("media")).to_pylist()
            at = [i for i, m in enumerate(media) if m is not None]
            rows: list[tuple] = [(None,) * 7] * len(media)
            for i, found in zip(at, read_each([media[i] for i in at]) if at else [], strict=True):
                own = len(media[i]), hashlib.sha256(media[i]).hexdigest()
                if isinstance(found, str):
                    rows[i] = None, None, None, *own, None, found
                    continue
                payload = payload_of(found[1])
                rows[i] = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *own, features(*found), None
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True))], names=[*part.schema.names, *kinds])

    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "error": pa.string()}
    kept = ", ".join(f"`{c}` {t}" for c, t in stored.dtypes)
    return stored.mapInArrow(run, f"{kept}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
