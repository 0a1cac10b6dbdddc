import hashlib
import zlib

import numpy as np
import pytest

from psephon.llm import jpeg


def test_payloads():
    r = np.random.default_rng(1)
    texts = [r.bytes(n) for n in (0, 1, 575, 576, 577, 5000, 60000)] + [b"\xff" * 3000, bytes(1000), b"\x80" * 999]
    payloads = [jpeg.padded(t) for t in texts]
    media = jpeg.store(payloads)
    for payload, own, (images, blocks) in zip(payloads, media, jpeg.read(media), strict=True):
        assert own[:2] == b"\xff\xd8" and own[-2:] == b"\xff\xd9"
        assert jpeg.payload_of(blocks) == payload and images[0].width == 72 and images[0].height == 8 * len(payload) // 576


def test_several_images(monkeypatch):
    monkeypatch.setattr(jpeg, "ROWS", 2)
    payload = jpeg.padded(b"abc" * 1000)
    (images, blocks), = jpeg.read(jpeg.store([payload]))
    assert len(images) == 3 and jpeg.payload_of(blocks) == payload and jpeg.features(images, blocks).count(",") == 2


def coded(values, dc, ac):
    """A straightforward writer of one block, to hold the decoder against."""
    diff, bits = values[0], ""

    def number(v):
        n = abs(v).bit_length()
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    code, length = dc[abs(diff).bit_length()]
    bits += format(code, f"0{length}b") + number(diff)
    run = 0
    last = max((i for i in range(1, 64) if values[i]), default=0)
    for v in values[1 : last + 1]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            bits += format(ac[0xF0][0], f"0{ac[0xF0][1]}b")
            run -= 16
        code, length = ac[run << 4 | abs(v).bit_length()]
        bits += format(code, f"0{length}b") + number(v)
        run = 0
    if last < 63:
        bits += format(ac[0][0], f"0{ac[0][1]}b")
    return bits


def test_colour_image_with_runs():
    """Three components, 2x2 sampling, zero runs, end of block, several quantisers, no restarts."""
    r = np.random.default_rng(2)
    dc_table, ac_table = jpeg.code_table({k: 4 for k in range(12)}), jpeg.code_table({s: 8 for s in [0, 0xF0] + [a << 4 | b for a in range(16) for b in range(1, 11)]})
    dc, ac = jpeg.codes_of(*dc_table), jpeg.codes_of(*ac_table)
    wide, high, previous, bits, luma = 3, 2, [0, 0, 0], "", []
    for _ in range(wide * high):
        for c in (0, 0, 0, 0, 1, 2):
            values = np.where(r.random(64) < 0.08, r.integers(-200, 200, 64), 0)
            values[0] = r.integers(-100, 100)
            if c == 0:
                luma.append(int(values[0]))
            own = values.tolist()
            own[0] -= previous[c]
            previous[c] = int(values[0])
            bits += coded(own, dc, ac)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    frame = b"\x08" + (high * 16 - 3).to_bytes(2, "big") + (wide * 16 - 5).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x01\x03\x11\x01"
    media = b"\xff\xd8" + jpeg.segment(0xE0, b"JFIF\0") + jpeg.segment(0xDB, b"\0" + b"\x10" * 64 + b"\x01" + b"\x11" * 64) + jpeg.segment(0xC0, frame)
    media += jpeg.segment(0xC4, b"\0" + b"".join(dc_table) + b"\x10" + b"".join(ac_table)) + jpeg.segment(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + scan + b"\xff\xd9"
    (images, blocks), = jpeg.read([media])
    picture = jpeg.luminance(images[0], blocks[0])
    want = np.clip((np.array(luma) * 16 + 4 >> 3) + 128, 0, 255).reshape(high, wide, 2, 2).transpose(0, 2, 1, 3).reshape(4, 6)
    assert (picture == want).all()


@pytest.mark.parametrize("cut", [0, 3, 30, 200, 500])
def test_broken(cut):
    media = jpeg.store([jpeg.padded(b"some text " * 100)])[0]
    with pytest.raises(ValueError):
        jpeg.read([media[:cut] + b"\0" if cut == 0 else media[:cut]])


def test_query(docs, rows, empty):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in jpeg.read_media(jpeg.encode_media(docs)).collect()}
    want = set()
    for i, t in rows:
        payload = jpeg.padded((t or "").encode())
        want.add((i, len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert got == want
    assert jpeg.read_media(jpeg.encode_media(empty)).count() == 0


def plain_media(payload):
    """The stored form, written bit by bit, and its feature, pixel by pixel."""
    dc, ac = jpeg.codes_of(*jpeg.code_table(jpeg.DC_LENGTHS)), jpeg.codes_of(*jpeg.code_table(jpeg.AC_LENGTHS))
    rows, picture = [], []
    for a in range(0, len(payload), 576):
        bits, previous, pixels = "", 0, []
        for b in range(a, a + 576, 64):
            values = [v - 128 + (v >= 128) for v in payload[b : b + 64]]
            pixels.append(min(max((values[0] + 4 >> 3) + 128, 0), 255))
            bits += coded([values[0] - previous, *values[1:]], dc, ac)
            previous = values[0]
        bits += "1" * (-len(bits) % 8)
        rows.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0"))
        picture.append(pixels)
    body = b"".join((bytes((0xFF, 0xD0 + (i - 1) % 8)) if i else b"") + r for i, r in enumerate(rows))

    def cell(i, n, size):
        start = i * size // n
        return start, max(start + 1, (i + 1) * size // n)

    def cells(n, m):
        out = []
        for i in range(n):
            r0, r1 = cell(i, n, len(picture))
            row = []
            for j in range(m):
                c0, c1 = cell(j, m, 9)
                values = [picture[r][c] for r in range(r0, r1) for c in range(c0, c1)]
                row.append(sum(values) / len(values))
            out.append(row)
        return out

    square, steps = cells(8, 8), cells(8, 9)
    mean = sum(map(sum, square)) / 64
    bits = ["".join("1" if v > mean else "0" for r in square for v in r), "".join("1" if b > a else "0" for r in steps for a, b in zip(r, r[1:], strict=False))]
    return jpeg.head(len(rows)) + body + b"\xff\xd9", f"72x{8 * len(rows)}:" + ":".join(format(int(b, 2), "016x") for b in bits)


def test_stored_form_and_feature(docs, rows):
    got = {(r.doc_id, r.media_bytes, r.media_sha256, r.feature, r.error) for r in jpeg.read_media(jpeg.encode_media(docs.filter("length(text) < 3000 OR text IS NULL"))).collect()}
    want = set()
    for i, t in rows:
        if len(t or "") < 3000:
            media, feature = plain_media(jpeg.padded((t or "").encode()))
            want.add((i, len(media), hashlib.sha256(media).hexdigest(), feature, None))
    assert got == want


def test_broken_media_are_reported(spark):
    good = jpeg.store([jpeg.padded(b"some text " * 100)])[0]
    media = [good, None, b"", b"no image", good[:300], good]
    df = spark.createDataFrame([(i, bytearray(m) if m is not None else None) for i, m in enumerate(media)], "i long, media binary").coalesce(1)
    got = {r.i: r for r in jpeg.read_media(df).collect()}
    assert [got[i].error is None for i in range(6)] == [True, True, False, False, False, True]
    assert got[0].feature == got[5].feature and got[0].payload_sha256 and got[1].media_bytes is None
    assert all(got[i].payload_sha256 is None and got[i].media_bytes == len(media[i]) for i in (2, 3, 4))
