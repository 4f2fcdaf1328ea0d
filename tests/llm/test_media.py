import hashlib
import zlib

import numpy as np
import pytest
from fixtures import ROWS, docs

from tidemill.llm import jpeg, media


def refined(bits, block, k0, k1, low):
    """T.81 G.1.2.3, without runs of blocks."""
    new = [k for k in range(k0, k1 + 1) if abs(block[k]) >> low == 1]
    last, r, held = max(new, default=-1), 0, []
    for k in range(k0, k1 + 1):
        m = abs(int(block[k])) >> low
        if m == 0:
            r += 1
            continue
        while r > 15 and k <= last:
            bits += [("s", 0xF0), *held]
            r, held = r - 16, []
        if m > 1:
            held.append(("b", m & 1, 1))
            continue
        bits += [("s", r << 4 | 1), ("b", int(block[k] > 0), 1), *held]
        r, held = 0, []
    if r or held:
        bits += [("s", 0), *held]


def valued(bits, prefix, v):
    n = abs(v).bit_length()
    bits += [("s", prefix << 4 | n), ("b", v if v > 0 else v + (1 << n) - 1, n)]


def scan(bits):
    """(Huffman table, entropy-coded bytes) with 8-bit codes for the symbols in use."""
    symbols = sorted({x[1] for x in bits if x[0] == "s"}) or [0]
    out = "".join(f"{symbols.index(x[1]):08b}" if x[0] == "s" else f"{x[1]:0{x[2]}b}" if x[2] else "" for x in bits)
    out += "1" * (-len(out) % 8)
    return symbols, bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")


def progressive(coefs, width, height):
    """An ordinary progressive file: 4:2:0, interleaved DC in two approximations, AC in bands and two refinements."""
    seg = jpeg._segment
    parts = [b"\xff\xd8", seg(0xDB, b"\0" + bytes(range(1, 65))), seg(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]

    def add(comps, k0, k1, high, low, bits):
        symbols, data = scan(bits)
        parts.append(seg(0xC4, bytes([0x10 if k0 else 0]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + bytes(symbols)))
        parts.append(seg(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0]) for c in comps) + bytes([k0, k1, high << 4 | low])))
        parts.append(data)

    rows, cols = coefs[1].shape[:2]
    mcus = [[(0, 2 * r + i, 2 * c + j) for i in (0, 1) for j in (0, 1)] + [(1, r, c), (2, r, c)] for r in range(rows) for c in range(cols)]
    bits, pred = [], [0, 0, 0]
    for x, r, c in (b for m in mcus for b in m):
        v = int(coefs[x][r, c, 0]) >> 1
        valued(bits, 0, v - pred[x])
        pred[x] = v
    add([0, 1, 2], 0, 0, 0, 1, bits)
    real = [(-(-height // 8), -(-width // 8)), (-(-height // 16), -(-width // 16)), (-(-height // 16), -(-width // 16))]

    def blocks(x):
        return [coefs[x][r, c] for r in range(real[x][0]) for c in range(real[x][1])]

    for x in range(3):
        for k0, k1 in ((1, 5), (6, 63)):
            bits = []
            for b in blocks(x):
                run = 0
                for k in range(k0, k1 + 1):
                    v = (abs(int(b[k])) >> 2) * (1 if b[k] > 0 else -1)
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        bits.append(("s", 0xF0))
                        run -= 16
                    valued(bits, run, v)
                    run = 0
                if run:
                    bits.append(("s", 0))
            add([x], k0, k1, 0, 2, bits)
        for low in (1, 0):
            bits = []
            for b in blocks(x):
                refined(bits, b, 1, 63, low)
            add([x], 1, 63, low + 1, low, bits)
    add([0, 1, 2], 0, 0, 1, 0, [("b", int(coefs[x][r, c, 0]) & 1, 1) for x, r, c in (b for m in mcus for b in m)])
    return b"".join([*parts, b"\xff\xd9"])


@pytest.mark.parametrize("width, height, share", [(32, 16, 0.2), (40, 24, 0.05), (17, 9, 0.6)])
def test_reads_ordinary_progressive_files(width, height, share):
    rng = np.random.default_rng(width)
    rows, cols = -(-height // 16), -(-width // 16)
    coefs = [np.zeros((rows * f, cols * f, 64), np.int16) for f in (2, 1, 1)]
    for c in coefs:
        c[:] = rng.integers(-90, 90, c.shape) * (rng.random(c.shape) < share)
        c[:, :, 0] = rng.integers(-200, 200, c.shape[:2])
    image = jpeg.Image(progressive(coefs, width, height))
    for c, want in zip(image.comps, coefs):
        got = c.coefs[: c.rows, : c.cols]
        assert (got == want[: c.rows, : c.cols]).all()
    assert image.rgb().shape == (height, width, 3)


def test_inverse_transform_and_colour():
    rng = np.random.default_rng(3)
    image = jpeg.Image(jpeg.store(rng.integers(0, 256, 384 * 4).astype(np.uint8).tobytes(), 5))
    c = image.comps[0]
    plane = image.planes()[0]
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    for r, q in ((0, 0), (1, 2)):
        block = np.zeros(64)
        block[jpeg.ZIGZAG] = c.coefs[r, q]
        want = np.clip(basis.T @ block.reshape(8, 8) @ basis + 128, 0, 255)
        assert np.abs(plane[8 * r : 8 * r + 8, 8 * q : 8 * q + 8] - want).max() < 1.6
    y, cb, cr = (p.astype(float) for p in image.planes())
    grown = lambda p: p.repeat(2, 0).repeat(2, 1) - 128
    want = np.clip(np.stack([y + 1.402 * grown(cr), y - 0.344136 * grown(cb) - 0.714136 * grown(cr), y + 1.772 * grown(cb)], 2), 0, 255)
    assert np.abs(image.rgb() - want).max() <= 1.01


@pytest.mark.parametrize("n", [1, 63, 64, 384, 385, 576, 576 * 7, 576 * 300])
def test_stores_bytes_without_loss(n):
    data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    file = jpeg.store(data, n)
    image = jpeg.Image(file)
    assert jpeg.load(image) == (data, n)

    class BitByBit(jpeg.Image):
        def _array_scan(self, *args):
            return False

    if n < 5000:
        assert all((a.coefs == b.coefs).all() for a, b in zip(image.comps, BitByBit(file).comps))


def test_broken_files_and_nulls(spark):
    good = jpeg.store(b"abc" * 192, 576)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"no image"), (4, good[:-40]), (5, b"")], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in media.decode_media(df).collect()}
    assert got[1]["payload"] == b"abc" * 192 and len(got[1]["rgb"]) == got[1]["height"] * got[1]["width"] * 3
    assert got[2]["media_bytes"] is None and got[3]["feature"] is None and got[3]["media_bytes"] == 8 and got[5]["feature"] is None


def test_any_bytes_are_read_or_refused():
    rng = np.random.default_rng(8)
    coefs = [np.zeros((2 * f, 2 * f, 64), np.int16) for f in (2, 1, 1)]
    for c in coefs:
        c[:] = rng.integers(-90, 90, c.shape) * (rng.random(c.shape) < 0.1)
    files = [jpeg.store(rng.integers(0, 256, 576).astype(np.uint8).tobytes(), 570), progressive(coefs, 30, 25)]
    odd = [b"\xff\xd8\xff\xd9", b"\xff\xd8", b"\xff\xd8\xff", b""]
    for f in files:
        odd += [f[:n] for n in range(0, len(f), 3)]
        odd += [f[:i] + bytes([x]) + f[i + 1 :] for i in range(len(f)) for x in ({0, 255, f[i] ^ 1} if i < 700 or i % 7 == 0 else ())]
        head = f.index(b"\xff\xc2")
        odd.append(f[: head + 5] + b"\xff\xff\xff\xff" + f[head + 9 :])
    for f in odd:
        got = media._decoded(f, True)
        assert got["media_bytes"] == len(f) and ("feature" not in got or got["rgb"] is not None)
    huge = jpeg._segment(0xC2, b"\x08\xff\xff\xff\xff" + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    with pytest.raises(jpeg.Bad, match="larger"):
        jpeg.Image(b"\xff\xd8" + huge + b"\0" * 100_000)


def plain_pixels(payload):
    """What the pixels of a stored payload are: whole coefficients, the transform by its definition, chroma repeated."""
    m = -(-len(payload) // 384)
    w = int(np.ceil(np.sqrt(m)))
    h = -(-m // w)
    b = np.frombuffer(payload + b"\xff" * (w * h * 384 - len(payload)), np.uint8).astype(int).reshape(-1, 64)
    coefs = np.where(b >= 128, b, b - 255)
    n = w * h
    k = np.arange(8)
    basis = np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    planes = []
    for own, across, down in ((coefs[: 4 * n], 2 * w, 2 * h), (coefs[4 * n : 5 * n], w, h), (coefs[5 * n :], w, h)):
        own = own.copy()
        for at in range(len(own)):  # DC values are sums, anew every eighth block
            own[at, 0] += own[at - 1, 0] if at % 8 else 0
        out = np.zeros((8 * down, 8 * across))
        for at, c in enumerate(own):
            block = np.zeros(64)
            block[jpeg.ZIGZAG] = c
            r, q = divmod(at, across)
            out[8 * r : 8 * r + 8, 8 * q : 8 * q + 8] = basis.T @ block.reshape(8, 8) @ basis + 128
        planes.append(np.clip(out, 0, 255))
    y, cb, cr = planes[0], *(p.repeat(2, 0).repeat(2, 1) - 128 for p in planes[1:])
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2), 0, 255)


@pytest.mark.parametrize("n", [576, 576 * 4, 576 * 11])
def test_feature_against_the_definition(n):
    payload = media.payload_of(np.random.default_rng(n).integers(0, 256, n - 7).astype(np.uint8).tobytes())
    file = jpeg.store(payload, n - 7)
    got = media._decoded(file, True)
    want = plain_pixels(payload)
    pixels = np.frombuffer(got["rgb"], np.uint8).reshape(want.shape)
    assert np.abs(pixels - want).max() < 3 and np.abs(pixels - want).mean() < 0.6
    size, *sums, crc = got["feature"].split(";")
    assert size == f"{want.shape[0]}x{want.shape[1]}" and [int(x) for x in sums] == pixels.reshape(-1, 3).sum(0, dtype=int).tolist() and crc == f"{zlib.crc32(got['rgb']):08x}"
    assert got["media_sha256"] == hashlib.sha256(file).hexdigest() and got["payload"] == payload


def test_tensors_are_stored(spark):
    got = {(r["doc_id"], r["rgb_sha256"]): r for r in media.tensor_digests(docs(spark, clash=True)).collect()}
    for i, text, *_ in ROWS:
        image = jpeg.Image(jpeg.store(media.payload_of((text or "").encode()), len((text or "").encode())))
        raw = image.rgb().tobytes()
        r = got[i, hashlib.sha256(raw).hexdigest()]
        assert (r["height"], r["width"], r["rgb_bytes"]) == (image.height, image.width, len(raw))


def test_payload_digests(spark):
    got = sorted((tuple(r) for r in media.payload_digests(docs(spark, clash=True)).collect()), key=str)
    want = []
    for i, text, *_ in ROWS:
        b = (text or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        assert by.setdefault(r[3], r[5:]) == r[5:]
    assert media.payload_digests(docs(spark, [])).count() == 0
