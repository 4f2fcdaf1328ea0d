"""Progressive JPEG (ITU-T T.81) with Huffman coding, in numpy.

``decode`` accumulates the scans of any progressive file of 8-bit samples (spectral selection and successive
approximation, restarts, one to four components, sampling factors 1 or 2) into coefficient arrays. A scan whose
Huffman table holds one symbol has codes of one length and is read as an array; other scans are read bit by bit.

``store`` writes bytes losslessly as quantized coefficients, the format's unit: byte b becomes the coefficient b if
b >= 128 and b - 255 below, so that every coefficient has size category 8 and its 8 extra bits are b itself.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: the zigzag order of an 8 x 8 block.
ZIGZAG = np.array(
    [
        0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
        35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
    ]
)
MCU_BYTES = 384
DC_EVERY = 8
LONGEST_RUN = 32767
#: An image of more coefficients is read only if its file has half as many bytes.
MOST_COEFFICIENTS = 1 << 26
BANDS = ((1, 5), (6, 63))

# The DCT basis times 4096, rounded: products of integers this small are exact in doubles, so equal blocks give equal pixels.
_k = np.arange(8)
BASIS = np.rint(4096 * np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16))


class Bad(ValueError):
    """The bytes are no progressive JPEG that this module reads."""


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(n, ())) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + b"".join(bytes(lengths[n]) for n in sorted(lengths)))


def _stuffed(a: np.ndarray, data: np.ndarray | None = None) -> bytes:
    """Entropy-coded bytes with a zero after each 255; data: False where a byte belongs to a marker."""
    full = a == 255
    if data is not None:
        full &= data
    if not full.any():
        return a.tobytes()
    times = 1 + full
    out = np.repeat(a, times)
    out[np.cumsum(times)[full] - 1] = 0
    return out.tobytes()


def _dc_scan(b: np.ndarray) -> bytes:
    """Differences whose extra bits are the bytes of b, prediction starting anew every DC_EVERY blocks, so that no DC value leaves its range."""
    n, k = len(b), len(b) // DC_EVERY
    bits = np.zeros((n, 9), np.uint8)
    bits[:, 1:] = np.unpackbits(b[:, None], axis=1)
    rest = b""
    if n % DC_EVERY:
        tail = bits[k * DC_EVERY :].ravel()
        rest = _stuffed(np.packbits(np.concatenate([tail, np.ones(-len(tail) % 8, np.uint8)])))
    rows = np.empty((k, DC_EVERY + 3), np.uint8)
    rows[:, : DC_EVERY + 1] = np.packbits(bits[: k * DC_EVERY].ravel()).reshape(k, DC_EVERY + 1)
    rows[:, -2], rows[:, -1] = 0xFF, 0xD0 + np.arange(k) % 8
    data = np.ones(rows.shape, bool)
    data[:, -2:] = False
    if rest or not k:
        return _stuffed(rows.ravel(), data.ravel()) + rest
    return _stuffed(rows.ravel()[:-2], data.ravel()[:-2])


def _refinement(low: np.ndarray) -> bytes:
    """One correction bit for each coefficient of the blocks (rows of low), behind the codes of the end-of-band runs that span them."""
    parts = []
    for a in range(0, len(low), LONGEST_RUN):
        run = low[a : a + LONGEST_RUN]
        n = len(run).bit_length() - 1
        head = [int(x) for x in f"{n:04b}" + (f"{len(run) - (1 << n):0{n}b}" if n else "")]
        parts += [np.array(head, np.uint8), run.ravel()]
    bits = np.concatenate(parts)
    return _stuffed(np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])))


def store(payload: bytes, n_bytes: int) -> bytes:
    """``payload`` as a colour image with chroma halved both ways: blocks of 64 bytes, luma first, then each chroma plane."""
    m = max(1, -(-len(payload) // MCU_BYTES))
    w = int(np.ceil(np.sqrt(m)))
    h = -(-m // w)
    if max(w, h) > 4095:
        raise ValueError("the payload is longer than the largest image holds")
    b = np.full(w * h * MCU_BYTES, 255, np.uint8)
    b[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = b.reshape(-1, 64)
    n = w * h
    parts = [
        b"\xff\xd8",
        _segment(0xFE, b"payload=%d;text=%d" % (len(payload), n_bytes)),
        _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC2, b"\x08" + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _table(0x00, {1: [8]}),
        _table(0x10, {1: [7]}),
        _table(0x11, {4: [16 * x for x in range(15)]}),
    ]
    for comp, (at, to) in enumerate(((0, 4 * n), (4 * n, 5 * n), (5 * n, 6 * n)), 1):
        own = blocks[at:to]
        parts += [_segment(0xDD, DC_EVERY.to_bytes(2, "big")), _segment(0xDA, bytes([1, comp, 0, 0, 0, 0])), _dc_scan(own[:, 0])]
        parts.append(_segment(0xDD, b"\0\0"))
        for lo, hi in BANDS:
            parts += [_segment(0xDA, bytes([1, comp, 0, lo, hi, 0x01])), (own[:, lo : hi + 1] >> 1).tobytes()]
        low = (own[:, 1:] & 1) ^ (own[:, 1:] < 128)
        parts += [_segment(0xDA, bytes([1, comp, 0x01, 1, 63, 0x10])), _refinement(low)]
    return b"".join([*parts, b"\xff\xd9"])


class _Bits:
    """Reads one restart interval bit by bit."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def bit(self) -> int:
        self.at += 1
        if self.at > len(self.bits):
            raise Bad("a scan ends early")
        return int(self.bits[self.at - 1])

    def take(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table: dict) -> int:
        code = 1
        for _ in range(16):
            code = code << 1 | self.bit()
            if code in table:
                return table[code]
        raise Bad("no such code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class _Component:
    def __init__(self, name: int, across: int, down: int, quant: int):
        self.name, self.across, self.down, self.quant = name, across, down, quant


def _codes(counts: bytes, symbols: bytes) -> dict[int, int]:
    """Symbols by code, behind a leading 1 that keeps the code's length."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            out[1 << n | code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _only(table: dict[int, int]) -> tuple[int, int] | None:
    """(symbol, length of its code) where a table has a single code, all zeros."""
    if len(table) == 1:
        ((code, symbol),) = table.items()
        if code & (code - 1) == 0:
            return symbol, code.bit_length() - 1
    return None


class Image:
    """Coefficients of a progressive file: for each component an array of (rows, columns, 64), in zigzag order.

    Whatever the bytes are, they are read or refused with ``Bad``.
    """

    def __init__(self, data: bytes):
        try:
            self._read(data)
        except (IndexError, KeyError, OverflowError, TypeError, ValueError) as e:
            raise Bad(f"the file is broken: {e}") from e
        if not self.comps:
            raise Bad("there is no frame")
        if any(c.quant not in self.quants for c in self.comps):
            raise Bad("a quantization table is missing")

    def _read(self, data: bytes) -> None:
        self.comment, self.width, self.height = b"", 0, 0
        self.comps: list[_Component] = []
        self.quants: dict[int, np.ndarray] = {}
        self.tables: dict[int, dict[int, int]] = {}
        self.every = 0
        if data[:2] != b"\xff\xd8":
            raise Bad("no start of image")
        at = 2
        while True:
            if at + 2 > len(data) or data[at] != 0xFF:
                raise Bad("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(data):
                raise Bad("a segment ends early")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    if len(body) <= n:
                        raise Bad("a quantization table ends early")
                    self.quants[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.every = int.from_bytes(body[:2], "big")
            elif marker == 0xC2:
                self._frame(body, len(data))
            elif marker == 0xDA:
                end = self._scan_end(data, at)
                self._scan(body, data[at:end])
                at = end
            elif marker in (0xC0, 0xC1, 0xC3) or 0xC5 <= marker <= 0xCF:
                raise Bad("the file is not progressive with Huffman codes")

    @staticmethod
    def _scan_end(data: bytes, at: int) -> int:
        while True:
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                raise Bad("a scan has no end")
            if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                return at
            at += 2

    def _frame(self, body: bytes, n_bytes: int) -> None:
        if self.comps:
            raise Bad("there is a second frame")
        if body[0] != 8:
            raise Bad("samples are not of 8 bits")
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for i in range(body[5]):
            name, factors, quant = body[6 + 3 * i : 9 + 3 * i]
            self.comps.append(_Component(name, factors >> 4, factors & 15, quant))
        names = {c.name for c in self.comps}
        if not self.height or not self.width or not 1 <= len(self.comps) <= 4 or len(names) < len(self.comps):
            raise Bad("the frame has no size, or no right components")
        if any(x not in (1, 2) for c in self.comps for x in (c.across, c.down)):
            raise Bad("sampling factors are not 1 or 2")
        self.most_across, self.most_down = max(c.across for c in self.comps), max(c.down for c in self.comps)
        self.mcu_cols, self.mcu_rows = -(-self.width // (8 * self.most_across)), -(-self.height // (8 * self.most_down))
        for c in self.comps:
            c.rows = -(-(-(-self.height * c.down // self.most_down)) // 8)
            c.cols = -(-(-(-self.width * c.across // self.most_across)) // 8)
        blocks = sum(self.mcu_rows * c.down * self.mcu_cols * c.across for c in self.comps)
        # every block takes a bit of the first scan at least
        if sum(c.rows * c.cols for c in self.comps) > 8 * n_bytes or 64 * blocks > max(MOST_COEFFICIENTS, 2 * n_bytes):
            raise Bad("the image is larger than its file can hold")
        for c in self.comps:
            c.coefs = np.zeros((self.mcu_rows * c.down, self.mcu_cols * c.across, 64), np.int16)

    def _scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        named = {c.name: c for c in self.comps}
        comps = [(named[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(n)]
        first, last, approx = head[1 + 2 * n : 4 + 2 * n]
        before, low = approx >> 4, approx & 15
        if not 1 <= n <= 4 or not first <= last <= 63 or (first and n > 1) or (not first and last) or low > 13:
            raise Bad("a scan has no such band")
        if n == 1 and self._array_scan(comps[0][0], self.tables.get(comps[0][1] >> 4, {}) if not first else self.tables.get(0x10 | comps[0][1] & 15, {}), data, first, last, before, low):
            return
        parts = [data]
        if self.every:
            a = np.frombuffer(data, np.uint8)
            cuts = np.flatnonzero((a[:-1] == 0xFF) & (a[1:] >= 0xD0) & (a[1:] <= 0xD7)).tolist()
            parts = [data[x:y] for x, y in zip([0, *(c + 2 for c in cuts)], [*cuts, len(data)])]
        if n == 1:
            c = comps[0][0]
            units = [[(comps[0], r, k)] for r in range(c.rows) for k in range(c.cols)]
        else:
            units = [[(x, r * x[0].down + i, k * x[0].across + j) for x in comps for i in range(x[0].down) for j in range(x[0].across)] for r in range(self.mcu_rows) for k in range(self.mcu_cols)]
        step = self.every or len(units) or 1
        for p, part in enumerate(parts):
            bits = _Bits(part.replace(b"\xff\0", b"\xff"))
            self.run = 0
            pred = {c.name: 0 for c, _ in comps}
            for unit in units[p * step : (p + 1) * step]:
                for (c, tables), r, k in unit:
                    block = c.coefs[r, k]
                    if not first:
                        if before:
                            block[0] |= bits.bit() << low
                        else:
                            pred[c.name] += bits.value(bits.symbol(self.tables[tables >> 4]))
                            block[0] = pred[c.name] << low
                    elif before:
                        self._refine(bits, self.tables[0x10 | tables & 15], block, first, last, low)
                    else:
                        self._ac_first(bits, self.tables[0x10 | tables & 15], block, first, last, low)

    def _ac_first(self, bits: _Bits, table: dict, block: np.ndarray, k: int, last: int, low: int) -> None:
        if self.run:
            self.run -= 1
            return
        while k <= last:
            skip, size = divmod(bits.symbol(table), 16)
            if size:
                k += skip
                v = bits.value(size)
                block[k] = (abs(v) << low) * (1 if v > 0 else -1)
                k += 1
            elif skip == 15:
                k += 16
            else:
                self.run = (1 << skip) + bits.take(skip) - 1
                return

    def _refine(self, bits: _Bits, table: dict, block: np.ndarray, k: int, last: int, low: int) -> None:
        def correct(i: int) -> None:
            if bits.bit():
                block[i] += (1 << low) if block[i] > 0 else -(1 << low)

        if not self.run:
            while k <= last:
                skip, size = divmod(bits.symbol(table), 16)
                if not size and skip < 15:
                    self.run = (1 << skip) + bits.take(skip)
                    break
                new = 0
                if size:
                    new = (1 << low) if bits.bit() else -(1 << low)
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif skip:
                        skip -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    block[k] = new
                k += 1
        if self.run:
            for i in range(k, last + 1):
                if block[i]:
                    correct(i)
            self.run -= 1

    def _array_scan(self, c: _Component, table: dict, data: bytes, first: int, last: int, before: int, low: int) -> bool:
        """Reads a scan of one component at once where all its codes are of one length; False: it has to be read bit by bit."""
        n, own = c.rows * c.cols, c.coefs[: c.rows, : c.cols]
        if before:
            return bool(first) and not self.every and bool((own[:, :, first : last + 1] != 0).all()) and self._corrections(own, table, data, first, last, low)
        only = _only(table)
        if only is None or (first and (only[0] >> 4 or not only[0])):
            return False
        size, length = only[0] & 15, only[1]
        each = size + length
        if size > 11 or (first and self.every):
            return False
        a = np.frombuffer(data, np.uint8)
        if self.every:
            mark = np.flatnonzero((a[:-1] == 0xFF) & (a[1:] >= 0xD0) & (a[1:] <= 0xD7))
            keep = np.ones(len(a), bool)
            keep[mark] = keep[mark + 1] = False
            a = a[keep]
        a = _unstuffed(a)
        count = n * (last - first + 1)
        if each == 8 and not self.every and len(a) == count:
            code, e = a >> size, (a & ((1 << size) - 1)).astype(np.int16)
        else:
            step = min(self.every or count, count)
            row = -(-step * each // 8)
            k, rest = divmod(count, step)
            if len(a) != k * row + -(-rest * each // 8):
                return False
            bits = np.unpackbits(a[: k * row].reshape(k, row), axis=1)[:, : step * each].reshape(-1, each)
            if rest:
                bits = np.concatenate([bits, np.unpackbits(a[k * row :])[: rest * each].reshape(-1, each)])
            code = bits[:, :length].any(axis=1)
            e = bits[:, length:].astype(np.int16) @ (1 << np.arange(size)[::-1]).astype(np.int16)
        if code.any():
            return False
        v = np.where(e >> (size - 1) if size else e, e, e - (1 << size) + 1) if size else e
        if first:
            own[:, :, first : last + 1] = (v << low).reshape(c.rows, c.cols, -1)
        else:
            step = self.every or n
            full = np.zeros(-(-n // step) * step, np.int64)
            full[:n] = v
            own[:, :, 0] = (np.cumsum(full.reshape(-1, step), axis=1).ravel()[:n] << low).reshape(c.rows, c.cols)
        return True

    def _corrections(self, own: np.ndarray, table: dict, data: bytes, first: int, last: int, low: int) -> bool:
        """A refinement of coefficients none of which is zero: runs of blocks, each with one bit for each coefficient."""
        bits = _Bits(_unstuffed(np.frombuffer(data, np.uint8)).tobytes())
        blocks = own.reshape(-1, 64)
        width, at, found = last - first + 1, 0, []
        while at < len(blocks):
            skip, size = divmod(bits.symbol(table), 16)
            if size or skip == 15:
                return False
            run = min((1 << skip) + bits.take(skip), len(blocks) - at)
            got = bits.bits[bits.at : bits.at + run * width]
            if len(got) < run * width:
                raise Bad("a scan ends early")
            found.append(got)
            bits.at += run * width
            at += run
        band = own[:, :, first : last + 1]
        own[:, :, first : last + 1] = band + np.sign(band) * (np.concatenate(found).astype(np.int16) << low).reshape(band.shape)
        return True

    def planes(self, top: int = 0, rows: int | None = None) -> list[np.ndarray]:
        """Samples of each component from MCU row top on."""
        out = []
        for c in self.comps:
            part = c.coefs[top * c.down : None if rows is None else (top + rows) * c.down]
            r, k = part.shape[:2]
            f = np.zeros((r * k, 64))
            f[:, ZIGZAG] = part.reshape(-1, 64) * self.quants[c.quant]
            f = f.reshape(-1, 8) @ BASIS
            f = f.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ BASIS
            f = np.clip(np.floor(f / (1 << 24) + 128.5), 0, 255).astype(np.int16)
            out.append(f.reshape(r, k, 8, 8).transpose(0, 3, 1, 2).reshape(8 * r, 8 * k))
        return out

    def rgb(self, top: int = 0, rows: int | None = None) -> np.ndarray:
        """Full-resolution pixels (height, width, 3) of MCU rows from top on, chroma repeated to the size of luma."""
        planes = self.planes(top, rows)

        def grown(p: np.ndarray, c: _Component) -> np.ndarray:
            return p.repeat(self.most_down // c.down, axis=0).repeat(self.most_across // c.across, axis=1)

        lines = min(self.height - 8 * self.most_down * top, len(planes[0]) * (self.most_down // self.comps[0].down))
        y = grown(planes[0], self.comps[0])[:lines, : self.width]
        out = np.empty((*y.shape, 3), np.uint8)
        if len(planes) < 3:
            out[:] = y[:, :, None]
            return out
        cb, cr = planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        # The JFIF colour conversion, in 1/65536.
        add = ((91881 * cr + 32768) >> 16, (-22554 * cb - 46802 * cr + 32768) >> 16, (116130 * cb + 32768) >> 16)
        for i, (a, c) in enumerate(zip(add, (self.comps[2], self.comps[1], self.comps[1]))):
            out[:, :, i] = np.clip(y + grown(a.astype(np.int16), c)[:lines, : self.width], 0, 255)
        return out


def _unstuffed(a: np.ndarray) -> np.ndarray:
    drop = np.flatnonzero((a[:-1] == 255) & (a[1:] == 0)) + 1
    return np.delete(a, drop) if len(drop) else a


def load(image: Image) -> tuple[bytes, int]:
    """The bytes that ``store`` put into a file, and how many of them are text."""
    want = dict(x.partition(b"=")[::2] for x in image.comment.split(b";"))
    size, text = want.get(b"payload", b""), want.get(b"text", b"")
    if not (size.isdigit() and text.isdigit() and len(size) < 19 and len(text) < 19 and len(image.comps) == 3):
        raise Bad("the comment does not tell the payload")
    parts = []
    for c in image.comps:
        v = c.coefs.reshape(-1, 64)
        out = v + 255 * (v < 0)
        dc = v[:, 0].astype(np.int32)
        diff = np.diff(dc, prepend=0)
        diff[::DC_EVERY] = dc[::DC_EVERY]
        out[:, 0] = diff + 255 * (diff < 0)
        parts.append(out.astype(np.uint8).ravel())
    found = np.concatenate(parts)
    if not int(text) <= int(size) <= len(found):
        raise Bad("the payload is longer than the image")
    return found[: int(size)].tobytes(), int(text)
