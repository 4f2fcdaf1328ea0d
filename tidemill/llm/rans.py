"""Static range asymmetric numeral systems over token ids, many lanes at once.

A block is cut into segments of STEPS x LANES ids. Each segment has its own LANES states and its own words, so that
segments decode alone or together: where a segment begins is a checkpoint. States keep to [2^31, 2^63) and
give or take 32-bit words; frequencies sum to 2^20 and every id of the vocabulary has at least one.

Layout, little-endian: b"TMR1", ids u32, segments u32, crc32 of the ids (as u32 each) u32; for each segment the
number of its words u32 and its LANES states u64; then all words u32, segment after segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE, LOW, WORD = 20, np.uint64(1 << 31), np.uint64(32)
LANES, STEPS, TOGETHER = 256, 256, 16
SEGMENT = LANES * STEPS
HEAD = struct.Struct("<4sIII")


class Corrupt(ValueError):
    """A block's checksum or layout is wrong."""


def shared_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies (u32) that sum to 2^SCALE, at least one each, nearly in proportion to counts; ties go to small ids."""
    counts = counts.astype(np.int64)
    size, most = len(counts), 1 << SCALE
    if size > most:
        raise ValueError("more symbols than 2^20")
    total = int(counts.sum())
    spare = most - size
    exact = counts.astype(np.float64) * (spare / total if total else 0.0)
    out = 1 + np.floor(exact).astype(np.int64)
    left = most - int(out.sum())
    order = np.argsort(-(exact - np.floor(exact)), kind="stable")
    out[order[: left % size]] += 1
    out += left // size
    return out.astype(np.uint32)


class Coder:
    def __init__(self, freqs: np.ndarray):
        self.f = freqs.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(freqs.astype(np.int64))[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freqs), dtype=np.uint16 if len(freqs) <= 65536 else np.uint32), freqs)

    def encode(self, ids: np.ndarray) -> bytes:
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        n = -(-len(ids) // SEGMENT)
        heads, words = [], []
        for at in range(0, n, TOGETHER):
            a, b = self._some(ids[at * SEGMENT : (at + TOGETHER) * SEGMENT])
            heads += a
            words += b
        return b"".join([HEAD.pack(b"TMR1", len(ids), n, crc), *heads, *words])

    def _some(self, ids: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        n = -(-len(ids) // SEGMENT)
        full = np.zeros(n * SEGMENT, ids.dtype)
        full[: len(ids)] = ids
        at = full.reshape(n, STEPS, LANES).transpose(1, 0, 2).reshape(STEPS, n * LANES)
        tail = len(ids) - (n - 1) * SEGMENT
        x = np.full(n * LANES, LOW)
        chunks, owners = [], []
        for s in reversed(range(STEPS)):
            m = (n - 1) * LANES + min(max(tail - s * LANES, 0), LANES)
            if not m:
                continue
            f, c, xs = self.f[at[s, :m]], self.c[at[s, :m]], x[:m]
            big = np.flatnonzero(xs >= f << np.uint64(31 - SCALE + 32))
            if len(big):
                chunks.append(xs[big].astype(np.uint32))
                owners.append((big // LANES).astype(np.uint8))
                xs[big] >>= WORD
            q = xs // f
            x[:m] = (q << np.uint64(SCALE)) + (xs - q * f) + c
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
        owner = np.concatenate(owners[::-1]) if owners else np.zeros(0, np.uint8)
        words = words[np.argsort(owner, kind="stable")]
        counts = np.bincount(owner, minlength=n)
        heads = [struct.pack("<I", k) + x[i * LANES : (i + 1) * LANES].astype("<u8").tobytes() for i, k in enumerate(counts.tolist())]
        return heads, [words.astype("<u4").tobytes()]

    def decode(self, block: bytes, segments: range | None = None) -> np.ndarray:
        """The ids of a block, or of a run of its segments alone (then without the checksum of the whole)."""
        try:
            magic, count, n, crc = HEAD.unpack_from(block)
            if magic != b"TMR1" or n != -(-count // SEGMENT):
                raise Corrupt("not a block")
            each = 4 + 8 * LANES
            sizes = [struct.unpack_from("<I", block, HEAD.size + i * each)[0] for i in range(n)]
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            words = np.frombuffer(block, "<u4", offset=HEAD.size + n * each)
            if len(words) != starts[-1]:
                raise Corrupt("words are missing")
            states = [np.frombuffer(block, "<u8", LANES, HEAD.size + i * each + 4) for i in range(n)]
        except (struct.error, ValueError) as e:
            raise Corrupt(str(e)) from e
        want = range(n) if segments is None else segments
        out = []
        for a in range(want.start, want.stop, TOGETHER):
            z = min(a + TOGETHER, want.stop)
            out.append(self._back(states[a:z], words, starts[a:z].copy(), min(count, z * SEGMENT) - a * SEGMENT))
        ids = np.concatenate(out) if out else np.zeros(0, self.symbol.dtype)
        if segments is None and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise Corrupt("the checksum differs")
        return ids

    def _back(self, states: list[np.ndarray], words: np.ndarray, at: np.ndarray, count: int) -> np.ndarray:
        n = len(states)
        x = np.concatenate(states).astype(np.uint64)
        out = np.zeros((STEPS, n * LANES), self.symbol.dtype)
        tail = count - (n - 1) * SEGMENT
        mask = np.uint64((1 << SCALE) - 1)
        for s in range(STEPS):
            m = (n - 1) * LANES + min(max(tail - s * LANES, 0), LANES)
            if not m:
                break
            slot = x[:m] & mask
            sym = self.symbol[slot]
            out[s, :m] = sym
            y = self.f[sym] * (x[:m] >> np.uint64(SCALE)) + slot - self.c[sym]
            low = np.flatnonzero(y < LOW)
            if len(low):
                seg = low // LANES
                first = np.searchsorted(seg, np.arange(n))
                pos = at[seg] + np.arange(len(low)) - first[seg]
                if pos[-1] >= len(words):
                    raise Corrupt("words are missing")
                y[low] = y[low] << WORD | words[pos].astype(np.uint64)
                at += np.bincount(seg, minlength=n)
            x[:m] = y
        if (x != LOW).any():  # where the encoder began
            raise Corrupt("the states don't end where they should")
        return out.reshape(STEPS, n, LANES).transpose(1, 0, 2).reshape(-1)[:count]
