"""Static range asymmetric numeral system over token ids: interleaved lanes, independent blocks, checkpoints, checksums.

The coder holds one 64-bit state for each lane, between 2**32 and 2**64, and moves 32 bits at a time. Symbol i of a
block belongs to lane i modulo the number of lanes, so all lanes advance together in numpy. Frequencies sum to 2**20.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20
LANES = 1024
#: A checkpoint (all states and the place in the words) after so many steps of a block.
CHECKPOINT = 128
_LOW = np.uint64(1 << 32)
_HEAD = struct.Struct("<IHHII")


class Corrupt(ValueError):
    pass


def frequencies(ids: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE, at least 1 for each id that occurs. One slot at least stays with an id that doesn't occur, so no frequency is the whole."""
    counts = np.bincount(ids).astype(np.int64)
    counts = np.append(counts, 0)
    used = counts > 0
    total, room = int(counts.sum()), (1 << SCALE) - 1 - int(used.sum())
    if room < 0:
        raise ValueError("more distinct ids than slots")
    out = np.zeros(len(counts), np.int64)
    if total:
        out[used] = 1 + counts[used] * room // total
    spare = (1 << SCALE) - 1 - int(out.sum())
    if total:
        out[int(counts.argmax())] += spare
    else:
        out[-1] += spare
    out[-1] += 1
    return out.astype(np.uint32)


def pack_table(freq: np.ndarray) -> bytes:
    return zlib.compress(freq.astype("<u4").tobytes(), 6)


def unpack_table(raw: bytes) -> np.ndarray:
    freq = np.frombuffer(zlib.decompress(raw), "<u4")
    if int(freq.sum(dtype=np.int64)) != 1 << SCALE:
        raise Corrupt("frequencies don't add up")
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.top = self.freq << np.uint64(64 - SCALE)
        self._symbols: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> bytes:
        """One block: header, checkpoints (place and states), words; then the crc32 of all that."""
        n = len(ids)
        lanes = max(1, min(LANES, n // 64))
        steps = -(-n // lanes)
        x = np.full(lanes, _LOW, np.uint64)
        out: list[np.ndarray] = []
        points: list[tuple[int, np.ndarray]] = []
        moved = 0
        for t in range(steps - 1, -1, -1):
            s = ids[t * lanes : (t + 1) * lanes]
            k = len(s)
            f, y = self.freq[s], x[:k]
            full = y >= self.top[s]
            if full.any():
                out.append((y[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                moved += len(out[-1])
                y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[:k] = (q << np.uint64(SCALE)) + (y - q * f) + self.cum[s]
            if t % CHECKPOINT == 0:
                points.append((moved, x.copy()))
        points.reverse()
        words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
        body = _HEAD.pack(n, lanes, CHECKPOINT, len(points), len(words))
        body += b"".join(struct.pack("<I", moved - m) + p.astype("<u8").tobytes() for m, p in points) + words.tobytes()
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, raw: bytes, point: int | None = None) -> np.ndarray:
        """All ids of a block, or with ``point`` those from that checkpoint to the next, without the rest of the block."""
        if len(raw) < _HEAD.size + 4 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise Corrupt("a block's checksum doesn't fit")
        n, lanes, every, n_points, n_words = _HEAD.unpack_from(raw)
        if not n:
            return np.zeros(0, np.int64)
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        size = 4 + 8 * lanes
        at = _HEAD.size + (point or 0) * size
        p = struct.unpack_from("<I", raw, at)[0]
        x = np.frombuffer(raw, "<u8", lanes, at + 4).copy()
        words = np.frombuffer(raw, "<u4", n_words, _HEAD.size + n_points * size)
        steps = -(-n // lanes)
        first, last = (0, steps) if point is None else (point * every, min(steps, (point + 1) * every))
        out = np.empty(min(n, last * lanes) - first * lanes, np.int64)
        mask = np.uint64((1 << SCALE) - 1)
        for t in range(first, last):
            k = min(lanes, n - t * lanes)
            y = x[:k]
            slot = y & mask
            s = self._symbols[slot.astype(np.int64)]
            out[(t - first) * lanes : (t - first) * lanes + k] = s
            y = self.freq[s] * (y >> np.uint64(SCALE)) + slot - self.cum[s]
            low = y < _LOW
            m = int(low.sum())
            if m:
                y[low] = y[low] << np.uint64(32) | words[p : p + m]
                p += m
            x[:k] = y
        return out
