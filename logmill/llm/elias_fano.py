"""Elias-Fano code of a non-decreasing sequence, with sampled select.

``n`` values below ``universe`` take about ``2 + log2(universe / n)`` bits each.  The low ``l`` bits are packed;
the high parts are a bitmap in which the i-th one stands at ``high + i``.  The place of every 256th one is kept,
so that ``select`` reads a few bytes.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxII")


def encode(values: np.ndarray, universe: int | None = None) -> bytes:
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(universe if universe is not None else (int(values[-1]) + 1 if n else 1))
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = b""
    if low_bits and n:
        part = values & np.uint64((1 << low_bits) - 1)
        bits = np.empty((n, low_bits), np.uint8)
        for b in range(low_bits):
            bits[:, b] = (part >> np.uint64(b)) & np.uint64(1)
        low = np.packbits(bits, bitorder="little").tobytes()
    at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    flags = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    flags[at] = 1
    high = np.packbits(flags, bitorder="little").tobytes()
    samples = at[::SAMPLE].astype("<u4").tobytes() if n and at[-1] < 2**32 else at[::SAMPLE].astype("<u8").tobytes()
    return _HEAD.pack(n, top, low_bits, len(low), len(high)) + low + high + samples


class EliasFano:
    def __init__(self, data: bytes):
        self.n, self.universe, self.low_bits, n_low, n_high = _HEAD.unpack_from(data)
        at = _HEAD.size
        self._low = np.frombuffer(data, np.uint8, n_low, at)
        self._high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        k = -(-self.n // SAMPLE)
        rest = len(data) - at - n_low - n_high
        self._samples = np.frombuffer(data, "<u4" if rest == 4 * k else "<u8", k, at + n_low + n_high)

    def __len__(self) -> int:
        return self.n

    def _low_of(self, i: int) -> int:
        out = 0
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((int(self._low[at >> 3]) >> (at & 7)) & 1) << b
        return out

    def select(self, i: int) -> int:
        """The i-th value, read from the sample before it on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, left = at >> 3, left + 1
            first = int(self._high[byte]) >> (at & 7) << (at & 7)
            while (ones := first.bit_count()) < left:
                left, byte = left - ones, byte + 1
                first = int(self._high[byte])
            for _ in range(left - 1):
                first &= first - 1
            at = byte * 8 + (first & -first).bit_length() - 1
        return (at - i) << self.low_bits | self._low_of(i)

    def values(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self._low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for b in range(self.low_bits):
                out |= bits[:, b].astype(np.uint64) << np.uint64(b)
        return out
