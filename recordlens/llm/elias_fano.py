"""Elias-Fano coding of non-decreasing numbers, with select by sampled positions."""

from __future__ import annotations

import struct

import numpy as np

# Every so many values the place of its bit is noted.
SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxxxxxQQ")


class EliasFano:
    """``n`` values below ``universe``: low bits packed, high bits in unary, about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        if len(values) and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("values must be non-negative and non-decreasing")
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)[None, :]) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.universe, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, universe, low_bits, a, b = _HEAD.unpack_from(raw)
        at = _HEAD.size
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, universe, low_bits, low, high, np.frombuffer(raw, "<u4", -(-n // SAMPLE), at + a + b))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def select(self, i: int) -> int:
        """Value number ``i``: from the sample before it, whole bytes are skipped by their counts of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        missing = i % SAMPLE
        byte = at >> 3
        first = int(self.high[byte]) >> (at & 7) << (at & 7)
        while missing >= first.bit_count():
            missing -= first.bit_count()
            byte += 1
            first = int(self.high[byte])
        for _ in range(missing):
            first &= first - 1
        place = byte * 8 + ((first & -first).bit_length() - 1)
        return (place - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """All values, in one pass over both bit arrays."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return ((ones - i) << self.low_bits) | low
