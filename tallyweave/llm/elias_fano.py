"""Elias-Fano sequences in numpy: monotone whole numbers in about 2 + log2(universe / n) bits each.

A value is split in ``low`` bits, kept packed, and the rest, kept in a bit vector: element i sets bit
(value >> low) + i. So the i-th one marks element i, and the h-th zero ends the bucket of
values whose high part is h. Sampled counts of ones (a word of them for each block of ``BLOCK`` words) serve both kinds of
select. All operations take arrays and work on memory-mapped buffers.
"""

from __future__ import annotations

import numpy as np

#: 64-bit words in a block of the directory.
BLOCK = 4
_U = np.uint64
_ONE = np.uint64(1)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of ``bits`` bits one after the other, as bytes; 8 bytes more, so that a whole word can be read anywhere."""
    n = len(values)
    out = np.zeros((n * bits + 7) // 8 + 8, np.uint8)
    if not bits or not n:
        return out
    step = 1 << 18  # a multiple of 8 values begins at a whole byte
    for at in range(0, n, step):
        v = values[at : at + step]
        flat = np.unpackbits(v.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=bits).ravel()
        raw = np.packbits(flat, bitorder="little")
        out[at * bits // 8 : at * bits // 8 + len(raw)] = raw
    return out


def _read(raw: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    """Packed values at indices; bits at most 57, or 64 read in two halves."""
    if not bits:
        return np.zeros(len(i), _U)
    if bits > 56:
        at = i.astype(np.int64) * bits
        return _bits_at(raw, at, 32) | (_bits_at(raw, at + 32, bits - 32) << _U(32))
    return _bits_at(raw, i.astype(np.int64) * bits, bits)


def _bits_at(raw: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    return (words[at >> 3] >> (at & 7).astype(_U)) & _U((1 << bits) - 1)


#: Place of the k-th one of a byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint8).ravel()
_EACH, _TOP = _U(0x0101010101010101), _U(0x8080808080808080)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) one of each word."""
    s = word - ((word >> _ONE) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH  # each byte: the ones up to its end
    k = k.astype(_U)
    byte = np.bitwise_count(((k * _EACH | _TOP) - s) & _TOP).astype(_U) << _U(3)  # bytes that end at or before the k-th one
    k -= (s << _U(8)) >> byte & _U(0xFF)
    return byte + _IN_BYTE[((word >> byte & _U(0xFF)) << _U(3) | k).astype(np.int64)]


class EliasFano:
    """A view of a sequence over its buffers."""

    def __init__(self, n: int, low: int, high: np.ndarray, ones: np.ndarray, lows: np.ndarray):
        self.n, self.low, self.high, self.ones, self.lows = n, low, high, ones, lows
        #: zeros before each block
        self.zeros = np.arange(len(ones), dtype=np.int64) * (64 * BLOCK) - ones

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> tuple[dict, list[np.ndarray]]:
        """(numbers, arrays) that make the sequence of non-decreasing values below ``universe``."""
        n = len(values)
        values = values.astype(_U)
        low = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        highs = (values >> _U(low)).astype(np.int64)
        top = int((universe - 1) >> low) if universe else 0
        bits = n + top + 2
        words = -(-(bits + 64) // (64 * BLOCK)) * BLOCK  # a word more, so that a run can be read anywhere
        flags = np.zeros(words * 64, np.uint8)
        flags[highs + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        per = np.bitwise_count(high).astype(np.int64).reshape(-1, BLOCK).sum(1)
        ones = np.concatenate([[0], np.cumsum(per)]).astype("<i8")
        return {"n": n, "low": low}, [high, ones, _pack(values & _U((1 << low) - 1) if low else values * _U(0), low)]

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        numbers, (high, ones, lows) = EliasFano.parts(values, universe)
        return EliasFano(numbers["n"], numbers["low"], high, ones, lows)

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Bit position of the k-th one (or zero, with flip) of the bit vector."""
        block = np.searchsorted(before, k, side="right") - 1
        left = k - before[block]
        word = block * BLOCK
        for _ in range(BLOCK - 1):
            w = self.high[word]
            n = np.bitwise_count(~w if flip else w).astype(np.int64)
            go = left >= n
            if not go.any():
                break
            left = np.where(go, left - n, left)
            word = np.where(go, word + 1, word)
        w = self.high[word]
        return word * 64 + _select_in_word(~w if flip else w, left).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at indices."""
        i = np.asarray(i, np.int64)
        highs = self._select(i, self.ones, False) - i
        return (highs.astype(_U) << _U(self.low)) | _read(self.lows, i, self.low)

    def access_pair(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at indices i and i + 1."""
        i = np.asarray(i, np.int64)
        at = self._select(i, self.ones, False)
        rest = _bits_at(self.high.view(np.uint8), at + 1, 56)
        step = np.bitwise_count((rest & (_U(0) - rest)) - _ONE).astype(np.int64)  # 64 where nothing follows that near
        nxt = at + 1 + step
        far = np.nonzero(rest == 0)[0]
        if len(far):
            nxt[far] = self._select(i[far] + 1, self.ones, False)
        low = _U(self.low)
        return ((at - i).astype(_U) << low) | _read(self.lows, i, self.low), ((nxt - i - 1).astype(_U) << low) | _read(self.lows, i + 1, self.low)

    def bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[start, end) of the elements whose high part is h: the run of ones after the zero that ends the bucket before."""
        h = np.asarray(h, np.int64)
        at = np.zeros(len(h), np.int64)
        some = np.nonzero(h > 0)[0]
        at[some] = self._select(h[some] - 1, self.zeros, True) + 1
        rest = ~_bits_at(self.high.view(np.uint8), at, 56)
        run = np.bitwise_count((rest & (_U(0) - rest)) - _ONE).astype(np.int64)
        starts = at - h
        long = np.nonzero(run >= 56)[0]
        if len(long):
            run[long] = self._select(h[long], self.zeros, True) - at[long]
        return starts, starts + run

    def _search(self, x: np.ndarray, a: np.ndarray | None, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The first element not below x among those of x's bucket within [a, b), and the end of these."""
        lo, hi = self.bucket((x >> _U(self.low)).astype(np.int64))
        if a is not None:
            lo, hi = np.maximum(lo, a), np.minimum(hi, b)
        end, want = hi.copy(), x & _U((1 << self.low) - 1)
        active = np.nonzero(lo < hi)[0]
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            below = _read(self.lows, mid, self.low) < want[active]
            lo[active] = np.where(below, mid + 1, lo[active])
            hi[active] = np.where(below, hi[active], mid)
            active = active[lo[active] < hi[active]]
        return lo, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element at or above each x; n where there is none."""
        x = np.asarray(x, _U)
        return self._search(x, None, None)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray, a: np.ndarray | None = None, b: np.ndarray | None = None) -> np.ndarray:
        """Index of each x, or -1, within [a, b) where given. x must be below the universe."""
        x = np.asarray(x, _U)
        out = np.full(len(x), -1, np.int64)
        if self.n and len(x):
            at, end = self._search(x, a, b)
            ok = np.nonzero(at < end)[0]
            ok = ok[_read(self.lows, at[ok], self.low) == x[ok] & _U((1 << self.low) - 1)]
            out[ok] = at[ok]
        return out
