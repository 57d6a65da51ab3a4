from __future__ import annotations

import numpy as np
import pytest

from tallyweave.llm.elias_fano import EliasFano


@pytest.mark.parametrize("seed", range(30))
def test_against_plain_arrays(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 3000))
    universe = int(rng.choice([1, 7, n + 1, 50 * n + 3, 1 << 40, (1 << 63) - 1, 1 << 64]))
    values = np.sort(rng.integers(0, universe - 1, n, dtype=np.uint64, endpoint=True))
    if seed % 3 == 0 and n:
        values[: n // 2] = values[n // 2]  # one long run
    seq = EliasFano.of(values, universe)
    assert (seq.access(np.arange(n)) == values).all()
    asked = np.concatenate([values, np.clip(values, 1, None) - np.uint64(1), rng.integers(0, universe - 1, 500, dtype=np.uint64, endpoint=True)])
    want = np.searchsorted(values, asked)
    assert (seq.successor(asked) == want).all()
    held = np.isin(asked, values)
    assert (seq.find(asked) == np.where(held, want, -1)).all()
    a, b = np.full(len(asked), n // 4), np.full(len(asked), n // 2)
    inside = held & (np.searchsorted(values, asked, side="right") > n // 4) & (want < n // 2)
    assert (seq.find(asked, a, b) == np.where(inside, np.maximum(want, n // 4), -1)).all()


def test_it_is_compact():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 100_000, dtype=np.uint64))
    seq = EliasFano.of(values, 1 << 40)
    bits = 8 * (seq.high.nbytes + seq.ones.nbytes + seq.lows.nbytes) / len(values)
    assert bits < 40 - np.log2(100_000) + 3.6
