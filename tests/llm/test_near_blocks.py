"""Lists of near copies that are cut into blocks, and the count filter."""

from __future__ import annotations

import numpy as np
import pytest
from test_near_copies import copies, kept

from tallyweave.llm import near_copies, simhash


@pytest.mark.parametrize("cell", [1 << 11])
def test_blocks_lose_no_pair(spark, monkeypatch, cell):
    monkeypatch.setattr(near_copies, "CELL_BYTES", cell)
    rows = copies(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in near_copies.dedup(docs).collect()} == kept(rows)


def test_links_span_what_is_alike():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(60, rng.integers(20, 50), replace=False).astype(np.uint64)) for _ in range(60)]
    wide = [bytes(160)] * 60  # all pass the count filter
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if near_copies.alike(sets[i], sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = list(range(60))
    for i, j in near_copies.link_members(wide, sets):
        assert near_copies.alike(sets[i], sets[j])
        a, b = got[i], got[j]
        got = [min(a, b) if r in (a, b) else r for r in got]
    assert got == root


def test_fingerprints_share_bytes_as_sets_share_members():
    rng = np.random.default_rng(5)
    shared = []
    for _ in range(60):
        a = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
        b = np.concatenate([a[:889], rng.integers(0, 1 << 64, 111, dtype=np.uint64)])  # similarity 0.8
        x, y = (np.frombuffer(near_copies.fingerprint(np.unique(s)), np.uint8) for s in (a, b))
        shared.append(int((x == y).sum()))
    assert min(shared) >= near_copies.LEAST_BYTES and 120 < np.mean(shared) < 137
    assert near_copies.fingerprint(np.zeros(0, np.uint64)) == b"" and near_copies.keys(b"") == []


def test_tally():
    members = np.array([0x0102030405060708, 0x0102030405060709, 0xFF02030405060708], np.uint64)
    assert simhash.tally(members).tolist() == [[8, 7, 7], [7, 8, 6], [7, 6, 8]]
