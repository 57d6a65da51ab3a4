"""What the trie does with keys beyond 64 bits, many segments, and contexts that outweigh a segment."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ngram_trie import Brute, corpus, tokens

from tallyweave.llm import ngram_trie as trie
from tallyweave.llm import shared


@pytest.mark.parametrize("bits", [64, 20])
def test_pairs_are_sorted_alike_at_any_width(monkeypatch, bits):
    monkeypatch.setattr(trie, "KEY_BITS", bits)
    rng = np.random.default_rng(1)
    context, word = rng.integers(0, 1 << 40, 50)[rng.integers(0, 50, 4000)], rng.integers(0, 1 << 10, 4000)
    a, b, back = trie.distinct(context, word, 11)
    want = sorted(set(zip(context.tolist(), word.tolist(), strict=True)))
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == want
    assert (a[back] == context).all() and (b[back] == word).all()


def test_contexts_beyond_32_bits():
    level = trie.Level(np.array([0, 1 << 33, 1 << 33, (1 << 33) + 1]), np.array([0, 0, 500, 0]), np.zeros(5, np.int64))
    context, word = np.array([5, 1 << 33, 1 << 33, 1 << 33, (1 << 33) + 7]), np.array([9, 1, 500, 800, 0])
    assert level.cuts(context, word).tolist() == [0, 1, 2, 4, 5]


def test_too_wide_a_segment_is_an_error():
    model = trie.Model("", word_bases=np.array([0, 1 << 40]), tokens=1 << 50)
    with pytest.raises(ValueError, match="64-bit"):
        trie._bounds(model, 1 << 45, 2, {})


@pytest.mark.parametrize("fan", [2, 4096])
def test_groups_of_segments(spark, monkeypatch, fan):
    monkeypatch.setattr(trie, "FAN", fan)
    monkeypatch.setattr(trie, "SALTS", 2)
    texts = corpus(9, 200) + ["w0 w1 w2 " * 400]  # contexts that outweigh a segment, of level 3 too
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    model = Brute(texts, 3, 1, 0.75)
    for r in trie.score(df, F.lit(True), min_count=1, segment_tokens=200).collect():
        want, n = model.score(r["text"]), len(tokens(r["text"]))
        assert want - 6 * n * trie.STEP - 1e-6 <= r["score"] <= want + 1e-6


def test_rows_passed_on_grow_with_the_tasks(monkeypatch):
    monkeypatch.setattr(trie, "FAN", 4)

    def rows(parts):
        keys = np.arange(parts * 3, dtype=np.uint64)
        out = list(trie._rows(keys, np.ones(len(keys), np.int64), np.arange(parts + 1) * 3, trie._width(parts)))
        assert sum(len(k) for b in out for _, k, _ in trie._unrow(*(b.column(n)[0].as_py() for n in ("parts", "sizes", "keys", "counts")))) == parts * 3
        return len(out)

    assert rows(4) == rows(40) == rows(400) == 4


def test_files_of_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    from pyarrow import fs

    shared.put_file(f"{tmp_path}/a", trie.pack_arrays({"x": 1}, {"n": np.arange(5)}))
    monkeypatch.setattr(shared, "local_fs", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), path))
    header, arrays = trie.map_arrays(f"{tmp_path}/a")
    assert header == {"x": 1} and arrays["n"].tolist() == [0, 1, 2, 3, 4]
