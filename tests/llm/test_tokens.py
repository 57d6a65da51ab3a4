from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import binary_records, queries, shared, token_cache, tokenize

TOK = Tokenizer.from_file(tokenize.default_path())
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "Word", "don't", "'ll", "é", "12", "!?", "<|endoftext|>", "\U0001f600", "中"])


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(PIECES, max_size=14).map("".join), st.text(max_size=60)))
def test_pieces_give_the_librarys_ids(text):
    enc = tokenize.encoder(tokenize.default_path())
    assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == ids_of(text)


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenize, "MEMO_PIECES", 3)
    enc = tokenize.Encoder(tokenize.default_path())
    for texts in [["one two three four five", "two three"], ["six " * 50, "one two " + "x" * 200, "a "], ["two four"], ["one two three four five six seven"], [""], [None, "two"]] * 2:
        assert [np.frombuffer(i, enc.dtype).tolist() for i in enc.encode(texts)] == [ids_of(t) for t in texts]


def test_hashes():
    import pyarrow as pa

    parts = pa.array(["", "a", "b", "aa", "ab", "ba", "é", "x" * 32, "x" * 33, "y" * 40])
    keys, short = tokenize.hashes(parts)
    assert len(set(keys[:8].tolist())) == 8 and short.tolist() == [True] * 8 + [False] * 2
    assert (tokenize.hashes(parts[3:6])[0] == keys[3:6]).all()


def test_counts(spark, odd_docs):
    got = token_cache.with_token_counts(odd_docs, shared.fresh_path(spark, "cache")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert r["n_tokens"] == len(ids_of(r["text"]))


def test_cache_encodes_only_misses(spark, odd_docs):
    cache = shared.fresh_path(spark, "cache")
    token_cache.with_token_counts(odd_docs.filter("doc_id < 5"), cache)
    before = token_cache.read_cache(spark, cache).count()
    token_cache.with_token_counts(odd_docs, cache)
    rows = token_cache.read_cache(spark, cache)
    assert before == 2 + 1  # empty (null too), blank, and one text
    assert rows.count() == rows.select("content_digest").distinct().count() == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    token_cache.with_token_counts(odd_docs, cache)
    assert token_cache.read_cache(spark, cache).count() == rows.count()


def test_cache_is_by_tokenizer_version(spark, odd_docs, tmp_path):
    other = tmp_path / "other.json"
    other.write_text(open(tokenize.default_path()).read() + "\n")
    cache = shared.fresh_path(spark, "cache")
    token_cache.with_token_counts(odd_docs, cache)
    n = token_cache.read_cache(spark, cache).count()
    token_cache.with_token_counts(odd_docs, cache, str(other))
    assert token_cache.read_cache(spark, cache).count() == 2 * n


def test_clashing_names(spark):
    docs = spark.createDataFrame([("one two", 5, 6, 7)], "text string, n long, content_digest long, n_tokens long")
    assert token_cache.with_token_counts(docs, shared.fresh_path(spark, "cache")).first().asDict() == {"text": "one two", "n": 5, "content_digest": 6, "n_tokens": 2}


def test_empty_table(spark, no_docs):
    assert token_cache.with_token_counts(no_docs, shared.fresh_path(spark, "cache")).collect() == []
    manifest = binary_records.write_records(no_docs, shared.fresh_path(spark, "records"))
    assert binary_records.read_records(spark, manifest).collect() == []


def test_query_op3(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op3_token_counts(spark, small).collect():
        n = len(ids_of(docs[r["doc_id"]]))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(docs[r["doc_id"]].encode()), n > 1024)


def test_frames_are_checked():
    data = binary_records.frame(b"abc") + binary_records.frame(b"")
    assert binary_records.unframe(data, 0, 19) == b"abc"
    assert binary_records.unframe(data, 19, 35) == b""
    for at in range(19):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            binary_records.unframe(bytes(bad), 0, 19)
    with pytest.raises(ValueError):
        binary_records.unframe(data[:18], 0, 19)


@pytest.mark.parametrize("file_bytes", [1, 300, 1 << 20])
def test_records_round_trip(spark, odd_docs, file_bytes):
    path = shared.fresh_path(spark, "records")
    manifest = binary_records.write_records(odd_docs, path, partitions=3, file_bytes=file_bytes)
    got = {}
    for r in manifest.collect():
        got.update({(d, tuple(i.tolist())): 1 for d, _, i in binary_records.read_file(r["path"])})
    docs = odd_docs.collect()
    assert set(got) == {(-(2**63) if d["doc_id"] is None else d["doc_id"], (*ids_of(d["text"]), 0)) for d in docs}
    rows = sorted(binary_records.read_records(spark, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows][1:] == sorted(d["doc_id"] for d in docs if d["doc_id"] is not None) and rows[0]["doc_id"] is None
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert at == sum(len(ids_of(d["text"])) + 1 for d in docs)


def test_query_op10(spark, small):
    at, want = 0, []
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*ids_of(r["text"]), 0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op10_binary_records(spark, small).collect())) == want
