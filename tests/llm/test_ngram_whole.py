from __future__ import annotations

import zlib

from test_ngram_trie import Brute

from tallyweave.llm import ngram_trie as trie
from tallyweave.llm import queries


def test_op1_keeps_every_ngram(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    model = Brute([t for d, t in docs.items() if zlib.crc32(str(d).encode()) % 7 != 2], 3, 1, 0.75)
    rows = queries.op1_ngram_trie(spark, small).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        assert abs(r["score"] - model.score(docs[r["doc_id"]])) <= 6 * r["n_tokens"] * trie.STEP
