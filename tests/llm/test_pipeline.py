from __future__ import annotations

import re

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from tallyweave.llm import quality, shared, simhash, tokenize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r["doc_id"]: r.asDict() for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "secrets", "packing"]
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, small), f"test-{name}")
        outs.append(docs)
    assert all(o.columns == COLUMNS for o in outs[:4])
    rows = [{r["doc_id"]: r.asDict() for r in o.collect()} for o in outs[:4]]

    learn = shared.crc_mod("doc_id", 5) != 0
    model = quality.fit(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"), learn)
    model.weights = model.weights.astype(np.float32)
    good = {d for d, r in before.items() if model.score([r["text"]])[0] >= quality.THRESHOLD}
    assert set(rows[0]) == good and all(rows[0][d] == before[d] for d in good)

    prints = {d: simhash.fingerprint(before[d]["text"]) for d in good}
    group = {d: d for d in good}
    for a in sorted(good):
        for b in sorted(good):
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((group[a], group[b]))
                group = {k: x if g == y else g for k, g in group.items()}
    assert set(rows[1]) == set(group.values()) and all(rows[1][d] == before[d] for d in rows[1])

    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    items = [word.findall(r["text"].lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams = {tuple(i[k : k + 10]) for i in items for k in range(max(1, len(i) - 9))}
    for d, r in rows[2].items():
        words = word.findall(r["text"].lower())
        if r != rows[1][d]:
            assert len(r["text"]) < len(rows[1][d]["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert not any(tuple(words[k : k + 10]) in grams for k in range(len(words)))
    assert any(rows[2][d] != rows[1][d] for d in rows[2])

    for d, r in rows[3].items():
        if r != rows[2][d]:
            assert "<SECRET:" in r["text"] or "<EXAMPLE:" in r["text"]
        assert not re.search("AKIA[A-Z0-9]{16}", r["text"]) and not re.search("[0-9a-f]{24}", r["text"])
    assert set(rows[3]) == set(rows[2])

    tok = Tokenizer.from_file(tokenize.default_path())
    pieces = outs[4].collect()
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == {d: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows[3].items()}


def test_run_is_the_stages(spark, small):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, small)
    assert out.count() > 0 and "sequence_id" in out.columns
