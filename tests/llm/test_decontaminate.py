from __future__ import annotations

import hashlib
import random
import re

import pytest

from tallyweave.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items, window=10):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    grams = {}
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            grams.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    for n in {len(g) for g in grams}:
        for i in range(len(words) - n + 1):
            if (g := tuple(words[i : i + n])) in grams:
                hit.update(range(i, i + n))
                found |= grams[g]
    return len(words), hit, found


@pytest.mark.parametrize("seed", range(40))
def test_automaton_against_brute_force(seed):
    rnd = random.Random(seed)
    letters = "abcde"[: rnd.randint(1, 4)]
    window = rnd.randint(1, 5)
    item = lambda: " ".join(rnd.choices(letters, k=rnd.randint(0, 9)))
    items = [(str(k), item()) for k in range(rnd.randint(0, 6))]
    auto = decontaminate.Automaton([(k, decontaminate.words_of(t)) for k, t in items], window)
    for _ in range(30):
        text = " ".join(rnd.choices(letters + "z", k=rnd.randint(0, 30)))
        n, hit, found = brute(text, items, window)
        spans, got = auto.hits(decontaminate.words_of(text))
        assert {i for a, b in spans for i in range(a, b)} == hit and got == found
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_blocks_give_the_same(spark, odd_docs):
    rnd = random.Random(1)
    fox = "The quick brown fox jumps over the lazy dog near the river bank today"
    items = spark.createDataFrame([(1, fox), (2, "drie, vier vijf"), (3, None), (4, ""), (None, "no ID"), (2, "one more"), (5, " ".join(rnd.choices(["alpha", "beta"], k=12))), (6, "alpha beta " * 7)], "item_id long, text string")
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "", r["n_words"], str(r["spans"]), str(r["items"]))
    docs = odd_docs.drop("spans")
    whole = sorted(map(key, decontaminate.find_hits(docs, items, ("doc_id", "text")).collect()), key=str)
    parts = sorted(map(key, decontaminate.find_hits(docs, items, ("doc_id", "text"), block_words=5).collect()), key=str)
    assert whole == parts and len(whole) == odd_docs.count()
    listed = [("" if r["item_id"] is None else r["item_id"], r["text"]) for r in items.collect()]
    for r in decontaminate.find_hits(docs, items, ("doc_id", "text")).collect():
        n, hit, found = brute(r["text"], listed)
        assert (r["n_words"], {i for s in r["spans"] for i in range(s["start"], s["end"])}, r["items"]) == (n, hit, sorted(found))


def test_removal(spark, odd_docs, no_docs):
    fox = "the lazy dog near the river bank today"
    items = spark.createDataFrame([(1, fox)], "item_id long, text string")
    out = decontaminate.remove_spans(odd_docs, items, n_chars="spans")
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[3]["text"] == "The quick brown fox jumps over" and by[3]["spans"] == len(by[3]["text"])
    assert by[5]["text"] == "the QUICK brown fox, jumps over: !" and by[0]["text"] is None and by[6]["spans"] == 6
    assert decontaminate.remove_spans(odd_docs, items, max_coverage=0.5, n_chars=None).count() == odd_docs.count() - 5  # documents 3 (three rows), 4 and 5
    assert decontaminate.remove_spans(no_docs, items).count() == 0
    assert decontaminate.remove_spans(odd_docs, items.limit(0)).exceptAll(odd_docs).count() == 0


def test_query_op5(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op5_decontamination(spark, small).collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, found = brute(docs[r["doc_id"]], items)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert tuple(r) == (r["doc_id"], n, len(hit), len(found), digest, bool(hit))
