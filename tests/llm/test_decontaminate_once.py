"""Cutting reads each text once, and agrees between one automaton and several."""

from tallyweave.llm import decontaminate

ITEM = " ".join(f"w{i}" for i in range(12))
DOCS = [
    (1, f"before {ITEM} after it come some more words that no item has at all", "x"),
    (2, "a clean text of a few words", "y"),
    (3, ITEM, "z"),
    (4, None, None),
    (5, "", "e"),
]


def frames(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, cut_text string")
    items = spark.createDataFrame([("a", ITEM), ("b", "other words " * 6), ("c", None)], "item_id string, text string")
    return docs, items


def test_one_pass(spark):
    docs, items = frames(spark)
    plan = decontaminate.remove_spans(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_one_block_as_several(spark):
    docs, items = frames(spark)
    one = sorted(decontaminate.remove_spans(docs, items).collect())
    several = sorted(decontaminate.remove_spans(docs, items, block_words=5).collect())
    assert one == several
    assert [r.doc_id for r in one] == [1, 2, 4, 5]
    assert one[0].text == "before after it come some more words that no item has at all"
    assert [tuple(r)[1:] for r in one[1:]] == [d[1:] for d in DOCS if d[0] in (2, 4, 5)]


def test_a_callers_cut_text_stays(spark):
    docs, items = frames(spark)
    found = decontaminate.find_hits(docs, items, keep=("doc_id", "cut_text"))
    assert {r.doc_id: r.cut_text for r in found.collect()} == {d[0]: d[2] for d in DOCS}
