from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import evaluate, pairing, review
from tallyweave.sources import documents
from tallyweave.streaming import events


def assets(spark, names):
    rows = [(f"/in/{n}", n.rsplit(".", 1)[0], "." + n.rsplit(".", 1)[1]) for n in names]
    return spark.createDataFrame(rows, "path string, stem string, suffix string")


def test_pairing(spark):
    t, none = pairing.split_by_code(assets(spark, ["600004075219.pdf", "600004075219-01.pdf"]))
    g, ignored = pairing.split_by_code(assets(spark, ["600004075219_1.jpg", "600004075219_2.jpg", "not_a_code.jpg"]))
    assert none.count() == 0 and ignored.count() == 1
    assert pairing.cases(t, g).count() == 4
    best = pairing.cases(t, g, best=True).collect()
    assert len(best) == 2 and {r["template_stem"] for r in best} == {"600004075219"}
    assert "600004075219__vs__600004075219_1" in {r["case_id"] for r in best}
    assert pairing.cases(t, g, only=["999999"]).count() == 0
    listed = pairing.listed_by_code(t).first()
    assert [a["stem"] for a in listed["assets"]] == ["600004075219", "600004075219-01"]


def test_preference(spark):
    t, _ = pairing.split_by_code(assets(spark, ["x123456.pdf", "123456_b.pdf", "123456-a.png", "123456-a.pdf"]))
    g, _ = pairing.split_by_code(assets(spark, ["123456_9.jpg"]))
    assert pairing.cases(t, g, best=True).first()["template_path"] == "/in/123456-a.pdf"


def test_catalogue(spark):
    got = pairing.catalogue(assets(spark, ["123456-b.pdf", "123456.PNG", "123456_a.pdf", "x.pdf", "123456.txt", "000123456.pdf"]))
    assert [(r["code"], r["variant"], r["source_type"], r["is_default"]) for r in got.collect()] == [("000123456", None, "pdf", True), ("123456", None, "image", True), ("123456", "a", "pdf", False), ("123456", "b", "pdf", False)]
    assert pairing.find_by_code(got, " 123456 ").count() == 3 and pairing.find_by_code(got, " ").count() == 0


def test_left_over(spark):
    a, b = (spark.createDataFrame([(v,) for v in vs], "code string") for vs in (["1", "2", "2"], ["2", "3"]))
    assert {tuple(r) for r in pairing.unmatched(a, b, "code").collect()} == {("1", "left"), ("3", "right")}
    assert [r["code"] for r in pairing.shared(a, b, "code").collect()] == ["2"]
    assert [r["code"] for r in pairing.pending(a.distinct(), b, ["code"]).collect()] == ["1"]
    wanted = spark.createDataFrame([(1, ["x", "b", "a"]), (2, []), (3, ["x"])], "k int, candidates array<string>")
    listing = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert {tuple(r) for r in pairing.first_existing(wanted, listing, ["k"], "candidates").collect()} == {(1, "b"), (2, None), (3, None)}


def test_run_stats(spark):
    a, b = (spark.createDataFrame([(v,) for v in vs], "code string") for vs in (["1", "2", "2"], ["2", "3"]))
    runs = spark.createDataFrame([(True, False), (False, True)], "success boolean, skipped boolean")
    assert pairing.run_stats(a, b, runs).first().asDict() == {"template_files": 3, "template_codes": 2, "target_files": 2, "target_codes": 2, "matched_codes": 1, "cases": 2, "succeeded": 1, "failed": 1, "skipped": 1}


def test_field_summary(spark):
    rows = spark.createDataFrame([(1, ["maker", "date", "gone"], {"maker": "A, B", "date": "2026.01"}, {"maker": "A,B", "date": "YYYY.MM", "more": "x"})], "k int, fields array<string>, a map<string,string>, b map<string,string>")
    compared = evaluate.compare_fields(rows, ["k"], "fields", "a", "b")
    assert evaluate.text_summary(compared, ["k"]).first().asDict() == {"k": 1, "matches": 2, "fields": 3, "differing": ["date"]}
    sheet = {r["field"]: (r["template"], r["target"], r["result"]) for r in evaluate.comparison_sheet(compared, ["k"]).collect()}
    assert sheet["gone"] == ("-", "-", "✓") and sheet["date"] == ("2026.01", "YYYY.MM", "✗")
    union = evaluate.align_union(rows, ["k"], "a", "b")
    assert [r["field"] for r in union.filter("NOT is_match").orderBy("field").collect()] == ["date", "more"]


def test_two_counting_rules(spark):
    rows = spark.createDataFrame([("match", False), ("match", True), ("mismatch", True), ("mismatch", None), ("unknown", False)], "d string, r boolean")
    report = rows.agg(*[c.alias(n) for n, c in evaluate.graphic_counts(F.col("d"), F.col("r")).items()]).first()
    desktop = rows.agg(*[c.alias(n) for n, c in evaluate.desktop_counts(F.col("d")).items()]).first()
    assert tuple(report) == (1, 1, 3, 1) and tuple(desktop) == (2, 2, 1)
    kept = spark.createDataFrame([("keep",), ("discard",), ("x",), (None,)], "d string").agg(*[c.alias(n) for n, c in evaluate.filter_counts(F.col("d")).items()]).first()
    assert tuple(kept) == (1, 1, 2)


@pytest.mark.parametrize(
    ("counts", "want"),
    [((3, 3, True, 0, 0, 0), "consistent"), ((3, 3, True, 2, 0, 0), "consistent_review"), ((2, 3, True, 1, 0, 0), "text_differs_review"), ((2, 3, True, 0, 0, 0), "text_differs"), ((3, 3, False, 0, 0, 1), "graphic_unresolved"), ((3, 3, False, 0, 1, 1), "graphic_differs"), ((2, 3, False, 0, 1, 0), "differs")],
)
def test_verdicts(spark, counts, want):
    assert spark.range(1).select(evaluate.verdict(*[F.lit(c) for c in counts]).alias("v")).first()["v"] == want


def test_colours(spark):
    f = lambda t: spark.range(1).select(evaluate.verdict_colour(F.lit(t)).alias("v")).first()["v"]
    assert [f(t) for t in ("❌ x", "⚠️ 差异", "⚠️ x", "✅ x", "x")] == ["red", "red", "orange", "green", None]


def test_fusion(spark):
    f = lambda *a: tuple(spark.range(1).select(evaluate.fused_decision(*[F.lit(v) for v in a]).alias("v")).first()["v"])
    assert f(0.9, "match", 0.9) == ("match", False, "model") and f(0.3, "match", 0.9) == ("match", True, "conflict")
    assert f(0.9, "unknown", 0.9) == ("match", False, "shape") and f(0.7, "unknown", 0.9) == ("unknown", True, "shape")


def test_roll_up(spark):
    schema = "passed boolean, duration_seconds double, detection_duration_seconds double, expected_count long, predicted_count long, matched_count long, missing_count long, extra_count long, category string, issues array<string>"
    rows = spark.createDataFrame([(True, 1.0, 1.4, 1, 1, 1, 0, 0, "a", []), (False, 3.0, 2.0, 2, 1, 1, 1, 0, "", ["missing", "extra"])], schema)
    r = evaluate.roll_up(rows).first()
    assert (r["total"], r["passed"], r["pass_rate"], r["avg_duration_seconds"], r["median_duration_seconds"], r["missing_count"]) == (2, 1, 0.5, 2.0, 2.0, 1)
    assert r["median_detection_duration_seconds"] == pytest.approx(1.7)
    assert evaluate.roll_up(rows.limit(0)).first()["pass_rate"] == 0.0
    assert {tuple(x) for x in evaluate.by_category(rows, "category").collect()} == {("a", 1, 1, 0), ("unknown", 1, 0, 1)}
    assert {tuple(x) for x in evaluate.by_value(rows, "issues").collect()} == {("missing", 1), ("extra", 1)}


def test_review_metrics(spark):
    schema = "predicted_boxes array<struct<decision:string>>, manual_gt_boxes array<struct<source:string>>"
    rows = spark.createDataFrame([([("true_positive",), ("false_positive",)], [("manual",)]), ([("unreviewed",)], [])], schema)
    assert evaluate.review_metrics(rows).first().asDict() == {"reviewed": 1, "skipped_unreviewed": 1, "tp": 1, "fp": 1, "manual": 1, "precision": 0.5, "recall_proxy": 0.5}
    assert evaluate.review_metrics(rows.limit(0)).first()["precision"] is None


def test_review_merge(spark):
    draft = spark.createDataFrame([("r", "b1"), ("r", "b2"), ("r", "b3")], "run string, box_id string")
    earlier = spark.createDataFrame([("r", "b1", "true_positive", "x", 0), ("r", "b1", "false_positive", "y", 1), ("r", "b2", "perhaps", None, 0), ("r", "old", "true_positive", "", 0)], "run string, box_id string, decision string, note string, at int")
    got = {r["box_id"]: (r["decision"], r["note"]) for r in review.merge_reviews(draft, earlier, ["run", "box_id"], "at").collect()}
    assert got == {"b1": ("false_positive", "y"), "b2": ("unreviewed", ""), "b3": ("unreviewed", "")}
    history = spark.createDataFrame([(i, f"d{i}") for i in range(5)], "seq long, output_dir string")
    assert [r["seq"] for r in review.recent(history, 2).collect()] == [4, 3] and review.recent(history, -1).count() == 0


KEYS = [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "Shift"), ("a", 3, "Enter"), ("a", 4, "Enter"), ("a", 5, "9"), ("a", 6, "Escape"), ("a", 7, "3"), ("b", 8, "x"), ("a", 9, "Enter"), ("b", 10, "y")]


def test_framing(spark):
    got = events.framed(spark.createDataFrame(KEYS, "device string, seq long, key string")).collect()
    assert {tuple(r) for r in got} == {("a", 3, "12"), ("a", 9, "3")}


def test_framing_stream(spark, tmp_path):
    for n, part in enumerate((KEYS[:2], KEYS[2:8], KEYS[8:])):  # a code is typed across batches
        spark.createDataFrame(part, "device string, seq long, key string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("device string, seq long, key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = events.framed_stream(stream).writeStream.format("memory").queryName("framed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("framed").collect()} == {("a", 3, "12"), ("a", 9, "3")}


def test_sequential_rules(spark):
    assert events.emitted([(0, "ok"), (1, "ok"), (2, "dim"), (3, "dim"), (12, "dim")], None, 10)[0] == [True, False, True, False, True]
    assert events.accepted([(0, 5), (1, 1), (5, 1), (5.5, 9)], None)[0] == [True, False, True, False]
    rows = spark.createDataFrame([("a", float(t), "ok") for t in range(25)] + [("b", 3.0, "dim")], "device string, at double, level string").repartition(4)
    got = events.per_device(rows, ["at", "level"], lambda r: events.emitted(r, None, 10.0)[0]).collect()
    assert {(r["device"], r["at"]) for r in got} == {("a", 0.0), ("a", 10.0), ("a", 20.0), ("b", 3.0)}
    changed = events.changes(spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, None), (1, 3, "x")], "k int, n int, v string"), ["k"], ["n"], "v")
    assert [r["n"] for r in changed.orderBy("n").collect()] == [0, 2, 3]


def test_documents(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/600004075219.json").write_text(json.dumps({"samples": [{"sample_id": "s2", "kind": "x"}, {"sample_id": " "}, {"sample_id": "s1"}]}, indent=2))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "note.TXT").write_text("export A='1 2'\n# c\nB=x\nnothing\n")
    good, bad = documents.documents(spark, str(tmp_path), "samples array<struct<sample_id:string,kind:string>>")
    assert good.count() == 1 and bad.count() == 1
    assert [r["sample_id"] for r in documents.manifest_cases(good).collect()] == ["s1", "s2"]
    files = documents.listing(spark, [str(tmp_path), f"{tmp_path}/absent"], (".json", ".txt"))
    assert {(r["stem"], r["suffix"]) for r in files.collect()} == {("600004075219", ".json"), ("bad", ".json"), ("note", ".txt")}
    assert documents.listing(spark, [f"{tmp_path}/absent"], (".json",)).count() == 0
    assert {tuple(r) for r in documents.exports(spark, f"{tmp_path}/note.TXT").collect()} == {("A", "1 2"), ("B", "x")}


def test_payloads_and_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, [[0.0], [1.0]], ["t"], [0.5, 0.6, 0.7])], "k int, boxes array<array<double>>, texts array<string>, scores array<double>")
    assert [(r["idx"], r["text"], r["score"]) for r in documents.ocr_items(p, ["k"]).collect()] == [(0, "t", 0.5), (1, "", 0.6)]
    documents.write_results(spark.createDataFrame([("c1", 1), ("c2", 2)], "code string, v int"), f"{tmp_path}/r", "code")
    assert spark.read.json(f"{tmp_path}/r").count() == 2
    documents.write_manifest(spark.createDataFrame([(1, "x", 2)], "a int, b string, c int"), f"{tmp_path}/m", ["b", "a"])
    assert spark.read.csv(f"{tmp_path}/m", header=True).columns == ["b", "a"]


def streamed(spark, tmp_path, parts, schema, make, name):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_emission_stream(spark, tmp_path):
    parts = [[("a", 0.0, "ok"), ("b", 1.0, "dim"), ("a", 4.0, "ok")], [("a", 9.0, "dim"), ("b", 12.0, "dim")], [("a", 10.0, "dim")]]
    got = streamed(spark, tmp_path, parts, "device string, at double, level string", lambda s: events.emitted_stream(s, 10.0), "emitted")
    assert got == {("a", 0.0, "ok"), ("b", 1.0, "dim"), ("a", 9.0, "dim"), ("b", 12.0, "dim")}


def test_busy_stream(spark, tmp_path):
    parts = [[("a", 0.0, 5.0), ("a", 1.0, 9.0)], [("a", 4.0, 1.0), ("a", 5.0, 2.0)]]
    got = streamed(spark, tmp_path, parts, "device string, at double, lasts double", events.accepted_stream, "accepted")
    assert got == {("a", 0.0, 5.0), ("a", 5.0, 2.0)}


def test_new_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.json").write_text(json.dumps({"code": "c", "verdict": "ok"}, indent=2))
    seen = []
    q = events.new_results(spark, f"{tmp_path}/in", "code string, verdict string", lambda batch, _: seen.extend(tuple(r) for r in batch.collect()), f"{tmp_path}/cp")
    assert q.awaitTermination(60) and seen == [("c", "ok")]
