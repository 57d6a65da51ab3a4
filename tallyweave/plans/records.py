"""Queries over assets, fields, texts, summaries and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import boxes, extract, text
from tallyweave.operators import evaluate, pairing, review
from tallyweave.sources import documents as sources
from tallyweave.streaming import events as streaming

from .tables import table

# ---- pairing


def pair_all(spark, sf_dir) -> DataFrame:
    t, g = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = pairing.pair(t.select(F.col("o_orderkey").alias("code"), "o_orderpriority"), g.select(F.col("l_orderkey").alias("code"), "l_linenumber", "l_partkey"), "code")
    return both.select("code", "o_orderpriority", "l_linenumber", "l_partkey")


def _customer_lines(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("code"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber").join(o, "o_orderkey").select("code", "l_partkey", "l_linenumber")


def pair_best(spark, sf_dir) -> DataFrame:
    """Each customer's preferred order, by priority, status and key, with all lines of the customer."""
    t = pairing.preferred(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), "o_orderpriority", "o_orderstatus", "o_orderkey"), ["code"], [F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey")])
    return pairing.pair(t, _customer_lines(spark, sf_dir), "code").groupBy("code", "o_orderkey").agg(F.count(F.lit(1)).alias("targets"), F.countDistinct("l_partkey").alias("parts"))


def unmatched_keys(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return pairing.unmatched(c, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("code")), "code")


def shared_keys(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    return pairing.shared(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code")), "code")


def skip_existing(spark, sf_dir) -> DataFrame:
    """Orders of which no line has been returned yet."""
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("code"), "o_orderpriority")
    return pairing.pending(plan, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("code")), ["code"])


def first_existing(spark, sf_dir) -> DataFrame:
    """The first of three candidate order keys that exists."""
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.array(F.col("c_custkey") * 97, F.col("c_custkey") * 13, F.col("c_custkey")).alias("candidates"))
    listing = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return pairing.first_existing(wanted, listing, ["c_custkey"], "candidates")


def run_stats(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"))
    g = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"))
    runs = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "F").alias("success"), (F.col("o_orderpriority") == "5-LOW").alias("skipped"))
    return pairing.run_stats(t, g, runs)


def asset_codes(spark, sf_dir) -> DataFrame:
    coded, rejected = pairing.split_by_code(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("stem")))
    return coded.select("doc_id", "code", F.lit(True).alias("kept")).unionByName(rejected.select("doc_id", "code", F.lit(False).alias("kept")))


def assets_by_code(spark, sf_dir) -> DataFrame:
    """Pages listed by the number in their address, the plain one first."""
    u = F.col("url")
    assets = table(spark, sf_dir, "pages").select(u.alias("path"), F.regexp_extract(u, "([0-9]+)", 1).alias("code"), F.element_at(F.split(u, "/"), -1).alias("stem"))
    out = pairing.listed_by_code(assets)
    return out.select("code", "n", F.array_join(F.transform("assets", lambda a: a["stem"]), "|").alias("stems"))


def safe_names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


def variants(spark, sf_dir) -> DataFrame:
    code, stem = F.col("p_partkey").cast("string"), F.concat_ws("-", F.col("p_partkey").cast("string"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", text.variant_of(stem, code).alias("variant"))


def templates_found(spark, sf_dir) -> DataFrame:
    """Orders of one customer, asked for by a code as it was typed."""
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("code"), "o_orderkey")
    return pairing.find_by_code(t, " 7 ").unionByName(pairing.find_by_code(t, "  "))


def template_catalogue(spark, sf_dir) -> DataFrame:
    """Parts as template files, some with a variant, some as pictures, some of no known kind."""
    k = F.col("p_partkey")
    code = F.lpad(k.cast("string"), 6, "0")
    stem = F.concat(code, F.when(k % 3 == 0, "-b").otherwise(""))
    files = table(spark, sf_dir, "part").select(F.concat(stem, F.when(k % 2 == 0, ".PDF").otherwise(".png")).alias("path"), stem.alias("stem"), F.when(k % 5 == 0, ".txt").when(k % 2 == 0, ".PDF").otherwise(".png").alias("suffix"))
    return pairing.catalogue(files).select("code", "variant", "source_type", "is_default", "stem")


def _shared(spark, name: str) -> str:
    """A new folder where files of a query go."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def case_documents(spark, sf_dir) -> DataFrame:
    """Nations written as one JSON object to a file, a broken file among them, and read back: the documents, and the rejects counted."""
    at = _shared(spark, "case-documents")
    rows = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("value"), "n_nationkey")
    rows = rows.withColumn("value", F.when(F.col("n_nationkey") % 10 == 9, F.lit('{"id": ')).otherwise(F.concat(F.lit("\ufeff"), "value")))
    rows.repartitionByRange(1000, "n_nationkey").select("value", F.col("n_nationkey").alias("case")).write.partitionBy("case").text(at)
    found, rejects = sources.documents(spark, at, "id long, name string", "*.txt")
    return found.select("id", "name").unionByName(rejects.agg(F.count(F.lit(1)).alias("id")).select("id", F.lit("rejects").alias("name")))


def csv_manifest(spark, sf_dir) -> DataFrame:
    """Suppliers as a CSV manifest with a header, written and read."""
    at = _shared(spark, "csv-manifest")
    sources.write_manifest(table(spark, sf_dir, "supplier"), at, ["s_suppkey", "s_nationkey"])
    return spark.read.csv(at, header=True, schema="s_suppkey long, s_nationkey long")


def manifest_samples(spark, sf_dir) -> DataFrame:
    """Samples of several manifests, a blank id among them; of those that two hold the root's wins."""
    li = table(spark, sf_dir, "nation")
    sample = F.struct(F.when(F.col("n_nationkey") % 7 == 0, " ").otherwise(F.concat(F.lit("s"), (F.col("n_nationkey") % 9).cast("string"))).alias("sample_id"), F.col("n_nationkey").alias("n"))
    manifests = li.groupBy(F.concat(F.lit("m"), (F.col("n_regionkey")).cast("string")).alias("path")).agg(F.collect_list(sample).alias("samples"))
    one = sources.manifest_cases(manifests).groupBy("manifest", "sample_id").agg(F.min("n").alias("n"))
    return sources.winning_manifests(one, "m2").select("manifest", "sample_id", "n")


def export_lines(spark, sf_dir) -> DataFrame:
    """Lines of an export file, of regions, with quotes, comments and other lines."""
    at = _shared(spark, "exports")
    k = F.col("r_regionkey").cast("string")
    line = F.explode(F.array(F.concat(F.lit("export R_"), k, F.lit("='"), F.col("r_name"), F.lit("'")), F.concat(F.lit("# R="), k), F.concat(F.lit("P"), k, F.lit(" = 1")), F.concat(F.lit("Q"), k, F.lit("= a=b "))))
    table(spark, sf_dir, "region").select(line.alias("value")).write.text(at)
    return sources.exports(spark, at)


def ocr_boxes(spark, sf_dir) -> DataFrame:
    """Payloads with more boxes than texts and scores."""
    k = F.col("c_custkey")
    payload = table(spark, sf_dir, "customer").select("c_custkey", F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.array(F.array(i.cast("double"), F.lit(0.0)))).alias("boxes"), F.array("c_name", "c_mktsegment").alias("texts"), F.array(F.lit(0.5)).alias("scores"))
    return sources.ocr_items(payload, ["c_custkey"]).select("c_custkey", "idx", "text", "score", F.get(F.get("poly", F.lit(0)), F.lit(0)).alias("x"))


def files_listed(spark, sf_dir) -> DataFrame:
    """Files under two roots, one of which is not there, by suffix."""
    at = _shared(spark, "listing")
    table(spark, sf_dir, "region").select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("r")).write.partitionBy("r").text(at)
    found = sources.listing(spark, [at, f"{at}-none"], (".TXT",))
    return found.select(F.regexp_extract("path", "r=([0-9]+)", 1).cast("long").alias("r"), "suffix", "length")


def history_numbers(spark, sf_dir) -> DataFrame:
    """Two batches of entries appended to a history."""
    at = _shared(spark, "history")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("at"))
    sources.append_history(n.filter("at < 10"), at)
    return sources.append_history(n.filter("at >= 10"), at).select("name", "seq")


def verdict_fallback(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(" ").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("b"))
    return evaluate.verdict_distribution(rows, "a", "b")


def result_buckets(spark, sf_dir) -> DataFrame:
    """Lines of an order as compared regions; of every fourth order none was compared, and its lines are predicted boxes."""
    d = F.when(F.col("l_returnflag") == "N", "match").when(F.col("l_returnflag") == "R", "mismatch").otherwise("unknown")
    seen = F.col("l_orderkey") % 4 != 0
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(seen, F.struct(d.alias("decision"), (F.col("l_linestatus") == "O").alias("needs_review")))).alias("c"), F.collect_list(F.col("l_linenumber").cast("string")).alias("b"))
    out = evaluate.result_buckets(F.col("c"), F.col("b"))
    return rows.select("l_orderkey", out["mismatches"].alias("mismatches"), out["reviews"].alias("reviews"))


def picked_camera(spark, sf_dir) -> DataFrame:
    """Suppliers as cameras: the third of a nation's with money, and the hundredth thousandth, which is not there."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    some = [F.col("s_nationkey") < 20, None, F.col("s_acctbal") > 0]
    return evaluate.picked(s, [F.col("s_suppkey")], 2, *some).unionByName(evaluate.picked(s, [F.col("s_suppkey")], 10**8, *some))


def check_list(spark, sf_dir) -> DataFrame:
    return evaluate.any_failed(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), (F.col("s_acctbal") > -2000).alias("ok")))


# ---- texts


def match_keys(spark, sf_dir) -> DataFrame:
    """Digests of texts as they are matched; equal ones are duplicates to a reader."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.match_key(F.col("text"), wide=False)).alias("key"))


def match_key_groups(spark, sf_dir) -> DataFrame:
    """The same with compatibility forms: how many texts share a key."""
    keyed = table(spark, sf_dir, "documents").select(F.md5(text.match_key(F.col("text"))).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def compare_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.compare_key(F.col("text"))).alias("key"))


def address_compare(spark, sf_dir) -> DataFrame:
    """Part names as values: those that are equal but for blanks, gaps and case."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    spaced = F.concat(F.lit("  "), F.upper("p_name"), F.lit(" , "), F.col("p_type"), F.lit(" 12 kg"))
    plain = F.concat(F.col("p_name"), F.lit(","), F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, " 12kg").otherwise(" 13kg"))
    return p.select("p_partkey", text.values_match(spaced, plain, wide=False).alias("is_match"))


def spec_extract(spark, sf_dir) -> DataFrame:
    f = extract.compact_fields(F.col("text"), wide=False)
    return table(spark, sf_dir, "documents").select("doc_id", *[f[n].alias(n) for n in ("net_weight", "gross_weight", "color", "refrigerant")])


def label_kinds(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extract.label_kind(F.col("text")).alias("kind"))


def url_parts(spark, sf_dir) -> DataFrame:
    u = F.col("url")
    part = lambda p: F.nullif(F.regexp_extract(u, p, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", part("^https?://([^/]+)").alias("host"), part("^https?://[^/]+/([a-z]{2})/").alias("lang"), part("[?&]page=([0-9]+)").alias("page"))


def json_props(spark, sf_dir) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("top"))


def decision_domain(spark, sf_dir) -> DataFrame:
    """Event types as answers of a filter: out of domain is unknown."""
    d = extract.domain(F.concat(F.lit(" "), F.upper("event_type")), ("click", "view"), "unknown")
    return table(spark, sf_dir, "events").select("event_id", d.alias("decision"))


# ---- fields and summaries


def _field_maps(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 2 == 1

    def side(cond, more: list) -> DataFrame:
        pick = lambda c: F.max(F.when(cond, F.col(c)))
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("k"), pick(c).alias("v")) for n, c in more]), lambda e: e["v"].isNotNull()))

    both = [("status", "o_orderstatus"), ("priority", "o_orderpriority")]
    return o.groupBy("o_custkey").agg(side(odd, both).alias("a"), side(~odd, [*both, ("last", "o_orderstatus")]).alias("b")).withColumn("fields", F.array(F.lit("status"), F.lit("priority")))


def _equal(a, b):
    return text.values_match(a, b, wide=False)


def field_compare(spark, sf_dir) -> DataFrame:
    rows = evaluate.compare_fields(_field_maps(spark, sf_dir), ["o_custkey"], "fields", "a", "b", _equal)
    return rows.select("o_custkey", "field", "left_value", "right_value", "is_match")


def field_summary(spark, sf_dir) -> DataFrame:
    rows = evaluate.compare_fields(_field_maps(spark, sf_dir), ["o_custkey"], "fields", "a", "b", _equal)
    return evaluate.text_summary(rows, ["o_custkey"]).select("o_custkey", "matches", "fields", F.array_join("differing", ",").alias("differing"))


def label_union_diff(spark, sf_dir) -> DataFrame:
    rows = evaluate.align_union(_field_maps(spark, sf_dir), ["o_custkey"], "a", "b", _equal)
    return rows.filter(~F.col("is_match")).select("o_custkey", "field", "left_value", "right_value")


def comparison_sheet(spark, sf_dir) -> DataFrame:
    rows = evaluate.compare_fields(_field_maps(spark, sf_dir), ["o_custkey"], "fields", "a", "b", _equal)
    return evaluate.comparison_sheet(rows, ["o_custkey"]).select("o_custkey", "field", "template", "target", "result")


def _evaluations(spark, sf_dir) -> DataFrame:
    """Orders as evaluations: lines that were returned are missing boxes."""
    li = table(spark, sf_dir, "lineitem")
    n = lambda c: F.count_if(c)
    q = F.col("l_quantity")
    per = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("expected_count"), n(q > 10).alias("predicted_count"), n(q > 20).alias("matched_count"), n(q > 48).alias("missing_count"), n(F.col("l_discount") == 0).alias("extra_count"), F.max(q).alias("duration_seconds"), F.min(q).alias("detection_duration_seconds"))
    return per.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey").withColumn("passed", evaluate.passed(F.col("missing_count")))


def evaluation_rollup(spark, sf_dir) -> DataFrame:
    out = evaluate.roll_up(_evaluations(spark, sf_dir))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def evaluation_by_category(spark, sf_dir) -> DataFrame:
    return evaluate.by_category(_evaluations(spark, sf_dir).withColumn("category", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))), "category")


def issue_counts(spark, sf_dir) -> DataFrame:
    issue = lambda cond, name: F.when(cond, F.lit(name))
    rows = _evaluations(spark, sf_dir).select(F.array_compact(F.array(issue(F.col("missing_count") > 0, "missing"), issue(F.col("extra_count") > 0, "extra"), issue(F.col("matched_count") < 2, "few"))).alias("issues"))
    return evaluate.by_value(rows, "issues")


def verdict_table(spark, sf_dir) -> DataFrame:
    e = _evaluations(spark, sf_dir)
    v = evaluate.verdict(F.col("matched_count"), F.col("predicted_count"), F.col("missing_count") == 0, F.col("extra_count"), F.col("missing_count"), F.col("expected_count") - 3)
    return e.select(v.alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def graphic_summary(spark, sf_dir) -> DataFrame:
    """Both counting rules over lines as compared regions."""
    d = F.when(F.col("l_returnflag") == "N", "match").when(F.col("l_returnflag") == "R", "mismatch").otherwise("unknown")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", d.alias("d"), (F.col("l_linestatus") == "O").alias("r"))
    report = evaluate.graphic_counts(F.col("d"), F.col("r"))
    desktop = evaluate.desktop_counts(F.col("d"))
    return rows.groupBy("l_orderkey").agg(*[c.alias(n) for n, c in report.items()], *[c.alias(f"desktop_{n}") for n, c in desktop.items()])


def filter_summary(spark, sf_dir) -> DataFrame:
    d = F.when(F.col("event_type") == "click", "keep").when(F.col("event_type") == "view", "discard").when(F.col("event_type") != "error", F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("user_id", d.alias("d"))
    return rows.groupBy("user_id").agg(*[c.alias(n) for n, c in evaluate.filter_counts(F.col("d")).items()])


def review_metrics(spark, sf_dir) -> DataFrame:
    """Labels as reviews: good ones true, toxic ones false, every seventh left open."""
    d = F.when(F.col("doc_id") % 7 == 0, "unreviewed").when(F.col("toxic") == 1, "false_positive").otherwise("true_positive")
    manual = F.when(F.col("quality") == 0, F.array(F.struct(F.lit("manual").alias("source")))).otherwise(F.array().cast("array<struct<source:string>>"))
    out = evaluate.review_metrics(table(spark, sf_dir, "labels").select(F.array(F.struct(d.alias("decision"))).alias("predicted_boxes"), manual.alias("manual_gt_boxes")))
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall_proxy")})


def review_pivot(spark, sf_dir) -> DataFrame:
    """Reviewed and open documents of each source: the statuses are known, so one pass pivots."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return rows.withColumn("status", F.when(F.col("l").isNull(), "unreviewed").otherwise("reviewed")).groupBy("source").pivot("status", ["reviewed", "unreviewed"]).count().na.fill(0, ["reviewed", "unreviewed"])


def review_merge(spark, sf_dir) -> DataFrame:
    draft = table(spark, sf_dir, "documents").select("doc_id")
    d = F.when(F.col("toxic") == 1, "false_positive").when(F.col("quality") == 1, "true_positive").otherwise("perhaps")
    earlier = table(spark, sf_dir, "labels").select("doc_id", d.alias("decision"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("note"), F.col("toxic").alias("at"))
    return review.merge_reviews(draft, earlier, ["doc_id"], "at")


def history_recent(spark, sf_dir) -> DataFrame:
    return review.recent(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 20, "event_id")


def history_documents(spark, sf_dir) -> DataFrame:
    """Documents with their label by either of two keys; those without go."""
    h = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("output_dir"), "lang")
    r = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("output_dir"), F.lit("first").alias("document"))
    f = table(spark, sf_dir, "labels").filter("toxic = 0").select(F.col("doc_id").alias("output_dir"), F.lit("second").alias("document"))
    return review.with_results(h, r, f).select("output_dir", "lang", "document")


def distinct_codes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code")).distinct().orderBy("code")


def populated_fields(spark, sf_dir) -> DataFrame:
    c = F.col
    fields = [F.nullif(c("c_mktsegment"), F.lit("BUILDING")), F.when(c("c_acctbal") > 0, c("c_name")), F.when(c("c_nationkey") % 5 == 0, F.lit("None")).otherwise(F.lit("x"))]
    return table(spark, sf_dir, "customer").select("c_custkey", sum(F.coalesce(text.present(f), F.lit(False)).cast("int") for f in fields).alias("populated"))


# ---- events


def discrete_p95(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


def brightness(spark, sf_dir) -> DataFrame:
    """Users as cameras: their class by mean and 95th percentile of what they send."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    return rows.select("user_id", boxes.brightness_class(F.col("mean") * 2, F.col("p95")).alias("level"))


def _keys(spark, sf_dir) -> DataFrame:
    """Events as keys: purchases and errors end a frame, the rest type the first letter of their type."""
    e = F.col("event_type")
    key = F.when(e == "purchase", streaming.COMMIT).when(e == "error", streaming.CLEAR).otherwise(F.substring(e, 1, 1))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), key.alias("key"))


def scan_framing(spark, sf_dir) -> DataFrame:
    return streaming.framed(_keys(spark, sf_dir))


def change_emit(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return streaming.changes(rows, ["user_id"], ["event_id"], "event_type")


def _timed(spark, sf_dir) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("device"), at.alias("at"), F.col("event_type").alias("level"), "value")


def interval_emit(spark, sf_dir) -> DataFrame:
    """A level when it changes, or an hour after the last that was sent."""
    return streaming.per_device(_timed(spark, sf_dir).select("device", "at", "level"), ["at", "level"], lambda rows: streaming.emitted(rows, None, 3600.0)[0])


def busy_drop(spark, sf_dir) -> DataFrame:
    """Scans that come while a detection of the device is running are dropped."""
    rows = _timed(spark, sf_dir).select("device", "at", (F.col("value") * 60).alias("lasts"))
    return streaming.per_device(rows, ["at", "lasts"], lambda r: streaming.accepted(r, None)[0])


# ---- beyond the surveyed operators: coverage of the test tables


def status_cube(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("quantity"))


def order_ranks(spark, sf_dir) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("n"), F.lag("o_orderkey").over(w).alias("before"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("last_three"))


def event_windows(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def event_sessions(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes").alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("s.start").alias("start"), "n")


def priority_except(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey", "o_orderpriority").exceptAll(o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority"))


_MAPS = """m AS (SELECT o_custkey, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END) AS s1, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END) AS p1,
    max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS s2, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END) AS p2 FROM orders GROUP BY o_custkey),
    f AS (SELECT o_custkey, 0 AS place, 'status' AS field, s1 AS left_value, s2 AS right_value FROM m UNION ALL SELECT o_custkey, 1, 'priority', p1, p2 FROM m),
    c AS (SELECT *, lower(coalesce(left_value, '')) = lower(coalesce(right_value, '')) AS is_match FROM f)"""
_EVAL = """ev AS (SELECT l_orderkey, count(*) AS expected_count, count(*) FILTER (l_quantity > 10) AS predicted_count, count(*) FILTER (l_quantity > 20) AS matched_count,
    count(*) FILTER (l_quantity > 48) AS missing_count, count(*) FILTER (l_discount = 0) AS extra_count, max(l_quantity) AS duration_seconds, min(l_quantity) AS detection_duration_seconds,
    count(*) FILTER (l_quantity > 48) = 0 AS passed FROM lineitem GROUP BY l_orderkey), e AS (SELECT ev.*, o_orderpriority FROM ev JOIN orders ON l_orderkey = o_orderkey)"""
_KEYS = "k AS (SELECT user_id AS device, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'Enter' WHEN 'error' THEN 'Escape' ELSE substr(event_type, 1, 1) END AS key FROM events)"

QUERIES = {
    "templates_found": (templates_found, "SELECT CAST(o_custkey AS VARCHAR) AS code, o_orderkey FROM orders WHERE o_custkey = 7"),
    "template_catalogue": (template_catalogue, """WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code FROM part)
        SELECT code, CASE WHEN k % 3 = 0 THEN 'b' END AS variant, CASE WHEN k % 2 = 0 THEN 'pdf' ELSE 'image' END AS source_type, k % 3 <> 0 AS is_default, code || CASE WHEN k % 3 = 0 THEN '-b' ELSE '' END AS stem FROM p WHERE k % 5 <> 0"""),
    "case_documents": (case_documents, "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 10 <> 9 UNION ALL SELECT count(*), 'rejects' FROM nation WHERE n_nationkey % 10 = 9"),
    "csv_manifest": (csv_manifest, "SELECT s_suppkey, s_nationkey FROM supplier"),
    "manifest_samples": (manifest_samples, """WITH s AS (SELECT 'm' || n_regionkey AS manifest, 's' || (n_nationkey % 9) AS sample_id, min(n_nationkey) AS n FROM nation WHERE n_nationkey % 7 <> 0 GROUP BY 1, 2)
        SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY manifest <> 'm2', manifest) = 1"""),
    "export_lines": (export_lines, "SELECT 'R_' || r_regionkey AS key, r_name AS value FROM region UNION ALL SELECT 'Q' || r_regionkey, 'a=b' FROM region"),
    "ocr_boxes": (ocr_boxes, """WITH i AS (SELECT *, unnest(generate_series(0, c_custkey % 4)) AS i FROM customer)
        SELECT c_custkey, CAST(i AS INT) AS idx, CASE i WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE '' END AS text, CASE WHEN i = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, i::DOUBLE AS x FROM i"""),
    "files_listed": (files_listed, "SELECT r_regionkey AS r, '.txt' AS suffix, CAST(strlen(r_name) + 1 AS BIGINT) AS length FROM region"),
    "history_numbers": (history_numbers, "SELECT n_name AS name, n_nationkey + 1 AS seq FROM nation"),
    "verdict_fallback": (verdict_fallback, "SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'unknown' END AS verdict, count(*) AS n FROM orders GROUP BY 1"),
    "result_buckets": (result_buckets, """SELECT l_orderkey, CAST(CASE WHEN l_orderkey % 4 = 0 THEN count(*) ELSE count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') END AS INT) AS mismatches,
        CAST(CASE WHEN l_orderkey % 4 = 0 THEN 0 ELSE count(*) FILTER (l_returnflag NOT IN ('N', 'R') OR l_linestatus = 'O') END AS INT) AS reviews FROM lineitem GROUP BY l_orderkey"""),
    "picked_camera": (picked_camera, "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey < 20 AND s_acctbal > 0 ORDER BY s_suppkey LIMIT 1 OFFSET 2"),
    "check_list": (check_list, "SELECT count(*) AS checks, bool_or(s_acctbal <= -2000) AS failed FROM supplier"),
    "pair_all": (pair_all, "SELECT o_orderkey AS code, o_orderpriority, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "pair_best": (pair_best, """WITH t AS (SELECT o_custkey AS code, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) = 1),
        g AS (SELECT o_custkey AS code, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
        SELECT code, o_orderkey, count(*) AS targets, count(DISTINCT l_partkey) AS parts FROM t JOIN g USING (code) GROUP BY code, o_orderkey"""),
    "unmatched_keys": (unmatched_keys, """WITH f AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') SELECT c_custkey AS code, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM f)
        UNION ALL SELECT DISTINCT o_custkey, 'right' FROM f WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""),
    "shared_keys": (shared_keys, "SELECT c_custkey AS code FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "skip_existing": (skip_existing, "SELECT o_orderkey AS code, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "first_existing": (first_existing, """SELECT c_custkey, coalesce((SELECT any_value(o_orderkey) FROM orders WHERE o_orderkey = c_custkey * 97), (SELECT any_value(o_orderkey) FROM orders WHERE o_orderkey = c_custkey * 13),
        (SELECT any_value(o_orderkey) FROM orders WHERE o_orderkey = c_custkey)) AS path FROM customer"""),
    "run_stats": (run_stats, """SELECT (SELECT count(*) FROM orders) AS template_files, (SELECT count(DISTINCT o_custkey) FROM orders) AS template_codes, (SELECT count(*) FROM customer) AS target_files,
        (SELECT count(DISTINCT c_custkey) FROM customer) AS target_codes, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS matched_codes,
        (SELECT count(*) FROM orders) AS cases, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS succeeded, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS failed,
        (SELECT count(*) FROM orders WHERE o_orderpriority = '5-LOW') AS skipped"""),
    "asset_codes": (asset_codes, "SELECT doc_id, nullif(regexp_extract(text, '([0-9]{6,})', 1), '') AS code, nullif(regexp_extract(text, '([0-9]{6,})', 1), '') IS NOT NULL AS kept FROM documents"),
    "assets_by_code": (assets_by_code, """WITH a AS (SELECT url AS path, regexp_extract(url, '([0-9]+)', 1) AS code, split_part(url, '/', -1) AS stem FROM pages)
        SELECT code, count(*) AS n, string_agg(stem, '|' ORDER BY stem <> code, stem, path) AS stems FROM a GROUP BY code"""),
    "safe_names": (safe_names, "SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), ''), 'unnamed') AS name FROM pages"),
    "variants": (variants, "SELECT p_partkey, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE '' END AS variant FROM part"),
    "match_keys": (match_keys, "SELECT doc_id, md5(regexp_replace(lower(coalesce(text, '')), '[^0-9a-z]+', '', 'g')) AS key FROM documents"),
    "match_key_groups": (match_key_groups, None),
    "compare_keys": (compare_keys, None),
    "address_compare": (address_compare, "SELECT p_partkey, p_partkey % 2 = 0 AS is_match FROM part"),
    "spec_extract": (spec_extract, r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, nullif(trim(regexp_replace(regexp_extract(t, '(?i)N\s*\.?\s*W\s*\.?\s*:?\s*([0-9]+(?:\.[0-9]+)?\s*KG)', 1), '\s+', ' ', 'g')), '') AS net_weight,
            nullif(trim(regexp_replace(regexp_extract(t, '(?i)G\s*\.?\s*W\s*\.?\s*:?\s*([0-9]+(?:\.[0-9]+)?\s*KG)', 1), '\s+', ' ', 'g')), '') AS gross_weight,
            nullif(regexp_extract(t, '(?i)COLOR\s*:?\s*([A-Z]+)', 1), '') AS color, nullif(regexp_extract(t, '(?i)REFRIGERANT\s*:?\s*([A-Z0-9]+)', 1), '') AS refrigerant FROM t"""),
    "label_kinds": (label_kinds, """WITH u AS (SELECT doc_id, upper(coalesce(text, '')) AS t FROM documents)
        SELECT doc_id, CASE WHEN contains(t, 'NW')::INT + contains(t, 'N.W')::INT + contains(t, 'GW')::INT + contains(t, 'G.W')::INT + contains(t, 'COLOR')::INT + contains(t, 'REFRIGERANT')::INT + contains(t, 'CONNECTION PIPE')::INT >= 2 THEN 'compact' ELSE 'standard' END AS kind FROM u"""),
    "url_parts": (url_parts, """SELECT page_id, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host, nullif(regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), '') AS lang,
        nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page FROM pages"""),
    "json_props": (json_props, "WITH k AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM k GROUP BY event_type"),
    "decision_domain": (decision_domain, "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'unknown' END AS decision FROM events"),
    "field_compare": (field_compare, f"WITH {_MAPS} SELECT o_custkey, field, left_value, right_value, is_match FROM c"),
    "field_summary": (field_summary, f"WITH {_MAPS} SELECT o_custkey, count(*) FILTER (is_match) AS matches, count(*) AS fields, coalesce(string_agg(field, ',' ORDER BY place) FILTER (NOT is_match), '') AS differing FROM c GROUP BY o_custkey"),
    "label_union_diff": (label_union_diff, f"WITH {_MAPS}, u AS (SELECT o_custkey, field, left_value, right_value FROM c UNION ALL SELECT o_custkey, 'last', NULL, s2 FROM m) SELECT * FROM u WHERE lower(coalesce(left_value, '')) <> lower(coalesce(right_value, ''))"),
    "comparison_sheet": (comparison_sheet, f"WITH {_MAPS} SELECT o_custkey, field, coalesce(nullif(left_value, ''), '-') AS template, coalesce(nullif(right_value, ''), '-') AS target, CASE WHEN is_match THEN '✓' ELSE '✗' END AS result FROM c"),
    "evaluation_rollup": (evaluation_rollup, f"""WITH {_EVAL} SELECT count(*) AS total, count(*) FILTER (passed) AS passed, CAST(sum(expected_count) AS BIGINT) AS expected_count, CAST(sum(predicted_count) AS BIGINT) AS predicted_count,
        CAST(sum(matched_count) AS BIGINT) AS matched_count, CAST(sum(missing_count) AS BIGINT) AS missing_count, CAST(sum(extra_count) AS BIGINT) AS extra_count, round(avg(duration_seconds), 9) AS avg_duration_seconds,
        round(median(duration_seconds), 9) AS median_duration_seconds, round(avg(detection_duration_seconds), 9) AS avg_detection_duration_seconds, round(median(detection_duration_seconds), 9) AS median_detection_duration_seconds,
        round(count(*) FILTER (passed) / count(*), 9) AS pass_rate FROM e"""),
    "evaluation_by_category": (evaluation_by_category, f"""WITH {_EVAL} SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE 'unknown' END AS category, count(*) AS total, count(*) FILTER (passed) AS passed,
        count(*) FILTER (NOT passed) AS failed FROM e GROUP BY 1"""),
    "issue_counts": (issue_counts, f"""WITH {_EVAL} SELECT 'missing' AS value, count(*) AS n FROM e WHERE missing_count > 0 HAVING count(*) > 0 UNION ALL SELECT 'extra', count(*) FROM e WHERE extra_count > 0 HAVING count(*) > 0
        UNION ALL SELECT 'few', count(*) FROM e WHERE matched_count < 2 HAVING count(*) > 0"""),
    "verdict_table": (verdict_table, f"""WITH {_EVAL} SELECT CASE WHEN predicted_count <= matched_count AND missing_count = 0 AND extra_count = 0 THEN 'consistent' WHEN predicted_count <= matched_count AND missing_count = 0 THEN 'consistent_review'
        WHEN missing_count = 0 AND extra_count > 0 THEN 'text_differs_review' WHEN missing_count = 0 THEN 'text_differs' WHEN predicted_count <= matched_count AND expected_count - 3 > 0 AND missing_count = 0 THEN 'graphic_unresolved'
        WHEN predicted_count <= matched_count THEN 'graphic_differs' ELSE 'differs' END AS verdict, count(*) AS n FROM e GROUP BY 1"""),
    "graphic_summary": (graphic_summary, """SELECT l_orderkey, count(*) FILTER (l_returnflag = 'N' AND l_linestatus <> 'O') AS matched, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS mismatched,
        count(*) FILTER (l_returnflag NOT IN ('N', 'R') OR l_linestatus = 'O') AS to_review, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS matched_though_flagged,
        count(*) FILTER (l_returnflag = 'N') AS desktop_matched, count(*) FILTER (l_returnflag = 'R') AS desktop_mismatched, count(*) FILTER (l_returnflag NOT IN ('N', 'R')) AS desktop_to_review FROM lineitem GROUP BY l_orderkey"""),
    "filter_summary": (filter_summary, "SELECT user_id, count(*) FILTER (event_type = 'click') AS kept, count(*) FILTER (event_type = 'view') AS discarded, count(*) FILTER (event_type NOT IN ('click', 'view')) AS undecided FROM events GROUP BY user_id"),
    "review_metrics": (review_metrics, """WITH r AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 0 WHEN toxic = 1 THEN 0 ELSE 1 END AS tp, CASE WHEN doc_id % 7 <> 0 AND toxic = 1 THEN 1 ELSE 0 END AS fp, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS manual FROM labels),
        s AS (SELECT count(*) FILTER (tp + fp + manual > 0) AS reviewed, count(*) FILTER (tp + fp + manual = 0) AS skipped_unreviewed, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(manual) AS BIGINT) AS manual FROM r)
        SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + manual, 0), 9) AS recall_proxy FROM s"""),
    "review_pivot": (review_pivot, "SELECT source, count(l.doc_id) AS reviewed, count(*) - count(l.doc_id) AS unreviewed FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source"),
    "review_merge": (review_merge, """SELECT d.doc_id, coalesce(CASE WHEN toxic = 1 THEN 'false_positive' WHEN quality = 1 THEN 'true_positive' END, 'unreviewed') AS decision, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'q' || quality END AS note
        FROM documents d LEFT JOIN labels l USING (doc_id)"""),
    "history_recent": (history_recent, "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 20"),
    "history_documents": (history_documents, """SELECT d.doc_id AS output_dir, lang, CASE WHEN quality = 1 THEN 'first' ELSE 'second' END AS document FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 OR toxic = 0"""),
    "distinct_codes": (distinct_codes, "SELECT DISTINCT o_custkey AS code FROM orders ORDER BY code"),
    "populated_fields": (populated_fields, "SELECT c_custkey, CAST((c_mktsegment <> 'BUILDING')::INT + (c_acctbal > 0)::INT + (c_nationkey % 5 <> 0)::INT AS INT) AS populated FROM customer"),
    "discrete_p95": (discrete_p95, "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type"),
    "brightness": (brightness, """WITH u AS (SELECT user_id, round(avg(value), 6) * 2 AS m, quantile_disc(value, 0.95) AS p FROM events GROUP BY user_id)
        SELECT user_id, CASE WHEN m < 85 OR p < 115 THEN 'too_dark' WHEN m < 115 OR p < 145 THEN 'dim' ELSE 'ok' END AS level FROM u"""),
    "scan_framing": (scan_framing, f"""WITH {_KEYS}, f AS (SELECT *, coalesce(count(*) FILTER (key IN ('Enter', 'Escape')) OVER (PARTITION BY device ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame FROM k)
        SELECT device, max(CASE WHEN key = 'Enter' THEN seq END) AS committed_at, string_agg(key, '' ORDER BY seq) FILTER (length(key) = 1) AS code FROM f GROUP BY device, frame HAVING committed_at IS NOT NULL AND coalesce(code, '') <> ''"""),
    "change_emit": (change_emit, "SELECT user_id, event_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS DISTINCT FROM event_type"),
    "interval_emit": (interval_emit, None),
    "busy_drop": (busy_drop, None),
    "status_cube": (status_cube, "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DECIMAL(28, 2)) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "order_ranks": (order_ranks, """SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS n, lag(o_orderkey) OVER w AS before, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""),
    "event_windows": (event_windows, "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "event_sessions": (event_sessions, """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.n"""),
    "priority_except": (priority_except, "SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'"),
}

