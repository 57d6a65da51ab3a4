"""Queries over read items: parts as items, their names as texts, their brands as cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import boxes, similarity
from tallyweave.operators import items, matching

from .tables import BOXES_SQL, line_boxes, sides, table

CASE = ["p_brand"]


def _items(spark, sf_dir) -> DataFrame:
    """(p_brand, idx, text, score, box): a part's place follows from its size and price."""
    x, y = F.col("p_size") * 18.0, F.col("p_retailprice") % 900
    b = boxes.box(x, y, x + F.length("p_name") * 6, y + 12)
    return table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"), (F.col("p_size") / 50.0).alias("score"), b.alias("box"))


def value_items(spark, sf_dir) -> DataFrame:
    """For every name of each brand, one letter lost, the items that give it."""
    n = F.row_number().over(W.partitionBy("p_brand").orderBy("text"))
    values = _items(spark, sf_dir).select("p_brand", "text").distinct().withColumn("n", n).select("p_brand", F.concat(F.lit("name"), F.col("n").cast("string")).alias("field"), F.expr("left(text, length(text) - 1)").alias("value"))
    return items.matching_items(values, _items(spark, sf_dir), CASE)


def item_features(spark, sf_dir) -> DataFrame:
    return items.place_features(_items(spark, sf_dir), 1000.0, 1000.0).select("idx", *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")])


def captions_found(spark, sf_dir) -> DataFrame:
    """Captions in items whose texts are types of parts and names of fields."""
    names = F.array(*[F.lit(t) for t in ("Rated", "Voltage", "Net Weight", "Serial No.", "Colour", "Color", "Noise Level", "Refrigerent")])
    held = _items(spark, sf_dir).withColumn("text", F.get(names, (F.col("idx") % 8).cast("int")))
    return items.captions(held, CASE).select("p_brand", "field", "caption", F.array_join(F.transform("idxs", lambda i: i.cast("string")), ",").alias("idxs"))


def annotation_outcomes(spark, sf_dir) -> DataFrame:
    """Lines as proposed annotations, in order; those of text have evidence."""
    rows = line_boxes(spark, sf_dir).select("l_orderkey", "idx", "box", (F.col("kind") == "text").alias("evidence"), (F.col("idx") % 3 == 0).alias("forced"))
    return items.annotate(rows, ["l_orderkey"]).select("l_orderkey", "idx", "outcome")


def position_differences(spark, sf_dir) -> DataFrame:
    """Lines of an order by place, odd against even, their kinds as texts."""
    def side(rows: DataFrame) -> DataFrame:
        return items.place_features(rows.select("l_orderkey", "idx", "box", F.col("kind").alias("text")), 60.0, 30.0)

    e, p = map(side, sides(line_boxes(spark, sf_dir)))
    return items.position_differences(matching.match_positions(e, p, ["l_orderkey"]), e, p, ["l_orderkey"])


def reason_settled(spark, sf_dir) -> DataFrame:
    """Event types as reasons: clicks speak of a graphic, views of a text."""
    e = F.col("event_type")
    reason = F.when(e == "click", "the logo moved").when(e == "view", "icon and digits").otherwise(e)
    return table(spark, sf_dir, "events").select("event_id", similarity.settled(F.lit("keep"), reason, F.col("user_id") % 2 == 0).alias("decision"))


def joined_words(spark, sf_dir) -> DataFrame:
    """The kinds and statuses of each order's lines as one text, in order."""
    rows = line_boxes(spark, sf_dir).select("l_orderkey", "idx", F.when(F.col("idx") % 4 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("kind"), F.col("idx").cast("string"))).alias("text"))
    return items.joined_text(rows, ["l_orderkey"], "idx")


def items_about(spark, sf_dir) -> DataFrame:
    """Even lines about odd ones as anchors, all that are found."""
    anchors, rest = sides(line_boxes(spark, sf_dir).select("l_orderkey", "idx", "box"))
    return items.about_anchor(anchors, rest, ["l_orderkey"]).select("l_orderkey", "l_idx", "r_idx")


def values_beside(spark, sf_dir) -> DataFrame:
    """Odd lines as captions of a voltage, even ones as values, some of which have its shape."""
    e, p = sides(line_boxes(spark, sf_dir))
    captions = e.select("l_orderkey", "idx", "box", F.lit("voltage").alias("field"))
    values = p.select("l_orderkey", "idx", "box", F.when(F.col("idx") % 4 == 0, "220V").otherwise(F.when(F.col("kind") == "text", "110 v").otherwise("none")).alias("text"))
    return items.value_beside(captions, values, ["l_orderkey"], 60.0, 30.0).select("l_orderkey", "l_idx", "r_idx", "value")


def address_lines(spark, sf_dir) -> DataFrame:
    """The line of an order that is likeliest an address: some say so, some lie at the bottom."""
    rows = line_boxes(spark, sf_dir).select("l_orderkey", "idx", "box", F.when(F.col("idx") % 3 == 0, "Add: West Rd").otherwise("x").alias("text"))
    return items.address_line(rows, ["l_orderkey"], 60.0, 14.0).select("l_orderkey", "idx")


def upper_candidates(spark, sf_dir) -> DataFrame:
    """Odd lines that are no fragments of even ones in the lower part."""
    e, p = sides(line_boxes(spark, sf_dir))
    return items.off_lower_lines(e.select("l_orderkey", "idx", "box"), p.select("l_orderkey", "idx", "box", F.lit("some words").alias("text")), ["l_orderkey"], 10.0).select("l_orderkey", "idx")


_O = "greatest(least(e.x2, p.x2) - greatest(e.x1, p.x1), 0) * greatest(least(e.y2, p.y2) - greatest(e.y1, p.y1), 0)"
_ROW = "greatest(least(e.y2, p.y2) - greatest(e.y1, p.y1), 0) / least(e.y2 - e.y1, p.y2 - p.y1)"

QUERIES = {
    "joined_words": (joined_words, f"""WITH {BOXES_SQL} SELECT l_orderkey, coalesce(string_agg(CASE WHEN idx % 4 <> 0 THEN kind || idx END, ' ' ORDER BY idx), '') AS text FROM b GROUP BY l_orderkey"""),
    "items_about": (items_about, f"""WITH {BOXES_SQL} SELECT l_orderkey, e.idx AS l_idx, p.idx AS r_idx FROM e JOIN p USING (l_orderkey)
        WHERE ((p.cx BETWEEN e.x1 - 10 AND e.x2 + 10 AND p.cy BETWEEN e.y1 - 8 AND e.y2 + 8) OR {_O} / p.area >= 0.35 OR {_O} / e.area >= 0.2) AND {_ROW} >= 0.35"""),
    "values_beside": (values_beside, f"""WITH {BOXES_SQL}, v AS (SELECT *, CASE WHEN idx % 4 = 0 THEN '220V' WHEN kind = 'text' THEN '110 v' END AS value FROM p),
        s AS (SELECT e.l_orderkey, e.idx AS l_idx, p.idx AS r_idx, p.value, abs(e.y1 + e.y2 - p.y1 - p.y2) / 2 / 30 + greatest(p.x1 - e.x2, 0) / 60 AS far FROM e JOIN v p USING (l_orderkey)
            WHERE p.cx > e.x2 AND value IS NOT NULL AND ({_ROW} >= 0.25 OR abs(e.y1 + e.y2 - p.y1 - p.y2) / 2 <= greatest(e.y2 - e.y1, p.y2 - p.y1, 1) * 0.7))
        SELECT l_orderkey, l_idx, r_idx, value FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_idx ORDER BY far, r_idx) = 1"""),
    "address_lines": (address_lines, f"""WITH {BOXES_SQL}, s AS (SELECT l_orderkey, idx, idx % 3 = 0 AS says, (x2 - x1) / 60 AS wide, y2 / 14 AS low, x1 FROM b)
        SELECT l_orderkey, idx FROM s WHERE (says OR (low >= 0.92 AND wide >= 0.35)) AND x1 <= 20 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY wide + low + CASE WHEN says THEN 0.5 ELSE 0 END DESC, idx DESC) = 1"""),
    "upper_candidates": (upper_candidates, f"""WITH {BOXES_SQL} SELECT l_orderkey, idx FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l_orderkey = e.l_orderkey AND e.cy / 10 >= 0.78 AND p.cy / 10 >= 0.72 AND {_ROW} >= 0.25
        AND greatest(0, e.x1 - p.x2, p.x1 - e.x2) <= greatest(30, (e.x2 - e.x1) * 0.45, (p.x2 - p.x1) * 0.08))"""),
    "value_items": (value_items, None),
    "item_features": (item_features, """WITH i AS (SELECT p_partkey AS idx, p_name AS t, p_size * 18.0 AS x, fmod(p_retailprice, 900) AS y FROM part), b AS (SELECT *, x + length(t) * 6 AS x2, y + 12 AS y2 FROM i)
        SELECT idx, round((x + x2) / 2 / 1000, 9) AS cx, round((y + y2) / 2 / 1000, 9) AS cy, round(greatest(x2 - x, 1) / 1000, 9) AS w, round(greatest(y2 - y, 1) / 1000, 9) AS h FROM b
        WHERE trim(t) <> '' AND NOT (length(regexp_replace(t, '[^0-9]', '', 'g')) >= 10 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) = 0)"""),
    "captions_found": (captions_found, None),
    "annotation_outcomes": (annotation_outcomes, None),
    "position_differences": (position_differences, None),
    "reason_settled": (reason_settled, "SELECT event_id, CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'discard' ELSE 'keep' END AS decision FROM events"),
}
