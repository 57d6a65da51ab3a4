"""Template and target assets: grouping by code, pairing, and what is left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions import text


def with_codes(assets: DataFrame, least: int = 6) -> DataFrame:
    """Assets (column stem) with their code, null where they have none."""
    return assets.withColumn("code", text.code_of(F.col("stem"), least))


def split_by_code(assets: DataFrame, least: int = 6) -> tuple[DataFrame, DataFrame]:
    """(assets with a code, assets without)."""
    coded = with_codes(assets, least)
    return coded.filter("code IS NOT NULL"), coded.filter("code IS NULL")


def listed_by_code(assets: DataFrame) -> DataFrame:
    """One row for each code: its assets in order, the plain one first."""
    order = F.struct((F.col("stem") != F.col("code")).alias("variant"), "stem", "path")
    return assets.groupBy("code").agg(F.array_sort(F.collect_list(order)).alias("assets"), F.count(F.lit(1)).alias("n"))


def template_rank(stem: Column, code: Column, suffix: Column) -> Column:
    """(how plain the variant is, PDF first, stem): the least is preferred."""
    starts = lambda mark: F.startswith(stem, F.concat(code, F.lit(mark)))
    kind = F.when(stem == code, 0).when(starts("-"), 1).when(starts("_"), 2).otherwise(3)
    return F.struct(kind.alias("kind"), F.when(F.lower(suffix) == ".pdf", 0).otherwise(1).alias("other"), stem.alias("stem"))


def preferred(templates: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group: the engine keeps one row per group and task before it shuffles."""
    return templates.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_n = 1").drop("_n")


def catalogue(files: DataFrame, suffixes: tuple[str, ...] = (".pdf", ".png", ".jpg", ".jpeg")) -> DataFrame:
    """The templates among files (path, stem, suffix) that have a code: variant (null for the plain one), kind, and whether each is its code's default. In order of code, the default first."""
    some = with_codes(files.filter(F.lower("suffix").isin(*suffixes))).filter("code IS NOT NULL")
    out = some.select(
        "code",
        F.nullif(text.variant_of(F.col("stem"), F.col("code")), F.lit("")).alias("variant"),
        F.when(F.lower("suffix") == ".pdf", "pdf").otherwise("image").alias("source_type"),
        (F.col("stem") == F.col("code")).alias("is_default"),
        "stem",
        "path",
    )
    return out.orderBy("code", F.col("is_default").desc(), F.coalesce("variant", F.lit("")), "source_type", "stem")


def find_by_code(templates: DataFrame, code: str) -> DataFrame:
    """Templates of a code as it was typed or scanned; none for a blank one."""
    wanted = code.strip()
    return templates.filter(F.col("code") == wanted) if wanted else templates.limit(0)


def pair(templates: DataFrame, targets: DataFrame, key: str, only: list[str] | None = None) -> DataFrame:
    """All pairs of one key: columns of both, the key once."""
    if only:
        templates, targets = templates.filter(F.col(key).isin(only)), targets.filter(F.col(key).isin(only))
    return templates.join(targets, key)


def cases(templates: DataFrame, targets: DataFrame, best: bool = False, only: list[str] | None = None) -> DataFrame:
    """The cases of two asset tables (code, stem, suffix, path): all pairs of a code, or its preferred template with each target."""
    if best:
        templates = preferred(templates, ["code"], [template_rank(F.col("stem"), F.col("code"), F.col("suffix"))])
    side = lambda df, name: df.select("code", *[F.col(c).alias(f"{name}_{c}") for c in ("stem", "suffix", "path")])
    both = pair(side(templates, "template"), side(targets, "target"), "code", only)
    return both.withColumn("case_id", text.case_id(F.col("template_stem"), F.col("target_stem")))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys on one side only, with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def shared(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def pending(plan: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows without a finished result of the same key."""
    return plan.join(done, key, "left_anti")


def first_existing(wanted: DataFrame, listing: DataFrame, key: list[str], candidates: str, path: str = "path") -> DataFrame:
    """key and the first of the candidate paths (an array, best first) that the listing has; null where it has none."""
    each = wanted.select(*key, F.posexplode_outer(candidates).alias("place", path))
    there = each.join(listing.select(path).distinct(), path, "left_semi").groupBy(*key).agg(F.min_by(path, "place").alias(path))
    return wanted.select(*key).join(there, key, "left")


def run_stats(templates: DataFrame, targets: DataFrame, runs: DataFrame, key: str = "code") -> DataFrame:
    """One row of counts: files, keys, shared keys, cases, and their outcomes (columns success, skipped)."""
    t = templates.agg(F.count(F.lit(1)).alias("template_files"), F.countDistinct(key).alias("template_codes"))
    g = targets.agg(F.count(F.lit(1)).alias("target_files"), F.countDistinct(key).alias("target_codes"))
    both = shared(templates, targets, key).agg(F.count(F.lit(1)).alias("matched_codes"))
    done = runs.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("success")).alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.count_if(F.col("skipped")).alias("skipped"))
    return t.join(F.broadcast(g)).join(F.broadcast(both)).join(F.broadcast(done))  # one row each
