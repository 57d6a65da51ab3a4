"""Secret scans with corpus-wide ownership frequency, in SQL functions alone.

1. Every text is cut by each pattern. ``split`` gives what lies between the matches and
   ``regexp_extract_all`` the matches; each match becomes a row, and running sums of their lengths, over the
   matches of one text, give the places. All of it takes time in proportion to the matches.
2. The candidates' values are named by SHA-256 and counted by distinct repository and owner over
   the whole corpus. A value that more than ``max_owners`` owners or more than ``max_repos`` repositories hold is a copied
   example; any other looks live.
3. Beyond the base kinds, long mixed tokens are candidates too (kind ``owned``). Only the
   frequency tells them from identifiers, so they become spans only where they look live.

Places are code points; ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

# The base patterns and the shortest value of each kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN, ACCESS_MIN = 6, 20
#: A mixed token: 20 characters or more with a digit, a capital and a small letter among them.
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[a-z+/_=-]*[A-Z0-9])[A-Za-z0-9+/_=-]{20,}"
#: The order of kinds among spans that begin at one place.
KINDS = ("assign", "access", "hex", "owned")
#: Owners, and repositories, that may hold a value that still looks live.
MAX_OWNERS, MAX_REPOS = 2, 4

MATCH = "struct<rank:int,n:int,gap:int,hit:string>"
SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"


def _matches(text: Column, pattern: str, rank: int) -> Column:
    """array<MATCH> of the leftmost non-overlapping matches in order, each with the length of what stands between it and the one before."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(gaps, F.lit(1), F.size(hits)), F.length)
    one = lambda gap, hit: F.struct(F.lit(rank).alias("rank"), F.length(hit).alias("n"), gap.alias("gap"), hit.alias("hit"))
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), F.zip_with(gaps, hits, one)).otherwise(F.array().cast(f"array<{MATCH}>"))


def matches(text: Column) -> Column:
    """array<MATCH> of all kinds."""
    return F.concat(*[_matches(text, p, rank) for rank, p in enumerate((ASSIGN, ACCESS, HEX, OWNED))])


def spans_of(found: DataFrame, by: list[str]) -> DataFrame:
    """A row (*by, s: SPAN) for each span of rows (*by, _matches); ``by`` begins with a key of the row. Failing matches, and mixed tokens that touch a base span, are left out."""
    row = by[0]
    each = found.select(*by, F.posexplode("_matches").alias("_at", "m"))
    m = F.col("m")
    end = F.sum(m["gap"] + m["n"]).over(W.partitionBy(row, m["rank"]).orderBy("_at")).cast("int")
    value = F.when(m["rank"] == 0, F.regexp_extract(m["hit"], ASSIGN, 2)).otherwise(m["hit"])
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), m["rank"] + 1)
    span = F.struct((end - m["n"]).alias("start"), m["rank"].alias("rank"), kind.alias("kind"), end.alias("end"), value.alias("value"))
    each = each.select(*by, span.alias("s"))
    s = F.col("s")
    mixed = s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]") & s["value"].rlike("[0-9]")
    good = F.when(s["rank"] == 0, F.length(s["value"]) >= ASSIGN_MIN).when(s["rank"] == 1, s["end"] - s["start"] >= ACCESS_MIN).when(s["rank"] == 3, mixed).otherwise(True)
    each = each.filter(good)
    base, order = s["rank"] != 3, W.partitionBy(row).orderBy("s.start", "s.rank")
    before = F.max(F.when(base, s["end"])).over(order.rowsBetween(W.unboundedPreceding, -1))
    after = F.min(F.when(base, s["start"])).over(W.partitionBy(row).orderBy(F.desc("s.start"), F.desc("s.rank")).rowsBetween(W.unboundedPreceding, -1))
    touches = F.coalesce(before > s["start"], F.lit(False)) | F.coalesce(after < s["end"], F.lit(False))
    return each.withColumn("_touches", touches).filter(base | ~F.col("_touches")).drop("_touches")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined; an empty text where there is none."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def ownership(spans: DataFrame) -> DataFrame:
    """(digest, n_docs, n_repos, n_owners) of (digest, repo, owner, rid) rows.

    Sums go up level by level, each with map-side combining, so a value that a third of all
    documents holds arrives as one row from each task.
    """
    # equal (digest, repo, owner) rows first, then distinct counts on what is left
    docs = spans.groupBy("digest", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    owners = docs.groupBy("digest", "owner").agg(F.sum("n").alias("n"))
    repos = docs.groupBy("digest", "repo").agg(F.lit(1).alias("one"))
    a = owners.groupBy("digest").agg(F.sum("n").alias("n_uses"), F.count(F.lit(1)).alias("n_owners"))
    b = repos.groupBy("digest").agg(F.count(F.lit(1)).alias("n_repos"))
    return a.join(b, "digest")


def scan(docs: DataFrame, repo: Column, owner: Column, text: str = "text", max_owners: int = MAX_OWNERS, keep: tuple[str, ...] = (), max_repos: int = MAX_REPOS) -> DataFrame:
    """One row for each row of docs: the columns ``keep``, ``spans_base`` (SPAN array in order), ``spans`` (base and owned ones),
    ``live`` (one boolean for each of ``spans``: at most ``max_owners`` distinct owners and ``max_repos`` distinct repositories
    hold its value), ``owners`` and ``repos`` (how many do), and ``before`` (the greatest end of the spans before each, or 0).

    Null texts are empty and have no spans. Null repositories and owners count as one nameless
    each. Repeated rows are each scanned, and count as one repository and owner. Values are equal
    where their text is. Columns of ``keep`` that have the names of the new ones give way. An empty table gives an empty one. Texts of any length are scanned whole.
    Only spans leave the scan: the text is not shuffled, unless it is kept.
    """
    new = ("spans_base", "spans", "live", "owners", "repos", "before")
    own = {c: f"k{i}" for i, c in enumerate(c for c in keep if c not in new)}  # the caller's columns under names of ours until the end
    side = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    found = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.monotonically_increasing_id().alias("_rid"), side(repo).alias("repo"), side(owner).alias("owner"), matches(F.coalesce(F.col(text), F.lit(""))).alias("_matches"))
    found = shared.written(found, "secret-matches")
    each = shared.written(spans_of(found, ["_rid", "repo", "owner"]).withColumn("digest", F.unhex(F.sha2(F.col("s.value"), 256))), "secret-spans")
    freq = shared.written(ownership(each.select("digest", "repo", "owner")), "secret-owners")  # a plain table: the engine can split a hot digest
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    judged = each.join(freq, "digest").select("_rid", "s", live.alias("live"), "n_owners", "n_repos")
    judged = judged.filter((F.col("s.kind") != "owned") | F.col("live"))
    order = W.partitionBy("_rid").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    judged = judged.withColumn("before", F.coalesce(F.max("s.end").over(order), F.lit(0)))
    per = judged.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("s", "live", "n_owners", "n_repos", "before"))).alias("_judged"))
    empty = F.array().cast(per.schema["_judged"].dataType)
    some = F.size("_matches") > 0  # the others have nothing to be joined
    rows = found.select(*own.values(), "_rid", "_matches")
    out = rows.filter(some).join(per, "_rid", "left").unionByName(rows.filter(~some).withColumn("_judged", empty))
    out = out.withColumn("_judged", F.coalesce("_judged", empty))
    part = lambda name: F.transform("_judged", lambda j: j[name])
    return out.select(
        *[F.col(n).alias(c) for c, n in own.items()],
        F.transform(F.filter("_judged", lambda j: j["s"]["kind"] != "owned"), lambda j: j["s"]).alias("spans_base"),
        *[part(name).alias(c) for c, name in (("spans", "s"), ("live", "live"), ("owners", "n_owners"), ("repos", "n_repos"), ("before", "before"))],
    )


def redact(docs: DataFrame, repo: Column, owner: Column, text: str = "text", max_owners: int = MAX_OWNERS, n_chars: str | None = "n_chars", max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with every span replaced: ``<SECRET:kind>`` where the value looks live, ``<EXAMPLE:kind>`` where it is widely copied.

    Spans that overlap become one, named by its first. Columns and rows stay; ``n_chars``, where
    there is such a column, follows the new text. A text without spans stays as it is, null too. An empty table gives an empty one.
    """
    keep = tuple(docs.columns)
    own = {c: f"c{i}" for i, c in enumerate(keep)}  # the caller's columns under names of ours until the end
    named = docs.select(*[F.col(c).alias(n) for c, n in own.items()], repo.cast("string").alias("repo_of"), owner.cast("string").alias("owner_of"))
    out = scan(named, F.col("repo_of"), F.col("owner_of"), own[text], max_owners, tuple(own.values()), max_repos)
    t, some = F.col(own[text]), F.size("spans") > 0
    cuts = F.filter(F.arrays_zip("spans", "live", "before"), lambda p: p["spans"]["start"] >= p["before"])
    tag = lambda p: F.concat(F.when(p["live"], F.lit("<SECRET:")).otherwise(F.lit("<EXAMPLE:")), p["spans"]["kind"], F.lit(">"))

    def redacted(wide: Column) -> Column:
        """wide: the text with four bytes to a code point, where a part is found without reading what stands before it."""
        part = lambda a, n: F.decode(F.substring(wide, a * 4 + 1, n * 4), "UTF-32")
        pieces = F.transform(cuts, lambda p: F.concat(part(p["before"], p["spans"]["start"] - p["before"]), tag(p)))
        return F.concat(F.array_join(pieces, ""), part(F.array_max(F.transform("spans", lambda s: s["end"])), F.length(t)))

    cut = F.get(F.transform(F.array(F.encode(t, "UTF-32")), redacted), F.lit(0))  # encoded once, as the element of an array
    out = out.withColumn(own[text], F.when(some, cut).otherwise(t))
    if n_chars and n_chars in own:
        n = own[n_chars]
        out = out.withColumn(n, F.when(some, F.length(own[text]).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n)))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])
