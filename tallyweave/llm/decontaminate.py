"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items build one automaton, each item starting at its root. A
document's words are streamed through it; after each word the automaton knows the longest
suffix of what was read that some item holds. Where that length reaches a window, the window's
words are hit, and the state tells the items that hold it.

An automaton holds about ``BLOCK_WORDS`` words of items. More items than that are dealt into several
blocks by a hash, each with its own automaton and its own pass over the documents; all passes write to one table, and the hits of a document are
united by one aggregation. Workers read the items of a block from the shared folder; none pass through the driver.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, ASCII capitals made
small. Bytes above 0x7f only stand in such characters, so UTF-8 can be cut as bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

WINDOW = 10
#: Words of items in one automaton (about 1 KB of memory each).
BLOCK_WORDS = 200_000
#: Word bytes as they are, capitals made small, all others blank.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, in order."""
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over words; states are numbers, 0 the root."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.nxt: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        #: Items that hold a state's words, for the states that stand for whole windows.
        self.items: list[str] = []
        own: list[set[int]] = [set()]
        whole: dict[int, set[int]] = {}
        for item, words in items:
            if not words:
                continue
            k = len(self.items)
            self.items.append(item)
            last = 0
            for w in words:
                last = self._extend(last, w, own)
            v = 0
            for w in words:
                v = self.nxt[v][w]
                own[v].add(k)
            if len(words) < window:
                whole.setdefault(last, set()).add(k)
        # a state's items are those of the prefixes that it is a suffix of: sent up the links, longest first
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            p = self.link[v]
            if self.len[p] >= window:
                own[p] |= own[v]
        #: For each state: the state on its link path that holds the last ``window`` words, or -1.
        self.at_window = [-1] * len(self.len)
        #: For each state: (length, items) of the short items on its link path.
        self.short: list[tuple[tuple[int, frozenset[int]], ...]] = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=lambda v: self.len[v]):
            p = self.link[v]
            if self.len[v] >= window:
                self.at_window[v] = v if self.len[p] < window else self.at_window[p]
            self.short[v] = self.short[p] + (((self.len[v], frozenset(whole[v])),) if v in whole else ())
        used = set(self.at_window)
        self.own = [frozenset(o) if v in used else frozenset() for v, o in enumerate(own)]
        #: No window is shorter.
        self.least = min([window] * any(v >= 0 for v in self.at_window) + [self.len[v] for v in whole], default=window)

    def _new(self, length: int, own: list[set[int]]) -> int:
        self.nxt.append({})
        self.link.append(0)
        self.len.append(length)
        own.append(set())
        return len(self.len) - 1

    def _clone(self, p: int, w: bytes, q: int, own: list[set[int]]) -> int:
        c = self._new(self.len[p] + 1, own)
        self.nxt[c] = dict(self.nxt[q])
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.nxt[p].get(w) == q:
            self.nxt[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: bytes, own: list[set[int]]) -> int:
        """The state of the item's words so far and w."""
        q = self.nxt[last].get(w)
        if q is not None:  # an item before has these words
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q, own)
        cur, p = self._new(self.len[last] + 1, own), last
        while p >= 0 and w not in self.nxt[p]:
            self.nxt[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.nxt[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q, own)
        return cur

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words ([start, end), apart and in order) and the items with occurring windows."""
        nxt, link, length = self.nxt, self.link, self.len
        window, least, at_window, short = self.window, self.least, self.at_window, self.short
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        state = n = 0
        for i, w in enumerate(words):
            t = nxt[state].get(w)
            if t is None:
                if not state:
                    continue
                while state and t is None:
                    state = link[state]
                    t = nxt[state].get(w)
                if t is None:
                    state = n = 0
                    continue
                n = length[state]
            state = t
            n += 1
            if n < least:
                continue
            reach = 0
            if n >= window:
                reach = window
                v = at_window[state]
                if v not in seen:
                    seen.add(v)
                    found |= self.own[v]
            for m, items in short[state]:
                if m <= n:
                    reach = max(reach, m)
                    found |= items
            if reach:
                a = i + 1 - reach
                if spans and a <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], a), i + 1)
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        b = spans.pop()
                        spans[-1] = (min(spans[-1][0], b[0]), b[1])
                else:
                    spans.append((a, i + 1))
        return spans, {self.items[k] for k in found}


_built: dict[tuple[str, int], Automaton] = {}
shared.holds("decontaminate", _built.clear)


def _automaton(path: str, window: int) -> Automaton:
    """The automaton of a block's items, built once in each worker; a worker holds one at a time."""
    shared.claim("decontaminate")
    if (path, window) not in _built:
        _built.clear()
        files, at = shared.local_fs(path)
        rows = pq.read_table(at, columns=["i", "t"], filesystem=files, partitioning=None).to_pylist()
        _built[path, window] = Automaton(sorted((r["i"], words_of(r["t"])) for r in rows), window)
    return _built[path, window]


def blocks_of(benchmark: DataFrame, id_col: str, text: str, block_words: int) -> list[str]:
    """Folders of the items of each block (i, t). Blocks have about block_words words; a longer item makes its block longer."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    rows = shared.written(rows, "decon-items")
    words = rows.agg(F.sum(F.size(F.split("t", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0  # at most two too many for each item
    n = -(-words // block_words) or 1
    path = shared.fresh_path(benchmark.sparkSession, "decon-blocks")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    dealt.repartition(n, "block").write.partitionBy("block").parquet(path)
    return [f"{path}/block={r['block']}" for r in dealt.select("block").distinct().orderBy("block").collect()]


HITS = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>,cut:string>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _hits(block: str | None, text: Column, window: int, cut: bool = False) -> Column:
    """n_words, spans (of words) and items of each text against one block, or none; if ``cut``, the text without the spans, where there are any.

    All in one pass, and marked as not to be repeated: else a filter on the spans has the texts read once more, and each function that follows
    another has two more workers an executor, which stay for the stages after.
    """

    @F.arrow_udf(HITS)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = _automaton(block, window) if block else Automaton([], window)
        for batch in texts:
            counts, starts, ends, items, ends_at, left = [], [], [], [], [0], []
            for t in batch.to_pylist():
                words = words_of(t)
                spans, found = auto.hits(words)
                counts.append(len(words))
                starts += [x for x, _ in spans]
                ends += [x for _, x in spans]
                ends_at.append(len(starts))
                items.append(sorted(found))
                left.append(without(t, spans) if cut and spans else None)
            flat = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(_SPAN))
            lists = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), flat)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), lists, pa.array(items, pa.list_(pa.string())), pa.array(left, pa.string())], ["n_words", "spans", "items", "cut"])

    return run.asNondeterministic()(text)


def find_hits(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of docs: the columns ``keep``, n_words, spans (hit spans of words, apart, in order) and items (ids as text, sorted).

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a word inside
    any occurrence of a window is hit. Null and empty texts have no words; items without words
    have no window. Items that repeat an id count as one item with the windows of both; documents
    that repeat are each judged. No items: no hits; no documents: no rows. Columns of ``keep`` that are called n_words,
    spans or items give way. Nothing is shuffled while the items fit one automaton.
    """
    return _found(docs, benchmark, keep, text, item_id, item_text, window, block_words)


def _found(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], text: str, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """find_hits; if ``cut``, also cut_text: the text without its spans, null where it has none."""
    spark = docs.sparkSession
    shared.arrow_batches(spark)
    own = {c: f"k{i}" for i, c in enumerate(c for c in keep if c not in ("n_words", "spans", "items"))}  # the caller's columns under names of ours until the end
    named = docs.select(*[F.col(c).alias(n) for c, n in own.items()], F.col(text).alias("_text"))
    back = lambda df: df.select(*[F.col(n).alias(c) for c, n in own.items()], "n_words", "spans", "items", *[F.col("cut").alias("cut_text")] * cut)
    blocks = blocks_of(benchmark, item_id, item_text, block_words)
    flat = ["_h.n_words", "_h.spans", "_h.items"]
    if len(blocks) < 2:
        return back(named.select("*", _hits(blocks[0] if blocks else None, F.col("_text"), window, cut).alias("_h")).select(*own.values(), *flat, "_h.cut"))
    rows = shared.written(named.withColumn("_rid", F.monotonically_increasing_id()), "decon-docs")
    at = shared.fresh_path(spark, "decon-passes")
    for place, block in enumerate(blocks):
        one = rows.select("_rid", _hits(block, F.col("_text"), window).alias("_h")).select("_rid", *flat)
        one.filter((F.size("spans") > 0) | F.lit(place == 0)).write.mode("append").parquet(at)
    found = spark.read.parquet(at)
    items = found.groupBy("_rid").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = (rows if cut else rows.drop("_text")).join(items, "_rid").join(_united(found.select("_rid", F.explode("spans").alias("s"))), "_rid", "left")
    if cut:
        out = out.withColumn("cut", _cut(F.when(F.col("spans").isNotNull(), F.col("_text")), F.col("spans")))
    return back(out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))))


def _united(spans: DataFrame) -> DataFrame:
    """(_rid, spans) of rows (_rid, s): spans that touch are one."""
    order = W.partitionBy("_rid").orderBy("s.start", "s.end")
    reach = F.max("s.end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce(F.col("s.start") > reach, F.lit(True)).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = marked.groupBy("_rid", "_run").agg(F.struct(F.min("s.start").alias("start"), F.max("s.end").alias("end")).alias("s"))
    return runs.groupBy("_rid").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_coverage: float = 0.8, window: int = WINDOW, n_chars: str | None = "n_chars", **columns: str) -> DataFrame:
    """docs without what they share with the benchmark.

    Hit spans (each at least a window long) are cut out of the text, each leaving one blank; a document of which more than ``max_coverage`` of the words are hit
    goes. All other rows and columns stay as they are, ``n_chars`` following the text where there is
    such a column. Null texts stay null; rows that repeat are each judged; no items change nothing; an empty table gives an empty one.
    """
    keep = tuple(docs.columns)
    own = {c: f"c{i}" for i, c in enumerate(keep)}  # the caller's columns under names of ours until the end
    renamed = docs.select(*[F.col(c).alias(n) for c, n in own.items()])
    found = _found(renamed, benchmark, tuple(own.values()), own[text], window=window, cut=True, **columns)
    total = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    found = found.filter(~((F.size("spans") > 0) & (total > F.col("n_words") * F.lit(max_coverage))))
    t = own[text]
    out = found.withColumn(t, F.coalesce("cut_text", F.col(t)))
    if n_chars and n_chars in own:
        n = own[n_chars]
        out = out.withColumn(n, F.when(F.col("cut_text").isNotNull(), F.length("cut_text").cast(docs.schema[n_chars].dataType)).otherwise(F.col(n)))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()])


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the spans of words; null where the text is null."""
    return pa.array([None if t is None else without(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())


def without(text: str, spans: list[tuple[int, int]]) -> str:
    places = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for start, end in spans:
        out.append(text[last : places[start][0]].rstrip())
        last = places[end - 1][1]
    return " ".join(x for x in [*out, text[last:].lstrip()] if x)
