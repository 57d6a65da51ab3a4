"""Near-duplicate groups by SimHash, with an inverted index over byte positions and count filtering.

A fingerprint is 8 bytes at 8 positions. Each differing bit spoils one byte at most, so two
fingerprints within k bits share at least 8 - k positional bytes: the guaranteed matches. Posting
lists of single bytes hold N/256 fingerprints each, and tallying all their pairs would grow with the
square of N. So the positions stand in k + 2 groups, of which at least two are whole in any such pair, and a
posting is keyed by the bytes of two groups (for k = 2: four bytes, 6 postings a fingerprint). In a list the
shared positional bytes of each pair are tallied, pairs that reach 8 - k of them are retained, and their differing bits verified.

Only distinct fingerprints are indexed, so exact copies cost nothing. Two members of a list are a pair and are
tallied in SQL; up to ``PAIRED`` are tallied inside a worker, which links each to the least of its component, so that no
list emits more rows than it has members. The members of longer lists are posted once more, by every choice of
8 - k positions: in such a list every pair has the guaranteed matches, k bytes are open, and at most 256**k fingerprints meet. There large lists
are probed with every mask of up to k bits instead of being paired. Components of links come from star
contraction over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Lists up to this length are compared pair by pair.
PAIRED = 128
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, ASCII capitals made small."""
    return (text or "").encode().lower().split()


def hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words (of all words, if fewer), repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    starts = starts.tolist()
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[shingle:])], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The bits that are set in over half of the hashes; 0 where there is none."""
    h = hashes(words_of(text), shingle)
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each text as a long."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64).astype(np.int64))

    return run(text)


def _masks(max_bits: int) -> list[int]:
    """For each choice of 8 - max_bits positions, the bits of their bytes, as signed longs."""
    full = [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), 8 - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in full]


def shared_bytes(x: Column) -> Column:
    """How many positional bytes two fingerprints share, of their exclusive or."""
    return sum((F.shiftrightunsigned(x, 8 * p).bitwiseAND(0xFF) == 0).cast("int") for p in range(8))


def _wide_masks(max_bits: int) -> list[int]:
    """As ``_masks``, for each choice of two of max_bits + 2 groups of positions."""
    groups = [sum(0xFF << (8 * int(p)) for p in g) for g in np.array_split(np.arange(8), max_bits + 2)]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(groups, 2))]


def tally(members: np.ndarray) -> np.ndarray:
    """How many positional bytes each two of the members (uint64) share."""
    own = members.astype("<u8").view(np.uint8).reshape(-1, 8)
    return sum((own[:, None, p] == own[None, :, p]).astype(np.uint8) for p in range(8))


def linked(members: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of the sorted distinct members (uint64) the least of its component under links of at most max_bits differing bits."""
    n = len(members)
    if n <= PAIRED:
        u, v = np.nonzero(np.triu(tally(members) >= 8 - max_bits, 1))
        near = np.bitwise_count(members[u] ^ members[v]) <= max_bits
        u, v = u[near], v[near]
    else:
        spread = np.bitwise_or.reduce(members ^ members[0])
        bits = [1 << i for i in range(64) if int(spread) >> i & 1]
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, max_bits + 1):
            for chosen in combinations(bits, k):
                other = members ^ np.uint64(sum(chosen))
                at = np.minimum(np.searchsorted(members, other), n - 1)
                here = np.nonzero((members[at] == other) & (members < other))[0]
                ends.append((here, at[here]))
        u, v = (np.concatenate([e[i] for e in ends]) if ends else np.zeros(0, np.int64) for i in (0, 1))
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, u, label[v])
        np.minimum.at(least, v, label[u])
        least = least[least]
        if (least == label).all():
            return members[label]
        label = least


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) links with v < u between the distinct fingerprints (column fp): as many as give the same components as all pairs within max_bits."""
    if not 1 <= max_bits <= 3:
        raise ValueError("max_bits must be 1, 2 or 3: a posting holds up to 256**max_bits fingerprints")
    posted, lists = _posted(prints.select("fp"), _wide_masks(max_bits))
    found = _tallied(posted, lists.filter(F.col("n") <= PAIRED), max_bits)
    long = posted.join(lists.filter(F.col("n") > PAIRED).select("c", "key"), ["c", "key"], "left_semi").select("fp").distinct()
    posted, lists = _posted(shared.written(long, "simhash-long"), _masks(max_bits))
    return found.unionByName(_tallied(posted, lists, max_bits)).distinct()


def _posted(prints: DataFrame, masks: list[int]) -> tuple[DataFrame, DataFrame]:
    """(postings (fp, c, key), lists (c, key, n, a, b) of several members, written)."""
    posted = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "key"))
    lists = posted.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    return posted, shared.written(lists, "simhash-lists")


def _tallied(posted: DataFrame, lists: DataFrame, max_bits: int) -> DataFrame:
    """(u, v) links that span what the members of each list are linked to."""
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = lists.filter("n = 2").filter((shared_bytes(x) >= 8 - max_bits) & (F.bit_count(x) <= max_bits))
    pairs = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    longer = posted.join(lists.filter("n > 2").select("c", "key"), ["c", "key"], "left_semi")
    longer = longer.groupBy("c", "key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for fps in b.column("fps"):
                members = np.sort(fps.values.to_numpy().astype(np.uint64))
                low = linked(members, max_bits)
                moved = members != low
                out.append(np.stack([members[moved], low[moved]]))
            both = np.concatenate(out, axis=1).astype(np.int64) if out else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both.max(0)), pa.array(both.min(0))], ["u", "v"])

    return pairs.unionByName(longer.mapInArrow(run, "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the least node of its component.

    Alternating large and small stars: in each half round all neighbours of a node are linked to
    its least neighbour. Minima are aggregated before they are joined back, from a written table, so
    that the engine can split the rows of a node with very many neighbours.
    """
    edges = shared.written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shared.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "components-least")
        large = both.filter("v > u").join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared.written(large, "components-large")
        least = shared.written(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        moved = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = shared.written(small, "components")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def classes(prints: DataFrame, first: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, class) for distinct fingerprints: class is the least ``first`` of the component's fingerprints."""
    prints = shared.written(prints.select("fp", F.col(first).alias("first")), "simhash-prints")
    return grouped(prints, links(prints, max_bits), "first")


def grouped(prints: DataFrame, edges: DataFrame, first: str) -> DataFrame:
    """(fp, class) as ``classes`` gives it, of links that are known; prints is a written table."""
    prints = prints.select("fp", F.col(first).alias("first"))
    of = components(edges)
    seen = of.withColumnRenamed("node", "fp").unionByName(of.select(F.col("root").alias("fp"), "root").distinct())
    seen = shared.written(seen.join(prints, "fp"), "simhash-seen")
    low = shared.written(seen.groupBy("root").agg(F.min("first").alias("class")), "simhash-least")
    moved = seen.join(low, "root").select("fp", "class")
    out = prints.join(moved, "fp", "left").select("fp", F.coalesce("class", "first").alias("class"))
    return shared.written(out, "simhash-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fp, component_id) for each row of docs: component_id is the least id that links reach.

    Rows whose fingerprints differ in at most max_bits bits are linked. Texts without words, null
    ones too, have fingerprint zero and are linked like any other. Rows that repeat are each
    returned. A null id is returned as it is and never is a component's id; a component of null
    ids has none. An empty table gives an empty one. Texts are read whole and do not leave their
    task: what is shuffled is 8-byte fingerprints.
    """
    shared.arrow_batches(docs.sparkSession)
    rows = shared.written(docs.select(F.col(id_col), fingerprints(F.col(text), shingle).alias("fp")), "simhash-rows")
    of = classes(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "first", max_bits)
    return rows.join(of, "fp").select(id_col, "fp", F.col("class").alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near duplicates: the one of the least id (nulls last). All columns stay.

    Rows of one id and one text count as one, whichever is kept; of different texts of the least id
    one is kept by a hash. What is shuffled of the texts is one exchange for the last join, by a key that is all but unique.
    """
    shared.arrow_batches(docs.sparkSession)
    names = docs.columns
    k1, k2, n = (shared.free_name(names, c) for c in ("key1", "key2", "place"))
    key = [F.xxhash64(F.lit(i), F.col(id_col).isNull(), F.col(id_col), F.col(text)).alias(c) for i, c in ((1, k1), (2, k2))]
    rows = shared.written(docs.select(F.col(id_col).alias("id"), key[0].alias("k1"), key[1].alias("k2"), fingerprints(F.col(text), shingle).alias("fp")), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2"))
    of = classes(rows.groupBy("fp").agg(first.alias("first")), "first", max_bits)
    kept = shared.written(of.select(F.col("class.k1").alias(k1), F.col("class.k2").alias(k2)).distinct(), "simhash-kept")
    out = docs.select("*", *key).join(kept.hint("merge"), [k1, k2], "left_semi")  # alike at every size
    one = F.row_number().over(W.partitionBy(k1, k2).orderBy(k1))  # rows that repeat id and text
    return out.withColumn(n, one).filter(F.col(n) == 1).select(*names)


def hex_print(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
