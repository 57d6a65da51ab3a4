"""Near copies by wide fingerprints: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The method is that of ``simhash``: a byte-position inverted index, a tally of shared positional bytes, a count filter, and a verification.
SimHash bits can't carry it to 0.8: sets of that similarity differ in 15 of 100 bits, so they share a positional byte with probability 0.27 only.
Here a fingerprint has ``ROWS`` * ``BANDS`` bytes, each of the least of the set's shingles under a hash function of its position, and two sets of similarity s share
a byte with probability s + (1 - s) / 256.

1. Texts of equal sets are one node, so exact copies cost nothing. A posting is keyed by a run of ``ROWS`` positions and their bytes.
   Two sets of similarity 0.8 meet in one of the ``BANDS`` lists but for 3 pairs of a million. Lists of the same members are one.
2. In a list the shared bytes of each pair that is not yet linked are tallied, and pairs that share ``LEAST_BYTES`` are retained: at 0.8, 128 of 160 are
   expected with a deviation of 5, so that fewer than one pair in 10**8 is missed.
3. Retained pairs are verified: the whole sets are compared, and only pairs that reach 0.8 are links.

A list is worked on in one task, whole sets beside it, up to ``CELL_BYTES`` of shingle bits; a longer one is cut into blocks by a hash, and each two blocks are a task of their own, so
no pair of a list is left out, no list is gathered whole, and a task emits no more links than it has members. Groups are the components of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, simhash

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
ROWS, BANDS = 5, 32
#: Positional bytes that retained pairs share, of ROWS * BANDS.
LEAST_BYTES = 96
#: Bytes of the table (members x shingles, in bits) that a task may hold for a list or a pair of its blocks.
CELL_BYTES = 16 << 20
#: Members that are compared with one at once.
SIDE = 128
#: Shingles that are hashed by all functions at once.
CHUNK = 1 << 11

_rng = np.random.default_rng(42)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FLIP = _rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text: hashes of its runs of five words (of all words, if fewer), sorted."""
    return np.unique(simhash.hashes(simhash.words_of(text), SHINGLE))


def fingerprint(h: np.ndarray) -> bytes:
    """The positional bytes of a set; none of an empty one."""
    if not len(h):
        return b""
    least = np.full(len(_MUL), np.uint64(2**64 - 1))
    for at in range(0, len(h), CHUNK):
        np.minimum(least, ((h[at : at + CHUNK, None] ^ _FLIP) * _MUL).min(axis=0), out=least)
    return ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def keys(wide: bytes) -> list[int]:
    """The keys of a fingerprint: the number of each run of positions above its bytes."""
    return [int.from_bytes(wide[at : at + ROWS]) | (at // ROWS) << (8 * ROWS) for at in range(0, len(wide), ROWS)]


def reach(both, a, b):
    """Whether sets of a and b members that share ``both`` have the least similarity."""
    top, bottom = LEAST
    return bottom * both >= top * (a + b - both)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the least similarity."""
    return bool(reach(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))


@F.arrow_udf(T.StructType([T.StructField("fp", T.LongType()), T.StructField("wide", T.BinaryType())]))
def _nodes(texts: pa.Array) -> pa.Array:
    shared.claim("near_copies")
    sets = [shingles(t) for t in texts.to_pylist()]
    fp = np.array([xxhash.xxh64_intdigest(s.astype("<u8").tobytes()) for s in sets], np.uint64).astype(np.int64)
    return pa.StructArray.from_arrays([pa.array(fp), pa.array([fingerprint(s) for s in sets], pa.binary())], ["fp", "wide"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def _keys(wide: pa.Array) -> pa.Array:
    return pa.array([keys(w) for w in wide.to_pylist()], pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def _sets(texts: pa.Array) -> pa.Array:
    shared.claim("near_copies")
    return pa.array([shingles(t).astype("<u8").tobytes() for t in texts.to_pylist()], pa.binary())


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, of the shingles that several of them hold."""
    flat = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, n = np.unique(flat, return_inverse=True, return_counts=True)
    several = n > 1
    column = np.cumsum(several) - 1
    some = several[place]
    width = -(-int(several.sum()) // 64)
    out = np.zeros((len(sets), width * 8), np.uint8)
    at = column[place[some]]
    np.bitwise_or.at(out, (of[some], at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
    return out.view("<u8")


def link_members(wide: list[bytes], sets: list[np.ndarray], block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (places of members) that span what alike members are linked to; with blocks, only members of different blocks are compared."""
    n = len(sets)
    byte = np.frombuffer(b"".join(wide), np.uint8).reshape(n, -1)
    size, bits = np.array([len(s) for s in sets]), _bits(sets)
    label, out = np.arange(n), []
    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        rest = rest[label[rest] != label[i]]
        if block is not None:
            rest = rest[block[rest] != block[i]]
        rest = rest[(byte[rest] == byte[i]).sum(1) >= LEAST_BYTES]
        for at in range(0, len(rest), SIDE):
            some = rest[at : at + SIDE]
            both = np.bitwise_count(bits[some] & bits[i]).sum(1, dtype=np.int64)
            for j in some[reach(both, size[some], size[i])].tolist():
                if label[j] != label[i]:
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v) links with v < u between alike nodes (fp, wide): enough for the components. texts gives (fp, text) of those asked for."""
    posted = shared.written(nodes.select("fp", F.explode(_keys(F.col("wide"))).alias("key")), "near-keys")
    same = [F.bit_xor(F.xxhash64(F.lit(i), "fp")).alias(f"x{i}") for i in (1, 2)]
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least"), *same).filter("n > 1")
    lists = shared.written(lists.groupBy("n", "least", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"), "near-lists")
    members = shared.written(posted.join(lists, "key").select("key", "n", "fp"), "near-members")
    needed = shared.written(members.select("fp").distinct(), "near-needed")
    sets = texts(needed).select("fp", _sets(F.col("text")).alias("set")).join(nodes.select("fp", "wide"), "fp")
    sets = shared.written(sets, "near-sets")
    sizes = members.join(sets.select("fp", F.octet_length("set").alias("b")), "fp").groupBy("key").agg(F.sum("b").alias("b"), F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.sqrt(F.col("n") * F.col("b") / (16.0 * CELL_BYTES))).cast("int")  # two blocks: 2n / blocks members, 2b / blocks / 8 shingles, in bits
    sizes = shared.written(sizes.select("key", F.greatest(blocks, F.lit(1)).alias("blocks")), "near-blocks")
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp", "key"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp").join(sets, "fp")
    dealt = dealt.repartition(F.xxhash64("key", "a", "b")).sortWithinPartitions("key", "a", "b", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def linked() -> pa.RecordBatch:
            fps = [h[0] for h in held]
            block = None if at[1] == at[2] else np.array([h[3] for h in held])
            found = link_members([h[1] for h in held], [np.frombuffer(h[2], "<u8") for h in held], block) if len(held) > 1 else []
            ends = [sorted((fps[i], fps[j])) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([e[1] for e in ends], pa.int64()), pa.array([e[0] for e in ends], pa.int64())], ["u", "v"])

        shared.claim("near_copies")
        for batch in batches:
            for key, a, b, own, fp, wide, members in zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b", "own", "fp", "wide", "set")), strict=True):
                if (key, a, b) != at:
                    if held:
                        yield linked()
                    at, held = (key, a, b), []
                held.append((fp, wide, members, own))
        if held:
            yield linked()

    return shared.written(dealt.select("key", "a", "b", "own", "fp", "wide", "set").mapInArrow(run, "u long, v long"), "near-links")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one of the least id (nulls last). All columns stay.

    Texts without words, null ones too, are one group. Rows of one id and one text count as one, whichever is kept; of different texts of the
    least id one is kept by a hash. Texts are shuffled twice, by a key that is all but unique: to compare those that met, and for the last join.
    """
    shared.arrow_batches(docs.sparkSession)
    names = docs.columns
    k1, k2, n = (shared.free_name(names, c) for c in ("key1", "key2", "place"))
    key = [F.xxhash64(F.lit(i), F.col(id_col).isNull(), F.col(id_col), F.col(text)).alias(c) for i, c in ((1, k1), (2, k2))]
    rows = docs.select(F.col(id_col).alias("id"), key[0].alias("k1"), key[1].alias("k2"), _nodes(F.col(text)).alias("node"))
    rows = shared.written(rows.select("id", "k1", "k2", "node.fp", "node.wide"), "near-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2"))
    nodes = shared.written(rows.groupBy("fp").agg(first.alias("first"), F.first("wide").alias("wide")), "near-nodes")

    def texts(needed: DataFrame) -> DataFrame:
        at = shared.written(nodes.join(needed, "fp", "left_semi").select("fp", F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2")), "near-at")
        met = docs.select(key[0].alias("k1"), key[1].alias("k2"), F.col(text).alias("text")).join(at.hint("merge"), ["k1", "k2"])
        one = F.row_number().over(W.partitionBy("k1", "k2").orderBy("k1"))
        return met.withColumn("place", one).filter("place = 1").select("fp", "text")

    of = simhash.grouped(nodes, links(nodes, texts), "first")
    kept = shared.written(of.select(F.col("class.k1").alias(k1), F.col("class.k2").alias(k2)).distinct(), "near-kept")
    out = docs.select("*", *key).join(kept.hint("merge"), [k1, k2], "left_semi")  # alike at every size
    one = F.row_number().over(W.partitionBy(k1, k2).orderBy(k1))  # rows that repeat id and text
    return out.withColumn(n, one).filter(F.col(n) == 1).select(*names)
