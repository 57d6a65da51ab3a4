"""Sharding by a k-d tree over document metadata, in SQL functions alone.

Rows of equal text form one group; a group is a point whose weight is its bytes and whose
coordinates are its source, its language and the length of its text. A node that has to give k
shards is cut along its widest dimension, where the share floor(k/2)/k of its bytes lies before the
cut, until each leaf is one shard. Cuts fall between groups. A group that outweighs ``hot_share`` of
a shard is dealt into small pieces first, by a hash of the document, so that it
can be cut too: it alone is spread over several shards, for no other way leaves sizes near equal.

A weighted median of a billion points is found without sorting them: all nodes of a level are
summed at once into ``BINS`` bins each, the bin that holds the cut is split into bins again, and so on until
what is left to decide weighs less than ``tolerance`` of a shard or is a single point. Each such pass
is one aggregation with map-side sums that yields at most shards x BINS rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared

#: Bits of the order key that a pass resolves.
STEP_BITS = 10
BINS = 1 << STEP_BITS
#: Bits of a coordinate, and of the tie hash below it.
DIM_BITS, TIE_BITS = 20, 42
KEY_BITS = DIM_BITS + TIE_BITS
#: Part of a shard that a piece of a hot group weighs.
PIECE_SHARE = 0.01
#: Bytes added to each row's text bytes.
ROW_BYTES = 16


@dataclass
class Node:
    """A cell of the tree. ``dim`` is -1 for a leaf; points whose key in ``dim`` is below ``cut`` go left."""

    shards: int
    first: int
    dim: int = -1
    cut: int = 0
    left: int = -1
    right: int = -1
    lo: int = 0
    bits: int = KEY_BITS
    before: float = 0.0
    weight: float = 0.0
    open: bool = field(default=False)


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def _hash_bits(column: Column, seed: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 64 - bits)


def _coordinate(column: Column, numeric: bool) -> Column:
    """DIM_BITS bits: of a number its logarithm, which keeps the order; of a text its hash."""
    if numeric:  # lengths span orders of magnitude: the logarithm to 1/4096 of a doubling, at most 64 doublings
        return F.least(F.floor(F.log2(F.greatest(column.cast("double"), F.lit(1.0))) * (1 << 14)), F.lit((1 << DIM_BITS) - 1)).cast("long")
    return _hash_bits(F.coalesce(column.cast("string"), F.lit("")), 7, DIM_BITS)


def _walk(tree: list[Node], keys: list[Column]) -> Column:
    """The node that a point has come to."""
    depth, level = 0, [0]
    while level := [c for n in level if tree[n].dim >= 0 for c in (tree[n].left, tree[n].right)]:
        depth += 1
    if not depth:
        return F.lit(0)
    as_array = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    dims, cuts = as_array([n.dim for n in tree], "int"), as_array([n.cut for n in tree], "long")
    lefts, rights = as_array([n.left for n in tree], "int"), as_array([n.right for n in tree], "int")
    key = F.array(*keys)

    def step(node: Column, _: Column) -> Column:
        dim = F.get(dims, node)
        nxt = F.when(F.get(key, dim) < F.get(cuts, node), F.get(lefts, node)).otherwise(F.get(rights, node))
        return F.when(dim >= 0, nxt).otherwise(node)

    return F.aggregate(F.array(*[F.lit(i) for i in range(depth)]), F.lit(0), step)


def build(pts: DataFrame, n_dims: int, shards: int, tolerance: float) -> list[Node]:
    """The tree over points (k0 .. k{n-1} order keys, w weight)."""
    keys = [F.col(f"k{i}") for i in range(n_dims)]
    spans = [c for i in range(n_dims) for c in (F.min(F.shiftright(f"k{i}", TIE_BITS)).alias(f"lo{i}"), F.max(F.shiftright(f"k{i}", TIE_BITS)).alias(f"hi{i}"))]
    tree, level, whole = [Node(shards, 0)], [0], None
    while level := [n for n in level if tree[n].shards > 1]:
        rows = {r["node"]: r for r in pts.select(_walk(tree, keys).alias("node"), *keys, "w").filter(F.col("node").isin(level)).groupBy("node").agg(F.sum("w").alias("w"), *spans).collect()}
        whole = whole or rows.get(0)
        for n in level:
            node, r = tree[n], rows.get(n)
            if r is None:  # no rows: any cut will do
                node.dim, node.cut = 0, 0
                continue
            wide = [(r[f"hi{i}"] - r[f"lo{i}"]) / max(1, whole[f"hi{i}"] - whole[f"lo{i}"]) for i in range(n_dims)]
            node.dim, node.weight, node.open = wide.index(max(wide)), float(r["w"]), True
            node.lo, node.bits, node.before = 0, KEY_BITS, 0.0
        _cut(pts, keys, tree, level, tolerance * (whole["w"] if whole else 0) / shards)
        below = []
        for n in level:
            node = tree[n]
            k = node.shards // 2
            node.left, node.right = len(tree), len(tree) + 1
            tree += [Node(k, node.first), Node(node.shards - k, node.first + k)]
            below += [node.left, node.right]
        level = below
    return tree


def _cut(pts: DataFrame, keys: list[Column], tree: list[Node], level: list[int], slack: float) -> None:
    """Set the cut of each open node of the level, a few bits of the key at a time."""
    plain = [Node(n.shards, n.first, n.dim if i not in level else -1, n.cut, n.left, n.right) for i, n in enumerate(tree)]
    at = _walk(plain, keys)
    while todo := [n for n in level if tree[n].open]:
        ids = F.array(*[F.lit(n) for n in todo])
        pick = lambda values, kind, j: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), j - 1)
        base = pts.select(F.array_position(ids, at).cast("int").alias("j"), *keys, "w").filter("j > 0")
        dim = pick([tree[n].dim for n in todo], "int", F.col("j"))
        base = base.select("j", F.get(F.array(*keys), dim).alias("k"), "w")
        lo, bits = pick([tree[n].lo for n in todo], "long", F.col("j")), pick([tree[n].bits for n in todo], "int", F.col("j"))
        base = base.withColumn("off", F.col("k") - lo).withColumn("bits", bits).filter((F.col("off") >= 0) & (F.expr("shiftright(off, bits)") == 0))
        bins = base.groupBy("j", F.expr(f"shiftright(off, greatest(bits - {STEP_BITS}, 0))").alias("bin")).agg(F.sum("w").alias("w"), F.min("k").alias("a"), F.max("k").alias("b"))
        found: dict[int, list] = {}
        for r in bins.collect():  # at most shards x BINS rows
            found.setdefault(todo[r["j"] - 1], []).append(r)
        for n in todo:
            node = tree[n]
            target = node.weight * (node.shards // 2) / node.shards
            have = node.before
            for r in sorted(found.get(n, []), key=lambda r: r["bin"]):
                if have + r["w"] >= target:
                    break
                have += r["w"]
            else:
                node.cut, node.open = node.lo + (1 << node.bits), False
                continue
            rest = max(node.bits - STEP_BITS, 0)
            if r["a"] == r["b"] or r["w"] <= slack or rest == 0:  # one point, or too light to matter: whichever side is nearer
                node.cut = r["a"] if target - have <= have + r["w"] - target else r["b"] + 1
                node.open = False
            else:
                node.lo, node.bits, node.before = node.lo + (r["bin"] << rest), rest, have


def shard(docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("source", "lang"), id_col: str = "doc_id", text: str = "text", tolerance: float = 0.002, hot_share: float = 0.25, spread: str | None = None) -> DataFrame:
    """docs with ``size`` (UTF-8 bytes of the text plus 16), ``shard`` and ``slot`` (gapless from 0 in each shard).

    Rows of equal text share a shard, unless all of them together outweigh ``hot_share`` of a
    shard; such a group is spread in pieces, and ``spread``, where it names a column, tells its rows. Null texts count as empty ones, a null coordinate as
    an empty text, a null id as 0. Repeated rows each take a slot. An empty table gives an empty one.
    The text itself is not carried along; columns of docs that have the names of the three new ones give way.

    Groups are summed with map-side combining before anything is shuffled, and the join that
    brings a group's cell back to its rows moves no text. Rows are written once with their place
    in their task, and a slot is that place plus the counts of the tasks before.
    """
    keep = [c for c in docs.columns if c not in ("size", "shard", "slot", text, spread)]
    own = {c: f"c{i}" for i, c in enumerate(keep)}  # the caller's columns under names of ours until the end
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *[F.col(c).alias(n) for c, n in own.items()],
        size_of(F.col(text)).alias("_size"),
        F.xxhash64(F.lit(1), t).alias("_g1"),
        F.xxhash64(F.lit(2), t).alias("_g2"),
        *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(f"_d{i}") for i, d in enumerate(dims)],
        F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.monotonically_increasing_id()), 44).alias("_deal"),
    )
    rows = shared.written(rows, "shard-rows")
    total = rows.agg(F.sum("_size")).first()[0] or 0
    groups = rows.groupBy("_g1", "_g2").agg(F.sum("_size").alias("w"), F.max("_size").alias("one"), F.count(F.lit(1)).alias("n"), *[F.min(f"_d{i}").alias(f"_d{i}") for i in range(len(dims))])
    most = max(1, int(total / shards * hot_share))
    fine = max(1, int(total / shards * PIECE_SHARE))  # bytes in a piece, or one row
    pieces = F.least(F.col("n"), F.ceil(F.col("w") / F.lit(fine))).cast("int")
    groups = groups.withColumn("_pieces", F.when(F.col("w") > most, pieces).otherwise(F.lit(1)))
    groups = groups.withColumn("_dims", F.array(*[_coordinate(F.col(f"_d{i}"), False) for i in range(len(dims))], _coordinate(F.col("one"), True)))
    groups = shared.written(groups.select("_g1", "_g2", "w", "_pieces", "_dims"), "shard-groups")
    n_dims = len(dims) + 1

    def keyed(piece: Column) -> list[Column]:
        tie = _hash_bits(F.concat_ws("/", F.col("_g1").cast("string"), F.col("_g2").cast("string"), piece.cast("string")), 11, TIE_BITS)
        return [(F.shiftleft(F.get("_dims", F.lit(i)), TIE_BITS) + tie).alias(f"k{i}") for i in range(n_dims)]

    pts = groups.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    pts = shared.written(pts.select(*keyed(F.col("_piece")), (F.col("w") / F.col("_pieces")).alias("w")), "shard-points")
    tree = build(pts, n_dims, shards, tolerance)
    firsts = F.array(*[F.lit(n.first) for n in tree])
    placed = rows.join(groups.select("_g1", "_g2", "_pieces", "_dims"), ["_g1", "_g2"])
    placed = placed.select(*own.values(), F.col("_size").alias("size"), (F.col("_pieces") > 1).alias("_spread"), *keyed((F.col("_deal") % F.col("_pieces")).cast("int")))
    placed = placed.select(*own.values(), "size", "_spread", F.get(firsts, _walk(tree, [F.col(f"k{i}") for i in range(n_dims)])).alias("shard"))
    out = with_slots(placed, "shard")
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], "size", "shard", "slot", *([F.col("_spread").alias(spread)] if spread else []))


def with_slots(rows: DataFrame, shard: str) -> DataFrame:
    """rows with ``slot``, gapless from 0 in each shard: no shard is gathered in one task."""
    own = F.monotonically_increasing_id()
    at = rows.sortWithinPartitions(shard).withColumn("_mid", own)
    at = shared.written(at.withColumn("_pid", F.shiftright("_mid", 33)), "shard-places")
    first = at.groupBy("_pid", shard).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(shard).orderBy("_pid")) - F.col("_n")
    first = first.select("_pid", shard, "_first", before.alias("_before"))
    return at.join(first, ["_pid", shard]).withColumn("slot", F.col("_mid") - F.col("_first") + F.col("_before")).drop("_pid", "_mid", "_first", "_before")


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder for each shard under path."""
    sharded.write.partitionBy(shard).parquet(path)
