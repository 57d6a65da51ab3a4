"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters and digits as they stand (case tells shouting from prose), and runs of other signs; blanks
but line ends are dropped. Each token, each pair of neighbours, and each token's shape hash to one of 2**bits
features; a text's value at a feature is the feature's share of all occurrences in the text.
The score is the sigmoid of its sparse dot product with the weights.

Training reads a bounded sample of the labelled rows (``max_rows``, the least by a hash of the id), in the order of
that hash, in one task: the FTRL-proximal update is sequential. The model has at most 2**bits weights, a
bound that no corpus moves, and is broadcast; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

BITS = 18
#: Labelled rows that are learned from, at most.
MAX_ROWS = 8_000
EPOCHS = 2
# FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.2, 0.5
#: A document is good where its score reaches this.
THRESHOLD = 0.3
#: Values of a text's features sum to this.
SCALE = 8.0
#: Texts scored at once.
AT_ONCE = 128
#: Tokens held by one worker before the memo starts again.
MEMO_TOKENS = 200_000
_TOKEN = re.compile(r"\w+|[^\w\s]+|\n+")
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _shape(token: str) -> str:
    """A rough sketch of a token: its kind of signs, and its length to a factor of two."""
    if token.islower():
        kind = "l"
    elif not token[0].isalnum():
        kind = token[:3]
    elif token.isupper():
        kind = "U" if len(token) > 1 else "C"
    else:
        kind = "C" if token[0].isupper() else "d" if token.isdigit() else "m"
    return f"{kind}{len(token).bit_length()}"


_shapes: dict[str, int] = {}


class _Memo(dict):
    """token -> its number; ``hashes`` holds the hash of the token and of its shape by number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((1 << 14, 2), np.uint64)

    def __missing__(self, token: str) -> int:
        k = len(self)
        if k == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[k, 0] = xxhash.xxh64_intdigest(token)
        shape = _shape(token)
        if shape not in _shapes:
            if len(_shapes) > 10_000:
                _shapes.clear()
            _shapes[shape] = xxhash.xxh64_intdigest(shape, 1)
        self.hashes[k, 1] = _shapes[shape]
        self[token] = k
        return k


_memo = _Memo()
shared.holds("quality", _memo.clear)


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, number of the text) of each occurrence of a feature."""
    shared.claim("quality")
    if len(_memo) > MEMO_TOKENS:
        _memo.clear()
    get, find = _memo.__getitem__, _TOKEN.findall
    found = [np.fromiter(map(get, find(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    n = np.array([len(f) for f in found], np.int64)
    k = np.concatenate(found) if found else np.zeros(0, np.int64)
    one, shape = _memo.hashes[k, 0], _memo.hashes[k, 1]
    text = np.repeat(np.arange(len(n)), n)
    pair = np.nonzero(text[1:] == text[:-1])[0]  # neighbours within a text
    two = (one[pair] * _ODD) ^ one[pair + 1]
    shapes = (shape[pair] * _ODD) ^ (shape[pair + 1] * _MIX)
    twice = pair[k[pair] == k[pair + 1]]  # a token that follows itself
    every = np.concatenate([one, two, shape, shapes, np.full(len(twice), 7, np.uint64)])
    of = np.concatenate([text, text[pair], text, text[pair], text[twice]])
    return ((every * _MIX) >> np.uint64(64 - bits)).astype(np.int64), of


def vectors(texts: list[str | None], bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct indices in order, values) of each text: a value is SCALE times the feature's share of the text's features."""
    index, of = features(texts, bits)
    n, out = np.bincount(of, minlength=len(texts)), []
    for part in np.split(index[np.argsort(of, kind="stable")], np.cumsum(n)[:-1]):
        at, count = np.unique(part, return_counts=True)
        out.append((at, count * (SCALE / max(1, len(part)))))
    return out


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    """Weights by feature and a bias; ``weights`` has 2**bits entries."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, texts: list[str | None]) -> list[float]:
        index, of = features(texts, self.bits)
        n = np.bincount(of, minlength=len(texts))
        sums = np.bincount(of, self.weights[index], len(texts))
        return sigmoid(sums * (SCALE / np.maximum(n, 1)) + self.bias).tolist()


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """FTRL-proximal over (indices, values, label) rows in their order, epoch after epoch. No rows: every text scores one half."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where((np.abs(zi) <= l1) & (i != bias), 0.0, -(zi - np.sign(zi) * l1 * (i != bias)) / ((beta + np.sqrt(n[i])) / alpha + l2 * (i != bias)))

    for _ in range(epochs):
        for at, value, label in rows:
            i, v = np.append(at, bias), np.append(value, 1.0)
            w = weight(i)
            g = (sigmoid(float(w @ v)) - label) * v
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange((1 << bits) + 1))
    return Model(w[:bias], float(w[bias]), bits)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text: str, label: str, max_rows: int) -> DataFrame:
    """At most max_rows rows (place, text, label): the least by a hash of the id among the labelled rows that ``learn`` admits.

    The choice is made on the labels alone, so what is joined to the documents has a fixed bound. An id with
    several labels counts with the least; of an id that several documents have one text is read, the least by a hash. A task passes on
    one text of an id at most.
    """
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & learn).groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("label"))
    chosen = ids.withColumn("place", F.xxhash64(F.col("id").cast("string"))).orderBy("place", "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("place").alias("place"), F.first("label").alias("label"))
    return one.select("place", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """The model of the labelled rows that ``learn`` (a condition on the labels' columns) admits.

    Features are hashed where the texts lie; what one task gathers is at most max_rows sparse vectors.
    """
    spark = docs.sparkSession
    shared.arrow_batches(spark)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = vectors(b.column("text").to_pylist(), bits)
            yield pa.RecordBatch.from_arrays([b.column("place"), pa.array([i.astype("<i4").tobytes() for i, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary()), b.column("label")], ["place", "at", "value", "label"])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column("place").to_pylist(), b.column("at").to_pylist(), b.column("value").to_pylist(), b.column("label").to_pylist(), strict=True)
        rows.sort()
        model = train([(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4"), y) for _, a, v, y in rows], bits, epochs)
        some = np.nonzero(model.weights)[0]
        yield pa.RecordBatch.from_arrays([pa.array([some.astype("<i4").tobytes()]), pa.array([model.weights[some].tobytes()]), pa.array([model.bias])], ["at", "weight", "bias"])

    rows = sample(docs, labels, learn, id_col, text, label, max_rows).mapInArrow(hashed, "place long, at binary, value binary, label int")
    row = shared.written(rows, "quality-sample").coalesce(1).mapInArrow(learned, "at binary, weight binary, bias double").first()
    weights = np.zeros(1 << bits)
    if row:
        weights[np.frombuffer(row["at"], "<i4")] = np.frombuffer(row["weight"])
    return Model(weights, row["bias"] if row else 0.0, bits)


def scores(spark, model: Model, text: Column) -> Column:
    """The score of each whole text, 0 to 1; null texts are empty, and an empty text scores by the bias alone."""
    shipped = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.bits))

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias, bits = shipped.value
        own = Model(weights, bias, bits)
        for batch in texts:
            listed = batch.to_pylist()
            yield pa.array([s for at in range(0, len(listed), AT_ONCE) for s in own.score(listed[at : at + AT_ONCE])], pa.float64())

    return run(text)


def with_quality(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, **more) -> DataFrame:
    """docs with ``score`` and ``predicted`` (1 where the score reaches the threshold). Columns of those names give way.

    Nothing but the text makes a score, so repeated rows and equal texts score alike. An empty table gives an
    empty one; without a label to learn from every score is one half.
    """
    model = fit(docs, labels, learn, id_col, text, label, **more)
    out = docs.drop("score", "predicted").withColumn("score", scores(docs.sparkSession, model, F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, **more) -> DataFrame:
    """The rows of docs that the classifier admits, all columns as they are.

    Null and empty texts score by the bias alone; rows that repeat and equal texts are admitted alike, a null id does not matter; an empty table gives an empty one.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    named = docs.select(*[F.col(c).alias(n) for c, n in own.items()])
    model = fit(docs, labels, learn, **{k: v for k, v in more.items() if k != "threshold"})
    scored = named.withColumn("score", scores(docs.sparkSession, model, F.col(own[more.get("text", "text")])))
    return scored.filter(F.col("score") >= more.get("threshold", THRESHOLD)).select(*[F.col(n).alias(c) for c, n in own.items()])
