"""Mixture-controlled packing of token sequences by deficit round-robin.

Each source is a queue of tokens. While windows (sequences of ``WINDOW`` ids) are filled, every queue's
deficit grows with its target proportion, and a queue is served a quantum of ``QUANTUM`` ids
whenever its deficit has reached that much. So the j-th quantum of a queue of weight p falls due at time
(j + 1/2) / p, and the round-robin serves quanta in the order of (due time, queue). Deficits are carried from window to
window: at any window's start a queue has had its share of all ids before, to within a quantum.

That order can be computed anywhere without walking it: the rank of a quantum is the number of
quanta, over all queues, that fall due before. With whole-number weights this is exact. So a task that
holds any part of any queue knows the window and place of each of its quanta, which is how deficits carry over
partitions as well, and no task needs more than the queues' lengths. When a queue
is used up the others share what it had.

What a queue has beyond its whole quanta, and the last quanta that do not fill a window, follow
one another in the windows at the end. So only the last sequence is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import shared, tokenize

WINDOW = 1024
QUANTUM = 128
#: Ranks of up to this many queues are summed queue by queue; of more, by classes of equal weight.
MAX_QUEUES = 256
#: Weights are whole numbers that sum to about this, or to the number of quanta where there are more.
SCALE = 1 << 20
#: Rows of (queue, partition) starts that may be broadcast; more are joined.
BROADCAST_ROWS = 200_000
#: Cells of (quanta x queues) computed at once.
CELLS = 1 << 22


@dataclass
class Mixture:
    """The schedule: what each queue holds, and its weight."""

    tokens: np.ndarray
    weights: np.ndarray
    window: int = WINDOW
    quantum: int = QUANTUM

    def __post_init__(self) -> None:
        self.quanta = self.tokens // self.quantum
        self.slots = self.window // self.quantum
        self.full = int(self.quanta.sum()) // self.slots  # whole windows
        rests = self.tokens % self.quantum
        head = (int(self.quanta.sum()) - self.full * self.slots) * self.quantum
        self.rest_at = head + np.concatenate([[0], np.cumsum(rests)[:-1]]).astype(np.int64) if len(rests) else rests

    @staticmethod
    def of(names: list[str], tokens: list[int], targets: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM) -> Mixture:
        """Weights by target proportion; without targets, by what each queue holds. A queue without a target weighs least."""
        if window % quantum:
            raise ValueError("the quantum must divide the window")
        held = np.array(tokens, np.int64)
        share = np.array([targets.get(n, 0.0) for n in names]) if targets else held.astype(np.float64)
        total = share.sum() or 1.0
        scale = max(SCALE, int(held.sum()) // quantum)
        return Mixture(held, np.maximum(1, np.rint(share / total * scale)).astype(np.int64), window, quantum)

    @cached_property
    def classes(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each distinct weight: its queues in order, their quanta in rising order, and sums of these before each. Within a weight, quanta must not rise with the queues' order."""
        order = np.argsort(self.weights, kind="stable")
        out = []
        for own in np.split(order, np.nonzero(np.diff(self.weights[order]))[0] + 1):
            quanta = self.quanta[own]
            if (np.diff(quanta) > 0).any():
                raise ValueError("queues of one weight must come in falling order of what they hold")
            out.append((int(self.weights[own[0]]), own, quanta[::-1].copy(), np.concatenate([[0], np.cumsum(quanta[::-1])])))
        return out

    def _ranks_by_class(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As ``ranks``, in steps of a class: of n queues of one weight, the same number of quanta falls due before, as far as each has them, and one more of those that tie and come first."""
        out = np.zeros(len(j), np.int64)
        own = self.weights[queue]
        for weight, queues, quanta, sums in self.classes:
            num = (2 * j + 1) * weight - own
            before = np.maximum(-((-num) // (2 * own)), 0)
            at = np.searchsorted(quanta, before)
            out += sums[at] + before * (len(quanta) - at)
            tie = np.nonzero((num >= 0) & (num % (2 * own) == 0))[0]
            more = len(quanta) - np.searchsorted(quanta, before[tie] + 1)  # the first so many hold another
            out[tie] += np.minimum(more, np.searchsorted(queues, queue[tie]))
        return out

    def ranks(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The place of the j-th quantum of each queue in the order of service."""
        if len(self.weights) > MAX_QUEUES:
            return self._ranks_by_class(queue, j)
        out = np.zeros(len(j), np.int64)
        step = max(1, CELLS // max(1, len(self.weights)))
        others = np.arange(len(self.weights))
        for at in range(0, len(j), step):
            q, k = queue[at : at + step, None], j[at : at + step, None]
            own = self.weights[q]
            num = (2 * k + 1) * self.weights[None, :] - own  # quantum i of another is before where 2 i own < num, or <= for queues that come first
            before = np.where(others[None, :] < q, num // (2 * own) + 1, -((-num) // (2 * own)))
            out[at : at + step] = np.clip(before, 0, self.quanta[None, :]).sum(axis=1)
        return out

    def place(self, queue: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the id at a position of a queue."""
        j = at // self.quantum
        rest = j >= self.quanta[queue]
        rank = self.ranks(queue, np.minimum(j, np.maximum(self.quanta[queue] - 1, 0)))
        inside = at - j * self.quantum
        late = rank - self.full * self.slots  # quanta that fill no window
        stream = np.where(rest, self.rest_at[queue] + at - self.quanta[queue] * self.quantum, late * self.quantum + inside)
        end = rest | (late >= 0)
        sequence = np.where(end, self.full + stream // self.window, rank // self.slots)
        return sequence, np.where(end, stream % self.window, rank % self.slots * self.quantum + inside)

    def deficits(self, window: int) -> np.ndarray:
        """Ids that each queue is owed at the start of a window (below nought: that it has had beforehand)."""
        rank = min(window, self.full) * self.slots
        lo, hi = np.zeros(len(self.tokens), np.int64), self.quanta.copy()
        q = np.arange(len(self.tokens))
        while (lo < hi).any():
            mid = (lo + hi) // 2
            low = (self.ranks(q, mid) < rank) & (lo < hi)
            lo, hi = np.where(low, mid + 1, lo), np.where(low | (lo >= hi), hi, mid)
        return self.weights / self.weights.sum() * rank * self.quantum - lo * self.quantum


def encode_queues(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text: str, source: str) -> DataFrame:
    """(doc_id, queue, part, local, n, ids) for each row, written: its ids and end id, and the ids before it in its part of its queue."""
    spark = docs.sparkSession
    shared.arrow_batches(spark)
    name = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), name.alias("queue"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = tokenize.encoder(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(b.column("text"))]
            counts = [len(x) // enc.width for x in ids]
            local = []
            for q, n in zip(b.column("queue").to_pylist(), counts, strict=True):
                local.append(before.get(q, 0))
                before[q] = local[-1] + n
            cols = [b.column("doc_id"), b.column("queue"), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "queue", "part", "local", "n", "ids"])

    return shared.written(rows.mapInArrow(run, "doc_id long, queue string, part int, local long, n long, ids binary"), "packing-queues")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def cut(mix: Mixture, queue: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents that lie at ``begin`` of their queues: cut between quanta, and where a window ends."""
    g = mix.quantum
    first, last = begin // g, (begin + n - 1) // g
    per = last - first + 1
    doc = np.repeat(np.arange(len(n)), per)
    j = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    lo, hi = np.maximum(j * g, begin[doc]), np.minimum((j + 1) * g, (begin + n)[doc])
    _, offset = mix.place(queue[doc], lo)
    over = np.maximum(offset + hi - lo - mix.window, 0)  # ids beyond the window's end, at most a quantum
    split = np.nonzero(over)[0]
    doc, lo, hi = np.concatenate([doc, doc[split]]), np.concatenate([lo, (hi - over)[split]]), np.concatenate([hi - over, hi[split]])
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    return doc, lo - begin[doc], hi - lo


def pack(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer_path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW, quantum: int = QUANTUM, with_ids: bool = False, temperature: float = 1.0) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue[, ids].

    ``targets`` are the proportions of sources; without them a source's is what it holds to the power of ``temperature`` (below 1 small sources come
    sooner than their share, and what is left of large ones comes at the end).

    Null texts are empty and hold the end id alone; a null source is the queue of the empty name; null ids stay null. Rows that repeat are
    each packed. Queues hold documents in the order in which the table is read. Each id lies in exactly one piece, and sequences are full
    but for the last. An empty table gives an empty one.

    Texts are encoded where they lie, once, and nothing is shuffled but one sum for each partition and queue.
    """
    spark = docs.sparkSession
    tokenizer_path = tokenizer_path or tokenize.default_path()
    rows = encode_queues(docs, tokenizer_path, end_id, id_col, text, source)
    sums = shared.written(rows.groupBy("queue", "part").agg(F.sum("n").alias("tokens")), "packing-sums")
    starts = sums.select("queue", "part", (F.sum("tokens").over(W.partitionBy("queue").orderBy("part")) - F.col("tokens")).alias("base"))
    totals = sorted((r["queue"], r["t"]) for r in sums.groupBy("queue").agg(F.sum("tokens").alias("t")).collect())  # one row for each source
    if len(totals) > MAX_QUEUES:  # as classes of equal weight need them
        totals.sort(key=lambda x: -x[1])
    names = [q for q, _ in totals]
    if not targets and temperature != 1.0:
        targets = {q: t**temperature for q, t in totals}
    mix = Mixture.of(names, [t for _, t in totals], targets, window, quantum)
    small = sums.count() <= BROADCAST_ROWS
    placed = rows.join(F.broadcast(starts) if small else starts, ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("local")).alias("begin"), "n", "ids")
    sent = spark.sparkContext.broadcast((mix, {q: i for i, q in enumerate(names)}))
    dtype = tokenize.encoder(tokenizer_path).dtype.str

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, numbers = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            queue = np.array([numbers[q] for q in b.column("queue").to_pylist()], np.int64)
            begin, n = b.column("begin").to_numpy(zero_copy_only=False), b.column("n").to_numpy(zero_copy_only=False)
            doc, start, length = cut(mix, queue, begin, n)
            sequence, offset = mix.place(queue[doc], begin[doc] + start)
            ids = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in b.column("ids").to_pylist()]
            parts = [ids[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            cols = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(n[doc]), pa.array(sequence), pa.array(offset), b.column("queue").take(pa.array(doc))]
            cols += [pa.array(parts, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"] + ["ids"] * with_ids)

    return placed.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces that carry their ids: unsigned 32-bit little-endian, in order of offset."""
    listed = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return listed.select("sequence_id", F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["length"]).alias("length"), ids.alias("ids"))
