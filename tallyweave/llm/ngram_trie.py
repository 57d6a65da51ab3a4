"""Language-model scoring with an Elias-Fano n-gram trie in memory-mapped levels.

Level 1 holds every word of the training texts: the hashes of the words are a monotone sequence, and a word's
id is its place in it. Level n holds the n-grams seen ``min_count`` times or more as children of the
(n-1)-grams: for each context a monotone pointer to its first child, the children's word ids as one monotone
sequence (a child's id counts from the base of its context), a quantised log probability for each child, and
a quantised back-off weight for each context. A query finds a context's range by its pointers and the child by
successor search in that range, relative to the context.

Probabilities are interpolated with absolute discounting: with c the counts that are kept,

    p1(w) = (c(w) + 1) / (N + V + 1)
    pn(w | h) = max(c(hw) - D, 0) / c(h) + g(h) p(n-1)(w | h without its first word)
    g(h) = 1 - (sum over kept hw of (c(hw) - D)) / c(h)

so what pruning takes goes to the shorter context and every distribution sums to one before
quantisation, which rounds probabilities down. A text is a run of words, then one end token;
the end token also stands before its first word.

Levels are built in segments: ranges of (context, word) pairs whose bounds follow from the counts, with a
frequent context spread over several. Texts are cut into words twice, once to count words and once to write each
text's word ids, which all later passes read. A task sums the pairs of what it read before anything is shuffled,
so neither a common word nor a common pair is a hot row. It passes them on packed, a row for each group of
segments: there are at most ``FAN`` groups, so that rows grow with the tasks alone; where a group holds several segments, its
rows are summed and split again before the segments are merged. A segment
is merged by one task and written as one file of the shared folder under a name of its own: a lost executor costs the
task. Scorers map the files; nothing of the model is sent through the driver but the segments' bounds and sizes.

Ids of words and of contexts are 64-bit numbers. A pair is sorted as one 64-bit number where both fit, else by the ranks of
the contexts at hand; within a segment contexts count from the segment's first, and a segment that is too wide for that is an error.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .elias_fano import EliasFano

ORDER = 3
MIN_COUNT = 2
DISCOUNT = 0.75
#: log10 units of one step of a quantised probability (two bytes).
STEP = 1 / 1024
#: Training tokens for each segment of a level.
SEGMENT_TOKENS = 4_000_000
#: Keys or words a task holds before it passes them on.
FLUSH = 4_000_000
#: Frequent words that each shard of level 1 looks at, to set the segments' bounds.
TOP = 64
#: Rows that a task passes on at once, at most: segments beyond go in groups.
FAN = 4096
#: Tasks that sum the rows of one group of segments, where groups hold several.
SALTS = 64
#: Bits of the number as which a pair is sorted.
KEY_BITS = 64
END = b" "  # no word holds a blank
_U = np.uint64


def hash_words(words) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], _U)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, END last; the number of each token's word, text after text; how many tokens each text has).

    Words stand between ASCII blanks, ASCII capitals made small; an end token follows each text's words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    blank = pc.index(words, "").as_py()  # what stands before a first and after a last blank
    if blank >= 0:
        keep = code != blank
        code, text = code[keep], text[keep]
    n = np.bincount(text, minlength=len(texts)) + 1
    out = np.full(len(code) + len(texts), len(words), np.int64)
    out[np.arange(len(code)) + text] = code
    return hash_words([*words.to_numpy(zero_copy_only=False), END]), out, n


# ---- files of arrays -------------------------------------------------------------------------------------


def pack_arrays(header: dict, arrays: dict[str, np.ndarray]) -> bytes:
    """One file: the length of a JSON header, the header, and the arrays, each at a multiple of 8 bytes."""
    at, where, raw = 0, {}, []
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        where[name] = (a.dtype.str, at, len(a))
        raw += [data, b"\0" * (-len(data) % 8)]
        at += len(data) + -len(data) % 8
    head = json.dumps({"header": header, "arrays": where}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return b"".join([struct.pack("<q", len(head)), head, *raw])


def map_arrays(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """The header and arrays of a file, memory-mapped; a file of a store that cannot be mapped is read into memory."""
    import mmap

    from pyarrow import fs

    files, at = shared.local_fs(path)
    if isinstance(files, fs.LocalFileSystem):
        with open(at, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with files.open_input_stream(at) as source:
            raw = source.read()
    n = struct.unpack_from("<q", raw)[0]
    head = json.loads(raw[8 : 8 + n])
    return head["header"], {k: np.frombuffer(raw, t, count, 8 + n + off) for k, (t, off, count) in head["arrays"].items()}


_open: dict[str, tuple] = {}


def _mapped(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    if path not in _open:
        while len(_open) > 4096:  # the one that was opened first goes
            del _open[next(iter(_open))]
        _open[path] = map_arrays(path)
    return _open[path]


_sequences: dict[tuple[str, str], EliasFano] = {}


shared.holds("ngram_trie", _open.clear)
shared.holds("ngram_trie", _sequences.clear)


def _sequence(path: str, name: str) -> EliasFano:
    if (path, name) not in _sequences:
        while len(_sequences) > 8192:
            del _sequences[next(iter(_sequences))]
        header, a = _mapped(path)
        numbers = header[name]
        _sequences[path, name] = EliasFano(numbers["n"], numbers["low"], a[f"{name}.high"], a[f"{name}.ones"], a[f"{name}.lows"])
    return _sequences[path, name]


def _stored(name: str, values: np.ndarray, universe: int, header: dict, arrays: dict[str, np.ndarray]) -> None:
    header[name], (high, ones, lows) = EliasFano.parts(values, universe)
    arrays |= {f"{name}.high": high, f"{name}.ones": ones, f"{name}.lows": lows}


def narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers, none below nought, in as few bytes as hold the largest."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def quantise(p: np.ndarray) -> np.ndarray:
    """Steps below log10 1, rounded down in probability."""
    return np.minimum(np.ceil(-np.log10(p) / STEP - 1e-9), 65535).astype("<u2")


# ---- the model -------------------------------------------------------------------------------------------


def distinct(context: np.ndarray, word: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, place of each pair given) of the distinct pairs in order; words have at most ``bits`` bits."""
    if not len(context):
        return context, word, np.zeros(0, np.int64)
    low, heads = _U(bits), None
    if int(context.max()).bit_length() + bits > KEY_BITS:
        heads, context = np.unique(context, return_inverse=True)
    keys, back = np.unique(context.astype(_U) << low | word.astype(_U), return_inverse=True)
    at = (keys >> low).astype(np.int64)
    return at if heads is None else heads[at], (keys & _U((1 << bits) - 1)).astype(np.int64), back


@dataclass(frozen=True)
class Level:
    """The segments of a level above the first: the least (context, word) of each, in order, and the nodes before each."""

    contexts: np.ndarray
    words: np.ndarray
    bases: np.ndarray

    def cuts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where each segment begins among pairs in order, and their number."""
        out = np.searchsorted(context, self.contexts)
        for s in np.nonzero(self.words)[0].tolist():  # segments that begin inside a frequent context
            end = np.searchsorted(context, self.contexts[s], side="right")
            out[s] += np.searchsorted(word[out[s] : end], self.words[s])
        return np.append(out, len(context))


@dataclass(frozen=True)
class Model:
    """Where the files are, and the sizes of shards and segments."""

    path: str
    shard_bits: int = 0
    word_bases: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    tokens: int = 0
    min_count: int = MIN_COUNT
    discount: float = DISCOUNT
    levels: tuple[Level, ...] = ()

    @property
    def words(self) -> int:
        return int(self.word_bases[-1])

    @property
    def word_bits(self) -> int:
        return max(1, self.words.bit_length())

    @property
    def id_type(self) -> str:
        """Of stored word ids, which are one more than the id: 0 is the unknown word."""
        return "<u4" if self.word_bits < 32 else "<u8"

    def shard_path(self, shard: int) -> str:
        return f"{self.path}/words/{shard:06d}"

    def segment_path(self, n: int, segment: int, kind: str) -> str:
        return f"{self.path}/level{n}-{kind}/{segment:06d}"

    # level 1

    def find_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        shards = _shard(hashes[order], self.shard_bits)
        cuts = np.searchsorted(shards, np.arange((1 << self.shard_bits) + 1))
        for s in np.unique(shards).tolist():
            part = order[cuts[s] : cuts[s + 1]]
            if self.word_bases[s + 1] == self.word_bases[s]:
                continue
            at = _sequence(self.shard_path(s), "hash").find(hashes[part] - _U(s << (64 - self.shard_bits) if s else 0))
            held = at >= 0
            ids[part[held]] = at[held] + self.word_bases[s]
            counts[part[held]] = _mapped(self.shard_path(s))[1]["count"][at[held]]
        return ids, counts

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.word_bases, ids, side="right") - 1
        for s in np.unique(shard).tolist():
            here = shard == s
            out[here] = _mapped(self.shard_path(s))[1]["count"][ids[here] - self.word_bases[s]]
        return out

    def p1(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.words + 1)

    # levels above

    def find_children(self, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``children``, of pairs written context << 32 | word: for models whose contexts and words have 32 bits."""
        return self.children(n, (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64))

    def children(self, n: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node or -1, steps of its log probability) in level n of distinct (context, word) pairs in order."""
        level = self.levels[n - 2]
        nodes, steps = np.full(len(context), -1, np.int64), np.zeros(len(context), np.int64)
        cuts = level.cuts(context, word)
        for s in np.nonzero(np.diff(cuts))[0].tolist():
            if level.bases[s + 1] == level.bases[s]:
                continue
            path = self.segment_path(n, s, "lvl")
            header, arrays = _mapped(path)
            pointers, children = _sequence(path, "pointer"), _sequence(path, "child")
            own = context[cuts[s] : cuts[s + 1]] - header["first"]
            heads = np.nonzero(np.diff(own, prepend=-1))[0]  # each context once: pairs are in order
            runs = np.diff(np.append(heads, len(own)))
            begin, end = (np.repeat(x.astype(np.int64), runs) for x in pointers.access_pair(own[heads]))
            some = np.nonzero(begin < end)[0]
            x = own[some].astype(_U) * _U(header["universe"]) + word[cuts[s] + some].astype(_U)
            at = children.find(x, begin[some], end[some])
            held = at >= 0
            where = cuts[s] + some[held]
            nodes[where] = at[held] + level.bases[s]
            steps[where] = arrays["steps"][at[held]]
        return nodes, steps

    def backoff(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """Steps of the back-off weight of distinct contexts of level n in order."""
        level = self.levels[n - 2]
        out = np.zeros(len(contexts), np.int64)
        cuts = level.cuts(contexts, np.zeros(len(contexts), np.int64))
        for s in np.nonzero(np.diff(cuts))[0].tolist():
            header, arrays = _mapped(self.segment_path(n, s, "lvl"))
            out[cuts[s] : cuts[s + 1]] = arrays["backoff"][contexts[cuts[s] : cuts[s + 1]] - header["first"]]
        return out

    def node_counts(self, n: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, last word) of nodes of level n, in order."""
        level = self.levels[n - 2]
        counts, last = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        cuts = np.searchsorted(nodes, level.bases)
        for s in np.nonzero(np.diff(cuts))[0].tolist():
            here = slice(cuts[s], cuts[s + 1])
            at = nodes[here] - level.bases[s]
            counts[here] = many(_mapped(self.segment_path(n, s, "cnt"))[1], at)
            path = self.segment_path(n, s, "lvl")
            last[here] = (_sequence(path, "child").access(at) % _U(_mapped(path)[0]["universe"])).astype(np.int64)
        return counts, last

    def given_word(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Steps of log p(word | before) by level 2."""
        context, own, back = distinct(before, word, self.word_bits)
        nodes, steps = self.children(2, context, own)
        first = np.diff(context, prepend=-1) != 0
        lower = quantise(self.p1(self.word_counts(own))).astype(np.int64) + self.backoff(2, context[first])[np.cumsum(first) - 1]
        return np.where(nodes >= 0, steps, lower)[back]

    # texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of all tokens of the texts, one after the other; -1 for an unknown word."""
        shared.claim("ngram_trie")
        hashes, local, lengths = tokens(texts)
        return lengths, self.find_words(hashes)[0][local]

    def end_id(self) -> int:
        return int(self.find_words(hash_words([END]))[0][0])

    def contexts(self, nodes: np.ndarray, place: np.ndarray, n: int, end: int) -> np.ndarray:
        """What level n has as the context of each token: the node, in the level below, of the tokens before it; -1 where there is none."""
        out = np.empty_like(nodes)
        out[1:], out[:1] = nodes[:-1], -1
        out[place == 0] = end if n == 2 else -1
        return out

    def steps(self, ids: np.ndarray, counts: np.ndarray | None, place: np.ndarray, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(steps of each token's log probability by the levels up to ``upto``, the node that each token and those before it have come to in level ``upto``, or -1); without counts no steps are worked out."""
        steps = None if counts is None else quantise(self.p1(counts)).astype(np.int64)
        end = self.end_id()
        nodes = ids
        for n in range(2, upto + 1):
            context = self.contexts(nodes, place, n, end)
            full = np.nonzero((context >= 0) & (ids >= 0))[0]
            heads, words, back = distinct(context[full], ids[full], self.word_bits)
            found, own = self.children(n, heads, words)
            nodes = np.full(len(ids), -1, np.int64)
            nodes[full] = found[back]
            if steps is not None:
                first = np.diff(heads, prepend=-1) != 0
                weights = self.backoff(n, heads[first])[np.cumsum(first) - 1] if len(heads) else heads
                steps[full] = np.where(found[back] >= 0, own[back], steps[full] + weights[back])
                rest = np.nonzero((context >= 0) & (ids < 0))[0]  # an unknown word after a known context
                if len(rest):
                    few, back = np.unique(context[rest], return_inverse=True)
                    steps[rest] += self.backoff(n, few)[back]
        return steps, nodes


def _shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


# ---- packed rows -----------------------------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """Bytes of one place side by side, which the shuffle's compression likes."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def packed(keys: np.ndarray, counts: np.ndarray, heads: np.ndarray | tuple = (0,)) -> tuple[bytes, bytes]:
    """Keys as differences, and counts; keys rise from each of the heads to the next."""
    diffs = np.diff(keys, prepend=_U(0))
    diffs[np.asarray(heads, np.int64)] = keys[np.asarray(heads, np.int64)]
    return _planes(diffs.astype("<u8")), _planes(counts.astype("<u8"))


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the differences, which are the keys where there is one head, and counts)."""
    return np.cumsum(_unplanes(keys, "<u8"), dtype=_U), _unplanes(counts, "<u8").astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.nonzero(np.diff(keys, prepend=keys[:1] + _U(1)))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


#: A row holds the keys of some parts: which, how many of each, and all of them packed.
PACKED = "part int, parts binary, sizes binary, keys binary, counts binary"


def _width(parts: int) -> int:
    """Parts in one group."""
    return -(-parts // FAN)


def _rows(keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray, width: int, first: int = 0) -> Iterator[pa.RecordBatch]:
    """A row for each group of ``width`` parts [cuts[i], cuts[i + 1]) that holds keys; keys rise within a part. first: the number of the first part."""
    held = np.nonzero(np.diff(cuts))[0]
    groups = held // width
    for own in np.split(held, np.nonzero(np.diff(groups))[0] + 1) if len(held) else ():
        a, b = cuts[own[0]], cuts[own[-1] + 1]
        sizes = np.diff(cuts)[own]
        cols = packed(keys[a:b], counts[a:b], cuts[own] - a)
        data = [pa.array([int(own[0]) // width + first], pa.int32()), *(pa.array([x.astype("<i8").tobytes()], pa.binary()) for x in (own + first, sizes)), *(pa.array([c], pa.binary()) for c in cols)]
        yield pa.RecordBatch.from_arrays(data, ["part", "parts", "sizes", "keys", "counts"])


def _unrow(parts: bytes, sizes: bytes, keys: bytes, counts: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, keys, counts) of each part of a row."""
    sizes = np.frombuffer(sizes, "<i8")
    total, counts = unpacked(keys, counts)
    ends = np.cumsum(sizes)
    for part, a, b in zip(np.frombuffer(parts, "<i8").tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
        yield part, total[a:b] - (total[a - 1] if a else _U(0)), counts[a:b]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, distinct keys, counts) of rows of one part each that come in order of part."""
    part, keys, counts, held = None, [], [], 0
    for b in batches:
        for p, k, c in (x for row in zip(*(b.column(n).to_pylist() for n in ("parts", "sizes", "keys", "counts")), strict=True) for x in _unrow(*row)):
            if p != part:
                if part is not None:
                    yield part, *summed(np.concatenate(keys), np.concatenate(counts))
                part, keys, counts, held = p, [], [], 0
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > 2 * FLUSH:  # sum what is there, so that equal keys of many tasks take no room
                k, c = summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, held = [k], [c], 0
    if part is not None:
        yield part, *summed(np.concatenate(keys), np.concatenate(counts))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of groups summed, and passed on as rows of one part each."""
    held: dict[int, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for p, both in held.items():
            k, c = summed(np.concatenate([x for x, _ in both]), np.concatenate([x for _, x in both]))
            yield from _rows(k, c, np.array([0, len(k)]), 1, p)

    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in ("parts", "sizes", "keys", "counts")), strict=True):
            for p, k, c in _unrow(*row):
                held.setdefault(p, []).append((k, c))
                size += len(k)
        if size > FLUSH:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def _by_part(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of each part in a task of its own."""
    if _width(parts) > 1:
        salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
        rows = rows.withColumn("salt", salt).repartition(FAN * SALTS, "part", "salt").drop("salt").mapInArrow(_split, PACKED)
    return rows.repartitionById(max(1, parts), F.col("part")).sortWithinPartitions("part")


# ---- building --------------------------------------------------------------------------------------------


def build(spark: SparkSession, texts: DataFrame, path: str, order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, segment_tokens: int = SEGMENT_TOKENS) -> Model:
    """The model of the texts (column text) under path, a folder that all executors see."""
    model = _build_words(texts, Model(path, min_count=min_count, discount=discount))
    ids = shared.written(encoded(spark, model, texts, "text"), "ngram-ids", codec="zstd")
    return _build_levels(spark, model, ids, order, segment_tokens)


def _build_levels(spark: SparkSession, model: Model, ids: DataFrame, order: int, segment_tokens: int) -> Model:
    """The model with its levels above the first, of the texts' ids (column ids)."""
    segments = max(1, 1 << model.shard_bits, -(-model.tokens // segment_tokens))
    frequent = _frequent_words(spark, model, segments)
    shared.delete_path(spark, f"{model.path}/top")
    for n in range(2, order + 1):
        if not model.tokens:
            break
        model, frequent = _build_level(spark, ids, model, n, order, segments, frequent)
        shared.delete_path(spark, f"{model.path}/level{n}-pairs")
        if n > 2:
            shared.delete_path(spark, f"{model.path}/level{n - 1}-cnt")
        shared.release(spark)
    return model


def _build_words(texts: DataFrame, model: Model) -> Model:
    partitions = texts.rdd.getNumPartitions()  # how the scan is split; no RDD runs
    bits = max(0, (partitions - 1).bit_length() - 2)
    width = _width(1 << bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            yield from _rows(keys, counts, np.searchsorted(_shard(keys, bits), np.arange((1 << bits) + 1)), width)

        for b in batches:
            if not b.num_rows:
                continue
            hashes, local, _ = tokens(b.column("text"))
            counts = np.bincount(local, minlength=len(hashes))
            some = counts > 0
            held.append((hashes[some], counts[some]))
            size += int(some.sum())
            if size > FLUSH // 2:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys, counts in _merged(batches):
            header: dict = {}
            arrays: dict[str, np.ndarray] = {"count": counts.astype("<u8" if counts.max() >> 32 else "<u4")}
            _stored("hash", keys - _U(part << (64 - bits) if part else 0), 1 << (64 - bits), header, arrays)
            shared.put_file(model.shard_path(part), pack_arrays(header, arrays))
            top = np.argsort(-counts, kind="stable")[:TOP]
            yield pa.RecordBatch.from_pylist([{"part": part, "words": len(keys), "tokens": int(counts.sum()), "top": top.tolist(), "top_counts": counts[top].tolist()}], schema=pa.schema([("part", pa.int32()), ("words", pa.int64()), ("tokens", pa.int64()), ("top", pa.list_(pa.int64())), ("top_counts", pa.list_(pa.int64()))]))

    rows = _by_part(texts.mapInArrow(count, PACKED), 1 << bits)
    made = shared.written(rows.mapInArrow(merge, TOPS), "ngram-top", f"{model.path}/top")
    sizes = np.zeros((1 << bits) + 1, np.int64)
    total = 0
    for r in made.select("part", "words", "tokens").toLocalIterator():  # one row for each shard
        sizes[r["part"] + 1] = r["words"]
        total += r["tokens"]
    return replace(model, shard_bits=bits, word_bases=np.cumsum(sizes), tokens=total)


TOPS = "part int, words long, tokens long, top array<long>, top_counts array<long>"


def _frequent_words(spark: SparkSession, model: Model, segments: int) -> dict[int, int]:
    """id -> count of the words that outweigh half a segment: at most two for each segment."""
    share = model.tokens / segments
    each = spark.read.schema(TOPS).parquet(f"{model.path}/top").select("part", F.explode(F.arrays_zip("top", "top_counts")).alias("t"))
    heavy = each.filter(F.col("t.top_counts") * 2 > share)
    return {int(model.word_bases[r["part"]]) + r["t"]["top"]: r["t"]["top_counts"] for r in heavy.collect()} if model.tokens else {}


def _bounds(model: Model, contexts: int, segments: int, frequent: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least (context, word) of each segment: even in contexts, and a frequent context's children in several segments of their own."""
    universe, share = model.words, model.tokens / segments
    cuts = {(contexts * i // segments, 0) for i in range(segments)}
    for c, n in frequent.items():
        if (parts := int(2 * n / share)) > 1:
            cuts |= {(c, universe * k // parts) for k in range(parts)} | ({(c + 1, 0)} if c + 1 < contexts else set())
    cuts = np.array(sorted(cuts), np.int64).reshape(-1, 2)
    spans = np.diff(np.append(cuts[:, 0], contexts)) + 1
    if int(spans.max()).bit_length() + model.word_bits > 64:
        raise ValueError("a segment has too many contexts for 64-bit keys: make segments smaller")
    return cuts[:, 0].copy(), cuts[:, 1].copy()


def _build_level(spark: SparkSession, texts: DataFrame, model: Model, n: int, order: int, segments: int, frequent: dict[int, int]) -> tuple[Model, dict[int, int]]:
    """The model with level n of ``order``, and the nodes of that level that outweigh half a segment. Contexts are kept (n-1)-grams, in order."""
    contexts = model.words if n == 2 else int(model.levels[-1].bases[-1])
    first, least = _bounds(model, contexts, segments, frequent)
    width, share = _width(len(first)), model.tokens / segments
    sent = spark.sparkContext.broadcast((model, Level(first, least, np.zeros(len(first) + 1, np.int64))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, level = sent.value
        shared.claim("ngram_trie")
        end, bits = model.end_id(), model.word_bits
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            context, word, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            context, word, back = distinct(context, word, bits)
            counts = np.bincount(back, counts, len(context)).astype(np.int64)
            cuts = level.cuts(context, word)
            keys = (context - np.repeat(level.contexts, np.diff(cuts))).astype(_U) << _U(bits) | word.astype(_U)
            yield from _rows(keys, counts, cuts, width)

        for b in batches:
            if not b.num_rows:
                continue
            ids, place, _ = _decoded(model, b.column("ids"))
            nodes = ids if n == 2 else model.steps(ids, None, place, n - 1)[1]
            context = model.contexts(nodes, place, n, end)
            full = (context >= 0) & (ids >= 0)
            context, word, back = distinct(context[full], ids[full], bits)
            held.append((context, word.astype("<u4") if bits <= 32 else word, np.bincount(back, minlength=len(context)).astype(np.int32)))
            size += len(context)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, level = sent.value
        bits = model.word_bits
        for part, keys, counts in _merged(batches):
            keep = counts >= model.min_count
            keys, counts = keys[keep], counts[keep]
            context, word = (keys >> _U(bits)).astype(np.int64) + level.contexts[part], (keys & _U((1 << bits) - 1)).astype(np.int64)
            shared.put_file(model.segment_path(n, part, "pairs"), _pairs(context, word, counts))
            if n < order:
                shared.put_file(model.segment_path(n, part, "cnt"), pack_arrays({}, few(counts)))
            ends = []  # what a segment holds of its first and its last context: others may hold more of them
            for c in dict.fromkeys(context[:1].tolist() + context[-1:].tolist()):
                a, b = np.searchsorted(context, [c, c + 1])
                ends.append((c, float((counts[a:b] - model.discount).sum())))
            heavy = np.nonzero(counts * 2 > share)[0]
            yield pa.RecordBatch.from_pylist([{"part": part, "kept": len(keys), "context": [c for c, _ in ends], "mass": [m for _, m in ends], "heavy": heavy.tolist(), "counts": counts[heavy].tolist()}], schema=pa.schema([("part", pa.int32()), ("kept", pa.int64()), ("context", pa.list_(pa.int64())), ("mass", pa.list_(pa.float64())), ("heavy", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]))

    rows = _by_part(texts.mapInArrow(count, PACKED), len(first))
    made = rows.mapInArrow(merge, "part int, kept long, context array<long>, mass array<double>, heavy array<long>, counts array<long>").collect()  # one row for each segment
    del rows
    sizes = np.zeros(len(first) + 1, np.int64)
    masses: dict[int, float] = {}
    for r in made:
        sizes[r["part"] + 1] = r["kept"]
        for c, m in zip(r["context"], r["mass"], strict=True):
            masses[c] = masses.get(c, 0.0) + m
    bases = np.cumsum(sizes)
    grown = replace(model, levels=(*model.levels, Level(first, least, bases)))
    finish = spark.sparkContext.broadcast((grown, np.array(sorted(masses.items())).reshape(-1, 2), {r["part"] for r in made}))
    shared.release(spark)

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, masses, written = finish.value
        level = model.levels[-1]
        for b in batches:
            for part in b.column("id").to_pylist():
                last = part + 1 == len(level.contexts)
                past = contexts if last else int(level.contexts[part + 1]) + int(level.words[part + 1] > 0)
                shared.put_file(model.segment_path(n, part, "lvl"), _segment(model, n, part, int(level.contexts[part]), past, masses, part in written))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64())], ["id"])
        for path in [p for p in _open if "-cnt/" in p]:  # a mapped file keeps its room on disk when it is deleted
            del _open[path]

    spark.range(0, len(first), 1, min(len(first), 4096)).mapInArrow(smooth, "id long").agg(F.count(F.lit(1))).collect()
    return grown, {int(bases[r["part"]]) + i: c for r in made for i, c in zip(r["heavy"], r["counts"], strict=True)}


def few(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 or more stand apart."""
    large = np.nonzero(counts >= 255)[0]
    return {"count": np.minimum(counts, 255).astype(np.uint8), "at": large, "large": counts[large]}


def many(arrays: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The counts at places."""
    out = arrays["count"][at].astype(np.int64)
    large = np.nonzero(out == 255)[0]
    out[large] = arrays["large"][np.searchsorted(arrays["at"], at[large])]
    return out


def _pairs(context: np.ndarray, word: np.ndarray, counts: np.ndarray) -> bytes:
    """The file of a segment's pairs and counts, compressed, which only the building of its level needs."""
    first = int(context[0]) if len(context) else 0
    raw = {"step": narrow(np.diff(context, prepend=first)), "word": narrow(word), "count": narrow(counts)}
    data = {k: np.frombuffer(pa.compress(_planes(a), "zstd", asbytes=True) if len(a) else b"", np.uint8) for k, a in raw.items()}
    return pack_arrays({"first": first, "n": len(context), "types": {k: a.dtype.str for k, a in raw.items()}}, data)


def _read_pairs(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    header, arrays = map_arrays(path)
    n, types = header["n"], header["types"]
    step, word, count = (_unplanes(pa.decompress(arrays[k].tobytes(), n * np.dtype(types[k]).itemsize, "zstd", asbytes=True), types[k]).astype(np.int64) if n else np.zeros(0, np.int64) for k in ("step", "word", "count"))
    return np.cumsum(step) + header["first"], word, count


def _segment(model: Model, n: int, part: int, first: int, past: int, masses: np.ndarray, written: bool) -> bytes:
    """A segment's file: pointers, children, steps of their probabilities, and back-off steps of its contexts [first, past)."""
    none = np.zeros(0, np.int64)
    context, word, counts = _read_pairs(model.segment_path(n, part, "pairs")) if written else (none, none, none)
    universe, size = model.words, max(past - first, 0)
    rel = context - first
    per = np.bincount(rel, minlength=size) if size else np.zeros(0, np.int64)
    mass = np.bincount(rel, counts - model.discount, minlength=size) if size else np.zeros(0)
    a, b = np.searchsorted(masses[:, 0], [first, past])  # contexts at the ends of segments, with what all segments hold of them
    mass[masses[a:b, 0].astype(np.int64) - first] = masses[a:b, 1]
    some = np.nonzero(mass > 0)[0]  # contexts with kept children here or in another segment
    whole = np.ones(size)
    if len(some):
        if n == 2:
            whole[some] = model.word_counts(some + first)
        else:
            whole[some] = model.node_counts(n - 1, some + first)[0]
    weight = np.ones(size)
    weight[some] = np.maximum(1 - mass[some] / whole[some], 1e-9)
    if len(word):
        if n == 2:
            lower = model.p1(model.word_counts(word))
        else:  # the shorter context is the last word of the context
            heads, back = np.unique(context, return_inverse=True)
            last = model.node_counts(n - 1, heads)[1][back]
            lower = 10.0 ** (-STEP * model.given_word(last, word))
        p = np.maximum(counts - model.discount, 0) / whole[rel] + weight[rel] * lower
    else:
        p = np.zeros(0)
    header: dict = {"first": first, "universe": universe}
    arrays = {"steps": quantise(p), "backoff": quantise(weight)}
    _stored("pointer", np.concatenate([[0], np.cumsum(per)]).astype(_U), len(word) + 1, header, arrays)
    _stored("child", rel.astype(_U) * _U(universe) + word.astype(_U), max(1, size * universe), header, arrays)
    return pack_arrays(header, arrays)


# ---- scoring

SCORES = "n_tokens long, n_known long, base_score double, score double"


def encoded(spark: SparkSession, model: Model, docs: DataFrame, text: str, name: str = "ids") -> DataFrame:
    """docs with ``name``, the word ids of each whole text (bytes of one place side by side), in place of the text."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("binary")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            if not len(batch):
                yield pa.array([], pa.binary())
                continue
            lengths, ids = sent.value.encode(batch)
            ids = (ids + 1).astype(sent.value.id_type)
            ends = np.cumsum(lengths)
            yield pa.array([_planes(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], pa.binary())

    return docs.select(*[c for c in docs.columns if c != text], run(F.col(text)).alias(name))


def _decoded(model: Model, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, place in its text, and the number of tokens of each text) of all tokens."""
    parts = [_unplanes(r, model.id_type) for r in ids.to_pylist()]
    lengths = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate(parts).astype(np.int64) - 1
    return flat, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths), lengths


def scores(spark: SparkSession, model: Model, ids: Column) -> Column:
    """struct<n_tokens, n_known, base_score, score> of each text, given by its ids."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{SCORES.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        shared.claim("ngram_trie")
        order = len(model.levels) + 1
        for batch in texts:
            if not len(batch):
                yield pa.array([], pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))
                continue
            ids, place, lengths = _decoded(model, batch)
            few, back = np.unique(ids, return_inverse=True)
            counts = np.zeros(len(few), np.int64)
            counts[few >= 0] = model.word_counts(few[few >= 0])
            counts = counts[back]
            steps, _ = model.steps(ids, counts, place, order)
            heads = np.cumsum(lengths) - lengths
            base = np.add.reduceat(np.log10(model.p1(counts)), heads)
            known = np.add.reduceat((counts > 0).astype(np.int64), heads)
            score = np.add.reduceat(steps, heads) * -STEP
            yield pa.StructArray.from_arrays([pa.array(lengths), pa.array(known), pa.array(base), pa.array(score)], ["n_tokens", "n_known", "base_score", "score"])

    return run(ids)


def score(docs: DataFrame, learn: Column, text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, discount: float = DISCOUNT, segment_tokens: int = SEGMENT_TOKENS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score (log10), by a model of the rows that ``learn`` admits.

    Null and empty texts hold the end token alone. Columns that have the new names give way; rows
    that repeat are each scored (and each learned from). Without a row to learn from no word is known and
    the one word that could be, the unknown one, has probability one: scores are 0. The columns of docs that are
    returned (``keep``, or all) are written once more, beside the ids of the texts.
    """
    spark = docs.sparkSession
    shared.arrow_batches(spark)
    new = ["n_tokens", "n_known", "base_score", "score"]
    own = {c: f"c{i}" for i, c in enumerate(c for c in keep or docs.columns if c not in (*new, "train_tokens"))}  # the caller's columns under names of ours until the end
    model = Model(shared.fresh_path(spark, "ngram-trie"), min_count=min_count, discount=discount)
    model = _build_words(docs.filter(learn).select(F.col(text).alias("text")), model)
    rows = docs.select(*[F.col(c).alias(n) for c, n in own.items()], learn.alias("learn"), F.col(text).alias("text"))
    rows = shared.written(encoded(spark, model, rows, "text"), "ngram-ids", codec="zstd")
    model = _build_levels(spark, model, rows.filter("learn").select("ids"), order, segment_tokens)
    out = rows.withColumn("s", scores(spark, model, F.col("ids")))
    return out.select(*[F.col(n).alias(c) for c, n in own.items()], F.lit(model.tokens).cast("long").alias("train_tokens"), *[F.col(f"s.{n}").alias(n) for n in new])
