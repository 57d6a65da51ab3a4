"""Encoding of whole texts with a public tokenizer file, memoised by blank-delimited piece.

A byte-level BPE cuts a text into pretokens before it merges bytes, and always cuts in front of
a blank that follows a non-blank. A text can therefore be cut there first: the ids of the text
are the ids of its pieces, one after the other. Pieces recur far more often than texts, so a worker
encodes each distinct piece once with the ``tokenizers`` library and joins the stored ids. Texts
with runs of white space or special strings are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import shared

#: The tokenizer file that the queries use; any byte-level BPE of the library works.
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Pieces held by one Python worker before those that did not recur are let go: bounds its memory (about 35 MB).
MEMO_PIECES = 1_000_000
#: Longer pieces (in bytes) seldom recur: they are encoded but not held.
MEMO_BYTES = 32
#: The characters that the pretokenizer takes for white space.
_SPACES = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def default_path() -> str:
    """Where the default tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


#: Parts whose ids are gathered at once.
GATHER = 1 << 17
#: Random words for the hash of a part, by place and byte; drawn from a fixed seed, so that a run can be repeated.
_TABLE = np.random.default_rng(20).integers(0, 1 << 64, (MEMO_BYTES, 256), dtype=np.uint64, endpoint=False).ravel()


def hashes(parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each part, whether it is short enough to be held).

    Tabulation hashing: two parts of at most MEMO_BYTES bytes share a hash with probability 2**-64 over the table.
    """
    offsets = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    raw = np.frombuffer(parts.buffers()[2], np.uint8) if parts.buffers()[2] else np.zeros(0, np.uint8)
    n = np.diff(offsets)
    short, keys = n <= MEMO_BYTES, np.full(len(parts), len(_TABLE), np.uint64)
    some = np.nonzero(short & (n > 0))[0]
    size = n[some]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    words = _TABLE[place * 256 + raw[place + np.repeat(offsets[some], size)]]
    if len(some):
        keys[some] = np.add.reduceat(words, np.cumsum(size) - size) + size.astype(np.uint64)
    return keys, short


class Memo:
    """hash of a part -> its ids, in sorted arrays: some 25 bytes an entry."""

    def __init__(self, dtype: np.dtype):
        self.keys, self.start = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.count, self.again = np.zeros(0, np.uint8), np.zeros(0, bool)
        self.ids = np.zeros(0, dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start in ids, count or -1) of each key."""
        start, count = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            there = self.keys[at] == keys
            at = at[there]
            start[there], count[there] = self.start[at], self.count[at]
            self.again[at] = True
        return start, count

    def add(self, keys: np.ndarray, ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        """New keys with their part of ``ids``; starts found before stay good."""
        order = np.argsort(keys)
        keys, start, count = keys[order], start[order], count[order]
        where = np.repeat(start, count) + _steps(count)
        place = np.searchsorted(self.keys, keys)
        begin = len(self.ids) + np.cumsum(count) - count
        self.keys = np.insert(self.keys, place, keys)
        self.start = np.insert(self.start, place, begin.astype(np.uint32))
        self.count = np.insert(self.count, place, count.astype(np.uint8))
        self.again = np.insert(self.again, place, False)
        self.ids = np.concatenate([self.ids, ids[where]])

    def trim(self) -> None:
        """Make room."""
        if len(self.keys) <= MEMO_PIECES:
            return
        keep = np.nonzero(self.again)[0] if self.again.sum() <= MEMO_PIECES // 2 else np.zeros(0, np.int64)
        n = self.count[keep].astype(np.int64)
        self.ids = self.ids[np.repeat(self.start[keep].astype(np.int64), n) + _steps(n)]
        self.keys, self.count = self.keys[keep], self.count[keep]
        self.start, self.again = (np.cumsum(n) - n).astype(np.uint32), np.zeros(len(keep), bool)


def _steps(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Encoder:
    """Ids of whole texts as little-endian unsigned integers, ``width`` bytes each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            raw = f.read()
        self.digest = hashlib.sha256(raw).hexdigest()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # the memo stands in for it
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.width = self.dtype.itemsize
        spec = json.loads(raw)
        pre = spec.get("pre_tokenizer") or {}
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        #: Only this shape is known to cut in front of every blank that follows a non-blank.
        self.by_piece = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and spec["model"].get("type") == "BPE"
            and not spec["model"].get("dropout")
            and not any(c.isspace() for s in self.specials for c in s)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        )
        self.lengths = None
        if self.by_piece:
            self.lengths = np.zeros(size, np.int64)
            for token, i in self.tok.get_vocab(with_added_tokens=False).items():
                self.lengths[i] = len(token)  # one character stands for one byte
            self.memo = Memo(self.dtype)
            #: A text with a blank after white space, or a special string, is encoded whole.
            self.not_by_piece = "|".join([f"[{_SPACES}] ", *map(re.escape, self.specials)])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of " " + part for each of some distinct parts, one after the other; how many each has): they are encoded in long joins, and cut apart by their bytes."""
        ids, counts = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        runs = [parts[at : at + 2048] for at in range(0, len(parts), 2048)]
        for run, e in zip(runs, self.tok.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, self.dtype))
            cuts = np.cumsum([len(p) + 1 for p in map(str.encode, run)])
            counts.append(np.diff(np.searchsorted(np.cumsum(self.lengths[ids[-1]]), cuts) + 1, prepend=0))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; how many each has). Null counts as empty; special strings are handled as the library's default does."""
        shared.claim("tokenize")
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if self.by_piece:
            self.memo.trim()
        else:
            raw = self._whole(texts.to_pylist())
            return np.frombuffer(b"".join(raw), self.dtype), np.array([len(r) // self.width for r in raw], np.int64)
        whole = pc.match_substring_regex(texts, self.not_by_piece)
        lists = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        coded = lists.flatten().dictionary_encode()
        parts, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        per = lists.value_lengths().to_numpy().astype(np.int64)
        first = np.cumsum(per) - per
        # a text's first part has no blank before it; of a text that is encoded whole it stands for all
        heads = parts.take(pa.array(code[first])).to_pylist()
        for i in np.nonzero(whole.to_numpy(zero_copy_only=False))[0].tolist():
            heads[i] = texts[i].as_py()
        heads = self._whole(heads)
        keys, short = hashes(parts)
        start, count = self.memo.find(keys)
        new = np.nonzero((count < 0) | ~short)[0]
        ids, n = self._learn(parts.take(pa.array(new)).to_pylist())
        at = np.cumsum(n) - n
        hold = short[new]
        self.memo.add(keys[new[hold]], ids, at[hold], n[hold])
        held = self.memo.ids
        start[new], count[new] = len(held) + at, n
        head_n = np.array([len(h) // self.width for h in heads], np.int64)
        start = np.concatenate([start, len(held) + len(ids) + np.cumsum(head_n) - head_n])
        count = np.concatenate([count, head_n])
        source = np.concatenate([held, ids, np.frombuffer(b"".join(heads), self.dtype)])
        code[first] = len(parts) + np.arange(len(first))
        n = count[code]
        out = [np.zeros(0, self.dtype)]
        for a in range(0, len(code), GATHER):  # a few at a time: places take eight bytes an id
            c = code[a : a + GATHER]
            k = count[c]
            ends = np.cumsum(k)
            out.append(source[np.arange(ends[-1]) + np.repeat(start[c] - (ends - k), k)])
        return np.concatenate(out), np.add.reduceat(n, first)

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as bytes."""
        ids, n = self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw, ends = ids.tobytes(), (np.cumsum(n) * self.width).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


_encoders: dict[str, Encoder] = {}
shared.holds("tokenize", _encoders.clear)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: its version, wherever the file lies."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
