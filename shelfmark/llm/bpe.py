"""Byte-level BPE encoding and decoding by speculate and verify.

Words (the vocabulary's own split of a text) are proposed as greedy longest matches.  For every two
adjacent tokens one vectorised test decides whether merging in rank order could produce them side
by side; a word all of whose pairs are compatible has its exact encoding already.  Only words with
a failing pair are merged exactly, by a heap of candidate merges.

Two tokens are compatible when no merge across their boundary comes before the merges that made
them.  The test undoes the later-made of the two, again and again, and looks each time for a merge
across the boundary that would have come first.

The vocabulary file is read on the driver and broadcast (MAX_VOCABULARY bytes at most), so workers
need no local copy.

Cases with a defined result
    null or empty text: no ids; the digests are those of the empty string
    very long text or word: merging is n log n; words over units.CACHE_BYTES are not kept
    special tokens written out in a text: encoded as their ids, as the library does
    repeated rows and ids, nulls in other columns: each row is encoded on its own
    equal merge ranks in a word: the leftmost first; extra columns, whatever their names: not read
    empty table: an empty result
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import ship
from .units import PATTERN, Runs, UnitEncoder, as_runs

MAX_VOCABULARY = 64 << 20
#: Words up to this many bytes are merged by plain search, longer ones with a heap.
SHORT = 24
_NONE = np.int64(1) << 40
_PACK = struct.Struct("<I").pack


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level vocabulary.  Tokens are numbered by rank here: 256 bytes, then merges in order."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        pre, model = j["pre_tokenizer"], j["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or j["normalizer"] or model["unk_token"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        to_byte, vocab = byte_alphabet(), model["vocab"]
        text = {c: bytes([b]) for c, b in to_byte.items()}
        symbols = [c for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        n = 256 + len(model["merges"])
        left, right = np.arange(n), np.arange(n)
        rank = {c: r for r, c in enumerate(symbols)}
        for k, (a, b) in enumerate(model["merges"]):
            left[256 + k], right[256 + k] = rank[a], rank[b]
            if a + b not in rank:
                rank[a + b] = 256 + k
                text[a + b] = text[a] + text[b]
            symbols.append(a + b)
        self.left, self.right = left, right
        self.data = [text[s] for s in symbols]
        self.ids = np.array([vocab[s] for s in symbols])
        self.rank_of = {text[s]: r for s, r in rank.items()}
        codes = left[256:] << 20 | right[256:]
        order = np.argsort(codes, kind="stable")
        self.codes, self.made = codes[order], (np.arange(256, n))[order]
        self.merge = {(int(a), int(b)): 256 + k for k, (a, b) in reversed(list(enumerate(zip(left[256:], right[256:], strict=True))))}
        longest = [1] * 256
        for d in self.rank_of:
            longest[d[0]] = max(longest[d[0]], len(d))
        self.longest = longest
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.by_id = dict(zip(self.ids.tolist(), self.data, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        # tokens that merging their own bytes does not give back are never proposed unchecked
        self.whole = np.ones(n, dtype=bool)
        first, second = left[256:], right[256:]
        self.whole[256:] = self.compatible(first, second, within=np.arange(256, n))
        self.split = regex.compile(PATTERN)
        self.on_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.units = UnitEncoder(self.learn_units, self.encode_texts, tuple(self.special))
        self.exactly_merged = 0

    def across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each a with its b; _NONE where there is none."""
        code = a << 20 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.made[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """Whether merging a's and b's bytes together leaves a beside b; with ``within``, whether
        nothing but the merge of that rank happens across the boundary."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        limit = np.full(len(a), _NONE, dtype=np.int64) if within is None else within.astype(np.int64)
        while len(open_):
            clash = self.across(a, b) < limit
            good[open_[clash]] = False
            # undo the later merge: on the left it precedes a like merge across, on the right it follows
            can_a, can_b = a >= 256, b >= 256
            undo_a = can_a & (~can_b | (a > b))
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            on = ~clash & (undo_a | undo_b)
            a, b, limit, open_ = a[on], b[on], limit[on], open_[on]
        return good

    def propose(self, word: bytes) -> list[int]:
        out, at, end, rank_of = [], 0, len(word), self.rank_of
        while at < end:
            n = min(self.longest[word[at]], end - at)
            while n > 1 and word[at : at + n] not in rank_of:
                n -= 1
            out.append(rank_of[word[at : at + n]])
            at += n
        return out

    def merge_exactly(self, word: bytes) -> list[int]:
        """Merges in rank order, leftmost first among equals."""
        self.exactly_merged += 1
        merge, none = self.merge, 1 << 40
        if len(word) <= SHORT:
            token = list(word)
            ranks = [merge.get(p, none) for p in pairwise(token)]
            while ranks and (r := min(ranks)) < none:
                i = ranks.index(r)
                token[i : i + 2] = [r]
                del ranks[i]
                if i:
                    ranks[i - 1] = merge.get((token[i - 1], r), none)
                if i < len(ranks):
                    ranks[i] = merge.get((r, token[i + 1]), none)
            return token
        token, after = list(word), [*range(1, len(word)), -1]
        before = list(range(-1, len(word) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(pairwise(token)) if (r := self.merge.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j < 0 or token[j] != b:
                continue
            token[i], token[j] = r, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := self.merge.get((r, token[k]))) is not None:
                    heapq.heappush(heap, (m, i, r, token[k]))
            if (h := before[i]) >= 0 and (m := self.merge.get((token[h], r))) is not None:
                heapq.heappush(heap, (m, h, token[h], r))
        return [t for t in token if t >= 0]

    def learn(self, words: list[str]) -> list[bytes]:
        """Encodings of distinct words: proposed one by one, verified all at once."""
        if not words:
            return []
        data = [w.encode() for w in words]
        proposed = [self.propose(d) for d in data]
        size = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(size.sum()))
        of = np.repeat(np.arange(len(words)), size)
        failing = np.zeros(len(words), dtype=bool)
        failing[of[~self.whole[flat]]] = True
        inner = of[:-1] == of[1:]
        a, b = flat[:-1][inner], flat[1:][inner]
        pairs, back = np.unique(a << 20 | b, return_inverse=True)
        good = self.compatible(pairs >> 20, pairs & 0xFFFFF)
        failing[of[1:][inner][~good[back]]] = True
        for k in np.flatnonzero(failing).tolist():
            proposed[k] = self.merge_exactly(data[k])
        size = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter(chain.from_iterable(proposed), dtype=np.int64, count=int(size.sum()))
        raw, ends = self.ids[flat].astype("<u4").tobytes(), (4 * np.cumsum(size)).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn_units(self, units: pa.Array) -> Runs:
        """Encodings of units, each as it stands after a space; one of letters alone is one word."""
        find = self.split.findall
        split = [[" " + u] if u.isalpha() else find(" " + u) for u in units.to_pylist()]
        words = list(dict.fromkeys(chain.from_iterable(split)))
        known = dict(zip(words, self.learn(words), strict=True))
        return as_runs([b"".join(map(known.__getitem__, w)) for w in split])

    def encode_texts(self, texts: list[str]) -> Runs:
        """The ids of whole texts, special tokens among them."""
        find, special = self.split.findall, self.special
        parts = [[p for p in (self.on_special.split(t) if self.on_special else [t]) if p] for t in texts]
        split = [[[p] if p in special else find(p) for p in ps] for ps in parts]
        new = list({w for ws in split for w in chain.from_iterable(ws) if w not in special})
        known = dict(zip(new, self.learn(new), strict=True)) | {s: _PACK(i) for s, i in special.items()}
        return as_runs([b"".join(map(known.__getitem__, chain.from_iterable(ws))) for ws in split])

    def encode_batch(self, texts: pa.Array | list[str]) -> Iterator[list[int]]:
        for ids in self.units.each(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            yield ids.tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        spec = f.read(MAX_VOCABULARY + 1)
    if len(spec) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return spec


_loaded: dict[str, Bpe] = {}


def _model(spec: str) -> Bpe:
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; ``vocabulary`` is the path of the JSON file."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(spec.value)
        for batch in batches:
            ids = bpe.encode_batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(ids), type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(per_task, _with_id(docs, id_col, "ids array<int>"))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of the ids that encode() gave."""
    ship(encoded.sparkSession)
    spec = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(spec.value)
        for batch in batches:
            texts = [bpe.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(per_task, _with_id(encoded, "doc_id", "text string"))


def round_trip_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ship(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(spec.value)
        sha, digits = hashlib.sha256, {i: str(i) for i in bpe.by_id}
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode_batch(batch.column(1)):
                n.append(len(ids))
                a.append(sha(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                b.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, type=pa.int64()), pa.array(a, type=pa.string()), pa.array(b, type=pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = _with_id(docs, id_col, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(per_task, schema)


def _with_id(df: DataFrame, id_col: str, rest: str) -> str:
    return f"doc_id {df.select(F.col(id_col)).schema[0].dataType.simpleString()}, {rest}"
