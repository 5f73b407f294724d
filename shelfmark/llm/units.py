"""Texts cut at single spaces, with the encodings of the pieces kept from text to text.

Byte-level vocabularies never join a token across a space that follows a character other than white
space.  So ``a b c`` is encoded as ``a``, `` b`` and `` c``, each alone, and most pieces were seen
before.  A text with white space before a space, or with a special token, is encoded whole.

A group of texts is split, its distinct pieces are found and its ids are put together in Arrow and
numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces a generation of a cache holds, and the longest one it keeps.
CACHE_PIECES, CACHE_BYTES = 200_000, 48
#: Bytes of text in a group; a longer text is a group of its own.
GROUP_BYTES = 1 << 22
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space of any kind before a space, and at the end.
_ODD, _BLANK_END = _BLANK + " ", _BLANK + "$"


def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ids[start : start + size], one after the other."""
    # 32 bits do: a text has fewer bytes than that, and so fewer ids
    upto = np.cumsum(size, dtype=np.int32)
    pick = np.repeat((start - (upto - size)).astype(np.int32), size)
    pick += np.arange(len(pick), dtype=np.int32)
    return ids[pick]


@dataclass
class Encodings:
    """Pieces and their ids, one run after the other."""

    pieces: pa.Array
    ids: np.ndarray
    size: np.ndarray

    def __post_init__(self) -> None:
        self.start = np.cumsum(self.size) - self.size

    @classmethod
    def empty(cls) -> Encodings:
        return cls(pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int32))

    def find(self, pieces: pa.Array) -> np.ndarray:
        """Place of each of ``pieces``, -1 where it is not here."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy().astype(np.int64)

    def take(self, at: np.ndarray) -> Encodings:
        return Encodings(self.pieces.take(pa.array(at)), gather(self.ids, self.start[at], self.size[at]), self.size[at])

    def __add__(self, other: Encodings) -> Encodings:
        return Encodings(pa.concat_arrays([self.pieces, other.pieces]), np.concatenate([self.ids, other.ids]), np.concatenate([self.size, other.size]))


#: Ids of all of some texts, and how many each has.
Runs = tuple[np.ndarray, np.ndarray]


def as_runs(encoded: list[bytes]) -> Runs:
    """Runs from the bytes of each text's ids (little-endian, 32 bits)."""
    return np.frombuffer(b"".join(encoded), "<u4"), (np.fromiter(map(len, encoded), np.int64, len(encoded)) >> 2).astype(np.int32)


class UnitEncoder:
    """``encode_units`` takes distinct pieces, none of them empty or ending in white space, and gives the
    ids of each as it stands after a space; ``encode_texts`` does so for whole texts.

    The latest pieces are kept: when a generation is full, only what the next one meets again stays."""

    def __init__(self, encode_units: Callable[[pa.Array], Runs], encode_texts: Callable[[list[str]], Runs], special: tuple[str, ...] = (), pieces: int = CACHE_PIECES, group: int = GROUP_BYTES):
        self.encode_units, self.encode_texts = encode_units, encode_texts
        self.whole = "|".join([_ODD, *map(re.escape, special)])
        self.size, self.group = pieces, group
        self.now, self.before = Encodings.empty(), Encodings.empty()

    def _encodings(self, pieces: pa.Array) -> tuple[Encodings, np.ndarray]:
        """A table that has all of ``pieces``, and the place of each in it."""
        at = self.now.find(pieces)
        lacks = np.flatnonzero(at < 0)
        if not len(lacks):
            return self.now, at
        missing = pieces.take(pa.array(lacks))
        old = self.before.find(missing)
        again, new = self.before.take(old[old >= 0]), missing.filter(pa.array(old < 0))
        odd = pc.or_(pc.equal(pc.binary_length(new), 0), pc.match_substring_regex(new, _BLANK_END)).to_numpy(zero_copy_only=False)
        plain, rest = new.filter(pa.array(~odd)), new.filter(pa.array(odd))
        learnt = Encodings(plain, *self.encode_units(plain)) + Encodings(rest, *self.encode_texts([" " + p for p in rest.to_pylist()]))
        fresh = again + learnt
        table = self.now + fresh
        place = np.empty(len(missing), np.int64)
        place[old >= 0] = np.arange(len(again.pieces))
        place[np.flatnonzero(old < 0)[~odd]] = len(again.pieces) + np.arange(len(plain))
        place[np.flatnonzero(old < 0)[odd]] = len(again.pieces) + len(plain) + np.arange(len(rest))
        at[lacks] = len(self.now.pieces) + place
        kept = fresh.take(np.flatnonzero(pc.less_equal(pc.binary_length(fresh.pieces), CACHE_BYTES).to_numpy(zero_copy_only=False)))
        if len(self.now.pieces) + len(kept.pieces) > self.size:
            self.before, self.now = self.now, kept
        else:
            self.now = self.now + kept
        return table, at

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, self.whole)
        at_whole = whole.to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pc.invert(whole)), " ")
        offsets, values = lists.offsets.to_numpy(), lists.flatten()
        # the first piece of a text has no space before it
        first = values.take(pa.array(offsets[:-1])).dictionary_encode()
        pieces = values.dictionary_encode()
        table, at = self._encodings(pieces.dictionary)
        codes = at[pieces.indices.to_numpy()]
        n = len(table.size)
        codes[offsets[:-1]] = n + first.indices.to_numpy()
        # equal texts are encoded once here, as equal pieces are
        alike = texts.filter(whole).dictionary_encode()
        ids, size = self.encode_texts([*first.dictionary.to_pylist(), *alike.dictionary.to_pylist()])

        count = np.ones(len(texts), np.int64)
        count[~at_whole] = np.diff(offsets)
        ends = np.cumsum(count)
        order = np.empty(int(ends[-1]), np.int64)
        alone = np.zeros(len(order), bool)
        alone[(ends - count)[at_whole]] = True
        order[alone], order[~alone] = n + len(first.dictionary) + alike.indices.to_numpy(), codes

        size = np.concatenate([table.size, size])
        took = size[order]
        return gather(np.concatenate([table.ids, ids]), (np.cumsum(size) - size)[order], took), np.cumsum(took)[ends - 1]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of texts in order: the ids of all texts of a group, and where each text's end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        size = pc.binary_length(texts).to_numpy()
        start = n = 0
        for k, s in enumerate(size.tolist()):
            if n and n + s > self.group:
                yield self._group(texts.slice(start, k - start))
                start, n = k, 0
            n += s + 1
        if len(texts) > start:
            yield self._group(texts.slice(start))

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for ids, ends in self.encode(texts):
            yield from np.split(ids, ends[:-1])
