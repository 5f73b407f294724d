"""Periodic runs of words, found by block matching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at
least max(24, 3 * q) words, that no neighbouring word extends.  For a scale B (8, 16, 32, ...) the text
is cut into aligned blocks of B words.  A run whose period is of that scale is longer than two blocks
and a period, so an aligned block of it occurs again one period further on.  The blocks are the keys of
a pyahocorasick automaton over word numbers; the text is searched for them, and an occurrence at a
distance of the scale (1 to 15 at scale 8, B to 2B - 1 above) seeds an extension to both sides.

Three things keep this near linear in the text:

* a block goes into the automaton only if each of its eight-word windows occurs again within the
  scale's distances (a block that occurs again has that), and is not inside a run of smaller period;
* a seed inside a run of smaller period is passed over: its own period is then a multiple of that one;
* all seeds of a scale are extended together, by doubling steps over hashes; what comes out is compared
  word by word, and extended word by word if the hashes were wrong.

Cases with a defined result
    null or empty text, or fewer than 24 words: no run; the collapsed text is the words joined by spaces
    ties of the strongest run: smallest start, then smallest period; overlapping runs: each is reported
    null or repeated ids, repeated rows: each row by its own text; very long text: read whole, in one task
    empty table: an empty result; extra columns, whatever their names: passed through
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import positional, ship

#: Words in a run, and periods in a run, at least.
MIN_WORDS, MIN_PERIODS = 24, 3
#: The smallest block.
LEAST = 8
#: Words in the blocks of one automaton; a longer block has one of its own.
KEY_WORDS = 1 << 20
_P = np.uint64((1 << 31) - 1)
_BASE = 1_234_567_891

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


class _Hashes:
    """Hashes of all stretches of a text, by prefix sums of ``code * base ** place``."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.power = np.ones(n + 1, np.uint64)
        have, step = 1, np.uint64(_BASE)
        while have <= n:  # the powers so far, times base ** have
            more = min(have, n + 1 - have)
            self.power[have : have + more] = self.power[:more] * step % _P
            have, step = have + more, step * step % _P
        self.sums = np.zeros(n + 1, np.uint64)
        # each term is below 2 ** 31, so the sum of 2 ** 32 words stays below 2 ** 63
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) % _P * self.power[:n] % _P, out=self.sums[1:])

    def same(self, i: np.ndarray, d: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether the k words from i and those from i + d have one hash."""
        a = (self.sums[i + k] - self.sums[i]) % _P * self.power[d] % _P
        return a == (self.sums[i + d + k] - self.sums[i + d]) % _P


def _reach(limit: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The greatest k up to ``limit`` with ``same(k)``, which holds up to some k and not beyond."""
    low = np.zeros(len(limit), np.int64)
    step = 1 << max(0, int(limit.max(initial=0)).bit_length() - 1)
    while step:
        k = low + step
        fits = np.flatnonzero(k <= limit)
        fits = fits[same(k, fits)]
        low[fits] = k[fits]
        step >>= 1
    return low


def _next_window(codes: np.ndarray) -> np.ndarray:
    """Distance from each eight-word window to its next occurrence; a great number if there is none.
    Windows count as equal if their hashes are, which loses none."""
    n = len(codes) - LEAST + 1
    h = codes.astype(np.uint64)
    for width in (1, 2, 4):
        h = (h[:-width] * np.uint64(0x9E3779B97F4A7C15) ^ h[:-width] >> np.uint64(29)) + h[width:] * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(h, kind="stable")
    out = np.full(n, 1 << 60, np.int64)
    alike = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    out[order[alike]] = order[alike + 1] - order[alike]
    return out


def _seeds(codes: np.ndarray, starts: np.ndarray, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of a block, distance) of the blocks' occurrences at ``low`` to ``high`` words further on."""
    n, at, by = len(codes), [], []
    group = max(1, KEY_WORDS // block)
    for g in range(0, len(starts), group):
        part = starts[g : g + group]
        keys: dict[tuple[int, ...], int] = {}
        key_of = {int(s): keys.setdefault(tuple(codes[s : s + block].tolist()), len(keys)) for s in part}
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, number in keys.items():
            machine.add_word(key, number)
        machine.make_automaton()
        # stretches that an occurrence of one of these blocks can lie in
        begins, ends = part + low, np.minimum(part + high + block, n)
        new = np.flatnonzero(np.concatenate([[True], begins[1:] > ends[:-1]]))
        for begin, end in zip(begins[new].tolist(), ends[np.append(new[1:], len(part)) - 1].tolist(), strict=True):
            for last, number in machine.iter(tuple(codes[begin:end].tolist())):
                p = begin + last - block + 1
                s = (p - low) // block * block
                while s >= 0 and p - s <= high:
                    if key_of.get(s) == number:
                        at.append(s)
                        by.append(p - s)
                    s -= block
    return np.array(at, np.int64), np.array(by, np.int64)


def _smaller_period(stretch: np.ndarray, d: int) -> bool:
    """Whether a stretch of three times ``d`` words or more has a period that divides ``d``."""
    rest, prime = d, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            q = d // prime
            if np.array_equal(stretch[:-q], stretch[q:]):
                return True
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return False


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, runs = len(codes), []
    if n < MIN_WORDS:
        return runs
    following = _next_window(codes)
    if following.min() > n:
        return runs
    hashes = None
    inside = np.zeros(n, np.int64)  # where the longest run of a smaller scale that covers a word ends
    block = LEAST
    while MIN_PERIODS * (low := 1 if block == LEAST else block) <= n:
        high = min(2 * block - 1, n // MIN_PERIODS)
        starts = np.arange(0, n - block - low + 1, block)
        worst = np.maximum.reduceat(following[: starts[-1] + block - LEAST + 1], np.column_stack([starts, np.minimum(starts + block - LEAST + 1, starts[-1] + block - LEAST)]).ravel())[::2]
        starts = starts[(worst <= high) & (inside[starts] < np.minimum(starts + high + block, n))]
        s, d = _seeds(codes, starts, block, low, high) if len(starts) else (starts, starts)
        open_ = inside[s] < s + d + block
        s, d = s[open_], d[open_]
        if len(s):
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            # the block before, found again at the same distance, lies in the same stretch
            first = np.concatenate([[True], (np.diff(d) != 0) | (np.diff(s) != block)])
            s, d = s[first], d[first]
            hashes = hashes or _Hashes(codes)
            e = s + block
            right = _reach(n - e - d, lambda k, x: hashes.same(e[x], d[x], k[x]))
            left = _reach(s, lambda k, x: hashes.same(s[x] - k[x], d[x], k[x]))
            length = block + left + right + d
            long = length >= np.maximum(MIN_WORDS, MIN_PERIODS * d)
            found = set()
            for a, m, q in sorted(set(zip((s - left)[long].tolist(), length[long].tolist(), d[long].tolist(), strict=True))):
                if not np.array_equal(codes[a : a + m - q], codes[a + q : a + m]):  # two hashes that clash
                    found |= _by_words(codes, q, block, s[long & (d == q)])
                elif not _smaller_period(codes[a : a + m], q):
                    found.add((a, m, q))
            runs += found
            for a, m, _ in found:
                np.maximum(inside[a : a + m], a + m, out=inside[a : a + m])
        block *= 2
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def _by_words(codes: np.ndarray, q: int, block: int, starts: np.ndarray) -> set[tuple[int, int, int]]:
    """The runs of period ``q`` around these blocks, compared word by word."""
    same, out = np.concatenate([[False], codes[:-q] == codes[q:], [False]]), set()
    unlike = np.flatnonzero(~same)
    for s in starts.tolist():
        k = np.searchsorted(unlike, s + 1)
        a, b = int(unlike[k - 1]), int(unlike[k]) - 1
        m = b - a + q
        if b >= s + block and m >= max(MIN_WORDS, MIN_PERIODS * q) and not _smaller_period(codes[a : a + m], q):
            out.add((a, m, q))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for a word that some run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for a, m, q in runs:
        depth[a + q] += 1
        depth[a + m] -= 1
    return np.cumsum(depth[:n]) == 0


def collapse(docs: DataFrame, text: Column | str = "text", edit: Callable[..., list[bytes]] | None = None, edit_with: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``_runs`` (every run of the words of ``text``) and ``_collapsed`` (the words kept,
    joined by one space) after its own columns.  ``edit(words, *values of the columns edit_with)`` may
    change the list of words first."""
    ship(docs.sparkSession)
    rows, at, _ = positional(docs)
    width = len(docs.columns)
    inside = rows.select("*", (F.col(at[text]) if isinstance(text, str) else text).alias("text"), *[F.col(at[c]).alias(f"with{i}") for i, c in enumerate(edit_with)])
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            values = [batch.column(width + 1 + i).to_pylist() for i in range(len(edit_with))]
            for k, t in enumerate(batch.column(width).to_pylist()):
                words = (t or "").encode().split()  # bytes split at exactly the six blanks
                if edit:
                    words = edit(words, *(v[k] for v in values))
                runs = find_runs(word_numbers(words)) if len(words) >= MIN_WORDS else []
                if runs:
                    keep = kept_words(len(words), runs)
                    words = [w for w, stays in zip(words, keep.tolist(), strict=True) if stays]
                found.append([{"start": a, "length": m, "period": q} for a, m, q in runs])
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(found, run_type), pa.array(texts, pa.string())], names=[*(f"c{i}" for i in range(width)), "runs", "collapsed"])

    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)), f"runs {RUN}", "collapsed string"])
    return inside.mapInArrow(per_task, schema).toDF(*docs.columns, "_runs", "_collapsed")


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's change to a tenth of the documents: the tail repeats itself, by the id's CRC."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def report(docs: DataFrame) -> DataFrame:
    """The figures and digests of each document's runs."""
    rows = collapse(docs.select("doc_id", "text"), edit=planted, edit_with=("doc_id",)).select("doc_id", "_runs", "_collapsed")
    # length / period is compared by cross products, which are exact
    better = "b.length * r.period > r.length * b.period OR (b.length * r.period = r.length * b.period AND (b.start < r.start OR (b.start = r.start AND b.period < r.period)))"
    best = F.expr(f"aggregate(_runs, element_at(_runs, 1), (r, b) -> IF({better}, b, r))")
    lines = F.expr("concat_ws('', transform(_runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return rows.withColumn("_best", F.when(F.size("_runs") > 0, best)).select(
        "doc_id", F.size("_runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("CAST(1000 * _best.length DIV _best.period AS BIGINT)").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode(F.col("_collapsed"), "UTF-8"), 256).alias("collapsed_sha256"),
    )
