"""Quality rules: fixed counts, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over the trusted target
(documents labelled good), one over the whole raw corpus.  A document's score is its mean
``log(p_target / p_raw)`` over all its n-grams, and one threshold decides for every document.

Cases with a defined result
    null or empty text: no words, so the base rule fails it; score 0
    fewer bytes than an n-gram: score 0
    null or repeated ids: each row is scored on its own text
    very long text: read whole; repeated rows: judged and counted each
    a score that equals the threshold: kept
    empty table: an empty result
    no trusted rows at all: every ratio is 0, so the base rule decides alone
    extra columns, whatever their names: passed through by ``filter_documents``
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import positional, ship

#: Hash buckets of both multinomials; the counts that reach the driver are this many rows.
N_BUCKETS = 1 << 15
#: Bytes in an n-gram.
NGRAM = 4
#: Weight of the raw corpus in the target's estimate, as a share of the target's n-grams.
PRIOR = 0.02
#: Documents whose mean log ratio is below this are dropped.
THRESHOLD = -0.35
#: Trusted rows used at most (lowest hash of the id first): the bound of what is broadcast.
MAX_TRUSTED = 20_000
#: Base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_STEP = 1 << 20

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def ngram_buckets(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of ``data``, a bounded slice at a time."""
    for start in range(0, max(0, len(data) - NGRAM + 1), _STEP):
        b = np.frombuffer(data[start : start + _STEP + NGRAM - 1], dtype=np.uint8).astype(np.uint32)
        n = len(b) - NGRAM + 1
        h = np.zeros(n, dtype=np.uint32)
        for k in range(NGRAM):
            h = h * np.uint32(0x01000193) + b[k : k + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        yield h >> np.uint32(32 - N_BUCKETS.bit_length() + 1)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    pair = np.unique(a[:-1] * len(ids) + a[1:], return_inverse=True)[1]
    _, back, counts = np.unique(pair[:-1] * len(ids) + a[2:], return_inverse=True, return_counts=True)
    hit = counts[back] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : k + n] |= hit
    return int(covered.sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    words = data.split()  # bytes split at exactly the six blanks
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def count_ngrams(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target) over every whole text; ``trusted`` holds ids, MAX_TRUSTED at most."""
    ship(docs.sparkSession)
    ids = (
        trusted.select(F.col(id_col).alias("_trusted")).where("_trusted is not null").distinct()
        .orderBy(F.xxhash64("_trusted"), "_trusted").limit(MAX_TRUSTED)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(ids), F.col("_id") == F.col("_trusted"), "left").select("_text", F.col("_trusted").isNotNull().alias("_good"))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(N_BUCKETS, np.int64), np.zeros(N_BUCKETS, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h in ngram_buckets((text or "").encode()):
                    n = np.bincount(h, minlength=N_BUCKETS)
                    raw += n
                    if good:
                        target += n
        k = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(raw[k]), pa.array(target[k])], names=["bucket", "raw", "target"])

    found = rows.mapInArrow(per_task, "bucket int, raw long, target long")
    return found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_weights(counts: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) by bucket, from N_BUCKETS rows at most."""
    raw, target = np.zeros(N_BUCKETS), np.zeros(N_BUCKETS)
    for r in counts.collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(N_BUCKETS)
    p_raw = (raw + 1) / (raw.sum() + N_BUCKETS)
    strength = max(1.0, PRIOR * target.sum())
    return np.log((target + strength * p_raw) / (target.sum() + strength)) - np.log(p_raw)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds COLUMNS to the columns named in ``carry`` (all of ``docs`` when None)."""
    carry = docs.columns if carry is None else carry
    keep = docs.select(*carry).schema
    ship(docs.sparkSession)
    w = docs.sparkSession.sparkContext.broadcast(weights)
    at = len(carry)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                text = text or ""
                data = text.encode()
                n_words, chars, symbols, dups, repeats = base_counts(text, data)
                total, n = 0.0, 0
                for h in ngram_buckets(data):
                    total += float(w.value[h].sum())
                    n += len(h)
                llr = total / n if n else 0.0
                failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
                rows.append((n_words, chars, symbols, dups, repeats, llr, failed, not failed and llr >= threshold))
            types = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            cols = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
            names = [f"c{i}" for i in range(at + len(cols))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), *cols], names=names)

    # columns go by position, so names that clash with ours do no harm inside the task
    inside = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs[text_col].alias(f"c{at}"))
    added = [x.split() for x in COLUMNS.split(", ")]
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(keep.fields)), *(f"c{at + i} {t}" for i, (_, t) in enumerate(added))])
    return inside.mapInArrow(per_task, schema).toDF(*carry, *(n for n, _ in added))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    trusted = labels.where("quality = 1").select("doc_id")
    return fit_weights(count_ngrams(docs, trusted))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    rows, at, back = positional(docs)
    return back(score(rows, fit(docs, labels), text_col=at["text"]).where("kept"))
