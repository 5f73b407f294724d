"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: row r holds words of 64 bits with one bit per
language.  An n-gram's N_HASHES rows, ANDed, give at once the set of all languages that contain it.
For a text the bits are counted per language over all its n-grams, each count is corrected by its
language's false-positive rate, and the largest decides.

Training counts the byte n-grams (3 to 5 bytes of lower-cased letters) of about PER_LANGUAGE
documents of each language, drawn by a hash of the id; an n-gram enters a language's filter when it
makes up MIN_SHARE of that language's n-grams or more, so a language adds 1 / MIN_SHARE at most.
What reaches the driver is the filter itself: ROWS rows at most for each 64 languages, however many
texts there are.

Cases with a defined result
    null text, or no letter in it: ``und``, score 0
    letters but no n-gram (one or two letters), or none known: the language of most training documents
    ties: the language that sorts first
    any number of languages: a filter row has a word for each 64
    very long text: read whole, _STEP bytes at a time
    null or repeated ids: each row is judged on its own text; null ids are never held out
    extra columns, whatever their names: not read
    no training rows: ``und`` for every text
    empty table: an empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import ship
from .quality_gam import held_out

SIZES = (3, 4, 5)
#: Documents of a language used for training, about.
PER_LANGUAGE = 5_000
MIN_SHARE = 1e-5
ROWS, N_HASHES = 1 << 20, 4
WORD_BITS = 64
_STEP = 1 << 18
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def ngrams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of all n-grams, a bounded slice at a time; words are set apart by one space."""
    data = (" " + _NOT_LETTERS.sub(" ", text.lower()) + " ").encode()
    for start in range(0, len(data), _STEP):
        b = np.frombuffer(data[start : start + _STEP + max(SIZES) - 1], dtype=np.uint8).astype(np.uint64)
        for size in SIZES:
            n = min(len(b) - size + 1, _STEP)
            if n <= 0:
                continue
            h = np.full(n, size, dtype=np.uint64)
            for k in range(size):
                h = (h << np.uint64(8)) | b[k : k + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            yield h ^ (h >> np.uint64(29))


def rows_of(h: np.ndarray) -> Iterator[np.ndarray]:
    """The filter rows of each n-gram, one array per hash function."""
    a, b = h >> np.uint64(40), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for k in range(N_HASHES):
        yield ((a + np.uint64(k) * b) & np.uint64(ROWS - 1)).astype(np.int64)


@dataclass
class Filters:
    """``masks`` has a row of ROWS words for each WORD_BITS languages."""

    languages: list[str]
    masks: np.ndarray
    common: int

    def __post_init__(self) -> None:
        one = np.uint64(1)
        fill = np.array([((self.masks[i // WORD_BITS] >> np.uint64(i % WORD_BITS)) & one).mean() for i in range(len(self.languages))])
        self.false_rate = np.minimum(fill**N_HASHES, 0.99)

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """How many n-grams of the text each language's filter has, and how many there are."""
        count, n = np.zeros(len(self.languages)), 0
        for h in ngrams(text):
            rows = list(rows_of(h))
            for word, masks in enumerate(self.masks):
                found = masks[rows[0]]
                for r in rows[1:]:
                    found = found & masks[r]
                for i in range(word * WORD_BITS, min((word + 1) * WORD_BITS, len(self.languages))):
                    count[i] += np.count_nonzero(found & np.uint64(1 << i % WORD_BITS))
            n += len(h)
        return count, n

    def judge(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        count, n = self.counts(text)
        true = np.maximum(0.0, (count - n * self.false_rate) / (1 - self.false_rate))
        best = int(true.argmax())
        if true[best] <= 0:
            return self.languages[self.common], 0.0
        second = max((true[i] for i in range(len(true)) if i != best), default=0.0)
        return self.languages[best], float(true[best] / (true[best] + second))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("_id"), docs[lang_col].alias("_lang"), docs[text_col].alias("_text"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").isNotNull() & ~held_out(F.col("_id")))
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy("_lang").collect()  # a row a language
    languages = [r["_lang"] for r in sizes]
    if not languages:
        return Filters([], np.zeros((0, ROWS), np.uint64), 0)
    # a literal, so that texts are not shuffled to meet it
    known = F.create_map(*[x for i, r in enumerate(sizes) for x in (F.lit(r["_lang"]), F.struct(F.lit(i).alias("number"), F.lit(min(1.0, PER_LANGUAGE / r["n"])).alias("share")))])
    rows = rows.withColumn("_k", known[F.col("_lang")]).select("*", "_k.number", "_k.share")
    drawn = F.pmod(F.xxhash64("_id", F.lit(4)), F.lit(1 << 30)) < F.col("share") * F.lit(float(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct n-grams of each language in a batch, with their numbers."""
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                by.setdefault(lang, []).extend(ngrams(text.as_py()))
            for lang, parts in by.items():
                if parts:
                    gram, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    grams = rows.where(drawn).select(F.col("number").alias("lang"), "_text").mapInArrow(count, "lang int, gram long, n long")
    grams = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = grams.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "l")  # a row a language
    kept = grams.join(F.broadcast(total), F.col("lang") == F.col("l")).where(F.col("n") >= F.lit(MIN_SHARE) * F.col("total"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).to_numpy()
            gram = batch.column(1).to_numpy().view(np.uint64)
            bit = np.left_shift(np.uint64(1), (lang % WORD_BITS).astype(np.uint64)).view(np.int64)
            for r in rows_of(gram):
                yield pa.RecordBatch.from_arrays([pa.array(lang // WORD_BITS), pa.array(r), pa.array(bit)], names=["word", "row", "mask"])

    placed = kept.select("lang", "gram").mapInArrow(place, "word int, row long, mask long").groupBy("word", "row").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((-(-len(languages) // WORD_BITS), ROWS), np.uint64)
    masks[placed["word"].to_numpy(np.int64), placed["row"].to_numpy(np.int64)] = placed["mask"].to_numpy(np.int64).view(np.uint64)
    return Filters(languages, masks, max(range(len(sizes)), key=lambda i: (sizes[i]["n"], -i)))


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    ship(docs.sparkSession)
    f = docs.sparkSession.sparkContext.broadcast(filters)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.value.judge(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(per_task, "doc_id long, held_out boolean, lang_pred string, score double")
