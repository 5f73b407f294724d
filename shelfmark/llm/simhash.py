"""SimHash near-dedup over a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight positional bytes.  Two fingerprints within MAX_BITS = 2 bits differ
in two bytes at most, so they share six or more positional bytes.  Lists of single bytes would grow
with the corpus, so a posting list is kept for each value of four positional bytes, for the
fourteen LISTED sets of four places whose numbers XOR to zero.  Any three places lie together in
exactly one such set, so two fingerprints that share

    8, 7 or 6 positional bytes   meet in 14, 7 or 3 lists,
    5 or fewer                   meet in one list at most.

The lists in which a pair meets are tallied over all lists, which gives its shared positional bytes;
pairs below the guaranteed minimum of MIN_LISTS = 3 lists are dropped, and the rest is verified by
the bits of their XOR.

A posting list longer than MAX_POSTING is not expanded into pairs.  Its fingerprints take an exact
linear way: two fingerprints are within 2 bits exactly when some value is within 1 bit of both, so
each is listed under itself and its 64 one-bit neighbours, and the (65 at most) fingerprints of
a value are linked to the least of them.  A link that the tally misses has both ends in a long
list, so no link is lost.

Everything from the postings on works on distinct fingerprints: copies, however many, are one.

Cases with a defined result
    null, empty or blank text: no words, fingerprint zero, linked like any other
    fewer than three words: the whole word sequence is the one shingle
    very long text: read whole, its shingles hashed a bounded slice at a time
    null id: takes part, but is a component's id only if all its ids are null
    repeated rows and ids: each row gets its own result row; ``keep_one`` keeps the text of the least id,
        of several texts with that id the one with the least fingerprint, then hash; equal rows stay together
    a fingerprint bit set in exactly half the shingles: 0
    extra columns, whatever their names: not read, kept by ``keep_one``
    empty table: an empty result
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, positional, ship
from .components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Sets of four places, one posting list for each value of their bytes.
LISTED = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Lists in which a pair that shares 8 - MAX_BITS positional bytes meets at least.
MIN_LISTS = 3
#: Longer posting lists take the linear way.
MAX_POSTING = 64
_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words, n = [b" ".join(words)], 1
        shingles = iter(words)
    else:
        n = len(words) - SHINGLE + 1
        shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, _SLICE):
        m = min(_SLICE, n - start)
        h = np.fromiter((digest(s, SEED) for s, _ in zip(shingles, range(m), strict=False)), dtype=">u8", count=m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, h) of every whole text; h is a hash of the text itself."""
    ship(docs.sparkSession)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one text at a time, so that a batch is never in memory twice
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(2)), dtype=np.int64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(1)], names=["doc_id", "fp", "h"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    return rows.mapInArrow(per_task, "doc_id long, fp long, h long")


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, fp): the fingerprint under its four bytes of each listed set, with the set's number."""
    byte = [f"(shiftrightunsigned(fp, {8 * k}) & 255)" for k in range(8)]
    keys = (f"({n}L << 32 | {byte[a]} << 24 | {byte[b]} << 16 | {byte[c]} << 8 | {byte[d]})" for n, (a, b, c, d) in enumerate(LISTED))
    return nodes.selectExpr(f"explode(array({', '.join(keys)})) AS key", "fp")


def links(nodes: DataFrame, scratch: Scratch, max_posting: int = MAX_POSTING) -> DataFrame:
    """Edges (u, v) among the distinct fingerprints ``nodes.fp``, with the components of all links
    of MAX_BITS or fewer bits."""
    postings = _postings(nodes)
    sizes = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "k")
    met = scratch.cut(postings.join(sizes, F.col("key") == F.col("k")).select("key", "fp", "n"), "postings")

    short = met.where(F.col("n") <= max_posting).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("list"))
    pairs = short.selectExpr("explode(list) AS u", "list").selectExpr("u", "explode(filter(list, v -> v > u)) AS v")
    tally = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") >= MIN_LISTS)
    near = tally.where(f"bit_count(u ^ v) <= {MAX_BITS}").select("u", "v")

    # the linear way for what lies in a long list
    long = met.where(F.col("n") > max_posting).select("fp").distinct()
    ball = long.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))) AS value")
    least = ball.groupBy("value").agg(F.collect_list("fp").alias("list")).where("size(list) > 1")  # 65 at most
    stars = least.selectExpr("explode(list) AS u", "array_min(list) AS v").where("u <> v").distinct()
    return near.unionByName(stars)


def _classes(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, h) of every row, and of every distinct fingerprint its component: the least id, and the
    text (keep_fp, keep_h) that stays for it."""
    rows = scratch.cut(fingerprints(docs, id_col, text_col), "fingerprints")
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    nodes = rows.groupBy("fp").agg(F.min(F.struct(last.alias("at"), F.col("doc_id").alias("id"), "h")).alias("first"))
    nodes = scratch.cut(nodes.select("fp", "first.*"), "distinct")
    labels = scratch.cut(components(links(nodes, scratch), scratch), "labels")
    linked = nodes.join(labels, F.col("fp") == F.col("vertex"), "left").select("fp", "at", "id", "h", F.coalesce("label", "fp").alias("label"))
    first = linked.groupBy("label").agg(F.min(F.struct("at", "fp", "h", "id")).alias("b"))
    first = first.select(F.col("label").alias("l"), F.col("b.id").alias("component_id"), F.col("b.fp").alias("keep_fp"), F.col("b.h").alias("keep_h"))
    classes = linked.join(first, F.col("label") == F.col("l")).select("fp", "component_id", "keep_fp", "keep_h")
    return rows, scratch.cut(classes, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest reachable id."""
    rows, classes = _classes(docs, id_col, text_col, scratch or Scratch(docs.sparkSession, "simhash"))
    # a plain join with exchanges on both sides: a fingerprint of very many rows is split
    return rows.join(classes.withColumnRenamed("fp", "f"), F.col("fp") == F.col("f")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays (the smallest id), with its own columns."""
    _, classes = _classes(docs, "doc_id", "text", Scratch(docs.sparkSession, "simhash"))
    kept = classes.where("fp = keep_fp").select(F.col("component_id").alias("_keep"), F.col("keep_h").alias("_h"))
    rows, at, back = positional(docs)
    # the text is part of the key, so rows that share an id but not a text are told apart
    on = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_keep")) & (F.xxhash64(at["text"]) == F.col("_h"))
    return back(rows.join(kept, on, "left_semi"))
