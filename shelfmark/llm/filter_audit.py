"""How filters interact: what each removes, alone and in every order, by part.

Each document fails some of the filters: a mask of bits.  Documents are counted by part and mask, which
is all that any order depends on.  A subset-zeta transform turns the counts of a part into the survivors
of every set of filters; a step of an order is the difference between two neighbouring sets.  The same
goes for the documents that a label marks.

After the count there are at most ``2 ** filters`` numbers a part, so orders cost nothing in documents.

Cases with a defined result
    null or empty text: no words, empty; it fails what an empty text fails
    null part: the part of the empty string
    repeated texts: all but those of the least id fail the filter on copies; rows that repeat id and text
        are one another's equals, so none of them is a copy of the other
    null id: neither smaller nor greater than another, so its row is no copy and makes none; it has no label
    a document with several label rows: marked if one of them marks it
    no words: 100 * distinct < 80 * words does not hold
    empty table: an empty result; extra columns, whatever their names: not read
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

#: Failure conditions of the contract's filters on ``text``, a text without nulls, and ``words``, its words.
FILTERS = {
    "A": "size(words) < 100",
    "B": "100 * size(array_distinct(words)) < 80 * size(words)",
    "C": "100 * length(regexp_replace(text, '[^A-Z]+', '')) > 10 * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
COPIES = "E"
MARKS = ("docs", "good", "toxic")


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def masks(docs: DataFrame, scratch: Scratch, filters: dict[str, str] = FILTERS, part: str = "lang") -> DataFrame:
    """(id, part, mask) of every document; the highest bit says that a smaller id has the same text."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    mask = sum((F.expr(f"IF({failure}, {1 << k}, 0)") for k, failure in enumerate(filters.values())), F.lit(0))
    rows = scratch.cut(rows.select("id", "part", mask.alias("mask"), F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")), "masks")
    # the first id of each text, joined back by text and id: a group of copies is spread over its ids
    first = rows.groupBy("digest").agg(F.min("id").alias("first")).where("first is not null").select(F.col("digest").alias("of"), "first")
    known = rows.where("id is not null").join(first, (F.col("digest") == F.col("of")) & (F.col("id") == F.col("first")), "left")
    known = known.select("id", "part", (F.col("mask") + F.when(F.col("of").isNull(), 1 << len(filters)).otherwise(0)).alias("mask"))
    return known.unionAll(rows.where("id is null").select("id", "part", "mask"))


def counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents, and those marked, by part and mask."""
    marks = labels.groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic")).where("doc_id is not null")
    return (
        masked.join(marks.withColumnRenamed("doc_id", "marked"), F.col("id") == F.col("marked"), "left").groupBy("part", "mask")
        .agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    )  # fmt: skip


def survivors(counted: DataFrame, bits: int) -> DataFrame:
    """A row per part; docs, good and toxic are arrays whose entry ``m`` sums the counts of all masks within
    ``m``: what is left by the filters that ``m`` lacks."""
    by_mask = counted.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in MARKS])
    dense = f"transform(sequence(0, {(1 << bits) - 1}), m -> coalesce({{0}}[m], 0L))"
    zeta = f"aggregate(sequence(0, {bits - 1}), {{0}}, (f, b) -> transform(f, (x, m) -> x + IF(getbit(m, b) = 1, f[m ^ shiftleft(1, b)], 0L)))"
    dense_rows = by_mask.select("part", *[F.expr(dense.format(c)).alias(c) for c in MARKS])
    return dense_rows.select("part", *[F.expr(zeta.format(c)).alias(c) for c in MARKS])


def audit(summed: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step."""
    n, full = len(letters), (1 << len(letters)) - 1
    # removed by a filter, summed over all orders: each set of others goes first in so many of them
    weight = lambda size: factorial(size) * factorial(n - 1 - size)  # noqa: E731
    shapley = {
        x: " + ".join(f"{weight(s.bit_count())} * (docs[{full ^ s}] - docs[{full ^ s ^ 1 << k}])" for s in range(full + 1) if not s >> k & 1)
        for k, x in enumerate(letters)
    }  # fmt: skip
    bit = f"shiftleft(1, locate(letter, '{letters}') - 1)"
    earlier = " + ".join(f"IF(locate('{x}', filter_order) < step AND letter <> '{x}', {1 << k}, 0)" for k, x in enumerate(letters))
    rows = summed.withColumn("by_letter", F.expr(f"map({', '.join(f'{x!r}, {e}' for x, e in shapley.items())})"))
    rows = rows.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    rows = rows.withColumn("before", F.expr(f"{full} - ({earlier})")).withColumn("after", F.expr(f"before - {bit}")).withColumn("bit", F.expr(bit))
    gone = lambda c: F.expr(f"{c}[before] - {c}[after]")  # noqa: E731
    return rows.select(
        "part", "filter_order", "step", F.expr("docs[after]").alias("kept"), gone("docs").alias("removed"),
        F.expr(f"docs[{full}] - docs[{full} - bit] - (docs[before] - docs[after])").alias("redundant"), F.expr("docs[bit] - docs[0]").alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.expr("by_letter[letter]").alias("shapley"),
    )  # fmt: skip


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all of ``docs``."""
    scratch = Scratch(docs.sparkSession, "filter-audit")
    letters = "".join(FILTERS) + COPIES
    return audit(survivors(counts(masks(docs, scratch), labels), len(letters)), letters)


_LETTER = ", ".join(f"({x!r}, {1 << k})" for k, x in enumerate("ABCDE"))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
f(letter, bit) AS (VALUES {_LETTER}),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f a JOIN f b ON b.letter <> a.letter JOIN f c ON c.letter NOT IN (a.letter, b.letter)
  JOIN f d ON d.letter NOT IN (a.letter, b.letter, c.letter) JOIN f e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
s AS (
  SELECT filter_order, step, f.letter, f.bit,
    CAST((SELECT coalesce(sum(g.bit), 0) FROM f g WHERE strpos(o.filter_order, g.letter) < step) AS INTEGER) AS before
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step) n JOIN f ON f.letter = substr(filter_order, step, 1)),
n AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
r AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN mask & (before | bit) = 0 THEN docs ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN docs ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r"""
