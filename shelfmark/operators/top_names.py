"""Searches of names by inverted lists, with bounds on what a list can add.

A query and a name score through units that they share: words of the query that begin words of the name,
and trigrams.  The most that some units can add together is known without a name, so the units of a query
are split: those that together stay below what a result needs are not looked up, and every possible result
is in the list of one of the others (the rarest).  What a result needs comes from a first look: of the
rarest units, the names of the largest contribution (the shortest) are scored, and the score of the last
one wanted is a floor.  Results are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T

Save = Callable[[DataFrame], DataFrame]
#: The first look: rarest units of a query, and names of each list, that it reads.
UNITS, NAMES = 8, 64
#: Scores are rounded to nine places; bounds give way by this much.
SLACK = 1e-8


def _prefixes(c: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(F.col(c), F.lit(1), i))


class NameIndex:
    """Distinct names (key, p, n_priced, size) and their postings (term, key, size)."""

    def __init__(self, names: DataFrame, limit: int, save: Save):
        """``names``: (key, p, n_priced), a key more than once where names differ and their words do not."""
        names = names.groupBy("key").agg(F.first("p").alias("p"), F.least(F.sum("n_priced"), F.lit(limit)).alias("n_priced"))
        names = names.withColumn("grams", T.trigrams(F.col("key")))
        self.names = save(names.withColumn("size", F.size("grams")))
        terms = F.concat(F.transform("grams", lambda g: F.concat(F.lit("g:"), g)), F.transform(F.array_distinct("p"), lambda w: F.concat(F.lit("w:"), w)))
        self.postings = save(self.names.select("key", "size", F.explode(terms).alias("term")))
        self.spread = save(self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        best = F.row_number().over(W.partitionBy("term").orderBy("size", "key"))
        self.heads = self.postings.withColumn("n", best).where(F.col("n") <= NAMES).select("term", "key")

    def terms_of(self, queries: DataFrame) -> DataFrame:
        """(query, unit, words, grams, term, df): the units of each query (query, q) and the terms that stand for them."""
        grams = queries.select("query", F.explode(T.trigrams(F.col("query"))).alias("g")).select("query", F.concat(F.lit("g:"), "g").alias("unit"), F.lit(0).alias("words"), F.lit(1).alias("grams"))
        grams = grams.join(self.spread.withColumnRenamed("term", "unit"), "unit").select("query", "unit", "words", "grams", F.col("unit").alias("term"), "df")
        words = queries.select("query", F.explode("q").alias("w")).groupBy("query", "w").agg(F.count(F.lit(1)).cast("int").alias("words"))
        vocabulary = self.spread.where(F.startswith("term", F.lit("w:"))).withColumn("v", F.expr("substring(term, 3)")).select("term", "df", F.explode(_prefixes("v")).alias("w"))
        words = words.join(vocabulary, "w").select("query", F.concat(F.lit("w:"), "w").alias("unit"), "words", F.lit(0).alias("grams"), "term", "df")
        return grams.unionByName(words)


def _scored(pairs: DataFrame, index: NameIndex, queries: DataFrame, cut: float, among: Column | None) -> DataFrame:
    """(query, key, p, n_priced, score) of pairs (query, key) of ``cut`` or more."""
    met = pairs.join(queries, "query").join(index.names.select("key", "p", "n_priced"), "key")
    if among is not None:
        met = met.where(among)
    return met.withColumn("score", F.round(T.name_similarity("q", "p"), 9)).where(F.col("score") >= cut).select("query", "key", "p", "n_priced", "score")


def similar_names(queries: DataFrame, index: NameIndex, cut: float, limit: int, save: Save, among: Column | None = None) -> DataFrame:
    """(query, key, p, score) with the names of the best ``limit`` products of each query (query: its words joined by
    spaces, q: its words) among them: priced products first, then by score.  ``among`` is a further condition on (q, p)."""
    terms = save(index.terms_of(queries))
    units = save(terms.groupBy("query", "unit").agg(F.first("words").alias("words"), F.first("grams").alias("grams"), F.sum("df").alias("df")))

    rarest = F.row_number().over(W.partitionBy("query").orderBy("df", "unit"))
    look = units.withColumn("n", rarest).where(F.col("n") <= UNITS).select("query", "unit").join(terms.select("query", "unit", "term"), ["query", "unit"])
    first = _scored(look.join(index.heads, "term").select("query", "key").distinct(), index, queries, cut, among)
    enough = F.sum("n_priced").over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    floors = first.withColumn("upto", enough).where(F.col("upto") >= limit).groupBy("query").agg(F.max("score").alias("floor"))

    size = queries.select("query", F.size("q").alias("n_words"), F.size(T.trigrams(F.col("query"))).alias("n_grams"))
    size = save(size.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(cut)) - SLACK))
    part = lambda words, grams, other: (  # noqa: E731  words and trigrams shared, of n_words and n_grams + other
        F.when(F.col("n_words") > 0, 0.5 * F.least(words, F.col("n_words")) / F.col("n_words")).otherwise(0.0) + grams / (F.col("n_grams") + other) + F.when(words > 0, 0.25).otherwise(0.0)
    )
    common = W.partitionBy("query").orderBy(F.desc("df"), "unit").rowsBetween(W.unboundedPreceding, 0)
    split = units.join(size, "query").withColumn("w", F.sum("words").over(common)).withColumn("g", F.sum("grams").over(common))
    split = save(split.withColumn("essential", part(F.col("w"), F.col("g"), F.col("g")) >= F.col("floor")))
    rest = split.where("NOT essential").groupBy("query").agg(F.max("w").alias("rest_w"), F.max("g").alias("rest_g"))

    found = split.where("essential").select("query", "unit", "words", "grams").join(terms.select("query", "unit", "term"), ["query", "unit"]).join(index.postings, "term")
    found = found.groupBy("query", "key").agg(F.sum("words").alias("w"), F.sum("grams").alias("g"), F.first("size").alias("size"))
    found = found.join(size, "query").join(rest, "query", "left").withColumn("w", F.col("w") + F.coalesce("rest_w", F.lit(0))).withColumn("g", F.least(F.col("g") + F.coalesce("rest_g", F.lit(0)), "n_grams", "size"))
    open_ = save(found.where(part(F.col("w"), F.col("g"), F.col("size")) >= F.col("floor")).select("query", "key"))
    return _scored(open_, index, queries, cut, among).select("query", "key", "p", "score")


def containing(queries: DataFrame, names: DataFrame, least: float) -> DataFrame:
    """(query, name, recall) where a name (name, p) has ``least`` of a query's words (query, q), repeats counted, or
    more.  A name that has so many of n words has one of those that are left when the commonest, up to one word short
    of ``least``, are set aside: only the lists of these are read."""
    words = queries.select("query", F.size("q").alias("n"), F.explode("q").alias("w")).groupBy("query", "n", "w").agg(F.count(F.lit(1)).alias("times"))
    postings = names.select("name", F.explode(F.array_distinct("p")).alias("w"))
    spread = postings.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    common = W.partitionBy("query").orderBy(F.desc("df"), "w").rowsBetween(W.unboundedPreceding, 0)
    rare = words.join(spread, "w").withColumn("upto", F.sum("times").over(common)).where(F.col("upto") >= least * F.col("n") - 1e-9).select("query", "w")
    met = rare.join(postings, "w").select("query", "name").distinct().join(queries, "query").join(names, "name")
    recall = F.size(F.filter("q", lambda w: F.array_contains("p", w))) / F.size("q")
    return met.withColumn("recall", recall).where(F.col("recall") >= least).select("query", "name", "recall")
