"""Pair scores by classes: what many listings have in common is compared once.

Listings repeat names, so their pairs are many more than the pairs of their names.  Scoring goes down in
three steps, each over what the step before has left:

* names: distinct (brand key, words, core words) that share a brand and two core words.  Their likeness
  (0.45 Jaccard + 0.55 Dice) is computed once a pair; agreeing axes and brands can add BONUS at most, so
  pairs below the least score without it are dropped.
* senses: distinct (name, brand, codes in the name, axes, bare numbers).  Conflicts, bonuses and the score
  itself are settled here.
* listings, or classes of listings with one sense and pack: only packs are left to compare.

Listings that share a code of any kind are scored apart, pair by pair: their verdict rests on that code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import axes as A, text as T
from .graph import connected_components
from .matching import candidate_pairs, score_pairs, verdict_columns

Save = Callable[[DataFrame], DataFrame]
#: What agreeing axes (0.15) and brands (0.05) add to a likeness at most.
BONUS = 0.2
#: Least score of a pair that only names speak for.
OPEN, TAKEN = 0.8, 0.92


def classed(feats: DataFrame) -> DataFrame:
    """``feats`` with brand_key, core (sorted), codes (of any kind), and the digests name and sense."""
    out = feats.withColumn("brand_key", F.get("brand_words", 0)).withColumn("core_set", F.array_sort(F.array_distinct("core_words")))
    out = out.withColumn("codes", F.array_distinct(F.filter(F.concat(F.array("code", "core"), "name_codes"), lambda c: F.length(c) > 0)))
    digest = lambda *c: F.sha1(F.to_json(F.struct(*c)))
    out = out.withColumn("name_id", digest("brand_key", "words", "core_set"))
    axes = F.array_sort(F.map_entries("axes")).alias("axes")
    return out.withColumn("sense_id", digest("name_id", "brand_words", "name_codes", axes, "loose"))


def _words_keys(df: DataFrame, id_col: str) -> DataFrame:
    two = "flatten(transform(core_set, (a, i) -> transform(slice(core_set, i + 2, size(core_set)), b -> concat('words:', brand_key, ':', a, ':', b))))"
    return df.where("brand_key IS NOT NULL").select(F.col(id_col).alias("listing_id"), F.explode(F.expr(two)).alias("key"))


def name_pairs(own: DataFrame, least: float, save: Save) -> DataFrame:
    """(left_name, right_name, base) of names, each with itself too, that share a brand and two core words and are
    ``least`` alike or more."""
    names = save(own.where("brand_key IS NOT NULL AND size(core_set) >= 2").groupBy("name_id").agg(*[F.first(c).alias(c) for c in ("brand_key", "core_set", "words", "grams")]))
    met = candidate_pairs(save(_words_keys(names, "name_id"))).withColumnsRenamed({"left_id": "left_name", "right_id": "right_name"})
    side = lambda s: names.select(F.col("name_id").alias(f"{s}_name"), F.array_distinct("words").alias(f"{s}_words"), F.col("grams").alias(f"{s}_grams"))
    base = 0.45 * T.jaccard(F.col("left_words"), F.col("right_words")) + 0.55 * T.dice(F.col("left_grams"), F.col("right_grams"))
    itself = names.select(F.col("name_id").alias("left_name"), F.col("name_id").alias("right_name"))
    both = save(met.unionByName(itself).join(side("left"), "left_name").join(side("right"), "right_name").select("left_name", "right_name", base.alias("base")))
    return both.where(F.col("base") >= least)


def sense_pairs(own: DataFrame, names: DataFrame, least: float, save: Save) -> DataFrame:
    """(left_sense, right_sense, n, apart) of senses of one brand that no axis and no bare number sets apart and whose
    names are ``least`` alike or more, each with itself too; apart: both have codes in their names, and none in common."""
    fields = ["brand_words", "axes", "loose", "name_codes"]
    # grouped without the map: one row of a sense is as good as any
    senses = own.select("name_id", "sense_id", F.struct(*fields).alias("f")).groupBy("name_id", "sense_id").agg(F.first("f").alias("f"))
    side = lambda s: senses.select(F.col("name_id").alias(f"{s}_name"), F.col("sense_id").alias(f"{s}_sense"), F.col("f").alias(s))
    a, b = (lambda c: F.col(f"left.{c}")), (lambda c: F.col(f"right.{c}"))
    met = names.join(side("left"), "left_name").join(side("right"), "right_name").where("left_name < right_name OR left_sense <= right_sense")
    met = met.where(~A.axes_conflict(a("axes"), b("axes")) & (T.brands_agree(a("brand_words"), b("brand_words")) == "match") & ~A.bare_conflict(a("loose"), b("loose")))
    like = F.col("base") + F.least(A.axis_agreements(a("axes"), b("axes")) * 0.05, F.lit(0.15)) + 0.05
    apart = (F.size(a("name_codes")) > 0) & (F.size(b("name_codes")) > 0) & ~F.arrays_overlap(a("name_codes"), b("name_codes"))
    met = met.select("left_sense", "right_sense", F.greatest(F.lit(0.0), F.least(F.lit(1.0), like)).alias("n"), apart.alias("apart"))
    return save(met.where(F.col("n") >= least))


def _met(senses: DataFrame, members: DataFrame, of: str) -> DataFrame:
    """Members (sense_id, ``of``, f) of two senses beside each other, each two once."""
    side = lambda s: members.select(F.col("sense_id").alias(f"{s}_sense"), F.col(of).alias(s), F.col("f").alias(f"{s}_f"))
    return senses.join(side("x"), F.col("left_sense") == F.col("x_sense")).join(side("y"), F.col("right_sense") == F.col("y_sense"))


def _judged(n: Column, apart: Column, differs: Column) -> tuple[Column, Column]:
    """Status and confidence of a pair of score OPEN or more that only names speak for."""
    return verdict_columns(F.when((n >= TAKEN) & ~apart, "accept").otherwise("review"), F.lit(0.0), n, differs)


def _code_pairs(own: DataFrame, save: Save) -> DataFrame:
    """Candidate pairs that share a code of any kind: by codes that are keys of their own, and by the others together
    with a brand and two core words."""
    eligible = (F.col("strength") > 0.1) | (F.size("name_codes") > 0)
    keyed = own.select("listing_id", "brand_key", "core_set", F.explode("codes").alias("c"), F.coalesce(eligible, F.lit(False)).alias("eligible"))
    own_key = F.col("eligible") & (F.length("c") >= 4)
    by_code = keyed.where(own_key).select("listing_id", F.concat(F.lit("code:"), "c").alias("key"))
    weak = keyed.where(~own_key).select("c").distinct()
    with_words = keyed.join(weak, "c", "left_semi")
    two = "flatten(transform(core_set, (a, i) -> transform(slice(core_set, i + 2, size(core_set)), b -> concat('both:', c, ':', brand_key, ':', a, ':', b))))"
    by_both = with_words.where("brand_key IS NOT NULL").select("listing_id", F.explode(F.expr(two)).alias("key"))
    return candidate_pairs(save(by_code.unionByName(by_both)))


def score_by_classes(feats: DataFrame, save: Save) -> DataFrame:
    """ER05, ER06: (left_id, right_id, status, confidence, name_sim) of the candidate pairs that are not rejected."""
    own = save(classed(feats))
    coded = save(score_pairs(_code_pairs(own, save), feats, rejected=False)).where("status <> 'reject'")
    senses = sense_pairs(own, name_pairs(own, OPEN - BONUS - 1e-9, save), OPEN, save)
    met = _met(senses, own.select("sense_id", "listing_id", F.struct("pack", "codes").alias("f")), "listing_id")
    met = met.where("(left_sense < right_sense OR left_sense > right_sense OR x < y) AND NOT arrays_overlap(x_f.codes, y_f.codes)")
    status, confidence = _judged(F.col("n"), F.col("apart"), T.pack_relation("x_f.pack", "y_f.pack") == "differs")
    named = met.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), status.alias("status"), confidence.alias("confidence"), F.round("n", 9).alias("name_sim"))
    return coded.unionByName(named)


def links_of_classes(own: DataFrame, save: Save) -> tuple[DataFrame, DataFrame]:
    """Links between classes of listings with one sense and pack, named by their least id, with their numbers of members
    and pairs (every); and (listing_id, class)."""
    senses = sense_pairs(own, name_pairs(own, OPEN - BONUS - 1e-9, save), OPEN, save)
    groups = own.groupBy("sense_id", "pack").agg(F.min("listing_id").alias("class"), F.count(F.lit(1)).alias("n"))
    met = _met(senses, groups.select("sense_id", "class", F.struct("pack", "n").alias("f")), "class").where("left_sense <> right_sense OR x <= y")
    status, confidence = _judged(F.col("n"), F.col("apart"), T.pack_relation("x_f.pack", "y_f.pack") == "differs")
    links = met.select(
        F.least("x", "y").alias("left_class"), F.greatest("x", "y").alias("right_class"), status.alias("status"), confidence.alias("confidence"), F.round("n", 9).alias("name_sim"),
        F.when(F.col("x") <= F.col("y"), F.col("x_f.n")).otherwise(F.col("y_f.n")).alias("n_left"), F.when(F.col("x") <= F.col("y"), F.col("y_f.n")).otherwise(F.col("x_f.n")).alias("n_right"),
        F.when(F.col("x") == F.col("y"), F.expr("x_f.n * (x_f.n - 1) DIV 2")).otherwise(F.col("x_f.n") * F.col("y_f.n")).alias("every"),
    )
    named = groups.select(F.col("sense_id").alias("s"), F.col("pack").alias("p"), "class")
    of = own.join(named, (F.col("sense_id") == F.col("s")) & F.col("pack").eqNullSafe(F.col("p"))).select("listing_id", "class")
    return links, of


def _class_links(own: DataFrame, save: Save) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``links_of_classes``, and the pairs of listings that share a code, with their classes (a, b)."""
    links, of = links_of_classes(own, save)
    # pairs of members that share a code are made once each, under the first code they share
    pairs = candidate_pairs(save(own.select("listing_id", F.explode("codes").alias("key"))))
    ends = pairs.join(of.select(F.col("listing_id").alias("left_id"), F.col("class").alias("a")), "left_id").join(of.select(F.col("listing_id").alias("right_id"), F.col("class").alias("b")), "right_id")
    return links, of, ends


def link_classes(feats: DataFrame, save: Save) -> DataFrame:
    """The same links without their copies: (left_class, right_class, status, confidence, name_sim, n_left, n_right,
    n_links) between classes of listings with one sense and pack, named by their least id.  n_links counts the pairs
    of members that share no code; those that do are ``score_by_classes``' coded pairs."""
    links, _, ends = _class_links(save(classed(feats)), save)
    coded = ends.groupBy(F.least("a", "b").alias("left_class"), F.greatest("a", "b").alias("right_class")).agg(F.count(F.lit(1)).alias("coded"))
    out = links.join(coded, ["left_class", "right_class"], "left").withColumn("n_links", F.col("every") - F.coalesce("coded", F.lit(0)))
    return out.where("n_links > 0").drop("every", "coded")


def _each(pairs: DataFrame, left: str, right: str, key: str, *more: Column) -> DataFrame:
    """(``key``, more) of both ends of pairs."""
    return pairs.select(F.explode(F.array(left, right)).alias(key), *more)


def link_counts(feats: DataFrame, save: Save) -> DataFrame:
    """ER05 without its pairs: (listing_id, class_id, n_links, n_exact, n_variant, n_review) of every listing: its class of
    ``link_classes`` and how many of the pairs of ``score_by_classes`` it is in, by their status.  They are its class's
    links, less the members that it shares a code with, and its own scored pairs by codes."""
    own = save(classed(feats))
    coded = save(score_pairs(_code_pairs(own, save), feats, rejected=False)).where("status <> 'reject'")
    links, of, ends = _class_links(own, save)
    links, of = save(links), save(of)
    by_status = [F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(f"n_{c}") for s, c in (("exact", "exact"), ("variant", "variant"), ("needs_review", "review"))]
    outward = links.where("left_class <> right_class").select("status", F.explode(F.array(F.struct(F.col("left_class").alias("class"), F.col("n_right").alias("n")), F.struct(F.col("right_class").alias("class"), F.col("n_left").alias("n")))).alias("e")).select("e.class", "status", "e.n")
    inward = links.where("left_class = right_class").select(F.col("left_class").alias("class"), "status", (F.col("n_left") - 1).alias("n"))
    shared = of.join(outward.unionByName(inward).groupBy("class").agg(*by_status), "class", "left")
    named = ends.withColumns({"left_class": F.least("a", "b"), "right_class": F.greatest("a", "b")}).join(links.select("left_class", "right_class", "status"), ["left_class", "right_class"])
    alone = _each(named, "left_id", "right_id", "listing_id", "status", F.lit(-1).alias("n")).unionByName(_each(coded, "left_id", "right_id", "listing_id", "status", F.lit(1).alias("n")))
    alone = alone.groupBy("listing_id").agg(*by_status).withColumnsRenamed({f"n_{c}": f"own_{c}" for c in ("exact", "variant", "review")})
    count = lambda c: F.coalesce(f"n_{c}", F.lit(0)) + F.coalesce(f"own_{c}", F.lit(0))
    kinds = [count(c).alias(f"n_{c}") for c in ("exact", "variant", "review")]
    return shared.join(alone, "listing_id", "left").select("listing_id", F.col("class").alias("class_id"), (count("exact") + count("variant") + count("review")).alias("n_links"), *kinds)


def name_brand_probe(feats: DataFrame, save: Save, medium: float = 0.7, high: float = 0.8) -> DataFrame:
    """ER19: (left_id, right_id, name_sim, high, group) of pairs of one brand, two shared core words and different
    suppliers that no axis and no bare number sets apart and whose names are ``medium`` alike or more; pairs from
    ``high`` on make groups."""
    own = save(classed(feats))
    senses = sense_pairs(own, name_pairs(own, medium - BONUS - 1e-9, save), medium, save)
    met = _met(senses, own.select("sense_id", "listing_id", F.struct("supplier_id").alias("f")), "listing_id")
    met = met.where("(left_sense <> right_sense OR x < y) AND x_f.supplier_id <> y_f.supplier_id")
    found = save(met.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), F.round("n", 9).alias("name_sim"), (F.col("n") >= high).alias("high")))
    groups = connected_components(found.where("high").select(F.col("left_id").alias("u"), F.col("right_id").alias("v")), save)
    return found.join(groups.select(F.col("vertex").alias("left_id"), F.col("label").alias("group")), "left_id", "left").withColumn("group", F.when(F.col("high"), F.col("group")))


def name_brand_groups(feats: DataFrame, save: Save, medium: float = 0.7, high: float = 0.8) -> DataFrame:
    """ER19 without its pairs: (listing_id, class_id, n_links, n_high, group) of every listing: its class of one sense and
    supplier, how many of the pairs of ``name_brand_probe`` it is in, and the group that those from ``high`` on make.
    Listings of one class have the same neighbours, so classes are counted and joined in their stead."""
    own = save(classed(feats))
    senses = sense_pairs(own, name_pairs(own, medium - BONUS - 1e-9, save), medium, save)
    # a listing without a supplier is compared with none, but keeps its row
    classes = save(own.groupBy("sense_id", "supplier_id").agg(F.min("listing_id").alias("class"), F.count(F.lit(1)).alias("n")))
    met = _met(senses, classes.select("sense_id", "class", F.struct("supplier_id", F.col("n").alias("members")).alias("f")), "class").where("(left_sense <> right_sense OR x < y) AND x_f.supplier_id <> y_f.supplier_id")
    met = save(met.select("x", "y", F.col("x_f.members").alias("n_x"), F.col("y_f.members").alias("n_y"), (F.col("n") >= high).alias("high")))
    both = met.select(F.explode(F.array(F.struct(F.col("x").alias("class"), F.col("n_y").alias("n")), F.struct(F.col("y").alias("class"), F.col("n_x").alias("n")))).alias("e"), "high")
    counts = both.groupBy("e.class").agg(F.sum("e.n").alias("n_links"), F.sum(F.when(F.col("high"), F.col("e.n")).otherwise(0)).alias("n_high"))
    groups = connected_components(met.where("high").select(F.col("x").alias("u"), F.col("y").alias("v")), save).select(F.col("vertex").alias("class"), F.col("label").alias("group"))
    found = save(classes.join(counts, "class", "left").join(groups, "class", "left"))
    named = found.select(F.col("sense_id").alias("s"), F.col("supplier_id").alias("p"), F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_high", F.lit(0)).alias("n_high"), "group")
    return own.join(named, (F.col("sense_id") == F.col("s")) & F.col("supplier_id").eqNullSafe(F.col("p"))).select("listing_id", "class_id", "n_links", "n_high", "group")
