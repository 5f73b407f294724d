"""Entity resolution: features, blocking, pair scores, clusters and stable ids.

Listings are (listing_id, supplier_id, sku, brand, name, pack_size).  Pairs come from inverted lists
(a shared code, or a brand and two shared core words).  No list is passed over: one longer than BLOCK is
split into blocks, so no task makes the pairs of a long list alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import axes as A, packs as P, text as T
from .graph import connected_components
from .overlap import similar_sets

#: Listings of one key in a block of a long posting list.
BLOCK = 600


# --- fixed values
GENERIC_BUR_WORDS = [
    "bur", "box", "carbide", "coarse", "diamond", "diameter", "end", "fg", "fine", "friction", "grit", "grip", "head", "length", "medium", "mm",
    "pack", "pk", "round", "shape", "single", "sterile", "super", "taper", "use",
]
GENERIC_BUR_CODE = r"^(?:\d{3,4}|[A-Z]\d{3}|[A-Z]{1,2}\d{3,4})\d{3}(?:F|M|C|SC|UF)?$"
BUR_GEOMETRY_CODE = r"^\d{6}[A-Z]{0,2}$"
LINE_CODE, LINE_WORDS = r"^DOC[PSW]\d{2,}", (["opticide3"], ["opti", "cide", "3"])


def features(listings: DataFrame) -> DataFrame:
    """ER02: the normalised fields that pairs are scored on."""
    supplier = F.col("supplier_id").cast("string")
    out = listings.withColumn("code", T.normalize_sku("sku")).withColumn("strength", T.sku_strength(F.col("code")))
    out = out.withColumn("core", F.when(supplier.isin(T.PREFIX_CODED_SUPPLIERS), T.sku_model_core("sku")).otherwise(""))
    out = out.withColumn("brand_words", T.brand_tokens("brand", supplier)).withColumn("words", T.tokenize_name("name")).withColumn("name_codes", T.sku_like_tokens("name"))
    out = out.withColumn("core_words", T.core_tokens(F.col("words"), F.col("brand_words"), F.col("name_codes"))).withColumn("grams", T.trigrams(F.array_join("words", " ")))
    found = A.axis_values("name", "code", "sku", "brand")
    # a prefixed listing's own model sets it apart from its supplier's others
    model = F.when(F.col("core") != "", F.map_from_arrays(F.array(F.lit("model")), F.array(F.array("core")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")))
    out = out.withColumn("axes", F.map_concat(found, model)).withColumn("stated", P.parse_pack_quantity(F.col("pack_size"), F.col("name")))
    # a number that is a code of the name is no pack
    out = out.withColumn("pack", F.when((F.col("stated") <= T.MAX_PACK) & ~F.array_contains("name_codes", F.col("stated").cast("string")), F.col("stated"))).drop("stated")
    return out.withColumn("loose", T.bare_numbers(F.col("words"), F.col("pack"), F.flatten(F.map_values("axes"))))


def blocking_index(feats: DataFrame) -> DataFrame:
    """ER03: (listing_id, key) postings: strong codes, and brand with every two core words."""
    codes = F.array_distinct(F.filter(F.concat(F.array("code", "core"), "name_codes"), lambda c: F.length(c) >= 4))
    by_code = feats.where("strength > 0.1 OR size(name_codes) > 0").select("listing_id", F.explode(codes).alias("c")).select("listing_id", F.concat(F.lit("code:"), "c").alias("key"))
    words = feats.select("listing_id", F.get("brand_words", 0).alias("brand"), F.array_sort(F.array_distinct("core_words")).alias("w"))
    two = F.expr("flatten(transform(w, (a, i) -> transform(slice(w, i + 2, size(w)), b -> concat('words:', brand, ':', a, ':', b))))")
    return by_code.unionByName(words.where("brand IS NOT NULL").select("listing_id", F.explode(two).alias("key")))


def candidate_pairs(index: DataFrame, block: int = BLOCK, rules: bool = False) -> DataFrame:
    """ER04, J08, J12: distinct pairs that share a posting list of ``index`` (listing_id, key), whose rows differ; with
    ``rules`` also by which kind of key.  A list of more than ``block`` listings becomes a grid of blocks, a row of it
    for the left side and a column for the right.  Both sides bring all their keys, and a pair is made under the first
    that it shares only, so no pairs are brought together to find the distinct ones."""
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("key", F.ceil(F.col("n") / block).cast("int").alias("n"))
    shared = index.join(sizes, "key")
    own = shared.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("l"))
    lists = own.select("listing_id", F.transform("l", lambda x: x["key"]).alias("keys"), F.explode("l").alias("e")).select("listing_id", "keys", "e.key", "e.n")
    lists = lists.withColumn("own", F.pmod(F.xxhash64("listing_id"), "n").cast("int")).withColumn("every", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    left = lists.select("key", F.col("listing_id").alias("left_id"), F.col("keys").alias("a"), F.col("own").alias("i"), F.col("every").alias("j"))
    right = lists.select("key", F.col("listing_id").alias("right_id"), F.col("keys").alias("b"), F.col("every").alias("i"), F.col("own").alias("j"))
    met = left.join(right, ["key", "i", "j"]).where("left_id < right_id").withColumn("both", F.array_intersect("a", "b")).where(F.get("both", 0) == F.col("key"))
    kind = lambda k: F.exists("both", lambda x: F.startswith(x, F.lit(k)))
    return met.select("left_id", "right_id", *([kind("code:").alias("by_code"), kind("words:").alias("by_words")] if rules else []))


def _keys_of(index: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(listing_id, codes, words): the sorted keys of each listing of ``index``, by their kind."""
    is_code = F.startswith("key", F.lit("code:"))
    return save(index.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.when(is_code, F.col("key")))).alias("codes"), F.sort_array(F.collect_list(F.when(~is_code, F.col("key")))).alias("words")))


def _kinds_met(keys: DataFrame, c: str, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Listings of equal ``c`` as kinds (c, kind, n), named by their least, and the pairs of kinds that share a key."""
    kinds = save(keys.where(F.size(c) > 0).groupBy(c).agg(F.min("listing_id").alias("kind"), F.count(F.lit(1)).alias("n")))
    return kinds, candidate_pairs(save(kinds.select(F.col("kind").alias("listing_id"), F.explode(c).alias("key"))))


def kind_pairs(index: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ER04, J12: the pairs of ``candidate_pairs`` with their rules.  Listings of equal words meet the same listings by
    words, those of equal codes by codes, so kinds of them are compared once each and then take the places of their
    listings; a pair that words bring together is not made by codes again.  No list is repeated for its blocks, and pairs
    go out as they are made."""
    keys = _keys_of(index, save)

    def met(c: str) -> DataFrame:
        kinds, pairs = _kinds_met(keys, c, save)
        named = save(keys.join(kinds.drop("n"), c))
        side = lambda s: named.select(F.col("kind").alias(f"{s}_kind"), F.col("listing_id").alias(s), F.struct("codes", "words").alias(f"{s}_keys"))
        both = save(pairs.select(F.col("left_id").alias("x_kind"), F.col("right_id").alias("y_kind")).unionByName(kinds.select(F.col("kind").alias("x_kind"), F.col("kind").alias("y_kind"))))
        # merged: a join by hash would make all pairs in the few tasks that kinds lie in
        return both.join(side("x"), "x_kind").join(side("y").hint("merge"), "y_kind").where("x_kind <> y_kind OR x < y")

    pair = (F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))
    shared = lambda c: F.arrays_overlap(f"x_keys.{c}", f"y_keys.{c}")
    by_words = met("words").select(*pair, shared("codes").alias("by_code"), F.lit(True).alias("by_words"))
    return by_words.unionByName(met("codes").where(~shared("words")).select(*pair, F.lit(True).alias("by_code"), F.lit(False).alias("by_words")))


def candidate_counts(listings: DataFrame, index: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs of ER04 and J12 counted: (listing_id, class_id, n_links, n_code, n_words) of every listing: its class (the
    least listing of equal brand and words, itself if no two words are a key), in how many pairs of ``candidate_pairs``
    it is, and in how many a code or brand and words bring it together with another.

    Listings of equal codes have equal neighbours by codes, those of equal words by words, so both are linked and
    counted between kinds.  What both ways bring together is counted once, between kinds of equal codes and words."""
    keys = _keys_of(index, save)

    def linked(c: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(listing_id, kind), linked kinds (u, v, n members of v) with each itself, and (kind, n) of other listings."""
        kinds, met = _kinds_met(keys, c, save)
        ends = F.explode(F.array(F.struct(F.col("left_id").alias("u"), F.col("right_id").alias("v")), F.struct(F.col("right_id").alias("u"), F.col("left_id").alias("v"))))
        both = met.select(ends.alias("e")).select("e.*").unionByName(kinds.select(F.col("kind").alias("u"), F.col("kind").alias("v")))
        both = save(both.join(kinds.select(F.col("kind").alias("v"), "n"), "v"))
        return keys.join(kinds, c).select("listing_id", F.col("kind").alias(c)), both, both.groupBy(F.col("u").alias(c)).agg((F.sum("n") - 1).alias(f"n_{c}"))

    (of_code, by_code, n_code), (of_words, by_words, n_words) = linked("codes"), linked("words")
    own = save(listings.select("listing_id").join(of_code, "listing_id", "left").join(of_words, "listing_id", "left"))
    cells = save(own.where("codes IS NOT NULL AND words IS NOT NULL").groupBy("codes", "words").agg(F.count(F.lit(1)).alias("n")))
    met = cells.drop("n").join(by_code.select(F.col("u").alias("codes"), F.col("v").alias("c")), "codes").join(cells.select(F.col("codes").alias("c"), F.col("words").alias("w"), "n"), "c")
    n_both = met.join(by_words.select(F.col("u").alias("words"), F.col("v").alias("w")), ["words", "w"]).groupBy("codes", "words").agg((F.sum("n") - 1).alias("n_both"))
    out = own.join(n_code, "codes", "left").join(n_words, "words", "left").join(n_both, ["codes", "words"], "left").na.fill(0, ["n_codes", "n_words", "n_both"])
    return out.select("listing_id", F.coalesce("words", "listing_id").alias("class_id"), (F.col("n_codes") + F.col("n_words") - F.col("n_both")).alias("n_links"), F.col("n_codes").alias("n_code"), "n_words")


def _code_evidence(a: Callable, b: Callable, brand: Column) -> Column:
    """(score, code) of what two listings' codes say: the same code, a shared model behind a prefix, one's
    code in the other's name, or a code in both names."""
    made = lambda score, code: F.struct(score.cast("double").alias("score"), code.alias("code"))
    core = F.when((a("core") != "") & ((a("core") == b("code")) | (a("core") == b("core"))), a("core")).when((b("core") != "") & (b("core") == a("code")), b("core"))
    bur = F.array_contains(a("words"), "bur") | F.array_contains(a("words"), "diamond") | F.array_contains(b("words"), "bur") | F.array_contains(b("words"), "diamond")
    shape = lambda code: bur & code.rlike(BUR_GEOMETRY_CODE)
    a_in_b = (F.length(a("code")) >= 5) & F.array_contains(b("name_codes"), a("code"))
    b_in_a = (F.length(b("code")) >= 5) & F.array_contains(a("name_codes"), b("code"))
    named, strength = F.when(a_in_b, a("code")).when(b_in_a, b("code")), F.when(a_in_b, a("strength")).otherwise(b("strength"))
    both = F.get(F.filter(F.array_intersect(a("name_codes"), b("name_codes")), lambda c: F.length(c) >= 6), 0)
    return (
        F.when((a("code") != "") & (a("code") == b("code")), made(F.least(a("strength"), b("strength")), a("code")))
        .when(core.isNotNull() & (brand == "match"), made(T.sku_strength(core), core))
        .when(named.isNotNull(), made(F.when(shape(named), 0.3).otherwise(F.least(F.lit(0.9), strength * 0.95)), named))
        .when(both.isNotNull(), made(F.when(shape(both), 0.3).otherwise(F.lit(0.55)), both))
        .otherwise(made(F.lit(0.0), F.lit("")))
    )


#: The features that pairs are scored on.
SCORED = ["supplier_id", "code", "strength", "core", "brand_words", "words", "name_codes", "grams", "pack", "axes", "loose"]


def _sides() -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    return (lambda c: F.col(f"left.{c}")), (lambda c: F.col(f"right.{c}"))


def _signals(pairs: DataFrame, feats: DataFrame, conflicts: bool = True) -> DataFrame:
    """``pairs`` with both sides' features, brand (relation), sku (code evidence), rel (brand, or one product line),
    loosely (bare numbers apart) and n (likeness of the names); without ``conflicts``, pairs whose axes conflict are
    dropped before the names are compared."""
    side = lambda s: feats.select(F.col("listing_id").alias(f"{s}_id"), F.struct(*SCORED).alias(s))
    p = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    a, b = _sides()
    if not conflicts:
        p = p.where(~A.axes_conflict(a("axes"), b("axes")))
    p = p.withColumn("brand", T.brands_agree(a("brand_words"), b("brand_words")))
    p = p.withColumn("sku", _code_evidence(a, b, F.col("brand")))
    code = F.col("sku.code")
    line = lambda x: F.lit(False) | F.arrays_overlap(x("words"), F.array(*map(F.lit, LINE_WORDS[0]))) | (F.size(F.array_except(F.array(*map(F.lit, LINE_WORDS[1])), x("words"))) == 0)
    one_line = (a("code") == b("code")) & code.rlike(LINE_CODE) & line(a) & line(b)
    p = p.withColumn("rel", F.when(one_line, "match").otherwise(F.col("brand"))).withColumn("loosely", A.bare_conflict(a("loose"), b("loose")))
    rel, loosely = F.col("rel"), F.col("loosely")
    like = 0.45 * T.jaccard(F.array_distinct(a("words")), F.array_distinct(b("words"))) + 0.55 * T.dice(a("grams"), b("grams")) + F.least(A.axis_agreements(a("axes"), b("axes")) * 0.05, F.lit(0.15))
    like = like + F.when(rel == "match", 0.05).otherwise(0.0) - F.when(loosely, 0.1).otherwise(0.0)
    return p.withColumn("n", F.greatest(F.lit(0.0), F.least(F.lit(1.0), like)))


def score_pairs(pairs: DataFrame, feats: DataFrame, rejected: bool = True) -> DataFrame:
    """ER05, ER06: (left_id, right_id, status, confidence, name_sim) of every candidate pair; without ``rejected``, of
    those whose axes do not conflict.  A filter on the status belongs after the pairs are written: before, it would
    be pushed below and compare the names again."""
    p = _signals(pairs, feats, conflicts=rejected)
    a, b = _sides()
    code, s, rel, loosely, n = (F.col(c) for c in ("sku.code", "sku.score", "rel", "loosely", "n"))

    special = lambda x: F.filter(x("words"), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(GENERIC_BUR_WORDS))
    only_shape = (s >= 0.55) & code.rlike(GENERIC_BUR_CODE) & (rel != "match") & ~F.arrays_overlap(special(a), special(b))
    apart = (F.size(a("name_codes")) > 0) & (F.size(b("name_codes")) > 0) & ~F.arrays_overlap(a("name_codes"), b("name_codes"))
    decide = lambda yes, maybe: F.when(yes, "accept").when(maybe, "review").otherwise("reject")
    never = F.lit(False)
    verdict = (
        F.when(A.axes_conflict(a("axes"), b("axes")), "reject").when(only_shape, decide(never, n >= 0.5))
        .when((s >= 0.55) & (rel == "conflict"), decide(never, n >= 0.5)).when(s >= 0.55, decide(n >= 0.45, n >= 0.25))
        .when(s >= 0.3, decide((n >= 0.6) & (rel != "conflict"), n >= 0.45)).when(s > 0, decide((n >= 0.8) & (rel == "match"), n >= 0.7))
        .when((rel == "match") & ~loosely, decide((n >= 0.92) & ~apart, n >= 0.8)).otherwise("reject")
    )
    status, confidence = verdict_columns(F.col("verdict"), s, n, T.pack_relation("left.pack", "right.pack") == "differs")
    return p.withColumn("verdict", verdict).select("left_id", "right_id", status.alias("status"), confidence.alias("confidence"), F.round("n", 9).alias("name_sim"))


def verdict_columns(verdict: Column, s: Column, n: Column, differs: Column) -> tuple[Column, Column]:
    """Status and confidence of a verdict with code score ``s`` and name score ``n``, by whether packs differ."""
    taken, open_ = verdict == "accept", verdict == "review"
    status = F.when(taken, F.when(differs, "variant").otherwise("exact")).when(open_, "needs_review").otherwise("reject")
    confidence = F.when(taken, F.least(F.lit(99), F.floor(F.when(differs, 70).otherwise(75) + 12.5 * (s + n) + 0.5))).when(open_, F.floor(40 + 20 * n + 0.5)).otherwise(0)
    return status, confidence.cast("int")


def _bounds(feats: DataFrame) -> DataFrame:
    """(id, bounds): what keeps listings apart: axis values, the pack, and the supplier's own code."""
    own = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("pack").alias("k"), F.array(F.col("pack").cast("string")).alias("v")),
        F.struct(F.concat(F.lit("code of "), F.col("supplier_id").cast("string")).alias("k"), F.array(F.nullif("code", F.lit(""))).alias("v")),
    ), lambda e: F.get(e["v"], 0).isNotNull() & e["k"].isNotNull()))
    return feats.select(F.col("listing_id").alias("id"), F.map_concat("axes", own).alias("bounds"), F.struct(F.map_entries("axes").alias("axes"), "pack", "code").alias("alike"))


_SHARED = "array_intersect(map_keys(x), map_keys(y))"
_APART = f"exists({_SHARED}, k -> NOT arrays_overlap(x[k], y[k]))"
_MET = f"""map_concat(map_from_entries(transform({_SHARED}, k -> struct(k, array_intersect(x[k], y[k])))),
  map_filter(x, (k, v) -> NOT map_contains_key(y, k)), map_filter(y, (k, v) -> NOT map_contains_key(x, k)))"""


def clusters(scored: DataFrame, feats: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ER07, ER08: (listing_id, cluster).

    Clusters grow over accepted pairs.  All members of a cluster have a value in common on every bound that more
    than one states (an axis, the pack, their supplier's code), so none holds two sizes, and a listing without a
    size goes with one of its neighbours.  Listings that agree in all bounds and the code are joined at once.
    Then, in rounds, each cluster names its best open pair (confidence, likeness, then a hash), and pairs that
    both ends name are merged; pairs whose ends have come apart are dropped.  The best pair of all is always
    merged, so the rounds end when no pair is open.
    """
    bounds = save(_bounds(feats))
    pairs = scored.where("status IN ('exact', 'variant')").select("left_id", "right_id", F.struct("confidence", "name_sim").alias("w"))
    alike = pairs.join(bounds.select(F.col("id").alias("left_id"), F.col("alike").alias("a")), "left_id").join(bounds.select(F.col("id").alias("right_id"), F.col("alike").alias("b")), "right_id")
    labels = connected_components(alike.where("a = b").select(F.col("left_id").alias("u"), F.col("right_id").alias("v")), save)
    of = save(bounds.select("id").join(labels, F.col("id") == F.col("vertex"), "left").select("id", F.coalesce("label", "id").alias("cluster")))
    # equal but for the supplier's key, of which members share the code
    nodes = of.join(bounds.select("id", F.explode("bounds").alias("k", "v")), "id").groupBy("cluster", "k").agg(F.min("v").alias("v"))
    nodes = nodes.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("bounds"))
    none = "map_from_arrays(cast(array() AS array<string>), cast(array() AS array<array<string>>))"
    nodes = save(of.select("cluster").distinct().join(nodes, "cluster", "left").select("cluster", F.coalesce("bounds", F.expr(none)).alias("bounds")))
    l, r = of.withColumnsRenamed({"id": "left_id", "cluster": "u"}), of.withColumnsRenamed({"id": "right_id", "cluster": "v"})
    links = pairs.join(l, "left_id").join(r, "right_id").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    turn = 0
    while True:
        turn += 1
        links = links.groupBy("u", "v").agg(F.max("w").alias("w"))
        met = links.join(nodes.select(F.col("cluster").alias("u"), F.col("bounds").alias("x")), "u").join(nodes.select(F.col("cluster").alias("v"), F.col("bounds").alias("y")), "v")
        links = save(met.where(f"NOT {_APART}").select("u", "v", "w"))
        if links.isEmpty():
            break
        rank = F.struct("w", F.xxhash64("u", "v", F.lit(turn)).alias("h"), "u", "v")
        both = links.select(F.col("u").alias("end"), rank.alias("r")).unionByName(links.select(F.col("v").alias("end"), rank.alias("r")))
        named = both.groupBy("end").agg(F.max("r").alias("r")).groupBy("r.u", "r.v").agg(F.count(F.lit(1)).alias("n"))
        merged = save(named.where("n = 2").select(F.col("u").alias("into"), F.col("v").alias("gone")))
        moved = lambda df, c: df.join(merged, F.col(c) == F.col("gone"), "left").withColumn(c, F.coalesce("into", c)).drop("into", "gone")
        sides = nodes.join(merged, F.col("cluster") == F.col("gone")).select(F.col("into").alias("cluster"), F.col("bounds").alias("y"))
        grown = nodes.join(sides, "cluster").select("cluster", F.expr(_MET.replace("(x", "(bounds").replace("x[k]", "bounds[k]").replace("map_keys(x)", "map_keys(bounds)")).alias("bounds"))
        same = nodes.join(merged.select(F.explode(F.array("into", "gone")).alias("cluster")), "cluster", "left_anti")
        nodes, of = save(same.unionByName(grown)), save(moved(of, "cluster"))
        links = moved(moved(links, "u"), "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    least = of.groupBy("cluster").agg(F.min("id").alias("least"))
    return of.join(least, "cluster").select(F.col("id").alias("listing_id"), F.col("least").alias("cluster"))


def representatives(members: DataFrame, feats: DataFrame) -> DataFrame:
    """ER09: the member that has most of its cluster's words; the least id wins ties."""
    words = members.join(feats.select("listing_id", F.explode("core_words").alias("word")), "listing_id")
    spread = words.groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    total = words.join(spread, ["cluster", "word"]).groupBy("cluster", "listing_id").agg(F.avg("n").alias("overlap"))
    best = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("overlap"), "listing_id"))
    return total.withColumn("rn", best).where("rn = 1").select("cluster", F.col("listing_id").alias("representative"))


def canonical_ids(members: DataFrame, feats: DataFrame) -> DataFrame:
    """ER10, ER11: (cluster, canonical_id): a digest of what the cluster is (brand, model, pack, variant), whatever
    its order or neighbours; equal digests are numbered by least member."""
    text = lambda c: F.array_join(F.array_sort(c), " ")
    variant = F.array_join(F.transform(F.array_sort(F.map_entries("axes")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    own = feats.select("listing_id", text("brand_words").alias("brand"), "code", F.coalesce(F.col("pack").cast("string"), F.lit("")).alias("pack"), text("core_words").alias("model"), variant.alias("variant"))
    key = members.join(own, "listing_id").groupBy("cluster").agg(F.concat_ws("|", F.min("brand"), F.min("code"), F.min("pack"), F.min("model"), F.min("variant")).alias("content"), F.min("listing_id").alias("first"))
    digest = key.withColumn("d", F.substring(F.sha1("content"), 1, 12))
    n = F.row_number().over(W.partitionBy("d").orderBy("content", "first"))
    return digest.withColumn("n", n).select("cluster", F.concat(F.lit("mcp_auto_"), "d", F.when(F.col("n") > 1, F.concat(F.lit("_"), "n")).otherwise("")).alias("canonical_id"))


def _variants(members: DataFrame, feats: DataFrame) -> DataFrame:
    """(cluster, brand_words, core_words, model, s) of clusters with an axis that they can be a variant on: all
    members that state the axis agree on one value, and s is the first such axis by priority."""
    axes = members.join(feats.select("listing_id", F.explode("axes").alias("axis", "v")), "listing_id")
    agreed = axes.groupBy("cluster", "axis").agg(F.array_distinct(F.flatten(F.collect_set("v"))).alias("v")).where("size(v) = 1").select("cluster", "axis", F.get("v", 0).alias("value"))
    shown = None
    for a, x in A.SELECTORS.items():
        f = F.struct(F.lit(x.priority).alias("priority"), F.lit(a).alias("axis"), A.format_variant(a, F.col("value")).alias("f"), F.col("value").alias("value"))
        shown = F.when(F.col("axis") == a, f) if shown is None else shown.when(F.col("axis") == a, f)
    best = agreed.withColumn("s", shown).where("s IS NOT NULL").groupBy("cluster").agg(F.min("s").alias("s"))
    first = members.groupBy("cluster").agg(F.min("listing_id").alias("listing_id"))
    words = first.join(feats.select("listing_id", "brand_words", "core_words"), "listing_id").join(best, "cluster")
    says = lambda axis: lambda w: A.is_strip_token(w, axis)
    kept = F.lit(None).cast("array<string>")
    for a in A.SELECTORS:
        kept = F.when(F.col("s.axis") == a, F.filter("core_words", lambda w: ~says(a)(w))).otherwise(kept)  # noqa: B023
    return words.withColumn("model", F.array_sort(kept)).where("size(brand_words) > 0 OR size(model) >= 3")


def bridge_orphans(groups: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ER14: (cluster, into) for groups (cluster, family, brand, model, core_words, axis, value) of one cluster that go
    to a family of two or more: the family has three words or more and the orphan's name all of them, the axis is
    the same, the brands are equal or one is not stated, and the family lacks the value.  Orphans choose in order
    of their cluster, each the largest family (then the least) that still lacks its value.

    All families are ranked alike, so the choices one after the other are those of rounds: each orphan that holds no
    place asks for its next one, of those that ask for a value of a family or hold it the least cluster has it, and
    only the others ask again.  Rounds end when none asks."""
    size = groups.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    lone = groups.join(size.where("n = 1").select("family"), "family", "left_semi")
    large = groups.join(size.where("n >= 2"), "family").where("size(model) >= 3").groupBy("family").agg(F.first("brand").alias("b"), F.first("model").alias("m"), F.first("axis").alias("axis"), F.first("n").alias("n"))
    # a family is found by its rarest word alone, as an orphan has to have all of them
    spread = large.select("family", F.explode(F.array_distinct("m")).alias("word"))
    rare = spread.join(spread.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "word").groupBy("family").agg(F.min(F.struct("df", "word")).alias("k"))
    keyed = large.join(rare, "family").select(F.col("family").alias("into"), "b", "m", "axis", "n", F.col("k.word").alias("word"))
    met = lone.withColumn("word", F.explode(F.array_distinct("core_words"))).join(keyed, ["axis", "word"])
    met = met.where((F.size(F.array_except("m", "core_words")) == 0) & ((F.col("brand") == F.col("b")) | (F.col("brand") == "") | (F.col("b") == "")))
    has = groups.select(F.col("family").alias("into"), "value").distinct()
    places = save(met.join(has, ["into", "value"], "left_anti").select("cluster", "value", F.struct((-F.col("n")).alias("n"), "into").alias("place")))
    held, asking = None, places
    while True:
        asks = asking.groupBy("cluster", "value").agg(F.min("place").alias("place"))
        first = F.min("cluster").over(W.partitionBy("place.into", "value"))
        met = save((asks if held is None else held.unionByName(asks)).withColumn("first", first))
        held, lost = met.where("cluster = first").drop("first"), met.where("cluster <> first").select("cluster", F.col("place").alias("at"))
        if lost.isEmpty():
            return held.select("cluster", F.col("place.into").alias("into"))
        asking = places.join(lost, "cluster").where(F.col("place") > F.col("at")).drop("at")


def families(members: DataFrame, feats: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """ER12 to ER15: (cluster, family, axis, value, label, rank) of clusters that are variants of one product: equal
    brand and core words but for those that say the axis, orphans bridged, two members and two labels or more."""
    keyed = _variants(members, feats)
    brand = F.array_join("brand_words", " ")
    key = F.sha1(F.concat_ws("|", brand, F.array_join("model", " "), "s.axis"))
    rows = save(keyed.select("cluster", key.alias("family"), brand.alias("brand"), "model", "core_words", "s.axis", "s.value", "s.f.label", "s.f.rank"))
    into = bridge_orphans(rows, save)
    rows = rows.join(into, "cluster", "left").withColumn("family", F.coalesce("into", "family")).select("cluster", "family", "axis", "value", "label", "rank")
    good = rows.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels")).where("n >= 2 AND labels >= 2")
    return rows.join(good.select("family"), "family", "left_semi")


def substitutes(products: DataFrame, least: float = 0.5, most: int = 5) -> DataFrame:
    """ER16: (id, substitute_id, likeness, saving, rank) of products (id, words, brand_words, axes, unit_price,
    n_suppliers): for each product of two suppliers or more, the ``most`` cheapest of those that share ``least`` of
    their core words or more (Jaccard), state no conflicting axis value, are of another or an unknown brand, and
    cost less a unit.

    Word sets are compared once each (``similar_sets``).  Products that agree in words, brand and axes
    stand in for one another, so only the cheapest ``most`` of them are met."""
    p = products.where("unit_price > 0").select("id", F.array_sort(F.array_distinct("words")).alias("words"), F.array_join("brand_words", " ").alias("brand"), F.sort_array(F.map_entries("axes")).alias("axes"), "unit_price", "n_suppliers").where("size(words) > 0")
    sets = p.select("words").distinct().select(F.sha1(F.array_join("words", " ")).alias("left_set"), F.col("words").alias("left_words"))
    alike = similar_sets(sets, sets.withColumnsRenamed({"left_set": "right_set", "left_words": "right_words"}), least)
    own = p.withColumn("set", F.sha1(F.array_join("words", " "))).drop("words")
    cheap = F.row_number().over(W.partitionBy("set", "brand", "axes").orderBy("unit_price", "id"))
    offers = own.withColumn("c", cheap).where(F.col("c") <= most).select(F.col("set").alias("right_set"), F.col("id").alias("substitute_id"), F.col("brand").alias("other"), F.col("axes").alias("y"), F.col("unit_price").alias("price"))
    wanted = own.where("n_suppliers >= 2").select(F.col("set").alias("left_set"), "id", "brand", "axes", "unit_price")
    # products of one set, brand and axes have the same candidates, of which each takes the first that are cheaper than it
    asked = wanted.select("left_set", "brand", "axes").distinct()
    fits = asked.select("left_set", "axes").distinct().join(alike, "left_set").join(offers.select("right_set", "y").distinct(), "right_set").where(~A.axes_conflict(F.map_from_entries("axes"), F.map_from_entries("y")))
    first = F.row_number().over(W.partitionBy("left_set", "axes", "other").orderBy("price", "substitute_id"))
    near = fits.join(offers, ["right_set", "y"]).withColumn("c", first).where(F.col("c") <= most).select("left_set", "axes", "other", "substitute_id", "likeness", "price")
    met = asked.join(near, ["left_set", "axes"]).where((F.col("brand") != F.col("other")) | (F.col("brand") == ""))
    rank = F.row_number().over(W.partitionBy("left_set", "brand", "axes").orderBy("price", "substitute_id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= most).select("left_set", "brand", "axes", "substitute_id", "likeness", "price", "rank")
    found = wanted.join(best, ["left_set", "brand", "axes"]).where(F.col("price") < F.col("unit_price"))
    return found.select("id", "substitute_id", F.round("likeness", 9).alias("likeness"), (F.col("unit_price") - F.col("price")).alias("saving"), F.least(F.lit(69), F.floor(F.col("likeness") * 69)).cast("int").alias("confidence"), "rank")


def cheaper_elsewhere(offers: DataFrame, most: int = 5) -> DataFrame:
    """(canonical_id, substitute_id, saving) of products (canonical_id, name, size, brand, best_cents, n_suppliers): for each
    of two suppliers or more, the ``most`` cheapest of its name and size, of another brand, that cost less.

    Products of one name, size and brand have the same candidates.  Of a brand no more than ``most`` can be wanted, and
    leaving out one brand leaves out no more than so many, so the first 2 x ``most`` of a name and size are enough."""
    order = [F.col("best_cents"), F.col("canonical_id")]
    own = offers.where("name IS NOT NULL AND size IS NOT NULL AND brand IS NOT NULL AND best_cents IS NOT NULL")
    first = lambda df, n, *keys: df.withColumn("c", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("c") <= n)
    near = first(first(own, most, "name", "size", "brand"), 2 * most, "name", "size")
    wanted = own.where("n_suppliers >= 2")
    met = wanted.select("name", "size", "brand").distinct().join(near.select("name", "size", F.col("brand").alias("other"), "canonical_id", "best_cents"), ["name", "size"]).where("brand <> other")
    best = first(met, most, "name", "size", "brand").select("name", "size", "brand", F.col("canonical_id").alias("substitute_id"), F.col("best_cents").alias("price"))
    return wanted.join(best, ["name", "size", "brand"]).where("price < best_cents").select("canonical_id", "substitute_id", (F.col("best_cents") - F.col("price")).alias("saving"))


def discover_axes(members: DataFrame, feats: DataFrame, min_stem: int = 2) -> DataFrame:
    """ER18: (brand, stem, n_values, n_clusters, n_suppliers, example) of words that set clusters of one brand apart
    and no selector knows: clusters without an axis value of a selector whose core words, axis words left out, are
    equal but for one word each; ``min_stem`` words or more are in common, and two clusters and two values there."""
    stated = F.size(F.filter(F.map_entries("axes"), lambda e: e["key"].isin(list(A.SELECTORS)))) > 0
    own = members.join(feats.select("listing_id", "supplier_id", stated.alias("stated"), "brand_words", "core_words"), "listing_id")
    one = own.groupBy("cluster").agg(F.bool_or("stated").alias("stated"), F.min_by(F.struct("brand_words", "core_words"), "listing_id").alias("f")).where("NOT stated")
    plain = F.array_sort(F.filter("f.core_words", lambda w: ~A.is_strip_token(w)))
    words = one.select("cluster", F.array_join("f.brand_words", " ").alias("brand"), plain.alias("core")).where(F.size("core") > min_stem)
    left_out = words.select("cluster", "brand", F.explode("core").alias("value"), "core")
    stems = left_out.select("cluster", "brand", "value", F.array_join(F.array_remove("core", F.col("value")), " ").alias("stem"))
    sold = own.select("cluster", "supplier_id").distinct()
    found = stems.groupBy("brand", "stem").agg(F.count_distinct("value").alias("n_values"), F.count_distinct("cluster").alias("n_clusters"), F.min("value").alias("example")).where("n_values >= 2 AND n_clusters >= 2")
    spread = stems.join(found.select("brand", "stem"), ["brand", "stem"], "left_semi").select("brand", "stem", "cluster").distinct().join(sold, "cluster").groupBy("brand", "stem").agg(F.count_distinct("supplier_id").alias("n_suppliers"))
    return found.join(spread, ["brand", "stem"]).select("brand", "stem", "n_values", "n_clusters", "n_suppliers", "example")
