"""Nested responses, anchors of search seeds, option lists of variants, and versions that keep what they captured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import axes as A, text as T
from ..plans import catalog

# --- fixed values
ANCHOR_STOPWORDS = r"(?i)\b(?:dental|disposable)\b"
PACK_TOKEN, PACK_SUFFIX = r"(\d+)\s*/\s*([A-Za-z.]+)", r"\s*[-–—]\s*\d+\s*/\s*[A-Za-z.]+\s*$"
FROZEN_VERSION_FIELDS = (
    "evidence_document_id", "practice_id", "version_number", "file_name", "file_mime_type", "file_extension", "file_size_bytes",
    "storage_key", "file_hash", "extracted_fields", "source_kind", "captured_by", "captured_at",
)
# --- end of the fixed values


def nest(rows: DataFrame, keys: list[str], name: str, fields: list[str], most: int | None = None) -> DataFrame:
    """A row for each of ``keys``, with its rows as an array ``name`` of structs of ``fields``, in the order of the
    fields; the first ``most`` only, which are chosen before they are brought together."""
    if most is not None:
        first = F.row_number().over(W.partitionBy(*keys).orderBy(*fields))
        rows = rows.withColumn("_rank", first).where(F.col("_rank") <= most).drop("_rank")
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def j14_report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each report with its practice and its opportunities as a list of records (as JSON)."""
    rows = catalog.run(spark, sf_dir, "SELECT m.practice_id, c.c_mktsegment AS segment, m.invoice_id, m.line_no, m.listing_id, m.savings_cents FROM line_match m JOIN customer c ON c.c_custkey = m.practice_id WHERE m.savings_cents > 0")
    return nest(rows, ["practice_id", "segment", "invoice_id"], "opportunities", ["line_no", "listing_id", "savings_cents"]).withColumn("opportunities", F.to_json("opportunities"))


def v23_quote_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request with its first three quotes as a list of records (as JSON)."""
    rows = catalog.run(spark, sf_dir, "SELECT invoice_id, line_no, supplier_id, listing_id, paid_cents FROM invoice_line")
    return nest(rows, ["invoice_id"], "quotes", ["line_no", "supplier_id", "listing_id", "paid_cents"], 3).withColumn("quotes", F.to_json("quotes"))


def _tokens(c: str | Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 2)


def best_anchors(seeds: DataFrame, products: DataFrame) -> DataFrame:
    """(seed_id, product_id, score) of the product whose name has most of the words of a seed (id, text), generic words
    left out, in percent; the shorter name wins ties, then the least id.  Names are compared once each, those that
    share a word with the seed only; a seed without any gets the shortest name of all."""
    s = seeds.select(F.col("id").alias("seed_id"), F.array_distinct(_tokens(F.regexp_replace("text", ANCHOR_STOPWORDS, " "))).alias("known"))
    names = products.groupBy("name").agg(F.min("id").alias("product_id")).withColumn("wanted", _tokens("name"))
    words = names.where("size(wanted) > 0").select("name", "product_id", F.size("wanted").alias("n"), F.explode("wanted").alias("w"))
    hits = s.select("seed_id", F.explode("known").alias("w")).join(words, "w").groupBy("seed_id", "name", "product_id", "n").agg(F.count(F.lit(1)).alias("hits"))
    score = F.floor(100 * F.col("hits") / F.col("n") + 0.5).cast("int")
    best = hits.groupBy("seed_id").agg(F.min(F.struct((-score).alias("score"), F.length("name").alias("size"), "product_id")).alias("b")).select("seed_id", "b.product_id", (-F.col("b.score")).alias("score"))
    shortest = names.agg(F.min(F.struct(F.length("name").alias("size"), F.col("product_id").alias("any")))["any"].alias("any"))  # one row
    all_ = s.select("seed_id").join(best, "seed_id", "left").join(F.broadcast(shortest))
    return all_.select("seed_id", F.coalesce("product_id", "any").alias("product_id"), F.coalesce("score", F.lit(0)).alias("score")).where("product_id IS NOT NULL")


def f22_seed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of part, with generic words, as a seed, against all parts' names."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    seeds = p.groupBy("p_type").agg(F.min("p_partkey").alias("id")).select("id", F.concat(F.lit("Dental disposable "), "p_type").alias("text"))
    return best_anchors(seeds, p.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name")))


def variant_options(variants: DataFrame) -> DataFrame:
    """(family, option, label, positions) of variants (family, position, label), positions from 0: the pack goes from the
    end of a label where the family has one pack at most, and labels that then agree (packs written alike, any case)
    are one option, by the label of its first position."""
    raw = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("Option "), F.col("position") + 1))
    token = F.lower(A.normalize_pack_text(F.regexp_extract(F.coalesce("label", F.lit("")), PACK_TOKEN, 0)))
    rows = variants.select("family", "position", raw.alias("raw"), F.nullif(token, F.lit("")).alias("pack"))
    packs = rows.groupBy("family").agg((F.coalesce(F.min("pack") == F.max("pack"), F.lit(True))).alias("one"))
    bare = F.trim(F.regexp_replace("raw", PACK_SUFFIX, ""))
    rows = rows.join(packs, "family").withColumn("label", F.when(F.col("one") & (bare != ""), bare).otherwise(F.col("raw")))
    options = rows.groupBy("family", F.lower(A.normalize_pack_text(F.col("label"))).alias("key")).agg(F.min_by("label", "position").alias("label"), F.array_sort(F.collect_list("position")).alias("positions"))
    order = F.row_number().over(W.partitionBy("family").orderBy(F.element_at("positions", 1)))
    return options.select("family", (order - 1).alias("option"), "label", "positions")


def f37_option_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of each kind of part by size; one pack everywhere in some kinds, written in two ways."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    unit = F.when(F.col("p_partkey") % 2 == 0, "/Bx").otherwise("/Box")
    pack = F.when(F.length("p_type") % 2 == 0, F.lit(5)).otherwise(F.col("p_partkey") % 3 + 5)
    position = F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey")) - 1
    rows = p.select(F.col("p_type").alias("family"), position.alias("position"), F.concat("p_size", F.lit(" ga - "), pack, unit).alias("label"))
    return variant_options(rows).withColumn("positions", F.array_join("positions", ","))


def apply_status_updates(versions: DataFrame, patches: DataFrame) -> DataFrame:
    """``versions`` (by id) with the columns that ``patches`` (id and some of their columns) give them; a patch that
    would change what a version captured is an error."""
    columns = [c for c in patches.columns if c != "id"]
    right = patches.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    hit = F.col("_id").isNotNull()

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        if c not in FROZEN_VERSION_FIELDS:
            return F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(hit & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.raise_error(F.lit(f"evidence version field {c} is immutable")).cast(versions.schema[c].dataType)).otherwise(F.col(c)).alias(c)

    return versions.join(right, F.col("id") == F.col("_id"), "left").select(*[value(c) for c in versions.columns])


QUERIES = {f.__name__: f for f in (j14_report_lists, v23_quote_lists, f22_seed_anchors, f37_option_lists)}
_W = "list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 2)"
ORACLES = {
    "j14_report_lists": catalog.oracle_text("SELECT m.practice_id, c.c_mktsegment AS segment, m.invoice_id, m.line_no, m.listing_id, m.savings_cents FROM line_match m JOIN customer c ON c.c_custkey = m.practice_id WHERE m.savings_cents > 0"),
    "v23_quote_lists": catalog.oracle_text("SELECT invoice_id, line_no, supplier_id, listing_id, paid_cents, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no, supplier_id, listing_id, paid_cents) AS place FROM invoice_line"),
    "f22_seed_anchors": f"""
        WITH p AS (SELECT concat(p_name, ' ', p_type) AS name, min(p_partkey) AS id FROM part GROUP BY 1),
             s AS (SELECT min(p_partkey) AS seed_id, {_W.format("p_type")} AS known FROM part GROUP BY p_type),
             x AS (SELECT seed_id, id, name, CAST(floor(100.0 * len(list_filter({_W.format("name")}, lambda w: list_contains(known, w))) / len({_W.format("name")}) + 0.5) AS INTEGER) AS score FROM s, p)
        SELECT seed_id, id AS product_id, score FROM (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, length(name), id) AS rn FROM x) q WHERE rn = 1""",
    "f37_option_lists": """
        WITH v AS (SELECT p_type AS family, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS position, p_size, CASE WHEN length(p_type) % 2 = 0 THEN 5 ELSE p_partkey % 3 + 5 END AS n, p_partkey % 2 = 0 AS short FROM part),
             f AS (SELECT family, count(DISTINCT n) <= 1 AS one FROM v GROUP BY family),
             o AS (SELECT v.family, CASE WHEN one THEN concat(p_size, ' ga') ELSE concat(p_size, ' ga - ', n) END AS k, min(position) AS first, list(position ORDER BY position) AS positions,
                     arg_min(CASE WHEN one THEN concat(p_size, ' ga') ELSE concat(p_size, ' ga - ', n, CASE WHEN short THEN '/Bx' ELSE '/Box' END) END, position) AS label FROM v JOIN f ON f.family = v.family GROUP BY 1, 2)
        SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY first) - 1 AS INTEGER) AS option, label, array_to_string(positions, ',') AS positions FROM o""",
}
ORACLES["j14_report_lists"] = f"SELECT practice_id, segment, invoice_id, CAST(to_json(list({{'line_no': line_no, 'listing_id': listing_id, 'savings_cents': savings_cents}} ORDER BY line_no, listing_id, savings_cents)) AS VARCHAR) AS opportunities FROM ({ORACLES['j14_report_lists']}) r GROUP BY practice_id, segment, invoice_id"
ORACLES["v23_quote_lists"] = f"SELECT invoice_id, CAST(to_json(list({{'line_no': line_no, 'supplier_id': supplier_id, 'listing_id': listing_id, 'paid_cents': paid_cents}} ORDER BY place)) AS VARCHAR) AS quotes FROM ({ORACLES['v23_quote_lists']}) r WHERE place <= 3 GROUP BY invoice_id"
