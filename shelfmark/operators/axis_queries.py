"""Queries over variant axes, packs, labels, versions and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import axes as A, codes as C, packs as P
from ..session import spread

DEPARTMENTS = [("Metals", ["steel", "brass", "copper", "nickel", "tin"]), ("Economy", ["economy", "promo"]), ("Standard", ["standard"]), ("Other", ["small", "medium", "large"])]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("part", "orders") else df


def _named(spark: SparkSession, sf_dir: str, first: str = "p_name") -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.expr(first), F.concat("p_size", F.lit("mm")), F.when(F.col("p_size") % 2 == 0, "Blue").otherwise("Small"), F.concat(F.lit("#"), F.col("p_partkey") % 9), F.concat("p_size", F.lit("/Box"))).alias("name"), "p_type", "p_brand", "p_size")


def c28_axis_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = A.axis_values("name")
    return _named(spark, sf_dir, "'Item'").select("p_partkey", F.array_join(v["mm"], "|").alias("mm"), F.array_join(v["color"], "|").alias("color"), F.array_join(v["#"], "|").alias("hash"), F.array_join(v["size"], "|").alias("size"))


def c29_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("p_partkey", A.selector(A.axis_values("name")).alias("s")).select("p_partkey", "s.axis", "s.label", "s.value")


def c09_parse_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs from the name, as a case of units, as a product, and none."""
    kind = F.col("p_partkey") % 4
    size = F.when(kind == 1, F.concat(F.lit("Case of "), "p_size")).when(kind == 2, F.concat("p_size", F.lit(" x 10"))).when(kind == 3, "Set-up tray")
    pack = P.parse_pack(size, F.when(kind == 0, F.concat_ws(" ", "p_name", F.concat("p_size", F.lit("/Box")))).otherwise(F.col("p_name")))
    return _read(spark, sf_dir, "part").select("p_partkey", pack.alias("p")).select("p_partkey", F.col("p.pack_quantity").cast("int").alias("qty"), "p.basis", "p.confidence", "p.source")


def f31_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", A.taxonomy(F.col("p_type"), F.col("p_name"), DEPARTMENTS).alias("department"))


def f35_name_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against themselves with another pack word, with one more word, and in another order."""
    p = _named(spark, sf_dir)
    other = F.when(F.col("p_partkey") % 3 == 0, F.regexp_replace("name", "/Box", "/bx")).when(F.col("p_partkey") % 3 == 1, F.concat("name", F.lit(" large"))).otherwise(F.array_join(F.reverse(F.split("name", " ")), ", "))
    return p.select("p_partkey", A.listing_name_differs(F.col("name"), other).alias("differs"))


def f36_pack_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    quantity = F.when(kind != 2, F.col("p_size"))
    label = A.pack_label(quantity, F.when(kind == 3, "each").otherwise("box"), F.when(kind == 1, "ml").otherwise("each"), F.when(kind == 2, F.concat(F.col("p_size") + 1, F.lit("/bx"))).otherwise(""))
    return _read(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


def f41_family_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("p_partkey", A.family_name("name").alias("family"))


def f22_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part whose type shares most words with each brand's first type; the shorter name wins ties."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split(F.lower("p_type"), " ").alias("w"), F.length("p_type").alias("n"))
    first = p.groupBy("p_brand").agg(F.min_by("w", "p_partkey").alias("seed"))
    scored = p.join(first, "p_brand").withColumn("hits", F.size(F.array_intersect("w", "seed")))
    rn = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("hits"), "n", "p_partkey"))
    return scored.withColumn("rn", rn).where("rn = 1").select("p_brand", "p_partkey", "hits")


def f37_variant_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a family's variants; the pack goes from a label where it tells nothing apart."""
    p = _named(spark, sf_dir)
    packs = p.groupBy("p_type").agg(F.count_distinct("p_size").alias("n_packs"))
    return p.join(packs, "p_type").select("p_type", "p_partkey", F.when(F.col("n_packs") <= 1, A.family_name("name")).otherwise(F.col("name")).alias("label"))


def c04_base_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("1"), F.lpad(F.col("p_partkey").cast("string"), 12, "0"))
    return _read(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey", F.size(C.base_unit_variants(F.concat(body, C.check_digit(body)))).alias("n"))


def c15_ground_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the nearest of a supplier's two sites to each customer."""
    miles = F.least(*[C.haversine_miles(F.lit(lat), F.lit(lon), F.lit(25.0) + F.col("c_nationkey"), F.lit(-90.0)) for lat, lon in ((40.0, -75.0), (34.0, -118.0))])
    return _read(spark, sf_dir, "customer").select("c_custkey", C.ground_days(miles).alias("days"))


def c26_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is a version of its conversation, one that answers an accepted one: numbered, and an accepted one is
    superseded by the next; the others stay pending."""
    t = _read(spark, sf_dir, "conversations").withColumn("taken", F.col("role") == "assistant")
    w = W.partitionBy("conv_id").orderBy("turn")
    after = F.min(F.when(F.col("taken"), F.col("turn"))).over(w.rowsBetween(1, W.unboundedFollowing))
    status = F.when(~F.col("taken"), "pending").when(after.isNull(), "accepted").otherwise("superseded")
    return t.select("conv_id", "turn", F.row_number().over(w).alias("version"), status.alias("status"), F.when(F.col("taken"), after).alias("superseded_by"))


def c27_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("present"))
    return e.select("user_id", F.explode(F.array_except(F.array(F.lit("click"), F.lit("view"), F.lit("audit")), "present")).alias("missing"))


def er14_orphan_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings alone in their (name, brand) join the largest family of the name with two or more members and
    a size it lacks.  One pass: targets do not grow."""
    p = _read(spark, sf_dir, "part")
    groups = p.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("family"), F.collect_set("p_size").alias("sizes"))
    lone = p.join(groups.where("n = 1").select("p_name", "p_brand"), ["p_name", "p_brand"]).select("p_partkey", "p_name", "p_size")
    met = lone.join(groups.where("n >= 2").select("p_name", "n", "family", "sizes"), "p_name").where(~F.array_contains("sizes", F.col("p_size")))
    return met.groupBy("p_partkey").agg(F.min(F.struct(-F.col("n"), "family")).alias("b")).select("p_partkey", F.col("b.family").alias("family"))


QUERIES = {f.__name__: f for f in (
    c28_axis_values, c29_selector, c09_parse_pack, f31_taxonomy, f35_name_differs, f36_pack_label, f41_family_name, f22_anchor, f37_variant_options,
    c04_base_units, c15_ground_days, c26_versions, c27_gaps, er14_orphan_bridge,
)}
ORACLES = {
    "f31_taxonomy": "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Economy' WHEN p_type = 'STANDARD' THEN 'Standard' ELSE 'Other' END AS department FROM part",
    "c15_ground_days": """
        SELECT c_custkey, CASE WHEN m <= 150 THEN 1 WHEN m <= 450 THEN 2 WHEN m <= 900 THEN 3 WHEN m <= 1500 THEN 4 WHEN m <= 2200 THEN 5 ELSE 6 END AS days FROM (
          SELECT c_custkey, least(2 * 3959 * asin(sqrt(power(sin(radians(25.0 + c_nationkey - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(25.0 + c_nationkey)) * power(sin(radians(-90.0 + 75.0) / 2), 2))),
            2 * 3959 * asin(sqrt(power(sin(radians(25.0 + c_nationkey - 34.0) / 2), 2) + cos(radians(34.0)) * cos(radians(25.0 + c_nationkey)) * power(sin(radians(-90.0 + 118.0) / 2), 2)))) AS m FROM customer) q""",
    "c28_axis_values": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS mm, CASE WHEN p_size % 2 = 0 THEN 'blue' END AS color, CAST(p_partkey % 9 AS VARCHAR) AS hash, CASE WHEN p_size % 2 <> 0 THEN 'S' END AS size FROM part",
    "c29_selector": """
        SELECT p_partkey, CASE WHEN s <> l THEN 'size' ELSE '#' END AS axis, CASE WHEN s <> l THEN 'Size' ELSE 'Number' END AS label, CASE WHEN s AND NOT l THEN 'S' WHEN l AND NOT s THEN 'L' ELSE CAST(p_partkey % 9 AS VARCHAR) END AS value
        FROM (SELECT p_partkey, p_name LIKE '%small%' OR p_size % 2 <> 0 AS s, p_name LIKE '%large%' AS l FROM part) q""",
    "c09_parse_pack": """
        SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN p_size * 10 WHEN 3 THEN NULL ELSE p_size END AS qty, CASE p_partkey % 4 WHEN 0 THEN 'box' WHEN 3 THEN NULL ELSE 'case' END AS basis,
               CASE p_partkey % 4 WHEN 0 THEN 0.7 WHEN 3 THEN NULL ELSE 0.92 END AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'name' WHEN 3 THEN NULL ELSE 'pack_size' END AS source FROM part""",
    "f35_name_differs": "SELECT p_partkey, p_partkey % 3 = 1 AND p_name NOT LIKE '%large%' AS differs FROM part",
    "f36_pack_label": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '/Box') WHEN 1 THEN concat(p_size, ' ml') WHEN 2 THEN concat(p_size + 1, '/Box') ELSE concat(p_size, '/Pack') END AS label FROM part",
    "c04_base_units": "SELECT p_partkey, 4 AS n FROM part WHERE p_partkey > 0",
    "c26_versions": """
        SELECT t.conv_id, t.turn, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn) AS version, CASE WHEN t.role <> 'assistant' THEN 'pending' WHEN n.next_turn IS NULL THEN 'accepted' ELSE 'superseded' END AS status, n.next_turn AS superseded_by
        FROM conversations t LEFT JOIN (SELECT a.conv_id, a.turn, min(b.turn) AS next_turn FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn > a.turn AND b.role = 'assistant' WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn) n
          ON n.conv_id = t.conv_id AND n.turn = t.turn""",
    "c27_gaps": "SELECT u.user_id, t.missing FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('view'), ('audit')) t(missing) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.missing)",
    "er14_orphan_bridge": """
        WITH g AS (SELECT p_name, p_brand, count(*) AS n, min(p_partkey) AS family FROM part GROUP BY p_name, p_brand)
        SELECT p_partkey, family FROM (SELECT l.p_partkey, t.family, row_number() OVER (PARTITION BY l.p_partkey ORDER BY t.n DESC, t.family) AS rn
          FROM part l JOIN g ON g.p_name = l.p_name AND g.p_brand = l.p_brand AND g.n = 1 JOIN g t ON t.p_name = l.p_name AND t.n >= 2
          WHERE NOT EXISTS (SELECT 1 FROM part x WHERE x.p_name = t.p_name AND x.p_brand = t.p_brand AND x.p_size = l.p_size)) q WHERE rn = 1""",
}
