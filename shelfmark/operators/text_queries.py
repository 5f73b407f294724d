"""Queries for text, code and record functions, each over a whole table, with SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import axes as A, codes as C, ingest_text as I, labels as L, taxonomy as X, text as T
from ..session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("part", "orders") else df


def _add(name: str, table: str, key: str, make: Callable[[], dict[str, Column]], oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _read(spark, sf_dir, table).select(key, *[c.alias(n) for n, c in make().items()])
    ORACLES[name] = f"SELECT {key}, {oracle} FROM {table}"


_text = lambda *parts: F.concat(*[F.lit(p[1:]) if p.startswith("=") else F.col(p).cast("string") for p in parts])

_add("f01_strip_diacritics", "documents", "doc_id", lambda: {"n": F.length(T.strip_diacritics("text")), "md5": F.md5(T.strip_diacritics("text"))}, "length(strip_accents(coalesce(text, ''))) AS n, md5(strip_accents(coalesce(text, ''))) AS md5")
_add("f06_brands_agree", "part", "p_partkey", lambda: {"relation": T.brands_agree(T.brand_tokens(F.when(F.col("p_partkey") % 3 > 0, F.concat("p_brand", F.lit(" Inc")))), T.brand_tokens(F.concat(F.lit("Brand "), F.col("p_size") % 25)))},
     "CASE WHEN p_partkey % 3 = 0 THEN 'unknown' ELSE 'match' END AS relation")
_add("f08_stem", "part", "p_partkey", lambda: {"w": T.stem(F.concat("p_name", F.element_at(F.array(*map(F.lit, ("s", "ss", "", "7s"))), (F.col("p_partkey") % 4 + 1).cast("int"))))},
     "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'ss' WHEN 2 THEN '' ELSE '7s' END) AS w")
_add("f11_core_words", "part", "p_partkey", lambda: {"core": F.array_join(T.core_tokens(T.tokenize_name(_text("p_name", "= box of ", "p_size", "=ml K", "p_partkey", "=123 a")), F.array(F.lit("hot")), F.array(F.concat(F.lit("K"), "p_partkey", F.lit("123")))), " "), "cents": T.unit_price(F.floor(F.col("p_retailprice") * 100).cast("long"), F.nullif(F.col("p_size") % 5, F.lit(0)))},
     "array_to_string(list_filter(string_split(p_name, ' '), lambda w: w <> 'hot'), ' ') AS core, CAST(floor(floor(p_retailprice * 100) / CASE WHEN p_size % 5 = 0 THEN 1 ELSE p_size % 5 END + 0.5) AS BIGINT) AS cents")
_mm = lambda n: F.create_map(F.lit("mm"), F.array((F.col("p_size") % n).cast("string")), F.lit("color"), F.array(F.lit("blue"), F.element_at(F.split("p_name", " "), 1)))
_add("f14_axis_relations", "part", "p_partkey", lambda: {"conflict": A.axes_conflict(_mm(2), _mm(3)), "agreements": A.axis_agreements(_mm(2), _mm(3)), "bare": A.bare_conflict(F.array((F.col("p_size") % 7).cast("string")), F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("3"))).otherwise(F.array().cast("array<string>")))},
     "p_size % 2 <> p_size % 3 AS conflict, CASE WHEN p_size % 2 = p_size % 3 THEN 1 ELSE 0 END + CASE WHEN p_name LIKE 'blue%' THEN 1 ELSE 2 END AS agreements, p_partkey % 2 = 0 AND p_size % 7 <> 3 AS bare")
QUERIES["f16_pack_relation"] = lambda spark, sf_dir: _read(spark, sf_dir, "part").select("p_partkey", F.nullif(F.col("p_size") % 4, F.lit(0)).alias("a"), (F.col("p_partkey") % 4).alias("b")).select("p_partkey", T.pack_relation("a", "b").alias("relation"))
ORACLES["f16_pack_relation"] = "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'unknown' WHEN p_size % 4 = p_partkey % 4 THEN 'same' ELSE 'differs' END AS relation FROM part"
_add("f18_head_noun", "part", "p_partkey", lambda: {"head": T.head_noun(T.tokenize_name(_text("p_name", "= ", "p_size", "=mm ", "p_size", "= box of the")))}, "string_split(p_name, ' ')[2] AS head")
_add("f23_clean_text", "part", "p_partkey", lambda: {"name": A.decode_entities(_text("p_name", "=&trade;&nbsp;&nbsp;&amp; Co &lt;", "p_size", "=&gt;&#39; - Blue - Blue"))}, "concat(p_name, '™ & Co <', p_size, '>'' - Blue') AS name")
_add("f23_product_name", "part", "p_partkey", lambda: {"name": A.clean_product_name(_text("p_name", "=?Gloves? , &amp; Blue, ", "p_size", "=/Bx - blue / ", "p_size", "=/bx"))}, "concat(p_name, ' Gloves, & Blue, ', p_size, '/Bx') AS name")
_add("f30_lead_class", "documents", "doc_id", lambda: {"kind": I.classify_lead(F.concat("source", F.when(F.col("doc_id") % 3 == 0, " CATALOG add to cart").when(F.col("doc_id") % 3 == 1, " our dentists").otherwise(" none")))["kind"], "confidence": I.classify_lead(F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 3 == 0, " CATALOG add to cart").otherwise(" our dentists")))["confidence"]},
     "CASE WHEN source IS NULL THEN 'unknown' WHEN doc_id % 3 = 0 THEN 'supplier' WHEN doc_id % 3 = 1 THEN 'practice' ELSE 'unknown' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 70 ELSE 40 END AS confidence")
_RULES = [("Rings", ["ring", "round"]), ("Plates", ["plate"]), ("Cheap", ["economy", "promo"])]
_add("f34_department", "part", "p_partkey", lambda: {"department": A.taxonomy(F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), F.col("p_name"), _RULES)},
     "CASE WHEN p_partkey % 2 = 0 AND p_type IN ('ECONOMY', 'PROMO') THEN 'Cheap' WHEN p_name LIKE '%ring%' THEN 'Rings' WHEN p_name LIKE '%plate%' THEN 'Plates' END AS department")
_add("f38_identity_query", "part", "p_partkey", lambda: {"q": A.identity_query(_text("=Lot the ", "p_name", "= ", "p_name", "= x ", "p_size", "=mm for ", "p_type"))},
     "array_to_string(list_slice(CASE WHEN list_contains(string_split(p_name, ' '), lower(p_type)) THEN string_split(p_name, ' ') ELSE list_append(string_split(p_name, ' '), lower(p_type)) END, 1, 8), ' ') AS q")
_add("f39_catalog_refs", "part", "p_partkey", lambda: {"refs": F.array_join(A.catalog_refs(_text("=code AB1", "p_partkey", "=00 REF: 45-", "p_size", "=X and item no. ", "p_partkey", "=999")), "|")},
     "concat('45-', p_size, 'X|', p_partkey, '999|AB1', p_partkey, '00') AS refs")
_add("f40_lot_expiry", "orders", "o_orderkey", lambda: {"lot": A.lot_and_expiry(_text("=LOT# L", "o_orderkey", "=99 EXP: ", "o_orderdate"))["lot"], "expiry": A.lot_and_expiry(F.concat(F.lit("BATCH 5 use by 20"), F.date_format("o_orderdate", "yy/MM")))["expiry"]},
     "concat('L', o_orderkey, '99') AS lot, CAST(last_day(CAST(concat('20', strftime(o_orderdate, '%y-%m-01')) AS DATE)) AS DATE) AS expiry")
_BODY = "lpad(CAST(o_orderkey AS VARCHAR), 14, '0')"
_code = lambda: F.lpad(F.col("o_orderkey").cast("string"), 14, "0")
_day = lambda: F.date_format("o_orderdate", "yyMMdd")
_gs1 = lambda: F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("(01)"), _code(), F.lit("(10)L"), "o_orderkey", F.lit("(17)"), _day())).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("]d201"), _code(), F.lit("17"), _day(), F.lit("10L"), "o_orderkey")).otherwise(F.concat(F.lit("01"), _code(), F.lit("10L"), "o_orderkey", F.lit("\x1d17"), _day()))
_add("c05_parse_gs1", "orders", "o_orderkey", lambda: {n: F.get(F.transform(F.array(_gs1()), C.parse_gs1), 0)[n] for n in ("gtin", "lot", "expiry")},
     f"{_BODY} AS gtin, CASE WHEN o_orderkey % 3 <> 1 THEN concat('L', o_orderkey) END AS lot, CAST(concat('20', strftime(o_orderdate, '%y-%m-%d')) AS DATE) AS expiry")
_add("c07_parse_hibc", "orders", "o_orderkey", lambda: {n: C.parse_hibc(F.concat(F.lit("+H123P"), "o_orderkey", F.lit("0"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/$$3"), _day(), F.lit("LOT"), "o_orderkey", F.lit("C"))).otherwise("C")))[n] for n in ("lic", "pcn", "lot", "expiry")},
     "'H123' AS lic, concat('P', o_orderkey) AS pcn, CASE WHEN o_orderkey % 2 = 0 THEN concat('LOT', o_orderkey) END AS lot, CASE WHEN o_orderkey % 2 = 0 THEN CAST(concat('20', strftime(o_orderdate, '%y-%m-%d')) AS DATE) END AS expiry")


def c24_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .delivery import ladder

    tier = lambda least, flat: F.struct(least.cast("long").alias("min_subtotal_cents"), flat.cast("long").alias("flat_cents"))
    tiers = F.array(tier(F.col("s_suppkey") * 100, F.lit(495)), tier(F.lit(2500), F.col("s_suppkey") + 900))
    text = F.array_join(F.transform(ladder(tiers), lambda t: F.concat(F.floor(t["min"] * 100 + 0.5).cast("string"), F.lit("="), F.floor(t["flat"] * 100 + 0.5).cast("string"))), ",")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", text.alias("ladder"))


ORACLES["c24_ladder"] = """
    SELECT s_suppkey, CASE WHEN s_suppkey * 100 <= 2500 THEN concat(s_suppkey * 100, '=495,2500=', s_suppkey + 900) ELSE concat('2500=', s_suppkey + 900, ',', s_suppkey * 100, '=495') END AS ladder FROM supplier WHERE s_suppkey <> 25
    UNION ALL SELECT 25, '2500=495,2500=925' FROM supplier WHERE s_suppkey = 25"""


def f25_decode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes of three character sets, named, named in the page or not at all, and back."""
    ship(spark)
    d = _read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    latin = F.regexp_replace("text", "[^\\x00-\\xff]", "?")
    body = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-8")).when(F.col("doc_id") % 3 == 1, F.encode(latin, "ISO-8859-1")).otherwise(F.encode(F.concat(F.lit('<meta charset="utf-8">'), "text"), "UTF-8"))
    raw = d.select("doc_id", body.alias("body"), F.when(F.col("doc_id") % 3 == 1, F.lit("iso-8859-1")).alias("charset"))
    return I.decode_pages(raw).select("doc_id", F.md5("text").alias("md5"))


ORACLES["f25_decode_pages"] = """
    SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') ELSE concat('<meta charset="utf-8">', text) END) AS md5 FROM documents WHERE text IS NOT NULL"""


def f15_sku_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every part and its like with another code form: how much their codes say."""
    from . import matching as M

    p = _read(spark, sf_dir, "part")
    side = lambda shift, sku, name: M.features(p.select((F.col("p_partkey") * 2 + shift).alias("listing_id"), F.lit(f"s{shift}").alias("supplier_id"), sku.alias("sku"), F.col("p_brand").alias("brand"), name.alias("name"), F.lit("").alias("pack_size")))
    kind = F.col("p_partkey") % 3
    code = F.concat(F.lit("AB"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))
    left = side(0, code, F.col("p_name"))
    right = side(1, F.when(kind == 0, code).otherwise("X1"), F.when(kind == 1, F.concat("p_name", F.lit(" "), code)).otherwise(F.col("p_name")))
    pairs = p.select((F.col("p_partkey") * 2).alias("left_id"), (F.col("p_partkey") * 2 + 1).alias("right_id"))
    found = M._signals(pairs, left.unionByName(right))
    return found.select((F.col("left_id") / 2).cast("long").alias("p_partkey"), F.round("sku.score", 6).alias("score"), "sku.code")


ORACLES["f15_sku_evidence"] = """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.9 ELSE 0.0 END AS score, CASE WHEN p_partkey % 3 < 2 THEN concat('AB', lpad(CAST(p_partkey AS VARCHAR), 7, '0')) ELSE '' END AS code FROM part"""
QUERIES |= {f.__name__: f for f in (c24_ladder, f15_sku_evidence, f25_decode_pages)}

_SHAPES = ("'yyyy-MM-dd'", "'yyyy/MM'", "'MM/dd/yyyy'", "'dd.MM.yyyy'", "'dd MMM yyyy'", "'MMM yyyy'", "'yyyyMMdd'", "'MM/yy'")
_later = "(o_orderdate + INTERVAL 30 YEARS)"  # dates of this century
_printed = "CASE " + " ".join(f"WHEN o_orderkey % 8 = {k} THEN concat('use by ', date_format({_later}, {f}))" for k, f in enumerate(_SHAPES)) + " END"
_add("c08_expiry", "orders", "o_orderkey", lambda: {"expiry": L.expiry(_printed, short=True), "gs1": L.gs1_expiry(f"date_format({_later}, 'yyMM00')"), "misread": L.expiry(f"translate(date_format({_later}, 'MM.yyyy'), '1', 'I')")}, "")
ORACLES["c08_expiry"] = """
    SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 8 IN (1, 5, 7) THEN last_day(d) WHEN o_orderkey % 8 = 3 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END, '%Y-%m-%d') AS expiry,
           strftime(last_day(d), '%Y-%m-%d') AS gs1, strftime(last_day(d), '%Y-%m-%d') AS misread FROM (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 30 YEARS AS DATE) AS d FROM orders) q"""
_add("c15_zip_state", "customer", "c_custkey", lambda: {"state": L.state_of_zip(F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0"))}, "")
#: First and last prefix and state, stated apart from the code under test (fixed values).
_ZIPS = """
    (10, 27, 'MA'), (28, 29, 'RI'), (30, 38, 'NH'), (39, 49, 'ME'), (50, 59, 'VT'), (60, 69, 'CT'), (70, 89, 'NJ'), (100, 149, 'NY'), (150, 196, 'PA'),
    (197, 199, 'DE'), (200, 205, 'DC'), (206, 219, 'MD'), (220, 246, 'VA'), (247, 268, 'WV'), (270, 289, 'NC'), (290, 299, 'SC'), (300, 319, 'GA'),
    (320, 349, 'FL'), (350, 369, 'AL'), (370, 385, 'TN'), (386, 397, 'MS'), (398, 399, 'GA'), (400, 427, 'KY'), (430, 459, 'OH'), (460, 479, 'IN'),
    (480, 499, 'MI'), (500, 528, 'IA'), (530, 549, 'WI'), (550, 567, 'MN'), (570, 577, 'SD'), (580, 588, 'ND'), (590, 599, 'MT'), (600, 629, 'IL'),
    (630, 658, 'MO'), (660, 679, 'KS'), (680, 693, 'NE'), (700, 714, 'LA'), (716, 729, 'AR'), (730, 749, 'OK'), (750, 799, 'TX'), (800, 816, 'CO'),
    (820, 831, 'WY'), (832, 838, 'ID'), (840, 847, 'UT'), (850, 865, 'AZ'), (870, 884, 'NM'), (889, 898, 'NV'), (900, 961, 'CA'), (967, 968, 'HI'),
    (970, 979, 'OR'), (980, 994, 'WA'), (995, 999, 'AK')"""
ORACLES["c15_zip_state"] = "SELECT c_custkey, state FROM customer LEFT JOIN (VALUES " + _ZIPS + ") z(low, high, state) ON c_custkey * 37 % 100000 // 100 BETWEEN low AND high"
_link = lambda: F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://a.example/dp/B"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("/ref=1"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("https://b.example/item_"), F.col("p_partkey") + 1000000, F.lit(".html"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("https://c.example/p/"), F.col("p_partkey") + 10000000, F.lit("?x=1"))).otherwise(F.concat(F.lit("https://d.example/x-"), "p_partkey", F.lit("?q=12345678")))
_add("f28_listing_id", "part", "p_partkey", lambda: {"id": L.listing_id(_link())}, """CASE p_partkey % 4 WHEN 0 THEN concat('B', lpad(CAST(p_partkey AS VARCHAR), 9, '0')) WHEN 1 THEN CAST(p_partkey + 1000000 AS VARCHAR)
    WHEN 2 THEN CAST(p_partkey + 10000000 AS VARCHAR) ELSE substr(sha1(concat('https://d.example/x-', p_partkey)), 1, 12) END AS id""")
_DEPARTMENTS = [
    X.Rule("rings", "Rings & Rods", ("ring", "steel rods"), r"\bring", r"ring|\brod\b", (("Hot Rings", r"\bhot\b"),)),
    X.Rule("low-price", "Economy", ("economy", "promo"), "economy|promo", "old"),
]
_category = lambda: F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, "General")


def f31_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.classify(_category(), F.lit(None).cast("string"), F.col("p_name"), _DEPARTMENTS)
    return _read(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", "c.department", "c.part", "c.confidence")


ORACLES["f31_classify"] = """
    SELECT p_partkey, CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN 'Rings & Rods' ELSE 'Economy' END AS department,
           CASE WHEN a = 0 AND b = 0 THEN NULL WHEN a >= b THEN CASE WHEN p_name LIKE 'hot%' THEN 'Hot Rings' ELSE 'Rings & Rods' END ELSE 'Economy' END AS part,
           CASE WHEN a > 0 OR b > 0 THEN least(100, greatest(a, b)) END AS confidence
    FROM (SELECT p_partkey, p_name, CASE WHEN regexp_matches(p_name, 'ring|rod') THEN CASE WHEN p_partkey % 3 = 0 THEN 35 ELSE 55 END ELSE 0 END AS a,
                 CASE WHEN p_partkey % 3 = 0 AND p_type IN ('ECONOMY', 'PROMO') THEN 190 ELSE 0 END + CASE WHEN p_name LIKE 'old%' OR p_name LIKE 'cold%' THEN CASE WHEN p_partkey % 3 = 0 THEN 35 ELSE 55 END ELSE 0 END AS b FROM part) q"""
_add("f32_display_category", "part", "p_partkey", lambda: {"shown": X.display(F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.lower("p_type"))).when(F.col("p_partkey") % 4 == 1, "rings &  rods").when(F.col("p_partkey") % 4 == 2, F.concat_ws("  ", F.lit("kit"), "p_name")), _DEPARTMENTS)}, """
    CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'Economy' ELSE concat(substr(p_type, 1, 1), lower(substr(p_type, 2))) END WHEN 1 THEN 'Rings & Rods'
      WHEN 2 THEN array_to_string(list_transform(string_split(concat('kit ', p_name), ' '), lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE concat(upper(substr(w, 1, 1)), substr(w, 2)) END), ' ') ELSE 'Other' END AS shown""")
QUERIES["f31_classify"] = f31_classify
