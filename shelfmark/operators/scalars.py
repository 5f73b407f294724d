"""Queries that apply the scalar functions to whole tables, with their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import codes as C, packs as P, text as T
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("part", "orders") else df


def _add(name: str, table: str, key: str, make: Callable[[], dict[str, Column]], oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _read(spark, sf_dir, table).select(key, *[c.alias(n) for n, c in make().items()])
    if oracle:
        ORACLES[name] = f"SELECT {key}, {oracle} FROM {table}"


_CODE = "concat(p_brand, '-', p_partkey)"
_code = lambda: F.concat(F.col("p_brand"), F.lit("-"), F.col("p_partkey"))
_NAME = "concat(p_name, ' ', p_type, ' ', p_size, '/Box')"
_name = lambda: F.concat_ws(" ", "p_name", "p_type", F.concat(F.col("p_size"), F.lit("/Box")))
_SKU = "regexp_replace(upper(" + _CODE + "), '[^A-Z0-9]', '', 'g')"
_TOKENS = "list_filter(string_split_regex(lower(" + _NAME + "), '[^a-z0-9.#]+'), lambda w: w <> '')"
_STEM = "list_transform(" + _TOKENS + ", lambda w: CASE WHEN NOT regexp_matches(w, '[0-9]') AND length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END)"

_add("f02_normalize_sku", "part", "p_partkey", lambda: {"sku": T.normalize_sku(_code())}, f"{_SKU} AS sku")
_add(
    "f03_sku_strength", "part", "p_partkey", lambda: {"strength": T.sku_strength(F.when(F.col("p_size") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("A"), "p_partkey")).otherwise(F.upper(F.regexp_replace("p_name", "[^a-z]", ""))))},
    "CASE p_size % 3 WHEN 0 THEN CASE WHEN regexp_full_match(CAST(p_partkey AS VARCHAR), '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+') THEN 0.1 WHEN p_partkey < 1000 THEN 0.12 WHEN p_partkey < 10000 THEN 0.35 ELSE 0.5 END"
    " WHEN 1 THEN CASE WHEN p_partkey < 100 THEN 0.3 WHEN p_partkey < 1000 THEN 0.6 WHEN p_partkey < 10000 THEN 0.85 ELSE 0.95 END ELSE CASE WHEN length(p_name) > 6 THEN 0.6 ELSE 0.3 END END AS strength",
)
_add(
    "f04_sku_core", "part", "p_partkey", lambda: {"core": T.sku_model_core(F.concat(F.lit("219-"), F.col("p_partkey") + 990))},
    "CASE WHEN length(CAST(p_partkey + 990 AS VARCHAR)) >= 4 THEN CAST(p_partkey + 990 AS VARCHAR) ELSE '' END AS core",
)
_add("f05_brand_key", "part", "p_partkey", lambda: {"brand": T.brand_key(T.brand_tokens(F.concat(F.col("p_brand"), F.lit(" Inc"))))}, "trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS brand")
_add("f07_pack_quantity", "part", "p_partkey", lambda: {"qty": P.parse_pack_quantity(F.lit(None).cast("string"), _name())}, "CASE WHEN p_size > 0 THEN p_size END AS qty")
_add("f09_tokenize", "part", "p_partkey", lambda: {"tokens": F.array_join(T.tokenize_name(_name()), " ")}, f"array_to_string({_STEM}, ' ') AS tokens")
_add("f10_sku_like", "part", "p_partkey", lambda: {"codes": F.array_join(T.sku_like_tokens(F.concat_ws(" ", "p_name", F.concat(F.lit("AB-"), F.col("p_partkey") + 1000), F.concat(F.col("p_partkey") + 1000, F.lit("mm")), F.concat(F.col("p_size"), F.lit("box")))), ",")},
     "concat('AB', p_partkey + 1000) AS codes")
_add(
    "f12_jaccard", "part", "p_partkey",
    lambda: {"score": F.round(T.jaccard(F.split(F.lower("p_type"), " "), F.array(F.lit("standard"), F.lit("steel"), F.lit("small"))), 9)},
    "round(len(list_intersect(string_split(lower(p_type), ' '), ['standard', 'steel', 'small'])) * 1.0 / len(list_distinct(list_concat(string_split(lower(p_type), ' '), ['standard', 'steel', 'small']))), 9) AS score",
)
_GRAMS = "list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))"
_add("f13_trigrams", "part", "p_partkey", lambda: {"n": F.size(T.trigrams("p_type"))})
ORACLES["f13_trigrams"] = f"SELECT p_partkey, len({_GRAMS}) AS n FROM (SELECT p_partkey, concat('  ', p_type, ' ') AS t FROM part) q"
_add("f17_prefix_recall", "part", "p_partkey", lambda: {"recall": T.prefix_recall(F.array(F.lit("st"), F.lit("po")), F.split(F.lower("p_type"), " "))},
     "(CASE WHEN len(list_filter(string_split(lower(p_type), ' '), lambda w: w LIKE 'st%')) > 0 THEN 0.5 ELSE 0 END + CASE WHEN len(list_filter(string_split(lower(p_type), ' '), lambda w: w LIKE 'po%')) > 0 THEN 0.5 ELSE 0 END) AS recall")
_add("f19_name_similarity", "part", "p_partkey", lambda: {"score": F.get(F.transform(F.array(T.tokenize_name(_name())), lambda words: T.name_similarity(F.array(F.lit("steel"), F.lit("part")), words)), 0)})
_add("f20_title_overlap", "part", "p_partkey", lambda: {"pct": T.title_overlap(F.split(F.concat_ws(" ", "p_name", F.lit("of"), F.element_at(F.split("p_name", " "), 1)), " "), F.array(F.lit("hot"), F.lit("ring"), F.lit("of")))},
     "CAST(floor(100.0 * (CASE WHEN p_name LIKE 'hot %' THEN 2 ELSE 0 END + CASE WHEN p_name LIKE '% ring' THEN 1 ELSE 0 END) / 3 + 0.5) AS INT) AS pct")
_add("f21_status", "part", "p_partkey", lambda: {"status": T.status_of_confidence(F.col("p_partkey") % 100)},
     "CASE WHEN p_partkey % 100 >= 80 THEN 'exact' WHEN p_partkey % 100 >= 55 THEN 'variant' WHEN p_partkey % 100 >= 30 THEN 'needs_review' ELSE 'unmatched' END AS status")
_add("f24_strip_tags", "pages", "page_id", lambda: {"plain": T.strip_tags("html")}, "trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain")
_add("f26_slugify", "part", "p_partkey", lambda: {"slug": T.slugify(_name())}, f"regexp_replace(substr(regexp_replace(regexp_replace(lower({_NAME}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug")
_add("f27_stable_id", "part", "p_partkey", lambda: {"id": F.concat(F.lit("mcpf_"), F.substring(F.sha1(_name()), 1, 10))}, f"concat('mcpf_', substr(sha1({_NAME}), 1, 10)) AS id")
_add("f28_normalize_url", "pages", "page_id", lambda: {"u": T.normalize_url("url")}, "regexp_replace(regexp_extract(lower(url), '^([a-z]+://[^/?#]+[^?#]*)', 1), '/+$', '') AS u")
_add("f29_classify_url", "pages", "page_id", lambda: {"kind": T.classify_url("url")},
     r"CASE WHEN regexp_matches(regexp_extract(lower(url), '^[a-z]+://[^/?#]+([^?#]*)', 1), '/\d+(?:\.html?)?/?$') THEN 'detail' WHEN regexp_extract(lower(url), '^[a-z]+://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN 'home' ELSE 'other' END AS kind")
_add("f33_suggest", "part", "p_partkey", lambda: {"rank": T.suggest(F.col("p_type"), "small")}, "CASE WHEN lower(p_type) = 'small' THEN NULL WHEN lower(p_type) LIKE 'small%' THEN 0 WHEN lower(p_type) LIKE '%small%' THEN 1 END AS rank")
_add("f42_money", "part", "p_partkey", lambda: {"cents": T.money_cents(F.concat(F.lit("now $"), F.format_string("%.2f", "p_retailprice"), F.lit(" each")))}, "CAST(floor(round(p_retailprice, 2) * 100 + 0.5) AS BIGINT) AS cents")

_BODY = "lpad(CAST(p_partkey AS VARCHAR), 12, '0')"
_body = lambda: F.lpad(F.col("p_partkey").cast("string"), 12, "0")
_DIGIT = f"(10 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr({_BODY}, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10"
_add("c01_check_digit", "part", "p_partkey", lambda: {"code": F.concat(_body(), C.check_digit(_body())), "ok": C.valid_gtin(F.concat(_body(), (F.col("p_size") % 10).cast("string")))}, f"concat({_BODY}, CAST({_DIGIT} AS INT)) AS code, CAST({_DIGIT} AS INT) = p_size % 10 AS ok")
_add("c02_gtin_variants", "part", "p_partkey", lambda: {"n": F.size(C.gtin_variants(F.concat(_body(), C.check_digit(_body()))))}, "CASE WHEN p_partkey = 0 THEN 3 ELSE 4 END AS n")
_add("c03_canonical_gtin", "part", "p_partkey", lambda: {"core": C.canonical_gtin(_body())}, "CASE WHEN p_partkey = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS core")
_add("c06_gs1_date", "orders", "o_orderkey", lambda: {"d": C.gs1_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyMM00")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyMMdd")).otherwise("991341"))},
     "CASE o_orderkey % 3 WHEN 0 THEN last_day(CAST(concat('20', strftime(o_orderdate, '%y-%m-01')) AS DATE)) WHEN 1 THEN CAST(concat('20', strftime(o_orderdate, '%y-%m-%d')) AS DATE) END AS d")
_add("c10_unit_price", "lineitem", "l_orderkey", lambda: {"cents": C.unit_price_cents(C.half_up(F.col("l_extendedprice") * 100), F.col("l_quantity"))}, "CASE WHEN l_quantity > 0 AND l_extendedprice > 0 THEN CAST(floor(floor(l_extendedprice * 100 + 0.5) / l_quantity + 0.5) AS BIGINT) END AS cents")
_add("c12_savings", "lineitem", "l_orderkey", lambda: {"cents": C.savings(F.col("l_extendedprice"), F.lit(30000.0), F.col("l_quantity"))}, "greatest(0, CAST(floor((l_extendedprice - 30000.0) * l_quantity + 0.5) AS BIGINT)) AS cents")
_add("c13_noisy_or", "part", "p_partkey", lambda: {"p": F.round(C.noisy_or(F.array(F.col("p_size") / 100.0, F.lit(0.3), F.lit(0.1))), 9)}, "round(1 - (1 - p_size / 100.0) * 0.7 * 0.9, 9) AS p")
_add("c14_haversine", "customer", "c_custkey", lambda: {"miles": F.round(C.haversine_miles(F.lit(40.0), F.lit(-75.0), F.lit(30.0) + F.col("c_nationkey"), F.lit(-80.0)), 6)},
     "round(2 * 3959 * asin(sqrt(power(sin(radians(30.0 + c_nationkey - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(30.0 + c_nationkey)) * power(sin(radians(-80.0 + 75.0) / 2), 2))), 6) AS miles")
_add("c16_business_days", "orders", "o_orderkey", lambda: {"d": C.add_business_days(F.to_date("o_orderdate"), F.lit(3))},
     "CAST(list_filter(list_transform(range(1, 12), lambda i: CAST(o_orderdate AS DATE) + CAST(i AS INT)), lambda d: dayofweek(d) NOT IN (0, 6))[3] AS DATE) AS d")
_add("c18_shipping", "orders", "o_orderkey", lambda: {"cents": C.shipping_cents(F.col("o_totalprice"), F.lit(250000.0), F.lit(995).cast("long"), F.array(F.struct(F.lit(50000).cast("long").alias("min_subtotal_cents"), F.lit(495).cast("long").alias("flat_cents"))))},
     "CASE WHEN o_totalprice >= 250000 THEN 0 WHEN o_totalprice >= 50000 THEN 495 ELSE 995 END AS cents")
_add("c19_lifecycle", "orders", "o_orderkey", lambda: {"state": C.lifecycle(F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")), F.to_date("o_orderdate"), F.lit("1996-06-01").cast("date"))},
     "CASE WHEN o_orderstatus = 'P' THEN 'pulled' WHEN CAST(o_orderdate AS DATE) < DATE '1996-06-01' THEN 'expired' WHEN CAST(o_orderdate AS DATE) <= DATE '1996-07-01' THEN 'expiring' ELSE 'active' END AS state")
_add("c22_clamp", "lineitem", "l_orderkey", lambda: {"v": C.clamp_int32(F.col("l_extendedprice") * 1000000)}, "CAST(least(greatest(CAST(trunc(l_extendedprice * 1000000) AS BIGINT), -2147483648), 2147483647) AS INT) AS v")
_add("c23_json", "events", "event_id", lambda: {"k": F.from_json("props", "k int")["k"]}, "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k")
_add("c25_days_until", "orders", "o_orderkey", lambda: {"days": F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate"))}, "date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days")
