"""The catalog model as SQL views over the warehouse tables, and a runner for queries on them.

Each view and query is one text for Spark SQL and for the oracle, apart from the few function names
in ``ORACLE_NAMES``.  A query is prefixed with just the views that it uses, directly or through
others; Spark reads the base tables straight from Parquet, so filters and columns reach the scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Status and confidence of the match of a supplier's listing with its product.
MATCH_STATUS = """CASE ({c} * 7 + {s}) % 10 WHEN 0 THEN 'unmatched' WHEN 1 THEN 'substitute' WHEN 2 THEN 'needs_review' WHEN 3 THEN 'variant' WHEN 4 THEN 'variant' ELSE 'exact' END"""
CONFIDENCE = "CAST(({c} * 13 + {s} * 7) % 100 AS INT)"

#: A price snapshot, of a line.
SNAPSHOT = """concat(l_suppkey, '-', l_partkey) AS listing_id, l_suppkey AS supplier_id, l_partkey AS canonical_id,
               CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS price_cents, l_quantity AS pack_quantity,
               CASE WHEN l_quantity > 0 THEN CAST(floor(floor(l_extendedprice * 100 + 0.5) / l_quantity + 0.5) AS BIGINT) END AS unit_price_cents,
               CASE l_returnflag WHEN 'N' THEN 'in_stock' WHEN 'A' THEN 'limited' ELSE 'backordered' END AS availability,
               l_shipdate AS captured_at, l_orderkey AS order_id, l_linenumber AS line_no"""

#: A listing is keyed by (supplier_id, canonical_id); listing_id is that pair as text, so no two pairs share one
#: however large the keys are.  Joins and windows go by the pair.
VIEWS: dict[str, str] = {
    # a listing is a supplier's offer of a part
    "listing": f"""
        SELECT concat(x.supplier_id, '-', x.canonical_id) AS listing_id, x.supplier_id, x.canonical_id, p.p_name AS name, p.p_brand AS brand,
               p.p_type AS category, p.p_size AS pack_size, concat('S', x.supplier_id, '-', x.canonical_id) AS sku, concat(p.p_brand, '-', x.canonical_id) AS mfr_sku,
               {MATCH_STATUS.format(c="x.canonical_id", s="x.supplier_id")} AS match_status, {CONFIDENCE.format(c="x.canonical_id", s="x.supplier_id")} AS confidence
        FROM (SELECT DISTINCT l_suppkey AS supplier_id, l_partkey AS canonical_id FROM lineitem) x
        JOIN part p ON p.p_partkey = x.canonical_id""",
    # one price snapshot per line; the last two columns break ties of captured_at
    "snapshot": f"SELECT {SNAPSHOT} FROM lineitem",
    # a line's own columns go through the window; what is made of them is made of the rows that are left
    "current_price": f"""
        SELECT {SNAPSHOT}, rn FROM (SELECT l.*, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem l) q
        WHERE rn = 1""",
    # a listing with its latest price, of which it has one: the lines are read once
    "priced_listing": f"""
        SELECT c.*, p.p_name AS name, p.p_brand AS brand, p.p_type AS category, p.p_size AS pack_size, concat('S', c.supplier_id, '-', c.canonical_id) AS sku, concat(p.p_brand, '-', c.canonical_id) AS mfr_sku,
               {MATCH_STATUS.format(c="c.canonical_id", s="c.supplier_id")} AS match_status, {CONFIDENCE.format(c="c.canonical_id", s="c.supplier_id")} AS confidence
        FROM current_price c JOIN part p ON p.p_partkey = c.canonical_id""",
    "match_row": "SELECT listing_id, supplier_id, canonical_id, match_status, confidence FROM listing",
    "family": """
        SELECT p_name AS family_name, p_type AS family_type, min(p_partkey) AS family_id, count(DISTINCT p_size) AS n_sizes
        FROM part GROUP BY p_name, p_type HAVING count(DISTINCT p_size) >= 2""",
    "canonical": """
        SELECT p.p_partkey AS canonical_id, p.p_name AS name, p.p_type AS category, p.p_brand AS brand, p.p_size AS variant_rank,
               f.family_id, coalesce(f.family_id, p.p_partkey) AS group_id
        FROM part p LEFT JOIN family f ON f.family_name = p.p_name AND f.family_type = p.p_type""",
    "supplier_info": """
        SELECT s_suppkey AS supplier_id, s_name AS supplier_name, n_name AS nation,
               CASE WHEN s_acctbal > 5000 THEN 5000000 WHEN s_acctbal > 0 THEN 2500000 END AS free_threshold_cents,
               CASE WHEN s_acctbal > -500 THEN CAST(995 + s_suppkey % 7 * 100 AS BIGINT) END AS flat_cents,
               s_suppkey % 20 = 0 AS is_marketplace
        FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""",
    # a product in a category that is neither generic nor a supplier's name
    "product": """
        SELECT p_partkey AS canonical_id, p_name AS name, p_brand AS brand, p_type AS category, lower(trim(p_type)) AS category_key, p_size AS pack_size
        FROM part LEFT JOIN (SELECT DISTINCT lower(s_name) AS taken FROM supplier) t ON t.taken = lower(p_type)
        WHERE trim(p_type) <> '' AND lower(trim(p_type)) NOT IN ('general', 'uncategorized') AND t.taken IS NULL""",
    # a listing's latest price, where it is positive, of a product as above
    "current_offer": """
        SELECT c.listing_id, c.supplier_id, c.canonical_id, c.price_cents, c.unit_price_cents, c.availability, c.captured_at, p.name, p.brand, p.category, p.category_key, p.pack_size
        FROM current_price c JOIN product p ON p.canonical_id = c.canonical_id WHERE c.price_cents > 0""",
    # products meet their families before prices do, so prices are joined once
    "matched_offer": f"""
        SELECT c.listing_id, c.supplier_id, c.canonical_id, c.price_cents, c.unit_price_cents, c.availability, c.captured_at, p.name, p.brand, p.category, p.category_key, p.pack_size,
               {MATCH_STATUS.format(c="c.canonical_id", s="c.supplier_id")} AS match_status, {CONFIDENCE.format(c="c.canonical_id", s="c.supplier_id")} AS confidence,
               p.group_id, p.family_id, p.pack_size AS variant_rank
        FROM current_price c JOIN (
          SELECT x.*, f.family_id, coalesce(f.family_id, x.canonical_id) AS group_id FROM product x LEFT JOIN family f ON f.family_name = x.name AND f.family_type = x.category
        ) p ON p.canonical_id = c.canonical_id WHERE c.price_cents > 0""",
    "listed_offer": "SELECT * FROM matched_offer WHERE match_status NOT IN ('unmatched', 'substitute')",
    "invoice_line": """
        SELECT o_orderkey AS invoice_id, o_custkey AS practice_id, o_orderdate AS invoice_date, l_linenumber AS line_no, l_suppkey AS supplier_id, l_partkey AS canonical_id,
               concat(l_suppkey, '-', l_partkey) AS listing_id, l_quantity AS qty, CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS paid_cents
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 0""",
    "cheapest_part": """
        SELECT canonical_id, min(unit_price_cents) AS best_cents, max(unit_price_cents) AS worst_cents, count(DISTINCT supplier_id) AS n_suppliers
        FROM listed_offer WHERE match_status IN ('exact', 'variant') AND unit_price_cents IS NOT NULL GROUP BY canonical_id""",
    "line_match": f"""
        SELECT i.*, b.best_cents, {MATCH_STATUS.format(c="i.canonical_id", s="i.supplier_id")} AS match_status,
               CASE WHEN b.best_cents IS NULL THEN 0 ELSE greatest(0, CAST(floor((i.paid_cents - b.best_cents) * i.qty + 0.5) AS BIGINT)) END AS savings_cents
        FROM invoice_line i LEFT JOIN cheapest_part b ON b.canonical_id = i.canonical_id""",
    # device references: a code, and the normalised brand, model and company that it stands for
    "reference_code": """
        SELECT concat('0', lpad(CAST(p_partkey AS VARCHAR(20)), 12, '0'), '7') AS gtin, lower(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END, '[^A-Za-z0-9]', '', 'g')) AS brand_norm,
               lower(regexp_replace(CASE WHEN p_partkey % 4 = 0 THEN concat('P-', p_partkey) ELSE p_name END, '[^A-Za-z0-9]', '', 'g')) AS model_norm,
               lower(regexp_replace(CASE WHEN p_partkey % 4 = 0 THEN 'House Supply' ELSE p_brand END, '[^A-Za-z0-9]', '', 'g')) AS company_norm
        FROM part""",
    # inventory: each user and product code is an item; its latest event is the item's state
    "item": """
        SELECT user_id AS location_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS code, event_type AS lot, event_id, ts, value FROM events""",
    "item_state": """
        SELECT * FROM (SELECT i.*, row_number() OVER (PARTITION BY location_id, code, lot ORDER BY ts DESC, event_id DESC) AS rn FROM item i) q WHERE rn = 1""",
}

#: Names in the shared text, and the oracle's or Spark's own where they differ.
ORACLE_NAMES = (("regexp_like(", "regexp_matches("), ("collect_list(", "list("), ("percentile(", "quantile_cont("), ("days_between(", "date_diff('day', "),
                ("array_join(", "array_to_string("), ("array_sort(", "list_sort("))
SPARK_NAMES = ((", 'g')", ")"), ("days_between(", "date_diff(DAY, "))


def used_views(sql: str) -> list[str]:
    """The views that ``sql`` needs, each after those it builds on."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def _with(parts: list[str], sql: str) -> str:
    body = sql.strip()
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + ("\n, " + body[5:] if body.upper().startswith("WITH ") else "\n" + body)


def spark_sql(sql: str, sf_dir: str) -> str:
    views = used_views(sql)
    text = "\n".join([sql, *(VIEWS[v] for v in views)])
    own = set(re.findall(r"\b(\w+) AS \(", sql))
    base = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in BASE if t not in own and re.search(rf"\b(?:FROM|JOIN|,)\s+{t}\b", text)]
    out = _with([*base, *(f"{v} AS ({VIEWS[v]})" for v in views)], sql)
    for a, b in SPARK_NAMES:
        out = out.replace(a, b)
    return out


def oracle_text(sql: str) -> str:
    out = _with([f"{v} AS ({VIEWS[v]})" for v in used_views(sql)], sql)
    for a, b in ORACLE_NAMES:
        out = out.replace(a, b)
    return out


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(spark_sql(sql, sf_dir))
