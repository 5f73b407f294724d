"""Scans, predicates, joins and set operations over the catalog views."""

QUERIES = {
    # an event of type logout is the soft deletion of its row
    "src01_active_scan": """
        SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'logout' THEN ts END AS deleted_at FROM events) e WHERE deleted_at IS NULL""",
    "src02_filtered_scan": """
        SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND (o_orderpriority ILIKE '1-%' OR o_totalprice > 300000)
        ORDER BY o_orderkey LIMIT 100""",
    "src03_scan_all": "SELECT doc_id, lang, source, n_chars FROM documents",
    "src17_latest_price_read": "SELECT listing_id, name, price_cents FROM priced_listing",
    "p01_substring_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%er%' OR p_brand ILIKE '%3%'",
    "p02_regex_search": "SELECT p_partkey, p_type FROM part WHERE regexp_like(p_type, '(?i)(standard|economy|tin)$')",
    "p03_optional_predicate": "SELECT p_partkey FROM part WHERE (CAST(NULL AS VARCHAR(10)) IS NULL OR p_brand = 'x') AND (p_size = 5 OR 5 IS NULL)",
    "p04_unique_prefix_hit": """
        SELECT prefix, min(p_partkey) AS part_id FROM (SELECT substr(p_name, 1, 6) AS prefix, p_partkey FROM part WHERE regexp_like(p_name, '^[A-Za-z]')) q
        GROUP BY prefix HAVING count(*) = 1""",
    "p05_status_sets": """
        SELECT count_if(match_status NOT IN ('unmatched', 'substitute')) AS in_listings, count_if(match_status <> 'unmatched') AS in_priced_count,
               count_if(match_status IN ('exact', 'variant')) AS in_offers FROM match_row""",
    "p06_is_distinct_from": "SELECT count(*) AS n FROM canonical WHERE family_id IS DISTINCT FROM canonical_id",
    "p07_not_in_supplier_names": "SELECT DISTINCT p_type FROM part WHERE lower(p_type) NOT IN (SELECT lower(s_name) FROM supplier)",
    "p08_category_key": "SELECT DISTINCT lower(trim(p_type)) AS category_key FROM part WHERE trim(p_type) <> ''",
    "p09_positive_price": "SELECT count(*) AS n FROM snapshot WHERE price_cents > 0",
    "p10_reject_reason": """
        SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' WHEN regexp_like(text, '(?i)not found|access denied') THEN 'error page'
          WHEN source IS NULL THEN 'no source' WHEN n_chars < 40 THEN 'too short' ELSE 'ok' END AS reason FROM documents) q GROUP BY reason""",
    "p11_shrink_guard": """
        SELECT supplier_id, old_n, new_n, old_n >= 50 AND new_n * 2 < old_n AS must_fail FROM (
          SELECT supplier_id, count(DISTINCT canonical_id) AS old_n, count(DISTINCT CASE WHEN order_id % 3 = 0 THEN canonical_id END) AS new_n FROM snapshot GROUP BY supplier_id) q""",
    "p12_enum_filter": "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')",
    "p13_orderable": "SELECT listing_id, availability <> 'backordered' AS orderable FROM current_price",
    "p14_page_clamp": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 50 OFFSET 20",
    "j01_match_price_product": """
        SELECT l.listing_id, l.match_status, l.price_cents, l.name, k.group_id FROM priced_listing l JOIN canonical k ON k.canonical_id = l.canonical_id""",
    "j02_left_supplier_default": """
        SELECT x.supplier_id, coalesce(s.supplier_name, 'Unknown supplier') AS supplier_name, x.n FROM (SELECT supplier_id + 3 AS supplier_id, count(*) AS n FROM listing GROUP BY supplier_id) x
        LEFT JOIN supplier_info s ON s.supplier_id = x.supplier_id""",
    "j03_hash_join_by_id": "SELECT o.listing_id, s.supplier_name, s.nation FROM current_offer o JOIN supplier_info s ON s.supplier_id = o.supplier_id",
    "j04_best_per_category": """
        SELECT category, p_partkey, p_retailprice FROM (SELECT p_type AS category, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS rn FROM part) q WHERE rn = 1""",
    "j05_semi_join": "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT supplier_id FROM current_offer WHERE price_cents > 5000000)",
    "j06_existence_flags": """
        SELECT p.p_partkey, x.canonical_id IS NOT NULL AS has_offer, y.family_id IS NOT NULL AS has_family FROM part p
        LEFT JOIN (SELECT DISTINCT canonical_id FROM listed_offer) x ON x.canonical_id = p.p_partkey
        LEFT JOIN (SELECT canonical_id, family_id FROM canonical WHERE family_id IS NOT NULL) y ON y.canonical_id = p.p_partkey""",
    "j07_integrity": "SELECT count(*) AS n_orphans FROM match_row m WHERE NOT EXISTS (SELECT 1 FROM canonical c WHERE c.canonical_id = m.canonical_id)",
    "j09_latest_left_join": """
        SELECT l.listing_id, c.captured_at, c.price_cents FROM listing l
        LEFT JOIN (SELECT * FROM current_price WHERE availability = 'in_stock') c ON c.supplier_id = l.supplier_id AND c.canonical_id = l.canonical_id""",
    "j11_functional_key_join": """
        SELECT a.p_partkey AS left_id, b.p_partkey AS right_id FROM part a JOIN part b
          ON lower(regexp_replace(a.p_brand, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(b.p_brand, '[^A-Za-z0-9]', '', 'g')) AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey""",
    "j13_snapshot_classify": """
        SELECT coalesce(n.listing_id, o.listing_id) AS listing_id,
               CASE WHEN o.listing_id IS NULL THEN 'create' WHEN n.listing_id IS NULL THEN 'stale' WHEN o.hidden THEN 'restore' ELSE 'update' END AS action
        FROM (SELECT supplier_id, canonical_id, min(listing_id) AS listing_id, bool_or(availability = 'backordered') AS hidden FROM snapshot WHERE order_id % 2 = 0 GROUP BY supplier_id, canonical_id) o
        FULL OUTER JOIN (SELECT DISTINCT supplier_id, canonical_id, listing_id FROM snapshot WHERE order_id % 3 = 0) n ON n.supplier_id = o.supplier_id AND n.canonical_id = o.canonical_id""",
    "j14_report_assembly": """
        SELECT c.c_custkey, c.c_mktsegment, count(o.o_orderkey) AS n_invoices, coalesce(CAST(floor(sum(o.o_totalprice) * 100 + 0.5) AS BIGINT), 0) AS total_cents
        FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_mktsegment""",
    # each report with its practice, and its lines' opportunities as one list
    "j14_report_nested": """
        SELECT c.c_custkey AS practice_id, c.c_mktsegment, m.invoice_id, count(*) AS n_lines, array_join(array_sort(collect_list(concat(m.line_no, ':', m.listing_id, ':', m.savings_cents))), ',') AS opportunities
        FROM line_match m JOIN customer c ON c.c_custkey = m.practice_id WHERE m.savings_cents > 0 GROUP BY c.c_custkey, c.c_mktsegment, m.invoice_id""",
    "j15_listing_with_match": """
        SELECT l.listing_id, l.name, c.price_cents, l.match_status, l.confidence FROM listing l
        LEFT JOIN current_price c ON c.supplier_id = l.supplier_id AND c.canonical_id = l.canonical_id""",
    "j18_handle_chain": """
        SELECT handle, target_id, tier FROM (SELECT h.*, row_number() OVER (PARTITION BY handle ORDER BY tier, target_id) AS rn FROM (
          SELECT lower(name) AS handle, canonical_id AS target_id, 1 AS tier FROM canonical WHERE family_id IS NULL
          UNION ALL SELECT lower(family_name), family_id, 2 FROM family
          UNION ALL SELECT lower(listing_id), canonical_id, 3 FROM listing
          UNION ALL SELECT substr(lower(name), 1, 8), canonical_id, 4 FROM canonical) h) q WHERE rn = 1""",
    "j19_family_siblings": """
        SELECT a.canonical_id, b.canonical_id AS sibling_id, b.variant_rank, row_number() OVER (PARTITION BY a.canonical_id ORDER BY b.variant_rank NULLS LAST, b.name, b.canonical_id) AS position
        FROM canonical a JOIN canonical b ON b.family_id = a.family_id AND b.canonical_id <> a.canonical_id""",
    "u01_union_paths": """
        SELECT part_id FROM (SELECT p_partkey AS part_id FROM part WHERE p_size = 3 UNION SELECT p_partkey FROM part WHERE p_brand LIKE '%1' UNION SELECT l_partkey FROM lineitem WHERE l_quantity = 50) u
        ORDER BY part_id LIMIT 25""",
    "u02_tagged_union": """
        SELECT canonical_id, priority FROM (SELECT canonical_id, priority, row_number() OVER (PARTITION BY canonical_id ORDER BY priority) AS rn FROM (
          SELECT p_partkey AS canonical_id, 1 AS priority FROM part WHERE p_name ILIKE '%an%' UNION ALL SELECT p_partkey, 2 FROM part WHERE p_brand ILIKE '%2%'
          UNION ALL SELECT p_partkey, 3 FROM part WHERE p_type ILIKE '%steel%') u) q WHERE rn = 1""",
    "u03_union_keys": "SELECT lower(p_brand) AS model_key FROM part UNION SELECT lower(p_type) FROM part",
    "u04_union_then_min": """
        SELECT brand, min(code) AS code FROM (SELECT p_brand AS brand, p_partkey AS code FROM part WHERE p_size > 25 UNION SELECT p_brand, p_size FROM part WHERE p_size <= 25) u GROUP BY brand""",
    "u05_union_incoming_wins": """
        SELECT id, origin, value FROM (SELECT u.*, row_number() OVER (PARTITION BY id ORDER BY origin DESC, value) AS rn FROM (
          SELECT l_partkey AS id, 0 AS origin, min(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey
          UNION ALL SELECT l_partkey, 1, max(l_quantity) FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_partkey) u) q WHERE rn = 1""",
    "u06_stale_ids": """
        SELECT listing_id FROM (SELECT DISTINCT listing_id, supplier_id, canonical_id FROM snapshot WHERE order_id % 2 = 0) a
        WHERE NOT EXISTS (SELECT 1 FROM snapshot b WHERE b.order_id % 2 = 1 AND b.supplier_id = a.supplier_id AND b.canonical_id = a.canonical_id)""",
    "u07_first_per_id": """
        SELECT listing_id, order_id, line_no, price_cents FROM (
          SELECT s.*, row_number() OVER (PARTITION BY supplier_id, canonical_id ORDER BY order_id, line_no, captured_at, price_cents) AS rn FROM snapshot s) q WHERE rn = 1""",
    # one row per link: the first result's title, and image and price from the first later result that has them
    "u08_fill_missing": """
        SELECT link, min(page_id) AS page_id, min_by(image, page_id) FILTER (WHERE image IS NOT NULL) AS image, min_by(title, page_id) FILTER (WHERE title IS NOT NULL) AS title, count(*) AS n_results FROM (
          SELECT page_id, lower(split_part(split_part(url, '?', 1), '#', 1)) AS link, CASE WHEN regexp_like(html, '<img ') THEN regexp_extract(html, '<img[^>]*src="([^"]*)"', 1) END AS image,
                 CASE WHEN regexp_like(html, '<title>') THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages) q
        GROUP BY link""",
    "st10_retention_purge": "SELECT listing_id, captured_at FROM current_price WHERE availability = 'backordered' AND captured_at < TIMESTAMP '1997-01-01 00:00:00'",
}
#: Small tables that make many pairs: a join by hash would make them all in the one task that reads the file.
SPARK = {
    "j11_functional_key_join": """
        WITH keyed AS (SELECT p_partkey AS part_id, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS brand_key, p_name AS name FROM part)
        SELECT /*+ MERGE(a, b) */ a.part_id AS left_id, b.part_id AS right_id FROM keyed a JOIN keyed b ON b.brand_key = a.brand_key AND b.name = a.name AND a.part_id < b.part_id""",
    # a family is put in order once; a sibling's position is its place there, less the product's own if that comes first, so
    # the pairs themselves are neither shuffled nor sorted
    "j19_family_siblings": """
        WITH placed AS (SELECT canonical_id, family_id, variant_rank, row_number() OVER (PARTITION BY family_id ORDER BY variant_rank NULLS LAST, name, canonical_id) AS place
          FROM canonical WHERE family_id IS NOT NULL AND canonical_id IS NOT NULL)
        SELECT /*+ MERGE(a, b) */ a.canonical_id, b.canonical_id AS sibling_id, b.variant_rank, b.place - CASE WHEN a.place < b.place THEN 1 ELSE 0 END AS position
        FROM placed a JOIN placed b ON b.family_id = a.family_id AND b.canonical_id <> a.canonical_id""",
}
