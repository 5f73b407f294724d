"""Aggregations and windows over the catalog views."""

QUERIES = {
    "ag01_per_supplier": "SELECT l_suppkey AS supplier_id, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "ag02_category_counts": "SELECT category, count(*) AS n, count(DISTINCT supplier_id) AS n_suppliers FROM listing WHERE lower(category) NOT IN (SELECT lower(s_name) FROM supplier) GROUP BY category",
    "ag03_priced_groups": "SELECT category, count(DISTINCT coalesce(family_id, canonical_id)) AS n FROM matched_offer WHERE match_status <> 'unmatched' GROUP BY category",
    "ag04_offer_count": "SELECT category_key, group_id, count(DISTINCT supplier_id) AS offer_count FROM listed_offer GROUP BY category_key, group_id",
    "ag05_group_info": "SELECT group_id, count(*) AS n, max(family_id) AS family_id, min_by(brand, canonical_id) AS first_brand FROM canonical GROUP BY group_id",
    "ag06_variant_count": "SELECT supplier_id, group_id, count(*) AS variant_count FROM matched_offer GROUP BY supplier_id, group_id",
    "ag07_coverage": "SELECT category, count(DISTINCT supplier_id) AS n_suppliers FROM listing GROUP BY category",
    "ag08_duplicate_groups": "SELECT p_name, p_type, p_size, count(*) AS n FROM part GROUP BY p_name, p_type, p_size HAVING count(*) > 1",
    "ag09_unambiguous_key": "SELECT p_name, p_brand, min(p_partkey) AS part_id FROM part GROUP BY p_name, p_brand HAVING count(DISTINCT p_partkey) = 1",
    "ag10_status_counts": "SELECT match_status, count(*) AS n FROM match_row GROUP BY match_status",
    # the most common value; the first seen wins ties
    "ag11_mode": """
        SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn
          FROM events WHERE trim(event_type) <> '' GROUP BY user_id, event_type) q WHERE rn = 1""",
    "ag12_category_consensus": """
        SELECT family_name, category FROM (SELECT p_name AS family_name, p_type AS category,
            row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN p_type LIKE 'STANDARD%' THEN 1 ELSE 0 END, count(*) DESC, p_type) AS rn FROM part GROUP BY p_name, p_type) q WHERE rn = 1""",
    "ag13_taxonomy_vote": """
        SELECT brand, department FROM (SELECT brand, department, row_number() OVER (PARTITION BY brand ORDER BY sum(vote) DESC, count(*) DESC, department) AS rn
          FROM (SELECT brand, split_part(category, ' ', 1) AS department, confidence + CASE WHEN match_status = 'exact' THEN 15 ELSE 0 END AS vote FROM listing) v GROUP BY brand, department) q WHERE rn = 1""",
    "ag14_distinct_values": "SELECT DISTINCT p_name, p_brand FROM part WHERE trim(p_brand) <> ''",
    "ag15_successor_vote": """
        SELECT old_id, new_id FROM (SELECT group_id AS old_id, canonical_id AS new_id, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, canonical_id) AS rn
          FROM matched_offer GROUP BY group_id, canonical_id) q WHERE rn = 1""",
    "ag16_max_confidence": "SELECT canonical_id, max(confidence) AS confidence, max_by(match_status, (confidence, supplier_id)) AS match_status FROM match_row GROUP BY canonical_id",
    "ag17_price_comparison": """
        SELECT canonical_id, min(unit_price_cents) AS lowest, max(unit_price_cents) AS highest, max(unit_price_cents) * 1.0 / min(unit_price_cents) AS spread,
               CASE WHEN count(pack_size) = count(*) THEN 'parsed' WHEN count(pack_size) = 0 THEN 'none' ELSE 'mixed' END AS certainty
        FROM listed_offer WHERE unit_price_cents > 0 GROUP BY canonical_id HAVING count(DISTINCT supplier_id) >= 2 AND count(*) >= 2""",
    "ag18_run_summary": """
        SELECT CAST(floor(confidence / 10) * 10 AS INT) AS band, count(*) AS n, count_if(match_status = 'exact') AS n_exact, count(DISTINCT supplier_id) AS n_suppliers FROM match_row GROUP BY CAST(floor(confidence / 10) * 10 AS INT)""",
    # over the multi-supplier products: how far prices are apart; the median of an even number is the upper one
    "ag18_spread_summary": """
        SELECT count(*) AS n, -percentile_disc(0.5) WITHIN GROUP (ORDER BY -spread) AS median_spread, count_if(spread > 3) AS n_wide FROM (
          SELECT canonical_id, floor(max(unit_price_cents) * 1000.0 / min(unit_price_cents) + 0.5) / 1000 AS spread FROM listed_offer WHERE unit_price_cents > 0
          GROUP BY canonical_id HAVING count(DISTINCT supplier_id) >= 2) q""",
    "ag20_shipping_estimate": """
        SELECT nation, CAST(floor(percentile(flat_cents, 0.5) + 0.5) AS BIGINT) AS flat_cents, min(free_threshold_cents) AS threshold_cents, count(*) AS n
        FROM supplier_info WHERE flat_cents IS NOT NULL GROUP BY nation HAVING count(*) >= 2""",
    "ag21_plan_totals": """
        SELECT b.invoice_id, count(*) AS n_baskets, sum(b.subtotal) AS subtotal, count(s.flat_cents) AS known_shipping,
               sum(CASE WHEN b.subtotal >= s.free_threshold_cents THEN 0 ELSE s.flat_cents END) AS shipping,
               min(CASE WHEN b.subtotal < s.free_threshold_cents THEN s.free_threshold_cents - b.subtotal END) AS nearest_gap
        FROM (SELECT invoice_id, supplier_id, sum(CAST(floor(paid_cents * qty + 0.5) AS BIGINT)) AS subtotal FROM invoice_line GROUP BY invoice_id, supplier_id) b
        JOIN supplier_info s ON s.supplier_id = b.supplier_id GROUP BY b.invoice_id""",
    "ag22_rows_by_supplier": """
        SELECT invoice_id, supplier_id, subtotal, n, row_number() OVER (PARTITION BY invoice_id ORDER BY subtotal DESC, supplier_id) AS position FROM (
          SELECT invoice_id, supplier_id, sum(CAST(floor(paid_cents * qty + 0.5) AS BIGINT)) AS subtotal, count(*) AS n FROM invoice_line GROUP BY invoice_id, supplier_id) q""",
    "ag23_invoice_totals": """
        SELECT practice_id, sum(savings_cents) AS savings_cents, count_if(savings_cents > 0) AS n_saving, count(*) AS n_lines FROM line_match GROUP BY practice_id""",
    "ag24_match_stats": """
        SELECT count_if(confidence >= 80) AS high, count_if(confidence >= 50 AND confidence < 80) AS middle, count_if(confidence < 50) AS low,
               CAST(floor(100.0 * count_if(match_status IN ('exact', 'variant')) / count(*) + 0.5) AS INT) AS matched_pct FROM match_row""",
    "ag25_location_rollup": """
        SELECT location_id, count(*) AS item_count, count_if(value < 10) AS needs_attention_count, max(ts) AS last_counted_at FROM item_state GROUP BY location_id""",
    # customers are places; one without a balance has no position on the plan
    "ag26_layout_summary": """
        SELECT count(*) AS total, count(x) AS placed, count(*) - count(x) AS unplaced, sum(coalesce(n, 0)) AS items, count_if(attention > 0) AS needing_attention FROM (
          SELECT c_custkey AS location_id, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS x FROM customer) p
        LEFT JOIN (SELECT location_id, count(*) AS n, count_if(value < 10) AS attention FROM item_state GROUP BY location_id) i ON i.location_id = p.location_id""",
    "ag27_department_rollup": """
        SELECT department, sum(n) AS n_products, max(n_suppliers) AS n_suppliers, min(best) AS best_price FROM (
          SELECT split_part(category, ' ', 1) AS department, category, count(*) AS n, count(DISTINCT supplier_id) AS n_suppliers, min(price_cents) AS best FROM listed_offer GROUP BY split_part(category, ' ', 1), category) q
        GROUP BY department HAVING sum(n) > 0""",
    "ag28_price_range": "SELECT canonical_id, min(price_cents) AS lowest, max(price_cents) AS highest, min(unit_price_cents) AS lowest_unit, max(unit_price_cents) AS highest_unit FROM listed_offer GROUP BY canonical_id",
    "ag29_url_types": """
        SELECT url_type, count(*) AS n FROM (SELECT CASE WHEN regexp_like(url, '[.]html') THEN 'page' WHEN regexp_like(url, '[?]page=') THEN 'listing' WHEN regexp_like(url, '/$') THEN 'folder' ELSE 'other' END AS url_type FROM pages) q GROUP BY url_type""",
    "ag30_marketplace_status": """
        SELECT o.supplier_id, count(*) AS n, count(DISTINCT o.canonical_id) AS n_canonicals, count_if(o.match_status = 'exact') AS n_exact, max(o.captured_at) AS last_seen
        FROM matched_offer o JOIN supplier_info s ON s.supplier_id = o.supplier_id WHERE s.is_marketplace GROUP BY o.supplier_id""",
    # each item needs three kinds of evidence
    "ag31_readiness": """
        SELECT location_id, CAST(floor(100.0 * sum(covered) / (3 * count(*)) + 0.5) AS INT) AS readiness, count_if(covered = 3) AS complete, sum(3 - covered) AS gaps FROM (
          SELECT location_id, code, count(DISTINCT CASE WHEN lot IN ('click', 'view', 'purchase') THEN lot END) AS covered FROM item GROUP BY location_id, code) q GROUP BY location_id""",
    "ag32_savings_rollup": """
        SELECT practice_id, sum(savings_cents) AS lifetime_cents, max(savings_cents) AS top_cents FROM line_match WHERE savings_cents > 0 GROUP BY practice_id ORDER BY lifetime_cents DESC, practice_id LIMIT 20""",
    "ag33_overlap_cheapest": """
        SELECT canonical_id, count(*) AS n_suppliers, min(cheapest) AS low, max(cheapest) AS high, max(cheapest) * 1.0 / min(cheapest) AS spread
        FROM (SELECT canonical_id, supplier_id, min(unit_price_cents) AS cheapest FROM listed_offer WHERE unit_price_cents > 0 GROUP BY canonical_id, supplier_id) q
        GROUP BY canonical_id HAVING count(*) >= 3""",
    # tokens that are in too many names are no use for blocking
    "ag34_token_frequency": """
        SELECT token, count(*) AS df FROM (SELECT DISTINCT p_partkey, lower(p_brand) AS token FROM part) q GROUP BY token HAVING count(*) <= 600""",
    # the strict winner of the counts; a tie has none
    "ag35_basis_plurality": """
        SELECT category, CASE WHEN n_top = 1 THEN basis END AS basis FROM (SELECT category, min(basis) AS basis, count(*) AS n_top FROM (
          SELECT category, basis, n, max(n) OVER (PARTITION BY category) AS most FROM (SELECT category, pack_size % 4 AS basis, count(*) AS n FROM listing GROUP BY category, pack_size % 4) a) b
          WHERE n = most GROUP BY category) q""",
    # listings that an unambiguous reference of their brand and name gives a code
    "ag36_enrichment_counts": """
        SELECT l.supplier_id, count(*) AS n FROM listing l JOIN (SELECT brand_norm, model_norm FROM reference_code GROUP BY brand_norm, model_norm HAVING count(DISTINCT gtin) = 1) r
          ON r.brand_norm = lower(regexp_replace(l.brand, '[^A-Za-z0-9]', '', 'g')) AND r.model_norm = lower(regexp_replace(l.name, '[^A-Za-z0-9]', '', 'g')) GROUP BY l.supplier_id""",
    "w01_keeper": """
        SELECT listing_id, order_id, line_no, rn AS position FROM (SELECT s.*, row_number() OVER (PARTITION BY supplier_id, canonical_id ORDER BY CASE availability WHEN 'in_stock' THEN 0 ELSE 1 END,
          CASE WHEN price_cents > 0 THEN 0 ELSE 1 END, captured_at DESC, order_id, line_no) AS rn FROM snapshot s) q WHERE rn <= 2""",
    "w02_sample_per_supplier": """
        SELECT supplier_id, listing_id FROM (SELECT supplier_id, listing_id, row_number() OVER (PARTITION BY supplier_id ORDER BY CASE WHEN price_cents > 0 THEN 0 ELSE 1 END, canonical_id) AS rn FROM current_price) q WHERE rn <= 5""",
    "w03_page_with_total": "SELECT p_partkey, p_name, t.total FROM part, (SELECT count(*) AS total FROM part) t ORDER BY p_partkey LIMIT 10",
    "w04_first_per_key": "SELECT category, listing_id FROM (SELECT category, listing_id, row_number() OVER (PARTITION BY category ORDER BY price_cents, supplier_id, canonical_id) AS rn FROM current_offer) q WHERE rn = 1",
    "w05_latest_snapshot": """
        SELECT canonical_id, price_cents FROM (SELECT s.*, row_number() OVER (PARTITION BY canonical_id ORDER BY captured_at DESC, order_id, line_no, supplier_id, price_cents) AS rn
          FROM snapshot s WHERE availability = 'in_stock') q WHERE rn = 1""",
    "w06_first_occurrence": """
        SELECT canonical_id, supplier_id, listing_id FROM (SELECT o.*, row_number() OVER (PARTITION BY canonical_id, supplier_id ORDER BY price_cents, listing_id) AS rn FROM current_offer o) q WHERE rn = 1""",
    "w07_best_url_per_key": """
        SELECT url_key, page_id FROM (SELECT lower(split_part(split_part(url, '?', 1), '#', 1)) AS url_key, page_id,
          row_number() OVER (PARTITION BY lower(split_part(split_part(url, '?', 1), '#', 1)) ORDER BY length(html) DESC, page_id) AS rn FROM pages) q WHERE rn = 1""",
}
