"""Orderings, top-k, entity-resolution reports and the small view-derived computations."""

QUERIES = {
    "o01_listing_order": "SELECT listing_id, unit_price_cents, price_cents FROM current_offer ORDER BY unit_price_cents NULLS LAST, price_cents, name, supplier_id, canonical_id LIMIT 50 OFFSET 5",
    "o02_top_then_join": """
        SELECT p.listing_id, p.unit_price_cents, s.supplier_name FROM (SELECT listing_id, supplier_id, unit_price_cents FROM listed_offer ORDER BY unit_price_cents NULLS LAST, supplier_id, canonical_id LIMIT 40) p
        LEFT JOIN supplier_info s ON s.supplier_id = p.supplier_id""",
    "o03_offer_order": """
        SELECT canonical_id, listing_id, row_number() OVER (PARTITION BY canonical_id ORDER BY CASE WHEN unit_price_cents IS NOT NULL THEN 0 ELSE 1 END, unit_price_cents NULLS LAST, price_cents, supplier_id) AS position FROM matched_offer""",
    "o04_invoice_offer_order": """
        SELECT canonical_id, listing_id, position FROM (SELECT canonical_id, listing_id, row_number() OVER (PARTITION BY canonical_id ORDER BY CASE WHEN availability IN ('backordered', 'out_of_stock') THEN 1 ELSE 0 END,
          unit_price_cents NULLS LAST, supplier_id) AS position FROM matched_offer WHERE price_cents > 0) q WHERE position <= 5""",
    "o05_marketplace_order": """
        SELECT canonical_id, listing_id, row_number() OVER (PARTITION BY canonical_id ORDER BY CASE match_status WHEN 'exact' THEN 0 WHEN 'variant' THEN 1 ELSE 2 END, price_cents NULLS LAST, supplier_id) AS position
        FROM matched_offer WHERE supplier_id % 20 = 0""",
    # the score is the share of the query's words that begin a word of the name
    "o06_fuzzy_order": """
        SELECT canonical_id, hits / 3.0 AS score, has_offers FROM (
          SELECT c.canonical_id, b.canonical_id IS NOT NULL AS has_offers, (CASE WHEN concat(' ', lower(c.name), ' ', lower(c.category)) LIKE '% small%' THEN 1 ELSE 0 END)
            + (CASE WHEN concat(' ', lower(c.name), ' ', lower(c.category)) LIKE '% st%' THEN 1 ELSE 0 END) + (CASE WHEN concat(' ', lower(c.name), ' ', lower(c.category)) LIKE '% plated%' THEN 1 ELSE 0 END) AS hits
          FROM canonical c LEFT JOIN cheapest_part b ON b.canonical_id = c.canonical_id) q
        WHERE hits > 0 ORDER BY CASE WHEN has_offers THEN 0 ELSE 1 END, hits DESC, canonical_id LIMIT 30""",
    "o07_category_ranking": "SELECT category, count(*) AS n FROM listing GROUP BY category ORDER BY n DESC, category LIMIT 12",
    # the page is taken first and numbered after, so no task sorts all rows
    "o08_needs_attention": """
        SELECT event_id, row_number() OVER (ORDER BY severity, low, event_id) AS position FROM (
          SELECT event_id, CASE lot WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS severity, CASE WHEN value < 10 THEN 0 ELSE 1 END AS low FROM item_state ORDER BY severity, low, event_id LIMIT 100) x""",
    "o09_evidence_order": "SELECT listing_id, match_status, confidence FROM match_row ORDER BY CASE match_status WHEN 'exact' THEN 0 WHEN 'variant' THEN 1 ELSE 2 END, confidence DESC, supplier_id, canonical_id LIMIT 100",
    "o10_variant_order": "SELECT group_id, canonical_id, row_number() OVER (PARTITION BY group_id ORDER BY variant_rank NULLS LAST, name, canonical_id) AS position FROM canonical WHERE family_id IS NOT NULL",
    "o11_axis_order": "SELECT family_name, n_sizes FROM family ORDER BY n_sizes DESC, family_name, family_type LIMIT 25",
    "o12_collapse_by_supplier": """
        SELECT canonical_id, supplier_id, listing_id FROM (SELECT o.*, row_number() OVER (PARTITION BY canonical_id, supplier_id ORDER BY CASE WHEN confidence > 90 THEN 0 ELSE 1 END, unit_price_cents NULLS LAST) AS rn FROM matched_offer o) q WHERE rn = 1""",
    # for each agent: the oldest queued job, else the oldest that has run for over ten minutes
    "o13_oldest_job": """
        SELECT user_id, job, event_id FROM (SELECT user_id, job, event_id, row_number() OVER (PARTITION BY user_id ORDER BY tier, ts, event_id) AS rn FROM (
          SELECT user_id, 'queued' AS job, 0 AS tier, ts, event_id FROM events WHERE event_type = 'view'
          UNION ALL SELECT user_id, 'stale', 1, ts, event_id FROM events WHERE event_type = 'click' AND ts < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES) u) q WHERE rn = 1""",
    "er01_load_listings": "SELECT listing_id, name, brand, price_cents, availability FROM priced_listing",
    "er12_agreed_axis": "SELECT group_id, min(variant_rank) AS value FROM canonical GROUP BY group_id HAVING count(DISTINCT variant_rank) = 1",
    "er13_family_groups": "SELECT p_brand, p_name, count(DISTINCT p_size) AS n_values, count(*) AS n FROM part GROUP BY p_brand, p_name HAVING count(DISTINCT p_size) >= 2",
    "er15_emit_families": """
        SELECT f.family_id, c.canonical_id, CAST(c.variant_rank AS VARCHAR(10)) AS label, count(*) OVER (PARTITION BY f.family_id, c.variant_rank) AS same_label
        FROM family f JOIN canonical c ON c.family_id = f.family_id""",
    "er16_substitutes": """
        SELECT canonical_id, substitute_id, saving FROM (SELECT a.canonical_id, b.canonical_id AS substitute_id, x.best_cents - y.best_cents AS saving,
            row_number() OVER (PARTITION BY a.canonical_id ORDER BY y.best_cents, b.canonical_id) AS rn
          FROM canonical a JOIN canonical b ON b.name = a.name AND b.brand <> a.brand AND b.variant_rank = a.variant_rank
          JOIN cheapest_part x ON x.canonical_id = a.canonical_id JOIN cheapest_part y ON y.canonical_id = b.canonical_id
          WHERE y.best_cents < x.best_cents AND x.n_suppliers >= 2) q WHERE rn <= 5""",
    # a rebuild: rows set by hand (confidence from 95 on) stay, the others get the family's product; a product that lost its rows is an alias
    "er17_commit": """
        SELECT 'match' AS kind, listing_id AS id, CASE WHEN confidence >= 95 THEN canonical_id ELSE group_id END AS canonical_id, CASE WHEN confidence >= 95 THEN 'manual' ELSE 'auto' END AS origin
        FROM (SELECT l.listing_id, l.canonical_id, l.confidence, c.group_id FROM listing l JOIN canonical c ON c.canonical_id = l.canonical_id) m
        UNION ALL
        SELECT 'alias', CAST(c.canonical_id AS VARCHAR(20)), c.group_id, 'auto' FROM canonical c LEFT JOIN (SELECT DISTINCT canonical_id FROM listing WHERE confidence >= 95) k ON k.canonical_id = c.canonical_id
        WHERE c.group_id <> c.canonical_id AND k.canonical_id IS NULL""",
    # codes by brand and model, and by company and model, where they name one code; the least of both paths
    "er20_enrichment": """
        SELECT part_id, min(code) AS code FROM (
          SELECT p.p_partkey AS part_id, k.code FROM part p JOIN (SELECT brand_norm, model_norm, min(gtin) AS code FROM reference_code GROUP BY brand_norm, model_norm HAVING count(DISTINCT gtin) = 1) k
            ON k.brand_norm = lower(regexp_replace(p.p_brand, '[^A-Za-z0-9]', '', 'g')) AND k.model_norm = lower(regexp_replace(p.p_name, '[^A-Za-z0-9]', '', 'g'))
          UNION SELECT p.p_partkey, k.code FROM part p JOIN (SELECT company_norm, model_norm, min(gtin) AS code FROM reference_code WHERE length(model_norm) >= 4 GROUP BY company_norm, model_norm HAVING count(DISTINCT gtin) = 1) k
            ON k.company_norm = lower(regexp_replace(p.p_brand, '[^A-Za-z0-9]', '', 'g')) AND k.model_norm = lower(regexp_replace(p.p_name, '[^A-Za-z0-9]', '', 'g'))) u
        GROUP BY part_id""",
    "er21_duplicate_reaper": """
        SELECT supplier_id, canonical_id, order_id, line_no FROM (SELECT s.*, row_number() OVER (PARTITION BY supplier_id, canonical_id ORDER BY captured_at DESC, order_id, line_no) AS rn FROM snapshot s) q WHERE rn > 1""",
    # listings once per SKU, then one match per product and listing
    "er22_marketplace_rows": """
        SELECT canonical_id, listing_id, match_status, confidence FROM (SELECT l.*, row_number() OVER (PARTITION BY supplier_id, sku ORDER BY confidence DESC, canonical_id) AS rn FROM listing l) q
        WHERE rn = 1 AND supplier_id % 20 = 0 AND match_status <> 'unmatched'""",
    "er23_marketplace_split": "SELECT CASE WHEN s.is_marketplace THEN 'alternatives' ELSE 'comparison' END AS section, count(*) AS n FROM listed_offer o JOIN supplier_info s ON s.supplier_id = o.supplier_id GROUP BY s.is_marketplace",
    "v01_department_listing": """
        SELECT department, canonical_id FROM (SELECT d.*, row_number() OVER (PARTITION BY department ORDER BY best, canonical_id) AS rn FROM (
          SELECT split_part(category, ' ', 1) AS department, canonical_id, min(price_cents) AS best FROM listed_offer GROUP BY split_part(category, ' ', 1), canonical_id) d) q WHERE rn <= 24""",
    "v02_gallery": "SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages WHERE length(html) > 100) q WHERE rn = 1",
    "v03_cheapest": "SELECT category, min_by(listing_id, (price_cents, supplier_id, canonical_id)) AS listing_id FROM current_offer GROUP BY category",
    "v04_product_offers": """
        SELECT canonical_id, supplier_id, listing_id, pack_size, row_number() OVER (PARTITION BY canonical_id ORDER BY unit_price_cents NULLS LAST, price_cents, supplier_id) AS position FROM listed_offer""",
    # the pack of the newest pending order, else that of the best orderable unit price, else the smallest
    "v05_default_pack": """
        SELECT o.group_id, coalesce(min(s.pack_size), min_by(o.pack_size, (o.unit_price_cents, o.supplier_id, o.canonical_id)) FILTER (WHERE o.availability <> 'backordered' AND o.unit_price_cents IS NOT NULL), min(o.pack_size)) AS pack_size,
               count(DISTINCT o.pack_size) AS n_packs
        FROM listed_offer o LEFT JOIN (SELECT c.group_id, max_by(c.variant_rank, (i.invoice_date, i.invoice_id, i.canonical_id)) AS pack_size
          FROM invoice_line i JOIN canonical c ON c.canonical_id = i.canonical_id WHERE i.invoice_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c.group_id) s ON s.group_id = o.group_id
        GROUP BY o.group_id""",
    "v06_bigger_pack": """
        SELECT a.family_id, a.pack_size AS small_pack, b.pack_size AS big_pack FROM (SELECT family_id, pack_size, min(unit_price_cents) AS best FROM listed_offer WHERE family_id IS NOT NULL GROUP BY family_id, pack_size) a
        JOIN (SELECT family_id, pack_size, min(unit_price_cents) AS best FROM listed_offer WHERE family_id IS NOT NULL GROUP BY family_id, pack_size) b ON b.family_id = a.family_id AND b.pack_size > a.pack_size AND b.best <= 0.9 * a.best""",
    "v07_plan_summary": """
        SELECT practice_id, count(*) AS n, count_if(best_cents IS NULL) AS missing, CAST(floor(100.0 * count(best_cents) / count(*) + 0.5) AS INT) AS coverage, sum(savings_cents) AS savings FROM line_match GROUP BY practice_id""",
    "v08_consolidation_diff": """
        SELECT i.invoice_id, i.line_no, i.listing_id, i.paid_cents, b.best_cents FROM invoice_line i JOIN cheapest_part b ON b.canonical_id = i.canonical_id WHERE b.best_cents < i.paid_cents""",
    "v09_supplier_tabs": "SELECT DISTINCT s.supplier_name FROM listed_offer o JOIN supplier_info s ON s.supplier_id = o.supplier_id ORDER BY s.supplier_name",
    "v10_plan_split": "SELECT invoice_id, count_if(match_status IN ('exact', 'variant')) AS included, count_if(match_status NOT IN ('exact', 'variant')) AS unresolved FROM line_match GROUP BY invoice_id",
    "v11_list_summary": "SELECT practice_id, count(*) AS items, count(DISTINCT supplier_id) AS suppliers, CAST(floor(sum(paid_cents * qty) + 0.5) AS BIGINT) AS spend FROM invoice_line GROUP BY practice_id",
    "v12_quick_search": "SELECT listing_id FROM listing WHERE lower(concat(name, ' ', brand, ' ', listing_id)) LIKE '%12%'",
    "v13_handoff": "SELECT invoice_id, supplier_id, count(*) AS n, CAST(floor(sum(paid_cents * qty) + 0.5) AS BIGINT) AS total FROM line_match WHERE match_status = 'exact' GROUP BY invoice_id, supplier_id",
    "v14_location_board": """
        SELECT location_id, CASE WHEN n = 0 THEN 'not_started' WHEN attention > 0 THEN 'needs_attention' ELSE 'healthy' END AS status, CAST(floor(100.0 * attention / n + 0.5) AS INT) AS attention_pct
        FROM (SELECT location_id, count(*) AS n, count_if(value < 5) AS attention FROM item_state GROUP BY location_id) q""",
    "v15_location_detail": "SELECT location_id, count(*) AS tracked, count_if(lot IN ('view', 'click')) AS traced, count_if(value BETWEEN 5 AND 10) AS expiring, count_if(value < 5) AS expired FROM item_state GROUP BY location_id",
    "v16_expired_list": """
        SELECT event_id, value < 5 AND lot <> 'purchase' AS expired_not_pulled, CASE WHEN code IS NULL OR value IS NULL THEN 'needs_details' WHEN value < 10 THEN 'review' ELSE 'confirmed' END AS part FROM item_state""",
    "v17_primary_location": """
        SELECT code, location_id FROM (SELECT code, location_id, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, location_id) AS rn FROM item GROUP BY code, location_id) q WHERE rn = 1""",
    "v18_attention_page": "SELECT event_id, value FROM item_state WHERE value < 20 ORDER BY value, event_id LIMIT 10 OFFSET 10",
    # types in the order of their registry, unknown ones last
    "v19_files_by_type": """
        SELECT lang, coalesce(rank, 99) AS registry_rank, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id
        FROM documents d LEFT JOIN (SELECT 'en' AS type, 1 AS rank UNION ALL SELECT 'de', 2 UNION ALL SELECT 'fr', 3) r ON r.type = d.lang GROUP BY lang, coalesce(rank, 99) ORDER BY registry_rank, lang""",
    # an offer of a supplier, SKU and price once, in dollars, with the first time it was seen
    "v20_flatten_matches": """
        SELECT supplier_id, canonical_id, price_cents / 100.0 AS price, min(captured_at) AS first_seen, count(*) AS n FROM snapshot GROUP BY supplier_id, canonical_id, price_cents""",
    # an order's cart goes to the shop of its first line that is in stock there; other lines are left over
    "v21_cart_bundles": """
        SELECT x.invoice_id, x.origin, array_join(array_sort(collect_list(CASE WHEN l.supplier_id = x.origin THEN concat(l.canonical_id, ':', CAST(l.qty AS INT)) END)), ',') AS cart,
               count_if(l.supplier_id <> x.origin) AS left_over
        FROM (SELECT i.invoice_id, min_by(i.supplier_id, (i.line_no, i.supplier_id, i.canonical_id)) AS origin FROM invoice_line i
              JOIN current_price c ON c.supplier_id = i.supplier_id AND c.canonical_id = i.canonical_id JOIN supplier_info s ON s.supplier_id = i.supplier_id
              WHERE c.availability = 'in_stock' AND NOT s.is_marketplace GROUP BY i.invoice_id) x
        JOIN (SELECT invoice_id, supplier_id, canonical_id, sum(qty) AS qty FROM invoice_line GROUP BY invoice_id, supplier_id, canonical_id) l ON l.invoice_id = x.invoice_id GROUP BY x.invoice_id, x.origin""",
    "v22_source_counts": "SELECT s.supplier_id, coalesce(p.n, 0) AS products, coalesce(x.n, 0) AS snapshots FROM supplier_info s LEFT JOIN (SELECT supplier_id, count(*) AS n FROM listing GROUP BY supplier_id) p ON p.supplier_id = s.supplier_id LEFT JOIN (SELECT supplier_id, count(*) AS n FROM snapshot GROUP BY supplier_id) x ON x.supplier_id = s.supplier_id",
    "v23_requests_with_quotes": """
        SELECT invoice_id, array_join(array_sort(collect_list(concat(position, '=', listing_id, '@', paid_cents))), ',') AS quotes, min_by(listing_id, position) AS first_item FROM (
          SELECT invoice_id, listing_id, paid_cents, row_number() OVER (PARTITION BY invoice_id ORDER BY line_no, supplier_id, canonical_id, paid_cents) AS position FROM invoice_line) q WHERE position <= 3 GROUP BY invoice_id""",
    "v24_refresh_targets": "SELECT code, min(page_id) AS page_id FROM (SELECT regexp_extract(url, '/([0-9]+)', 1) AS code, page_id FROM pages) q WHERE code <> '' GROUP BY code",
    "v25_crawl_merge": "SELECT canonical_id, listing_id FROM (SELECT canonical_id, listing_id, row_number() OVER (PARTITION BY canonical_id ORDER BY order_id, line_no, supplier_id) AS rn FROM snapshot) q WHERE rn = 1",
}
