"""Read models and listings: latest prices, best offers, category and supplier pages.

Best offers are taken by aggregates over one pass of ``listed_offer``, which combine before they are shuffled, so
each model reads the lines once.
"""

#: Order of offers: comparable ones first, by unit price, then by price; the pair of keys breaks ties.
UNIT_ORDER = "CASE WHEN unit_price_cents IS NULL THEN 1 ELSE 0 END, unit_price_cents, price_cents, supplier_id, canonical_id"
#: The same order as one value.
UNIT_KEY = "(CASE WHEN unit_price_cents IS NULL THEN 1 ELSE 0 END, coalesce(unit_price_cents, 0), price_cents, supplier_id, canonical_id)"

CATEGORY_LISTING = f"""
    SELECT a.category_key, a.group_id, concat(a.best_supplier_id, '-', a.best_canonical_id) AS best_listing_id, a.price_cents, a.unit_price_cents, a.best_supplier_id, a.best_canonical_id,
           a.offer_count, i.n_variants, i.first_name
    FROM (SELECT category_key, group_id, count(DISTINCT supplier_id) AS offer_count, min(unit_price_cents) AS unit_price_cents, min_by(price_cents, {UNIT_KEY}) AS price_cents,
                 min_by(supplier_id, {UNIT_KEY}) AS best_supplier_id, min_by(canonical_id, {UNIT_KEY}) AS best_canonical_id
          FROM listed_offer GROUP BY category_key, group_id) a
    JOIN (SELECT group_id, count(*) AS n_variants, min(name) AS first_name FROM canonical GROUP BY group_id) i ON i.group_id = a.group_id"""

QUERIES = {
    # latest price of each listing
    "q06_current_price": "SELECT listing_id, supplier_id, price_cents, unit_price_cents, availability, captured_at FROM current_price",
    "q07_current_offer": "SELECT listing_id, supplier_id, canonical_id, category_key, price_cents, unit_price_cents FROM current_offer",
    "q08_category_summary": """
        SELECT category, count(*) AS n_listings, count(DISTINCT supplier_id) AS n_suppliers FROM current_offer GROUP BY category""",
    # substitutes count here, unlike in the listings
    "q09_category_priced_count": """
        SELECT category_key, count(DISTINCT group_id) AS priced_count FROM matched_offer WHERE match_status <> 'unmatched' GROUP BY category_key""",
    "q10_supplier_product_count": "SELECT supplier_id, count(*) AS n_products FROM listing GROUP BY supplier_id",
    "q11_supplier_listing": f"""
        SELECT supplier_id, group_id, concat(supplier_id, '-', canonical_id) AS listing_id, price_cents, unit_price_cents, variant_count FROM (
          SELECT supplier_id, group_id, min_by(canonical_id, {UNIT_KEY}) AS canonical_id, min_by(price_cents, {UNIT_KEY}) AS price_cents, min(unit_price_cents) AS unit_price_cents, count(*) AS variant_count
          FROM listed_offer GROUP BY supplier_id, group_id) q""",
    "q12_category_listing": CATEGORY_LISTING,
    # the live definition filters one category before it ranks; it agrees with the model above
    "q01_category_listing_live": f"""
        SELECT group_id, concat(supplier_id, '-', canonical_id) AS listing_id, unit_price_cents, price_cents, offer_count FROM (
          SELECT group_id, min_by(supplier_id, {UNIT_KEY}) AS supplier_id, min_by(canonical_id, {UNIT_KEY}) AS canonical_id, min(unit_price_cents) AS unit_price_cents, min_by(price_cents, {UNIT_KEY}) AS price_cents,
                 count(DISTINCT supplier_id) AS offer_count
          FROM listed_offer WHERE category ILIKE 'STANDARD%' GROUP BY group_id) q
        ORDER BY {UNIT_ORDER} LIMIT 50""",
    # page first, then join
    "q02_category_page": """
        SELECT p.category_key, p.group_id, p.best_listing_id, p.unit_price_cents, p.offer_count, coalesce(s.supplier_name, 'Unknown supplier') AS supplier_name
        FROM (SELECT * FROM (""" + CATEGORY_LISTING + """) m ORDER BY CASE WHEN unit_price_cents IS NULL THEN 1 ELSE 0 END, unit_price_cents, price_cents, best_supplier_id, best_canonical_id LIMIT 50 OFFSET 10) p
        LEFT JOIN supplier_info s ON s.supplier_id = p.best_supplier_id""",
    "q03_supplier_page": """
        SELECT supplier_id, listing_id, group_id, price_cents FROM listed_offer WHERE supplier_id = 7 ORDER BY """ + UNIT_ORDER + " LIMIT 24",
    # every sibling of a family with its offers' range
    "q04_product_page": """
        SELECT c.group_id, c.canonical_id, c.variant_rank, count(o.listing_id) AS n_offers, min(o.price_cents) AS lowest, max(o.price_cents) AS highest,
               min(o.unit_price_cents) AS lowest_unit, max(o.unit_price_cents) AS highest_unit
        FROM canonical c LEFT JOIN listed_offer o ON o.canonical_id = c.canonical_id
        GROUP BY c.group_id, c.canonical_id, c.variant_rank""",
    "q05_browse": """
        SELECT c.canonical_id, c.name, min(o.price_cents) AS best_price, count(DISTINCT o.supplier_id) AS n_suppliers
        FROM canonical c JOIN listed_offer o ON o.canonical_id = c.canonical_id WHERE o.supplier_id IN (1, 2, 3, 5, 8)
        GROUP BY c.canonical_id, c.name ORDER BY best_price, c.canonical_id LIMIT 50""",
    "q13_categories_landing": f"""
        SELECT category_key, n_groups, n_suppliers, concat(best_supplier_id, '-', best_canonical_id) AS best_listing_id, best_unit FROM (
          SELECT category_key, count(DISTINCT group_id) AS n_groups, count(DISTINCT supplier_id) AS n_suppliers, min(unit_price_cents) AS best_unit,
                 min_by(supplier_id, {UNIT_KEY}) AS best_supplier_id, min_by(canonical_id, {UNIT_KEY}) AS best_canonical_id
          FROM (SELECT category_key, group_id, supplier_id, min(unit_price_cents) AS unit_price_cents, min_by(price_cents, {UNIT_KEY}) AS price_cents, min_by(canonical_id, {UNIT_KEY}) AS canonical_id
                FROM listed_offer GROUP BY category_key, group_id, supplier_id) s
          GROUP BY category_key) q
        ORDER BY n_groups DESC, category_key LIMIT 12""",
    "q14_suppliers": """
        SELECT s.supplier_id, s.supplier_name, s.free_threshold_cents, s.flat_cents, coalesce(c.n, 0) AS n_products
        FROM supplier_info s LEFT JOIN (SELECT supplier_id, count(*) AS n FROM listing GROUP BY supplier_id) c ON c.supplier_id = s.supplier_id""",
    # comparable offers of a product first, by unit price, then the rest by sticker price
    "q20_offer_enrichment": """
        SELECT canonical_id, listing_id, row_number() OVER (PARTITION BY canonical_id ORDER BY CASE WHEN unit_price_cents IS NULL THEN 1 ELSE 0 END, unit_price_cents, price_cents, supplier_id) AS offer_rank
        FROM listed_offer WHERE match_status IN ('exact', 'variant')""",
    "q24_inventory_prices": """
        SELECT i.location_id, i.code, min(o.price_cents) AS lowest, max(o.price_cents) AS highest, count(o.listing_id) AS n_offers
        FROM item_state i LEFT JOIN listed_offer o ON o.canonical_id = i.code GROUP BY i.location_id, i.code""",
    # scanned codes against suppliers' and makers' SKUs, as they are and in capitals
    "q17_sku_scan": """
        SELECT DISTINCT s.code, l.listing_id FROM (SELECT DISTINCT code, key FROM (
            SELECT code, code AS key FROM (SELECT concat('s', user_id % 20, '-', regexp_extract(props, '([0-9]+)', 1)) AS code FROM events UNION ALL SELECT concat('Brand#', user_id % 50, '-', regexp_extract(props, '([0-9]+)', 1)) FROM events) a
            UNION ALL SELECT code, upper(code) FROM (SELECT concat('s', user_id % 20, '-', regexp_extract(props, '([0-9]+)', 1)) AS code FROM events) b) k) s
        JOIN (SELECT listing_id, sku AS key FROM listing UNION ALL SELECT listing_id, mfr_sku FROM listing) l ON l.key = s.key""",
    # a reference's products: the house supplier's own SKU, brand and model, company and model; the suffix path is j10
    "q18_reference_lookup": """
        SELECT DISTINCT gtin, part_id FROM (
          SELECT r.gtin, p.p_partkey AS part_id FROM reference_code r JOIN part p ON lower(regexp_replace(concat('P-', p.p_partkey), '[^A-Za-z0-9]', '', 'g')) = r.model_norm WHERE r.company_norm LIKE 'house%'
          UNION SELECT r.gtin, p.p_partkey FROM reference_code r JOIN part p ON lower(regexp_replace(p.p_brand, '[^A-Za-z0-9]', '', 'g')) = r.brand_norm AND lower(regexp_replace(p.p_name, '[^A-Za-z0-9]', '', 'g')) = r.model_norm
          UNION SELECT r.gtin, p.p_partkey FROM reference_code r JOIN part p ON lower(regexp_replace(p.p_brand, '[^A-Za-z0-9]', '', 'g')) = r.company_norm AND lower(regexp_replace(p.p_name, '[^A-Za-z0-9]', '', 'g')) = r.model_norm
            WHERE length(r.company_norm) >= 4) u""",
    "q19_substitutes": """
        SELECT canonical_id, substitute_id, unit_price_cents FROM (
          SELECT a.canonical_id, b.canonical_id AS substitute_id, b.best_cents AS unit_price_cents,
                 row_number() OVER (PARTITION BY a.canonical_id ORDER BY b.best_cents, b.canonical_id) AS rn
          FROM canonical a JOIN canonical c ON c.name = a.name AND c.category = a.category AND c.canonical_id <> a.canonical_id
          JOIN cheapest_part b ON b.canonical_id = c.canonical_id
          LEFT JOIN cheapest_part own ON own.canonical_id = a.canonical_id WHERE own.canonical_id IS NULL OR own.best_cents > 3000) q WHERE rn <= 3""",
    "q22_members_and_offers": """
        SELECT canonical_id, listing_id, comparable_cents, offer_rank FROM (
          SELECT o.canonical_id, o.listing_id, coalesce(o.unit_price_cents, o.price_cents) AS comparable_cents,
                 row_number() OVER (PARTITION BY o.canonical_id ORDER BY CASE WHEN o.availability = 'backordered' THEN 1 ELSE 0 END, coalesce(o.unit_price_cents, o.price_cents), o.supplier_id) AS offer_rank
          FROM listed_offer o WHERE o.match_status IN ('exact', 'variant')) q WHERE offer_rank <= 5""",
    "q23_invoice_totals": """
        SELECT invoice_id, CAST(floor(sum(paid_cents * qty) + 0.5) AS BIGINT) AS invoice_cents,
               CAST(floor(sum(least(coalesce(best_cents, paid_cents), paid_cents) * qty) + 0.5) AS BIGINT) AS suggested_cents, sum(savings_cents) AS savings_cents,
               count_if(match_status = 'exact') AS n_exact, count_if(match_status = 'variant') AS n_variant,
               count_if(match_status = 'needs_review') AS n_review, count_if(match_status = 'unmatched' OR match_status IS NULL) AS n_unmatched
        FROM line_match GROUP BY invoice_id""",
    "q27_match_rows": """
        SELECT r.invoice_id, r.line_no, r.listing_id, r.paid_cents, b.listing_id AS recommended_id, b.unit_price_cents AS recommended_cents,
               CASE WHEN b.listing_id IS NOT NULL AND b.listing_id <> r.listing_id AND b.unit_price_cents < r.paid_cents THEN b.supplier_id END AS switch_to
        FROM invoice_line r LEFT JOIN (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY canonical_id ORDER BY unit_price_cents, supplier_id) AS rn
          FROM listed_offer o WHERE availability <> 'backordered' AND unit_price_cents > 0) q WHERE rn = 1) b ON b.canonical_id = r.canonical_id""",
    # strictly fastest of two or more delivery estimates
    "q28_fastest_offer": """
        SELECT canonical_id, min(days) AS fastest_days, min(CASE WHEN days = least_days THEN listing_id END) AS listing_id FROM (
          SELECT e.*, min(days) OVER (PARTITION BY canonical_id) AS least_days FROM (
            SELECT o.canonical_id, o.listing_id, 1 + (o.supplier_id * 7 + CASE o.availability WHEN 'in_stock' THEN 0 ELSE 3 END) % 9 AS days
            FROM listed_offer o WHERE o.availability <> 'backordered') e) q
        GROUP BY canonical_id HAVING count(*) >= 2 AND count_if(days = least_days) = 1""",
    "q29_list_status": """
        SELECT practice_id, CASE WHEN count_if(match_status IS NULL OR match_status = 'unmatched') = count(*) THEN 'draft'
                 WHEN count_if(match_status = 'needs_review') > 0 THEN 'needs_review' ELSE 'ready' END AS status, count(*) AS n_lines
        FROM line_match GROUP BY practice_id""",
}

#: What Spark runs for queries whose plain text above makes pairs that it then drops; the rows are the same.
SPARK = {
    # a part's codes and names are keys of one join; a pair is made under the least key that it shares only, so the pairs
    # themselves are never shuffled
    "q18_reference_lookup": """
        WITH refs AS (SELECT gtin, collect_set(k) AS own FROM (
               SELECT gtin, explode(array(CASE WHEN company_norm LIKE 'house%' THEN concat('::', model_norm) END, concat(brand_norm, ':', model_norm), CASE WHEN length(company_norm) >= 4 THEN concat(company_norm, ':', model_norm) END)) AS k
               FROM reference_code) x WHERE k IS NOT NULL GROUP BY gtin),
             parts AS (SELECT part_id, collect_set(k) AS own FROM (
               SELECT p_partkey AS part_id, explode(array(concat('::', lower(regexp_replace(concat('P-', p_partkey), '[^A-Za-z0-9]', '', 'g'))),
                 concat(lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), ':', lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g'))))) AS k
               FROM part) x WHERE k IS NOT NULL GROUP BY part_id)
        SELECT r.gtin, p.part_id FROM (SELECT gtin, own, explode(own) AS k FROM refs) r JOIN (SELECT part_id, own, explode(own) AS k FROM parts) p ON p.k = r.k
        WHERE array_min(array_intersect(r.own, p.own)) = r.k""",
    # of a name and category the four cheapest parts are enough for any of its parts
    "q19_substitutes": """
        WITH priced AS (SELECT p.p_partkey AS canonical_id, p.p_name AS name, p.p_type AS category, b.best_cents FROM part p LEFT JOIN cheapest_part b ON b.canonical_id = p.p_partkey),
             least AS (SELECT * FROM (SELECT x.*, dense_rank() OVER (PARTITION BY name, category ORDER BY best_cents, canonical_id) AS place FROM priced x WHERE best_cents IS NOT NULL) y WHERE place <= 4)
        SELECT canonical_id, substitute_id, unit_price_cents FROM (
          SELECT a.canonical_id, c.canonical_id AS substitute_id, c.best_cents AS unit_price_cents, row_number() OVER (PARTITION BY a.canonical_id ORDER BY c.best_cents, c.canonical_id) AS rn
          FROM priced a JOIN least c ON c.name = a.name AND c.category = a.category AND c.canonical_id <> a.canonical_id
          WHERE a.best_cents IS NULL OR a.best_cents > 3000) q WHERE rn <= 3""",
}
