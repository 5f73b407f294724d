"""Readers and sinks, end to end: a table is written in the source's format to the shared folder, read back by the
reader, and compared with the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from ..streaming import state as ST
from . import readers as R, sinks as S


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def src04_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes, commas and line ends through the CSV report (SNK06) and the reader."""
    path = _path(spark, "csv")
    d = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"a", '), F.translate(F.coalesce("text", F.lit("")), "\r\x0b\x0c", "   "), F.lit(' "z"')).alias("text"))
    S.csv_report(d, path)
    return R.read_csv(spark, path).select(F.col("doc_id").cast("long"), F.md5("text").alias("md5"))


def src05_invoice_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "invoices")
    p = _read(spark, sf_dir, "part")
    S.csv_report(p.select(F.when(F.col("p_partkey") % 5 == 0, "ab").otherwise(F.concat_ws(", ", "p_name", "p_partkey")).alias("Item"), F.col("p_partkey").alias("Part #"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("Qty Ordered"), F.lit("bx").alias("UOM"), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("Price ea")), path)
    return R.read_invoice_csv(spark, path)


def src06_pdf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items of invoices, each line's three words a little out of line, back to rows of cells."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct().withColumn("seq", F.row_number().over(R.W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    item = lambda x, dy, width, text: F.struct(F.lit(x).alias("x"), (F.lit(10_000.0) - F.col("seq") * 12 + dy).alias("y"), F.lit(width).alias("width"), text.alias("text"))
    items = li.select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.explode(F.array(item(10.0, 0.0, 30.0, F.concat(F.lit("P"), "l_partkey")), item(45.0, 1.0, 20.0, F.lit("blue")), item(120.0, -1.0, 20.0, F.concat(F.lit("S"), "l_suppkey")))).alias("i")).select("doc", "page", "i.*")
    return R.invoice_rows(items).select("doc", F.array_join("cells", "|").alias("cells"))


def src07_invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with two amounts; every fifth has a total that no whole number of the line explains."""
    p = _read(spark, sf_dir, "part")
    unit = (F.col("p_partkey") % 9000 + 125).cast("long")
    total = F.when(F.col("p_partkey") % 5 == 0, unit * 7777 + 5000).otherwise(unit * F.col("p_size"))
    money = lambda c: F.concat(F.lit("$"), F.format_number(c / 100, 2))
    lines = p.select("p_partkey", F.concat_ws(" ", F.concat(F.lit("AB-"), F.col("p_partkey") + 1000), "p_name", F.col("p_size").cast("string"), F.lit("bx"), money(unit), money(total)).alias("line"))
    return R.parse_invoice_rows(lines.unionByName(p.select("p_partkey", F.concat(F.lit("no amounts "), "p_name").alias("line")))).drop("line")


def src08_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    loc = F.transform(F.sort_array(F.collect_set("url")), lambda u: F.concat(F.lit("<url><loc> <![CDATA["), u, F.lit("]]> </loc></url>")))
    maps = _read(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("n")).agg(F.array_join(loc, "\n").alias("xml"))
    return R.sitemap_locations(maps).distinct()


def src12_shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "shop")
    variant = F.struct(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("title"), F.concat(F.lit("K"), "p_partkey").alias("sku"), F.format_string("%.2f", "p_retailprice").alias("price"), (F.col("p_partkey") % 2 == 0).alias("available"))
    products = _read(spark, sf_dir, "part").groupBy("p_name", "p_brand").agg(F.collect_list(variant).alias("variants"), F.min("p_partkey").alias("id")).select(F.struct("id", F.col("p_name").alias("title"), F.col("p_brand").alias("vendor"), "variants").alias("p"))
    products.groupBy(F.floor(F.col("p.id") / 40)).agg(F.collect_list("p").alias("products")).select(F.to_json(F.struct("products")).alias("value")).write.text(path)
    return R.shopify_products(spark, path, lines=True).select("product_id", "title", "vendor", "variant_id", "variant", "sku", "price_cents", "availability")


def src13_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "devices")
    gtin = F.lpad(F.col("p_partkey").cast("string"), 14, "0")
    ids = F.concat(F.lit("<identifiers><identifier><deviceId>"), gtin, F.lit("</deviceId><deviceIdIssuingAgency>GS1</deviceIdIssuingAgency></identifier><identifier><deviceId>D7</deviceId><deviceIdIssuingAgency>HIBCC</deviceIdIssuingAgency></identifier></identifiers>"))
    device = F.concat(F.lit("<device>"), ids, F.lit("<brandName>"), "p_brand", F.lit("</brandName><versionModelNumber>M-"), "p_partkey", F.lit("</versionModelNumber><catalogNumber>Cat "), F.col("p_partkey") + 1000, F.lit("</catalogNumber><companyName>"), "p_name", F.lit("</companyName></device>"))
    # one document a file
    files = _read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 5000).alias("n")).agg(F.concat(F.lit("<gudid>"), F.array_join(F.collect_list(device), ""), F.lit("</gudid>")).alias("value"))
    files.write.partitionBy("n").text(path)
    return R.gudid_devices(spark, path).select("gtin", "brand_norm", "model_norm", "company_name")


def src14_marketplace_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages of parts: each has two links to the same product, one with a query string, and a price after."""
    card = F.concat(F.lit('<a href="https://shop.example/p/'), "p_partkey", F.lit('?ref=1"><img src="x.jpg"></a><p>ad</p><a href="https://shop.example/p/'), "p_partkey", F.lit('/"><b>'), "p_name", F.lit("</b></a> <span>now $"), F.format_string("%.2f", "p_retailprice"), F.lit("</span> or $1.00/ea"))
    pages = _read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("page")).agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", card.alias("c")))), lambda x: x["c"]), "<br>" + " " * 1800), F.lit("</html>")).alias("html"))
    return R.marketplace_cards(pages)


def src15_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    offer = lambda price: F.struct(price.cast("string").alias("price"))
    product = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.concat(F.lit("K"), "p_partkey").alias("sku"), F.struct(F.col("p_brand").alias("name")).alias("brand"), F.array(offer(F.lit("0")), offer(F.col("p_size") + 0.5), offer(F.col("p_size") + 3)).alias("offers"))
    doc = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"@graph":[{"@type":"Page"},'), F.to_json(product), F.lit("]}"))).otherwise(F.to_json(product))
    pages = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit('<title>t</title><script type="application/ld+json">'), doc, F.lit("</script>")).alias("html"))
    return R.json_ld_products(R.html_meta(pages).select("page_id", "json_ld"))


def src16_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "seeds")
    _read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "), "p_partkey")).alias("value")).write.text(path)
    return R.seed_queries(spark, path)


def snk01_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, o = _path(spark, "append"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    S.append(o.where("o_orderkey % 2 = 0"), path)
    S.append(o.where("o_orderkey % 2 <> 0"), path)
    return spark.read.parquet(path)


def snk02_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, o = _path(spark, "replace"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    S.replace(o, path)
    S.replace(o.where("o_custkey % 2 = 0"), path)
    return S.current(spark, path)


def _stock(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    twice = p.where("p_partkey % 3 = 0").select((F.col("p_partkey") * 2).alias("p_partkey"), F.upper("p_name").alias("p_name"), F.explode(F.array(F.lit(1), F.lit(2))).alias("p_size"))
    return p, twice


def snk03_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows repeat their keys; the row with the larger size is the later one."""
    old, new = _stock(spark, sf_dir)
    return S.upsert(old, new, ["p_partkey"], [F.desc("p_size")])


def snk04_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _stock(spark, sf_dir)
    return S.update_from(old, new.where("p_size = 1"), ["p_partkey"], ["p_name"])


def snk05_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models, given in any order, each built after those it reads."""
    root, tag = _path(spark, "models"), f"m{uuid.uuid4().hex}"
    count, best, line = f"{tag}_count", f"{tag}_best", f"{tag}_line"
    models = {
        best: ([line, count], lambda s: s.sql(f"SELECT c.l_suppkey, c.n, max(l.l_quantity) AS most FROM {count} c JOIN {line} l ON l.l_suppkey = c.l_suppkey GROUP BY c.l_suppkey, c.n")),
        count: ([line], lambda s: s.sql(f"SELECT l_suppkey, count(*) AS n FROM {line} GROUP BY l_suppkey")),
        line: ([], lambda s: _read(s, sf_dir, "lineitem").select("l_suppkey", "l_quantity")),
    }
    S.refresh(spark, models, root)
    return spark.table(best)


def snk07_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "summary")
    S.json_report(_read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_name").alias("first")), path)
    return spark.read.schema("p_brand string, n long, first string").json(path)


def snk07_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the brands as pages, and its cells read back."""
    path = _path(spark, "pages")
    S.html_report(_read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.concat(F.min("p_name"), F.lit(" <&>")).alias("first")), path, "Brands & parts")
    cells = spark.read.text(path).select(F.regexp_extract_all("value", F.lit("<td>([^<]*)</td>"), F.lit(1)).alias("c")).where("size(c) = 3")
    return cells.select(F.col("c")[0].alias("p_brand"), F.col("c")[1].cast("long").alias("n"), F.col("c")[2].alias("first"))


def snk08_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked_candidates(_read(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", [F.desc("p_partkey")])


def st06_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three devices' lists, merged in whichever order: the newest write of an item, deletions first in a tie."""
    e = _read(spark, sf_dir, "events").select(
        (F.col("user_id") % 50).alias("list_id"), F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("item_id"), F.date_trunc("day", "ts").alias("updated_at"), (F.col("event_type") == "logout").alias("deleted"), F.col("event_id").alias("payload"),
    )
    parts = [e.where(f"payload % 3 = {k}") for k in (2, 0, 1)]
    merged = None
    for p in parts:
        merged = ST.merge_lists(merged, p)
    return merged


QUERIES = {f.__name__: f for f in (
    src04_csv, src05_invoice_csv, src06_pdf_rows, src07_invoice_lines, src08_sitemap, src12_shop_products, src13_devices, src14_marketplace_cards, src15_json_ld, src16_seeds,
    snk01_append, snk02_replace, snk03_upsert, snk04_update, snk05_refresh, snk07_summary, snk07_html, snk08_ranks, st06_state_merge,
)}
_STOCK = "SELECT p_partkey * 2 AS p_partkey, upper(p_name) AS p_name FROM part WHERE p_partkey % 3 = 0"
ORACLES = {
    "src04_csv": "SELECT doc_id, md5(concat('\"a\", ', translate(coalesce(text, ''), concat(chr(13), chr(11), chr(12)), '   '), ' \"z\"')) AS md5 FROM documents",
    "src05_invoice_csv": """
        SELECT concat(p_name, ', ', p_partkey) AS description, CAST(p_partkey AS VARCHAR) AS sku, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 1 END AS qty, 'bx' AS unit, CAST(floor(round(p_retailprice, 2) * 100 + 0.5) AS BIGINT) AS unit_price_cents
        FROM part WHERE p_partkey % 5 <> 0""",
    "src06_pdf_rows": "SELECT doc, cells FROM (SELECT DISTINCT l_orderkey AS doc, l_linenumber, concat('P', l_partkey, ' blue|S', l_suppkey) AS cells FROM lineitem) q",
    "src07_invoice_lines": """
        SELECT p_partkey, concat('AB-', p_partkey + 1000) AS sku, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS qty, p_partkey % 9000 + 125 AS unit_price_cents,
               CASE WHEN p_partkey % 5 = 0 THEN (p_partkey % 9000 + 125) * 7777 + 5000 ELSE (p_partkey % 9000 + 125) * p_size END AS total_cents FROM part""",
    "src08_sitemap": "SELECT DISTINCT url FROM pages WHERE url IS NOT NULL",
    "src12_shop_products": """
        SELECT min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS product_id, p_name AS title, p_brand AS vendor, p_partkey AS variant_id, CAST(p_size AS VARCHAR) AS variant, concat('K', p_partkey) AS sku,
               CAST(floor(round(p_retailprice, 2) * 100 + 0.5) AS BIGINT) AS price_cents, CASE WHEN p_partkey % 2 = 0 THEN 'in_stock' ELSE 'backordered' END AS availability FROM part""",
    "src13_devices": """
        SELECT lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS gtin, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS brand_norm, model_norm, p_name AS company_name FROM (
          SELECT *, concat('m', p_partkey) AS model_norm FROM part WHERE p_partkey > 99 UNION ALL SELECT *, concat('cat', p_partkey + 1000) FROM part) q""",
    "src14_marketplace_cards": """
        SELECT concat('https://shop.example/p/', p_partkey) AS url, p_name AS title, CAST(floor(round(p_retailprice, 2) * 100 + 0.5) AS BIGINT) AS price_cents, 'x.jpg' AS image, 2 AS n_links FROM part""",
    "src15_json_ld": "SELECT p_partkey AS page_id, p_name AS name, concat('K', p_partkey) AS sku, p_brand AS brand, p_size * 100 + 50 AS price_cents FROM part",
    "src16_seeds": "SELECT concat(p_name, ' ', p_partkey) AS query FROM part WHERE p_partkey % 3 = 2",
    "snk01_append": "SELECT o_orderkey, o_custkey FROM orders",
    "snk02_replace": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 0",
    "snk03_upsert": f"SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM ({_STOCK}) k) UNION ALL SELECT p_partkey, p_name, 2 FROM ({_STOCK}) n",
    "snk04_update": f"SELECT p.p_partkey, coalesce(n.p_name, p.p_name) AS p_name, p.p_size FROM part p LEFT JOIN ({_STOCK}) n ON n.p_partkey = p.p_partkey",
    "snk05_refresh": "SELECT l_suppkey, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY l_suppkey",
    "snk07_summary": "SELECT p_brand, count(*) AS n, min(p_name) AS first FROM part GROUP BY p_brand",
    "snk07_html": "SELECT p_brand, count(*) AS n, concat(min(p_name), ' &lt;&amp;&gt;') AS first FROM part GROUP BY p_brand",
    "snk08_ranks": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS rank FROM part",
    "st06_state_merge": """
        SELECT list_id, item_id, updated_at, deleted, payload FROM (SELECT q.*, row_number() OVER (PARTITION BY list_id, item_id ORDER BY updated_at DESC, deleted DESC, payload DESC) AS rn FROM (
          SELECT user_id % 50 AS list_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id, date_trunc('day', ts) AS updated_at, event_type = 'logout' AS deleted, event_id AS payload FROM events) q) r WHERE rn = 1""",
}
