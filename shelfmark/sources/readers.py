"""Sources: CSV, invoices, sitemaps, product pages, catalog APIs and device XML as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as T
from ..session import saver, ship

#: Header aliases of invoice columns.
INVOICE_ALIASES = {
    "description": ["description", "item", "product", "name", "details"],
    "sku": ["sku", "item #", "item#", "item number", "catalog", "catalog #", "part", "part #", "mfg #"],
    "qty": ["qty", "quantity", "qty ordered", "ordered", "count"],
    "unit": ["unit", "uom", "unit of measure", "pack"],
    "price": ["unit price", "price", "unit cost", "cost", "each", "price ea"],
}


def active(df: DataFrame) -> DataFrame:
    """SRC01: rows that are not softly deleted."""
    return df.where("deleted_at IS NULL")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of quoted CSV files, from 0 in each, whatever line ends their fields hold.

    A file is read in splits.  Whether a line begins inside quotes is told by the number of quotes before it: counted
    by split, summed over the splits of a file (a row each), and then over the lines of a split where they are read.
    Records are put together there too, and written once; only those that go on in another split are brought together."""
    save = saver(spark)
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.regexp_count("value", F.lit('"')) % 2).cast("int").alias("odd"), F.col("value").alias("text")
    )
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = lines.select("file", "block", "odd").mapInArrow(_quotes_by_split, "file string, block long, odd long, even_begins long, odd_begins long")
    splits = splits.withColumn("start", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    begins = F.when(F.col("start") == 0, F.col("even_begins")).otherwise(F.col("odd_begins"))
    splits = splits.withColumn("first", F.coalesce(F.sum(begins).over(before), F.lit(0))).select("file", "block", "start", "first")
    # a row a split: lines stay in their places and order
    parts = lines.join(F.broadcast(save(splits)), ["file", "block"]).select("file", "block", "start", "first", "odd", "text")
    parts = save(parts.mapInArrow(_records_of_split, "file string, block long, record long, whole boolean, text string"))
    cut = parts.where("NOT whole").groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return parts.where("whole").select("file", "record", "text").unionByName(cut)


def _split_runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of a batch by (file, block); a task reads the lines of a split one after the other."""
    if not batch.num_rows:
        return
    file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy(zero_copy_only=False)
    codes, names = file.indices.to_numpy(zero_copy_only=False), file.dictionary
    ends = [*(np.flatnonzero((np.diff(block) != 0) | (np.diff(codes) != 0)) + 1).tolist(), batch.num_rows]
    for at, end in zip([0, *ends], ends):
        yield (names[int(codes[at])].as_py(), int(block[at])), batch.slice(at, end - at)


def _quotes_by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A split's lines with an odd number of quotes, and its lines before which their number is even, and odd."""
    found: list[list] = []
    for batch in batches:
        for key, run in _split_runs(batch):
            if not found or found[-1][0] != key:
                found.append([key, 0, 0, 0])
            own = found[-1]
            odd = run.column("odd").to_numpy(zero_copy_only=False).astype("int64")
            n_inside = int(((own[1] + np.cumsum(odd) - odd) % 2).sum())
            own[1], own[2], own[3] = own[1] + int(odd.sum()), own[2] + len(odd) - n_inside, own[3] + n_inside
    columns = [[k[0] for k, *_ in found], [k[1] for k, *_ in found], *[[x[i] for x in found] for i in (1, 2, 3)]]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["file", "block", "odd", "even_begins", "odd_begins"])


def _records_of_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split; not ``whole`` where lines of it are, or may be, in another one."""
    key, quotes, record, known, open_ = None, 0, 0, False, []

    def out(records: list[int], whole: list[bool], texts: pa.Array) -> pa.RecordBatch:
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(records, pa.int64()), pa.array(whole, pa.bool_()), texts], ["file", "block", "record", "whole", "text"])

    def joined(lines: list[pa.Array], starts: list[int]) -> pa.Array:
        values = pa.concat_arrays(lines)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(values)], pa.int32()), values), "\n")

    for batch in batches:
        for own, run in _split_runs(batch):
            if own != key:
                if open_:  # the last record of a split is whole if its quotes are closed and it began there
                    yield out([record], [known and quotes % 2 == 0], joined(open_, [0]))
                key, quotes, record, known, open_ = own, run.column("start")[0].as_py(), run.column("first")[0].as_py() - 1, False, []
            odd, text = run.column("odd").to_numpy(zero_copy_only=False).astype("int64"), run.column("text")
            begins = np.flatnonzero((quotes + np.cumsum(odd) - odd) % 2 == 0).tolist()
            quotes += int(odd.sum())
            if not begins:
                open_.append(text)
                continue
            records, whole = [], []
            if begins[0] > 0:
                open_.append(text.slice(0, begins[0]))
            if open_:
                records, whole = [record], [known]
            n_open = sum(map(len, open_))
            closed = [*open_, text.slice(begins[0], begins[-1] - begins[0])]
            records += range(record + 1, record + len(begins))
            whole += [True] * (len(begins) - 1)
            if records:
                yield out(records, whole, joined(closed, [*([0] if open_ else []), *[n_open + b - begins[0] for b in begins[:-1]]]))
            record, known, open_ = record + len(begins), True, [text.slice(begins[-1])]
    if open_:
        yield out([record], [known and quotes % 2 == 0], joined(open_, [0]))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC04: quoted fields with doubled quotes and line ends inside; blank rows skipped.  The first record of a file
    names its columns, the first file's those of all.  Large files are read by many tasks (``csv_records``)."""
    save = saver(spark)
    records = csv_records(spark, path).withColumn("text", F.regexp_replace("text", "\r$", "")).where(F.trim("text") != "")
    head = save(records.groupBy("file").agg(F.min("record").alias("record")))
    top = records.join(head, ["file", "record"]).agg(F.min(F.struct("file", "text"))["text"]).first()[0]
    options = {"quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    names = spark.read.options(**options, header="true").csv(spark.sparkContext.parallelize([top or ""], 1)).columns
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = records.join(F.broadcast(head.withColumnRenamed("record", "head")), "file").where("record <> head")
    df = rows.select(F.from_csv("text", schema, options).alias("r")).select("r.*")
    filled = F.lit(False)
    for c in df.columns:
        filled = filled | (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
    return df.where(filled)


def read_invoice_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC05: description, sku, qty, unit, unit_price_cents; descriptions of 3 or more characters."""
    df = read_csv(spark, path)
    pick = lambda name: next((F.col(f"`{c}`") for c in df.columns if c.strip().lower() in INVOICE_ALIASES[name]), F.lit(None).cast("string"))
    money = F.regexp_replace(pick("price"), r"[$,\s]", "").try_cast("double")
    out = df.select(
        F.trim(pick("description")).alias("description"), pick("sku").alias("sku"), F.coalesce(pick("qty").try_cast("double"), F.lit(1.0)).alias("qty"),
        pick("unit").alias("unit"), F.floor(money * 100 + 0.5).cast("long").alias("unit_price_cents"),
    )
    return out.where(F.length("description") >= 3)


def invoice_rows(items: DataFrame, y_gap: float = 3.0, x_gap: float = 8.0) -> DataFrame:
    """SRC06: text items (page, x, y, width, text) of a document to rows of cells: items within ``y_gap``
    make a row, and a gap of more than ``x_gap`` starts a new cell."""
    # a row's items come together once; they are few, so its cells are made within it
    by_y = W.partitionBy("doc", "page").orderBy(F.desc("y"), "x")
    r = items.withColumn("new_row", (F.lag("y").over(by_y) - F.col("y") > y_gap).cast("int"))
    r = r.withColumn("row", F.sum(F.coalesce("new_row", F.lit(0))).over(by_y))
    own = r.groupBy("doc", "page", "row").agg(F.array_sort(F.collect_list(F.struct("x", "text", "width"))).alias("i"))
    begins = F.filter(F.sequence(F.lit(0), F.size("i") - 1), lambda k: (k == 0) | (F.get(F.col("i.x"), k) - (F.get(F.col("i.x"), k - 1) + F.get(F.col("i.width"), k - 1)) > x_gap))
    own = own.withColumn("b", begins)
    cell = lambda k, n: F.array_join(F.slice(F.col("i.text"), k + 1, F.coalesce(F.get("b", n + 1), F.size("i")) - k), " ")
    return own.select("doc", "page", "row", F.transform("b", cell).alias("cells"))


def parse_invoice_rows(rows: DataFrame, line: str = "line") -> DataFrame:
    """SRC07: the last two amounts of a line are unit price and total; the quantity is the whole number of
    the line that solves unit x qty = total within 2 cents or 1 %.  The digits of the line's own code are none,
    unless that code is a bare number."""
    amounts = F.transform(F.regexp_extract_all(F.col(line), F.lit(r"\$?\s?([0-9][0-9,]*\.[0-9]{2})\b"), F.lit(1)), lambda m: F.floor(F.replace(m, F.lit(","), F.lit("")).cast("double") * 100 + 0.5).cast("long"))
    rest = F.regexp_replace(line, r"^\s*(?=[0-9]*[A-Z-])[A-Z0-9][A-Z0-9-]{3,}\b", "")
    whole = F.transform(F.regexp_extract_all(rest, F.lit(r"(?<![0-9.,])([0-9]{1,4})(?![0-9.,])"), F.lit(1)), lambda m: m.cast("long"))
    r = rows.withColumn("amounts", amounts).withColumn("whole", whole).where(F.size("amounts") >= 2)
    unit, total = F.get("amounts", F.size("amounts") - 2), F.get("amounts", F.size("amounts") - 1)
    r = r.withColumn("unit_price_cents", unit).withColumn("total_cents", total)
    fits = F.filter("whole", lambda q: F.abs(q * F.col("unit_price_cents") - F.col("total_cents")) <= F.greatest(F.lit(2.0), 0.01 * F.col("total_cents")))
    sku = F.regexp_extract(line, r"^\s*([A-Z0-9][A-Z0-9-]{3,})\b", 1)
    return r.select(*rows.columns, F.nullif(sku, F.lit("")).alias("sku"), F.get(fits, 0).alias("qty"), "unit_price_cents", "total_cents")


def sitemap_locations(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """SRC08."""
    found = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</loc>"), F.lit(1))
    return pages.select(F.explode(F.array_distinct(found)).alias("url"))


def html_meta(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC09: title, description, canonical link and the JSON-LD products of a page."""
    meta = lambda name: F.regexp_extract(html, rf"(?is)<meta[^>]+(?:name|property)=[\"']{name}[\"'][^>]+content=[\"']([^\"']*)", 1)
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return pages.withColumns({
        "title": F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), "description": F.coalesce(F.nullif(meta("description"), F.lit("")), meta("og:description")),
        "canonical": F.regexp_extract(html, r"(?is)<link[^>]+rel=[\"']canonical[\"'][^>]+href=[\"']([^\"']*)", 1), "json_ld": blocks,
    })


_PRODUCT = "struct<`@type`:string,name:string,sku:string,mpn:string,gtin:string,brand:struct<name:string>,offers:array<struct<price:string,availability:string>>>"


def json_ld_products(pages: DataFrame, blocks: str = "json_ld") -> DataFrame:
    """SRC15: products of JSON-LD blocks, ``@graph`` flattened, with the lowest positive price."""
    one = pages.withColumn("j", F.explode(blocks))
    graph = F.from_json(F.get_json_object("j", "$.@graph"), f"array<{_PRODUCT}>")
    flat = one.withColumn("p", F.explode(F.coalesce(graph, F.array(F.from_json("j", _PRODUCT))))).where(F.col("p.`@type`") == "Product")
    single = F.array(F.get_json_object("j", "$.offers.price"))
    prices = F.filter(F.transform(F.coalesce(F.col("p.offers.price"), single), lambda x: x.try_cast("double")), lambda x: x > 0)
    return flat.select(*[c for c in pages.columns if c != blocks], F.col("p.name").alias("name"), F.col("p.sku").alias("sku"), F.col("p.brand.name").alias("brand"), F.floor(F.array_min(prices) * 100 + 0.5).cast("long").alias("price_cents"))


def image_urls(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC10: image links without logos and pixels, each once, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<img[^>]+src=[\"']([^\"']+)"), F.lit(1))
    return pages.withColumn("images", F.array_distinct(F.filter(found, lambda u: ~F.lower(u).rlike(r"logo|sprite|pixel|icon|\.svg"))))


def generic_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """SRC11: the generic adapter: JSON-LD first, else the page's title and first price."""
    m = html_meta(pages, html)
    price = T.money_cents(T.strip_tags(html))
    return m.select(*pages.columns, T.strip_tags("title").alias("name"), price.alias("price_cents"), (F.size("json_ld") > 0).alias("has_json_ld"))


def shopify_products(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC12: pages of a shop's product list, a file each (or a line each), one row per variant."""
    schema = "products array<struct<id:bigint,title:string,vendor:string,product_type:string,handle:string,variants:array<struct<id:bigint,title:string,sku:string,price:string,available:boolean>>>>"
    p = spark.read.schema(schema).json(path, multiLine=not lines).select(F.explode("products").alias("p")).select("p.*", F.explode("p.variants").alias("v"))
    return p.select(
        F.col("id").alias("product_id"), "title", "vendor", "product_type", "handle", F.col("v.id").alias("variant_id"), F.col("v.title").alias("variant"), F.col("v.sku").alias("sku"),
        F.floor(F.col("v.price").try_cast("double") * 100 + 0.5).cast("long").alias("price_cents"), F.when(F.col("v.available"), "in_stock").otherwise("backordered").alias("availability"),
    )


def gudid_devices(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: one row per (GS1 identifier, model key) of device records; keys of 4 or more characters."""
    schema = "identifiers struct<identifier:array<struct<deviceId:string,deviceIdIssuingAgency:string,pkgQuantity:int>>>,brandName string,versionModelNumber string,catalogNumber string,companyName string"
    d = spark.read.format("xml").option("rowTag", "device").schema(schema).load(path)
    one = d.withColumn("i", F.explode("identifiers.identifier")).where(F.col("i.deviceIdIssuingAgency") == "GS1")
    keyed = one.withColumn("model_raw", F.explode(F.array_distinct(F.filter(F.array("versionModelNumber", "catalogNumber"), lambda x: x.isNotNull()))))
    norm = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    out = keyed.select(F.col("i.deviceId").alias("gtin"), norm(F.col("brandName")).alias("brand_norm"), norm(F.col("model_raw")).alias("model_norm"), F.col("brandName").alias("brand_name"), "model_raw", F.col("companyName").alias("company_name"), F.col("i.pkgQuantity").alias("pkg_quantity"))
    return out.where(F.length("model_norm") >= 4).dropDuplicates(["gtin", "brand_norm", "model_norm"])


def marketplace_cards(pages: DataFrame, html: str = "html", reach: int = 1800) -> DataFrame:
    """SRC14: links of search pages, one row a link: its longest text, and the first price and image within ``reach``
    characters after one of its anchors."""
    anchor = r"(?is)<a[^>]+href=[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a>"
    # the text between two anchors stands after the first of them
    parts = F.split(F.col(html), "(?i)(?=<a\\s)")
    one = pages.select(F.monotonically_increasing_id().alias("page"), F.posexplode(parts).alias("pos", "part"))
    found = one.select("page", "pos", F.regexp_extract("part", anchor, 1).alias("url"), T.strip_tags(F.regexp_extract("part", anchor, 2)).alias("title"), F.substring("part", 1, reach).alias("near"))
    found = found.withColumn("url", T.normalize_url("url")).where("url <> ''")
    price, image = T.money_cents(T.strip_tags(F.regexp_replace("near", anchor, " "))), F.nullif(F.regexp_extract("near", r"(?is)<img[^>]+src=[\"']([^\"']+)", 1), F.lit(""))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.struct("page", "pos")))
    return found.withColumns({"price": price, "image": image}).groupBy("url").agg(
        F.max_by("title", F.struct(F.length("title"), F.col("title"))).alias("title"), first(F.col("price")).alias("price_cents"), first(F.col("image")).alias("image"), F.count(F.lit(1)).alias("n_links"),
    )


def seed_queries(spark: SparkSession, path: str) -> DataFrame:
    """SRC16: one query a line; lines that start with # are comments."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> '' AND NOT startswith(query, '#')")
