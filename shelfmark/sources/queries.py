"""Source operators over the page table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import readers as R


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")


def src09_html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.html_meta(_pages(spark, sf_dir)).select("page_id", "title", "description", "canonical")


def src10_image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.image_urls(_pages(spark, sf_dir)).selectExpr("page_id", "size(images) AS n_images")


def src11_generic_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.generic_products(_pages(spark, sf_dir)).drop("html")


QUERIES = {f.__name__: f for f in (src09_html_meta, src10_image_urls, src11_generic_products)}
ORACLES = {"src10_image_urls": "SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, '<img[^>]+src=[\"'']([^\"'']+)', 1), lambda u: NOT regexp_matches(lower(u), 'logo|sprite|pixel|icon|[.]svg')))) AS n_images FROM pages"}
