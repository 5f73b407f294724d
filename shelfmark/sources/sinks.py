"""Sinks: append, replace, upsert, join-update, ordered refresh, CSV and JSON reports."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..streaming.store import Published, Run


def append(df: DataFrame, path: str) -> None:
    """SNK01."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """SNK02: written beside the old rows, which ``current`` reads until the new ones are published; an empty ``df`` is a
    table like any other.  The rows before stay for readers that have begun; older ones are deleted."""
    publish(df.sparkSession, {"rows": df}, path)


def current(spark: SparkSession, path: str, table: str = "rows") -> DataFrame:
    """SNK02: the rows that ``replace`` (or, of a ``table``, ``publish``) made public last."""
    return Published(spark, path).read(table)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> None:
    """Replace several tables below ``root`` at once; tables that are not named stay as they are."""
    store = Published(spark, root)
    number, known = store.manifest()
    store.publish(number + 1, known | {name: [store.stage(df, name, number + 1)] for name, df in tables.items()})


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """SNK03: incoming rows, one a key (the first by ``order``, else by all columns), and the existing ones whose key they
    do not have.  Null keys are equal."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*(order or incoming.columns)))
    new = incoming.withColumn("_rn", first).where("_rn = 1").drop("_rn")
    named = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return existing.join(named, on, "left_anti").unionByName(new)


def update_from(existing: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """SNK04: the named columns taken from ``values`` where it has the key."""
    right = values.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = existing.join(right, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def refresh(spark: SparkSession, models: dict[str, tuple[list[str], Callable[[SparkSession], DataFrame]]], root: str) -> list[str]:
    """SNK05: build read models (name -> names it reads, builder), each after those it reads, which it finds as views.
    All are made public at once, when the last one is written; if one fails, the models before stay public and the
    views go back to them.  Gives the order; a circle is an error."""
    order = list(TopologicalSorter({name: [r for r in reads if r in models] for name, (reads, _) in models.items()}).static_order())
    store = Published(spark, root)
    number, known = store.manifest()
    built: dict[str, list[Run]] = {}
    try:
        for name in order:
            built[name] = [store.stage(models[name][1](spark), name, number + 1)]
            store.rows(name, built[name]).createOrReplaceTempView(name)
        store.publish(number + 1, known | built)
    except Exception:
        for name in built:
            if name in known:
                store.rows(name, known[name]).createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)
        raise
    return order


def commit_matches(spark: SparkSession, root: str, matches: DataFrame, canonicals: DataFrame) -> None:
    """ER17: put a matching run's ``matches`` (listing_id, canonical_id, status, confidence) and ``canonicals``
    (canonical_id, name) in place of those of the run before, in the tables match, canonical and alias below ``root``.

    Rows with origin "auto" are reset.  Rows set by hand (any other origin) stay, and a listing that has one gets no
    other.  A product that is gone becomes an alias of the one that most of its listings went to (the least id wins
    ties); earlier aliases of it follow.  The three tables appear at once."""
    store = Published(spark, root)
    number, known = store.manifest()
    auto = F.lit("auto").alias("origin")
    match, canonical = matches.select("listing_id", "canonical_id", "status", "confidence", auto), canonicals.select("canonical_id", "name", auto)
    alias = spark.createDataFrame([], "old_id string, canonical_id string")
    if known:
        before, products, aliases = (store.rows(t, known[t]) for t in ("match", "canonical", "alias"))
        by_hand = before.where("origin <> 'auto'")
        match = by_hand.unionByName(match.join(by_hand.select("listing_id"), "listing_id", "left_anti"))
        canonical = products.where("origin <> 'auto'").unionByName(canonical.join(products.where("origin <> 'auto'").select("canonical_id"), "canonical_id", "left_anti"))
        gone = products.select(F.col("canonical_id").alias("old_id")).join(canonical.select(F.col("canonical_id").alias("old_id")), "old_id", "left_anti")
        moved = before.select("listing_id", F.col("canonical_id").alias("old_id")).join(gone, "old_id").join(match.select("listing_id", "canonical_id"), "listing_id")
        votes = moved.groupBy("old_id", "canonical_id").agg(F.count(F.lit(1)).alias("n"))
        new = votes.groupBy("old_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "canonical_id")).alias("s")).select("old_id", "s.canonical_id")
        follow = aliases.join(new.select(F.col("old_id").alias("canonical_id"), F.col("canonical_id").alias("to")), "canonical_id", "left").select("old_id", F.coalesce("to", "canonical_id").alias("canonical_id"))
        every = follow.join(new.select("old_id"), "old_id", "left_anti").unionByName(new)
        # an alias leads to a product that is there, and is none itself
        alias = every.join(canonical.select("canonical_id"), "canonical_id", "left_semi").join(canonical.select(F.col("canonical_id").alias("old_id")), "old_id", "left_anti").select("old_id", "canonical_id")
    publish(spark, {"match": match, "canonical": canonical, "alias": alias}, root)


def csv_report(df: DataFrame, path: str) -> None:
    """SNK06."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def json_report(df: DataFrame, path: str) -> None:
    """SNK07."""
    df.write.mode("overwrite").json(path)


def html_report(df: DataFrame, path: str, title: str) -> None:
    """SNK07: a page a part of the result, each whole in itself: the title, a row of headings and the rows, escaped.  Rows
    are written where they are."""
    def escaped(c: Column) -> Column:
        for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
            c = F.replace(c, F.lit(char), F.lit(f"&{name};"))
        return c

    line = lambda tag, cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), escaped(c), F.lit(f"</{tag}>")) for c in cells], F.lit("</tr>"))
    head = F.concat(F.lit("<!doctype html><meta charset='utf-8'><title>"), escaped(F.lit(title)), F.lit("</title><h1>"), escaped(F.lit(title)), F.lit("</h1><table>"), line("th", [F.lit(c) for c in df.columns]))
    rows = df.select(line("td", [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"), F.spark_partition_id().alias("part"))
    # a page's rows are one text; parts are bounded by the readers' splits
    pages = rows.groupBy("part").agg(F.array_join(F.collect_list("value"), "\n").alias("value"))
    pages.select(F.concat(head, F.lit("\n"), "value", F.lit("\n</table>")).alias("value")).write.mode("overwrite").text(path)


def ranked_candidates(df: DataFrame, group: str, order: list) -> DataFrame:
    """SNK08: candidates with a rank from 1."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))
