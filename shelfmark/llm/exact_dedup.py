"""Exact dedup with a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after deleting space and U+0009 to U+000D.  A batch is reduced
to one entry per digest (map-side combined), a sort-merge anti-join leaves the entries the
index lacks, and those are appended to it.  Every row then learns its group from the index.

Only small rows are shuffled: (id, length, 32-byte digest), and of the index nothing is: it is read in its
buckets and meets the batch's digests there.  A digest with a third of all rows is combined before the
shuffle, and the join that hands the entries back has plain exchanges on both sides, so adaptive
execution splits such a digest.

Cases with a defined result
    null text: counts as empty; all empty and blank texts are one group
    equal texts of equal length: the smallest id stays
    null id: sorts after every other id; rows that repeat an id are one document, with one verdict
    very long text: digested whole; extra columns, whatever their names, are not read
    empty table: an empty result, and the index stays as it is
    a digest the index already has: its old keeper stays, whatever the new texts' lengths, and its group
        size is that of the batch that brought it
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BLANKS, Scratch, positional

#: Buckets of a new index, unless spark.shelfmark.index.buckets names another number: about one a GB of entries.
N_BUCKETS = 64
ENTRY = "digest binary, keep_id long, keep_chars long, group_size long"


def normalised(text) -> F.Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_code_points, digest) of every row."""
    text = docs[text_col]
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"),
        F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
    )


class DigestIndex:
    """A table of digests at ``path``, bucketed and sorted by digest; made when it is missing.  Files of an earlier
    session are taken up when ``buckets`` is the number that they were written with."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets = buckets or int(spark.conf.get("spark.shelfmark.index.buckets", str(N_BUCKETS)))
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            columns = ENTRY.split(", ")
            spark.sql(
                f"CREATE TABLE {self.name} ({', '.join(columns)}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, rows: DataFrame, scratch: Scratch) -> DataFrame:
        """Add one entry per digest of ``rows`` that the index lacks, and give the digests of ``rows``.

        The entries are written before the anti-join: the optimizer would else move the join below the
        aggregate, and every row of a hot digest would be shuffled."""
        best = F.max(F.struct(F.col("n"), (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("negative_id"), F.col("doc_id"))).alias("best")
        groups = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))
        batch = scratch.cut(groups.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.n").alias("keep_chars"), "group_size"), "batch")
        new = batch.join(self.entries().hint("merge"), "digest", "left_anti")
        new.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", self.path).saveAsTable(self.name)
        return batch.select("digest")

    def look_up(self, rows: DataFrame, digests: DataFrame, scratch: Scratch) -> DataFrame:
        """Each row with its entry.  The batch's distinct ``digests`` meet the index in its buckets; what is found is
        written, so that the join with the rows has an exchange on either side and can split a digest that many
        rows share."""
        found = scratch.cut(self.entries().hint("merge").join(digests, "digest", "left_semi"), "found")
        return rows.join(found, "digest")

    def forget(self) -> None:
        """Drop the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "exact-dedup")
    own = index or DigestIndex(spark, scratch.path("index"))
    rows = scratch.cut(digests(docs), "digests")
    found = own.look_up(rows, own.append_new(rows, scratch), scratch)
    if index is None:  # what was found is written, so an index of this batch alone has served
        own.forget()
        scratch.drop(own.path)
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns; a repeated row stays once for each time it occurs."""
    kept = deduplicate(docs).where("kept").select(F.col("doc_id").alias("_keep"), F.unhex("text_sha256").alias("_digest")).distinct()
    # the digest is part of the key, so rows that share an id but not a text are told apart
    rows, at, back = positional(docs)
    probe = rows.withColumn("_d", F.unhex(F.sha2(normalised(F.col(at["text"])), 256)))
    on = F.col("_d").eqNullSafe(F.col("_digest")) & F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_keep"))
    return back(probe.join(kept, on, "left_semi"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
