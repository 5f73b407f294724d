"""Mixing sources to target weights by pivotal dependent rounding.

A document's fractional copy number is its source's target over its source's size.  The whole
part is taken outright.  The fractional parts of a source are settled in pairs: one document
receives words from the other until one of the two is integral, the direction being drawn so that
both keep their expectation, and the words of the pair are kept.  Pairs are folded within blocks of
about FAN_IN documents; each block leaves one undecided document, and these residuals meet in
blocks again until every source has one left, which is drawn by its fraction.

That last draw misses the target by a document at most, up or down, so that the words expected are
the target and each document's expected copies are its fraction.  A block takes its documents from the
longest to the shortest: a long one that is undecided is settled by the words of the shorter ones after
it, so what a block leaves, and what is drawn in the end, is short as a rule.  The miss is then made
good by documents drawn by lot, DRAWN of each source at most: each that brings the source nearer to its
target goes down by the copy that rounding gave it, or up by the one that it kept back.  The last draw
goes up by ``1 - p`` of its words with probability ``p`` and down by ``p`` of them otherwise, so a document is
drawn to go down as often as to go up, and its expected copies stay its fraction.

Rows that agree in every column are one unit of m rows.  Settled among themselves they take the
whole part of their m fractions between them, and one row stays for the pairs above; so different
rows of a unit may take different copies.  Random numbers are hashes of the rows and SEED, so reruns
agree on any cluster.

Cases with a defined result
    null text or no words: size 0, taken 0; very long text: one document like any other, never cut
    null source: a source of its own, after all others
    repeated rows: one unit, see above; one result row each
    rows that share an id but differ otherwise: documents of their own
    ties in a document's hash: broken by its other fields
    null id: like any other id; extra columns, whatever their names, are kept by ``apply_mix``
    empty table: an empty result
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, Scratch, positional

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
#: Undecided documents of a block, on average.
FAN_IN = 48
SEED = 20_240_607
#: Documents of a source that may make good what the last draw of it misses.
DRAWN = 64
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _row_hash(docs: DataFrame) -> F.Column:
    """A hash of all columns; maps, which have none, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(docs[f.name])) if "map<" in f.dataType.simpleString() else docs[f.name] for f in docs.schema.fields], F.lit(SEED))


def units(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, g, m): rows that agree in all columns, their hash and their number."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), _row_hash(docs).alias("g"))
    return rows.groupBy("doc_id", "source", "size", "g").agg(F.count(F.lit(1)).alias("m"))


def running(df: DataFrame, order: list[F.Column], sums: dict[str, F.Column], scratch: Scratch) -> DataFrame:
    """``df`` with, for each of ``sums``, the sum over all rows before in ``order``.  Rows are partitioned by
    range; only one row a partition is brought together."""
    parts = scratch.cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    each = parts.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    upto = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as partitions
    start = each.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(f"_{n}") for n in sums])
    before = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = parts.join(F.broadcast(start), F.col("_part") == F.col("_p"))
    return out.select(*df.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(n) for n, c in sums.items()])


def targets(rows: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n, target): one row per source.

    All words are shared by weight; a source stops at ``max_copies`` times its size and the excess
    is shared anew.  The level at which that ends is found from running sums over the sources in
    order of cap per weight: that of the first source whose cap it does not pass.
    """
    total = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    named = running(total, [F.asc_nulls_last("source")], {"place": F.lit(1)}, scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int")).cast("double")
    named = named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_copies))).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = scratch.cut(running(named, [F.col("ratio"), F.asc_nulls_last("source")], {"capped": F.col("cap"), "gone": F.col("weight")}, scratch), "ranked")
    words, weighed = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    # the level if exactly the sources before this one are at their caps
    level = (F.lit(float(words or 0)) - F.col("capped")) / (F.lit(weighed or 1.0) - F.col("gone"))
    # "gone" grows with the order, so its least value is the first source that stays below its cap
    free = F.lit(ranked.withColumn("level", level).where("level <= ratio").agg(F.min(F.struct("gone", "level"))["level"]).first()[0])
    return ranked.select("source", "source_size", "n", F.when(F.col("ratio") <= free, F.col("cap")).otherwise(free * F.col("weight")).alias("target"))


#: One step of a block's fold: ``a.c`` is the undecided document, ``x`` the next one.
#: Words that c can still take or give, and x likewise, bound what may move either way.
_FOLD = """
aggregate(list, named_struct('c', CAST(NULL AS {unit}), 'done', CAST(array() AS array<{unit}>)), (a, x) ->
  CASE WHEN a.c IS NULL THEN named_struct('c', x, 'done', a.done)
       WHEN a.c.p <= 0 OR a.c.p >= 1 THEN named_struct('c', x, 'done', concat(a.done, array(a.c)))
  ELSE element_at(transform(array(named_struct(
         'up', least((1 - a.c.p) * a.c.w, x.p * x.w), 'down', least(a.c.p * a.c.w, (1 - x.p) * x.w),
         'r', pmod(xxhash64(a.c.h, x.h, {seed}L), 9007199254740992) / 9007199254740992D)), t ->
    element_at(transform(array(CASE
      WHEN t.r * (t.up + t.down) < t.down THEN
        CASE WHEN (1 - a.c.p) * a.c.w <= x.p * x.w
          THEN named_struct('pc', 1D, 'px', x.p - (1 - a.c.p) * a.c.w / x.w) ELSE named_struct('pc', a.c.p + x.p * x.w / a.c.w, 'px', 0D) END
      ELSE
        CASE WHEN a.c.p * a.c.w <= (1 - x.p) * x.w
          THEN named_struct('pc', 0D, 'px', x.p + a.c.p * a.c.w / x.w) ELSE named_struct('pc', a.c.p - (1 - x.p) * x.w / a.c.w, 'px', 1D) END
      END), q -> CASE
        WHEN q.pc <= 0 OR q.pc >= 1 THEN named_struct(
          'c', named_struct({keep_x}, 'p', q.px), 'done', concat(a.done, array(named_struct({keep_c}, 'p', q.pc))))
        ELSE named_struct(
          'c', named_struct({keep_c}, 'p', q.pc), 'done', concat(a.done, array(named_struct({keep_x}, 'p', q.px)))) END), 1)), 1)
  END)
"""


def _round_once(pending: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: each (source, block) settles all its documents but one."""
    fields = [f for f in pending.schema.fields if f.name in ("h", "w", "doc_id", "size", "g", "m", "whole", "source_size", "target")]
    unit = "struct<" + ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in fields) + ", p: double>"
    keep = {v: ", ".join(f"'{f.name}', {v}.{f.name}" for f in fields) for v in ("a.c", "x")}
    fold = _FOLD.format(unit=unit, seed=seed, keep_x=keep["x"], keep_c=keep["a.c"])
    block = F.pmod(F.xxhash64("h", F.lit(seed)), F.col("blocks")).alias("block")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("by"), F.struct(*[f.name for f in fields], "p").alias("d"))))
    lists = pending.groupBy("source", "blocks", block).agg(F.transform(ordered, lambda x: x["d"]).alias("list"))
    folded = lists.selectExpr("source", "blocks", f"{fold} AS r")
    return folded.selectExpr("source", "blocks", "explode(concat(transform(r.done, d -> struct(d AS d, true AS settled)), array(struct(r.c AS d, false AS settled)))) AS e").select(
        "source", "blocks", "e.d.*", (F.col("e.settled") | (F.col("e.d.p") <= 0) | (F.col("e.d.p") >= 1)).alias("settled")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per unit: doc_id, source, size, g, m, source_size, target, copies (of its m rows together)."""
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    rows = scratch.cut(units(docs, id_col, source_col, text_col), "units")
    shares = scratch.cut(targets(rows, scratch), "targets")
    n_sources, most = shares.agg(F.count(F.lit(1)), F.max("n")).first()
    right = shares.withColumnRenamed("source", "_source")
    if n_sources <= MAX_BROADCAST_SOURCES:
        right = F.broadcast(right)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    all_rows = (
        rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("f", F.when(F.col("size") > 0, copies * F.col("m")).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("f").cast("long"))
        .withColumn("p", F.col("f") - F.floor("f"))
        .withColumn("h", F.xxhash64("doc_id", "source", "size", "g", F.lit(SEED)))
        .withColumn("w", F.col("size").cast("double"))
    )
    names = ["doc_id", "source", "size", "g", "m", "source_size", "target"]
    whole = all_rows.where("p = 0").select(*names, F.col("whole").alias("copies"))
    pending = all_rows.where("p > 0").select(
        "source", F.ceil(F.col("n") / F.lit(FAN_IN)).cast("long").alias("blocks"), "h", "w", "doc_id", "size", "g", "m", "whole", "source_size", "target", "p"
    )
    settled = [whole]
    taken = (F.col("whole") + F.floor(F.col("p") + F.lit(0.5))).cast("long").alias("copies")
    blocks, level = -(-(most or 0) // FAN_IN), 0
    while True:
        level += 1
        folded = scratch.cut(_round_once(pending, SEED + level), "level")
        settled.append(folded.where("settled").select(*names, taken))
        pending = folded.where("not settled").drop("settled").withColumn("blocks", F.ceil(F.col("blocks") / F.lit(FAN_IN)).cast("long"))
        if blocks <= 1:
            break
        blocks = -(-blocks // FAN_IN)
    # one document of each source: up with the probability of its fraction
    drawn = F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    settled.append(pending.select(*names, (F.col("whole") + (drawn < F.col("p")).cast("long")).alias("copies")))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return _made_good(scratch.cut(out, "settled"), n_sources * DRAWN <= MAX_BROADCAST_SOURCES)


def _made_good(rows: DataFrame, small: bool) -> DataFrame:
    """``rows`` with the copies of some drawn documents changed by one, each source against what it misses."""
    hint = F.broadcast if small else (lambda df: df)
    gaps = rows.groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) - F.max("target")).alias("gap")).withColumnRenamed("source", "_source")
    exact = F.col("m") * F.col("target") / F.col("source_size")
    may = F.when(F.col("gap") > 0, F.col("copies") > F.floor(exact)).otherwise((F.col("copies") <= F.floor(exact)) & (exact > F.floor(exact)))
    could = rows.where("size > 0").join(hint(gaps), F.col("source").eqNullSafe(F.col("_source"))).where(may & (F.col("size") <= F.abs("gap")))
    lot = F.row_number().over(W.partitionBy("source").orderBy(F.xxhash64("g", F.lit(SEED + 1)), "g", "doc_id", "size"))
    lots = could.withColumn("lot", lot).where(F.col("lot") <= DRAWN)
    lots = lots.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct("lot", "doc_id", "size", "g"))).alias("l"))
    taken = """aggregate(l, named_struct('rest', abs(gap), 'out', slice(l, 1, 0)), (a, x) ->
      IF(x.size <= a.rest, named_struct('rest', a.rest - x.size, 'out', concat(a.out, array(x))), a)).out"""
    moves = lots.select(F.col("source").alias("_s"), F.when(F.col("gap") > 0, -1).otherwise(1).alias("by"), F.explode(F.expr(taken)).alias("d"))
    moves = moves.select("_s", "by", F.col("d.doc_id").alias("_d"), F.col("d.size").alias("_z"), F.col("d.g").alias("_g"))
    on = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z")) & (F.col("g") == F.col("_g"))
    return rows.join(hint(moves), on, "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).select(*rows.columns)


#: Rows that a unit is written out in at a time.
_RUN = 1000


def _spread(units_: DataFrame, count: F.Column, name: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0 in ``name``; long runs are cut and shuffled first, so one row is
    never written out by one task alone."""
    if not units_.where(count > _RUN).isEmpty():
        starts = units_.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / F.lit(_RUN)))) * F.lit(_RUN))
        units_ = starts.repartition(F.col("_from"), *[F.col(c) for c in units_.columns if c in ("_g", "g")])
        return units_.withColumn(name, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + F.lit(_RUN), count) - 1))).drop("_from")
    return units_.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = _spread(mix(docs), F.col("m"), "_row")
    # the copies of a unit are spread evenly over its rows
    rows = rows.withColumn("copies", F.floor(F.col("copies") / F.col("m")) + (F.col("_row") < F.col("copies") % F.col("m")).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with its own columns."""
    scratch = Scratch(docs.sparkSession, "mixing")
    plan = scratch.cut(mix(docs, scratch=scratch).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("g").alias("_g"), "m", F.col("copies").alias("_copies")), "plan")
    rows, at, back = positional(docs)
    rows = rows.withColumn("_h", _row_hash(rows))
    on = F.col(at["doc_id"]).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g"))
    single, many = plan.where("m = 1"), plan.where("m > 1")
    out = rows.join(single, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*at.values())
    if not many.isEmpty():  # equal rows: one of them, as often as all are taken
        one = rows.join(many, on).dropDuplicates(["_id", "_g"])
        out = out.unionByName(_spread(one, F.col("_copies"), "_copy").select(*at.values()))
    return back(out)
