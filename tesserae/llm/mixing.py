"""Mixing sources to target weights by hash order and distributed prefix sums.

Every document gets a random key, the MD5 of its doc_id. Equal ranges of that key
are buckets; a source's buckets in key order, and the documents in a bucket in key
order, are a range sort of the source whatever its share of the rows. Sizes are
summed per (source, bucket) and those sums are prefix-summed per source, which finds
the bucket in which a source's budget ends. Only in that bucket, whose rows are few,
are documents moved and summed one by one; all others are taken whole or not by
their bucket's number. A source's budget is spent in whole epochs, then up to the
exact word in key order. Sizes are counted once and stored in the shared folder.

Weights go by the order of the sources (code point, null last). Targets share the
total by weight, stop at `most` times the source's size, and the excess is shared
again by weight; that fixed point comes from one pass over the sources ordered by
size / weight.

Defined results: null text has size 0 and takes 0; a source without words has
target 0. Repeated rows (equal doc_id, size) are ordered by no more than that and
take what the two places in order give. Null doc_id sorts as the empty text's MD5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import stored, work_dir

WEIGHTS = (5.0, 2.0, 1.0)
ROWS_PER_BUCKET = 20_000
MOST_BROADCAST = 100_000  # sources, of 64 bytes a name on average
SALTS = 64
_DIGITS = 8  # hex digits of the key that number its bucket: up to 2**32 buckets


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, target from one row a source with columns source, source_size."""
    ordered = by_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cases = reduce(lambda c, kw: c.when(F.col("_rank") % len(weights) == kw[0], F.lit(float(kw[1]))), enumerate(weights), F)
    weighed = ordered.withColumn("_w", cases).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    line = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_rank"))
    everything = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, onward = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    # the first source in this order whose cap is not reached fixes the words per unit of weight
    found = weighed.withColumn("_level", level).withColumn(
        "_level", F.first(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")), ignorenulls=True).over(everything)
    )
    return found.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")).alias("target"))


def _sized(docs: DataFrame, keep: list[Column]) -> DataFrame:
    return docs.select(*keep, "doc_id", "source", word_count(F.col("text")).alias("size"))


def _dealt(sized: DataFrame, buckets: int) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    number = F.floor(F.conv(F.substring("_key", 1, _DIGITS), 16, 10).cast("long") * F.lit(buckets) / F.lit(16**_DIGITS)).cast("long")
    return sized.withColumn("_key", key).withColumn("_bucket", number)


def _cuts(dealt: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """A row for each source: its size, target, whole epochs, the bucket its budget ends in (null without words) and the words left for it."""
    sums = dealt.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").cast("long").alias("source_size")), weights, most).withColumnRenamed("source", "_s")
    run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.round(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    line = sums.withColumn("_end", F.sum("_sum").over(run)).join(targets, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_epochs", epochs)
    rest = budget - F.col("_epochs") * F.col("source_size")
    reached = F.col("_end") > rest  # ends never fall, so the first bucket beyond the rest has the least values of all beyond
    return line.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("_epochs").alias("_epochs"),
        F.min(F.when(reached, F.col("_bucket"))).alias("_cut"),
        F.min_by(rest - F.col("_end") + F.col("_sum"), F.when(reached, F.col("_bucket"))).alias("_left"),
    ).withColumnRenamed("source", "_s")


def _taken(docs: DataFrame, keep: list[Column], weights: tuple[float, ...], most: float, rows_per_bucket: int) -> DataFrame:
    """`keep`, doc_id, source, size, source_size, target, taken: only rows of the buckets in which a budget ends are moved."""
    spark = docs.sparkSession
    light = stored(_sized(docs, []), work_dir(spark, "mix-sizes"))
    # the number of buckets follows the number of rows, so that a bucket's rows stay few
    buckets = max(1, -(-light.count() // rows_per_bucket))
    cuts = stored(_cuts(_dealt(light, buckets), weights, most), work_dir(spark, "mix-cuts"))
    dealt = _dealt(_sized(docs, keep) if keep else light, buckets)
    n, name_bytes = cuts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_s")), F.lit(0))).first()
    if n <= MOST_BROADCAST and name_bytes <= 64 * MOST_BROADCAST:
        placed = dealt.join(F.broadcast(cuts), F.col("source").eqNullSafe(F.col("_s")))
    else:  # many sources: joined by source and a salt from the key, so that a hot source is split
        salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.conv(F.substring("_key", 17, 4), 16, 10).cast("int") % SALTS
        placed = dealt.withColumn("_of", salt).join(salted, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_of") == F.col("_salt"))).drop("_of", "_salt")
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = placed.filter(F.col("_bucket") == F.col("_cut")).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at_cut = at_cut.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_before")))).drop("_before")
    whole = placed.filter(~F.col("_bucket").eqNullSafe(F.col("_cut"))).withColumn("_part", F.when(F.col("_bucket") < F.col("_cut"), F.col("size")).otherwise(0))
    return whole.unionByName(at_cut).withColumn("taken", (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs."""
    return _taken(docs, [], weights, most, rows_per_bucket).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Whole rows of docs, each as often as the mix takes it; of a document taken in part, the part counts from half.

    Documents without words take no budget and stay once.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    took = _taken(docs, [row], weights, most, rows_per_bucket)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(1).cast("int")
    return took.select("_row", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT l.source, l.source_size, least(l.cap, coalesce((SELECT x.lv FROM l x WHERE x.lv * x.w <= x.cap ORDER BY x.cap / x.w, x.r LIMIT 1), 0) * l.w) AS target FROM l),
p AS (SELECT d.doc_id, d.source, d.k, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
"""
ORACLE_SQL = ORACLE + r"""
SELECT doc_id, size, source_size, target,
    (CASE WHEN source_size > 0 THEN (budget // source_size) * size + greatest(0, least(size, budget % source_size - b)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
