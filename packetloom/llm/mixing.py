"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WEIGHTS = (5, 2, 1)
#: Most epochs of a source, and so most copies of a document.
MOST_EPOCHS = 3
#: Key ranges within a source; only the one that holds the cut is ever sorted.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    """Number of runs of characters that are no white space: positions where one begins."""
    flat = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: the share of a text that is not symbols, to the fourth power. Null or empty: 0.1."""
    length = F.length(text)
    kept = F.length(F.translate(text, "!#$%&*|<>{}[]", ""))
    return F.when(F.coalesce(length, F.lit(0)) == 0, 0.1).otherwise(F.greatest(F.lit(0.1), F.pow(kept / length, F.lit(4.0))))


def uniform(doc_id: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of an MD5 sum: the same on every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (bits + 0.5) / float(1 << 52)


def indexed(df: DataFrame, column: str) -> DataFrame:
    """df, one row a value, with ``place``: the value's 0-based place in code point order, nulls last. Sorted in ranges; only one count a range meets."""
    ranged = written(df.repartitionByRange(F.col(column).isNull(), F.col(column)).sortWithinPartitions(F.col(column).isNull(), column).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()), "sources")
    parts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    return ranged.join(parts, "_part").withColumn("place", F.col("_id") - F.col("_first") + F.coalesce("_before", F.lit(0))).drop("_part", "_id", "_n", "_first", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size) with ``weight`` and ``target``: shares of the sum of all sizes by weight, none above most times its size; the excess goes to the others by weight.

    The level is found by repeated sums over the sources, of which only one row comes to the driver."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    own = written(indexed(sources, "source").withColumn("weight", weight).drop("place"), "weights")
    level = 0.0
    full = F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight")
    before = -1
    while True:
        row = own.agg(F.sum("source_size"), F.sum(F.when(full, F.lit(most) * F.col("source_size"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if row[3] == before or not row[2]:
            break
        before, level = row[3], ((row[0] or 0) - (row[1] or 0)) / row[2]
        full = F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight")
    target = F.when(full, (F.lit(most) * F.col("source_size")).cast("double")).otherwise(F.lit(float(level)) * F.col("weight"))
    return own.withColumn("target", target)


def mix(docs: DataFrame, size: Column, quality: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies of every document.

    A source's target is first filled with complete epochs. What remains is filled in the order of exponential keys -ln(u) / quality:
    a document is taken once more while its middle lies within the remainder. The key space is cut in ranges whose sizes are summed; only
    the range in which the cut falls is sorted, so a hot source never meets in one task. u depends on seed and doc_id alone: reruns agree.
    Null source is a source of its own, the last; null doc_ids tie, and rows that tie are taken together; empty documents have size 0 and take nothing."""
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.col("_q")
    slim = docs.select("doc_id", "source", size.alias("size"), quality.alias("_q")).withColumn("key", key)
    bucket = F.floor(F.col("key") / (F.col("key") + 1) * BUCKETS).cast("int")
    slim = written(slim.select("doc_id", "source", "size", "key", bucket.alias("bucket")), "keys")
    sums = written(slim.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "ranges")
    goal = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = written(goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - epochs * F.col("source_size")), "goals")
    g = goal.select(F.col("source").alias("_s"), "rest")
    by_range = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = sums.join(g, F.col("source").eqNullSafe(F.col("_s"))).withColumn("upto", F.sum("size").over(by_range))
    cut = cut.where((F.col("upto") > F.col("rest")) & (F.col("size") > 0)).groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "rest"), "bucket").alias("c"))
    cut = written(cut.select(F.col("source").alias("_s"), "c.*"), "cuts")
    inside = slim.alias("d").join(cut.alias("c"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("d.bucket") == F.col("c.bucket"))).select("source", "size", "doc_id", "key", "before", "rest")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).where(F.col("before") + F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id"))).alias("last"))
    cut, last = cut.withColumnRenamed("bucket", "cut_bucket"), last.withColumnRenamed("source", "_l")
    plan = goal.drop("rest").join(cut.drop("rest", "before"), F.col("source").eqNullSafe(F.col("_s")), "left").join(last, F.col("source").eqNullSafe(F.col("_l")), "left").drop("_s", "_l")
    plan = written(plan.withColumnRenamed("source", "_s"), "plan")
    more = F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket"))
    more |= (F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id")) <= F.col("last"), F.lit(False))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(F.col("epochs") + F.when((F.col("epochs") < most) & more, 1).otherwise(0), F.lit(most))).cast("long")
    out = slim.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op1_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(docs, n_words(F.col("text")), quality_weight(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0.1::DOUBLE ELSE greatest(0.1::DOUBLE, pow(length(translate(text, '!#$%&*|<>{}[]', ''))::DOUBLE / length(text), 4)) END AS q,
    (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER ()::BIGINT AS t, coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS capped, sum(w) OVER ()::BIGINT - coalesce(sum(w) OVER o, 0)::BIGINT AS left_w, count(*) OVER o AS k FROM s
      WINDOW o AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min((t - capped)::DOUBLE / left_w, k) AS level FROM r WHERE 3 * source_size > (t - capped)::DOUBLE / left_w * w),
g AS (SELECT source, source_size, CASE WHEN 3 * source_size <= level * w THEN (3 * source_size)::DOUBLE ELSE level * w END AS target FROM s, lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
k AS (SELECT d.doc_id, d.size, e.*, sum(size) OVER (PARTITION BY e.source ORDER BY -ln(u) / q, d.doc_id)::BIGINT AS upto FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * least(3, epochs + CASE WHEN epochs < 3 AND upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""
