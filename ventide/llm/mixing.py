"""Mixing sources to target weights.

Sizes are added up per source, targets follow from the weights, and a source's repetition rate is
its target over its size. Each document is emitted floor(rate) times, plus once more if a number
drawn from a hash of its key is below the fraction. Columns only: no Python runs in tasks.

A hot source is no concern: sums are partial sums first, and the one-row-per-source table is
joined by its measured size (Spark broadcasts it below its threshold and splits a skewed join
above it). Draws depend on key and seed alone, so that a rerun, a retried task or another
partitioning takes the same documents.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a source
of size 0 gets target 0, rate 0 and no copies; repeated rows are counted and drawn as often as
they occur, with one draw for the same key; a null key draws as the text 'null'; an empty table
gives an empty result. Columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ventide.llm.tables import stored, word_count

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
MOST = 3
ADDED = ("size", "source_size", "target", "rate", "copies")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the seed and the key."""
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def shares(sized: DataFrame, source: str, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source_size, target and rate.

    Weights go round over the sources in code-point order. Targets share the total of all sizes
    and stop at `most` times a source's size; what is over goes to the others by weight. That is
    the level at which min(cap, level x weight) adds up to the total, found by ordering the sources
    by cap over weight: the first whose cap is above the level of those that are left. From there
    on levels only fall, so it is the largest level that is not above its own source's ratio.
    """
    total = sized.groupBy(F.col(source).alias("_source")).agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(everything.orderBy(F.col("_source").asc_nulls_last())) - 1
    by_ratio = everything.orderBy("_ratio", "_place")
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return (
        total.withColumn("_place", place)
        .withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)),
                                            (F.col("_place") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", (F.sum("source_size").over(everything) - before) / left)
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(everything))
        .select(
            "_source", "source_size",
            F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")).alias("target"),
        )
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                    .otherwise(F.lit(0.0)))
    )


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", size: Column | None = None,
        weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents with size, source_size, target and rate of their source, and their copies.

    `size` defaults to the number of words of the column `text`.
    """
    size = word_count(F.col("text")) if size is None else size
    sized = docs.select(F.col(source), size.alias("size"))
    known = stored(shares(sized, source, weights, most), "mix-shares")
    base = docs.withColumn("size", size).drop("source_size", "target", "rate", "copies", "_source")
    whole = F.floor("rate")
    return (
        base.join(known, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("copies", (whole + (draw(F.col(key), seed) < F.col("rate") - whole).cast("long")).cast("int"))
    )


def emit(mixed: DataFrame, copy: str = "copy") -> DataFrame:
    """Every document as often as it is taken, numbered from 1 in `copy`."""
    return mixed.where("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies"))))


#: The same rules in another engine's SQL.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM src),
open AS (  -- a source is at its cap if the level of those with no smaller ratio is above its own
  SELECT a.source, a.source_size, a.w,
    (SELECT sum(b.source_size) FROM ranked b)
      - (SELECT coalesce(sum(3 * b.source_size), 0) FROM ranked b
         WHERE 3 * b.source_size / b.w < 3 * a.source_size / a.w) AS rest,
    (SELECT sum(b.w) FROM ranked b WHERE 3 * b.source_size / b.w >= 3 * a.source_size / a.w) AS weight
  FROM ranked a),
lvl AS (SELECT max(rest::DOUBLE / weight) AS level FROM open
          WHERE rest::DOUBLE / weight <= 3 * source_size::DOUBLE / w),
targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, level * w) AS target FROM open, lvl),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT d.doc_id, d.size, r.source_size, r.target,
  d.size * (floor(r.rate)
    + CASE WHEN ('0x' || md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null'))[1:13])::BIGINT / pow(2.0, 52)
           < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
"""
