"""Joins and merges of genomic intervals, closed at both ends, planned as equi-joins on bins.

Catalyst has no range join: a bare overlap predicate is a Cartesian product, and one with an equal chromosome compares
all pairs of a chromosome. Here both sides are exploded to the bins they touch, joined on (chr, bin), and a pair is
kept only in the first bin that both touch. Choose a bin about as wide as a typical interval with its slack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, chr_l: str, lo: Column, hi: Column, chr_r: str, start: Column, end: Column, bin_size: int, how: str = "inner") -> DataFrame:
    """Pairs with equal chromosome and start <= hi and lo <= end. Columns of both sides must have different names.

    ``left_semi`` and ``left_anti`` keep each row of ``left`` as often as it comes, whatever its other columns hold; rows
    without a chromosome or a bound have no partner.
    """
    if how in ("left_semi", "left_anti"):  # whether a row has a partner depends on its chromosome and bounds alone
        asked = left.select(F.col(chr_l).alias("_c"), lo.alias("_l"), hi.alias("_h")).distinct()
        found = range_join(asked, right, "_c", F.col("_l"), F.col("_h"), chr_r, start, end, bin_size).select("_c", "_l", "_h").distinct()
        return left.join(found, (F.col(chr_l) == F.col("_c")) & (lo == F.col("_l")) & (hi == F.col("_h")), how)
    a = left.withColumn("_lo", F.floor(lo / bin_size)).withColumn("_hi", F.floor(hi / bin_size)).where("_lo <= _hi").withColumn("_bin", F.explode(F.sequence("_lo", "_hi")))
    b = right.withColumn("_first", F.floor(start / bin_size)).withColumn("_b", F.explode(F.sequence("_first", F.floor(end / bin_size))))
    pairs = (F.col(chr_l) == F.col(chr_r)) & (F.col("_bin") == F.col("_b")) & (start <= hi) & (lo <= end)
    return a.join(b, pairs & (F.col("_bin") == F.greatest("_lo", "_first"))).drop("_lo", "_hi", "_bin", "_first", "_b")


def merge(df: DataFrame, chrom: str = "chr", start: str = "start", end: str = "end", adjacent: bool = False, by: list[str] | None = None) -> DataFrame:
    """Unions of overlapping intervals (also of those that just touch, if ``adjacent``)."""
    keys = [*(by or []), chrom]
    w = Window.partitionBy(*keys).orderBy(start, end)
    top = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(top.isNull() | (F.col(start) > top + (1 if adjacent else 0)), 1).otherwise(0)
    islands = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("_island")


def tile(hotspots: DataFrame, chrom: str = "chr", start0: str = "start0", end: str = "end") -> DataFrame:
    """A tiling of each chromosome: (idx, chr, start, end, type) with a coldspot before each hotspot and one after the last."""
    w = Window.partitionBy(chrom).orderBy(start0)
    rows = hotspots.withColumn("_before", F.lag(end).over(w)).select(
        F.col(chrom).alias("chr"),
        F.explode(
            F.array(
                F.struct(F.coalesce(F.col("_before") + 1, F.lit(0)).cast("long").alias("start"), F.col(start0).cast("long").alias("end"), F.lit("CS").alias("type")),
                F.struct((F.col(start0) + 1).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.lit("HS").alias("type")),
            )
        ).alias("r"),
    ).select("chr", "r.*")
    tail = hotspots.groupBy(F.col(chrom).alias("chr")).agg((F.max(end) + 1).cast("long").alias("start")).select("chr", "start", F.lit(2147483647).cast("long").alias("end"), F.lit("CS").alias("type"))
    # numbered within the chromosome; chromosomes follow each other
    inside = F.row_number().over(Window.partitionBy("chr").orderBy("start", "end"))
    numbered = rows.unionByName(tail).withColumn("_i", inside)
    sizes = numbered.groupBy("chr").agg(F.count("*").alias("_n"))  # one row for each chromosome
    offsets = sizes.select(F.col("chr").alias("_c"), F.coalesce(F.sum("_n").over(Window.orderBy("chr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return numbered.join(F.broadcast(offsets), F.col("chr") == F.col("_c")).select((F.col("_o") + F.col("_i") - 1).alias("idx"), "chr", "start", "end", "type")


def nearest(points: DataFrame, anchors: DataFrame, chrom: str = "chr", pos: str = "pos", anchor_pos: str = "pos", anchor_id: str = "anchor_id") -> DataFrame:
    """Each point with the nearest anchor of its chromosome at or before it, and after it: two sorts, no pairs.

    Both are running last values, one in each direction, so a point costs the same however many follow it.
    """
    a = anchors.select(F.col(chrom).alias("chr"), F.col(anchor_pos).alias("_p"), F.struct(F.col(anchor_pos).alias("at"), F.col(anchor_id).alias("id")).alias("_a"), F.lit(0).alias("_k"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_row"))
    p = points.select(F.col(chrom).alias("chr"), F.col(pos).alias("_p"), F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), F.lit(1).alias("_k"), F.struct(*points.columns).alias("_row"))
    both = a.unionByName(p)
    w = Window.partitionBy("chr").orderBy("_p", "_k")
    before = F.last("_a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy("chr").orderBy(F.col("_p").desc(), F.col("_k").desc())
    after = F.last("_a", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    out = both.withColumn("_before", before).withColumn("_after", after).where("_k = 1")
    return out.select("_row.*", F.col("_before.at").alias("before_pos"), F.col("_before.id").alias("before_id"), F.col("_after.at").alias("after_pos"), F.col("_after.id").alias("after_id"))


def runs(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Runs of consecutive positions: (key, first, last, n)."""
    w = Window.partitionBy(key).orderBy(pos)
    return df.select(key, pos).distinct().withColumn("_g", F.col(pos) - F.row_number().over(w)).groupBy(key, "_g").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).drop("_g")


def density(anchors: DataFrame, annotations: DataFrame, window: int = 1_000_000, bin_size: int = 1000, join_bin: int | None = None) -> DataFrame:
    """How many anchors (chr, pos, anchor_id, neg) have an annotation (chr, start, end) in each bin of relative position.

    Coordinates are mirrored for anchors on the negative strand; an anchor counts once in a bin.
    """
    b = annotations.select(F.col("chr").alias("achr"), F.col("start").alias("astart"), F.col("end").alias("aend"))
    pairs = range_join(anchors, b, "chr", F.col("pos") - window, F.col("pos") + window, "achr", F.col("astart"), F.col("aend"), join_bin or window)
    lo = F.when(F.col("neg"), F.col("pos") - F.col("aend")).otherwise(F.col("astart") - F.col("pos"))
    hi = F.when(F.col("neg"), F.col("pos") - F.col("astart")).otherwise(F.col("aend") - F.col("pos"))
    at = lambda x: F.floor((x + window) / bin_size)
    last = (2 * window - 1) // bin_size
    hit = pairs.select("anchor_id", F.greatest(at(lo), F.lit(0)).alias("a"), F.least(at(hi), F.lit(last)).alias("b")).where("a <= b")  # one that begins at the window's very end is in no bin
    hit = hit.select("anchor_id", F.explode(F.sequence("a", "b")).alias("k")).distinct()
    bins = anchors.sparkSession.range(last + 1).withColumnRenamed("id", "k")
    counted = bins.join(hit.groupBy("k").agg(F.count("*").alias("n")), "k", "left")
    return counted.select((F.col("k") * bin_size - window).alias("from"), (F.col("k") * bin_size - window + bin_size - 1).alias("to"), F.coalesce("n", F.lit(0)).alias("n"))
