"""Enrichment of points in annotations, against permuted or matched nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import nearest, range_join


def at_quantile(values: str, q: float, n: Column | int) -> Column:
    """Element round(n * q) (from 0) of the n sorted values, the last one at most."""
    return F.element_at(F.array_sort(values), F.least(F.round(F.lit(q) * n) + 1, F.size(values)).cast("int"))


def empirical(null: DataFrame, observed: Column, total: Column, value: str = "n") -> DataFrame:
    """Two-sided empirical p-value and odds ratios at the null's 2.5 %, median and 97.5 %, of one observed count.

    ``null`` has one row for each permutation, so its values may be gathered.
    """
    one = null.agg(F.count("*").alias("N"), F.avg(value).alias("null_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("null_sd"), F.count_if(F.col(value) >= observed).alias("_ge"), F.count_if(F.col(value) <= observed).alias("_le"), F.collect_list(value).alias("_v"), F.first(observed).alias("obs"), F.first(total).alias("total"))

    def odds(q):
        e, o = at_quantile("_v", q, F.col("N")) / F.col("total"), F.col("obs") / F.col("total")
        up, down = o * (1 - e), e * (1 - o)  # a division of doubles: infinite, or NaN for 0 / 0
        return F.when(down != 0, up / F.nullif(down, F.lit(0.0))).when(up > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))

    return one.select("obs", "total", "null_mean", "null_sd", F.least(F.lit(1.0), (2 * F.least("_ge", "_le") + 1) / (F.col("N") + 1)).alias("p"), odds(0.025).alias("or_q025"), odds(0.5).alias("or_median"), odds(0.975).alias("or_q975"))


def overlaps(points: DataFrame, annotations: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """The points (chr, pos, ...) that lie in an annotation (chr, start, end)."""
    b = annotations.select(F.col("chr").alias("achr"), F.col("start").alias("astart"), F.col("end").alias("aend"))
    return range_join(points, b, "chr", F.col("pos"), F.col("pos"), "achr", F.col("astart"), F.col("aend"), bin_size, "left_semi")


def functional_enrichment(qtls: DataFrame, anchors: DataFrame, annotations: DataFrame, permutations: int = 1000, seed: int = 15112011) -> DataFrame:
    """Do QTLs (qtl_id, anchor_id, chr, pos) lie in annotations more often than at random anchors (anchor_id, chr, pos, neg)?

    A QTL's signed distance to its own anchor is applied, for the null, to other anchors in a random order: in
    permutation k the i-th QTL takes the anchor whose hash has rank i. Whether a distance from an anchor hits is looked
    up for the (QTL, anchor) pairs drawn, by one binned join over all permutations.
    """
    a = anchors.select("anchor_id", F.col("chr").alias("achr_"), F.col("pos").alias("apos"), F.col("neg").alias("aneg"))
    own = qtls.join(a, "anchor_id").withColumn("d", F.when(F.col("aneg"), -1).otherwise(1) * (F.col("pos") - F.col("apos")))
    n = own.count()
    observed = overlaps(own.select("qtl_id", "chr", "pos"), annotations).count()
    numbered = own.select("d", (F.row_number().over(Window.orderBy("qtl_id")) - 1).alias("i"))
    draws = anchors.sparkSession.range(permutations).withColumnRenamed("id", "k").crossJoin(a.select("anchor_id"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.lit(seed), "k", "anchor_id"), "anchor_id")) - 1
    drawn = draws.withColumn("i", rank).where(F.col("i") < n).join(numbered, "i").join(a, "anchor_id")
    spots = drawn.select("k", "i", F.col("achr_").alias("chr"), (F.col("apos") + F.when(F.col("aneg"), -F.col("d")).otherwise(F.col("d"))).alias("pos"))
    hits = overlaps(spots, annotations).groupBy("k").agg(F.count("*").alias("n"))
    null = anchors.sparkSession.range(permutations).withColumnRenamed("id", "k").join(hits, "k", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return empirical(null, F.lit(observed).cast("double"), F.lit(n).cast("double"))


def signed_distance_to_anchor(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """Distance of each point to the nearer of the anchors around it, below 0 upstream; open-ended at both ends."""
    neg = anchors.select(F.col("anchor_id").alias("_id"), F.col("neg").alias("_neg"))
    near = nearest(points, anchors)
    left, right = F.col("pos") - F.col("before_pos"), F.col("after_pos") - F.col("pos")
    take_left = F.coalesce(left <= right, F.col("after_pos").isNull())
    out = near.withColumn("_a", F.when(take_left, F.col("before_id")).otherwise(F.col("after_id"))).withColumn("_d", F.when(take_left, left).otherwise(-right))
    return out.join(neg, F.col("_a") == F.col("_id"), "left").select(*points.columns, F.col("_a").alias("anchor_id"), F.when(F.col("_neg"), -F.col("_d")).otherwise(F.col("_d")).alias("dist"))


def matched_bins(qtls: DataFrame, candidates: DataFrame, bin_distance: int = 5000, bin_maf: float = 0.02, min_null: int = 3) -> DataFrame:
    """Bins of QTLs (qtl_id, maf, dist) by allele frequency and distance, with the candidates (cid, maf, dist) that match.

    A QTL joins the first bin that holds it, else opens one around itself: sequential over QTLs, so they go through one
    task (they are the significant ones). Candidates are streamed against the bins, whose number is at most that of QTLs.
    """

    def open_bins(batches):
        import pandas as pd

        bins = []
        for q in batches:
            rows = []
            for i, m, d in zip(q["qtl_id"], q["maf"], q["dist"], strict=True):
                k = next((k for k, b in enumerate(bins) if b[0] <= m < b[1] and b[2] <= d < b[3]), None)
                if k is None:
                    k = len(bins)
                    bins.append((max(0.0, m - bin_maf), min(0.5, m + bin_maf) if m < 0.5 else 0.5 + 1e-9, d - bin_distance, d + bin_distance))
                rows.append((k, i, *bins[k]))
            yield pd.DataFrame(rows, columns=["bin", "qtl_id", "maf_lo", "maf_hi", "dist_lo", "dist_hi"])

    schema = "bin long, qtl_id string, maf_lo double, maf_hi double, dist_lo double, dist_hi double"
    placed = qtls.select("qtl_id", "maf", "dist").coalesce(1).sortWithinPartitions("qtl_id").mapInPandas(open_bins, schema)
    boxes = placed.groupBy("bin", "maf_lo", "maf_hi", "dist_lo", "dist_hi").agg(F.collect_list("qtl_id").alias("qtls"))
    fits = candidates.join(boxes, (F.col("maf") >= F.col("maf_lo")) & (F.col("maf") < F.col("maf_hi")) & (F.col("dist") >= F.col("dist_lo")) & (F.col("dist") < F.col("dist_hi")))
    first = fits.groupBy("cid").agg(F.min("bin").alias("bin"))
    matched = first.groupBy("bin").agg(F.collect_list("cid").alias("nulls")).where(F.size("nulls") >= min_null)
    return boxes.join(matched, "bin").select("bin", "qtls", F.array_sort("nulls").alias("nulls"))


def matched_enrichment(bins: DataFrame, hits: DataFrame, total: int, permutations: int = 1000, seed: int = 15112011) -> DataFrame:
    """Overlap of QTLs with ``hits`` (id), against random candidates of the same bins; ``total``: all QTLs."""
    one = bins.select("bin", F.size("nulls").cast("long").alias("n"), F.explode("qtls").alias("qtl_id"))
    observed = one.join(hits, one.qtl_id == hits.id, "left_semi").count()
    draws = one.crossJoin(bins.sparkSession.range(permutations).withColumnRenamed("id", "k"))
    draws = draws.select("k", "bin", F.pmod(F.xxhash64(F.lit(seed), "k", "qtl_id"), "n").cast("int").alias("i"))
    # a draw is a place in the bin's list: the lists themselves are not copied for each QTL
    there = bins.select("bin", F.posexplode("nulls").alias("i", "id")).join(hits, "id", "left_semi").select("bin", "i")
    got = draws.join(there, ["bin", "i"]).groupBy("k").agg(F.count("*").alias("n"))
    null = bins.sparkSession.range(permutations).withColumnRenamed("id", "k").join(got, "k", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return empirical(null, F.lit(observed).cast("double"), F.lit(total).cast("double"))


def linked(sites: DataFrame, targets: DataFrame, haplotypes: DataFrame, r2: float = 0.5, reach: int = 1_000_000) -> DataFrame:
    """The sites (id, chr, pos) that are a target or in linkage disequilibrium with one within reach.

    ``haplotypes`` has (id, hap array<boolean>).
    """
    h = haplotypes.select(F.col("id").alias("hid"), "hap")
    a = sites.join(h, F.col("id") == F.col("hid")).drop("hid")
    b = targets.select(F.col("id").alias("tid"), F.col("chr").alias("tchr"), F.col("pos").alias("tpos")).join(h, F.col("tid") == F.col("hid")).drop("hid").withColumnRenamed("hap", "thap")
    pairs = range_join(a, b, "chr", F.col("pos") - reach, F.col("pos") + reach, "tchr", F.col("tpos"), F.col("tpos"), reach)
    return pairs.where((F.col("id") == F.col("tid")) | (ld("hap", "thap")["r2"] >= r2)).select("id").distinct()


def ld(a: str, b: str) -> Column:
    """struct(dprime, r2) of two phased haplotype arrays."""
    n = F.size(a).cast("double")
    count = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v.cast("int"))
    pa, pb, pab = count(F.col(a)) / n, count(F.col(b)) / n, count(F.zip_with(a, b, lambda x, y: x & y)) / n
    d = pab - pa * pb
    top = F.when(d < 0, F.least(pa * pb, (1 - pa) * (1 - pb))).otherwise(F.least(pa * (1 - pb), (1 - pa) * pb))
    return F.struct((F.abs(d) / F.nullif(top, F.lit(0.0))).alias("dprime"), (d * d / F.nullif(pa * (1 - pa) * pb * (1 - pb), F.lit(0.0))).alias("r2"))
