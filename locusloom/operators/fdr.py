"""False discovery rates and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns


def q_values(df: DataFrame, p: str, pi0: float | None = 1.0, lam: float = 0.5) -> DataFrame:
    """Column ``qval``: Benjamini-Hochberg for pi0 = 1, Storey's with pi0 estimated at ``lam`` for None.

    Equal p-values share a rank. Counts run over distinct p-values, by a window over their histogram.
    """
    total = df.where(F.col(p).isNotNull()).agg(F.count("*").alias("_m"), F.count_if(F.col(p) > lam).alias("_over"))
    tail = F.lit(pi0) if pi0 is not None else F.least(F.lit(1.0), F.col("_over") / ((1 - lam) * F.col("_m")))
    counts = df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    ranked = counts.withColumn("_rank", F.sum("_n").over(Window.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)))
    raw = ranked.join(F.broadcast(total)).withColumn("_q", tail * F.col("_m") * F.col(p) / F.col("_rank"))
    q = raw.withColumn("qval", F.least(F.lit(1.0), F.min("_q").over(Window.orderBy(F.col(p).desc()).rowsBetween(Window.unboundedPreceding, 0)))).select(F.col(p).alias("_p"), "qval")
    return df.join(q, F.col(p) == F.col("_p"), "left").drop("_p")


def cis_thresholds(permuted: DataFrame, fdr: float = 0.05, pi0: float | None = None) -> DataFrame:
    """A nominal threshold for each phenotype at a false discovery rate, from the permutation pass."""
    q = q_values(permuted, "adj_beta_pval", pi0)
    cut = q.agg(F.max(F.when(F.col("qval") <= fdr, F.col("adj_beta_pval"))).alias("lo"), F.min(F.when(F.col("qval") > fdr, F.col("adj_beta_pval"))).alias("hi"))
    cut = cut.select(F.when(F.col("hi").isNull(), F.col("lo")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("_t"))
    out = q.join(F.broadcast(cut))
    t = columns.nominal_threshold(F.col("_t"), F.col("bml1"), F.col("bml2"), F.col("dof1"), F.col("dof2"))
    return out.withColumn("threshold", t).withColumn("significant", F.col("qval") <= fdr).drop("_t")


def approximate_trans(best: DataFrame, hits: DataFrame, fdr: float = 0.05, pi0: float | None = None) -> DataFrame:
    """Hits up to the smallest adjusted best p-value whose q-value exceeds the rate."""
    cut = q_values(best, "adj_pval", pi0).where(F.col("qval") > fdr).agg(F.min("adj_pval").alias("_t"))
    return hits.join(F.broadcast(cut)).where(F.col("_t").isNull() | (F.col("adj_pval") <= F.col("_t"))).drop("_t")


def full_trans(hits: DataFrame, permuted: DataFrame, p: str = "p") -> DataFrame:
    """For the h-th smallest nominal p: number of permuted p-values up to it, over h.

    Both are counted by distinct p-value first; the window runs over those.
    """
    both = hits.select(p).withColumn("_h", F.lit(1)).unionByName(permuted.select(p).withColumn("_h", F.lit(0)))
    by_p = both.groupBy(p).agg(F.sum("_h").alias("hits"), F.sum(1 - F.col("_h")).alias("nulls"))
    upto = Window.orderBy(p).rangeBetween(Window.unboundedPreceding, 0)
    out = by_p.select(p, "hits", F.sum("hits").over(upto).alias("rank"), F.sum("nulls").over(upto).alias("n_null"))
    return out.where("hits > 0").withColumn("fdr", F.col("n_null") / F.col("rank"))


def quantile_of_bins(bins: DataFrame, ranks: DataFrame) -> DataFrame:
    """Null p-value at each rank, by interpolation inside bins (p_lo, p_hi, n), smallest p first."""
    w = Window.orderBy("p_lo").rowsBetween(Window.unboundedPreceding, 0)
    cum = bins.withColumn("_hi", F.sum("n").over(w)).withColumn("_lo", F.col("_hi") - F.col("n")).where("n > 0")
    # bins are few (1000 by default), so they go to every task
    hit = ranks.join(F.broadcast(cum), (F.col("rank") > F.col("_lo")) & (F.col("rank") <= F.col("_hi")))
    return hit.select("rank", (F.col("p_lo") + (F.col("p_hi") - F.col("p_lo")) * (F.col("rank") - F.col("_lo")) / F.col("n")).alias("null_p"))
