"""Co-localisation of two signals: regulatory trait concordance, and unions of hits over datasets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .intervals import range_join


def region_of(variants: DataFrame, tiling: DataFrame, bin_size: int = 1_000_000) -> DataFrame:
    """The tile of each variant (vid, chr, pos): its idx, -1 after the last tile, -2 in a gap, -4 on an unknown chromosome."""
    tops = tiling.groupBy(F.col("chr").alias("tchr")).agg(F.max("end").alias("top"))
    # the last tile has no real end: it needs no bins of its own
    ends = F.least(F.col("end"), F.col("rstart") + F.lit(10**9))
    t = tiling.select("idx", F.col("chr").alias("rchr"), F.col("start").alias("rstart"), "end").where("end < 2147483647").withColumn("rend", ends).drop("end")
    tails = tiling.where("end = 2147483647").select(F.col("idx").alias("tail_idx"), F.col("chr").alias("tail_chr"), F.col("start").alias("tail_start"))
    hit = range_join(variants, t, "chr", F.col("pos"), F.col("pos"), "rchr", F.col("rstart"), F.col("rend"), bin_size).groupBy("vid").agg(F.min("idx").alias("idx"))
    out = variants.join(hit, "vid", "left").join(F.broadcast(tops), F.col("chr") == F.col("tchr"), "left").join(F.broadcast(tails), F.col("chr") == F.col("tail_chr"), "left")  # a row for each chromosome
    return out.withColumn("region", F.coalesce("idx", F.when(F.col("pos") >= F.col("tail_start"), F.col("tail_idx")), F.when(F.col("tchr").isNull(), -4).when(F.col("pos") > F.col("top"), -1).otherwise(-2)).cast("long")).select(*variants.columns, "region")


def colocated(gwas: DataFrame, qtls: DataFrame, window: int, to: str = "phenotype", listed: bool = True) -> DataFrame:
    """GWAS variants (gwas_vid, chr, gpos) within a window of QTLs (qtl_vid, pid, qchr, qpos, ppos): of the phenotype's
    start, or of the QTL's variant; with the other signals of the phenotype (``others``), or, if not ``listed``, only their
    number (``n_others``): lists grow with the square of a phenotype's signals.

    Either is joined to the pairs that were found, after the range join.
    """
    at = F.col("ppos") if to == "phenotype" else F.col("qpos")
    found = range_join(gwas, qtls, "chr", F.col("gpos") - window, F.col("gpos") + window, "qchr", at, at, window)
    if not listed:
        n = qtls.groupBy("pid").agg(F.count_distinct("qtl_vid").alias("_n"))
        return found.join(n, "pid").withColumn("n_others", F.col("_n") - F.col("qtl_vid").isNotNull().cast("long")).drop("_n")
    others = qtls.groupBy("pid").agg(F.collect_set("qtl_vid").alias("_all"))
    return found.join(others, "pid").withColumn("others", F.array_sort(F.array_except("_all", F.array("qtl_vid")))).drop("_all")


def paired_signals(a: DataFrame, b: DataFrame, window: int | None = None) -> DataFrame:
    """Signals of one group in two sets (grp, vid, chr, pos): all pairs, or those within a window."""
    r = b.select("grp", F.col("vid").alias("vid2"), F.col("chr").alias("chr2"), F.col("pos").alias("pos2"))
    out = a.join(r, "grp")
    return out if window is None else out.where((F.col("chr") == F.col("chr2")) & (F.abs(F.col("pos") - F.col("pos2")) <= window))


def rtc_score(phenotype: np.ndarray, genotypes: np.ndarray, test: int, qtl: int, others: np.ndarray | None = None, normal: bool = False) -> float:
    """How well removing the test variant (row) removes the QTL's signal, among all variants of the region: 1 is best."""
    if test == qtl:
        return 1.0
    g = stats.unit(genotypes)
    p = phenotype
    if others is not None and len(others):
        p = stats.residualise(p[None], stats.basis(others))[0]
    p = stats.unit((stats.rank_normal(p) if normal else p)[None])[0]
    left = p[None] - (g @ p)[:, None] * g
    if normal:
        left = np.array([stats.rank_normal(v) for v in left])
    c = np.abs(stats.unit(left) @ g[qtl])
    n = len(c)
    return float((n - (int((c <= c[test]).sum()) - 1)) / n)


RTC = "pid string, gwas_vid string, qtl_vid string, n_variants int, rank int, rtc double, dosage_r2 double"


def rtc(pairs: DataFrame, phenotypes: DataFrame, genotypes: DataFrame, regions: DataFrame, normal: bool = False, seed: int = 15112011, simulate: int = 0, ld: float = 0.5) -> DataFrame:
    """Regulatory trait concordance of (pid, gwas_vid, qtl_vid, others) pairs whose variants lie in the same region.

    ``regions``: (vid, region). A task holds one region's genotypes once for all its pairs. With ``simulate`` > 0 the
    scores of simulated pairs with two causal variants (h0) or one (h1) give a p-value and medians.
    """
    a = regions.select(F.col("vid").alias("gwas_vid"), F.col("region").alias("ra"))
    b = regions.select(F.col("vid").alias("qtl_vid"), F.col("region").alias("rb"))
    ok = pairs.join(a, "gwas_vid").join(b, "qtl_vid").where("ra = rb and ra >= 0").join(phenotypes.select("pid", "vals"), "pid")
    ok = ok.select(F.col("ra").alias("region"), "pid", "gwas_vid", "qtl_vid", "others", "vals")
    g = regions.where("region >= 0").join(genotypes.select("vid", "gvals"), "vid").select(F.col("region").alias("vregion"), "vid", "gvals")
    extra = ", p double, median_h0 double, median_h1 double, h0_share double, n_h0 int, n_h1 int" if simulate else ""

    def kernel(key, pg: pd.DataFrame, gg: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in (RTC + extra).split(", ")]
        if not len(pg) or not len(gg):
            return pd.DataFrame([], columns=names)
        gg = gg.sort_values("vid")
        where = {v: i for i, v in enumerate(gg["vid"])}
        x = stats.impute(np.array([np.array(v, float) for v in gg["gvals"]]))
        rows = []
        for r in pg.sort_values(["pid", "gwas_vid", "qtl_vid"]).itertuples():
            if r.gwas_vid not in where or r.qtl_vid not in where:
                continue
            t, q = where[r.gwas_vid], where[r.qtl_vid]
            o = [where[v] for v in r.others if v in where]
            y = stats.impute(np.array(r.vals, float)[None])[0]
            score = rtc_score(y, x, t, q, x[o] if o else None, normal)
            row = [r.pid, r.gwas_vid, r.qtl_vid, len(x), int(round(len(x) - score * len(x))), score, float((stats.unit(x[[t]])[0] @ stats.unit(x[[q]])[0]) ** 2)]
            if simulate:
                row += simulated(y, x, q, score, simulate, ld, np.random.default_rng([seed, *f"{r.pid} {r.gwas_vid} {r.qtl_vid}".encode()]), normal)
            rows.append(row)
        return pd.DataFrame(rows, columns=names)

    return ok.groupBy("region").cogroup(g.groupBy("vregion")).applyInPandas(kernel, RTC + extra)


def simulated(y: np.ndarray, x: np.ndarray, qtl: int, score: float, n: int, ld: float, rng, normal: bool) -> list:
    """p, medians of h0 and h1, share of h0 near the score, and how many of each succeeded."""
    out = {0: [], 1: []}
    g = stats.unit(x)
    r2 = (g @ g.T) ** 2
    slope = np.polyfit(x[qtl], y, 1)
    left = y - np.polyval(slope, x[qtl])
    if len(x) >= 4:
        for h in (0, 1):
            for _ in range(50 * n):
                if len(out[h]) >= n:
                    break
                c = int(rng.integers(len(x)))
                near = np.flatnonzero((r2[c] >= ld) & (np.arange(len(x)) != c))
                if h == 1:
                    if near.size < 2:
                        continue
                    e, t = rng.choice(near, 2, replace=False)
                else:
                    if not near.size:
                        continue
                    e = rng.choice(near)
                    rest = np.setdiff1d(np.arange(len(x)), [c, e])
                    if not rest.size:
                        continue
                    o = int(rng.choice(rest))
                    nearer = np.setdiff1d(np.flatnonzero(r2[o] >= ld), [o, c, e])
                    if not nearer.size:
                        continue
                    t = rng.choice(nearer)
                made = np.polyval(slope, x[c]) + rng.permutation(left)
                out[h].append(rtc_score(made, x, int(t), int(e), None, normal))
    h0, h1 = np.array(out[0]), np.array(out[1])
    if not h0.size or not h1.size:
        return [None, None, None, None, h0.size, h1.size]
    pool, kind = np.concatenate((h0, h1)), np.concatenate((np.zeros(h0.size), np.ones(h1.size)))
    order = np.argsort(pool, kind="stable")
    at, half = int(np.abs(pool[order] - score).argmin()), len(pool) // 10
    around = kind[order][max(0, at - half) : at + half + 1]
    return [float(((h0 >= score).sum() + 1) / (h0.size + 1)), float(np.median(h0)), float(np.median(h1)), float((around == 0).mean()), h0.size, h1.size]


def union_hits(hits: DataFrame, datasets: DataFrame, phenotypes: DataFrame, best: DataFrame) -> DataFrame:
    """Hits over (region, phenotype) in all datasets, each key filled up to its largest number of signals.

    ``hits``: dataset, region, pid, vid, rank; ``phenotypes``: dataset, pid; ``best``: the best variant for each
    (dataset, region, pid, vid, pval) that a dataset without hits offers.
    """
    known = hits.where("region >= 0")
    sizes = known.groupBy("dataset", "region", "pid").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("region", "pid").agg(F.max("n").alias("most"))
    grid = keys.join(F.broadcast(datasets.select("dataset")))  # datasets are files: a handful
    have = phenotypes.select("dataset", "pid").distinct().withColumn("_p", F.lit(True))
    b = best.select("dataset", "region", "pid", F.col("vid").alias("best_vid"), F.col("pval").alias("best_p"))
    full = grid.join(sizes, ["dataset", "region", "pid"], "left").join(have, ["dataset", "pid"], "left").join(b, ["dataset", "region", "pid"], "left")
    listed = known.select("dataset", "region", "pid", "vid", "rank", F.lit(0.0).alias("pval"))
    filled = full.where("n is null and _p and best_vid is not null").select("dataset", "region", "pid", F.col("best_vid").alias("vid"), F.lit(-1).alias("rank"), F.col("best_p").alias("pval"))
    used = F.when(F.col("n").isNotNull(), F.col("n")).when(F.col("_p") & F.col("best_vid").isNotNull(), 1).otherwise(0)
    why = F.when(F.col("n").isNotNull() | (F.col("_p") & F.col("best_vid").isNotNull()), "__UNION_FILLER_MAX_INDEP__").when(F.col("_p").isNull(), "__UNION_FILLER_MISS_PHENO__").otherwise("__UNION_FILLER_MISS_GENO__")
    gaps = full.withColumn("_need", F.col("most") - used).where("_need > 0")
    gaps = gaps.select("dataset", "region", "pid", why.alias("vid"), F.explode(F.sequence(F.lit(1), F.col("_need").cast("int"))).alias("_k")).select("dataset", "region", "pid", "vid", F.lit(-1).alias("rank"), F.lit(None).cast("double").alias("pval"))
    return listed.unionByName(filled).unionByName(gaps)
