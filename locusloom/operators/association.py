"""Association of phenotypes with variants: one linear regression for each pair.

Long-form statistics (``pair_stats``) stay in Catalyst; array-form passes multiply blocks of normalised rows with
numpy and pre-aggregate in the task, so only hits, bins and best pairs are shuffled.

Wide phenotypes: pid, grp, chr, start, end, neg, vals. Wide genotypes: vid, vchr, vstart, vend, gvals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns, stats
from .intervals import range_join

BROADCAST_BYTES = 256 << 20
BLOCK_BYTES = 32 << 20  # of rows that a task multiplies at once


def pair_stats(pairs: DataFrame, by: list[str], x: str = "gv", y: str = "pv") -> DataFrame:
    """n, r, r_squared, slope, slope_se, nom_pval of each group of (x, y) observations."""
    r = F.corr(F.col(y), F.col(x))
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(r, F.lit(0.0)).alias("r"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("_sx"), F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("_sy"))
    flat = (F.col("_sx") < 1e-16) | (F.col("_sy") < 1e-16)
    out = out.withColumn("r", F.when(flat, 0.0).otherwise(F.col("r")))
    out = out.withColumn("r_squared", F.col("r") * F.col("r")).withColumn("slope", F.when(flat, 0.0).otherwise(F.col("r") * F.col("_sy") / F.col("_sx")))
    se = F.when(flat, 0.0).otherwise(F.col("_sy") / F.col("_sx") * F.sqrt((1 - F.col("r_squared")) / (F.col("n") - 2)))
    return out.withColumn("slope_se", se).withColumn("nom_pval", columns.corr_p(F.col("r"), F.col("n") - 2)).drop("_sx", "_sy")


def cis_pairs(phenotypes: DataFrame, variants: DataFrame, window: int = 1_000_000, bin_size: int | None = None) -> DataFrame:
    """(phenotype, variant) annotation pairs within the window, with their signed distance ``dist``."""
    lo, hi = F.greatest(F.col("start") - window, F.lit(0)), F.col("end") + window
    pairs = range_join(phenotypes, variants, "chr", lo, hi, "vchr", F.col("vstart"), F.col("vend"), bin_size or max(window, 1))
    return pairs.withColumn("dist", columns.signed_distance(F.col("vstart"), F.col("vend"), F.col("start"), F.col("end"), F.col("neg")))


def best_hit(df: DataFrame, group: str, r: str = "r", order: list[str] = ("pid", "vid")) -> DataFrame:
    """Flag the pair with the largest absolute correlation of its group; ties by distance, then in the given order."""
    w = Window.partitionBy(group).orderBy(F.abs(r).desc(), F.abs("dist"), *order)
    return df.withColumn("best_hit", (F.row_number().over(w) == 1).cast("int"))


def cis_nominal(phenotypes: DataFrame, variants: DataFrame, p_long: DataFrame, g_long: DataFrame, window: int = 1_000_000, threshold: float = 1.0, thresholds: DataFrame | None = None) -> DataFrame:
    """All pairs in the window with p <= threshold (or a threshold for each phenotype): annotation, statistics, best hit."""
    pairs = cis_pairs(phenotypes, variants, window)
    obs = pairs.select("pid", "vid").join(p_long, "pid").join(g_long, ["vid", "sample"])
    stats_ = pair_stats(obs, ["pid", "vid"])
    out = pairs.join(stats_, ["pid", "vid"])
    out = best_hit(out, "pid").withColumn("n_var_in_cis", F.count("*").over(Window.partitionBy("pid")))
    if thresholds is not None:
        return out.join(thresholds.withColumnRenamed("threshold", "_t"), "pid").where("nom_pval <= _t").drop("_t")
    return out.where(F.col("nom_pval") <= threshold)


def _block(g: pd.DataFrame, column: str) -> np.ndarray:
    """Unit rows of an array column, made row by row: rows may be long."""
    out = [stats.unit(stats.impute(np.array(v, float)[None])) for v in g[column]]
    return np.concatenate(out) if out else np.empty((0, 0))


def _grouped(phenotypes: DataFrame, variants: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Phenotypes, and the variants in the window of each group's first member (pid order), keyed by grp and vgrp."""
    first = phenotypes.withColumn("_k", F.row_number().over(Window.partitionBy("grp").orderBy("pid"))).where("_k = 1").select(F.col("grp"), "chr", "start", "end", "neg")
    return phenotypes, cis_pairs(first, variants, window).select(F.col("grp").alias("vgrp"), "vid", "vstart", "vend", "dist", "gvals")


PERMUTED = "grp string, pid string, n_var_in_cis int, dist long, vid string, dof1 double, dof2 double, bml1 double, bml2 double, nom_pval double, r_squared double, slope double, slope_se double, adj_emp_pval double, adj_beta_pval double"


def cis_permute(phenotypes: DataFrame, variants: DataFrame, window: int = 1_000_000, permutations: int = 1000, seed: int = 15112011) -> DataFrame:
    """The best pair of each group and its p-values adjusted by permutations of the samples.

    One permutation serves all members of a group, so their correlation is kept. Draws depend on the seed and the
    group only, not on partitions. Permutations run in blocks, so a group's memory is its genotypes and one block.
    Groups without variants give a row of nulls.
    """
    p, g = _grouped(phenotypes, variants, window)

    def kernel(key, pg: pd.DataFrame, gg: pd.DataFrame) -> pd.DataFrame:
        row = dict.fromkeys(x.split()[0] for x in PERMUTED.split(", ")) | {"grp": key[0], "n_var_in_cis": len(gg)}
        pg, gg = pg.sort_values("pid"), gg.sort_values("vid")
        if not len(gg) or not len(pg):
            row["pid"] = pg["pid"].iloc[0] if len(pg) else None
            return pd.DataFrame([row]) if len(pg) else pd.DataFrame([], columns=list(row))
        y, x = _block(pg, "vals"), _block(gg, "gvals")
        n = y.shape[1]
        r = y @ x.T
        order = np.lexsort((np.tile(np.arange(len(gg)), len(pg)), np.repeat(np.arange(len(pg)), len(gg)), np.abs(np.tile(gg["dist"].to_numpy(), len(pg))), -np.abs(r).ravel()))
        i, j = divmod(int(order[0]), len(gg))
        rng = np.random.default_rng([seed, *np.frombuffer(str(key[0]).encode(), np.uint8).tolist()])
        null = []
        step = min(64, max(1, BLOCK_BYTES // (8 * n * (len(pg) + 1))))
        for a in range(0, permutations, step):
            perms = np.array([rng.permutation(n) for _ in range(min(step, permutations - a))])
            rp = np.einsum("spn,vn->spv", y[:, perms].transpose(1, 0, 2), x).reshape(len(perms), -1)
            null.append(rp[np.arange(len(perms)), np.abs(rp).argmax(axis=1)])
        null = np.concatenate(null)
        df = n - 2
        sp, sg = (float(stats.sd(stats.impute(np.array(v, float)[None]))[0]) for v in (pg["vals"].iloc[i], gg["gvals"].iloc[j]))
        row |= {"pid": pg["pid"].iloc[i], "vid": gg["vid"].iloc[j], "dist": int(gg["dist"].iloc[j]), "dof1": float(df), "r_squared": r[i, j] ** 2, "nom_pval": float(stats.corr_p(r[i, j], df)), "slope": float(stats.slope(r[i, j], sp, sg)), "slope_se": float(stats.slope_se(r[i, j], sp, sg, n))}
        row |= {"dof2": float(df), "bml1": float("nan"), "bml2": float("nan"), "adj_emp_pval": 1.0, "adj_beta_pval": 1.0}
        if null.var(ddof=1) > 0:
            row["dof2"] = stats.fit_df(null, float(df))
            pp = stats.corr_p(null, row["dof2"])
            if pp.var(ddof=1) > 0 and pp.mean() != 1:
                row["bml1"], row["bml2"] = stats.beta_fit(pp)
                row["adj_emp_pval"] = float(((np.abs(null) >= abs(r[i, j])).sum() + 1) / (permutations + 1))
                row["adj_beta_pval"] = float(stats.betainc(row["bml1"], row["bml2"], stats.corr_p(r[i, j], row["dof2"])))
        return pd.DataFrame([row])

    return p.groupBy("grp").cogroup(g.groupBy("vgrp")).applyInPandas(kernel, PERMUTED)


CONDITIONAL = "grp string, pid string, vid string, dist long, rank int, fwd_pval double, fwd_r_squared double, fwd_slope double, fwd_best_hit int, fwd_sig int, bwd_pval double, bwd_r_squared double, bwd_slope double, bwd_best_hit int, bwd_sig int"


def cis_conditional(phenotypes: DataFrame, variants: DataFrame, thresholds: DataFrame, window: int = 1_000_000) -> DataFrame:
    """Independent signals of each group by forward-backward stepwise regression; ``thresholds``: (pid, threshold).

    Forward: as long as some pair passes its threshold, its best variant (the last of tied ones) is regressed out of
    all members, which are then rank-normalised. Backward: each signal is tested again with all others regressed out.
    """
    t = thresholds.select(F.col(thresholds.columns[0]).alias("_id"), F.col("threshold").alias("_t"))
    known = phenotypes.join(t, F.col("_id") == F.col("pid"), "left")
    p, g = _grouped(known.withColumn("_t", F.coalesce("_t", F.lit(-1.0))).drop("_id"), variants, window)

    def kernel(key, pg: pd.DataFrame, gg: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in CONDITIONAL.split(", ")]
        if not len(pg) or not len(gg):
            return pd.DataFrame([], columns=names)
        pg, gg = pg.sort_values("pid"), gg.sort_values("vid")
        raw = stats.impute(np.array([np.array(v, float) for v in pg["vals"]]))
        geno = stats.impute(np.array([np.array(v, float) for v in gg["gvals"]]))
        x, limit, n = stats.unit(geno), pg["_t"].to_numpy(float)[:, None], raw.shape[1]

        def test(y):
            r = stats.unit(y) @ x.T
            return stats.corr_p(r, n - 2), r, stats.slope(r, stats.sd(y)[:, None], stats.sd(geno)[None])

        def without(y, j):
            return np.array([stats.rank_normal(v) for v in stats.regress_out(y, geno[j])])

        signals, forward, y = [], [], raw
        while True:
            found = test(y)
            p_ = found[0]
            if not (p_ <= limit).any() or len(signals) >= min(len(gg), n - 3):
                break
            low = p_.min(axis=0)
            signals.append(int(np.flatnonzero(low == low.min())[-1]))
            forward.append(found)
            y = without(y, signals[-1])
        rows = []
        for k, (fp, fr, fs) in enumerate(forward):
            y = raw
            for other in signals[:k] + signals[k + 1 :]:
                y = without(y, other)
            bp, br, bs = test(y)
            f_best, b_best = int(fp.argmin()), int(bp.argmin())
            for i, j in zip(*np.nonzero((fp <= limit) | (bp <= limit)), strict=True):
                at = i * len(gg) + j
                rows.append((key[0], pg["pid"].iloc[i], gg["vid"].iloc[j], int(gg["dist"].iloc[j]), k, fp[i, j], fr[i, j] ** 2, fs[i, j], int(at == f_best), int(fp[i, j] <= limit[i, 0]), bp[i, j], br[i, j] ** 2, bs[i, j], int(at == b_best), int(bp[i, j] <= limit[i, 0])))
        return pd.DataFrame(rows, columns=names)

    return p.groupBy("grp").cogroup(g.groupBy("vgrp")).applyInPandas(kernel, CONDITIONAL)


def phenotype_blocks(phenotypes: DataFrame, kernel=None):
    """Phenotypes as normalised blocks for the driver to broadcast, each of a bounded size however many there are.

    Yields (ids, chromosomes, starts, unit rows, sds).
    """
    some = phenotypes.select("pid", "chr", "start", "vals").orderBy("pid")
    rows, size = [], 0

    def block(rows):
        x = stats.impute(np.array([np.array(r["vals"], float) for r in rows]))
        x = kernel(x) if kernel else x
        return np.array([r["pid"] for r in rows]), np.array([r["chr"] for r in rows]), np.array([r["start"] for r in rows], np.int64), stats.unit(x), stats.sd(x)

    for r in some.toLocalIterator(prefetchPartitions=True):
        rows.append(r)
        size += 8 * len(r["vals"])
        if size > BROADCAST_BYTES:
            yield block(rows)
            rows, size = [], 0
    if rows:
        yield block(rows)


TRANS = "kind string, pid string, pchr string, pstart long, vid string, vchr string, vpos long, nom_pval double, r double, slope double, bin long, n long"


def trans(phenotypes: DataFrame, genotypes: DataFrame, window: int = 5_000_000, threshold: float = 1e-5, bins: int = 1000, shuffle_seed: int | None = None, null: tuple[float, float] | None = None, limit: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every pair outside the cis window: (hits, histogram of the others, best variant of each phenotype).

    The threshold on p is turned into one on |r| once. Each task multiplies its genotypes with a broadcast block of
    phenotypes and returns hits, bin counts and best pairs only. ``shuffle_seed`` permutes the samples of all
    phenotypes alike. With ``null`` (two beta shapes) the threshold is on the adjusted p-value. ``limit`` is a threshold
    on |r| itself, in place of one on p.
    """
    spark, parts = phenotypes.sparkSession, None
    n = phenotypes.select(F.size("vals")).first()
    n = n[0] if n else 3
    p0 = float(stats.qbeta(threshold, *null)) if null else threshold
    limit = float(stats.r_threshold(p0, n - 2)) if limit is None else limit
    order = np.random.default_rng(shuffle_seed).permutation(n) if shuffle_seed is not None else None
    for block in phenotype_blocks(phenotypes, (lambda x: x[:, order]) if order is not None else None):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, chroms, starts, y, sds = shared.value
            hist = np.zeros(bins, np.int64)
            best_r, best_v = np.zeros(len(ids)), np.full(len(ids), None, object)
            for b in (b.iloc[i : i + step] for b in batches if len(b) for step in [max(1, BLOCK_BYTES // (8 * n))] for i in range(0, len(b), step)):
                raw = stats.impute(np.array([np.array(v, float) for v in b["gvals"]]))
                r = stats.unit(raw) @ y.T
                sg = stats.sd(raw)
                near = (b["vchr"].to_numpy()[:, None] == chroms) & (np.abs(b["vstart"].to_numpy()[:, None] - starts) <= window)
                a = np.where(near, -1.0, np.abs(r))
                i, j = np.nonzero(a >= limit)
                if i.size:
                    yield pd.DataFrame({"kind": "hit", "pid": ids[j], "pchr": chroms[j], "pstart": starts[j], "vid": b["vid"].to_numpy()[i], "vchr": b["vchr"].to_numpy()[i], "vpos": b["vstart"].to_numpy()[i], "nom_pval": stats.corr_p(r[i, j], n - 2), "r": r[i, j], "slope": stats.slope(r[i, j], sds[j], sg[i]), "bin": None, "n": None})
                low = a[(a >= 0) & (a < limit)]
                hist += np.bincount(np.minimum((low * bins / limit).astype(np.int64), bins - 1), minlength=bins)
                k = a.argmax(axis=0)
                top = a[k, np.arange(len(ids))]
                vids = b["vid"].to_numpy()[k]
                better = (top > best_r) | ((top == best_r) & (top > 0) & np.array([w is not None and v < w for v, w in zip(vids, best_v, strict=True)]))
                best_v[better], best_r[better] = vids[better], top[better]
            at = np.flatnonzero(hist)
            blank = dict.fromkeys(["pid", "pchr", "pstart", "vid", "vchr", "vpos", "nom_pval", "r", "slope"])
            yield pd.DataFrame({"kind": "bin", **blank, "bin": at, "n": hist[at]})
            yield pd.DataFrame({"kind": "best", **blank, "pid": ids, "vid": best_v, "r": best_r, "nom_pval": stats.corr_p(best_r, n - 2), "bin": None, "n": None})

        part = genotypes.select("vid", "vchr", "vstart", "gvals").mapInPandas(run, TRANS)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], TRANS)
    hits = parts.where("kind = 'hit'").select("pid", "pchr", "pstart", "vid", "vchr", "vpos", "nom_pval", "r", "slope")
    counts = parts.where("kind = 'bin'").groupBy("bin").agg(F.sum("n").alias("n"))
    edges = spark.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
    hist = edges.select("bin", (F.col("bin") * limit / bins).alias("r_lo"), ((F.col("bin") + 1) * limit / bins).alias("r_hi"), F.coalesce("n", F.lit(0)).alias("n"))
    top = F.max_by(F.struct("vid", "nom_pval", "r"), F.struct(F.col("r"), F.when(F.col("vid").isNull(), 0).otherwise(1)))
    best = parts.where("kind = 'best'").groupBy("pid").agg(top.alias("b")).select("pid", "b.vid", "b.nom_pval", F.col("b.r").alias("abs_r"))
    return hits, hist, best


def sampled_null(phenotypes: DataFrame, n: int = 1000, seed: int = 15112011) -> DataFrame:
    """``n`` phenotypes drawn with replacement, the samples of each shuffled on its own: input for a null pass.

    Draw k picks row ``hash(seed, k)`` of the phenotypes numbered by pid, so it doesn't depend on partitions.
    """
    total = phenotypes.count()
    numbered = phenotypes.select("pid", F.row_number().over(Window.orderBy("pid")).alias("_i")).withColumn("_i", F.col("_i") - 1)
    draws = phenotypes.sparkSession.range(n).select(F.col("id").alias("_draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))).alias("_i"))
    rows = draws.join(numbered, "_i").join(phenotypes, "pid")

    def shuffled(g: pd.DataFrame) -> pd.DataFrame:
        g["vals"] = [np.random.default_rng([seed, int(d)]).permutation(np.array(v, float)) for d, v in zip(g["_draw"], g["vals"], strict=True)]
        return g

    # a group is one draw: a batch of many rows could hold a large share of the table
    rows = rows.withColumn("vals", F.col("vals").cast("array<double>"))
    rows = rows.groupBy("_draw").applyInPandas(shuffled, rows.schema)
    return rows.withColumn("pid", F.concat("pid", F.lit("#"), F.col("_draw"))).drop("_draw", "_i")


def beta_null(p_values: DataFrame, column: str = "nom_pval", most: int = 1_000_000) -> tuple[float, float]:
    """Beta shapes of null p-values (at most ``most``, an error beyond); values outside 0 to 1 are an error."""
    got = np.array([r[0] for r in p_values.select(column).limit(most + 1).collect()], float)
    if got.size > most or got.size < 2 or (got < 0).any() or (got > 1).any():
        raise ValueError("null p-values: between 2 and a million, from 0 to 1")
    return stats.beta_fit(got)


def adjust(df: DataFrame, null: tuple[float, float], column: str = "nom_pval") -> DataFrame:
    return df.withColumn("adj_pval", columns.beta_p(F.col(column), F.lit(null[0]), F.lit(null[1])))


def gwas(p_long: DataFrame, genotypes: DataFrame, g_long: DataFrame) -> DataFrame:
    """Every phenotype with every variant: sums over shared samples, from an equi-join on the sample."""
    return pair_stats(p_long.join(g_long, "sample"), ["pid", "vid"])


def replicate(pairs: DataFrame, p_long: DataFrame, g_long: DataFrame) -> DataFrame:
    """The listed pairs only: (pid, vid); pairs with an unknown id drop out."""
    obs = pairs.select("pid", "vid").distinct().join(p_long, "pid").join(g_long, ["vid", "sample"])
    return pair_stats(obs, ["pid", "vid"])


def best_in_region(regions: DataFrame, phenotypes: DataFrame, genotypes: DataFrame) -> DataFrame:
    """The best variant of each (region, pid) among the region's variants, with its p-value: one task holds a region.

    ``regions``: (region, pid, vid). Ties go to the smallest id.
    """
    p = regions.select("region", "pid").distinct().join(phenotypes.select("pid", "vals"), "pid")
    g = regions.select(F.col("region").alias("vregion"), "vid").distinct().join(genotypes.select("vid", "gvals"), "vid")

    def kernel(key, pg: pd.DataFrame, gg: pd.DataFrame) -> pd.DataFrame:
        if not len(pg) or not len(gg):
            return pd.DataFrame([], columns=["region", "pid", "vid", "pval"])
        gg = gg.sort_values("vid")
        y, x = _block(pg, "vals"), _block(gg, "gvals")
        r = y @ x.T
        j = np.abs(r).argmax(axis=1)
        return pd.DataFrame({"region": key[0], "pid": pg["pid"].to_numpy(), "vid": gg["vid"].to_numpy()[j], "pval": stats.corr_p(r[np.arange(len(pg)), j], y.shape[1] - 2)})

    return p.groupBy("region").cogroup(g.groupBy("vregion")).applyInPandas(kernel, f"region {regions.schema['region'].dataType.simpleString()}, pid string, vid string, pval double")


def dataset_pairs(beds: list[str], qtls: list[str]) -> list[tuple[str, str]]:
    """Every file of phenotypes with every list of QTLs, but a dataset with its own list where both have equally many."""
    same = len(beds) == len(qtls) > 1
    return [(b, q) for i, b in enumerate(beds) for j, q in enumerate(qtls) if not (same and i == j)]
