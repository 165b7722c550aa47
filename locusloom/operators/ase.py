"""Allele-specific expression: site filters, reference-mapping bias, binomial tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns
from .intervals import range_join
from .reads import waterfall

BASES = ("A", "C", "G", "T")


def site_reason(blacklisted: Column, excluded: Column | None = None, absent: Column | None = None, genome: bool = False, auto_flip: bool = False, min_imp: float = 0.0, min_gp: float = 0.0) -> Column:
    """Why a variant (ref, alts array, gt, imp_qual, gp) is left out; the first reason in this order wins.

    VMA several alternatives; VU left out by the user; VCNIB chromosome without reads; VB blacklisted; VI no single base;
    VMRA allele missing; then, with ``genome`` (column ``genome``: the sequence's base, null beyond it), VNIF not in the
    sequence and VWR neither allele fits it (with ``auto_flip`` the alternative, or the complement of the reference, may);
    VBI low imputation score (variants without one stay); VMGT no genotype; VMG allele missing; VH homozygous;
    VBG low genotype probability (variants without one stay).
    """
    no, ref, alt = F.lit(False), F.col("ref"), F.element_at("alts", 1)
    missing = lambda x: x.isNull() | x.isin("N", "", ".")
    alleles = F.split("gt", r"[/|]")
    tests = [
        ("VMA", F.size("alts") > 1),
        ("VU", no if excluded is None else excluded),
        ("VCNIB", no if absent is None else absent),
        ("VB", blacklisted),
        ("VI", (F.length("ref") > 1) | (F.length(alt) > 1)),
        ("VMRA", missing(ref) | missing(alt)),
    ]
    if genome:
        fits = ref == F.col("genome")
        if auto_flip:
            fits = fits | (alt == F.col("genome")) | (columns.complement(ref) == F.col("genome"))
        tests += [("VNIF", F.col("genome").isNull()), ("VWR", ~fits)]
    return waterfall([
        *tests,
        ("VBI", F.coalesce(F.col("imp_qual") < min_imp, no) if min_imp > 0 else no),
        ("VMGT", F.col("gt").isNull()),
        ("VMG", F.array_contains(alleles, ".")),
        ("VH", F.element_at(alleles, 1) == F.element_at(alleles, -1)),
        ("VBG", F.coalesce(F.col("gp") < min_gp, no) if min_gp > 0 else no),
    ])


def sites(variants: DataFrame, blacklist: DataFrame | None = None, bin_size: int = 10_000, chromosomes: DataFrame | None = None, exclude: DataFrame | None = None, genome: bool = False, auto_flip: bool = False, **how) -> DataFrame:
    """Variants (chr, pos, id, ref, alts, gt, imp_qual, gp) with ``reason``, ``dup`` and ``notes``.

    ``chromosomes`` (chr) are those with reads, ``exclude`` (id) variants to leave out. Of passing ones at one position the
    first (by id) stays, the others get VD. ``dup`` marks those kept where the file has the position again, whatever
    became of the other variant (multi-allelic ones and those the user left out don't count).
    Missing ids become chr_pos_refalt. Notes of passing variants: VS alleles swapped, VF put on the other strand (``ref``
    and ``alts`` are changed so), VMI id was missing, VDK kept at a position that comes again.
    """
    no_id = F.col("id").isNull() | F.col("id").isin("", ".")
    v = variants.withColumn("_mi", no_id).withColumn("id", F.when(no_id, F.concat_ws("_", "chr", "pos", F.concat("ref", F.element_at("alts", 1)))).otherwise(F.col("id")))
    black, excluded, absent = F.lit(False), None, None
    if blacklist is not None:
        b = blacklist.select(F.col("chr").alias("bchr"), F.col("start").alias("bstart"), F.col("end").alias("bend"))
        spots = v.select(F.col("chr").alias("_vc"), F.col("pos").alias("_vp")).distinct()
        inside = range_join(spots, b, "_vc", F.col("_vp"), F.col("_vp"), "bchr", F.col("bstart"), F.col("bend"), bin_size, "left_semi").withColumn("_black", F.lit(True))
        v = v.join(inside, (F.col("chr") == F.col("_vc")) & (F.col("pos") == F.col("_vp")), "left").drop("_vc", "_vp")
        black = F.coalesce("_black", F.lit(False))
    if exclude is not None:
        v = v.join(exclude.select(F.col("id").alias("_xid")).distinct(), F.col("id") == F.col("_xid"), "left")
        excluded = F.col("_xid").isNotNull()
    if chromosomes is not None:
        v = v.join(chromosomes.select(F.col("chr").alias("_rc")).distinct(), F.col("chr") == F.col("_rc"), "left")
        absent = F.col("_rc").isNull()
    v = v.withColumn("reason", site_reason(black, excluded, absent, genome, auto_flip, **how)).drop("_black", "_xid", "_rc")
    passing, alt = F.col("reason") == "PASS", F.element_at("alts", 1)
    swap = flip = F.lit(False)
    if genome and auto_flip:
        swap = passing & (F.col("ref") != F.col("genome")) & (alt == F.col("genome"))
        flip = passing & (F.col("ref") != F.col("genome")) & ~(alt == F.col("genome"))
    v = v.withColumn("_swap", swap).withColumn("_flip", flip)
    v = v.withColumns({"ref": F.when(F.col("_swap"), alt).when(F.col("_flip"), columns.complement(F.col("ref"))).otherwise(F.col("ref")), "alts": F.when(F.col("_swap"), F.array("ref")).when(F.col("_flip"), F.array(columns.complement(alt))).otherwise(F.col("alts"))})
    again = F.count_if(~F.col("reason").isin("VMA", "VU")).over(Window.partitionBy("chr", "pos")) > 1
    v = v.withColumn("_k", F.row_number().over(Window.partitionBy("chr", "pos", "reason").orderBy("id"))).withColumn("dup", passing & (F.col("_k") == 1) & again).withColumn("reason", F.when(passing & (F.col("_k") > 1), "VD").otherwise(F.col("reason")))
    notes = F.array_compact(F.array(F.when(F.col("_swap"), "VS"), F.when(F.col("_flip"), "VF"), F.when(F.col("_mi"), "VMI"), F.when(F.col("dup"), "VDK")))
    return v.withColumn("notes", F.when(F.col("reason") == "PASS", notes).otherwise(F.array().cast("array<string>"))).drop("_k", "_mi", "_swap", "_flip")


def orient(df: DataFrame, genome: str = "genome") -> DataFrame:
    """Fit alleles to the genome's base: swap where the alternative is it, take complements where the complement of the reference is it."""
    g, r, a = F.col(genome), F.col("ref"), F.col("alt")
    kind = F.when(r == g, "match").when(a == g, "swap").when(columns.complement(r) == g, "flip").when(columns.complement(a) == g, "flip_swap").otherwise("mismatch")
    ref = F.when(kind == "swap", a).when(kind == "flip", columns.complement(r)).when(kind == "flip_swap", columns.complement(a)).otherwise(r)
    alt = F.when(kind == "swap", r).when(kind == "flip", columns.complement(a)).when(kind == "flip_swap", columns.complement(r)).otherwise(a)
    return df.select(*[c for c in df.columns if c not in ("ref", "alt")], ref.alias("ref"), alt.alias("alt"), kind.alias("orientation"))


def concerns(df: DataFrame, max_depth: int = 65536) -> DataFrame:
    """Counts with total, minor allele ratio and the list of concerns, in a fixed order."""
    total = F.col("ref_count") + F.col("alt_count")
    seen_ref, seen_alt = F.col("ref_count") > 0, F.col("alt_count") > 0
    d = df.withColumn("total", total).withColumn("mar", F.when(total > 0, F.least("ref_count", "alt_count") / total).otherwise(0.0))
    parts = [
        F.when(F.col("dup"), "DP") if "dup" in df.columns else F.lit(None),
        F.when((F.col("total") == 0), "NRA").when(F.col("other_count") > 0, F.concat(F.lit("DA"), F.when(F.col("other_count") > F.col("alt_count"), ",MDTA").otherwise(""), F.when(F.col("other_count") > F.col("ref_count"), ",MDTR").otherwise(""))),
        F.when((F.col("total") > 0) & ~(seen_ref & seen_alt), "BANS").when((F.col("total") > 0) & (F.col("mar") < 0.02), "LMAR"),
        F.when(F.col("depth") > max_depth, "PD") if "depth" in df.columns else F.lit(None),
    ]
    joined = F.concat_ws(",", *parts)
    return d.withColumn("concern", F.when(joined == "", "PASS").otherwise(joined))


def reference_bias(df: DataFrame, min_sites: int = 200, quantile: float = 0.75, min_cov: int = 10, both_seen: bool = True, drop_other: bool = True, seed: int = 15112011) -> DataFrame:
    """Share of reference reads for each allele pair (ref, alt, ref_count, alt_count, other_count): ref, alt, n, bias, pooled.

    A pair with at least ``min_sites`` has its own ratio, others the ratio of all together. Sites deeper than the
    quantile of their set are thinned to it by a seeded binomial draw, so a few deep sites don't decide.
    """
    total = F.col("ref_count") + F.col("alt_count")
    ok = df.withColumn("total", total).where(F.col("total") >= min_cov)
    if both_seen:
        ok = ok.where("ref_count > 0 and alt_count > 0")
    if drop_other:
        ok = ok.where("other_count <= ref_count and other_count <= alt_count")

    @F.pandas_udf("double")
    def draw(ref: pd.Series, total: pd.Series, cap: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([float(np.random.default_rng(int(k) & (2**63 - 1)).binomial(int(c), r / t)) for r, t, c, k in zip(ref, total, cap, key, strict=True)], dtype=float)

    def ratio(d: DataFrame, keys: list[str]) -> DataFrame:
        rank = F.greatest(F.floor(F.count("*") * quantile) - 1, F.lit(0))
        # exact order statistic from counts by depth, which are few
        depth = d.groupBy(*keys, "total").agg(F.count("*").alias("_m"))
        w = Window.partitionBy(*keys).orderBy("total") if keys else Window.orderBy("total")
        upto = depth.withColumn("_c", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        size = d.groupBy(*keys).agg(rank.alias("_rank"), F.count("*").alias("n"))
        joined = upto.join(size, keys) if keys else upto.crossJoin(size)
        caps = joined.where(F.col("_c") > F.col("_rank")).groupBy(*keys).agg(F.min("total").alias("_cap"), F.first("n").alias("n"))
        each = d.join(caps, keys) if keys else d.crossJoin(F.broadcast(caps))
        over = F.col("total") > F.col("_cap")
        key = F.xxhash64(F.lit(seed), *[F.col(c) for c in d.columns])
        each = each.withColumn("_r", F.when(over, draw("ref_count", "total", "_cap", key)).otherwise(F.col("ref_count").cast("double"))).withColumn("_t", F.when(over, F.col("_cap")).otherwise(F.col("total")))
        return each.groupBy(*keys).agg((F.sum("_r") / F.sum("_t")).alias("bias"), F.first("n").alias("n"))

    own = ratio(ok, ["ref", "alt"])
    pooled = ratio(ok, []).select(F.col("bias").alias("_pool"))
    enough = F.col("n") >= min_sites
    return own.crossJoin(F.broadcast(pooled)).select("ref", "alt", "n", F.when(enough, F.col("bias")).otherwise(F.col("_pool")).alias("bias"), (~enough).alias("pooled"))


def test_sites(df: DataFrame, bias: DataFrame | None = None, min_cov: int = 16, max_p: float | None = None) -> DataFrame:
    """Sites with total >= ``min_cov``: expected reference share, weighted counts, allelic ratio, exact p-value."""
    d = df.withColumn("total", F.col("ref_count") + F.col("alt_count")).where(F.col("total") >= min_cov)
    if bias is not None:  # twelve allele pairs at most
        d = d.join(F.broadcast(bias.select("ref", "alt", F.col("bias").alias("_b"))), ["ref", "alt"], "left").withColumn("bias", F.coalesce("_b", F.lit(0.5))).drop("_b")
    else:
        d = d.withColumn("bias", F.lit(0.5))
    w_ref, w_alt = F.col("ref_count") * (1 - F.col("bias")), F.col("alt_count") * F.col("bias")
    d = d.withColumn("weighted_ref", w_ref).withColumn("weighted_alt", w_alt).withColumn("ref_ratio", F.col("ref_count") / F.col("total")).withColumn("effect", F.abs(0.5 - w_ref / F.nullif(w_ref + w_alt, F.lit(0.0))))
    d = d.withColumn("pval", columns.binomial_test(F.col("ref_count"), F.col("total"), F.col("bias")))
    return d if max_p is None else d.where(F.col("pval") <= max_p)


def annotate(df: DataFrame, exons: DataFrame, bin_size: int = 10_000) -> DataFrame:
    """Sites (chr, pos, id) with the labels of the exons (chr, start, end, label) that hold them, joined by ;."""
    e = exons.select(F.col("chr").alias("echr"), F.col("start").alias("estart"), F.col("end").alias("eend"), "label")
    hit = range_join(df.select("chr", "pos", "id"), e, "chr", F.col("pos"), F.col("pos"), "echr", F.col("estart"), F.col("eend"), bin_size)
    labels = hit.groupBy("chr", "pos", "id").agg(F.array_join(F.array_sort(F.collect_set("label")), ";").alias("exons"))
    return df.join(labels, ["chr", "pos", "id"], "left").withColumn("exons", F.coalesce("exons", F.lit("NA")))


def fix_chromosomes(df: DataFrame, known: DataFrame, chrom: str = "chr") -> DataFrame:
    """Chromosome names brought to those of ``known`` (chr): as they are, with or without a leading chr; else null."""
    names = known.select(F.col(chrom).alias("_k")).distinct()
    mine = df.select(F.col(chrom).alias("_c")).distinct()
    options = mine.select("_c", F.posexplode(F.array(F.col("_c"), F.concat(F.lit("chr"), "_c"), F.regexp_replace("_c", "^chr", ""))).alias("_o", "_k"))
    best = options.join(names, "_k", "left_semi").groupBy("_c").agg(F.min_by("_k", "_o").alias("_k"))  # one row for each name
    return df.join(F.broadcast(best), F.col(chrom) == F.col("_c"), "left").withColumn(chrom, F.col("_k")).drop("_c", "_k")
