"""Column functions: what Catalyst can say itself, and Arrow-batched kernels where it can't."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import stats


def corr_p(r: Column, df: Column) -> Column:
    """p-value of a correlation."""

    @F.pandas_udf("double")
    def kernel(r: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(stats.corr_p(r.to_numpy(float), df.to_numpy(float)))

    return kernel(r.cast("double"), df.cast("double"))


def beta_p(x: Column, a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def kernel(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(stats.betainc(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)))

    return kernel(x.cast("double"), a.cast("double"), b.cast("double"))


def normal_quantile(p: Column) -> Column:
    @F.pandas_udf("double")
    def kernel(p: pd.Series) -> pd.Series:
        return pd.Series(stats.qnorm(p.to_numpy(float)))

    return kernel(p.cast("double"))


def binomial_test(x: Column, n: Column, p: Column) -> Column:
    """Exact two-sided test."""

    @F.pandas_udf("double")
    def kernel(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([stats.binom_two_sided(int(a), int(b), c) for a, b, c in zip(x, n, p, strict=True)], dtype=float)

    return kernel(x.cast("long"), n.cast("long"), p.cast("double"))


def nominal_threshold(p: Column, shape1: Column, shape2: Column, dof1: Column, dof2: Column) -> Column:
    """The nominal p-value that corresponds to an adjusted one, by beta shapes and fitted degrees of freedom."""

    @F.pandas_udf("double")
    def kernel(p: pd.Series, a: pd.Series, b: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        p, a, b, d1, d2 = (x.to_numpy(float) for x in (p, a, b, d1, d2))
        r = stats.r_threshold(stats.qbeta(p, a, b), d2)
        return pd.Series(stats.corr_p(r, d1))

    return kernel(*(c.cast("double") for c in (p, shape1, shape2, dof1, dof2)))


def numeric(c: Column) -> Column:
    """Whether a token is a number."""
    return c.try_cast("double").isNotNull()


def complement(base: Column) -> Column:
    return F.translate(base, "ATGCatgc", "TACGtacg")


def base_of_code(code: Column) -> Column:
    """Nucleotide of a 4-bit code."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in {1: "A", 2: "C", 4: "G", 8: "T", 15: "N"}.items() for x in kv]), code.cast("int"))


def dosage(gt: Column) -> Column:
    """Alternative alleles of a genotype such as 0/1 or 1|1; null if one is missing."""
    parts = F.split(F.split(gt, ":")[0], r"[/|]")
    return parts[0].try_cast("int") + parts[1].try_cast("int")


def error_probability(quality: Column, illumina13: bool = False) -> Column:
    return F.pow(F.lit(10.0), -(F.greatest(quality - 31, F.lit(0)) if illumina13 else quality) / 10)


def cigar_blocks(cigar: Column, pos: Column) -> Column:
    """Contiguous aligned blocks of a read as array<struct<start, end>>: broken by N and D, S H I P don't move on."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), lambda o: F.struct(F.regexp_extract(o, r"\d+", 0).cast("long").alias("n"), F.substring(o, -1, 1).alias("op")))
    zero = F.struct(pos.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("blocks"), F.lit(False).alias("open"))

    def step(acc, o):
        moves = o.op.isin("M", "=", "X")
        last = F.element_at(acc.blocks, -1)
        grown = F.when(acc.open, F.concat(F.slice(acc.blocks, F.lit(1), F.greatest(F.size(acc.blocks) - 1, F.lit(0))), F.array(F.struct(last.start.alias("start"), (acc.at + o.n - 1).alias("end"))))).otherwise(F.concat(acc.blocks, F.array(F.struct(acc.at.alias("start"), (acc.at + o.n - 1).alias("end")))))
        gap = o.op.isin("N", "D")
        return F.struct(
            F.when(moves | gap, acc.at + o.n).otherwise(acc.at).alias("at"),
            F.when(moves, grown).otherwise(acc.blocks).alias("blocks"),
            F.when(moves, True).when(gap, False).otherwise(acc.open).alias("open"),
        )

    return F.aggregate(ops, zero, step).blocks


def mismatches(tags: Column) -> Column:
    """NM tag; 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(tags, r"NM:[iIcCsS]:(-?\d+)", 1), F.lit("")).cast("int"), F.lit(0))


def signed_distance(vstart: Column, vend: Column, pstart: Column, pend: Column, negative: Column) -> Column:
    """0 if they overlap, below 0 upstream, above downstream; mirrored on the negative strand."""
    d = F.when((vstart <= pend) & (pstart <= vend), 0).when(vend < pstart, vend - pstart).otherwise(vstart - pend)
    return (d * F.when(negative, -1).otherwise(1)).cast("long")


def region(text: str) -> dict:
    """chr, chr:pos or chr:a-b."""
    chrom, _, span = text.partition(":")
    a, _, b = span.replace(",", "").partition("-")
    return {"chr": chrom, "start": int(a) if a else 0, "end": int(b or a) if span else 1_000_000_000}


def in_region(chrom: Column, start: Column, end: Column, text: str) -> Column:
    r = region(text)
    return (chrom == r["chr"]) & (start <= r["end"]) & (end >= r["start"])
