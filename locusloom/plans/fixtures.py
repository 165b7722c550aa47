"""The driver's star-schema tables seen as domain data: embeddings as a sample x feature matrix, parts as intervals,
line items as reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """sample, dim, v, label, chr, st, en."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("d", "x"))
    d = F.col("d").cast("long")
    return e.select("sample", d.alias("dim"), F.col("x").cast("double").alias("v"), "label", F.concat(F.lit("c"), d % 2).alias("chr"), ((d % 16) * 1000 + 1).alias("st"), ((d % 16) * 1000 + (d % 3) * 400 + 1).alias("en"))


def p_long(spark, sf) -> DataFrame:
    return cells(spark, sf).where("dim < 16").select(F.col("dim").alias("pid"), "sample", F.col("v").alias("pv"))


def g_long(spark, sf) -> DataFrame:
    return cells(spark, sf).where("dim >= 16").select(F.col("dim").alias("vid"), "sample", F.col("v").alias("gv"))


def _loci(spark, low: int, high: int) -> DataFrame:
    d = F.col("id")
    return spark.range(low, high).select(d, F.concat(F.lit("c"), d % 2).alias("chr"), ((d % 16) * 1000 + 1).alias("start"), ((d % 16) * 1000 + (d % 3) * 400 + 1).alias("end"))


def phenotypes(spark) -> DataFrame:
    return _loci(spark, 0, 16).select(F.col("id").alias("pid"), "chr", "start", "end", (F.col("id") % 4 == 3).alias("neg"))


def variants(spark) -> DataFrame:
    return _loci(spark, 16, 64).select(F.col("id").alias("vid"), F.col("chr").alias("vchr"), F.col("start").alias("vstart"), F.col("end").alias("vend"))


def wide(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Phenotypes and genotypes as arrays; ids are strings, groups are pairs of phenotypes."""
    rows = cells(spark, sf).groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "v"))), lambda x: x.v).alias("vals"))
    p = phenotypes(spark).join(rows, F.col("pid") == F.col("dim"))
    p = p.select(F.format_string("p%02d", "pid").alias("pid"), F.format_string("g%02d", F.floor(F.col("pid") / 2).cast("long")).alias("grp"), "chr", "start", "end", "neg", "vals")
    g = variants(spark).join(rows, F.col("vid") == F.col("dim")).select(F.format_string("v%02d", "vid").alias("vid"), "vchr", "vstart", "vend", F.col("vals").alias("gvals"))
    return p, g


def parts(spark, sf) -> DataFrame:
    """Intervals: id, chr, start, end, size, kind."""
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chr"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + F.col("p_size")).alias("end"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"))


def reads(spark, sf) -> DataFrame:
    """Line items as reads: qname, flag, chr, pos, mapq, cigar, seq, tags."""
    li = table(spark, sf, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    bit = lambda cond, b: F.when(cond, b).otherwise(0)
    flag = 1 + bit((k + n) % 7 != 0, 2) + bit((k * 3 + n) % 11 == 0, 4) + bit((k + 2 * n) % 13 == 0, 8) + bit(n % 2 == 0, 16) + bit((n + k % 5) % 2 == 1, 32) + bit(n % 2 == 1, 64) + bit(n % 2 == 0, 128) + bit((k + n) % 17 == 0, 256) + bit((k + n) % 19 == 0, 512) + bit((k + n) % 23 == 0, 1024)
    return li.select(k.alias("qname"), flag.cast("int").alias("flag"), F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_quantity").cast("int").alias("mapq"), F.when(n % 3 == 0, "5M2N5M").when(n % 3 == 1, "2S10M").otherwise("4M1D6M").alias("cigar"), F.lit("ACGTACGTAC").alias("seq"), F.concat(F.lit("NM:i:"), F.col("l_linenumber")).alias("tags"))
