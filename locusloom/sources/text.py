"""Readers of tab- or space-separated domain files (plain, gz or bz2), as DataFrames.

Headers are read on the driver; rows are split by Spark. Starts are 1-based closed in all results (BED starts + 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns


def fields(spark: SparkSession, path: str, comment: str | None = "#") -> DataFrame:
    """One array ``c`` of tokens for each line; runs of blanks or tabs separate."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    if comment:
        rows = rows.where(~F.col("value").startswith(comment))
    return rows.select(F.split(F.trim(F.regexp_replace("value", "\r$", "")), r"[ \t]+").alias("c"))


def _numbers(from_: int) -> Column:
    return F.transform(F.slice("c", F.lit(from_), F.greatest(F.size("c") - (from_ - 1), F.lit(0))), lambda x: F.when(x != "NA", x.try_cast("double")))


def header(spark: SparkSession, path: str, starts: str = "#") -> list[str]:
    row = spark.read.text(path).where(F.col("value").startswith(starts)).first()
    if row is None:
        raise ValueError(f"{path} has no header line that starts with {starts}")
    return row["value"].rstrip("\r\n").split()


def _subset(df: DataFrame, name: str, samples: list[str], want: list[str] | None) -> DataFrame:
    """Array columns in the order of the wanted samples."""
    if want is None or want == samples:
        return df
    missing = [s for s in want if s not in samples]
    if missing:
        raise ValueError(f"samples not in the file: {missing[:5]}")
    at = F.array(*[F.lit(samples.index(s)) for s in want])
    return df.withColumn(name, F.transform(at, lambda i: F.col(name)[i]))


def bed_samples(spark: SparkSession, path: str) -> list[str]:
    return header(spark, path)[6:]


def bed(spark: SparkSession, path: str, samples: list[str] | None = None, values: bool = True) -> DataFrame:
    """Phenotype matrix: pid, grp, chr, start, end, neg, vals; without values the annotation only."""
    rows = fields(spark, path)
    out = rows.select(F.col("c")[3].alias("pid"), F.col("c")[4].alias("grp"), F.col("c")[0].alias("chr"), (F.col("c")[1].cast("long") + 1).alias("start"), F.col("c")[2].cast("long").alias("end"), (F.col("c")[5] == "-").alias("neg"), *([_numbers(7).alias("vals")] if values else []))
    return _subset(out, "vals", bed_samples(spark, path), samples) if values else out


def bed_genotypes(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """A matrix in the same layout as variants: vid, vchr, vstart, vend, gvals."""
    return bed(spark, path, samples).select(F.col("pid").alias("vid"), F.col("chr").alias("vchr"), F.col("start").alias("vstart"), F.col("end").alias("vend"), F.col("vals").alias("gvals"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    return header(spark, path, "#CHROM")[9:]


def vcf(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """All records: vid, vchr, vstart, vend, ref, alts, qual, info, has_ds, has_gt, gt, gvals (DS, else the GT's sum), phased.

    bgzip files are gzip to Spark, so one task each: convert large ones to parquet once.
    """
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", "\t").alias("c"))
    keys = F.split(F.col("c")[8], ":")
    ds, gt = F.array_position(keys, "DS").cast("int"), F.array_position(keys, "GT").cast("int")
    calls = F.slice("c", F.lit(10), F.greatest(F.size("c") - 9, F.lit(0)))
    part = lambda x, i: F.get(F.split(x, ":"), i - 1)
    out = rows.select(
        F.when(F.col("c")[2] == ".", F.concat_ws("_", F.col("c")[0], F.col("c")[1], F.concat(F.col("c")[3], F.col("c")[4]))).otherwise(F.col("c")[2]).alias("vid"),
        F.col("c")[0].alias("vchr"),
        F.col("c")[1].cast("long").alias("vstart"),
        F.coalesce(F.nullif(F.regexp_extract(F.col("c")[7], r"(?:^|;)END=(\d+)", 1), F.lit("")).cast("long"), F.col("c")[1].cast("long") + F.length(F.col("c")[3]) - 1).alias("vend"),
        F.col("c")[3].alias("ref"),
        F.split(F.col("c")[4], ",").alias("alts"),
        F.col("c")[5].alias("qual"),
        F.col("c")[7].alias("info"),
        (ds > 0).alias("has_ds"),
        (gt > 0).alias("has_gt"),
        F.when(gt > 0, F.transform(calls, lambda x: part(x, gt))).alias("gt"),
        F.when(ds > 0, F.transform(calls, lambda x: part(x, ds).try_cast("double"))).when(gt > 0, F.transform(calls, lambda x: columns.dosage(part(x, gt)).cast("double"))).alias("gvals"),
        F.when(gt > 0, F.forall(F.transform(calls, lambda x: part(x, gt)), lambda g: g.contains("|"))).alias("phased"),
    )
    names = vcf_samples(spark, path)
    return _subset(_subset(out, "gvals", names, samples), "gt", names, samples)


def usable(variants: DataFrame) -> DataFrame:
    """Bi-allelic records with DS or GT."""
    return variants.where((F.size("alts") == 1) & (F.col("has_ds") | F.col("has_gt")))


def haplotypes(variants: DataFrame) -> DataFrame:
    """Phased records as (id, hap): two booleans for each sample."""
    alleles = F.flatten(F.transform("gt", lambda g: F.transform(F.split(g, r"\|"), lambda a: a == "1")))
    return variants.where("phased").select(F.col("vid").alias("id"), alleles.alias("hap"))


def covariates(spark: SparkSession, path: str, samples: list[str]) -> list[list[str]]:
    """Rows of text, one for each covariate, in sample order; small by nature."""
    read = spark.read.text(path).limit(100_001).collect()
    if len(read) > 100_000:
        raise ValueError(f"more than 100000 lines of covariates in {path}")
    lines = [r["value"].split() for r in read if r["value"].strip()]
    at = {s: i for i, s in enumerate(lines[0]) if i}
    missing = [s for s in samples if s not in at]
    if missing:
        raise ValueError(f"samples without covariates: {missing[:5]}")
    return [[row[at[s]] for s in samples] for row in lines[1:]]


def ids(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    return fields(spark, path).select(F.col("c")[0].alias(name)).distinct()


def positions(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path).select(F.col("c")[0].alias("chr"), F.col("c")[1].cast("long").alias("pos")).distinct()


def pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("pid", "vid")) -> DataFrame:
    return fields(spark, path).select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)])


def thresholds(spark: SparkSession, path: str, required: DataFrame | None = None) -> DataFrame:
    """(pid, threshold), -1 for NA; an error if a required phenotype (pid) has none."""
    out = fields(spark, path).select(F.col("c")[0].alias("pid"), F.coalesce(F.col("c")[1].try_cast("double"), F.lit(-1.0)).alias("threshold"))
    if required is not None and (lost := required.join(out, "pid", "left_anti").select("pid").take(1)):
        raise ValueError(f"no threshold for {lost[0][0]}")
    return out


def intervals(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path).select(F.col("c")[0].alias("chr"), (F.col("c")[1].cast("long") + 1).alias("start"), F.col("c")[2].cast("long").alias("end"))


def anchors(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path).select(F.col("c")[3].alias("anchor_id"), F.col("c")[0].alias("chr"), (F.col("c")[1].cast("long") + 1).alias("pos"), (F.col("c")[5] == "-").alias("neg"))


def qtl_points(spark: SparkSession, path: str, anchors_: DataFrame) -> DataFrame:
    """qtl_id, anchor_id, chr, pos (the middle of the raw interval); one for each known anchor."""
    out = fields(spark, path).select(F.col("c")[3].alias("qtl_id"), F.col("c")[4].alias("anchor_id"), F.col("c")[0].alias("chr"), F.floor((F.col("c")[1].cast("long") + F.col("c")[2].cast("long")) / 2).alias("pos"))
    if bad := out.groupBy("anchor_id").count().where("count > 1").take(1):
        raise ValueError(f"several QTLs for {bad[0][0]}")
    if bad := out.join(anchors_, "anchor_id", "left_anti").take(1):
        raise ValueError(f"unknown anchor {bad[0]['anchor_id']}")
    return out


def hotspots(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path).select(F.col("c")[0].alias("chr"), F.col("c")[1].cast("long").alias("start0"), F.col("c")[2].cast("long").alias("end"))


def null_p(spark: SparkSession, path: str) -> DataFrame:
    """Third column as nom_pval, from 0 to 1."""
    out = fields(spark, path).select(F.col("c")[2].try_cast("double").alias("nom_pval"))
    if out.where("nom_pval is null or nom_pval < 0 or nom_pval > 1").take(1):
        raise ValueError(f"{path}: a null p-value is not a number from 0 to 1")
    return out


def qtl_results(spark: SparkSession, path: str, pheno: int = 1, geno: int = 8, rank: int | None = None, best: int | None = None, group: int | None = None) -> DataFrame:
    """pid, vid, rank, grp by column number (from 1); fillers and rows that aren't best are dropped. Files of joined hits are recognised."""
    rows = fields(spark, path)
    joined = F.col("c")[0] == "__UNION__"
    at = lambda i: F.get("c", F.lit(i - 1)) if i else F.lit(None).cast("string")
    out = rows.select(
        F.when(joined, F.col("c")[1]).otherwise(at(pheno)).alias("pid"),
        F.when(joined, F.col("c")[2]).otherwise(at(geno)).alias("vid"),
        F.when(joined, F.col("c")[3]).otherwise(at(rank)).try_cast("int").alias("rank"),
        F.when(joined, F.lit("1")).otherwise(F.coalesce(at(best), F.lit("1"))).alias("_best"),
        F.coalesce(at(group), at(pheno)).alias("grp"),
    )
    return out.where((F.col("_best") == "1") & ~F.col("vid").startswith("__UNION_FILLER")).drop("_best")


def gtf(spark: SparkSession, path: str, gene_types: list[str] | None = None) -> DataFrame:
    """Exons: gene_id, gene_name, gene_type, transcript_id, transcript_type, chr, start, end, strand, label."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c")).where(F.col("c")[2] == "exon")
    get = lambda k: F.nullif(F.regexp_extract(F.col("c")[8], k + r' "?([^";]+)', 1), F.lit(""))
    out = rows.select(get("gene_id").alias("gene_id"), get("gene_name").alias("gene_name"), F.coalesce(get("gene_type"), get("gene_biotype")).alias("gene_type"), get("transcript_id").alias("transcript_id"), get("transcript_type").alias("transcript_type"), F.col("c")[0].alias("chr"), F.col("c")[3].cast("long").alias("start"), F.col("c")[4].cast("long").alias("end"), F.col("c")[6].alias("strand"))
    if gene_types:
        out = out.where(F.col("gene_type").isin(gene_types) & (F.col("transcript_type").isNull() | F.col("transcript_type").isin(gene_types)))
    return out.withColumn("label", F.concat_ws(":", "gene_id", "transcript_id", F.concat_ws("_", "start", "end"), F.coalesce("gene_name", "gene_id")))


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """Upper-cased sequence as (chr, chunk, seq): position p is character p - chunk * size of chunk (p - 1) div size.

    A whole file is a row of text split at ``>``, so a chromosome is read by one task and memory is one chromosome.
    """
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    out = rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chr"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"\s", "")).alias("_s"))
    return out.select("chr", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("_s"), F.lit(1)) - 1) / chunk).cast("int"))).alias("chunk"), "_s").select("chr", "chunk", F.substr("_s", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("seq"))


def genome_base(df: DataFrame, genome: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Column ``genome``: the reference base at (chr, pos)."""
    g = genome.select(F.col("chr").alias("_c"), F.col("chunk").alias("_k"), "seq")
    at = F.floor((F.col("pos") - 1) / chunk)
    return df.join(g, (F.col("chr") == F.col("_c")) & (at == F.col("_k")), "left").withColumn("genome", F.substr("seq", (F.col("pos") - at * chunk).cast("int"), F.lit(1))).drop("_c", "_k", "seq")


def sam(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c"))
    c = F.col("c")
    return rows.select(c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("chr"), c[3].cast("long").alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"), F.when(c[6] == "=", c[2]).otherwise(c[6]).alias("mchr"), c[7].cast("long").alias("mpos"), c[8].cast("long").alias("isize"), c[9].alias("seq"), c[10].alias("qual"), F.array_join(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), "\t").alias("tags"))


def write_bed(df: DataFrame, path: str, samples: list[str]) -> None:
    """The layout that :func:`bed` reads; sorted by position inside each file, one header line in each."""
    head = "#" + "\t".join(["chr", "start", "end", "pid", "gid", "strand", *samples])
    vals = F.array_join(F.transform("vals", lambda v: F.coalesce(v.cast("string"), F.lit("NA"))), "\t")
    line = F.concat_ws("\t", "chr", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), "pid", "grp", F.when(F.col("neg"), "-").otherwise("+"), vals)
    rows = df.repartitionByRange("chr", "start").sortWithinPartitions("chr", "start").select(line.alias("value"))
    _with_header(rows, head).write.text(path)


def write_vcf(df: DataFrame, path: str, samples: list[str]) -> None:
    """Variants (vid, vchr, vstart, ref, alts, gvals) as VCF text with a DS field; a header in each part file."""
    head = "##fileformat=VCFv4.2\n" + '##FORMAT=<ID=DS,Number=1,Type=Float,Description="Dosage">\n' + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])
    calls = F.array_join(F.transform("gvals", lambda v: F.coalesce(v.cast("string"), F.lit("."))), "\t")
    line = F.concat_ws("\t", "vchr", F.col("vstart").cast("string"), "vid", "ref", F.array_join("alts", ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("DS"), calls)
    _with_header(df.repartitionByRange("vchr", "vstart").sortWithinPartitions("vchr", "vstart").select(line.alias("value")), head).write.text(path)


def _with_header(rows: DataFrame, head: str) -> DataFrame:
    """The header before the lines of each partition that has some."""

    def run(batches):
        import pandas as pd

        first = True
        for b in batches:
            if first and len(b):
                yield pd.DataFrame({"value": head.split("\n")})
                first = False
            yield b

    return rows.mapInPandas(run, "value string")


def write_table(df: DataFrame, path: str, sep: str = " ", header_: bool = True) -> None:
    """Result tables as text, NA for missing; arrays joined by commas."""
    flat = [F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(f"`{c}`").cast("string").alias(c) for c, kind in df.dtypes]
    df.select(*flat).write.option("sep", sep).option("nullValue", "NA").option("emptyValue", "").option("header", str(header_).lower()).csv(path)


def sniff(path: str) -> str:
    """Format by extension."""
    p = path.lower().removesuffix(".gz").removesuffix(".bz2").removesuffix(".bgz")
    for end, kind in ((".vcf", "vcf"), (".bcf", "bcf"), (".bed", "bed"), (".sam", "sam"), (".bam", "bam"), (".gtf", "gtf"), (".fa", "fasta"), (".fasta", "fasta"), (".parquet", "parquet")):
        if p.endswith(end):
            return kind
    raise ValueError(f"unknown format: {path}")
