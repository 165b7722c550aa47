"""Aligned reads: filter waterfalls, pile-ups, quality metrics, expression counts, sample matching.

Reads: qname, flag, chr, pos, mapq, cigar, mchr, mpos, isize, seq, qual, tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns
from .intervals import range_join

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def has(bit: int, flag: Column | None = None) -> Column:
    return (F.col("flag") if flag is None else flag).bitwiseAND(bit) != 0


def waterfall(tests: list[tuple[str, Column]], passed: str = "PASS") -> Column:
    """The name of the first test that holds."""
    out = F.lit(passed)
    for name, test in reversed(tests):
        out = F.when(test, name).otherwise(out)
    return out


def stat_reason(min_mapq: int = 10, keep_duplicates: bool = False) -> Column:
    """Why a read is left out of the alignment statistics."""
    paired = has(PAIRED)
    tests = [("UNMAPPED", has(UNMAPPED)), ("SECONDARY", has(SECONDARY)), ("QCFAIL", has(FAILED))]
    if not keep_duplicates:
        tests.append(("DUPLICATE", has(DUPLICATE)))
    tests += [("NOT_PROPER", paired & ~has(PROPER)), ("MATE_UNMAPPED", paired & has(MATE_UNMAPPED)), ("SAME_STRAND", paired & (has(REVERSE) == has(MATE_REVERSE))), ("MAPQ", F.col("mapq") < min_mapq)]
    return waterfall(tests)


def quant_reason(min_mapq: int = 10, max_mismatch: float | None = None, proper: bool = False, keep_failed: bool = False, keep_duplicates: bool = False) -> Column:
    """Why a read is left out of quantification; a mismatch limit below 1 is a share of the read's length."""
    tests = [("SECD", has(SECONDARY) | has(SUPPLEMENTARY)), ("UNMAP", has(UNMAPPED) | (has(PAIRED) & has(MATE_UNMAPPED)))]
    if not keep_failed:
        tests.append(("FAILQC", has(FAILED)))
    if not keep_duplicates:
        tests.append(("DUP", has(DUPLICATE)))
    tests.append(("MAPQ", F.col("mapq") < min_mapq))
    if proper:
        tests.append(("NPP", has(PAIRED) & ~has(PROPER)))
    if max_mismatch is not None:
        tests.append(("MISM", columns.mismatches(F.col("tags")) > (max_mismatch if max_mismatch >= 1 else F.length("seq") * max_mismatch)))
    return waterfall(tests)


def pileup_reason(min_mapq: int = 10, keep_duplicates: bool = False, keep_failed: bool = False, keep_orphans: bool = False, proper: bool = True) -> Column:
    """Why a read is left out of a pile-up."""
    paired = has(PAIRED)
    tests = [("UNMAPPED", has(UNMAPPED)), ("SECONDARY", has(SECONDARY)), ("SUPPLEMENTARY", has(SUPPLEMENTARY))]
    if not keep_failed:
        tests.append(("QCFAIL", has(FAILED)))
    if not keep_duplicates:
        tests.append(("DUPLICATE", has(DUPLICATE)))
    if not keep_orphans:
        tests += [("ORPHAN", paired & has(MATE_UNMAPPED)), ("ORIENTATION", paired & (has(REVERSE) == has(MATE_REVERSE)))]
    if proper:
        tests.append(("NOT_PROPER", paired & ~has(PROPER)))
    return waterfall([*tests, ("MAPQ", F.col("mapq") < min_mapq)])


def flags_pass(bad: int, pair_bad: int = 0, pair_needs: int = 0, strands: bool = False) -> Column:
    """Whether a read has no bit of ``bad`` and, if paired, none of ``pair_bad``, all of ``pair_needs`` and, with
    ``strands``, another strand than its mate; true without a flag.

    The flag is named once: a filter takes in the expression behind it as often as it is named, and code that grows too
    large for the JVM's compiler is an order of magnitude slower.
    """
    mask = bad | pair_bad | pair_needs | PAIRED | ((REVERSE | MATE_REVERSE) if strands else 0)

    def ok(f: int) -> bool:
        pair = not f & pair_bad and f & pair_needs == pair_needs and not (strands and bool(f & REVERSE) == bool(f & MATE_REVERSE))
        return not f & bad and (pair or not f & PAIRED)

    return F.coalesce(F.col("flag").bitwiseAND(mask).isin([f for f in range(mask + 1) if f & ~mask == 0 and ok(f)]), F.lit(True))


def stat_passes(min_mapq: int = 10, keep_duplicates: bool = False) -> Column:
    """Whether ``stat_reason`` is PASS."""
    flags = flags_pass(UNMAPPED | SECONDARY | FAILED | (0 if keep_duplicates else DUPLICATE), MATE_UNMAPPED, PROPER, True)
    return flags & F.coalesce(F.col("mapq") >= min_mapq, F.lit(True))


def quant_passes(min_mapq: int = 10, max_mismatch: float | None = None, proper: bool = False, keep_failed: bool = False, keep_duplicates: bool = False) -> Column:
    """Whether ``quant_reason`` is PASS."""
    bad = SECONDARY | SUPPLEMENTARY | UNMAPPED | (0 if keep_failed else FAILED) | (0 if keep_duplicates else DUPLICATE)
    out = flags_pass(bad, MATE_UNMAPPED, PROPER if proper else 0) & F.coalesce(F.col("mapq") >= min_mapq, F.lit(True))
    if max_mismatch is not None:
        out = out & F.coalesce(columns.mismatches(F.col("tags")) <= (max_mismatch if max_mismatch >= 1 else F.length("seq") * max_mismatch), F.lit(True))
    return out


def pileup_passes(min_mapq: int = 10, keep_duplicates: bool = False, keep_failed: bool = False, keep_orphans: bool = False, proper: bool = True) -> Column:
    """Whether ``pileup_reason`` is PASS."""
    bad = UNMAPPED | SECONDARY | SUPPLEMENTARY | (0 if keep_failed else FAILED) | (0 if keep_duplicates else DUPLICATE)
    flags = flags_pass(bad, 0 if keep_orphans else MATE_UNMAPPED, PROPER if proper else 0, not keep_orphans)
    return flags & F.coalesce(F.col("mapq") >= min_mapq, F.lit(True))


def count_reasons(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def alignment_stats(reads: DataFrame, annotations: DataFrame, min_mapq: int = 10, keep_duplicates: bool = False, bin_size: int = 100_000) -> DataFrame:
    """total, kept, overlap_reads, n_annot, covered_annot: one row.

    Of paired reads only names seen exactly twice go on to the overlaps; read 1 and read 2 count once each.
    """
    kept = stat_passes(min_mapq, keep_duplicates)
    totals = reads.agg(F.count("*").alias("total"), F.count_if(kept).alias("kept"))
    named = reads.where(kept).select("qname", "flag", "chr", "pos", "cigar").withColumn("_n", F.count("*").over(Window.partitionBy("qname", has(PAIRED))))
    alive = named.where(~has(PAIRED) | (F.col("_n") == 2))
    blocks = alive.select("qname", (has(SECOND)).alias("second"), F.col("chr").alias("bchr"), F.explode(columns.cigar_blocks(F.col("cigar"), F.col("pos"))).alias("b")).select("qname", "second", "bchr", F.col("b.start").alias("bstart"), F.col("b.end").alias("bend"))
    a = annotations.select(F.monotonically_increasing_id().alias("aid"), "chr", "start", "end") if "aid" not in annotations.columns else annotations.select("aid", "chr", "start", "end")
    hits = range_join(blocks, a, "bchr", F.col("bstart"), F.col("bend"), "chr", F.col("start"), F.col("end"), bin_size)
    found = hits.agg(F.count_distinct(F.struct("qname", "second")).alias("overlap_reads"), F.count_distinct("aid").alias("covered_annot"))
    n = annotations.agg(F.count("*").alias("n_annot"))
    return totals.crossJoin(n).crossJoin(found).select("total", "kept", "overlap_reads", "n_annot", "covered_annot")  # one row each


def pileup(reads: DataFrame, sites: DataFrame, min_baseq: int = 10, min_mapq: int = 10, bin_size: int = 1000, **how) -> DataFrame:
    """Bases of passing reads over sites (schr, spos, ref, alt, ...): one row for each site and read that covers it.

    base and qual are null where the read has a deletion or skips the site.
    """
    kept = reads.where(pileup_passes(min_mapq, **how))
    # query offset of each aligned block
    ops = F.regexp_extract_all("cigar", F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    zero = F.struct(F.lit(1).cast("long").alias("q"), F.col("pos").cast("long").alias("r"), F.array().cast("array<struct<start:bigint,end:bigint,q:bigint>>").alias("out"))

    def step(acc, o):
        n, op = F.regexp_extract(o, r"\d+", 0).cast("long"), F.substring(o, -1, 1)
        aligned, query, ref = op.isin("M", "=", "X"), op.isin("M", "=", "X", "I", "S"), op.isin("M", "=", "X", "D", "N")
        q = F.when(aligned, acc.q).otherwise(F.lit(None).cast("long"))
        return F.struct(F.when(query, acc.q + n).otherwise(acc.q).alias("q"), F.when(ref, acc.r + n).otherwise(acc.r).alias("r"), F.when(ref, F.concat(acc.out, F.array(F.struct(acc.r.alias("start"), (acc.r + n - 1).alias("end"), q.alias("q"))))).otherwise(acc.out).alias("out"))

    blocks = kept.select("qname", "flag", F.col("chr").alias("bchr"), "seq", F.col("qual").alias("quals"), F.explode(F.aggregate(ops, zero, step).out).alias("b")).select("qname", "flag", "bchr", "seq", "quals", F.col("b.start").alias("bstart"), F.col("b.end").alias("bend"), F.col("b.q").alias("q"))
    hits = range_join(blocks, sites, "bchr", F.col("bstart"), F.col("bend"), "schr", F.col("spos"), F.col("spos"), bin_size)
    at = (F.col("q") + F.col("spos") - F.col("bstart")).cast("int")
    out = hits.withColumn("base", F.when(F.col("q").isNotNull(), F.substr("seq", at, F.lit(1)))).withColumn("baseq", F.when(F.col("q").isNotNull(), F.ascii(F.substr("quals", at, F.lit(1))) - 33))
    return out.where(F.col("baseq").isNull() | (F.col("baseq") >= min_baseq)).drop("seq", "quals", "bstart", "bend", "q", "bchr")


def allele_counts(bases: DataFrame, by: list[str]) -> DataFrame:
    """ref_count, alt_count, other_count, depth, alleles_seen and expected errors of each site, from (ref, alt, base, baseq)."""
    known = F.col("base").isNotNull() & (F.col("base") != "N")
    return bases.groupBy(*by).agg(
        F.count_if(known & (F.col("base") == F.col("ref"))).alias("ref_count"),
        F.count_if(known & (F.col("base") == F.col("alt"))).alias("alt_count"),
        F.count_if(known & (F.col("base") != F.col("ref")) & (F.col("base") != F.col("alt"))).alias("other_count"),
        F.count("*").alias("depth"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("base")))), ",").alias("alleles_seen"),
        F.coalesce(F.sum(F.when(known, columns.error_probability(F.col("baseq")))), F.lit(0.0)).alias("expected_errors"),
    )


def match_samples(counts: DataFrame, genotypes: DataFrame, min_cov: int = 10, ase_p: float = 0.05) -> DataFrame:
    """How well each sample's genotypes (site, sample, dosage) agree with a pile-up (site, ref_count, alt_count)."""
    j = genotypes.join(counts, "site", "left").withColumn("_ref", F.coalesce("ref_count", F.lit(0))).withColumn("_alt", F.coalesce("alt_count", F.lit(0)))
    hom, het, covered = F.col("dosage").isin(0, 2), F.col("dosage") == 1, (F.col("_ref") + F.col("_alt")) >= min_cov
    j = j.withColumn("_p", F.when(het & covered, columns.binomial_test(F.col("_ref"), F.col("_ref") + F.col("_alt"), F.lit(0.5))))
    fit_hom, fit_het = (F.col("_ref") == 0) | (F.col("_alt") == 0), (F.col("_ref") > 0) & (F.col("_alt") > 0)
    out = j.groupBy("sample").agg(
        F.count_if(F.col("dosage").isNull()).alias("n_missing"),
        F.count_if(het).alias("n_het"),
        F.count_if(hom).alias("n_hom"),
        F.count_if(het & covered).alias("n_het_covered"),
        F.count_if(hom & covered).alias("n_hom_covered"),
        F.count_if(het & covered & fit_het).alias("n_het_consistent"),
        F.count_if(hom & covered & fit_hom).alias("n_hom_consistent"),
        F.count_if(het & covered & fit_het & (F.col("_p") < ase_p)).alias("n_het_in_ase"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(float("nan")))
    return out.withColumn("perc_het_consistent", share("n_het_consistent", "n_het_covered")).withColumn("perc_hom_consistent", share("n_hom_consistent", "n_hom_covered"))


def genes_of(exons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(genes, exons): overlapping exons of a gene (gene_id, chr, start, end, strand) merged, and each gene's extent,
    exonic length and start of transcription."""
    w = Window.partitionBy("gene_id").orderBy("start", "end")
    top = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = exons.withColumn("_new", F.when(top.isNull() | (F.col("start") > top), 1).otherwise(0)).withColumn("_k", F.sum("_new").over(w))
    merged = merged.groupBy("gene_id", "_k").agg(F.min("chr").alias("chr"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand")).drop("_k")
    genes = merged.groupBy("gene_id").agg(F.min("chr").alias("chr"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("strand").alias("strand"), F.sum(F.col("end") - F.col("start") + 1).alias("length"))
    genes = genes.withColumn("tss", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")))
    return genes, merged.withColumn("exon_id", F.concat_ws("_", "gene_id", "start", "end"))


def quantify(reads: DataFrame, exons: DataFrame, bin_size: int = 100_000, consistent: bool = False, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gene counts, exon counts, statistics) of read pairs over merged exons (gene_id, exon_id, chr, start, end).

    A pair counts for a gene if each mate overlaps one of its exons (with ``consistent``: each aligned block does). A
    mate gives an exon (half the exonic bases that both mates cover + the other exonic bases) / all exonic bases that
    the mate has in the gene. Pairs need equal chromosomes, first mate forward, second reverse, not before the first.
    """
    marked = reads.withColumn("reason", quant_reason(**how))
    name, fwd = Window.partitionBy("qname"), ~F.col("rev")
    ok = reads.where(quant_passes(**how)).select("qname", has(REVERSE).alias("rev"), F.col("chr").alias("bchr"), "pos", "cigar")
    ok = ok.withColumns({"_n": F.count("*").over(name), "_rev": F.count_if("rev").over(name), "_one": F.min("bchr").over(name) == F.max("bchr").over(name), "_fwd": F.min(F.when(fwd, F.col("pos"))).over(name), "_bwd": F.min(F.when(F.col("rev"), F.col("pos"))).over(name)})
    pairs = ok.where("_n = 2 and _rev = 1 and _one and _bwd >= _fwd")
    all_blocks = columns.cigar_blocks(F.col("cigar"), F.col("pos"))
    pairs = pairs.withColumn("_b", all_blocks).withColumn("n_blocks", F.sum(F.size("_b")).over(name))
    blocks = pairs.select("qname", "rev", "bchr", "n_blocks", F.posexplode("_b").alias("k", "b")).select("qname", "rev", "bchr", "n_blocks", "k", F.col("b.start").alias("bs"), F.col("b.end").alias("be"))
    e = exons.select("gene_id", "exon_id", F.col("chr").alias("echr"), F.col("start").alias("es"), F.col("end").alias("ee"))
    hit = range_join(blocks, e, "bchr", F.col("bs"), F.col("be"), "echr", F.col("es"), F.col("ee"), bin_size)
    seg = F.struct("rev", "exon_id", "k", F.greatest("bs", "es").alias("lo"), F.least("be", "ee").alias("hi"))
    # a pair's segments in one gene: as many as its blocks meet exons
    per = hit.groupBy("qname", "gene_id").agg(F.collect_list(seg).alias("segs"), F.first("n_blocks").alias("n_blocks"))
    per = per.where(F.exists("segs", lambda s: s.rev) & F.exists("segs", lambda s: ~s.rev))
    if consistent:
        per = per.where(F.size(F.array_distinct(F.transform("segs", lambda s: F.struct(s.rev, s.k)))) == F.col("n_blocks"))
    length = lambda s: s.hi - s.lo + 1
    zero = F.lit(0).cast("long")
    shared = lambda s: F.aggregate(F.filter("segs", lambda t: (t.rev != s.rev) & (t.exon_id == s.exon_id)), zero, lambda n, t: n + F.greatest(F.least(s.hi, t.hi) - F.greatest(s.lo, t.lo) + 1, zero))
    whole = lambda s: F.aggregate(F.filter("segs", lambda t: t.rev == s.rev), zero, lambda n, t: n + length(t))
    per = per.select("qname", "gene_id", F.explode(F.transform("segs", lambda s: F.struct(s.exon_id.alias("exon_id"), ((length(s) - 0.5 * shared(s)) / whole(s)).alias("weight")))).alias("w")).select("qname", "gene_id", "w.exon_id", "w.weight")
    exon_counts = per.groupBy("gene_id", "exon_id").agg(F.sum("weight").alias("read_count"))
    gene_counts = per.groupBy("gene_id").agg(F.sum("weight").alias("read_count"))
    names = marked.groupBy("reason").agg(F.count("*").alias("n")).select(F.col("reason").alias("stat"), F.col("n").cast("double").alias("value"))
    more = per.agg((2 * F.count_distinct("qname")).cast("double").alias("exonicint"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("exonic_multi")).selectExpr("stack(2, 'exonicint', exonicint, 'exonic_multi', exonic_multi) as (stat, value)")
    lonely = ok.agg(F.count_if(F.col("_n") != 2).cast("double").alias("value")).select(F.lit("unmatched").alias("stat"), "value")
    return gene_counts, exon_counts, names.unionByName(more).unionByName(lonely)


def rates(counts: DataFrame, lengths: DataFrame, key: str, exonic: Column | None = None) -> DataFrame:
    """rpkm and tpm of counts (key, read_count) with lengths (key, length); every key of ``lengths`` has a row."""
    df = lengths.select(key, "length").join(counts.select(key, "read_count"), key, "left").withColumn("read_count", F.coalesce("read_count", F.lit(0.0)))
    df = df.withColumn("_rpk", F.col("read_count") * 1000 / F.col("length"))
    sums = df.agg(F.sum("read_count").alias("_n"), F.sum("_rpk").alias("_t"))
    out = df.join(F.broadcast(sums))
    return out.withColumn("rpkm", F.col("_rpk") * 1e6 / (F.col("_n") if exonic is None else exonic)).withColumn("tpm", F.col("_rpk") * 1e6 / F.col("_t")).drop("_rpk", "_n", "_t")
