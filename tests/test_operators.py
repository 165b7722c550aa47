"""Operators on small hand-made tables."""

import gzip
import random
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from locusloom.functions import columns, stats
from locusloom.operators import ase, association, coloc, enrichment, fdr, intervals, matrix, reads
from locusloom.sources import bam, text


def test_binned_join_equals_the_plain_one(spark):
    r = random.Random(1)
    a = [(i, f"c{r.randrange(3)}", s := r.randrange(1000), s + r.randrange(60)) for i in range(200)]
    b = [(i, f"c{r.randrange(3)}", s := r.randrange(1000), s + r.randrange(60)) for i in range(200)]
    da, db = spark.createDataFrame(a, "i int, ca string, s long, e long"), spark.createDataFrame(b, "j int, cb string, t long, f long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and y[2] <= x[3] + 7 and x[2] - 7 <= y[3])
    for size in (5, 40, 5000):
        got = intervals.range_join(da, db, "ca", F.col("s") - 7, F.col("e") + 7, "cb", F.col("t"), F.col("f"), size)
        assert sorted((x["i"], x["j"]) for x in got.collect()) == want
        plan = got._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    semi = {x["i"] for x in intervals.range_join(da, db, "ca", F.col("s"), F.col("e"), "cb", F.col("t"), F.col("f"), 30, "left_semi").collect()}
    anti = {x["i"] for x in intervals.range_join(da, db, "ca", F.col("s"), F.col("e"), "cb", F.col("t"), F.col("f"), 30, "left_anti").collect()}
    assert semi | anti == set(range(200)) and not semi & anti


def test_merge_and_tile(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 8), ("a", 9, 9), ("b", 1, 2)], "chr string, start long, end long")
    assert sorted(map(tuple, intervals.merge(df).collect())) == [("a", 1, 8, 2), ("a", 9, 9, 1), ("b", 1, 2, 1)]
    assert sorted(map(tuple, intervals.merge(df, adjacent=True).collect())) == [("a", 1, 9, 3), ("b", 1, 2, 1)]
    t = intervals.tile(spark.createDataFrame([("a", 10, 20), ("a", 30, 40)], "chr string, start0 long, end long")).orderBy("idx").collect()
    assert [tuple(x) for x in t] == [(0, "a", 0, 10, "CS"), (1, "a", 11, 20, "HS"), (2, "a", 21, 30, "CS"), (3, "a", 31, 40, "HS"), (4, "a", 41, 2147483647, "CS")]


def wide(spark, n=60, seed=1):
    r = np.random.default_rng(seed)
    g = r.integers(0, 3, (6, n)).astype(float)
    y = r.normal(size=(4, n))
    y[0] += 1.5 * g[1]
    y[1] += 1.2 * g[1] + 1.2 * g[4]
    p = [(f"p{i}", f"g{i // 2}", "c", 100 * i + 1, 100 * i + 1, False, v.tolist()) for i, v in enumerate(y)]
    v = [(f"v{i}", "c", 50 * i + 1, 50 * i + 1, x.tolist()) for i, x in enumerate(g)]
    return spark.createDataFrame(p, "pid string, grp string, chr string, start long, end long, neg boolean, vals array<double>"), spark.createDataFrame(v, "vid string, vchr string, vstart long, vend long, gvals array<double>"), y, g


def test_permutation_pass(spark):
    p, g, y, x = wide(spark)
    rows = {r["grp"]: r for r in association.cis_permute(p, g, 1000, 100).collect()}
    r = stats.unit(y) @ stats.unit(x).T
    assert (rows["g0"]["pid"], rows["g0"]["vid"]) in {("p0", "v1"), ("p1", "v1"), ("p1", "v4")}
    assert abs(rows["g0"]["r_squared"] - (r[:2] ** 2).max()) < 1e-9
    assert rows["g0"]["adj_emp_pval"] == 1 / 101 and rows["g0"]["adj_beta_pval"] < 0.01 < rows["g1"]["adj_beta_pval"]
    again = {x["grp"]: x for x in association.cis_permute(p.repartition(3), g.repartition(5), 1000, 100).collect()}
    assert again == rows  # draws don't depend on partitions
    far = p.withColumn("chr", F.lit("z"))
    assert [x["vid"] for x in association.cis_permute(far, g, 10, 10).collect()] == [None, None]


def test_conditional_pass_finds_both_signals(spark):
    p, g, _, _ = wide(spark, 200)
    rows = association.cis_conditional(p.where("pid = 'p1'"), g, p.select("pid", F.lit(1e-6).alias("threshold")), 1000).collect()
    assert {(r["rank"], r["vid"]) for r in rows if r["bwd_best_hit"]} in ({(0, "v1"), (1, "v4")}, {(0, "v4"), (1, "v1")})


def test_trans_equals_the_whole_product(spark):
    p, g, y, x = wide(spark)
    hits, hist, best = association.trans(p, g, -1, 0.05, 10)
    r = stats.unit(x) @ stats.unit(y).T
    pv = stats.corr_p(r, 58)
    assert {(h["vid"], h["pid"]) for h in hits.collect()} == {(f"v{i}", f"p{j}") for i, j in zip(*np.nonzero(pv <= 0.05))}
    assert sum(h["n"] for h in hist.collect()) == int((pv > 0.05).sum())
    assert all(abs(b["abs_r"] - np.abs(r[:, int(b["pid"][1])]).max()) < 1e-12 for b in best.collect())


def test_fdr(spark):
    df = spark.createDataFrame([(x,) for x in (0.01, 0.02, 0.02, 0.5, 0.9)], "p double")
    assert [round(r["qval"], 6) for r in fdr.q_values(df, "p").orderBy("p").collect()] == [round(x, 6) for x in (0.2 / 6, 0.2 / 6, 0.2 / 6, 0.625, 0.9)]


def test_pca_and_collapse(spark):
    p, _, y, _ = wide(spark)
    scores, info = matrix.pca(p.select("vals"))
    z = y - y.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(z.T, full_matrices=False)
    got = np.array([r["scores"] for r in scores.orderBy("pc").collect()])
    assert np.allclose(np.abs(got), np.abs(u * s).T, atol=1e-8)
    assert np.allclose([r["sd"] for r in info.orderBy("pc").collect()], s / np.sqrt(59))
    one = {r["grp"]: r for r in matrix.collapse(p, "mean").collect()}
    assert np.allclose(one["g0"]["vals"], y[:2].mean(axis=0)) and one["g0"]["n_phe"] == 2


def test_components_hold_the_smaller_side_only(spark, monkeypatch):
    """Many samples of few features go through in chunks, and no samples x samples matrix is made; nor the other way about."""
    rng, shapes, eigh = np.random.default_rng(5), [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: (shapes.append(m.shape), eigh(m))[1])
    monkeypatch.setattr(matrix, "CHUNK", 70)
    for features, samples in ((4, 300), (30, 6)):
        y = rng.normal(size=(features, samples))
        y[2] = y[1]
        rows = [y[i].tolist() for i in range(features)] + [[1.0] * samples]
        scores, info = matrix.pca(spark.createDataFrame([(r,) for r in rows], "vals array<double>"), scale=True)
        z = (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, ddof=1, keepdims=True)
        u, s, _ = np.linalg.svd(z.T, full_matrices=False)
        info, got = info.orderBy("pc").collect(), np.array([r["scores"] for r in scores.orderBy("pc").collect()])
        assert len(info) == len(got) == min(features, samples) and shapes[-1] == (min(features, samples),) * 2
        assert np.allclose([r["sd"] for r in info], s / np.sqrt(samples - 1), atol=1e-7)
        assert np.allclose(np.abs(got)[s > 1e-6], np.abs(u * s).T[s > 1e-6], atol=1e-8)


def test_density_at_the_ends_of_the_window(spark):
    """An annotation that begins at the very end of the window is in no bin, on either strand; one at its start is."""
    a = spark.createDataFrame([(1, "c", 1000, False), (2, "c", 5000, True)], "anchor_id long, chr string, pos long, neg boolean")
    b = spark.createDataFrame([("c", 1200, 1210), ("c", 4790, 4800), ("c", 795, 800)], "chr string, start long, end long")
    got = {r["from"]: r["n"] for r in intervals.density(a, b, 200, 25).collect()}
    assert got == {f: int(f == -200) for f in range(-200, 200, 25)}


def test_other_signals_are_counted_without_lists(spark):
    w = spark.createDataFrame([(1, "c", 100), (2, "c", 500), (3, "d", 100)], "gwas_vid long, chr string, gpos long")
    q = spark.createDataFrame([(10, 7, "c", 90, 95), (11, 7, "c", 480, 470), (11, 7, "c", 130, 130), (12, 7, "d", 9, 9), (13, 8, "c", 120, 110), (None, 7, "c", 101, 101)], "qtl_vid long, pid long, qchr string, qpos long, ppos long")
    listed = coloc.colocated(w, q, 40).select("gwas_vid", "qtl_vid", F.size("others").alias("n"))
    counted = coloc.colocated(w, q, 40, listed=False)
    assert sorted(map(str, listed.collect())) == sorted(map(str, counted.select("gwas_vid", "qtl_vid", F.col("n_others").alias("n")).collect()))
    assert listed.count() == 5 and "collect_set" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_filters_of_reads_name_the_flag_once_and_agree_with_reasons(spark):
    df = spark.range(4096).select(F.col("id").cast("int").alias("flag")).union(spark.createDataFrame([(None,)], "flag int"))
    df = df.crossJoin(spark.createDataFrame([(9, "NM:i:4"), (10, "NM:i:2"), (None, "")], "mapq int, tags string")).withColumn("seq", F.lit("ACGTACGTAC"))
    several = [
        (reads.stat_reason, reads.stat_passes, [{}, {"keep_duplicates": True}]),
        (reads.quant_reason, reads.quant_passes, [{}, {"proper": True, "max_mismatch": 3}, {"max_mismatch": 0.3}, {"keep_failed": True, "keep_duplicates": True}]),
        (reads.pileup_reason, reads.pileup_passes, [{}, {"keep_orphans": True}, {"proper": False, "keep_failed": True}, {"keep_duplicates": True}]),
    ]
    cases = [(why(**how) == "PASS", passes(**how)) for why, passes, hows in several for how in hows]
    got = df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(f"d{i}") for i, (a, b) in enumerate(cases)], *[F.count_if(b).alias(f"n{i}") for i, (_, b) in enumerate(cases)]).first().asDict()
    assert all(got[f"d{i}"] == 0 and got[f"n{i}"] for i in range(len(cases)))
    kept = df.where(reads.quant_passes())._jdf.queryExecution().optimizedPlan().toString()
    assert kept.split("Filter ")[1].split("\n")[0].count("id#") == 1


def test_blocks_bound_trans_passes_and_change_nothing(spark, monkeypatch):
    """Rows are multiplied in blocks of bounded bytes, one at a time if need be; draws don't depend on blocks."""
    p, g, _, _ = wide(spark)
    plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    run = lambda: [sorted(map(plain, df.collect())) for df in association.trans(association.sampled_null(p, 5), g, -1, 0.3, 7)]
    want = run()
    monkeypatch.setattr(association, "BLOCK_BYTES", 1)
    assert run() == want
    assert association.sampled_null(p, 5)._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1


def test_permutations_go_in_blocks_of_bounded_bytes(spark, monkeypatch):
    """One at a time, if rows are long; the draws and results are the same."""
    p, g, _, _ = wide(spark)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    run = lambda: sorted(map(plain, association.cis_permute(p, g, 100, 70).collect()))
    want = run()
    monkeypatch.setattr(association, "BLOCK_BYTES", 1)
    assert run() == want and any(r[4] for r in want)


def test_matched_draws_are_places_in_a_bin(spark):
    """The draws are those of the bins' lists, but the lists are not carried to each of them."""
    bins = spark.createDataFrame([(0, ["a", "b"], ["n1", "n2", "n3"]), (4, ["c"], ["n4", "n5", "n6", "n7"])], "bin long, qtls array<string>, nulls array<string>")
    hits = spark.createDataFrame([("n1",), ("n6",), ("n6",), ("c",)], "id string")
    draw = F.element_at("nulls", (F.pmod(F.xxhash64(F.lit(3), "k", "q"), F.size("nulls").cast("long")) + 1).cast("int"))
    want = bins.select("nulls", F.explode("qtls").alias("q")).crossJoin(spark.range(50).withColumnRenamed("id", "k")).select(draw.alias("id")).where("id in ('n1', 'n6')").count()
    out = enrichment.matched_enrichment(bins, hits, 3, 50, 3)
    assert abs(out.first()["null_mean"] - want / 50) < 1e-12 and out.first()["obs"] == 1
    assert "element_at(nulls" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_thin(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 5, 11, 14, 22)] + [("b", 3)], "chr string, pos long")
    assert sorted(map(tuple, matrix.thin(df, 10).collect())) == [("a", 1), ("a", 11), ("a", 22), ("b", 3)]


def test_cigar(spark):
    df = spark.createDataFrame([("3S5M2I4M10N6M2D1M4H", 100)], "cigar string, pos long")
    assert [tuple(b) for b in df.select(columns.cigar_blocks(F.col("cigar"), F.col("pos")).alias("b")).first()["b"]] == [(100, 108), (119, 124), (127, 127)]


READ = "qname string, flag int, chr string, pos long, mapq int, cigar string, mchr string, mpos long, isize long, seq string, qual string, tags string"


def read(name, flag, pos, cigar, seq="A" * 60):
    return (name, flag, "c", pos, 60, cigar, "c", pos, 0, seq, "I" * 60, "NM:i:0")


def test_quantification_of_a_split_pair(spark):
    exons = spark.createDataFrame([("g", "c", 1, 100, "+"), ("g", "c", 201, 300, "+"), ("h", "c", 251, 400, "+")], "gene_id string, chr string, start long, end long, strand string")
    rows = [read("a", 99, 81, "20M100N30M"), read("a", 147, 211, "50M"), read("b", 99, 500, "50M"), read("b", 147, 520, "50M"), read("lone", 99, 10, "50M")]
    genes, per_exon, stat = reads.quantify(spark.createDataFrame(rows, READ), reads.genes_of(exons)[1], bin_size=50)
    g = {r["gene_id"]: r["read_count"] for r in genes.collect()}
    # first mate: 20 bases of exon 1 and 30 of exon 2, 20 of them shared with the mate, which has 50 in exon 2
    assert abs(g["g"] - ((20 + 10 + 10) / 50 + (10 + 30) / 50)) < 1e-9
    assert "h" not in g  # the first mate misses it
    e = {r["exon_id"]: r["read_count"] for r in per_exon.collect()}
    assert abs(e["g_1_100"] - 0.4) < 1e-9 and abs(e["g_201_300"] - 1.2) < 1e-9
    s = {r["stat"]: r["value"] for r in stat.collect()}
    assert s["unmatched"] == 1 and s["exonicint"] == 2


def test_pileup(spark):
    rows = [read("a", 99, 10, "5M2D5M", "ACGTACGTAC"), read("b", 99, 12, "2S8M", "TTACGTACGT")]
    sites = spark.createDataFrame([("c", 12, "G", "A"), ("c", 15, "A", "C"), ("c", 18, "G", "T")], "schr string, spos long, ref string, alt string")
    bases = reads.pileup(spark.createDataFrame(rows, READ).withColumn("flag", F.lit(99)), sites, bin_size=7)
    got = {(r["qname"], r["spos"]): r["base"] for r in bases.collect()}
    assert got == {("a", 12): "G", ("a", 15): None, ("a", 18): "G", ("b", 12): "A", ("b", 15): "T", ("b", 18): "G"}


def test_reference_bias_and_tests(spark):
    df = spark.createDataFrame([("A", "G", 10, 10, 0)] * 5 + [("C", "T", 30, 10, 0)] * 3, "ref string, alt string, ref_count long, alt_count long, other_count long").withColumn("s", F.monotonically_increasing_id())
    bias = {(r["ref"], r["alt"]): r for r in ase.reference_bias(df, min_sites=4, quantile=1.0).collect()}
    assert bias["A", "G"]["bias"] == 0.5 and not bias["A", "G"]["pooled"] and bias["C", "T"]["pooled"]
    p = ase.test_sites(df).select("ref", "pval").distinct().collect()
    assert {r["ref"]: round(r["pval"], 6) for r in p} == {"A": 1.0, "C": round(stats.binom_two_sided(30, 40, 0.5), 6)}


def test_rtc_of_the_same_and_of_a_perfect_proxy():
    r = np.random.default_rng(5)
    g = r.normal(size=(20, 80))
    g[3] = g[2] + 1e-6 * r.normal(size=80)
    y = g[2] + 0.3 * r.normal(size=80)
    assert coloc.rtc_score(y, g, 2, 2) == 1.0 and coloc.rtc_score(y, g, 3, 2) >= 0.95
    assert coloc.rtc_score(y, g, 10, 2) < 0.9


def test_enrichment_counts(spark):
    null = spark.createDataFrame([(i % 10,) for i in range(1000)], "n long")
    r = enrichment.empirical(null, F.lit(8.0), F.lit(20.0)).first()
    assert abs(r["p"] - (2 * 200 + 1) / 1001) < 1e-12


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.bed").write_text("#chr\tstart\tend\tpid\tgid\tstrand\ts1\ts2\nc\t9\t20\tp\tg\t-\t1.5\tNA\n")
    df = text.bed(spark, str(tmp_path / "p.bed"), ["s2", "s1"])
    r = df.first()
    assert (r["start"], r["end"], r["neg"], r["vals"]) == (10, 20, True, [None, 1.5])
    text.write_bed(df, str(tmp_path / "out"), ["s2", "s1"])
    assert text.bed(spark, str(tmp_path / "out")).first() == r
    with gzip.open(tmp_path / "g.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\nc\t5\t.\tA\tG\t.\t.\t.\tGT:DS\t0|1:0.9\t1|1:2\nc\t7\tm\tA\tG,T\t.\t.\tEND=9\tGT\t0|1\t./.\n")
    v = text.vcf(spark, str(tmp_path / "g.vcf.gz"), ["b", "a"]).orderBy("vstart").collect()
    assert (v[0]["vid"], v[0]["gvals"], v[0]["phased"]) == ("c_5_AG", [2.0, 0.9], True) and (v[1]["vend"], v[1]["gvals"]) == (9, [None, 1.0])
    assert text.usable(text.vcf(spark, str(tmp_path / "g.vcf.gz"))).count() == 1
    (tmp_path / "x.fa").write_text(">c one\nacg\nTA\n>d\nGG\n")
    fa = text.fasta(spark, str(tmp_path / "x.fa"), 2)
    at = spark.createDataFrame([("c", 3), ("c", 5), ("d", 2)], "chr string, pos long")
    assert [r["genome"] for r in text.genome_base(at, fa, 2).orderBy("chr", "pos").collect()] == ["G", "A", "G"]
    (tmp_path / "x.gtf").write_text('c\t.\texon\t1\t9\t.\t+\t.\tgene_id "G"; transcript_id "T"; gene_name "N"; gene_type "pc";\nc\t.\tgene\t1\t9\t.\t+\t.\tgene_id "G";\n')
    assert text.gtf(spark, str(tmp_path / "x.gtf")).first()["label"] == "G:T:1_9:N"


def bam_bytes(n: int) -> bytes:
    """A small BAM file of plain reads, in several blocks."""
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 10000)
    for i in range(n):
        name, seq = f"r{i}".encode() + b"\0", bytes([0x12, 0x48])
        tag = b"NMC" + bytes([i % 5])
        rec = struct.pack("<iiBBHHHiiii", 0, i, len(name), 60, 0, 1, 99, 4, 0, i, 0) + name + struct.pack("<I", 4 << 4) + seq + bytes([30, 31, 32, 33]) + tag
        body += struct.pack("<i", len(rec)) + rec
    out = b""
    for a in range(0, len(body), 700):
        part = body[a : a + 700]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        d = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(d) + 25) + d + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_bam_in_one_range_and_in_many(spark, tmp_path):
    path = tmp_path / "x.bam"
    path.write_bytes(bam_bytes(300))
    bam.register(spark)
    for split in (1 << 20, 900):
        rows = spark.read.format("bam").option("path", str(path)).option("split", split).load().orderBy("pos").collect()
        assert [r["qname"] for r in rows] == [f"r{i}" for i in range(300)]
        assert (rows[7]["pos"], rows[7]["cigar"], rows[7]["seq"], rows[7]["qual"], rows[7]["tags"]) == (8, "4M", "ACGT", "?@AB", "NM:i:2")


def test_targeted_covariates_best_in_region_and_vcf_writer(spark, tmp_path):
    p, g, y, x = wide(spark)
    own = spark.createDataFrame([("p0", x[1].tolist())], "pid string, cov array<double>")
    out = {r["pid"]: np.array(r["vals"]) for r in matrix.residualise_targeted(p, [], own).collect()}
    assert np.allclose(out["p0"], stats.regress_out(y[[0]], x[1])[0]) and np.allclose(out["p2"], y[2])
    regions = spark.createDataFrame([(0, "p0", f"v{i}") for i in range(6)], "region long, pid string, vid string")
    assert association.best_in_region(regions, p, g).first()["vid"] == "v1"
    assert association.dataset_pairs(["a", "b"], ["c", "d"]) == [("a", "d"), ("b", "c")] and association.dataset_pairs(["a"], ["c"]) == [("a", "c")]
    names = [f"s{i}" for i in range(60)]
    text.write_vcf(g.selectExpr("vid", "vchr", "vstart", "'A' as ref", "array('G') as alts", "gvals"), str(tmp_path / "out"), names)
    back = {r["vid"]: r["gvals"] for r in text.vcf(spark, str(tmp_path / "out")).collect()}
    assert back == {f"v{i}": v.tolist() for i, v in enumerate(x)}


def test_semi_and_anti_joins_keep_repeated_rows_and_nulls(spark):
    left = spark.createDataFrame([(1, "c", 5, None), (1, "c", 5, None), (2, "c", 50, "x"), (3, "c", None, "x"), (4, None, 5, None), (5, "d", 5, None)], "id int, chr string, pos long, note string")
    right = spark.createDataFrame([("c", 1, 9), ("c", 4, 60_000), (None, 1, 9)], "rc string, s long, e long")
    join = lambda how: sorted(x["id"] for x in intervals.range_join(left, right.where("e < 10"), "chr", F.col("pos"), F.col("pos"), "rc", F.col("s"), F.col("e"), 4, how).collect())
    assert join("left_semi") == [1, 1] and join("left_anti") == [2, 3, 4, 5]
    both = intervals.range_join(left, right, "chr", F.col("pos"), F.col("pos"), "rc", F.col("s"), F.col("e"), 1000, "left_semi")
    assert both.columns == left.columns and both.count() == 3


def test_odds_ratios_divide_like_doubles(spark):
    null = spark.createDataFrame([(float(x),) for x in (0, 0, 10, 10)], "n double")
    got = enrichment.empirical(null, F.lit(5.0), F.lit(10.0)).first()
    assert got["or_q025"] == float("inf") and got["or_q975"] == 0.0
    got = enrichment.empirical(null, F.lit(0.0), F.lit(10.0)).first()
    assert np.isnan(got["or_q025"]) and got["or_q975"] == 0.0


def test_nearest_anchor_is_that_of_brute_force(spark):
    r = random.Random(9)
    points = [(i, f"c{r.randrange(2)}", r.randrange(200)) for i in range(150)]
    anchors = [(100 + i, f"c{r.randrange(3)}", r.randrange(200)) for i in range(12)]
    got = intervals.nearest(spark.createDataFrame(points, "id int, chr string, pos long"), spark.createDataFrame(anchors, "anchor_id int, chr string, pos long")).collect()
    assert len(got) == 150
    for x in got:
        own = [p for _, c, p in anchors if c == x["chr"]]
        assert x["before_pos"] == max((p for p in own if p <= x["pos"]), default=None)
        assert x["after_pos"] == min((p for p in own if p > x["pos"]), default=None)


def test_site_reasons_come_in_their_order(spark):
    rows = [("c1", i, None if i == 1 else f"v{i}", *x) for i, x in enumerate([
        ("A", ["C", "G"], "0|1", None, None, "A"), ("A", ["C"], "0|1", None, None, "A"), ("AT", ["C"], "0|1", None, None, "A"), ("N", ["C"], "0|1", None, None, "A"), ("A", ["C"], "0|1", None, None, None),
        ("A", ["C"], "0|1", None, None, "G"), ("A", ["C"], "0|1", None, None, "C"), ("A", ["C"], "0|1", None, None, "T"), ("A", ["C"], "0|1", 0.1, None, "A"), ("A", ["C"], None, 0.9, None, "A"),
        ("A", ["C"], "./1", 0.9, None, "A"), ("A", ["C"], "1/1", 0.9, 0.1, "A"), ("A", ["C"], "0|1", 0.9, 0.1, "A"), ("A", ["C"], "0|1", 0.9, 0.9, "A")])]
    v = spark.createDataFrame(rows, "chr string, pos int, id string, ref string, alts array<string>, gt string, imp_qual double, gp double, genome string")
    got = {x["pos"]: x for x in ase.sites(v, genome=True, auto_flip=True, min_imp=0.5, min_gp=0.5).collect()}
    assert [got[i]["reason"] for i in range(14)] == ["VMA", "PASS", "VI", "VMRA", "VNIF", "VWR", "PASS", "PASS", "VBI", "VMGT", "VMG", "VH", "VBG", "PASS"]
    assert got[1]["id"] == "c1_1_AC" and got[1]["notes"] == ["VMI"]
    assert (got[6]["ref"], got[6]["alts"], got[6]["notes"]) == ("C", ["A"], ["VS"]) and (got[7]["ref"], got[7]["alts"], got[7]["notes"]) == ("T", ["G"], ["VF"])
    assert ase.sites(v, genome=True).where("reason = 'VWR'").count() == 3 and ase.sites(v).where("reason = 'VWR'").count() == 0
