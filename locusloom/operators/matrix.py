"""Feature-by-sample matrices: long form (feature, sample, value) for Catalyst, wide form (array per feature) for kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns, stats

CHUNK = 1 << 14  # samples of a chunk of features


def impute(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Missing values become the feature's mean."""
    return df.withColumn(value, F.coalesce(value, F.avg(value).over(Window.partitionBy(feature))))


def normalise(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Centre each feature and scale it to unit length; a constant one becomes 0."""
    w = Window.partitionBy(feature)
    centred = df.withColumn(value, F.col(value) - F.avg(value).over(w))
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(w))
    return centred.withColumn(value, F.col(value) / F.when(norm == 0, 1.0).otherwise(norm))


def average_rank(df: DataFrame, feature: str = "feature", value: str = "value", out: str = "rank") -> DataFrame:
    w = Window.partitionBy(feature)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(feature, value)) - 1) / 2)


def rank_normal(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Normal quantiles of (rank - 1/2) / largest average rank of the feature."""
    ranked = average_rank(df, feature, value, "_rank")
    share = (F.col("_rank") - 0.5) / F.max("_rank").over(Window.partitionBy(feature))
    return ranked.withColumn("_share", share).withColumn(value, columns.normal_quantile(F.col("_share"))).drop("_rank", "_share")


def to_wide(df: DataFrame, feature: str, sample: str, value: str, keep: list[str] = ()) -> DataFrame:
    """One array per feature, in sample order."""
    return df.groupBy(feature, *keep).agg(F.transform(F.array_sort(F.collect_list(F.struct(sample, value))), lambda x: x[value]).alias("vals"))


def to_long(df: DataFrame, samples: list[str], keep: list[str]) -> DataFrame:
    axis = F.array(*[F.lit(s) for s in samples])
    return df.select(*keep, F.posexplode("vals").alias("_i", "value")).withColumn("sample", axis[F.col("_i")]).drop("_i")


def transpose(df: DataFrame, feature: str, sample: str, value: str, features: list) -> DataFrame:
    """Sample-major: a row per sample, a column per feature."""
    return df.groupBy(sample).pivot(feature, features).agg(F.first(value))


def common_samples(files: DataFrame, file: str = "file", sample: str = "sample") -> DataFrame:
    """Samples that every file has."""
    n = files.agg(F.count_distinct(file).alias("_n"))
    return files.groupBy(sample).agg(F.count_distinct(file).alias("_f")).join(F.broadcast(n), F.col("_f") == F.col("_n")).select(sample)


def keep_ids(df: DataFrame, key: str | list[str], include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Include and exclude lists: ids, or chromosome and position."""
    if include is not None:
        df = df.join(include, key, "left_semi")
    return df if exclude is None else df.join(exclude, key, "left_anti")


def map_arrays(df: DataFrame, kernel, name: str = "vals", many: Column | None = None) -> DataFrame:
    """Apply a numpy kernel (rows x samples -> same shape) to an array column, an Arrow batch at a time."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([np.array(v, float) for v in s]) if len(s) else np.empty((0, 0))
            yield pd.Series(list(kernel(x)) if len(s) else [])

    return df.withColumn(name, run(F.col(name)))


def residualise(df: DataFrame, covariates: list[list[str | None]], normal: bool = False, name: str = "vals") -> DataFrame:
    """Residuals of each feature on covariates (given as text, a list for each), optionally rank-normalised after."""
    q = stats.basis(stats.encode_covariates(covariates)) if covariates else None

    def kernel(x):
        x = stats.impute(x)
        if q is not None and len(q) > 1:
            x = stats.residualise(x, q)
        return np.array([stats.rank_normal(v) for v in x]) if normal else x

    return map_arrays(df, kernel, name)


def residualise_targeted(df: DataFrame, shared: list[list[str | None]], own: DataFrame, normal: bool = False) -> DataFrame:
    """Residuals of wide phenotypes (pid, vals) on shared covariates and on those of their own: (pid, cov) rows, such as
    the dosages of variants that are known to act on them. The covariates of one phenotype are gathered, no more."""
    common = stats.encode_covariates(shared) if shared else None
    mine = own.groupBy("pid").agg(F.collect_list("cov").alias("_own"))

    @F.pandas_udf("array<double>")
    def run(vals: pd.Series, own_: pd.Series) -> pd.Series:
        out = []
        for v, o in zip(vals, own_, strict=True):
            x = stats.impute(np.array(v, float)[None])
            extra = stats.impute(np.array([np.array(c, float) for c in o])) if o is not None and len(o) else np.empty((0, x.shape[1]))
            rows = extra if common is None else np.vstack([common, extra])
            if len(rows):
                x = stats.residualise(x, stats.basis(rows))
            out.append(stats.rank_normal(x[0]) if normal else x[0])
        return pd.Series(out)

    return df.join(mine, "pid", "left").withColumn("vals", run("vals", "_own")).drop("_own")


def collapse(df: DataFrame, how: str = "mean") -> DataFrame:
    """One row for each group (grp) of wide phenotypes: their mean, or the first principal component and its share.

    The annotation is that of the group's first member (pid order).
    """

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        x = np.array([np.array(v, float) for v in g["vals"]])
        out, share = g.iloc[[0]].copy(), 1.0
        if len(g) > 1:
            if how == "mean":
                vals = x.mean(axis=0)
            else:
                s = stats.sd(x)
                z = (x - x.mean(axis=1, keepdims=True)) / np.where(s == 0, 1, s)[:, None]
                u, d, vt = np.linalg.svd(z, full_matrices=False)
                vals, share = d[0] * vt[0], float(d[0] ** 2 / (d**2).sum())
            out.at[out.index[0], "vals"] = vals
        out["n_phe"], out["var_explained"] = len(g), share
        return out[["grp", "pid", "chr", "start", "end", "neg", "vals", "n_phe", "var_explained"]]

    return df.groupBy("grp").applyInPandas(kernel, "grp string, pid string, chr string, start long, end long, neg boolean, vals array<double>, n_phe int, var_explained double")


def allele_frequency(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Alternative allele frequency and minor allele frequency of dosages."""
    f = F.sum(value) / (2 * F.count(value))
    return df.groupBy(feature).agg(f.alias("af"), F.least(f, 1 - f).alias("maf"))


def thin(df: DataFrame, distance: int) -> DataFrame:
    """Sites (chr, pos, ...) at least ``distance`` from the last kept one: sequential, one pass over each chromosome.

    Each task streams a sorted chromosome, so memory is one batch.
    """
    names = df.columns
    c, p = names.index("chr"), names.index("pos")

    def run(batches):
        chrom = last = None
        for b in batches:
            keep = []
            for x, y in zip(b.column(c).to_pylist(), b.column(p).to_pylist(), strict=True):
                ok = x != chrom or y - last >= distance
                if ok:
                    chrom, last = x, y
                keep.append(ok)
            import pyarrow as pa

            yield b.filter(pa.array(keep, pa.bool_()))

    return df.repartition("chr").sortWithinPartitions("chr", "pos").mapInArrow(run, df.schema)


def pca(df: DataFrame, center: bool = True, scale: bool = False) -> tuple[DataFrame, DataFrame]:
    """Principal components of samples over features (wide rows fid, vals): (scores, statistics).

    The Gram matrix of samples, or of features where they are fewer, is summed over partitions (partial sums in the
    tasks); only it reaches the driver. Both have the same eigenvalues. Features meet in chunks of ``CHUNK`` samples, so
    a task holds that many columns of them; scores are then computed chunk by chunk, when they are asked for.
    """
    spark = df.sparkSession
    n, size = df.agg(F.count("*"), F.max(F.size("vals"))).first()
    wide = (size or 0) > n  # more samples than features

    def prepared(b):
        x = np.array([np.array(v, float) for v in b["vals"]])
        s = stats.sd(x)
        x = x[s > 0]
        if center and len(x):
            x = x - x.mean(axis=1, keepdims=True)
        return (x / s[s > 0][:, None] if scale and len(x) else x), s > 0

    def gram(batches):
        total, n = None, 0
        for b in batches:
            x, _ = prepared(b)
            if not len(x):
                continue
            total = x.T @ x if total is None else total + x.T @ x
            n += len(x)
        if total is not None:
            yield pd.DataFrame({"n": [n], "g": [total.ravel().tobytes()]})

    def cut(batches):
        for b in batches:
            for i in range(len(b)):  # features are long: one at a time
                x, ok = prepared(b.iloc[i : i + 1])
                for k in range(0, x.shape[1] if ok.any() else 0, CHUNK):
                    yield pd.DataFrame({"k": [k // CHUNK], "f": [b["f"].iloc[i]], "vals": [x[0, k : k + CHUNK]]})

    def block(g):
        return np.array(g.sort_values("f")["vals"].tolist())  # equal names are equal features: all chunks have one order

    def cross(g: pd.DataFrame) -> pd.DataFrame:
        x = block(g)
        return pd.DataFrame({"n": [len(x)], "g": [(x @ x.T).ravel().tobytes()]})

    chunks = df.select(F.xxhash64("vals").alias("f"), "vals").mapInPandas(cut, "k int, f long, vals array<double>") if wide else None
    sums = chunks.groupBy("k").applyInPandas(cross, "n long, g binary") if wide else df.select("vals").mapInPandas(gram, "n long, g binary")
    total, features = 0, 0
    for r in sums.toLocalIterator():
        total, features = total + np.frombuffer(r["g"]), r["n"] if wide else features + r["n"]
    if not features:
        raise ValueError("no feature varies")
    samples, size = size, int(round(len(total) ** 0.5))
    values, vectors = np.linalg.eigh(total.reshape(size, size))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    k = min(samples, features)
    values, vectors = values[:k], vectors[:, :k]
    sds, share = np.sqrt(values / max(samples - 1, 1)), values / values.sum()
    total_share = np.cumsum(share)
    kaiser = int(np.flatnonzero(sds >= 1).max() + 1) if (sds >= 1).any() else 0
    most = max(1, int((total_share < 0.995).sum()))
    info = [(j + 1, float(sds[j]), float(share[j]), float(total_share[j]), kaiser, most) for j in range(k)]
    if wide:
        shared = spark.sparkContext.broadcast(vectors)

        def project(g: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"pc": np.arange(1, k + 1), "k": g["k"].iloc[0], "part": list(shared.value.T @ block(g))})

        parts = chunks.groupBy("k").applyInPandas(project, "pc int, k int, part array<double>")
        scores = parts.groupBy("pc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x.part)).alias("scores"))
    else:
        scores = spark.createDataFrame([(j + 1, (vectors[:, j] * np.sqrt(values[j])).tolist()) for j in range(k)], "pc int, scores array<double>")
    return scores, spark.createDataFrame(info, "pc int, sd double, prop_var double, cum_prop double, kaiser int, pcs_995 int")
