"""Running counts over streams: reads as they come off an instrument, filtered and counted by event-time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons_by_window(stream: DataFrame, reason: Column, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """How many rows end at each step of a filter waterfall, for each window; rows later than ``late`` are dropped."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), reason.alias("reason"))
    return w.agg(F.count("*").alias("n")).select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "reason", "n")


def allele_counts_by_window(stream: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Reference, alternative and other bases of each site (site, ref, alt, base), for each window."""
    b = F.col("base")
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "site")
    out = w.agg(F.count_if(b == F.col("ref")).alias("ref_count"), F.count_if(b == F.col("alt")).alias("alt_count"), F.count_if(~b.isin("N") & (b != F.col("ref")) & (b != F.col("alt"))).alias("other_count"))
    return out.select(F.col("w.start").alias("from"), F.col("w.end").alias("to"), "site", "ref_count", "alt_count", "other_count")
