"""Reads on streams: the batch expressions as stateless maps, counters by window, and dedupe within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import dna


def translated(stream: DataFrame, seq: str = "seq") -> DataFrame:
    """Reads with their protein, those with a stop dropped."""
    return stream.withColumn("aa", dna.translate(F.col(seq), stop="drop")).filter("aa is not null")


def variant_counts(stream: DataFrame, time: str, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """window, aa, n: counts of variants in tumbling windows; rows later than the watermark are dropped."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "aa").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "aa", "n")


def unique_sequences(stream: DataFrame, time: str, seq: str = "seq", late: str = "10 minutes") -> DataFrame:
    """The first row of each sequence within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([seq])
