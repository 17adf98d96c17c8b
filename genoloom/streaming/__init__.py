"""Structured Streaming: aggregations that are sums run on streams as on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators.genotype import allele_frequency
from genoloom.operators.rejects import dissect


def running_frequency(calls: DataFrame) -> DataFrame:
    """Allele frequencies of a stream of calls; write in complete or update mode."""
    return allele_frequency(calls)


def windowed_counts(events: DataFrame, time: str, late: str, length: str, keys: list[str]) -> DataFrame:
    """Rows per window and key; rows later than `late` are left out, windows come out once they are complete."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("start"), *keys, "rows")


def unreadable(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of a stream with stray quotes or a wrong number of cells, against a static table of files."""
    d = dissect(lines.join(files.select("file_id", "separator", F.split("column_list", ",", -1).alias("__names")), "file_id"))
    return d.where(F.col("__quoting") | (F.col("__count") != F.size("__names"))).select("line_id", F.when(F.col("__quoting"), "quoting").otherwise("columns").alias("reason"))


__all__ = ["running_frequency", "unreadable", "windowed_counts"]
