"""Joins of positions with intervals, by equality on bins instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overlaps(points: DataFrame, intervals: DataFrame, chr_col: str = "CHR", pos: str = "POS", bounds: tuple[str, str, str] = ("chr", "start_pos", "end_pos"), width: int = 10_000, closed: str = "both") -> DataFrame:
    """(points..., intervals' columns as iv_*) of every pair with start <= pos <= end, or < end if closed is left.

    Both sides are keyed by chromosome and bin of `width` positions: an interval is repeated for each bin it touches, a
    point has one, so the join is an equality join with a residual condition. Choose a width near the usual interval.
    """
    c, lo, hi = bounds
    bins = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    iv = intervals.where(F.col(lo) <= F.col(hi)).select(F.col(c).alias("__c"), F.explode(bins).alias("__b"), *[F.col(x).alias(f"iv_{x}") for x in intervals.columns])
    p = points.withColumn("__c", F.col(chr_col)).withColumn("__b", F.floor(F.col(pos) / width))
    end = F.col(pos) <= F.col(f"iv_{hi}") if closed == "both" else F.col(pos) < F.col(f"iv_{hi}")
    return p.join(iv, ["__c", "__b"]).where((F.col(pos) >= F.col(f"iv_{lo}")) & end).drop("__c", "__b")


def annotate(points: DataFrame, intervals: DataFrame, name: str, key: list[str], **how) -> DataFrame:
    """points with a 0/1 column: whether any interval holds the position."""
    inside = overlaps(points, intervals, **how).select(*key).distinct().withColumn(name, F.lit(1))
    return points.join(inside, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def inside(points: DataFrame, intervals: DataFrame, key: list[str], **how) -> DataFrame:
    return points.join(overlaps(points, intervals, **how).select(*key).distinct(), key, "left_semi")


def outside(points: DataFrame, intervals: DataFrame, key: list[str], **how) -> DataFrame:
    return points.join(overlaps(points, intervals, **how).select(*key).distinct(), key, "left_anti")


def as_of_blocks(points: DataFrame, blocks: DataFrame, chr_col: str = "CHR", pos: str = "POS", bounds: tuple[str, str, str] = ("chr", "block_start", "block_end"), matched_only: bool = False, bin_width: int = 1_000_000) -> DataFrame:
    """Every point with the last block that starts at or before it on its chromosome (null if none starts before).

    matched_only keeps points inside their block, [start, end). The last start is carried within bins of positions, so a
    chromosome with a third of all rows is divided; from earlier bins only the last start of each is looked up.
    """
    c, lo, hi = bounds
    b = F.floor(F.col("__p") / bin_width)
    pts = points.withColumn("__c", F.col(chr_col)).withColumn("__p", F.col(pos)).withColumn("__b", b)
    own = F.struct(F.col(lo), F.col(hi))
    blk = blocks.select(F.col(c).alias("__c"), F.col(lo).alias("__p"), own.alias("__blk")).withColumn("__b", b)
    # the last block of all bins before: one row per bin that has blocks, a small table
    last = blk.groupBy("__c", "__b").agg(F.max_by("__blk", "__p").alias("__last"))
    bins = pts.select("__c", "__b").distinct().select("__c", "__b", F.lit(None).cast(last.schema["__last"].dataType).alias("__last")).unionByName(last).groupBy("__c", "__b").agg(F.max("__last").alias("__last"))
    carry = bins.withColumn("__before", F.last("__last", ignorenulls=True).over(W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).select("__c", "__b", "__before")
    rows = pts.withColumn("__blk", F.lit(None).cast(blk.schema["__blk"].dataType)).withColumn("__is", F.lit(1)).unionByName(blk.withColumn("__is", F.lit(0)), allowMissingColumns=True)
    within = W.partitionBy("__c", "__b").orderBy("__p", "__is").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("__own", F.last("__blk", ignorenulls=True).over(within)).where("__is = 1")
    out = found.join(carry, ["__c", "__b"], "left").withColumn("__own", F.coalesce("__own", "__before"))
    out = out.select(*points.columns, F.col(f"__own.{lo}").alias(lo), F.col(f"__own.{hi}").alias(hi))
    return out.where((F.col(pos) >= F.col(lo)) & (F.col(pos) < F.col(hi))) if matched_only else out


def regions(texts: list[str]) -> list[tuple[str, int, int]]:
    """(chromosome, start, end) of texts such as chr1:1,000-2,000."""
    import re

    out = []
    for t in texts:
        m = re.fullmatch(r"\s*(?:chr)?([^:]+):([\d,]+)-([\d,]+)\s*", t, re.IGNORECASE)
        if not m:
            raise ValueError(f"not a region: {t}")
        start, end = (int(x.replace(",", "")) for x in m.groups()[1:])
        if start > end:
            raise ValueError(f"empty region: {t}")
        out.append((m.group(1), start, end))
    return out


def split_blocks(blocks: DataFrame, most: int, bounds: tuple[str, str] = ("block_start", "block_end")) -> DataFrame:
    """Blocks longer than `most` cut into the least number of pieces of equal length (rounded down at the cuts)."""
    lo, hi = bounds
    n = F.greatest(F.ceil((F.col(hi) - F.col(lo)) / most), F.lit(1))

    def at(k: Column) -> Column:
        return (F.col(lo) + F.floor((F.col(hi) - F.col(lo)) * k / n)).cast("int")

    parts = blocks.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    rest = [c for c in blocks.columns if c not in bounds]
    return parts.select(*rest, at(F.col("__k")).alias(lo), at(F.col("__k") + 1).alias(hi))
