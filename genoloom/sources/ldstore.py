"""Stores of correlation edges: parquet by chromosome, with a table of the variants and one of attributes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import Window as W

from genoloom.functions.stats import dequantize, quantize
from genoloom.operators.banded import apply_mask, rows_of
from genoloom.operators.intervals import outside
from genoloom.operators.ld import ld_scores, window_size
from genoloom.storage import sorted_join


def write_store(path: str, edges: DataFrame, variants: DataFrame, attributes: dict, bits: int | None = 16) -> None:
    """edges: chr, i, j, r; variants: chr, i, ... Correlations are stored as whole numbers of `bits` bits, or as doubles."""
    e = edges if bits is None else edges.withColumn("r", quantize(F.col("r"), bits))
    write = lambda df, name: df.repartition("chr").sortWithinPartitions("chr", "i").write.mode("overwrite").option("compression", "zstd").partitionBy("chr").parquet(f"{path}/{name}")
    write(e.select("chr", "i", "j", "r"), "edges")
    write(variants, "variants")
    spark = edges.sparkSession
    text = json.dumps(attributes | {"bits": bits}, sort_keys=True)
    spark.createDataFrame([(text,)], "attributes string").coalesce(1).write.mode("overwrite").parquet(f"{path}/attributes")


def attributes(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/attributes").first().attributes)


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/variants")


def read_store(spark: SparkSession, path: str, chromosome: int | None = None, rows: tuple[int, int] | None = None, raw: bool = False) -> DataFrame:
    """Edges, of one chromosome (a partition) and of rows [start, end) (by statistics of the files) if asked."""
    e = spark.read.parquet(f"{path}/edges")
    e = e if chromosome is None else e.where(F.col("chr") == chromosome)
    e = e if rows is None else e.where((F.col("i") >= rows[0]) & (F.col("i") < rows[1]))
    bits = attributes(spark, path)["bits"]
    e = e.select("chr", "i", "j", "r")
    return e if raw or bits is None else e.withColumn("r", dequantize(F.col("r"), bits))


def read_rows(spark: SparkSession, path: str, chromosome: int, start: int, end: int, symmetric: bool = False, diagonal: bool = False) -> DataFrame:
    """(i, j, r) of rows [start, end) of one chromosome, as in banded.rows_of."""
    e = read_store(spark, path, chromosome)
    # entries left of the diagonal of these rows stand in earlier rows, so that all rows up to the last are read
    return rows_of(e.where(F.col("i") < end), start, end, symmetric, diagonal)


def snp_table(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """The store's variants with LDScore and WindowSize; n: samples that the correlations come from, by default the store's."""
    v, e = read_variants(spark, path), read_store(spark, path)
    n = n or attributes(spark, path).get("n")
    scores = ld_scores(e, v, n, by=["chr"]).select("chr", "i", "LDScore")
    sizes = window_size(e, v, by=["chr"]).select("chr", "i", F.col("window_size").alias("WindowSize"))
    return sorted_join(sorted_join(v, scores, ["chr", "i"]), sizes, ["chr", "i"])


def outside_regions(spark: SparkSession, path: str, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, variants) of a store without the variants in regions (chr, start_pos, end_pos), numbered anew."""
    v = outside(read_variants(spark, path), regions, ["chr", "i"], chr_col="chr")
    e = apply_mask(read_store(spark, path), v, by=["chr"])
    numbers = v.select("chr", "i").withColumn("__n", F.row_number().over(W.partitionBy("chr").orderBy("i")) - 1)
    return e, v.join(numbers, ["chr", "i"]).drop("i").withColumnRenamed("__n", "i")


def validate(spark: SparkSession, path: str) -> None:
    """Raises unless entries are right of the diagonal, contiguous, unique, at most 1 in size, and of listed variants."""
    e, v = read_store(spark, path), read_variants(spark, path).select("chr", "i")
    if not e.where((F.col("i") >= F.col("j")) | (F.abs("r") > 1 + 1e-9) | F.isnan("r")).isEmpty():
        raise ValueError("entries on or below the diagonal, or outside -1 to 1")
    rows = e.groupBy("chr", "i").agg(F.count(F.lit(1)).alias("n"), F.max("j").alias("last"), F.count_distinct("j").alias("d"))
    if not rows.where("n <> last - i OR n <> d").isEmpty():
        raise ValueError("the entries are not contiguous around the diagonal")
    for c in ("i", "j"):
        if not sorted_join(e.select("chr", F.col(c).alias("i")).distinct(), v, ["chr", "i"], "left_anti").isEmpty():
            raise ValueError("entries of unlisted variants")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(chr, variants, entries, mean_neighbors, size_mb): size_mb is that of the entries uncompressed."""
    bits = attributes(spark, path)["bits"] or 64
    e = read_store(spark, path, raw=True).groupBy("chr").agg(F.count(F.lit(1)).alias("entries"))
    v = read_variants(spark, path).groupBy("chr").agg(F.count(F.lit(1)).alias("variants"))
    n = F.coalesce("entries", F.lit(0))
    return v.join(e, "chr", "left").select("chr", "variants", n.alias("entries"), (2 * n / F.col("variants")).alias("mean_neighbors"), (n * bits / 8 / 2**20).alias("size_mb"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"{old} can't be moved to {new}")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)
