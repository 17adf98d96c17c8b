"""Linear algebra over correlation edges (i, j, r), i < j, diagonal 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom.operators.ld import mirrored
from genoloom.storage import sorted_join


#: Variants of one bin; running sums go over bins first.
BIN = 4096

def matvec(edges: DataFrame, vector: DataFrame, by: list[str] | None = None, lower: bool = True, upper: bool = True, diag: bool = True, shift: float = 0.0) -> DataFrame:
    """(by..., i, y) of (R + shift I) x over the chosen triangles. vector: by..., i, x, one row per variant."""
    by = by or []
    up = edges.select(*by, "i", "j", "r")
    parts = ([up] if upper else []) + ([up.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "r")] if lower else [])
    own = vector.select(*by, "i", (F.col("x") * ((1.0 + shift) if diag else shift)).alias("p"))
    x = vector.select(*by, F.col("i").alias("j"), "x")
    for p in parts:
        own = own.unionByName(sorted_join(p, x, [*by, "j"]).select(*by, "i", (F.col("r") * F.col("x")).alias("p")))
    return own.groupBy(*by, "i").agg(F.sum("p").alias("y"))


def rank_one(edges: DataFrame, vector: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    """R + alpha x xᵀ on the stored band."""
    by = by or []
    a = vector.select(*by, "i", F.col("x").alias("xi"))
    b = vector.select(*by, F.col("i").alias("j"), F.col("x").alias("xj"))
    return edges.join(a, [*by, "i"]).join(b, [*by, "j"]).select(*by, "i", "j", (F.col("r") + alpha * F.col("xi") * F.col("xj")).alias("r"))


def rank_one_diagonal(vector: DataFrame, alpha: float, by: list[str] | None = None) -> DataFrame:
    """(by..., i, shift): what the update adds to the diagonal."""
    return vector.select(*(by or []), "i", (alpha * F.col("x") * F.col("x")).alias("shift"))


def block(edges: DataFrame, rows: tuple[int, int], cols: tuple[int, int] | None = None) -> DataFrame:
    """Dense block [rows) x [cols) of the symmetric matrix in long form: i, j, r, with the diagonal and zeros out of band."""
    cols = cols or rows
    spark = edges.sparkSession
    grid = spark.range(*rows).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(cols[0]).cast("bigint"), F.lit(cols[1] - 1).cast("bigint"))))
    lo, hi = min(rows[0], cols[0]), max(rows[1], cols[1])
    near = mirrored(edges.where((F.col("i") >= lo) & (F.col("i") < hi) & (F.col("j") >= lo) & (F.col("j") < hi)))
    near = near.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "r")
    return grid.join(near, ["i", "j"], "left").select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce("r", F.lit(0.0))).alias("r"))


def row(edges: DataFrame, i: int, symmetric: bool = True) -> DataFrame:
    """(j, r) of a row: stored neighbours on both sides, or to the right only."""
    e = mirrored(edges) if symmetric else edges
    return e.where(F.col("i") == i).select("j", "r")


def entry(edges: DataFrame, i: int, j: int) -> float:
    """One element: 1 on the diagonal, 0 out of band."""
    if i == j:
        return 1.0
    found = edges.where((F.col("i") == min(i, j)) & (F.col("j") == max(i, j))).select("r").head(1)
    return float(found[0].r) if found else 0.0


def fill_gaps(edges: DataFrame, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Edges made contiguous right of the diagonal: each row has every j from i + 1 to its last; missing ones become 0.

    Entries on and below the diagonal are dropped. strict raises instead of filling.
    """
    by = by or []
    up = edges.where(F.col("i") < F.col("j")).select(*by, "i", "j", "r")
    ends = up.groupBy(*by, "i").agg(F.max("j").alias("last"), F.count(F.lit(1)).alias("n"))
    if strict:
        if not ends.where(F.col("n") != F.col("last") - F.col("i")).isEmpty():
            raise ValueError("the entries are not contiguous around the diagonal")
        return up
    grid = ends.select(*by, "i", F.explode(F.sequence(F.col("i") + 1, "last")).alias("j"))
    return sorted_join(grid, up, [*by, "i", "j"], "left").select(*by, "i", "j", F.coalesce("r", F.lit(0.0)).alias("r"))


def row_pointer(edges: DataFrame, m: int) -> DataFrame:
    """(i, indptr) for i in 0..m: entries stored before row i. Counts are summed by bins first, rows within their bin."""
    counts = edges.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    every = edges.sparkSession.range(m + 1).select(F.col("id").alias("i"))
    n = every.join(counts, "i", "left").select("i", F.floor(F.col("i") / BIN).alias("bin"), F.coalesce("n", F.lit(0)).alias("n"))
    earlier = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # a row for BIN variants
    bins = n.groupBy("bin").agg(F.sum("n").alias("s")).select("bin", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("o"))
    before = W.partitionBy("bin").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return n.join(bins, "bin").select("i", (F.col("o") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("indptr"))


def leftmost(edges: DataFrame, variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., i, leftmost): first neighbour to the left, the variant itself where there is none."""
    by = by or []
    low = edges.groupBy(*by, F.col("j").alias("i")).agg(F.min("i").alias("__l"))
    return variants.select(*by, "i").join(low, [*by, "i"], "left").select(*by, "i", F.least("i", F.coalesce("__l", "i")).alias("leftmost"))


def apply_mask(edges: DataFrame, kept: DataFrame, by: list[str] | None = None, renumber: bool = True) -> DataFrame:
    """Edges among the kept variants (by..., i), numbered anew within `by` if asked."""
    by = by or []
    k = kept.select(*by, "i").distinct()
    if not renumber:
        return sorted_join(sorted_join(edges, k, [*by, "i"], "left_semi"), k.withColumnRenamed("i", "j"), [*by, "j"], "left_semi")
    k = k.withColumn("bin", F.floor(F.col("i") / BIN))
    over = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)  # a row for BIN variants
    bins = k.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("s")).select(*by, "bin", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("o"))
    place = F.row_number().over(W.partitionBy(*by, "bin").orderBy("i"))
    k = sorted_join(k, bins, [*by, "bin"]).select(*by, "i", (F.col("o") + place - 1).cast("bigint").alias("__n"))
    a, b = k.withColumnRenamed("__n", "__i"), k.withColumnsRenamed({"i": "j", "__n": "__j"})
    return sorted_join(sorted_join(edges, a, [*by, "i"]), b, [*by, "j"]).select(*by, F.col("__i").alias("i"), F.col("__j").alias("j"), "r")


def stack_blocks(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Block-diagonal union of (edges, number of variants): indices of each part go on after those before."""
    out, at = None, 0
    for edges, m in parts:
        moved = edges.select((F.col("i") + at).alias("i"), (F.col("j") + at).alias("j"), "r")
        out, at = moved if out is None else out.unionByName(moved), at + m
    return out


def replace_rows(edges: DataFrame, new: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) taken from `new`, the others as they are."""
    own = (F.col("i") >= start) & (F.col("i") < end)
    return edges.where(~own).unionByName(new.where(own).select(*edges.columns))


def from_dense(rows: DataFrame) -> DataFrame:
    """Strict upper triangle of rows (i, values array)."""
    return rows.select("i", F.posexplode("values").alias("j", "r")).where("i < j")


def from_pair_table(pairs: DataFrame, variants: DataFrame, trim: bool = False) -> DataFrame:
    """Edges of a table SNP_A, SNP_B, R by the index (variants: SNP, i, optionally v_end); a null R is 0."""
    a = variants.select(F.col("SNP").alias("SNP_A"), F.col("i").alias("__a"), *(["v_end"] if trim else []))
    b = variants.select(F.col("SNP").alias("SNP_B"), F.col("i").alias("__b"))
    e = sorted_join(sorted_join(pairs, a, ["SNP_A"]), b, ["SNP_B"]).withColumn("i", F.least("__a", "__b")).withColumn("j", F.greatest("__a", "__b")).where("i < j")
    return (e.where("j < v_end") if trim else e).select("i", "j", F.coalesce("R", F.lit(0.0)).alias("r"))


def assign_blocks(variants: DataFrame, size: int | None = None, dist: str | None = None, width: float | None = None, by: list[str] | None = None) -> DataFrame:
    """variants with block_id: runs of `size` variants, or of `width` along the column `dist`."""
    if size:
        return variants.withColumn("block_id", F.floor(F.col("i") / size))
    keys = by or []
    first = variants.groupBy(*keys).agg(F.min(dist).alias("__first"))
    placed = variants.join(first, keys) if keys else variants.join(F.broadcast(first))  # one row
    return placed.withColumn("block_id", F.floor((F.col(dist) - F.col("__first")) / width)).drop("__first")


def assign_given_blocks(variants: DataFrame, ends: list[int]) -> DataFrame:
    """variants with block_id by explicit limits: block k holds the i in [ends[k], ends[k + 1])."""
    k = F.lit(None).cast("bigint")
    for n in reversed(range(len(ends) - 1)):
        k = F.when((F.col("i") >= ends[n]) & (F.col("i") < ends[n + 1]), n).otherwise(k)
    return variants.withColumn("block_id", k)


def block_edges(edges: DataFrame, variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., block_id, i, j, r) of the edges inside blocks; variants: by..., i, block_id. Grouped by block_id, each group is
    what one step of an iteration over blocks would load."""
    by = by or []
    v = variants.select(*by, "i", "block_id").where("block_id IS NOT NULL")
    w = v.select(*by, F.col("i").alias("j"), F.col("block_id").alias("__b"))
    return sorted_join(sorted_join(edges, v, [*by, "i"]), w, [*by, "j"]).where("block_id = __b").select(*by, "block_id", "i", "j", "r")


def block_ends(variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., block_id, first, end, variants): limits of each block, the end exclusive."""
    by = by or []
    return variants.where("block_id IS NOT NULL").groupBy(*by, "block_id").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("end"), F.count(F.lit(1)).alias("variants"))


def slices(df: DataFrame, value: str, idx: str = "i") -> DataFrame:
    """(value, first, end): the run of indices of each value; equal values must stand next to each other."""
    return df.groupBy(value).agg(F.min(idx).alias("first"), (F.max(idx) + 1).alias("end"))


def from_ragged(rows: DataFrame) -> DataFrame:
    """Strict upper triangle of ragged rows (i, start, values): values[k] belongs to column start + k."""
    return rows.select("i", "start", F.posexplode("values").alias("__k", "r")).select("i", (F.col("start") + F.col("__k")).cast("bigint").alias("j"), "r").where("i < j")


def rows_of(edges: DataFrame, start: int, end: int, symmetric: bool = False, diagonal: bool = False) -> DataFrame:
    """(i, j, r) of rows [start, end): right of the diagonal, or with the left side and the diagonal if asked."""
    own = (F.col("i") >= start) & (F.col("i") < end)
    out = edges.where(own).select("i", "j", "r")
    if symmetric:
        out = out.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "r").where(own))
    if diagonal:
        out = out.unionByName(edges.sparkSession.range(start, end).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("r")))
    return out


def compressed(edges: DataFrame) -> DataFrame:
    """(i, columns, values): the rows in compressed form, sorted; what a sparse matrix holds between two row pointers."""
    c = F.sort_array(F.collect_list(F.struct("j", "r")))
    return edges.groupBy("i").agg(c.alias("c")).select("i", F.col("c.j").alias("columns"), F.col("c.r").alias("values"))


def dense(edges: DataFrame, variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., i, SNP, values): every row of the block-diagonal matrix of the variants (by..., i, SNP) in full, its columns in
    the order of the variants. Meant for regions: a row is as long as its chromosome has variants here."""
    by = by or []
    ids = variants.select(*by, "i", "SNP").distinct()
    here = sorted_join(sorted_join(edges, ids.select(*by, "i"), [*by, "i"]), ids.select(*by, F.col("i").alias("j")), [*by, "j"])
    every = ids.groupBy(*by).agg(F.sort_array(F.collect_list("i")).alias("__all")) if by else ids.agg(F.sort_array(F.collect_list("i")).alias("__all"))
    near = mirrored(here, by).groupBy(*by, "i").agg(F.map_from_entries(F.collect_list(F.struct("j", "r"))).alias("__m"))
    rows = ids.join(every, by) if by else ids.join(F.broadcast(every))  # one row
    rows = sorted_join(rows, near, [*by, "i"], "left")
    value = lambda j: F.when(j == F.col("i"), F.lit(1.0)).otherwise(F.coalesce(F.try_element_at("__m", j), F.lit(0.0)))
    return rows.select(*by, "i", "SNP", F.transform("__all", value).alias("values"))
