"""Correlation (linkage disequilibrium) of neighbouring variants, as edges (i, j, r) with i < j; the diagonal is 1."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom.storage import sorted_join

#: Samples of one matrix product.
SAMPLE_BLOCK = 16_384


def position_bounds(variants: DataFrame, dist: str, d: float, by: str = "chr", idx: str = "variant_idx") -> DataFrame:
    """variants with v_start and v_end: the first index within distance d to the left, and one past the last to the right."""
    # a range frame needs a whole number or decimal; scaled to keep fractions of a map unit
    scale = 1 if dict(variants.dtypes)[dist] in ("int", "bigint", "smallint") else 10**6
    key = F.rint(F.col(dist) * scale).cast("bigint") if scale > 1 else F.col(dist).cast("bigint")
    reach = int(round(d * scale))
    # all within reach stand in a variant's own bin or in one beside it, so that a chromosome is divided
    own = F.floor(key / max(reach, 1))
    rows = variants.withColumn("__d", key).withColumn("__own", own).withColumn("__bin", F.explode(F.array(own - 1, own, own + 1)))
    w = W.partitionBy(by, "__bin").orderBy("__d").rangeBetween(-reach, reach)
    bounds = rows.withColumn("v_start", F.min(idx).over(w)).withColumn("v_end", F.max(idx).over(w) + 1)
    return bounds.where("__own = __bin").drop("__d", "__own", "__bin")


def _ends(variants: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """variants with __lo and __hi: the ends of the index within the keys."""
    ends = variants.groupBy(*keys).agg(F.min(idx).alias("__lo"), F.max(idx).alias("__hi"))
    return variants.join(ends, keys)


def count_bounds(variants: DataFrame, size: int, by: str = "chr", idx: str = "variant_idx") -> DataFrame:
    """Bounds by number of variants: size - 1 neighbours to either side at most."""
    v = _ends(variants, [by], idx)
    return v.select(*variants.columns, F.greatest(F.col(idx) - (size - 1), "__lo").alias("v_start"), F.least(F.col(idx) + size, F.col("__hi") + 1).alias("v_end"))


def block_bounds(variants: DataFrame, block: str = "block_start", by: str = "chr", idx: str = "variant_idx") -> DataFrame:
    v = _ends(variants, [by, block], idx)
    return v.select(*variants.columns, F.col("__lo").alias("v_start"), (F.col("__hi") + 1).alias("v_end"))


def shrinkage_distance(ne: float, n: int, cutoff: float) -> float:
    """The map distance (cM) beyond which the shrinkage factor is under the cutoff."""
    return -math.log(cutoff) / (0.02 * ne / n)


def tightest(variants: DataFrame, bounds: list[DataFrame], idx: str = "variant_idx") -> DataFrame:
    """Intersection of several kinds of bounds: the largest start and the smallest end."""
    out = variants
    for k, b in enumerate(bounds):
        out = out.join(b.select(idx, F.col("v_start").alias(f"__s{k}"), F.col("v_end").alias(f"__e{k}")), idx)
    cols = range(len(bounds))
    one = len(bounds) == 1
    start = F.col("__s0") if one else F.greatest(*[f"__s{k}" for k in cols])
    end = F.col("__e0") if one else F.least(*[f"__e{k}" for k in cols])
    return out.select(*variants.columns, start.alias("v_start"), end.alias("v_end"))


def packed_blocks(calls: DataFrame, sample_block: int, several: bool) -> DataFrame:
    """(variant_idx, part, at, g): observed dosages of each block of samples as bytes, at their places in it; and m, ss, n, the
    variant's mean, sum of squares about it and observed calls, if there are several blocks. sample_idx counts from 0."""
    seen = calls.where("dosage IS NOT NULL")
    cells = F.collect_list(F.struct(F.pmod("sample_idx", F.lit(sample_block)).cast("int").alias("at"), F.col("dosage").cast("tinyint").alias("g")))
    lists = seen.groupBy("variant_idx", F.floor(F.col("sample_idx") / sample_block).alias("part")).agg(cells.alias("c")).select("variant_idx", "part", F.col("c.at").alias("at"), F.col("c.g").alias("g"))
    if not several:  # a variant's one list tells all
        return lists
    g = F.col("dosage").cast("double")
    sums = seen.groupBy("variant_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(g).alias("s"), F.sum(g * g).alias("q"))
    return lists.join(sums.select("variant_idx", (F.col("s") / F.col("n")).alias("m"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("ss"), "n"), "variant_idx")


def banded(calls: DataFrame, bounds: DataFrame, by: str = "chr", tile: int = 256, impute: bool = True, idx: str = "variant_idx", sample_block: int = SAMPLE_BLOCK) -> DataFrame:
    """(chr, i, j, r) for j in [i + 1, v_end of i).

    bounds: idx, chr, v_end. Variants are laid out in tiles of neighbouring ones, samples in blocks; a tile meets itself and
    the tiles its band reaches, and each pair of tiles is one matrix product for a block of samples, which are added up.
    Memory of a task is two tiles of one block, whatever the number of variants and samples. impute: missing calls count
    as the mean and r is over all samples; else means, variances and products are over observed calls and r is over the
    calls observed in both. Constant variants have r = 0.
    """
    several = (calls.agg(F.max("sample_idx")).first()[0] or 0) >= sample_block
    x = packed_blocks(calls, sample_block, several).join(bounds.select(F.col(idx).alias("variant_idx"), F.col(by).alias("chr"), "v_end"), "variant_idx")
    x = x.withColumn("t", F.floor(F.col("variant_idx") / tile))
    reach = bounds.select(F.col(by).alias("chr"), F.floor(F.col(idx) / tile).alias("t"), F.floor((F.col("v_end") - 1) / tile).alias("e")).groupBy("chr", "t").agg(F.max("e").alias("reach"))
    # every row goes to the pairs of tiles that its tile is in, on either side
    pairs = reach.select("chr", F.col("t").alias("a"), F.explode(F.sequence("t", F.greatest("t", "reach"))).alias("b"))
    one = lambda c, side: F.struct(F.col(c).alias("t"), F.lit(side).alias("side"))
    grid = pairs.select("chr", "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array(one("a", 0))).otherwise(F.array(one("a", 0), one("b", 1)))).alias("x")).select("chr", "a", "b", "x.t", "x.side")
    rows = x.join(grid, ["chr", "t"]).drop("t")
    kind = x.schema["chr"].dataType

    def product(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("variant_idx", "ascending")])
        get = lambda c: table.column(c).to_numpy()
        lists = table.column("at").combine_chunks()
        offs = lists.offsets.to_numpy()
        row = np.repeat(np.arange(len(table)), np.diff(offs))
        every, place = np.unique(lists.values.to_numpy()[offs[0] : offs[-1]], return_inverse=True)
        g = table.column("g").combine_chunks()
        g = g.values.to_numpy()[g.offsets[0].as_py() : g.offsets[-1].as_py()]
        if several:
            m, ss, n = get("m"), get("ss"), get("n")
        else:
            n = np.maximum(np.diff(offs), 1)
            m = np.bincount(row, g, len(table)) / n
            ss = np.bincount(row, (g - m[row]) ** 2, len(table))
        dense = np.zeros((len(table), len(every)))
        dense[row, place] = g - m[row]
        side = get("side") == 0
        a = np.flatnonzero(side)
        b = a if side.all() else np.flatnonzero(~side)
        i, j = get("variant_idx")[a], get("variant_idx")[b]
        p, q = np.nonzero((j[None, :] > i[:, None]) & (j[None, :] < get("v_end")[a][:, None]))
        xy = (dense[a] @ dense[b].T)[p, q]
        if impute:
            joint, scale = np.zeros(len(p)), np.sqrt(ss[a][p] * ss[b][q])
        else:
            seen = np.zeros(dense.shape, np.float32)
            seen[row, place] = 1
            joint = (seen[a] @ seen[b].T)[p, q].astype(float)
            scale = np.sqrt((ss[a] / n[a])[p] * (ss[b] / n[b])[q])
        chr_ = pa.repeat(table.column("chr")[0], len(p))
        return pa.table([chr_, pa.array(i[p].astype(np.int64)), pa.array(j[q].astype(np.int64)), pa.array(xy), pa.array(joint), pa.array(scale)], names=["chr", "i", "j", "xy", "joint", "scale"])

    parts = rows.groupBy("chr", "a", "b", "part").applyInArrow(product, f"chr {kind.simpleString()}, i bigint, j bigint, xy double, joint double, scale double")
    if several:
        parts = parts.groupBy("chr", "i", "j").agg(F.sum("xy").alias("xy"), F.sum("joint").alias("joint"), F.max("scale").alias("scale"))
    scale = F.col("scale") if impute else F.col("scale") * F.col("joint")
    return parts.select("chr", "i", "j", F.when(scale > 1e-12, F.col("xy") / scale).otherwise(0.0).alias("r"))


def pairwise(calls: DataFrame, pairs: DataFrame, impute: bool = True) -> DataFrame:
    """(i, j, r) of explicit pairs, by joins and sums alone."""
    seen = calls.where("dosage IS NOT NULL").select("sample_idx", "variant_idx", F.col("dosage").cast("double").alias("g"))
    stats = seen.groupBy("variant_idx").agg(F.avg("g").alias("m"), F.var_pop("g").alias("v"), F.count("g").alias("n"))
    c = seen.join(stats, "variant_idx").select("sample_idx", "variant_idx", (F.col("g") - F.col("m")).alias("x"))
    a, b = c.withColumnsRenamed({"variant_idx": "i", "x": "xi"}), c.withColumnsRenamed({"variant_idx": "j", "x": "xj"})
    sums = pairs.select("i", "j").distinct().join(a, "i").join(b, ["j", "sample_idx"]).groupBy("i", "j").agg(F.sum(F.col("xi") * F.col("xj")).alias("xy"), F.count("xi").alias("joint"))
    s = lambda k: stats.select(F.col("variant_idx").alias(k), F.col("v").alias(f"v{k}"), F.col("n").alias(f"n{k}"))
    j = pairs.select("i", "j").distinct().join(sums, ["i", "j"], "left").join(s("i"), "i", "left").join(s("j"), "j", "left")
    scale = F.sqrt(F.col("vi") * F.col("ni") * F.col("vj") * F.col("nj")) if impute else F.sqrt(F.col("vi") * F.col("vj")) * F.col("joint")
    return j.select("i", "j", F.when(scale > 1e-12, F.col("xy") / scale).otherwise(0.0).alias("r"))


def shrink(edges: DataFrame, variants: DataFrame, ne: float, n: int, cutoff: float = 1e-3) -> DataFrame:
    """Edges shrunk by map distance and sampling error. variants: variant_idx, cm, MAF_VAR."""
    k = 0.02 * ne / n
    h = sum(1 / t for t in range(1, 2 * n))
    theta = (1 / h) / (2 * n + 1 / h)
    f, g = (1 - theta) ** 2, 0.5 * theta * (1 - 0.5 * theta)
    side = lambda x: variants.select(F.col("variant_idx").alias(x), F.col("cm").alias(f"cm_{x}"), (F.col("MAF_VAR") / 2).alias(f"v_{x}"))
    j = edges.join(side("i"), "i").join(side("j"), "j")
    e = F.exp(-k * F.abs(F.col("cm_i") - F.col("cm_j")))
    e = F.when(e < cutoff, 0.0).otherwise(e)
    s = lambda x: F.sqrt(f"v_{x}") / F.sqrt(f * F.col(f"v_{x}") + g)
    return j.select(*edges.columns[:-1], (F.col("r") * s("i") * s("j") * e * f).alias("r"))


def mirrored(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Both directions of every edge."""
    by = by or []
    return edges.select(*by, "i", "j", "r").unionByName(edges.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "r"))


def symmetrize(edges: DataFrame, variants: DataFrame, by: list[str] | None = None, diagonal: float = 1.0) -> DataFrame:
    """Edges, mirrored edges and the diagonal. variants: by..., i."""
    by = by or []
    return mirrored(edges, by).unionByName(variants.select(*by, "i", F.col("i").alias("j"), F.lit(diagonal).alias("r")))


def ld_scores(edges: DataFrame, variants: DataFrame, n: int, annotations: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(by..., i, LDScore or one column per annotation): sum over the band of r² less its sampling error, the variant included."""
    by = by or []
    r2 = F.col("r") * F.col("r")
    fixed = r2 - (1 - r2) / (n - 2)
    both = mirrored(edges, by).withColumn("__w", fixed)
    if not annotations:
        s = both.groupBy(*by, "i").agg(F.sum("__w").alias("__s"))
        return sorted_join(variants.select(*by, "i"), s, [*by, "i"], "left").select(*by, "i", (1 + F.coalesce("__s", F.lit(0.0))).alias("LDScore"))
    there = variants.select(*by, F.col("i").alias("j"), *[F.col(a).alias(f"__{a}") for a in annotations])
    s = sorted_join(both, there, [*by, "j"]).groupBy(*by, "i").agg(*[F.sum(F.col("__w") * F.col(f"__{a}")).alias(f"__{a}") for a in annotations])
    return sorted_join(variants.select(*by, "i", *annotations), s, [*by, "i"], "left").select(*by, "i", *[(F.col(a) + F.coalesce(f"__{a}", F.lit(0.0))).alias(a) for a in annotations])


def window_size(edges: DataFrame, variants: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., i, neighbors, window_size): neighbours on both sides; the window counts the variant too."""
    by = by or []
    c = mirrored(edges, by).groupBy(*by, "i").agg(F.count(F.lit(1)).alias("neighbors"))
    n = F.coalesce("neighbors", F.lit(0))
    return sorted_join(variants.select(*by, "i"), c, [*by, "i"], "left").select(*by, "i", n.alias("neighbors"), (n + 1).alias("window_size"))


def estimate(calls: DataFrame, variants: DataFrame, estimator: str = "windowed", **how) -> DataFrame:
    """Edges by one of the estimators: sample (all pairs of a chromosome), windowed (size, kb, cm), block (block column), shrinkage (ne, n).

    variants: variant_idx, chr, pos, cm.
    """
    if estimator == "sample":
        w = W.partitionBy("chr")
        bounds = variants.withColumn("v_end", F.max("variant_idx").over(w) + 1)
    elif estimator == "windowed":
        kinds = [count_bounds(variants, how["size"])] if how.get("size") else []
        kinds += [position_bounds(variants, "pos", how["kb"] * 1000)] if how.get("kb") else []
        kinds += [position_bounds(variants, "cm", how["cm"])] if how.get("cm") else []
        if not kinds:
            raise ValueError("give size, kb or cm")
        bounds = tightest(variants, kinds)
    elif estimator == "block":
        bounds = block_bounds(variants, how.get("block", "block_start"))
    elif estimator == "shrinkage":
        bounds = position_bounds(variants, "cm", shrinkage_distance(how["ne"], how["n"], how.get("cutoff", 1e-3)))
    else:
        raise ValueError(f"unknown estimator: {estimator}")
    edges = banded(calls, bounds, tile=how.get("tile", 256), impute=how.get("impute", True))
    if estimator != "shrinkage":
        return edges
    from genoloom.operators.genotype import allele_frequency

    return shrink(edges, variants.join(allele_frequency(calls), "variant_idx"), how["ne"], how["n"], how.get("cutoff", 1e-3))


