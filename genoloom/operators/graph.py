"""Greedy selection on the correlation graph, with exactly the result of going through the variants one by one.

The greedy choice is the lexicographically first maximal independent set. The genome is divided where no link crosses, and
each piece is gone through in order by one pass over sorted rows. In the order of positions a pass needs no more memory than
a band; in any other order, pieces of more rows than a task should hold are decided in rounds: every undecided variant
without an earlier undecided neighbour is kept and its undecided neighbours are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom.operators.ld import mirrored
from genoloom.storage import cut, drop_cut, sorted_join

#: Variants of one bin; the genome is divided at ends of bins.
BIN = 1024
#: Variants of a piece up to which it is one task's in an order other than that of positions.
PIECE_ROWS = 500_000


def _rounds(nodes: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Kept nodes (keys). nodes: keys, rank (unique within what is linked). links: keys of a, `o_` keys of b, both directions."""
    others = [f"o_{k}" for k in keys]
    ranks = nodes.select(*keys, "rank")
    edges = cut(
        sorted_join(sorted_join(links, ranks, keys), ranks.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("rank").alias("o_rank")), others).select(*keys, *others, "rank", "o_rank"), "links"
    )
    todo = cut(nodes.select(*keys), "todo")
    kept: DataFrame | None = None
    while not todo.isEmpty():
        later = sorted_join(edges.where("o_rank < rank"), todo.select(*[F.col(k).alias(f"o_{k}") for k in keys]), others, "left_semi").select(*keys).distinct()
        now = cut(sorted_join(todo, later, keys, "left_anti"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        gone = sorted_join(edges, now, keys, "left_semi").select(*[F.col(f"o_{k}").alias(k) for k in keys]).distinct()
        before = todo, edges
        todo = cut(sorted_join(sorted_join(todo, now, keys, "left_anti"), gone, keys, "left_anti"), "todo")
        edges = cut(sorted_join(sorted_join(edges, todo, keys, "left_semi"), todo.select(*[F.col(k).alias(f"o_{k}") for k in keys]), others, "left_semi"), "links")
        drop_cut(*before)
    return nodes.select(*keys).limit(0) if kept is None else kept


def _with_pieces(nodes: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """nodes with piece: runs of bins that no link leaves. links: by..., i, o_i with i < o_i."""
    bin_ = lambda c: F.floor(F.col(c) / BIN)
    crossed = links.select(*by, bin_("i").alias("b0"), bin_("o_i").alias("b1")).where("b0 < b1").distinct()
    closed = crossed.select(*by, F.explode(F.sequence(F.col("b0") + 1, "b1")).alias("bin")).distinct().withColumn("__c", F.lit(0))
    bins = nodes.select(*by, bin_("i").alias("bin")).distinct().join(closed, [*by, "bin"], "left")
    w = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("bin")  # a row for BIN variants
    pieces = bins.select(*by, "bin", F.sum(F.coalesce("__c", F.lit(1))).over(w).alias("piece"))
    return sorted_join(nodes.withColumn("bin", bin_("i")), pieces, [*by, "bin"]).drop("bin")


def _pass(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., i) of the kept rows. rows: by..., piece, rank, i, earlier (linked ones of lower rank), last (position beyond
    which nothing is linked to i, null if unknown); every piece is gone through in the order of its ranks."""
    group = [*by, "piece"]
    sorted_ = rows.repartition(*group).sortWithinPartitions(*group, "rank").select(*group, "i", "earlier", "last")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        kept: dict[int, int | None] = {}
        seen = 0
        for b in batches:
            chosen = []
            columns = [b.column(c).to_pylist() for c in group]
            for n, (i, earlier, last) in enumerate(zip(b.column("i").to_pylist(), b.column("earlier").to_pylist(), b.column("last").to_pylist())):
                key = tuple(c[n] for c in columns)
                if key != now:
                    now, kept, seen = key, {}, 0
                if not any(e in kept for e in earlier or ()):
                    kept[i] = last
                    chosen.append(n)
                seen += 1
                if seen % 20_000 == 0:
                    kept = {k: x for k, x in kept.items() if x is None or x > i}
            yield b.select([*by, "i"]).take(pa.array(chosen, pa.int64()))

    return sorted_.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (*by, "i")))


def _greedy(nodes: DataFrame, links: DataFrame, by: list[str], ranked: bool, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Kept nodes (by..., i). nodes: by..., i, rank (null: by position). links: by..., i, o_i with i < o_i."""
    keys = [*by, "i"]
    placed = _with_pieces(nodes, links, by)
    if not ranked:
        near = links.select(*by, F.col("o_i").alias("i"), F.col("i").alias("e"))
        earlier = near.groupBy(*keys).agg(F.collect_list("e").alias("earlier"))
        last = links.groupBy(*keys).agg(F.max("o_i").cast("bigint").alias("last"))
        return _pass(sorted_join(sorted_join(placed.withColumn("rank", F.col("i")), earlier, keys, "left"), last, keys, "left"), by)
    placed = cut(placed, "pieces")
    both = links.unionByName(links.select(*by, F.col("o_i").alias("i"), F.col("i").alias("o_i")))
    sizes = placed.groupBy(*by, "piece").count()
    large = cut(sizes.where(F.col("count") > piece_rows).select(*by, "piece"), "large")
    own = placed.join(large, [*by, "piece"], "left_anti")
    ranks = own.select(*keys, "rank")
    near = sorted_join(sorted_join(both, ranks, keys), ranks.select(*by, F.col("i").alias("o_i"), F.col("rank").alias("o_rank")), [*by, "o_i"]).where("o_rank < rank")
    earlier = near.groupBy(*keys).agg(F.collect_list("o_i").alias("earlier"))
    out = _pass(sorted_join(own, earlier, keys, "left").withColumn("last", F.lit(None).cast("bigint")), by)
    if large.isEmpty():
        return out
    rest = placed.join(large, [*by, "piece"], "left_semi").select(*keys, "rank")
    wide = both.select(*keys, *[F.col(k).alias(f"o_{k}") for k in by], "o_i")
    return out.unionByName(_rounds(rest, wide, keys))


def prune(edges: DataFrame, variants: DataFrame, threshold: float, by: list[str] | None = None, rank: str | None = None, strong: Column | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Kept variants (by..., i): each is taken in order unless |r| >= threshold with one kept before.

    variants: by..., i and, if given, the column `rank` (ascending; ties by i). Variants whose rank is null can only be
    dropped, never kept. strong: another condition in place of |r| >= threshold.
    """
    by = by or []
    cond = strong if strong is not None else F.abs("r") >= threshold
    low, high = F.least("i", "j"), F.greatest("i", "j")
    links = edges.where(cond).where("i <> j").select(*by, low.alias("i"), high.alias("o_i")).distinct()
    order = F.struct(F.col(rank), F.col("i")) if rank else F.lit(None)
    nodes = variants.where(F.col(rank).isNotNull()) if rank else variants
    return _greedy(nodes.select(*by, "i", order.alias("rank")).dropDuplicates([*by, "i"]), links, by, rank is not None, piece_rows)


def clump(edges: DataFrame, variants: DataFrame, r2: float, by: list[str] | None = None, rank: str | None = None) -> DataFrame:
    """As prune, by r² > threshold (strictly)."""
    return prune(edges, variants, 0.0, by, rank, strong=F.col("r") * F.col("r") > r2)


def tagging(edges: DataFrame, focal: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Focal variants (by..., i) and their neighbours with |r| >= threshold."""
    by = by or []
    near = mirrored(edges.where(F.abs("r") >= threshold), by).join(focal.select(*by, "i").distinct(), [*by, "i"], "left_semi")
    return focal.select(*by, "i").unionByName(near.select(*by, F.col("j").alias("i"))).distinct()


def expand(edges: DataFrame, focal: DataFrame, r2: float, by: list[str] | None = None) -> DataFrame:
    """(by..., i, ord): the focal list in its order (column ord), then new variants with r² above the limit in genome order."""
    by = by or []
    near = mirrored(edges.where(F.col("r") * F.col("r") > r2), by).join(focal.select(*by, "i").distinct(), [*by, "i"], "left_semi").select(*by, F.col("j").alias("i")).distinct()
    new = near.join(focal.select(*by, "i"), [*by, "i"], "left_anti").withColumn("part", F.lit(1)).withColumn("ord", F.lit(0).cast("bigint"))
    old = focal.groupBy(*by, "i").agg(F.min("ord").cast("bigint").alias("ord")).withColumn("part", F.lit(0))
    return old.select(*by, "i", "part", "ord").unionByName(new.select(*by, "i", "part", "ord"))


def priority(stats: DataFrame, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """stats with `rank`: the order by the first of PVAL, P, PVALUE that it has, then by i."""
    col = next((c for c in ("PVAL", "P", "PVALUE") if c in stats.columns), None)
    if col is None:
        raise ValueError("no p-value column")
    return stats.withColumn("rank", -F.col(col) if descending else F.col(col))


def ordered(variants: DataFrame, listed: DataFrame | None = None, stats: DataFrame | None = None, on: str = "SNP") -> DataFrame:
    """variants with `rank`: the order of a list (SNP, ord), then the p-values of stats; what neither has gets null.

    Variants of the list come before all others; within them a p-value doesn't count.
    """
    out = variants
    if listed is not None:
        out = sorted_join(out, listed.groupBy(on).agg(F.min("ord").cast("double").alias("__o")), [on], "left")
    if stats is not None:
        own = priority(stats).groupBy(on).agg(F.min("rank").cast("double").alias("__p"))
        out = sorted_join(out, own, [on], "left")
    o = F.col("__o") if listed is not None else F.lit(None).cast("double")
    p = F.col("__p") if stats is not None else F.lit(None).cast("double")
    rank = F.when(o.isNotNull(), F.struct(F.lit(0).alias("k"), o.alias("x"))).when(p.isNotNull(), F.struct(F.lit(1).alias("k"), p.alias("x")))
    return out.withColumn("rank", rank).drop("__o", "__p")


def mismatch(edges: DataFrame, stats: DataFrame, n: int, r2_max: float = 0.95, by: list[str] | None = None, least: int = 1) -> DataFrame:
    """(by..., i, T): mean squared standardised difference of each z from what its neighbours (r² < r2_max) predict.

    All eligible neighbours are used instead of a random one each time, so the result is always the same. Variants with
    fewer than `least` of them have no T.
    """
    by = by or []
    e = mirrored(edges.where(F.col("r") * F.col("r") < r2_max), by)
    zi = stats.select(*by, "i", F.col("Z").alias("zi"))
    zj = stats.select(*by, F.col("i").alias("j"), F.col("Z").alias("zj"))
    d = F.col("zi") - F.col("r") * F.col("zj")
    return e.join(zi, [*by, "i"]).join(zj, [*by, "j"]).groupBy(*by, "i").agg(F.avg(d * d / (1 - F.col("r") * F.col("r"))).alias("T"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")


def drop_mismatched(
    edges: DataFrame, stats: DataFrame, n: int, p_max: float = 5e-8, rounds: int = 10, cap: float = 0.005, by: list[str] | None = None,
    neighbors: int = 10, gwas_p: float = 1e-2,
) -> DataFrame:
    """stats without variants whose T is improbable. A variant is judged if it has at least `neighbors` eligible ones.

    Each round drops the worst, at most a share `cap` of all variants among those with an association p-value (of Z) above
    gwas_p, and as many among the others; the last round drops all that are found. stats: by..., i, Z.
    """
    from genoloom.functions.stats import erfc_sql, pvalue_sql

    by = by or []
    keys = [*by, "i"]
    most = max(1, int(cap * stats.count()))
    left = stats
    for k in range(rounds):
        t = mismatch(edges, left, n, by=by, least=neighbors).withColumn("p", F.expr(erfc_sql("sqrt(T / 2)"))).where(F.col("p") < p_max)
        t = t.join(left.select(*keys, F.expr(pvalue_sql("Z")).alias("__g")), keys)
        if k < rounds - 1:
            parts = [t.where(c).orderBy("p", F.desc("T"), *keys).limit(most) for c in (F.col("__g") > gwas_p, F.col("__g") <= gwas_p)]
            t = parts[0].unionByName(parts[1])
        worst = cut(t.select(*keys), "mismatch")
        if worst.isEmpty():
            break
        left = left.join(worst, keys, "left_anti")
    return left
