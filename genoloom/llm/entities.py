"""Matching markers to variants without a common key: an unlabelled Gaussian mixture over similarity vectors.

Candidates are pairs that agree in one exact way (site in either build, site or identifier in the name). Each has a
vector of similarities, an absent attribute leaving its place empty. Two regularised Gaussian components, matched and
unmatched, are fitted by expectation maximisation; as the attributes are apart, their covariance is diagonal, and an
empty place is integrated out. Transitivity: a marker that is two variants would make these the same, but variants are
distinct, so within the expectation step the candidates of a marker compete for one match at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoloom.storage import cut, small

FEATURES = ("site", "allele", "frequency", "name")


@dataclass(frozen=True)
class Mixture:
    """weight of the matched component; means and variances by (component, feature), unmatched first."""

    weight: float
    mean: np.ndarray
    var: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of rows of similarities with NaN in empty places."""
        total = np.full(len(x), np.log(self.weight) - np.log1p(-self.weight))
        seen = ~np.isnan(x)
        for c, sign in ((1, 1.0), (0, -1.0)):
            d = np.where(seen, -0.5 * ((np.nan_to_num(x) - self.mean[c]) ** 2 / self.var[c] + np.log(self.var[c])), 0.0)
            total += sign * d.sum(1)
        return total

    def posteriors(self, x: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
        """Probability of each candidate being its group's one match; group numbers ascend."""
        z = np.clip(self.log_odds(x), -500, 500)
        top = np.zeros(groups)  # no match has odds 1
        np.maximum.at(top, group, z)
        e = np.exp(z - top[group])
        return e / (np.exp(-top) + np.bincount(group, e, groups))[group]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(similarities, group of each candidate, candidates) of a batch of markers with their lists."""
    lists = batch.column("c")
    offs = lists.offsets.to_numpy()
    rows = lists.values.slice(offs[0], offs[-1] - offs[0])
    x = np.stack([rows.field(f).to_numpy(zero_copy_only=False).astype(float) for f in FEATURES], axis=1)
    return x, np.repeat(np.arange(batch.num_rows), np.diff(offs)), rows


def fit(candidates: DataFrame, rounds: int = 30, tolerance: float = 1e-4, floor: float = 0.004) -> Mixture:
    """Fits the mixture to a written table (m, c: list of candidates). Every round is one pass; tasks return their sums.

    floor: regularisation, added to each variance, so that a similarity that is constant within a component can't make
    the component infinitely narrow.
    """
    spark = candidates.sparkSession
    k = len(FEATURES)
    state: Mixture | None = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(state and (state.weight, state.mean, state.var))  # plain values: workers may lack the package

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + 6 * k)
            for b in batches:
                if not b.num_rows:
                    continue
                x, group, _ = _flat(b)
                now = shared.value and Mixture(*shared.value)
                seen, filled = ~np.isnan(x), np.nan_to_num(x)
                # start: alike in more than three quarters of what can be compared
                r = (filled.sum(1) > 0.75 * seen.sum(1)).astype(float) if now is None else now.posteriors(x, group, b.num_rows)
                total[0] += len(x)
                total[1] += r.sum()
                for c, w in ((0, 1 - r), (1, r)):
                    part = w[:, None] * seen
                    total[2 + c * 3 * k : 2 + (c + 1) * 3 * k] += np.concatenate([part.sum(0), (part * filled).sum(0), (part * filled**2).sum(0)])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g", "s"])

        parts = candidates.mapInArrow(sums, "g int, s array<double>").select(*[F.get("s", F.lit(i)).alias(f"s{i}") for i in range(2 + 6 * k)])
        s = np.array([float(v or 0.0) for v in parts.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(2 + 6 * k)]).first()])
        shared.unpersist()
        if s[0] == 0:
            return Mixture(0.5, np.array([[0.2] * k, [0.9] * k]), np.full((2, k), 0.05))
        mean, var = np.zeros((2, k)), np.zeros((2, k))
        for c in (0, 1):
            n, t, q = s[2 + c * 3 * k : 2 + (c + 1) * 3 * k].reshape(3, k)
            mean[c] = (t + (0.2, 0.9)[c]) / (n + 1)  # one imagined pair keeps an unseen similarity defined
            var[c] = np.maximum(q / np.maximum(n, 1) - (t / np.maximum(n, 1)) ** 2, 0) + floor + 0.05 / (n + 1)
        new = Mixture(float(np.clip(s[1] / s[0], 1e-3, 1 - 1e-3)), mean, var)
        done = state is not None and abs(new.weight - state.weight) + float(np.abs(new.mean - state.mean).max()) < tolerance
        state = new
        if done:
            break
    return state


def match(candidates: DataFrame, mixture: Mixture) -> DataFrame:
    """(m, v, confidence): each marker's best candidate. Ties go to the smaller v."""
    shared = candidates.sparkSession.sparkContext.broadcast((mixture.weight, mixture.mean, mixture.var))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema["c"].dataType.elementType}
    m_kind = candidates.schema["m"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, group, rows = _flat(b)
            p = Mixture(*shared.value).posteriors(x, group, b.num_rows)
            v = rows.field("v").to_numpy(zero_copy_only=False)
            order = np.lexsort((v, -np.round(p, 9), group))
            first = order[np.unique(group[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([b.column("m").take(pa.array(group[first])), rows.field("v").take(pa.array(first)), pa.array(p[first])], names=["m", "v", "confidence"])

    return candidates.mapInArrow(run, f"m {m_kind}, v {kinds['v']}, confidence double")


def _rc(x: Column) -> Column:
    return F.reverse(F.translate(x, "ACGT", "TGCA"))


def allele_similarity(a: Column, b: Column, v1: Column, v2: Column) -> Column:
    """Likeness of a marker's alleles a, b (either may be null) to a variant's: 1 the same two, whatever their order, strand
    and manner of writing; 0.9 consistent, but not fully written (one allele, or I and D); 0 contradictory; null if neither
    is given. Upper-case texts; `-` stands for no bases, then the first base of the variant's alleles is left out."""
    long, short = F.when(F.length(v1) >= F.length(v2), v1).otherwise(v2), F.when(F.length(v1) >= F.length(v2), v2).otherwise(v1)
    indel = F.length(long) != F.length(short)
    same = ((a == v1) & (b == v2)) | ((a == v2) & (b == v1)) | ((_rc(a) == v1) & (_rc(b) == v2)) | ((_rc(a) == v2) & (_rc(b) == v1))
    rest = lambda x: F.substring(x, 2, 1 << 30)
    bare = lambda x: indel & (F.length(short) == 1) & ((x == rest(long)) | (x == rest(_rc(long))) | (x == _rc(rest(long))))
    both = F.when(same, 1.0).when((a == "-") & (b != "-"), F.when(bare(b), 1.0).otherwise(0.0)).when((b == "-") & (a != "-"), F.when(bare(a), 1.0).otherwise(0.0))
    both = both.when((a.isin("I", "D")) & (b.isin("I", "D")) & (a != b), F.when(indel, 0.9).otherwise(0.0)).otherwise(0.0)
    one = F.coalesce(a, b)
    single = F.when(one.isin("I", "D", "-"), F.when(indel, 0.9).otherwise(0.0)).when((one == v1) | (one == v2) | (_rc(one) == v1) | (_rc(one) == v2) | bare(one), 0.9).otherwise(0.0)
    return F.when(one.isNull(), F.lit(None).cast("double")).when(a.isNull() | b.isNull(), single).otherwise(both)


def candidates(variants: DataFrame, markers: DataFrame, shifts: DataFrame) -> DataFrame:
    """(m, c): every marker that has candidates, with their similarities.

    variants: variant_idx, chr, snp, pos, a1, a2, maf in build b1. markers: marker_id, marker_name, chr, pos, build, a1,
    a2, maf. shifts: chr, region_start, region_end, shift_bp (a fixed, small table). Other columns are ignored.
    """
    regions = small(shifts.where("chr IS NOT NULL").groupBy("chr").agg(F.collect_list(F.struct("region_start", "region_end", "shift_bp")).alias("regions")))
    up = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    v = variants.where("variant_idx IS NOT NULL AND chr IS NOT NULL AND pos IS NOT NULL").join(regions, "chr", "left")
    p = F.col("pos")

    def there(x: Column) -> Column:
        """A b1 position in b2, null where no region holds it."""
        hit = F.get(F.filter("regions", lambda r: x.between(r["region_start"], r["region_end"])), F.lit(0))
        return x + hit["shift_bp"]

    v = v.select(
        F.struct(F.col("variant_idx").alias("v"), F.col("chr"), F.col("pos"), F.coalesce(up("a1"), F.lit("")).alias("v1"), F.coalesce(up("a2"), F.lit("")).alias("v2"), F.when(~F.isnan("maf"), F.col("maf")).alias("maf"), F.regexp_extract("snp", r"(\d+)$", 1).alias("rs"), there(p).alias("b2"), there(p + 1).alias("b2n")).alias("x")
    ).withColumn("indel", F.length("x.v1") != F.length("x.v2"))
    place = lambda b, q: F.struct(F.lit(b).alias("build"), q.cast("int").alias("p"))
    places = F.array(place("b1", F.col("x.pos")), place("b2", F.col("x.b2")), place("b1", F.when(F.col("indel"), F.col("x.pos") + 1)), place("b2", F.when(F.col("indel"), F.col("x.b2n"))))
    sites = v.select("x", F.explode(F.filter(places, lambda s: s["p"].isNotNull())).alias("s")).select("x", "s.build", "s.p")

    name = F.trim("marker_name")
    at = F.regexp_extract(name, r"(?i)^(?:chr)?(\d+)[:_.\-](\d+)(?:[:_.\-].*)?$", 1)
    m = markers.where("marker_id IS NOT NULL").select(
        F.struct(
            F.col("marker_id").alias("m"),
            F.regexp_extract("chr", r"(?i)^\s*(?:chr_?)?0*(\d+)(?:\.0*)?\s*$", 1).try_cast("int").alias("chr"), F.col("pos"),
            F.when(F.lower(F.trim("build")).isin("b1", "b2"), F.lower(F.trim("build"))).alias("build"),
            up("a1").alias("a"), up("a2").alias("b"), F.when(~F.isnan("maf"), F.col("maf")).alias("maf"),
            F.nullif(F.regexp_extract(name, r"(?i)^(?:seq-)?(?:rs)?0*(\d+)(?:_.*)?$", 1), F.lit("")).alias("rs"),
            at.try_cast("int").alias("nchr"), F.regexp_extract(name, r"(?i)^(?:chr)?(\d+)[:_.\-](\d+)(?:[:_.\-].*)?$", 2).try_cast("int").alias("npos"),
            F.when(F.lower(name).endswith("_b2"), "b2").otherwise("b1").alias("nbuild"),
        ).alias("y")
    )
    m = m.withColumn("y", F.col("y").withField("rs", F.when(F.col("y.nchr").isNull(), F.col("y.rs"))))
    builds = F.when(F.col("y.build").isNull(), F.array(F.lit("b1"), F.lit("b2"))).otherwise(F.array("y.build"))
    placed = m.where("y.pos IS NOT NULL").select("y", F.explode(builds).alias("build"), F.col("y.pos").alias("p"), F.col("y.chr").alias("k"))
    by_chr = sites.withColumn("k", F.col("x.chr"))
    pairs = [
        placed.where("k IS NOT NULL").join(by_chr, ["k", "build", "p"]),
        placed.where("k IS NULL").join(sites, ["build", "p"]),
        m.where("y.npos IS NOT NULL AND y.nchr IS NOT NULL").select("y", F.col("y.nchr").alias("k"), F.col("y.npos").alias("p"), F.col("y.nbuild").alias("build")).join(by_chr, ["k", "build", "p"]),
        m.where("y.rs IS NOT NULL").select("y", F.col("y.rs").alias("rs")).join(v.select("x", F.col("x.rs").alias("rs")).where("rs <> ''"), "rs"),
    ]
    both = pairs[0].select("y", "x")
    for other in pairs[1:]:
        both = both.unionByName(other.select("y", "x"))

    y, x = lambda c: F.col(f"y.{c}"), lambda c: F.col(f"x.{c}")
    indel = F.length(x("v1")) != F.length(x("v2"))
    in1 = (y("pos") == x("pos")) | (indel & (y("pos") == x("pos") + 1))
    in2 = F.coalesce((y("pos") == x("b2")) | (indel & (y("pos") == x("b2n"))), F.lit(False))
    fits = F.when(y("build") == "b1", in1).when(y("build") == "b2", in2).otherwise(in1 | in2)
    site = F.when(y("chr").isNotNull() & (y("chr") != x("chr")), 0.0).when(y("pos").isNotNull(), F.when(fits, 1.0).otherwise(0.0)).when(y("chr").isNotNull(), 0.9)
    near = F.least(F.abs(y("maf") - x("maf")), F.abs(1 - y("maf") - x("maf")))
    frequency = F.when(near.isNotNull(), 1 - F.least(near, F.lit(0.25)) * 4)
    nb = F.when(y("nbuild") == "b2", x("b2")).otherwise(x("pos"))
    named = F.when(y("nchr").isNotNull(), F.when((y("nchr") == x("chr")) & (F.abs(y("npos") - nb) <= indel.cast("int")), 1.0).otherwise(0.0)).when(y("rs") == x("rs"), 1.0)
    features = F.struct(x("v").alias("v"), site.alias("site"), allele_similarity(y("a"), y("b"), x("v1"), x("v2")).alias("allele"), frequency.alias("frequency"), named.alias("name"))
    return both.select(y("m").alias("m"), features.alias("f")).groupBy("m").agg(F.sort_array(F.collect_set("f")).alias("c"))


def match_markers(variants: DataFrame, markers: DataFrame, shifts: DataFrame, least: float = 0.5) -> DataFrame:
    """(variant_idx, marker_id, confidence): which marker is which variant, each marker once at most.

    A match has a confidence of at least `least` (half as much where two candidates share it evenly); nothing but the
    mixture decides. Null attributes are left out of the comparison; a marker with
    neither site nor telling name has no candidate. Repeated markers are matched each. Empty tables give none.
    """
    table = cut(candidates(variants, markers, shifts), "pairs")
    best = match(table, fit(table))
    return best.where(F.col("confidence") >= least / 2).select(F.col("v").alias("variant_idx"), F.col("m").alias("marker_id"), "confidence")
