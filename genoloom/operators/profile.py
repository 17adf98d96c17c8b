"""Column profile of delivered loads: standard aggregates, expressions induced by description length, comparisons.

Every load is compared with the one before it. Counts are compared as whole numbers, so that a share that lies exactly
on a limit never depends on rounding. Columns may be numbers or texts; numbers have the text that a plain writer gives.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoloom.storage import cut, drop_cut

#: Runs up to which every run of a text is generalised or not by description length; in longer texts all runs are.
WIDE_RUNS = 8
#: Mantissa bits of the bins that a distribution is compared in; a level is reached only by bins that are undecided.
LEVELS = (4, 8, 16, 32, 52)


@dataclass(frozen=True)
class Domain:
    """What a column may hold: an interval, values of the column's own expression only (strict), and whether few distinct
    values are a fault."""

    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False
    strict: bool = False
    spread: bool = False

    def outside(self, x: Column) -> Column:
        """NaN is outside every interval."""
        bad = F.isnan(x)
        if self.low is not None:
            bad = bad | ((x <= self.low) if self.low_open else (x < self.low))
        if self.high is not None:
            bad = bad | ((x >= self.high) if self.high_open else (x > self.high))
        return bad


def value_text(x: Column) -> Column:
    """Text of a double; without an exponent from 1e7 on, where the usual text has one. NaN and infinities have none."""
    text = x.cast("string")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), "[-.]", "")
    places = F.substring_index(text, "E", -1).try_cast("int") + 1
    whole = F.rpad(F.left(digits, places), places, "0")
    rest = F.substr(digits, places + 1)
    plain = F.concat(F.when(x < 0, "-").otherwise(""), whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.when(F.abs(x) >= 1e7, plain).otherwise(text))


def shape_of(text: Column) -> Column:
    """Token shape: U upper-case run, l lower-case run, Z run of zeros, D other run of digits, the rest as it is."""
    named = F.when(
        text.rlike("[A-Za-z]"), F.regexp_replace(F.regexp_replace(text, "[A-Z]+", "U"), "[a-z]+", "l")
    ).otherwise(text)
    return F.regexp_replace(F.regexp_replace(named, "0*[1-9][0-9]*", "D"), "0+", "Z")


def wide_shape(shape: Column) -> Column:
    """The shape with every run generalised (zeros to digits, cases to letters) and without a sign in front."""
    wide = F.regexp_replace(F.regexp_replace(F.translate(shape, "ZUl", "DAA"), "A+", "A"), "D+", "D")
    return F.regexp_replace(wide, "^-", "")


#: Regular expression and bits of a character for every token class.
TOKENS = {"U": ("[A-Z]+", math.log2(26)), "l": ("[a-z]+", math.log2(26)), "Z": ("0+", 0.0), "D": ("[0-9]+", math.log2(10)), "A": ("[A-Za-z]+", math.log2(52))}


def _regex(shape: str) -> str:
    """The expression of a shape; a leading ~ stands for a sign that may be there."""
    sign, rest = ("-?", shape[1:]) if shape.startswith("~") else ("", shape)
    return sign + "".join(TOKENS[c][0] if c in TOKENS else ("\\" + c if not c.isalnum() and c.isascii() else c) for c in rest)


def _shape_bits(shape: str, own: list[dict], total: int) -> float:
    """Description length of one expression and of the distinct values it covers."""
    n = sum(s["n"] for s in own)
    lengths: dict[tuple[bool, int], int] = defaultdict(int)  # values by sign and length
    for s in own:
        for length, m in s["lengths"]:
            lengths[s["shape"].startswith("-"), length] += m
    chars = sum(x * m for (_, x), m in lengths.items())
    symbols = len(shape)
    if shape.startswith("~"):
        chars -= sum(m for (signed, _), m in lengths.items() if signed)
        shape = shape[1:]
    runs = [c for c in shape if c in TOKENS]
    free = max(0.0, chars - n * (len(shape) - len(runs)))
    each = max((TOKENS[c][1] for c in runs), default=0.0)
    if runs and any(c != "Z" for c in runs):  # zeros are free, but at least one character each
        free = max(0.0, free - n * sum(c == "Z" for c in runs))
    else:
        each = 0.0
    # sign and length by a code of the group's own, which is part of the model, then where runs end
    code = sum(m * math.log2(n / m) + 2 * math.log2(2 + x) + math.log2(1 + m) for (_, x), m in lengths.items()) if runs else 0.0
    ends = sum(m * math.log2(max(1, x)) for (_, x), m in lengths.items()) * max(0, len(runs) - 1)
    return (symbols + 2) * math.log2(100) + n * math.log2(total / n) + code + free * each + ends


def _raw_bits(own: list[dict], total: int) -> float:
    """Description length of values written out character by character."""
    return sum(s["n"] * math.log2(total / s["n"]) + sum(x * m for x, m in s["lengths"]) * math.log2(96) for s in own)


def _positions(shape: str) -> list[str]:
    """Sign (- or nothing), then runs and other characters one by one; letters next to each other are one run."""
    out, rest = (["-"], shape[1:]) if shape.startswith("-") else ([""], shape)
    for c in rest:
        if c in "Ul" and len(out) > 1 and out[-1][-1] in "Ul":
            out[-1] += c
        else:
            out.append(c)
    return out


def induce(stats: list[dict], total: int) -> list[tuple[str, list[dict], bool]]:
    """Expressions of least description length for the distinct values of one wide shape, as (shape, members, kept).

    stats: shape, n (distinct values), lengths (of (length, distinct values)) of each member. total: distinct values of the column.
    Starts from an expression for each member. A place of the wide shape is generalised in all of them (zeros become
    digits, cases letters, a sign one that may be there) as long as that shortens the description, the best place first.
    What is then shorter written out character by character is no expression of the column (kept is false).
    """
    parts = [(_positions(s["shape"]), s) for s in stats]
    places = len(parts[0][0])
    open_places = [k for k in range(places) if len({p[k] for p, _ in parts}) > 1]
    wide = {k: "~" if k == 0 else "A" if parts[0][0][k][0] in "UlA" else "D" for k in open_places}

    def grouped(general: set[int]) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = defaultdict(list)
        for p, s in parts:
            out["".join(wide[k] if k in general else c for k, c in enumerate(p))].append(s)
        return out

    bits = lambda groups: sum(_shape_bits(k, own, total) for k, own in groups.items())
    chosen: set[int] = set() if len(open_places) <= WIDE_RUNS else set(open_places)
    groups = grouped(chosen)
    least = bits(groups)
    while len(chosen) < len(open_places):
        tried = [(bits(g), k, g) for k in open_places if k not in chosen for g in [grouped(chosen | {k})]]
        best, k, g = min(tried, key=lambda x: x[:2])
        if best >= least:
            break
        least, groups = best, g
        chosen.add(k)
    return [(k, own, _shape_bits(k, own, total) <= _raw_bits(own, total)) for k, own in groups.items()]


def distinct_table(df: DataFrame, load: str, fields: list[str]) -> DataFrame:
    """(load_id, f, x, t, shape, c): the rows of each distinct value of each field of each load; f is the field's position,
    x the value as a number (null if it is none), t the text of a column of texts, shape the text's token shape."""
    kinds = dict(df.dtypes)
    texts = [c for c in fields if kinds[c] == "string"]
    number = lambda c: f"try_cast(`{c}` AS DOUBLE)"
    pairs = ", ".join(f"{i}, {number(c)}, {f'`{c}`' if c in texts else 'CAST(NULL AS STRING)'}" for i, c in enumerate(fields))
    long = df.where(F.col(load).isNotNull()).select(F.col(load).alias("load_id"), F.expr(f"stack({len(fields)}, {pairs}) AS (f, x, t)"))
    keys = ["x", "t"] if texts else ["x"]
    one = long.groupBy("load_id", "f", *keys).agg(F.count(F.lit(1)).alias("c"))
    text = F.coalesce("t", value_text(F.col("x"))) if texts else value_text(F.col("x"))
    return one.select("load_id", "f", "x", F.col("t") if texts else F.lit(None).cast("string").alias("t"), shape_of(text).alias("shape"), "c")


def expressions(values: DataFrame) -> DataFrame:
    """(f, shape, example, regex, distinct_values, kept) of every token shape of every field, a written table: the induced
    expression that the shape belongs to, and how many distinct values in all loads that has.

    Wide shapes are described apart from each other, so that any number of shapes is handled, each in full length.
    """
    text = F.coalesce("t", value_text(F.col("x")))
    single = values.where("shape IS NOT NULL").select("f", "x", "t", "shape").distinct()
    sized = single.withColumn("text", text).groupBy("f", "shape", F.length("text").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("example"))
    shapes = sized.groupBy("f", "shape").agg(F.sum("n").alias("n"), F.min("example").alias("example"), F.sort_array(F.collect_list(F.array(F.col("len").cast("bigint"), "n"))).alias("lengths"))
    shapes = cut(shapes.withColumn("wide", wide_shape(F.col("shape"))), "shapes")
    total = shapes.groupBy("f").agg(F.sum("n").alias("total"))

    def describe(part: pd.DataFrame) -> pd.DataFrame:
        part["lengths"] = [[(int(a), int(b)) for a, b in x] for x in part.lengths]
        stats = part.drop(columns=["f", "wide", "total"]).to_dict("records")
        out = [
            (part.f[0], s["shape"], s["example"], _regex(shape), sum(o["n"] for o in own), kept)
            for shape, own, kept in induce(stats, int(part.total[0])) for s in own
        ]
        return pd.DataFrame(out, columns=["f", "shape", "example", "regex", "distinct_values", "kept"])

    schema = "f int, shape string, example string, regex string, distinct_values bigint, kept boolean"
    return cut(shapes.join(total, "f").groupBy("f", "wide").applyInPandas(describe, schema), "expressions")


def own_expressions(found: DataFrame) -> DataFrame:
    """(f, own): the kept expression of each field that covers most distinct values; of equal ones the last in order."""
    return found.where("kept").groupBy("f").agg(F.max_by("regex", F.struct("distinct_values", "regex")).alias("own"))


def _ordered(x: Column, bits: int) -> Column:
    """Sign, exponent and the first `bits` of the mantissa as one whole number that grows with x; NaN comes last.

    Zero is 0; a magnitude m has the bin 1 + (floor(log2 m) + 1100) * 2^bits + its part of that octave.
    """
    m = F.abs(x)
    e = F.floor(F.log2(m))
    # log2 may be off by one next to a power of two
    e = F.when(F.pow(F.lit(2.0), e) > m, e - 1).when(F.pow(F.lit(2.0), e + 1) <= m, e + 1).otherwise(e)
    part = F.floor((m / F.pow(F.lit(2.0), e) - 1) * float(2**bits))
    top = float(2**bits)
    code = (F.lit(1) + (e + 1100) * F.lit(2**bits) + F.least(part, F.lit(2**bits - 1))).cast("bigint")
    infinite = F.lit(int((1024 + 1100) * top) + 1).cast("bigint")
    code = F.when(m == 0, F.lit(0).cast("bigint")).when(m == float("inf"), infinite).otherwise(code)
    return F.when(F.isnan(x), infinite + 1).otherwise(F.when(x < 0, -code).otherwise(code))


def shifted(values: DataFrame, pairs: DataFrame, limit: Fraction) -> DataFrame:
    """(load_id, f) whose distribution of non-null values differs somewhere by more than `limit` from that before.

    values: distinct_table, written. pairs: load_id, prev_id. Cumulated counts are compared at the edges of bins; a bin
    inside which the limit might be passed, but isn't at its edges, is divided on the next level, down to single values.
    """
    p, q = limit.numerator, limit.denominator
    v = values.where("x IS NOT NULL").select("load_id", "f", "x", "c")
    big = lambda x: F.col(x).cast("decimal(18,0)")  # noqa: E731  products of two counts fit
    zero = F.lit(0).cast("decimal(38,0)")
    totals = v.groupBy("load_id", "f").agg(F.sum("c").cast("decimal(18,0)").alias("n"))
    both = (
        pairs.join(totals, "load_id")
        .join(totals.select(F.col("load_id").alias("prev_id"), "f", F.col("n").alias("m")), ["prev_id", "f"])
        .select("load_id", "prev_id", "f", "n", "m")
    )
    hit: DataFrame | None = None
    written: list[DataFrame] = []
    open_bins: DataFrame | None = None
    for level, bits in enumerate(LEVELS):
        exact = bits == LEVELS[-1]
        key = F.col("x") if exact else _ordered(F.col("x"), bits).cast("double")
        parent = _ordered(F.col("x"), LEVELS[level - 1]).cast("double") if level else F.lit(0.0)
        binned = v.select("load_id", "f", parent.alias("up"), key.alias("b"), "c")
        if open_bins is None:
            own = binned.groupBy("load_id", "f", "up", "b").agg(F.sum("c").alias("c"))
            sides = both.select("load_id", "prev_id", "f", "n", "m", F.lit(0.0).alias("up"), zero.alias("d0"))
        else:
            sides = open_bins
            wanted = sides.select("load_id", "f", "up").unionByName(sides.select(F.col("prev_id").alias("load_id"), "f", "up")).distinct()
            own = binned.join(wanted, ["load_id", "f", "up"], "left_semi").groupBy("load_id", "f", "up", "b").agg(F.sum("c").alias("c"))
        # counts are cross-multiplied: d = cumulated count * m - cumulated count before * n, against limit * n * m
        now = sides.join(own, ["load_id", "f", "up"]).select("load_id", "prev_id", "f", "n", "m", "up", "d0", "b", (big("c") * F.col("m")).cast("decimal(38,0)").alias("plus"), zero.alias("minus"))
        then = sides.join(own.withColumnRenamed("load_id", "prev_id"), ["prev_id", "f", "up"]).select("load_id", "prev_id", "f", "n", "m", "up", "d0", "b", zero.alias("plus"), (big("c") * F.col("n")).cast("decimal(38,0)").alias("minus"))
        keys = ["load_id", "prev_id", "f", "n", "m", "up", "d0"]
        bins = now.unionByName(then).groupBy(*keys, "b").agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus"))
        run = W.partitionBy("load_id", "f", "up").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
        walked = bins.withColumn("d", F.col("d0") + F.sum(F.col("plus") - F.col("minus")).over(run)).withColumn("before", F.col("d") - F.col("plus") + F.col("minus"))
        size = F.col("n") * F.col("m") * F.lit(p)
        walked = walked.withColumn("over", F.abs("d") * F.lit(q) > size).withColumn(
            "may", ((F.col("before") + F.col("plus")) * F.lit(q) > size) | ((F.col("minus") - F.col("before")) * F.lit(q) > size)
        )
        walked = cut(walked.where("over OR may"), "shift")
        written.append(walked)
        over = walked.where("over").select("load_id", "f").distinct()
        hit = over if hit is None else hit.unionByName(over)
        if exact:
            break
        left = walked.where("may").join(hit.distinct(), ["load_id", "f"], "left_anti")
        if left.isEmpty():
            break
        open_bins = left.select("load_id", "prev_id", "f", "n", "m", F.col("b").alias("up"), F.col("before").cast("decimal(38,0)").alias("d0"))
    out = cut(hit.distinct(), "shifted")
    for t in written:
        drop_cut(t)
    return out


@dataclass
class Profile:
    """table: one row for each load and field. expressions: (field_name, rank_no, expression, distinct_values)."""

    table: DataFrame
    expressions: DataFrame


def profile(
    df: DataFrame,
    loads: DataFrame,
    domains: dict[str, Domain],
    load: str = "load_id",
    series: tuple[str, ...] = ("study_id", "release_no"),
    order: str = "load_no",
    shift_limit: str = "0.3",
    null_limit: str = "0.1",
    distinct_share: str = "0.5",
) -> Profile:
    """Profile of the columns named in `domains` for every load of `df`, compared with the load before.

    df has a row per delivered value row, `loads` one row per load with `series` and a gapless `order`. Other columns of
    either table, whatever their names, are not read. Rows without a load belong to none and are left out; a load that
    `loads` doesn't list, or whose series or order is null, is a first load. Repeated rows count as often as they stand.
    NaN counts as a value outside the domain and, as infinities do, has no text. In a column of texts what is no number is
    outside as well. An empty table gives an empty profile.

    Columns: load_id, field_name, rows, nulls, distinct_values, min_value, max_value, outside, expression (of the column:
    the induced one that covers most distinct values), nonconforming (rows whose text it doesn't match; none where a column
    has no expression shorter than its values), uncovered (rows that no induced expression describes), conforming_share,
    coverage_change, has_prev, and the flags is_nulls, is_range, is_pattern (strict columns: rows don't conform),
    is_distinct, is_shift.
    """
    fields = list(domains)
    kinds = dict(df.dtypes)
    values = cut(distinct_table(df, load, fields), "values")
    found = expressions(values)
    verdicts = found.join(F.broadcast(own_expressions(found)), "f", "left").select(  # a row for each field
        "f", "shape", F.coalesce(F.expr("example RLIKE concat('^(?:', own, ')$')"), F.lit(True)).alias("conforms"), "kept"
    )

    outside, spread, strict = F.lit(False), [], []
    for i, name in enumerate(fields):
        here, dom = F.col("f") == i, domains[name]
        bad = dom.outside(F.col("x"))
        if kinds[name] == "string":
            bad = F.coalesce(bad, F.col("t").isNotNull())
        outside = F.when(here, bad).otherwise(outside)
        if dom.spread:
            spread.append(i)
        if dom.strict:
            strict.append(i)
    present = F.col("x").isNotNull() | F.col("t").isNotNull()
    rows = lambda cond: F.sum(F.when(cond, F.col("c")).otherwise(0)).alias
    # values of one shape share its verdict, so they are added up before it is looked up
    by_shape = values.groupBy("load_id", "f", "shape").agg(
        F.sum("c").alias("c"), rows(~present)("nulls"), F.sum(present.cast("bigint")).alias("distinct_values"),
        F.min("x").alias("min_value"), F.max("x").alias("max_value"), rows(present & outside)("outside"),
    )
    agg = by_shape.join(verdicts, ["f", "shape"], "left").groupBy("load_id", "f").agg(
        F.sum("c").alias("rows"),
        F.sum("nulls").alias("nulls"),
        F.sum("distinct_values").alias("distinct_values"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("outside").alias("outside"),
        rows(~F.col("conforms"))("nonconforming"),
        rows(~F.col("kept"))("uncovered"),
    )
    agg = cut(agg, "profile")

    ids = loads.where(F.col(load).isNotNull()).select(F.col(load).alias("load_id"), *[F.col(s).alias(f"__s{k}") for k, s in enumerate(series)], F.col(order).alias("__no")).dropDuplicates(["load_id"])
    on = [f"__s{k}" for k in range(len(series))]
    pairs = ids.join(ids.select(*on, (F.col("__no") + 1).alias("__no"), F.col("load_id").alias("prev_id")), [*on, "__no"]).select("load_id", "prev_id")
    pairs = cut(pairs, "pairs")
    shift = shifted(values, pairs, Fraction(shift_limit)).withColumn("is_shift", F.lit(True))
    drop_cut(values)

    before = agg.select(F.col("load_id").alias("prev_id"), "f", F.col("rows").alias("rows0"), F.col("nulls").alias("nulls0"), F.col("nonconforming").alias("bad0"))
    whole = agg.join(pairs, "load_id", "left").join(before, ["prev_id", "f"], "left").join(shift, ["load_id", "f"], "left")
    whole = whole.join(F.broadcast(own_expressions(found)), "f", "left")
    big = lambda x: F.col(x).cast("decimal(18,0)")
    nl, ds = Fraction(null_limit), Fraction(distinct_share)
    n = F.col("rows") - F.col("nulls")
    n0 = F.col("rows0") - F.col("nulls0")
    share, share0 = (n - F.col("nonconforming")) / F.nullif(n, F.lit(0)), (n0 - F.col("bad0")) / F.nullif(n0, F.lit(0))
    name = F.element_at(F.array(*[F.lit(x) for x in fields]), F.col("f") + 1).alias("field_name")
    table = whole.select(
        "load_id", name, "rows", "nulls", "distinct_values", "min_value", "max_value", "outside",
        F.col("own").alias("expression"), "nonconforming", "uncovered",
        share.alias("conforming_share"),
        (share - share0).alias("coverage_change"),
        F.col("rows0").isNotNull().alias("has_prev"),
        F.coalesce((big("nulls") * big("rows0") - big("nulls0") * big("rows")) * nl.denominator > big("rows") * big("rows0") * nl.numerator, F.lit(False)).alias("is_nulls"),
        (F.col("outside") > 0).alias("is_range"),
        (F.col("f").isin(strict) & (F.col("nonconforming") > 0)).alias("is_pattern"),
        (F.col("f").isin(spread) & (F.col("distinct_values") * ds.denominator < n * ds.numerator)).alias("is_distinct"),
        F.coalesce("is_shift", F.lit(False)).alias("is_shift"),
    )
    listed = found.where("kept").select(name, F.col("regex").alias("expression"), "distinct_values").distinct()
    rank = F.row_number().over(W.partitionBy("field_name").orderBy(F.desc("distinct_values"), F.desc("expression")))
    return Profile(table, listed.select("field_name", rank.alias("rank_no"), "expression", "distinct_values"))


def issues(table: DataFrame) -> DataFrame:
    """One row (load_id, field_name, issue) for each flag that is set."""
    names = ("nulls", "range", "pattern", "distinct", "shift")
    marks = F.filter(F.array(*[F.when(F.col(f"is_{x}"), F.lit(x)) for x in names]), lambda x: x.isNotNull())
    return table.select("load_id", "field_name", F.explode(marks).alias("issue"))
