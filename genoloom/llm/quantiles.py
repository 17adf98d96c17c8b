"""Percentiles per group from mergeable summaries with a tracked, bounded rank error.

A summary is a sorted list of values, each with the interval [lo, hi] that its rank lies in, and the number of rows. It is
exact while lo = hi. Merging adds the intervals; compressing drops values while neighbours stay within the permitted
uncertainty. Both are deterministic, so a lost task gives the same summary again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]

#: Rows a task holds before it turns them into summaries; bounds its memory whatever the number of groups.
HELD_ROWS = 500_000
#: Summaries merged at once; more are merged in levels.
FAN_IN = 32


def exact(values: np.ndarray) -> Summary:
    v = np.sort(values)
    ranks = np.arange(1, len(v) + 1, dtype=np.int64)
    return v, ranks, ranks, len(v)


def compress(s: Summary, slack: float) -> Summary:
    """Drops values while every dropped rank stays between two kept ones whose interval is at most 2 * slack * n wide."""
    v, lo, hi, n = s
    room = 2 * slack * n
    if room < 2 or len(v) < 3:
        return s
    keep, i, last = [0], 0, len(v) - 1
    while i < last:
        i = min(last, max(i + 1, int(np.searchsorted(hi, lo[i] + room, side="right")) - 1))
        keep.append(i)
    return v[keep], lo[keep], hi[keep], n


def merge(parts: list[Summary]) -> Summary:
    """Union of summaries; equal values keep the order of the parts, so ties never widen an interval."""
    parts = [p for p in parts if p[3]]
    if not parts:
        return np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), 0
    loose = [p for p in parts if len(p[0]) != p[3]]
    tight = [p for p in parts if len(p[0]) == p[3]]
    if tight:
        loose.append(tight[0] if len(tight) == 1 else exact(np.concatenate([p[0] for p in tight])))
    if len(loose) == 1:
        return loose[0]
    vs, los, his = [], [], []
    for i, (v, lo, hi, _) in enumerate(loose):
        a, b = lo.copy(), hi.copy()
        for j, (w, wlo, whi, m) in enumerate(loose):
            if i != j:
                at = np.searchsorted(w, v, side="right" if j < i else "left")  # values of j that come before
                a += np.where(at > 0, wlo[np.maximum(at - 1, 0)], 0)
                b += np.where(at < len(w), whi[np.minimum(at, len(w) - 1)] - 1, m)
        vs.append(v), los.append(a), his.append(b)
    v = np.concatenate(vs)
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate(los)[order], np.concatenate(his)[order], sum(p[3] for p in loose)


def uncertainty(s: Summary) -> int:
    """The largest distance of any asked rank from the rank of the value given for it."""
    v, lo, hi, n = s
    if not n:
        return 0
    gap = int(((hi[1:] - lo[:-1] + 1) // 2).max()) if len(v) > 1 else 0
    return max(gap, int((hi - lo).max()))


def at_rank(s: Summary, rank: int) -> tuple[float, int, int]:
    """(value, lo, hi) whose rank interval is nearest to the asked rank."""
    v, lo, hi, _ = s
    k = int(np.argmin(np.maximum(rank - lo, hi - rank)))
    return float(v[k]), int(lo[k]), int(hi[k])


class Stack:
    """Merges any number of summaries in levels of FAN_IN; level i may use slack / 2^(i + 1), so that all of it never exceeds slack."""

    def __init__(self, slack: float) -> None:
        self.slack, self.levels = slack, []

    def add(self, s: Summary, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(s)
        if len(self.levels[level]) == FAN_IN:
            full, self.levels[level] = self.levels[level], []
            self.add(compress(merge(full), self.slack / 2 ** (level + 2)), level + 1)

    def total(self) -> Summary:
        """Compressed only if that makes it smaller than what came in."""
        return compress(merge([s for level in self.levels for s in level]), self.slack / 2)


_FIELDS = "v array<double>, lo array<bigint>, hi array<bigint>, n bigint"


def _rows(batch: pa.RecordBatch) -> Iterator[Summary]:
    lists = [batch.column(c) for c in ("v", "lo", "hi")]
    flat = [x.values.to_numpy(zero_copy_only=False) for x in lists]
    offs = [x.offsets.to_numpy() for x in lists]
    for i, n in enumerate(batch.column("n").to_pylist()):
        v, lo, hi = (f[o[i] : o[i + 1]] for f, o in zip(flat, offs))
        if len(lo) == 0 and n:
            lo = hi = np.arange(1, n + 1, dtype=np.int64)
        yield v, lo, hi, n


def _batch(keys: list[str], types: list[pa.DataType], rows: list[tuple[tuple, Summary]]) -> pa.RecordBatch:
    """Exact summaries carry no ranks."""
    cols = [pa.array([k[i] for k, _ in rows], t) for i, t in enumerate(types)]
    none = np.empty(0, np.int64)
    for at, kind in ((0, pa.float64()), (1, pa.int64()), (2, pa.int64())):
        lists = [none if at and len(s[0]) == s[3] else s[at] for _, s in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else none, kind)))
    cols.append(pa.array([s[3] for _, s in rows], pa.int64()))
    return pa.RecordBatch.from_arrays(cols, names=[*keys, "v", "lo", "hi", "n"])


def summarize(df: DataFrame, keys: list[str], value: str, slack: float) -> DataFrame:
    """(keys..., part, v, lo, hi, n): summaries of the rows that single tasks hold; null and NaN values are left out.

    A key may come out more than once, as often as tasks hold rows of it. Nothing is shuffled.
    """
    x = F.col(f"`{value}`").cast("double")
    chosen = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            codes = np.zeros(t.num_rows, np.int64)
            for k in names:  # one whole number for each group; null is a group
                code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                codes = codes * (int(code.max()) + 1) + code
            v = t.column("x").to_numpy()
            order = np.lexsort((v, codes))
            codes, v = codes[order], v[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(v)]])
            first = t.select(names).take(pa.array(order[cuts[:-1]])).to_pylist()
            rows = []
            for i, key in enumerate(first):
                rows.append(((*key.values(), part), compress(exact(v[cuts[i] : cuts[i + 1]]), slack)))
            return _batch([*names, "part"], [*[t.schema.field(k).type for k in names], pa.int32()], rows)

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= HELD_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    out = chosen.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in names) + f", part int, {_FIELDS}")
    return out.select(*[F.col(k).alias(g) for k, g in zip(names, keys)], "part", "v", "lo", "hi", "n")


def combine(summaries: DataFrame, keys: list[str], slack: float) -> DataFrame:
    """(keys..., v, lo, hi, n): the summaries of each key merged into one. Null is a key like any other."""
    names = [f"k{i}" for i in range(len(keys))]
    chosen = summaries.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "v", "lo", "hi", "n")
    parts = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = chosen.repartition(parts, *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack, types, done, size = None, None, None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(k).type for k in names]
            for k, s in zip(zip(*[b.column(n).to_pylist() for n in names]), _rows(b)):
                if stack is None or k != key:
                    if stack is not None:
                        done.append((key, stack.total()))
                        size += len(done[-1][1][0])
                        if size > HELD_ROWS:
                            yield _batch(names, types, done)
                            done, size = [], 0
                    key, stack = k, Stack(slack)
                stack.add(s)
        if stack is not None:
            done.append((key, stack.total()))
            yield _batch(names, types, done)

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    out = sorted_.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in names) + f", {_FIELDS}")
    return out.select(*[F.col(k).alias(g) for k, g in zip(names, keys)], "v", "lo", "hi", "n")


def load_summaries(df: DataFrame, part: str, group: str, value: str, error: float = 0.001) -> DataFrame:
    """One summary for each (part, group), e.g. load and chromosome, with rank error up to error / 2 of its rows.

    Tasks' summaries of a hot pair are merged in two steps, so no task gets all of them.
    """
    local = summarize(df, [part, group], value, error / 8)
    local = local.withColumn("__some", F.floor(F.col("part") / FAN_IN))
    return combine(combine(local, [part, group, "__some"], error / 8), [part, group], error / 4)


def unite(summaries: DataFrame, part: str, group: str, error: float = 0.001) -> DataFrame:
    """One summary for each group over all parts, with rank error up to `error` of its rows, from load_summaries."""
    buckets = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = summaries.withColumn("__some", F.pmod(F.xxhash64(part), F.lit(buckets)))
    return combine(combine(spread, [group, "__some"], error / 4), [group], error / 4)


def percentiles(summaries: DataFrame, keys: list[str], asked: list[float]) -> DataFrame:
    """(keys..., percentile, value, n, rank_lo, rank_hi, error_bound) for each asked percentile.

    The asked rank is ceil(p / 100 * n), at least 1. The value's true rank lies in [rank_lo, rank_hi]; error_bound is how
    far, as a share of n, it can at most be from the asked one.
    """
    names = [f"k{i}" for i in range(len(keys))]
    chosen = summaries.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "v", "lo", "hi", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, s in zip(zip(*[b.column(n).to_pylist() for n in names]), _rows(b)):
                for p in asked:
                    rank = max(1, int(np.ceil(round(p / 100 * s[3], 9))))
                    value, lo, hi = at_rank(s, rank)
                    rows.append((*k, p, value, s[3], lo, hi, max(rank - lo, hi - rank) / s[3]))
            types = [*[b.schema.field(n).type for n in names], pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "percentile", "value", "n", "rank_lo", "rank_hi", "error_bound"])

    kinds = {f.name: f.dataType.simpleString() for f in chosen.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in names) + ", percentile double, value double, n bigint, rank_lo bigint, rank_hi bigint, error_bound double"
    out = chosen.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(g) for k, g in zip(names, keys)], "percentile", "value", "n", "rank_lo", "rank_hi", "error_bound")
