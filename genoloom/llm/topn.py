"""The N best rows of every group through one global, range-partitioned sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether two arrays agree element by element; nulls agree with nulls."""
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def top_n(df: DataFrame, groups: list[str], order: list[tuple[Column, str]], item: str, n: int, partitions: int | None = None) -> DataFrame:
    """(groups..., rank_no, item) of the first n rows of every group in the given order.

    order: pairs of a Column and the name of its direction (asc, desc_nulls_last, ...). It should end in a unique identifier, so that the
    result is always the same; rows that tie in every order column come in no promised order. Repeated rows count each,
    null is a group like any other, NaN an ordinary value above all numbers. Only the named columns are read, so extra
    ones may have any names. An empty table gives an empty result.

    All rows are sorted over (groups, order) into ranges, so that a group with a third of all rows spans many
    partitions. A partition numbers its rows from the start of each group and keeps positions up to n; of the group that
    is open at its end it also gives the number of rows. These counts, summed over the partitions before, turn local into
    exact positions.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    spark = df.sparkSession
    keys = [f"__g{i}" for i in range(len(groups))]
    # an order column becomes a plain one of its own, so that groups, order and item may share columns
    sorts = []
    cols = [F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)] + [F.col(f"`{item}`").alias("__item")]
    for i, (column, direction) in enumerate(order):
        cols.append(column.alias(f"__o{i}"))
        sorts.append(getattr(F.col(f"__o{i}"), direction)())
    chosen = df.select(*cols)
    by = [F.col(k).asc_nulls_first() for k in keys] + sorts
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = chosen.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(*keys, "__item")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        schema: pa.Schema | None = None
        last: pa.RecordBatch | None = None
        held = 0  # rows so far of the group that is open
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                own = batch.column(k)
                before = pa.concat_arrays([last.column(k) if last is not None else own.slice(0, 1), own.slice(0, batch.num_rows - 1)])
                new |= ~_same(own, before)
            new[0] = new[0] or last is None
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            pos = np.where(start >= 0, at - start + 1, at + 1 + held)
            held = int(pos[-1])
            last = batch.slice(batch.num_rows - 1, 1)
            keep = pa.array(np.flatnonzero(pos <= n))
            if len(keep):
                small = batch.take(keep)
                k = small.num_rows
                out = [small.column(c) for c in range(small.num_columns)] + [pa.array([pid] * k, pa.int32()), pa.array(pos[pos <= n], pa.int64()), pa.nulls(k, pa.int64())]
                schema = pa.schema([*batch.schema, ("pid", pa.int32()), ("pos", pa.int64()), ("rows", pa.int64())])
                yield pa.RecordBatch.from_arrays(out, schema=schema)
        if last is not None:
            cells = [last.column(k) for k in keys] + [pa.nulls(1, last.column("__item").type)]
            schema = pa.schema([pa.field(f.name, f.type) for f in last.schema] + [("pid", pa.int32()), ("pos", pa.int64()), ("rows", pa.int64())])
            yield pa.RecordBatch.from_arrays([*cells, pa.array([pid], pa.int32()), pa.nulls(1, pa.int64()), pa.array([held], pa.int64())], schema=schema)

    kinds = {f.name: f.dataType.simpleString() for f in ranged.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"__item {kinds['__item']}", "pid int", "pos bigint", "rows bigint"])
    kept = ranged.mapInArrow(local, schema)
    earlier = W.partitionBy(*keys).orderBy("pid").rangeBetween(W.unboundedPreceding, -1)
    placed = kept.withColumn("rank_no", F.col("pos") + F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return placed.where(F.col("rank_no") <= n).select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col("rank_no").cast("int").alias("rank_no"), F.col("__item").alias(item))
