"""Binary genotypes (two bits a call, variant by variant) as a data source and a writer.

    register(spark); spark.read.format("genoloom_bed").load("panel.bed")

The file is read in ranges of variants, one task each, by seeking; the fam and bim files beside it give the numbers of
samples and variants. Filters on variant_idx, and a list of samples as an option, limit what is read and decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Start of a file with variants as rows; dosage of A1 for each two-bit code, -1 for missing.
MAGIC = bytes([0x6C, 0x1B, 0x01])
DOSAGES = np.array([2, -1, 1, 0], np.int8)
#: Calls of one batch of rows.
BATCH_CALLS = 200_000


def lookup() -> np.ndarray:
    """The four dosages in each of the 256 bytes, lowest bits first."""
    codes = np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    return DOSAGES[codes]


def _open(path: str):
    """A file of any file system that the workers reach by its address; a plain path is a local one. It can be sought in."""
    if "://" in path:
        fs, own = pafs.FileSystem.from_uri(path)
        return fs.open_input_file(own)
    return pafs.LocalFileSystem().open_input_file(path)


def _lines(path: str) -> int:
    count, rest = 0, b""
    with _open(path) as f:
        while chunk := f.read(1 << 20):
            *lines, rest = (rest + chunk).split(b"\n")
            count += sum(1 for x in lines if x.strip())
    return count + bool(rest.strip())


class Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class BedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        base = self.path.removesuffix(".bed")
        self.samples, self.variants = _lines(base + ".fam"), _lines(base + ".bim")
        self.stride = -(-self.samples // 4)
        keep = options.get("samples")
        self.keep = np.array(sorted({int(x) for x in keep.split(",")}), np.int64) if keep else None
        self.mb = int(options.get("blockMb", 32))
        self.low, self.high = 0, self.variants
        with _open(self.path) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path} is no file of genotypes by variant")
            size = f.size()
        if size != 3 + self.stride * self.variants:
            raise ValueError(f"{self.path} doesn't fit its fam and bim files")

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("variant_idx",):
                if isinstance(f, GreaterThan):
                    self.low = max(self.low, int(f.value) + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, int(f.value))
                elif isinstance(f, LessThan):
                    self.high = min(self.high, int(f.value))
                elif isinstance(f, LessThanOrEqual):
                    self.high = min(self.high, int(f.value) + 1)
            yield f

    def partitions(self) -> list[Range]:
        size = max(1, self.mb * 2**20 // max(1, self.stride * 40))  # rows grow when they are decoded
        return [Range(a, min(a + size, self.high)) for a in range(self.low, self.high, size)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        table = lookup()
        at = self.keep if self.keep is not None else np.arange(self.samples)
        several = max(1, BATCH_CALLS // max(1, len(at)))
        with _open(self.path) as f:
            f.seek(3 + partition.start * self.stride)
            for first in range(partition.start, partition.end, several):
                count = min(several, partition.end - first)
                rows = np.frombuffer(f.read(count * self.stride), np.uint8).reshape(count, self.stride)
                # only the bytes with chosen samples are decoded
                g = table[rows[:, at // 4], at % 4].ravel()
                variants = np.repeat(np.arange(first, first + count, dtype=np.int64), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(at, count)), pa.array(variants), pa.array(g, mask=g < 0)], names=["sample_idx", "variant_idx", "dosage"])


class BedSource(DataSource):
    """Calls in long form: sample_idx, variant_idx, dosage (null = missing)."""

    @classmethod
    def name(cls) -> str:
        return "genoloom_bed"

    def schema(self) -> str:
        return "sample_idx bigint, variant_idx bigint, dosage tinyint"

    def reader(self, schema) -> BedReader:
        return BedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BedSource)


def write_bed(calls: DataFrame, path: str, samples: int) -> None:
    """Writes calls to a local file; variants are packed in tasks and stream through the driver in their order."""
    code = np.array([3, 2, 0, 1], np.uint8)  # of dosage 0, 1, 2 and missing

    def pack(batches):
        import pandas as pd

        for b in batches:
            out = []
            for at, g in zip(b.s, b.g):
                full = np.full(-(-samples // 4) * 4, 3, np.int64)
                full[np.array(at, np.int64)] = np.where(np.array(g) < 0, 3, np.array(g))
                full[samples:] = 0
                bits = code[full]
                bits[samples:] = 0
                out.append((bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes())
            yield pd.DataFrame({"variant_idx": b.variant_idx, "row": out})

    from pyspark.sql import functions as F

    lists = calls.groupBy("variant_idx").agg(F.collect_list("sample_idx").alias("s"), F.collect_list(F.coalesce("dosage", F.lit(-1)).cast("int")).alias("g"))
    rows = lists.mapInPandas(pack, "variant_idx bigint, row binary").orderBy("variant_idx")
    with open(path, "wb") as f:
        f.write(MAGIC)
        for r in rows.toLocalIterator():
            f.write(r.row)
