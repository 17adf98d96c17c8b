"""Cutting lineage through tables in the folder that all executors share, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as text) up to which a lookup side may be broadcast; beyond either a shuffled join is planned.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is set (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.TemporaryDirectory(prefix="genoloom-")
    atexit.register(own.cleanup)
    spark.sparkContext.setCheckpointDir(f"file://{own.name}")
    return f"file://{own.name}"


def _folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one, deleted when the application ends."""
    root = f"{shared_dir(spark)}/genoloom/{spark.sparkContext.applicationId}"
    if root not in _FOLDERS:
        _FOLDERS.add(root)
        atexit.register(_delete, spark.sparkContext._jvm, spark._jsc.hadoopConfiguration(), root)
    return root


_FOLDERS: set[str] = set()


def _delete(jvm, conf, path: str) -> None:
    try:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  at the end of the application the JVM may be gone; the folder's name tells whose it was
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder, for files of other formats."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, computed once and written as a parquet table in the shared folder; survives the loss of executors."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() returned and that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        _delete(spark.sparkContext._jvm, spark._jsc.hadoopConfiguration(), df._cut_path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most `rows` rows and `size` bytes, else unchanged.

    The count stops as soon as the bound of rows is passed.
    """
    told = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()
    return F.broadcast(df) if told[0] <= rows and (told[1] or 0) <= size else df


def sorted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the input, as a merge of both sorted.

    Without the hint Spark takes a side for small by the compressed bytes of the files or blocks it comes from, however many
    rows were made of them, and builds a table of it in the driver's memory.
    """
    return left.join(right.hint("merge"), on, how)


def salted_join(big: DataFrame, side: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Join where a key of `big` may be hot: its rows are spread over `salts` copies of the matching rows of `side`.

    `how` is inner, left, left_semi or left_anti, seen from `big`. A `side` counted as small is broadcast instead.
    """
    hinted = small(side)
    if hinted is not side:
        return big.join(hinted, on, how)
    salted = big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
