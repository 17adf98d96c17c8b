"""Readers and writers of text tables: samples, variants, lists, intervals, annotations, phenotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Numbers of the chromosomes that have letters.
LETTERED = {"x": 23, "y": 24, "xy": 25, "m": 26, "mt": 26}


def chromosome(name: str) -> int | None:
    """Number of a chromosome: 7, chr7, X, chrMT; null for what is none."""
    own = name.lower().removeprefix("chr")
    return LETTERED.get(own, int(own) if own.isdigit() else None)


def chromosome_column(name: Column) -> Column:
    own = F.regexp_replace(F.lower(name), "^chr", "")
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LETTERED.items() for x in pair]), own), own.try_cast("int"))


def _fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(f): the whitespace-separated fields of every line that isn't empty."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where("size(f) > 0 AND f[0] <> ''")


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def _header(spark: SparkSession, path: str | list[str]) -> list[str]:
    return _fields(spark, path).first().f


def _value(x: Column) -> Column:
    """Text with the usual marks of missing values as null."""
    return F.when(~F.lower(x).isin("na", "nan", "none", "null", "."), x)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, read from one file, with the number of each row (from 0). Only the rows per partition go through one task."""
    tagged = df.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    counts = tagged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__p", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    local = F.col("__m") - F.shiftleft("__p", 33)
    return tagged.join(F.broadcast(before), "__p").select(*df.columns, (F.col("__o") + local).alias(name))


def _drop_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    counts = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if counts[c] == 0])


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """CHR, SNP, cM, POS, A1, A2 of a .bim file (a .bed path is understood)."""
    path = path[:-4] + ".bim" if path.endswith(".bed") else path
    kinds = [("SNP", "string"), ("cM", "float"), ("POS", "int"), ("A1", "string"), ("A2", "string")]
    return _fields(spark, path).select(chromosome_column(_at(0)).alias("CHR"), *[_at(i + 1).try_cast(t).alias(n) for i, (n, t) in enumerate(kinds)])


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """FID, IID, fatherID, motherID, sex, phenotype; sex 0 and phenotype -9 are null, and columns without any value are dropped."""
    path = path[:-4] + ".fam" if path.endswith(".bed") else path
    f = _fields(spark, path)
    sex, y = _at(4).try_cast("float"), _at(5).try_cast("float")
    df = f.select(*[_at(i).alias(n) for i, n in enumerate(("FID", "IID", "fatherID", "motherID"))], F.nullif(sex, F.lit(0.0)).alias("sex"), F.nullif(y, F.lit(-9.0)).alias("phenotype"))
    return _drop_empty(df, ["sex", "phenotype"])


def read_snp_list(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    return spark.read.csv(path, sep="\t").select(F.col(f"_c{column}").alias("SNP"))


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """IID of a file with one column (IID) or two (FID, IID)."""
    n = len(_header(spark, path))
    if n > 2:
        raise ValueError("a sample list has one or two columns")
    return _fields(spark, path).select(_at(n - 1).alias("IID"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path).select(*[_at(i).alias(n) for i, n in enumerate(("FID", "IID", "Cluster"))])


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """chr, start_pos, end_pos from the first three columns of a BED file; chr prefixes go, lines that don't fit too."""
    df = _fields(spark, path).select(chromosome_column(_at(0)).alias("chr"), _at(1).try_cast("int").alias("start_pos"), _at(2).try_cast("int").alias("end_pos"))
    return df.dropna()


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """chr, block_start, block_end; lines with None or without numbers (such as a header) are dropped."""
    return read_intervals(spark, path).withColumnsRenamed({"start_pos": "block_start", "end_pos": "block_end"})


def read_annotations(spark: SparkSession, path: str, ldsc: bool = False, rename: dict[str, str] | None = None) -> DataFrame:
    """CHR, SNP, POS and every other column as a number. ldsc: BP is the position, CM and base are dropped."""
    names = _header(spark, path)
    df = _fields(spark, path).where(_at(0) != names[0]).select(*[_value(_at(i)).alias(n) for i, n in enumerate(names)])
    df = df.withColumnsRenamed({"BP": "POS"} if ldsc else rename or {}).drop(*(("CM", "base") if ldsc else ()))
    kind = {"CHR": "int", "POS": "int", "SNP": "string"}
    return df.select(*[F.col(c).try_cast(kind.get(c, "double")).alias(c) for c in df.columns]).dropna().orderBy("CHR", "POS")


def _joined(spark: SparkSession, samples: DataFrame, path: str, named: list[str] | None, prefix: str) -> tuple[DataFrame, list[str]]:
    first = _header(spark, path)
    has = "FID" in first or "IID" in first
    names = first if has else ["FID", "IID", *(named or [f"{prefix}_{i}" for i in range(1, len(first) - 1)])]
    rows = _fields(spark, path)
    rows = rows.where(~((_at(0) == first[0]) & (_at(1) == first[1]))) if has else rows
    return rows.select(*[_value(_at(i)).alias(n) for i, n in enumerate(names)]), [n for n in names if n not in ("FID", "IID")]


def read_phenotype(spark: SparkSession, samples: DataFrame, path: str, drop_na: bool = True) -> DataFrame:
    """samples with the phenotype of a file (header or not); -9 is null; samples that the file lacks are dropped."""
    rows, cols = _joined(spark, samples, path, ["phenotype"], "phenotype")
    y = F.nullif(F.col(cols[0]).try_cast("double"), F.lit(-9.0)).alias("phenotype")
    out = samples.drop("phenotype").join(rows.select("FID", "IID", y), ["FID", "IID"])
    return out.where("phenotype IS NOT NULL") if drop_na else out


def read_covariates(spark: SparkSession, samples: DataFrame, path: str) -> DataFrame:
    rows, cols = _joined(spark, samples, path, None, "covar")
    return samples.join(rows.select("FID", "IID", *[F.col(c).try_cast("double").alias(c) for c in cols]), ["FID", "IID"])


def write_table(df: DataFrame, path: str, header: bool = True, gzip: bool = False) -> None:
    """Tab-separated text; annotations are usually compressed."""
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path, sep="\t", header=header, nullValue="NA")
