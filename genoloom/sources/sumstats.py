"""Summary-statistics files in the usual formats: renaming to canonical columns and back."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.functions.stats import div

#: Canonical columns and their types, the formats' names for them, and what an analysis needs at least.
CANONICAL = {"CHR": "int", "SNP": "string", "POS": "int", "A1": "string", "A2": "string", "MAF": "double", "N": "double", "BETA": "double", "OR": "double", "Z": "double", "SE": "double", "PVAL": "double", "CHISQ": "double", "MAC": "double"}
FORMATS = {
    "canonical": {},
    "plink2": {"#CHROM": "CHR", "ID": "SNP", "P": "PVAL", "OBS_CT": "N", "A1_FREQ": "MAF", "T_STAT": "Z", "Z_STAT": "Z"},
    "plink1.9": {"P": "PVAL", "NMISS": "N", "STAT": "Z", "BP": "POS"},
    "cojo": {"freq": "MAF", "b": "BETA", "se": "SE", "p": "PVAL"},
    "fastgwa": {"AF1": "MAF", "P": "PVAL"},
    "ssf": {"chromosome": "CHR", "base_pair_location": "POS", "rsid": "SNP", "effect_allele": "A1", "other_allele": "A2", "beta": "BETA", "standard_error": "SE", "effect_allele_frequency": "MAF", "p_value": "PVAL", "n": "N"},
    "saige": {"MarkerID": "SNP", "Allele1": "A2", "Allele2": "A1", "AF_Allele2": "MAF", "AC_Allele2": "MAC", "Tstat": "Z", "p.value": "PVAL"},
}
#: Other names of the formats; plink alone is its second version.
ALIASES = {"plink": "plink2", "plink1": "plink1.9", "gwas-catalog": "ssf", "gwascatalog": "ssf", "gwas-ssf": "ssf", "gcta": "fastgwa"}
#: Groups of columns, of each the first that is wholly there must not be missing.
KEYS = (("SNP", "A1"), ("CHR", "POS", "A1"))
EFFECTS = (("BETA", "SE"), ("Z",), ("PVAL", "BETA"), ("PVAL", "OR"), ("PVAL", "Z"), ("CHISQ", "BETA"), ("CHISQ", "OR"), ("CHISQ", "Z"))


@dataclass(frozen=True)
class Format:
    name: str
    names: dict[str, str] = field(default_factory=dict)
    separator: str = "\t"


def get_format(name: str, names: dict[str, str] | str | None = None) -> Format:
    """A registered format, with further names given as a dict or as text such as a=BETA,b=SE."""
    own = ALIASES.get(name.lower(), name.lower())
    if own not in FORMATS:
        raise KeyError(f"unknown format {name}; known: {', '.join(FORMATS)}")
    if isinstance(names, str):
        names = dict(x.split("=", 1) for x in names.split(","))
    return Format(own, FORMATS[own] | (names or {}))


def essential(columns: list[str]) -> list[str]:
    """The columns that must not be missing: the first key group and the first effect group that are wholly there."""
    out: list[str] = []
    for groups in (KEYS, EFFECTS):
        out += next((list(g) for g in groups if set(g) <= set(columns)), [])
    return list(dict.fromkeys(out))


def canonical(df: DataFrame, fmt: Format, drop_na: bool = True) -> DataFrame:
    """A table with a format's names, renamed, typed and completed (A2 in plink2, N in SAIGE)."""
    taken: dict[str, str] = {}
    for c in df.columns:
        taken.setdefault(fmt.names.get(c, c), c)
    df = df.select(*[F.col(f"`{c}`").alias(n) for n, c in taken.items()])
    missing = lambda c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin("na", "nan", "", ".", "null"), F.col(f"`{c}`"))

    def typed(c: str) -> Column:
        x = F.col(f"`{c}`")
        if c not in CANONICAL:
            return x
        x = missing(c) if dict(df.dtypes)[c] == "string" else x
        if c == "CHR":
            x = F.regexp_replace(x.cast("string"), "(?i)^chr", "").try_cast("double")
        return (x.try_cast("double").try_cast("int") if CANONICAL[c] == "int" else x.try_cast(CANONICAL[c])).alias(c)

    df = df.select(*[typed(c) for c in df.columns])
    if fmt.name == "plink2" and "A2" not in df.columns:
        alt = next((c for c in ("ALT1", "ALT") if c in df.columns), None)
        if alt and "REF" in df.columns:
            df = df.withColumn("A2", F.when(F.col("A1") == F.col(alt), F.col("REF")).otherwise(F.col(alt)))
    if fmt.name == "saige" and "N" not in df.columns and {"MAC", "MAF"} <= set(df.columns):
        df = df.withColumn("N", div(F.col("MAC"), 2 * F.col("MAF")))
    return df.dropna(subset=essential(df.columns)) if drop_na and essential(df.columns) else df


def read_sumstats(spark: SparkSession, path: str | list[str], fmt: str = "canonical", names: dict[str, str] | str | None = None, drop_na: bool = True) -> DataFrame:
    """Canonical table of text files with a header, divided by tabs or other white space."""
    f = get_format(fmt, names)
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError("no header")
    if "\t" in first.value:
        df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    else:
        head = first.value.split()
        rows = spark.read.text(path).where(F.col("value") != first.value).select(F.split(F.trim("value"), r"\s+").alias("f"))
        df = rows.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(head)])
    return canonical(df, f, drop_na)


def formatted(df: DataFrame, fmt: str = "canonical") -> DataFrame:
    """The canonical columns of df under a format's names."""
    back: dict[str, str] = {}
    for theirs, ours in get_format(fmt).names.items():
        back.setdefault(ours, theirs)
    return df.select(*[F.col(c).alias(back.get(c, c)) for c in df.columns if c in CANONICAL])


def write_sumstats(df: DataFrame, path: str, fmt: str = "canonical") -> None:
    formatted(df, fmt).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA")
