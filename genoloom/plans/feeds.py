"""Queries of problem 4: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoloom.operators.drift import Drift, Flooding, Target, reconcile, reference_profiles
from genoloom.plans.tables import table
from genoloom.sources.sumstats import FORMATS


def _names(field: str) -> tuple[str, ...]:
    """The canonical name and those of the public file formats."""
    return tuple(dict.fromkeys([field, *[theirs for names in FORMATS.values() for theirs, ours in names.items() if ours == field]]))


#: The canonical schema: fields of summary statistics, then others that such files hold, under one name each.
TARGETS = (
    Target("PVAL", _names("PVAL"), wanted=True),
    Target("POS", _names("POS"), "integer", wanted=True),
    Target("N", _names("N"), "integer", wanted=True),
    Target("Z", _names("Z"), wanted=True),
    Target("CHR", _names("CHR"), "integer"),
    Target("SNP", _names("SNP"), "string"),
    Target("A1", _names("A1"), "string"),
    Target("A2", _names("A2"), "string"),
    *[Target(c, _names(c)) for c in ("MAF", "BETA", "SE")],
    *[Target(c, (c,)) for c in ("INFO", "CALL_RATE", "HWE_P", "HET_P", "REF_FREQ", "CM")],
    Target("N_CASES", ("N_CASES",), "integer"),
    *[Target(c, (c,), "string") for c in ("TEST", "BATCH")],
)
CASTS = {"PVAL": "double", "POS": "bigint", "N": "double", "Z": "double"}


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fields' values look like in delivered statistics, whose columns have canonical names."""
    columns = {"PVAL": "pval", "POS": "pos", "N": "n", "Z": "z", "CHR": "chr", "MAF": "maf", "BETA": "beta", "SE": "se"}
    return reference_profiles(table(spark, sf_dir, "sumstats"), "load_id", columns)


def _drift(spark: SparkSession, sf_dir: str) -> Drift:
    return reconcile(table(spark, sf_dir, "feed_records"), table(spark, sf_dir, "feed_files"), Flooding(TARGETS), CASTS, reference(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).changes


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all feeds in one table."""
    return _drift(spark, sf_dir).table


QUERIES = {"p4_found": p4_found, "p4_table": p4_table}


# Every name of a field in the feeds, for the SQL alone.
_SQL_NAMES = {
    "PVAL": ("P", "p", "PVAL", "pval", "p_value", "p.value", "pvalue", "P-value", "P_BOLT", "Pr(>|z|)", "PVALUE", "p_val", "P_LRT", "P_BOLT_LMM"),
    "POS": ("POS", "Pos", "pos", "BP", "bp", "position", "base_pair_location", "pos_b1", "GENPOS", "POSITION", "base_pair", "pos_b2"),
    "N": ("N", "n", "nobs", "NMISS", "OBS_CT", "N_total", "n_samples", "TotalSampleSize", "sample_size", "n_total", "Neff"),
    "Z": ("Z", "z", "zscore", "z_score", "Z_STAT", "T_STAT", "STAT", "Tstat", "zstat", "Zscore", "t_stat"),
}


def _list(names: tuple[str, ...]) -> str:
    return ", ".join("'" + n + "'" for n in names)


_FIELD = "CASE " + " ".join(f"WHEN k IN ({_list(names)}) THEN '{f}'" for f, names in _SQL_NAMES.items()) + " END"
_KEYS = f"""keys AS (SELECT record_id, file_id, payload, unnest(json_keys(payload)) AS k FROM feed_records),
cells AS (SELECT record_id, file_id, k, {_FIELD} AS f, json_type(payload, '/' || k) AS t, json_extract_string(payload, '/' || k) AS s FROM keys WHERE {_FIELD} IS NOT NULL)"""
SQL = {
    "p4_found": f"""WITH {_KEYS},
has AS (SELECT file_id, f, k, max(CASE WHEN t = 'NULL' THEN NULL WHEN t IN ('UBIGINT', 'BIGINT') THEN 0 WHEN t = 'DOUBLE' THEN 1 ELSE 2 END) AS w FROM cells GROUP BY 1, 2, 3),
grid AS (SELECT a.file_id, b.file_id AS prev_id, f.f FROM feed_files a JOIN feed_files b ON a.feed = b.feed AND a.seq_no = b.seq_no + 1, (VALUES ('PVAL'), ('POS'), ('N'), ('Z')) f(f)),
two AS (SELECT g.file_id, g.f, h.k, p.k AS k0, h.w, p.w AS w0 FROM grid g LEFT JOIN has h ON h.file_id = g.file_id AND h.f = g.f LEFT JOIN has p ON p.file_id = g.prev_id AND p.f = g.f)
SELECT file_id, f AS field_name, 'added' AS change_kind FROM two WHERE k IS NOT NULL AND k0 IS NULL
UNION ALL SELECT file_id, f, 'removed' FROM two WHERE k IS NULL AND k0 IS NOT NULL
UNION ALL SELECT file_id, f, 'renamed' FROM two WHERE k <> k0
UNION ALL SELECT file_id, f, 'retyped' FROM two WHERE w <> w0""",
    "p4_table": f"""WITH {_KEYS},
nums AS (SELECT record_id, f, TRY_CAST(regexp_replace(regexp_replace(trim(s), '^[A-Za-z]=', ''), '([0-9]),([0-9])', '\\1\\2', 'g') AS DOUBLE) AS x FROM cells)
SELECT r.record_id, r.file_id, max(CASE WHEN f = 'PVAL' THEN x END) AS pval, CAST(trunc(max(CASE WHEN f = 'POS' THEN x END)) AS BIGINT) AS pos,
  max(CASE WHEN f = 'N' THEN x END) AS n, max(CASE WHEN f = 'Z' THEN x END) AS z
FROM feed_records r LEFT JOIN nums USING (record_id) GROUP BY r.record_id, r.file_id""",
}
