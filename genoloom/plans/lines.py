"""Queries of problem 3: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoloom.operators.rejects import Check, Loaded, load_lines
from genoloom.plans.tables import table

CHECKS = [Check("BETA"), Check("SE", low=0.0, low_open=True), Check("PVAL", low=0.0, high=1.0)]


def _load(spark: SparkSession, sf_dir: str) -> Loaded:
    return load_lines(table(spark, sf_dir, "raw_lines"), table(spark, sf_dir, "raw_files"), CHECKS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load(spark, sf_dir).rejected


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed rows."""
    return _load(spark, sf_dir).rows.select("line_id", "file_id", "line_no", "beta", "se", "pval")


QUERIES = {"p3_found": p3_found, "p3_rows": p3_rows}

# The SQL reads a line with regular expressions instead of dividing it at its quotes. \\x00 to \\x02 don't occur in the tables.
_PARSED = r"""files AS (
  SELECT file_id, CASE separator WHEN 'tab' THEN chr(9) WHEN 'comma' THEN ',' WHEN 'semicolon' THEN ';' ELSE ' ' END AS s,
    string_split(column_list, ',') AS names FROM raw_files),
base AS (
  SELECT l.line_id, l.file_id, l.line_no, f.s, f.names,
    CASE WHEN f.s = ' ' THEN trim(regexp_replace(l.raw, '\r$', ''), ' ') ELSE regexp_replace(l.raw, '\r$', '') END AS t
  FROM raw_lines l JOIN files f USING (file_id) WHERE l.line_no <> 1),
formed AS (
  SELECT *, CASE s
    WHEN ' ' THEN regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^" ]*)(?: +(?:"(?:[^"]|"")*"|[^" ]*))*')
    WHEN ',' THEN regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
    WHEN ';' THEN regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^";]*)(?:;(?:"(?:[^"]|"")*"|[^";]*))*')
    ELSE regexp_full_match(t, '(?s)(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*))*') END AS sound FROM base),
cells AS (
  SELECT *, CASE WHEN NOT sound THEN NULL ELSE (CASE s
    WHEN ' ' THEN regexp_extract_all(' ' || t, '(?s) +("(?:[^"]|"")*"|[^" ]*)', 1)
    WHEN ',' THEN regexp_extract_all(',' || t, '(?s),("(?:[^"]|"")*"|[^",]*)', 1)
    WHEN ';' THEN regexp_extract_all(';' || t, '(?s);("(?:[^"]|"")*"|[^";]*)', 1)
    ELSE regexp_extract_all(chr(9) || t, '(?s)\t("(?:[^"]|"")*"|[^"\t]*)', 1) END) END AS c FROM formed),
vals AS (
  SELECT *, trim(regexp_replace(c[list_position(names, 'BETA')], '(?s)^"(.*)"$', '\1'), ' ') AS b,
    trim(regexp_replace(c[list_position(names, 'SE')], '(?s)^"(.*)"$', '\1'), ' ') AS e,
    trim(regexp_replace(c[list_position(names, 'PVAL')], '(?s)^"(.*)"$', '\1'), ' ') AS p FROM cells),
nums AS (
  SELECT *, lower(b) IN ('', 'na', 'nan', 'null', '.') AS bn, lower(e) IN ('', 'na', 'nan', 'null', '.') AS en, lower(p) IN ('', 'na', 'nan', 'null', '.') AS pn,
    CASE WHEN regexp_full_match(b, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(ltrim(b, '+') AS DOUBLE) END AS beta,
    CASE WHEN regexp_full_match(e, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(ltrim(e, '+') AS DOUBLE) END AS se,
    CASE WHEN regexp_full_match(p, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(ltrim(p, '+') AS DOUBLE) END AS pval FROM vals),
judged AS (
  SELECT line_id, file_id, line_no, beta, se, pval, CASE WHEN NOT sound THEN 'quoting' WHEN len(c) <> len(names) THEN 'columns'
    WHEN (NOT bn AND beta IS NULL) OR (NOT en AND (se IS NULL OR se <= 0)) OR (NOT pn AND (pval IS NULL OR pval < 0 OR pval > 1)) THEN 'value' END AS reason FROM nums)"""
SQL = {
    "p3_found": f"WITH {_PARSED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_rows": f"WITH {_PARSED} SELECT line_id, file_id, line_no, beta, se, pval FROM judged WHERE reason IS NULL",
}
