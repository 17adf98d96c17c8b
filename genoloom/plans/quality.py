"""Queries of problem 1: profile of every load's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoloom.operators import profile as P
from genoloom.plans.tables import table

#: Domains of the profiled summary-statistics columns (fixed values).
DOMAINS = {
    "maf": P.Domain(0.0, 1.0, low_open=True, high_open=True, spread=True),
    "pval": P.Domain(0.0, 1.0, spread=True),
    "se": P.Domain(low=0.0, low_open=True, spread=True),
    "n": P.Domain(low=0.0, low_open=True, strict=True),
}


def _profile(spark: SparkSession, sf_dir: str) -> P.Profile:
    return P.profile(table(spark, sf_dir, "sumstats"), table(spark, sf_dir, "loads"), DOMAINS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.issues(_profile(spark, sf_dir).table)


def p1_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard aggregates of every load and field."""
    t = _profile(spark, sf_dir).table
    return t.select("load_id", "field_name", "rows", "nulls", "distinct_values", "min_value", "max_value", "outside")


def p1_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression of each column, the rows of every load that don't conform, their share and its change from the load before."""
    t = _profile(spark, sf_dir).table
    return t.select("load_id", "field_name", "expression", "nonconforming", F.round("conforming_share", 9).alias("conforming_share"), F.round("coverage_change", 9).alias("coverage_change"))


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_expressions": p1_expressions}

_LONG = """long AS (
  SELECT load_id, 'maf' AS field_name, maf AS x FROM sumstats UNION ALL SELECT load_id, 'pval', pval FROM sumstats
  UNION ALL SELECT load_id, 'se', se FROM sumstats UNION ALL SELECT load_id, 'n', n FROM sumstats)"""

# What the values of each column should look like; numbers below 0.001 are written with an exponent.
_FORM = r"CASE field_name WHEN 'n' THEN '-?[0-9]+\.0+' WHEN 'maf' THEN '0+\.[0-9]+' ELSE '-?0+\.[0-9]+' END"
SQL = {
    "p1_profile": f"""WITH {_LONG}
SELECT load_id, field_name, count(*) AS rows, count(*) - count(x) AS nulls, count(DISTINCT x) AS distinct_values,
  min(x) AS min_value, max(x) AS max_value,
  CAST(coalesce(sum(CASE WHEN x IS NULL THEN 0 WHEN isnan(x) THEN 1
    WHEN field_name = 'maf' AND NOT (x > 0 AND x < 1) THEN 1 WHEN field_name = 'pval' AND NOT (x >= 0 AND x <= 1) THEN 1
    WHEN field_name IN ('se', 'n') AND NOT x > 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS outside
FROM long WHERE load_id IS NOT NULL GROUP BY 1, 2""",
    "p1_found": f"""WITH {_LONG},
agg AS (
  SELECT load_id, field_name, count(*) AS n_rows, count(x) AS n, count(DISTINCT x) AS d,
    max(CASE WHEN x IS NULL THEN 0 WHEN isnan(x) THEN 1
      WHEN field_name = 'maf' AND NOT (x > 0 AND x < 1) THEN 1 WHEN field_name = 'pval' AND NOT (x >= 0 AND x <= 1) THEN 1
      WHEN field_name IN ('se', 'n') AND NOT x > 0 THEN 1 ELSE 0 END) AS bad,
    max(CASE WHEN field_name = 'n' AND x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AND x <> floor(x) THEN 1 ELSE 0 END) AS frac
  FROM long WHERE load_id IS NOT NULL GROUP BY 1, 2),
pairs AS (
  SELECT a.load_id, b.load_id AS prev_id FROM loads a JOIN loads b
  ON a.study_id = b.study_id AND a.release_no = b.release_no AND a.load_no = b.load_no + 1),
joined AS (
  SELECT a.*, p.prev_id, b.n_rows AS n_rows0, b.n AS n0 FROM agg a LEFT JOIN pairs p USING (load_id)
  LEFT JOIN agg b ON b.load_id = p.prev_id AND b.field_name = a.field_name),
vals AS (SELECT load_id, field_name, x, count(*) AS c FROM long WHERE x IS NOT NULL GROUP BY 1, 2, 3),
step AS (
  SELECT b.load_id, b.field_name, b.n, b.n0, v.x, v.c * b.n0 AS d FROM joined b JOIN vals v ON v.load_id = b.load_id AND v.field_name = b.field_name WHERE b.n0 > 0 AND b.n > 0
  UNION ALL
  SELECT b.load_id, b.field_name, b.n, b.n0, v.x, -v.c * b.n FROM joined b JOIN vals v ON v.load_id = b.prev_id AND v.field_name = b.field_name WHERE b.n0 > 0 AND b.n > 0),
walk AS (SELECT load_id, field_name, n, n0, sum(d) OVER (PARTITION BY load_id, field_name ORDER BY x RANGE UNBOUNDED PRECEDING) AS d FROM step),
shift AS (SELECT DISTINCT load_id, field_name FROM walk WHERE 10 * abs(d) > 3 * CAST(n AS HUGEINT) * n0)
SELECT load_id, field_name, 'nulls' AS issue FROM joined WHERE 10 * ((n_rows - n) * n_rows0 - (n_rows0 - n0) * n_rows) > n_rows * n_rows0
UNION ALL SELECT load_id, field_name, 'range' FROM joined WHERE bad = 1
UNION ALL SELECT load_id, field_name, 'pattern' FROM joined WHERE frac = 1
UNION ALL SELECT load_id, field_name, 'distinct' FROM joined WHERE field_name <> 'n' AND 2 * d < n
UNION ALL SELECT load_id, field_name, 'shift' FROM shift""",
    "p1_expressions": f"""WITH {_LONG},
forms AS (SELECT load_id, field_name, x, {_FORM} AS form FROM long WHERE load_id IS NOT NULL),
own AS (SELECT load_id, field_name, form, count(x) AS n, CAST(coalesce(sum(CASE WHEN NOT regexp_full_match(CAST(x AS VARCHAR), form) OR (x <> 0 AND abs(x) < 0.001) THEN 1 ELSE 0 END), 0) AS BIGINT) AS bad FROM forms GROUP BY ALL),
pairs AS (SELECT a.load_id, b.load_id AS prev_id FROM loads a JOIN loads b ON a.study_id = b.study_id AND a.release_no = b.release_no AND a.load_no = b.load_no + 1)
SELECT o.load_id, o.field_name, CASE WHEN o.field_name = 'se' THEN min(CASE WHEN o.field_name = 'se' AND EXISTS (SELECT 1 FROM sumstats WHERE se < 0 AND se > -1 AND load_id IS NOT NULL) THEN '-?0+\\.[0-9]+' ELSE '0+\\.[0-9]+' END) ELSE min(o.form) END AS expression,
  min(o.bad) AS nonconforming, round(min((o.n - o.bad) / nullif(CAST(o.n AS DOUBLE), 0)), 9) AS conforming_share,
  round(min((o.n - o.bad) / nullif(CAST(o.n AS DOUBLE), 0) - (q.n - q.bad) / nullif(CAST(q.n AS DOUBLE), 0)), 9) AS coverage_change
FROM own o LEFT JOIN pairs p ON p.load_id = o.load_id LEFT JOIN own q ON q.load_id = p.prev_id AND q.field_name = o.field_name GROUP BY o.load_id, o.field_name""",
}
