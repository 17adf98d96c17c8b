"""Queries of problem 2: markers and variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoloom.llm.entities import match_markers
from genoloom.plans.tables import table


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their confidence."""
    return match_markers(table(spark, sf_dir, "variants"), table(spark, sf_dir, "markers"), table(spark, sf_dir, "build_shifts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("variant_idx", "marker_id")


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}

# The SQL has fixed rules in place of the mixture: what contradicts nothing matches; of several, the one that the name
# gives, then the one with the nearest frequency.
_RC = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
SQL = {
    "p2_found": f"""WITH
v AS (
  SELECT v.variant_idx, v.chr, v.pos, upper(v.a1) AS v1, upper(v.a2) AS v2, v.maf, regexp_extract(v.snp, '([0-9]+)$', 1) AS rs,
    v.pos + s.shift_bp AS b2, v.pos + 1 + t.shift_bp AS b2n, length(v.a1) <> length(v.a2) AS indel,
    CASE WHEN length(v.a1) >= length(v.a2) THEN upper(v.a1) ELSE upper(v.a2) END AS long
  FROM variants v LEFT JOIN build_shifts s ON s.chr = v.chr AND v.pos BETWEEN s.region_start AND s.region_end
  LEFT JOIN build_shifts t ON t.chr = v.chr AND v.pos + 1 BETWEEN t.region_start AND t.region_end),
m AS (
  SELECT marker_id, TRY_CAST(regexp_extract(chr, '^\\s*(?:(?i)chr_?)?0*([0-9]+)(?:\\.0*)?\\s*$', 1) AS INT) AS chr, pos, build, upper(trim(a1)) AS a, upper(trim(a2)) AS b, maf,
    TRY_CAST(regexp_extract(trim(marker_name), '^(?:chr)?([0-9]+)[:_.\\-]([0-9]+)([:_.\\-].*)?$', 1) AS INT) AS nchr,
    TRY_CAST(regexp_extract(trim(marker_name), '^(?:chr)?([0-9]+)[:_.\\-]([0-9]+)([:_.\\-].*)?$', 2) AS INT) AS npos,
    regexp_extract(trim(marker_name), '^(?:seq-)?(?:(?i)rs)?0*([0-9]+)(_.*)?$', 1) AS rs, trim(marker_name) LIKE '%_b2' AS in2
  FROM markers),
site AS (
  SELECT variant_idx, chr, 'b1' AS build, pos AS p FROM v UNION SELECT variant_idx, chr, 'b2', b2 FROM v
  UNION SELECT variant_idx, chr, 'b1', pos + 1 FROM v WHERE indel UNION SELECT variant_idx, chr, 'b2', b2n FROM v WHERE indel),
pair AS (
  SELECT marker_id, variant_idx FROM m JOIN site s ON s.p = m.pos AND (m.build IS NULL OR m.build = s.build) AND (m.chr IS NULL OR m.chr = s.chr)
  UNION SELECT marker_id, variant_idx FROM m JOIN site s ON m.pos IS NULL AND s.p = m.npos AND s.chr = m.nchr AND s.build = CASE WHEN in2 THEN 'b2' ELSE 'b1' END WHERE m.chr IS NULL OR m.chr = s.chr
  UNION SELECT marker_id, variant_idx FROM m JOIN v ON m.pos IS NULL AND m.nchr IS NULL AND v.rs = m.rs AND m.rs <> '' WHERE m.chr IS NULL OR m.chr = v.chr),
both AS (SELECT m.*, v.variant_idx, v.chr AS vchr, v.pos AS vpos, v1, v2, indel, long, v.maf AS vmaf, v.rs AS vrs FROM pair JOIN m USING (marker_id) JOIN v USING (variant_idx)),
fit AS (
  SELECT marker_id, variant_idx,
    CASE WHEN nchr IS NOT NULL THEN (nchr = vchr AND abs(npos - vpos) <= 1) WHEN rs = vrs THEN true ELSE false END AS named,
    coalesce(least(abs(maf - vmaf), abs(1 - maf - vmaf)), 0) AS far
  FROM both WHERE CASE
    WHEN b IS NULL THEN (CASE WHEN a IN ('I', 'D', '-') THEN indel ELSE a IN (v1, v2) OR {_RC('a')} IN (v1, v2) OR (indel AND (a = long[2:] OR a = ({_RC('long')})[2:] OR a = {_RC('long[2:]')})) END)
    WHEN a IN ('I', 'D') AND b IN ('I', 'D') THEN indel AND a <> b
    WHEN a = '-' THEN indel AND (b = long[2:] OR b = ({_RC('long')})[2:] OR b = {_RC('long[2:]')})
    WHEN b = '-' THEN indel AND (a = long[2:] OR a = ({_RC('long')})[2:] OR a = {_RC('long[2:]')})
    ELSE (a = v1 AND b = v2) OR (a = v2 AND b = v1) OR ({_RC('a')} = v1 AND {_RC('b')} = v2) OR ({_RC('a')} = v2 AND {_RC('b')} = v1) END)
SELECT variant_idx, marker_id FROM (SELECT *, row_number() OVER (PARTITION BY marker_id ORDER BY named DESC, far, variant_idx) AS r FROM fit) WHERE r = 1""".replace("both AS (SELECT m.*", "joined AS (SELECT m.*").replace("FROM both WHERE", "FROM joined WHERE"),
}
