"""Genetic relations as deterministic projections of the test tables.

Each view is one SQL text that Spark and DuckDB both read, apart from the unnesting of the embedding and the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoloom.plans.tables import table

_CALLS = """SELECT vec_id AS sample_idx, variant_idx,
  CASE WHEN (vec_id * 64 + variant_idx) % 37 = 0 THEN NULL WHEN e < -0.08 THEN 0 WHEN e < 0.08 THEN 1 ELSE 2 END AS dosage FROM ({unnest})"""
SPARK_CALLS = _CALLS.format(unnest="SELECT vec_id, pos AS variant_idx, CAST(e AS DOUBLE) AS e FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, e")
DUCK_CALLS = _CALLS.format(unnest="SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS variant_idx, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings")

# As VIEWS has them, for tables of any size: places are counted without gaps, so that each i - 1 to i - 8 is there and needs no
# join to be found (Spark takes either side for small by the compressed bytes of part and sends its rows through the driver),
# and the products, beyond 32 bits from the 19,065th variant of a chromosome on, are of 64.
SPARK_EDGES = "SELECT CHR AS chr, i, j, ((CAST(i AS BIGINT) * 7919 + CAST(j AS BIGINT) * 104729) % 2001 - 1000) / CAST(1000 AS DOUBLE) AS r FROM (SELECT CHR, explode(sequence(greatest(i - 8, 0), i - 1)) AS i, i AS j FROM ranked WHERE i > 0 AND CHR IS NOT NULL)"

#: Views in the order of their dependence. D marks whole-number division, written differently by the two engines.
VIEWS = {
    "calls_big": "SELECT l_orderkey AS sample_idx, l_suppkey AS variant_idx, CAST(max(l_linenumber) % 3 AS INTEGER) AS dosage FROM lineitem GROUP BY l_orderkey, l_suppkey",
    "samples_big": "SELECT o_orderkey AS sample_idx, CAST(o_totalprice AS DOUBLE) / 1000 AS phenotype FROM orders",
    "variants_big": "SELECT s_suppkey AS variant_idx, CAST(1 + {dfive} AS INTEGER) AS chr, CAST(100 * s_suppkey AS INTEGER) AS pos, CAST(s_suppkey AS DOUBLE) / 100 AS cm FROM supplier",
    "samples": "SELECT vec_id AS sample_idx, CAST(label + (vec_id % 17) / CAST(10 AS DOUBLE) AS DOUBLE) AS phenotype, CAST(vec_id % 2 AS DOUBLE) AS covar_1, CAST(vec_id % 5 AS DOUBLE) AS covar_2, CAST(label % 2 AS INTEGER) AS status FROM embeddings",
    "variants64": "SELECT variant_idx, CAST(1 + {d32} AS INTEGER) AS chr, CAST(1000 * (variant_idx % 32) + (variant_idx * 37) % 500 AS INTEGER) AS pos, (1000 * (variant_idx % 32) + (variant_idx * 37) % 500) / CAST(10000 AS DOUBLE) AS cm, CONCAT('v', CAST(variant_idx AS STRING)) AS snp FROM (SELECT DISTINCT variant_idx FROM calls)",
    "vars": "SELECT p_partkey AS idx, CONCAT('rs', CAST(p_partkey AS STRING)) AS SNP, CAST(1 + p_partkey % 22 AS INTEGER) AS CHR, CAST(1000 * {d22} + p_size AS INTEGER) AS POS, substr('ACGT', CAST(1 + p_size % 4 AS INTEGER), 1) AS A1, substr('ACGT', CAST(1 + (p_size + 1 + p_partkey % 3) % 4 AS INTEGER), 1) AS A2, (p_retailprice - 1000) / CAST(1000 AS DOUBLE) AS BETA, CAST(0.01 AS DOUBLE) + p_size / CAST(100 AS DOUBLE) AS SE, CAST(0.01 AS DOUBLE) + (p_partkey % 49) / CAST(100 AS DOUBLE) AS MAF FROM part",
    "sumstats_v": "SELECT v.*, coalesce(l.n, 0) AS N FROM vars v LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = v.idx",
    "refpanel": "SELECT idx, SNP, CHR, POS, CASE WHEN idx % 11 = 0 THEN 'X' WHEN idx % 5 = 0 THEN A2 ELSE A1 END AS A1, CASE WHEN idx % 5 = 0 THEN A1 ELSE A2 END AS A2, MAF FROM vars WHERE idx % 7 <> 0",
    "intervals": "SELECT s_suppkey AS id, CAST(1 + s_suppkey % 22 AS INTEGER) AS chr, CAST((s_suppkey * 7919) % 90000 AS INTEGER) AS start_pos, CAST((s_suppkey * 7919) % 90000 + 2000 + (s_suppkey % 7) * 500 AS INTEGER) AS end_pos FROM supplier",
    "blocks": "SELECT DISTINCT CHR AS chr, CAST(10000 * {dblock} AS INTEGER) AS block_start, CAST(10000 * {dblock} + 9000 AS INTEGER) AS block_end FROM vars",
    "ranked": "SELECT idx, CHR, SNP, POS, MAF, BETA, SE, CAST(row_number() OVER (PARTITION BY CHR ORDER BY idx) - 1 AS INTEGER) AS i FROM vars",
    "edges": "SELECT a.CHR AS chr, a.i AS i, b.i AS j, ((a.i * 7919 + b.i * 104729) % 2001 - 1000) / CAST(1000 AS DOUBLE) AS r FROM ranked a JOIN (SELECT CHR, i, explode_i AS lo FROM (SELECT CHR, i, {explode} AS explode_i FROM ranked)) b ON a.CHR = b.CHR AND a.i = b.lo",
    "annot": "SELECT SNP, CHR, POS, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS big, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS quarter, p_retailprice / CAST(1000 AS DOUBLE) AS price FROM part JOIN vars ON idx = p_partkey",
}
_SPARK = {"dfive": "(s_suppkey div 500)", "d32": "variant_idx div 32", "d22": "(p_partkey div 22)", "dblock": "(POS div 10000)"}
_DUCK = {"dfive": "(s_suppkey // 500)", "d32": "variant_idx // 32", "d22": "(p_partkey // 22)", "dblock": "(POS // 10000)", "explode": "unnest(range(greatest(i - 8, 0), i + 1))"}
#: The generated edges need i < j; filtered here so that both engines explode alike.
_TABLES = ("embeddings", "part", "lineitem", "orders", "supplier")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame over the tables of a folder. No name is left in the catalog for others to meet."""
    ctes = {"calls": SPARK_CALLS} | {k: s.format(**_SPARK) for k, s in VIEWS.items() if k != "edges"} | {"edges": SPARK_EDGES}
    given = {t: table(spark, sf_dir, t) for t in _TABLES}
    return spark.sql(with_clause(ctes, name, {t: "{" + t + "}" for t in given}), **{t: d for t, d in given.items() if t in _needed(ctes, name)})


def _needed(ctes: dict[str, str], name: str) -> set[str]:
    import re

    seen: set[str] = set()
    todo = [name]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            if x in ctes:
                todo += [y for y in [*ctes, *_TABLES] if re.search(rf"\b{y}\b", ctes[x])]
    return seen


def with_clause(ctes: dict[str, str], name: str, tables: dict[str, str]) -> str:
    import re

    need = _needed(ctes, name)
    parts = []
    for k, s in ctes.items():
        if k in need:
            for t, ref in tables.items():
                s = re.sub(rf"\b{t}\b", ref, s)
            parts.append(f"{k} AS ({s})")
    return "WITH " + ", ".join(parts) + f" SELECT * FROM {name}"


def duck(sql: str, *names: str) -> str:
    """SQL for the other engine with the named views (and those they need) in front; `sql` may begin with more of them."""
    ctes = {"calls": DUCK_CALLS} | {k: s.format(**_DUCK) for k, s in VIEWS.items()}
    ctes["edges"] += " WHERE a.i < b.i"
    need = set().union(*[_needed(ctes, n) for n in names])
    head = "WITH RECURSIVE " + ", ".join(f"{k} AS ({s})" for k, s in ctes.items() if k in need)
    body = sql.strip()
    return head + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
