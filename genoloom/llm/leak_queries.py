"""Queries of problem 8: evaluation texts in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoloom.llm.leaks import leaked
from genoloom.plans.tables import table

LEAST = 13


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps, those with substituted words included."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), least=LEAST)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_overlaps(spark, sf_dir).where(f"run_words >= {LEAST}").select("item_id", "doc_id")


def p8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of equal words of each item and document that have one of 13 or more."""
    return p8_overlaps(spark, sf_dir).where(f"run_words >= {LEAST}").select("item_id", "doc_id", "run_words")


QUERIES = {"p8_found": p8_found, "p8_overlaps": p8_overlaps, "p8_runs": p8_runs}


def _words(column: str) -> str:
    return rf"regexp_extract_all(lower(regexp_replace({column}, '\\[nrt""]', ' ', 'g')), '[a-z0-9]+')".replace('""', '"')


def _runs(table_: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + {LEAST - 1}], ' ') AS run
FROM (SELECT {key}, w, unnest(range(1, len(w) - {LEAST - 2})) AS i FROM (SELECT {key}, {_words("text")} AS w FROM {table_}) WHERE len(w) >= {LEAST})"""


def _places(table_: str, key: str) -> str:
    """As _runs, with the place of every run."""
    return f"""SELECT {key}, i, array_to_string(w[i:i + {LEAST - 1}], ' ') AS run
FROM (SELECT {key}, w, unnest(range(1, len(w) - {LEAST - 2})) AS i FROM (SELECT {key}, {_words("text")} AS w FROM {table_}) WHERE len(w) >= {LEAST})"""


SQL = {
    "p8_found": f"WITH d AS ({_runs('documents', 'doc_id')}), e AS ({_runs('eval_items', 'item_id')}) SELECT DISTINCT item_id, doc_id FROM d JOIN e USING (run)",
    "p8_runs": f"""WITH d AS ({_places('documents', 'doc_id')}), e AS ({_places('eval_items', 'item_id')}),
m AS (SELECT DISTINCT item_id, doc_id, d.i - e.i AS diagonal, d.i FROM d JOIN e USING (run)),
k AS (SELECT *, i - row_number() OVER (PARTITION BY item_id, doc_id, diagonal ORDER BY i) AS island FROM m),
n AS (SELECT item_id, doc_id, count(*) + {LEAST - 1} AS run_words FROM k GROUP BY item_id, doc_id, diagonal, island)
SELECT item_id, doc_id, CAST(max(run_words) AS INTEGER) AS run_words FROM n GROUP BY item_id, doc_id""",
}
