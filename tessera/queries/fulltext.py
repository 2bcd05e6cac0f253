"""Full-text search by index, over the documents' whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import textindex
from tessera.plans.workspace import Workspace
from tessera.queries.tables import table

#: Phrases and words of two languages, with an exclusion.
QUERY = '"of the" and -"to the" or que "de la"'


def _index(spark, sf_dir, stemmed):
    return textindex.build(table(spark, sf_dir, "documents"), "doc_id", "text", f"{Workspace(spark, 'fulltext').root}/index", stemmed=stemmed)


def phrase_search(spark, sf_dir):
    return _index(spark, sf_dir, stemmed=False).search(QUERY).withColumn("rank", F.round("rank", 6))


def stemmed_search(spark, sf_dir):
    """Documents with forms of some English words."""
    return _index(spark, sf_dir, stemmed=True).search("things ended or resting").withColumn("rank", F.round("rank", 6))


QUERIES = {"fulltext_phrase": phrase_search, "fulltext_stemmed": stemmed_search}

_PAIR = "SELECT {alt} AS alt, {unit} AS unit, a.doc_id, a.p AS s, b.p AS e FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.word = '{one}' AND b.word = '{two}'"
SQL = {
    "fulltext_phrase": rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
places AS ({_PAIR.format(alt=1, unit=0, one="of", two="the")} UNION ALL SELECT 1, 1, doc_id, p, p FROM t WHERE word = 'and'
  UNION ALL SELECT 2, 0, doc_id, p, p FROM t WHERE word = 'que' UNION ALL {_PAIR.format(alt=2, unit=1, one="de", two="la")}),
bad AS (SELECT doc_id FROM ({_PAIR.format(alt=0, unit=0, one="to", two="the")})),
sofar AS (SELECT alt, doc_id, e, row_number() OVER w AS n, max(CASE WHEN unit = 0 THEN s END) OVER w AS a, max(CASE WHEN unit = 1 THEN s END) OVER w AS b
  FROM places WHERE alt = 2 OR doc_id NOT IN (SELECT doc_id FROM bad) WINDOW w AS (PARTITION BY alt, doc_id ORDER BY e, s, unit ROWS UNBOUNDED PRECEDING)),
covers AS (SELECT doc_id, e, least(a, b) AS f, lag(least(a, b)) OVER (PARTITION BY alt, doc_id ORDER BY n) AS before FROM sofar WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT doc_id, round(sum(0.1 / (1 + greatest(e - f + 1 - 3, 0))), 6) AS rank FROM covers WHERE before IS NULL OR f > before GROUP BY doc_id""",
}
