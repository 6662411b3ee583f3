"""Query of the ranked lexical search."""

from kerbside.llm.lexical_search import search
from kerbside.llm.q_dedup import documents
from kerbside.llm.registry import query

TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
SQL = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, {TERMS} AS terms FROM documents WHERE doc_id IS NOT NULL
), sized AS (
  SELECT doc_id, r, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0
), corpus AS (
  SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM sized
), asked AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) t
), postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM sized) t
  WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(documents) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, corpus GROUP BY term
), parts AS (
  SELECT r, doc_id, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // length))) AS part
  FROM postings p JOIN weights USING (term), corpus
), scores AS (
  SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, r, doc_id HAVING sum(part) > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores) t WHERE rank <= 50
"""


@query("op12_lexical_search", sql=SQL)
def _(spark, sf):
    return search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"), k=50)
