"""Query of the line deduplication."""

from pyspark.sql import functions as F

from kerbside.llm.line_dedup import lines_dropped
from kerbside.llm.q_dedup import documents
from kerbside.llm.registry import query

SQL = r"""
WITH l AS (
  SELECT doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) s) t
), shared AS (
  SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (s.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN shared s ON s.key = l.key GROUP BY doc_id
"""


@query("op11_line_dedup", sql=SQL)
def _(spark, sf):
    out = lines_dropped(documents(spark, sf), least_documents=10, least_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
