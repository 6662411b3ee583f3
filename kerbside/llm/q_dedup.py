"""Queries of the near-duplicate and substring operators."""

from pyspark.sql import functions as F

from kerbside.llm.jaccard_join import linked_classes
from kerbside.llm.registry import query
from kerbside.llm.suffix_dedup import without_repeats


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w) t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT a AS doc_id, a AS seen FROM both_ways UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.seen
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(min(r.seen), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach r ON r.doc_id = w.doc_id GROUP BY w.doc_id, n.n
"""


@query("op2_ngram_jaccard", sql=JACCARD_SQL)
def _(spark, sf):
    return linked_classes(documents(spark, sf))


REPEATS_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL
), k AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100) t
), firsts AS (
  SELECT w, min(doc_id) AS first_doc FROM k GROUP BY w
), hit AS (
  SELECT k.doc_id, k.i FROM k JOIN firsts f ON f.w = k.w WHERE f.first_doc < k.doc_id
), run AS (
  SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS nth
  FROM (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM hit) t
), span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, nth
), cut AS (
  SELECT span.doc_id, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS piece FROM (
    SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span) span JOIN d ON d.doc_id = span.doc_id
), joined AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY a) AS pieces, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last FROM cut GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN j.doc_id IS NULL THEN h ELSE pieces || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN joined j ON j.doc_id = d.doc_id
"""


@query("op4_suffix_dedup", sql=REPEATS_SQL)
def _(spark, sf):
    out = without_repeats(documents(spark, sf))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
