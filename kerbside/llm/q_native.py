"""Queries of mixing and chat formatting."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm import chat_format
from kerbside.llm.mixing import mix
from kerbside.llm.q_dedup import documents
from kerbside.llm.registry import query

DICE = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"
MIX_BODY = rf"""
sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    {DICE.format("'mix|doc|' || coalesce(CAST(doc_id AS VARCHAR), '~')")} AS permuted
  FROM docs_in
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST([5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight,
    source_size * CAST(3 AS DOUBLE) AS lim FROM sources
), summed AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS share, sum(weight) OVER () AS weights,
    coalesce(sum(lim) OVER w, 0.0) AS limits_before, coalesce(sum(weight) OVER w, 0.0) AS weights_before
  FROM weighted WINDOW w AS (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, CASE WHEN (share - limits_before) / (weights - weights_before) * weight <= lim THEN (share - limits_before) / (weights - weights_before) END AS lv FROM summed
), targets AS (
  SELECT source, source_size, docs, least(lim, coalesce(max(lv) OVER () * weight, lim)) AS target FROM levels
), parts AS (
  SELECT *, CAST(least(ceil(docs / 8.0), 512) AS BIGINT) AS blocks_of,
    CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets
), rests AS (
  SELECT *, target - passes * source_size AS rest FROM parts
), placed AS (
  SELECT s.*, r.source_size, r.target, r.passes, r.rest, s.permuted % r.blocks_of AS block
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source
), held AS (
  SELECT source, block, sum(size) AS words, any_value(rest) AS rest FROM placed GROUP BY source, block
), held_before AS (
  SELECT source, block, words, rest, coalesce(sum(words) OVER (PARTITION BY source ORDER BY
    {DICE.format("'mix|block|' || coalesce(source, '~') || '|' || CAST(block AS VARCHAR)")}, block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM held
), ordered AS (
  SELECT p.*, h.before, h.words, coalesce(sum(p.size) OVER (PARTITION BY p.source, p.block ORDER BY p.permuted, p.doc_id ASC NULLS LAST, p.size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM placed p JOIN held_before h ON p.source IS NOT DISTINCT FROM h.source AND p.block = h.block
), mixed AS (
  SELECT doc_id, source, size, source_size, target, passes + CASE
    WHEN before >= rest THEN 0 WHEN before + words <= rest THEN 1 WHEN before + inside + size / 2.0 <= rest THEN 1 ELSE 0 END AS times
  FROM ordered
)
"""
MIX_SQL = f"""
WITH docs_in AS (SELECT * FROM documents), {MIX_BODY}
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * times AS BIGINT) AS taken FROM mixed
"""


@query("op7_mixing", sql=MIX_SQL)
def _(spark, sf):
    return mix(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


CONTROL = r"(/?s>|\|im_start\|>|\|im_end\|>|/?INST\])"
CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*){CONTROL}', '\1\\\2\3', 'g') AS safe,
    replace(replace(regexp_replace(role, '([<\[])(\\*){CONTROL}', '\1\\\2\3', 'g'), '\', '\\'), chr(10), '\n') AS safe_role
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + length(safe_role) + 1 + length(safe) + 10 + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def event_log(messages: DataFrame) -> DataFrame:
    """A log whose folding gives ``messages`` (conv_id, message, role, text): every text arrives as a beginning and a
    streamed delta. Two of three messages were drafted first, with the text backwards, and then edited or regenerated;
    the draft's answer, already begun, is void by that."""
    text, drafted = F.coalesce("text", F.lit("")), F.col("message") % 3 != 0
    at, half = F.col("message").cast("long") * 4, (F.char_length(text) / 2).cast("int")
    event = lambda message, seq, kind, role, said: F.struct(
        message.alias("message"), seq.alias("seq"), kind.alias("kind"), role.alias("role"), said.alias("text")
    )
    role, none = F.col("role"), F.lit(None).cast("string")
    start = F.when(drafted, F.when(F.col("message") % 3 == 1, "edit").otherwise("regenerate")).otherwise("message")
    events = F.array(
        event(F.col("message"), at + 2, start, role, F.substring(text, F.lit(1), half)),
        event(F.col("message"), at + 3, F.lit("delta"), none, F.substring(text, half + 1, F.char_length(text))),
        event(F.when(drafted, F.col("message")), at, F.lit("message"), role, F.reverse(text)),
        event(F.when(drafted, F.col("message") + 1), at + 1, F.lit("message"), none, F.lit("void")),
    )
    return messages.select("conv_id", F.inline(F.filter(events, lambda e: e["message"].isNotNull())))


@query("op9_chat_format", sql=CHAT_SQL)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    in_turn = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    messages = rows.select("conv_id", F.row_number().over(in_turn).alias("message"), "role", "text")
    read = chat_format.read_back(chat_format.render(chat_format.fold(event_log(messages))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars",
    )
