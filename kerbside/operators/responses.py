"""Model answers (free text around JSON) turned into category rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import let, lookup
from kerbside.schema import CATEGORY_RESULT, CATEGORY_RESULT_WITH_ID


def resolve_category(raw: Column) -> Column:
    """Exact value, then alias, then the first alias that contains or is contained in the text, then 'clean'."""
    word = F.translate(F.lower(F.trim(raw)), "- ", "__")
    partial = F.coalesce(
        *[
            F.when(F.contains(word, F.lit(alias)) | F.contains(F.lit(alias), word), F.lit(category))
            for alias, category in fixed.CATEGORY_ALIASES.items()
        ]
    )
    return F.coalesce(lookup(word, fixed.CATEGORY_ALIASES), partial, F.lit("clean"))


def unfenced(raw: Column) -> Column:
    """The body of a ```json fence, or the text without fence lines when it starts with one."""
    text = F.trim(raw)
    fence = r"(?s)```json\s*(.*?)\s*```"
    lines = F.filter(F.split(text, "\n"), lambda line: ~F.startswith(F.trim(line), F.lit("```")))
    return (
        F.when(F.regexp_like(text, F.lit(fence)), F.trim(F.regexp_extract(text, fence, 1)))
        .when(F.startswith(text, F.lit("```")) & ~F.contains(text, F.lit("```json")), F.trim(F.array_join(lines, "\n")))
        .otherwise(text)
    )


def closed(text: Column) -> Column:
    """Truncated JSON with an open quote and the brace closed."""
    cut = F.rtrim(text)
    odd = (F.length(cut) - F.length(F.replace(cut, F.lit('"'), F.lit("")))) % 2 == 1
    return F.when(~F.endswith(cut, F.lit("}")), F.concat(cut, F.when(odd, '"').otherwise(""), F.lit("}")))


def _object(text: Column) -> Column:
    """Parsed object, or NULL when the text is not one JSON object."""
    whole = F.regexp_like(text, F.lit(r"(?s)^\s*\{.*\}\s*$"))
    return F.when(whole & F.try_parse_json(text).isNotNull(), F.from_json(text, CATEGORY_RESULT))


def parsed_response(raw: Column, repair: bool = False) -> Column:
    """Category struct by the first strategy that works; NULL when none does."""
    text = unfenced(raw)
    candidates = [
        text,
        F.regexp_extract(text, r'(?s)\{[^{}]*"category"[^{}]*\}', 0),
        F.regexp_extract(text, r'(?s)\{.*?"category"\s*:.*?\}', 0),
        F.when(F.contains(text, F.lit('"category"')), first_object(text)),
    ]
    if repair:
        candidates.append(closed(F.regexp_extract(text, r"(?s)\{.*$", 0)))
    return F.coalesce(*[_object(c) for c in candidates])


def parse_model_response(responses: DataFrame, raw: str = "raw", repair: bool = False) -> DataFrame:
    """Add category, confidence, flags, reasoning and ``parsed``; an unreadable answer is 'clean' at 0.3."""
    result = responses.withColumn("__p", parsed_response(F.col(raw), repair))
    ok = F.col("__p").isNotNull()
    no_flags = F.array().cast("array<string>")
    return result.withColumns(
        {
            "category": F.when(ok, resolve_category(F.coalesce("__p.category", F.lit("clean")))).otherwise("clean"),
            "confidence": F.when(ok, F.coalesce("__p.confidence", F.lit(0.5))).otherwise(0.3),
            "flags": F.when(ok, F.coalesce("__p.flags", no_flags)).otherwise(no_flags),
            "reasoning": F.when(ok, F.coalesce("__p.reasoning", F.lit(""))).otherwise("parse error"),
            "parsed": ok,
        }
    ).drop("__p")


def parse_model_batch_response(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per item of a JSON array answer; items without a readable body are skipped."""
    text = unfenced(F.col(raw))
    direct = F.regexp_like(text, F.lit(r"(?s)^\s*\[.*\]\s*$"))
    array = F.when(direct, text).otherwise(F.regexp_extract(text, r"(?s)\[.*\]", 0))
    items = F.from_json(array, f"array<{CATEGORY_RESULT_WITH_ID.simpleString()}>")
    exploded = responses.withColumn("__item", F.explode(items)).filter(F.col("__item").isNotNull())
    return exploded.select(
        *responses.columns,
        F.coalesce("__item.id", F.lit("")).alias("item_id"),
        resolve_category(F.coalesce("__item.category", F.lit("clean"))).alias("category"),
        F.coalesce("__item.confidence", F.lit(0.5)).alias("confidence"),
        F.coalesce("__item.flags", F.array().cast("array<string>")).alias("flags"),
        F.coalesce("__item.reasoning", F.lit("")).alias("reasoning"),
    )


def first_object(text: Column) -> Column:
    """From the first brace to its matching one, at any depth, or to the end when the text is cut.

    The text is taken apart at its braces and folded once over the running depth.
    """
    rest = F.substr(text, F.instr(text, "{"))
    pieces = F.regexp_extract_all(rest, F.lit(r"[{}][^{}]*"), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        depth = state["depth"] + F.when(F.startswith(piece, F.lit("{")), 1).otherwise(-1)
        end = F.when(state["end"] > 0, state["end"]).when(depth == 0, state["seen"] + 1).otherwise(0)
        return F.struct(depth.alias("depth"), (state["seen"] + 1).alias("seen"), end.alias("end"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end"))
    end = F.aggregate(pieces, start, step)["end"]
    whole = let(end, lambda n: F.when(n > 0, F.concat(F.array_join(F.slice(pieces, F.lit(1), n - 1), ""), F.lit("}"))).otherwise(rest))
    return F.when(F.instr(text, "{") > 0, whole)
