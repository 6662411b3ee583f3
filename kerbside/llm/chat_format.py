"""Chat formatting from an event log. DataFrame functions only.

A log holds one row per event: a message begins, a streamed delta is appended, a message is edited or regenerated. The log
is partitioned by conversation and sorted by sequence; each message's events are folded into its final text, and a
message goes if an earlier one was edited or regenerated after it was written. The messages are rendered with a template
that marks turns; control strings inside texts are escaped so that they can be restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks, and the control strings that texts may not hold as they are.
BEGIN, END, BREAK = "<|im_start|>", "<|im_end|>", "\n"
_CONTROL = r"(/?s>|\|im_start\|>|\|im_end\|>|/?INST\])"
#: A backslash behind the first character breaks a control string; one that is broken already gets one more.
ESCAPE, ESCAPED = r"([<\[])(\\*)" + _CONTROL, r"([<\[])\\(\\*)" + _CONTROL

#: Kinds of events; all but the delta start a message's text anew, the last two also void what was written after it.
KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Roles stand on one line: backslash and line break are escaped as well."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) from (conv_id, message, seq, kind, role, text).

    Events of a message count in the order of ``seq`` (at one ``seq`` a new beginning before a delta, then by role and
    text). The last ``message``, ``edit`` or ``regenerate`` starts the text anew, later deltas are appended. An edit or
    regeneration of an earlier message voids what this one got before it; a message of which nothing is left goes. The
    role is the last one given. Null texts and roles are empty; a null ``seq`` comes first; rows with another kind or
    without a message number are left out; a null conversation is one of its own.
    """
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    rows = events.select("conv_id", "message", F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), order.alias("kind"), "role", "text")
    rows = rows.filter((F.col("kind") > 0) & F.col("message").isNotNull())
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("events"),
        F.max(F.when(F.col("kind") < 4, F.struct("seq", "kind"))).alias("anew"),
        F.max(F.when(F.col("kind").isin(2, 3), F.col("seq"))).alias("voids"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("void", F.max("voids").over(earlier))
    counts = lambda e: (
        F.coalesce(F.struct(e["seq"], e["kind"]) >= F.col("anew"), F.lit(True)) & F.coalesce(e["seq"] > F.col("void"), F.lit(True))
    )
    rows = rows.withColumn("live", F.filter("events", counts)).filter(F.size("live") > 0)
    last = F.element_at(F.filter("events", lambda e: e["role"] != ""), -1)["role"]
    return rows.select(
        "conv_id", "message", F.coalesce(F.when(F.exists("events", lambda e: e["role"] != ""), last), F.lit("")).alias("role"),
        F.array_join(F.transform("live", lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) of (conv_id, message, role, text): the marked-up text of each conversation, and for each
    of its messages where (in code points) its text stands and whether it is in the loss mask."""
    text = escape(F.coalesce("text", F.lit("")))
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(BEGIN), escape_role(role), F.lit(BREAK))
    rows = messages.select("conv_id", "message", head.alias("head"), text.alias("text"), (role == learn_from).alias("learn"))
    upto = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("head") + F.char_length("text") + F.lit(len(END) + len(BREAK))
    start = F.coalesce(F.sum(size.cast("long")).over(upto), F.lit(0)) + F.char_length("head")
    rows = rows.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("text"))
    piece = F.concat("head", "text", F.lit(END + BREAK)).alias("piece")
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", piece, "start", "end", "learn"))).alias("m"))
    loss = F.transform("m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["learn"].alias("learn")))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda m: m["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, learnt, formatted_chars) from what ``render`` wrote: roles and texts in order, and the texts under the
    loss mask. Turns come from the marks alone; what is learnt is what stands from ``start`` to ``end`` of a mask entry,
    wherever that is, so a mask that is off shows. Conversations are told apart by ``conv_id``."""
    mark = BEGIN.replace("|", r"\|")
    pieces = F.transform(F.slice(F.split("formatted", mark), F.lit(2), F.size("loss")), lambda p: F.concat(F.lit(BEGIN), p))
    rows = formatted.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), F.arrays_zip(pieces.alias("piece"), F.col("loss")).alias("zipped"))
    rows = rows.select("conv_id", "formatted_chars", F.posexplode("zipped").alias("nth", "z")).select("conv_id", "formatted_chars", "nth", "z.piece", "z.loss")
    # where each piece begins; a mask entry is read from its piece, so that long conversations are not walked for every turn
    upto = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.char_length("piece").cast("long")).over(upto), F.lit(0)))
    line = F.substring_index("piece", BREAK, 1)
    body = F.substring(F.col("piece"), F.char_length(line) + 2, F.char_length("piece"))
    inside = F.substring(F.col("piece"), (F.col("loss.start") - F.col("begin") + 1).cast("int"), (F.col("loss.end") - F.col("loss.start")).cast("int"))
    read = F.struct(
        "nth", unescape_role(F.substring(line, len(BEGIN) + 1, 1 << 30)).alias("role"), unescape(F.substring_index(body, END, 1)).alias("text"),
        F.when(F.col("loss.learn"), unescape(inside)).alias("learnt"),
    )
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(read)).alias("read"), F.max("formatted_chars").alias("formatted_chars"))
    return rows.select(
        "conv_id", F.transform("read", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"),
        F.transform(F.filter("read", lambda r: r["learnt"].isNotNull()), lambda r: r["learnt"]).alias("learnt"), "formatted_chars",
    )
