"""Language identification by compression.

Each language has a zstandard dictionary of raw content: texts of that language. A text is cut into pieces, every piece is
compressed with each dictionary, and the language whose dictionary makes the text smallest wins. Where the runner-up is
nearly as small the answer is marked as rejected.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.lm_scoring import held_out

#: Texts per language that a dictionary is made of (the smallest hashes of the ids), their length in bytes, and its size.
DICT_TEXTS, DICT_FROM, DICT_TO, DICT_BYTES = 48, 200, 6000, 96 << 10
#: Languages whose dictionaries are collected together and prepared at one time.
LANGUAGE_GROUP = 200
PIECE, LEVEL = 2048, 3
#: Texts of at most so many bytes are compressed at the more thorough level: a few bytes decide.
SHORT, SHORT_LEVEL = 1024, 19
#: Ends every dictionary and begins every short text: zstandard stores a few bytes as they are unless a longer match in
#: front of them opens a compressed block, in which then any match pays.
LEAD = b"\x01qjxzkvwy\x02zqkxjwvy\x03kzjqvxyw\x04xkqzwjyv\x05vzqxkyjw\x06jkzxqwvy"
#: The answer is rejected where the runner-up is less than this share larger.
MARGIN = 0.01

_LETTER = re.compile(r"[^\W\d_]")
# ASCII marks and digits tell nothing about the language
_PLAIN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """Lower-cased text as UTF-8 with blanks for ASCII marks, digits and white space."""
    return text.lower().encode().translate(_PLAIN)


def dictionaries(docs: DataFrame, id_col: str, text_col: str, lang_col: str, mod: int, remainder: int) -> list[dict[str, bytes]]:
    """Raw content for every language, by name and ``LANGUAGE_GROUP`` at a time, from a bounded number of whole training texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), mod, remainder))
    sizes = rows.select("doc_id", "lang", F.octet_length("text").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("fits").desc(), F.xxhash64("doc_id"), "doc_id")
    picked = sizes.withColumn("fits", F.col("n").between(DICT_FROM, DICT_TO)).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= DICT_TEXTS)
    names = [r[0] for r in sizes.select("lang").distinct().orderBy("lang").collect()]
    groups = []
    for start in range(0, len(names), LANGUAGE_GROUP):
        own = picked.filter(F.col("lang").between(names[start], names[min(start + LANGUAGE_GROUP, len(names)) - 1])).select("doc_id", "lang", "nth")
        texts = rows.join(F.broadcast(own), ["doc_id", "lang"]).select("lang", "nth", "text")
        out: dict[str, bytes] = {}
        # at most DICT_TEXTS texts a language, cut to DICT_BYTES each
        for lang, content in texts.groupBy("lang").agg(
            F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.substring("text", 1, DICT_TO).alias("text")))), lambda x: x["text"]), "\n").cast("binary"), 1, DICT_BYTES)
        ).orderBy("lang").collect():
            out[lang] = plain(bytes(content).decode(errors="ignore"))
        if out:
            groups.append(out)
    return groups


def compressors(content: dict[str, bytes], level: int = LEVEL) -> list[zstandard.ZstdCompressor]:
    """One compressor for each language, its dictionary prepared once."""
    out = []
    for data in content.values():
        prepared = zstandard.ZstdCompressionDict(data + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prepared.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=prepared, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, remainder: int = 2, margin: float = MARGIN
) -> DataFrame:
    """(doc_id, held_out, lang, score, rejected) of every row.

    Learns from texts with a language that are not held out (crc32 of the id by ``mod`` leaves another remainder). The
    whole text counts. ``lang`` is the best learned language, ties to the first by name; ``und`` for null texts, texts
    without a letter, and where nothing could be learned. ``score`` is the share by which the runner-up is larger (1 with
    one language, 0 for ``und``); ``rejected`` marks narrow margins and ``und``. Rows without an id are not held out;
    repeated rows are each answered; other columns are ignored.
    """
    groups = [docs.sparkSession.sparkContext.broadcast(g) for g in dictionaries(docs, id_col, text_col, lang_col, mod, remainder)]
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        prepared = lambda g: (list(g.value), compressors(g.value, SHORT_LEVEL), compressors(g.value, LEVEL))
        only = [prepared(groups[0])] if len(groups) == 1 else None
        for batch in batches:
            texts = batch.column(1)
            # smallest size and its language, second smallest size
            state: list[tuple] = [(None, "und", None)] * len(texts)
            for names, thorough, quick in only or map(prepared, groups):
                for row, value in enumerate(texts):
                    text = value.as_py()
                    if not text or not _LETTER.search(text):
                        continue
                    data = plain(text)
                    tools = thorough if len(data) <= SHORT else quick
                    data = LEAD + data if len(data) <= SHORT else data
                    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                    best, lang, second = state[row]
                    for name, tool in zip(names, tools, strict=True):
                        size = sum(len(tool.compress(p)) for p in pieces)
                        if best is None or size < best:
                            best, lang, second = size, name, best
                        elif second is None or size < second:
                            second = size
                    state[row] = (best, lang, second)
            scores = [0.0 if best is None else 1.0 if second is None else (second - best) / second for best, _, second in state]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[1] for x in state], pa.string()), pa.array(scores, pa.float64()), pa.array([x[0] is None or y < margin for x, y in zip(state, scores, strict=True)], pa.bool_())],
                names=["doc_id", "lang", "score", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"doc_id {kind}, lang string, score double, rejected boolean")
    return found.select("doc_id", held_out(F.col("doc_id"), mod, remainder).alias("held_out"), "lang", "score", "rejected")
