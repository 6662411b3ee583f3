"""Lines that many documents share are dropped everywhere.

Every text is exploded into lines at ``\\n``; a line's key is the line without ASCII white space at both ends and with A-Z
lower-cased. Keys are hashed to 128 bits; distinct documents are counted per hash, and lines whose key occurs in at least
``least_documents`` of them go, in every document. What stays is put together again in the order of its positions.

A document sends each of its keys once, as two longs; the count is combined before the shuffles, so a line that a third
of all documents hold reaches its counter as one row per task. The verdicts return on two ways, both exact: the heaviest
``most_shared`` shared lines as a broadcast (16 bytes each, so its size is bounded), and the others, none of which is hot
once those are gone, by a join on the hash that ends in one short list per text. The texts themselves only move on the
second way, which runs only when there are such lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from kerbside.llm import arrays as A
from kerbside.llm.storage import stage

WHITE = b" \t\n\x0b\x0c\r"
#: Most shared lines that are broadcast; 4 MB of hashes, about 25 MB as a set in a Python worker.
MOST_SHARED = 1 << 18
_KEYS = "doc_id long, text_hash long, a long, b long"


def key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def long_enough(k: bytes, least_chars: int) -> bool:
    return len(k) >= least_chars and (least_chars <= 1 or len(k.decode("utf-8", "replace")) >= least_chars)


def whole_texts(column: pa.Array):
    """The UTF-8 bytes of every text of a column; null is empty."""
    data, starts = A.text_bytes(column)
    view = memoryview(data)
    return [bytes(view[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def document_keys(rows: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, text_hash, a, b): every distinct key of every row, as the two halves of its hash."""

    def explode(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            digests, origin, size = [], [], 0
            for i, text in enumerate([*whole_texts(batch.column(2)), None]):
                if text is not None:
                    keys = {key(line) for line in text.split(b"\n")}
                    found = [xxhash.xxh3_128_digest(k) for k in keys if long_enough(k, least_chars)]
                    digests += found
                    origin += [i] * len(found)
                    size += len(text)
                if digests and (text is None or size > 1 << 22):
                    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    at = pa.array(origin, pa.int64())
                    columns = [ids.take(at), hashes.take(at), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "a", "b"])
                    digests, origin, size = [], [], 0

    return rows.mapInArrow(explode, _KEYS)


def shared_lines(rows: DataFrame, least_documents: int, least_chars: int) -> DataFrame:
    """(a, b, n): the keys found in at least ``least_documents`` documents, with their number."""
    counted = document_keys(rows, least_chars).groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"))
    return counted.filter(F.col("n") >= least_documents)


def lines_dropped(
    docs: DataFrame, least_documents: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text",
    carry: list[str] | None = None, most_shared: int = MOST_SHARED,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row, and the columns ``carry``.

    ``n_lines`` counts lines before dropping. A null or empty text is one empty line. Keys shorter than ``least_chars``
    code points are never dropped, so blank lines stay. If all lines go, ``kept`` is empty. Documents are told apart by
    their ids: rows that repeat an id count once for a line, and rows without an id do not count, but lose the shared
    lines like any other. Rows come out as often as they came in. An empty table gives an empty table. Other columns of
    the table, whatever their names, play no part; ``carry`` must not name the four of the result.
    """
    keep = list(carry or [])
    if set(keep) & {"doc_id", "n_lines", "n_dropped", "kept"}:
        raise ValueError("carry names a column of the result")
    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__hash"), text.alias("__text"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(keep)])
    rows = named.select("__id", "__hash", "__text")
    shared = stage(shared_lines(rows, least_documents, least_chars), "shared-lines")
    number = shared.count()
    heaviest = shared.orderBy(F.desc("n"), "a", "b").limit(most_shared) if number > most_shared else shared
    if number > most_shared:
        heaviest = stage(heaviest, "heaviest-lines")
    table = heaviest.select("a", "b").toArrow()
    halves = np.stack([table["a"].to_numpy(), table["b"].to_numpy()], axis=1).astype(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(halves.tobytes())
    lists = F.lit(None).cast("array<binary>")
    if number <= most_shared:
        named = named.withColumn("__more", lists)
    else:
        rest = shared.join(heaviest.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
        hits = document_keys(rows, least_chars).join(rest, ["a", "b"], "left_semi")
        packed = F.unhex(F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0")))
        more = hits.groupBy(F.col("doc_id").alias("__of"), F.col("text_hash").alias("__hash_of")).agg(F.collect_set(packed).alias("__more"))
        named = named.join(more, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__hash_of")), "left").drop("__of", "__hash_of")
    cache: dict[int, frozenset] = {}

    def drop(batches):
        if 0 not in cache:
            data = sent.value
            cache[0] = frozenset(data[i : i + 16] for i in range(0, len(data), 16))
        everywhere = cache[0]
        for batch in batches:
            texts, more = whole_texts(batch.column("__text")), batch.column("__more")
            carried = [batch.column(f"__c{i}") for i in range(len(keep))]
            first, size, n_lines, n_dropped, kept = 0, 0, [], [], []
            for i, text in enumerate(texts):
                gone = everywhere
                if more[i].is_valid:
                    # Spark writes longs with the highest byte first, the hashes are read with the lowest first
                    gone = everywhere | {v[7::-1] + v[:7:-1] for v in more[i].as_py()}
                lines = text.split(b"\n")
                stay = [line for line in lines if not (long_enough(k := key(line), least_chars) and xxhash.xxh3_128_digest(k) in gone)]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(text if len(stay) == len(lines) else b"\n".join(stay))
                size += len(text)
                if size > 1 << 22 or i + 1 == len(texts):
                    part = slice(first, i + 1)
                    own = [batch.column("__id")[part], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).view(pa.string())]
                    yield pa.RecordBatch.from_arrays([*own, *[c[part] for c in carried]], names=["doc_id", "n_lines", "n_dropped", "kept", *keep])
                    first, size, n_lines, n_dropped, kept = i + 1, 0, [], [], []

    schema = StructType().add("doc_id", LongType()).add("n_lines", LongType()).add("n_dropped", LongType()).add("kept", StringType())
    for name in keep:
        schema = schema.add(docs.schema[name])
    return named.mapInArrow(drop, schema)
