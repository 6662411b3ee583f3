"""Questions that blocks of documents put to hash ranges of the corpus, and the answers that go back.

Documents are dealt into blocks of a few megabytes. Each block sends, for every range of the key space, the sorted
distinct keys of its own texts (a few bytes per key) to a bucket; each bucket sees one range of the keys of all blocks
and answers every block in the order of its keys; the block then works through its texts again with the answers. So a
corpus-wide statistic reaches every text without one row per key, a bucket holds each key once per block (a frequent
key is no heavier than a rare one), and nothing passes through the driver but the total size of the texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LETTERS = "block int, bucket int, data binary"
_LETTERS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
#: Least number of blocks, so that small inputs also run in parallel.
LEAST_BLOCKS = 24


def letters(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, _LETTERS, strict=True)], schema=_LETTERS)


def measured(docs: DataFrame, text: str) -> tuple[int, int]:
    """Rows and bytes of all texts."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return row[0], row[1]


def block_count(size: int, block_bytes: int) -> int:
    return max(LEAST_BLOCKS, math.ceil(size / block_bytes))


def dealt(docs: DataFrame, id_col: str, text_col: str, blocks: int) -> DataFrame:
    """(block, doc_id, text), dealt by a hash of the id; rows without an id are left out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("doc_id").isNotNull())
    return rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")


def one_per_id(table: pa.Table) -> pa.Table:
    """One row for each doc_id, in the order of ids; of rows that repeat an id the one with the smallest text stays."""
    table = table.sort_by([("doc_id", "ascending")])
    ids = table["doc_id"].to_numpy()
    if len(ids) < 2 or (ids[1:] != ids[:-1]).all():
        return table
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].to_numpy()
    return table.filter(pa.array([True, *(ids[1:] != ids[:-1])]))


def by_bucket(right: pa.Table) -> dict[int, bytes]:
    """Data of the letters that a block or bucket got, by bucket (or block), in ascending order."""
    rows = sorted(zip(right["bucket"].to_pylist(), right["data"].to_pylist(), strict=True), key=lambda x: x[0])
    return dict(rows)


def ask_and_answer(blocks: DataFrame, ask: Callable, answer: Callable) -> DataFrame:
    """Letters of the blocks to the buckets, and the buckets' letters back."""
    asked = blocks.groupBy("block").applyInArrow(ask, LETTERS)
    return asked.groupBy("bucket").applyInArrow(answer, LETTERS)


def with_answers(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str | StructType) -> DataFrame:
    """``finish(texts, letters)`` for every block."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def joined(parts: list[bytes]) -> bytes:
    """Several byte strings as one."""
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8)
    ends = np.cumsum(sizes) + 8 * (n + 1)
    return [data[e - s : e] for e, s in zip(ends, sizes, strict=True)]
