"""Exact top-k search by inner product with vector-approximation files.

Every vector block is a small vector-approximation file: each component is replaced by the number of one of ``cells``
equal-depth cells of its dimension, and the block keeps the smallest and largest value of every cell. A block of
queries scans the approximations, which give an upper and a lower bound of each score; exact vectors are then read in
the order of their bounds (best first) until the k-th best score so far is above every bound that is left. Blocks of a
query block's slice are scanned one after the other, so the k-th score found in one block already prunes the next.

Vectors and queries meet as packed blocks in an equi-join on (length, query block, slice): the number of rows joined is
the number of block pairs, and no task holds more than one block of either side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024
CELLS = 16
READ_AT_ONCE = 64
#: Blocks scanned in turn in one task, and the least number of (query block, slice) pairs aimed at.
BLOCKS_PER_SLICE = 16
MIN_PAIRS = 24

PACKED = "dim int, block int, n int, ids binary, vectors binary, codes binary, lows binary, highs binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def _build_block(table: pa.Table) -> pa.Table:
    """One approximation file: ids in ascending order, exact vectors, cell numbers, bounds of the cells."""
    dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
    ids = table["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids = np.ascontiguousarray(ids[order])
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(len(ids), dim)[order].astype(np.int64)
    n = len(ids)
    ranks = np.argsort(np.argsort(vectors, axis=0, kind="stable"), axis=0, kind="stable")
    codes = (ranks * CELLS // n).astype(np.uint8)
    ordered = np.sort(vectors, axis=0)
    used = min(CELLS, n)
    cell_of_rank = np.arange(n) * CELLS // n
    lows, highs = np.zeros((CELLS, dim), np.int64), np.zeros((CELLS, dim), np.int64)
    first = np.flatnonzero(np.diff(cell_of_rank, prepend=-1))
    last = np.append(first[1:], n) - 1
    lows[cell_of_rank[first]], highs[cell_of_rank[first]] = ordered[first], ordered[last]
    assert len(first) == used
    return pa.table(
        {
            "dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "n": pa.array([n], pa.int32()),
            "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "codes": [codes.tobytes()],
            "lows": [lows.tobytes()], "highs": [highs.tobytes()],
        }
    )


class _Best:
    """The k best (score, id) of every query of one block so far; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def kth(self, q: int) -> float:
        score = self.found[q][0]
        return float(score[-1]) if len(score) == self.k else -math.inf

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.found[q][0], scores]), np.concatenate([self.found[q][1], ids])
        order = np.lexsort((i, -s))[: self.k]
        self.found[q] = (s[order], i[order])

    def batch(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.found]
        columns = [np.repeat(self.ids, n), np.concatenate([i for _, i in self.found]), np.concatenate([s for s, _ in self.found])]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def _scan(best: _Best, queries: np.ndarray, block: dict, k: int) -> None:
    """Bounds of all pairs from the approximations, then exact reads in bound order."""
    dim, n = queries.shape[1], block["n"]
    ids = np.frombuffer(block["ids"], np.int64)
    exact = np.frombuffer(block["vectors"], np.int64).reshape(n, dim)
    codes = np.frombuffer(block["codes"], np.uint8).reshape(n, dim)
    lows = np.frombuffer(block["lows"], np.int64).reshape(CELLS, dim).astype(np.float64)
    highs = np.frombuffer(block["highs"], np.int64).reshape(CELLS, dim).astype(np.float64)
    every = np.arange(dim)
    middle, radius = ((lows + highs) / 2)[codes, every], ((highs - lows) / 2)[codes, every]
    for start in range(0, len(queries), 128):
        part = queries[start : start + 128].astype(np.float64)
        centre, reach = part @ middle.T, np.abs(part) @ radius.T
        reach += 1e-9 * (np.abs(centre) + reach)  # rounding of large values
        upper, lower = centre + reach, centre - reach
        at = np.searchsorted(ids, best.ids[start : start + 128])
        own = np.flatnonzero((at < n) & (ids[np.minimum(at, n - 1)] == best.ids[start : start + 128]))
        upper[own, at[own]] = lower[own, at[own]] = -math.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k] if n >= k else np.full(len(part), -math.inf)
        for row in range(len(part)):
            q = start + row
            certain = max(kth[row], best.kth(q))
            left = np.flatnonzero((upper[row] >= certain) & (upper[row] > -math.inf))
            left = left[np.lexsort((ids[left], -upper[row, left]))]
            for at_once in range(0, len(left), READ_AT_ONCE):
                read = left[at_once : at_once + READ_AT_ONCE]
                if upper[row, read[0]] < best.kth(q):
                    break
                best.add(q, exact[read] @ queries[q], ids[read])


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block_vectors: int = BLOCK_VECTORS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """The ``k`` vectors with the highest integer inner product for every query: (query_id, rank, vec_id, score).

    Components become floor(scale * x). Rows whose id or vector is null, or whose vector holds a null, NaN or infinite
    component, take no part on either side. An id that occurs more than once counts once, with its smallest vector. A
    query never finds its own id. Vectors meet vectors of their own length only; queries without any candidate give no
    row. Ties go to the smaller id. Other columns are ignored. Vector and query tables may be of any size.
    """

    def packed(df: DataFrame, per_block: int) -> tuple[DataFrame, int]:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))
        rows = rows.filter(F.col("id").isNotNull() & usable(F.col("x")))
        blocks = max(1, math.ceil(rows.count() / per_block))
        rows = rows.select("id", quantised(F.col("x"), scale).alias("v"))
        rows = rows.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")})
        # both groupings use the distribution by block: one shuffle
        rows = rows.repartition("block").groupBy("block", "id").agg(F.min(F.struct("dim", "v")).alias("r"))
        rows = rows.select("id", "block", "r.dim", "r.v")
        return rows.groupBy("block", "dim").applyInArrow(_build_block, PACKED), blocks

    files, n_files = packed(vectors, block_vectors)
    asked, n_asked = packed(queries, block_queries)
    slices = min(n_files, max(math.ceil(n_files / BLOCKS_PER_SLICE), math.ceil(MIN_PAIRS / n_asked)))
    files = files.select(
        "dim", F.pmod("block", F.lit(slices)).alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))).alias("query_block"),
        "n", "ids", "vectors", "codes", "lows", "highs",
    )
    asked = asked.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.col("block").alias("query_block"),
        F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"),
    )
    pairs = files.hint("merge").join(asked, ["dim", "slice", "query_block"])

    def search(batches):
        best, key, block = None, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
                if key != (one["dim"], one["slice"], one["query_block"]):
                    if best is not None:
                        yield best.batch()
                    key = (one["dim"], one["slice"], one["query_block"])
                    query_ids = np.frombuffer(one["query_ids"], np.int64)
                    block = np.frombuffer(one["query_vectors"], np.int64).reshape(len(query_ids), one["dim"])
                    best = _Best(query_ids, k)
                _scan(best, block, one, k)
        if best is not None:
            yield best.batch()

    found = pairs.mapInArrow(search, FOUND)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
