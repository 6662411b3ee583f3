"""Ranked lexical search: posting lists in blocks of similar documents, skipped by coordinatewise maxima.

The index holds every document as its distinct terms (as 64-bit hashes) with their occurrences, and its length; it depends
on no query. A document is a sparse vector with one coordinate per term: the term's weight times its saturated, length
normalised count. An item's score for a document is the sum of the document's coordinates at the item's terms.

Tasks read the index in shards of some thousand documents. In a shard the posting list of a term is clustered: some of its
documents are pivots, each document joins the pivot with the most similar sketch (a random projection of its vector), and
the clusters are cut into blocks. Each block stores the maximum of every coordinate over its documents. The sum of these
maxima at an item's terms bounds the score of every document in the block, so a block is skipped for an item only if that
sum is below the item's k-th best score so far. A list is not opened for an item at all if the largest coordinates of this and
the item's other unopened lists cannot reach that score together. Documents that are left are scored exactly, once for
each item. Summaries keep the coordinates of the items that open the list, since no other coordinate is ever asked for.

The k best of a task and then, in two steps, of all tasks are merged. Items are searched in chunks of about
``CHUNK_TERMS`` terms: one chunk is what a broadcast holds, and each chunk is one pass over the index.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm import arrays as A
from kerbside.llm.storage import stage

#: Terms of the items that are searched in one pass, on average.
CHUNK_TERMS = 16_384
#: Values of a shard's matrix (documents times terms of the items), 8 bytes each.
SHARD_VALUES = 1 << 23
MOST_DOCUMENTS = 8_192
#: Documents of a block. Small ones have tight bounds: on whole texts blocks of 4 let 37 % be skipped, blocks of 16 let 8 %.
BLOCK = 4
SKETCH = 16
SLICE = 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_INDEX = "doc_id long, n long, terms array<long>, tf array<int>"
_FOUND = "item_id long, doc_id long, score long"


def term_counts(text: bytes) -> Counter:
    """Occurrences of every term of a whole text; long texts are read in slices that end between terms."""
    counts, at = Counter(), 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            found = _BREAK.search(text, end)
            end = found.start() if found else len(text)
        counts.update(_TERM.findall(text[at:end].lower()))
        at = end
    return counts


def term_hash(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def term_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf) of every document that has an id and a term; n counts terms with repeats."""

    def read(batches):
        for batch in batches:
            data, starts = A.text_bytes(batch.column(1))
            for first, last in A.portions(starts, 1 << 22):
                n, sizes, terms, tf = [], [0], [], []
                for x, y in zip(starts[first:last], starts[first + 1 : last + 1], strict=True):
                    counts = term_counts(data[x:y].tobytes())
                    n.append(sum(counts.values()))
                    terms += map(term_hash, counts)
                    tf += counts.values()
                    sizes.append(len(terms))
                at = pa.array(sizes, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.int64())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int32()))]
                columns = [batch.column(0)[first:last], pa.array(n, pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(read, _INDEX).filter("n > 0")


def restricted(batch: pa.RecordBatch, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, tf) of the postings of a batch whose terms are among the sorted ``known``."""
    terms = batch.column("terms")
    flat = terms.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(batch.num_rows), terms.value_lengths().to_numpy(zero_copy_only=False))
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[at] == flat
    return rows[hit], at[hit], batch.column("tf").flatten().to_numpy(zero_copy_only=False)[hit].astype(np.int64)


def statistics(index: DataFrame, known: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and in how many documents each known term occurs."""
    sent = index.sparkSession.sparkContext.broadcast(known.tobytes())

    def count(batches):
        terms = np.frombuffer(sent.value, np.int64)
        held, documents, length = np.zeros(len(terms), np.int64), 0, 0
        for batch in batches:
            held += np.bincount(restricted(batch, terms)[1], minlength=len(terms))
            documents += batch.num_rows
            length += int(batch.column("n").to_numpy().sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], some]), pa.int64()), pa.array(np.concatenate([[documents, length], held[some]]), pa.int64())], names=["term", "n"]
        )

    table = index.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = dict(zip(table["term"].to_pylist(), table["n"].to_pylist(), strict=True))
    held = np.array([sums.get(i, 0) for i in range(len(known))], np.int64)
    return sums.get(-2, 0), sums.get(-1, 0), held


class Queries:
    """The items of one chunk, the weights of their terms, and what the corpus is like."""

    def __init__(self, known: np.ndarray, of_item: np.ndarray, of_term: np.ndarray, items: np.ndarray, documents: int, length: int, held: np.ndarray):
        self.known, self.items, self.documents, self.length = known, items, documents, length
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in held.tolist()], np.int64)
        order = np.lexsort((of_term, of_item))
        self.terms = np.split(of_term[order], np.searchsorted(of_item[order], np.arange(1, len(items))))
        self.asks = np.zeros((len(known), len(items)))
        self.asks[of_term, of_item] = 1.0
        # one fixed draw of signs: every task sketches alike
        self.signs = np.random.default_rng(20).choice([-1.0, 1.0], (len(known), SKETCH))

    def vectors(self, rows: np.ndarray, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Documents times terms; whole numbers below 2**53, so held exactly."""
        m = 100 - 50 + (50 * n * self.documents) // self.length
        x = np.zeros((len(n), len(self.known)))
        x[rows, terms] = self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[rows]))
        return x


def opened(q: Queries, highest: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Terms times items: the lists that an item opens.

    The lists with the smallest maxima stay closed as long as their maxima together are below what the item must reach.
    """
    out = np.zeros((len(q.known), len(q.items)), bool)
    for i, terms in enumerate(q.terms):
        order = terms[np.argsort(highest[terms], kind="stable")]
        sums = np.cumsum(highest[order])
        out[order[(sums >= reach[i]) & (highest[order] > 0)], i] = True
    return out


def blocks_of(sketch: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a list's documents by cluster, and where its blocks begin: at most ``size`` documents of one cluster."""
    n = len(sketch)
    if n <= size:
        return np.arange(n), np.zeros(1, np.int64)
    pivots = sketch[:: size][: max(2, n // size)]
    cluster = np.argmax(sketch @ pivots.T, axis=1)
    order = np.argsort(cluster, kind="stable")
    counts = np.bincount(cluster, minlength=len(pivots))
    counts = counts[counts > 0]
    first = np.cumsum(counts) - counts
    inside = np.arange(n) - np.repeat(first, counts)
    return order, np.flatnonzero(inside % size == 0)


def candidates(q: Queries, x: np.ndarray, reach: np.ndarray, tally: np.ndarray | None = None) -> np.ndarray:
    """Documents times items: pairs that no summary bound rules out. ``tally`` adds up blocks seen and skipped."""
    wanted = opened(q, x.max(axis=0), reach)
    sketch = x @ q.signs
    sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
    marked = np.zeros((len(x), len(q.items)), bool)
    for t in np.flatnonzero(wanted.any(axis=1)):
        postings = np.flatnonzero(x[:, t])
        items = np.flatnonzero(wanted[t])
        order, starts = blocks_of(sketch[postings], BLOCK)
        postings = postings[order]
        coordinates = np.flatnonzero(q.asks[:, items].any(axis=1))
        summaries = np.maximum.reduceat(x[np.ix_(postings, coordinates)], starts, axis=0)
        bounds = summaries @ q.asks[np.ix_(coordinates, items)]
        # sums of doubles may be off by a rounding once they pass 2**53
        live = bounds * (1 + 1e-9) >= reach[items]
        sizes = np.diff(np.append(starts, len(postings)))
        at = np.ix_(postings, items)
        marked[at] |= np.repeat(live, sizes, axis=0)
        if tally is not None:
            tally += (live.size, live.size - live.sum())
    return marked


class Best:
    """The k best documents of every item so far: highest score first, then smallest id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.ids = [np.empty(0, np.int64)] * items
        self.scores = [np.empty(0, np.int64)] * items
        self.reach = np.ones(items)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[i], ids]), np.concatenate([self.scores[i], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]
        if len(order) == self.k:
            self.reach[i] = max(1, self.scores[i][-1])


def search_shard(q: Queries, best: Best, ids: np.ndarray, n: np.ndarray, postings: tuple, tally: np.ndarray | None = None) -> None:
    x = q.vectors(*postings, n)
    marked = candidates(q, x, best.reach, tally)
    for i in np.flatnonzero(marked.any(axis=0)):
        docs = np.flatnonzero(marked[:, i])
        scores = x[np.ix_(docs, q.terms[i])].astype(np.int64).sum(axis=1)
        good = (scores > 0) & (scores >= best.reach[i])
        if good.any():
            best.add(i, ids[docs[good]], scores[good])


def search_chunk(index: DataFrame, q: Queries, k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of every task for the items of one chunk."""
    sent = index.sparkSession.sparkContext.broadcast(q)
    most = int(min(MOST_DOCUMENTS, max(16, SHARD_VALUES // len(q.known))))

    def search(batches):
        queries = sent.value
        best = Best(len(queries.items), k)
        waiting, rows = [], 0

        def shard():
            ids, n = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
            before = np.cumsum([0, *(len(w[0]) for w in waiting)])
            places = np.concatenate([w[2][0] + b for w, b in zip(waiting, before[:-1], strict=True)])
            postings = places, np.concatenate([w[2][1] for w in waiting]), np.concatenate([w[2][2] for w in waiting])
            search_shard(queries, best, ids, n, postings)

        for big in batches:
            at = 0
            while at < big.num_rows:
                batch = big.slice(at, most - rows)
                waiting.append((batch.column("doc_id").to_numpy(), batch.column("n").to_numpy(), restricted(batch, queries.known)))
                at, rows = at + batch.num_rows, rows + batch.num_rows
                if rows == most:
                    shard()
                    waiting, rows = [], 0
        if rows:
            shard()
        sizes = [len(x) for x in best.ids]
        columns = [np.repeat(queries.items, sizes), np.concatenate(best.ids), np.concatenate(best.scores)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    return index.mapInArrow(search, _FOUND)


def item_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    index = term_index(queries, id_col, text_col)
    return index.select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, in two steps: parts of an item first, so no task meets an item's finds of all tasks."""
    order = [F.desc("score"), F.asc("doc_id")]
    salted = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)


def search(
    docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text",
    chunk_terms: int = CHUNK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item, all with a score above 0.

    Terms are runs of digits, letters A-Z (lower-cased) and characters beyond ASCII. Equal scores rank by ascending doc_id.
    Texts that are null or hold no term are no documents; an item without terms, or whose terms no document holds, has no
    rows. Rows without an id take no part. Rows that repeat a doc_id are documents of their own and can rank beside each
    other; rows that repeat an item's id are one item with the terms of all. Empty tables give an empty table. Other
    columns, whatever their names, play no part.
    """
    index = stage(term_index(docs, id_col, text_col), "term-index")
    asked = stage(item_terms(queries, query_id, query_text), "item-terms")
    chunks = max(1, math.ceil(asked.count() / chunk_terms))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)))
    parts = []
    for chunk in range(chunks):
        table = asked.filter(F.col("chunk") == chunk).select("item_id", "term").toArrow()
        if not table.num_rows:
            continue
        known, of_term = np.unique(table["term"].to_numpy(), return_inverse=True)
        items, of_item = np.unique(table["item_id"].to_numpy(), return_inverse=True)
        documents, length, held = statistics(index, known)
        if not documents:
            break
        found = search_chunk(index, Queries(known, of_item, of_term, items, documents, length, held), k)
        parts.append(ranked(found, k) if chunks == 1 else stage(ranked(found, k), "ranked"))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if not parts else None
    for part in parts:
        part = part.select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.union(part)
    return out
