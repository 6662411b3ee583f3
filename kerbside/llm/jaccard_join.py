"""N-gram Jaccard join: documents whose word 5-grams overlap by at least 75 %, as classes of linked documents.

1. Every document's set of shingles is put in one order for the whole corpus: rare shingles first. How rare a shingle
   is comes from an exchange of sorted key lists between blocks of documents and hash ranges (``exchange``).
2. Two linked sets share a shingle among the first |x| - ceil(t |x|) + 1 of either. Of these prefixes only shingles that
   occur in a second document can join, which are few: the rest of a prefix never leaves its block.
3. Documents with equal sets are one representative from here on.
4. In each prefix shingle's group the most central document (the one whose shingles are the most common) is compared
   with all others: as many pairs as members. The links found join most of a family of copies into one component.
5. Then only pairs of documents that still lie in different components meet, group by group, large groups in squares of
   bounded size; the length, positional and suffix filters run on these before a pair leaves its task.
6. Each pair that is left is verified once, on the two whole texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import arrays as A
from kerbside.llm import exchange as X
from kerbside.llm.components import components
from kerbside.llm.storage import stage

WORDS = 5
PERCENT = 75
BLOCK_BYTES = 6 << 20
#: Keys of the frequency exchange: bits left out of a hash (frequencies only order the shingles), keys per bucket.
SHIFT = 24
BUCKET_KEYS = 2_000_000
#: Bits of the parity signature of a set, and members of a group that meet in one task.
SIGNATURE_BITS = 512
SQUARE = 1024

SETS = (
    "doc_id long, n long, digest binary, central double, prefix array<struct<gram: long, position: int>>,"
    " signature binary, packed binary"
)


def shingle_sets(table: pa.Table, words: int):
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    data, starts = A.text_bytes(table["text"])
    for a, b in A.portions(starts):
        own = starts[a : b + 1] - starts[a]
        h, first = A.words(data[starts[a] : starts[b]], own)
        g = A.grams(h, words)
        for x, y in zip(first[:-1], first[1:], strict=True):
            if y - x >= words:
                yield np.unique(g[x : y - words + 1])
            elif y > x:
                yield A.mix(A.grams(h[x:y], int(y - x)))
            else:
                yield np.empty(0, np.uint64)


def _rarity(n: np.ndarray) -> np.ndarray:
    """Number of documents in steps of a twelfth of a power of two; 0 for a single one."""
    return np.minimum(255, np.rint(8 * np.log2(np.maximum(n, 1)))).astype(np.uint8)


def signature(grams: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of ``SIGNATURE_BITS`` parts: sets differ in at least as many shingles as
    their signatures in bits."""
    counts = np.bincount((grams & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64), minlength=SIGNATURE_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def shingle_frequencies(blocks: DataFrame, buckets: int, words: int) -> DataFrame:
    """Letters to every block with the rarity of each of its distinct shingles."""
    lower = A.bucket_starts(buckets)

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        sets = list(shingle_sets(X.one_per_id(table), words))
        keys, documents = np.unique(np.concatenate(sets) >> np.uint64(SHIFT) << np.uint64(SHIFT), return_counts=True)
        cut = np.append(np.searchsorted(keys, lower), len(keys))
        return X.letters([(block, i, A.pack(keys[a:b], SHIFT, documents[a:b])) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        got = {block: A.unpack(data) for block, data in zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True)}
        keys, at = np.unique(np.concatenate([k for k, _ in got.values()]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([v for _, v in got.values()]), minlength=len(keys))
        code = _rarity(total)
        rows, start = [], 0
        for block, (k, _) in got.items():
            rows.append((block, bucket, A.zlib.compress(code[at[start : start + len(k)]].tobytes(), 1)))
            start += len(k)
        return X.letters(rows)

    return X.ask_and_answer(blocks, ask, answer)


def shingled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One row per document: size and digest of its set and, if a second document has one of its prefix shingles, the
    shared part of the prefix, the signature and the packed text."""
    _, size = X.measured(docs, text_col)
    blocks = X.dealt(docs, id_col, text_col, X.block_count(size, BLOCK_BYTES))
    # a shingle starts at every word; words have some five letters
    answers = shingle_frequencies(blocks, max(8, size // 5 // BUCKET_KEYS), words)

    def prefixes(table: pa.Table, right: pa.Table) -> pa.Table:
        table = X.one_per_id(table)
        sets = list(shingle_sets(table, words))
        everything = np.concatenate([*sets, np.empty(0, np.uint64)]) >> np.uint64(SHIFT)
        keys = np.unique(everything)
        rarity = np.frombuffer(b"".join(A.zlib.decompress(x) for x in X.by_bucket(right).values()), np.uint8)
        rarity = rarity[np.searchsorted(keys, everything)]
        texts, squeeze = table["text"].to_pylist(), zstandard.ZstdCompressor(level=3)
        rows: dict[str, list] = {name: [] for name in ("n", "digest", "central", "prefix", "signature", "packed")}
        start = 0
        for i, s in enumerate(sets):
            own = rarity[start : start + len(s)]
            start += len(s)
            length = len(s) + (-percent * len(s) // 100) + 1 if len(s) else 0
            order = np.lexsort((s, own))[:length]
            shared = np.flatnonzero(own[order] > 0)
            rows["n"].append(len(s))
            rows["digest"].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            rows["central"].append(float(own.mean()) if len(s) else 0.0)
            if len(shared):
                grams = s[order[shared]].view(np.int64).tolist()
                rows["prefix"].append([{"gram": g, "position": p} for g, p in zip(grams, shared.tolist(), strict=True)])
                rows["signature"].append(signature(s))
                rows["packed"].append(squeeze.compress((texts[i] or "").encode()))
            else:
                for name in ("prefix", "signature", "packed"):
                    rows[name].append(None)
        kinds = {
            "n": pa.int64(), "digest": pa.binary(), "central": pa.float64(), "signature": pa.binary(), "packed": pa.binary(),
            "prefix": pa.list_(pa.struct([("gram", pa.int64()), ("position", pa.int32())])),
        }
        columns = {"doc_id": table["doc_id"]} | {name: pa.array(values, kinds[name]) for name, values in rows.items()}
        return pa.table(columns).select(["doc_id", "n", "digest", "central", "prefix", "signature", "packed"])

    return stage(X.with_answers(blocks, answers, prefixes, SETS), "shingled")


def fits_length(n: Column, m: Column, percent: int) -> Column:
    """Length filter: the smaller set is at least that share of the larger."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def fits_position(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Positional filter: if this is the first shared shingle, what follows it on the shorter side can still suffice."""
    return (F.least(n - i, m - j)) * (100 + percent) >= (n + m) * percent


def verified(pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose whole texts link."""
    packed = sets.select("doc_id", "packed")
    both = pairs.join(packed.toDF("a", "packed_a"), "a").join(packed.toDF("b", "packed_b"), "b")

    def verify(batches):
        expand = zstandard.ZstdDecompressor()
        last_b, set_b = None, None

        def grams(packed: bytes) -> np.ndarray:
            return next(shingle_sets(pa.table({"text": [expand.decompress(packed).decode()]}), words))

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = np.zeros(len(a), bool)
            for row in range(len(a)):
                if b[row] != last_b:
                    last_b, set_b = b[row], grams(batch.column("packed_b")[row].as_py())
                set_a = grams(batch.column("packed_a")[row].as_py())
                common = len(np.intersect1d(set_a, set_b, assume_unique=True))
                keep[row] = 100 * common >= percent * (len(set_a) + len(set_b) - common)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.array(a)[keep], np.array(b)[keep])], names=["a", "b"])

    return stage(both.mapInArrow(verify, "a long, b long"), "verified")


def _square_pairs(percent: int):
    """Filter the pairs of neighbours of one group whose components differ; rows come sorted by group."""
    names = ("gram", "left", "right", "side", "doc_id", "n", "position", "component", "signature")

    def pairs(batches):
        kept = None
        for batch in [*batches, None] if isinstance(batches, list) else _with_end(batches):
            if batch is not None:
                now = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in names[:-1]}
                sig = b"".join(batch.column("signature").to_pylist())
                now["signature"] = np.frombuffer(sig, np.uint64).reshape(batch.num_rows, -1)
                if kept is not None:
                    now = {x: np.concatenate([kept[x], now[x]]) for x in names}
            elif kept is None:
                return
            else:
                now = kept
            new = np.ones(len(now["gram"]), bool)
            new[1:] = (now["gram"][1:] != now["gram"][:-1]) | (now["left"][1:] != now["left"][:-1]) | (now["right"][1:] != now["right"][:-1])
            group = np.cumsum(new)
            end = len(group) if batch is None else int(np.flatnonzero(new)[-1])  # the last group may go on
            kept = None if batch is None else {x: now[x][end:] for x in names}
            yield _compare({x: now[x][:end] for x in names}, group[:end], percent)

    return pairs


def _with_end(batches):
    yield from batches
    yield None


def _compare(rows: dict, group: np.ndarray, percent: int) -> pa.RecordBatch:
    a, b = [], []
    live = np.arange(len(group))
    step = 0
    while len(live):
        step += 1
        live = live[live + step < len(group)]
        live = live[group[live] == group[live + step]]
        x, y = live, live + step
        # in a square off the diagonal only the two sides meet
        ok = (rows["component"][x] != rows["component"][y]) & ((rows["left"][x] == rows["right"][x]) | (rows["side"][x] != rows["side"][y]))
        x, y = x[ok], y[ok]
        n, m, i, j = rows["n"][x], rows["n"][y], rows["position"][x], rows["position"][y]
        ok = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - i, m - j) * (100 + percent) >= (n + m) * percent)
        x, y = x[ok], y[ok]
        n, m = rows["n"][x], rows["n"][y]
        needed = -(-percent * (n + m) // (100 + percent))
        apart = np.bitwise_count(rows["signature"][x] ^ rows["signature"][y]).sum(axis=1)
        ok = apart <= n + m - 2 * needed
        a.append(rows["doc_id"][x[ok]])
        b.append(rows["doc_id"][y[ok]])
    a, b = (np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64) for v in (a, b))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A document's set holds the distinct ``words``-grams of its words (A-Z lower-cased); a text of fewer words is one
    shingle, an empty or null text has none and links with nothing. Two documents link when their sets overlap by at
    least ``percent`` % (Jaccard); ``component_id`` is the smallest id reachable over links. Rows without an id are left
    out; rows that repeat an id count as one, with its smallest text. Other columns are ignored. Shingles are compared
    by 64-bit hashes.
    """
    sets = shingled(docs, id_col, text_col, words, percent)
    classes = sets.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    found = sets.filter("prefix is not null").join(classes, ["digest", "doc_id"], "left_semi")
    found = stage(found.select("doc_id", "n", "central", "prefix", "signature", "packed"), "representatives")

    entries = found.select("doc_id", "n", "central", F.inline("prefix"))
    # the pivot of a group: the most central document, ties to the smallest id
    pivots = entries.groupBy("gram").agg(
        F.max(F.struct("central", (-F.col("doc_id")).alias("neg"), "n", "position")).alias("p"), F.count(F.lit(1)).alias("members")
    ).filter("members > 1")
    pivots = pivots.select("gram", (-F.col("p.neg")).alias("b"), F.col("p.n").alias("m"), F.col("p.position").alias("j"))
    stars = entries.join(pivots, "gram").filter(F.col("doc_id") != F.col("b"))
    stars = stars.filter(fits_length(F.col("n"), F.col("m"), percent) & fits_position(F.col("n"), F.col("position"), F.col("m"), F.col("j"), percent))
    links = verified(stars.select(F.col("doc_id").alias("a"), "b").distinct(), found, words, percent)
    labels = components(links)

    placed = found.select("doc_id", "n", "signature", F.inline("prefix"))
    placed = placed.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_groups = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members"))
    open_groups = open_groups.filter("x <> y").select("gram", F.ceil(F.col("members") / SQUARE).cast("int").alias("parts"))
    placed = placed.join(open_groups, "gram").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    squares = placed.select(
        "gram", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), (F.col("part") <= F.col("other")).alias("side"),
        "doc_id", F.col("n"), F.col("position").cast("long").alias("position"), "component", "signature",
    )
    squares = squares.repartition("gram", "left", "right").sortWithinPartitions("gram", "left", "right", "doc_id")
    pairs = squares.mapInArrow(_square_pairs(percent), "a long, b long").distinct()
    more = verified(pairs, found, words, percent)
    labels = components(links.union(more))

    named = classes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.select("digest", F.coalesce("component", "doc_id").alias("component_id"))
    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    return rows.join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
