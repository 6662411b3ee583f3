"""Top-k search, n-gram join and substring removal against brute force, and their edge cases."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from kerbside.llm import arrays as A
from kerbside.llm import jaccard_join, suffix_dedup, topk_search
from tests.llm import brute

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", ["op1_exact_topk", "op2_ngram_jaccard", "op4_suffix_dedup", "op7_mixing", "op9_chat_format"])
def test_query_equals_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name]) == []


def test_top_k_edges(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], "x") for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0], "tie") for i in range(30)]
    rows += [(2000, None, "x"), (2001, [1.0, None, 0.0, 0.0], "x"), (2002, [1.0, math.nan, 0.0, 0.0], "x"), (2003, [math.inf] * 4, "x"), (None, [1.0] * 4, "x")]
    rows += [(2004, [1.0, 2.0], "short"), (5, rows[5][1], "again"), (2050, [9.0], "alone")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string").withColumnRenamed("block", "dim")
    got = topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, block_vectors=64, block_queries=4).collect()
    usable = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in usable if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    empty = vectors.filter("false")
    assert topk_search.top_k(empty, empty).count() == 0
    assert topk_search.top_k(vectors.filter("vec_id < 3"), vectors.filter("vec_id = 0")).count() == 2


def test_n_gram_classes(spark, sf, documents):
    got = {r[0]: (r[1], r[2]) for r in entry.queries()["op2_ngram_jaccard"](spark, sf).collect()}
    assert got == brute.jaccard_classes(documents)


def near_copies(seed, families=12, most=40):
    """Families of near copies, some only linked over others, that share passages with other families."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    rows, n = [], 0
    for _ in range(families):
        base = rng.choices(words, k=rng.randint(20, 160)) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((n, " ".join(own).title() if rng.random() < 0.3 else " ".join(own)))
            n += 1
    return rows


@pytest.mark.parametrize("square", [8, 1024])
def test_n_gram_families(spark, monkeypatch, square):
    monkeypatch.setattr(jaccard_join, "SQUARE", square)
    rows = near_copies(3)
    rows += [(9000, None), (9001, ""), (9002, "  \n"), (9003, "one two"), (9004, "One  Two"), (9005, "one two three"), (9006, "É é"), (9007, "é é")]
    rows += [(9100, " ".join(f"l{i % 50000}" for i in range(200_000))), (9101, " ".join(f"l{i % 50000}" for i in range(190_000)))]
    rows += [rows[0], (None, "one two three four five six")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS + ", n int, prefix string")
    out = jaccard_join.linked_classes(docs).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got == brute.jaccard_classes({d: t for d, t in rows if d is not None}.items()) and len(out) == len(got)
    assert jaccard_join.linked_classes(docs.filter("false")).count() == 0


def test_filters_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], rng.integers(0, 1 << 60, 5).astype(np.uint64)]))
        apart = np.bitwise_count(np.frombuffer(jaccard_join.signature(x), np.uint64) ^ np.frombuffer(jaccard_join.signature(y), np.uint64)).sum()
        assert apart <= len(np.setxor1d(x, y))


def test_removed_bytes(spark, sf, documents):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in entry.queries()["op4_suffix_dedup"](spark, sf).collect()}
    assert got == {d: (n, r, s, brute.sha(k)) for d, (n, r, s, k) in brute.without_repeats(documents).items()}


def test_removed_bytes_edges(spark):
    loop = "ababab cdcdcd " * 40
    passage = "The quick brown fox jumps over the lazy dog near the river bank, é à ü."
    rows = [(1, passage), (2, "x" + passage + "y"), (3, loop), (4, loop[3:]), (5, loop), (6, None), (7, ""), (8, passage[:49]), (9, passage[:50]), (10, passage[1:60] + loop[:80])]
    rows += [(20 + i, f"{i} " * 30 + passage * (i % 3) + f" end {i}") for i in range(40)]
    rows += [(100, "long " + "".join(random.Random(4).choices("abcdef ", k=1_500_000)) + passage), (101, passage), (None, passage)]
    docs = spark.createDataFrame([(d, t, "a", 1) for d, t in rows + [rows[1]]], DOCS + ", lang string, bucket int")
    out = suffix_dedup.without_repeats(docs, carry=["lang"]).collect()
    want = brute.without_repeats([r for r in rows if r[0] is not None])
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in out}
    assert got == want and len(out) == len(want) and {r.lang for r in out} == {"a"}
    assert suffix_dedup.without_repeats(docs.filter("false")).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(60):
        loop = np.tile(rng.integers(97, 99, rng.integers(2, 40)), rng.integers(1, 7))
        s = np.concatenate([rng.integers(97, 99, rng.integers(10, 300)), [255], loop, [255], loop[: len(loop) // 2], [255]]).astype(np.uint8)
        order = suffix_dedup.suffix_array(s)
        padded = s.tobytes() + b"\xff" * (len(s) + 8)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: padded[i : i + len(s) + 8])
        shared = suffix_dedup.common_prefixes(s, order, 50)
        raw = s.tobytes()
        for k in range(1, len(s)):
            a, b, n = int(order[k - 1]), int(order[k]), 0
            while n < 50 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert shared[k] == n


def test_packed_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        values = rng.integers(0, 70_000, len(keys))
        back, v = A.unpack(A.pack(keys, 0, values))
        assert (back == keys).all() and (v == values).all()
        assert (A.unpack(A.pack(keys >> np.uint64(8) << np.uint64(8), 8))[0] == keys >> np.uint64(8) << np.uint64(8)).all()
        bits = rng.random(n) < 0.3
        assert (A.unflags(A.flags(bits), n) == bits).all()


def test_words_are_split_like_the_pattern():
    texts = ["", " a\tB\nc ", "É x y", None, "one", "  z  q"]
    data, starts = A.text_bytes(pa.array(texts))
    h, first = A.words(data, starts)
    found: dict[int, str] = {}
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        own = brute.WORD.findall(brute.lower(t))
        assert len(own) == b - a
        for w, x in zip(own, h[a:b].tolist(), strict=True):
            assert found.setdefault(x, w) == w
