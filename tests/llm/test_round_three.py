"""Line deduplication, ranked lexical search and tokenizer alignment against SQL and plain versions, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from kerbside.llm import lexical_search as L
from kerbside.llm import line_dedup, token_alignment
from tests.llm import brute

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_lexical_search"])
def test_query_equals_sql(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name]) == []


# lines


def plain_lines(rows, least_documents, least_chars=1):
    def key(line):
        return brute.lower(line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least_chars:
                held[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < least_documents]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


LINES = ["Shared Line", "  shared line\t", "SHARED LINE\r", "ÄRGER", "ärger", "x", "xy", "", "   ", "\x85pad", "tail\x1f", "日本", "own"]


def line_rows():
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(LINES) + (str(i) if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 9)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "\n\n own \n"), (204, "Shared Line"), (205, "\n".join(["long own line"] * 30_000))]
    rows += [rows[5], (5, "another text of the same id\nxy"), (None, "xy\nno id"), (None, "xy\nno id")]
    return rows


@pytest.mark.parametrize("least_documents,least_chars,most_shared", [(10, 1, 1 << 18), (10, 3, 1 << 18), (2, 1, 3), (1, 2, 0), (1000, 1, 5)])
def test_lines(spark, least_documents, least_chars, most_shared):
    rows = line_rows()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS + ", kept string, a int, __text string").repartition(7)
    out = line_dedup.lines_dropped(docs, least_documents, least_chars, carry=["a", "__text"] if most_shared > 5 else ["a"], most_shared=most_shared)
    got = [tuple(r)[:4] for r in out.drop("a", "__text").collect()]
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(got, key=key) == sorted(plain_lines(rows, least_documents, least_chars), key=key)


def test_lines_empty_table_and_names(spark):
    none = spark.createDataFrame([], DOCS)
    assert line_dedup.lines_dropped(none).collect() == []
    with pytest.raises(ValueError):
        line_dedup.lines_dropped(none.selectExpr("*", "1 AS kept"), carry=["kept"])


# lexical search


def plain_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    tf = [(d, Counter(term.findall(brute.lower(t)))) for d, t in docs if d is not None]
    tf = [(d, c) for d, c in tf if c]
    n_docs, length = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(term.findall(brute.lower(t)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, c in tf:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def lexical_rows(n=700, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["Ünï", "日本", "x9", "A", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(n)]
    docs += [(5000 + i, docs[3][1]) for i in range(40)]
    docs += [(6000, None), (6001, ""), (6002, "... !!"), (None, "w1 w2"), (3, docs[3][1]), (6003, "w1 " * 2_000), (6004, "_w2_w2-W3\x7fw4")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)]
    items += [(100, None), (101, ""), (102, "unseen words"), (None, "w1"), (7, "w5 w6"), (103, docs[3][1]), (104, "the THE w1 w1")]
    return docs, items


@pytest.mark.parametrize("chunk_terms,shard", [(1 << 14, 1 << 23), (60, 1 << 12)])
def test_search_equals_brute_force(spark, monkeypatch, chunk_terms, shard):
    monkeypatch.setattr(L, "SHARD_VALUES", shard)
    docs, items = lexical_rows()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", n int, terms string").repartition(5)
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = L.search(table, asked, k=20, chunk_terms=chunk_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == plain_search(docs, items, 20)


def test_search_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], DOCS)
    for docs, items in ((none, one), (one, none), (none, none), (one, spark.createDataFrame([(1, "?")], DOCS))):
        out = L.search(docs, items.toDF("item_id", "text"))
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def shard_of(rows, items):
    docs = [L.term_counts(t.encode()) for _, t in rows]
    asked = [set(L.term_counts(t.encode())) for t in items]
    known = np.array(sorted({L.term_hash(w) for terms in asked for w in terms}), np.int64)
    place = {int(h): i for i, h in enumerate(known)}
    hits = [(r, place[h], c) for r, counts in enumerate(docs) for w, c in counts.items() if (h := L.term_hash(w)) in place]
    of = [(i, place[L.term_hash(w)]) for i, terms in enumerate(asked) for w in terms]
    n = np.array([sum(c.values()) for c in docs], np.int64)
    held = np.bincount([h[1] for h in hits], minlength=len(known))
    of_item, of_term = np.array(of).T
    q = L.Queries(known, of_item, of_term, np.arange(len(items)), len(docs), int(n.sum()), held)
    return q, tuple(np.array(x, np.int64) for x in zip(*hits, strict=True)), n


def test_bounds_hold_and_blocks_are_skipped():
    rng = random.Random(9)
    # words that every topic shares, and few words of its own: a list of a shared word holds all topics
    topics = [[f"t{t}w{i}" for i in range(8)] for t in range(12)]
    shared = [f"s{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(topics[i % 12], k=6) + rng.sample(shared, 8))) for i in range(1500)]
    items = [" ".join(rng.sample(topics[t], 4) + rng.sample(shared, 6)) for t in range(12)]
    q, postings, n = shard_of(rows, items)
    best = L.Best(len(items), 10)
    ids = np.arange(len(rows))
    L.search_shard(q, best, ids, n, postings)
    x = q.vectors(*postings, n)
    scores = x @ q.asks
    for i in range(len(items)):
        order = np.lexsort((ids, -scores[:, i]))[:10]
        assert best.ids[i].tolist() == order.tolist() and best.scores[i].tolist() == scores[order, i].astype(int).tolist()
    # with the k-th scores known, every document that reaches one stays a candidate, and most blocks are skipped
    tally = np.zeros(2, np.int64)
    marked = L.candidates(q, x, best.reach, tally)
    assert marked[scores >= best.reach].all()
    assert tally[1] > 0.3 * tally[0] and marked.mean() < 0.1
    # similar documents share blocks: fewer candidates than with blocks in the order of ids
    plain = lambda sketch, size: (np.arange(len(sketch)), np.arange(0, len(sketch), size))
    kept, L.blocks_of = L.blocks_of, plain
    try:
        assert L.candidates(q, x, best.reach).sum() > marked.sum()
    finally:
        L.blocks_of = kept


def test_blocks_of_lists():
    for n in (1, 15, 16, 17, 500):
        sketch = np.random.default_rng(n).normal(size=(n, L.SKETCH))
        order, starts = L.blocks_of(sketch, L.BLOCK)
        assert sorted(order.tolist()) == list(range(n)) and starts[0] == 0
        assert (np.diff(np.append(starts, n)) <= L.BLOCK).all() and (np.diff(starts) > 0).all()


def test_terms_of_long_texts(monkeypatch):
    text = (" ".join(f"word{i % 97}" for i in range(5_000)) + "é" * 300).encode()
    whole = L.term_counts(text)
    monkeypatch.setattr(L, "SLICE", 11)
    assert L.term_counts(text) == whole


# tokenizers


@pytest.fixture(scope="module")
def codec():
    with open(token_alignment.BYTE_LEVEL, "rb") as a, open(token_alignment.PIECES, "rb") as b:
        return token_alignment.Codec(a.read(), b.read())


def plain_alignment(codec, text):
    """Groups of a text as [(A ids, B ids)], by walking over the decoded bytes alone."""
    raw = b" " + (text or "").encode()
    if not text:
        return []
    a, b = codec.a.encode(" " + text, add_special_tokens=False).ids, codec.b.encode(text)
    if b"".join(codec.a_bytes[i] for i in a) != raw or b"".join(codec.b_bytes[i] for i in b) != raw:
        return []
    groups, x, y, left, right = [], [], [], 0, 0
    a, b = a[:], b[:]
    while a or b:
        if left <= right and a:
            x.append(a.pop(0))
            left += len(codec.a_bytes[x[-1]])
        else:
            y.append(b.pop(0))
            right += len(codec.b_bytes[y[-1]])
        if left == right and x and y:
            groups.append((x, y))
            x, y = [], []
    return groups


TEXTS = [
    None, "", " ", "  ", "\n", "plain words here", " leading", "trailing ", "a  b   c\t\td\r\n\r\n", "héllo wörld", "日本語のテキスト", "a𝄞é̃ꙮx𝄞𝄞",
    "<|endoftext|> and <s>[INST] </s> <unk> <0x41>", "▁a", "a▁b", "\x00\x01\x7f", "�", "👩‍👩‍👧 family 🏳️‍🌈", "ﬁ Å ①", "x" * 3_000, "né" * 400,
    "ا ل ع ر ب ي ة", "שלום", "हिन्दी", "  　", "é", "don't we'll I'M 12345 ++ == ///", "\U000e0001\U0010ffff",
]


def test_alignment_equals_plain_version(spark, codec, sf):
    rows = list(enumerate(TEXTS)) + [(3, "again"), (None, "no id"), (None, "no id"), (900, TEXTS[5])]
    rows += [(1000 + d, t) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", groups string, row int").repartition(6)
    groups = [plain_alignment(codec, t) for _, t in rows]
    counts = Counter((x[-1], y[-1]) for g in groups for x, y in g)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    want = []
    for (doc, _), g in zip(rows, groups, strict=True):
        pairs = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        best = sum(counts[p] == highest[p[1]] for p in pairs)
        want.append((doc, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(g), best, sum(counts[p] for p in pairs), text))
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    for most in (token_alignment.MOST_PAIRS, 50, 0):
        got = [tuple(r) for r in token_alignment.align(docs, most_pairs=most).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(bool(g) for g in groups) > len(rows) - 8


def test_spans_are_refined(codec):
    """The coarse spans are no ends of bytes inside multibyte characters; refined they are, and they decide alone there."""
    text = "a𝄞é̃ꙮx"
    (a, begin, end, first), (b, b_begin, b_end, b_first) = codec.encode([text])
    assert (end != np.cumsum(codec.a_lengths[a])).any() and (b_end != np.cumsum(codec.b_lengths[b])).any()
    assert token_alignment.refined_ends(begin, end, first, codec.a_lengths[a]).tolist() == np.cumsum(codec.a_lengths[a]).tolist()
    assert token_alignment.refined_ends(b_begin, b_end, b_first, codec.b_lengths[b]).tolist() == np.cumsum(codec.b_lengths[b]).tolist()


def test_alignment_query_and_empty_table(spark, sf):
    out = entry.queries()["op13_token_alignment"](spark, sf)
    rows = out.collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert len(rows) == len(texts) and all((r.groups_sha256 == "") == (r.n_a == 0) for r in rows)
    assert all(len(r.groups_sha256) in (0, 64) and r.n_links == r.n_groups for r in rows)
    none = token_alignment.align(spark.createDataFrame([], DOCS))
    assert none.collect() == [] and none.columns[0] == "doc_id"
    assert hashlib.sha256(b"").hexdigest() not in {r.groups_sha256 for r in rows}
