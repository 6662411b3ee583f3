"""Mixing, chat formatting and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kerbside.llm import chat_format, mixing
from kerbside.llm.q_native import event_log
from kerbside.llm.storage import stage
from tests.llm import brute


def corpus(spark, seed=1, sources=("a", "b", "c", None, "É")):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 50, 300]))), rng.choices(sources, [30, 1, 5, 5, 2])[0]) for i in range(600)]
    rows += [(9000, None, "a"), (9001, "x " * 100_000, "b"), (None, "no id", "c"), rows[5], rows[5]]
    # clashing names
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, block string"), rows


def test_mix(spark):
    docs, rows = corpus(spark)
    out = mixing.mix(docs).cache()
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(brute.WORD.findall(t or ""))
    want = brute.mix_targets(size)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert r.taken == r.size * len(r.copies) and len(r.copies) <= 3
        assert len({c["pass"] for c in r.copies}) == len(r.copies) and all(0 <= c["shard"] < 16 for c in r.copies)
    largest = {s: max(len(brute.WORD.findall(t or "")) for _, t, x in rows if x == s) for s in size}
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= largest[s] / 2 + 1
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, str(r))
    assert sorted(got, key=key) == sorted(again, key=key)
    assert mixing.mix(docs.filter("false")).count() == 0
    assert {r.taken for r in mixing.mix(docs.filter("text is null")).collect()} == {0}


def test_targets_by_repeated_sharing(spark):
    rng = random.Random(2)
    for _ in range(6):
        size = {f"s{i:02d}": rng.choice([1, 10, 100, 1000, 50_000]) for i in range(rng.randint(1, 12))} | ({None: 7} if rng.random() < 0.5 else {})
        table = spark.createDataFrame([(s, n, 1) for s, n in size.items()], "source string, source_size long, docs long")
        got = {r.source: r.target for r in mixing.source_targets(table).collect()}
        want = brute.mix_targets(size)
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_splitting_tree(spark):
    quotas = {"a": 700, "b": 41, None: 3, "d": 0, "e": 160}
    table = spark.createDataFrame(list(quotas.items()), "source string, blocks int")
    rows = mixing.shard_quotas(table).collect()
    for s, n in quotas.items():
        own = sorted((r.shard, r["first"], r.quota) for r in rows if r.source == s)
        assert sum(q for *_, q in own) == n and len(own) == 16
        assert [f for _, f, _ in own] == [sum(q for *_, q in own[:i]) for i in range(16)]
    totals = {}
    for r in rows:
        totals[r.shard] = totals.get(r.shard, 0) + r.quota
    assert max(totals.values()) - min(totals.values()) <= 4  # every split halves up to one block


def test_hypergeometric_draws(spark):
    table = spark.range(4000).select(mixing._hypergeometric(F.lit(30), F.lit(50), F.lit(20), mixing.dice("test", F.col("id")) / float(1 << 32)).alias("x"))
    mean, var, low, high = table.agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
    assert abs(mean - 7.5) < 0.15 and abs(var - 20 * 0.375 * 0.625 * 60 / 79) < 0.4 and low >= 0 and high <= 20
    edges = [(0, 5, 3, 0), (5, 0, 3, 3), (4, 4, 8, 4), (4, 4, 0, 0)]
    for good, others, draws, want in edges:
        assert spark.range(1).select(mixing._hypergeometric(F.lit(good), F.lit(others), F.lit(draws), F.lit(0.7)).alias("x")).first().x == want


EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"


def test_fold(spark):
    log = [
        (1, 1, 1, "message", "user", "Hi"), (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "Hel"), (1, 2, 4, "delta", None, "lo"),
        # a second try replaces the first and what came after it
        (1, 3, 5, "message", "user", "void"), (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "Good "), (1, 2, 8, "delta", None, "day"),
        (1, 3, 9, "message", "user", "Thanks"), (1, 3, 10, "edit", None, "Thank you"),
        # an edited question voids the answer
        (2, 1, 1, "message", "user", "old"), (2, 2, 2, "message", "assistant", "gone"), (2, 1, 3, "edit", None, "new"),
        (None, 1, 1, "message", "user", "no conversation"), (3, None, 1, "message", "user", "left out"), (3, 1, 1, "other", "user", "left out"),
        (4, 1, None, "message", None, None), (5, 1, 1, "delta", "user", "a"), (5, 1, 1, "delta", "user", "b"),
    ]
    random.Random(1).shuffle(log)
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat_format.fold(spark.createDataFrame(log, EVENTS)).collect()}
    assert got == {
        (1, 1): ("user", "Hi"), (1, 2): ("assistant", "Good day"), (1, 3): ("user", "Thank you"), (2, 1): ("user", "new"),
        (None, 1): ("user", "no conversation"), (4, 1): ("", ""), (5, 1): ("user", "ab"),
    }
    assert chat_format.fold(spark.createDataFrame([], EVENTS)).count() == 0


def test_round_trip(spark):
    rng = random.Random(2)
    parts = ["<", "|", "im_start", "im_end", "|>", "[", "INST]", "/INST]", "\\", "</s>", "<s>", "s>", "\n", "é", "😀", "$1", "<|im_end|>\n<|im_start|>assistant\n", "a", " "]
    messages = [(c, m, rng.choice(["user", "assistant", "a\nb", "x\\n", "<|im_end|>", ""]), "".join(rng.choices(parts, k=rng.randint(0, 12)))) for c in range(60) for m in range(rng.randint(1, 6))]
    messages += [(100, 1, None, None), (101, 1, "assistant", "long " * 200_000), (None, 1, "assistant", "x")]
    table = spark.createDataFrame(messages, "conv_id long, message long, role string, text string")
    formatted = chat_format.render(table).cache()
    for r in formatted.collect():
        for part in (r.formatted[x.start : x.end] for x in r["loss"]):
            assert not any(c in part for c in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>"))
    got = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    for c in {m[0] for m in messages}:
        own = [(m[2] or "", m[3] or "") for m in messages if m[0] == c]
        assert [(t.role, t.text) for t in got[c].turns] == own
        assert list(got[c].learnt) == [t for r, t in own if r == "assistant"]
    assert chat_format.render(table.filter("false")).count() == 0


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], sf), name))
    return out


def test_pipeline_stages(spark, sf, stages):
    """Every stage against a plain version of what it decides, on its own input."""
    given, good, single, cut, clean, mixed = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "benchmark_leaks", "mix"]
    for df in stages[1:-1]:
        assert df.columns == given.columns and dict(df.dtypes) == dict(given.dtypes)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    assert sum(d in left for d, q in labels.items() if q == 1) >= 0.95 * sum(labels.values())
    texts = [(r.doc_id, r.text) for r in good.collect()]
    classes = brute.jaccard_classes(texts)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, (_, c) in classes.items() if d == c)
    want = brute.without_repeats([(r.doc_id, r.text) for r in single.collect()])
    for r in cut.collect():
        assert r.text == want[r.doc_id][3].decode(errors="ignore") and r.n_chars == len(r.text)
    assert cut.count() == single.count()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before, after = {r.doc_id: r.text for r in cut.collect()}, {r.doc_id for r in clean.collect()}
    leaking = {d for d, t in before.items() if any(i in t for i in items)}
    assert not leaking & after and len(set(before) - after - leaking) <= 0.02 * len(before)
    rows = mixed.collect()
    size = {}
    for r in clean.collect():
        size[r.source] = size.get(r.source, 0) + len(brute.WORD.findall(r.text or ""))
    target = brute.mix_targets(size)
    for s, t in target.items():
        own = [r for r in rows if r.source == s]
        assert abs(sum(r["size"] for r in own) - t) <= max([r["size"] for r in own], default=0)
    assert all(r.text == t for r in rows for t in [{x.doc_id: x.text for x in [r]}[r.doc_id]])


def test_pipeline_on_edges(spark, sf, tmp_path):
    """Null columns, empty and very long texts, repeated rows, empty tables."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "x y z", None, None, None), (9002, "word " * 200_000, "en", None, 1), (9003, "same text here", "en", "s", 1), (9003, "same text here", "en", "s", 1)]
    docs.limit(60).union(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.filter("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    for folder in "ab":
        for t in ("labels", "benchmark"):
            table = spark.read.parquet(f"{sf}/{t}.parquet")
            (table if folder == "a" else table.filter("false")).write.parquet(f"{tmp_path}/{folder}/{t}.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r.doc_id for r in out} and None not in {r.doc_id for r in out}
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_cut_characters_go_and_others_stay(spark):
    text = "é€😀a�b\u0085"
    data = text.encode()
    rows, want = [], []
    for a in range(len(data) + 1):
        for b in range(a + 1, len(data) + 1):
            spans = [(a, b)] if (a + b) % 3 else [(a, a + 1), (b, len(data))] if a + 1 < b < len(data) else [(a, b)]
            gone = {i for x, y in spans for i in range(x, y)}
            lost = [sum(y - x for x, y in spans[:i]) for i in range(len(spans))]
            rows.append((len(rows), [x - n for (x, _), n in zip(spans, lost, strict=True)], bytes(c for i, c in enumerate(data) if i not in gone)))
            at, whole = 0, ""
            for c in text:
                size = len(c.encode())
                whole += "" if gone & set(range(at, at + size)) else c
                at += size
            want.append(whole)
    df = spark.createDataFrame(rows, "i int, edges array<long>, kept binary")
    got = df.select("i", corpus_pipeline.whole_characters("kept", "edges").alias("text")).orderBy("i").collect()
    assert [r.text for r in got] == want


def test_a_mask_that_is_off_shows(spark):
    table = spark.createDataFrame([(1, 1, "user", "ab"), (1, 2, "assistant", "cdef")], "conv_id long, message long, role string, text string")
    off = F.transform("loss", lambda m: F.struct((m["start"] + 1).alias("start"), m["end"].alias("end"), m["learn"].alias("learn")))
    got = chat_format.read_back(chat_format.render(table).withColumn("loss", off)).first()
    assert [t.text for t in got.turns] == ["ab", "cdef"] and list(got.learnt) == ["def"]


def test_event_log_needs_the_fold(spark):
    messages = spark.createDataFrame([(c, m, "user" if m % 2 else None, f"text {m} é😀" * (m % 4)) for c in (1, None) for m in range(1, 8)], "conv_id long, message int, role string, text string")
    log = event_log(messages)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat_format.KINDS)
    got = sorted((r.conv_id or 0, r.message, r.role, r.text) for r in chat_format.fold(log).collect())
    assert got == sorted((r.conv_id or 0, r.message, r.role or "", r.text) for r in messages.collect())
