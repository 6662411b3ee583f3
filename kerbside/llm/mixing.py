"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Targets. All sizes together are shared out by the sources' weights; no target passes ``most`` times its source's size,
   what is left over is shared again by weight.
2. Blocks. A source's documents fall into permuted blocks by a hash of the id. A target is so many whole passes over
   the source plus the first blocks of the permutation; in the block where the target is reached, documents in
   permuted order up to it.
3. Splitting tree. A source contributes so many blocks in all. The root holds these quotas; every node gives its left
   half of the output shards a share of each source's blocks drawn from the multivariate hypergeometric distribution
   (source by source from the conditional hypergeometric), the rest goes right. The leaves' quotas add up exactly.
4. A leaf takes the next blocks of each source, no two leaves the same draw of a block, and a hash orders its rows.

All random choices are hashes of a seed and of what they are about, so a retried task and a rerun give the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.common import let
from kerbside.llm.storage import stage

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Blocks of a source: one for every BLOCK_DOCS documents, at most MOST_BLOCKS; more documents make larger blocks.
BLOCK_DOCS = 8
MOST_BLOCKS = 512
#: Width of the ranges of the 32-bit permutation that are added up where a block is cut.
RANGE = 1 << 20
#: The tree has 2**DEPTH leaves, the output shards.
DEPTH = 4
SEED = "mix"
#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"


def dice(seed: str, *parts: Column) -> Column:
    """A number below 2**32 from the md5 of seed and parts (the same in any engine)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, docs, weight, target) of a table with one row per source.

    A target is min(most * size, level * weight), with the one level at which the targets add up to all sizes: what
    repeated sharing of the excess comes to. Sources that reach their limit first have the smallest limit per weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "share": F.sum("source_size").over(everything).cast("double"),
        "limits_before": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
        "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(everything),
    })
    # the level if exactly the sources before this one are at their limit; of the feasible ones the highest holds
    level = (F.col("share") - F.col("limits_before")) / (F.col("weights") - F.col("weights_before"))
    rows = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    rows = rows.withColumn("level", F.max("level").over(everything))
    target = F.least("limit", F.coalesce(F.col("level") * F.col("weight"), "limit"))
    return rows.select("source", "source_size", "docs", "weight", target.alias("target"))


def _hypergeometric(good: Column, others: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among ``draws`` without replacement from good + others, by inversion at ``u``.

    Logarithms of the probabilities, relative to that of the smallest number, come from the ratio of neighbours; a first
    walk adds them up, a second one stops where the sum passes ``u``. Linear in the number of blocks.
    """
    low, high = F.greatest(F.lit(0), draws - others), F.least(good, draws)
    steps = F.when(high > low, F.sequence(low.cast("int"), (high - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def following(last: Column, x: Column) -> Column:
        return last + F.log(((good - x) * (draws - x)).cast("double") / ((x + 1) * (others - draws + x + 1)).cast("double"))

    def added(a: Column, x: Column) -> Column:
        entry = lambda v, top: F.struct(v.alias("last"), top.alias("top"), (a["sum"] * F.exp(a["top"] - top) + F.exp(v - top)).alias("sum"))
        return let(following(a["last"], x), lambda v: let(F.greatest(a["top"], v), lambda top: entry(v, top)))

    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("top"), F.lit(1.0).alias("sum"))

    def passed(goal: Column, top: Column) -> Column:
        count = lambda v: F.when(v <= goal, 1).otherwise(0)
        walk = lambda a, x: let(following(a["last"], x), lambda v: let(a["sum"] + F.exp(v - top), lambda c: F.struct(
            v.alias("last"), c.alias("sum"), (a["passed"] + count(c)).alias("passed"))))
        begin = F.struct(F.lit(0.0).alias("last"), F.exp(-top).alias("sum"), count(F.exp(-top)).alias("passed"))
        return F.aggregate(steps, begin, walk)["passed"]

    found = let(F.aggregate(steps, start, added), lambda z: let(u * z["sum"], lambda goal: passed(goal, z["top"])))
    return F.least(low + found, high).cast("int")


def shard_quotas(quotas: DataFrame, depth: int = DEPTH, seed: str = SEED) -> DataFrame:
    """(shard, source, first, quota): how many of its ``blocks`` each source gives to each of 2**depth shards, and how
    many of them went to shards before. Level by level; a node is one row per source."""
    nodes = quotas.select(F.lit(0).alias("node"), "source", F.col("blocks").cast("int").alias("n"))
    for level in range(depth):
        rows = nodes.groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "n"))).alias("s"),
            F.sum("n").cast("int").alias("all"),
        )
        # an odd block goes to a side by hash
        odd = (dice(seed, F.lit("odd"), F.lit(level), F.col("node")) % 2).cast("int")
        rows = rows.withColumn("draws", F.floor((F.col("all") + odd) / 2).cast("int"))
        # conditional draws, source after source
        state = F.struct(F.col("draws").alias("draws"), F.col("all").alias("left"), F.array().cast("array<int>").alias("taken"))

        at_level = F.lit(level)

        def draw(a, x):
            u = dice(seed, F.lit("split"), at_level, F.col("node"), x["source"]) / float(1 << 32)
            good = _hypergeometric(x["n"], a["left"] - x["n"], a["draws"], u)
            step = lambda g: F.struct(
                (a["draws"] - g).cast("int").alias("draws"), (a["left"] - x["n"]).cast("int").alias("left"), F.concat(a["taken"], F.array(g)).alias("taken")
            )
            return F.get(F.transform(F.array(good), step), 0)

        rows = rows.withColumn("taken", F.aggregate("s", state, draw)["taken"])
        rows = rows.select("node", F.explode(F.arrays_zip("s", "taken")).alias("x"))
        rows = rows.select("node", F.col("x.s.source").alias("source"), F.col("x.s.n").alias("n"), F.col("x.taken").alias("got"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("got").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("got")).alias("n")))
        nodes = rows.select("source", F.inline(sides))
    before = Window.partitionBy("source").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.select(F.col("node").alias("shard"), "source", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.col("n").alias("quota"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return rows.withColumn("permuted", dice(SEED, F.lit("doc"), F.col("doc_id")))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, copies).

    ``copies`` lists (pass, shard, place) of every time the mix takes the document; ``taken`` is its size times their
    number, at most ``most`` times its size. In the block in which a target is reached, documents in permuted order are
    taken as long as half of the next still fits, so a source is off its target by half a document at most. Documents
    without words are taken with their block. A null source is a source of its own, last in order; a null text has size
    0; a null id is kept; repeated rows are each taken alike. Other columns are ignored. If all texts are empty, targets
    are 0. The table with one row per source is expected to be small: its targets are worked out in one task.
    """
    rows = stage(sized(docs, id_col, text_col, source_col), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    blocks = F.least(F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(MOST_BLOCKS)).cast("int")
    targets = source_targets(sources, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumns({"blocks_of": blocks, "passes": passes})
    targets = stage(targets.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")

    same = lambda a, b: a.eqNullSafe(b)
    per_source = targets.select(F.col("source").alias("of"), "source_size", "target", "blocks_of", "passes", "rest")
    rows = rows.join(per_source, same(F.col("source"), F.col("of")), "left").drop("of")
    rows = rows.withColumn("block", F.pmod(F.col("permuted"), F.col("blocks_of")).cast("int"))
    # blocks in permuted order and the words before each
    held = rows.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("passes").alias("passes"), F.first("blocks_of").alias("blocks_of"))
    permuted = Window.partitionBy("source").orderBy(dice(SEED, F.lit("block"), F.col("source"), F.col("block")), "block")
    held = held.withColumn("nth", F.row_number().over(permuted) - 1)
    held = held.withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    held = held.withColumn("used", (F.col("before") < F.col("rest")).cast("int"))
    held = held.withColumn("whole", F.col("before") + F.col("words") <= F.col("rest"))
    held = held.withColumn("filled", F.count(F.lit(1)).over(Window.partitionBy("source")).cast("int"))
    held = stage(held, "mix-blocks")

    quotas = held.groupBy("source").agg((F.first("passes") * F.first("filled") + F.sum("used")).cast("int").alias("blocks"))
    shards = shard_quotas(quotas, depth)
    # draw number pass * blocks + nth of a source lies in the shard whose range of the source's quota holds it
    ranges = shards.filter("quota > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("first", "quota", "shard"))).alias("ranges"))
    held = held.join(ranges.withColumnRenamed("source", "of"), same(F.col("source"), F.col("of")), "left").drop("of")
    draws = F.sequence(F.lit(0), F.col("passes") + F.col("used") - 1)
    draws = F.when(F.col("passes") + F.col("used") > 0, draws).otherwise(F.array().cast("array<int>"))
    number = lambda p: p * F.col("filled") + F.col("nth")
    inside = lambda p: F.filter("ranges", lambda r: (number(p) >= r["first"]) & (number(p) < r["first"] + r["quota"]))
    drawn = F.transform(draws, lambda p: F.struct(p.alias("pass"), F.get(inside(p), 0)["shard"].alias("shard")))
    held = held.select(F.col("source").alias("of"), F.col("block").alias("of_block"), "before", "used", "whole", F.col("passes").alias("whole_passes"), drawn.alias("draws"))
    # the branches below read the draws several times; the tree is worked out once
    held = stage(held, "mix-draws")
    rows = rows.join(held, same(F.col("source"), F.col("of")) & (F.col("block") == F.col("of_block")), "left").drop("of", "of_block")

    # the one block of a source that is used in part: its documents in permuted order, by ranges of the permutation
    partial = (F.col("used") == 1) & ~F.col("whole")
    cut = rows.filter(partial).withColumn("range", F.floor(F.col("permuted") / RANGE).cast("int"))
    ranges = cut.groupBy("source", "block", "range").agg(F.sum("size").alias("words"))
    by_range = Window.partitionBy("source", "block").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("source").alias("of"), F.col("block").alias("of_block"), F.col("range").alias("of_range"), F.coalesce(F.sum("words").over(by_range), F.lit(0)).alias("ranges_before")
    )
    cut = cut.join(ranges, same(F.col("source"), F.col("of")) & (F.col("block") == F.col("of_block")) & (F.col("range") == F.col("of_range")))
    in_range = Window.partitionBy("source", "block", "range").orderBy("permuted", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.col("ranges_before") + F.coalesce(F.sum("size").over(in_range), F.lit(0)) + F.col("size") / 2
    cut = cut.withColumn("last", upto <= F.col("rest")).drop("range", "ranges_before", "of", "of_block", "of_range")
    rows = rows.filter(~partial).withColumn("last", F.col("used") == 1).unionByName(cut)
    times = F.col("whole_passes") + F.col("last").cast("int")
    copies = F.transform(
        F.slice("draws", F.lit(1), times),
        lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), dice(SEED, F.lit("place"), F.col("doc_id"), x["pass"]).alias("place")),
    )
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"), copies.alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the output shard, the place that orders the
    shard, the pass, and size, target and taken words (columns of ``docs`` with these names are replaced). Rows without an
    id and documents that are not taken go; ids must be unique."""
    taken = mix(docs, id_col, **options).filter(F.size("copies") > 0)
    taken = taken.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken", F.inline("copies"))
    return docs.drop(*[c for c in taken.columns if c != id_col]).join(taken, id_col)
