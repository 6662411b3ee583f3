"""Shared building blocks: lineage cuts, size-checked joins, exact distributed quantiles."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

# A broadcast side takes at most this many bytes, by the sizes of its values.
MAX_BROADCAST_BYTES = 32 << 20
# At most this many keys are treated as hot; any other key holds less than 1/HOT_KEYS of the rows.
HOT_KEYS = 1_000
HOT_SALTS = 64


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and written tables: the cluster's own setting, a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kerbside-"))
    return sc.getCheckpointDir()


# What is being written now, by session, and the setting to go back to.
_writing: dict[str, list] = {}
_writing_lock = threading.Lock()
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run meanwhile are removed when it ends, not when the driver happens to collect garbage."""
    app = spark.sparkContext.applicationId
    with _writing_lock:
        state = _writing.setdefault(app, [0, spark.conf.get(_DROP_SHUFFLES, "false")])
        state[0] += 1
        spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _writing_lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(_DROP_SHUFFLES, _writing.pop(app)[1])


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write ``df`` as a compressed Parquet table, which takes a small part of a checkpoint's bytes, and return what reads it."""
    with shuffles_dropped(df.sparkSession):
        df.write.mode(mode).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a table in the shared folder, so lost executors cost nothing."""
    return write_table(df, f"{shared_folder(df.sparkSession)}/settled/{uuid.uuid4().hex}")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def lookup(column: Column, table: dict[str, str]) -> Column:
    """Dictionary lookup as one literal map (dictionaries are fixed and small); NULL when absent."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def missing(column: Column) -> Column:
    """True for NULL and zero."""
    return F.coalesce(column, F.lit(0)) == 0


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row, however often the body names it.

    Catalyst does not share sub-expressions between the branches of CASE, COALESCE or NULLIF, so a costly regex
    named twice there would run twice.
    """
    return F.get(F.transform(F.array(value), body), 0)


def computed(df: DataFrame, keep: Sequence[str], **values: Column) -> DataFrame:
    """``keep`` plus the named values, each worked out once per row.

    The values pass through a one-row generator, which the optimizer does not see through: without it every later
    access to a field of a parsed struct would be pushed down as a parse of its own.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))))


def contains_any(text: Column, phrases: Sequence[str]) -> Column:
    """True when the text holds any phrase; one alternation-free scan per phrase, all inside codegen."""
    if not phrases:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes: strings by length, arrays by their elements, other values eight."""
    eight = F.lit(8).cast("long")
    if isinstance(kind, StringType | BinaryType):
        return eight + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, StructType):
        return reduce(lambda a, b: a + b, [value_bytes(value[f.name], f.dataType) for f in kind.fields], eight)
    if isinstance(kind, ArrayType):
        return eight + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType)), F.lit(0))
    if isinstance(kind, MapType):
        return eight + value_bytes(F.map_keys(value), ArrayType(kind.keyType)) + value_bytes(F.map_values(value), ArrayType(kind.valueType))
    return eight


def table_bytes(df: DataFrame) -> int:
    """About how many bytes the rows of a settled table take."""
    row = reduce(lambda a, b: a + b, [value_bytes(F.col(f.name), f.dataType) for f in df.schema.fields], F.lit(16).cast("long"))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def attach_groups(
    df: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    rows: str | None = None,
    spread_by: Column | None = None,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    settled: bool = False,
) -> DataFrame:
    """Left-join one row per key back onto the rows. ``settled``: the groups are a settled table already.

    The group table is computed once and its bytes are added up. Small: broadcast, so the rows do not move. Large: shuffle
    join in which the heaviest ``HOT_KEYS`` keys (by the count column ``rows``) are spread over ``HOT_SALTS``
    tasks; the salt comes from ``spread_by`` (a row id), so a retried task salts the same way. NULL keys meet nothing.
    """
    keys = list(keys)
    if not settled:
        groups = settle(groups)
    values = groups.drop(rows) if rows else groups
    if table_bytes(values) <= max_broadcast_bytes:
        return df.join(F.broadcast(values), keys, "left")
    # told to merge: by the size of its compressed files Spark might broadcast what is too large for it
    if rows is None or spread_by is None:
        return df.join(values.hint("merge"), keys, "left")
    hot = groups.orderBy(F.desc(rows), *keys).limit(HOT_KEYS).select(*keys, F.lit(True).alias("__hot"))
    salted = df.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(HOT_SALTS)).cast("int")).otherwise(F.lit(0)),
    )
    copies = (
        values.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "__salt",
            F.explode(
                F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("__hot")
    )
    return salted.drop("__hot").join(copies.hint("merge"), [*keys, "__salt"], "left").drop("__salt")


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], count: str = "n"
) -> DataFrame:
    """Exact linear-interpolated quantiles per key, plus the row count.

    Rows are first collapsed to (key, value) counts with map-side combine, so what meets in one task is the set
    of *distinct* values of a key, never its rows; the running count over it spills to disk when needed. Where a key may
    have a great many distinct values, or there is no key, ``split_quantiles`` gives the same.
    """
    keys = list(keys)
    if not keys:
        return split_quantiles(df, keys, value, probabilities, count)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    ordered = Window.partitionBy(*keys)
    running = counted.select(
        *keys,
        F.col(value).alias("__v"),
        F.sum("__c").over(ordered.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"),
        F.sum("__c").over(ordered).alias("__n"),
    )
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("__n") - 1)
        picks.append(F.min(F.when(F.col("__upto") > F.floor(position), F.col("__v"))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("__upto") > F.ceil(position), F.col("__v"))).alias(f"__hi_{name}"))
    picked = running.groupBy(*keys).agg(F.max("__n").alias(count), *picks)
    return picked.select(*keys, count, *_interpolated(count, probabilities))


def split_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], count: str = "n", ranges: int = 128
) -> DataFrame:
    """As ``group_quantiles``, for keys with more distinct values than one task should order: distributed selection.

    A digest of bounded size cuts the values of each key into ``ranges`` ranges of about equally many; counts per range tell
    in which one a quantile lies; only those ranges are ordered, one window each. The cuts decide how much is ordered, the
    counts are exact, so the result does not depend on them.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    counted = settle(counted)
    parts = [i / ranges for i in range(1, ranges)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(F.col("__v").cast("double"), parts, 10 * ranges).alias("__cuts"))
    placed = attach_groups(counted, cuts, keys) if keys else counted.withColumn("__cuts", cuts.scalar())
    placed = placed.withColumn("__r", F.size(F.filter("__cuts", lambda x: x < F.col("__v").cast("double")))).drop("__cuts")
    in_order = Window.partitionBy(*keys).orderBy("__r")
    held = placed.groupBy(*keys, "__r").agg(F.sum("__c").alias("__in"))
    # at most ``ranges`` rows per key
    held = held.select("*", (F.sum("__in").over(in_order) - F.col("__in")).alias("__before"), F.sum("__in").over(Window.partitionBy(*keys)).alias("__n"))
    places = [rounded(F.lit(float(p)) * (F.col("__n") - 1)) for p in probabilities.values() for rounded in (F.floor, F.ceil)]
    inside = reduce(lambda a, b: a | b, [(F.col("__before") <= at) & (at < F.col("__before") + F.col("__in")) for at in places])
    wanted = held.filter(inside).drop("__in")
    chosen = placed.join(F.broadcast(wanted) if not keys else wanted, [*keys, "__r"])
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__r").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.select(*keys, "__v", "__n", upto.alias("__upto"))
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("__n") - 1)
        picks.append(F.min(F.when(F.col("__upto") > F.floor(position), F.col("__v"))).alias(f"__lo_{name}"))
        picks.append(F.min(F.when(F.col("__upto") > F.ceil(position), F.col("__v"))).alias(f"__hi_{name}"))
    picked = chosen.groupBy(*keys).agg(F.max("__n").alias(count), *picks)
    return picked.filter(F.col(count).isNotNull()).select(*keys, count, *_interpolated(count, probabilities))


def _interpolated(count: str, probabilities: dict[str, float]) -> list[Column]:
    """Quantiles between the picked values below and above their positions."""
    out = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col(count) - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + (position - F.floor(position)) * (high - low)).cast("double").alias(name))
    return out


def scalar(df: DataFrame) -> Column:
    """One-row, one-column frame as a scalar subquery."""
    return df.scalar()


def newest_first(*columns: str) -> list[Column]:
    """Descending, NULLs last, on each column."""
    return [F.col(c).desc_nulls_last() for c in columns]


def fold_of(row_id: Column, folds: int) -> Column:
    """Fold number by plain arithmetic on the id: order-free and the same in any engine."""
    return F.pmod(F.pmod(row_id, F.lit(1_000_003)) * F.lit(7_919), F.lit(folds)).cast("int")
