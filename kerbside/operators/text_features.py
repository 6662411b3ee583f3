"""TF-IDF and SVD features of descriptions with pyspark.ml."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, NGram, Normalizer, SQLTransformer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside import fixed_values as fixed
from kerbside.common import let
from kerbside.functions.text import keyword_flags, tokens


def keyword_support(rows: DataFrame, text: str, patterns: dict[str, str] = fixed.KEYWORD_PATTERNS) -> DataFrame:
    """Share of rows per keyword, and whether it is frequent enough to keep (more than one per cent)."""
    flags = keyword_flags(F.col(text), patterns)
    shares = rows.agg(*[F.round(F.avg(flag), 6).alias(name) for name, flag in flags.items()])
    entries = F.array(*[F.struct(F.lit(n).alias("keyword"), F.col(n).alias("share")) for n in patterns])
    return shares.select(F.inline(entries)).withColumn("kept", F.col("share") > 0.01)


def term_statistics(rows: DataFrame, text: str, min_df: int = 5, max_df: float = 0.8) -> DataFrame:
    """(term, df, idf): all one- and two-word terms found in at least ``min_df`` rows and at most a share ``max_df`` of them.

    The vocabulary stays a table, however large: each row sends a term once, counts are combined before the shuffle.
    """
    words = rows.select(tokens(F.col(text)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat(F.get("w", i - 1), F.lit(" "), F.get("w", i)))
    terms = words.select(F.explode(F.array_distinct(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))))).alias("term"))
    total = words.agg(F.count("*")).scalar()
    counted = terms.groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * total))
    return counted.withColumn("idf", F.ln((total + 1.0) / (F.col("df") + 1.0)))


# Columns a pass over the rows multiplies at once.
BLOCK = 64
# Rows and terms that are dense at once in a task, and ranges of terms in which the partitions' products are added up.
DENSE_ROWS, TERM_RANGES = 256, 16


def vocabulary(rows: DataFrame, terms: str, max_terms: int, min_df: int, max_df: float) -> list[str]:
    """The ``max_terms`` most frequent terms of at least ``min_df`` rows and at most a share ``max_df`` of them; ties by term.

    A row's terms are sorted, so that its first of each is known and one count per term gives both frequencies.
    """
    total = rows.count()
    marked = lambda line: F.transform(line, lambda t, i: F.struct(t.alias("term"), F.coalesce(F.get(line, i - 1) != t, F.lit(True)).cast("int").alias("first")))
    found = rows.select(F.inline(let(F.sort_array(terms), marked)))
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("df"))
    kept = counted.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * total))
    return [r.term for r in kept.orderBy(F.desc("n"), "term").limit(max_terms).select("term").collect()]


def fit_tfidf(words: DataFrame, max_terms: int = 5000, min_df: int = 5, max_df: float = 0.8) -> tuple[PipelineModel, DataFrame]:
    """One- and two-word terms -> smoothed idf -> unit length; and the persisted term counts of the rows."""
    grams = [NGram(n=2, inputCol="words", outputCol="pairs"), SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__")]
    terms = grams[1].transform(grams[0].transform(words))
    known = vocabulary(terms, "terms", max_terms, min_df, max_df)
    if not known:
        raise ValueError("no term is frequent enough")
    counter = CountVectorizerModel.from_vocabulary(known, inputCol="terms", outputCol="counts")
    counts = counter.transform(terms).select("counts").persist()
    idf = IDF(inputCol="counts", outputCol="weighted").fit(counts)
    return PipelineModel([*grams, counter, idf, Normalizer(inputCol="weighted", outputCol="tfidf")]), counts


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and value of the entries of sparse vectors."""
    lists, values = vectors.field("indices"), vectors.field("values")
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(vectors)), sizes), lists.flatten().to_numpy(), values.flatten().to_numpy()


def _dense(vectors: pa.StructArray, terms: int) -> Iterator[np.ndarray]:
    """The vectors as dense matrices of a bounded number of rows."""
    for start in range(0, len(vectors), DENSE_ROWS):
        part = pa.concat_arrays([vectors.slice(start, DENSE_ROWS)])
        row, term, value = _entries(part)
        matrix = np.zeros((len(part), terms))
        matrix[row, term] = value
        yield matrix


def gram_product(vectors: DataFrame, column: str, v: np.ndarray) -> np.ndarray:
    """A'A v of the matrix A with one sparse row vector per row, in one pass.

    A partition gives one terms × columns sum; these are added up by ranges of terms, so the driver sees one such matrix.
    """
    terms, wide = v.shape

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((terms, wide))
        for batch in batches:
            for matrix in _dense(batch.column(0), terms):
                out += matrix.T @ (matrix @ v)
        parts = np.array_split(out, TERM_RANGES)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(TERM_RANGES), pa.int32()), "sums": pa.array([p.tobytes() for p in parts], pa.binary())})

    def added(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(b.as_buffer()) for b in table.column("sums"))
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([sums.tobytes()], pa.binary())})

    schema = "part int, sums binary"
    found = vectors.select(column).mapInArrow(multiplied, schema).groupBy("part").applyInArrow(added, schema).collect()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(found, key=lambda r: r.part)]).reshape(terms, wide)


def right_singular(vectors: DataFrame, column: str, terms: int, components: int, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors (terms × components) and singular values of the row vectors, by block Lanczos.

    A pass multiplies a block of columns; all blocks stay orthogonal to each other and the decomposition within their span is
    taken when its residuals are below ``tolerance`` of the last value. Values below 1e-9 of the first are left out. The
    largest loading of a component is positive.
    """
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((terms, min(BLOCK, terms))))[0]
    basis, image = np.zeros((terms, 0)), np.zeros((terms, 0))
    while True:
        basis, image = np.hstack([basis, q]), np.hstack([image, gram_product(vectors, column, q)])
        inside = basis.T @ image
        energy, turn = np.linalg.eigh((inside + inside.T) / 2)
        energy, turn = energy[::-1][:components], turn[:, ::-1][:, :components]
        v = basis @ turn
        residual = np.linalg.norm(image @ turn - v * energy, axis=0)
        room = min(BLOCK, terms - basis.shape[1])
        if room == 0 or (len(energy) == components and residual.max() <= tolerance * max(energy[-1], 1e-9 * energy[0])):
            break
        q = image[:, -q.shape[1] :]
        for _ in range(2):
            q = q - basis @ (basis.T @ q)
        left, size, _ = np.linalg.svd(q, full_matrices=False)
        q = left[:, : min(room, int((size > 1e-10 * energy[0]).sum()))]
        if q.shape[1] == 0:
            break
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    values = np.sqrt(np.maximum(energy, 0.0))
    kept = values >= 1e-9 * values[0]
    v = v[:, kept]
    return v * np.where(v[np.abs(v).argmax(axis=0), range(v.shape[1])] < 0, -1.0, 1.0), values[kept]


class DescriptionFeatures:
    """Fitted TF-IDF plus the right singular vectors of the training matrix (terms x components, small)."""

    def __init__(self, model: PipelineModel, components: np.ndarray, singular_values: np.ndarray):
        self.model, self.components, self.singular_values = model, components, singular_values

    def terms(self, spark: SparkSession) -> DataFrame:
        """(term, idf, loadings): one row per term of the vocabulary, which ``max_terms`` bounds."""
        rows = zip(self.model.stages[2].vocabulary, self.model.stages[3].idf.toArray().tolist(), self.components.tolist(), strict=True)
        return spark.createDataFrame(list(rows), "term string, idf double, loadings array<double>")

    def transform(self, rows: DataFrame, text: str, key: str) -> DataFrame:
        """Add ``svd``, the projection on each component, padded with zeros when the vocabulary is smaller, and ``has_terms``.

        ``key`` identifies the rows. A row's vector is projected where it is; only rows whose keys repeat or are missing go the
        longer way, on which the terms of one key are counted together and rows without a key have none.
        """
        words = rows.select(key, tokens(F.col(text)).alias("words"))
        repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
        projected = self._projected(words, key) if repeated.isEmpty() else self._projected_by_key(words, key)
        wide = range(self.components.shape[1])
        none = {"svd": F.coalesce("svd", F.array(*[F.lit(0.0) for _ in wide])), "has_terms": F.coalesce("has_terms", F.lit(False))}
        return rows.join(projected, key, "left").withColumns(none)

    def _projected(self, words: DataFrame, key: str) -> DataFrame:
        """One projected row per row."""
        loadings = self.components

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, vectors = batch.column(0), batch.column(1)
                row, term, value = _entries(vectors)
                norm = np.sqrt(np.bincount(row, value * value, len(keys)))
                sums = np.array([np.bincount(row, value * loadings[term, c], len(keys)) for c in range(loadings.shape[1])]).T
                svd = sums / np.where(norm > 0, norm, 1.0)[:, None]
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * loadings.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(svd.ravel()))
                yield pa.RecordBatch.from_arrays([keys, lists, pa.array(norm > 0)], names=[key, "svd", "has_terms"])

        weighted = PipelineModel(self.model.stages[:4]).transform(words).select(key, "weighted")
        kind = words.schema[key].dataType.simpleString()
        return weighted.mapInArrow(project, f"`{key}` {kind}, svd array<double>, has_terms boolean")

    def _projected_by_key(self, words: DataFrame, key: str) -> DataFrame:
        """One projected row per key: its known terms meet their loadings by a join with the bounded vocabulary."""
        pairs = self.model.stages[1].transform(self.model.stages[0].transform(words))
        terms = self.terms(words.sparkSession)
        known = pairs.select(key, F.explode("terms").alias("term")).join(F.broadcast(terms.select("term")), "term")
        counted = known.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))
        weighted = counted.join(F.broadcast(terms), "term").withColumn("w", F.col("n") * F.col("idf"))
        wide = range(self.components.shape[1])
        sums = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), *[F.sum(F.col("w") * F.get("loadings", c)).alias(f"c{c}") for c in wide])
        return sums.select(key, F.array(*[F.coalesce(F.try_divide(f"c{c}", "norm"), F.lit(0.0)) for c in wide]).alias("svd"), (F.col("norm") > 0).alias("has_terms"))


def fit_description_features(
    rows: DataFrame, text: str, components: int = 20, max_terms: int = 5000, min_df: int = 5, max_df: float = 0.8
) -> DescriptionFeatures:
    """Fit TF-IDF and the truncated SVD of its matrix; vectors stay sparse until a task multiplies them."""
    model, counts = fit_tfidf(rows.select(tokens(F.col(text)).alias("words")), max_terms, min_df, max_df)
    terms = len(model.stages[2].vocabulary)
    vectors = PipelineModel(model.stages[3:]).transform(counts)
    loadings, values = right_singular(vectors, "tfidf", terms, min(components, terms))
    counts.unpersist()
    v, sizes = np.zeros((terms, components)), np.zeros(components)
    best = len(values)
    v[:, :best], sizes[:best] = loadings, values
    return DescriptionFeatures(model, v, sizes)


def explained_variance(fitted: DescriptionFeatures, projected: DataFrame) -> DataFrame:
    """(component, share): squared singular values as shares of all that the TF-IDF matrix holds.

    Its rows have unit length or, without a known term, are zero; so the total is the number of rows with a term.
    ``projected`` is what ``transform`` gives for the rows of the fit.
    """
    rows = [(c, float(s) ** 2) for c, s in enumerate(fitted.singular_values)]
    energy = projected.sparkSession.createDataFrame(rows, "component int, energy double")
    total = projected.agg(F.count_if("has_terms")).scalar()
    return energy.select("component", F.try_divide("energy", total).alias("share"))


def cumulative_explained_variance(components: DataFrame) -> DataFrame:
    """Running sum of the components' variance shares (one small row per component)."""
    order = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return components.withColumn("cumulative", F.round(F.sum("share").over(order), 6))
