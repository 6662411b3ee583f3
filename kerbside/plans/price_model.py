"""Price model with pyspark.ml: boosted trees and a forest on ln(price), stopped by validation rows, with bounds from
the residuals of rows that a fit has not seen."""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from kerbside import fixed_values as fixed
from kerbside.common import attach_groups, fold_of, settle, split_quantiles, union_all
from kerbside.operators.encode import LEVELS, apply_target_encoding, target_encoding, target_encoding_oof_table
from kerbside.operators.features import (
    CATEGORICAL,
    ZERO_IS_MISSING,
    derived_features,
    fill_defaults,
    segment_sample_counts,
    time_decay_weight,
    training_bounds,
)
from kerbside.operators.pricing import confidence_of, price_vs_market, stacked_p50, whole_price, with_sample_confidence

CODED = ["source", "engine_type", "transmission", "drive_type", "body_type"]
NUMERIC = [
    "year", "mileage", "engine_volume", "power_hp", "owners_count", "photo_count", "is_dealer", "car_age", "log_car_age",
    "log_mileage", "mileage_per_year", "mileage_ratio", "listing_month", "power_per_liter", "is_premium",
]
ENCODED = ["te_brand_model", "te_brand_model_year", "te_brand", "te_city"]
#: What a fit reads of its rows, besides the dates that are there.
READ = [*CATEGORICAL, *ZERO_IS_MISSING, "year", "photo_count", "is_dealer", "listing_id", "price"]
DATES = ["listing_date", "created_at"]
MIN_TRAINING_ROWS = 200


@dataclass(frozen=True)
class TrainingOptions:
    #: Most trees of a boosting; it stops before when a further tree does not help the validation rows.
    trees: int = 60
    depth: int = 5
    step: float = 0.2
    forest_trees: int = 20
    seed: int = 42
    decay: float = 0.007
    #: One row in so many only tells when to stop, and how much better a further tree has to be.
    validation_every: int = 10
    tolerance: float = 0.01
    #: Fits of the cross-validation, and how many of them run side by side.
    folds: int = 5
    side_by_side: int = 5


def prepare(rows: DataFrame) -> DataFrame:
    """Defaults and derived features; numeric inputs as doubles."""
    out = derived_features(fill_defaults(rows))
    return out.withColumns({c: F.col(c).cast("double") for c in NUMERIC})


@dataclass
class PriceModel:
    encodings: dict[str, DataFrame]
    counts: DataFrame
    #: codes and filled numbers, which all learners share; a learner is its choice of inputs and its trees
    inputs: PipelineModel
    first: PipelineModel
    second: PipelineModel | None
    third: PipelineModel | None
    bounds: DataFrame | None = None
    overall_bounds: dict[str, float] = field(default_factory=dict)
    #: (listing_id, brand, model, fold, price, p50) of every training row, from a fit that has not seen its fold
    out_of_fold: DataFrame | None = None

    def _learners(self, rows: DataFrame) -> DataFrame:
        out = self.inputs.transform(apply_target_encoding(prepare(rows), self.encodings))
        for name, model in (("p_first", self.first), ("p_second", self.second), ("p_third", self.third)):
            if model is None:
                out = out.withColumn(name, F.lit(None).cast("double"))
                continue
            scored = model.transform(out).withColumn(name, F.exp("prediction"))
            out = scored.select(*out.columns, name)
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """P10 / P50 / P90, discount against P50 and confidence for any rows with the input columns."""
        kept = list(rows.columns)
        if "listing_id" not in kept:
            rows = rows.withColumn("listing_id", F.xxhash64(*kept))
        learned = self._learners(rows).withColumn(
            "p50_raw", stacked_p50(F.col("p_first"), F.col("p_second"), F.col("p_third"))
        )
        if self.bounds is not None:
            learned = attach_groups(learned, self.bounds, ["brand", "model"], rows="n", spread_by=F.col("listing_id"))
            low = F.coalesce("q10", F.lit(self.overall_bounds["q10"]))
            high = F.coalesce("q90", F.lit(self.overall_bounds["q90"]))
        else:
            low = high = F.lit(0.0)
        counted = with_sample_confidence(learned, self.counts)
        return counted.select(
            *kept,
            whole_price(F.col("p50_raw") * F.exp(low)).alias("p10"),
            whole_price(F.col("p50_raw")).alias("p50"),
            whole_price(F.col("p50_raw") * F.exp(high)).alias("p90"),
            "p_first", "p_second", "p_third", "samples", "confidence_level",
        ).withColumn("price_vs_market_pct", price_vs_market(F.col("price"), F.col("p50")))

    def fit_report(self, spark) -> DataFrame:
        """(learner, trees) of each learner that was fitted: how far boosting went before it was stopped."""
        fitted = [("boosted", self.first), ("forest", self.second), ("boosted_plain", self.third)]
        rows = [(name, int(model.stages[-1].getNumTrees)) for name, model in fitted if model is not None]
        return spark.createDataFrame(rows, "learner string, trees int")

    def feature_importance(self, spark) -> DataFrame:
        """Importance of each input of the first learner, ranked."""
        names = self.first.stages[-2].getInputCols()
        weights = self.first.stages[-1].featureImportances.toArray()
        rows = sorted(((n, float(w)) for n, w in zip(names, weights)), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(
            [(i + 1, n, w) for i, (n, w) in enumerate(rows)], "rank int, feature string, importance double"
        )


class UntrainedPriceModel:
    """Stands for a model that had too few rows to be fitted: every prediction is NULL, nothing has importance."""

    def predict(self, rows: DataFrame) -> DataFrame:
        empty = {"p10": "int", "p50": "int", "p90": "int", "p_first": "double", "p_second": "double", "p_third": "double"}
        out = rows.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()})
        out = out.withColumn("samples", F.lit(0).cast("bigint"))
        out = out.withColumn("confidence_level", confidence_of(F.col("samples")))
        return out.withColumn("price_vs_market_pct", price_vs_market(F.col("price"), F.col("p50")))

    def feature_importance(self, spark) -> DataFrame:
        return spark.createDataFrame([], "rank int, feature string, importance double")


def shared_inputs() -> Pipeline:
    """Codes of the categories and filled numbers: what every learner takes."""
    indexer = StringIndexer(inputCols=CODED, outputCols=[f"{c}_ix" for c in CODED], handleInvalid="keep", stringOrderType="alphabetAsc")
    return Pipeline(stages=[indexer, Imputer(inputCols=NUMERIC, outputCols=[f"{c}_f" for c in NUMERIC], strategy="mean")])


def assembler(encoded: bool) -> VectorAssembler:
    inputs = [f"{c}_ix" for c in CODED] + [f"{c}_f" for c in NUMERIC] + (ENCODED if encoded else ENCODED[:2])
    return VectorAssembler(inputCols=inputs, outputCol="features" if encoded else "features_plain")


def encoded_unseen(rows: DataFrame, parts: int = 5) -> DataFrame:
    """``te_<level>`` of every training row from the other parts of the rows, so that no row's own price is in its inputs."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("listing_id", F.lit("encoding")), F.lit(parts)).cast("int"))
    out = rows
    for level, keys in LEVELS.items():
        # sums of the rows as they came: not behind the joins of the levels before
        table = target_encoding_oof_table(rows, keys, "__part", fixed.ENCODING_SMOOTHING[level])
        out = attach_groups(out, table, [*keys, "__part"], rows="n", spread_by=F.col("listing_id")).withColumnRenamed("te_oof", f"te_{level}")
    return out.drop("__part")


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows that may train a model, with their defaults and only what a fit reads."""
    usable = training_bounds(fill_defaults(rows))
    return usable.select(*READ, *[c for c in DATES if c in usable.columns])


def train_price_model(
    rows: DataFrame, as_of: Column, options: TrainingOptions = TrainingOptions(), stacked: bool = True, bounds: bool = True
) -> PriceModel | UntrainedPriceModel:
    """Fit the model; with fewer than 200 usable rows it stays untrained and predicts NULL.

    Boosted trees give P50; with ``stacked`` a forest and a second boosting without brand and city encodings join
    the blend. Boosting stops when rows set aside by their id no longer gain. P10 / P90 are P50 shifted by the segment's
    quantiles of ln(price / P50) over out-of-fold predictions, so what a fit has learnt by heart does not narrow them; they
    never cross P50.
    """
    return _train(settle(usable_rows(rows)), as_of, options, stacked, bounds)


def _train(train: DataFrame, as_of: Column, options: TrainingOptions, stacked: bool, bounds: bool) -> PriceModel | UntrainedPriceModel:
    """Fit on usable rows that cost little to read again.

    Inputs are coded, filled and laid out once and kept: every pass of every learner reads vectors.
    """
    if train.count() < MIN_TRAINING_ROWS:
        return UntrainedPriceModel()
    encodings = target_encoding(train)
    reference = F.col("listing_date") if "listing_date" in train.columns else F.col("created_at")
    # other numbers than those of the folds, which are taken from the id as well
    aside = F.pmod(F.xxhash64("listing_id"), F.lit(options.validation_every)) == 0
    prepared = prepare(train)
    inputs = shared_inputs().fit(prepared)
    full, plain = assembler(True), assembler(False)
    laid_out = plain.transform(full.transform(inputs.transform(encoded_unseen(prepared))))
    label, weight = F.ln("price").alias("label"), time_decay_weight(as_of, reference, options.decay).alias("weight")
    vectors = [full.getOutputCol()] + ([plain.getOutputCol()] if stacked else [])
    ready = settle(laid_out.select(label, weight, aside.alias("aside"), *vectors))
    common = dict(labelCol="label", weightCol="weight", maxDepth=options.depth, seed=options.seed, maxBins=64)
    boosting = dict(maxIter=options.trees, stepSize=options.step, validationIndicatorCol="aside", validationTol=options.tolerance, **common)
    first = PipelineModel([full, GBTRegressor(**boosting).fit(ready)])
    second = third = None
    if stacked:
        second = PipelineModel([full, RandomForestRegressor(numTrees=options.forest_trees, **common).fit(ready)])
        third = PipelineModel([plain, GBTRegressor(featuresCol=plain.getOutputCol(), **boosting).fit(ready)])
    model = PriceModel(encodings, settle(segment_sample_counts(train)), inputs, first, second, third)
    if bounds:
        model.out_of_fold = settle(cross_validate(train, as_of, options.folds, options, stacked))
        residuals = model.out_of_fold.filter("p50 > 0").select("brand", "model", (F.ln("price") - F.ln("p50")).alias("r"))
        cuts = {"q10": 0.10, "q90": 0.90}
        both_sides = [F.least("q10", F.lit(0.0)).alias("q10"), F.greatest("q90", F.lit(0.0)).alias("q90")]
        model.bounds = settle(split_quantiles(residuals, ["brand", "model"], "r", cuts).filter("n >= 15").select("brand", "model", "n", *both_sides))
        whole = split_quantiles(residuals, [], "r", cuts).select(*both_sides).first()
        # a fold whose fit stayed untrained has no residuals
        model.overall_bounds = {n: float(whole[n]) if whole else 0.0 for n in cuts}
    return model


def cross_validate(
    rows: DataFrame, as_of: Column, folds: int | None = None, options: TrainingOptions = TrainingOptions(), stacked: bool = False
) -> DataFrame:
    """Out-of-fold predictions of every usable row: one fit per fold, some side by side, and one union."""
    folds = options.folds if folds is None else folds
    usable = settle(usable_rows(rows).withColumn("fold", fold_of(F.col("listing_id"), folds)))

    def fit(k: int) -> PriceModel | UntrainedPriceModel:
        return _train(usable.filter(F.col("fold") != k), as_of, options, stacked, bounds=False)

    with ThreadPool(max(1, min(folds, options.side_by_side))) as pool:
        models = pool.map(inheritable_thread_target(rows.sparkSession)(fit), range(folds))
    kept = ["listing_id", "brand", "model", "fold", "price", "p50"]
    return union_all([m.predict(usable.filter(F.col("fold") == k)).select(*kept) for k, m in enumerate(models)])


def make_baseline(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """``baseline``: the geometric mean price of the row's make in the other folds, or of all makes there.

    What a fitted model has to beat. Totals less the fold's own, so it takes no pass per fold.
    """
    sums = [F.sum(F.ln("price")).alias("s"), F.count("*").alias("n")]
    own = settle(rows.groupBy("brand", fold).agg(*sums))
    make = own.groupBy("brand").agg(F.sum("s").alias("make_s"), F.sum("n").alias("make_n"))
    by_fold = own.groupBy(fold).agg(F.sum("s").alias("fold_s"), F.sum("n").alias("fold_n"))
    total = own.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    all_s, all_n = total.select("all_s").scalar(), total.select("all_n").scalar()
    others = (F.col("make_s") - F.col("s")) / (F.col("make_n") - F.col("n"))
    rest = F.try_divide(all_s - F.col("fold_s"), all_n - F.col("fold_n"))
    value = F.exp(F.when(F.col("make_n") > F.col("n"), others).otherwise(rest))
    per_key = own.join(make, "brand").join(by_fold, fold).select("brand", fold, "n", value.alias("baseline"))
    return attach_groups(rows, per_key, ["brand", fold], rows="n", spread_by=F.col("listing_id"))


def price_calculator(model: PriceModel | UntrainedPriceModel, parameters: DataFrame) -> DataFrame:
    """Price table for hypothetical cars (one row per parameter set)."""
    with_price = parameters if "price" in parameters.columns else parameters.withColumn("price", F.lit(0))
    return model.predict(with_price)
