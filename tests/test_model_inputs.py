"""A price model codes and lays out its inputs once, however many learners read them."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from kerbside.plans import price_model as M


def test_learners_share_their_inputs(spark, monkeypatch):
    rows = spark.range(400).select(
        F.col("id").alias("listing_id"), F.concat(F.lit("b"), F.col("id") % 3).alias("brand"), F.concat(F.lit("m"), F.col("id") % 7).alias("model"),
        (F.lit(2000) + F.col("id") % 20).cast("int").alias("year"), (F.lit(100_000) + F.col("id") % 20 * 10_000).cast("int").alias("price"),
        F.when(F.col("id") % 5 > 0, F.col("id") * 100).alias("mileage"), F.when(F.col("id") % 4 > 0, "petrol").alias("engine_type"),
        (F.lit(1.0) + F.col("id") % 3).alias("engine_volume"), F.lit(90).alias("power_hp"), F.lit(1).alias("owners_count"), F.lit("x").alias("title"), F.timestamp_seconds(F.lit(10**9) + F.col("id")).alias("created_at"),
    )
    fits = []
    fit = Pipeline._fit
    monkeypatch.setattr(Pipeline, "_fit", lambda self, data: fits.append([s for s in self.getStages() if isinstance(s, StringIndexer)]) or fit(self, data))
    options = M.TrainingOptions(trees=2, forest_trees=2, depth=2)
    model = M.train_price_model(rows, F.to_timestamp(F.lit("2001-11-05")), options, bounds=False)
    assert sum(len(f) for f in fits) == 1
    out = model.predict(rows)
    assert out.agg(F.count("p_first"), F.count("p_second"), F.count("p_third")).first() == (400, 400, 400)
    # the second boosting does without the encodings of make and city
    assert len(model.first.stages[-2].getInputCols()) - len(model.third.stages[-2].getInputCols()) == 2
    # dearer cars are newer here, which every learner sees
    means = {r.newer: r.p50 for r in out.groupBy((F.col("year") >= 2010).alias("newer")).agg(F.avg("p50").alias("p50")).collect()}
    assert means[True] > means[False]
