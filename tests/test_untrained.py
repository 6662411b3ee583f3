"""A price model with too few rows predicts NULL instead of failing."""

from pyspark.sql import functions as F

from checks.q_pricing import train
from kerbside.operators import evaluate
from kerbside.plans import price_model as M
from kerbside.sources import driver_tables as D


def test_too_few_rows(spark, sf):
    few = train(spark, sf).limit(40)
    model = M.train_price_model(few, D.as_of())
    out = model.predict(few)
    got = out.agg(F.count("*"), F.count("p10"), F.count("p50"), F.count("p90"), F.count("price_vs_market_pct"), F.max("samples")).first()
    assert tuple(got) == (40, 0, 0, 0, 0, 0)
    assert set(out.columns) >= {"confidence_level", "p_first", "p_second", "p_third"}
    assert M.price_calculator(model, few).filter("p50 is not null").count() == 0
    folds = M.cross_validate(few, D.as_of(), folds=2)
    assert folds.filter("p50 is not null").count() == 0 and folds.count() > 0
    assert evaluate.mape_overall(folds).count() == 1
    assert model.feature_importance(spark).count() == 0
