"""The learning rows are aggregated once, whatever reads them."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from featherloom.catalog import QUERIES, flows
from featherloom.functions import textrules as tr


def test_learning_rows_are_written_once(spark):
    lines = spark.createDataFrame([(1, 2.0, 3.0, 0.1, 0.2, 1), (1, 1.0, 4.0, 0.3, 0.0, 2), (2, 5.0, 6.0, 0.0, 0.1, 1)],
                                  "l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linenumber int")
    orders = spark.createDataFrame([(1, "F"), (2, "O"), (3, "F")], "o_orderkey bigint, o_orderstatus string")
    rows = flows._learning_rows(SimpleNamespace(lineitem=lines, orders=orders))
    assert {(r["id"], r["y"], r["l_quantity"], r["l_linenumber"]) for r in rows.collect()} == {(1, 1.0, 3.0, 3.0), (2, 0.0, 5.0, 1.0)}
    assert "Aggregate" not in rows._jdf.queryExecution().optimizedPlan().toString()      # before, each of some six readers aggregated the lines anew


def test_fill_empty_evaluates_its_text_once(spark):
    """What stands before the step runs once a row; before, it ran once for the test and once for the value."""
    df = spark.createDataFrame([("a  b",), (" \t",), ("",), (None,)], "t string")
    out = df.select(tr.chain("t", [lambda c: F.regexp_replace(c, "once", "x"), tr.fill_empty]).alias("o"), tr.fill_empty("t", strict=True).alias("s"))
    assert [tuple(r) for r in out.collect()] == [("a  b", "a  b"), ("NA", " \t"), ("NA", "NA"), (None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("once") == 1


def test_stacked_models_make_learning_rows_once(spark, monkeypatch):
    """Boosting and the linear models share the rows, and these stay packed; before, they were aggregated twice and unpivoted."""
    feats = spark.createDataFrame([(1, 1.0, 0, 2.0, 3.0, 0.1, 0.2, 1.0), (2, 0.0, 1, 5.0, 6.0, 0.0, 0.1, 2.0)], ["id", "y", "fold", *flows.FEATURES])
    packed, _ = flows._dense_rows(feats)
    assert packed.columns == ["id", "terms", "ws"] and packed.count() == 2
    made = []
    monkeypatch.setattr(flows, "_learning_rows", lambda t: made.append(t) or feats)
    monkeypatch.setattr(flows.boost, "fit_boosted", lambda rows, *a, **k: (None, rows.select("id", "y", "fold", F.lit(0.5).alias("p"))))
    monkeypatch.setattr(flows.learn, "search_subsets", lambda df, *a, **k: df.select(F.lit("x").alias("models"), F.col("shrunk").alias("auc")))
    assert QUERIES["mlf_5_stacked_models"](spark, "/none").count() == 2 and len(made) == 1
