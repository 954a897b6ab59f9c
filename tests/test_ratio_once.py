"""Rows of documents move once for the training and the test side."""

import numpy as np
from pyspark.sql import functions as F

from featherloom.operators import linear


def test_rows_are_made_once_for_both_sides(spark, monkeypatch):
    """Before, rows were written, and written documents were shuffled once for each side."""
    tables, write = [], linear.stored

    def noted(df, name="stage"):
        tables.append(name)
        return write(df, name)

    monkeypatch.setattr(linear, "stored", noted)
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(int(i), f"t{t}", float(rng.random())) for i in range(60) for t in rng.choice(12, 5, replace=False)], "id bigint, term string, w double")
    train = spark.range(40).select("id", (F.col("id") % 3).alias("fold"), (F.col("id") % 2).alias("y"))
    test = spark.range(40, 62).select("id").union(spark.range(3, 4).select("id"))      # one is on both sides, two have no rows
    valid, new = linear.ratio_scaled_logistic(rows, train, test, "id", ["y"], 3, steps=3)
    assert tables == ["packed"]
    assert sorted(r["id"] for r in valid.collect()) == list(range(40))
    got = {r["id"]: r["p"] for r in new.collect()}
    assert sorted(got) == [3, *range(40, 62)] and got[60] == got[61] and len({round(p, 12) for p in got.values()}) > 10
