"""Ratios of terms and scaled rows without a row for each document and term in a join."""

import pytest
from pyspark.sql import functions as F

from featherloom.operators import textfeat

TEXTS = [(i, " ".join(f"w{(i * j) % 9}x" for j in range(1, 7))) for i in range(40)] + [(3, "w1x w2x extra"), (None, "w1x w2x w3x"), (50, None), (51, "")]
LABELS = [(i, i % 3 == 0) for i in range(0, 40, 2)] + [(3, True), (3, False), (5, None), (None, True), (99, True)]


@pytest.fixture()
def made(spark):
    df = spark.createDataFrame(TEXTS, "id bigint, text string")
    labels = spark.createDataFrame([(i, None if y is None else int(y)) for i, y in LABELS], "id bigint, y int")
    of = lambda **k: textfeat.fit_transform_tfidf(df, "id", "text", n=(1, 2), min_df=2, max_df=0.9, sublinear=True, **k)[1]
    return df, labels, of(), of(sliced=True)


def rounded(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_ratio_of_slices_is_that_of_rows(made):
    """Null and repeated keys, keys with two labels or a null one, labels without a text."""
    _, labels, rows, sliced = made
    want = textfeat.log_count_ratio(rows, labels, "id", "y")
    got = textfeat.log_count_ratio(sliced, labels, "id", "y")
    assert rounded(got) == rounded(want) and got.count() > 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (id" not in plan and "Join Inner, (term" not in plan       # before, all rows were joined with the labels
    narrow = labels.withColumn("id", F.col("id").cast("int"))                      # another type of key is dealt in another way
    assert rounded(textfeat.log_count_ratio(sliced, narrow, "id", "y")) == rounded(want)
    assert textfeat.log_count_ratio(sliced, labels.where("false"), "id", "y").count() == 0


def test_scaled_rows_of_slices_are_those_of_rows(made):
    _, labels, rows, sliced = made
    ratio = textfeat.log_count_ratio(rows, labels, "id", "y").where("term not like '% %'")
    want, got = textfeat.scale_by_ratio(rows, ratio, "id"), textfeat.scale_by_ratio(sliced, ratio, "id")
    assert rounded(got) == rounded(want) and 0 < got.count() < rows.count()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroupsInArrow", 1)[0]                # before, all rows were joined with the ratio
    assert rounded(sliced.rows()) == rounded(rows)
    assert textfeat.scale_by_ratio(sliced, ratio.where("false"), "id").count() == 0
    with pytest.raises(Exception, match="listed twice"):
        textfeat.scale_by_ratio(sliced, ratio.union(ratio), "id").count()
