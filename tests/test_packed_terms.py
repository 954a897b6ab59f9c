"""Terms move packed: a row for each slice and bucket, however many terms there are."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from featherloom.operators import textfeat


def test_packed_terms_come_back_and_buckets_depend_on_the_bytes_only(monkeypatch):
    terms = pa.array(["", "a", "ab", "b a", "ü\U0001d538", "\n\x00", *[f"w{i} w{i * 7 % 11}" for i in range(3000)]])
    assert textfeat._terms_unpacked(textfeat._terms_packed(terms)).equals(terms)
    assert textfeat._terms_unpacked(textfeat._terms_packed(terms.slice(3, 0))).equals(terms.slice(3, 0))
    whole = textfeat._bucket(terms, 7)
    assert set(whole) == set(range(7)) and np.bincount(whole).max() < 2 * len(terms) / 7
    assert (textfeat._bucket(terms.slice(5, 900), 7) == whole[5:905]).all()
    monkeypatch.setattr(textfeat, "_HASHED", 5)      # terms are cut between chunks
    assert (textfeat._bucket(terms, 7) == whole).all()


def test_slices_send_a_row_for_each_bucket(spark):
    """Before, each distinct term of each slice was a row of a shuffle, here 4,000 and more."""
    df = spark.range(400).select("id", F.expr("concat_ws(' ', transform(sequence(1, 20), x -> concat('w', (id * x) % 2000)))").alias("text"))
    packed = textfeat.slice_terms(df, "id", "text", "word", (1, 2), 4, 3)
    rows = packed.collect()
    assert len(rows) <= 4 * 3 and sum(len(textfeat._terms_unpacked(r["terms"])) for r in rows) > 4000
    model, weighed = textfeat.fit_transform_tfidf(df, "id", "text", n=(1, 2), min_df=2)
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert "terms" in plan and "term#" not in plan.split("FlatMapCoGroupsInArrow", 1)[1].split("Exchange", 1)[1]
    plain = df.select("id", F.explode(textfeat.n_grams("text", "word", 1)).alias("term")).union(df.select("id", F.explode(textfeat.n_grams("text", "word", 2)))).distinct()
    want = {r["term"]: r["n"] for r in plain.groupBy("term").agg(F.count("*").alias("n")).where("n > 1").collect()}
    assert {r["term"]: r["df"] for r in model.vocabulary.collect()} == want
    assert weighed.count() == sum(want.values())


def test_a_limited_vocabulary_cuts_ties_by_term(spark):
    df = spark.createDataFrame([(1, "aa bb cc dd"), (2, "dd cc bb aa"), (3, "zz zz üü yy"), (4, None)], "id bigint, text string")
    model, rows = textfeat.fit_transform_tfidf(df, "id", "text", max_features=3)
    assert {r["term"] for r in model.vocabulary.collect()} == {r["term"] for r in rows.collect()} == {"aa", "bb", "cc"}
    assert textfeat.fit_transform_tfidf(df.where("id > 3"), "id", "text", max_features=3)[1].count() == 0
    same = {tuple(r) for r in model.transform(df, "id", "text").collect()}
    assert same == {tuple(r) for r in rows.collect()}
