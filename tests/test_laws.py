"""Laws: scalable forms equal the plain ones, also when one key holds most of the rows."""

import numpy as np
from pyspark.sql import Window, functions as F

from featherloom.functions.hashing import HASH_RANGE, key_hash
from featherloom.operators import ensemble, evaluate, folds, match, postings, ranking, records, vectors


def hot(spark, n=3000):
    """Two thirds of the rows share one group and one score."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
                                 F.when(F.col("id") % 2 == 0, 0.5).otherwise((F.col("id") % 97) / 97).alias("p"),
                                 (F.col("id") % 5 == 0).cast("int").alias("y"))


def test_ordered_prefix_equals_window(spark):
    df = hot(spark)
    w = Window.partitionBy("g").orderBy("p", "id")
    plain = df.select("id", F.row_number().over(w).alias("r"), F.sum("y").over(w).alias("s"))
    ours = ranking.ordered_prefix(df, ["g"], [F.col("p"), F.col("id")], row_number="r", sums={"s": "y"}).select("id", "r", "s")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ours.collect()))


def test_ordered_prefix_numbers_sorted_slices(spark, monkeypatch):
    """Rows are numbered where they were sorted; running sums get one slice a task, which no planner joins again."""
    df = hot(spark)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    order = [F.col("p"), F.col("id")]
    assert "Window" not in plan(ranking.ordered_prefix(df, ["g"], order, row_number="r"))
    summed = plan(ranking.ordered_prefix(df, ["g"], order, row_number=None, sums={"s": "y"}, slices=9))
    assert "Window" in summed and "REPARTITION_BY_NUM" in summed and "ENSURE_REQUIREMENTS" not in summed.split("Window")[1].split("BroadcastExchange")[0]
    assert ranking.ordered_prefix(df.where("false"), ["g"], order, sums={"s": "y"}).count() == 0
    monkeypatch.setattr(ranking, "SLICE_ROWS", 100)
    assert ranking.slices_by_rows(df.select(F.explode(F.array("id", "id")).alias("id"))) == 60


def test_substring_scan_passes_short_pieces_once_a_task(spark, monkeypatch):
    """A short text in every document is one row a task; before, it was one row a document, and the text was hashed anew for each length."""
    corpus = spark.createDataFrame([(i, f"ab {i} ab abc the quick brown fox jumps over {i}") for i in range(200)], "id bigint, c string").repartition(2)
    texts = spark.createDataFrame([("ab",), ("abc",), ("the quick br",), ("quick brown fox jumps over 7",), ("quick brown fox jumps over x",)], "t string")
    rows, write = [], match.stored
    monkeypatch.setattr(match, "stored", lambda df, name: (made := write(df, name), rows.append(made.where("length(piece) < 12").count()))[0])
    found = match.contained_in_any(texts, "t", corpus, "id", "c")
    assert {r["t"] for r in found.collect()} == {"ab", "abc", "the quick br", "quick brown fox jumps over 7"}
    assert 2 <= rows[0] <= 4
    text = "\U0001f600bc" * 9
    assert [h.tolist() for n in (3, 40) for h in (match._Pieces(text).hashes(n, 3),)] == [match._piece_hashes("\U0001f600bc", 3).tolist() * 9, []]


def test_hashed_rank_equals_window(spark):
    df = hot(spark).withColumn("h", key_hash("id"))
    plain = df.select("id", (F.row_number().over(Window.partitionBy("g").orderBy("h", "id")) - 1).alias("r"))
    ours = ranking.hashed_rank(df, ["g"], "h", ["id"], hash_range=HASH_RANGE, rank_name="r").select("id", "r")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, ours.collect()))


def test_exact_median(spark):
    df = hot(spark)
    want = df.agg(F.median("p")).first()[0]
    assert ranking.exact_medians(df, ["p"]).first()["median_p"] == want


def test_auc_of_reversed_score(spark):
    df = hot(spark)
    auc = evaluate.roc_auc(df, [], "y", "p").first()["auc"]
    back = evaluate.roc_auc(df.withColumn("p", -F.col("p")), [], "y", "p").first()["auc"]
    assert abs(auc + back - 1) < 1e-12


def test_rank_average_ignores_monotone_transform(spark):
    df = hot(spark, 400).withColumn("model", F.lit("m"))
    a = sorted(map(tuple, ensemble.rank_average(df, "model", "id", "p").collect()))
    b = sorted(map(tuple, ensemble.rank_average(df.withColumn("p", F.exp("p")), "model", "id", "p").collect()))
    assert a == b


def test_fold_laws(spark):
    df = folds.stratified_folds(hot(spark), "y", "id", 5)
    sizes = [r["n"] for r in df.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).where("y = 1").collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert folds.leaking_keys(df, "id", "fold").count() == 0
    members = folds.fold_members(df, 5)
    assert members.where("role = 'valid'").count() == 3000 and members.count() == 15000


def test_nested_rows_keep_every_case(spark):
    df = hot(spark).select(F.col("g").alias("key"), F.lit("20200101").alias("d"), F.col("id").cast("string").alias("c"), F.lit("v").alias("x"))
    rows = records.nested_by_date(df, "key", "d", "c", "x", F.lit(1)).select("key", "d", F.size("cases").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 3000
    assert len(rows) == len({(r["key"], r["d"]) for r in rows})      # one row a key and date, whatever the size


def test_blocked_matches_equal_one_block(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    one = sorted(map(tuple, vectors.top_matches(df, df, 4).collect()))
    many = sorted(map(tuple, vectors.top_matches(df, df, 4, block_rows=17).collect()))
    assert one == many


def test_blocked_neighbours_equal_one_block(spark):
    rng = np.random.default_rng(8)
    rows = [(d, f"t{t}", float(abs(rng.normal()))) for d in range(60) for t in rng.choice(30, 6, replace=False)]
    df = spark.createDataFrame(rows, "doc bigint, term string, w double")
    labels = spark.createDataFrame([(d, d % 2) for d in range(0, 60, 2)], "doc bigint, y int")
    one = sorted(map(tuple, postings.knn_probability(df, "doc", df, labels, "y").collect()))
    many = sorted(map(tuple, postings.knn_probability(df, "doc", df, labels, "y", block_docs=7, chunk_docs=5).collect()))
    assert one == many and len(one) == 30


def test_common_neighbours_with_a_hub(spark):
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 59)] + [(1, 3), (3, 1)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = sorted((a, b, len(near[a]), len(near[b]), len(near[a] & near[b])) for a, b in {(min(e), max(e)) for e in edges})
    assert sorted(map(tuple, match.common_neighbours(df, "a", "b").collect())) == want


def test_common_neighbours_make_no_row_of_two_neighbours_of_a_hub(spark, monkeypatch):
    names = []
    kept = match.stored
    monkeypatch.setattr(match, "stored", lambda df, name="stage": names.append((name, out := kept(df, name))) or out)
    edges = [(i, 1000 + (i * 7 + j) % 9) for i in range(300) for j in range(5)]
    assert match.common_neighbours(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").where("shared > 0").count() == 0
    lists = dict(names)["lists"].collect()
    assert {len(r["vs"]) for r in lists} == {5} and all(r["u"] < 1000 for r in lists)      # hubs have no list; a member gets what stands after it


def test_contained_texts_with_a_full_filter(spark):
    texts = spark.createDataFrame([(f"needle number {i}",) for i in range(30)], "t string")
    corpus = spark.createDataFrame([(i, f"hay needle number {i * 3} hay") for i in range(10)], "id int, c string")
    want = {r["t"] for r in match.contained_in_any(texts, "t", corpus, "id", "c").collect()}
    full = match.contained_in_any(texts, "t", corpus, "id", "c", filter_bits=8)      # everything passes: only the amount of work changes
    assert {r["t"] for r in full.collect()} == want
    assert "needle number 27" in want and "needle number 1" in want  # 1 is part of 12, 15, 18
