"""Hand-made rows for the edge rules."""

import pytest
from pyspark.sql import functions as F

from featherloom.functions import arrays, dates, scalars, textrules as tr
from featherloom import session
from featherloom.operators import columns, encode, ensemble, evaluate, filters, folds, learn, match, postings, ranking, records, sampling, textfeat, vectors
from featherloom.plans.flow import fit_flow
from featherloom.sources import scan


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make("x").alias("y")).first()["y"]


@pytest.mark.parametrize("x,want", [("5", "<5"), ("4", "<5"), ("13", "5_13"), ("13.5", "13_21"), ("46", "40_48"), ("47.9", "40_48"),
                                    ("48", ">48"), (None, None), ("bad", None)])
def test_bin_label(spark, x, want):
    assert one(spark, x, "string", lambda c: scalars.bin_label(c, 5, 48, 8)) == want


@pytest.mark.parametrize("x,want", [("1", "L"), ("2", "M"), ("4", "M"), ("4.1", "H"), (None, None)])
def test_level(spark, x, want):
    assert one(spark, x, "string", lambda c: scalars.level(c, 2, 4)) == want


@pytest.mark.parametrize("x,want", [("10", 1.0), ("0", 0.0), ("1", 0.1111), (None, None)])
def test_clip_ratio(spark, x, want):
    assert one(spark, x, "string", lambda c: scalars.clip_ratio(c, 0, 9)) == want


def test_largest_skips_nan(spark):
    row = spark.createDataFrame([(1.0, float("nan"), 3.0)], "a double, b double, c double")
    assert row.select(scalars.largest("a", "b", "c").alias("m")).first()["m"] == 3.0


def test_region_parts_round_half_even(spark):
    assert one(spark, 0.125, "double", scalars.region_remainder) == 25
    n = spark.createDataFrame([((62 ** 0.5) / 40,)], "x double")
    a, m = scalars.region31("x")
    assert tuple(n.select(a, m).first()) == (31, 1)


def test_dates(spark):
    assert one(spark, "2014-8-5", "string", dates.compact_date) == "20140805"
    assert one(spark, "2016-07-01 12:00:00", "string", dates.utc_to_local) == "2016-07-01 05:00:00"


def test_narrowing_keeps_what_does_not_fit(spark):
    df = columns.narrow_types(spark.createDataFrame([(127, 300, 1.5), (-128, 1, 2.5)], "a bigint, b bigint, c double"))
    assert dict(df.dtypes) == {"a": "tinyint", "b": "bigint", "c": "float"}


def test_unknown_column_is_an_error(spark):
    with pytest.raises(ValueError):
        columns.remain_columns(spark.range(1), ["nope"])


def test_target_encoding_edges(spark):
    rows = [(1, "a", 1, 0), (2, "a", 0, 1), (3, "b", 1, 0), (4, None, 1, 0), (5, None, 0, 1)]
    df = spark.createDataFrame(rows, "id int, v string, y int, fold int")
    out = {r["id"]: r["enc"] for r in encode.oof_target_encode(df, "v", "y", "fold", min_leaf=1, smoothing=1, out="enc").collect()}
    assert out[3] == 0.0          # b is in no other fold: prior of fold 1
    assert out[4] == 0.0 and out[5] == 1.0
    assert out[1] == pytest.approx(0.0) and out[2] == pytest.approx(1.0)


def test_noise_is_deterministic(spark):
    df = spark.range(50).selectExpr("id", "cast(id % 3 as string) v", "cast(id % 2 as int) y", "cast(id % 5 as int) fold")
    run = lambda: sorted((r["id"], r["enc"]) for r in encode.oof_target_encode(
        df, "v", "y", "fold", min_leaf=1, smoothing=1, out="enc", noise=0.1, noise_key="id").select("id", "enc").collect())
    assert run() == run()


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    assert [r["v"] for r in encode.impute(df, modes=["v"]).collect()] == ["b", "a", "a"]


def test_frequent_values_have_no_limit(spark):
    df = spark.range(200).selectExpr("cast(id as string) v", "cast(null as string) w")
    assert encode.frequent_values(df, df, ["v", "w"], min_ones=1).count() == 200
    text = spark.createDataFrame([("nan",), (None,)], "v string")
    assert encode.fit_frequent_one_hot(text, text, ["v"], min_ones=1) == {"v": ["nan"]}


def test_auc_and_gini_edges(spark):
    one_class = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "id int, y int, p double")
    assert evaluate.roc_auc(one_class, [], "y", "p").first()["auc"] is None
    tied = spark.createDataFrame([(1, 1, 0.5), (2, 0, 0.5), (3, 1, 0.5), (4, 0, 0.5)], "id int, y int, p double")
    assert evaluate.roc_auc(tied, [], "y", "p").first()["auc"] == 0.5
    single = spark.createDataFrame([(1, 0, 0.5)], "id int, y int, p double")
    assert evaluate.normalized_gini(single, [], "y", "p", "id").first()["gini"] is None
    perfect = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.9), (3, 1, 0.8)], "id int, y int, p double")
    assert evaluate.normalized_gini(perfect, [], "y", "p", "id").first()["gini"] == pytest.approx(1.0)


def test_grouped_fold_edges(spark):
    df = spark.createDataFrame([("a_nohash_1.wav",), ("a_nohash_2.wav",), ("plain",), ("_nohash_3",), ("ü_nohash_1",)], "n string")
    rows = df.select(folds.group_of("n").alias("g"), folds.grouped_fold(folds.group_of("n"), 5).alias("f")).collect()
    assert rows[0]["g"] == rows[1]["g"] == "a" and rows[0]["f"] == rows[1]["f"]
    assert rows[2]["g"] == "plain" and rows[3]["g"] == "" and rows[4]["g"] == "ü"
    assert all(0 <= r["f"] < 5 for r in rows)


def test_missing_prediction_is_an_error(spark):
    truth = spark.createDataFrame([(1, 1), (2, 0)], "id int, y int")
    with pytest.raises(ValueError):
        folds.matched_predictions(spark.createDataFrame([(1, 0.5)], "id int, p double"), truth, "id")


def test_votes(spark):
    rows = [(1, "m1", "yes"), (1, "m2", "no"), (1, "m3", "no"), (1, "m4", "yes"),
            (2, "m1", "unknown"), (2, "m2", "unknown"), (2, "m3", "silence"), (3, "m1", "unknown"), (3, "m2", "unknown"), (3, "m3", "up"),
            (4, "m2", "up")]
    df = spark.createDataFrame(rows, "id int, model string, label string")
    major = {r["id"]: r["label"] for r in ensemble.majority_vote(df, "model", ["id"], "label").collect()}
    assert major == {1: "yes", 2: "unknown", 3: "unknown", 4: "up"}
    ruled = {r["id"]: r["label"] for r in ensemble.rule_vote(df, "model", ["id"], "label").collect()}
    assert ruled == {1: "yes", 2: "silence", 3: "unknown", 4: "up"}
    signed = {r["id"]: (r["signature"], r["tied"]) for r in ensemble.vote_signature(df, ["id"], "label").collect()}
    assert signed[1] == ("no2_yes2", True) and signed[4] == ("up1", False)


def test_best_f1_first_best_wins(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "id int, y int, p double")
    row = evaluate.best_f1(df, [], "y", "p").first()
    assert (row["threshold"], row["f1"]) == (0.1, 1.0)


def test_sections(spark):
    begin, end = ("B",), ("E",)
    cases = {("B", "x", "E"): "", ("a", "B", "x", "y", "E"): "xy", ("a", "B", "x", "B", "z", "E"): "z",
             ("a", "B", "x"): "", (): "", ("a", "E", "B", "q", "E"): "q", ("a", "BE", "E"): ""}
    for pieces, want in cases.items():
        df = spark.createDataFrame([(list(pieces),)], "p array<string>")
        assert df.select(tr.section("p", begin, end).alias("s")).first()["s"] == want


def test_topics(spark):
    topics = [("alpha", "beta"), ("gamma",)]
    got = lambda text: [tuple(x) for x in one(spark, text, "string", lambda c: tr.topic_ranges(c, topics))]
    assert got("nothing here") == []
    assert got("x, so beta is") == [("beta", 2, 13)]
    assert got("x, so gamma: is, the alpha") == [("gamma", 6, 16), ("alpha", 16, 26)]
    assert got("alpha gamma") == [("alpha", 0, 0), ("gamma", 0, 11)]


def test_text_edges(spark):
    assert one(spark, "", "string", tr.clean_comment) == ""
    assert one(spark, "!?", "string", tr.clean_comment) == " !  ? "
    assert one(spark, "I can't", "string", tr.clean_comment) == "i cannot "
    assert one(spark, "привет", "string", tr.clean_comment).strip() == ""
    assert one(spark, "a * b*b", "string", lambda c: tr.unmask_stars(c, ["bb"])) == "a   bb"
    assert one(spark, "yes we won't", "string", tr.for_char_grams) == "#yes# #we# #will# #not#"
    assert one(spark, "  ", "string", tr.fill_empty) == "NA"
    assert one(spark, "  ", "string", lambda c: tr.fill_empty(c, strict=True)) == "  "
    assert one(spark, ["入", "病", "3", "天", "天", "x", "天"], "array<string>", tr.join_time_words) == ["入", "病", "3天", "天", "x", "天"]
    assert one(spark, ["病", "肺", "病", "史"], "array<string>", tr.join_suffix_words) == ["病", "肺病史"]
    assert len(one(spark, "a" * 1_000_000, "string", tr.squeeze_letters)) == 2


def test_person_pattern_and_marker(spark):
    assert one(spark, "x,患者姓名a,年龄b,y", "string", tr.drop_person_info) == "x年龄b,y"
    assert one(spark, "术后复查示", "string", tr.after_marker) == "示"


def test_arrays(spark):
    fit = lambda xs, n, side: one(spark, xs, "array<int>", lambda c: arrays.fit_length(c, n, 0, side))
    assert fit([], 2, "post") == [0, 0] and fit([1], 2, "pre") == [0, 1]
    assert fit([1, 2, 3], 2, "pre") == [2, 3] and fit([1, 2, 3], 2, "post") == [1, 2] and fit([1, 2], 2, "post") == [1, 2]
    assert one(spark, [2.0, 2.0], "array<double>", arrays.min_max_signed) == [-1.0, -1.0]
    assert one(spark, [1, 2, 3], "array<int>", lambda c: arrays.circular_shift(c, 1)) == [3, 1, 2]
    assert one(spark, [], "array<int>", lambda c: arrays.circular_shift(c, 1)) == []


def test_nested_records_last_value_wins(spark):
    rows = [("p1", "EMR", None, "bp", "1", 1), ("p1", "EMR", None, "bp", "2", 2), ("p1", "LIS", "c", "k", "9", 3)]
    df = spark.createDataFrame(rows, "key string, kind string, category string, item string, value string, seq int")
    got = {(r["kind"], r["category"]): r["items"] for r in records.nested_records(df, "key", "kind", "category", "item", "value", F.col("seq")).collect()}
    assert got == {("EMR", ""): {"bp": "2"}, ("LIS", "c"): {"k": "9"}}


def test_size_does_not_change_the_grain(spark):
    many = spark.range(5000).select(F.lit("p1").alias("key"), F.lit("LIS").alias("kind"), F.lit("c").alias("category"), F.concat(F.lit("k"), "id").alias("item"),
                                    F.lit("1").alias("value"), F.col("id").alias("seq"))
    events = records.nested_records(many, "key", "kind", "category", "item", "value", F.col("seq"))
    admissions = spark.createDataFrame([(1, "p1"), (2, "p2")], "event_id int, key string")
    assert records.left_join(admissions, events, ["key"]).count() == 2
    sparse = spark.createDataFrame([("a", "x", 5, "one "), ("a", "x", 1_000_005, "two")], "key string, kind string, seq int, text string")
    assert [tuple(r) for r in records.pivot_sections(sparse, "key", "kind", "seq", "text", ["x", "y"]).collect()] == [("a", "one two", "")]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None)], "id bigint, label string")
    assert {r["id"] for r in folds.stratified_folds(df, "label", "id", 2).collect()} == {1, 2, 3, 4}
    scores = spark.createDataFrame([(None, 1, 0.5), (None, 2, 0.1), ("m", 1, None)], "model string, id bigint, p double")
    assert ensemble.tied_rank(scores, "model", "p").count() == 3
    numbered = ranking.ordered_prefix(df, ["label"], [F.col("id")], sums={"s": "id"}).collect()
    assert {(r["id"], r["row_num"], r["s"]) for r in numbered} == {(1, 1, 1), (2, 1, 2), (3, 2, 4), (4, 2, 6)}


def test_repeated_dictionary_keys_do_not_multiply(spark):
    words = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    table = spark.createDataFrame([("a", "Y"), ("a", "X")], "w string, c string")
    assert {r["id"]: r["text"] for r in textfeat.map_tokens_by_join(words, "id", "text", table, "w", "c").collect()} == {1: "X b", 2: None}
    keys = spark.createDataFrame([("a",), ("z",)], "w string")
    assert {tuple(r) for r in records.lookup_or_default(keys, "w", table, "c", "none").collect()} == {("a", "X"), ("z", "none")}
    near = spark.createDataFrame([("q", "a", 0.9)], "word string, neighbour string, sim double")
    votes = match.vote_category(near, table.toDF("word", "category")).collect()
    assert [(r["category"], r["weight"]) for r in votes] == [("X", 0.9)]


def test_medians_of_ties_nulls_and_even_counts(spark):
    df = spark.range(2001).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 7).alias("a"), (F.col("id") * 1.5).alias("b"),
                                  F.when(F.col("id") < 4, F.col("id")).alias("c"), F.lit(None).cast("int").alias("d"))
    row = ranking.exact_medians(df, ["a", "b", "c", "d"]).first()
    import statistics
    assert row["median_a"] == statistics.median([i % 7 for i in range(2001) if i % 3]) and row["median_b"] == 1500 and row["median_c"] == 1.5 and row["median_d"] is None


def test_storage_must_be_shared_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.shared_dir(Session())
    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,1024]")


def test_words_stand_in_one_split_only(spark):
    df = spark.range(3000).select("id", (F.col("id") % 40).cast("string").alias("w"), F.when(F.col("id") % 10 < 3, "valid").otherwise("train").alias("part"),
                                  (F.col("id") % 4 == 0).alias("wanted"))
    got = sampling.unknown_by_split(df, "part", "w", F.col("wanted"), "id", 10)
    assert got.count() and got.groupBy("w").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_missing_features_are_an_error(spark):
    with pytest.raises(Exception):
        learn.assemble(spark.createDataFrame([(1, None), (2, 1.0)], "id int, x double"), ["x"], ["id"]).collect()


def test_pruned_matches_equal_the_exact_ones_above_the_bound(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 16))
    y = x + 0.1 * rng.standard_normal(x.shape)
    frame = lambda m: spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(m / np.linalg.norm(m, axis=1, keepdims=True))], "id bigint, vec array<double>")
    left, right = frame(x), frame(y)
    exact = {tuple(r) for r in vectors.top_matches(left, right, 2, block_rows=64).where("score >= 0.9").collect()}
    pruned = {tuple(r) for r in vectors.pruned_matches(left, right, 2, 0.9, 16).collect()}
    assert pruned <= exact and len(pruned) >= 0.99 * len(exact)


def test_documents_without_terms_get_a_probability(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (4, "a", 1.0)], "id bigint, term string, w double")
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id bigint")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "id bigint, y int")
    got = {r["id"]: r["p"] for r in postings.knn_probability(rows, "id", docs, labels, "y", k=1, block_docs=2, chunk_docs=1).collect()}
    assert got == {4: 1.0, 5: 1.0}


def test_a_letter_in_every_document_makes_no_pairs(spark):
    corpus = spark.range(300).select("id", F.concat(F.lit("the letter a in "), "id").alias("c"))
    texts = spark.createDataFrame([("a",), ("zz",)], "t string")
    assert [r["t"] for r in match.contained_in_any(texts, "t", corpus, "id", "c").collect()] == ["a"]


def test_csv_sentinel(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,-1\n2,-1.0\n-1,0.5\n")
    rows = scan.scan_csv(spark, str(tmp_path), "id int, v double").orderBy(F.col("id").asc_nulls_last()).collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, None), (None, 0.5)]


def test_nested_document_folders(spark, tmp_path):
    for day, name, body in (("01", "x_007_note a.txt", "one\ntwo"), ("02", "x_008_note b.txt", "three"), ("02", "x_009_other.txt", "no")):
        (tmp_path / "m1" / day).mkdir(parents=True, exist_ok=True)
        (tmp_path / "m1" / day / name).write_text(body)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x_010_note.txt").write_text("hidden")
    rows = {r["id"]: r["content"] for r in scan.scan_documents(spark, str(tmp_path), "*note*").collect()}
    assert rows == {"007": "one\ntwo", "008": "three"}


def test_filters(spark):
    df = spark.createDataFrame([("k", "-"), (" ", "v"), ("a", "v"), ("head", "v")], "k string, v string")
    assert [r["k"] for r in filters.keep_real(df, "k", "v", header="head").collect()] == ["a"]
    with pytest.raises(ValueError):
        filters.assert_valid(df, {"legal": F.col("v") == "v"})


def test_unknown_flow_operation(spark):
    with pytest.raises(ValueError):
        fit_flow(spark.range(1), [[("no_such_operation", [])]])


def test_zero_vector_matches_nothing(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0])], "id bigint, vec array<double>").select("id", vectors.unit("vec").alias("vec"))
    right = spark.createDataFrame([(5, [1.0, 0.0]), (4, [0.0, 1.0])], "id bigint, vec array<double>")
    assert tuple(vectors.top_matches(left, right, 1).first()) == (1, 4, 0.0)


def test_contained_texts_short_and_long(spark):
    texts = spark.createDataFrame([("cat",), ("the quick brown fox",), ("zebra",), ("",)], "t string")
    corpus = spark.createDataFrame([(1, "see the quick brown fox run"), (2, "concatenate")], "id int, c string")
    assert {r["t"] for r in match.contained_in_any(texts, "t", corpus, "id", "c").collect()} == {"cat", "the quick brown fox"}
