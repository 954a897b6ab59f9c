"""Sequences and mapped tokens against plain Python, with repeated and null keys; no row for each token is shuffled."""

from pyspark.sql import functions as F

from featherloom.functions.textrules import tokens
from featherloom.operators import textfeat

ROWS = [(1, "b a c a"), (2, "c zz b"), (2, "a b"), (3, None), (4, ""), (None, "a b"), (5, "zz"), (1, None)]


def frame(spark):
    return spark.createDataFrame(ROWS, "id bigint, text string")


def merged(key, value):
    placed = [(i, value(w)) for k, text in ROWS if k == key and text for i, w in enumerate(text.split()) if value(w) is not None]
    return [v for _, v in sorted(placed)] if key is not None else []


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_id_sequences(spark):
    codes = {"a": 1, "b": 2, "c": 3}
    index = spark.createDataFrame(list(codes.items()), "word string, code bigint")
    for side, length in (("pre", 3), ("post", 3), ("pre", 6)):
        got = textfeat.id_sequences(frame(spark), "id", tokens("text"), index, length, side)
        want = []
        for key, _ in ROWS:
            ids = merged(key, codes.get)
            ids, pad = ids[:length] if side == "post" else ids[-length:], [0] * (length - len(ids))
            want.append((key, ids + pad if side == "post" else pad + ids))
        assert rows(got) == sorted(want, key=str)


def test_map_tokens_by_join(spark):
    names = {"a": "X", "c": "b"}
    table = spark.createDataFrame([*names.items(), ("a", "Y"), ("b", None)], "w string, c string")
    got = textfeat.map_tokens_by_join(frame(spark), "id", "text", table, "w", "c")
    want = [(key, None if text is None else " ".join(merged(key, lambda w: names.get(w, w)))) for key, text in ROWS]
    assert rows(got) == sorted(want, key=str)


def test_only_distinct_words_of_a_document_meet_the_table(spark):
    df = spark.createDataFrame([(i, "a b " * 500) for i in range(20)], "id bigint, text string")
    index = spark.createDataFrame([("a", 1), ("b", 2)], "word string, code bigint")
    out = textfeat.id_sequences(df, "id", tokens("text"), index, 4)
    assert {tuple(r["ids"]) for r in out.collect()} == {(1, 2, 1, 2)}
    found = textfeat._looked_up(df, "id", tokens("text"), index.withColumnRenamed("code", "value"))
    assert found.agg(F.max(F.size("_found"))).first()[0] == 2                # before, 1000 rows of a document were joined
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "array_distinct" in plan
