"""Counts and TF-IDF by slices against plain Python; terms meet the vocabulary once for each slice, not for each document."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from featherloom.operators import encode, textfeat

ROWS = [(1, "the cat sat on the mat \U0001d538\U0001d539\U0001d538"), (2, "The  dog\tsat"), (2, "dog and the cat"), (None, "cat mat"), (4, ""), (5, None), (6, "x"), (7, "the the the"), (8, "ab\x85cd \U0001d538b the mat")]


def grams(text, analyzer, lo, hi):
    if text is None:
        return []
    if analyzer == "word":
        units = [re.findall(r"[^\W]{2,}", text.lower())]
    elif analyzer == "char":
        units = [list(re.sub(r"[ \t\n\x0b\f\r]{2,}", " ", text.lower()))]
    else:
        units = [list(w) for w in re.split(r"[ \t\n\x0b\f\r]+", text)]
    join = " ".join if analyzer == "word" else "".join
    return [join(u[i : i + n]) for u in units for n in range(lo, hi + 1) for i in range(len(u) - n + 1)]


def counted(analyzer, lo, hi):
    out = {}
    for key, text in ROWS:
        out.setdefault(key, Counter()).update(grams(text, analyzer, lo, hi))
    return {(k, t): c for k, own in out.items() for t, c in own.items()}


@pytest.mark.parametrize("analyzer, n", [("word", (1, 2)), ("word", (2, 3)), ("char", (2, 3)), ("char", (1, 1)), ("token_char", (3, 3)), ("token_char", (1, 4))])
@pytest.mark.parametrize("slice_text", [1 << 20, 9])
def test_term_counts(spark, monkeypatch, analyzer, n, slice_text):
    monkeypatch.setitem(textfeat.SLICE_TEXT, analyzer, slice_text)
    got = textfeat.term_counts(spark.createDataFrame(ROWS, "id bigint, text string"), "id", "text", analyzer, n).collect()
    assert {(r["id"], r["term"]): r["tf"] for r in got} == counted(analyzer, *n) and len(got) == len(counted(analyzer, *n))


@pytest.mark.parametrize("limit, binary, sublinear", [(None, False, True), (4, True, False)])
def test_tfidf_matches_plain_python(spark, limit, binary, sublinear):
    df = spark.createDataFrame(ROWS, "id bigint, text string")
    model, rows = textfeat.fit_transform_tfidf(df, "id", "text", n=(1, 2), min_df=2, max_df=0.9, max_features=limit, binary=binary, sublinear=sublinear)
    tf = counted("word", 1, 2)
    df_of, corpus = Counter(t for _, t in tf), Counter()
    for (_, t), c in tf.items():
        corpus[t] += c
    kept = sorted((t for t, d in df_of.items() if 2 <= d <= 0.9 * len(ROWS)), key=lambda t: (-corpus[t], t))[:limit]
    idf = {t: math.log((1 + len(ROWS)) / (1 + df_of[t])) + 1 for t in kept}
    raw = {(k, t): (1.0 if binary else 1 + math.log(c) if sublinear else c) * idf[t] for (k, t), c in tf.items() if t in idf}
    norm = {k: math.sqrt(sum(w * w for (j, _), w in raw.items() if j == k)) for k, _ in raw}
    want = {(k, t): w / norm[k] for (k, t), w in raw.items()}
    for got in (rows, model.transform(df, "id", "text")):
        found = {(r["id"], r["term"]): r["w"] for r in got.collect()}
        assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-12 for x in want)
    assert {r["term"]: r["df"] for r in model.vocabulary.collect()} == {t: df_of[t] for t in kept}


def test_no_shuffle_carries_a_row_for_each_document_and_term(spark):
    df = spark.range(2000).selectExpr("id", "'one two three four five six seven eight' as text")
    _, rows = textfeat.fit_transform_tfidf(df, "id", "text", n=(1, 2))
    terms = textfeat.slice_terms(df, "id", "text", "word", (1, 2), 8)
    assert rows.count() == 2000 * 15 and terms.count() <= 8 * 15
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan      # before, every (document, term) was shuffled to the vocabulary and back


def test_only_wanted_keys_are_transformed_with_the_weights_of_all(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}x" for j in range(1, 6))) for i in range(30)], "id bigint, text string")
    only = spark.createDataFrame([(i,) for i in (1, 4, 4, 9, 99)], "id bigint")
    of = lambda **k: {(r["id"], r["term"], round(r["w"], 9)) for r in textfeat.fit_transform_tfidf(df, "id", "text", n=(1, 2), min_df=2, sublinear=True, **k)[1].collect()}
    assert of(only=only) == {r for r in of() if r[0] in (1, 4, 9)}


def test_word_counts_are_those_of_the_tokens(spark):
    """Equal to one row a word, with null texts, null and repeated keys, and every character that may part words."""
    odd = "".join(f"a{chr(c)}B" for c in [*range(1, 48), 0x85, 0xA0, 0x2003, 0x3000])
    rows = [(1, " the cat the "), (2, None), (2, "the"), (None, "cat cat"), (None, "cat"), (3, ""), (3, " \t"), (2, "the ü"), (4, odd)]
    df = spark.createDataFrame(rows, "id bigint, t string").repartition(3)
    plain = df.select("id", F.explode(textfeat.tokens(F.lower("t"))).alias("word")).groupBy("id", "word").count()
    made = textfeat.word_counts(df, "id", F.lower("t"))
    pairs = [(k, r["word"], n) for r in made.collect() for k, n in zip(r["keys"], r["ns"], strict=True)]
    assert Counter(pairs) == Counter(tuple(r) for r in plain.collect())
    codes = encode.frequency_codes(made, "word", n="n")
    assert {tuple(r) for r in codes.collect()} == {tuple(r) for r in encode.frequency_codes(df.select(F.explode(textfeat.tokens(F.lower("t"))).alias("word")), "word").collect()}
    bag = textfeat.bag_of_words(made, "id", None, codes)
    assert {tuple(r) for r in bag.collect()} == {tuple(r) for r in textfeat.bag_of_words(df, "id", textfeat.tokens(F.lower("t")), codes).collect()}
    assert "explode" not in bag._jdf.queryExecution().optimizedPlan().toString()       # before, each word of each text was a row, twice
    assert textfeat.word_counts(df.where("false"), "id", F.lower("t")).count() == 0
