"""Operators of featherloom.llm against brute force on small inputs, and their edge rows."""

import base64
import collections
import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Reference

from featherloom.llm.common import WordHasher
from featherloom.llm import bpe, cells, components, html, minhash, mixing, onebit, order, parsing, pii, queries, substring, toxicity

FOLDER = "/root/testdata/sf0.001"
EDGE = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (None, "one two three four five", "b"), (5, "same words here now then", "b"),
        (5, "same words here now then", "b"), (6, "same words here now then", None), (7, "é 😀 " * 4000, "a")]


def docs_of(spark, rows=EDGE):
    """Documents with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    return df.select("*", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("n"), F.lit(2).alias("key"), F.lit(3).alias("size"),
                     F.lit(4).alias("node"), F.lit(5).alias("g"), F.lit(6).alias("bucket"))


def components_of(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


# -- connected components and MinHash

def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = components_of([p for p in links if p[0] != p[1]])
    assert got == want


def test_least_neighbours_of_a_hot_node(spark):
    edges = [(5, i) for i in range(6, 3000)] + [(5, 2), (7, 1), (9, 9)]
    got = {(r["u"], r["v"]): r["m"] for r in components.with_least(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(u, v): {5: 2, 7: 1, 9: 9}[u] for u, v in edges}


def test_block_forest_spans_the_links():
    rng = np.random.default_rng(0)
    xs, ys = np.arange(40), np.arange(30, 80)
    links = rng.random((40, 50)) < 0.03
    want = components_of([(int(xs[i]), int(ys[j])) for i, j in zip(*np.nonzero(links)) if xs[i] != ys[j]])
    got = components_of([tuple(map(int, e)) for e in components.block_forest(*np.nonzero(links), xs, ys)])
    assert got == want


def near_copies(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    base = [word() for _ in range(150)]
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 90):      # a family around the threshold, copies, and strangers
        w = list(base) if i < 60 else [word() for _ in range(120)]
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8]) if i < 60 else 0):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w), "s"))
    return rows


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, k, num, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = near_copies() + [(1001, None, None), (1002, "", "a"), (1003, " \t\n", "a")]
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = components_of(links)
    shape = {"bands": 24, "rows": 6} if num == 85 else {}
    got = minhash.near_duplicates(docs_of(spark, rows), k=k, threshold=(num, 100), **shape).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), want.get(i, i)), i


def test_near_duplicates_edges(spark):
    got = minhash.near_duplicates(docs_of(spark)).collect()
    assert len(got) == len(EDGE)
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert {r["n_shingles"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_near_duplicates_of_ids_with_two_texts(spark):
    long = lambda c: " ".join(f"{c}{i}" for i in range(40))
    rows = [(1, long("p"), "s"), (5, long("p") + " end", "s"), (5, long("q"), "s"), (9, long("q") + " end", "s"), (None, long("r"), "s"), (12, long("r") + " end", "s"),
            (None, long("t"), "s"), (None, long("t") + " end", "s")]
    rows += [(20 + i, f"{long('u')} {i}", "s") for i in range(6)] + [(20 + i, f"{long('v')} {i}", "s") for i in range(6)]
    want = [1, 1, 5, 5, 12, 12, None, None] + [20] * 12
    got = minhash.duplicate_classes(docs_of(spark, rows)).collect()
    key = lambda i, t: (i, hashlib.md5(t.encode()).digest())
    found = {(r["doc_id"], bytes(r["digest"])): r for r in got}
    assert len(got) == len(found) == len(rows)
    assert [found[key(i, t)]["component_id"] for i, t, _ in rows] == want
    classes = [found[key(i, t)]["class"] for i, t, _ in rows]
    assert [len(set(classes[a:b])) for a, b in ((0, 2), (2, 4), (4, 6), (6, 8), (8, 14), (14, 20))] == [1] * 6 and len(set(classes)) == 6


def test_shared_counts():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    assert (minhash.shared_counts(sets[:5], sets[5:]) == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()


# -- mixing

@pytest.mark.parametrize("sizes, at_once", [({"a": 10, "b": 1000, "c": 40, "d": 7, None: 300, "e": 0}, 1 << 22),
                                            ({None: 90} | {f"host{i}": i * i * i % 997 * (1 + 40 * (i % 9 == 0)) for i in range(400)}, 500)])
def test_targets_follow_the_resharing_rule(spark, monkeypatch, sizes, at_once):
    monkeypatch.setattr(mixing, "SOURCE_BYTES", at_once)
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    order_ = sorted([s for s in sizes if s is not None]) + [None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order_)}
    total, target, full = 1.5 * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else left * w[s] / sum(w[x] for x in sizes if x not in full) for s in sizes}
        above = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    assert got == pytest.approx(target)


def test_mixture_is_near_its_targets_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 60), "xyz"[min(2, int(rng.random() * 4))]) for i in range(3000)]
    docs = docs_of(spark, rows)
    got = mixing.mix_units(docs).collect()
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix_units(docs.repartition(7)).collect()}
    assert len(got) == len(rows) and {(r["doc_id"], r["copies"]) for r in got} == again
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 61
    assert mixing.mix_sources(docs).count() == sum(r["copies"] for r in got)


def test_mixture_of_many_equal_rows(spark):
    rows = [(None, "w " * 10, "s")] * 1000 + [(None, "w " * 3, "t")] * 1000 + [(i, "w " * 5, "u") for i in range(400)]
    docs = docs_of(spark, rows)
    got = mixing.mix_units(docs).collect()
    assert sum(r["m"] for r in got) == len(rows)
    for s in "stu":
        mine = [r for r in got if r["source"] == s]
        taken = sum(r["m"] * r["copies"] * r["size"] for r in mine)
        assert abs(taken - mine[0]["target"]) <= mine[0]["size"] and {r["copies"] for r in mine} <= {0, 1, 2}
    want = collections.Counter()
    for r in got:
        want[r["doc_id"], r["source"]] += r["m"] * r["copies"]
    have = collections.Counter((r["doc_id"], r["source"]) for r in mixing.mix_sources(docs).collect())
    assert have == +want


def test_mixture_with_filters_that_tell_little(spark, monkeypatch):
    from featherloom.llm import bits

    monkeypatch.setattr(bits, "bitmap_size", lambda rows, most: 64)
    rng = random.Random(5)
    docs = docs_of(spark, [(i // 2, "w " * rng.randrange(0, 9), "xyz"[i % 3] if i % 7 else None) for i in range(600)])
    want = collections.Counter()
    for r in mixing.mix_units(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["m"] * r["copies"]
    have = collections.Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.mix_sources(docs).collect())
    assert have == +want


def test_mixture_edges(spark):
    docs = docs_of(spark)
    got = mixing.mix_units(docs).collect()
    assert sum(r["m"] for r in got) == len(EDGE)
    assert mixing.mix_sources(docs).columns == docs.columns
    assert mixing.mix_units(docs_of(spark, [])).count() == 0


# -- toxicity

def test_nnpu_finds_hidden_positives():
    rng = np.random.default_rng(0)
    rows, truth = [], []
    for i in range(3000):
        toxic = rng.random() < 0.15
        f = set(rng.integers(1000, 3000, 40).tolist()) | ({int(rng.integers(0, 12))} if toxic else set())
        rows.append(np.array(sorted(f), np.uint32))
        truth.append(toxic)
    truth = np.array(truth)
    labelled = truth & (rng.random(3000) < 0.5)
    buckets, w, b = toxicity.fit_nnpu(rows, labelled, 0.15)
    weights = np.zeros(1 << toxicity.BITS)
    weights[buckets] = w
    g = np.array([weights[r].sum() + b for r in rows])
    hidden, clean = g[truth & ~labelled], g[~truth]
    assert (hidden[:, None] > clean[None, :]).mean() > 0.97


def test_toxicity_on_held_out_documents(spark):
    got = queries.QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert auc > 0.85
    assert sum(n >= 0.7 for n in neg) <= 0.05 * len(neg)


def test_toxicity_learns_one_row_of_an_id(spark):
    rows = [(i, "awful dreadful words" if i % 4 == 0 else "kind quiet words", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    once = toxicity.score_toxicity(docs_of(spark, rows), labels).select("doc_id", "score").distinct().collect()
    again = toxicity.score_toxicity(docs_of(spark, rows + [rows[7]] * 500 + [rows[8]] * 500), labels)
    assert again.count() == 1200
    # the prior and the drawn ids do not follow the repeats
    assert {r["doc_id"]: round(r["score"], 9) for r in once} == {r["doc_id"]: round(r["score"], 9) for r in again.select("doc_id", "score").distinct().collect()}


def test_toxicity_edges(spark):
    docs = docs_of(spark)
    labels = spark.createDataFrame([(5, 1), (5, 0), (2, 0), (None, 1), (7, None)], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, labels, carry=True)
    assert got.select("row.*").columns == docs.columns
    assert got.count() == len(EDGE) and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(docs, labels.where("false")).agg(F.max("score")).first()[0] == 0
    assert toxicity.score_toxicity(docs_of(spark, []), labels).count() == 0


# -- token shards

def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 1000, 70_000):
        assert sorted(order.feistel(np.arange(n), n, 9)) == list(range(n))
    assert (order.feistel(np.arange(1000), 1000, 1) != order.feistel(np.arange(1000), 1000, 2)).any()


def test_shards_give_every_sequence_back(spark, tmp_path):
    ranks = order.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = docs_of(spark)
    n = order.write_shards(docs, ranks, public_tokenizers.PATTERN, str(tmp_path / "s"), length=16, per_shard=32)
    rows = order.read_shards(spark, str(tmp_path / "s")).collect()
    assert sorted(r["slot"] for r in rows) == list(range(n))
    want = collections.Counter()
    for i, t, _ in EDGE:
        ids = coder.encode_ordinary(t) if t else []
        for p in range(0, len(ids), 16):
            piece = ids[p : p + 16]
            want[i, p // 16, len(piece), np.array(piece + [len(ranks)] * (16 - len(piece)), "<u2").tobytes()] += 1
    assert collections.Counter((r["doc_id"], r["part"], r["n_tokens"], bytes(r["ids"])) for r in rows) == want
    assert all(r["byte_offset"] == r["slot"] % 32 * 32 and r["shard"] == r["slot"] // 32 for r in rows)
    late = order.read_shards(spark, str(tmp_path / "s"), from_slot=n - 5).collect()
    assert sorted(r["slot"] for r in late) == list(range(n - 5, n))
    assert order.write_shards(docs_of(spark, []), ranks, public_tokenizers.PATTERN, str(tmp_path / "e")) == 0


# -- substring deduplication

def test_word_hashes_tell_thue_morse_words_apart(spark):
    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    for n in (256, 512, 1024, 2048, 4096):
        assert WordHasher().one(a[:n].encode())[0] != WordHasher().one(b[:n].encode())[0]
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {a[:512]}", "s"), (2, f"{same} {b[:512]}", "s")]
    assert [r["n_removed"] for r in substring.remove_repeats(docs_of(spark, rows)).collect()] == [0, 0]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    powers = (parsing.Powers(), parsing.Powers(parsing.BASE2))
    part = rng.integers(0, 1 << 63, 90).astype(np.uint64)
    for size in (3, 50, 1 << 40):     # from runs and loops to texts without repeats
        part = rng.integers(0, size, 90).astype(np.uint64)
        texts = [np.concatenate([rng.integers(0, size, a).astype(np.uint64), part, rng.integers(0, size, b).astype(np.uint64)]) for a, b in ((0, 7), (40, 0), (13, 60))]
        seen = {}
        for t in texts:
            w = parsing.Windows(t, 35, powers)
            for i in range(len(t) - 34):
                assert seen.setdefault(t[i : i + 35].tobytes(), (w.anchor[i], w.whole[i])) == (w.anchor[i], w.whole[i])


def test_repeats_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcd", k=2))
    passage = [word() for _ in range(60)]
    rows = [(100 + i, " ".join([word() for _ in range(rng.randrange(80))] + passage[rng.randrange(20) : 60 - rng.randrange(10)] + [word() for _ in range(30)]), "s") for i in range(40)]
    rows += [(150, "ha " * 90, "s"), (151, "x  " + " ".join(passage) + "\n y", "s"), (152, rows[0][1], "s"), (153, " ".join([word() for _ in range(40)] * 2), "s"), *EDGE]
    count = collections.Counter()
    words = [(t or "").encode().split() for _, t, _ in rows]
    for w in words:
        count.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = collections.Counter()
    for (i, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    got = substring.remove_repeats(docs_of(spark, rows)).drop("kept").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0


def test_repeats_of_null_and_repeated_ids(spark):
    run = lambda c, n=50: " ".join(f"{c}{i}" for i in range(n))
    texts = [(1, f"{run('a')} {run('k', 9)}"), (None, f"x {run('a')}"), (5, f"{run('b')} {run('l', 9)}"), (5, f"{run('b')} {run('m', 12)}"), (5, run("c", 70)), (None, run("d", 80)), (None, run("d", 80))]
    want = [(1, 59, 50), (None, 51, 50), (5, 59, 50), (5, 62, 50), (5, 70, 0), (None, 80, 80), (None, 80, 80)]
    left = [run("k", 9), "x", run("l", 9), run("m", 12), run("c", 70), "", ""]
    got = substring.remove_repeats(docs_of(spark, [(i, t, "s") for i, t in texts])).drop("kept").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter((*w, hashlib.sha256(k.encode()).hexdigest()) for w, k in zip(want, left, strict=True))


# -- vectors

def vectors(spark, n=500):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, 16))
    x[100:160] = x[0] + 0.35 * rng.standard_normal((60, 16))
    x[160:170] = x[1] * np.arange(1, 11)[:, None]
    x[170:180] = x[2]
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 1), (905, [1.0, 2.0], 1)]
    return x, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node int").withColumn("v", F.lit(1)).withColumn("key", F.lit(2))


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 60)
    monkeypatch.setattr(cells, "BLOCK_BYTES", 16 * 8 * 40)
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    want = components_of([(int(a), int(b)) for a, b in zip(*np.nonzero(links)) if a < b])
    got = {r["vec_id"]: r for r in cells.near_vectors(df).collect()}
    assert len(got) == len(x) + 6
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (links[i].sum() - 1, want.get(i, i)), i
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(900, 906))
    assert cells.near_vectors(df.where("false")).count() == 0


def test_near_vectors_of_low_rank_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL", 25)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 4)) @ rng.standard_normal((4, 64)) + 0.05 * rng.standard_normal((1500, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    want = components_of([(int(a), int(b)) for a, b in zip(*np.nonzero(links)) if a < b])
    got = cells.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(i, links[i].sum() - 1, want.get(i, i)) for i in range(len(x))]


def test_nearest_recall_and_scores(spark):
    x, df = vectors(spark)
    got = onebit.nearest(df, df.where(F.col("vec_id") % 10 == 0)).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = u @ u.T
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert r["score"] == pytest.approx(cos[r["query_id"], r["vec_id"]], abs=1e-12)
        found[r["query_id"]].append(r["vec_id"])
    hit = total = 0
    for q in range(0, len(x), 10):
        order_ = [i for i in np.lexsort((np.arange(len(x)), -np.round(cos[q], 12))) if i != q][:5]
        hit, total = hit + len(set(order_) & set(found[q])), total + 5
    assert hit / total >= 0.99 and set(found) == set(range(0, len(x), 10))
    assert onebit.nearest(df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id < 3")
    assert onebit.nearest(few, few).count() == 6


# -- BPE

@pytest.mark.parametrize("tile", [1 << 26, 1 << 10])
def test_nearest_of_repeated_ids(spark, monkeypatch, tile):
    monkeypatch.setattr(onebit, "TILE_BYTES", tile)
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.standard_normal(8).tolist()) for i in rng.integers(0, 60, 300)] + [(3, None)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in onebit.nearest(frame, frame.where("vec_id % 10 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = rows[:-1]
    assert set(got) == {i for i, _ in rows if i % 10 == 0}
    for q, found in got.items():
        best = {}
        for i, x in rows:
            for j, y in rows:
                if i == q and j != q:
                    c = float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
                    best[j] = max(c, best.get(j, -2.0))
        want = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:5]
        found.sort()
        assert [(k + 1, v) for k, (v, _) in enumerate(want)] == [(k, v) for k, v, _ in found]
        assert np.allclose([s for _, s in want], [s for _, _, s in found])


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    ref = Reference.from_file(path)
    rng = random.Random(0)
    bits = ["'s", "'ll", "ΑΣ", " Σ", "İ", "é", "é", "<|endoftext|>", "<|startoftext|>", "<|", "\xa0", " ", "😀", "1", "²", "a", "Hello", "th", "\n", "...", "ß", "Ⅷ"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(400)] + ["x" * 5000, None, "", "aé" * 300]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    coder = bpe.Tokenizer(spark, path).fit(docs, words=20)
    assert coder.lexicon
    assert {(r["doc_id"], r["decoded"]) for r in coder.encode(docs, decoded="decoded").collect()} == {(r["doc_id"], r["decoded"]) for r in coder.decode(coder.encode(docs)).collect()}
    for r in coder.decode(coder.encode(docs)).collect():
        ids = ref.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == ref.decode(ids, skip_special_tokens=False)
    assert coder.encode(docs_of(spark, [])).count() == 0


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(1)
    words = {"".join(rng.choices("ab", k=rng.randint(1, 9))).encode(): [rng.randrange(9) for _ in range(rng.randint(1, 3))] for _ in range(300)}
    blob = bpe.compile_lexicon(words)
    (tmp_path / "l").write_bytes(blob)
    lex = bpe.Lexicon(str(tmp_path / "l"))
    assert all(lex.get(w) == ids for w, ids in words.items())
    assert all(lex.get(w) is None for w in (b"", b"c", b"a" * 30) if w not in words)
    rights = {w[i:]: None for w in words for i in range(len(w) + 1)}
    languages = {frozenset(r for r in rights if p + r in words) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(lex.end) == len(languages)       # one state for each set of endings


def test_long_pieces_merge_like_short_ones():
    m = bpe.Merger(json.load(open(public_tokenizers.path("word_bpe_49k.json"))))
    rng = random.Random(6)
    for _ in range(200):
        w = "".join(rng.choices("abdehilnorst", k=rng.randint(2, 40)))
        sym = [m.letters[b] for b in w.encode()]
        sym[-1] += m.suffix
        short = m._merge_short(sym)
        old, bpe.SHORT = bpe.SHORT, 0
        try:
            assert m.merge(w) == short
        finally:
            bpe.SHORT = old


# -- HTML

@pytest.fixture(scope="module")
def field():
    return html.trained_field()


def test_field_on_unseen_layouts(field):
    right = total = 0
    for blocks, gold in html.labelled_pages(80, seed=321):
        right += sum(a == b for a, b in zip(field.decode(blocks), gold, strict=True))
        total += len(gold)
    assert right / total > 0.98


def test_viterbi_is_the_best_path(field):
    import itertools

    blocks = html.labelled_pages(6, seed=9)[3][0][:9]
    s = field.scores(blocks)
    value = lambda y: field.start[y[0]] + sum(s[k][v] for k, v in enumerate(y)) + sum(field.step[a][b] for a, b in zip(y, y[1:]))
    best = max(itertools.product((0, 1), repeat=len(blocks)), key=value)
    assert value(field.decode(blocks)) == pytest.approx(value(best))


def test_article_of_pages(spark, field):
    page = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>"
            "<article><h1>Head&nbsp;line &amp; more</h1><p>One\n two.<p>Three &lt;b&gt; four.<br></article><form><label>Mail</label></form><footer>&copy; x</footer>")
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (3, None, ""), (4, "u", "<<< < > &")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(rows.withColumn("text", F.lit("old")), field=field).collect()}
    assert got[1] == "Head line & more\nOne two.\nThree <b> four."
    assert got[2] == got[3] == ""
    assert html.extract_main_text(rows.where("false"), field=field).count() == 0


def test_article_keeps_formulas_listings_and_plain_holders(field):
    text = "<p>The river rose slowly over the old mill and nobody knew why it had done so.</p><p>Later that week the water fell again, and people went home.</p>"
    plain = "The river rose slowly over the old mill and nobody knew why it had done so.\nLater that week the water fell again, and people went home."
    page = ("<article><p>We know <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here.</p><noscript><p>A paragraph for readers without scripts, kept as it is.</p></noscript>"
            "<xmp>if a &lt; <b> then</xmp><p>An <svg><text>axis</text></svg> label.<select><option>no</option></select></p><p>Open <math><mi>y</p><p>Next one here.</p></article>")
    assert html.main_text(page, field) == ("We know x=2 holds here.\nA paragraph for readers without scripts, kept as it is.\nif a &lt; <b> then\n"
                                           "An axis label.\nOpen y\nNext one here.")
    menu, foot = "<nav><ul><li><a href=x>Home</a></li></ul></nav>", "<footer>&copy; x</footer>"
    assert html.main_text(f"<body>{menu}<div class='wrap'><div class='xyz'>{text}</div></div>{foot}</body>", field) == plain
    assert html.main_text(f"<body>{menu}<div class='zz'>{text}</div><div id='disqus_thread'><p>I like this very much, thanks.</p></div></body>", field) == plain


def test_deep_pages_need_memory_for_their_tags_only(field):
    blocks = html.leaf_blocks("<div>x" * 100_000)
    assert len(blocks) == 100_000 and len(field.decode(blocks)) == 100_000
    assert blocks[7].path is blocks[8].path.parent and html.path_features(blocks[-1].path) == ["any", "leaf div", "tag div"]


def test_pages_of_the_table(spark):
    import html as entities

    got = queries.QUERIES["op8_html_main_text"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


# -- personal data

def base_spans(t):
    luhn = lambda d: sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, t or "") if ok(m[0])]


def test_spans_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a@b.co_x@y.z 1.2.3.4.5.6.7.8 ", "00000255.1.1.1 256.1.1.1 4111 1111-1111 1111", "+1 (234) 567-8901, +49.12 é😀 x@y.de" * 3, "a@b.c@d.e.f",
             "12 x a@b.cd " * 900, "a" * 100_000, "1 " * 20_000]
    texts += ["".join(rng.choices("0123456789..@@ab-_+ ( )é😀4111 ", k=rng.randrange(120))) for _ in range(600)]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in pii.find_pii(docs).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in ("email", "ip", "card", "phone")] == base_spans(texts[r["doc_id"]]), r["doc_id"]
    assert pii.find_pii(docs_of(spark, [])).count() == 0


def test_checksums_context_and_masks(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 end", "GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "lot 123-45-6789", "mail me@x.org or 4111111111111111", None, "plain"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    found = {r["doc_id"]: r["pii"] for r in pii.find_pii(docs).collect()}
    assert [s["kind"] for s in found[0]] == ["iban"] and not [s for s in found[1] if s["kind"] == "iban"]
    assert [s["kind"] for s in found[2]] == ["ssn"] and not found[3]
    masked = {r["doc_id"]: r["text"] for r in pii.mask_pii(docs).collect()}
    assert masked == {0: "IBAN [IBAN] end", 1: texts[1], 2: "ssn [SSN]", 3: texts[3], 4: "mail [EMAIL] or [CARD]", 5: None, 6: "plain"}


# -- the pipeline and the registry

@pytest.mark.parametrize("slots", [None, 64])
def test_keep_one_leaves_one_row_of_each_class(spark, monkeypatch, slots):
    from featherloom.llm import bits

    if slots:
        monkeypatch.setattr(bits, "bitmap_size", lambda rows, most: slots)
    texts = [t for t in near_copies() if t]
    rows = [(i // 2 if i % 5 == 0 else i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s")] * 3 + [(None, texts[4], "t"), (None, None, "t"), (9, "", "s"), (9, "", "s")]
    docs = docs_of(spark, rows)
    by = {}
    for r in minhash.duplicate_classes(docs).collect():
        by.setdefault(r["class"], []).append((r["doc_id"], bytes(r["digest"]) if r["digest"] is not None else None))
    digest = lambda t: None if t is None else hashlib.md5(t.encode()).digest()
    want = collections.Counter(min(v, key=lambda x: (x[0] is None, x[0] or 0, x[1])) for c, v in by.items() if c is not None) + collections.Counter(by.get(None, []))
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], digest(r["text"])) for r in kept.collect()) == want
    assert minhash.keep_one(docs.where("false")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for name, stage in c.STAGES:
        docs = c.written(stage(spark, docs, FOLDER), f"test-{name}")
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        if name != "bpe":
            assert docs.columns == list(c.COLUMNS)
        if name == "near-duplicates":
            left = minhash.near_duplicates(docs).where("doc_id <> component_id").count()
            assert left == 0
        if name == "personal-data":
            assert not [r for r in docs.collect() if base_spans(re.sub(r"\[[A-Z]+\]", "|", r["text"] or ""))]
    assert all(b <= a for a, b in zip(seen, seen[1:])) and seen[-1]
    assert len(c.STAGES) == 5


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as c

    long = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(1, long("p"), "s"), (5, long("p"), "s"), (5, long("q"), "s"), (9, long("q") + " end", "s"), (None, long("r"), "s"), (12, long("r"), "s"), (30, long("w"), "s"),
            (None, long("t"), "s"), (None, long("t"), "u"), (7, long("v"), "s"), (7, long("v"), "s"), (7, long("v"), None), (8, None, "s"), (8, None, "s"), (None, " ", "s")]
    got = [(r["doc_id"], (r["text"] or " ").split(" ")[0]) for r in c.drop_near_duplicates(spark, docs_of(spark, rows), FOLDER).collect()]
    assert collections.Counter(got) == collections.Counter([(1, "p0"), (5, "q0"), (12, "r0"), (None, "t0"), (7, "v0"), (30, "w0"), (8, ""), (8, ""), (None, "")])


def test_pipeline_edges(spark):
    import corpus_pipeline as c

    for docs in (docs_of(spark), docs_of(spark, [])):
        for name, stage in c.STAGES:
            docs = c.written(stage(spark, docs, FOLDER), f"edge-{name}")


def test_one_query_for_each_operator():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert base64 and set(queries.CHECKS) <= set(queries.QUERIES)
