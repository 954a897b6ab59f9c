"""Exact duplicates, phrase stripes and the Merkle manifest against brute force, and their edge rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from featherloom.llm import bits, exact, merkle, phrases

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    """Documents, with extra columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(1).alias(n) for n in ("row", "n", "size", "head", "leaf", "tree", "pos", "part", "prefix", "claim", "digest", "open", "key", "block")])


def test_bitmap_is_right_at_its_ends(spark):
    slots = [0, 1, 7, 8, 32767, 32768, 65535]
    made = bits.bitmap_of(spark.createDataFrame([(s,) for s in slots * 2], "slot bigint"), 1 << 16)
    assert np.flatnonzero(bits.in_bitmap(made, np.arange(1 << 16))).tolist() == slots
    assert bits.bitmap_size(0, 1 << 28) == 1 << 16 and bits.bitmap_size(10**12, 1 << 28) == 1 << 28


# -- exact duplicates

def copies(seed):
    rng = random.Random(seed)
    rows = [(None, None, "en", None, None), (3, "", "en", "s", 0), (2, " \t\r\n\v\f", "en", "s", 6), (2, " \t\r\n\v\f", "en", "s", 6), (8, "\x1c\x85 ", "en", "s", 3)]
    texts = ["same words", "samewords", "same  words ", "é 😀" * 50, "é😀" * 50 + " ", "x" * 300 + "a", "x" * 300 + "b", "y" * 20000 + "\n" + "z", "y" * 20000 + "z"]
    for i in range(300):
        rows.append((rng.choice([None, *range(40)]), rng.choice(texts) if rng.random() < 0.7 else "w" * rng.randrange(1, 9) + str(i), "en", "s", 1))
    return rows


@pytest.mark.parametrize("most_slots", [1 << 28, 1 << 4])
def test_exact_duplicates_match_brute_force(spark, most_slots):
    rows = copies(4)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[ \t-\r]", "", r[1] or "")].append(r)
    want = Counter()
    for bare, mine in groups.items():
        first = min(mine, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept = [(len(r[1] or ""), r[0]) == (len(first[1] or ""), first[0]) for r in mine]
        assert any(kept)
        for i, r in enumerate(mine):
            want[r[0], first[0], len(mine), kept.index(True) == i, hashlib.sha256(bare.encode()).hexdigest()] += 1
    got = exact.exact_duplicates(frame(spark, rows).repartition(5), digests=True, most_slots=most_slots)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in got.collect()) == want


def test_exact_duplicates_hash_only_what_is_open(spark):
    rows = [(1, "a" * 10, "", "", 0), (2, "b" * 10, "", "", 0), (3, "c" * 11, "", "", 0), (4, "d d", "", "", 0), (5, "dd", "", "", 0)]
    got = {r["doc_id"]: (r["keep_id"], r["digest"] is not None) for r in exact.exact_duplicates(frame(spark, rows)).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, False), 4: (4, True), 5: (4, True)}
    assert exact.exact_duplicates(frame(spark, []), digests=True).count() == 0


# -- phrases

def brute_phrases(rows, least, best):
    f, words = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in rows:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            ws = re.findall("[^ \t]+", piece)
            words[lang or "und"] += len(ws)
            for k in (1, 2, 3, 4):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and within(p, q) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:best], 1):
            out.add((lang, rank, p.decode(), -a, left, right, words[lang], -s))
    return out


def chatter(seed, n=400):
    rng = random.Random(seed)
    vocab = ["the", "The", "of", "é", "a:b", "😀", "new", "york", "x\x1cy", "to", " ", "be", "city"]
    rows = [(None, None, None, None, 0), (1, "", "en", "", 0), (1, " \t.,;:!?\n\v\f\r ", "en", "", 0), (2, "lone", "fr", "", 0)]
    for i in range(n):
        ws = [rng.choice(vocab[: rng.randrange(1, len(vocab))]) for _ in range(rng.randrange(1, 30))]
        if rng.random() < 0.4:
            ws += ["new", "york", "city", "hall"]
        rows.append((i, rng.choice([" ", "  ", "\t", " . "]).join(ws), rng.choice(["en", "en", "de", None]), "", 0))
    return rows


@pytest.mark.parametrize("best, text, hot", [(2000, 16 << 20, 4096), (7, 500, 3)])
def test_phrases_match_brute_force(spark, monkeypatch, best, text, hot):
    monkeypatch.setattr(phrases, "TEXT", text)
    monkeypatch.setattr(phrases, "HOT", hot)
    rows = chatter(5) + [(9, "the " * 20000, "en", "", 0)]
    got = phrases.mine_phrases(frame(spark, rows).repartition(4), least=30, best=best, most_slots=1 << 16)
    assert {tuple(r) for r in got.collect()} == brute_phrases(rows, 30, best)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_of_nothing(spark):
    assert phrases.mine_phrases(frame(spark, [])).count() == 0
    assert phrases.mine_phrases(frame(spark, [(1, None, None, None, None)])).count() == 0


def test_stripes_merge_entry_by_entry_over_batches():
    rows = [(1, "en", "new", 0, "york:29,deal"), (1, "en", "new", 0, "york,deal:30"), (2, "en", "", 5, "a:3,b"), (2, "en", "", 5, "c:40")]
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()), ("stripe", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True))], schema) for r in rows]
    out = [r for b in phrases.merge_stripes(iter(batches)) for r in b.to_pylist()]
    assert [(r["prefix"], r["total"], dict(zip(r["nexts"], r["counts"], strict=True))) for r in out] == [("new", 61, {"york": 30, "deal": 31}), ("", 44, {"c": 40})]


def test_scores_of_counts_beyond_64_bits(spark):
    row = spark.range(1).select(F.lit(9_000_000_000_000).alias("a"), F.lit(9_000_000_000_001).alias("l"), F.lit(9_000_000_000_003).alias("r"))
    got = row.select(F.expr(phrases.SCORE.format(scale=2_000_000)).alias("s")).first()["s"]
    assert got == 2_000_000 * 9_000_000_000_000 // 18_000_000_000_004


# -- Merkle manifest

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    parts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def brute_tree(hashes):
    """Levels of a tree, from the leaves to its one node."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    """(left siblings, right siblings) up to the last node."""
    for level in levels[:-1]:
        at = i // 16 * 16
        yield "".join(level[at:i]), "".join(level[i + 1 : at + 16])
        i //= 16


def brute_manifest(rows, claim):
    sources = defaultdict(list)
    for r in rows:
        leaf = brute_leaf(r[0], r[3], r[2], r[4], r[1])
        sources[r[3]].append(((r[0] is not None, r[0] or 0), leaf, claim(r, leaf)))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([leaf for _, leaf, _ in sorted(sources[s])]) for s in names]
    top = brute_tree([t[-1][0] for t in trees])
    out = Counter()
    for j, s in enumerate(names):
        for i, ((has, doc_id), leaf, claimed) in enumerate(sorted(sources[s])):
            around = [*path(trees[j], i), *path(top, j)]
            node = claimed
            for left, right in around:
                node = sha(left + node + right)
            root = top[-1][0]
            out[doc_id if has else None, leaf, trees[j][-1][0], root, sha("".join(a + b for a, b in around)), node, node == root] += 1
    return out


def manifest_rows(seed, sources, n):
    rng = random.Random(seed)
    rows = [(None, None, None, None, None), (None, "", "", "", 0), (5, "Ab" * 9000, "en", "s1", 3), (5, "Ab", "en", "s1", 3), (5, "Ab", "en", "s1", 3), (-7, "é😀", None, "S1", 2)]
    return rows + [(i, f"Text {i}", "en", rng.choice(sources), i) for i in range(n)]


@pytest.mark.parametrize("sources, n, block", [(["s0"] * 8 + ["s1", "s2", "é"], 900, 4096), ([f"h{i}" for i in range(400)], 700, 37), (["one"], 300, 16), (["a", "b"], 40, 1)])
def test_manifest_matches_brute_force(spark, sources, n, block):
    rows = manifest_rows(n, sources, n)
    claimed = F.when(F.col("doc_id") % 3 == 0, merkle.leaf_hash(*[F.col(c) for c in merkle.FIELDS[:-1]], F.lower("text")))
    want = brute_manifest(rows, lambda r, leaf: brute_leaf(r[0], r[3], r[2], r[4], r[1].lower()) if r[0] is not None and r[0] % 3 == 0 else leaf)
    docs = frame(spark, rows).repartition(6)
    own = merkle.leaf_hash(*[F.col(c) for c in merkle.FIELDS])
    got = merkle.merkle_proofs(docs, F.coalesce(claimed, own), block=block)
    assert Counter(tuple(r) for r in got.collect()) == want


def test_manifest_of_one_row_and_of_none(spark):
    row = (1, "a", None, None, 1)
    got = merkle.merkle_proofs(frame(spark, [row])).collect()
    leaf = brute_leaf(1, None, None, 1, "a")
    assert [tuple(r) for r in got] == [(1, leaf, leaf, leaf, sha(""), leaf, True)]
    assert merkle.merkle_proofs(frame(spark, [])).count() == 0


def test_missing_nodes_are_the_least_union():
    assert merkle.missing_nodes(0, 299, 300) == [] and merkle.missing_nodes(0, 0, 1) == []
    assert merkle.missing_nodes(0, 15, 33) == [(1, 1), (1, 2)]
    assert merkle.missing_nodes(1, 14, 17) == [(0, 0), (0, 15), (1, 1)]


def test_a_match_of_very_many_labels_ends_no_task(spark):
    from featherloom.llm import pii

    text = "mail a@b" + ".c" * 200_000 + " 1" + ".1" * 400 + " +1" + "-1" * 20_000
    docs = frame(spark, [(1, text, "en", "s", 1)])
    spans = pii.find_pii(docs).first()["pii"]
    assert [(s["kind"], s["start"], s["end"]) for s in spans if s["kind"] == "email"] == [("email", 5, 8 + 400_000)]
    assert pii.mask_pii(docs).first()["text"].startswith("mail [EMAIL] ")
