"""Phrase collocations by stripes: each prefix of words keys an associative counter of the words that follow it.

Entries of a prefix's stripe are the frequencies of its extensions; the entry for its own last word, in the stripe of the prefix that is
one word shorter, is its total; its largest entry says whether an extension subsumes it. Stripes of the empty prefix count words; then
follow stripes of words, of pairs and of triples. Tasks count in numpy, on numbers that they give to the words they meet, and write a stripe
as one string; stripes of a prefix are merged entry by entry. Between the scans a bitmap of bounded size keeps what is frequent:
a phrase's parts are at least as frequent as it is, so nothing frequent is lost, and what passes by accident is counted and dropped. Very frequent
prefixes (there can be few) are cut into parts by the following word.

Cases: a null language is ``und``; null, empty and wordless texts add nothing; repeated rows count each time. Extra columns are
left alone. No rows give no rows. Counts are exact; scores are computed with decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from featherloom.llm.bits import bitmap_of, bitmap_size, in_bitmap
from featherloom.llm.common import drop_written, mix64, release, written

LONGEST = 4
TEXT = 16 << 20          # bytes of text that a task counts before it passes its stripes on
HOT = 4096               # words with at least 1 / HOT of all occurrences are hot, so there are at most HOT
CUTS = 64                # parts of a stripe whose prefix has hot words only
MOST_SLOTS = 1 << 28     # 32 MB
PARTS = 64               # parts in which a language's best are found

#: Fixed by the contract: A-Z become a-z, the tab a space, piece ends (. , ; : ! ? and LF, VT, FF, CR) one sign.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
STRIPE = "lang string, prefix string, part int, stripe string"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NEXT, CUT = 26, 6        # bits of a key for the following word's number and for the part


def numbered(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of a folded text as numbers, 0 for the end of a piece, with the name and the hash of each number."""
    cut = pc.list_flatten(pc.split_pattern(pa.array([text.replace(b"\n", b" \n ")], pa.large_binary()), b" "))
    coded = cut.dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    number = np.arange(1, len(names) + 1)
    for i, word in enumerate(names):
        if word == b"\n":
            number[i] = 0
        elif not word:
            number[i] = -1
    words = number[at]
    return words[words >= 0], pa.array([b"", *names], pa.binary()).cast(pa.string()), np.array([0, *map(xxhash.xxh64_intdigest, names)], np.uint64)


def _join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(left * MULTIPLIER + right)


class Filter:
    """Bitmaps of the words, pairs and triples that may be frequent, as far as they are known."""

    def __init__(self, *bitmaps: np.ndarray):
        self.bitmaps = bitmaps

    @staticmethod
    def slots(hashes: np.ndarray, lang: str, size: int) -> np.ndarray:
        """Slots of a language's phrases."""
        return _join_hash(hashes, np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))) & np.uint64(size - 1)

    def starts(self, words: np.ndarray, hashes: np.ndarray, lang: str, size: int) -> np.ndarray:
        """Where a run of size + 1 words starts, of which every part that a bitmap knows may be frequent."""
        at, joined = np.flatnonzero(words), None
        for k in range(size + 1):          # runs of k + 1 words, from those of k words
            if k:
                here = np.zeros(len(words) + 1, bool)
                here[at] = True
                on = here[at + 1]
                joined = _join_hash(joined[on], hashes[at[on] + k])
                at = at[on]
            else:
                joined = hashes[at]
            if k < len(self.bitmaps):
                may = in_bitmap(self.bitmaps[k], self.slots(joined, lang, len(self.bitmaps[k]) * 8))
                at, joined = at[may], joined[may]
        return at


def stripes_of(words: np.ndarray, at: np.ndarray, names: pa.Array, hashes: np.ndarray, hot: np.ndarray, lang: str, size: int) -> pa.RecordBatch:
    """Stripes of the prefixes of ``size`` words that start at the places ``at``; an entry is a word, and its count after a colon unless it is 1."""
    code, all_hot = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j in range(size):
        mine = words[at + j]
        all_hot &= hot[mine]
        code = np.unique(code << NEXT | mine, return_inverse=True)[1] if j else mine
    following = words[at + size]
    part = np.where(all_hot, (hashes[following] % np.uint64(CUTS)).astype(np.int64), 0)
    key, first, n = np.unique((code << CUT | part) << NEXT | following, return_index=True, return_counts=True)
    group = key >> NEXT
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(key) else np.empty(0, np.int64)
    entries, many = names.take(pa.array(following[first])), np.flatnonzero(n > 1)
    counted = pc.binary_join_element_wise(entries.take(pa.array(many)), pc.cast(pa.array(n[many]), pa.string()), ":")
    entries = pc.replace_with_mask(entries, pa.array(n > 1), counted)
    starts = at[first[head]]
    prefix = [names.take(pa.array(words[starts + j])) for j in range(size)]
    prefix = pc.binary_join_element_wise(*prefix, " ") if size else pa.array([""] * len(head), pa.string())
    stripe = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(head, len(key)), pa.int32()), entries), ",")
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(head), pa.string()), prefix, pa.array(group[head] & (CUTS - 1), pa.int32()), stripe], ["lang", "prefix", "part", "stripe"])


def count_stripes(docs: DataFrame, size: int, passed=None, hot: frozenset = frozenset(), name: str = "phrases") -> DataFrame:
    """Merged stripes of the prefixes of ``size`` words over rows (lang, text as binary): (lang, prefix, total, nexts, counts).

    ``passed`` is a broadcast ``Filter``. A cut stripe gives a row for each part; ``total`` is the sum of all its entries.
    """

    def count(batches):
        keep = passed.value if passed is not None else Filter()

        def out():
            for lang, texts in held.items():
                words, names, hashes = numbered(b"".join(texts))
                warm = pc.is_in(names, value_set=pa.array(sorted(hot), pa.string())).to_numpy(zero_copy_only=False)
                batch = stripes_of(words, keep.starts(words, hashes[words], lang, size), names, hashes, warm, lang, size)
                for at in range(0, batch.num_rows, 20_000):
                    yield batch.slice(at, 20_000)

        held, total = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text.translate(FOLD) + b"\n")
                    total += len(text)
                if total > TEXT:
                    yield from out()
                    held, total = {}, 0
        yield from out()
        release()

    key = ["lang", "prefix", "part"]
    dealt = docs.mapInArrow(count, STRIPE).withColumn("key", F.xxhash64(*key))
    dealt = dealt.repartition("key").sortWithinPartitions("key")
    return written(dealt.mapInArrow(merge_stripes, "lang string, prefix string, total bigint, nexts array<string>, counts array<bigint>"), name)


def merge_stripes(batches, least: int = 30) -> Iterator[pa.RecordBatch]:
    """Add up the stripes of each prefix; rows of one ``key`` follow each other. Entries under ``least`` only stay in the total.

    At most one batch and the stripes of one key, without repeats, are held.
    """
    key = ["key", "lang", "prefix", "part"]

    def flat(batch: pa.RecordBatch) -> pa.Table:
        entries = pc.split_pattern(batch.column("stripe"), ",")
        row, entry = pc.list_parent_indices(entries), pc.split_pattern(pc.list_flatten(entries), ":")
        many = pc.equal(pc.list_value_length(entry), 2)
        n = pc.replace_with_mask(pa.array(np.ones(len(entry), np.int64)), many, pc.cast(pc.list_element(entry.filter(many), 1), pa.int64()))
        return pa.table([pc.take(batch.column(k), row) for k in key] + [pc.list_element(entry, 0), n], [*key, "next", "n"])

    def added(t: pa.Table) -> pa.Table:
        return t.group_by([*key, "next"], use_threads=False).aggregate([("n", "sum")]).rename_columns([*key, "next", "n"])

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        codes = t.group_by(key, use_threads=False).aggregate([("n", "sum")])
        frequent = t.filter(pc.greater_equal(t.column("n"), least))
        if codes.num_rows == 0:
            return
        # stripes without a frequent entry only matter for their total, which only the empty prefix needs
        both = pa.concat_tables([frequent.select([*key, "next", "n"]), pa.table([*(codes.column(k) for k in key), pa.nulls(codes.num_rows, pa.string()), codes.column("n_sum")], [*key, "next", "n"])
                                 .filter(pc.or_(pc.equal(codes.column("prefix"), ""), pc.is_in(codes.column("key"), value_set=frequent.column("key").combine_chunks())))])
        both = both.sort_by([(k, "ascending") for k in key])
        if not both.num_rows:
            return
        cols = [both.column(k).combine_chunks() for k in key]
        new = np.ones(both.num_rows, bool)
        new[1:] = np.logical_or.reduce([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in cols])
        head = np.flatnonzero(new)
        n, following = both.column("n").to_numpy(), both.column("next").combine_chunks()
        keep = following.is_valid().to_numpy(zero_copy_only=False)
        ends = pa.array(np.append(0, np.cumsum(np.add.reduceat(keep, head, dtype=np.int64))), pa.int32())
        yield pa.RecordBatch.from_arrays([cols[1].take(pa.array(head)), cols[2].take(pa.array(head)), pa.array(np.add.reduceat(np.where(keep, 0, n), head)),
                                          pa.ListArray.from_arrays(ends, following.filter(pa.array(keep))), pa.ListArray.from_arrays(ends, pa.array(n[keep]))],
                                         ["lang", "prefix", "total", "nexts", "counts"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = added(flat(batch) if held is None else pa.concat_tables([held, flat(batch)]))
        same = pc.equal(now.column("key"), batch.column("key")[-1])      # the last key may go on in the next batch
        held = now.filter(same)
        yield from out(now.filter(pc.invert(same)))
    if held is not None:
        yield from out(held)
    release()


def _bitmap(spark, entries: DataFrame, most: int):
    """Bitmap of frequent words, pairs or triples from rows (lang, phrase)."""
    size = bitmap_size(entries.count(), most)

    def place(batches):
        for batch in batches:
            slots = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, *more = [np.array([xxhash.xxh64_intdigest(w)], np.uint64) for w in phrase.encode("utf-8", "surrogatepass").split(b" ")]
                for word in more:
                    first = _join_hash(first, word)
                slots.append(int(Filter.slots(first, lang, size)[0]))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], ["slot"])

    return bitmap_of(entries.select("lang", "phrase").mapInArrow(place, "slot bigint"), size)


def _entries(stripes: DataFrame) -> DataFrame:
    """(lang, prefix, phrase, words, n) of every frequent extension."""
    one = stripes.where(F.size("nexts") > 0).select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.nexts")).otherwise(F.concat_ws(" ", "prefix", "e.nexts"))
    return one.select("lang", "prefix", phrase.alias("phrase"), F.col("e.counts").alias("n"))


#: floor(scale * a / (l + r)) in decimals, as products pass 64 bits.
SCORE = "cast({scale} as decimal(18,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"


def _exact(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(38,0)")


def mine_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, best: int = 2000, scale: int = 2_000_000, cover: int = 80, most_slots: int = MOST_SLOTS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of 2 to 4 words of each language.

    The score of a cut is floor(scale * a / (l + r)); a phrase takes its lowest. A phrase that a frequent longer one covers in at
    least ``cover`` percent of its occurrences is dropped; as frequencies only fall with length, the longer ones by one word decide.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("binary").alias("text"))
    known = lambda *bitmaps: spark.sparkContext.broadcast(Filter(*bitmaps))

    empty = count_stripes(base, 0, name="phrases-words")                       # stripes of the empty prefix: word counts
    sizes = empty.groupBy("lang").agg(F.sum("total").alias("n"))
    words = _entries(empty).where(F.col("n") >= least)
    everything = sizes.agg(F.sum("n")).first()[0] or 0
    hot = frozenset(r["phrase"] for r in words.where(F.col("n") * HOT >= everything).select("phrase").distinct().collect())   # HOT rows at most
    found, frequent = [empty], [_bitmap(spark, words, most_slots)]
    for size in range(1, LONGEST):
        found.append(count_stripes(base, size, known(*frequent), hot, f"phrases-after{size}"))
        if size < LONGEST - 1:
            frequent.append(_bitmap(spark, _entries(found[-1]), most_slots))
    entries = _entries(found[0])
    for more in found[1:]:
        entries = entries.unionByName(_entries(more))
    found, made = written(entries.where(F.col("n") >= least), "phrases-found"), found
    drop_written(*made[1:])
    pieces = F.split("phrase", " ")
    candidates = found.where("prefix <> ''").withColumn("words", pieces)
    # subsumption: the largest entry of a phrase's own stripe, and of the stripes that extend it to the left
    right = candidates.where(F.size("words") > 2).select("lang", F.col("prefix").alias("phrase"), F.col("n").alias("most"))
    left = candidates.where(F.size("words") > 2).select("lang", F.array_join(F.slice("words", 2, LONGEST), " ").alias("phrase"), F.col("n").alias("most"))
    covers = right.unionByName(left).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    open_ones = candidates.join(covers, ["lang", "phrase"], "left").where(F.col("most").isNull() | (_exact("most") * 100 < _exact("n") * cover))
    cuts = open_ones.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("words", F.col("k") + 1, F.lit(LONGEST)), " ").alias("rest"))
    part = lambda of, n: found.select(F.col("lang"), F.col("phrase").alias(of), F.col("n").alias(n))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(SCORE.format(scale=scale)))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    within = Window.partitionBy("lang", "part").orderBy(*order)
    short = lowest.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= best)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)      # PARTS * best rows at most
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
