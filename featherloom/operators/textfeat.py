"""Token counts, vocabularies, bag of words, sequences and n-gram TF-IDF in long form.

For TF-IDF the compact text is shuffled by document key into slices of bounded size, which a task counts in numpy; only the
distinct terms of a slice meet the vocabulary. They move in buckets by a hash, sorted and compressed, a row for each slice and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from featherloom.functions.arrays import fit_length
from featherloom.functions.textrules import W, tokens
from featherloom.operators.columns import with_row
from featherloom.operators.encode import frequency_codes
from featherloom.operators.filters import keep_words
from featherloom.operators.relations import one_per_key
from featherloom.session import input_bytes, stored

# fixed values: Unicode scripts counted by the census
SCRIPTS = (
    "Arabic", "Armenian", "Bengali", "Bopomofo", "Braille", "Buhid", "Canadian_Aboriginal", "Cherokee",
    "Cyrillic", "Devanagari", "Ethiopic", "Georgian", "Greek", "Gujarati", "Gurmukhi", "Han", "Hangul",
    "Hanunoo", "Hebrew", "Hiragana", "Inherited", "Kannada", "Katakana", "Khmer", "Lao", "Latin", "Limbu",
    "Malayalam", "Mongolian", "Myanmar", "Ogham", "Oriya", "Runic", "Sinhala", "Syriac", "Tagalog",
    "Tagbanwa", "Tai_Le", "Tamil", "Telugu", "Thaana", "Thai", "Tibetan", "Yi", "Common",
)


def script_census(df: DataFrame, text: str, scripts: Sequence[str] = SCRIPTS) -> DataFrame:
    """Characters and documents per Unicode script.

    The script patterns only see distinct characters: those of the corpus with their counts, and the
    character set of each document.
    """
    in_script = lambda c, s: F.col(c).rlike(rf"\p{{Is{s}}}")
    chars = df.select(F.explode(F.split(text, "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    totals = chars.agg(*[F.coalesce(F.sum(F.when(in_script("c", s), F.col("n"))), F.lit(0)).alias(f"c_{s}") for s in scripts])
    sets = df.select(F.array_join(F.array_distinct(F.split(text, "")), "").alias("d"))
    docs = sets.agg(*[F.count_if(in_script("d", s)).alias(f"d_{s}") for s in scripts])
    row = totals.crossJoin(F.broadcast(docs))  # one row each
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(s).alias("script"), F.col(f"c_{s}").alias("chars"), F.col(f"d_{s}").alias("docs")) for s in scripts])))


def word_frequency(df: DataFrame, words: Column, threshold: int, stop_words: Sequence[str] = ()) -> DataFrame:
    """Words occurring more than ``threshold`` times, without numbers, measures and stop words."""
    kept = keep_words(df.select(F.explode(words).alias("word")), "word", list(stop_words) or [""])
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)


def word_counts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(word, n, keys, ns) of the blank-separated words of a text, as ``tokens`` cuts them: a row for each word of a slice, with the keys that have it
    and how often; written once for whoever reads it.

    A text moves once, whole, into a slice of bounded size; a task cuts and counts a slice in numpy, and only a slice's distinct words are rows.
    """
    parts = _slice_parts(df)
    dealt = df.select(key, text.alias("_text")).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition(parts, "_s")

    def count(table: pa.Table) -> pa.Table:
        lists = pc.ascii_split_whitespace(table.column("_text").combine_chunks())
        words = pc.list_flatten(lists)
        full = pc.not_equal(words, "")        # before and behind outer blanks
        row = pc.list_parent_indices(lists).filter(full).to_numpy()
        ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(lists)))), pa.int32())
        cut = pa.table([table.column(key), pa.ListArray.from_arrays(ends, words.filter(full))], [key, "_units"])
        (keys, owner, word, n, listed), = _counted(cut, key, "word", (1, 1))
        order = np.argsort(word, kind="stable")
        ends = pa.array(np.append(0, np.cumsum(np.bincount(word, minlength=len(listed)))), pa.int32())
        totals = np.bincount(word, weights=n, minlength=len(listed)).astype(np.int64)
        return pa.table([listed, pa.array(totals), pa.ListArray.from_arrays(ends, keys.take(pa.array(owner[order]))), pa.ListArray.from_arrays(ends, pa.array(n[order]))], ["word", "n", "keys", "ns"])

    return stored(dealt.groupBy("_s").applyInArrow(count, f"word string, n bigint, keys array<{dict(df.dtypes)[key]}>, ns array<bigint>"), "word-counts")


def bag_of_words(df: DataFrame, key: str, words: Column | None, vocabulary: DataFrame) -> DataFrame:
    """(key, idx, n) for the words of a vocabulary table (word, code). Without ``words``, ``df`` holds the ``word_counts``."""
    listed = stored(vocabulary.select("word", F.col("code").alias("idx")), "vocabulary")      # its size is known: a small one is broadcast, and counts stay where they are
    if words is None:
        pairs = F.inline(F.arrays_zip(F.col("keys").alias(key), F.col("ns").alias("n"))).alias(key, "n")
        return df.join(listed, "word").select("idx", pairs).select(key, "idx", "n")
    counts = df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(listed, "word").select(key, "idx", "n")


SLICE_BYTES = 4 << 20     # stored bytes of a partition whose texts become arrays of tokens


def _looked_up(df: DataFrame, key: str, words: Column, table: DataFrame) -> DataFrame:
    """(key, _lists, _found): the word lists of all rows of a key, and the map from their words to the values of ``table`` (word, value),
    which lists a word once. Only a key's distinct words meet the table; a text moves once, whole."""
    parts = _slice_parts(df)
    lists = df.repartition(parts, key).select(key, words.alias("_ws")).groupBy(key).agg(F.collect_list(F.struct("_ws")).alias("_lists"))
    distinct = lists.select(key, F.explode(F.array_distinct(F.flatten(F.filter("_lists._ws", lambda x: x.isNotNull())))).alias("word"))
    found = distinct.join(table.select("word", "value"), "word").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("_found"))
    return lists.join(found.hint("shuffle_hash"), key, "left")


def _slice_parts(df: DataFrame) -> int:
    """Partitions of a bounded share of the input, a few megabytes as it is stored; where its size is not known, as many as shuffles have."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return max(least, math.ceil(size / SLICE_BYTES)) if size < 1 << 48 else least


def _in_order(lists: Column, place: Callable[[Column], Column]) -> Column:
    """One list of all lists of a key: by position, then by value, as rows of the same key are merged."""
    placed = F.flatten(F.transform(F.filter(lists, lambda x: x["_ws"].isNotNull()), lambda x: F.transform(x["_ws"], lambda w, i: F.named_struct(F.lit("pos"), i, F.lit("v"), place(w)))))
    merged = F.transform(F.array_sort(placed), lambda x: x["v"])
    return F.when(F.size(lists) == 1, F.transform(F.coalesce(F.get(lists, F.lit(0))["_ws"], F.array().cast("array<string>")), place)).otherwise(merged)


def map_tokens_by_join(df: DataFrame, key: str, text: str, table: DataFrame, word: str, canonical: str) -> DataFrame:
    """Replace tokens through a table of any size, keeping their order; a null text stays null. Of a word listed twice the
    smaller replacement counts."""
    names = one_per_key(table.select(F.col(word).alias("word"), F.col(canonical).alias("value")), ["word"], "value").where("value is not null")
    looked = _looked_up(df.select(key, text), key, tokens(text), names)
    mapped = F.array_join(_in_order(F.col("_lists"), lambda w: F.coalesce(F.col("_found")[w], w)), " ")
    whole = looked.select(key, F.explode("_lists._ws").alias("_ws"), F.when(F.col(key).isNull(), F.lit("")).otherwise(mapped).alias("_mapped"))
    return whole.select(key, F.when(F.col("_ws").isNotNull(), F.col("_mapped")).alias(text))


# fixed value: characters that separate tokens; ! and ? stay part of the text
TOKEN_FILTER = "\"#$%&()*+,-./:;<=>@[\\]^_`{|}~\t\n"


def index_tokens(text: Column | str) -> Column:
    """Lower-cased tokens split at blanks after the filter characters are blanked."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.translate(F.lower(t), TOKEN_FILTER, " " * len(TOKEN_FILTER)), " "), lambda w: w != "")


def char_tokens(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), ""), lambda c: c != "")


def fit_token_index(df: DataFrame, words: Column, cap: int | None = None) -> DataFrame:
    """(word, code), code 1 for the most frequent word. With ``cap`` only codes below it are used."""
    codes = frequency_codes(df.select(F.explode(words).alias("word")), "word", start=1)
    return codes if cap is None else codes.where(F.col("code") < cap)


def id_sequences(df: DataFrame, key: str, words: Column, index: DataFrame, length: int, side: str = "pre") -> DataFrame:
    """Token ids in order, unknown words dropped, padded and cut to ``length``."""
    looked = _looked_up(df, key, words, index.select("word", F.col("code").alias("value")))
    codes = F.filter(_in_order(F.col("_lists"), lambda w: F.col("_found")[w]), lambda x: x.isNotNull())
    none = F.array().cast("array<bigint>")
    ids = F.when(F.col(key).isNull(), none).otherwise(F.coalesce(codes, none))
    each = looked.select(key, ids.alias("_ids"), F.explode("_lists").alias("_l"))
    return each.select(key, fit_length(F.col("_ids"), length, F.lit(0).cast("long"), side).alias("ids"))


# -- n-grams and TF-IDF ------------------------------------------------------------------------

WORD_TOKEN = f"{W}{{2,}}"   # runs of two or more word characters


def word_list(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(t), F.lit(WORD_TOKEN), F.lit(0))


def n_grams(text: Column | str, analyzer: str, n: int) -> Column:
    """All n-grams of a text. A look-ahead captures the gram while the match consumes one unit, so
    the work is linear in the text, however long it is.

    ``word``: runs of two or more word characters, joined by a blank. ``char``: characters of the
    lower-cased text with blank runs as one blank. ``token_char``: characters inside each
    blank-separated token (for ``#word#`` padded text).
    """
    t = F.col(text) if isinstance(text, str) else text
    if analyzer == "word":
        if n == 1:
            return word_list(t)
        source = F.array_join(word_list(t), " ")
        pattern = rf"(?=([^ ]+(?: [^ ]+){{{n - 1}}}))[^ ]+ ?"
    elif analyzer == "char":
        source = F.regexp_replace(F.lower(t), r"\s\s+", " ")
        pattern = rf"(?s)(?=(.{{{n}}}))."
    elif analyzer == "token_char":
        source, pattern = t, rf"(?=(\S{{{n}}}))\S"
    else:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    return F.regexp_extract_all(source, F.lit(pattern), F.lit(1))


SLICE_TEXT = {"word": 8 << 20, "char": 4 << 20, "token_char": 4 << 20}        # bytes of text that a task counts at once
BUCKET_TEXT = {"word": 16 << 20, "char": 64 << 20, "token_char": 64 << 20}    # bytes of text whose distinct terms are a bucket, which a task holds
FINER = 2      # where operators work in slices, a task holds more than the weights, so slices are as many times smaller
_BLANKS = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def _slices(df: DataFrame, key: str, text: str, analyzer: str, n: int) -> DataFrame:
    """(_s, key, _units): rows dealt into ``n`` slices by key, all rows of a key in one, with words or the text to take characters from."""
    if analyzer not in SLICE_TEXT:
        raise ValueError(f"unknown analyzer {analyzer!r}")
    units = {"word": word_list(text), "char": F.regexp_replace(F.lower(text), r"\s\s+", " "), "token_char": F.col(text)}[analyzer]
    dealt = df.select(key, text).where(F.col(text).isNotNull()).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    return dealt.repartition(n, "_s").select("_s", key, units.alias("_units"))


def _sizes(df: DataFrame, text: str, analyzer: str) -> tuple[int, int, int]:
    """(slices, buckets of terms, rows) of a frame: one scan."""
    size, rows = df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count(F.lit(1))).first()
    slices = max(math.ceil(size / SLICE_TEXT[analyzer]), df.sparkSession.sparkContext.defaultParallelism)
    return slices, max(math.ceil(size / BUCKET_TEXT[analyzer]), min(slices, df.sparkSession.sparkContext.defaultParallelism)), rows


def _codes(units: pa.Array, analyzer: str) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
    """(row, code, words) of all units in order; the code of a character is its code point, and blanks are -1 for ``token_char``."""
    if analyzer == "word":
        coded = pc.list_flatten(units).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy().astype(np.int64)
        return pc.list_parent_indices(units).to_numpy(), _ranks(order)[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))
    texts = units.to_pylist()
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return row, np.where(np.isin(points, _BLANKS), -1, points.astype(np.int64)) if analyzer == "token_char" else points.astype(np.int64), None


def _ranks(order: np.ndarray) -> np.ndarray:
    """The place of each item in an order."""
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values as equal numbers from 0, in their order, and how many there are."""
    coded = pa.array(values).dictionary_encode()
    return _ranks(np.argsort(coded.dictionary.to_numpy()))[coded.indices.to_numpy()], len(coded.dictionary)


def _counted(table: pa.Table, key: str, analyzer: str, sizes: tuple[int, int]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
    """(distinct keys, key number, term number, count, terms) of the n-grams of a slice, for each n of the closed range ``sizes``;
    the terms in the order of their units."""
    units = table.column("_units").combine_chunks()
    keys = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode")
    row, code, words = _codes(units, analyzer)
    owner = keys.indices.to_numpy()[row].astype(np.int64)
    base, most = _numbered(code)
    at, gram, some = np.arange(len(code)), base, most
    for n in range(1, sizes[1] + 1):
        if n > 1:      # a gram starts where the units that it needs stand in the same row
            at, gram = at[: max(len(code) - n + 1, 0)], gram[: max(len(code) - n + 1, 0)]
            keep = row[at] == row[at + n - 1]
            gram, _ = _numbered(np.where(keep, gram * most + base[at + n - 1], -1))
        else:
            keep = np.ones(len(code), bool)
        if analyzer == "token_char":
            keep = keep & (code[at + n - 1] >= 0) & (code[at] >= 0)
            for i in range(1, n - 1):
                keep &= code[at + i] >= 0
        if n < sizes[0]:
            continue
        here = at[keep]
        term, some = _numbered(gram[keep])
        starts = np.empty(some, np.int64)
        starts[term] = here          # any place of a term tells its units
        pair, count = np.unique(owner[here] * max(some, 1) + term, return_counts=True)
        if words is not None:
            parts = [words.take(pa.array(code[starts + i])) for i in range(n)]
            terms = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
        else:
            points = code[starts[:, None] + np.arange(n)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            terms = pa.array([points[i : i + n] for i in range(0, len(points), n)], pa.string())
        yield keys.dictionary, pair // max(some, 1), pair % max(some, 1), count, terms


def _term_schema(df: DataFrame, key: str, value: str) -> str:
    return f"`{key}` {dict(df.dtypes)[key]}, term string, {value}"


def term_counts(df: DataFrame, key: str, text: str, analyzer: str = "word", n: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, term, tf) for all n-gram lengths in the closed range ``n``.

    The text is shuffled once by key, before the n-grams multiply it, into slices of bounded size; a task counts one slice in numpy.
    """
    def count(table: pa.Table) -> pa.Table:
        found = [pa.table([keys.take(pa.array(owner)), terms.take(pa.array(term)), pa.array(tf)], [key, "term", "tf"]) for keys, owner, term, tf, terms in _counted(table, key, analyzer, n)]
        return pa.concat_tables(found)

    return _slices(df, key, text, analyzer, _sizes(df, text, analyzer)[0]).groupBy("_s").applyInArrow(count, _term_schema(df, key, "tf bigint"))


# -- packed terms: what slices and buckets of terms send to one another, as compressed bytes

_SEPARATOR = 0xFF     # stands in no UTF-8
_TURN = np.uint64(0x9E3779B97F4A7C15)
_HASHED = 1 << 20     # bytes of terms that are hashed at a time


def _pressed(values: bytes | np.ndarray) -> bytes:
    data = values if isinstance(values, bytes) else values.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _opened(value: bytes) -> bytes:
    return pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)


def _bytes_of(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ends from 0 on, bytes) of terms without nulls."""
    buffers = terms.buffers()
    ends = np.frombuffer(buffers[1], np.int32)[terms.offset : terms.offset + len(terms) + 1] if len(terms) else np.zeros(1, np.int32)
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return ends.astype(np.int64) - ends[0], data


def _terms_packed(terms: pa.Array) -> bytes:
    """Terms one after the other, each with a separator behind it."""
    ends, data = _bytes_of(terms)
    return _pressed(np.insert(data, ends[1:], _SEPARATOR))


def _terms_unpacked(value: bytes) -> pa.Array:
    data = np.frombuffer(_opened(value), np.uint8)
    at = np.flatnonzero(data == _SEPARATOR)
    ends = np.append(0, at - np.arange(len(at))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.delete(data, at)))


def _numbers_unpacked(value: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(_opened(value), kind)


def _bucket(terms: pa.Array, buckets: int) -> np.ndarray:
    """The bucket of each term, by a hash of its bytes only."""
    ends, data = _bytes_of(terms)
    sums = np.zeros(len(terms), np.uint64)
    for lo in range(0, len(data), _HASHED):
        part = data[lo : lo + _HASHED]
        first, last = np.searchsorted(ends, lo, "right") - 1, np.searchsorted(ends, lo + len(part), "left")
        starts = np.maximum(ends[first:last], lo) - lo                # terms that have bytes here, or none at all
        place = np.arange(lo, lo + len(part)) - np.repeat(ends[first:last], np.diff(np.append(starts, len(part))))
        with np.errstate(over="ignore"):
            mixed = (part.astype(np.uint64) + np.uint64(1)) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _TURN)
            mixed ^= mixed >> np.uint64(29)
            totals = np.append(np.uint64(0), np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64))
            sums[first:last] += totals[np.append(starts[1:], len(part))] - totals[starts]
    sums ^= sums >> np.uint64(32)
    with np.errstate(over="ignore"):
        return ((sums * _TURN) >> np.uint64(33)).astype(np.int64) % buckets


def _dealt(terms: pa.Array, buckets: int, **numbers: np.ndarray) -> Iterator[tuple[int, pa.Array, dict[str, np.ndarray]]]:
    """(bucket, its terms, their numbers) of each bucket that has terms, in the order in which the terms come."""
    bucket = _bucket(terms, buckets)
    order = np.argsort(bucket, kind="stable")
    terms, bucket, numbers = terms.take(pa.array(order)), bucket[order], {c: x[order] for c, x in numbers.items()}
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for lo, hi in zip(starts, np.append(starts[1:], len(bucket))):
        yield int(bucket[lo]), terms.slice(lo, hi - lo), {c: x[lo:hi] for c, x in numbers.items()}


def slice_terms(df: DataFrame, key: str, text: str, analyzer: str, n: tuple[int, int], slices: int, buckets: int | None = None) -> DataFrame:
    """(_s, _b, terms, dfs, tfs): the distinct terms of each slice by bucket, with the keys and the occurrences that it has of them, packed."""
    buckets = buckets or slices

    def count(table: pa.Table) -> pa.Table:
        parts = [(terms, np.bincount(term, minlength=len(terms)), np.bincount(term, weights=tf, minlength=len(terms))) for _, _, term, tf, terms in _counted(table, key, analyzer, n)]
        terms, dfs, tfs = pa.concat_arrays([p[0] for p in parts]), *(np.concatenate([p[i] for p in parts]).astype("<u4") for i in (1, 2))
        del parts
        rows = [(b, _terms_packed(some), _pressed(x["df"]), _pressed(x["tf"])) for b, some, x in _dealt(terms, buckets, df=dfs, tf=tfs)]
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(np.full(len(rows), table.column("_s")[0].as_py()), pa.int32()), *[pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]], ["_s", "_b", "terms", "dfs", "tfs"])

    return _slices(df, key, text, analyzer, slices).groupBy("_s").applyInArrow(count, "_s int, _b int, terms binary, dfs binary, tfs binary")


KNOWN = "_s int, _b int, terms binary, idf binary, dfs binary, tfs binary"      # packed terms that a slice (or, at -1, the vocabulary) has in a bucket


def _known(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["_s", "_b", "terms", "idf", "dfs", "tfs"])


def _bucket_terms(table: pa.Table) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(ends of the rows, terms of all rows as numbers of distinct ones) of packed terms."""
    lists = [_terms_unpacked(x) for x in table.column("terms").to_pylist()]
    return np.append(0, np.cumsum([len(x) for x in lists])), pa.concat_arrays(lists).dictionary_encode()


def _vocabulary(known: DataFrame) -> DataFrame:
    """(term, df, corpus_tf, idf) of the vocabulary's rows."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, idf, dfs, tfs in zip(*(batch.column(c).to_pylist() for c in ("terms", "idf", "dfs", "tfs")), strict=True):
                yield pa.RecordBatch.from_arrays([_terms_unpacked(terms), *[pa.array(_numbers_unpacked(x, kind)) for x, kind in ((dfs, "<i8"), (tfs, "<i8"), (idf, "<f8"))]], ["term", "df", "corpus_tf", "idf"])

    return known.where("_s = -1").select("terms", "idf", "dfs", "tfs").mapInArrow(unpack, "term string, df bigint, corpus_tf bigint, idf double")


def bucketed(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """(_b, terms, numbers): rows (term, value) packed by bucket in the tasks that make them."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            found = [(b, _terms_packed(some), _pressed(x["x"])) for b, some, x in _dealt(table.column("term").combine_chunks(), buckets, x=table.column("x").to_numpy().astype("<f8"))]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["_b", "terms", "numbers"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 20:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return rows.where("term is not null").select("term", F.col(value).cast("double").alias("x")).mapInArrow(pack, "_b int, terms binary, numbers binary")


def _met(packed: DataFrame, listed: DataFrame, schema: str, found: Callable[[pa.Table, np.ndarray, pa.Array, np.ndarray], pa.Table]) -> DataFrame:
    """Packed rows (_s, _b, terms, ...) and ``bucketed`` ones, bucket by bucket: ``found`` gets the former, their ends, the place of each of their
    terms among the latter (null for none), and the numbers of those."""
    def meet(table: pa.Table, other: pa.Table) -> pa.Table:
        ends, terms = _bucket_terms(table) if table.num_rows else (np.zeros(1, int), pa.array([], pa.string()).dictionary_encode())
        values = [_terms_unpacked(x) for x in other.column("terms").to_pylist()]
        numbers = [_numbers_unpacked(x, "<f8") for x in other.column("numbers").to_pylist()]
        listed = pa.concat_arrays(values) if values else pa.array([], pa.string())
        if pc.count_distinct(listed).as_py() < len(listed):
            raise ValueError("a term is listed twice")
        place = pc.index_in(terms.dictionary, value_set=listed)
        return found(table, ends, place.take(terms.indices), np.concatenate(numbers) if numbers else np.zeros(0))

    return packed.groupBy("_b").cogroup(listed.groupBy("_b")).applyInArrow(meet, schema)


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary (term, idf) with the options that its counts need."""

    vocabulary: DataFrame
    analyzer: str
    n: tuple[int, int]
    sublinear: bool
    binary: bool

    def weigher(self, key: str) -> Callable[[pa.Table, pa.Table], Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]]]:
        """For a task, from a slice and what it knows: (distinct keys, key number, term number, terms, weight) of its kept terms, for each n; rows have length 1."""
        analyzer, n, sublinear, binary = self.analyzer, self.n, self.sublinear, self.binary

        def weights(table: pa.Table, known: pa.Table) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
            lists = [_terms_unpacked(x) for x in known.column("terms").to_pylist()]
            listed = pa.concat_arrays(lists) if lists else pa.array([], pa.string())
            idf = np.concatenate([np.zeros(0), *[_numbers_unpacked(x, "<f8") for x in known.column("idf").to_pylist()]])
            found = []
            for keys, owner, term, tf, terms in _counted(table, key, analyzer, n):
                place = pc.index_in(terms, value_set=listed).fill_null(-1).to_numpy().astype(np.int64)
                here = place[term] >= 0
                owner, term, tf = owner[here], term[here], np.ones(here.sum()) if binary else tf[here].astype(float)
                kept = np.flatnonzero(place >= 0)
                number = np.full(len(place), -1)
                number[kept] = np.arange(len(kept))
                found.append((keys, owner, number[term], terms.take(pa.array(kept)), (1 + np.log(tf) if sublinear else tf) * idf[place[term]]))
            squares = sum(np.bincount(owner, weights=w * w, minlength=len(keys)) for keys, owner, _, _, w in found)
            for keys, owner, term, terms, w in found:
                yield keys, owner, term, terms, w / np.sqrt(squares[owner])

        return weights

    def fit_slices(self, df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
        """(known, slices): what the slices of another frame have of this vocabulary."""
        slices, buckets, _ = _sizes(df, text, self.analyzer)

        def found(table: pa.Table, ends: np.ndarray, place: pa.Array, idf: np.ndarray) -> pa.Table:
            rows = []
            for i, (s, b, terms) in enumerate(zip(*(table.column(c).to_pylist() for c in ("_s", "_b", "terms")), strict=True)):
                own = place.slice(ends[i], ends[i + 1] - ends[i])
                here = pc.is_valid(own)
                rows.append((s, b, _terms_packed(_terms_unpacked(terms).filter(here)), _pressed(idf[own.filter(here).to_numpy()]), None, None))
            return _known(rows)

        return _met(slice_terms(df, key, text, self.analyzer, self.n, slices, buckets), bucketed(self.vocabulary, "idf", buckets), KNOWN, found), slices

    def transform(self, df: DataFrame, key: str, text: str, known: DataFrame | None = None, slices: int | None = None) -> DataFrame:
        """(key, term, w) with L2-normalised rows.

        The vocabulary meets the distinct terms of each slice, not the counts of each document, and what a slice knows comes back to
        it; the counts are then made anew from the slice's text and never shuffled. ``known`` is what the ``slices`` of ``df`` know.
        """
        if known is None:
            known, slices = self.fit_slices(df, key, text)
        weights = self.weigher(key)

        def weigh(table: pa.Table, known: pa.Table) -> pa.Table:
            return pa.concat_tables([pa.table([keys.take(pa.array(owner)), terms.take(pa.array(term)), pa.array(w)], [key, "term", "w"]) for keys, owner, term, terms, w in weights(table, known)])

        sent = known.where("_s >= 0").select("_s", "terms", "idf")
        return _slices(df, key, text, self.analyzer, slices).groupBy("_s").cogroup(sent.groupBy("_s")).applyInArrow(weigh, _term_schema(df, key, "w double"))


def _fitted(df: DataFrame, key: str, text: str, analyzer: str, n: tuple[int, int], min_df: int, max_df: float, max_features: int | None, sublinear: bool, binary: bool, finer: int = 1) -> tuple[TfidfModel, DataFrame, int, int]:
    """The model, the slices' share of its vocabulary, and the numbers of slices and buckets. A bucket answers each slice with the terms of its own that are kept."""
    slices, buckets, docs = _sizes(df, text, analyzer)
    slices, buckets = slices * finer, buckets * finer

    def merge(table: pa.Table) -> pa.Table:
        ends, terms = _bucket_terms(table)
        at, size = terms.indices.to_numpy(), len(terms.dictionary)
        totals = [np.bincount(at, weights=np.concatenate([_numbers_unpacked(x, "<u4") for x in table.column(c).to_pylist()]), minlength=size).astype("<i8") for c in ("dfs", "tfs")]
        idf = np.log((1.0 + docs) / (1.0 + totals[0])) + 1
        keep = (totals[0] >= min_df) & (totals[0] <= docs * max_df)
        b, rows = table.column("_b")[0].as_py(), []
        if keep.any():
            rows.append((-1, b, _terms_packed(terms.dictionary.filter(pa.array(keep))), _pressed(idf[keep]), *[_pressed(x[keep]) for x in totals]))
        for i, s in enumerate(table.column("_s").to_pylist()):
            own = at[ends[i] : ends[i + 1]]
            own = own[keep[own]]
            if len(own):
                rows.append((s, b, _terms_packed(terms.dictionary.take(pa.array(own))), _pressed(idf[own]), None, None if max_features is None else _pressed(totals[1][own])))
        return _known(rows)

    known = stored(slice_terms(df, key, text, analyzer, n, slices, buckets).groupBy("_b").applyInArrow(merge, KNOWN), "slice-terms")
    vocabulary = _vocabulary(known)
    if max_features is not None:
        vocabulary = stored(top_terms(vocabulary, max_features), "vocabulary")
        last = vocabulary.orderBy("corpus_tf", F.col("term").desc()).first()
        known = known.where("_s >= 0").mapInArrow(_leading(*(last["corpus_tf"], last["term"]) if last else (1 << 62, "")), KNOWN)
    return TfidfModel(vocabulary, analyzer, n, sublinear, binary), known, slices, buckets


def _leading(least: int, last: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed terms of a corpus frequency above ``least``, or equal to it and no later than ``last``."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for s, b, packed, idf, tfs in zip(*(batch.column(c).to_pylist() for c in ("_s", "_b", "terms", "idf", "tfs")), strict=True):
                terms, tf = _terms_unpacked(packed), _numbers_unpacked(tfs, "<i8")
                keep = (tf > least) | ((tf == least) & pc.less_equal(terms, last).to_numpy(zero_copy_only=False))
                rows.append((s, b, _terms_packed(terms.filter(pa.array(keep))), _pressed(_numbers_unpacked(idf, "<f8")[keep]), None, None))
            yield from _known(rows).to_batches()

    return cut


def fit_tfidf(df: DataFrame, key: str, text: str, *, analyzer: str = "word", n: tuple[int, int] = (1, 1),
              min_df: int = 1, max_df: float = 1.0, max_features: int | None = None,
              sublinear: bool = False, binary: bool = False) -> TfidfModel:
    """Smooth inverse document frequencies over all rows of ``df`` (train and test together)."""
    return _fitted(df, key, text, analyzer, n, min_df, max_df, max_features, sublinear, binary)[0]


@dataclass(frozen=True)
class Sliced:
    """TF-IDF rows (key, term, w) that are not made: the texts, what their slices know, and how to weigh them."""

    model: TfidfModel
    texts: DataFrame
    key: str
    text: str
    known: DataFrame
    slices: int
    buckets: int

    def rows(self) -> DataFrame:
        return self.model.transform(self.texts, self.key, self.text, self.known, self.slices)

    def dealt(self) -> DataFrame:
        return _slices(self.texts, self.key, self.text, self.model.analyzer, self.slices)

    def meets(self, other: DataFrame, key: str) -> bool:
        """Whether equal keys of ``other`` are dealt to the same slice, which a hash of equal types says."""
        kind = dict(self.texts.dtypes)[self.key]
        return key == self.key and dict(other.dtypes)[key] == kind and kind in ("bigint", "int", "string")


def fit_transform_tfidf(df: DataFrame, key: str, text: str, *, analyzer: str = "word", n: tuple[int, int] = (1, 1), min_df: int = 1, max_df: float = 1.0,
                        max_features: int | None = None, sublinear: bool = False, binary: bool = False, only: DataFrame | None = None, sliced: bool = False) -> tuple[TfidfModel, DataFrame | Sliced]:
    """Fit and transform the same rows; ``only`` is a table of the keys whose rows are wanted, the others are fitted on and not transformed.

    With ``sliced`` the rows stay in their slices, for operators that take them so.
    """
    model, known, slices, buckets = _fitted(df, key, text, analyzer, n, min_df, max_df, max_features, sublinear, binary, FINER if sliced else 1)
    wanted = df if only is None else df.select(key, text).join(only.select(key), key, "left_semi")
    made = Sliced(model, wanted, key, text, known, slices, buckets)
    return model, made if sliced else made.rows()


def union_terms(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Several vectorisers as one feature set: (key, term, w) of all parts, each term under its part's name."""
    named = [rows.select(key, F.concat(F.lit(f"{name}:"), "term").alias("term"), "w") for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, named)


def top_terms(terms: DataFrame, k: int) -> DataFrame:
    """The k terms with the highest corpus frequency (ties by term): a top-k, not a full sort."""
    return terms.orderBy(F.col("corpus_tf").desc(), F.col("term")).limit(k)


def log_count_ratio(rows: DataFrame | Sliced, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(term, r) with ``r = ln(((1 + sum x+) / (1 + n+)) / ((1 + sum x-) / (1 + n-)))``. Where rows are ``Sliced``, labels go to the slices, and sums of terms come back."""
    y = F.col(label) == 1
    sizes = labels.agg(F.count_if(y).alias("_np"), F.count_if(~y).alias("_nn"))
    if isinstance(rows, Sliced) and rows.meets(labels, key):
        sums = _label_sums(rows, labels, label)
    else:
        plain = rows.rows() if isinstance(rows, Sliced) else rows
        sums = plain.join(labels.select(key, label), key).groupBy("term").agg(
            F.sum(F.when(y, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(~y, F.col("w")).otherwise(0.0)).alias("q"))
    return with_row(sums, sizes).select("term", F.ln(
        ((1 + F.col("p")) / (1 + F.col("_np"))) / ((1 + F.col("q")) / (1 + F.col("_nn")))).alias("r"))


def _label_sums(rows: Sliced, labels: DataFrame, label: str) -> DataFrame:
    """(term, p, q): the weights of each term in documents with the label 1, and with another, once for each row of a document's labels."""
    key, kind, buckets, weights = rows.key, dict(rows.texts.dtypes)[rows.key], rows.buckets, rows.model.weigher(rows.key)
    y = F.col(label) == 1
    owned = labels.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(y).cast("double").alias("yes"), F.count_if(~y).cast("double").alias("no"))
    owned = owned.select(F.pmod(F.xxhash64(key), F.lit(rows.slices)).cast("int").alias("_s"), F.col(key).alias("_key"), "yes", "no")
    sent = rows.known.where("_s >= 0").select("_s", "terms", "idf").unionByName(owned, allowMissingColumns=True)

    def add(table: pa.Table, sent: pa.Table) -> pa.Table:
        owned = sent.filter(pc.is_valid(sent.column("_key")))
        names = owned.column("_key").combine_chunks()
        table = table.filter(pc.is_in(table.column(key), value_set=names))      # the others add nothing
        found = []
        for keys, owner, term, terms, w in weights(table, sent.filter(pc.is_valid(sent.column("terms")))):
            at = pc.index_in(keys, value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            p, q = (np.bincount(term, weights=w * owned.column(c).to_numpy()[at][owner], minlength=len(terms)) for c in ("yes", "no"))
            some = np.bincount(term, minlength=len(terms)) > 0
            found += [(b, _terms_packed(mine), _pressed(x["p"]), _pressed(x["q"])) for b, mine, x in _dealt(terms.filter(pa.array(some)), buckets, p=p[some], q=q[some])]
        return pa.table([pa.array([f[i] for f in found], pa.binary() if i else pa.int32()) for i in range(4)], ["_b", "terms", "p", "q"])

    def total(table: pa.Table) -> pa.Table:
        _, terms = _bucket_terms(table)
        sums = [np.bincount(terms.indices.to_numpy(), weights=np.concatenate([_numbers_unpacked(x, "<f8") for x in table.column(c).to_pylist()]), minlength=len(terms.dictionary)) for c in ("p", "q")]
        return pa.table([terms.dictionary, *[pa.array(x) for x in sums]], ["term", "p", "q"])

    added = rows.dealt().groupBy("_s").cogroup(sent.groupBy("_s")).applyInArrow(add, "_b int, terms binary, p binary, q binary")
    return added.groupBy("_b").applyInArrow(total, "term string, p double, q double")


def scale_by_ratio(rows: DataFrame | Sliced, ratio: DataFrame, key: str) -> DataFrame:
    """(key, term, w): rows times the ratio (term, r) of their term, without terms that have none. For ``Sliced`` rows, the ratio lists a term once."""
    if not isinstance(rows, Sliced):
        return rows.join(ratio, "term").select(key, "term", (F.col("w") * F.col("r")).alias("w"))
    weights = rows.model.weigher(rows.key)

    def found(table: pa.Table, ends: np.ndarray, place: pa.Array, r: np.ndarray) -> pa.Table:
        at, sent = place.fill_null(-1).to_numpy(), []
        for i, (s, terms, idf) in enumerate(zip(*(table.column(c).to_pylist() for c in ("_s", "terms", "idf")), strict=True)):
            own = at[ends[i] : ends[i + 1]]
            sent.append((s, terms, idf, _pressed((own >= 0).astype(np.uint8)), _pressed(r[own[own >= 0]])))
        return pa.table([pa.array([x[i] for x in sent], pa.binary() if i else pa.int32()) for i in range(5)], ["_s", "terms", "idf", "has", "r"])

    scaled = _met(rows.known.where("_s >= 0").select("_s", "_b", "terms", "idf"), bucketed(ratio, "r", rows.buckets), "_s int, terms binary, idf binary, has binary, r binary", found)

    def weigh(table: pa.Table, known: pa.Table) -> pa.Table:
        lists = [_terms_unpacked(t).filter(pa.array(_numbers_unpacked(h, "u1") > 0)) for t, h in zip(known.column("terms").to_pylist(), known.column("has").to_pylist(), strict=True)]
        listed = pa.concat_arrays(lists) if lists else pa.array([], pa.string())
        r, made = np.concatenate([np.zeros(0), *[_numbers_unpacked(x, "<f8") for x in known.column("r").to_pylist()]]), []
        for keys, owner, term, terms, w in weights(table, known):
            place = pc.index_in(terms, value_set=listed).fill_null(-1).to_numpy()
            here = place[term] >= 0
            owner, term, w = owner[here], term[here], w[here]
            made.append(pa.table([keys.take(pa.array(owner)), terms.take(pa.array(term)), pa.array(w * r[place[term]])], [key, "term", "w"]))
        return pa.concat_tables(made)

    return rows.dealt().groupBy("_s").cogroup(scaled.groupBy("_s")).applyInArrow(weigh, _term_schema(rows.texts, key, "w double"))


def group_terms(terms: DataFrame, key: str, term: str, categories: DataFrame, norms: DataFrame,
                unknown: str = "dummy_term") -> DataFrame:
    """(key, norm, terms): the terms of a record by normalised category; ``unknown`` otherwise."""
    return (
        terms.select(key, F.col(term).alias("term")).distinct()
        .join(one_per_key(categories.select(F.col("word").alias("term"), "category"), ["term"], "category"), "term", "left")
        .join(one_per_key(norms, ["category"], "norm"), "category", "left")
        .groupBy(key, F.coalesce("norm", F.lit(unknown)).alias("norm"))  # one record's distinct terms
        .agg(F.array_sort(F.collect_list("term")).alias("terms"))
    )
