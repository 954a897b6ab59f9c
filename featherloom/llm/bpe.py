"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Spark counts the pieces of all texts; the most frequent ones are merged once and compiled into an acyclic automaton that
shares prefixes and suffixes. Each edge carries how many words lie before it, so a walk ends in the word's number, and the
number in its token ids. The file goes to every executor through Spark and is memory-mapped by its workers. A piece that
the lexicon does not hold is merged there and then, by rank, so the size of the lexicon changes speed, never ids.

Cases: null text encodes to no ids and decodes to the empty text. Texts and pieces of any length are encoded whole (merging
uses a heap). Repeated rows, extra columns: every row keeps its columns and gets the new ones. No rows give no rows. Character classes are those of the installed ``regex``; code points first assigned in Unicode 17
can differ from a tokenizers build with older tables.
"""

from __future__ import annotations

import heapq
import json
import os
import struct
import tempfile
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from featherloom.llm.common import drop_written, release, written

LEXICON_WORDS = 120_000     # words of the lexicon at most; others are merged when met
SHORT = 48                  # symbols up to which merging scans instead of keeping a heap
LEXICON_LEAST = 3           # occurrences that make a word frequent
LEXICON_BYTES = 64          # longer words are left to merging
MEMO_WORDS = 500_000        # a worker's memo holds so many pieces
ROWS = 200


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    shown = set(prints)
    return [chr(b) if b in shown else chr(256 + next(rest)) for b in range(256)]


class Merger:
    """Exact merging of one piece, and the ways from a text to pieces and from ids to a text."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[str, str], int] = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split

    def normal(self, text: str) -> str:
        """NFC, then lower case letter by letter (a final sigma is not special)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Pieces in order; a special token is a piece of its own name, which no normal piece can be."""
        if not any(s in text for s in self.special):
            return self.find(self.normal(text))
        out: list[str] = []
        for part in self.cut(text):
            if part in self.special:
                out.append(part)
            else:
                out += self.find(self.normal(part))
        return out

    def merge(self, piece: str) -> list[int]:
        """Merge by rank, leftmost first, until no pair has a rank."""
        if piece in self.special:
            return [self.special[piece]]
        sym: list[str | None] = [self.letters[b] for b in piece.encode("utf-8", "surrogatepass")]
        sym[-1] += self.suffix
        n = len(sym)
        if n <= SHORT:
            return self._merge_short(sym)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue
            sym[i], sym[j] = left + right, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := self.rank.get((sym[a], sym[b]))) is not None:
                    heapq.heappush(heap, (r, a, sym[a], sym[b]))
        return [self.vocab[s] for s in sym if s is not None]

    def decode(self, codes: bytes | None) -> str:
        """Token strings joined by a blank, as a tokenizer file without a decoder asks."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(codes, "<u4").tolist())) if codes else ""

    def _merge_short(self, sym: list[str]) -> list[int]:
        """The same by scanning: for a dozen symbols the least of a list is quicker than a heap."""
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(pair, none) for pair in zip(sym, sym[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            sym[i : i + 2] = [sym[i] + sym[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((sym[i], sym[i + 1]), none)
            if i:
                ranks[i - 1] = rank((sym[i - 1], sym[i]), none)
        return [self.vocab[s] for s in sym]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The automaton of ``words`` (word to ids) as one block of bytes.

    Words are added in order; behind the part that a word shares with the one before it, states are final and replaced by an
    equal state that is already there, so equal suffixes are stored once.
    """
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]    # open states of the last word: is a word's end, [(label, state or None)]
    labels: list[int] = []

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            end, edges = path.pop()
            key = (end, tuple(edges))
            if (at := register.get(key)) is None:
                at = register[key] = len(states)
                states.append(key)
            path[-1][1].append((labels.pop(), at))

    order = sorted(words)
    for word in order:
        shared = 0
        while shared < len(labels) and shared < len(word) and labels[shared] == word[shared]:
            shared += 1
        close(shared)
        for b in word[shared:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    close(0)
    states.append((path[0][0], tuple(path[0][1])))
    below = np.zeros(len(states), np.int64)
    first, label, target, skip = [0], [], [], []
    for s, (end, edges) in enumerate(states):     # children come before their parents
        n = int(end)
        for b, to in edges:
            label.append(b)
            target.append(to)
            skip.append(n)
            n += int(below[to])
        below[s] = n
        first.append(len(label))
    ids = [words[w] for w in order]
    parts = [np.array([e for e, _ in states], np.uint8), np.array(first, np.uint32), np.array(label, np.uint8), np.array(target, np.uint32),
             np.array(skip, np.uint32), np.cumsum([0, *map(len, ids)]).astype(np.uint32), np.array([i for x in ids for i in x], np.uint32)]
    head = struct.pack("<7Q", *[len(p) for p in parts])
    body = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
    return head + body


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    KINDS = (np.uint8, np.uint32, np.uint8, np.uint32, np.uint32, np.uint32, np.uint32)

    def __init__(self, path: str):
        mapped = np.memmap(path, np.uint8, "r")
        sizes = struct.unpack("<7Q", mapped[:56].tobytes())
        at, parts = 56, []
        for n, kind in zip(sizes, self.KINDS, strict=True):
            nbytes = n * np.dtype(kind).itemsize
            parts.append(memoryview(mapped[at : at + nbytes].view(kind)))
            at += nbytes + -nbytes % 8
        self.end, self.first, self.label, self.target, self.skip, self.offset, self.ids = parts
        self.root = len(self.end) - 1

    def get(self, word: bytes) -> list[int] | None:
        state, number = self.root, 0
        for b in word:
            lo, hi = self.first[state], self.first[state + 1]
            while lo < hi:
                mid = (lo + hi) // 2
                if self.label[mid] < b:
                    lo = mid + 1
                else:
                    hi = mid
            if lo == self.first[state + 1] or self.label[lo] != b:
                return None
            number += self.skip[lo]
            state = self.target[lo]
        if not self.end[state]:
            return None
        return list(self.ids[self.offset[number] : self.offset[number + 1]])


class Memo(dict):
    """Ids of a piece as bytes: from the lexicon, else merged; of fixed size."""

    def __init__(self, merger: Merger, lexicon: Lexicon | None):
        super().__init__()
        self.merger, self.lexicon = merger, lexicon

    def __missing__(self, piece: str) -> bytes:
        ids = self.lexicon.get(piece.encode("utf-8", "surrogatepass")) if self.lexicon else None
        got = np.array(self.merger.merge(piece) if ids is None else ids, "<u4").tobytes()
        if len(piece) <= LEXICON_BYTES and len(self) < MEMO_WORDS:      # frequent pieces come early and stay
            self[piece] = got
        return got


_MEMOS: dict[str | None, Memo] = {}


def _worker_memo(model, lexicon: str | None) -> Memo:
    """The memo of a lexicon, which a worker keeps from task to task; one at a time."""
    if lexicon is None:
        return Memo(Merger(model.value), None)
    if lexicon not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[lexicon] = Memo(Merger(model.value), Lexicon(SparkFiles.get(lexicon)))
    return _MEMOS[lexicon]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list]]:
    for at in range(0, batch.num_rows, ROWS):
        n = min(ROWS, batch.num_rows - at)
        yield at, n, batch.column(batch.schema.get_field_index(name)).slice(at, n).to_pylist()


class Tokenizer:
    """A tokenizer file read on the driver (``path``), with a lexicon once ``fit`` has been called."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.spark, self.lexicon = spark, None
        self.model = spark.sparkContext.broadcast(self.spec)   # as large as the tokenizer's file

    def count_pieces(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(piece, n) over all texts; each task sums its own pieces first."""
        model = self.model

        def count(batches):
            from collections import Counter

            merger, seen = Merger(model.value), Counter()

            def out():
                rows = [(p, c) for p, c in seen.items() if len(p) <= LEXICON_BYTES]
                for at in range(0, len(rows), 20_000):
                    part = rows[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], ["piece", "n"])
                seen.clear()

            for batch in batches:
                for _, _, texts in _texts(batch, "text"):
                    for t in texts:
                        if t:
                            seen.update(merger.pieces(t))
                    if len(seen) > MEMO_WORDS:
                        yield from out()
            yield from out()
            release()

        only = docs.select(F.col(f"`{text}`").alias("text"))
        return only.mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))

    def fit(self, docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> "Tokenizer":
        """Compile the at most ``words`` most frequent pieces; the driver holds only these.

        Counts are cut at a power of 2 ** (1 / 16), found from how many pieces lie between two such powers, so that no more than
        ``words`` rows are ever collected from any number of tasks.
        """
        step = F.floor(F.log2("n") * 16)
        counts = written(self.count_pieces(docs, text).where(F.col("n") >= LEXICON_LEAST), "bpe-counts")
        cut, total = None, 0
        for row in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():      # 16 rows for each doubling
            total += row["count"]
            if total > words:
                break
            cut = row["s"]
        rows = counts.where(step >= cut).select("piece").collect() if cut is not None else []
        drop_written(counts)
        merger = Merger(self.spec)
        blob = compile_lexicon({w: merger.merge(r["piece"]) for r in rows if 0 < len(w := r["piece"].encode()) <= LEXICON_BYTES and r["piece"] not in merger.special})
        path = os.path.join(tempfile.mkdtemp(prefix="lexicon-"), f"lexicon-{uuid.uuid4().hex}.bin")
        with open(path, "wb") as f:
            f.write(blob)
        self.spark.sparkContext.addFile(path)    # Spark copies it to each executor, later ones too
        self.lexicon = os.path.basename(path)
        return self

    def encode(self, docs: DataFrame, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str | None = None) -> DataFrame:
        """Add ``ids`` (little-endian unsigned 32-bit integers, as binary) and ``count``; columns of these names are replaced.

        With ``decoded`` the ids are decoded again in the same pass, into a column of that name.
        """
        model, lexicon = self.model, self.lexicon
        new = {ids: BinaryType(), count: LongType()} | ({decoded: StringType()} if decoded else {})

        def run(batches):
            memo = _worker_memo(model, lexicon)
            merger = memo.merger
            for batch in batches:
                for at, n, texts in _texts(batch, text):
                    codes = [b"".join(map(memo.__getitem__, merger.pieces(t))) if t else b"" for t in texts]
                    out = {ids: pa.array(codes, pa.binary()), count: pa.array([len(c) // 4 for c in codes], pa.int64())}
                    if decoded:
                        out[decoded] = pa.array(map(merger.decode, codes), pa.string())
                    yield _with(batch.slice(at, n), out)
            release()

        return docs.mapInArrow(run, _schema(docs, new))

    def decode(self, rows: DataFrame, ids: str = "ids", into: str = "decoded") -> DataFrame:
        """Add the text of ``ids``; null gives an empty text."""
        model = self.model

        def run(batches):
            merger = Merger(model.value)
            for batch in batches:
                for at, n, codes in _texts(batch, ids):
                    yield _with(batch.slice(at, n), {into: pa.array(map(merger.decode, codes), pa.string())})

        return rows.mapInArrow(run, _schema(rows, {into: StringType()}))


def _schema(df: DataFrame, new: dict) -> StructType:
    return StructType([f for f in df.schema.fields if f.name not in new] + [StructField(k, t) for k, t in new.items()])


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in keep] + list(new.values()), [*keep, *new])
