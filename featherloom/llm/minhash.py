"""Near-duplicates by MinHash: universal hash minima in bands, a check of the signatures, a check of the full sets, components.

A document's set is its distinct k-word shingles, as 64-bit fingerprints. Documents with equal sets are one node from the start,
so a group of exact copies costs one row a band. Documents that share a band meet in a bucket, split further by set size (sets
of similarity s differ in size by s at most). In a bucket nothing is paired with everything: each member is compared with one
member drawn for that bucket, the confirmed links make components, and only members that are still in different components
of a bucket are compared directly: in small buckets as pairs, in larger ones block by block, as exact products in which
pairs are never rows. So a group of near copies costs about one pair a member, a family just under the
threshold gives next to none, and no link that the bands show is left out.

Cases: null, empty and blank texts have no set and link with nothing. A text with fewer words than a shingle is one shingle.
Links are between sets, whatever the ids: an id that stands with two texts may be in two components, and rows of null id link
like others. A component is named by its smallest id, null where it has none. Repeated rows come back as often as they stand.
No rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from featherloom.llm.bits import KeyFilter, KeyTest
from featherloom.llm.common import ODD, WordHasher, drop_written, mix64, release, text_digest, written
from featherloom.llm.components import SALTS, block_forest, connected_components

ROWS = 128
SMALL = 16       # members up to which a bucket's open pairs are listed at once
BLOCK, BLOCK_TOKENS = 192, 200_000      # members, and shingles, that a block of a larger bucket holds
SLICE = 4096     # tokens of the matrices that two blocks are multiplied by


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted fingerprints of the distinct k-word shingles of a text given by its word hashes."""
    if not len(h):
        return np.empty(0, np.uint64)
    width = min(k, len(h))     # fewer words than a shingle: all of them, told apart by their number
    out = np.full(len(h) - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mix64(out * ODD + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def hash_family(count: int, seed: int = 20240607) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and addends of ``count`` multiply-shift hashes over 64 bits."""
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2)
    return draw() + np.uint64(1), draw() + rng.integers(0, 2, count, dtype=np.uint64)


def minima(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash minima of non-empty sets, one row a set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(a)), np.uint64)
    buf = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for i in range(len(a)):
            np.multiply(flat, a[i], out=buf)
            np.add(buf, b[i], out=buf)
            out[:, i] = np.minimum.reduceat(buf, starts)
    return out


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, digest, n, key, bands, sig) of (doc_id, digest, text): set size, 128-bit digest of the set, band hashes, 16 bits of each minimum."""

    def run(batches):
        a, b = hash_family(bands * rows)
        hasher = WordHasher(lower=True)      # A-Z only; other letters stay
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingle_set(h, k) for h in hasher.each(part.column("text"))]
                full = [s for s in sets if len(s)]
                mins = minima(full, a, b) if full else np.empty((0, bands * rows), np.uint64)
                with np.errstate(over="ignore"):
                    joint = np.zeros((len(full), bands), np.uint64) + salt
                    for r in range(rows):
                        joint = mix64(joint * ODD + mins[:, r::rows])
                short = (mins >> np.uint64(48)).astype("<u2")
                it = iter(range(len(full)))
                cols = [[], [], []]
                for s in sets:
                    i = next(it) if len(s) else None
                    cols[0].append(None if i is None else xxhash.xxh3_128_digest(s.tobytes()))
                    cols[1].append(None if i is None else joint[i].view(np.int64))
                    cols[2].append(None if i is None else short[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cols[0], pa.binary()),
                     pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.binary())], ["doc_id", "digest", "n", "key", "bands", "sig"])
        release()

    return docs.mapInArrow(run, "doc_id bigint, digest binary, n bigint, key binary, bands array<bigint>, sig binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the whole sets of the nodes (node, key, row), 8 bytes a shingle, read again from the texts of (doc_id, digest, text)."""

    def run(batches):
        hasher = WordHasher(lower=True)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingle_set(h, k).tobytes() for h in hasher.each(part.column("text"))]
                same = pa.array([xxhash.xxh3_128_digest(x) == y for x, y in zip(sets, part.column("key").to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("node").filter(same), pa.array(sets, pa.binary()).filter(same)], ["node", "shingles"])

    wanted = nodes.select("node", "key", F.col("row.doc_id").alias("id_"), F.col("row.digest").alias("digest_"))
    same_row = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("digest") == F.col("digest_"))
    return docs.join(wanted, same_row).select("node", "key", "text").mapInArrow(run, "node bigint, shingles binary").dropDuplicates(["node"])


def _lean(t: float, minima_: int) -> float:
    """The share of equal minima that a pair of similarity ``t`` falls under once in 300,000 times."""
    return t - 4.5 * math.sqrt(t * (1 - t) / minima_)


def _confirm(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) among the candidate pairs (a, b), a written table that goes: first by signature, then by the full sets."""
    t = num / den

    def alike(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                keep = pa.array((x == y).mean(axis=1) >= _lean(t, x.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    near = written(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(alike, "a bigint, b bigint"), "minhash-near")

    def linked(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, keep = batch.slice(at, ROWS), []
                for x, y in zip(part.column("x").to_pylist(), part.column("y").to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["u", "v"])

    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    edges = written(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(linked, "u bigint, v bigint"), "minhash-edges")
    drop_written(pairs, near)
    return edges


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets in ``x`` with all in ``y``, as matrix products over slices of the tokens that both sides hold."""
    tokens, at = np.unique(np.concatenate(x + y), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in x + y])
    left = row < len(x)
    both = (np.bincount(at[left], minlength=len(tokens)) > 0) & (np.bincount(at[~left], minlength=len(tokens)) > 0)
    use = both[at]
    row, column = row[use], (np.cumsum(both) - 1)[at[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)))
    for lo in range(0, int(both.sum()), SLICE):
        a, b = np.searchsorted(column, (lo, lo + SLICE))
        m = np.zeros((len(x) + len(y), SLICE), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def _links_in_blocks(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (u, v) between components within large buckets, as a written table.

    Members are packed with their full sets into blocks; a task compares two blocks of one bucket exactly and gives a spanning
    forest of their links, so that a family just under the threshold makes no rows of its pairs. ``rows`` are (bucket, node, comp, parts).
    """
    blocks = written(rows.join(sets, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).groupBy("bucket", "part")
                     .agg(F.collect_list(F.struct("node", "comp", "shingles")).alias("m")), "minhash-blocks")

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for c in ("x", "y"):
                    m = batch.column(c)[i].values
                    sides.append((np.asarray(m.field("node")), np.asarray(m.field("comp")), [np.frombuffer(b, np.uint64) for b in m.field("shingles").to_pylist()]))
                (xs, xc, xt), (ys, yc, yt) = sides
                size_x, size_y = (np.array([len(t) for t in side]) for side in (xt, yt))
                both = shared_counts(xt, yt).astype(np.int64)
                links = (den * both >= num * (size_x[:, None] + size_y[None, :] - both)) & (xc[:, None] != yc[None, :])
                tree = block_forest(*np.nonzero(links), xs, ys)
                yield pa.RecordBatch.from_arrays([pa.array(tree[:, 0], pa.int64()), pa.array(tree[:, 1], pa.int64())], ["u", "v"])

    x = blocks.select("bucket", F.col("part").alias("px"), F.col("m").alias("x"))
    y = blocks.select("bucket", F.col("part").alias("py"), F.col("m").alias("y"))
    edges = written(x.join(y, "bucket").where("px <= py").select("x", "y").mapInArrow(compare, "u bigint, v bigint").distinct(), "minhash-blockwise")
    drop_written(blocks)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100),
                    bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    return duplicate_classes(docs, id_col, text, k, threshold, bands, rows).select("doc_id", "n_shingles", "component_id")


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100),
                      bands: int = 32, rows: int = 5) -> DataFrame:
    """(doc_id, digest, n_shingles, class, component_id), one row for each row of ``docs``; ``class`` numbers the component within this call, null without a set.

    Pairs with intersection * threshold[1] >= union * threshold[0] are linked. A pair of similarity s shares a band with
    probability 1 - (1 - s ** rows) ** bands: at 0.8 with the defaults all but 3 in a million.
    """
    num, den = threshold
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_digest(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    sig = written(signatures(base, k, bands, rows), "minhash-sig")
    # a node is a set; its number is fixed by the written table, and one of its rows stands for it when the text is read again
    nodes = written(sig.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "digest")).alias("row"), F.first("n").alias("n"),
                                                                 F.first("bands").alias("bands"), F.first("sig").alias("sig"))
                    .withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    every = written(sig.select("doc_id", "digest", "n", "key"), "minhash-rows")
    drop_written(sig)
    in_bands = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = in_bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    step = F.lit(-math.log(num / den) * 1.01)
    size_class = F.floor(F.log("n") / step)
    members = written(in_bands.join(shared, "bucket").select("node", "n", F.explode(F.array(size_class, size_class + 1)).alias("c"), "bucket")
                      .select("node", "n", F.xxhash64("bucket", "c").alias("bucket")), "minhash-members")

    fits = (den * F.least("n", "n_b") >= num * F.greatest("n", "n_b"))
    ends = [F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")]

    def stars(rows_: DataFrame, turn: int) -> DataFrame:
        drawn = rows_.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket", F.lit(turn)).alias("h"), F.col("node").alias("node_b"),
                                                             F.col("n").alias("n_b"))).alias("d")).select("bucket", "d.node_b", "d.n_b")
        return rows_.join(drawn, "bucket").where(F.col("node") != F.col("node_b")).where(fits).select(*ends).distinct()

    def with_component(rows_: DataFrame, comps: DataFrame) -> DataFrame:
        return rows_.join(comps.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def open_members(comps: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component."""
        now = with_component(members, comps)
        mixed = now.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        return now.join(mixed, "bucket")

    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "key", "row")
    sets = written(shingle_sets(base, wanted, k), "minhash-sets")
    edges = _confirm(written(stars(members, 0), "minhash-pairs"), nodes, sets, num, den)
    comps = connected_components(edges)
    rest = open_members(comps)
    count = F.count(F.lit(1))
    parts = F.greatest(F.ceil(count / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS))
    rest = written(rest.join(rest.groupBy("bucket").agg(parts.alias("parts"), (count > SMALL).alias("large")), "bucket"), "minhash-open")
    drop_written(members, comps)
    small = rest.where("not large").select("bucket", "node", "n", "comp")
    other = small.select("bucket", F.col("node").alias("node_b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
    cross = (small.join(other, "bucket").where(F.col("node") < F.col("node_b")).where(F.col("comp") != F.col("comp_b")).where(fits).select(*ends).distinct())
    across = _confirm(written(cross, "minhash-cross"), nodes, sets, num, den)
    in_blocks = _links_in_blocks(rest.where("large").select("bucket", "node", "comp", "parts"), sets, num, den)
    drop_written(rest, sets)
    comps = connected_components(edges.unionByName(across).unionByName(in_blocks))
    drop_written(edges, across, in_blocks)
    named = written(with_component(nodes.select("key", "node", "least"), comps).select("key", "comp", "least"), "minhash-named")
    drop_written(nodes, comps)
    by_key = written(named.join(named.groupBy("comp").agg(F.min("least").alias("component_id")), "comp"), "minhash-classes").drop("least")
    drop_written(named)
    # rows without a set stay out of the join, where they would meet in one task
    full = every.where("key is not null").join(by_key, "key", "left").select(
        "doc_id", "digest", F.col("n").alias("n_shingles"), F.col("comp").alias("class"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.unionByName(every.where("key is null").select("doc_id", "digest", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("class"),
                                                              F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = 32, rows: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class: that of smallest id. Rows without a set all stay.

    Rows are told apart by id and text, so that each class keeps exactly one row where ids repeat or are null (null comes last);
    of equal rows, the least of all columns. Texts are not shuffled: keys decide, and a scan leaves out what is gone.
    """
    keys = ["id__", "digest__"]
    groups = written(duplicate_classes(docs, id_col, text, k, threshold, bands, rows).select(F.col("doc_id").alias("id__"), F.col("digest").alias("digest__"), "class"), "minhash-groups")
    texts = written(groups.where("class is not null").groupBy("class", *keys).agg(F.count(F.lit(1)).alias("c"))
                    .withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(SALTS))), "minhash-texts")
    # the first of a class by (class, part), then by class, and handed back to its parts: a large class is dealt to many tasks
    first = F.min(F.struct(F.col("id__").isNull().alias("no_id"), *keys)).alias("first")
    parts = texts.groupBy("class", "part").agg(first, F.sum("c").alias("rows"))
    whole = parts.groupBy("class").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"), F.collect_list("part").alias("parts")).where("rows > 1")
    ranked = texts.join(whole.select("class", "first", F.explode("parts").alias("part")), ["class", "part"])
    stays = F.col("id__").eqNullSafe(F.col("first.id__")) & (F.col("digest__") == F.col("first.digest__"))
    # all but single rows that stay: of equal rows that stay one is put back
    gone = written(ranked.select(*keys, stays.alias("stays"), "c").where("not stays or c > 1").select(*keys, "stays"), "minhash-gone")
    drop_written(texts)
    told = KeyTest(gone, groups, keys)
    drop_written(groups)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id__"), text_digest(F.col(f"`{text}`")).alias("digest__"))
    marked = told.mark(base, "gone__")
    out = marked.where("gone__ = 0").select("row.*")
    same = F.col("id__").eqNullSafe(F.col("gone_id")) & F.col("digest__").eqNullSafe(F.col("gone_digest"))
    named = gone.select(F.col("id__").alias("gone_id"), F.col("digest__").alias("gone_digest"), "stays")
    if told.open:
        out = out.unionByName(marked.where("gone__ = -1").join(named, same, "left_anti").select("row.*"))
    again = KeyFilter(gone.where("stays"), keys)
    if again.count:
        out = out.unionByName(again.mark(base, "back__").where("back__").join(named.where("stays"), same).groupBy("gone_id", "gone_digest").agg(F.min("row").alias("row")).select("row.*"))
    return out
