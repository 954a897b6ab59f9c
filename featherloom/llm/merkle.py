"""A Merkle manifest of a dataset, and octopus multiproofs for all of its leaves.

Every row is a leaf; the leaves of a source, in order, form its tree, and the subroots of all sources form the top tree. Inner nodes
are the SHA-256 of up to ``FAN`` hashes as hex text. Spark sorts the leaves by range, numbers them from the totals of the ranges, and
builds a level in one grouping by run. For the proofs the leaves are cut into partitions of ``BLOCK`` neighbours, whichever
sources they are of. Each works out which nodes its leaves' proofs need that its own leaves cannot give (the minimal union),
fetches those once by a join, derives the shared interior nodes up to the root, and cuts every leaf's proof out of them. A leaf that is
claimed unchanged is verified with its partition, by the root derived from fetched nodes; a changed one is folded up alone.

Cases: a null field is ``-``, so it differs from an empty one; a null source is a source, first in order; leaves with null ids come
first in their source. Rows of one id are ordered by their leaf; fully equal rows are leaves of their own. A lone leaf is its subroot,
a lone subroot the root, and their proof is empty. No rows give no rows. Extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from featherloom.llm.common import written
from featherloom.session import slices_of

FAN = 16
BLOCK = 4096        # leaves of one partition of proofs
HEX = 64            # letters of a hash
TOP = -1            # number of the tree above the subroots
SALTS = 64          # parts in which requests for one node are answered
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields in order, each its length in bytes, a colon and its value, or ``-`` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


@dataclass
class Manifest:
    """What is kept of a dataset: ``leaves`` (at, tree, pos, doc_id, leaf, claim), ``nodes`` (tree, level, idx, hash) of both kinds
    of tree, ``trees`` (tree, n), the number of sources and the root (None without rows)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    sources: int
    root: str | None


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (tree, pos, at, doc_id, leaf, claim): number of the source, place in it, and place among all rows."""
    spark = rows.sparkSession
    keys = ["source", "doc_id", "leaf", "tie"]         # the tie spreads fully equal rows over ranges; any order of theirs is right
    laid = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(slices_of(rows), *keys).sortWithinPartitions(*keys)

    def number(batches):
        part, row, local, since, last = TaskContext.get().partitionId(), 0, -1, 0, None
        for batch in batches:
            locals_, sinces = [], []
            for s in batch.column("source").to_pylist():
                if local < 0 or s != last:
                    local, since, last = local + 1, 0, s
                locals_.append(local)
                sinces.append(since)
                since += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), pa.array(locals_, pa.int64()), pa.array(sinces, pa.int64()),
                 *(batch.column(c) for c in ("source", "doc_id", "leaf", "claim"))],
                ["slice", "row", "local", "since", "source", "doc_id", "leaf", "claim"])
            row += n

    laid = written(laid.select("source", "doc_id", "leaf", "claim").mapInArrow(
        number, "slice int, row bigint, local bigint, since bigint, source string, doc_id bigint, leaf string, claim string"), "merkle-laid")
    end = F.struct("row", "source", "since")
    each = laid.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.max("local").alias("local"), F.min(F.struct("row", "source")).alias("first"), F.max(end).alias("last"))
    totals = sorted(each.collect(), key=lambda r: r["slice"])      # one row for each range of SLICE_BYTES
    size = max((r["slice"] for r in totals), default=-1) + 1
    start, tree, carry = (np.zeros(size, np.int64) for _ in range(3))
    at, number_of, kept, before = 0, -1, 0, None
    for i, r in enumerate(totals):
        goes_on = i > 0 and r["first"]["source"] == before
        if not goes_on:
            number_of, kept = number_of + 1, 0
        start[r["slice"]], tree[r["slice"]], carry[r["slice"]] = at, number_of, kept
        kept = r["last"]["since"] + 1 + (kept if r["local"] == 0 else 0)
        at, number_of, before = at + r["n"], number_of + r["local"], r["last"]["source"]
    held = spark.sparkContext.broadcast((start, tree, carry))

    def place(batches):
        start, tree, carry = held.value
        for batch in batches:
            s, row, local, since = (batch.column(c).to_numpy() for c in ("slice", "row", "local", "since"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(start[s] + row), pa.array(tree[s] + local), pa.array(since + np.where(local == 0, carry[s], 0)), *(batch.column(c) for c in ("doc_id", "leaf", "claim"))],
                ["at", "tree", "pos", "doc_id", "leaf", "claim"])

    return laid.mapInArrow(place, "at bigint, tree bigint, pos bigint, doc_id bigint, leaf string, claim string")


def _grow(level: DataFrame, name: str, stages: list) -> tuple[list[DataFrame], DataFrame]:
    """All nodes above rows (tree, idx, hash), a frame for each level, and (tree, hash) of each tree's last node."""
    levels, tops, k = [], [], 0
    while True:
        levels.append(level.select("tree", F.lit(k).alias("level"), "idx", "hash"))
        runs = level.groupBy("tree", F.floor(F.col("idx") / FAN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("run_nodes"))
        lone = (F.col("run") == 0) & (F.size("run_nodes") == 1)       # the first run is full unless it is the only one
        joined = F.sha2(F.array_join(F.transform("run_nodes", lambda x: x["hash"]), ""), 256)
        up = written(runs.select("tree", F.col("run").alias("idx"), F.when(lone, F.col("run_nodes")[0]["hash"]).otherwise(joined).alias("hash"), lone.alias("lone")), f"merkle-{name}{k}")
        stages.append(up)
        tops.append(up.where("lone").select("tree", "hash"))
        level, k = up.where("not lone").select("tree", "idx", "hash"), k + 1
        if level.isEmpty():
            last = tops[0]
            for t in tops[1:]:
                last = last.unionByName(t)
            return levels, last


def build_manifest(rows: DataFrame) -> Manifest:
    """Order rows (source, doc_id, leaf, claim) and build every node above them."""
    leaves = _in_order(rows.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), "leaf", "claim"))
    stages: list[DataFrame] = []
    below, subroots = _grow(leaves.select("tree", F.col("pos").alias("idx"), F.col("leaf").alias("hash")), "source", stages)
    above, top = _grow(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "hash"), "top", stages)
    nodes = below[0]
    for frame in [*below[1:], *above]:
        nodes = nodes.unionByName(frame)
    trees = written(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "merkle-trees")
    root = top.first()
    return Manifest(leaves, nodes, trees, trees.count(), root["hash"] if root else None)


def missing_nodes(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """(level, idx) of the least set of nodes that leaves lo to hi of a tree of n leaves need besides what follows from themselves."""
    out, level = [], 0
    while n > 1:
        first, last = lo // FAN * FAN, min(hi // FAN * FAN + FAN, n) - 1
        out += [(level, i) for i in range(first, lo)] + [(level, i) for i in range(hi + 1, last + 1)]
        lo, hi, n, level = lo // FAN, hi // FAN, -(-n // FAN), level + 1
    return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class _Climb:
    """Every run of nodes that the own nodes lo, lo + 1, … of a tree touch, up to its last node."""

    def __init__(self, lo: int, own: Sequence[str], n: int, fetched: dict[tuple[int, int], str]):
        self.levels: list[tuple[int, str]] = []      # (first node, hashes of the touched runs in order), by level
        level, own = 0, list(own)
        while n > 1:
            hi = lo + len(own) - 1
            first, last = lo // FAN * FAN, min(hi // FAN * FAN + FAN, n) - 1
            run = [fetched[level, i] for i in range(first, lo)] + own + [fetched[level, i] for i in range(hi + 1, last + 1)]
            text = "".join(run)
            self.levels.append((first, text))
            own = [_digest(text[i : i + FAN * HEX]) for i in range(0, len(text), FAN * HEX)]
            lo, n, level = lo // FAN, -(-n // FAN), level + 1
        self.root = own[0]
        self.kept: dict[tuple[int, int], str] = {}

    def around(self, level: int, idx: int) -> tuple[str, str]:
        """The siblings to the left and to the right of a node."""
        first, text = self.levels[level]
        run, at = (idx // FAN * FAN - first) * HEX, (idx - first) * HEX
        return text[run:at], text[at + HEX : run + FAN * HEX]

    def above(self, level: int, idx: int) -> str:
        """Siblings of a node and of all nodes over it; shared by the nodes of a run."""
        if level == len(self.levels):
            return ""
        if (level, idx) not in self.kept:
            self.kept[level, idx] = "".join(self.around(level, idx)) + self.above(level + 1, idx // FAN)
        return self.kept[level, idx]

    def proof(self, idx: int) -> str:
        return "".join(self.around(0, idx)) + self.above(1, idx // FAN) if self.levels else ""

    def fold(self, idx: int, node: str) -> str:
        """The root that follows from another hash in place of a node and from its siblings."""
        for level in range(len(self.levels)):
            left, right = self.around(level, idx)
            node, idx = _digest(left + node + right), idx // FAN
        return node


def expand(leaves: list[tuple], fetched: list[tuple], sources: int) -> list[tuple]:
    """(doc_id, leaf, subroot, proof digest, folded root) of the leaves (tree, pos, doc_id, leaf, claim) of one partition, in order.

    ``fetched`` are (tree, level, idx, hash); level -1 stands for the size of a tree, in ``idx``.
    """
    of: dict[int, dict] = {}
    for tree, level, idx, node in fetched:
        of.setdefault(tree, {})[(level, idx) if level >= 0 else "n"] = node if level >= 0 else idx
    groups: dict[int, list] = {}
    for leaf in leaves:
        groups.setdefault(leaf[0], []).append(leaf)
    climbs = {t: _Climb(rows[0][1], [r[3] for r in rows], of[t]["n"], of[t]) for t, rows in groups.items()}
    top = _Climb(min(climbs), [climbs[t].root for t in sorted(climbs)], sources, of.get(TOP, {}))
    out = []
    for tree, rows in groups.items():
        climb, rest = climbs[tree], top.proof(tree)
        for _, pos, doc_id, leaf, claim in rows:
            folded = top.root if claim == leaf else top.fold(tree, climb.fold(pos, claim))
            out.append((doc_id, leaf, climb.root, _digest(climb.proof(pos) + rest), folded))
    return out


def multiproofs(made: Manifest, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every leaf, by partitions of ``block`` leaves."""
    leaves = made.leaves.withColumn("block", F.floor(F.col("at") / block))
    parts = leaves.groupBy("block", "tree").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).join(made.trees, "tree")
    plans = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("tree", "lo", "hi", "n"))).alias("plan"))      # a block has at most ``block`` sources
    sources = made.sources

    def ask(batches):
        for batch in batches:
            out = []
            for b, plan in zip(batch.column("block").to_pylist(), batch.column("plan").to_pylist(), strict=True):
                for p in plan:
                    out.append((b, p["tree"], -1, p["n"]))
                    out += [(b, p["tree"], level, i) for level, i in missing_nodes(p["lo"], p["hi"], p["n"])]
                out += [(b, TOP, level, i) for level, i in missing_nodes(plan[0]["tree"], plan[-1]["tree"], sources)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["block", "tree", "level", "idx"])

    asked = written(plans.mapInArrow(ask, "block bigint, tree bigint, level int, idx bigint"), "merkle-asked").withColumn("part", F.col("block") % SALTS)
    # a node near the root is asked for by many partitions: each node goes to the parts that ask, each part to its askers
    node, wanted = ["tree", "level", "idx"], asked.where("level >= 0")
    spread = wanted.select(*node, "part").distinct().join(made.nodes, node)
    fetched = wanted.join(spread, [*node, "part"]).select("block", *node, "hash").unionByName(asked.where("level < 0").select("block", *node, F.lit(None).cast("string").alias("hash")))
    schema = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"

    def prove(mine: pa.Table, others: pa.Table) -> pa.Table:
        mine = mine.sort_by("at")
        rows = list(zip(*(mine.column(c).to_pylist() for c in ("tree", "pos", "doc_id", "leaf", "claim")), strict=True))
        out = expand(rows, list(zip(*(others.column(c).to_pylist() for c in (*node, "hash")), strict=True)), sources)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 4), strict=True)], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    proved = leaves.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(prove, schema)
    root = F.lit(made.root).cast("string")
    return proved.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def merkle_proofs(docs: DataFrame, claimed: Column | None = None, source: str = "source", id_col: str = "doc_id", fields: Sequence[str] = FIELDS, block: int = BLOCK) -> DataFrame:
    """Manifest and proofs of ``docs``; ``claimed`` gives the leaf that someone claims each row to have, by default its own."""
    leaf = leaf_hash(*[F.col(f"`{f}`") for f in fields])
    rows = docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{id_col}`").alias("doc_id"), leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claim"))
    return multiproofs(build_manifest(rows), block)
