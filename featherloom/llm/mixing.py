"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document starts with the copies its source's target asks for; the whole part is given, the fraction is a copy
probability. Two documents with fractions meet: mass (words) moves from one to the other, in the direction a keyed coin
tosses, until one fraction is 0 or 1. The expected copies of each document stay what they were, and the words of the pair
stay the same in sum. Leaves of some dozens of documents each leave one fraction; those meet in a tree of fixed fan-in
until one per source is left, which is rounded to the nearer side. A source so misses its target by half a document.

Cases: null text has 0 words and is taken 0 words; a null source is a source of its own, last in order; a null id is an id.
Rows equal in id, source and size are numbered, and each has a coin of its own, so that sources of very many equal rows come as near their targets
as others. No rows give no rows. Coins hash ids and numbers, so reruns agree whatever the partitioning. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featherloom.llm.bits import KeyFilter, KeyTest, same_key
from featherloom.llm.common import base_columns, drop_written, text_digest, word_count, written
from featherloom.llm.pii import let
from featherloom.operators.ranking import ordered_prefix
from featherloom.session import input_bytes

WEIGHTS = (3.0, 1.0, 2.0)
LEAF, FAN, LEVELS = 48, 192, 4     # 48 * 192 ** 4 documents a source before a leaf grows
EPS = 1e-9
SOURCE_BYTES = 4 << 20     # of the source table that one task puts in order
REPEATS = 1 << 16      # numbers that one row of repeats is spread into at once
KEYS = ["id__", "source__", "size__"]


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size[, m]): ``size`` words, in ``m`` documents where that is given.

    Sources in code point order, null last, take the weights in turn and share ``share`` of all words. A target stops at
    ``most`` times its source; with sources in order of the level at which they fill up, whether one is full depends only on
    those before it, so the resharing until none is above is one running sum over the source table. Both orders of the sources
    are dealt in ranges, so that a source column of hosts meets no single task. The result is a written table.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), (F.sum("m") if "m" in sized.columns else F.count(F.lit(1))).alias("n"))
    per, turns = written(per, "mix-sources"), F.array(*[F.lit(float(w)) for w in weights])
    slices = 1 + input_bytes(per) // SOURCE_BYTES
    rows = ordered_prefix(per, [], [F.col("source").asc_nulls_last()], row_number="turn", slices=slices)
    rows = rows.withColumn("w", F.element_at(turns, ((F.col("turn") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    rows = ordered_prefix(rows, [], [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], row_number=None, sums={"caps": "cap", "ws": "w"}, slices=slices)
    level = (share / most * F.col("caps_total") - F.col("caps") + F.col("cap")) / (F.col("ws_total") - F.col("ws") + F.col("w"))
    rows = written(rows.withColumn("full", F.col("cap") / F.col("w") < level).select("source", "n", "source_size", "w", "cap", "full"), "mix-levels")
    words, full_cap, open_w = rows.agg(F.sum("source_size"), F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)),
                                       F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w")))).first()
    rate = (share * (words or 0) - (full_cap or 0.0)) / open_w if open_w else 0.0
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("w") * F.lit(rate), F.col("cap")))
    out = written(rows.select("source", "n", "source_size", target.cast("double").alias("target")), "mix-targets")
    drop_written(per, rows)
    return out


def _coin(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 11) / float(1 << 53)


def _meet(acc: Column, x: Column, seed: str) -> Column:
    """One step in a leaf: the carried document meets ``x``; the one that becomes whole goes to ``out``."""
    one, zero = F.lit(1), F.lit(0)

    def done(item: Column, up: Column) -> Column:
        return F.struct(item["id"].alias("id"), item["size"].alias("size"), item["m"].alias("m"), up.cast("int").alias("up"))

    def out(*rows: Column) -> Column:
        return F.concat(acc["out"], F.array(*rows))

    def state(carry: Column, rows: Column) -> Column:
        return F.struct(carry.alias("carry"), rows.alias("out"))

    nothing = F.lit(None).cast("struct<o:bigint,id:bigint,size:bigint,m:bigint,p:double>")
    c = acc["carry"]
    words = lambda i: (i["size"] * i["m"]).cast("double")

    def with_p(i: Column, p: Column) -> Column:
        return F.struct(i["o"].alias("o"), i["id"].alias("id"), i["size"].alias("size"), i["m"].alias("m"), p.alias("p"))

    def settle(z: Column) -> Column:
        """z: who became whole and how, who stays and with which fraction."""
        whole = F.when(z["c_whole"], done(c, z["up"])).otherwise(done(x, z["up"]))
        stay = F.when(z["c_whole"], with_p(x, z["p"])).otherwise(with_p(c, z["p"]))
        return (F.when(z["p"] <= EPS, state(nothing, out(whole, done(stay, zero))))
                .when(z["p"] >= 1 - EPS, state(nothing, out(whole, done(stay, one))))
                .otherwise(state(stay, out(whole))))

    def move(v: Column) -> Column:
        wc, wx = v["wc"], v["wx"]
        rise = v["coin"] * (v["a"] + v["b"]) < v["b"]      # the carried one rises with probability b / (a + b)
        c_whole = F.when(rise, v["c_room"] <= v["x_mass"]).otherwise(v["c_mass"] <= v["x_room"])
        p = (F.when(rise & c_whole, x["p"] - v["a"] / wx).when(rise, c["p"] + v["a"] / wc)
             .when(c_whole, x["p"] + v["b"] / wx).otherwise(c["p"] - v["b"] / wc))
        up = F.when(rise == c_whole, one).otherwise(zero)  # rising makes the carried 1 or x 0, sinking the carried 0 or x 1
        return let(F.struct(c_whole.alias("c_whole"), up.alias("up"), p.alias("p")), settle)

    def masses(v: Column) -> Column:
        return F.struct(v["wc"].alias("wc"), v["wx"].alias("wx"), v["c_room"].alias("c_room"), v["x_mass"].alias("x_mass"),
                        v["c_mass"].alias("c_mass"), v["x_room"].alias("x_room"), F.least(v["c_room"], v["x_mass"]).alias("a"),
                        F.least(v["c_mass"], v["x_room"]).alias("b"),
                        _coin(c["o"], x["o"], F.lit(seed)).alias("coin"))

    first = F.struct(words(c).alias("wc"), words(x).alias("wx"), ((1 - c["p"]) * words(c)).alias("c_room"), (x["p"] * words(x)).alias("x_mass"),
                     (c["p"] * words(c)).alias("c_mass"), ((1 - x["p"]) * words(x)).alias("x_room"))
    return (F.when((x["p"] <= EPS) | (x["size"] == 0), state(c, out(done(x, zero))))
            .when(c.isNull(), state(x, acc["out"]))
            .otherwise(let(first, lambda v: let(masses(v), move))))


def _level(items: DataFrame, level: int, seed: str) -> DataFrame:
    """Rows (source, node, carry, out): each node's items reduced to at most one fraction and the decided ones."""
    nodes = items.groupBy("source", "node").agg(F.array_sort(F.collect_list("item")).alias("items"))
    start = F.struct(F.lit(None).cast("struct<o:bigint,id:bigint,size:bigint,m:bigint,p:double>").alias("carry"),
                     F.array().cast("array<struct<id:bigint,size:bigint,m:bigint,up:int>>").alias("out"))
    return nodes.withColumn("s", F.aggregate("items", start, lambda acc, x: _meet(acc, x, f"{seed}/{level}"))).select(
        "source", "node", F.col("s.carry").alias("carry"), F.col("s.out").alias("out"))


def _plan(docs: DataFrame, id_col: str, text: str, source: str, seed: str, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """One row for each (doc_id, source, size), a written table: ``m`` rows in the input, of which ``ups`` get ``low`` + 1 copies and the others ``low``."""
    rows = base_columns(docs, id_col, source, text).toDF("doc_id", "source", "text")
    units = (rows.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"))
             .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m")))
    units = written(units, "mix-units")
    targets = source_targets(units.select("source", (F.col("size") * F.col("m")).alias("size"), "m"), weights, share, most)
    t = targets.withColumnRenamed("source", "t_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # the numbers of repeats in two steps, so that no row holds a long list
    numbered = (units.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / REPEATS))))
                .withColumn("no", F.explode(F.sequence(F.col("run") * REPEATS + 1, F.least(F.col("m"), (F.col("run") + 1) * REPEATS)))))
    drawn = (numbered.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
             .withColumn("share", copies).withColumn("o", F.xxhash64("doc_id", "size", "no", F.lit(seed))))
    leaves = F.greatest(F.ceil(F.col("n") / LEAF), F.lit(1))
    items = drawn.select("source", F.pmod(F.xxhash64("o", F.lit("leaf")), leaves).alias("node"),
                         F.struct("o", F.col("doc_id").alias("id"), "size", F.lit(1).cast("long").alias("m"),
                                  (F.col("share") - F.floor(F.col("share") + EPS)).alias("p")).alias("item"))
    level = written(_level(items, 0, seed), "mix-leaves")
    levels = [level]
    decided = [level.select("source", F.explode("out").alias("d"))]
    for k in range(1, LEVELS + 1):
        items = level.where("carry is not null").select("source", F.floor(F.col("node") / FAN).alias("node"), F.col("carry").alias("item"))
        level = written(_level(items, k, seed), f"mix-level{k}")
        levels.append(level)
        decided.append(level.select("source", F.explode("out").alias("d")))
    last = level.where("carry is not null").select("source", F.struct("carry.id", "carry.size", "carry.m",
                                                                    (F.col("carry.p") >= 0.5).cast("int").alias("up")).alias("d"))
    ups = decided[0]
    for d in [*decided[1:], last]:
        ups = ups.unionByName(d)
    plan = written(ups.groupBy("source", F.col("d.id").alias("doc_id"), F.col("d.size").alias("size"))
                   .agg(F.count(F.lit(1)).alias("m"), F.sum(F.when(F.col("d.size") > 0, F.col("d.up")).otherwise(0)).alias("ups"))
                   .join(t, F.col("source").eqNullSafe(F.col("t_source")))
                   .select("doc_id", "source", "size", "m", "source_size", "target", F.floor(copies + EPS).cast("long").alias("low"), "ups"), "mix-plan")
    drop_written(units, targets, *levels)
    return plan


def mix_units(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
              weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (doc_id, source, size, m, source_size, target, copies): ``m`` rows of the input that get ``copies`` copies each.

    A (doc_id, source, size) that repeats may have two such rows, one for each number of copies.
    """
    both = F.array(F.struct((F.col("m") - F.col("ups")).alias("m"), F.col("low").alias("copies")), F.struct(F.col("ups").alias("m"), (F.col("low") + 1).alias("copies")))
    plan = _plan(docs, id_col, text, source, seed, weights, share, most).withColumn("part", F.explode(both)).where("part.m > 0")
    return plan.select("doc_id", "source", "size", "part.m", "source_size", "target", "part.copies")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix",
                weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as its copies say, all columns kept.

    Texts are not shuffled: for each number of copies a filter of the keys that get as many tells a scan what to copy. Only rows
    that the filters leave open, and repeats of which some are copied once more than others, are joined with the plan.
    """
    plan = _plan(docs, id_col, text, source, seed, weights, share, most)
    plan = plan.select(F.col("doc_id").alias("id__"), F.col("source").alias("source__"), F.col("size").alias("size__"), "m", "low", "ups")
    mixed = F.col("ups").between(1, F.col("m") - 1)
    top = plan.agg(F.max(F.col("low") + (F.col("ups") > 0).cast("int"))).first()[0] or 0
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id__"),
                       F.col(f"`{source}`").alias("source__"), word_count(F.col(f"`{text}`")).alias("size__"))
    uneven = KeyFilter(plan.where(mixed), KEYS)
    marked, tests = uneven.mark(base, "open__").withColumn("copies__", F.lit(0)), []
    for level in range(1, top + 1):
        tests.append(KeyTest(plan.where(~mixed).where(F.col("low") + (F.col("ups") > 0).cast("int") >= level), plan, KEYS))
        marked = tests[-1].mark(marked, "in__").withColumn("open__", F.col("open__") | (F.col("in__") < 0)).withColumn("copies__", F.col("copies__") + F.col("in__")).drop("in__")
    repeat = lambda df, n: df.withColumn("no__", F.explode(F.sequence(F.lit(1), n.cast("int")))).select("row.*")
    out = repeat(marked.where("not open__ and copies__ > 0"), F.col("copies__"))
    if not uneven.count and not any(t.open for t in tests):
        return out
    named = plan.select(*[F.col(k).alias(f"{k}_plan") for k in KEYS], mixed.alias("mixed"), "low", "ups")
    found = marked.where("open__").join(named, same_key(KEYS, "_plan"))
    plain = found.where("not mixed").withColumn("copies", F.col("low") + (F.col("ups") > 0).cast("int")).where("copies > 0")
    out = out.unionByName(repeat(plain, F.col("copies")))
    if uneven.count:
        repeats = found.where("mixed").select("row", *KEYS, "low", "ups", text_digest(F.col("row").getField(text)).alias("digest__"), F.xxhash64("row").alias("hash__"))
        ranked = ordered_prefix(repeats, KEYS, [F.col("digest__"), F.col("hash__")], row_number="rank__")
        ranked = ranked.withColumn("copies", F.col("low") + (F.col("rank__") <= F.col("ups")).cast("int")).where("copies > 0")
        out = out.unionByName(repeat(ranked, F.col("copies")))
    return out
