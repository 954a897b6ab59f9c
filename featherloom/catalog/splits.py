"""Fold, split, sampling and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.catalog.common import LABEL_SCORES, h27, label_scores, r
from featherloom.catalog.registry import query
from featherloom.functions import arrays
from featherloom.functions.hashing import key_hash
from featherloom.operators import folds, sampling

PCT = lambda x: f"({h27(x)} * 100.0::DOUBLE / 134217727.0::DOUBLE)"


@query("win_5_shuffled_fold", f"select o_orderkey, ({h27(chr(39) + '0|' + chr(39) + ' || o_orderkey::VARCHAR')} % 6)::INTEGER as fold from orders")
def _(t):
    return t.orders.select("o_orderkey", folds.shuffled_fold("o_orderkey", 6).alias("fold"))


STRATIFIED = f"""folded as (select o_orderkey, o_orderstatus, (row_number() over (partition by o_orderstatus
    order by {h27("'0|' || o_orderkey::VARCHAR")}, o_orderkey) - 1) % 5 as fold from orders)"""


@query("win_5_stratified_folds", f"with {STRATIFIED} select o_orderkey, o_orderstatus, fold::INTEGER as fold from folded")
def _(t):
    return folds.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 5)


@query("win_7_grouped_fold", f"""
with x as (select doc_id, source || '_' || (doc_id // 3)::VARCHAR as g from documents)
select doc_id, g, case when {PCT('g')} >= 100 then -1 else floor({PCT('g')} * 5 / 100.0::DOUBLE) end::INTEGER as fold,
       case when {PCT('g')} < 10 then 'valid' when {PCT('g')} < 30 then 'test' else 'train' end as split from x""")
def _(t):
    name = F.concat(F.col("source"), F.lit("_"), F.floor(F.col("doc_id") / 3).cast("string"), F.lit("_nohash_"), F.col("doc_id").cast("string"))
    x = t.documents.select("doc_id", folds.group_of(name).alias("g"))
    return x.select("doc_id", "g", folds.grouped_fold("g", 5).alias("fold"), folds.percent_split("g", 10, 20).alias("split"))


@query("agg_14_label_shares", f"""
with x as (select ({h27("'0|' || doc_id::VARCHAR")} % 6)::INTEGER as fold, quality, toxic from labels)
select fold, count(*) as rows, round(avg(quality), 5) as quality, round(avg(toxic), 5) as toxic from x group by fold""")
def _(t):
    x = t.labels.withColumn("fold", folds.shuffled_fold("doc_id", 6))
    return folds.label_shares(x, ["fold"], ["quality", "toxic"])


@query("jon_14_leaking_keys", f"""
with x as (select l_suppkey, l_partkey, ({h27("'0|' || l_orderkey::VARCHAR")} % 5)::INTEGER as fold from lineitem)
select l_partkey, min(fold) as first_fold, max(fold) as last_fold from x group by l_partkey having min(fold) <> max(fold)""")
def _(t):
    x = t.lineitem.select("l_partkey", folds.shuffled_fold("l_orderkey", 5).alias("fold"))
    return folds.leaking_keys(x, "l_partkey", "fold")


@query("jon_14_no_group_leak", """
select count(distinct l_suppkey) as groups, 0::BIGINT as leaking from lineitem""")
def _(t):
    x = t.lineitem.select(F.col("l_suppkey").cast("string").alias("g"))
    leaking = folds.leaking_keys(x.withColumn("fold", folds.grouped_fold("g", 5)), "g", "fold").agg(F.count(F.lit(1)).alias("leaking"))
    return x.agg(F.count_distinct("g").alias("groups")).crossJoin(F.broadcast(leaking))  # one row each


@query("jon_15_fold_members", f"""
with x as (select o_orderstatus, ({h27("'0|' || o_orderkey::VARCHAR")} % 5)::INTEGER as fold from orders)
select k::INTEGER as round, case when fold = k then 'valid' else 'train' end as role, o_orderstatus, count(*) as n
from x cross join range(0, 5) t(k) group by all""")
def _(t):
    x = t.orders.select("o_orderstatus", folds.shuffled_fold("o_orderkey", 5).alias("fold"))
    return folds.fold_members(x, 5).groupBy("round", "role", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("jon_2_match_predictions", f"""
with {LABEL_SCORES} select id, label_name, truth, p from label_scores where model = 'm1'""")
def _(t):
    scored = label_scores(t).where("model = 'm1'").withColumn("key", F.concat_ws("|", "id", "label_name"))
    # the folds' prediction tables, stacked
    preds = scored.where(folds.shuffled_fold("id", 2) == 0).select("key", "p").unionByName(
        scored.where(folds.shuffled_fold("id", 2) == 1).select("key", "p"))
    return folds.matched_predictions(preds, scored.drop("p", "model"), "key").drop("key")


@query("srt_4_hash_prefix", f"""
select o_orderkey, case when {h27("'shuffle|' || o_orderkey::VARCHAR")} < 93952409 then 'train' else 'test' end as part from orders""")
def _(t):
    return folds.hash_prefix(t.orders.select("o_orderkey"), "o_orderkey", 0.7)


@query("srt_4_shuffled_order", f"""
select o_orderkey, row_number() over (order by {h27("'shuffle|' || o_orderkey::VARCHAR")}, o_orderkey) - 1 as position from orders""")
def _(t):
    return folds.shuffled_order(t.orders.select("o_orderkey"), "o_orderkey")


@query("set_1_stack_and_split", """
with x as (select c_custkey as id, c_nationkey as nation, c_acctbal as bal, 'customer' as source from customer
  union all select s_suppkey, s_nationkey, s_acctbal, 'supplier' from supplier),
s as (select avg(bal) as m from x)
select id, source, round(bal - m, 6) as centred from x, s where source = 'supplier'""")
def _(t):
    from featherloom.operators.columns import with_row
    from featherloom.operators.relations import split_stacked, stack

    both = stack({"customer": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")),
                  "supplier": t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))})
    centred = with_row(both, both.agg(F.avg("bal").alias("m"))).select("id", "source", r(F.col("bal") - F.col("m"), 6).alias("centred"))
    return split_stacked(centred, "supplier")


@query("set_2_concat_sorted", """
select o_custkey as user_id, o_orderdate as at, 'order' as kind, o_totalprice as amount from orders
union all select user_id, ts, event_type, null from events""")
def _(t):
    orders = t.orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("amount"))
    events = t.events.select("user_id", F.col("ts").alias("at"), F.col("event_type").alias("kind"))
    return orders.unionByName(events, allowMissingColumns=True).orderBy("user_id", "at", "kind")


@query("set_3_intersect_subtract", """
with a as (select distinct unnest(string_split(p_name, ' ')) as w from part), b as (select distinct unnest(string_split(lower(text), ' ')) as w from documents)
select w, case when w in (select w from b) then 'both' else 'left' end as side from a""")
def _(t):
    a = t.part.select(F.explode(F.split("p_name", " ")).alias("w"))
    b = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    both, left = a.intersect(b), a.subtract(b)
    return both.withColumn("side", F.lit("both")).unionByName(left.withColumn("side", F.lit("left"))).orderBy("w")


@query("set_4_oversample", """
select l_orderkey, l_linenumber, unnest(range(1, case when l_returnflag = 'R' then 7 else 2 end))::INTEGER as copy from lineitem""")
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    return sampling.oversample(x, F.col("l_returnflag") == "R", 5).drop("l_returnflag")


@query("set_5_undersample", f"""
select o_orderkey, o_orderstatus from orders where o_orderstatus <> 'O' or {h27("'under|' || o_orderkey::VARCHAR")} < 33554432""")
def _(t):
    return sampling.undersample(t.orders.select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "O", "o_orderkey", 0.25)


@query("set_6_quota_fill", f"""
with x as (select doc_id, source as g, lang, lang in ('en', 'de') as wanted, {h27("'quota|' || doc_id::VARCHAR")} as h from documents),
q as (select g, ceil(count(*) * 10 / 100.0)::BIGINT as quota from x where wanted group by g),
ranked as (select x.*, quota, row_number() over (partition by x.g, wanted order by h, doc_id) - 1 as rk from x join q on x.g = q.g)
select g, doc_id, lang, -1::BIGINT as variant from x where wanted
union all select g, doc_id, 'unknown', (rk // quota)::BIGINT from ranked where not wanted and rk // quota < 3
union all select g, rk, 'silence', -1::BIGINT from ranked where wanted and rk < quota""")
def _(t):
    x = t.documents.select("doc_id", F.col("source").alias("g"), "lang")
    return sampling.quota_fill(x, ["g"], "lang", F.col("lang").isin("en", "de"), "doc_id", 10, variants=3)


@query("set_6_disjoint_unknown", f"""
with x as (select doc_id, source, lang in ('en', 'de') as wanted, case when {h27("'part|' || doc_id::VARCHAR")} < 26843545 then 'valid' else 'train' end as split from documents),
q as (select split, ceil(count(*) * 10 / 100.0)::BIGINT as quota from x where wanted group by split),
u as (select case when {h27("'words|' || source")} < 26843545 then 'valid' else 'train' end as split, source, doc_id, {h27("'unknown|' || doc_id::VARCHAR")} as h from x where not wanted),
k as (select u.*, row_number() over (partition by split order by h, doc_id) as rk from u)
select k.split, source, doc_id from k join q using (split) where rk <= quota""")
def _(t):
    x = t.documents.select("doc_id", "source", "lang").withColumn("split", F.when(key_hash(F.lit("part"), "doc_id") < 26843545, "valid").otherwise("train"))
    return sampling.unknown_by_split(x, "split", "source", F.col("lang").isin("en", "de"), "doc_id", 10)


@query("set_7_augment", f"""
with x as (select vec_id, embedding as e, v, ({h27("vec_id::VARCHAR || '|' || v::VARCHAR")} % 64)::INTEGER as k from embeddings cross join range(0, 3) r(v)),
y as (select vec_id, v::INTEGER as variant, unnest(range(1, 65)) as i, e, k from x)
select vec_id, variant, round(sum(i * e[((i - 1 + 64 - k) % 64) + 1]::DOUBLE), 4) as checksum from y group by vec_id, variant""")
def _(t):
    x = sampling.fan_out(t.embeddings, 3).withColumn(
        "shifted", arrays.circular_shift("embedding", (key_hash("vec_id", "variant") % 64).cast("int")))
    weighted = F.aggregate(F.transform("shifted", lambda e, i: e.cast("double") * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return x.select("vec_id", "variant", F.round(weighted, 4).alias("checksum"))


@query("set_8_symmetric_pairs", """
with p as (select l_partkey as a, l_suppkey as b, l_quantity from lineitem)
select a, b, 0 as swapped, l_quantity from p union all select b, a, 1, l_quantity from p""")
def _(t):
    x = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity")
    return sampling.symmetric_pairs(x, "a", "b")


@query("set_8_average_both_orders", f"""
with p as (select o_orderkey as id, o_custkey as a, o_orderkey as b from orders),
s as (select id, {h27("a::VARCHAR || '|' || b::VARCHAR")} % 1000 / 1e3 as p from (select id, a, b from p union all select id, b, a from p))
select id, round(avg(p), 9) as score from s group by id""")
def _(t):
    pairs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
    scored = sampling.symmetric_pairs(pairs, "a", "b").withColumn("p", key_hash("a", "b") % 1000 / F.lit(1000.0))
    return scored.groupBy("id").agg(r(F.avg("p")).alias("score"))
