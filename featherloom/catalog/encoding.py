"""Statistics, one-hot, dense code, target encoding and imputation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.catalog.common import h27, r
from featherloom.catalog.registry import query
from featherloom.operators import encode, evaluate, folds

FLOATS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("agg_1_column_stats", " union all ".join(f"""
select '{c}' as name, round(avg({c}), 6) as mean, round(median({c}), 6) as median, round(skewness({c}), 6) + 0.0 as skew
from (select {'nullif(l_discount, 0) as l_discount' if c == 'l_discount' else c} from lineitem)""" for c in FLOATS))
def _(t):
    df = t.lineitem.select(*FLOATS).withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return encode.column_stats(df, FLOATS).withColumns({c: r(c, 6) for c in ("mean", "median", "skew")})


@query("agg_2_above_center", """
with x as (select l_orderkey, l_linenumber, l_quantity, nullif(l_discount, 0) as d from lineitem),
s as (select median(l_quantity) as mq, avg(l_quantity) as aq, median(d) as md, avg(d) as ad from x)
select l_orderkey, l_linenumber, (l_quantity > mq)::INTEGER as l_quantity_median_range, coalesce(d > md, false)::INTEGER as d_median_range,
       (l_quantity > aq)::INTEGER as l_quantity_mean_range, coalesce(d > ad, false)::INTEGER as d_mean_range from x, s""")
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("d"))
    return encode.above_center_flags(x, ["l_quantity", "d"]).drop("l_quantity", "d")


@query("agg_3_value_counts", """
select 'o_orderstatus' as name, coalesce(nullif(o_orderstatus, 'P'), 'nan') as value, count(*) as n from orders group by all
union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by all""")
def _(t):
    x = t.orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_orderpriority", "o_orderkey")
    return encode.bounded_value_counts(x, ["o_orderstatus", "o_orderpriority", "o_orderkey"])


@query("agg_4_one_hot", """
select o_orderkey, (s = 'F')::FLOAT as "o_orderstatus_F", (s = 'O')::FLOAT as "o_orderstatus_O", (s = 'nan')::FLOAT as "o_orderstatus_nan"
from (select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'nan') as s from orders)""")
def _(t):
    x = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"))
    return encode.one_hot(x, encode.fit_one_hot(x, ["o_orderstatus", "o_orderkey"]))


@query("agg_5_frequent_one_hot", """
select c_custkey as id, (c_mktsegment = 'AUTOMOBILE')::FLOAT as "seg_oh_AUTOMOBILE", (c_mktsegment = 'BUILDING')::FLOAT as "seg_oh_BUILDING",
  (c_mktsegment = 'FURNITURE')::FLOAT as "seg_oh_FURNITURE", (c_mktsegment = 'HOUSEHOLD')::FLOAT as "seg_oh_HOUSEHOLD",
  (c_mktsegment = 'MACHINERY')::FLOAT as "seg_oh_MACHINERY", c_acctbal from customer""")
def _(t):
    x = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), "c_acctbal",
                          folds.percent_split(F.col("c_name"), 0, 30).alias("part"))
    train, test = x.where("part = 'train'").drop("part"), x.where("part = 'test'").drop("part")
    kept = encode.fit_frequent_one_hot(train, test, ["seg"], 50)
    return encode.one_hot(train.unionByName(test), kept, joiner="_oh_")


@query("agg_6_one_hot_by_unique", """
select l_orderkey, l_linenumber, s as l_returnflag, l_tax, (s is not distinct from 'A')::FLOAT as "l_returnflag_oh_A", (s is not distinct from 'R')::FLOAT as "l_returnflag_oh_R"
from (select l_orderkey, l_linenumber, l_tax, nullif(l_returnflag, 'N') as s from lineitem)""")
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), "l_tax")
    fitted = encode.fit_one_hot_by_unique(x, ["l_returnflag", "l_tax"], 3, 6)
    return encode.one_hot(x, fitted, joiner="_oh_", keep=True)


def _labelled(t):
    """Line items with the order priority (null for one level), a label, and a fold by order key."""
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey",
                             F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y")) \
        .join(orders, "l_orderkey").withColumn("fold", folds.shuffled_fold("l_orderkey", 5))


LABELLED_SQL = f"""labelled as (select l_orderkey, l_linenumber, (l_returnflag = 'R')::INTEGER as y, o_custkey,
    nullif(o_orderpriority, '5-LOW') as priority, ({h27("'0|' || l_orderkey::VARCHAR")} % 5)::INTEGER as fold
  from lineitem join orders on l_orderkey = o_orderkey)"""


def _encoded_sql(col: str, min_leaf: float, smoothing: float) -> str:
    return f"""priors as (select f.fold, avg(l.y) as prior from (select distinct fold from labelled) f join labelled l on l.fold <> f.fold group by f.fold),
  cells as (select {col} as v, fold, count(*) as n, sum(y) as s from labelled group by all),
  others as (select a.v, a.fold, coalesce(sum(b.n), 0)::DOUBLE as n, coalesce(sum(b.s), 0)::DOUBLE as s from cells a left join cells b on a.v = b.v and a.fold <> b.fold group by all),
  tab as (select v, fold, case when v is null or n = 0 then prior else prior * (1 - 1 / (1 + exp(-(n - {min_leaf}) / {smoothing}::DOUBLE))) + s / n / (1 + exp(-(n - {min_leaf}) / {smoothing}::DOUBLE)) end as enc
          from others join priors using (fold)),
  encoded as (select l.l_orderkey, l.l_linenumber, l.y, l.fold, round(t.enc, 9) as enc from labelled l join tab t on l.{col} is not distinct from t.v and l.fold = t.fold)"""


@query("agg_7_target_encode", f"with {LABELLED_SQL}, {_encoded_sql('o_custkey', 20, 10)} select l_orderkey, l_linenumber, fold, enc from encoded")
def _(t):
    out = encode.oof_target_encode(_labelled(t), "o_custkey", "y", "fold", min_leaf=20, smoothing=10, out="enc")
    return out.select("l_orderkey", "l_linenumber", "fold", r("enc").alias("enc"))


@query("agg_7_fold_mean_encode", f"""with {LABELLED_SQL}, tr as (select * from labelled where l_linenumber > 1), te as (select * from labelled where l_linenumber = 1),
pri as (select f.fold, avg(l.y) as prior from (select distinct fold from tr) f join tr l on l.fold <> f.fold group by f.fold),
cells as (select o_custkey as v, fold, count(*) as n, sum(y) as s from tr group by all), tot as (select v, sum(n) as n, sum(s) as s from cells group by v),
grid as (select tot.v, prior, (tot.n - coalesce(c.n, 0))::DOUBLE as n, (tot.s - coalesce(c.s, 0))::DOUBLE as s from tot cross join pri p left join cells c on c.v = tot.v and c.fold = p.fold),
enc as (select v, avg(case when n = 0 then prior else prior * (1 - 1 / (1 + exp(-(n - 20) / 10::DOUBLE))) + s / n / (1 + exp(-(n - 20) / 10::DOUBLE)) end) as enc from grid group by v)
select l_orderkey, l_linenumber, round(coalesce(enc, (select avg(prior) from pri)), 9) as enc from te left join enc on o_custkey = v""")
def _(t):
    rows = _labelled(t)
    out = encode.fold_mean_encode(rows.where("l_linenumber > 1"), rows.where("l_linenumber = 1"), "o_custkey", "y", "fold", min_leaf=20, smoothing=10, out="enc")
    return out.select("l_orderkey", "l_linenumber", r("enc").alias("enc"))


@query("agg_7_target_encode_auc", f"""with {LABELLED_SQL}, {_encoded_sql('priority', 200, 10)},
ranks as (select fold, y, rank() over (partition by fold order by enc) + (count(*) over (partition by fold, enc) - 1) / 2.0 as rk from encoded)
select fold, round((sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2.0)::DOUBLE / (sum(y) * (count(*) - sum(y)))::DOUBLE, 9) as auc from ranks group by fold""")
def _(t):
    out = encode.oof_target_encode(_labelled(t), "priority", "y", "fold", min_leaf=200, smoothing=10, out="enc")
    return evaluate.roc_auc(out.withColumn("enc", r("enc")), ["fold"], "y", "enc").select("fold", r("auc").alias("auc"))


@query("jon_3_lookup_or_prior", f"""with {LABELLED_SQL}, p as (select avg(y) as prior from labelled where fold <> 0),
  tab as (select priority, count(*)::DOUBLE as n, sum(y)::DOUBLE as s from labelled where fold <> 0 group by priority)
select l.l_orderkey, l.l_linenumber, round(case when t.n is null then prior
  else prior * (1 - 1 / (1 + exp(-(n - 200) / 10::DOUBLE))) + s / n / (1 + exp(-(n - 200) / 10::DOUBLE)) end, 9) as enc
from labelled l left join tab t using (priority), p where l.fold = 0""")
def _(t):
    rows = _labelled(t)
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    table = encode.fit_target_table(train, "priority", "y", 200, 10)
    out = encode.lookup_or_prior(test, table, "priority", train.agg(F.avg("y").alias("prior")), "enc")
    return out.select("l_orderkey", "l_linenumber", r("enc").alias("enc"))


@query("agg_8_impute", """
with x as (select l_orderkey, nullif(l_returnflag, 'N') as l_returnflag, nullif(l_linenumber, 2) as l_linenumber, nullif(l_quantity, 1) as l_quantity, nullif(l_discount, 0) as l_discount from lineitem),
s as (select (select l_returnflag from x where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1) as m1, median(l_quantity) as m3, median(l_linenumber)::DOUBLE as m2, avg(l_discount) as m4 from x)
select l_orderkey, coalesce(l_returnflag, m1) as l_returnflag, coalesce(l_linenumber, m2) as l_linenumber, coalesce(l_quantity, m3) as l_quantity, round(coalesce(l_discount, m4), 9) as l_discount from x, s""")
def _(t):
    x = t.lineitem.select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("l_returnflag"), F.nullif("l_linenumber", F.lit(2)).alias("l_linenumber"),
                          F.nullif("l_quantity", F.lit(1.0)).alias("l_quantity"), F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    out = encode.impute(x, modes=["l_returnflag"], medians=["l_linenumber", "l_quantity"], means=["l_discount"])
    return out.withColumn("l_discount", r("l_discount"))


@query("agg_9_distinct_counts", " union all ".join(f"""
select l_linestatus as source, '{c}' as name, count(distinct {c}) as distinct_values from lineitem group by 1""" for c in ("l_partkey", "l_suppkey", "l_quantity")))
def _(t):
    x = t.lineitem.select(F.col("l_linestatus").alias("source"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity"))
    return encode.distinct_counts(x, ["l_partkey", "l_suppkey", "l_quantity"], "source")


@query("win_6_sorted_codes", "select p_name, row_number() over (order by p_name) - 1 as code from (select distinct p_name from part)")
def _(t):
    return encode.sorted_codes(t.part, "p_name")


@query("win_6_frequency_codes", """
select w, n, row_number() over (order by n desc, w) as code from (
  select w, count(*) as n from (select unnest(string_split(lower(text), ' ')) as w from documents) group by w)""")
def _(t):
    words = t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return encode.frequency_codes(words, "w")


@query("win_6_first_seen_codes", """
select p_brand, row_number() over (order by k, p_brand) - 1 as code from (select p_brand, min(p_partkey) as k from part group by p_brand)""")
def _(t):
    return encode.first_seen_codes(t.part, "p_brand", "p_partkey")


@query("mlf_10_category_index", """
with c as (select o_custkey, row_number() over (order by o_custkey) as code from (select distinct o_custkey from orders where o_orderdate < '1993-06-01'))
select o_orderkey, coalesce(code, 0) as idx from orders left join c using (o_custkey)""")
def _(t):
    codes = encode.sorted_codes(t.orders.where("o_orderdate < '1993-06-01'"), "o_custkey", start=1)
    return encode.apply_codes(t.orders.select("o_orderkey", "o_custkey"), codes, "o_custkey", "idx", 0).select("o_orderkey", "idx")


@query("prj_17_combine_codes", """
with x as (select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'nan') || '_' || o_orderpriority as v from orders)
select o_orderkey, v as status_plus_priority, c.code from x join (select v, row_number() over (order by v) - 1 as code from (select distinct v from x)) c using (v)""")
def _(t):
    from featherloom.functions.scalars import combine

    x = t.orders.select("o_orderkey", combine(F.nullif("o_orderstatus", F.lit("P")), "o_orderpriority").alias("status_plus_priority"))
    codes = encode.sorted_codes(x, "status_plus_priority")
    return encode.apply_codes(x, codes, "status_plus_priority", "code").select("o_orderkey", "status_plus_priority", "code")


@query("src_10_sparse_rows", """
with x as (select o_orderkey, (o_orderstatus = 'F')::INTEGER as y, 0 as f, o_orderstatus as v from orders
  union all select o_orderkey, (o_orderstatus = 'F')::INTEGER, 1, o_orderpriority from orders
  union all select o_orderkey, (o_orderstatus = 'F')::INTEGER, 2, o_custkey::VARCHAR from orders),
c as (select f, v, row_number() over (order by f, v) - 1 as code from (select distinct f, v from x))
select o_orderkey, y::VARCHAR || ' ' || string_agg(f::VARCHAR || ':' || code::VARCHAR || ':1', ' ' order by f) as line from x join c using (f, v) group by o_orderkey, y""")
def _(t):
    x = t.orders.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return encode.sparse_rows(x, "o_orderkey", "y", ["o_orderstatus", "o_orderpriority", "o_custkey"])
