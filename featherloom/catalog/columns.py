"""Column transforms, filters and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.catalog.common import r
from featherloom.catalog.registry import query
from featherloom.functions import dates, scalars
from featherloom.operators import columns, filters, survey
from featherloom.plans.compose import compose

PRICE = ["l_quantity", "l_extendedprice", "l_discount"]


@query("prj_1_remain_columns", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _(t):
    return columns.remain_columns(t.orders, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("prj_2_drop_columns", "select l_linenumber, l_returnflag, l_linestatus, l_shipdate, l_orderkey, l_partkey, l_suppkey from lineitem")
def _(t):
    return columns.drop_columns(columns.drop_columns(t.lineitem, PRICE), prefix="l_tax")


@query("prj_3_narrow_types", """
select l_orderkey, l_linenumber::TINYINT as l_linenumber, l_quantity::FLOAT as l_quantity from lineitem""")
def _(t):
    return columns.narrow_types(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"))


@query("prj_4_minmax_signed", """
with s as (select min(l_quantity) as a, max(l_quantity) as b, min(l_extendedprice) as c, max(l_extendedprice) as d from lineitem)
select l_orderkey, l_linenumber, round(2 * ((l_quantity - a) / (b - a + 1e-7) - 0.5::DOUBLE), 9) + 0.0 as l_quantity,
       round(2 * ((l_extendedprice - c) / (d - c + 1e-7) - 0.5::DOUBLE), 9) + 0.0 as l_extendedprice
from lineitem, s""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = columns.normalization(df, ["l_quantity", "l_extendedprice"], 0)
    return out.withColumns({c: r(c) for c in ("l_quantity", "l_extendedprice")})


@query("prj_4_minmax_unit", """
with s as (select min(o_totalprice) as a, max(o_totalprice) as b from orders)
select o_orderkey, round((o_totalprice - a) / (b - a + 1e-7), 9) as o_totalprice from orders, s""")
def _(t):
    out = columns.normalization(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"], 1)
    return out.withColumn("o_totalprice", r("o_totalprice"))


@query("prj_5_descartes", """
select l_orderkey, round(l_quantity * l_discount, 6) as l_quantity_x_l_discount, round(l_quantity * l_tax, 6) as l_quantity_x_l_tax from lineitem""")
def _(t):
    out = columns.descartes(t.lineitem, ["l_quantity"], ["l_discount", "l_tax"])
    return out.select("l_orderkey", *[r(c, 6).alias(c) for c in ("l_quantity_x_l_discount", "l_quantity_x_l_tax")])


@query("prj_6_descartes_interaction", """
select l_orderkey, round(l_quantity * l_extendedprice, 4) as l_quantity_x_l_extendedprice,
       round(l_quantity * l_discount, 4) as l_quantity_x_l_discount,
       round(l_extendedprice * l_discount, 6) as l_extendedprice_x_l_discount from lineitem""")
def _(t):
    out = columns.descartes_interaction(t.lineitem, PRICE)
    return out.select("l_orderkey", r("l_quantity_x_l_extendedprice", 4).alias("l_quantity_x_l_extendedprice"),
                      r("l_quantity_x_l_discount", 4).alias("l_quantity_x_l_discount"),
                      r("l_extendedprice_x_l_discount", 6).alias("l_extendedprice_x_l_discount"))


@query("prj_7_clip_ratio", """
select o_orderkey, case when o_totalprice >= 400000 then 1.0::DOUBLE when o_totalprice <= 1000 then 0.0::DOUBLE
       else round((o_totalprice - 1000) / 399000, 4) end as ratio from orders""")
def _(t):
    text = t.orders.select("o_orderkey", F.col("o_totalprice").cast("string").alias("x"))
    return text.select("o_orderkey", scalars.clip_ratio("x", 1000, 400000).alias("ratio"))


@query("prj_8_level", """
select c_custkey, case when c_acctbal < 0 then 'L' when c_acctbal <= 5000 then 'M' else 'H' end as level from customer""")
def _(t):
    text = t.customer.select("c_custkey", F.col("c_acctbal").cast("string").alias("x"))
    return text.select("c_custkey", scalars.level("x", 0, 5000).alias("level"))


@query("prj_9_bin_label", """
select p_partkey, case when p_size <= 5 then '<5' when p_size >= 48 then '>48'
       when ceil((p_size - 5) / 8.0)::BIGINT * 8 + 5 < 48 then (ceil((p_size - 5) / 8.0)::BIGINT * 8 - 3)::VARCHAR || '_' || (ceil((p_size - 5) / 8.0)::BIGINT * 8 + 5)::VARCHAR
       else '40_48' end as bin from part""")
def _(t):
    text = t.part.select("p_partkey", F.col("p_size").cast("string").alias("x"))
    return text.select("p_partkey", scalars.bin_label("x", 5, 48, 8).alias("bin"))


@query("prj_10_binary_flags", """
select o_orderkey, (nullif(o_orderstatus, 'P') is not distinct from 'F')::DOUBLE as is_f,
       (nullif(o_orderstatus, 'P') is not null)::INTEGER as present, coalesce(nullif(o_orderstatus, 'P'), '') as shown
from orders""")
def _(t):
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.select("o_orderkey", scalars.is_value(s, "F").alias("is_f"),
                           scalars.is_present(s).alias("present"), scalars.blank_if_null(s).alias("shown"))


@query("prj_11_text_arithmetic", """
select l_orderkey, l_linenumber, l_quantity + 1 as plus_one, round(l_quantity + l_tax, 6) as plus,
       round(l_quantity - l_discount, 6) as minus from lineitem""")
def _(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", *[F.col(c).cast("string").alias(c) for c in ("l_quantity", "l_tax", "l_discount")])
    return x.select("l_orderkey", "l_linenumber", scalars.plus_one("l_quantity").alias("plus_one"),
                    r(scalars.plus("l_quantity", "l_tax"), 6).alias("plus"),
                    r(scalars.minus("l_quantity", "l_discount"), 6).alias("minus"))


@query("prj_12_sign_convert", """
with x as (select l_orderkey, l_linenumber, l_quantity, case when l_returnflag = 'R' then 'nan' when l_returnflag = 'A' then '阴性' else l_quantity::VARCHAR end as txt from lineitem)
select l_orderkey, l_linenumber, case when l_quantity > 25 then '+' else '-' end as one,
       case when txt = 'nan' then 'nan' when txt = '阴性' then '-' when txt::DOUBLE > 4 then '+' else '-' end as two,
       case when l_linenumber = 1 then '男' else '女' end as three
from x""")
def _(t):
    text = F.when(F.col("l_returnflag") == "R", "nan").when(F.col("l_returnflag") == "A", "阴性") \
        .otherwise(F.col("l_quantity").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", scalars.sign_by_limit("l_quantity", 25).alias("one"),
                             scalars.sign_by_text(text).alias("two"), scalars.sex_text("l_linenumber").alias("three"))


@query("prj_13_merge_signs", """
with x as (select l_orderkey, l_linenumber, case when l_quantity > 40 then '+' when l_quantity > 20 then '-' end as a,
                  case when l_discount > 0.08 then '+' when l_discount > 0.04 then '-' end as b from lineitem)
select l_orderkey, l_linenumber, case when a = '+' or b = '+' then '+' when a = '-' or b = '-' then '-' end as merged from x""")
def _(t):
    sign = lambda c, low, high: F.when(F.col(c) > high, "+").when(F.col(c) > low, "-")
    x = t.lineitem.select("l_orderkey", "l_linenumber", sign("l_quantity", 20, 40).alias("a"), sign("l_discount", 0.04, 0.08).alias("b"))
    return x.select("l_orderkey", "l_linenumber", scalars.merge_signs("a", "b").alias("merged"))


@query("prj_14_largest", """
select l_orderkey, l_linenumber, greatest(nullif(l_quantity, 50), l_linenumber * 10.0::DOUBLE, l_discount * 100.0::DOUBLE) as largest from lineitem""")
def _(t):
    q = F.when(F.col("l_quantity") == 50, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", scalars.largest(
        q, F.col("l_linenumber") * 10.0, F.col("l_discount") * 100.0).alias("largest"))


REG = "round_even(power(40 * x, 2), 0)::BIGINT"


@query("prj_15_region_parts", f"""
with x as (select c_custkey, nullif(abs(c_acctbal) / 1000, 0) as x from customer), n as (select c_custkey, {REG} as n from x)
select c_custkey, (n - n % 27) // 27 as m, n % 27 as f from n""")
def _(t):
    x = t.customer.select("c_custkey", (F.abs("c_acctbal") / 1000).alias("x"))
    return x.select("c_custkey", scalars.region_quotient("x").alias("m"), scalars.region_remainder("x").alias("f"))


@query("prj_16_region31", f"""
with x as (select c_custkey, abs(c_acctbal) / 1000 as x from customer), n as (select c_custkey, {REG} as n from x),
a as (select c_custkey, n, case when n % 31 = 0 then 31 else n % 31 end as a from n)
select c_custkey, case when a = 19 then -1 else a end as a, case when (n - a) // 31 = 51 then -1 else (n - a) // 31 end as m from a""")
def _(t):
    x = t.customer.select("c_custkey", (F.abs("c_acctbal") / 1000).alias("x"))
    a, m = scalars.region31("x")
    return x.select("c_custkey", a.alias("a"), m.alias("m"))


@query("prj_18_equal_width_bins", """
with s as (select min(l_extendedprice) as a, (max(l_extendedprice) - min(l_extendedprice)) / 50 as w from lineitem)
select l_orderkey, l_linenumber, l_extendedprice, greatest(ceil(round((l_extendedprice - a) / w, 9)) - 1, 0)::INTEGER as l_extendedprice_bin from lineitem, s""")
def _(t):
    return columns.equal_width_bins(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"])


@query("prj_19_shared_range", """
with s as (select min(least(l_quantity, l_discount, l_tax)) as lo, max(greatest(l_quantity, l_discount, l_tax)) as hi from lineitem)
select l_orderkey, round(2 * ((l_quantity - lo) / (hi - lo + 1e-8) - 0.5::DOUBLE), 9) + 0.0 as l_quantity,
       round(2 * ((l_discount - lo) / (hi - lo + 1e-8) - 0.5::DOUBLE), 9) + 0.0 as l_discount,
       round(2 * ((l_tax - lo) / (hi - lo + 1e-8) - 0.5::DOUBLE), 9) + 0.0 as l_tax from lineitem, s""")
def _(t):
    cols = ["l_quantity", "l_discount", "l_tax"]
    return columns.shared_range(t.lineitem.select("l_orderkey", *cols), cols).withColumns({c: r(c) for c in cols})


@query("prj_20_logit_pair", """
select l_orderkey, round(ln(p / (1 - p)), 9) + 0.0 as logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 9) as back
from (select l_orderkey, least(greatest(l_quantity / 51, 1e-6), 1 - 1e-6) as p from lineitem)""")
def _(t):
    x = t.lineitem.select("l_orderkey", scalars.logit(F.col("l_quantity") / 51).alias("z"))
    return x.select("l_orderkey", r("z").alias("logit"), r(scalars.inv_logit("z")).alias("back"))


@query("prj_21_missing_feature", """
with n as (select l_orderkey, (nullif(l_linenumber, 1) is null)::INTEGER + (nullif(l_discount, 0) is null)::INTEGER + (nullif(l_tax, 0) is null)::INTEGER as k,
     (l_linenumber = 1)::INTEGER as raw from lineitem), s as (select min(k) as a, max(k) as b from n)
select l_orderkey, round(2 * ((k - a) / (b - a + 1e-7) - 0.5::DOUBLE), 9) as negative_one_vals, raw from n, s""")
def _(t):
    x = t.lineitem.select("l_orderkey", F.nullif("l_linenumber", F.lit(1)).alias("a"), F.nullif("l_discount", F.lit(0.0)).alias("b"),
                          F.nullif("l_tax", F.lit(0.0)).alias("c"),
                          F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_linenumber")).alias("d"))
    out = columns.missing_feature(x, ["a", "b", "c"])
    return out.select("l_orderkey", r("negative_one_vals").alias("negative_one_vals"), scalars.sentinel_count(["d"]).alias("raw"))


@query("prj_22_fill_constants", """
select l_orderkey, coalesce(nullif(l_linenumber, 1), 0)::INTEGER as a, coalesce(nullif(l_discount, 0), -1)::DOUBLE as b from lineitem""")
def _(t):
    x = t.lineitem.select("l_orderkey", F.nullif("l_linenumber", F.lit(1)).alias("a"), F.nullif("l_discount", F.lit(0.0)).alias("b"))
    return columns.fill_constants(x, {"a": 0, "b": -1.0})


@query("prj_23_ordinal_map", """
with x as (select o_orderkey, 'status' as factor, o_orderstatus as display from orders
           union all select o_orderkey, 'price', o_totalprice::VARCHAR from orders)
select o_orderkey, factor, case when factor = 'price' then display::DOUBLE when display = 'F' then 1.0::DOUBLE when display = 'O' then 2.0::DOUBLE end as code,
       case when factor = 'status' and display not in ('F', 'O') then display end as error from x""")
def _(t):
    x = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("string").alias("price")) \
        .unpivot(["o_orderkey"], ["status", "price"], "factor", "display")
    out = columns.ordinal_map(x, "factor", "display", {("status", "F"): 1, ("status", "O"): 2})
    return out.select("o_orderkey", "factor", "code", "error")


INPUT_FEATURES = ["l_linenumber_1", "l_linenumber_2", "l_quantity_L", "l_quantity_M", "l_quantity_H", "l_tax", "absent"]
RISK = {"l_linenumber_1": 0.4, "l_linenumber_2": -0.3, "l_quantity_L": 0.2, "l_quantity_H": -0.6, "l_tax": 1.5}
INPUTS_SQL = """inputs as (select l_orderkey, (l_linenumber = 1)::DOUBLE as l_linenumber_1, (l_linenumber = 2)::DOUBLE as l_linenumber_2,
    (l_quantity < 10)::DOUBLE as "l_quantity_L", (l_quantity between 10 and 30)::DOUBLE as "l_quantity_M",
    (l_quantity > 30)::DOUBLE as "l_quantity_H", l_tax / 0.08::DOUBLE as l_tax, 0.0::DOUBLE as absent from lineitem)"""


def _inputs(t):
    return columns.model_inputs(t.lineitem, "l_orderkey", {"l_linenumber": (1, 2)}, {"l_quantity": (10, 30)}, ["l_tax"],
                                {"l_tax": (0.0, 0.08), "absent": (0.0, 0.0)}, INPUT_FEATURES)


@query("prj_24_model_inputs", f"""with {INPUTS_SQL} select * replace (round(l_tax, 9) as l_tax) from inputs""")
def _(t):
    return _inputs(t).withColumn("l_tax", r("l_tax"))


@query("prj_25_linear_risk", f"""with {INPUTS_SQL}
select l_orderkey, round(1 / (1 + exp(-(0.1 + 0.4 * l_linenumber_1 - 0.3 * l_linenumber_2 + 0.2 * "l_quantity_L" - 0.6 * "l_quantity_H" + 1.5 * l_tax))), 9) as risk from inputs""")
def _(t):
    return columns.linear_risk(_inputs(t), "l_orderkey", RISK, 0.1).withColumn("risk", r("risk"))


@query("prj_25_weight_report", f"""with {INPUTS_SQL}, w as (
select 'l_linenumber_1' as feature, 0.4::DOUBLE as weight, avg(0.4 * l_linenumber_1) as c from inputs union all
select 'l_linenumber_2', -0.3::DOUBLE, avg(-0.3 * l_linenumber_2) from inputs union all
select 'l_quantity_L', 0.2::DOUBLE, avg(0.2 * "l_quantity_L") from inputs union all
select 'l_quantity_H', -0.6::DOUBLE, avg(-0.6 * "l_quantity_H") from inputs union all
select 'l_tax', 1.5::DOUBLE, avg(1.5 * l_tax) from inputs)
select feature, weight, round(c, 9) as contribution from w""")
def _(t):
    return columns.weight_report(_inputs(t), RISK).withColumn("contribution", r("contribution"))


CODED_SQL = """coded as (select o_orderkey,
    case o_orderstatus when 'F' then '1' when 'O' then '0' end || (case when o_totalprice > 150000 then '1' else '0' end)
    || case substr(o_orderpriority, 1, 1) when '1' then '1' when '2' then '1' when '5' then null else '0' end as code from orders),
  kinds(code, explanation, kind) as (values
    ('000', 'HHMEMDRV:NO, DRVR_FLG:NO, TRPHHVEH:NO', 0), ('001', 'HHMEMDRV:NO, DRVR_FLG:NO, TRPHHVEH:YES', 1),
    ('010', 'HHMEMDRV:NO, DRVR_FLG:YES, TRPHHVEH:NO', 0), ('011', 'HHMEMDRV:NO, DRVR_FLG:YES, TRPHHVEH:YES', 0),
    ('100', 'HHMEMDRV:YES, DRVR_FLG:NO, TRPHHVEH:NO', 0), ('101', 'HHMEMDRV:YES, DRVR_FLG:NO, TRPHHVEH:YES', 1),
    ('110', 'HHMEMDRV:YES, DRVR_FLG:YES, TRPHHVEH:NO', 1), ('111', 'HHMEMDRV:YES, DRVR_FLG:YES, TRPHHVEH:YES', 0))"""


def _classified(t):
    first = F.substring("o_orderpriority", 1, 1)
    x = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "01").when(F.col("o_orderstatus") == "O", "02").otherwise("-9").alias("a"),
        F.when(F.col("o_totalprice") > 150000, "01").otherwise("02").alias("b"),
        F.when(first.isin("1", "2"), "01").when(first == "5", "-1").otherwise("02").alias("c"))
    return survey.classify_codes(x, ["a", "b", "c"])


@query("prj_26_bit_code_class", f"with {CODED_SQL} select o_orderkey, code, kind from coded join kinds using (code)")
def _(t):
    return _classified(t).select("o_orderkey", "code", "kind")


@query("agg_13_code_counts", f"""with {CODED_SQL}
select code, explanation, kind, count(o_orderkey) as n from kinds left join coded using (code) group by all""")
def _(t):
    return survey.count_codes(_classified(t))


@query("prj_27_keyed_json", """
select o_orderkey, '{"price":{"rank":"' || substr(o_orderpriority, 1, 1) || '","val":"' || (o_totalprice::BIGINT)::VARCHAR
       || '"},"status":{"val":"' || o_orderstatus || '"}}' as json from orders""")
def _(t):
    x = t.orders.select("o_orderkey", F.lit("PriceRank,Price,Status").alias("names"), F.concat_ws(
        ",", F.substring("o_orderpriority", 1, 1), F.bround("o_totalprice").cast("long").cast("string"), "o_orderstatus").alias("vals"))
    return columns.keyed_json(x, "o_orderkey", "names", "vals", {
        "Price": ("price", "val"), "PriceRank": ("price", "rank"), "Status": ("status", "val")})


@query("prj_28_row_total", "select l_orderkey, round(l_quantity + l_discount + l_tax, 6) as total from lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", r(scalars.row_total(["l_quantity", "l_discount", "l_tax"]), 6).alias("total"))


@query("prj_29_repair_values", """
select o_orderkey, case when contains(x, '70') then '70' when contains(x, 'LOW') then null else x end as repaired
from (select o_orderkey, case when o_orderkey % 2 = 0 then o_orderpriority else (o_totalprice::BIGINT)::VARCHAR end as x from orders)""")
def _(t):
    x = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.bround("o_totalprice").cast("long").cast("string"))
    return t.orders.select("o_orderkey", scalars.repair(x, {"70": "70"}, ["LOW"]).alias("repaired"))


@query("prj_30_compose", """
with s as (select min(l_quantity) as a, max(l_quantity) as b from lineitem)
select l_orderkey, round(2 * ((l_quantity - a) / (b - a + 1e-7) - 0.5::DOUBLE), 9) + 0.0 as l_quantity,
       round(2 * ((l_quantity - a) / (b - a + 1e-7) - 0.5::DOUBLE) * l_tax, 9) + 0.0 as l_quantity_x_l_tax from lineitem, s""")
def _(t):
    chain = compose([
        (columns.remain_columns, {"cols": ["l_orderkey", "l_quantity", "l_tax"]}),
        (columns.normalization, {"cols": ["l_quantity"], "val_range": 0}),
        (columns.descartes, {"left": ["l_quantity"], "right": ["l_tax"]}),
        (columns.drop_columns, {"cols": ["l_tax"]}),
    ])
    return chain(t.lineitem).withColumns({c: r(c) for c in ("l_quantity", "l_quantity_x_l_tax")})


@query("prj_32_signed_label", "select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 1 else -1 end as y from lineitem")
def _(t):
    label = (F.col("l_returnflag") == "R").cast("int")
    return t.lineitem.select("l_orderkey", "l_linenumber", scalars.class_value(label, {0: -1, 1: 1}).alias("y"))


@query("prj_33_sample_weight", "select doc_id, case when toxic = 0 then 1.309028344::DOUBLE when toxic = 1 then 0.472001959::DOUBLE end as weight from labels")
def _(t):
    return t.labels.select("doc_id", scalars.class_value("toxic", {0: 1.309028344, 1: 0.472001959}).alias("weight"))


# -- filters -----------------------------------------------------------------------------------

@query("flt_1_keep_complete", "select l_orderkey, l_linenumber, l_discount from lineitem where nullif(l_linenumber, 1) is not null and nullif(l_discount, 0) is not null")
def _(t):
    x = t.lineitem.select("l_orderkey", F.nullif("l_linenumber", F.lit(1)).alias("l_linenumber"), F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return filters.keep_complete(x, ["l_linenumber", "l_discount"])


@query("flt_2_keep_listed", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_acctbal < 0)")
def _(t):
    return filters.keep_listed(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where("c_acctbal < 0"), "c_custkey")


@query("flt_3_drop_flagged", "select o_orderkey, nullif(o_orderstatus, 'P') as s from orders where nullif(o_orderstatus, 'P') is distinct from 'F'")
def _(t):
    return filters.drop_flagged(t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s")), "s", "F")


@query("flt_4_keep_real", """
with x as (select o_orderkey, case when o_orderstatus = 'P' then '  ' else o_orderkey::VARCHAR end as k, case when o_orderstatus = 'O' then ' -' else o_orderpriority end as v from orders)
select o_orderkey, k, v from x where trim(k) <> '' and trim(v) not in ('-', '─')""")
def _(t):
    s = F.col("o_orderstatus")
    x = t.orders.select("o_orderkey", F.when(s == "P", "  ").otherwise(F.col("o_orderkey").cast("string")).alias("k"),
                        F.when(s == "O", " -").otherwise(F.col("o_orderpriority")).alias("v"))
    return filters.keep_real(x, "k", "v")


@query("flt_5_drop_outliers", """
select o_orderkey, o_totalprice from orders
where o_totalprice <= (select avg(o_totalprice) + 1.5 * stddev_samp(o_totalprice) from orders)""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    limit = orders.agg((F.avg("o_totalprice") + 1.5 * F.stddev_samp("o_totalprice")).alias("_limit"))
    outliers = columns.with_row(orders, limit).where("o_totalprice > _limit")
    return filters.drop_keys(orders, "o_orderkey", outliers)


@query("flt_6_violations", """
select 'legal_flag' as rule, count(*) filter (l_returnflag not in ('A', 'N')) as bad from lineitem
union all select 'no_null', count(*) filter (nullif(l_discount, 0) is null) from lineitem""")
def _(t):
    return filters.violations(t.lineitem, {
        "legal_flag": F.col("l_returnflag").isin("A", "N"),
        "no_null": F.nullif("l_discount", F.lit(0.0)).isNotNull()})


@query("flt_7_blank_unknown", """
select doc_id, case when source in (select source from documents group by source having count(*) > 20) then source else '' end as source from documents""")
def _(t):
    known = t.documents.groupBy("source").count().where("count > 20")
    return filters.blank_unknown(t.documents.select("doc_id", "source"), "source", known, "source")


@query("flt_8_any_token", """
select doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w in ('the', 'und', 'les'))) > 0 as hit from documents""")
def _(t):
    return t.documents.select("doc_id", filters.has_any_token("text", ["the", "und", "les"]).alias("hit"))


@query("flt_9_keep_words", """
with w as (select doc_id, unnest(string_split(text, ' ')) as w from documents)
select w, count(*) as n from w where not regexp_matches(w, '^[-+]?[0-9]+$') and not contains(w, 'mm') and not contains(w, 'cm')
  and w not in ('the', 'of', 'und') group by w""")
def _(t):
    words = t.documents.select(F.explode(F.split("text", " ")).alias("w"))
    return filters.keep_words(words, "w", ["the", "of", "und"]).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


# -- dates -------------------------------------------------------------------------------------

@query("dat_1_age", """
select o_orderkey, year(o_orderdate)::INTEGER - (1900 + o_custkey % 90)::INTEGER as age from orders""")
def _(t):
    x = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("check"),
                        F.concat((1900 + F.col("o_custkey") % 90).cast("string"), F.lit("-7-1")).alias("birth"))
    return x.select("o_orderkey", dates.age_from_dates("check", "birth").alias("age"))


@query("dat_2_compact_date", "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as d from orders")
def _(t):
    x = t.orders.select("o_orderkey", F.date_format("o_orderdate", "y-M-d").alias("x"))
    return x.select("o_orderkey", dates.compact_date("x").alias("d"))


@query("dat_3_utc_to_pacific", """
select event_id, strftime(ts - interval 1 hour * (case when ts >= '2024-03-10 10:00:00' and ts < '2024-11-03 09:00:00' then 7 else 8 end), '%m/%d/%Y %H:%M:%S') as local_time from events""")
def _(t):
    x = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("x"))
    return x.select("event_id", dates.utc_to_local("x", target="MM/dd/yyyy HH:mm:ss").alias("local_time"))


@query("dat_4_slash_date", "select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as d from orders")
def _(t):
    return t.orders.select("o_orderkey", dates.slash_date("o_orderdate").alias("d"))
