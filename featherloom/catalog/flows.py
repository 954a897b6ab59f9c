"""Source, sink, flow, streaming and learning queries."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

from featherloom.catalog.common import ORDER_SCORES, h27, order_scores, r
from featherloom.catalog.registry import query
from featherloom.catalog.text import WORD_TFIDF, tok
from featherloom.functions import arrays, textrules as tr
from featherloom.functions.hashing import key_hash
from featherloom.operators import boost, cbow, folds, learn, linear, relations, textfeat
from featherloom.plans.flow import apply_column, fit_flow, run_flow
from featherloom.session import scratch_path, stored
from featherloom.sources import scan, sinks
from featherloom.streaming import chunks

# -- sources and sinks -------------------------------------------------------------------------


@query("src_1_scan_csv", """
select l_orderkey, nullif(l_linenumber, 1) as l_linenumber, case when l_discount <> 0 then l_discount end as l_discount, l_returnflag from lineitem""")
def _(t):
    x = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") == 1, -1).otherwise(F.col("l_linenumber")).alias("l_linenumber"),
                          F.when(F.col("l_discount") == 0, -1.0).otherwise(F.col("l_discount")).alias("l_discount"), "l_returnflag")
    path = sinks.write_csv(x, scratch_path(t.spark, "csv"))
    return scan.scan_csv(t.spark, path, "l_orderkey bigint, l_linenumber int, l_discount double, l_returnflag string")


@query("src_2_scan_text_csv", "select o_orderkey::VARCHAR as o_orderkey, o_orderstatus, o_orderpriority from orders")
def _(t):
    path = sinks.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), scratch_path(t.spark, "csv"))
    return scan.scan_text_csv(t.spark, path, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("src_3_scan_tsv", "select p_partkey::VARCHAR as id, p_name as name from part")
def _(t):
    path = sinks.write_tsv(t.part.select("p_partkey", "p_name"), scratch_path(t.spark, "tsv"))
    return scan.scan_tsv(t.spark, path, ["_c0", "_c1"], {"_c0": "id", "_c1": "name"})


@query("src_4_scan_positions", "select o_orderkey::VARCHAR as id, o_orderstatus as status from orders where o_orderstatus <> 'P'")
def _(t):
    line = F.when(F.col("o_orderstatus") == "P", "short,line").otherwise(
        F.concat_ws(",", "o_orderpriority", F.col("o_orderkey").cast("string"), F.lit("x"), F.concat(F.lit(" "), "o_orderstatus")))
    path = sinks.write_lines(t.orders.select(line.alias("value")), "value", scratch_path(t.spark, "lines"))
    return scan.scan_positions(t.spark, path, {"id": 1, "status": 3})


@query("src_5_scan_documents", "select source as id, count(*) as docs from documents group by source")
def _(t):
    path = scratch_path(t.spark, "docs")
    x = t.documents.select("lang", "source", F.regexp_replace("text", r"[\r\n]", " ").alias("value"))
    x.write.partitionBy("lang", "source").text(path)
    found = scan.scan_documents(t.spark, path, "part-*", r"source=([^/]*)/")
    return found.groupBy("id").agg(F.sum(F.regexp_count("content", F.lit(r"\n"))).cast("long").alias("docs"))


@query("src_6_scan_predictions", f"with {ORDER_SCORES} select model, id, round(p, 4) as p from order_scores")
def _(t):
    path = scratch_path(t.spark, "preds")
    order_scores(t).select("model", "id", "p").write.option("header", True).partitionBy("model").csv(path)
    return scan.scan_predictions(t.spark, path, "id bigint, p double", r"model=([^/]+)/").withColumn("p", r("p", 4))


@query("src_7_json_lines", "select event_id, event_type, (props::JSON ->> 'k')::BIGINT as k from events")
def _(t):
    x = t.events.select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k")).alias("info"))
    path = sinks.write_json_lines(x, scratch_path(t.spark, "json"))
    back = scan.scan_json_lines(t.spark, path, "event_id bigint, info map<string,string>")
    return back.select("event_id", F.col("info")["type"].alias("event_type"), F.col("info")["k"].cast("long").alias("k"))


@query("src_8_csv_sink", "select o_orderkey::VARCHAR as o_orderkey, printf('%.7f', o_totalprice) as o_totalprice from orders")
def _(t):
    path = sinks.write_csv(t.orders.select("o_orderkey", "o_totalprice"), scratch_path(t.spark, "csv"), ["o_totalprice"])
    return scan.scan_text_csv(t.spark, path, ["o_orderkey", "o_totalprice"])


@query("src_9_word_vectors", "select vec_id::VARCHAR as word, len(embedding)::INTEGER as n, round(list_sum(embedding)::DOUBLE, 4) + 0.0 as total from embeddings")
def _(t):
    path = sinks.write_word_vectors(t.embeddings, "vec_id", "embedding", scratch_path(t.spark, "vectors"))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return scan.scan_word_vectors(t.spark, path).select("word", F.size("vec").alias("n"), r(total, 4).alias("total"))


@query("src_11_table_store", """
select c_custkey as id, c_name as name, c_acctbal as salary from customer union all select s_suppkey + 1000000, s_name, s_acctbal from supplier order by id desc""")
def _(t):
    people = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("salary"))
    more = t.supplier.select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("salary"))
    return sinks.TableStore(t.spark, "company").create(people).insert(more).newest_first("id")


@query("src_12_save_stage", "select l_orderkey, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by l_orderkey")
def _(t):
    stage = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("q"))
    return sinks.save_stage(stage)


# -- sorts -------------------------------------------------------------------------------------

@query("srt_1_order_by_count", "select c_mktsegment, count(*) as n, round(sum(c_acctbal), 2) as total from customer group by c_mktsegment order by n desc, abs(sum(c_acctbal)) desc, c_mktsegment")
def _(t):
    x = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r(F.sum("c_acctbal"), 2).alias("total"))
    return x.orderBy(F.col("n").desc(), F.abs("total").desc(), "c_mktsegment")


CORR_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]
CORR_SQL = " union all ".join(f"select '{c}' as name, corr(l_extendedprice, {c}) as corr from lineitem" for c in CORR_COLS)


@query("srt_2_correlation_report", f"""
with c as ({CORR_SQL}), n as (select *, row_number() over (order by corr desc, name) as t, row_number() over (order by corr, name) as b from c)
select 'top' as side, t::INTEGER as position, name, round(corr, 6) + 0.0 as corr from n where t <= 3
union all select 'bottom', b::INTEGER, name, round(corr, 6) + 0.0 from n where b <= 3""")
def _(t):
    return learn.correlation_report(t.lineitem, "l_extendedprice", CORR_COLS, 3).withColumn("corr", r("corr", 6))


# -- flows and streams -------------------------------------------------------------------------

FLOW = [
    [
        ("remain_columns", ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey"]),
        ("keep_complete", ["o_orderstatus", "o_totalprice"]),
    ],
    [
        ("plus", [("o_totalprice", "o_custkey", "price_plus")]),
        ("largest", [("o_totalprice", "o_custkey", "o_orderkey", "largest")]),
        ("clip_ratio", [("o_totalprice", 1000, 400000)]),
        ("level", [("o_custkey", 100, 1000)]),
        ("is_value", [("o_orderpriority", "1-URGENT")]),
        ("one_hot", ["o_orderstatus"]),
    ],
]


def _flow_input(t):
    return t.orders.select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey")],
                           F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.lit("unused").alias("extra"))


FLOW_SQL = """select o_orderkey::VARCHAR as o_orderkey, case when o_totalprice >= 400000 then 1.0::DOUBLE when o_totalprice <= 1000 then 0.0::DOUBLE else round((o_totalprice - 1000) / 399000, 4) end as o_totalprice,
  (o_orderpriority = '1-URGENT')::DOUBLE as o_orderpriority, case when o_custkey < 100 then 'L' when o_custkey <= 1000 then 'M' else 'H' end as o_custkey,
  round(o_totalprice + o_custkey, 4) as price_plus, greatest(o_totalprice, o_custkey, o_orderkey)::DOUBLE as largest,
  (o_orderstatus = 'F')::FLOAT as "o_orderstatus_F", (o_orderstatus = 'O')::FLOAT as "o_orderstatus_O" from orders where o_orderstatus <> 'P'"""


@query("prj_31_declared_flow", FLOW_SQL)
def _(t):
    return run_flow(_flow_input(t), FLOW).withColumn("price_plus", r("price_plus", 4))


@query("stm_1_flow_on_chunks", FLOW_SQL)
def _(t):
    batch = _flow_input(t)
    chunked = scratch_path(t.spark, "chunks")
    batch.write.option("maxRecordsPerFile", max(1, batch.count() // 3)).parquet(chunked)
    stream = chunks.read_chunks(t.spark, chunked, batch.schema)
    out = chunks.run_flow_on_stream(stream, fit_flow(batch, FLOW), scratch_path(t.spark, "sink"), scratch_path(t.spark, "progress"))
    return out.withColumn("price_plus", r("price_plus", 4))


@query("stm_2_counts_on_chunks", """
select 'event_type' as name, event_type as value, count(*) as n from events group by all union all select 'user_id', user_id::VARCHAR, count(*) from events group by all""")
def _(t):
    events = t.events.select("event_type", "user_id")
    chunked = scratch_path(t.spark, "chunks")
    events.write.option("maxRecordsPerFile", max(1, events.count() // 3)).parquet(chunked)
    return chunks.count_values_on_stream(chunks.read_chunks(t.spark, chunked, events.schema, 2), ["event_type", "user_id"], scratch_path(t.spark, "progress"))


@query("udf_1_apply_column", "select p_partkey, upper(p_name[1]) || p_name[2:] as p_name from part")
def _(t):
    @F.pandas_udf("string")
    def capital(s: pd.Series) -> pd.Series:
        return s.str[:1].str.upper() + s.str[1:]

    return apply_column(t.part.select("p_partkey", "p_name"), "p_name", capital)


# -- learning: fixed steps on exact sums, so that SQL takes the same steps -----------------------

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def _learning_rows(t):
    """One row per order with summed line features, the label, and a fold; written once, since every fit and its statistics read it."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(*[F.round(F.sum(F.col(c).cast("double")), 4).alias(c) for c in FEATURES])
    orders = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("double").alias("y"))
    return stored(lines.join(orders, "id").withColumn("fold", folds.shuffled_fold("id", 3)), "features")


FOLD = f"({h27("'0|' || {0}::VARCHAR")} % 3)::INTEGER"
LINES_SQL = f"""rows_ as (select o_orderkey as id, (o_orderstatus = 'F')::DOUBLE as y, {FOLD.format('o_orderkey')} as fold
  from orders where o_orderkey in (select l_orderkey from lineitem))"""
LABELLED_SQL = f"""labelled as (select doc_id, label_name, truth::INTEGER as truth, {FOLD.format('doc_id')} as fold
  from (select doc_id, 'quality' as label_name, quality as truth from labels union all select doc_id, 'toxic', toxic from labels) join documents using (doc_id))"""


STEPS = 8
DOCUMENT_TASKS = [(name, fold) for name in ("quality", "toxic") for fold in range(3)]


def _steps_sql(models: list[tuple], steps: int, rate: float, scaled: bool = False) -> str:
    """Fixed steps of accelerated gradient descent over cells (id, term, w) and targets (id, label_name, fold, y), as a chain of tables.

    ``models`` are (m, label, fold, penalty); ``scaled`` multiplies cells by ratio (m, term, r). The last tables are w{steps} and b{steps}.
    """
    x = "(select m, id, term, cells.w * r as w from cells join ratio using (term))" if scaled else "(select m, id, term, w from cells cross join models)"
    out = [f"models(m, label_name, fold, pen) as (values {', '.join(f"({m}, '{l}', {f}, {c}::DOUBLE)" for m, l, f, c in models)})",
           "seen as materialized (select m, id, y::DOUBLE as y from targets t join models using (label_name) where t.fold <> models.fold)", "sizes_ as (select m, count(*) as n from seen group by m)",
           f"x as materialized (select * from {x})",
           "w0 as (select m, term, 0.0::DOUBLE as w, 0.0::DOUBLE as prev from models cross join (select distinct term from cells))", "b0 as (select m, 0.0::DOUBLE as w, 0.0::DOUBLE as prev from models)"]
    for k in range(steps):
        push = f"{k}::DOUBLE / {k + 3}"
        out.append(f"""a{k} as materialized (select m, term, w, w + {push} * (w - prev) as a from w{k}), d{k} as materialized (select m, w, w + {push} * (w - prev) as a from b{k}),
r{k} as materialized (select m, id, 1 / (1 + exp(-(coalesce(z, 0) + a))) - y as r from seen left join (select m, id, sum(x.w * a) as z from x join a{k} using (m, term) group by all) using (m, id) join d{k} using (m)),
w{k + 1} as materialized (select m, term, a - (1 / (1 / {rate}::DOUBLE + pen)) * (coalesce(g, 0) / n + pen * a) as w, a{k}.w as prev from a{k} join sizes_ using (m) join models using (m)
  left join (select m, term, sum(x.w * r) as g from x join r{k} using (m, id) group by all) using (m, term)),
b{k + 1} as materialized (select m, a - (1 / (1 / {rate}::DOUBLE + pen)) * (g / n) as w, d{k}.w as prev from d{k} join sizes_ using (m) join models using (m) join (select m, sum(r) as g from r{k} group by m) using (m))""")
    out.append(f"scores as (select m, id, 1 / (1 + exp(-(coalesce(z, 0) + b{steps}.w))) as p from (select id from everyone) cross join b{steps} left join (select m, id, sum(x.w * v.w) as z from x join w{steps} v using (m, term) group by all) using (m, id))")
    return ", ".join(out)


TARGETS_SQL = """targets as (select doc_id as id, label_name, fold, truth as y from labelled)"""
TEXT_STEPS = f"""{WORD_TFIDF}, {LABELLED_SQL}, everyone as (select distinct doc_id as id from labelled), {TARGETS_SQL},
kept as (select term from rows where doc_id in (select id from everyone) group by term order by count(*) desc, term limit 20000),
cells as (select doc_id as id, term, w from rows join kept using (term) where doc_id in (select id from everyone)),
{_steps_sql([(m, name, fold, 0.001) for m, (name, fold) in enumerate(DOCUMENT_TASKS)], STEPS, 2.0)}"""


def _text_model(t, only=None):
    return textfeat.fit_transform_tfidf(t.documents, "doc_id", "text", n=(1, 2), min_df=3, max_df=0.9, sublinear=True, only=only)


def _labelled(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id").withColumn("fold", folds.shuffled_fold("doc_id", 3))


@query("mlf_3_text_logistic", f"with {TEXT_STEPS} select doc_id, label_name, truth, l.fold, round(p, 7) as p from labelled l join models using (label_name, fold) join scores on scores.m = models.m and id = doc_id")
def _(t):
    rows = _text_model(t, only=t.labels)[1]
    scored = linear.oof_logistic(rows, _labelled(t), "doc_id", ["quality", "toxic"], 3, penalties=[0.001], steps=STEPS)
    return scored.select("doc_id", "label_name", "truth", "fold", r("p", 7).alias("p"))


RATIO_STEPS = f"""{WORD_TFIDF}, {LABELLED_SQL}, everyone as (select doc_id as id from documents), {TARGETS_SQL},
kept as (select term from rows group by term order by count(*) desc, term limit 20000), cells as (select doc_id as id, term, w from rows join kept using (term)),
tasks_(m, label_name, f) as (values {', '.join(f"({m}, '{name}', {fold})" for m, (name, fold) in enumerate(DOCUMENT_TASKS))}),
ysize as (select m, count(*) filter (y = 1) as np, count(*) filter (y <> 1) as nn from targets join tasks_ using (label_name) where fold <> f group by m),
ysums as (select m, term, sum(case when y = 1 then w else 0.0 end) as p, sum(case when y <> 1 then w else 0.0 end) as q from targets join tasks_ using (label_name) join cells using (id) where fold <> f group by all),
ratio as materialized (select m, term, ln(((1 + coalesce(p, 0)) / (1 + np)) / ((1 + coalesce(q, 0)) / (1 + nn))) as r from ysize cross join kept left join ysums using (m, term)),
{_steps_sql([(m, name, fold, 0.001) for m, (name, fold) in enumerate(DOCUMENT_TASKS)], STEPS, 0.5, scaled=True)}"""


@query("mlf_2_ratio_scaled_logistic", f"""with {RATIO_STEPS}
select 'valid' as part, doc_id, label_name, l.fold, round(p, 7) as p from labelled l join models using (label_name, fold) join scores on scores.m = models.m and id = doc_id
union all select 'test', id, label_name, null, round(avg(p), 7) from scores join models using (m) where id not in (select doc_id from labels) group by all""")
def _(t):
    test = t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")
    model, rows = _text_model(t)
    valid, mean = linear.ratio_scaled_logistic(rows, _labelled(t), test, "doc_id", ["quality", "toxic"], 3, steps=STEPS, counts=model.vocabulary)
    named = lambda part, df: df.select(F.lit(part).alias("part"), "doc_id", "label_name", F.col("fold") if part == "valid" else F.lit(None).cast("int").alias("fold"), r("p", 7).alias("p"))
    return named("valid", valid).unionByName(named("test", mean))


ROUNDS, DEPTH, BINS, GRAIN = 3, 2, 16, 1 << 20
FEATURES_SQL = f"""feats as (select id, y, fold, {", ".join(FEATURES)} from (select o_orderkey as id, (o_orderstatus = 'F')::DOUBLE as y, {FOLD.format('o_orderkey')} as fold from orders)
  join (select l_orderkey as id, {", ".join(f"round(sum({c}::DOUBLE), 4) as {c}" for c in FEATURES)} from lineitem group by 1) using (id))"""


def _boost_sql() -> str:
    """The boosting steps as a chain of tables; s{r} holds the margins before round r, best{r}_{level} the splits, leaf{r} the values."""
    b = [f"b{i}" for i in range(len(FEATURES))]
    bins = ", ".join(f"least(floor(({c} - lo{i}) / (hi{i} - lo{i}) * {BINS}.0::DOUBLE), {BINS - 1})::INTEGER as b{i}" for i, c in enumerate(FEATURES))
    out = [FEATURES_SQL, f"ends as (select {', '.join(f'min({c}) as lo{i}, max({c}) as hi{i}' for i, c in enumerate(FEATURES))} from feats)",
           f"binned as (select id, y, fold, {bins} from feats cross join ends)", "s0 as materialized (select m, binned.*, 0.0::DOUBLE as f from binned cross join (values (0), (1), (2)) v(m))"]
    for r in range(ROUNDS):
        out.append(f"n{r}_0 as (select *, 0 as node, round((p - y) * {GRAIN}.0::DOUBLE)::BIGINT as g, round(p * (1 - p) * {GRAIN}.0::DOUBLE)::BIGINT as h from (select *, 1 / (1 + exp(-f)) as p from s{r}))")
        for d in range(DEPTH):
            part = lambda g, h: f"({g})::DOUBLE * ({g})::DOUBLE / (({h})::DOUBLE + {GRAIN}.0::DOUBLE)"
            out.append(f"""h{r}_{d} as (select m, node, feature, bin, sum(g)::BIGINT as g, sum(h)::BIGINT as h, count(*) as n
  from (select m, node, g, h, unnest(range({len(b)})) as feature, unnest([{", ".join(b)}]) as bin from n{r}_{d} where fold <> m) group by all),
c{r}_{d} as (select m, node, feature, bin, {", ".join(f"(sum({x}) over (partition by m, node, feature order by bin))::BIGINT as {x}l, (sum({x}) over (partition by m, node, feature))::BIGINT as {x}" for x in "ghn")} from h{r}_{d}),
best{r}_{d} as materialized (select m, node, feature, bin as last_left from (select *, {part("gl", "hl")} + {part("g - gl", "h - hl")} - {part("g", "h")} as gain from c{r}_{d})
  where nl < n and gain > 0 qualify row_number() over (partition by m, node order by gain desc, feature, bin) = 1),
n{r}_{d + 1} as materialized (select x.* replace (node * 2 + case when [{", ".join(b)}][feature + 1] > last_left then 1 else 0 end as node) from n{r}_{d} x left join best{r}_{d} using (m, node))""")
        out.append(f"""leaf{r} as materialized (select m, node, -0.3::DOUBLE * sum(g)::DOUBLE / (sum(h)::DOUBLE + {GRAIN}.0::DOUBLE) as v from n{r}_{DEPTH} where fold <> m group by all),
s{r + 1} as materialized (select m, id, y, fold, {", ".join(b)}, f + coalesce(v, 0.0) as f from n{r}_{DEPTH} left join leaf{r} using (m, node))""")
    return ", ".join(out)


def _boosted(rows):
    return boost.fit_boosted(rows, "id", "y", FEATURES, "fold", 3, rounds=ROUNDS, depth=DEPTH, bins=BINS)


@query("mlf_4_oof_gbt", f"with {_boost_sql()} select id, y, fold, round(1 / (1 + exp(-f)), 9) as p from s{ROUNDS} where m = fold")
def _(t):
    return _boosted(_learning_rows(t))[1].withColumn("p", r("p"))


PENALTIES = [0.0, 0.001, 0.01, 0.1, 1.0, 10.0]


def _dense_cells_sql() -> str:
    stats = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in FEATURES)
    cells = " union all ".join(f"select id, '{c}' as term, coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0) / 2.0::DOUBLE as w from feats cross join stats" for c in FEATURES)
    return f"stats as (select {stats} from feats), cells as materialized ({cells}), everyone as (select id from feats), targets as (select id, 'y' as label_name, fold, y from feats)"


def _grid_sql(penalties: list[float]) -> str:
    models = [(i * 3 + fold, "y", fold, c) for i, c in enumerate(penalties) for fold in range(3)]
    return f"""{FEATURES_SQL}, {_dense_cells_sql()},
{_steps_sql(models, STEPS, 2.0)},
own as (select pen as penalty, fold, y, round(p, 9) as p from scores join models using (m) join (select id, fold as own_fold, y from feats) using (id) where fold = own_fold),
ranked as (select penalty, fold, y, rank() over (partition by penalty, fold order by p) + (count(*) over (partition by penalty, fold, p) - 1) / 2.0::DOUBLE as rk from own),
auc as (select penalty, fold, (sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::DOUBLE) / (count(*) filter (y = 1) * count(*) filter (y = 0)) as auc from ranked group by all)
select penalty, round(avg(2 * auc - 1), 7) as gini from auc group by penalty"""


def _dense_rows(feats):
    """Standardised features as packed rows (id, terms, ws), and the rows themselves."""
    stats = feats.agg(*[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES])
    scaled = lambda c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)), F.lit(0.0)) / 2.0
    wide = feats.crossJoin(F.broadcast(stats)).select("id", *[scaled(c).alias(c) for c in FEATURES])      # one row of statistics
    return wide.select("id", F.array(*[F.lit(c) for c in FEATURES]).alias("terms"), F.array(*FEATURES).alias("ws")), feats


def _grid(t, **options):
    return linear.search_logistic(*_dense_rows(_learning_rows(t)), "id", "y", 3, penalties=PENALTIES, steps=STEPS, **options).withColumn("gini", r("gini", 7))


@query("mlf_6_tuned_logistic", f"with {_grid_sql(PENALTIES)}")
def _(t):
    return _grid(t)


@query("mlf_6_random_search", f"with {_grid_sql(linear.drawn(PENALTIES, 3, 7))}")
def _(t):
    return _grid(t, draws=3)


BASE = ("boosted", "logistic", "shrunk")
RIDGE = 1.0


def _stack_sql() -> str:
    """Sums of products by fold, then elimination for every subset and fold, row by row of the system."""
    col = {"boosted": "boosted", "logistic": "logistic", "shrunk": "shrunk"}
    names = ["1.0::DOUBLE", *col.values(), "y"]
    n = len(names)
    out = [f"gram as materialized (select fold as f, {', '.join(f'sum({names[i]} * {names[j]}) as g{i}_{j}' for i in range(n) for j in range(i, n))} from base group by fold)",
           f"others as materialized (select k, {', '.join(f'sum(g{i}_{j}) as g{i}_{j}' for i in range(n) for j in range(i, n))} from gram join (values (0), (1), (2)) v(k) on f <> k group by k)"]
    parts = []
    for chosen in [c for size in range(2, len(BASE) + 1) for c in combinations(range(len(BASE)), size)]:
        at = [0, *[c + 1 for c in chosen]]
        tag, d = "".join(map(str, chosen)), len(at)
        g = lambda i, j: f"g{min(i, j)}_{max(i, j)}"
        now = ", ".join([f"{g(i, j)}{f' + {RIDGE}::DOUBLE' if i == j and i else ' + 1e-9::DOUBLE' if i == j else ''} as a{x}_{y}" for x, i in enumerate(at) for y, j in enumerate(at)] + [f"{g(i, n - 1)} as r{x}" for x, i in enumerate(at)])
        out.append(f"e{tag}_0 as (select k, {now} from others)")
        for i in range(d):
            low = lambda x, c: f"{c}{x} - a{x.split('_')[0]}_{i} / a{i}_{i} * {c}{i}{x[len(x.split('_')[0]):]}" if int(x.split("_")[0]) > i else f"{c}{x}"
            cols = [f"{low(f'{x}_{y}', 'a')} as a{x}_{y}" for x in range(d) for y in range(d)] + [f"{low(str(x), 'r')} as r{x}" for x in range(d)]
            out.append(f"e{tag}_{i + 1} as materialized (select k, {', '.join(cols)} from e{tag}_{i})")
        back = f"e{tag}_{d}"
        for i in reversed(range(d)):
            rest = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, d))
            back = f"(select *, (r{i}{rest}) / a{i}_{i} as x{i} from {back})"
        score = " + ".join(["x0", *[f"x{i + 1} * {BASE[c]}" for i, c in enumerate(chosen)]])
        parts.append(f"select '{'+'.join(BASE[c] for c in chosen)}' as models, y, round({score}, 9) as p from base join {back} on k = fold")
    return ", ".join(out) + f""", stacked as ({' union all '.join(parts)}),
ranked as (select models, y, rank() over (partition by models order by p) + (count(*) over (partition by models, p) - 1) / 2.0::DOUBLE as rk from stacked)
select models, round((sum(rk) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0::DOUBLE) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 5) as auc from ranked group by models"""


@query("mlf_5_stacked_models", f"""with {_boost_sql()}, {_dense_cells_sql()}, {_steps_sql([(i * 3 + fold, "y", fold, c) for i, c in enumerate((0.001, 1.0)) for fold in range(3)], STEPS, 2.0)},
base as materialized (select s.id, s.y, s.fold, 1 / (1 + exp(-s.f)) as boosted, u.p as logistic, v.p as shrunk from s{ROUNDS} s join scores u on u.id = s.id and u.m = s.fold join scores v on v.id = s.id and v.m = 3 + s.fold where s.m = s.fold),
{_stack_sql()}""")
def _(t):
    rows = _learning_rows(t)
    boosted = _boosted(rows)[1].select("id", "y", "fold", F.col("p").alias("boosted"))
    cells, feats = _dense_rows(rows)
    linear_ones = linear.oof_logistic(cells, feats, "id", ["y"], 3, penalties=[0.001, 1.0], steps=STEPS)
    wide = linear_ones.groupBy("id").agg(*[F.max(F.when(F.col("penalty") == c, F.col("p"))).alias(name) for name, c in (("logistic", 0.001), ("shrunk", 1.0))])
    return learn.search_subsets(boosted.join(wide, "id"), list(BASE), "y", 3, ridge=RIDGE).select("models", r("auc", 5).alias("auc"))


def _permuted_sql() -> str:
    """Rows with one feature's bins dealt anew within the fold (variant -1: none), taken through the trees of their fold's model."""
    b = [f"b{i}" for i in range(len(FEATURES))]
    dealt = ", ".join(f"case when variant = {i} then o.{c} else x.{c} end as {c}" for i, c in enumerate(b))
    out = [f"""placed as (select *, row_number() over (partition by fold order by id) as at, row_number() over (partition by fold order by {h27("'deal|' || id::VARCHAR")}, id) as other from binned),
w0 as (select variant, x.id, x.y, x.fold, {dealt}, 0.0::DOUBLE as f from placed x join placed o on x.fold = o.fold and x.at = o.other cross join (select unnest(range(-1, {len(b)})) as variant))"""]
    for k in range(ROUNDS):
        now = f"(select *, 0 as node from w{k})"
        for d in range(DEPTH):
            now = f"(select x.* replace (x.node * 2 + case when [{', '.join(b)}][feature + 1] > last_left then 1 else 0 end as node) from {now} x left join best{k}_{d} z on z.m = x.fold and z.node = x.node)"
        out.append(f"w{k + 1} as (select variant, id, y, fold, {', '.join(b)}, f + coalesce(v, 0.0) as f from {now} x left join leaf{k} z on z.m = x.fold and z.node = x.node)")
    return ", ".join(out)


@query("mlf_7_importance", f"""with {_boost_sql()}, {_permuted_sql()},
losses as (select variant, avg(-ln(case when y = 1 then p else 1 - p end)) as loss from (select *, 1 / (1 + exp(-f)) as p from w{ROUNDS}) group by variant),
rises as (select variant, round(loss - (select loss from losses where variant = -1), 9) as loss from losses where variant >= 0)
select ([{", ".join(f"'{f}'" for f in FEATURES)}])[variant + 1] as feature, loss, round(greatest(loss, 0) / sum(greatest(loss, 0)) over (), 6) as share from rises""")
def _(t):
    rows = _learning_rows(t)
    made, _ = _boosted(rows)
    found = boost.permutation_importance(made, rows, "id", "y", "fold", key_hash(F.lit("deal"), F.col("id")))
    return found.withColumn("share", r("share", 6))


@query("mlf_8_word_vectors", f"""
with words as (select unnest({tok("lower(text)")}) as word from (select text from documents union all select text from conversations))
select word, count(*) as n, 16 as dims, 1.0::DOUBLE as norm from words group by word having count(*) >= 10""")
def _(t):
    corpora = relations.stack({"documents": t.documents.select("text"), "conversations": t.conversations.select("text")})
    vecs = cbow.fit_cbow(corpora.select(tr.tokens(F.lower("text")).alias("words")), "words", size=16, rounds=2)
    return vecs.select("word", F.col("count").alias("n"), F.size("vec").alias("dims"), r(arrays.norm("vec"), 6).alias("norm"))
