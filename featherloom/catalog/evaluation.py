"""Ranking, evaluation and ensemble queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from featherloom.catalog.common import (LABEL_SCORES, MODELS, ORDER_SCORES, ORDER_VOTES, label_scores,
                                        order_scores, order_votes, r)
from featherloom.catalog.registry import query
from featherloom.catalog.text import CLEAN
from featherloom.functions.textrules import clean_comment
from featherloom.operators import ensemble, evaluate


@query("win_1_rank_average", f"""
with {ORDER_SCORES}, ranked as (
  select id, (row_number() over (partition by model order by p, id) - 1) / (count(*) over (partition by model) - 1)::DOUBLE as s
  from order_scores)
select id, round(avg(s), 9) as score from ranked group by id""")
def _(t):
    return ensemble.rank_average(order_scores(t), "model", "id", "p").select("id", r("score").alias("score"))


@query("win_2_tied_rank", f"""
with {ORDER_SCORES}, ranked as (
  select id, (rank() over (partition by model order by p) + (count(*) over (partition by model, p) - 1) / 2.0)::DOUBLE
             / count(*) over (partition by model) as s
  from order_scores)
select id, round(avg(s), 9) as score from ranked group by id""")
def _(t):
    ranked = ensemble.tied_rank(order_scores(t), "model", "p")
    return ensemble.mean_by_key(ranked, ["id"], "rank").select("id", r("score").alias("score"))


@query("win_3_normalized_gini", f"""
with {ORDER_SCORES}, ranked as (
  select model, truth, row_number() over (partition by model order by p desc, id) as rk,
         row_number() over (partition by model order by truth desc, id) as best,
         count(*) over (partition by model) as n
  from order_scores), summed as (
  select model, n, sum(truth)::DOUBLE as a, sum(truth * (n - rk + 1))::DOUBLE as area,
         sum(truth * (n - best + 1))::DOUBLE as best_area
  from ranked group by model, n)
select model, round((area / a - (n + 1) / 2.0) / (best_area / a - (n + 1) / 2.0), 9) as gini from summed""")
def _(t):
    return evaluate.normalized_gini(order_scores(t), ["model"], "truth", "p", "id").select("model", r("gini").alias("gini"))


AUC = """ranks as (
  select model, label_name, truth, rank() over (partition by model, label_name order by p)
         + (count(*) over (partition by model, label_name, p) - 1) / 2.0 as rk
  from label_scores), auc as (
  select model, label_name,
         (sum(rk) filter (truth = 1) - sum(truth) * (sum(truth) + 1) / 2.0)::DOUBLE
         / (sum(truth) * (count(*) - sum(truth)))::DOUBLE as auc
  from ranks group by model, label_name)"""


@query("win_4_roc_auc", f"""
with {LABEL_SCORES}, {AUC} select model, label_name, round(auc, 9) as auc from auc""")
def _(t):
    return evaluate.roc_auc(label_scores(t), ["model", "label_name"], "truth", "p").select("model", "label_name", r("auc").alias("auc"))


@query("win_4_macro_auc", f"""
with {LABEL_SCORES}, {AUC} select model, round(avg(auc), 9) as macro_auc from auc group by model""")
def _(t):
    auc = evaluate.roc_auc(label_scores(t), ["model", "label_name"], "truth", "p")
    return evaluate.macro_mean(auc, ["model"], "auc", "macro_auc").select("model", r("macro_auc").alias("macro_auc"))


@query("win_9_argmax_label", f"""
with {LABEL_SCORES}
select id, model, case when max(p) filter (label_name = 'quality') >= max(p) filter (label_name = 'toxic')
                       then 'quality' else 'toxic' end as label, max(p) as prob
from label_scores group by id, model""")
def _(t):
    return ensemble.argmax_long(label_scores(t), ["id", "model"], "label_name", "p")


@query("evl_1_accuracy", f"""
with {ORDER_SCORES}
select model, round(avg((truth = (p > 0.5)::INTEGER)::INTEGER), 9) as accuracy, count(*) as n
from order_scores group by model""")
def _(t):
    called = order_scores(t).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return evaluate.accuracy(called, ["model"], "truth", "pred").withColumn("accuracy", r("accuracy"))


@query("evl_2_confusion", f"""
with {ORDER_SCORES}
select model, truth, (p > 0.5)::INTEGER as pred, count(*) as n from order_scores group by all""")
def _(t):
    called = order_scores(t).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return evaluate.confusion(called, ["model"], "truth", "pred")


@query("evl_2_confusion_wide", f"""
with {ORDER_VOTES}, pairs as (
  select a.label as truth, b.label as pred from order_votes a join order_votes b using (id)
  where a.model = 'm1' and a.run = 1 and b.model = 'm2' and b.run = 1)
select truth, count(*) filter (pred = 'yes') as pred_yes, count(*) filter (pred = 'no') as pred_no,
       count(*) filter (pred = 'up') as pred_up, count(*) filter (pred = 'unknown') as pred_unknown,
       count(*) filter (pred = 'silence') as pred_silence
from pairs group by truth""")
def _(t):
    votes = order_votes(t)
    one = votes.where("model = 'm1' and run = 1").select("id", F.col("label").alias("truth"))
    two = votes.where("model = 'm2' and run = 1").select("id", F.col("label").alias("pred"))
    return evaluate.confusion_wide(one.join(two, "id"), "truth", "pred", ["yes", "no", "up", "unknown", "silence"])


@query("evl_3_bad_cases", f"""
with {LABEL_SCORES}, cleaned as (select doc_id, text, {CLEAN} as clean from documents)
select s.model, s.label_name, s.id, case when s.truth = 1 then 'fn' else 'fp' end as kind, s.p, d.text, d.clean
from label_scores s join cleaned d on s.id = d.doc_id
where (s.truth = 1 and s.p < 0.5) or (s.truth = 0 and s.p > 0.5)""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), "text", clean_comment("text").alias("clean"))
    return evaluate.bad_cases(label_scores(t), "truth", "p").join(docs, "id") \
        .select("model", "label_name", "id", "kind", "p", "text", "clean")


@query("evl_4_best_f1", f"""
with {ORDER_SCORES}, scored as (
  select model, i, count(*) filter (p > i / 1e2) as called, sum(truth) as total,
         sum(truth) filter (p > i / 1e2) as tp
  from order_scores cross join range(0, 100) r(i) group by model, i), f as (
  select model, i, coalesce(2.0 * coalesce(tp, 0)::DOUBLE / (called + total), 0) as f1 from scored)
select model, arg_max(i, (f1, -i)) / 1e2 as threshold, round(max(f1), 9) as f1 from f group by model""")
def _(t):
    return evaluate.best_f1(order_scores(t), ["model"], "truth", "p").withColumn("f1", r("f1"))


@query("evl_5_prediction_correlation", f"""
with {LABEL_SCORES}, c as (
  select a.label_name, a.model as model_a, b.model as model_b, corr(a.p, b.p) as c
  from label_scores a join label_scores b on a.id = b.id and a.label_name = b.label_name and a.model < b.model
  group by all)
select model_a, model_b, round(avg(c), 9) as corr from c group by all""")
def _(t):
    per_label = evaluate.pair_correlation(label_scores(t), ["label_name"], "model", "id", "p")
    return per_label.groupBy("model_a", "model_b").agg(r(F.avg("corr")).alias("corr"))


@query("ens_1_equal_mean", f"""
with {LABEL_SCORES} select id, label_name, round(avg(p), 9) as score from label_scores group by all""")
def _(t):
    return ensemble.mean_by_key(label_scores(t), ["id", "label_name"], "p").withColumn("score", r("score"))


WEIGHTS = {"m1": 0.25, "m2": 0.25, "m3": 0.2, "m4": 0.2, "m5": 0.1}
WEIGHT_SQL = "case model " + " ".join(f"when '{m}' then {w}::DOUBLE" for m, w in WEIGHTS.items()) + " end"


@query("ens_2_weighted_mean", f"""
with {ORDER_SCORES} select id, round(sum({WEIGHT_SQL} * p), 9) as score from order_scores group by id""")
def _(t):
    return ensemble.weighted_mean(order_scores(t), "model", ["id"], "p", WEIGHTS).withColumn("score", r("score"))


@query("ens_2_weighted_rank", f"""
with {ORDER_SCORES}, ranked as (
  select id, model, (rank() over (partition by model order by p) + (count(*) over (partition by model, p) - 1) / 2.0)::DOUBLE
             / count(*) over (partition by model) as s
  from order_scores)
select id, round(sum({WEIGHT_SQL} * s), 9) as score from ranked group by id""")
def _(t):
    ranked = ensemble.tied_rank(order_scores(t), "model", "p")
    return ensemble.weighted_mean(ranked, "model", ["id"], "rank", WEIGHTS).withColumn("score", r("score"))


# fixed values: the weights of the five members of the geometric ensemble
LOG_WEIGHTS = {"m1": 0.1, "m2": 0.1, "m3": 0.1, "m4": 0.1, "m5": 0.4}


@query("ens_3_geometric_mean", f"""
with {ORDER_SCORES}
select id, round(exp(sum((case when model = 'm5' then 0.5 else 0.125 end)::DOUBLE * ln(greatest(p, 1e-15)))), 9) as score
from order_scores group by id""")
def _(t):
    return ensemble.geometric_mean(order_scores(t), "model", ["id"], "p", LOG_WEIGHTS).withColumn("score", r("score"))


@query("prj_20_logit_average", f"""
with {ORDER_SCORES}, x as (select id, least(greatest(p, 1e-6), 1 - 1e-6) as p from order_scores)
select id, round(1 / (1 + exp(-avg(ln(p / (1 - p))))), 9) as score from x group by id""")
def _(t):
    return ensemble.logit_mean(order_scores(t), ["id"], "p").withColumn("score", r("score"))


VOTE = """votes as (select id, label, count(*) as n, min(model) as first from order_votes where run = 1 group by all),
  ranked as (select id, label, n, row_number() over (partition by id order by n desc, first, label) as rk from votes)"""


@query("ens_4_majority_vote", f"""
with {ORDER_VOTES}, {VOTE} select id, label, n as votes from ranked where rk = 1""")
def _(t):
    return ensemble.majority_vote(order_votes(t).where("run = 1"), "model", ["id"], "label")


@query("ens_4_two_level_vote", f"""
with {ORDER_VOTES}, inner_votes as (
  select id, model, label, row_number() over (partition by id, model order by count(*) desc, min(run), label) as rk
  from order_votes group by id, model, label), outer_votes as (
  select id, label, count(*) as n, row_number() over (partition by id order by count(*) desc, min(model), label) as rk
  from inner_votes where rk = 1 group by id, label)
select id, label, n as votes from outer_votes where rk = 1""")
def _(t):
    return ensemble.two_level_vote(order_votes(t), "model", "run", ["id"], "label")


@query("ens_5_rule_vote", f"""
with {ORDER_VOTES}, {VOTE}, flags as (
  select id, count(*) filter (label = 'unknown') as u, count(*) filter (label = 'silence') as s
  from order_votes where run = 1 group by id)
select r.id, case when u >= 2 and s > 0 then 'silence' when u >= 2 then 'unknown' else r.label end as label
from ranked r join flags f using (id) where rk = 1""")
def _(t):
    return ensemble.rule_vote(order_votes(t).where("run = 1"), "model", ["id"], "label")


SIGNATURE = """counted as (select id, label, count(*) as n from order_votes where run = 1 group by all),
  numbered as (select *, row_number() over (partition by id order by n desc, label) as rk from counted),
  signed as (select id, string_agg(label || n::VARCHAR, '_' order by n desc, label) as signature,
         coalesce(bool_and(n = 2) filter (rk <= 2) and count(*) >= 2, false) as tied,
         coalesce(max(n) filter (label = 'unknown'), 0) as unknown
  from numbered group by id)"""


@query("ens_6_vote_signature", f"""
with {ORDER_VOTES}, {SIGNATURE} select id, signature, tied, unknown from signed""")
def _(t):
    return ensemble.vote_signature(order_votes(t).where("run = 1"), ["id"], "label")


@query("ens_6_signature_groups", f"""
with {ORDER_VOTES}, {SIGNATURE}
select signature, count(*) as ids, count(*) filter (tied) as tied_ids from signed group by signature""")
def _(t):
    signed = ensemble.vote_signature(order_votes(t).where("run = 1"), ["id"], "label")
    return signed.groupBy("signature").agg(F.count(F.lit(1)).alias("ids"), F.count_if("tied").alias("tied_ids"))


@query("ens_7_mean_prob_argmax", f"""
with {LABEL_SCORES}, m as (select id, label_name, avg(p) as p from label_scores group by all),
  w as (select id, max(p) filter (label_name = 'quality') as q, max(p) filter (label_name = 'toxic') as x from m group by id)
select id, case when round(q, 9) >= round(x, 9) then 'quality' else 'toxic' end as label, round(greatest(q, x), 9) as prob from w""")
def _(t):
    mean = ensemble.mean_by_key(label_scores(t), ["id", "label_name"], "p", "p").withColumn("p", r("p"))
    return ensemble.argmax_long(mean, ["id"], "label_name", "p")


PAIRS = """pairs as (
  select a.model as model_a, b.model as model_b, avg((a.label = b.label)::INTEGER) as rate,
         count(*) filter (a.label = b.label) as same
  from order_votes a join order_votes b on a.id = b.id and a.model < b.model
  where a.run = 1 and b.run = 1 group by all)"""


@query("jon_13_model_agreement", f"""
with {ORDER_VOTES}, {PAIRS} select model_a, model_b, round(rate, 9) as rate, same from pairs""")
def _(t):
    return ensemble.agreement(order_votes(t).where("run = 1"), "model", "id", "label").withColumn("rate", r("rate"))


@query("srt_3_least_similar_models", f"""
with {ORDER_VOTES}, {PAIRS}, both_ways as (
  select model_a as model, same from pairs union all select model_b, same from pairs)
select model, sum(same)::BIGINT as total from both_ways group by model order by total, model limit 3""")
def _(t):
    return ensemble.least_similar(order_votes(t).where("run = 1"), "model", "id", "label", 3)


@query("mth_1_class_share_from_loss", """
select o_orderkey, round((6 * s - 5 * ln(2) - ln(1.25)) / (ln(5) - ln(1.25)), 9) as share
from (select o_orderkey, o_totalprice / 1e6 as s from orders)""")
def _(t):
    return t.orders.select("o_orderkey", r(evaluate.class_share_from_loss(F.col("o_totalprice") / F.lit(1e6))).alias("share"))


# fixed values: class weights for labels 0 and 1
CLASS_WEIGHTS = (1.309028344, 0.472001959)


@query("mth_2_weighted_log_loss", f"""
with {ORDER_SCORES}, x as (select model, truth, least(greatest(p, 1e-15), 1 - 1e-15) as p from order_scores)
select model, round(avg(case when truth = 1 then -0.472001959::DOUBLE * ln(p) else -1.309028344::DOUBLE * ln(1 - p) end), 9) as log_loss
from x group by model""")
def _(t):
    return evaluate.weighted_log_loss(order_scores(t), ["model"], "truth", "p", CLASS_WEIGHTS).withColumn("log_loss", r("log_loss"))


@query("evl_6_gini_and_auc", f"""
with {ORDER_SCORES}, ranked as (
  select model, truth, row_number() over (partition by model order by p desc, id) as rk,
         rank() over (partition by model order by p) + (count(*) over (partition by model, p) - 1) / 2.0 as av
  from order_scores), s as (
  select model, count(*)::DOUBLE as n, sum(truth)::DOUBLE as a, sum(truth * rk)::DOUBLE as ar, sum(truth * av)::DOUBLE as av from ranked group by model)
select model, round(((n + 1) / 2 - ar / a) / ((n + 1) / 2 - (a + 1) / 2), 9) as gini, round((av - a * (a + 1) / 2) / (a * (n - a)), 9) as auc from s""")
def _(t):
    scores = order_scores(t)
    gini = evaluate.normalized_gini(scores, ["model"], "truth", "p", "id")
    return gini.join(evaluate.roc_auc(scores, ["model"], "truth", "p"), "model").select("model", r("gini").alias("gini"), r("auc").alias("auc"))
