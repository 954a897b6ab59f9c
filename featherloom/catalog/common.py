"""Shared inputs of the queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featherloom.catalog.registry import Tables
from featherloom.functions.hashing import key_hash

MODELS = ("m1", "m2", "m3", "m4", "m5")
VOTE_LABELS = ("yes", "no", "up", "unknown", "silence")
RUNS = 3


def h27(expr: str) -> str:
    """SQL twin of ``key_hash``."""
    return f"(('0x' || substr(sha1({expr}), 34, 7))::BIGINT % 134217728)"


def values_sql(items) -> str:
    return ", ".join(f"('{m}')" for m in items)


def order_scores(t: Tables) -> DataFrame:
    """Predictions of five models for every order: (model, id, truth, p)."""
    truth = (F.col("o_orderstatus") == "F").cast("int")
    return (
        t.orders.select(F.col("o_orderkey").alias("id"), truth.alias("truth"),
                        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
        .withColumn("p", (key_hash("id", "model") % 7000 + 3000 * F.col("truth")) / F.lit(10000.0))
    )


ORDER_SCORES = f"""order_scores as (
  select model, o_orderkey as id, (o_orderstatus = 'F')::INTEGER as truth,
         ({h27("o_orderkey::VARCHAR || '|' || model")} % 7000 + 3000 * (o_orderstatus = 'F')::INTEGER) / 1e4 as p
  from orders cross join (values {values_sql(MODELS)}) m(model))"""


def label_scores(t: Tables) -> DataFrame:
    """Predictions of five models for both document labels: (model, id, label_name, truth, p)."""
    return (
        t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
        .unpivot(["id"], ["quality", "toxic"], "label_name", "truth")
        .withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
        .withColumn("p", (key_hash("id", "label_name", "model") % 700 + 300 * F.col("truth")) / F.lit(1000.0))
    )


LABEL_SCORES = f"""label_scores as (
  select model, id, label_name, truth,
         ({h27("id::VARCHAR || '|' || label_name || '|' || model")} % 700 + 300 * truth) / 1e3 as p
  from (select doc_id as id, 'quality' as label_name, quality as truth from labels
        union all select doc_id, 'toxic', toxic from labels)
  cross join (values {values_sql(MODELS)}) m(model))"""


def order_votes(t: Tables) -> DataFrame:
    """Class labels of five models in three runs for every order: (model, run, id, label)."""
    return (
        t.orders.select(F.col("o_orderkey").alias("id"), F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
        .withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(RUNS))))
        .withColumn("label", F.get(F.array(*[F.lit(v) for v in VOTE_LABELS]),
                                   (key_hash("id", "model", "run") % len(VOTE_LABELS)).cast("int")))
    )


ORDER_VOTES = f"""order_votes as (
  select id, model, run,
         (['{"', '".join(VOTE_LABELS)}'])[({h27("id::VARCHAR || '|' || model || '|' || run::VARCHAR")} % {len(VOTE_LABELS)} + 1)::INTEGER] as label
  from (select o_orderkey as id from orders)
  cross join (values {values_sql(MODELS)}) m(model)
  cross join (values (1), (2), (3)) r(run))"""


def r(col, places: int = 9):
    return F.round(col, places)
