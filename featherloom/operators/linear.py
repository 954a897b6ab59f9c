"""Many logistic models in one scan: labels, folds, penalties and feature scales all share the pass over the data.

Documents are packed rows (term numbers and weights as arrays). A step broadcasts the weights of all models, each task
adds up its gradients of all models in numpy, and one grouped sum by term number joins them. What is broadcast and collected is bounded by
``most_terms`` x models. Steps are fixed (accelerated gradient descent with a constant rate), so reruns and other engines can take the same ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from featherloom.operators.evaluate import roc_auc
from featherloom.session import stored


@dataclass(frozen=True)
class Task:
    """One model: its label column, the fold that it must not see (None: it sees all), and its L2 penalty."""

    label: str
    fold: int | None = None
    penalty: float = 0.0


def number_terms(rows: DataFrame, most_terms: int, counts: DataFrame | None = None) -> DataFrame:
    """(term, code) of the ``most_terms`` terms in most rows, ties by the smaller term; codes from 0 in that order. ``counts`` (term, df) spares the count."""
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if counts is None else counts.select("term", "df")
    top = counts.orderBy(F.col("df").desc(), "term").limit(most_terms)
    return rows.sparkSession.createDataFrame([(r["term"], i) for i, r in enumerate(top.collect())], f"term {dict(rows.dtypes)['term']}, code int")     # most_terms rows


def _runs(rows: DataFrame, key: str, value: str, kind: str, codes: DataFrame | None = None) -> DataFrame:
    """(key, ``value``, ws): neighbouring rows (key, term, w) of a key as one row, so that a document moves as a few rows; null keys are left out.

    With ``codes`` (term, code) the values are codes, and other terms are left out.
    """
    terms = None if codes is None else [r["term"] for r in codes.orderBy("code").collect()]        # most_terms values
    held = None if codes is None else rows.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        listed = None
        for batch in batches:
            names, values, ws = (batch.column(c) for c in (key, "term", "w"))
            if held is not None:
                listed = pa.array(held.value, values.type) if listed is None else listed
                values = pc.index_in(values, value_set=listed)
                known = pc.is_valid(values)
                names, values, ws = names.filter(known), values.filter(known), ws.filter(known)
            number = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, np.diff(number) != 0)) if len(number) else np.zeros(0, np.int64)
            ends = pa.array(np.append(starts, len(number)), pa.int32())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(starts)), pa.ListArray.from_arrays(ends, values), pa.ListArray.from_arrays(ends, ws)], [key, value, "ws"])

    return rows.where(F.col(key).isNotNull()).select(key, "term", F.col("w").cast("double").alias("w")).mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, {value} array<{kind}>, ws array<double>")


def pack_rows(rows: DataFrame, codes: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with their (codes, ws) from rows (key, term, w); a document without any kept term has empty arrays."""
    return _packed(_runs(rows, key, "codes", "int", codes), documents, key)


def _coded(runs: DataFrame, key: str, codes: DataFrame) -> DataFrame:
    """(key, codes, ws) of packed rows (key, terms, ws), without terms that ``codes`` (term, code) does not list."""
    held = runs.sparkSession.sparkContext.broadcast([r["term"] for r in codes.orderBy("code").collect()])       # most_terms values

    def look_up(batches):
        listed = None
        for batch in batches:
            lists = batch.column("terms")
            flat = pc.list_flatten(lists)
            listed = pa.array(held.value, flat.type) if listed is None else listed
            code = pc.index_in(flat, value_set=listed)
            known = pc.is_valid(code)
            row = pc.list_parent_indices(lists).filter(known).to_numpy()
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=batch.num_rows))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, code.filter(known)),
                                              pa.ListArray.from_arrays(ends, pc.list_flatten(batch.column("ws")).filter(known))], [key, "codes", "ws"])

    return runs.select(key, "terms", "ws").mapInArrow(look_up, f"`{key}` {dict(runs.dtypes)[key]}, codes array<int>, ws array<double>")


def _packed(runs: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    whole = runs.groupBy(key).agg(F.collect_list(F.struct("codes", "ws")).alias("_xs"))       # the runs of a document
    full = documents.join(whole, key, "left")
    return full.select(*documents.columns, F.coalesce(F.flatten("_xs.codes"), F.array().cast("array<int>")).alias("codes"), F.coalesce(F.flatten("_xs.ws"), F.array().cast("array<double>")).alias("ws"))


def _cells(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, w) of every cell of packed rows."""
    lists = batch.column("codes")
    return pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_flatten(batch.column("ws")).to_numpy(zero_copy_only=False)


def _margins(cells: tuple, n: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    row, code, w = cells
    out = np.tile(bias, (n, 1))
    for m in range(weights.shape[1]):
        out[:, m] += np.bincount(row, weights=w * weights[code, m], minlength=n)
    return out


def fit_logistic(packed: DataFrame, tasks: Sequence[Task], terms: int, fold: str = "fold", steps: int = 20, rate: float = 2.0, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights by term and model, biases) of the mean logistic loss plus penalty / 2 x squared weights.

    ``packed`` has codes, ws, the fold, and the labels of all tasks (0 or 1; a null label takes no part). ``scale`` multiplies the terms of each
    model (terms x models). The rate, which a penalty shortens, suits rows of length 1.
    """
    spark, names = packed.sparkSession, sorted({t.label for t in tasks})
    rows = packed.select("codes", "ws", F.col(fold).cast("int").alias("_fold"), *[F.col(c).cast("double").alias(c) for c in names])
    scale = np.ones((terms, len(tasks))) if scale is None else scale
    weights, bias = np.zeros((terms, len(tasks))), np.zeros(len(tasks))
    before, bias_before = weights, bias
    penalty = np.array([t.penalty for t in tasks])
    rates = 1 / (1 / rate + penalty)

    def gradients(held):
        def run(batches):
            at_weights, at_bias = held.value
            total, ends, n = np.zeros((terms, len(tasks))), np.zeros(len(tasks)), np.zeros(len(tasks))
            for batch in batches:
                cells, size = _cells(batch), batch.num_rows
                p = 1 / (1 + np.exp(-_margins(cells, size, at_weights * scale, at_bias)))
                folds = batch.column("_fold").to_numpy(zero_copy_only=False)
                for m, t in enumerate(tasks):
                    y = batch.column(t.label).to_numpy(zero_copy_only=False)
                    sees = ~np.isnan(y) & (folds != t.fold if t.fold is not None else True)
                    rest = np.where(sees, p[:, m] - np.nan_to_num(y), 0.0)
                    total[:, m] += np.bincount(cells[1], weights=cells[2] * rest[cells[0]], minlength=terms) * scale[:, m]
                    ends[m] += rest.sum()
                    n[m] += sees.sum()
            touched = np.flatnonzero(total.any(axis=1))
            code = pa.array(np.append(touched, [-1, -2]), pa.int32())          # -1: biases, -2: rows seen
            values = np.vstack([total[touched], ends, n])
            yield pa.RecordBatch.from_arrays([code, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(tasks)).cast(pa.list_(pa.float64()))], ["code", "g"])

        return run

    for step in range(steps):
        push = step / (step + 3)
        at, at_bias = weights + push * (weights - before), bias + push * (bias - bias_before)
        held = spark.sparkContext.broadcast((at, at_bias))
        sums = rows.mapInArrow(gradients(held), "code int, g array<double>").groupBy("code").agg(F.array(*[F.sum(F.get("g", F.lit(m))) for m in range(len(tasks))]).alias("g"))
        found = {r["code"]: np.array(r["g"]) for r in sums.collect()}       # a row for each term
        held.unpersist()
        if not found:
            break
        n = np.maximum(found.pop(-2), 1)
        slope, slope_bias = np.zeros_like(weights), found.pop(-1) / n
        if found:
            slope[list(found)] = np.array(list(found.values())) / n
        before, bias_before = weights, bias
        weights, bias = at - rates * (slope + penalty * at), at_bias - rates * slope_bias
    return weights, bias


def predict_logistic(packed: DataFrame, weights: np.ndarray, bias: np.ndarray, keep: Sequence[str], scale: np.ndarray | None = None) -> DataFrame:
    """(keep..., ps): the probability of each model as an array."""
    held = packed.sparkSession.sparkContext.broadcast((weights if scale is None else weights * scale, bias))
    schema = ", ".join(f"`{c}` {dict(packed.dtypes)[c]}" for c in keep) + ", ps array<double>"

    def run(batches):
        for batch in batches:
            w, b = held.value
            p = 1 / (1 + np.exp(-_margins(_cells(batch), batch.num_rows, w, b)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(b)).cast(pa.list_(pa.float64()))], [*keep, "ps"])

    return packed.select(*keep, *[c for c in ("codes", "ws") if c not in keep]).mapInArrow(run, schema)


def oof_logistic(rows: DataFrame, documents: DataFrame, key: str, labels: Sequence[str], folds: int, fold: str = "fold", penalties: Sequence[float] = (0.0,),
                 most_terms: int = 20_000, steps: int = 20, rate: float = 2.0) -> DataFrame:
    """(key, label_name, truth, fold, penalty, p): out-of-fold probabilities of every label and penalty from rows (key, term, w), or packed ones (key, terms, ws).

    ``documents`` holds key, labels and fold; its rows without a kept term are answered by the bias. labels x folds x penalties models are fitted together.
    """
    tasks = [Task(name, k, c) for name in labels for c in penalties for k in range(folds)]
    base = documents.select(key, F.col(fold).cast("int").alias(fold), *labels)
    if "terms" in rows.columns:
        whole = rows.where(F.col(key).isNotNull()).select(key, "terms", F.col("ws").cast("array<double>").alias("ws"))
    else:
        whole = _runs(rows, key, "terms", dict(rows.dtypes)["term"])
    runs = stored(whole.join(base.select(key), key, "left_semi"), "runs")      # rows are made once, and a document meets the labels whole
    codes = number_terms(runs.select(F.explode("terms").alias("term")), most_terms)
    terms = codes.count()
    packed = stored(_packed(_coded(runs, key, codes), base, key), "packed")
    ps = predict_logistic(packed, *fit_logistic(packed, tasks, terms, fold, steps, rate), [key, fold, *labels])
    own = [F.struct(F.lit(name).alias("label_name"), F.col(name).cast("int").alias("truth"), F.lit(float(c)).alias("penalty"),
                    F.get("ps", F.lit((i * len(penalties) + j) * folds) + F.col(fold)).alias("p")) for i, name in enumerate(labels) for j, c in enumerate(penalties)]
    return ps.select(key, fold, F.explode(F.array(*own)).alias("e")).select(key, "e.label_name", "e.truth", fold, "e.penalty", "e.p")


def search_logistic(rows: DataFrame, documents: DataFrame, key: str, label: str, folds: int, fold: str = "fold", penalties: Sequence[float] = (0.0, 0.1), draws: int | None = None,
                    seed: int = 7, **options) -> DataFrame:
    """(penalty, gini), the mean over folds of 2 AUC - 1: all penalties, or ``draws`` of them by a seeded hash; every point is fitted in the same scans."""
    if draws is not None:
        penalties = drawn(penalties, draws, seed)
    scored = oof_logistic(rows, documents, key, [label], folds, fold, penalties, **options).withColumn("p", F.round("p", 9))
    return roc_auc(scored, ["penalty", fold], "truth", "p").groupBy("penalty").agg(F.avg(2 * F.col("auc") - 1).alias("gini"))


def drawn(points: Sequence[float], draws: int, seed: int) -> list[float]:
    """``draws`` different points in the order of a seeded hash."""
    return sorted(points, key=lambda x: hashlib.sha256(repr((seed, float(x))).encode()).digest())[:draws]


def fold_ratios(packed: DataFrame, tasks: Sequence[Task], fold: str, terms: int) -> np.ndarray:
    """Log-count ratios (terms x models), each from the documents that its model may see; one scan of the packed rows for all."""
    sees = [F.col(t.label).isNotNull() & (F.col(fold) != t.fold) for t in tasks]
    yes = [s & (F.col(t.label) == 1) for s, t in zip(sees, tasks, strict=True)]
    no = [s & (F.col(t.label) != 1) for s, t in zip(sees, tasks, strict=True)]
    flags, n = [*yes, *no], 2 * len(tasks)
    sizes = np.array(packed.agg(*[F.count_if(f) for f in flags]).first(), float)

    def add(batches):
        total = np.zeros((terms, n))
        for batch in batches:
            row, code, w = _cells(batch)
            for i in range(n):
                total[:, i] += np.bincount(code, weights=w * batch.column(f"_f{i}").to_numpy()[row], minlength=terms)
        touched = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(total[touched].ravel()), n).cast(pa.list_(pa.float64()))], ["code", "s"])

    flagged = packed.select("codes", "ws", *[F.when(f, 1.0).otherwise(0.0).alias(f"_f{i}") for i, f in enumerate(flags)])
    sums = flagged.mapInArrow(add, "code int, s array<double>").groupBy("code").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(n)]).alias("s"))
    held = np.zeros((terms, n))
    for r in sums.collect():        # a row for each term
        held[r["code"]] = r["s"]
    share = (1 + held) / (1 + sizes)
    return np.log(share[:, : len(tasks)] / share[:, len(tasks) :])


def ratio_scaled_logistic(rows: DataFrame, train: DataFrame, test: DataFrame, key: str, labels: Sequence[str], folds: int, fold: str = "fold", penalty: float = 0.001,
                          most_terms: int = 20_000, steps: int = 20, rate: float = 0.5, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Naive-Bayes scaled logistic regression from rows (key, term, w): (key, label_name, truth, fold, p) out of fold, and for ``test`` (key, label_name, p), the mean over folds.

    The vocabulary is that of all rows; the ratio of a label and fold comes from its training folds only, and scales the terms of its model.
    ``counts`` (term, df), if it is known already, says in how many of the rows a term is, and spares a pass over them.
    """
    tasks = [Task(name, k, penalty) for name in labels for k in range(folds)]
    base = train.select(key, F.col(fold).cast("int").alias(fold), *labels)
    codes = number_terms(rows, most_terms, counts)
    terms = codes.count()
    both = base.withColumn("_new", F.lit(False)).unionByName(test.select(key).withColumn("_new", F.lit(True)), allowMissingColumns=True)
    whole = stored(_packed(_runs(rows, key, "codes", "int", codes), both, key), "packed")       # rows are made and moved once, for both sides
    packed = whole.where("not _new")
    scale = fold_ratios(packed, tasks, fold, terms)
    fitted = fit_logistic(packed, tasks, terms, fold, steps, rate, scale)
    seen = predict_logistic(packed, *fitted, [key, fold, *labels], scale)
    own = [F.struct(F.lit(name).alias("label_name"), F.col(name).cast("int").alias("truth"), F.get("ps", F.lit(i * folds) + F.col(fold)).alias("p")) for i, name in enumerate(labels)]
    valid = seen.select(key, fold, F.explode(F.array(*own)).alias("e")).select(key, "e.label_name", "e.truth", fold, "e.p")
    new = predict_logistic(whole.where("_new"), *fitted, [key], scale)
    mean = lambda i: sum([F.get("ps", F.lit(i * folds + k)) for k in range(1, folds)], F.get("ps", F.lit(i * folds))) / folds
    each = [F.struct(F.lit(name).alias("label_name"), mean(i).alias("p")) for i, name in enumerate(labels)]
    return valid, new.select(key, F.explode(F.array(*each)).alias("e")).select(key, "e.label_name", "e.p")
