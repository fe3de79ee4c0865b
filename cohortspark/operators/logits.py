"""Logistic regressions of many cohorts, iterated together.

Every pass over the rows sums gradient, Hessian and likelihood for all cohorts that are still moving, partly in each
Arrow batch and then by cohort in Spark; one row per cohort takes its Newton step in a task. The driver sees no
coefficients, only whether a cohort is left, so the number of cohorts is not limited, nor is the size of one.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cohortspark.operators.joins import with_totals
from cohortspark.operators.lineage import durable
from cohortspark.operators.ordered import OrderedScan, null_safe_join, running_sum

_STATE = "_cid long, _trial array<double>, _base array<double>, _step array<double>, _scale double, _ll double, _done boolean, _n double, _ones double, _w double, _hess array<double>"


def refuse_nulls(df, columns):
    """The frame, failing when it is read if one of the columns is NULL or NaN: such rows are imputed first, not dropped."""
    checked = {}
    for c in columns:
        value = F.col(c).cast("double")
        checked[c] = F.when(value.isNull() | F.isnan(value), F.raise_error(F.lit(f"{c} has NULL or NaN values: impute them first")).cast("double")).otherwise(value)
    return df.withColumns(checked)


def _dot(x, b):
    """b[0] + x . b[1:] for two array columns."""
    return F.element_at(b, 1) + F.aggregate(F.zip_with(x, F.slice(b, 2, F.size(x)), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _sums(rows, state, p):
    """Per cohort: likelihood, gradient (p), weights, rows, ones and the upper half of the Hessian, at the trial point."""
    at = np.triu_indices(p)
    width = 4 + p + len(at[0])

    def batches(stream):
        for batch in stream:
            if not batch.num_rows:
                continue
            cid, y = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            n = len(cid)
            x = np.column_stack([np.ones(n), batch.column(1).flatten().to_numpy().reshape(n, p - 1)])
            eta = np.einsum("ij,ij->i", x, batch.column(3).flatten().to_numpy().reshape(n, p))
            mu = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
            w = mu * (1 - mu)
            flat = np.column_stack([y * eta - np.logaddexp(0.0, eta), w, np.ones(n), y, x * (y - mu)[:, None], x[:, at[0]] * x[:, at[1]] * w[:, None]])
            by = np.argsort(cid, kind="stable")
            cid, flat = cid[by], flat[by]
            first = np.flatnonzero(np.r_[True, cid[1:] != cid[:-1]])
            sums = np.add.reduceat(flat, first)
            yield pa.RecordBatch.from_arrays([pa.array(cid[first])] + [pa.array(sums[:, i]) for i in range(width)], names=["_cid"] + [f"s{i}" for i in range(width)])

    part = rows.join(state.select("_cid", "_trial"), "_cid").select("_cid", "_x", "_y", "_trial")
    part = part.mapInArrow(batches, "_cid long, " + ", ".join(f"s{i} double" for i in range(width)))
    return part.groupBy("_cid").agg(F.array(*[F.sum(f"s{i}") for i in range(width)]).alias("_s"))


def _step(p, reg, tol):
    """One row per cohort: accept the trial point and take the next Newton step, or halve the step."""
    at = np.triu_indices(p)

    def move(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                s, trial = np.asarray(r.sums), np.asarray(r.trial)
                n = s[2]
                ridge = np.r_[0.0, np.full(p - 1, n * reg)]
                ll = s[0] - 0.5 * float(ridge @ (trial * trial))
                hess = np.zeros((p, p))
                hess[at] = s[4 + p:]
                hess = hess + np.triu(hess, 1).T + np.diag(ridge)
                first = np.isnan(r.ll)
                if first or ll >= r.ll - 1e-12 * max(1.0, abs(r.ll)) or r.scale < 1e-4:
                    step = np.linalg.pinv(hess, hermitian=True) @ (s[4:4 + p] - ridge * trial)
                    # near the end a Newton step squares the error; without a finite optimum only the likelihood settles
                    done = bool(np.max(np.abs(step)) < tol or (not first and abs(ll - r.ll) <= 1e-9 * n))
                    out.append((r.cid, trial if done else trial + step, trial, step, 1.0, ll, done, n, s[3], s[1], hess.ravel()))
                else:
                    scale, base, step = r.scale / 2, np.asarray(r.base), np.asarray(r.step)
                    out.append((r.cid, base + scale * step, base, step, scale, r.ll, False, n, s[3], s[1], hess.ravel()))
            yield pd.DataFrame([(c, list(t), list(b), list(d), sc, ll, done, n, o, w, list(h)) for c, t, b, d, sc, ll, done, n, o, w, h in out],
                               columns=[x.split()[0] for x in _STATE.split(", ")])

    return move


class Logits:
    """Fitted regressions: ``cohorts`` has one row per cohort with its key columns, means and deviations of the features,
    and coefficients on standardised features (intercept first)."""

    def __init__(self, cohorts, xs, by):
        self.cohorts, self.xs, self.by = cohorts, list(xs), list(by)

    def _joined(self, df):
        table = self.cohorts.select(*self.by, "_cid", "_mean", "_sd", "_beta")
        return null_safe_join(df, table, self.by) if self.by else with_totals(df, table)

    def transform(self, df, name="probability"):
        """Add P(y = 1); NULL for cohorts that were not fitted."""
        safe = refuse_nulls(df.withColumns({f"_x_{x}": F.col(x) for x in self.xs}), [f"_x_{x}" for x in self.xs])
        joined = self._joined(safe)
        centred = F.zip_with(F.array(*[F.col(f"_x_{x}") for x in self.xs]), "_mean", lambda v, m: v - m)
        x = F.zip_with(centred, "_sd", lambda v, d: F.when(d > 0, v / d).otherwise(0.0))
        return joined.withColumn(name, 1.0 / (1.0 + F.exp(-_dot(x, F.col("_beta"))))).select(*df.columns, name)


def fit_logits(df, xs, y, by=(), reg=0.0, max_iter=50, tol=1e-9):
    """Logistic regression on standardised features for every combination of the ``by`` columns (NULL is a value).
    ``reg`` penalises half the squared standardised coefficients, per row. Returns ``Logits``."""
    xs, by = list(xs), list(by)
    p = len(xs) + 1
    frame = refuse_nulls(df.select(*by, *[F.col(x).alias(f"_x{i}") for i, x in enumerate(xs)], F.col(y).alias("_y")), [f"_x{i}" for i in range(len(xs))] + ["_y"])
    stats = [F.avg(f"_x{i}").alias(f"m{i}") for i in range(len(xs))] + [F.stddev_samp(f"_x{i}").alias(f"d{i}") for i in range(len(xs))]
    groups = frame.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *stats) if by else frame.agg(F.count(F.lit(1)).alias("_rows"), *stats).filter("_rows > 0")
    cohorts = durable(groups.select(*by, F.monotonically_increasing_id().alias("_cid"), F.array(*[F.col(f"m{i}") for i in range(len(xs))]).cast("array<double>").alias("_mean"),
                                    F.array(*[F.coalesce(f"d{i}", F.lit(0.0)) for i in range(len(xs))]).cast("array<double>").alias("_sd")))
    keyed = null_safe_join(frame, cohorts, by) if by else with_totals(frame, cohorts)
    z = [F.when(F.col("_sd")[i] > 0, (F.col(f"_x{i}") - F.col("_mean")[i]) / F.col("_sd")[i]).otherwise(0.0) for i in range(len(xs))]
    rows = durable(keyed.select("_cid", F.array(*z).cast("array<double>").alias("_x"), "_y"))
    zero, nan = F.array_repeat(F.lit(0.0), p), F.lit(float("nan"))
    state = cohorts.select("_cid", zero.alias("_trial"), zero.alias("_base"), zero.alias("_step"), F.lit(1.0).alias("_scale"), nan.alias("_ll"), F.lit(False).alias("_done"),
                           nan.alias("_n"), nan.alias("_ones"), nan.alias("_w"), F.array().cast("array<double>").alias("_hess"))
    finished = []
    for i in range(max_iter):
        asked = state.select(F.col("_cid").alias("cid"), F.col("_trial").alias("trial"), F.col("_base").alias("base"), F.col("_step").alias("step"), F.col("_scale").alias("scale"), F.col("_ll").alias("ll"))
        moved = asked.join(_sums(rows, state, p).withColumnRenamed("_cid", "cid").withColumnRenamed("_s", "sums"), "cid")
        moved = durable(moved.mapInPandas(_step(p, reg, tol), _STATE))
        finished.append(moved.filter("_done" if i + 1 < max_iter else "true"))
        state = moved.filter("NOT _done")
        if state.isEmpty():
            break
    ended = finished[0]
    for more in finished[1:]:
        ended = ended.unionByName(more)
    ended = durable(ended.select("_cid", F.col("_base").alias("_beta"), "_ll", "_done", "_n", "_ones", "_w", "_hess"))
    return Logits(durable(cohorts.join(ended, "_cid")), xs, by)


def auc_by(scored, score, label, by, hot_rows=None):
    """Exact ROC AUC (tie-aware rank sum) per group; NULL where a group has one class only."""
    y = F.col(label).cast("long")
    per = scored.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    ranked = OrderedScan(per, list(by), [score], hot_rows=hot_rows).add(_upto=running_sum("_n")).result()
    sums = ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum("_pos").alias("_p"), F.sum(F.col("_pos") * (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2.0)).alias("_rs"))
    pos, neg = F.col("_p"), F.col("n") - F.col("_p")
    return sums.select(*by, "n", ((F.col("_rs") - pos * (pos + 1) / 2.0) / F.nullif((pos * neg).cast("double"), F.lit(0.0))).alias("auc"))
