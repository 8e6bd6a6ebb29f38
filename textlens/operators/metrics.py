"""Distributed evaluation metrics.

Every metric is a one-pass aggregate (partial aggregation on the map side, a
tiny final merge), so the input is never brought to one task or the driver.
Only the small per-group count tables are combined afterwards.  Zero
divisions give 0 (``zero_division=0``) except where a value is undefined
(AUC with one class present), which gives NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlens.plans.prefix import global_rank, running_sums
from textlens.session import materialize


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0.0 when b is 0 or NULL."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _cnt(cond: Column) -> Column:
    return F.count_if(cond)


# ---------------------------------------------------------------- A01 / A03
def binary_counts(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    Y, P = F.col(y), F.col(yhat)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _cnt((Y == 1) & (P == 1)).alias("tp"),
        _cnt((Y == 0) & (P == 1)).alias("fp"),
        _cnt((Y == 1) & (P == 0)).alias("fn"),
        _cnt((Y == 0) & (P == 0)).alias("tn"),
        _cnt(Y == P).alias("correct"),
    )


def accuracy_f1(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and F1 of class 1 (0 when undefined)."""
    c = binary_counts(df, y, yhat, by)
    return c.select(
        *by, "n",
        _div0(F.col("correct"), F.col("n")).alias("accuracy"),
        _div0(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    )


def binary_prf(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 as one row per group."""
    c = binary_counts(df, y, yhat, by)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        *by,
        _div0(F.col("correct"), F.col("n")).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def metrics_long(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unpivot a one-row-per-group metrics table to ``(metric, value)`` rows."""
    vals = [c for c in metrics.columns if c not in by]
    return metrics.select(*by, *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(
        list(by), vals, "metric", "value")


# ---------------------------------------------------------------- A02
def confusion_matrix(df: DataFrame, classes: Sequence[int] = (0, 1), y: str = "y", yhat: str = "yhat",
                     by: Sequence[str] = ()) -> DataFrame:
    """Long confusion matrix ``(by.., true_label, predicted_label, n)`` with
    every class pair present (zero cells included)."""
    # One aggregate: the counts of every class pair per group, then one row per pair.
    pairs = [(t, p) for t in classes for p in classes]
    cells = F.array(*[F.struct(F.lit(t).alias("true_label"), F.lit(p).alias("predicted_label"),
                               _cnt((F.col(y) == t) & (F.col(yhat) == p)).alias("n")) for t, p in pairs])
    return df.groupBy(*by).agg(cells.alias("_c")).select(*by, F.inline("_c"))


# ---------------------------------------------------------------- A04
def classification_report(df: DataFrame, classes: Sequence[int] = (0, 1), y: str = "y", yhat: str = "yhat",
                          by: Sequence[str] = ("task",)) -> DataFrame:
    """Per group: one row per class, plus ``accuracy``, ``macro avg`` and
    ``weighted avg`` rows: ``(by.., row, precision, recall, f1, support)``.
    The accuracy row carries the accuracy in all three metric columns."""
    by = list(by)
    cm = df.groupBy(*by, F.col(y).alias("_y"), F.col(yhat).alias("_p")).count()
    per = cm.select("*", F.explode(F.array(*[F.lit(c) for c in classes])).alias("_c")).groupBy(*by, "_c").agg(
        F.sum(F.when((F.col("_y") == F.col("_c")) & (F.col("_p") == F.col("_c")), F.col("count")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_y") == F.col("_c"), F.col("count")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("_p") == F.col("_c"), F.col("count")).otherwise(0)).alias("pred"),
    )
    per = per.select(
        *by, F.col("_c").cast("string").alias("row"), "tp", "support",
        _div0(F.col("tp"), F.col("pred")).alias("precision"),
        _div0(F.col("tp"), F.col("support")).alias("recall"),
        _div0(2 * F.col("tp"), F.col("pred") + F.col("support")).alias("f1"),
    )
    # A group's class rows (as many as classes) and its three summary rows come
    # out of one grouped aggregate.
    cols = ["precision", "recall", "f1"]

    def row(name: Column, values: Sequence[Column], support: Column) -> Column:
        return F.struct(name.alias("row"), *[v.alias(c) for v, c in zip(values, cols)], support.alias("support"))

    acc = _div0(F.sum("tp"), F.sum("support"))
    g = per.groupBy(*by).agg(
        F.array_sort(F.collect_list(row(F.col("row"), [F.col(c) for c in cols], F.col("support")))).alias("_rows"),
        row(F.lit("accuracy"), [acc] * 3, F.sum("support")).alias("_acc"),
        row(F.lit("macro avg"), [F.avg(c) for c in cols], F.sum("support")).alias("_macro"),
        row(F.lit("weighted avg"), [_div0(F.sum(F.col(c) * F.col("support")), F.sum("support")) for c in cols],
            F.sum("support")).alias("_weighted"))
    return g.select(*by, F.inline(F.concat("_rows", F.array("_acc", "_macro", "_weighted"))))


# ---------------------------------------------------------------- A05
def _roc_points(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Per (group, distinct score): tp, fp, inclusive running sums from the
    highest score down, and the group totals P, N.  Without groups a constant
    key stands in, so the totals join is still an equi-join."""
    keys = list(by) or ["_tl_all"]
    src = df if by else df.withColumn("_tl_all", F.lit(0))
    g = src.groupBy(*keys, F.col(score).cast("double").alias("threshold")).agg(
        _cnt(F.col(label) == 1).alias("tp"), _cnt(F.col(label) != 1).alias("fp"))
    # One pass over the predictions; the per-score table feeds three branches.
    g = materialize(g)
    cum = running_sums(g, "threshold", ["tp", "fp"], by=keys, descending=True)
    totals = g.groupBy(*keys).agg(F.sum("tp").alias("P"), F.sum("fp").alias("N"))
    out = cum.join(totals, keys, "inner")  # one row per group; AQE broadcasts it at runtime
    return out if by else out.drop("_tl_all")


def roc_curve(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = (),
              drop_intermediate: bool = False, include_origin: bool = False) -> DataFrame:
    """One ROC point per distinct score (descending threshold):
    ``(by.., threshold, fpr, tpr)``; rates are NULL when a class is absent.

    ``drop_intermediate`` keeps only the first, the last and the corner
    points (non-zero second difference of the cumulative false or true
    positives); ``include_origin`` adds the point (0, 0) at threshold
    +infinity.  Neighbours are found by distributed ranks and equi-joins on
    rank +- 1, not by an ordered window."""
    pts = _roc_points(df, score, label, by)
    by = list(by)
    if drop_intermediate:
        keys = by or ["_tl_all"]
        base = pts if by else pts.withColumn("_tl_all", F.lit(0))
        ranked = materialize(global_rank(base, "threshold", by=keys, descending=True, name="_i"))
        prev = ranked.select(*keys, (F.col("_i") + 1).alias("_i"), F.col("cum_tp").alias("_ptp"),
                             F.col("cum_fp").alias("_pfp"))
        nxt = ranked.select(*keys, (F.col("_i") - 1).alias("_i"), F.col("cum_tp").alias("_ntp"),
                            F.col("cum_fp").alias("_nfp"))
        j = ranked.join(prev, [*keys, "_i"], "left").join(nxt, [*keys, "_i"], "left")
        corner = ((F.col("_nfp") - 2 * F.col("cum_fp") + F.col("_pfp")) != 0) | \
                 ((F.col("_ntp") - 2 * F.col("cum_tp") + F.col("_ptp")) != 0)
        pts = j.where(F.col("_ptp").isNull() | F.col("_ntp").isNull() | corner)
        pts = pts if by else pts.drop("_tl_all")
    out = pts.select(*by, "threshold",
                     F.try_divide(F.col("cum_fp").cast("double"), F.col("N")).alias("fpr"),
                     F.try_divide(F.col("cum_tp").cast("double"), F.col("P")).alias("tpr"))
    if include_origin:
        groups = pts.select(*by, "P", "N").distinct() if by else pts.select("P", "N").limit(1)
        origin = groups.select(*by, F.lit(float("inf")).alias("threshold"),
                               F.when(F.col("N") > 0, 0.0).alias("fpr"), F.when(F.col("P") > 0, 0.0).alias("tpr"))
        out = out.unionByName(origin)
    return out


def roc_auc(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Trapezoidal area under the ROC curve, ties grouped (= Mann-Whitney U).

    Per distinct score s with counts (tp_s, fp_s) and inclusive running sum
    TP_s, the trapezoid is fp_s * (2 TP_s - tp_s) / (2 P N); no lag needed.
    """
    pts = _roc_points(df, score, label, by)
    # counts as decimals: the sum reaches 2 P N, beyond a long for some 4e9 rows
    fp, tp, cum = (F.col(c).cast("decimal(18,0)") for c in ("fp", "tp", "cum_tp"))
    area = F.sum((fp * (cum + (cum - tp))).cast("decimal(38,0)"))
    return pts.groupBy(*by).agg(
        F.try_divide(area.cast("double"), 2.0 * F.first("P") * F.first("N")).alias("auc"))


# ---------------------------------------------------------------- A06
def class_balance(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ("task",)) -> DataFrame:
    """Per group: class counts, positive ratio, and a flag for a model that
    predicts a single class."""
    return df.groupBy(*by).agg(
        _cnt(F.col(y) == 0).alias("n_class0"),
        _cnt(F.col(y) == 1).alias("n_class1"),
        _div0(_cnt(F.col(y) == 1), F.count(F.lit(1))).alias("ratio_class1"),
        (F.count_distinct(F.col(yhat)) == 1).alias("single_class_pred"),
    )


# ---------------------------------------------------------------- A11
def request_stats(log: DataFrame, by: Sequence[str] = ("worker_id",), ok: str = "ok", seconds: str = "seconds",
                  key_col: str | None = None) -> DataFrame:
    """Attempts, failures, mean seconds per attempt (2 decimals), success rate
    and, with ``key_col``, the number of distinct keys of successful answers."""
    aggs = [
        F.count(F.lit(1)).alias("total_requests"),
        _cnt(~F.col(ok)).alias("failed_requests"),
        # Exact decimal mean rounded half-up, independent of summation order.
        F.round(F.avg(F.col(seconds).cast("decimal(20,4)")), 2).cast("double").alias("avg_response_sec"),
        (F.lit(1.0) - _div0(_cnt(~F.col(ok)), F.count(F.lit(1)))).alias("success_rate"),
    ]
    if key_col:
        aggs.append(F.count_distinct(F.when(F.col(ok), F.col(key_col))).alias("cache_size"))
    return log.groupBy(*by).agg(*aggs)


def cache_key(text: Column, entity: Column, prefix_len: int = 150) -> Column:
    """Result-cache key: first ``prefix_len`` characters of the text, ``|``, entity."""
    return F.concat(F.substring(text, 1, prefix_len), F.lit("|"), entity)


# ---------------------------------------------------------------- A12
# The task weights of the combined loss.
TASK_WEIGHTS = {"sarcasm": 2.0, "hostile": 0.3, "contempt": 0.3, "humor": 0.3}
EPS = 1e-15


def multitask_loss(df: DataFrame, weights: Mapping[str, float] = TASK_WEIGHTS, task: str = "task",
                   y: str = "y", p: str = "p") -> DataFrame:
    """Mean binary cross-entropy per task (p clipped to [1e-15, 1 - 1e-15]),
    its weight, and a ``total`` row with the weighted sum."""
    pc = F.least(F.greatest(F.col(p).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    ll = F.when(F.col(y) == 1, F.ln(pc)).otherwise(F.ln(1 - pc))
    wmap = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    per = df.groupBy(task).agg((-F.avg(ll)).alias("loss")).select(
        F.col(task).alias("task"), "loss", F.coalesce(F.try_element_at(wmap, F.col(task)), F.lit(0.0)).alias("weight"))
    # one row per task: listed with their total in one aggregate
    one = per.agg(F.array_sort(F.collect_list(F.struct("task", "loss", "weight"))).alias("_t"),
                  F.struct(F.lit("total").alias("task"), F.sum(F.col("loss") * F.col("weight")).alias("loss"),
                           F.lit(None).cast("double").alias("weight")).alias("_all"))
    return one.select(F.inline(F.concat("_t", F.array("_all"))))


# ---------------------------------------------------------------- A14
def vector_profile(df: DataFrame, vec: str = "embedding", keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """Dimension, min, max and L2 norm of each array vector (row-local)."""
    v = F.col(vec)
    return df.select(
        *keep, F.size(v).alias("dim"),
        F.array_min(v).cast("double").alias("vmin"), F.array_max(v).cast("double").alias("vmax"),
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))).alias("norm"),
    )


# ---------------------------------------------------------------- M06
def select_checkpoint(runs: DataFrame, run: str = "run_id", step: str = "step", metric: str = "eval_loss",
                      greater_is_better: bool = False, keep: int = 2) -> DataFrame:
    """Best ``keep`` checkpoints per run (rank 1 = best; ties -> earlier step).

    ``row_number() <= keep`` is planned as a WindowGroupLimit, so every map
    task keeps at most ``keep`` rows per run before the shuffle; a run holding
    a third of all rows costs no more than any other.
    """
    order = F.col(metric).desc() if greater_is_better else F.col(metric).asc()
    w = Window.partitionBy(run).orderBy(order, F.col(step).asc())
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
