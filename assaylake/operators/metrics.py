"""Holdout metrics over (y, prediction) tables, for any grouping columns, each in a few shuffles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean as C
from ..registry import BINARY, FLOOR, REGION_CUT
from .joins import each_of, hot_of_counts, salted_join
from .prepare import same_groups
from .rank import exact_quantiles, global_rank, prefix_sums, value_counts


def grouped(df: DataFrame, by: Iterable[str], aggs: Sequence[Column]) -> DataFrame:
    by = list(by)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def auc(df: DataFrame, y: str = "y", score: str = "score", by: Iterable[str] = ()) -> DataFrame:
    """Tie-aware area under the ROC curve from prefix counts over distinct scores; NULL with one class."""
    by = list(by)
    ranked = global_rank(df, score, by, {"pos": F.col(y).cast("long")})
    neg, neg_before = F.col("n") - F.col("pos"), F.col("n_before") - F.col("pos_before")
    aggs = [F.sum(F.col("pos") * (neg_before + neg / 2.0)).alias("__u"), F.max("pos_total").cast("double").alias("__p"),
            F.max(F.col("n_total") - F.col("pos_total")).cast("double").alias("__n")]
    value = F.when((F.col("__p") > 0) & (F.col("__n") > 0), F.col("__u") / (F.col("__p") * F.col("__n")))
    return grouped(ranked, by, aggs).select(*by, value.alias("auc"))


def binary_metrics(df: DataFrame, y: str = "y", score: str = "score", by: Iterable[str] = (),
                   threshold: float = 0.5) -> DataFrame:
    """AUC, Matthews correlation, accuracy at the threshold, positive rate."""
    by = list(by)
    t, p = F.col(y).cast("long") == 1, F.col(score) >= threshold
    cells = grouped(df, by, [F.count(F.lit(1)).alias("n"), F.count_if(t & p).cast("double").alias("__tp"),
                             F.count_if(~t & p).cast("double").alias("__fp"),
                             F.count_if(t & ~p).cast("double").alias("__fn"),
                             F.count_if(~t & ~p).cast("double").alias("__tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("__tp", "__fp", "__fn", "__tn"))
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    mcc = F.when(scale > 0, (tp * tn - fp * fn) / scale).otherwise(F.lit(0.0))
    out = cells.select(*by, "n", mcc.alias("mcc"), ((tp + tn) / F.col("n")).alias("accuracy"),
                       ((tp + fn) / F.col("n")).alias("pos_rate"))
    return same_groups(out, auc(df, y, score, by), by)


def regression_aggs(y: Column, p: Column) -> list[Column]:
    n = F.count(y)
    residual = F.sum((y - p) * (y - p))
    total = F.var_pop(y) * n
    return [n.alias("n"), F.when(total > 0, F.lit(1.0) - residual / total).alias("r2"), F.sqrt(residual / n).alias("rmse"),
            F.avg(F.abs(y - p)).alias("mae"), F.min(y).alias("y_min"), F.max(y).alias("y_max"),
            F.min(p).alias("pred_min"), F.max(p).alias("pred_max")]


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Iterable[str] = ()) -> DataFrame:
    """n, R2, RMSE, MAE and the ranges of target and prediction."""
    return grouped(df, by, regression_aggs(F.col(y), F.col(pred)))


def spearman(df: DataFrame, y: str = "y", pred: str = "pred", by: Iterable[str] = ()) -> DataFrame:
    """Rank correlation with average ranks.

    Rows collapse to distinct (y, pred); ranks come back by a salted join, since a censored y holds many rows.
    """
    by = list(by)
    pairs = df.groupBy(*by, F.col(y).alias("__y"), F.col(pred).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    pairs = pairs.withColumns({"__ky": F.struct(*by, "__y"), "__kp": F.struct(*by, "__p")})
    for key, value in (("__ky", "__y"), ("__kp", "__p")):
        ranks = global_rank(df.withColumnRenamed(y if value == "__y" else pred, value), value, by)
        centred = F.col("avg_rank") - (F.col("n_total") + 1) / 2.0
        lookup = ranks.select(F.struct(*by, value).alias(key), centred.alias(f"r{value}"), "n")
        hot = hot_of_counts(lookup, key, "n")
        pairs = salted_join(pairs, lookup.drop("n"), key, hot=hot)
    a, b, n = F.col("r__y"), F.col("r__p"), F.col("__n")
    sums = grouped(pairs, by, [F.sum(n * a * b).alias("__ab"), F.sum(n * a * a).alias("__aa"), F.sum(n * b * b).alias("__bb")])
    rho = F.when((F.col("__aa") > 0) & (F.col("__bb") > 0), F.col("__ab") / F.sqrt(F.col("__aa")) / F.sqrt(F.col("__bb")))
    return sums.select(*by, rho.alias("spearman"))


def region_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Iterable[str] = (), floor: float = FLOOR,
                   cut: float = REGION_CUT) -> DataFrame:
    """Regression metrics per floor / bulk / tail region."""
    return regression_metrics(df.withColumn("region", C.region(F.col(y), floor, cut)), y, pred, [*by, "region"])


def nonfloor_metrics(df: DataFrame, y: str = "y", pred: str = "pred", by: Iterable[str] = (),
                     floor: float = FLOOR) -> DataFrame:
    """R2 and rank correlation over all rows and over the non-floor rows."""
    by = list(by)
    both = each_of(df, "part", ["all", "nonfloor"]).where(
        (F.col("part") == "all") | ~C.is_floor(F.col(y), floor))
    keys = [*by, "part"]
    return same_groups(regression_metrics(both, y, pred, keys).select(*keys, "n", "r2", "rmse", "mae"),
                       spearman(both, y, pred, keys), keys)


def pr_curve(df: DataFrame, y: str = "y", score: str = "score", by: Iterable[str] = ()) -> DataFrame:
    """Precision, recall and F1 at every distinct score, flagging score >= threshold."""
    ranked = global_rank(df, score, by, {"pos": F.col(y).cast("long")})
    tp = F.col("pos_total") - F.col("pos_before")
    precision = tp / (F.col("n_total") - F.col("n_before"))
    recall = F.when(F.col("pos_total") > 0, tp / F.col("pos_total"))
    out = ranked.select(*by, F.col(score).alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.lit(2.0) * p * r / F.greatest(p + r, F.lit(1e-12)))


def best_threshold(curve: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """The threshold with the best F1 per group, the lowest one among equals."""
    by = list(by)
    best = grouped(curve, by, [F.min(F.struct((-F.col("f1")).alias("f"), F.col("threshold").alias("t"))).alias("b")])
    return best.select(*by, F.col("b.t").alias("threshold"), (-F.col("b.f")).alias("f1"))


def confusion_at(df: DataFrame, thresholds: Sequence[float], y: str = "y", score: str = "score",
                 by: Iterable[str] = ()) -> DataFrame:
    """Counts, precision, recall and specificity flagging score > threshold, for every threshold in one pass."""
    rows = each_of(df, "threshold", [float(t) for t in thresholds])
    t, p = F.col(y).cast("long") == 1, F.col(score) > F.col("threshold")
    out = grouped(rows, [*by, "threshold"], [
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn")])
    one = F.lit(1)
    return out.withColumns({
        "n_flagged": F.col("tp") + F.col("fp"),
        "precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one),
        "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one),
        "specificity": F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), one)})


def multiclass_confusion(df: DataFrame, y: str = "y", pred: str = "pred", by: Iterable[str] = ()) -> DataFrame:
    """Per class that occurs as label or prediction: support, n_predicted, hits, precision, recall, f1, and the accuracy of all. A row adds its
    label and its prediction to one combined aggregate, whatever the number of classes."""
    by = list(by)
    hit = F.col(y).eqNullSafe(F.col(pred))
    parts = F.array(F.struct(F.col(y).alias("class"), F.lit(1).alias("s"), F.lit(0).alias("p"), hit.cast("int").alias("h")),
                    F.struct(F.col(pred).alias("class"), F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).alias("h")))
    cells = df.select(*by, F.explode(parts).alias("e")).groupBy(*by, F.col("e.class").alias("class")).agg(
        F.sum("e.s").alias("support"), F.sum("e.p").alias("n_predicted"), F.sum("e.h").alias("hits"))
    precision, recall = (F.when(F.col(n) > 0, F.col("hits") / F.col(n)) for n in ("n_predicted", "support"))
    total = grouped(df, by, [F.avg(hit.cast("double")).alias("accuracy")])
    f1 = F.when(F.col("support") + F.col("n_predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("n_predicted")))
    return same_groups(cells.withColumns({"precision": precision, "recall": recall, "f1": f1}), total, by)


def calibration_bins(df: DataFrame, bins: int = 5, y: str = "y", score: str = "score",
                     by: Iterable[str] = ()) -> DataFrame:
    """Quantile bins of the score: rows, observed positive share and mean score of every non-empty bin."""
    by = list(by)
    edges = {f"__e{i}": i / bins for i in range(1, bins)}
    cuts = exact_quantiles(df, score, edges, by)
    rows = same_groups(df, cuts, by)
    number = sum((F.when(F.col(e) < F.col(score), 1).otherwise(0) for e in edges), F.lit(0))
    return grouped(rows.withColumn("bin", number), [*by, "bin"], [
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("observed"), F.avg(score).alias("mean_score")])


def rank_positions(df: DataFrame, flag: str, pred: str = "pred", by: Iterable[str] = ()) -> DataFrame:
    """Where flagged rows sit by prediction (0 = lowest; ties count the rows strictly below): mean, median,
    and how many lie in the lowest k, 2k and 3k rows, k being the number of flagged rows."""
    by = list(by)
    ranked = global_rank(df, pred, by, {"f": F.col(flag).cast("long")}).where("f > 0")
    hits = [F.sum(F.when(F.col("n_before") < m * F.col("f_total"), F.col("f")).otherwise(0)).alias(f"in_bottom_{m}k")
            for m in (1, 2, 3)]
    out = grouped(ranked, by, [F.max("f_total").alias("k"), (F.sum(F.col("f") * F.col("n_before")) / F.sum("f")).alias("mean_position"),
                               *hits])
    places = ranked.select(*by, F.col("n_before").alias("position"), F.col("f").alias("n"))
    return same_groups(out, exact_quantiles(places, "position", {"median_position": 0.5}, by, counts=places), by)


def seed_summary(metrics: DataFrame, config: Sequence[str], metric: str, ddof: int = 0) -> DataFrame:
    """Mean, deviation (ddof 0 or 1), min and max of a metric over seeds."""
    spread = F.stddev_samp(metric) if ddof == 1 else F.stddev_pop(metric)
    return metrics.groupBy(*config).agg(F.count(metric).alias("n_seeds"), F.avg(metric).alias("mean"), spread.alias("sd"),
                                        F.min(metric).alias("min"), F.max(metric).alias("max"))


def leaderboard(metrics: DataFrame, config: Sequence[str], metric: str, baseline: float | None = None,
                top: int | None = None) -> DataFrame:
    """All configurations by metric, or the `top` ones if asked for, and their distance to a baseline."""
    out = metrics if baseline is None else metrics.withColumn("delta", F.col(metric) - F.lit(baseline))
    out = out.orderBy(F.desc(metric), *config)
    return out if top is None else out.limit(top)


def endpoint_summary(registry: DataFrame, binary: DataFrame, regression: DataFrame) -> DataFrame:
    """One row per endpoint: AUC for binary ones, else R2. Inputs have one row per endpoint."""
    joined = registry.join(binary.select("endpoint", "auc", F.col("n").alias("n_b")), "endpoint", "left").join(
        regression.select("endpoint", "r2", F.col("n").alias("n_r")), "endpoint", "left")
    is_binary = F.col("kind") == BINARY
    return joined.select("endpoint", "kind", "modality", "input_dim", F.coalesce("n_b", "n_r").alias("n"),
                         F.when(is_binary, "AUC").otherwise("R2").alias("primary_metric_name"),
                         F.when(is_binary, F.col("auc")).otherwise(F.col("r2")).alias("primary_metric"))
