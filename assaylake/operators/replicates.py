"""Replicate measurements, noise ceilings, label comparisons between data sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import clean as C
from ..registry import FLOOR
from .joins import attach_row
from .prepare import same_groups
from .rank import exact_quantiles


def _agg(df: DataFrame, by: Iterable[str], aggs) -> DataFrame:
    by = list(by)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def replicate_mean(df: DataFrame, key: str = "key", y: str = "y", order: Iterable[str] = (),
                   features: Iterable[str] = ()) -> DataFrame:
    """One row per key: mean target, number of repeats, and the features of the first row in `order`."""
    order, features = list(order), list(features)
    aggs = [F.avg(y).alias("y_mean"), F.count(F.lit(1)).alias("repeats")]
    if features:
        first = F.min_by(F.struct(*features), F.struct(*order))
        out = df.groupBy(key).agg(*aggs, first.alias("__f"))
        return out.select(key, "y_mean", "repeats", "__f.*")
    return df.groupBy(key).agg(*aggs)


def replicate_info(means: DataFrame) -> DataFrame:
    return means.agg(F.sum("repeats").alias("n_rows_before"), F.count(F.lit(1)).alias("n_rows_after"),
                     (F.sum("repeats") - F.count(F.lit(1))).alias("n_duplicate_keys"),
                     F.max("repeats").alias("max_repeats"))


def _per_key(df: DataFrame, by: list[str], key: str, y: str) -> DataFrame:
    return df.groupBy(*by, key).agg(
        F.count(F.lit(1)).alias("c"), F.count(y).alias("m"), F.avg(y).alias("mu"),
        F.coalesce(F.stddev_samp(y), F.lit(0.0)).alias("sd"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("v"))


def replicate_census(df: DataFrame, key: str = "key", y: str = "y", by: Iterable[str] = ()) -> DataFrame:
    """How often keys repeat and how far repeats spread (sample deviation; singletons count as 0)."""
    by = list(by)
    keys = _per_key(df, by, key, y)
    spread = (F.col("c") > 1) & (F.col("sd") > 1e-9)
    out = _agg(keys, by, [
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("c") > 1).alias("n_repeated_keys"),
        F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_repeated_rows"),
        F.count_if(spread).alias("n_spread_keys"), F.avg(F.when(spread, F.col("sd"))).alias("mean_spread"),
        F.max(F.when(spread, F.col("sd"))).alias("max_spread")])
    overall = _agg(df, by, [F.stddev_samp(y).alias("overall_sd")])
    return same_groups(out, overall, by)


def noise_ceiling(df: DataFrame, key: str = "key", y: str = "y", goal: float = 0.8,
                  by: Iterable[str] = ()) -> DataFrame:
    """Best R2 any predictor of the key alone can reach: 1 - E[Var(y|key)] / Var(y)."""
    by = list(by)
    within = _agg(_per_key(df, by, key, y), by, [
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("c") * F.col("v")).alias("__wv")])
    overall = _agg(df, by, [F.var_samp(y).alias("var_y")])
    both = same_groups(within, overall, by)
    noise = F.col("__wv") / F.col("n")
    ceiling = F.lit(1.0) - noise / F.col("var_y")
    return both.select(*by, "n", "n_keys", "var_y", noise.alias("noise_var"), ceiling.alias("ceiling"),
                       (ceiling >= goal).alias("reachable"))


def label_ab(df: DataFrame, key: str = "key", y: str = "y", floor: float = FLOOR) -> DataFrame:
    """Raw rows against key-averaged rows: counts, mixed floor keys, keys lifted above the floor by averaging."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.avg(y).alias("mu"),
                               F.count_if(C.is_floor(F.col(y), floor)).alias("f"))
    has = F.col("f") > 0
    return keys.agg(
        F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
        (F.sum("c") / F.count(F.lit(1))).alias("mean_replicates"), F.sum("f").alias("n_floor_rows"),
        F.count_if(has).alias("n_floor_keys"), F.count_if(has & (F.col("f") < F.col("c"))).alias("n_mixed_keys"),
        F.count_if(has & ~C.is_floor(F.col("mu"), floor)).alias("n_lifted_keys"))


def target_profile(df: DataFrame, y: str = "y", by: Iterable[str] = ()) -> DataFrame:
    """min, max, sample deviation, bias-corrected skewness, missing and distinct counts of the target."""
    by = list(by)
    v = F.when(~C.is_missing(F.col(y)), F.col(y))
    rows = df.select(*by, v.alias("__v"))
    n = F.count("__v")
    skew = F.when(n > 2, F.skewness("__v") * F.sqrt(n * (n - 1)) / (n - 2))
    distinct = rows.where(F.col("__v").isNotNull()).groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    distinct = _agg(distinct, by, [F.count(F.lit(1)).alias("n_distinct")])
    main = _agg(rows, by, [n.alias("n"), F.count_if(F.col("__v").isNull()).alias("n_missing"), F.min("__v").alias("min"),
                           F.max("__v").alias("max"), F.stddev_samp("__v").alias("sd"), skew.alias("skew")])
    by = list(by)
    return same_groups(main, distinct, by).fillna(0, ["n_distinct"])


def dataset_overlap(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys of A, B and both, shares of each, and B without A: one shuffle, no join."""
    marked = a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    keys = marked.groupBy(key).agg(F.max("in_a").alias("a"), F.max("in_b").alias("b"))
    both = F.count_if((F.col("a") == 1) & (F.col("b") == 1))
    n_a, n_b = F.count_if(F.col("a") == 1), F.count_if(F.col("b") == 1)
    return keys.agg(n_a.alias("n_a"), n_b.alias("n_b"), both.alias("n_both"), (both / n_a).alias("share_of_a"),
                    (both / n_b).alias("share_of_b"), (n_b - both).alias("n_b_only"))


def label_agreement(a: DataFrame, b: DataFrame, key: str = "key", y: str = "y",
                    tolerance: float = 1e-4) -> DataFrame:
    """Labels of shared keys, each side first reduced to its mean per key."""
    means = [side.groupBy(key).agg(F.avg(y).alias(name)) for side, name in ((a, "__a"), (b, "__b"))]
    diffs = means[0].join(means[1], key).select(F.abs(F.col("__a") - F.col("__b")).alias("d"))
    stats = diffs.agg(F.count(F.lit(1)).alias("n_shared"), F.max("d").alias("max_diff"),
                      F.count_if(F.col("d") < tolerance).alias("n_equal"))
    return attach_row(stats, exact_quantiles(diffs, "d", {"median_diff": 0.5}))


def floor_census(df: DataFrame, y: str = "y", by: Iterable[str] = (), floor: float = FLOOR) -> DataFrame:
    f = C.is_floor(F.col(y), floor)
    return _agg(df, by, [F.count(F.lit(1)).alias("n"), F.count_if(f).alias("n_floor"),
                         F.avg(f.cast("double")).alias("floor_share")])
