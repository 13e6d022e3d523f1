"""Diagnostics of left-censored targets: variance shares, ceilings, sweeps, rank-Gaussian transform."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clean as C, normal as N
from ..functions.sequence import bind
from ..registry import FLOOR, REGION_CUT
from .joins import attach_row, each_of
from .metrics import auc, grouped, regression_aggs
from .prepare import same_groups
from .rank import exact_quantiles, prefix_max, prefix_sums, value_counts


def _moments(df: DataFrame, y: str, keys: list[str]) -> DataFrame:
    return grouped(df, keys, [F.count(y).alias("n"), F.avg(y).alias("mu"), F.var_pop(y).alias("v")])


def variance_share(df: DataFrame, y: str = "y", by: Iterable[str] = (), floor: float = FLOOR,
                   cut: float = REGION_CUT) -> DataFrame:
    """Per region: rows and share of the squared deviation from the global mean. One pass over the rows: the
    deviation of a region is n * var + n * (mean - global mean)^2; only region rows meet the window."""
    by = list(by)
    m = _moments(df.withColumn("region", C.region(F.col(y), floor, cut)), y, [*by, "region"])
    w = Window.partitionBy(*by)
    m = m.withColumn("gm", F.sum(F.col("n") * F.col("mu")).over(w) / F.sum("n").over(w))
    ss = F.col("n") * F.col("v") + F.col("n") * (F.col("mu") - F.col("gm")) ** 2
    m = m.withColumn("ss", ss)
    return m.select(*by, "region", "n", (F.col("ss") / F.sum("ss").over(w)).alias("ss_share"))


def oracle_ceiling(df: DataFrame, y: str = "y", by: Iterable[str] = (), floor: float = FLOOR) -> DataFrame:
    """R2 with perfect non-floor rows when floor rows get the floor mean (a) or the global mean (b)."""
    by = list(by)
    flag = C.is_floor(F.col(y), floor)
    m = grouped(df, by, [
        F.count(y).alias("n"), F.avg(y).alias("gm"), F.var_pop(y).alias("gv"), F.count_if(flag).alias("n_floor"),
        F.avg(F.when(flag, F.col(y))).alias("fm"), F.coalesce(F.var_pop(F.when(flag, F.col(y))), F.lit(0.0)).alias("fv")])
    total = F.col("n") * F.col("gv")
    own = F.col("n_floor") * F.col("fv")
    shared = own + F.coalesce(F.col("n_floor") * (F.col("fm") - F.col("gm")) ** 2, F.lit(0.0))
    return m.select(*by, "n", "n_floor", F.when(total > 0, 1.0 - own / total).alias("ceiling_floor_mean"),
                    F.when(total > 0, 1.0 - shared / total).alias("ceiling_global_mean"),
                    F.when(total > 0, shared / total).alias("floor_ss_share"))


def oracle_sweep(df: DataFrame, ks: Sequence[int], row_id: str = "row_id", y: str = "y", pred: str = "pred",
                 floor: float = FLOOR) -> DataFrame:
    """R2 after the first k true floor rows (in row order) are set to the floor, for every k."""
    err = (F.col(y) - F.col(pred)) ** 2
    base = df.agg(F.sum(err).alias("__res"), (F.var_pop(y) * F.count(y)).alias("__tot"))
    floors = df.where(C.is_floor(F.col(y), floor)).select(
        row_id, (err - (F.col(y) - F.lit(floor)) ** 2).alias("gain"), F.lit(1).alias("one"))
    placed = prefix_sums(floors, row_id, ["one"])
    steps = each_of(df.sparkSession.range(1), "k", [int(k) for k in ks]).select("k")
    gains = each_of(placed, "k", [int(k) for k in ks]).where(F.col("one_before") < F.col("k"))
    gains = gains.groupBy("k").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("n_set"))
    out = attach_row(steps.join(gains, "k", "left"), base)
    r2 = 1.0 - (F.col("__res") - F.coalesce("gain", F.lit(0.0))) / F.col("__tot")
    return out.select("k", F.coalesce("n_set", F.lit(0)).alias("n_set"), r2.alias("r2"))


def flag_sweep(df: DataFrame, fractions: Sequence[float], score: str = "p_floor", y: str = "y", pred: str = "pred",
               floor: float = FLOOR) -> DataFrame:
    """Overwrite the top fraction by score with the floor; R2 and flag quality per fraction."""
    names = {f"__q{i}": 1.0 - f for i, f in enumerate(fractions)}
    cuts = exact_quantiles(df, score, names)
    pairs = F.array(*[F.struct(F.lit(float(f)).alias("top_fraction"), F.col(c).alias("threshold"))
                      for f, c in zip(fractions, names)])
    rows = attach_row(df, cuts).select("*", F.inline(pairs)).drop(*names)
    t, p = C.is_floor(F.col(y), floor), F.col(score) > F.col("threshold")
    aggs = regression_aggs(F.col(y), F.when(p, F.lit(floor)).otherwise(F.col(pred)))[1:2]
    out = rows.groupBy("top_fraction", "threshold").agg(
        *aggs, F.count_if(p).alias("n_flagged"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t).alias("__pos"))
    return out.withColumns({"precision": F.col("tp") / F.greatest(F.col("n_flagged"), F.lit(1)),
                            "recall": F.col("tp") / F.greatest(F.col("__pos"), F.lit(1))}).drop("__pos")


def two_stage(df: DataFrame, threshold: float = 0.5, strict: bool = False, p_floor: str = "p_floor",
              pred: str = "pred", floor: float = FLOOR) -> DataFrame:
    """Adds `staged`: the floor where the classifier says floor, else the regressor. Row-local."""
    hit = F.col(p_floor) > threshold if strict else F.col(p_floor) >= threshold
    return df.withColumn("staged", F.when(hit, F.lit(floor)).otherwise(F.col(pred)))


def blended(pred: Column, p_floor: Column, beta: Column, floor: float = FLOOR) -> Column:
    return pred - beta * p_floor * (pred - F.lit(floor))


def soft_blend(df: DataFrame, betas: Sequence[float], y: str = "y", pred: str = "pred", p_floor: str = "p_floor",
               split: str = "split", floor: float = FLOOR) -> DataFrame:
    """R2 on validation and test for every beta, in one pass; `chosen` marks the beta picked on validation
    alone (the smallest of the best, so 0 wins unless another is strictly better)."""
    rows = each_of(df.where(F.col(split).isin("val", "test")), "beta", [float(b) for b in betas])
    value = blended(F.col(pred), F.col(p_floor), F.col("beta"), floor)
    m = rows.groupBy("beta", split).agg(*regression_aggs(F.col(y), value)[1:2])
    wide = m.groupBy("beta").agg(F.max(F.when(F.col(split) == "val", F.col("r2"))).alias("r2_val"),
                                 F.max(F.when(F.col(split) == "test", F.col("r2"))).alias("r2_test"))
    best = wide.agg(F.min(F.struct((-F.col("r2_val")).alias("r"), F.col("beta").alias("b"))).alias("best"))
    return attach_row(wide, best).select("beta", "r2_val", "r2_test", (F.col("beta") == F.col("best.b")).alias("chosen"))


def soft_blend_regions(df: DataFrame, sweep: DataFrame, y: str = "y", pred: str = "pred", p_floor: str = "p_floor",
                       split: str = "split", floor: float = FLOOR) -> DataFrame:
    """The chosen blend on the test rows, by floor and non-floor: n, R2, exact median of the blended prediction."""
    pick = sweep.where("chosen").agg(F.max("beta").alias("__beta"))
    rows = attach_row(df.where(F.col(split) == "test"), pick)
    rows = rows.withColumn("blend", blended(F.col(pred), F.col(p_floor), F.col("__beta"), floor)).withColumn(
        "part", F.when(C.is_floor(F.col(y), floor), "floor").otherwise("nonfloor"))
    m = rows.groupBy("part").agg(*regression_aggs(F.col(y), F.col("blend"))[:2])
    return same_groups(m, exact_quantiles(rows, "blend", {"median_pred": 0.5}, ["part"]), ["part"])


def rank_gaussian(df: DataFrame, y: str = "y", train: Column | None = None) -> DataFrame:
    """(value, cdf, z) for every distinct value: normal score of its share among the train values.

    Train-only fit. The share of train values <= v is a prefix sum over all distinct values with train
    counts as weights, so no lookup join is needed; values below the train minimum take the minimum's share.
    """
    train = train if train is not None else (F.col("split") == "train")
    counts = df.where(F.col(y).isNotNull()).groupBy(F.col(y).alias("value")).agg(F.count_if(train).alias("m"))
    placed = prefix_sums(counts, "value", ["m"])
    upto = F.col("m_before") + F.col("m")
    lowest = placed.where("m > 0").agg(F.min(F.struct("value", "m")).alias("__low"))
    n = F.col("m_total").cast("double")
    share = F.greatest(upto, F.col("__low.m")) / n
    p = F.least(F.greatest(share, F.lit(0.5) / n), F.lit(1.0) - F.lit(0.5) / n)
    out = attach_row(placed, lowest).select("value", p.alias("cdf"))
    # the start value is bound once: repeated in the refinement it would blow the expression up
    return out.withColumn("z", bind(N.ppf(F.col("cdf")), lambda x: N.refine(x, F.col("cdf"))))


def rank_gaussian_inverse(queries: DataFrame, train_values: DataFrame, z: str = "z", y: str = "y") -> DataFrame:
    """(z, value): normal scores back to target units, by linear interpolation in the sorted train values.

    A sorted lookup without a range join: positions of train values and of queries go into one table and a
    prefix maximum over positions carries the latest train value to each query.
    """
    train = value_counts(train_values, y).select(F.col(y).cast("double").alias("v"), "n")
    ranked = prefix_sums(train, "v", ["n"])
    n = train.agg(F.sum("n").cast("double").alias("__n"))
    q = attach_row(queries.select(z).where(F.col(z).isNotNull()).distinct(), n)
    half = F.lit(0.5) / F.col("__n")
    q = q.withColumn("__pos", F.least(F.greatest(N.cdf(F.col(z)), half), F.lit(1.0) - half) * (F.col("__n") - 1))
    lo = F.floor("__pos").cast("double")
    q = q.withColumns({"lo": lo, "hi": F.least(lo + 1, F.col("__n") - 1), "frac": F.col("__pos") - lo})
    ends = q.select(z, "frac", F.posexplode(F.array("lo", "hi")).alias("end", "at"))
    line = ranked.select(F.col("n_before").cast("double").alias("at"), "v").unionByName(
        ends.select("at").distinct(), allowMissingColumns=True)
    line = line.groupBy("at").agg(F.max("v").alias("v"))
    known = prefix_max(line, "at", "v").select("at", "v_upto")
    both = ends.join(known, "at").groupBy(z, "frac").agg(
        F.max(F.when(F.col("end") == 0, F.col("v_upto"))).alias("__lo"), F.max(F.when(F.col("end") == 1, F.col("v_upto"))).alias("__hi"))
    return both.select(z, (F.col("__lo") * (1 - F.col("frac")) + F.col("__hi") * F.col("frac")).alias("value"))


def group_separability(long: DataFrame, feature: str = "feature", value: str = "value", flag: str = "flag") -> DataFrame:
    """Per feature: exact medians in the flagged and other rows, and the single-feature AUC."""
    rows = long.select(feature, F.col(value).alias("__v"), F.col(flag).cast("int").alias("__f"))
    medians = exact_quantiles(rows, "__v", {"median": 0.5}, [feature, "__f"])
    wide = medians.groupBy(feature).agg(F.max(F.when(F.col("__f") == 1, F.col("median"))).alias("median_floor"),
                                        F.max(F.when(F.col("__f") == 0, F.col("median"))).alias("median_other"))
    return same_groups(wide, auc(rows, "__f", "__v", [feature]), [feature])
