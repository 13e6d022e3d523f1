"""Seeded splits by family, key or row, and their audits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from .. import registry as R
from .joins import salted_join
from .rank import permutation_rank


def _name(position, first, second):
    return F.when(position < first, "train").when(position < second, "val").otherwise("test")


def _split_groups(groups: DataFrame, group: str, seed: int, train: float, val: float, rounding: str) -> DataFrame:
    """One row per group -> (group, split), cut by group count in seeded pseudo-random order."""
    ranked = permutation_rank(groups, group, seed)
    n = F.col("n_total").cast("double")
    if rounding == "floor":
        first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    else:
        first = F.bround(n * F.lit(train))
        second = first + F.bround(n * F.lit(val))
    return ranked.select(group, _name(F.col("position"), first, second).alias("split"))


def family_split(rows: DataFrame, family: str = "family", seed: int = 42, train: float = R.TRAIN_FRACTION,
                 val: float = R.VAL_FRACTION) -> DataFrame:
    """Adds `split`; all rows of a family share it. Cuts at floor(train * F) and floor((train + val) * F) families."""
    groups = rows.select(family).distinct()
    return salted_join(rows, _split_groups(groups, family, seed, train, val, "floor"), family)


def family_strata(rows: DataFrame, family: str, label: str) -> DataFrame:
    """One row per family: its size class (whole part of log2 of its rows) and its class of mean label, a fifth each; -1 without any label."""
    groups = rows.groupBy(family).agg(F.count(F.lit(1)).alias("__n"), F.avg(label).alias("__rate"))
    return groups.select(family, (F.length(F.bin("__n")) - 1).cast("int").alias("size_class"),
                         F.coalesce(F.floor(F.col("__rate") * R.RATE_CLASSES), F.lit(-1)).cast("int").alias("rate_class"))


def stratified_family_split(rows: DataFrame, label: str, family: str = "family", seed: int = 42, train: float = R.TRAIN_FRACTION,
                            val: float = R.VAL_FRACTION) -> DataFrame:
    """Adds `split`; all rows of a family share it, and every stratum of families alike in size and label rate is cut in the same shares.

    A stratum gets the whole part of the share of all families up to its end less that up to its start: remainders are carried to the
    next stratum, so small strata are not rounded away and the totals equal those of `family_split`, to one family.
    """
    strata = ["size_class", "rate_class"]
    ranked = permutation_rank(family_strata(rows, family, label), family, seed, by=strata)
    # one row a stratum: at most 64 size classes times the rate classes
    counts = ranked.groupBy(*strata).agg(F.max("n_total").alias("__s"))
    upto = Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, 0)
    ends = counts.withColumn("__end", F.sum("__s").over(upto))
    first = lambda end: F.floor(end * F.lit(train))
    # the families of both first sides less those of the first; it may step back by one, which the next strata make up for
    ends = ends.withColumn("__val", F.max(F.floor(F.col("__end") * F.lit(train + val)) - first(F.col("__end"))).over(upto))
    here = first(F.col("__end")) - first(F.col("__end") - F.col("__s"))
    before = F.coalesce(F.lag("__val").over(Window.orderBy(*strata)), F.lit(0))
    cuts = ends.select(*[F.col(c).alias(f"__{c}") for c in strata], here.alias("__first"), (here + F.col("__val") - before).alias("__second"))
    placed = ranked.join(F.broadcast(cuts), (F.col("size_class") == F.col("__size_class")) & (F.col("rate_class") == F.col("__rate_class")))
    split = _name(F.col("position"), F.col("__first"), F.col("__second")).alias("split")
    return salted_join(rows, placed.select(family, split), family)


def unique_key_split(rows: DataFrame, key: str = "key", seed: int = 42, train: float = R.TRAIN_FRACTION,
                     val: float = R.VAL_FRACTION) -> DataFrame:
    """Adds `split`; repeats of a key stay together. Counts are rounded half to even."""
    groups = rows.select(key).distinct()
    return salted_join(rows, _split_groups(groups, key, seed, train, val, "even"), key)


def random_row_split(rows: DataFrame, row_id: str = "row_id", seed: int = 42, train: float = R.TRAIN_FRACTION,
                     val: float = R.VAL_FRACTION) -> DataFrame:
    """Adds `split` per row: the deliberately leaky comparison. Rows need a unique id."""
    ranked = permutation_rank(rows, row_id, seed)
    n = F.col("n_total").cast("double")
    first = F.bround(n * F.lit(train))
    return ranked.withColumn("split", _name(F.col("position"), first, first + F.bround(n * F.lit(val)))).drop(
        "position", "n_total")


def split_audit(rows: DataFrame, groups: Iterable[str], split: str = "split") -> DataFrame:
    """Per split: rows and distinct values of each grouping column (key, signature class, family)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")] + [F.countDistinct(g).alias(f"n_{g}") for g in groups]
    return rows.groupBy(split).agg(*aggs)


def exact_leaks(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """How many groups occur in more than one split (must be 0 for a controlled split)."""
    per = rows.groupBy(group).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("n_leaking"))


def label_rate_gap(rows: DataFrame, labels: Iterable[str], split: str = "split") -> DataFrame:
    """Largest |mean label in train - mean label in test| over the label columns."""
    labels = list(labels)
    means = rows.agg(*[F.avg(F.when(F.col(split) == side, F.col(c))).alias(f"{side}_{c}")
                       for c in labels for side in ("train", "test")])
    gaps = [F.abs(F.col(f"train_{c}") - F.col(f"test_{c}")) for c in labels]
    out = means.select(*[g.alias(f"gap_{c}") for g, c in zip(gaps, labels)])
    top = F.col(f"gap_{labels[0]}") if len(labels) == 1 else F.greatest(*[f"gap_{c}" for c in labels])
    return out.withColumn("max_gap", top)
