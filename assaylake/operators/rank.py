"""Ranks, prefix sums and exact quantiles over whole tables, without a one-task window.

Rows are first collapsed to one row per distinct value, which removes ties and hot values before the
shuffle. Values are then cut into buckets at approximate quantiles; windows run inside (group, bucket)
and the few bucket totals (at most `buckets` per group) carry the offsets. A group with most of the rows
is spread over most of the buckets.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import shuffle_partitions

_BUCKET = "__bucket"


def _lookup(rows: DataFrame, offsets: DataFrame, names: Iterable[str]) -> DataFrame:
    """Null-safe join of rows with per-(group, bucket) offsets, under fresh names for the right side."""
    names = list(names)
    right = offsets.withColumnsRenamed({c: f"__r_{i}" for i, c in enumerate(names)})
    cond = F.lit(True)
    for i, c in enumerate(names):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{i}"))
    return rows.join(right, cond)


def cut_points(df: DataFrame, value: str, buckets: int) -> list[float]:
    """At most buckets - 1 increasing cut values: a bounded list, as a range partitioner would draw."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), probs, 20 * buckets).alias("c")).first()
    cuts = sorted({float(c) for c in (row["c"] or []) if c == c and abs(c) != float("inf")})
    return cuts


def with_buckets(df: DataFrame, value: str, buckets: int | None = None,
                 cuts: list[float] | None = None) -> DataFrame:
    """Adds an order-preserving bucket number of `value`; fixed cut literals, so re-runs agree."""
    if cuts is None:
        cuts = cut_points(df, value, buckets or shuffle_partitions(df.sparkSession))
    if not cuts:
        return df.withColumn(_BUCKET, F.lit(0.0))
    numeric = "__numeric"
    out = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=numeric, outputCol=_BUCKET,
                     handleInvalid="keep").transform(df.withColumn(numeric, F.col(value).cast("double")))
    return out.drop(numeric)


def prefix_sums(df: DataFrame, value: str, sums: Iterable[str], by: Iterable[str] = (),
                buckets: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """For a table with one row per (by, value): adds `<s>_before` (rows with smaller value, same group)
    and `<s>_total` (whole group) for every summed column."""
    by, sums = list(by), list(sums)
    rows = with_buckets(df, value, buckets, cuts)
    inside = Window.partitionBy(*by, _BUCKET).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__in_{s}") for s in sums])
    totals = rows.groupBy(*by, _BUCKET).agg(*[F.sum(s).alias(f"__sum_{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = totals.select(
        *by, _BUCKET,
        *[F.coalesce(F.sum(f"__sum_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sums],
        *[F.sum(f"__sum_{s}").over(whole).alias(f"{s}_total") for s in sums])
    joined = _lookup(rows, offsets, [*by, _BUCKET])
    return joined.select(
        *df.columns, *[(F.col(f"__in_{s}") + F.col(f"__off_{s}")).alias(f"{s}_before") for s in sums],
        *[F.col(f"{s}_total") for s in sums])


def value_counts(df: DataFrame, value: str, by: Iterable[str] = (),
                 extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (by, value) with `n` rows and further summed columns (partial aggregation first)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(c).alias(name) for name, c in (extra or {}).items()]
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*aggs)


def global_rank(df: DataFrame, value: str, by: Iterable[str] = (),
                extra: Mapping[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """Per distinct value: n, n_before, n_total, min_rank, avg_rank (1-based, ties averaged)."""
    counts = value_counts(df, value, by, extra)
    out = prefix_sums(counts, value, ["n", *(extra or {})], by, buckets)
    return out.withColumns({"min_rank": F.col("n_before") + 1,
                            "avg_rank": F.col("n_before") + (F.col("n") + 1) / 2.0})


def hash_order(key: Column, seed: int | str) -> Column:
    """Reproducible pseudo-random order key: hex digest of seed|key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def permutation_rank(df: DataFrame, key: str, seed: int | str, buckets: int | None = None, by: Iterable[str] = ()) -> DataFrame:
    """One row per key -> adds `position` (0-based) in seeded pseudo-random order and `n_total`, of the whole table or per group.

    Digests are uniform, so buckets are equal digest ranges and need no pass over the data; a group with most of the rows is spread over all of them.
    """
    n, by = buckets or shuffle_partitions(df.sparkSession), list(by)
    span = 16 ** 8
    rows = df.withColumn("__digest", hash_order(F.col(key), seed))
    number = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("double")
    rows = rows.withColumn(_BUCKET, F.floor(number * n / span).cast("double"))
    w = Window.partitionBy(*by, _BUCKET).orderBy("__digest", key)
    rows = rows.withColumn("__in", F.row_number().over(w) - 1)
    totals = rows.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, _BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"),
                            F.sum("__n").over(Window.partitionBy(*by)).alias("n_total"))
    if not by:
        # at most `n` offset rows: bounded by the bucket count, so a broadcast is safe
        offsets = F.broadcast(offsets)
    joined = _lookup(rows, offsets, [*by, _BUCKET])
    return joined.select(*df.columns,
                         (F.col("__in") + F.col("__off")).cast("long").alias("position"), "n_total")


def prefix_max(df: DataFrame, order: str, value: str, by: Iterable[str] = (),
               buckets: int | None = None) -> DataFrame:
    """Adds `<value>_upto`: the largest value at or before each position of `order` (ties see each other)."""
    by = list(by)
    rows = with_buckets(df, order, buckets)
    inside = Window.partitionBy(*by, _BUCKET).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__in", F.max(value).over(inside))
    tops = rows.groupBy(*by, _BUCKET).agg(F.max(value).alias("__top"))
    before = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(*by, _BUCKET, F.max("__top").over(before).alias("__off"))
    joined = _lookup(rows, offsets, [*by, _BUCKET])
    return joined.select(*df.columns,
                         F.greatest("__in", "__off").alias(f"{value}_upto"))


def exact_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float], by: Iterable[str] = (),
                    counts: DataFrame | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per group from prefix counts; no group is collected.

    One row per group (none for an empty one): by columns and one column per named quantile.
    """
    by = list(by)
    ranked = prefix_sums(counts if counts is not None else value_counts(df, value, by), value, ["n"], by)
    end = F.col("n_before") + F.col("n")
    v, aggs, outs = F.col(value).cast("double"), [], []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("n_total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("n_before") <= at) & (at < end), v)).alias(f"__{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"__{name}_f"))
        lo, hi, frac = F.col(f"__{name}_lo"), F.col(f"__{name}_hi"), F.col(f"__{name}_f")
        outs.append((lo + (hi - lo) * frac).alias(name))
    grouped = ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)
    return grouped.select(*by, *outs)
