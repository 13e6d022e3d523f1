"""Equi-join with salted hot keys, and broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import shuffle_partitions


def hot_keys(df: DataFrame, key: str, share: int | None = None) -> DataFrame:
    """Keys holding more than 1/share of all rows, with a salt count; at most `share` rows by counting."""
    return hot_of_counts(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key, "__n", share)


def hot_of_counts(counts: DataFrame, key: str, n: str, share: int | None = None) -> DataFrame:
    """The same from a table of rows per key."""
    share = share or 4 * shuffle_partitions(counts.sparkSession)
    total = counts.agg(F.sum(n).alias("__all"))
    return (attach_row(counts, total).where(F.col(n) * share > F.col("__all"))
            .select(F.col(key).alias("__hot"),
                    F.least(F.ceil(F.col(n) * share / F.col("__all")), F.lit(share)).cast("int").alias("__salts")))


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Many-to-one join on `key`. Hot keys of `rows` are spread over salts; their lookup rows (few, by the
    pigeonhole bound of `hot_keys`) are repeated per salt. Cold keys join as usual.

    `rows` is read twice when `hot` is not given, so pass a materialized table or the hot keys themselves.
    """
    hot = F.broadcast(hot if hot is not None else hot_keys(rows, key))
    left = rows.join(hot, F.col(key) == F.col("__hot"), "left")
    rest = [F.col(c) for c in rows.columns if c != key]
    # rows without further columns are all alike: spread them by the partition they come from
    spread = F.pmod(F.xxhash64(*rest) if rest else F.spark_partition_id(), F.col("__salts")).cast("int")
    left = left.select(*rows.columns, F.coalesce(spread, F.lit(0)).alias("__salt"))
    right = lookup.join(hot, F.col(key) == F.col("__hot"), "left")
    right = right.select(*lookup.columns,
                         F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1)).alias("__salt"))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row (a scalar subquery, run once)."""
    cell = row.select(F.struct(*row.columns).alias("__row")).scalar()
    return df.select("*", cell.alias("__row")).select(*df.columns, *[F.col(f"__row.{c}").alias(c) for c in row.columns])


def each_of(df: DataFrame, name: str, values) -> DataFrame:
    """Repeats every row once per parameter value (a short literal list), as column `name`."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
