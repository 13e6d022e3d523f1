"""Cleaning of endpoint tables and the accounting of dropped rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from .. import registry as R
from ..functions import clean as C
from .joins import attach_row
from .rank import exact_quantiles


def flag_rows(df: DataFrame, kind: str, modality: str, key: str = "raw_key", label: str = "y") -> DataFrame:
    """Adds the clean `key`, `key_ok` and `label_ok`; drops nothing. Row-local."""
    if modality == R.SEQUENCE:
        clean = C.clean_sequence(F.col(key))
    else:
        clean = F.when(C.valid_molecule(F.col(key)), C.strip(F.col(key)))
    return df.withColumn("key", clean).withColumns({
        "key_ok": F.col("key").isNotNull(), "label_ok": C.valid_label(F.col(label), kind)})


def prepare(df: DataFrame, ep: R.Endpoint, key: str = "raw_key", label: str = "y") -> DataFrame:
    """Kept rows in the one prepared schema (endpoint, kind, modality, key, y). Row-local."""
    rows = flag_rows(df, ep.kind, ep.modality, key, label).where("key_ok AND label_ok")
    return rows.select(F.lit(ep.name).alias("endpoint"), F.lit(ep.kind).alias("kind"),
                       F.lit(ep.modality).alias("modality"), "key", F.col(label).alias("y"))


def drop_accounting(flagged: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Where rows went. `n_label_of_all` counts labels over all rows, `n_label_of_valid` over valid keys."""
    n = F.count_if
    aggs = [F.count(F.lit(1)).alias("n_raw"), n(F.col("key_ok")).alias("n_valid_key"),
            n(F.col("label_ok")).alias("n_label_of_all"),
            n(F.col("key_ok") & F.col("label_ok")).alias("n_label_of_valid"),
            n(F.col("key_ok") & F.col("label_ok")).alias("n_final"),
            n(~(F.col("key_ok") & F.col("label_ok"))).alias("n_dropped")]
    return flagged.groupBy(*by).agg(*aggs) if list(by) else flagged.agg(*aggs)


def same_groups(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Joins two per-group results null-safely; without groups both are one row."""
    if not by:
        return attach_row(left, right)
    renamed = right.withColumnsRenamed({c: f"__g_{i}" for i, c in enumerate(by)})
    cond = F.lit(True)
    for i, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g_{i}"))
    return left.join(renamed, cond, "left").drop(*[f"__g_{i}" for i in range(len(by))])


def label_stats(df: DataFrame, label: str = "y", by: Iterable[str] = ()) -> DataFrame:
    """n, n_null, min, exact median and max of the raw label; NaN counts as missing."""
    by = list(by)
    y = F.when(~C.is_missing(F.col(label)), F.col(label))
    rows = df.select(*by, y.alias("__y"))
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("__y").isNull()).alias("n_null"),
            F.min("__y").alias("min"), F.max("__y").alias("max")]
    stats = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    medians = exact_quantiles(rows, "__y", {"median": 0.5}, by)
    return same_groups(stats, medians, by)


def label_distribution(df: DataFrame, label: str = "y", by: Iterable[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, label)


def route_endpoints(rows: DataFrame, names=None, batch: bool = False, sequence: str = "sequence",
                    molecule: str = "molecule") -> DataFrame:
    """One row per row and endpoint that applies. Named endpoints apply to every row; otherwise those whose input the row
    has, or all of them for a batch or for a row without any input."""
    eps = F.array(*[F.struct(F.lit(e.name).alias("endpoint"), F.lit(e.kind).alias("kind"), F.lit(e.modality).alias("modality"),
                             F.lit(e.transform).alias("transform"), F.lit(e.unit).alias("unit")) for e in R.resolve(names)])
    out = rows.select("*", F.inline(eps))
    has_seq = F.coalesce(F.length(sequence) > 0, F.lit(False))
    has_mol = F.coalesce(F.length(molecule) > 0, F.lit(False))
    has_input = F.when(F.col("modality") == R.SEQUENCE, has_seq).otherwise(has_mol)
    if names is None and not batch:
        out = out.where(has_input | (~has_seq & ~has_mol))
    return out.withColumn("has_input", has_input)
