"""Readers and writers: endpoint tables, prepared tables, reports, key lists, embedding stores, external sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.clean import strip
from ..registry import Endpoint


def read_endpoint(spark: SparkSession, ep: Endpoint, path: str, fmt: str = "csv", row_id: Column | None = None) -> DataFrame:
    """Raw endpoint table as (row_id, key, y). CSV columns are mapped by header
    name and cast, never inferred; a label that is no number becomes NULL."""
    if fmt == "csv":
        # every header column is read as text; only the two mapped columns survive pruning
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    ident = row_id if row_id is not None else F.monotonically_increasing_id()
    return df.select(ident.alias("row_id"), F.col(ep.key_column).cast("string").alias("key"),
                    F.col(ep.label_column).try_cast("double").alias("y"))


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Prepared rows of all endpoints, one directory per endpoint, so readers prune by partition."""
    writer = df.write.mode(mode).partitionBy("endpoint")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def read_prepared(spark: SparkSession, path: str, endpoint: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if endpoint is None else df.where(F.col("endpoint") == endpoint)


def report_json(df: DataFrame, by: list[str], column: str = "report") -> DataFrame:
    """One JSON document per row: the `by` columns stay, everything else is nested."""
    rest = [c for c in df.columns if c not in by]
    return df.select(*by, F.to_json(F.struct(*rest)).alias(column))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_key_list(spark: SparkSession, path: str) -> DataFrame:
    """Text file with one key per line; trimmed, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("key")).where(F.length("key") > 0)


def write_store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select("key", "model", "emb").write.mode(mode).partitionBy("model").parquet(path)


def checked_store(df: DataFrame, dim: int, model: str | None = None) -> DataFrame:
    """The store rows of one model; a row with another dimension or a non-finite value fails the job."""
    if model is not None:
        df = df.where(F.col("model") == model)
    bad = (F.size("emb") != dim) | F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    emb = F.when(F.coalesce(bad, F.lit(True)),
                 F.raise_error(F.concat(F.lit("bad embedding for key "), F.col("key").cast("string")))
                 ).otherwise(F.col("emb"))
    return df.withColumn("emb", emb)


def read_store(spark: SparkSession, path: str, dim: int, model: str | None = None) -> DataFrame:
    """Fails on a missing path (Spark's own error), a wrong dimension or a non-finite value."""
    return checked_store(spark.read.parquet(path), dim, model)


def external_union(own: DataFrame, external: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Our rows plus the named parts of an external set; `origin` keeps where each row came from."""
    out = own.select(*columns).withColumn("origin", F.lit("own"))
    for name, part in external.items():
        out = out.unionByName(part.select(*columns).withColumn("origin", F.lit(name)))
    return out
