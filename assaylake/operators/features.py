"""Feature vectors, embedding joins, scaling and feature audits."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import composition as Z, molecule as M, sequence as S
from ..registry import ALPHABET, FINGERPRINT_BITS
from .joins import attach_row, salted_join


def aac_block(df: DataFrame, key: str = "key", output: str = "aac") -> DataFrame:
    return df.withColumn(output, Z.letter_shares(F.col(key)))


def dpc_block(df: DataFrame, key: str = "key", output: str = "dpc") -> DataFrame:
    return df.withColumn(output, Z.pair_shares(F.col(key)))


def physchem_block(df: DataFrame, key: str = "key", output: str = "physchem") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.array(*S.physchem(F.col(key)).values())))


def _shares(df: DataFrame, tokens: Column, vocabulary: Sequence[str], output: str) -> DataFrame:
    """Sparse vector of token shares over a fixed vocabulary (counts scaled to sum 1), in the JVM."""
    raw, toks = f"__raw_{output}", f"__tok_{output}"
    model = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol=toks, outputCol=raw)
    out = model.transform(df.withColumn(toks, tokens))
    return Normalizer(p=1.0, inputCol=raw, outputCol=output).transform(out).drop(raw, toks)


def sequence_vector(df: DataFrame, key: str = "key", output: str = "features", in_jvm: bool = False) -> DataFrame:
    """[20 letter shares | 400 dipeptide shares | 8 properties] = 428; fails on a non-standard residue.

    Row-local, so it runs on a stream too; the vectors stay sparse. `in_jvm` gives the same vectors without Python, at several times the time.
    """
    if not in_jvm:
        return df.withColumn(output, Z.sequence_features(S.checked(F.col(key))))
    out = df.withColumn("__key", S.checked(F.col(key)))
    for n, vocabulary, block in ((1, ALPHABET, "__aac"), (2, S.DIPEPTIDES, "__dpc")):
        out = _shares(out, S.kmers(F.col("__key"), n), vocabulary, block)
    out = physchem_block(out, "__key", "__phys")
    out = VectorAssembler(inputCols=["__aac", "__dpc", "__phys"], outputCol=output).transform(out)
    return out.drop("__key", "__aac", "__dpc", "__phys")


def fingerprint_block(df: DataFrame, key: str = "key", radius: int = 2, output: str = "fingerprint", in_jvm: bool = False) -> DataFrame:
    if not in_jvm:
        return df.withColumn(output, Z.fingerprint_vector(F.col(key), M.TOKEN_PATTERN, radius))
    bits = F.transform(M.fingerprint_bits(F.col(key), radius), lambda b: b.cast("string"))
    model = CountVectorizerModel.from_vocabulary([str(b) for b in range(FINGERPRINT_BITS)],
                                                 inputCol="__bits", outputCol=output)
    return model.setBinary(True).transform(df.withColumn("__bits", bits)).drop("__bits")


def array_block(df: DataFrame, array: str, output: str) -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(array).cast("array<double>")))


def concat_blocks(df: DataFrame, blocks: Sequence[str], output: str = "features") -> DataFrame:
    """The named vector blocks in the given order, and the total width as `dim`."""
    out = VectorAssembler(inputCols=list(blocks), outputCol=output).transform(df)
    return out.withColumn("dim", F.size(vector_to_array(F.col(output))))


def masked_mean_pool(states: DataFrame, key: str = "key", mask: str = "mask", state: str = "state") -> DataFrame:
    """Per key: sum(state * mask) / max(sum(mask), 1); vector sums combine before the shuffle."""
    weighted = array_to_vector(F.transform(F.col(state), lambda x: x.cast("double") * F.col(mask)))
    sums = states.groupBy(key).agg(Summarizer.sum(weighted).alias("__s"), F.sum(mask).alias("__m"))
    size = F.greatest(F.col("__m").cast("double"), F.lit(1.0))
    return sums.select(key, F.transform(vector_to_array("__s"), lambda x: x / size).alias("emb"))


def cls_pool(states: DataFrame, key: str = "key", position: str = "pos", state: str = "state") -> DataFrame:
    return states.where(F.col(position) == 0).select(key, F.col(state).alias("emb"))


def one_per_key(store: DataFrame, key: str = "key", value: str = "emb") -> DataFrame:
    """One embedding per key; repeats carry the same vector, the smallest is taken so re-runs agree."""
    return store.groupBy(key).agg(F.min(value).alias(value))


def attach_embeddings(rows: DataFrame, store: DataFrame, key: str = "key", missing: str = "error",
                      value: str = "emb", dim: int | None = None) -> DataFrame:
    """Many-to-one join of rows with the store; hot keys are salted. A missing key fails the job (missing="error"),
    is left NULL ("null"), gets `dim` zeros and has_emb = false ("zero") or, if the caller asks for it, drops the row ("drop")."""
    if missing not in ("error", "null", "zero", "drop") or (missing == "zero") != (dim is not None):
        raise ValueError("missing must be error, null, zero or drop; zero needs dim, the width of the store")
    joined = salted_join(rows, one_per_key(store, key, value), key, "inner" if missing == "drop" else "left")
    if missing == "zero":
        zeros = F.array_repeat(F.lit(0.0), dim).cast(store.schema[value].dataType)
        joined = joined.withColumn("has_emb", F.col(value).isNotNull()).withColumn(value, F.coalesce(value, zeros))
    if missing == "error":
        text = F.concat(F.lit("no embedding for key "), F.col(key).cast("string"))
        joined = joined.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(text)).otherwise(F.col(value)))
    return joined


def novel_keys(rows: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Keys still to be embedded, each once (NULL keys are none)."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(store.select(key), key, "left_anti")


def fit_scaler(df: DataFrame, features: str, train: Column) -> DataFrame:
    """One row: mean and population deviation per dimension over the train rows; zero deviation becomes 1."""
    vec = array_to_vector(F.col(features).cast("array<double>"))
    row = df.where(train).agg(Summarizer.metrics("mean", "variance", "count").summary(vec).alias("s"))
    n = F.col("s.count").cast("double")
    sigma = F.transform(vector_to_array("s.variance"),
                        lambda v: F.when(v > 0, F.sqrt(v * (n - 1.0) / n)).otherwise(F.lit(1.0)))
    return row.select(vector_to_array("s.mean").alias("mu"), sigma.alias("sigma"))


def standardize(df: DataFrame, features: str, scaler: DataFrame, output: str = "scaled") -> DataFrame:
    """(x - mu) / sigma with a fitted one-row scaler."""
    both = attach_row(df, scaler)
    centred = F.zip_with(F.col(features), F.col("mu"), lambda x, m: x.cast("double") - m)
    return both.withColumn(output, F.zip_with(centred, F.col("sigma"), lambda x, s: x / s)).drop("mu", "sigma")


def finite_audit(df: DataFrame, features: str, by: Iterable[str] = ()) -> DataFrame:
    """Rows, rows with a bad value and bad values (NULL, NaN, infinite); a sound table has none."""
    bad = F.size(F.filter(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(features).isNull() | (bad > 0)).alias("n_bad_rows"),
            F.coalesce(F.sum(F.when(F.col(features).isNotNull(), bad)), F.lit(0)).cast("long").alias("n_bad_values")]
    return df.groupBy(*by).agg(*aggs) if list(by) else df.agg(*aggs)


def feature_diff_audit(a: DataFrame, b: DataFrame, key: str, features: str, tolerance: float = 1e-8) -> DataFrame:
    """Two versions of a feature table joined by key: per dimension the largest absolute difference."""
    left, right = a.select(key, F.col(features).alias("__a")), b.select(key, F.col(features).alias("__b"))
    pairs = left.join(right, key)
    diffs = F.zip_with("__a", "__b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    long = pairs.select(F.posexplode(diffs).alias("idx", "d"))
    return long.groupBy("idx").agg(F.max("d").alias("max_diff"), F.count_if(F.col("d") > tolerance).alias("n_over"))


def group_constant_audit(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """Keys whose feature values differ between rows (smallest and largest tuple differ): exact, no hashing."""
    tup = F.struct(*features)
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(tup).alias("__lo"), F.max(tup).alias("__hi"))
    return out.where(~F.col("__lo").eqNullSafe(F.col("__hi"))).select(key, "n")
