"""Hand-computed values of the row functions."""

import math
import statistics

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assaylake import registry as R
from assaylake.functions import censored as T, clean as C, molecule as M, normal as N, sequence as S
from assaylake.operators import features as X

# sequence -> mw, mean hydropathy, range, charge, pI, share hydropathy > 0, share charged
PHYS = {
    "ACDEFGHIKLMNPQRSTVWY": (2200, -0.49, 9.0, 0.1, 7.0, 0.35, 0.25),
    "GAGAGAGAGAGA": (1320, 0.7, 2.2, 0, 7.0, 0.5, 0.0),
    "KKKKKKKKKK": (1100, -3.9, 0.0, 10, 9.0, 0.0, 1.0),
    "VVVVVVVVVV": (1100, 4.2, 0.0, 0, 7.0, 1.0, 0.0),
    "PPPPPPPPPP": (1100, -1.6, 0.0, 0, 7.0, 0.0, 0.0),
    "ACDE": (440, -0.675, 6.0, -2, 6.0, 0.5, 0.5),
    "GAGAGA": (660, 0.7, 2.2, 0, 7.0, 0.5, 0.0),
    "RKRRKRRKRR": (1100, -4.32, 0.6, 10, 9.0, 0.0, 1.0),
    "DDDEDDDEDD": (1100, -3.5, 0.0, -10, 5.0, 0.0, 1.0),
    "MLLLLLLLLL": (1100, 3.61, 1.9, 0, 7.0, 1.0, 0.0),
}


def one(spark, value, expr, type_="string"):
    return spark.createDataFrame([(value,)], f"s {type_}").select(expr(F.col("s")).alias("v")).first()["v"]


@pytest.mark.parametrize("raw,want", [
    (" acde ", "ACDE"), ("AC DE", "ACDE"), ("ACD", None), ("ACDX", None), ("", None), (None, None), ("A" * 121, None),
    ("A" * 120, "A" * 120), ("\tacde\n", "ACDE"), ("AC\tDE", None), ("ACDE1", None)])
def test_clean_sequence(spark, raw, want):
    assert one(spark, raw, C.clean_sequence) == want


@pytest.mark.parametrize("raw,want", [("acd", True), ("AC", False), (" ACD", False), ("A" * 121, True), (None, False), ("ACDX", False)])
def test_scoring_mask(spark, raw, want):
    assert one(spark, raw, C.scoring_mask) is want


@pytest.mark.parametrize("raw,want", [
    ("CC(=O)O", True), ("", False), ("nan", False), ("None", False), (None, False), ("C(C", False), ("C)C(", False),
    ("[NH3+]CC", True), ("C C", False), ("C]C[", False), (" CCO ", True)])
def test_valid_molecule(spark, raw, want):
    assert one(spark, raw, C.valid_molecule) is want


def test_valid_label_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (float("nan"),), (None,)], "y double")
    rows = df.select(C.valid_label(F.col("y"), R.BINARY).alias("b"), C.valid_label(F.col("y"), R.REGRESSION).alias("r")).collect()
    assert [r["b"] for r in rows] == [True, True, False, False, False]
    assert [r["r"] for r in rows] == [True, True, True, False, False]


def test_physchem(spark):
    df = spark.createDataFrame([(s,) for s in PHYS], "s string")
    for row in df.select("s", *[c.alias(n) for n, c in S.physchem(F.col("s")).items()]).collect():
        mw, mean, rng, charge, pi, hydro, charged = PHYS[row["s"]]
        got = [row["mw"], row["hydro_mean"], row["hydro_range"], row["net_charge"], row["pi_est"], row["gravy"],
               row["hydrophobic_share"], row["charged_share"]]
        assert got == pytest.approx([mw, mean, rng, charge, pi, mean, hydro, charged], abs=1e-9)


def test_kmers_and_signature(spark):
    counts = one(spark, "GAGAGA", lambda s: S.kmer_counts(s, 3))
    assert {r["token"]: r["n"] for r in counts} == {"GAG": 2, "AGA": 2}
    assert one(spark, "KKKKKKKKKK", lambda s: S.kmer_counts(s, 3))[0]["n"] == 8
    assert one(spark, "AC", lambda s: S.kmer_counts(s, 3)) == []
    a, b = (one(spark, s, S.kmer_signature) for s in ("FRRFFKWPRRPFKFF", "FRRPFKWPRRFFKFF"))
    assert a == b
    assert one(spark, "GAGAGAGA", S.kmer_signature) != one(spark, "GAGAGA", S.kmer_signature)


def test_sequence_vector_layout(spark):
    df = spark.createDataFrame([("KKKKKKKKKK",), ("GAGAGA",)], "key string")
    rows = X.sequence_vector(df).select("key", vector_to_array("features").alias("v")).collect()
    k, g = rows[0]["v"], rows[1]["v"]
    assert len(k) == R.SEQUENCE_FEATURES
    kk = R.ALPHABET.index("K")
    assert k[kk] == 1.0 and k[20 + 20 * kk + kk] == 1.0 and sum(k[20:420]) == pytest.approx(1.0)
    ga, ag = (20 + 20 * R.ALPHABET.index(x) + R.ALPHABET.index(y) for x, y in ("GA", "AG"))
    assert g[ga] == pytest.approx(0.6) and g[ag] == pytest.approx(0.4)


def test_sequence_vector_rejects_other_residues(spark):
    df = spark.createDataFrame([("ACXD",)], "key string")
    with pytest.raises(Exception, match="non-standard residue"):
        X.sequence_vector(df).collect()


def test_fingerprint(spark):
    bits = one(spark, "BrCC[NH3+]", lambda s: M.fingerprint_bits(s, 2))
    assert bits == sorted(set(bits)) and all(0 <= b < 2048 for b in bits)
    assert one(spark, "BrCC[NH3+]", M.tokens) == ["Br", "C", "C", "[NH3+]"]
    assert one(spark, "", lambda s: M.fingerprint_bits(s, 2)) == []


def test_normal_functions(spark):
    nd = statistics.NormalDist()
    xs = [i / 10 for i in range(-80, 81)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", N.cdf(F.col("x")).alias("c"), N.log_cdf(F.col("x")).alias("l")).collect():
        exact = 0.5 * math.erfc(-r["x"] / math.sqrt(2))
        assert abs(r["c"] - exact) < 1e-12
        tol = 1e-8 if r["x"] >= -6 else 3.0 / r["x"] ** 4
        assert abs(r["l"] - math.log(exact)) < tol
    ps = [0.0001, 0.01, 0.02425, 0.3, 0.5, 0.77, 0.99, 0.99999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("x", N.ppf(F.col("p")))
    for r in df.select("p", N.refine(F.col("x"), F.col("p")).alias("z")).collect():
        assert abs(r["z"] - nd.inv_cdf(r["p"])) < 1e-9


def test_tobit_directions(spark):
    df = spark.createDataFrame([(-8.0, -8.0), (5.0, -10.0), (-15.0, -10.0)], "f double, y double")
    a, b, c = [r[0] for r in df.select(T.tobit_nll(F.col("f"), F.col("y"), 1.0)).collect()]
    assert abs(a) < 1e-9 and b > 5 and c < 0.05


def test_registry_rejects_unknown():
    with pytest.raises(ValueError):
        R.Endpoint("x", R.REGRESSION, R.SEQUENCE, "k", "y", "log10plus")
    with pytest.raises(ValueError):
        R.endpoint("nope")
    assert [e.input_dim for e in R.ENDPOINTS] == [1580, 1580, 3033, 3033]
