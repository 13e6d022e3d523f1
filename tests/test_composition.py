"""Counts of whole columns: the same numbers as strings cut letter by letter, and no k-mer made as a string."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assaylake import registry as R
from assaylake.functions import composition as Z, molecule as M, sequence as S
from assaylake.operators import features as X
from assaylake.plans import bindings as B

RND = random.Random(5)
PLAIN = ["", "A", "AC", "KKKK"] + ["".join(RND.choice(R.ALPHABET) for _ in range(n)) for n in (3, 40, 7, 2500, 60)]
ODD = ["A?C", "é", "AéCA", "a", "AC\nDE", "A C", "BO", "C?AY", "a\rbc"]


def frame(spark, keys):
    return spark.createDataFrame(list(enumerate(keys)), "i int, key string")


def shares(s, n):
    letters = [a + b for a in R.ALPHABET for b in R.ALPHABET] if n == 2 else R.ALPHABET
    grams = [s[i:i + n] for i in range(len(s) - n + 1)]
    counts = [sum(g == a for g in grams) for a in letters]
    return [c / max(sum(counts), 1) for c in counts]


@pytest.mark.parametrize("step", [1, 64, 1 << 20])
def test_vectors_are_those_of_single_strings(spark, monkeypatch, step):
    monkeypatch.setattr(Z, "STEP", step)
    both = X.dpc_block(X.aac_block(frame(spark, PLAIN + ODD), "key", "a"), "key", "d")
    for r in both.collect():
        assert r["a"].toArray().tolist() == pytest.approx(shares(r["key"], 1)) and r["d"].toArray().tolist() == pytest.approx(shares(r["key"], 2))
    got = X.sequence_vector(frame(spark, PLAIN)).select("key", vector_to_array("features").alias("v"), *[c.alias(n) for n, c in S.physchem(F.col("key")).items()])
    for r in got.collect():
        assert r["v"][:420] == pytest.approx(shares(r["key"], 1) + shares(r["key"], 2))
        assert r["v"][420:] == [r[n] for n in S.PHYSCHEM]


def test_a_sequence_must_be_there(spark):
    for block in (X.sequence_vector, X.aac_block, X.dpc_block):
        with pytest.raises(Exception, match="without a sequence"):
            block(frame(spark, ["AC", None])).collect()


def test_entries_of_plain_and_odd_strings(spark):
    rows = {r["i"]: [tuple(e) for e in r["e"]] for r in frame(spark, PLAIN + ODD + [None]).select("i", S.dpc_entries(F.col("key")).alias("e")).collect()}
    for i, s in enumerate(PLAIN):
        assert rows[i] == [(k, v) for k, v in enumerate(shares(s, 2)) if v]
    assert rows[len(PLAIN)] == [(-19, 0.5), (-1, 0.5)] and rows[len(PLAIN) + len(ODD)] == []


def test_fingerprints_have_the_bits_of_the_column_function(spark):
    keys = ["", "Br", "BrCC[NH3+]", "https://a.b/c\nd", "é😀x", "C%12C", "[x", "\r\n", "a b", "BrCC[NH3+]", None]
    df = X.fingerprint_block(frame(spark, keys)).select("fingerprint", M.fingerprint_bits(F.col("key")).alias("bits"))
    for r in df.collect():
        assert r["fingerprint"].indices.tolist() == (r["bits"] or []) and set(r["fingerprint"].values.tolist()) <= {1.0}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_cut_no_strings(spark, sf_dir):
    """F17 to F23: pairs were cut out by a regular expression and counted by lambdas; texts were cleaned piece by piece, twice."""
    rows = B.segments(spark, sf_dir)
    assert plan_of(rows).count("regexp_replace") == 1
    for df in (X.sequence_vector(rows), X.aac_block(rows), X.dpc_block(rows), X.fingerprint_block(rows), rows.select(S.dpc_entries(F.col("key")))):
        plan = plan_of(df)
        assert "regexp_extract_all" not in plan and plan.count("ArrowEvalPython") == 1


def test_pieces_of_texts(spark, tmp_path):
    texts = ["Ab-1 c.de\nö. X", "", ".", None, "😀A.B z", "A\r.C"]
    spark.createDataFrame([(i, "en", t, 1) for i, t in enumerate(texts)], "doc_id long, lang string, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    keep = lambda s, letters: "".join(c for c in s if c in letters)
    pieces = {i * 1000000 + p: s for i, t in enumerate(texts) if t is not None for p, s in enumerate(t.replace("\n", ".").split("."))}
    raw = {r["row_id"]: r["raw_key"] for r in B.peptides(spark, str(tmp_path)).collect()}
    assert raw == {i: keep(s, B.LETTERS + "0123456789 ") for i, s in pieces.items()}
    cut = {r["row_id"]: r["key"] for r in B.segments(spark, str(tmp_path)).collect()}
    assert cut == {i: keep(s, B.LETTERS).upper() for i, s in pieces.items() if keep(s, B.LETTERS)}


def test_both_ways_give_the_same_vectors(spark):
    seqs, mols = frame(spark, PLAIN), frame(spark, ["", "BrCC[NH3+]", "https://a.b/c", None])
    for df, block, out in ((seqs, X.sequence_vector, "features"), (mols, X.fingerprint_block, "fingerprint")):
        one, two = ({r["i"]: r[out] for r in block(df, in_jvm=way).collect()} for way in (False, True))
        assert one == two
