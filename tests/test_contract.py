"""Registered queries against their oracles, plan shapes, streaming and persistence."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_check as O
from assaylake import registry as R
from assaylake.functions import clean as C
from assaylake.operators import models as L, scoring as Sc
from assaylake.plans import bindings as B, catalog, learn
from assaylake.session import ensure_checkpoint_dir
from assaylake.streaming import rowlocal

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return O.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert O.difference(got, con.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", ["clean_sequence", "physchem8", "kmer_counts", "aac", "drop_accounting", "global_rank",
                                  "binary_metrics", "soft_blend", "rank_gaussian", "replicate_census", "score_rows"])
def test_plans_stay_in_the_jvm(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_regressions_read_every_document(spark, sf_dir):
    long_enough = F.length("key") >= R.SCORING_MIN_LEN
    want = B.profiles(spark, sf_dir).where(long_enough).count()
    marked = B.profiles(spark, sf_dir).where(long_enough).join(B.table(spark, sf_dir, "labels"), "doc_id").count()
    assert marked < want
    rows = QUERIES["fit_regression"](spark, sf_dir).groupBy("loss").agg(F.sum("n").alias("n")).collect()
    assert {r["loss"]: r["n"] for r in rows} == {"squared": want, "huber": want}
    base = learn.sized(spark, sf_dir)
    assert base.count() == want and learn.labelled(spark, sf_dir).count() == marked


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = QUERIES["regression_metrics"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in re.findall(r"ReadSchema: [^\n]*", plan)[0]


def test_row_local_operators_run_on_a_stream(spark, sf_dir):
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = B.peptides(spark, sf_dir).select("row_id", "raw_key", "y")
    rows.write.parquet(f"{root}/in")
    stream = rowlocal.read_rows(spark, f"{root}/in", "row_id long, raw_key string, y double")
    q = rowlocal.write_rows(rowlocal.prepare_stream(stream, R.endpoint("Half_life")), f"{root}/out", f"{root}/ck", "endpoint")
    q.awaitTermination(120)
    want = rows.where(C.clean_sequence(F.col("raw_key")).isNotNull()).count()
    assert spark.read.parquet(f"{root}/out").count() == want


def test_scoring_report_and_persistence(spark, sf_dir):
    from pyspark.ml import PipelineModel
    from assaylake.plans.learn import endpoint_models
    models = endpoint_models(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    models["Hemolysis"].write().save(path)
    models["Hemolysis"] = PipelineModel.load(path)
    rows = spark.createDataFrame([(1, "ACDEFGHIKL", None), (2, None, "CCO"), (3, None, None), (4, "acd", "nan")],
                                 "row_id long, sequence string, molecule string")
    got = {(r["row_id"], r["endpoint"]): r for r in Sc.score_rows(rows, models).collect()}
    assert len(got) == 16
    assert got[1, "Hemolysis"]["ok"] and 0 <= got[1, "Hemolysis"]["value"] <= 1 and got[1, "Half_life"]["value"] > 0
    assert not got[1, "Caco2"]["ok"] and got[1, "Caco2"]["reason"] == "no input" and got[1, "Caco2"]["value"] is None
    assert got[2, "Caco2"]["ok"] and not got[2, "Hemolysis"]["ok"] and got[4, "Hemolysis"]["ok"] and not got[4, "Caco2"]["ok"]
    report = {r["row_id"]: r for r in Sc.score_report(Sc.score_rows(rows, models)).collect()}
    assert report[3]["n_ok"] == 0 and len(report[1]["results"]) == 4


def test_entry_and_columns(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and df.first()["max_jaccard"] < R.FAMILY_THRESHOLD
    assert set(entry.oracle_sql()) <= set(entry.queries())
