"""Fitting and scoring queries. Fits in few dimensions are solved in SQL as well; of large ones SQL tells the rows, and the query the optimality."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import censored as T, clean as C, normal as N
from ..operators import features as X, linear as A, metrics as M, models as L, scoring as Sc, splits as Sp
from ..session import cut_lineage
from . import bindings as B
from .catalog import query
from .censor import cdf_sql
from .census import rounded
from .rows import _SCORING_ROWS, scoring_rows
from .similar import _KSPLIT, controlled

SEEDS = (42, 123, 456, 789, 1024)


def sized(spark, d):
    """All documents with the 428 sequence features of the whole text and log size; the quality label where there is one."""
    marks = B.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    docs = B.profiles(spark, d).where(F.length("key") >= R.SCORING_MIN_LEN).join(marks, "doc_id", "left")
    return X.sequence_vector(docs.select("doc_id", "key", "label", F.log10("y").alias("y")), "key", Sc.SEQ_FEATURES)


def labelled(spark, d):
    """The documents of `sized` with a label row: what a binary fit can learn from."""
    return sized(spark, d).join(B.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


def with_split(rows):
    return cut_lineage(Sp.unique_key_split(rows))


@query("fit_binary")
def fit_binary(spark, d):
    rows = with_split(labelled(spark, d))
    model = L.fit_binary(rows.where("split = 'train'"), Sc.SEQ_FEATURES, "label")
    scored = L.predictions(model, rows, ["label", "split"], R.BINARY)
    return rounded(M.binary_metrics(scored, "label", "pred", ["split"]))


@query("fit_regression")
def fit_regression(spark, d):
    """Squared loss from one matrix of sums; Huber loss with delta 1 by reweighted sums."""
    rows = with_split(sized(spark, d))
    train, parts = rows.where("split = 'train'"), []
    for loss in ("squared", "huber"):
        fit = A.ridge(A.moments(train, Sc.SEQ_FEATURES, "y")[0]) if loss == "squared" else A.huber_fit(train, Sc.SEQ_FEATURES, "y", penalty=1e-2, tolerance=1e-6)
        scored = rows.select("y", "split", fit.predict(Sc.SEQ_FEATURES).alias("pred"))
        parts.append(M.regression_metrics(scored, by=["split"]).withColumn("loss", F.lit(loss)))
    return rounded(parts[0].unionByName(parts[1]))


def assay_vectors(spark, d):
    """Training rows of the measurements with two features: the stand-in prediction and a step."""
    from pyspark.ml.feature import VectorAssembler
    rows = B.assay(spark, d).where("split = 'train'").withColumn("step", (F.col("row_id") % 13).cast("double"))
    return cut_lineage(VectorAssembler(inputCols=["pred", "step"], outputCol="x").transform(rows).select("x", "y"))


#: Reweighted least squares in three unknowns, solved by determinants, from the plain fit on.
_HUBER = f"""{B.ASSAY}, h AS (SELECT y, pred AS a, CAST(row_id % 13 AS DOUBLE) AS b FROM assay WHERE split = 'train'),
s AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(y, a) AS ya, covar_pop(y, b) AS yb, covar_pop(a, b) AS ab, var_pop(a) AS aa, var_pop(b) AS bb FROM h),
it AS (SELECT 0 AS k, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS p, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS q,
    my - ma * (ya * bb - yb * ab) / (aa * bb - ab * ab) - mb * (yb * aa - ya * ab) / (aa * bb - ab * ab) AS c FROM s
  UNION ALL SELECT k + 1, (cy * vb - cz * cv) / (va * vb - cv * cv), (cz * va - cy * cv) / (va * vb - cv * cv),
    wy - wa * (cy * vb - cz * cv) / (va * vb - cv * cv) - wb * (cz * va - cy * cv) / (va * vb - cv * cv)
  FROM (SELECT k, sy / sw AS wy, sa / sw AS wa, sb / sw AS wb, say / sw - sa / sw * sy / sw AS cy, sby / sw - sb / sw * sy / sw AS cz,
      sab / sw - sa / sw * sb / sw AS cv, saa / sw - sa / sw * sa / sw AS va, sbb / sw - sb / sw * sb / sw AS vb
    FROM (SELECT k, sum(w) AS sw, sum(w * y) AS sy, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * y) AS say, sum(w * b * y) AS sby,
        sum(w * a * b) AS sab, sum(w * a * a) AS saa, sum(w * b * b) AS sbb
      FROM (SELECT k, y, a, b, {R.HUBER_DELTA} / greatest({R.HUBER_DELTA}, abs(y - p * a - q * b - c)) AS w FROM h, it WHERE k < 200) GROUP BY k))),
fit AS (SELECT p, q, c FROM it WHERE k = 200)"""


@query("huber_fit", f"""WITH RECURSIVE {_HUBER} SELECT 'pred' AS name, round(p, 5) AS value FROM fit UNION ALL SELECT 'step', round(q, 5) FROM fit
UNION ALL SELECT 'intercept', round(c, 5) FROM fit""")
def huber_fit(spark, d):
    """Coefficients under Huber loss with delta 1; the oracle repeats the rounds in SQL."""
    fit = A.huber_fit(assay_vectors(spark, d), "x", tolerance=1e-10, most=300)
    values = [*zip(("pred", "step"), map(float, fit.coefficients)), ("intercept", fit.intercept)]
    return rounded(spark.createDataFrame(values, "name string, value double"), 5)


@query("leakage_contrast")
def leakage_contrast(spark, d):
    """The same regression under the family split and under a random row split."""
    base = sized(spark, d)
    fam = base.join(controlled(spark, d).select("doc_id", "split"), "doc_id")
    rnd = Sp.random_row_split(base.select("doc_id"), "doc_id").join(base, "doc_id")
    runs = []
    for name, rows in (("controlled", fam), ("random", rnd)):
        rows = cut_lineage(rows)
        model = L.fit_regression(rows.where("split = 'train'"), Sc.SEQ_FEATURES, "y")
        scored = L.predictions(model, rows.where("split = 'test'"), ["y"], R.REGRESSION)
        runs.append(M.regression_metrics(scored).select(F.lit(name).alias("protocol"), "r2"))
    return rounded(L.leakage_contrast(runs[0].unionByName(runs[1]), "r2"))


def leakage_binary_rows(spark, d):
    base = cut_lineage(labelled(spark, d).where("label IS NOT NULL"))
    fam = base.join(controlled(spark, d).select("doc_id", "split"), "doc_id")
    return {"controlled": cut_lineage(fam), "random": cut_lineage(Sp.random_row_split(base.select("doc_id"), "doc_id").join(base, "doc_id"))}


@query("leakage_contrast_binary")
def leakage_contrast_binary(spark, d):
    """The same classifier under the family split and under a random row split: AUC on test rows."""
    runs = []
    for name, rows in leakage_binary_rows(spark, d).items():
        model = L.fit_binary(rows.where("split = 'train'"), Sc.SEQ_FEATURES, "label")
        scored = L.predictions(model, rows.where("split = 'test'"), ["label"], R.BINARY)
        runs.append(M.auc(scored, "label", "pred").select(F.lit(name).alias("protocol"), "auc"))
    return rounded(L.leakage_contrast(runs[0].unionByName(runs[1]), "auc"))


BLOCKS = {"aac": 20, "dpc": 400, "physchem": 8, "emb_block": 64}


def ablation_rows(spark, d):
    docs = B.profiles(spark, d).where(F.length("key") >= R.SCORING_MIN_LEN).select("doc_id", "key", F.log10("y").alias("y"))
    rows = X.physchem_block(X.dpc_block(X.aac_block(docs)))
    rows = X.attach_embeddings(rows.withColumnsRenamed({"key": "seq", "doc_id": "key"}), B.store(spark, d), missing="zero", dim=64)
    return cut_lineage(Sp.unique_key_split(X.array_block(rows, "emb", "emb_block"), "seq").select(*BLOCKS, "seq", "y", "split"))


@query("feature_ablation")
def feature_ablation(spark, d):
    return rounded(L.feature_ablation(ablation_rows(spark, d), BLOCKS, {
        "aac": ["aac"], "aac+physchem": ["aac", "physchem"], "aac+dpc+physchem": ["aac", "dpc", "physchem"],
        "emb": ["emb_block"], "all": ["aac", "dpc", "physchem", "emb_block"]}))


_SMALL = {"charge": ["a"], "hydropathy": ["b"], "charge+hydropathy": ["a", "b"]}


@query("feature_ablation_small", f"""WITH {_KSPLIT}, f AS (SELECT k.split, log10(p.y) AS y,
  (length(k.key) - length(replace(k.key, 'K', ''))) / length(k.key) AS a, (length(k.key) - length(replace(k.key, 'L', ''))) / length(k.key) AS b
  FROM ksplit k JOIN profiles p ON p.doc_id = k.doc_id WHERE length(k.key) >= {R.SCORING_MIN_LEN}),
t AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(y) AS sy, stddev_pop(a) AS sa, stddev_pop(b) AS sb,
  corr(a, y) AS ry, corr(b, y) AS rz, corr(a, b) AS rab FROM f WHERE split = 'train'),
g AS (SELECT *, 1 + 0.01 / sy AS u FROM t),
w AS (SELECT 'charge' AS config, 1 AS dim, ry / u * sy / sa AS p, 0.0 AS q, * FROM g UNION ALL SELECT 'hydropathy', 1, 0.0, rz / u * sy / sb, * FROM g
  UNION ALL SELECT 'charge+hydropathy', 2, (ry * u - rz * rab) / (u * u - rab * rab) * sy / sa, (rz * u - ry * rab) / (u * u - rab * rab) * sy / sb, * FROM g),
r AS (SELECT config, dim, f.y AS y, my + p * (f.a - ma) + q * (f.b - mb) AS e FROM f, w WHERE split = 'test')
SELECT config, dim, count(*) AS n, round(1 - sum((y - e) * (y - e)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - e) * (y - e))), 6) AS rmse FROM r GROUP BY config, dim""")
def feature_ablation_small(spark, d):
    """The ablation with one and two features (shares of two letters), which SQL solves by determinants."""
    from pyspark.ml.functions import array_to_vector
    docs = B.profiles(spark, d).where(F.length("key") >= R.SCORING_MIN_LEN).select("doc_id", "key", F.log10("y").alias("y"))
    share = lambda c: array_to_vector(F.array((F.length("key") - F.length(F.replace(F.col("key"), F.lit(c), F.lit("")))) / F.length("key")))
    rows = cut_lineage(with_split(docs).select("y", "split", share("K").alias("a"), share("L").alias("b")))
    return rounded(L.feature_ablation(rows, {"a": 1, "b": 1}, _SMALL))


#: Depths 5, 6, 7 have up to 32, 64, 128 leaves. The reference's grid has 36 settings a feature set and up to 1,000 trees.
GRID = [{"maxDepth": depth, "stepSize": step, "minInstancesPerNode": least} for depth in (5, 6) for step in (0.05, 0.1) for least in (10, 30)]


@query("boosted_grid")
def boosted_grid(spark, d):
    rows = X.aac_block(sized(spark, d), "key", "aac")
    rows = Sp.unique_key_split(rows.select("doc_id", "key", "y", "aac"))
    return rounded(M.leaderboard(L.boosted_grid(rows, "aac", GRID), ["config"], "r2_val"))


@query("tobit_fit", f"""WITH {B.ASSAY} SELECT count(*) AS n, count(*) FILTER (floor_row) AS n_censored, true AS few_passes, true AS stationary, true AS better
FROM assay WHERE split = 'train'""")
def tobit_fit(spark, d):
    """The censored fit by Newton's method: rows, passes (15 at most), gradient (under 1e-6) and likelihood (above that of the plain fit).

    The gradient is summed anew from the returned coefficients, in the JVM and in other units.
    """
    rows = assay_vectors(spark, d)
    fit = A.tobit_fit(rows, "x", floor=B.ASSAY_FLOOR)
    plain = A.ridge(A.moments(rows, "x", "y")[0], penalty=0.0)
    censored = C.is_floor(F.col("y"), B.ASSAY_FLOOR)
    f, x = fit.predict("x"), vector_to_array(F.col("x"))
    z = (F.lit(B.ASSAY_FLOOR) - f) / fit.sigma
    pull = F.when(censored, -F.exp(-0.5 * z * z - N.LOG_SQRT_2PI - N.log_cdf(z))).otherwise((F.col("y") - f) / fit.sigma)
    spread = F.sqrt(F.avg((F.col("y") - plain.predict("x")) ** 2))
    told = cut_lineage(rows.withColumns({"pull": pull, "a": x[0], "b": x[1], "c": censored, "nll": T.tobit_nll(f, F.col("y"), fit.sigma, B.ASSAY_FLOOR)}))
    base = rows.agg(spread.alias("s")).first()["s"]
    other = rows.agg(F.avg(T.tobit_nll(plain.predict("x"), F.col("y"), base, B.ASSAY_FLOOR)).alias("v")).first()["v"]
    slopes = [F.abs(F.avg(F.col("pull") * v)) for v in (F.col("a"), F.col("b"), F.lit(1.0))]
    scale = [F.greatest(F.stddev_pop("a"), F.lit(1e-9)), F.greatest(F.stddev_pop("b"), F.lit(1e-9)), F.lit(1.0)]
    flat = F.greatest(*[s / w for s, w in zip(slopes, scale)]) < 1e-6
    return told.agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("n_censored"), F.lit(fit.passes <= 15).alias("few_passes"), flat.alias("stationary"),
                    (F.avg("nll") < other).alias("better"))


#: Stand-in scores of three classes, the regions of the measurement; equal scores go to the smallest class.
_CLASSES = f"""{B.ASSAY}, c AS (SELECT split, CASE region WHEN 'floor' THEN 0 WHEN 'bulk' THEN 1 ELSE 2 END AS y,
  [abs(pred - 4) * -1, abs(pred - 30) * -1, abs(pred - 80) * -1] AS s FROM assay),
k AS (SELECT split, y, list_position(s, list_max(s)) - 1 AS p FROM c), a AS (SELECT split, avg(CAST(y = p AS DOUBLE)) AS accuracy FROM k GROUP BY split),
e AS (SELECT split, y AS class, 1 AS s, 0 AS p, CAST(y = p AS INTEGER) AS h FROM k UNION ALL SELECT split, p, 0, 1, 0 FROM k),
g AS (SELECT split, class, CAST(sum(s) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS n_predicted, CAST(sum(h) AS BIGINT) AS hits FROM e GROUP BY ALL)
SELECT g.split, CAST(class AS INTEGER) AS class, support, n_predicted, hits, round(hits / nullif(n_predicted, 0), 6) AS precision, round(hits / nullif(support, 0), 6) AS recall,
  round(2 * hits / (support + n_predicted), 6) AS f1, round(accuracy, 6) AS accuracy FROM g JOIN a ON a.split = g.split"""


@query("multiclass_confusion", f"WITH {_CLASSES}")
def multiclass_confusion(spark, d):
    """Largest score of three, and the per-class confusion."""
    rows = B.assay(spark, d).withColumn("class", F.when(C.is_floor(F.col("y"), B.ASSAY_FLOOR), 0).when(F.col("y") <= B.ASSAY_CUT, 1).otherwise(2))
    scores = F.array(*[-F.abs(F.col("pred") - c) for c in (4.0, 30.0, 80.0)])
    rows = rows.select("split", F.col("class").alias("y"), L.class_prediction(scores).alias("pred"))
    return rounded(M.multiclass_confusion(rows, by=["split"]))


@query("fit_multiclass")
def fit_multiclass(spark, d):
    """The language of a document from its 428 features, by multinomial regression: confusion per side of the split."""
    langs = B.table(spark, d, "documents").select("doc_id", F.array_position(F.array(F.lit("de"), F.lit("en"), F.lit("es"), F.lit("fr")), F.col("lang")).cast("int").alias("at"))
    rows = with_split(sized(spark, d).drop("label", "y").join(langs.where("at > 0"), "doc_id").withColumn("y", (F.col("at") - 1).cast("double")))
    model = L.fit_binary(rows.where("split = 'train'"), Sc.SEQ_FEATURES, "y", classes=4)
    scored = L.class_predictions(model, rows, ["y", "split"])
    return rounded(M.multiclass_confusion(scored.select(F.col("y").cast("int").alias("y"), "pred", "split"), by=["split"]))


def seed_predictions(spark, d):
    """Stand-in predictions of five seeds: the row's prediction with a seed-dependent offset."""
    rows = B.assay(spark, d).select("row_id", "grp", "y", "pred")
    rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    return rows.withColumn("pred", F.col("pred") + F.pmod(F.col("row_id") * F.col("seed"), F.lit(11)) - 5)


@query("seed_ensemble", f"""WITH {B.ASSAY}, s AS (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed),
p AS (SELECT row_id, any_value(y) AS y, avg(pred + (row_id * seed) % 11 - 5) AS pred FROM assay, s GROUP BY row_id)
SELECT count(*) AS n, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(sum((y - pred) * (y - pred)) / count(*)), 6) AS rmse FROM p""")
def seed_ensemble(spark, d):
    return rounded(M.regression_metrics(L.seed_ensemble(seed_predictions(spark, d))).select("n", "r2", "rmse"))


@query("rank_ensemble", f"""WITH {B.ASSAY}, s AS (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed),
q AS (SELECT row_id, any_value(y) AS y, avg(round((pred + (row_id * seed) % 11 - 5 - 40) / 40, 3)) AS z FROM assay, s GROUP BY row_id),
t AS (SELECT list_sort(list(y)) AS l, count(*) AS n FROM assay WHERE split = 'train'),
k AS (SELECT y, l, n, least(greatest({cdf_sql('z')}, 0.5 / n), 1 - 0.5 / n) * (n - 1) AS pos FROM q, t),
p AS (SELECT y, l[CAST(floor(pos) AS BIGINT) + 1] * (1 - (pos - floor(pos))) + l[CAST(least(floor(pos) + 1, n - 1) AS BIGINT) + 1] * (pos - floor(pos)) AS pred FROM k)
SELECT count(*) AS n, round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 6) AS r2, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse FROM p""")
def rank_ensemble(spark, d):
    """Seed predictions averaged as normal scores, mapped back through the train quantiles."""
    preds = seed_predictions(spark, d).withColumn("z", F.round((F.col("pred") - 40) / 40, 3))
    out = L.rank_ensemble(preds, B.assay(spark, d).where("split = 'train'"))
    return rounded(M.regression_metrics(out).select("n", "r2", "rmse"))


def endpoint_models(spark, d):
    """One model per endpoint: documents stand for sequence endpoints, product names for molecular ones."""
    seq = cut_lineage(sized(spark, d))
    parts = B.table(spark, d, "part").select(F.col("p_name").alias("key"), F.log10("p_retailprice").alias("y"))
    mol = cut_lineage(X.fingerprint_block(parts, "key", 2, Sc.MOL_FEATURES))
    models = {}
    for ep in R.ENDPOINTS:
        rows, col = (seq, Sc.SEQ_FEATURES) if ep.modality == R.SEQUENCE else (mol, Sc.MOL_FEATURES)
        label = "label" if ep.kind == R.BINARY else "y"
        models[ep.name] = L.fit_endpoint(rows.where(F.col(label).isNotNull()), ep, col, label, "squared")
    return models


_MASKS = f"""WITH {_SCORING_ROWS}, e AS (SELECT * FROM (VALUES ('Hemolysis', 'P(positive)', true), ('Half_life', 'seconds', true),
  ('Caco2', 'logPapp', false), ('PAMPA_MDCK', 'logPapp', false)) t(endpoint, unit, is_seq)),
v AS (SELECT row_id, endpoint, unit, coalesce(CASE WHEN is_seq THEN regexp_full_match(upper(sequence), '[{R.ALPHABET}]{{3,}}')
  ELSE trim(molecule) NOT IN ('', 'nan', 'None') END, false) AS ok FROM scoring, e)"""


@query("score_rows", f"""{_MASKS} SELECT row_id, endpoint, unit, ok, ok AS has_value, CASE WHEN NOT ok THEN 'no input' END AS reason FROM v""")
def score_rows(spark, d):
    """Every sequence row through all four endpoint models; the oracle checks routing, units and reasons."""
    out = Sc.score_rows(scoring_rows(spark, d), endpoint_models(spark, d), in_jvm=True)
    sound = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    bounded = (F.col("endpoint") != "Hemolysis") | F.col("value").between(0, 1)
    return out.select("row_id", "endpoint", "unit", "ok", (sound & bounded).alias("has_value"), "reason")


@query("score_report", f"""{_MASKS} SELECT row_id, count(*) FILTER (ok) AS n_ok,
  array_to_string(list_sort(list(endpoint)), ',') AS endpoints FROM v GROUP BY row_id""")
def score_report(spark, d):
    report = Sc.score_report(Sc.score_rows(scoring_rows(spark, d), endpoint_models(spark, d)))
    return report.select("row_id", "n_ok", F.array_join("endpoints", ",").alias("endpoints"))
