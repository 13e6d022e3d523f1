"""Metric operators over the event measurements: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..functions import clean as C
from ..operators import metrics as M
from ..operators.joins import each_of
from ..operators.rank import global_rank
from . import bindings as B
from .catalog import query
from .census import rounded

FLOOR, CUT = B.ASSAY_FLOOR, B.ASSAY_CUT
THRESHOLDS = (0.01, 0.02, 0.05, 0.1)
SEEDS = (42, 123, 456)


def flagged(spark, d):
    """Measurements with the floor flag as a binary target and the stand-in floor probability as score."""
    return B.assay(spark, d).withColumn("flag", C.is_floor(F.col("y"), FLOOR).cast("int"))


_FLAG = f"WITH {B.ASSAY}, fl AS (SELECT *, CAST(floor_row AS INTEGER) AS flag FROM assay)"


@query("global_rank", f"""WITH {B.MEASURES}, c AS (SELECT y, count(*) AS n FROM measures GROUP BY y),
r AS (SELECT y, n, CAST(coalesce(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before FROM c)
SELECT y, n, n_before, n_before + 1 AS min_rank, n_before + (n + 1) / 2.0::DOUBLE AS avg_rank FROM r""")
def whole_rank(spark, d):
    return global_rank(B.measures(spark, d), "y").select("y", "n", "n_before", "min_rank", "avg_rank")


@query("global_rank_grouped", f"""WITH {B.ASSAY}, c AS (SELECT grp, y, count(*) AS n FROM assay GROUP BY 1, 2)
SELECT grp, y, n, CAST(coalesce(sum(n) OVER (PARTITION BY grp ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before,
  CAST(sum(n) OVER (PARTITION BY grp) AS BIGINT) AS n_total FROM c""")
def grouped_rank(spark, d):
    return global_rank(B.assay(spark, d), "y", ["grp"]).select("grp", "y", "n", "n_before", "n_total")


def auc_sql(source: str, keys: str, y: str, score: str) -> str:
    """CTE body: tie-aware AUC by average ranks."""
    return f"""SELECT {keys}, (sum(r) FILTER (t = 1) - np * (np + 1) / 2.0) / nullif(CAST(np AS DOUBLE) * (nn - np), 0) AS auc
FROM (SELECT {keys}, {y} AS t, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2.0::DOUBLE AS r,
  sum({y}) OVER (PARTITION BY {keys}) AS np, count(*) OVER (PARTITION BY {keys}) AS nn FROM {source}) GROUP BY {keys}, np, nn"""


@query("binary_metrics", f"""{_FLAG}, a AS ({auc_sql('fl', 'split', 'flag', 'p_floor')}),
m AS (SELECT split, count(*) AS n, CAST(count(*) FILTER (flag = 1 AND p_floor >= 0.05) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (flag = 0 AND p_floor >= 0.05) AS DOUBLE) AS fp, CAST(count(*) FILTER (flag = 1 AND p_floor < 0.05) AS DOUBLE) AS fn,
  CAST(count(*) FILTER (flag = 0 AND p_floor < 0.05) AS DOUBLE) AS tn FROM fl GROUP BY split)
SELECT m.split, n, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
  round((tp + tn) / n, 6) AS accuracy, round((tp + fn) / n, 6) AS pos_rate, round(auc, 6) AS auc FROM m JOIN a ON a.split = m.split""")
def binary_metrics(spark, d):
    return rounded(M.binary_metrics(flagged(spark, d), "flag", "p_floor", ["split"], 0.05))


_REG = """count(*) AS n, round(1 - sum((y - {p}) * (y - {p})) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(sum((y - {p}) * (y - {p})) / count(*)), 6) AS rmse, round(avg(abs(y - {p})), 6) AS mae, min(y) AS y_min, max(y) AS y_max,
  round(min({p}), 6) AS pred_min, round(max({p}), 6) AS pred_max"""
REG = _REG.replace("{p}", "pred")
_KEEP = ("y_min", "y_max")


@query("regression_metrics", f"WITH {B.ASSAY} SELECT grp, split, {REG} FROM assay GROUP BY 1, 2")
def regression_metrics(spark, d):
    return rounded(M.regression_metrics(B.assay(spark, d), by=["grp", "split"]), skip=_KEEP)


def _rho(source: str, keys: str) -> str:
    return f"""SELECT {keys}, corr(ry, rp) AS rho FROM (SELECT {keys},
  rank() OVER (PARTITION BY {keys} ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2.0::DOUBLE AS ry,
  rank() OVER (PARTITION BY {keys} ORDER BY pred) + (count(*) OVER (PARTITION BY {keys}, pred) - 1) / 2.0::DOUBLE AS rp
  FROM {source}) GROUP BY {keys}"""


@query("spearman", f"WITH {B.ASSAY}, r AS ({_rho('assay', 'split')}) SELECT split, round(rho, 6) AS spearman FROM r")
def spearman(spark, d):
    return rounded(M.spearman(B.assay(spark, d), by=["split"]))


@query("region_metrics", f"""WITH {B.ASSAY}, m AS (SELECT split, region, count(*) AS n, var_pop(y) * count(*) AS tot,
  sum((y - pred) * (y - pred)) AS res, avg(abs(y - pred)) AS mae, min(pred) AS lo, max(pred) AS hi FROM assay GROUP BY 1, 2)
SELECT split, region, n, round(CASE WHEN tot > 0 THEN 1 - res / tot END, 6) AS r2, round(mae, 6) AS mae,
  round(lo, 6) AS pred_min, round(hi, 6) AS pred_max FROM m""")
def region_metrics(spark, d):
    out = M.region_metrics(B.assay(spark, d), by=["split"], floor=FLOOR, cut=CUT)
    return rounded(out.select("split", "region", "n", "r2", "mae", "pred_min", "pred_max"))


@query("nonfloor_metrics", f"""WITH {B.ASSAY}, u AS (SELECT *, 'all' AS part FROM assay UNION ALL SELECT *, 'nonfloor' FROM assay WHERE NOT floor_row),
r AS ({_rho('u', 'split, part')}), m AS (SELECT split, part, count(*) AS n, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2,
  sqrt(sum((y - pred) * (y - pred)) / count(*)) AS rmse, avg(abs(y - pred)) AS mae FROM u GROUP BY 1, 2)
SELECT m.split, m.part, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(rho, 6) AS spearman
FROM m JOIN r ON r.split = m.split AND r.part = m.part""")
def nonfloor_metrics(spark, d):
    return rounded(M.nonfloor_metrics(B.assay(spark, d), by=["split"], floor=FLOOR))


_CURVE = f"""{_FLAG}, d AS (SELECT split, p_floor, count(*) AS n, sum(flag) AS pos FROM fl GROUP BY 1, 2),
w AS (SELECT split, p_floor, sum(n) OVER q AS flagged, sum(pos) OVER q AS tp, sum(pos) OVER (PARTITION BY split) AS np FROM d
  WINDOW q AS (PARTITION BY split ORDER BY p_floor DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT split, p_floor AS threshold, tp / flagged AS p, tp / np AS r,
  2.0::DOUBLE * (tp / flagged) * (tp / np) / greatest(tp / flagged + tp / np, 1e-12) AS f1 FROM w)"""


@query("pr_curve", f"""{_CURVE} SELECT split, round(threshold, 9) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall,
  round(f1, 6) AS f1 FROM curve""")
def pr_curve(spark, d):
    out = M.pr_curve(flagged(spark, d), "flag", "p_floor", ["split"])
    return rounded(out.withColumn("threshold", F.round("threshold", 9)), skip=("threshold",))


@query("best_threshold", f"""{_CURVE} SELECT split, round(threshold, 9) AS threshold, round(f1, 6) AS f1 FROM curve
QUALIFY row_number() OVER (PARTITION BY split ORDER BY f1 DESC, threshold) = 1""")
def best_threshold(spark, d):
    out = M.best_threshold(M.pr_curve(flagged(spark, d), "flag", "p_floor", ["split"]), ["split"])
    return out.select("split", F.round("threshold", 9).alias("threshold"), F.round("f1", 6).alias("f1"))


@query("confusion_at", f"""{_FLAG}, th AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])::DOUBLE AS threshold),
c AS (SELECT split, threshold, count(*) FILTER (flag = 1 AND p_floor > threshold) AS tp, count(*) FILTER (flag = 0 AND p_floor > threshold) AS fp,
  count(*) FILTER (flag = 1 AND p_floor <= threshold) AS fn, count(*) FILTER (flag = 0 AND p_floor <= threshold) AS tn FROM fl, th GROUP BY 1, 2)
SELECT *, tp + fp AS n_flagged, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall,
  round(tn / greatest(tn + fp, 1), 6) AS specificity FROM c""")
def confusion_at(spark, d):
    return rounded(M.confusion_at(flagged(spark, d), THRESHOLDS, "flag", "p_floor", ["split"]))


@query("calibration_bins", f"""{_FLAG}, q AS (SELECT split, quantile_cont(p_floor, [0.2, 0.4, 0.6, 0.8]) AS e FROM fl GROUP BY split),
b AS (SELECT fl.split, flag, p_floor, len(list_filter(e, lambda x: x < p_floor)) AS bin FROM fl JOIN q ON q.split = fl.split)
SELECT split, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(flag), 6) AS observed, round(avg(p_floor), 6) AS mean_score FROM b GROUP BY 1, 2""")
def calibration_bins(spark, d):
    return rounded(M.calibration_bins(flagged(spark, d), 5, "flag", "p_floor", ["split"]))


@query("rank_positions", f"""{_FLAG}, r AS (SELECT split, flag, rank() OVER (PARTITION BY split ORDER BY pred) - 1 AS pos,
  sum(flag) OVER (PARTITION BY split) AS k FROM fl)
SELECT split, CAST(any_value(k) AS BIGINT) AS k, round(avg(pos), 6) AS mean_position, count(*) FILTER (pos < k) AS in_bottom_1k,
  count(*) FILTER (pos < 2 * k) AS in_bottom_2k, count(*) FILTER (pos < 3 * k) AS in_bottom_3k, round(median(pos), 6) AS median_position
FROM r WHERE flag = 1 GROUP BY split""")
def rank_positions(spark, d):
    return rounded(M.rank_positions(flagged(spark, d), "flag", by=["split"]))


def per_seed(spark, d):
    """R2 per group and seed on the keys a seed puts into test: one pass over rows x seeds."""
    rows = each_of(B.assay(spark, d), "seed", SEEDS)
    digit = F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("key").cast("string"))), 1, 1)
    return M.regression_metrics(rows.where(digit >= "d"), by=["grp", "seed"]).select("grp", "seed", "n", "r2", "rmse")


_SEEDS = f"""WITH {B.ASSAY}, s AS (SELECT unnest([{', '.join(map(str, SEEDS))}]) AS seed),
per AS (SELECT grp, seed, count(*) AS n, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM assay, s
  WHERE substr(md5(CAST(seed AS VARCHAR) || '|' || CAST(key AS VARCHAR)), 1, 1) >= 'd' GROUP BY 1, 2)"""


@query("seed_summary", f"""{_SEEDS}, u AS (SELECT grp, 0 AS ddof, count(r2) AS n_seeds, avg(r2) AS mean, stddev_pop(r2) AS sd, min(r2) AS lo, max(r2) AS hi FROM per GROUP BY grp
  UNION ALL SELECT grp, 1, count(r2), avg(r2), stddev_samp(r2), min(r2), max(r2) FROM per GROUP BY grp)
SELECT grp, ddof, n_seeds, round(mean, 6) AS mean, round(sd, 6) AS sd, round(lo, 6) AS min, round(hi, 6) AS max FROM u""")
def seed_summary(spark, d):
    per = per_seed(spark, d)
    parts = [M.seed_summary(per, ["grp"], "r2", k).withColumn("ddof", F.lit(k)) for k in (0, 1)]
    return rounded(parts[0].unionByName(parts[1]))


@query("leaderboard", f"""{_SEEDS} SELECT grp, seed, n, round(r2, 6) AS r2, round(r2 - 0.9, 6) AS delta FROM per ORDER BY per.r2 DESC, grp, seed LIMIT 5""")
def leaderboard(spark, d):
    return rounded(M.leaderboard(per_seed(spark, d).drop("rmse"), ["grp", "seed"], "r2", 0.9, 5))


_ENDPOINT = {"click": "Hemolysis", "error": "Hemolysis", "view": "Half_life", "purchase": "Caco2", "signup": "PAMPA_MDCK"}
_MAP = ", ".join(f"('{e}', '{g}')" for g, e in _ENDPOINT.items())
_INFO = ", ".join(f"('{e.name}', '{e.kind}', '{e.modality}', {e.input_dim})" for e in R.ENDPOINTS)


@query("endpoint_summary", f"""{_FLAG}, map AS (SELECT * FROM (VALUES {_MAP}) t(endpoint, grp)),
info AS (SELECT * FROM (VALUES {_INFO}) t(endpoint, kind, modality, input_dim)),
te AS (SELECT endpoint, fl.* FROM fl JOIN map ON map.grp = fl.grp WHERE split = 'test'), a AS ({auc_sql('te', 'endpoint', 'flag', 'p_floor')}),
m AS (SELECT endpoint, count(*) AS n, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM te GROUP BY 1)
SELECT i.endpoint, kind, modality, CAST(input_dim AS INTEGER) AS input_dim, n, CASE WHEN kind = 'binary' THEN 'AUC' ELSE 'R2' END AS primary_metric_name,
  round(CASE WHEN kind = 'binary' THEN auc ELSE r2 END, 6) AS primary_metric FROM info i JOIN m ON m.endpoint = i.endpoint JOIN a ON a.endpoint = i.endpoint""")
def endpoint_summary(spark, d):
    """The event types of the test split stand for endpoints."""
    name = F.create_map(*[F.lit(x) for pair in _ENDPOINT.items() for x in pair])
    rows = flagged(spark, d).where("split = 'test'").withColumn("endpoint", name[F.col("grp")]).where("endpoint IS NOT NULL")
    return rounded(M.endpoint_summary(R.endpoints_frame(spark), M.binary_metrics(rows, "flag", "p_floor", ["endpoint"]),
                                      M.regression_metrics(rows, by=["endpoint"])))


@query("floor_rank_auc", f"{_FLAG}, a AS ({auc_sql('fl', 'split', 'flag', 'score')}) SELECT split, round(auc, 6) AS auc FROM a")
def floor_rank_auc(spark, d):
    return rounded(M.auc(flagged(spark, d), "flag", "score", ["split"]))
