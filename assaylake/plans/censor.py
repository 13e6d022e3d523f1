"""Censoring diagnostics over the event measurements: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import censored as T, normal as N
from ..operators import censoring as Z, metrics as M
from . import bindings as B
from .catalog import query
from .census import rounded
from .scores import auc_sql, flagged

FLOOR, CUT, SIGMA = B.ASSAY_FLOOR, B.ASSAY_CUT, 25.0
BETAS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0)
FRACTIONS = (0.005, 0.01, 0.05, 0.1, 0.2, 0.5)
KS = (0, 10, 50, 100, 500, 1000)


def _poly(cs, x: str) -> str:
    out = f"{cs[0]!r}::DOUBLE"
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    """Normal CDF of a column name or short expression."""
    a = f"abs({x})"
    frac = f"({a} + 0.65)"
    for k in (4.0, 3.0, 2.0, 1.0):
        frac = f"({a} + {k} / {frac})"
    e = f"exp(-0.5 * {a} * {a})"
    up = (f"CASE WHEN {a} < {N.CDF_SPLIT} THEN {e} * {_poly(N.CDF_NUM, a)} / {_poly(N.CDF_DEN, a)} "
          f"ELSE {e} / {frac} / {N.SQRT_2PI!r} END")
    return f"(CASE WHEN {x} > 0 THEN 1 - ({up}) ELSE ({up}) END)"


def ppf_start_sql(p: str) -> str:
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    return (f"CASE WHEN {p} < {N.PPF_LOW} THEN {_poly(N.PPF_C, lo)} / {_poly(N.PPF_D, lo)} "
            f"WHEN {p} > {1 - N.PPF_LOW} THEN -{_poly(N.PPF_C, hi)} / {_poly(N.PPF_D, hi)} "
            f"ELSE {_poly(N.PPF_A, r)} * {q} / {_poly(N.PPF_B, r)} END")


@query("variance_share", f"""WITH {B.ASSAY}, g AS (SELECT split, avg(y) AS gm FROM assay GROUP BY split),
s AS (SELECT a.split, region, count(*) AS n, sum((y - gm) * (y - gm)) AS ss FROM assay a JOIN g ON g.split = a.split GROUP BY 1, 2)
SELECT split, region, n, round(ss / sum(ss) OVER (PARTITION BY split), 6) AS ss_share FROM s""")
def variance_share(spark, d):
    return rounded(Z.variance_share(B.assay(spark, d), by=["split"], floor=FLOOR, cut=CUT))


@query("oracle_ceiling", f"""WITH {B.ASSAY}, g AS (SELECT split, avg(y) AS gm, avg(y) FILTER (floor_row) AS fm FROM assay GROUP BY split),
s AS (SELECT a.split, count(*) AS n, count(*) FILTER (floor_row) AS n_floor, sum((y - gm) * (y - gm)) AS tot,
  coalesce(sum((y - fm) * (y - fm)) FILTER (floor_row), 0) AS own, coalesce(sum((y - gm) * (y - gm)) FILTER (floor_row), 0) AS shared
  FROM assay a JOIN g ON g.split = a.split GROUP BY 1)
SELECT split, n, n_floor, round(1 - own / tot, 6) AS ceiling_floor_mean, round(1 - shared / tot, 6) AS ceiling_global_mean,
  round(shared / tot, 6) AS floor_ss_share FROM s""")
def oracle_ceiling(spark, d):
    return rounded(Z.oracle_ceiling(B.assay(spark, d), by=["split"], floor=FLOOR))


@query("oracle_sweep", f"""WITH {B.ASSAY}, k AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k),
r AS (SELECT *, row_number() OVER (PARTITION BY floor_row ORDER BY row_id) - 1 AS pos FROM assay),
v AS (SELECT k, y, floor_row AND pos < k AS hit, CASE WHEN floor_row AND pos < k THEN {FLOOR}::DOUBLE ELSE pred END AS p FROM r, k)
SELECT k, count(*) FILTER (hit) AS n_set, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM v GROUP BY k""")
def oracle_sweep(spark, d):
    return rounded(Z.oracle_sweep(B.assay(spark, d), KS, floor=FLOOR))


@query("flag_sweep", f"""WITH {B.ASSAY}, f AS (SELECT unnest([{', '.join(map(str, FRACTIONS))}])::DOUBLE AS top_fraction),
q AS (SELECT top_fraction, threshold FROM (SELECT quantile_cont(p_floor, [{', '.join(repr(1.0 - x) for x in FRACTIONS)}]) AS t FROM assay) , (
  SELECT unnest([{', '.join(map(str, FRACTIONS))}])::DOUBLE AS top_fraction, unnest(range({len(FRACTIONS)})) + 1 AS i) z, LATERAL (SELECT t[i] AS threshold)),
v AS (SELECT top_fraction, threshold, y, floor_row, p_floor > threshold AS hit, CASE WHEN p_floor > threshold THEN {FLOOR}::DOUBLE ELSE pred END AS p FROM assay, q)
SELECT top_fraction, round(threshold, 6) AS threshold, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2, count(*) FILTER (hit) AS n_flagged,
  count(*) FILTER (hit AND floor_row) AS tp, count(*) FILTER (hit AND NOT floor_row) AS fp,
  round(count(*) FILTER (hit AND floor_row) / greatest(count(*) FILTER (hit), 1), 6) AS precision,
  round(count(*) FILTER (hit AND floor_row) / greatest(count(*) FILTER (floor_row), 1), 6) AS recall FROM v GROUP BY 1, 2""")
def flag_sweep(spark, d):
    return rounded(Z.flag_sweep(B.assay(spark, d), FRACTIONS, floor=FLOOR))


@query("two_stage", f"""WITH {B.ASSAY}, v AS (SELECT split, y, CASE WHEN p_floor >= 0.08 THEN {FLOOR}::DOUBLE ELSE pred END AS p FROM assay)
SELECT split, count(*) AS n, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
  round(sqrt(sum((y - p) * (y - p)) / count(*)), 6) AS rmse FROM v GROUP BY split""")
def two_stage(spark, d):
    rows = Z.two_stage(B.assay(spark, d), 0.08, floor=FLOOR)
    return rounded(M.regression_metrics(rows, pred="staged", by=["split"]).select("split", "n", "r2", "rmse"))


_BLEND = f"""WITH {B.ASSAY}, b AS (SELECT unnest([{', '.join(map(str, BETAS))}])::DOUBLE AS beta),
v AS (SELECT beta, split, y, floor_row, pred - beta * p_floor * (pred - {FLOOR}) AS p FROM assay, b WHERE split IN ('val', 'test')),
m AS (SELECT beta, split, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM v GROUP BY 1, 2),
w AS (SELECT beta, max(r2) FILTER (split = 'val') AS r2_val, max(r2) FILTER (split = 'test') AS r2_test FROM m GROUP BY beta),
pick AS (SELECT beta AS chosen_beta FROM w ORDER BY r2_val DESC, beta LIMIT 1)"""


@query("soft_blend", f"""{_BLEND} SELECT beta, round(r2_val, 6) AS r2_val, round(r2_test, 6) AS r2_test, beta = chosen_beta AS chosen FROM w, pick""")
def soft_blend(spark, d):
    return rounded(Z.soft_blend(B.assay(spark, d), BETAS, floor=FLOOR))


@query("soft_blend_regions", f"""{_BLEND}, t AS (SELECT CASE WHEN floor_row THEN 'floor' ELSE 'nonfloor' END AS part, y, p FROM v, pick
  WHERE split = 'test' AND beta = chosen_beta), a AS (SELECT part, count(*) AS n, var_pop(y) * count(*) AS tot, sum((y - p) * (y - p)) AS res, median(p) AS med FROM t GROUP BY part)
SELECT part, n, round(CASE WHEN tot > 0 THEN 1 - res / tot END, 6) AS r2, round(med, 6) AS median_pred FROM a""")
def soft_blend_regions(spark, d):
    rows = B.assay(spark, d)
    return rounded(Z.soft_blend_regions(rows, Z.soft_blend(rows, BETAS, floor=FLOOR), floor=FLOOR))


_GAUSS = f"""WITH {B.ASSAY}, c AS (SELECT y AS value, count(*) FILTER (split = 'train') AS m FROM assay GROUP BY y),
u AS (SELECT value, m, sum(m) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS upto, sum(m) OVER () AS n FROM c),
low AS (SELECT arg_min(m, value) AS lm FROM c WHERE m > 0),
p AS (SELECT value, least(greatest(greatest(upto, lm) / n, 0.5 / n), 1 - 0.5 / n) AS cdf FROM u, low),
s AS (SELECT value, cdf, {ppf_start_sql('cdf')} AS x FROM p),
st AS (SELECT value, cdf, x, ({cdf_sql('x')} - cdf) * {N.SQRT_2PI!r}::DOUBLE * exp(x * x / 2) AS h FROM s),
gauss AS (SELECT value, cdf, x - h / (1 + x * h / 2) AS z FROM st)"""


@query("rank_gaussian", f"{_GAUSS} SELECT value, round(cdf, 6) AS cdf, round(z, 6) AS z FROM gauss")
def rank_gaussian(spark, d):
    return rounded(Z.rank_gaussian(B.assay(spark, d)), skip=("value",))


@query("rank_gaussian_inverse", f"""WITH {B.ASSAY}, q AS (SELECT DISTINCT round((pred - 40) / 40, 3) AS z FROM assay),
t AS (SELECT list_sort(list(y)) AS l, count(*) AS n FROM assay WHERE split = 'train'),
k AS (SELECT z, l, n, least(greatest({cdf_sql('z')}, 0.5 / n), 1 - 0.5 / n) * (n - 1) AS pos FROM q, t)
SELECT z, round(l[CAST(floor(pos) AS BIGINT) + 1] * (1 - (pos - floor(pos))) + l[CAST(least(floor(pos) + 1, n - 1) AS BIGINT) + 1] * (pos - floor(pos)), 6) AS value FROM k""")
def rank_gaussian_inverse(spark, d):
    rows = B.assay(spark, d)
    z = rows.select(F.round((F.col("pred") - 40) / 40, 3).alias("z"))
    return rounded(Z.rank_gaussian_inverse(z, rows.where("split = 'train'")), skip=("z",))


_TAIL = f"-0.5 * x * x - {N.LOG_SQRT_2PI!r}::DOUBLE - ln(-x) + ln(1 - 1 / (x * x))"


@query("tobit_nll", f"""WITH {B.ASSAY}, a AS (SELECT split, y, pred, ({FLOOR} - pred) / {SIGMA} AS x FROM assay),
v AS (SELECT split, y > {FLOOR} + 1e-6 AS unc, CASE WHEN y > {FLOOR} + 1e-6 THEN 0.5 * ((y - pred) / {SIGMA}) * ((y - pred) / {SIGMA}) + ln({SIGMA})
  ELSE -CASE WHEN x < -6 THEN {_TAIL} ELSE ln({cdf_sql('x')}) END END AS nll FROM a)
SELECT split, unc AS uncensored, count(*) AS n, round(avg(nll), 6) AS mean_nll FROM v GROUP BY 1, 2""")
def tobit_nll(spark, d):
    rows = B.assay(spark, d).select("split", (F.col("y") > FLOOR + 1e-6).alias("uncensored"),
                                    T.tobit_nll(F.col("pred"), F.col("y"), SIGMA, FLOOR).alias("nll"))
    return rounded(rows.groupBy("split", "uncensored").agg(F.count(F.lit(1)).alias("n"), F.avg("nll").alias("mean_nll")))


@query("tobit_mean", f"""WITH {B.ASSAY}, a AS (SELECT row_id, pred, (pred - {FLOOR}) / {SIGMA} AS x, -(pred - {FLOOR}) / {SIGMA} AS m FROM assay)
SELECT row_id, round(pred * {cdf_sql('x')} + {SIGMA} * exp(-0.5 * x * x) / {N.SQRT_2PI!r}::DOUBLE + {FLOOR} * {cdf_sql('m')}, 6) AS mean FROM a""")
def tobit_mean(spark, d):
    return rounded(B.assay(spark, d).select("row_id", T.tobit_mean(F.col("pred"), SIGMA, FLOOR).alias("mean")))


_LONG = """long AS (SELECT CAST(label < 5 AS INTEGER) AS flag, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(len(embedding))) AS feature FROM embeddings)"""


@query("group_separability", f"""WITH {_LONG}, a AS ({auc_sql('long', 'feature', 'flag', 'value')}),
m AS (SELECT feature, median(value) FILTER (flag = 1) AS mf, median(value) FILTER (flag = 0) AS mo FROM long GROUP BY feature)
SELECT CAST(m.feature AS BIGINT) AS feature, round(mf, 6) AS median_floor, round(mo, 6) AS median_other, round(auc, 6) AS auc FROM m JOIN a ON a.feature = m.feature""")
def group_separability(spark, d):
    long = B.store(spark, d).select((F.col("label") < 5).cast("int").alias("flag"), F.posexplode("emb").alias("feature", "value"))
    long = long.select("flag", F.col("feature").cast("long").alias("feature"), F.col("value").cast("double").alias("value"))
    return rounded(Z.group_separability(long))
