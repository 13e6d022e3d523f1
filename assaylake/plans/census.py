"""Replicates, profiling and set operations: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import prepare as P, replicates as Rep
from . import bindings as B
from .catalog import query


def rounded(df, digits: int = 6, skip: tuple[str, ...] = ()):
    """Doubles rounded for comparison between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c)
                       for c, t in df.dtypes])


@query("replicate_mean", f"""WITH {B.MEASURES}, first AS (
  SELECT key, quantity FROM measures QUALIFY row_number() OVER (PARTITION BY key ORDER BY l_orderkey, l_linenumber, quantity, y) = 1)
SELECT m.key, round(avg(log10(m.y)), 6) AS y_mean, count(*) AS repeats, any_value(f.quantity) AS quantity
FROM measures m JOIN first f ON f.key = m.key GROUP BY m.key""")
def replicate_mean(spark, d):
    rows = B.measures(spark, d).withColumn("model_y", F.log10("y"))
    order = ["l_orderkey", "l_linenumber", "quantity", "y"]
    return rounded(Rep.replicate_mean(rows, y="model_y", order=order, features=["quantity"]), skip=("quantity",))


@query("replicate_info", f"""WITH {B.KEPT}, k AS (SELECT key, count(*) AS c FROM kept GROUP BY key)
SELECT CAST(sum(c) AS BIGINT) AS n_rows_before, count(*) AS n_rows_after, CAST(sum(c) - count(*) AS BIGINT) AS n_duplicate_keys,
       max(c) AS max_repeats FROM k""")
def replicate_info(spark, d):
    return Rep.replicate_info(Rep.replicate_mean(B.kept(spark, d)))


@query("replicate_census", f"""WITH {B.KEPT},
k AS (SELECT lang, key, count(*) AS c, coalesce(stddev_samp(y), 0) AS sd FROM kept GROUP BY 1, 2)
SELECT lang, CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (c > 1) AS n_repeated_keys,
  CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS n_repeated_rows,
  count(*) FILTER (c > 1 AND sd > 1e-9) AS n_spread_keys, round(avg(sd) FILTER (c > 1 AND sd > 1e-9), 6) AS mean_spread,
  round(max(sd) FILTER (c > 1 AND sd > 1e-9), 6) AS max_spread,
  round((SELECT stddev_samp(y) FROM kept t WHERE t.lang = k.lang), 6) AS overall_sd FROM k GROUP BY lang""")
def replicate_census(spark, d):
    return rounded(Rep.replicate_census(B.kept(spark, d), by=["lang"]))


@query("noise_ceiling", f"""WITH {B.KEPT}, ly AS (SELECT key, log10(y) AS y FROM kept WHERE y > 0),
k AS (SELECT key, count(*) AS c, coalesce(var_samp(y), 0) AS v FROM ly GROUP BY key),
a AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS n_keys, sum(c * v) / sum(c) AS e FROM k), b AS (SELECT var_samp(y) AS var_y FROM ly)
SELECT n, n_keys, round(var_y, 6) AS var_y, round(e, 6) AS noise_var, round(1 - e / var_y, 6) AS ceiling,
       1 - e / var_y >= 0.8 AS reachable FROM a, b""")
def noise_ceiling(spark, d):
    rows = B.kept(spark, d).where("y > 0").withColumn("y", F.log10("y"))
    return rounded(Rep.noise_ceiling(rows))


@query("label_ab", f"""WITH {B.ASSAY}, k AS (
  SELECT key, count(*) AS c, avg(y) AS mu, count(*) FILTER (floor_row) AS f FROM assay GROUP BY key)
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, round(sum(c) / count(*), 6) AS mean_replicates,
  CAST(sum(f) AS BIGINT) AS n_floor_rows, count(*) FILTER (f > 0) AS n_floor_keys,
  count(*) FILTER (f > 0 AND f < c) AS n_mixed_keys,
  count(*) FILTER (f > 0 AND mu > {B.ASSAY_FLOOR} + 1e-6) AS n_lifted_keys FROM k""")
def label_ab(spark, d):
    return rounded(Rep.label_ab(B.assay(spark, d), floor=B.ASSAY_FLOOR))


@query("label_stats", f"""WITH {B.PEPTIDES}
SELECT lang, count(*) AS n, count(*) - count(label) AS n_null, min(label) AS min, max(label) AS max, median(label) AS median
FROM peptides GROUP BY lang""")
def label_stats(spark, d):
    return P.label_stats(B.peptides(spark, d, labels=True), "label", ["lang"])


@query("target_stats", f"""WITH {B.MEASURES}
SELECT count(*) AS n, count(*) - count(y) AS n_null, min(y) AS min, max(y) AS max, round(median(y), 6) AS median FROM measures""")
def target_stats(spark, d):
    return rounded(P.label_stats(B.measures(spark, d)), skip=("min", "max"))


@query("label_distribution", f"""WITH {B.KEPT} SELECT label, count(*) AS n FROM kept WHERE label IN (0, 1) GROUP BY label""")
def label_distribution(spark, d):
    return P.label_distribution(B.kept(spark, d, labels=True).where("label IN (0, 1)"), "label")


@query("drop_accounting", f"""WITH {B.CLEAN}
SELECT lang, count(*) AS n_raw, count(key) AS n_valid_key, count(*) FILTER (label IN (0, 1)) AS n_label_of_all,
  count(*) FILTER (key IS NOT NULL AND label IN (0, 1)) AS n_label_of_valid,
  count(*) FILTER (key IS NOT NULL AND label IN (0, 1)) AS n_final,
  count(*) - count(*) FILTER (key IS NOT NULL AND label IN (0, 1)) AS n_dropped
FROM cleaned GROUP BY lang""")
def drop_accounting(spark, d):
    flagged = P.flag_rows(B.peptides(spark, d, labels=True), R.BINARY, R.SEQUENCE, label="label")
    return P.drop_accounting(flagged, ["lang"])


@query("target_profile", f"""WITH {B.ASSAY}
SELECT grp, count(*) AS n, count(*) - count(y) AS n_missing, min(y) AS min, max(y) AS max, round(stddev_samp(y), 6) AS sd,
       round(skewness(y), 6) AS skew, count(DISTINCT y) AS n_distinct FROM assay GROUP BY grp""")
def target_profile(spark, d):
    return rounded(Rep.target_profile(B.assay(spark, d), by=["grp"]), skip=("min", "max"))


@query("dataset_overlap", f"""WITH {B.SETS}, a AS (SELECT DISTINCT key FROM set_a), b AS (SELECT DISTINCT key FROM set_b),
i AS (SELECT key FROM a INTERSECT SELECT key FROM b)
SELECT na AS n_a, nb AS n_b, ni AS n_both, round(ni / na, 6) AS share_of_a, round(ni / nb, 6) AS share_of_b, nb - ni AS n_b_only
FROM (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM i) AS ni)""")
def dataset_overlap(spark, d):
    return rounded(Rep.dataset_overlap(*B.order_sets(spark, d, *B.TWO_SETS)))


@query("label_agreement", f"""WITH {B.SETS}, a AS (SELECT key, avg(y) AS y FROM set_a GROUP BY key),
b AS (SELECT key, avg(y) AS y FROM set_b GROUP BY key), j AS (SELECT abs(a.y - b.y) AS d FROM a JOIN b USING (key))
SELECT count(*) AS n_shared, round(max(d), 4) AS max_diff, count(*) FILTER (d < 1e-4) AS n_equal, round(median(d), 4) AS median_diff FROM j""")
def label_agreement(spark, d):
    return rounded(Rep.label_agreement(*B.order_sets(spark, d, *B.TWO_SETS)), 4)


@query("floor_census", f"""WITH {B.ASSAY}
SELECT grp, split, count(*) AS n, count(*) FILTER (floor_row) AS n_floor,
       round(avg(CAST(floor_row AS DOUBLE)), 6) AS floor_share FROM assay GROUP BY 1, 2""")
def floor_census(spark, d):
    return rounded(Rep.floor_census(B.assay(spark, d), by=["grp", "split"], floor=B.ASSAY_FLOOR))
