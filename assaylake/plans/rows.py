"""Sources, cleaning, row features, embedding joins: queries and oracles."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from .. import registry as R
from ..functions import clean as C, molecule as M, sequence as S
from ..operators import features as X, prepare as P
from ..session import ensure_checkpoint_dir
from ..sources import io
from . import bindings as B
from .catalog import query

_ONE = "CAST(1 AS BIGINT)"


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_PRICE = R.Endpoint("Price", R.REGRESSION, R.MOLECULAR, "p_name", "p_retailprice", R.IDENTITY, "price")


@query("read_endpoint", "SELECT p_partkey AS row_id, p_name AS key, p_retailprice AS y FROM part")
def read_endpoint(spark, d):
    return io.read_endpoint(spark, _PRICE, f"{d}/part.parquet", "parquet", row_id=F.col("p_partkey"))


def _prepared(spark, d):
    rows = B.peptides(spark, d, labels=True)
    parts = [P.prepare(rows, R.endpoint("Hemolysis"), label="label"), P.prepare(rows, R.endpoint("Half_life")),
             P.prepare(B.molecules(spark, d).withColumnRenamed("key", "raw_key"), R.endpoint("Caco2"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_OPEN_CLOSE = """list_reduce(list_prepend(0, list_transform(regexp_extract_all(trim({s}), '[\\{o}\\{c}]'),
  lambda m: CASE WHEN m = '{o}' THEN 1 ELSE -1 END)), lambda a, b: CASE WHEN a < 0 THEN a ELSE a + b END) = 0"""
_VALID_MOLECULE = ("(trim({s}) NOT IN ('', 'nan', 'None') AND regexp_full_match(trim({s}), "
                   "'[A-Za-z0-9@+\\-\\[\\]()=#$:/\\\\.%*~]+') AND "
                   + _OPEN_CLOSE.replace("{o}", "(").replace("{c}", ")") + " AND "
                   + _OPEN_CLOSE.replace("{o}", "[").replace("{c}", "]") + ")")
_VALID_KEY = _VALID_MOLECULE.replace("{s}", "key")

_PREPARED = f"""{B.KEPT}, {B.MOLECULES}, prepared AS (
  SELECT 'Hemolysis' AS endpoint, 'binary' AS kind, 'sequence' AS modality, key, label AS y
  FROM kept WHERE label IN (0, 1)
  UNION ALL SELECT 'Half_life', 'regression', 'sequence', key, y FROM kept WHERE y IS NOT NULL
  UNION ALL SELECT 'Caco2', 'regression', 'molecular', trim(key), y FROM molecules
  WHERE {_VALID_KEY} AND y IS NOT NULL)"""


@query("prepare", f"""WITH {_PREPARED}
SELECT endpoint, kind, modality, count(*) AS n, count(DISTINCT key) AS n_keys,
       CAST(sum(length(key)) AS BIGINT) AS letters, round(avg(y), 6) AS mean_y FROM prepared GROUP BY 1, 2, 3""")
def prepare(spark, d):
    return _summary(_prepared(spark, d))


def _summary(df):
    return df.groupBy("endpoint", "kind", "modality").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("n_keys"),
        F.sum(F.length("key")).alias("letters"), F.round(F.avg("y"), 6).alias("mean_y"))


@query("write_prepared", f"""WITH {_PREPARED}
SELECT endpoint, kind, modality, count(*) AS n, count(DISTINCT key) AS n_keys,
       CAST(sum(length(key)) AS BIGINT) AS letters, round(avg(y), 6) AS mean_y FROM prepared GROUP BY 1, 2, 3""")
def write_prepared(spark, d):
    path = _folder(spark, "prepared")
    io.write_prepared(_prepared(spark, d), path)
    return _summary(io.read_prepared(spark, path))


_ACCOUNT = """count(*) AS n_raw, count(*) FILTER (key IS NOT NULL) AS n_valid_key,
  count(*) FILTER (label IN (0, 1)) AS n_label_of_all,
  count(*) FILTER (key IS NOT NULL AND label IN (0, 1)) AS n_label_of_valid,
  count(*) FILTER (key IS NOT NULL AND label IN (0, 1)) AS n_final,
  count(*) - count(*) FILTER (key IS NOT NULL AND label IN (0, 1)) AS n_dropped"""


@query("write_report", f"""WITH {B.CLEAN}, acc AS (SELECT lang, {_ACCOUNT} FROM cleaned GROUP BY lang)
SELECT lang, CAST(to_json({{n_raw: n_raw, n_valid_key: n_valid_key, n_label_of_all: n_label_of_all,
  n_label_of_valid: n_label_of_valid, n_final: n_final, n_dropped: n_dropped}}) AS VARCHAR) AS report FROM acc""")
def write_report(spark, d):
    path = _folder(spark, "report")
    flagged = P.flag_rows(B.peptides(spark, d, labels=True), R.BINARY, R.SEQUENCE, label="label")
    io.write_report(io.report_json(P.drop_accounting(flagged, ["lang"]), ["lang"]), path)
    return spark.read.schema("lang string, report string").json(path)


@query("read_key_list", "SELECT trim(url) AS key FROM pages WHERE length(trim(url)) > 0")
def read_key_list(spark, d):
    path = _folder(spark, "keys")
    B.table(spark, d, "pages").select(F.concat(F.lit("  "), "url", F.lit(" "))).write.text(path)
    return io.read_key_list(spark, path)


@query("embedding_store", """SELECT vec_id AS key, 'base' AS model, CAST(len(embedding) AS INTEGER) AS dim,
  round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(CAST(embedding[64] AS DOUBLE), 6) AS last FROM embeddings""")
def embedding_store(spark, d):
    path = _folder(spark, "store")
    io.write_store(B.store(spark, d), path)
    df = io.read_store(spark, path, 64, "base")
    return df.select("key", "model", F.size("emb").alias("dim"),
                     F.round(F.element_at("emb", 1).cast("double"), 6).alias("first"),
                     F.round(F.element_at("emb", -1).cast("double"), 6).alias("last"))


@query("external_union", f"""WITH {B.sets_sql(*B.THREE_SETS)}, u AS (
  SELECT *, 'own' AS origin FROM set_a UNION ALL SELECT *, 'train' FROM set_b UNION ALL SELECT *, 'val' FROM set_c)
SELECT origin, key, count(*) AS n, CAST(sum(CAST(round(y * 100) AS BIGINT)) AS BIGINT) AS cents FROM u GROUP BY 1, 2""")
def external_union(spark, d):
    """All orders; prices are summed in whole cents, so the sums do not depend on the order of rows."""
    own, train, val = B.order_sets(spark, d, *B.THREE_SETS)
    out = io.external_union(own, {"train": train, "val": val}, ["key", "y"])
    return out.groupBy("origin", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("y") * 100).cast("long")).alias("cents"))


@query("clean_sequence", f"WITH {B.CLEAN} SELECT row_id, lang, key FROM cleaned")
def clean_sequence(spark, d):
    return B.cleaned(spark, d).select("row_id", "lang", "key")


@query("valid_label", f"""WITH {B.PEPTIDES}
SELECT lang, count(*) AS n, count(*) FILTER (label IN (0, 1)) AS n_binary, count(y) AS n_regression
FROM peptides GROUP BY lang""")
def valid_label(spark, d):
    df = B.peptides(spark, d, labels=True)
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C.valid_label(F.col("label"), R.BINARY)).alias("n_binary"),
        F.count_if(C.valid_label(F.col("y"), R.REGRESSION)).alias("n_regression"))


@query("valid_molecule_string", f"WITH {B.MOLECULES} SELECT src, row_id, {_VALID_KEY} AS ok FROM molecules")
def valid_molecule_string(spark, d):
    return B.molecules(spark, d).select("src", "row_id", C.valid_molecule(F.col("key")).alias("ok"))


@query("infer_valid_mask", f"""WITH {B.PEPTIDES}
SELECT row_id, regexp_full_match(upper(raw_key), '[{R.ALPHABET}]{{3,}}') AS ok FROM peptides""")
def infer_valid_mask(spark, d):
    return B.peptides(spark, d).select("row_id", C.scoring_mask(F.col("raw_key")).alias("ok"))


@query("target_transform", f"""WITH {B.ASSAY}, t AS (SELECT row_id, y, p, r FROM (
  SELECT row_id, y, CASE WHEN grp = 'purchase' THEN log10(y) ELSE y END AS p,
         CASE WHEN grp = 'purchase' THEN pow(10.0, log10(y)) ELSE y END AS r FROM assay))
SELECT row_id, round(p, 6) AS model_y, round(r, 6) AS human_y FROM t""")
def target_transform(spark, d):
    kind = F.when(F.col("grp") == "purchase", R.LOG10).otherwise(R.IDENTITY)
    p = C.to_model_space(F.col("y"), kind)
    return B.assay(spark, d).select("row_id", F.round(p, 6).alias("model_y"),
                                    F.round(C.to_human_units(p, kind), 6).alias("human_y"))


_SCORING_ROWS = f"""{B.PEPTIDES}, scoring AS (
  SELECT p.row_id, nullif(p.raw_key, '') AS sequence, g.url AS molecule
  FROM peptides p LEFT JOIN pages g ON g.page_id = p.doc_id)"""
_EPS = """eps AS (SELECT * FROM (VALUES ('Hemolysis', 'sequence'), ('Half_life', 'sequence'), ('Caco2', 'molecular'),
  ('PAMPA_MDCK', 'molecular')) t(endpoint, modality))"""


def scoring_rows(spark, d):
    """Sequence rows; documents with a page of the same number also bring its address as molecule string."""
    pages = B.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("molecule"))
    rows = B.peptides(spark, d).withColumn("sequence", F.expr("nullif(raw_key, '')"))
    return rows.join(pages, "doc_id", "left").select("row_id", "sequence", "molecule")


@query("route_endpoints", f"""WITH {_SCORING_ROWS}, {_EPS}
SELECT s.row_id, e.endpoint, CASE WHEN e.modality = 'sequence' THEN sequence IS NOT NULL ELSE molecule IS NOT NULL END AS has_input
FROM scoring s JOIN eps e ON (e.modality = 'sequence' AND sequence IS NOT NULL)
  OR (e.modality = 'molecular' AND molecule IS NOT NULL) OR (sequence IS NULL AND molecule IS NULL)""")
def route_endpoints(spark, d):
    return P.route_endpoints(scoring_rows(spark, d)).select("row_id", "endpoint", "has_input")


@query("floor_flag", f"WITH {B.ASSAY} SELECT row_id, floor_row AS is_floor, region FROM assay")
def floor_flag(spark, d):
    return B.assay(spark, d).select("row_id", C.is_floor(F.col("y"), B.ASSAY_FLOOR).alias("is_floor"),
                                    C.region(F.col("y"), B.ASSAY_FLOOR, B.ASSAY_CUT).alias("region"))


_LETTERS = "letters AS (SELECT unnest(string_split('" + R.ALPHABET + "', '')) AS letter, unnest(range(20)) AS idx)"


@query("aac", f"""WITH {B.SEGMENTS}, {_LETTERS}
SELECT lang, idx, count(*) AS n, round(avg((length(key) - length(replace(key, letter, ''))) / length(key)), 6) AS mean_share,
  round(max((length(key) - length(replace(key, letter, ''))) / length(key)), 6) AS max_share
FROM segments CROSS JOIN letters GROUP BY 1, 2""")
def aac(spark, d):
    rows = B.segments(spark, d).select("lang", F.posexplode(S.aac(F.col("key"))).alias("idx", "share"))
    return rows.groupBy("lang", F.col("idx").cast("long").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("share"), 6).alias("mean_share"),
        F.round(F.max("share"), 6).alias("max_share"))


_DI = f"""pairs AS (SELECT row_id, lang, length(key) - 1 AS m,
    20 * (strpos('{R.ALPHABET}', substr(key, i, 1)) - 1) + strpos('{R.ALPHABET}', substr(key, i + 1, 1)) - 1 AS idx
  FROM (SELECT row_id, lang, key, unnest(range(1, length(key))) AS i FROM segments)),
di AS (SELECT row_id, lang, idx, count(*) / any_value(m) AS share FROM pairs GROUP BY 1, 2, 3)"""


@query("dpc", f"""WITH {B.SEGMENTS}, {_DI}
SELECT lang, CAST(idx AS BIGINT) AS idx, count(*) AS n_rows, round(avg(share), 6) AS mean_share,
       round(max(share), 6) AS max_share FROM di GROUP BY 1, 2""")
def dpc(spark, d):
    rows = B.segments(spark, d).select("lang", F.explode(S.dpc_entries(F.col("key"))).alias("e"))
    return rows.groupBy("lang", F.col("e.idx").cast("long").alias("idx")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("e.share"), 6).alias("mean_share"),
        F.round(F.max("e.share"), 6).alias("max_share"))


def _case(weights: dict[str, float]) -> str:
    arms = " ".join(f"WHEN '{a}' THEN {round(10 * w)}" for a, w in weights.items())
    return f"CASE c {arms} ELSE 0 END"


_PHYS = f"""res AS (SELECT row_id, lang, key, unnest(string_split(key, '')) AS c FROM segments),
val AS (SELECT *, {_case(S.HYDROPATHY)} AS h, {_case(S.CHARGE)} AS q FROM res),
phys AS (SELECT row_id, any_value(lang) AS lang, any_value(key) AS key, 110.0 * count(*) AS mw,
  sum(h) / 10.0::DOUBLE / count(*) AS hydro_mean, max(h) / 10.0 - min(h) / 10.0 AS hydro_range,
  sum(q) / 10.0::DOUBLE AS net_charge,
  7.0 + 2.0 * (count(*) FILTER (c IN ('R', 'K')) - count(*) FILTER (c IN ('D', 'E'))) / count(*) AS pi_est,
  sum(h) / 10.0::DOUBLE / count(*) AS gravy, count(*) FILTER (h > 0) / count(*) AS hydrophobic_share,
  count(*) FILTER (c IN ('R', 'K', 'H', 'D', 'E')) / count(*) AS charged_share FROM val GROUP BY row_id)"""
_PHYS_COLS = ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" for c in S.PHYSCHEM)


@query("physchem8", f"WITH {B.SEGMENTS}, {_PHYS} SELECT row_id, {_PHYS_COLS} FROM phys")
def physchem8(spark, d):
    cols = S.physchem(F.col("key"))
    return B.segments(spark, d).select("row_id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


@query("physchem_profile", f"""WITH {B.SEGMENTS}, {_PHYS}
SELECT lang, count(*) AS n, {", ".join(f"round(avg(CAST({c} AS DOUBLE)), 6) AS {c}" for c in S.PHYSCHEM)}
FROM phys GROUP BY lang""")
def physchem_profile(spark, d):
    cols = S.physchem(F.col("key"))
    rows = B.segments(spark, d).select("lang", *[c.alias(n) for n, c in cols.items()])
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(n), 6).alias(n) for n in S.PHYSCHEM])


@query("sequence_vector", f"""WITH {B.SEGMENTS}, {_PHYS}, {_LETTERS}, {_DI},
long AS (SELECT lang, CAST(idx AS BIGINT) AS idx, share AS value FROM (
    SELECT lang, idx, (length(key) - length(replace(key, letter, ''))) / length(key) AS share FROM segments CROSS JOIN letters)
  UNION ALL SELECT lang, 20 + idx, share FROM di
  {" ".join(f"UNION ALL SELECT lang, {420 + i}, CAST({c} AS DOUBLE) FROM phys" for i, c in enumerate(S.PHYSCHEM))})
SELECT lang, idx, count(*) AS n_nonzero, round(avg(value), 6) AS mean_value FROM long WHERE value <> 0 GROUP BY 1, 2""")
def sequence_vector(spark, d):
    rows = X.sequence_vector(B.segments(spark, d).select("lang", "key"))
    long = rows.select("lang", F.posexplode(vector_to_array("features")).alias("idx", "value"))
    return long.where(F.col("value") != 0).groupBy("lang", F.col("idx").cast("long").alias("idx")).agg(
        F.count(F.lit(1)).alias("n_nonzero"), F.round(F.avg("value"), 6).alias("mean_value"))


_KMER3 = """km AS (SELECT row_id, kmer, count(*) AS n FROM (
  SELECT row_id, substr(key, i, 3) AS kmer FROM (SELECT row_id, key, unnest(range(1, length(key) - 1)) AS i FROM segments))
  GROUP BY 1, 2)"""


@query("kmer_counts", f"""WITH {B.SEGMENTS}, {_KMER3}
SELECT kmer, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_total, CAST(max(n) AS BIGINT) AS max_n FROM km GROUP BY kmer""")
def kmer_counts(spark, d):
    rows = B.segments(spark, d).select(F.explode(S.kmer_counts(F.col("key"))).alias("e"))
    return rows.groupBy(F.col("e.token").alias("kmer")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("e.n").alias("n_total"), F.max("e.n").cast("long").alias("max_n"))


@query("kmer_signature", f"""WITH {B.SEGMENTS}
SELECT row_id, sha256(array_to_string(list_sort([key[i:i+2] for i in range(1, length(key) - 1)]), ',')) AS signature
FROM segments WHERE length(key) >= 3""")
def kmer_signature(spark, d):
    return B.segments(spark, d, 3).select("row_id", S.kmer_signature(F.col("key")).alias("signature"))


_TOK = r"\[[^\]]*\]|Br|Cl|%[0-9][0-9]|."
_FP = f"""toks AS (SELECT src, row_id, regexp_extract_all(key, '{_TOK}') AS t FROM molecules),
grams AS (SELECT src, row_id, unnest(list_concat(t,
    [t[i] || ' ' || t[i+1] for i in range(1, len(t))],
    [t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, len(t) - 1)])) AS g FROM toks),
bits AS (SELECT DISTINCT src, row_id, CAST(CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 2048 AS INTEGER) AS bit FROM grams)"""


@query("hashed_fingerprint", f"WITH {B.MOLECULES}, {_FP} SELECT src, row_id, bit FROM bits")
def hashed_fingerprint(spark, d):
    return B.molecules(spark, d).select("src", "row_id", F.explode(M.fingerprint_bits(F.col("key"), 2)).alias("bit"))


_STATES = """states AS (SELECT vec_id // 8 AS key, vec_id % 8 AS pos, embedding AS state,
  CAST(embedding[1] > 0 AS INTEGER) AS mask FROM embeddings)"""


def states(spark, d):
    """Embeddings read as token states: eight positions per key, masked where the first value is not positive."""
    return B.table(spark, d, "embeddings").select(
        F.expr("vec_id div 8").alias("key"), (F.col("vec_id") % 8).alias("pos"), F.col("embedding").alias("state"),
        (F.element_at("embedding", 1) > 0).cast("int").alias("mask"))


@query("masked_mean_pool", f"""WITH {_STATES}, long AS (
  SELECT key, mask, unnest(state) AS v, unnest(range(len(state))) AS dim FROM states)
SELECT key, CAST(dim AS BIGINT) AS dim, round(sum(CAST(v AS DOUBLE) * mask) / greatest(sum(mask), 1), 6) AS value
FROM long GROUP BY 1, 2""")
def masked_mean_pool(spark, d):
    pooled = X.masked_mean_pool(states(spark, d))
    long = pooled.select("key", F.posexplode("emb").alias("dim", "value"))
    return long.select("key", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("cls_pool", f"""WITH {_STATES}, long AS (
  SELECT key, unnest(state) AS v, unnest(range(len(state))) AS dim FROM states WHERE pos = 0)
SELECT key, CAST(dim AS BIGINT) AS dim, round(CAST(v AS DOUBLE), 6) AS value FROM long""")
def cls_pool(spark, d):
    long = X.cls_pool(states(spark, d)).select("key", F.posexplode("emb").alias("dim", "v"))
    return long.select("key", F.col("dim").cast("long").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("value"))


@query("attach_embeddings", """SELECT e.event_id, e.user_id AS key,
  round(CAST(m.embedding[1] AS DOUBLE), 6) AS first, round(CAST(m.embedding[64] AS DOUBLE), 6) AS last
FROM events e LEFT JOIN embeddings m ON m.vec_id = e.user_id""")
def attach_embeddings(spark, d):
    rows = B.table(spark, d, "events").select("event_id", F.col("user_id").alias("key"))
    out = X.attach_embeddings(rows, B.store(spark, d), missing="null")
    return out.select("event_id", "key", F.round(F.get("emb", F.lit(0)).cast("double"), 6).alias("first"),
                      F.round(F.get("emb", F.lit(63)).cast("double"), 6).alias("last"))


@query("novel_keys", "SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def novel_keys(spark, d):
    return X.novel_keys(B.table(spark, d, "documents").select(F.col("doc_id").alias("key")), B.store(spark, d))


@query("concat_blocks", f"""WITH {B.PROFILES}, j AS (
  SELECT doc_id, key, embedding FROM profiles LEFT JOIN embeddings ON vec_id = doc_id WHERE length(key) >= 3)
SELECT doc_id, CAST(428 + 64 AS INTEGER) AS dim,
  round((length(key) - length(replace(key, 'A', ''))) / length(key), 6) AS first,
  round(coalesce(CAST(embedding[64] AS DOUBLE), 0), 6) AS last, embedding IS NOT NULL AS has_emb FROM j""")
def concat_blocks(spark, d):
    rows = B.profiles(spark, d).where(F.length("key") >= R.SCORING_MIN_LEN).withColumnRenamed("key", "seq")
    rows = X.attach_embeddings(rows.select(F.col("doc_id").alias("key"), "seq"), B.store(spark, d), missing="zero", dim=64)
    rows = X.array_block(X.sequence_vector(rows, "seq", "seq_block"), "emb", "emb_block")
    out = X.concat_blocks(rows, ["seq_block", "emb_block"]).withColumn("v", vector_to_array("features"))
    return out.select(F.col("key").alias("doc_id"), "dim", F.round(F.get("v", F.lit(0)), 6).alias("first"),
                      F.round(F.element_at("v", -1), 6).alias("last"), "has_emb")


@query("standardize", """WITH long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS idx FROM embeddings),
fit AS (SELECT idx, avg(v) AS mu, CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END AS sigma FROM long WHERE label < 7 GROUP BY idx)
SELECT vec_id, CAST(l.idx AS BIGINT) AS idx, round((v - mu) / sigma, 6) AS value FROM long l JOIN fit f ON f.idx = l.idx""")
def standardize(spark, d):
    df = B.store(spark, d)
    scaler = X.fit_scaler(df, "emb", F.col("label") < 7)
    long = X.standardize(df, "emb", scaler).select("key", F.posexplode("scaled").alias("idx", "v"))
    return long.select(F.col("key").alias("vec_id"), F.col("idx").cast("long").alias("idx"), F.round("v", 6).alias("value"))


@query("finite_audit", """SELECT label, count(*) AS n_rows,
  count(*) FILTER (len(list_filter(r, lambda x: NOT isfinite(x))) > 0) AS n_bad_rows,
  CAST(sum(len(list_filter(r, lambda x: NOT isfinite(x)))) AS BIGINT) AS n_bad_values
FROM (SELECT label, list_transform(embedding, lambda x: CASE WHEN abs(x) < 0.001 THEN 'inf'::DOUBLE ELSE x::DOUBLE END) AS r
      FROM embeddings) GROUP BY label""")
def finite_audit(spark, d):
    """Audits the element-wise scale of the store with near-zero values turned infinite, so it finds some."""
    ratio = F.transform("emb", lambda x: F.when(F.abs(x) < 0.001, F.lit(float("inf"))).otherwise(x.cast("double")))
    return X.finite_audit(B.store(spark, d).withColumn("r", ratio), "r", ["label"])


@query("feature_diff_audit", """WITH long AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS idx FROM embeddings)
SELECT CAST(idx AS INTEGER) AS idx, round(max(abs(v - floor(v * 100) / 100)), 6) AS max_diff,
       count(*) FILTER (abs(v - floor(v * 100) / 100) > 0.0099) AS n_over FROM long GROUP BY idx""")
def feature_diff_audit(spark, d):
    a = B.store(spark, d)
    b = a.withColumn("emb", F.transform("emb", lambda x: F.floor(x.cast("double") * 100) / 100))
    out = X.feature_diff_audit(a, b, "key", "emb", 0.0099)
    return out.withColumn("max_diff", F.round("max_diff", 6))


@query("group_constant_audit", f"""WITH {B.KEPT}
SELECT key, count(*) AS n FROM kept GROUP BY key HAVING count(DISTINCT y) > 1""")
def group_constant_audit(spark, d):
    return X.group_constant_audit(B.kept(spark, d), "key", ["y"])
