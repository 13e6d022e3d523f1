"""How the given tables stand in for assay tables: one Spark view and one SQL text per binding.

Every binding reads its whole table and whole texts. Each sentence or line of every document is one
sequence row; events are censored measurements with a stand-in prediction; line items are replicate
measurements of a part; orders before and after a date are data sets sharing customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import clean as C
from ..registry import ALPHABET

LETTERS = ALPHABET + ALPHABET.lower()
ASSAY_FLOOR, ASSAY_CUT = 5.0, 50.0
SIMILARITY_K = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(spark: SparkSession, sf_dir: str, dropped: str, name: str, change=lambda text: text) -> DataFrame:
    """Texts without what `dropped` matches, cut at full stops and line feeds: the text is cleaned once, its pieces not again."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("y"), change(F.regexp_replace("text", dropped, "")).alias("text"))
    rows = docs.select("doc_id", "lang", "y", F.posexplode(F.split("text", "[.\n]")).alias("pos", name))
    return rows.withColumn("row_id", F.col("doc_id") * 1000000 + F.col("pos"))


def peptides(spark: SparkSession, sf_dir: str, labels: bool = False) -> DataFrame:
    """One row per sentence or line of every document; digits are kept, so some keys are invalid."""
    rows = _cut(spark, sf_dir, f"[^{LETTERS}0-9 .\n]+", "raw_key").select("row_id", "doc_id", "lang", "raw_key", "y")
    if labels:
        marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
        rows = rows.join(marks, "doc_id", "left")
    return rows


PEPTIDES = rf"""peptides AS (
  SELECT s.doc_id * 1000000 + s.pos AS row_id, s.doc_id, s.lang,
         regexp_replace(s.segment, '[^{LETTERS}0-9 ]', '', 'g') AS raw_key, s.y,
         CAST(l.quality AS DOUBLE) AS label
  FROM (SELECT doc_id, lang, y, unnest(parts) AS segment, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, lang, CAST(n_chars AS DOUBLE) AS y,
                     regexp_split_to_array(text, '[.\n]') AS parts FROM documents)) s
  LEFT JOIN labels l ON l.doc_id = s.doc_id)"""

CLEAN_SQL = rf"""CASE WHEN regexp_full_match(upper(replace(trim(raw_key), ' ', '')), '[{ALPHABET}]{{4,120}}')
  THEN upper(replace(trim(raw_key), ' ', '')) END"""
CLEAN = f"{PEPTIDES}, cleaned AS (SELECT *, {CLEAN_SQL} AS key FROM peptides)"
KEPT = f"{CLEAN}, kept AS (SELECT * FROM cleaned WHERE key IS NOT NULL)"


def cleaned(spark: SparkSession, sf_dir: str, labels: bool = False) -> DataFrame:
    return peptides(spark, sf_dir, labels).withColumn("key", C.clean_sequence(F.col("raw_key")))


def kept(spark: SparkSession, sf_dir: str, labels: bool = False) -> DataFrame:
    return cleaned(spark, sf_dir, labels).where(F.col("key").isNotNull())


def segments(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """Every sentence or line with at least `least` letters, whatever its length: what the row features take."""
    rows = _cut(spark, sf_dir, f"[^{LETTERS}.\n]+", "key", F.upper)
    return rows.select("row_id", "doc_id", "lang", "y", "key").where(F.length("key") >= least)


SEGMENTS = f"""{PEPTIDES}, segments AS (SELECT * FROM (
  SELECT row_id, lang, upper(regexp_replace(raw_key, '[^{LETTERS}]', '', 'g')) AS key FROM peptides) WHERE length(key) > 0)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the letters of its whole text as one sequence."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source",
                       F.upper(F.regexp_replace("text", f"[^{LETTERS}]", "")).alias("key"),
                       F.col("n_chars").cast("double").alias("y"))


PROFILES = f"""profiles AS (
  SELECT doc_id, lang, source, upper(regexp_replace(text, '[^{LETTERS}]', '', 'g')) AS key,
         CAST(n_chars AS DOUBLE) AS y FROM documents)"""


def assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as censored measurements with floor 5; the prediction is a stand-in derived from the row."""
    digit = F.substring(F.md5(F.concat(F.lit("42|"), F.col("user_id").cast("string"))), 1, 1)
    pred = F.lit(0.8) * F.col("value") + F.pmod(F.col("event_id"), F.lit(17))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("key"), F.col("event_type").alias("grp"),
        F.greatest("value", F.lit(ASSAY_FLOOR)).alias("y"), pred.alias("pred"), (-pred).alias("score"),
        (F.lit(1.0) / (F.lit(1.0) + pred)).alias("p_floor"),
        F.when(digit < "b", "train").when(digit < "d", "val").otherwise("test").alias("split"))


ASSAY = f"""assay AS (
  SELECT *, -pred AS score, 1.0 / (1.0 + pred) AS p_floor, y <= {ASSAY_FLOOR} + 1e-6 AS floor_row,
         CASE WHEN y <= {ASSAY_FLOOR} + 1e-6 THEN 'floor' WHEN y <= {ASSAY_CUT} THEN 'bulk' ELSE 'tail' END AS region
  FROM (SELECT event_id AS row_id, user_id AS key, event_type AS grp,
               CAST(greatest(value, {ASSAY_FLOOR}) AS DOUBLE) AS y,
               CAST(0.8 AS DOUBLE) * value + event_id % 17 AS pred,
               CASE WHEN substr(md5('42|' || CAST(user_id AS VARCHAR)), 1, 1) < 'b' THEN 'train'
                    WHEN substr(md5('42|' || CAST(user_id AS VARCHAR)), 1, 1) < 'd' THEN 'val'
                    ELSE 'test' END AS split
        FROM events))"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.col("l_extendedprice").alias("y"), "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("quantity"))


MEASURES = """measures AS (SELECT l_partkey AS key, l_extendedprice AS y, l_orderkey, l_linenumber,
  l_quantity AS quantity FROM lineitem)"""


def order_sets(spark: SparkSession, sf_dir: str, *cuts: str) -> list[DataFrame]:
    """All orders, cut at the given dates into data sets of labels per customer; orders without a date are in the first."""
    orders = table(spark, sf_dir, "orders")
    era = sum((F.coalesce(F.col("o_orderdate") >= F.lit(c).cast("timestamp"), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return [orders.where(era == k).select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("y")) for k in range(len(cuts) + 1)]


def sets_sql(*cuts: str) -> str:
    era = " + ".join(f"CAST(coalesce(o_orderdate >= TIMESTAMP '{c}', false) AS INTEGER)" for c in cuts)
    return ", ".join(f"set_{name} AS (SELECT o_custkey AS key, o_totalprice AS y FROM orders WHERE {era} = {k})"
                     for k, name in zip(range(len(cuts) + 1), "abc"))


TWO_SETS = ("1998-01-01",)
SETS = sets_sql(*TWO_SETS)


THREE_SETS = ("1997-01-01", "1998-01-01")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("row_id"),
                                                F.col("p_name").alias("key"), F.col("p_retailprice").alias("y"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("src"), F.col("page_id").alias("row_id"),
                                                 F.col("url").alias("key"), F.length("url").cast("double").alias("y"))
    return parts.unionByName(pages)


MOLECULES = """molecules AS (
  SELECT 'part' AS src, p_partkey AS row_id, p_name AS key, p_retailprice AS y FROM part
  UNION ALL SELECT 'page', page_id, url, CAST(length(url) AS DOUBLE) FROM pages)"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding table as a store: one row per key and model."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("key"), F.lit("base").alias("model"), F.col("embedding").alias("emb"), "label")
