"""Registered queries of the operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, collocations, embedding_dedup, exact_dedup, extraction, lexical, minhash, packing, quality, sharding, suffix_dedup, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op2_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op3_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"))


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    found = warc.read_archives(manifest, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op5_hyperplane_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.scored(table(spark, sf_dir, "documents"), trusted).drop("text_key")


def op8_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.reply_ordered(table(spark, sf_dir, "conversations"))


def op10_heavy_hitter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_text(table(spark, sf_dir, "pages"))


def op13_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_suffix_array_dedup, op2_weighted_minhash, op3_rank_array_bpe, op4_zip_warc, op5_hyperplane_dedup, op6_feistel_sharding,
        op7_kneser_ney_quality, op8_genetic_packing, op9_quotation_linking, op10_heavy_hitter_dedup,
        op11_max_sketch_search, op12_template_extraction, op13_setm_collocations)}


_EXACT = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""


_WARC = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, url, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {warc.MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {warc.MIN_REVISIT} AND page_id > first THEN first END AS refers_to, url FROM q"""
#: All pairs of a label, in doubles; components by a recursive walk.
_EMBED = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v), z AS (SELECT * FROM u WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM z a JOIN z b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= {embedding_dedup.THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN k ON vec_id = k.a"""


#: All scores of all pairs that share a term.
_SEARCH = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {{lower}} AS t FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {{lower}} AS t FROM benchmark),
dt AS (SELECT r, doc_id, unnest(regexp_extract_all(t, '{{term}}')) AS term FROM d),
tf AS MATERIALIZED (SELECT r, doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
n AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r), s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term),
m AS (SELECT r, 100 - 90 + ((90 * n * nn) // ll) AS m FROM n, s),
bt AS (SELECT DISTINCT q, item_id, term FROM (SELECT q, item_id, unnest(regexp_extract_all(t, '{{term}}')) AS term FROM b)),
p AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM bt JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= {lexical.TOP}""".format(
    lower="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", term=r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Every phrase counted, in 128-bit products.
_PHRASES = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest(list_concat(w, [w[i] || ' ' || w[i+1] for i in range(1, len(w))], [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)])) AS phrase FROM w),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS a, string_split(phrase, ' ') AS x FROM g GROUP BY lang, phrase HAVING count(*) >= {collocations.LEAST}),
c AS (SELECT f.lang, f.phrase, f.a, f.x, k, u.a AS l, v.a AS r, CAST((1000000::HUGEINT * f.a * f.a) // (u.a::HUGEINT * v.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(x))) AS k FROM f WHERE len(x) > 1) f
  JOIN f u ON u.lang = f.lang AND u.phrase = array_to_string(f.x[:k], ' ') JOIN f v ON v.lang = f.lang AND v.phrase = array_to_string(f.x[k+1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([x[1] || ' ' || x[2], x[2] || ' ' || x[3]]) AS part FROM f WHERE len(x) = 3) GROUP BY lang, part),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE 100 * coalesce(most, 0) < {collocations.SHARE} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= {collocations.TOP}"""


def oracle_sql() -> dict[str, str]:
    return {"op4_zip_warc": _WARC, "op5_hyperplane_dedup": _EMBED, "op6_feistel_sharding": sharding.oracle(), "op10_heavy_hitter_dedup": _EXACT,
            "op11_max_sketch_search": _SEARCH, "op13_setm_collocations": _PHRASES}
