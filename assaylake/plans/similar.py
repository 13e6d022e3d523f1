"""Similarity, families, splits and leakage audits over whole documents: queries and oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry as R
from ..operators import similarity as Sim, splits as Sp
from ..operators.families import families
from ..operators.joins import attach_row
from ..session import cut_lineage
from . import bindings as B
from .catalog import query
from .census import rounded

K, T = B.SIMILARITY_K, R.FAMILY_THRESHOLD


def _sim(threshold: float) -> str:
    """Brute force in SQL: classes of equal multisets, every sharing pair, then components by recursion."""
    return f"""{B.PROFILES}, grams AS (
  SELECT doc_id, key, [key[i:i+{K - 1}] for i in range(1, length(key) - {K} + 2)] AS g FROM profiles),
sig AS MATERIALIZED (SELECT doc_id, key, g, md5(array_to_string(list_sort(g), ',')) AS s FROM grams),
member AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM sig),
tok AS MATERIALIZED (SELECT id, kmer, count(*) AS n FROM (
  SELECT doc_id AS id, unnest(g) AS kmer FROM sig WHERE doc_id IN (SELECT rep FROM member)) GROUP BY 1, 2),
sz AS MATERIALIZED (SELECT id, sum(n) AS m FROM tok GROUP BY id),
ov AS (SELECT x.id AS a, y.id AS b, sum(least(x.n, y.n)) AS o FROM tok x JOIN tok y ON x.kmer = y.kmer AND x.id < y.id GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT a, b, CAST(o AS BIGINT) AS overlap, CAST(p.m + q.m - o AS BIGINT) AS un,
  o / (p.m + q.m - o) AS jaccard FROM ov JOIN sz p ON p.id = a JOIN sz q ON q.id = b),
edge AS (SELECT a, b FROM pairs WHERE jaccard >= {threshold} UNION SELECT b, a FROM pairs WHERE jaccard >= {threshold}),
reach AS (SELECT DISTINCT rep AS id, rep AS r FROM member UNION SELECT e.b, reach.r FROM reach JOIN edge e ON e.a = reach.id),
comp AS (SELECT id, min(r) AS family FROM reach GROUP BY id),
fam AS (SELECT m.doc_id, m.rep, c.family FROM member m JOIN comp c ON c.id = m.rep)"""


_WITH = f"WITH RECURSIVE {_sim(T)}"
_FSPLIT = """forder AS (SELECT family, row_number() OVER (ORDER BY md5('42|' || CAST(family AS VARCHAR)), family) - 1 AS p,
  count(*) OVER () AS n FROM (SELECT DISTINCT family FROM fam)),
fsplit AS (SELECT f.*, CASE WHEN p < floor(n * 0.7::DOUBLE) THEN 'train' WHEN p < floor(n * 0.7999999999999999::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM fam f JOIN forder o ON o.family = f.family)"""


def family_rows(spark, d, classes=None):
    return families(B.profiles(spark, d).select("doc_id", "key"), "doc_id", "key", T, K, classes)


def controlled(spark, d, classes=None):
    """The family split, stored, since audits read it more than once."""
    return cut_lineage(Sp.family_split(cut_lineage(family_rows(spark, d, classes))))


def _sets(spark, d):
    return Sim.signature_classes(B.profiles(spark, d).select("doc_id", "key"), "doc_id", "key", K)


_TURNS = f"""t AS (SELECT conv_id, turn, upper(regexp_replace(text, '[^{B.LETTERS}]', '', 'g')) AS key FROM conversations),
km AS (SELECT conv_id, turn, kmer, count(*) AS n FROM (
  SELECT conv_id, turn, unnest([key[i:i+2] for i in range(1, length(key) - 1)]) AS kmer FROM t) GROUP BY 1, 2, 3),
sz AS (SELECT conv_id, turn, sum(n) AS m FROM km GROUP BY 1, 2),
pr AS (SELECT x.conv_id, x.turn AS turn FROM t x JOIN t y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
ov AS (SELECT x.conv_id, x.turn, sum(least(x.n, y.n)) AS o FROM km x JOIN km y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 AND y.kmer = x.kmer GROUP BY 1, 2)"""


@query("jaccard_pairs", f"""WITH {_TURNS}
SELECT conv_id, turn, CAST(coalesce(o, 0) AS BIGINT) AS overlap,
  round(coalesce(o / (a.m + b.m - o), 0), 6) AS jaccard
FROM pr LEFT JOIN ov USING (conv_id, turn) LEFT JOIN sz a USING (conv_id, turn)
LEFT JOIN sz b ON b.conv_id = pr.conv_id AND b.turn = pr.turn + 1""")
def jaccard_pairs(spark, d):
    """3-mer Jaccard of every message with the next one of its conversation."""
    # the pair (conversation, turn) is the key, whatever the number of turns
    place = lambda turn: F.concat_ws("|", "conv_id", turn)
    rows = B.table(spark, d, "conversations").select(
        place(F.col("turn")).alias("rep"), place(F.col("turn") - 1).alias("before"), "conv_id", "turn",
        F.upper(F.regexp_replace("text", f"[^{B.LETTERS}]", "")).alias("key"))
    sets = Sim.as_sets(rows, "rep", "key", R.FAMILY_K)
    follow = rows.select(F.col("before").alias("a"), F.col("rep").alias("b"))
    pairs = rows.select("conv_id", "turn", F.col("rep").alias("a")).join(follow, "a")
    return rounded(Sim.jaccard_of(pairs, sets, R.FAMILY_K).select("conv_id", "turn", "overlap", "jaccard"))


@query("similar_pairs", f"{_WITH} SELECT a, b, overlap, round(jaccard, 6) AS jaccard FROM pairs WHERE jaccard >= {T}")
def similar_pairs(spark, d):
    _, sets = _sets(spark, d)
    return rounded(Sim.similar_pairs(sets, T, K).select("a", "b", "overlap", "jaccard"))


@query("homology_families", f"{_WITH} SELECT doc_id, rep, family FROM fam")
def homology_families(spark, d):
    return family_rows(spark, d)


@query("family_split", f"{_WITH}, {_FSPLIT} SELECT doc_id, family, split FROM fsplit")
def family_split(spark, d):
    return controlled(spark, d).select("doc_id", "family", "split")


_KSPLIT = f"""{B.PROFILES}, korder AS (SELECT key, row_number() OVER (ORDER BY md5('42|' || key), key) - 1 AS p, count(*) OVER () AS n
  FROM (SELECT DISTINCT key FROM profiles)),
ksplit AS (SELECT doc_id, r.key, CASE WHEN p < round_even(n * 0.7::DOUBLE, 0) THEN 'train'
  WHEN p < round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split
  FROM profiles r JOIN korder o ON o.key = r.key)"""


@query("unique_key_split", f"WITH {_KSPLIT} SELECT doc_id, split FROM ksplit")
def unique_key_split(spark, d):
    return Sp.unique_key_split(B.profiles(spark, d).select("doc_id", "key")).select("doc_id", "split")


_RSPLIT = """rsplit AS (SELECT doc_id, CASE WHEN p < round_even(n * 0.7::DOUBLE, 0) THEN 'train'
  WHEN p < round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS p, count(*) OVER () AS n FROM documents))"""


@query("random_row_split", f"WITH {_RSPLIT} SELECT doc_id, split FROM rsplit")
def random_row_split(spark, d):
    return Sp.random_row_split(B.table(spark, d, "documents").select("doc_id"), "doc_id")


@query("split_audit", f"""{_WITH}, {_FSPLIT}
SELECT split, count(*) AS n_rows, count(DISTINCT rep) AS n_rep, count(DISTINCT family) AS n_family FROM fsplit GROUP BY split""")
def split_audit(spark, d):
    return Sp.split_audit(controlled(spark, d), ["rep", "family"])


def _cross(split, classes):
    members, sets = classes
    rows = members.join(split.select("doc_id", "split"), "doc_id").select("rep", "split")
    return rounded(Sim.max_cross_jaccard(rows, sets, K))


_SIDES = """side AS (SELECT DISTINCT rep, split = 'train' AS tr FROM members),
x AS (SELECT p.a, p.b, p.jaccard, sa.tr FROM pairs p JOIN side sa ON sa.rep = p.a JOIN side sb ON sb.rep = p.b AND sb.tr <> sa.tr
  UNION ALL SELECT s.rep, s.rep, 1.0, true FROM side s JOIN side u ON u.rep = s.rep AND s.tr AND NOT u.tr AND s.rep IN (SELECT id FROM sz))"""
_CROSS = f"""{_SIDES}
SELECT CASE WHEN tr THEN a ELSE b END AS a, CASE WHEN tr THEN b ELSE a END AS b, round(jaccard, 6) AS max_jaccard
FROM x ORDER BY jaccard DESC, 1, 2 LIMIT 1"""


@query("max_cross_jaccard", f"{_WITH}, {_FSPLIT}, members AS (SELECT rep, split FROM fsplit), {_CROSS}")
def max_cross_jaccard(spark, d):
    """After the family split: must stay below the family threshold."""
    classes = _sets(spark, d)
    return _cross(controlled(spark, d, classes), classes)


@query("max_cross_jaccard_random", f"""{_WITH}, {_RSPLIT}, members AS (
  SELECT m.rep, r.split FROM member m JOIN rsplit r ON r.doc_id = m.doc_id), {_CROSS}""")
def max_cross_jaccard_random(spark, d):
    return _cross(Sp.random_row_split(B.table(spark, d, "documents").select("doc_id"), "doc_id"), _sets(spark, d))


@query("exact_leak_check", f"""{_WITH}, {_FSPLIT}, {_RSPLIT},
u AS (SELECT 'family' AS protocol, rep, split FROM fsplit
  UNION ALL SELECT 'random', m.rep, r.split FROM member m JOIN rsplit r ON r.doc_id = m.doc_id),
g AS (SELECT protocol, rep, count(DISTINCT split) AS c FROM u GROUP BY 1, 2)
SELECT protocol, count(*) AS n_groups, count(*) FILTER (c > 1) AS n_leaking FROM g GROUP BY protocol""")
def exact_leak_check(spark, d):
    fam = controlled(spark, d)
    rnd = Sp.random_row_split(fam.select("doc_id", "rep"), "doc_id")
    return Sp.exact_leaks(fam, "rep").withColumn("protocol", F.lit("family")).unionByName(
        Sp.exact_leaks(rnd, "rep").withColumn("protocol", F.lit("random")))


@query("label_rate_gap", f"""{_WITH}, {_FSPLIT}, j AS (SELECT split, quality, toxic FROM fsplit f JOIN labels l ON l.doc_id = f.doc_id),
g AS (SELECT abs(avg(quality) FILTER (split = 'train') - avg(quality) FILTER (split = 'test')) AS q,
  abs(avg(toxic) FILTER (split = 'train') - avg(toxic) FILTER (split = 'test')) AS x FROM j)
SELECT round(q, 6) AS gap_quality, round(x, 6) AS gap_toxic, round(greatest(q, x), 6) AS max_gap FROM g""")
def label_rate_gap(spark, d):
    rows = controlled(spark, d).join(B.table(spark, d, "labels"), "doc_id")
    return rounded(Sp.label_rate_gap(rows, ["quality", "toxic"]))


#: The label of a family's stratum is the quality mark of its documents.
_STRATA = f"""marked AS (SELECT f.*, l.quality, l.toxic FROM fam f LEFT JOIN labels l ON l.doc_id = f.doc_id),
strata AS (SELECT family, length(bin(count(*))) - 1 AS sc, coalesce(floor(avg(quality) * {R.RATE_CLASSES}), -1) AS rc FROM marked GROUP BY family),
placed AS (SELECT family, sc, rc, row_number() OVER (PARTITION BY sc, rc ORDER BY md5('42|' || CAST(family AS VARCHAR)), family) - 1 AS p FROM strata),
ends AS (SELECT sc, rc, s, sum(s) OVER (ORDER BY sc, rc) AS e FROM (SELECT sc, rc, count(*) AS s FROM strata GROUP BY sc, rc)),
vals AS (SELECT *, floor(e * 0.7::DOUBLE) - floor((e - s) * 0.7::DOUBLE) AS t, max(floor(e * 0.7999999999999999::DOUBLE) - floor(e * 0.7::DOUBLE)) OVER (ORDER BY sc, rc) AS v FROM ends),
cuts AS (SELECT *, t + v - coalesce(lag(v) OVER (ORDER BY sc, rc), 0) AS u FROM vals),
ssplit AS (SELECT m.*, CASE WHEN p < t THEN 'train' WHEN p < u THEN 'val' ELSE 'test' END AS split
  FROM marked m JOIN placed USING (family) JOIN cuts USING (sc, rc))"""


def stratified(spark, d):
    rows = cut_lineage(family_rows(spark, d)).join(B.table(spark, d, "labels"), "doc_id", "left")
    return cut_lineage(Sp.stratified_family_split(cut_lineage(rows), "quality"))


@query("stratified_family_split", f"{_WITH}, {_STRATA} SELECT doc_id, family, split FROM ssplit")
def stratified_family_split(spark, d):
    return stratified(spark, d).select("doc_id", "family", "split")


@query("stratified_split_audit", f"""{_WITH}, {_STRATA}, {_FSPLIT},
pf AS (SELECT 'plain' AS protocol, f.split, m.family, m.quality FROM fsplit f JOIN marked m ON m.doc_id = f.doc_id
  UNION ALL SELECT 'stratified', split, family, quality FROM ssplit)
SELECT protocol, split, count(*) AS n_rows, count(DISTINCT family) AS n_family, round(avg(quality), 6) AS rate FROM pf GROUP BY 1, 2""")
def stratified_split_audit(spark, d):
    """Rows, families and label rate of each side, for the plain and the stratified split."""
    rows = stratified(spark, d)
    plain = Sp.family_split(rows.drop("split"))
    both = plain.withColumn("protocol", F.lit("plain")).unionByName(rows.withColumn("protocol", F.lit("stratified")))
    return both.groupBy("protocol", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("family").alias("n_family"), F.round(F.avg("quality"), 6).alias("rate"))


@query("similar_pairs_lsh")
def similar_pairs_lsh(spark, d):
    """The approximate join: exactly checked, some pairs missed. `similar_pairs` is the exact one."""
    _, sets = _sets(spark, d)
    return rounded(Sim.similar_pairs_lsh(sets, T, K).select("a", "b", "overlap", "jaccard"))


_PROBES = 100


@query("lsh_recall", f"""{_WITH}, probe AS (SELECT id FROM sz WHERE id % {_PROBES} = 0),
e AS (SELECT a, b FROM pairs WHERE jaccard >= {T} UNION ALL SELECT b, a FROM pairs WHERE jaccard >= {T})
SELECT id, count(e.b) AS n_exact, CAST(0 AS BIGINT) AS n_wrong, true AS recalled FROM probe LEFT JOIN e ON e.a = id GROUP BY id""")
def lsh_recall(spark, d):
    """Every profile whose id is divisible by 100 against all rows: exact partners, wrong ones (none) and whether 0.9 of all are found."""
    _, sets = _sets(spark, d)
    probes = sets.where(F.col("id") % _PROBES == 0).select("id")
    found = cut_lineage(Sim.lsh_recall(Sim.similar_pairs_lsh(sets, T, K), probes, sets, T, K))
    total = found.agg((F.sum("n_found") >= 0.9 * F.sum("n_exact")).alias("recalled"))
    return attach_row(found, total).select("id", "n_exact", "n_wrong", F.coalesce("recalled", F.lit(True)).alias("recalled"))


@query("split_report", f"""{_WITH}, {_FSPLIT}, members AS (SELECT rep, split FROM fsplit), {_SIDES}
SELECT split, count(*) AS n_rows, count(DISTINCT rep) AS n_rep, count(DISTINCT family) AS n_family,
  (SELECT round(max(jaccard), 6) FROM x) AS max_jaccard FROM fsplit GROUP BY split""")
def split_report(spark, d):
    """Flagship: the audited family split with its exact maximum cross-split similarity."""
    classes = _sets(spark, d)
    fam = controlled(spark, d, classes)
    top = _cross(fam, classes).select("max_jaccard")
    return attach_row(Sp.split_audit(fam, ["rep", "family"]), top)
