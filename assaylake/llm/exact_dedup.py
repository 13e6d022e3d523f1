"""Exact dedup with a split of heavy hitters, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest id stays.
A digest per row is written once. A Misra-Gries summary (Spark's `freqItems`) names every digest that may hold more
than `support` of the rows, at most 1/support of them; their exact counts and winners, a table bounded by that number,
are broadcast, so hot rows never move. All other digests are grouped by an ordinary shuffle.

Defined cases: a null text is empty, and all empty texts are equal; a null id is smaller than any other; of rows with
the same text and the same id exactly one stays; an empty table gives no rows; further columns are kept by
`keep_one` and ignored by `exact_groups`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import stored, text_of

SUPPORT = 0.001
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else kept. Pure ASCII texts take the plain `lower`."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(ascii_lower(text_of(text)), 256).alias("digest"))
    return stored(rows, "exact-digests").withColumn("uid", F.monotonically_increasing_id())


def _groups(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("doc_id", "uid")).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, text, doc_id)
    frequent = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    # at most 1/support digests of 64 characters, by the bound of the summary
    winners = stored(_groups(rows.join(F.broadcast(frequent), "digest")), "exact-winners")
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    found = hot.unionByName(cold.join(_groups(cold), "digest"))
    return found.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                        (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """The documents of which one row per group of equal texts stays, with all their columns."""
    groups = exact_groups(docs, text, doc_id, support)
    kept = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    # where the winning id occurs more than once with the text, its rows are told apart by nothing but their columns
    shared = (groups.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256", "doc_id").count()
              .where("count > 1").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")))
    shared = stored(shared, "exact-shared")
    keyed = docs.withColumns({"__key": F.sha2(ascii_lower(text_of(text)), 256)})
    match = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha"))
    single = kept.join(shared.withColumnsRenamed({"__id": "__i", "__sha": "__s"}),
                       F.col("__sha") == F.col("__s"), "left_anti")
    out = keyed.join(single, match, "left_semi")
    if not shared.isEmpty():
        repeated = keyed.join(shared, match, "left_semi").dropDuplicates([doc_id, "__key"])
        out = out.unionByName(repeated)
    return out.select(*docs.columns)
