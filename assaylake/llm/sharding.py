"""Reproducible shuffle into shards: a Feistel permutation over global row numbers, in DataFrame functions only.

Rows are numbered in the order of a digest of (id, size, checksum). The digest's first hex digits cut the order into
equal ranges, so windows stay small and only one total per range is summed up. A permutation of 0..n-1, keyed by a seed,
turns the number into a position: shard = position mod shards, slot = position div shards. Both can be computed for any
row number without the data, shards differ by one row at most, and slots have no gaps.

The permutation is a balanced Feistel network over an a x b grid just larger than n. Positions beyond n walk on
along their cycle until they fall below n; fewer than `a` grid cells lie beyond, which bounds every walk.

Defined cases: a null text has size 8 and checksum 0, like an empty one; rows equal in id, size and checksum are
counted first and spread out last, so a third of all rows may be alike; an empty table gives no rows; other columns
don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored, text_of

SHARDS, SEED, ROUNDS = 24, 20240229, 4
OVERHEAD = 8
#: Rows that one range of the numbering holds on average at most.
RANGE_ROWS = 100_000
_CHUNK = 100_000


def _round(value: Column, seed: int, r: int, modulus: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(r)), value.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(modulus)


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _network_round(seed: int, r: int, a: int, b: int):
    if r % 2 == 0:
        return lambda p: F.struct(((p["l"] + _round(p["r"], seed, r, a)) % F.lit(a)).alias("l"), p["r"].alias("r"))
    return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + _round(p["l"], seed, r, b)) % F.lit(b)).alias("r"))


def permute_once(y: Column, n: int, seed: int = SEED) -> Column:
    """One pass of the network over the grid of n."""
    a, b = grid(n)
    pair = F.struct(F.call_function("div", y, F.lit(b)).alias("l"), (y % F.lit(b)).cast("long").alias("r"))
    # one-cell arrays keep every round's operands as values, so the expression stays linear in the rounds
    for r in range(ROUNDS):
        pair = F.transform(F.array(pair), _network_round(seed, r, a, b))[0]
    return F.transform(F.array(pair), lambda p: p["l"] * F.lit(b) + p["r"])[0]


def with_position(rows: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """Adds position to row numbers below n: the network, then the walk along the cycle for cells beyond n."""
    a, _ = grid(n)
    at = F.col("__at")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(a)), at,
                       lambda y, _: F.when(y < n, y).otherwise(permute_once(y, n, seed)))
    rows = rows.withColumn("__at", permute_once(F.col("row_number"), n, seed))
    return rows.withColumn("position", F.when(at < n, at).otherwise(walk)).drop("__at")


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Adds row_number (long, from 0) to rows of (doc_id, size, text_crc32), and gives their number."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32"))
    counted = stored(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
                     .withColumn("digest", digest), "shard-rows")
    n = int(counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    digits = max(2, math.ceil(math.log(max(n / RANGE_ROWS, 1), 16)))
    counted = counted.withColumn("range", F.substring("digest", 1, digits))
    # one row per digest range: n / RANGE_ROWS * 16 rows at most
    totals = counted.groupBy("range").agg(F.sum("n").alias("in_range"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    starts = starts.join(offsets, "range").withColumn("start", F.col("base") + F.col("before"))
    # equal rows get their numbers in chunks, so no array outgrows a row
    chunks = starts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _CHUNK))))
    first = F.col("start") + F.col("chunk") * _CHUNK
    last = F.least(first + _CHUNK, F.col("start") + F.col("n")) - 1
    return chunks.select("doc_id", "size", "text_crc32", F.explode(F.sequence(first, last)).alias("row_number")), n


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number, position."""
    whole = text_of(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
                       F.crc32(whole.cast("binary")).cast("long").alias("text_crc32"))
    rows, n = numbered(rows)
    rows = with_position(rows, n, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                       (F.col("position") % shards).cast("int").alias("shard"),
                       F.floor(F.col("position") / shards).cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")


def oracle(shards: int = SHARDS, seed: int = SEED, rounds: int = ROUNDS) -> str:
    """The same law in DuckDB SQL; the walk is a recursive query."""
    def step(source: str, keep: str, value: str) -> str:
        a, b = "(SELECT a FROM g)", "(SELECT b FROM g)"
        q = f"SELECT {keep}, {value} // {b} AS l, {value} % {b} AS r FROM {source}"
        for k in range(rounds):
            other, own, mod = ("r", "l", a) if k % 2 == 0 else ("l", "r", b)
            f = f"('0x' || substr(md5('{seed}|{k}|' || CAST({other} AS VARCHAR)), 1, 15))::BIGINT"
            new = f"({own} + {f} % {mod}) % {mod}"
            q = f"SELECT {keep}, {new if own == 'l' else 'l'} AS l, {new if own == 'r' else 'r'} AS r FROM ({q})"
        return f"SELECT {keep}, l * {b} + r AS y FROM ({q})"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + {OVERHEAD} AS BIGINT) AS size,
       coalesce(text, '') AS t FROM documents),
tab AS (SELECT list(v ORDER BY i) AS l FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT doc_id, size, hex(encode(t)) AS h, (SELECT l FROM tab) AS l FROM d),
x AS (SELECT doc_id, size, CAST(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(0, strlen(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT)),
        lambda c, z: xor(c // 256, l[1 + xor(c, z) % 256]))) AS BIGINT) AS text_crc32 FROM h),
n AS (SELECT count(*) AS n FROM d),
g0 AS (SELECT n, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM n), g AS (SELECT n, a, (n + a - 1) // a AS b FROM g0),
rn AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), size, text_crc32)), doc_id) - 1 AS row_number FROM x),
w AS ({step('rn', 'row_number', 'row_number')} UNION ALL
      {step('(SELECT * FROM w WHERE y >= (SELECT n FROM g))', 'row_number', 'y')}),
p AS (SELECT row_number, y AS position FROM w WHERE y < (SELECT n FROM g))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(position % {shards} AS INTEGER) AS shard, position // {shards} AS slot,
       CAST(NULL AS INTEGER) AS grown_shard, row_number, position FROM rn JOIN p USING (row_number)"""
