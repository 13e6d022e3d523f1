"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine and connected components.

Each table hashes a vector to the signs of its products with BITS fixed random hyperplanes. Vectors of one label that
share all signs in a table meet in a bucket; a bucket of more than BLOCK rows is cut into pairs of blocks, so one task never holds
a whole hot bucket. Inside a block pair all cosines are computed in double precision. A pair is counted in the first table where its
codes agree, which both ends can tell from their codes, so no pair is ever emitted or deduplicated: a block pair returns link
counts and a spanning forest of its links. Components join the forests.

With 22 degrees (cosine 0.93) a sign agrees with probability 0.88, a table of 8 signs catches a pair with 0.36, and 24
tables miss one of it with probability 2e-5.

Defined cases: null labels, null or zero vectors, vectors with null or non-finite components and vectors of unequal
width link with nothing; repeated rows are vectors of their own and link with each other; a null vec_id is larger than any
other when a component takes its smallest; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .components import components

THRESHOLD, TABLES, BITS, BLOCK, SEED = 0.93, 24, 8, 512, 93


def hyperplanes(width: int, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, tables * bits))


def _codes(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    signs = (vectors @ hyperplanes(vectors.shape[1], tables, bits, seed) > 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.uint16)


def coded(vectors: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Rows that can link: uid, label, width, vector and codes (packed)."""
    real = np.float32 if "float" in dict(vectors.dtypes)["embedding"] else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, label = batch.column("uid").to_numpy(), batch.column("label")
            cells = batch.column("embedding")
            widths = np.asarray(cells.value_lengths())
            flat = np.asarray(cells.flatten().to_numpy(zero_copy_only=False), np.float64)
            starts = np.concatenate(([0], np.cumsum(widths)))
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                rows = flat[starts[at][:, None] + np.arange(width)]
                fine = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
                rows, at = rows[fine], at[fine]
                if not len(at):
                    continue
                codes = _codes(rows, tables, bits, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[at]), label.take(pa.array(at)), pa.array(np.full(len(at), width, np.int32)),
                     pa.array([r.tobytes() for r in rows.astype(real)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary())],
                    names=["uid", "label", "width", "vector", "codes"])

    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = rows.where(~F.exists("embedding", lambda x: x.isNull()))
    return rows.select("uid", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "uid long, label string, width int, vector binary, codes binary")


def _forest(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links in a matrix of row ids x column ids."""
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(mask.any(axis=1)):
        for j in np.flatnonzero(mask[i]):
            a, b = top(int(left[i])), top(int(right[j]))
            if a != b:
                parent[b] = a
                out.append((int(left[i]), int(right[j])))
    return out


def linked_in_blocks(t: int, width: int, same: bool, table: pa.Table, tables: int, threshold: float) -> pa.Table:
    """Counts and forest of the pairs of one block pair (or of one block, if `same`) that meet first in table t."""
    uid, side = table["uid"].to_numpy(), table["side"].to_numpy()
    packed = b"".join(table["vector"].to_pylist())
    real = np.float32 if len(packed) == 4 * width * len(uid) else np.float64
    rows = np.frombuffer(packed, real).reshape(len(uid), width).astype(np.float64)
    codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint16).reshape(len(uid), tables)
    norms = np.sqrt((rows * rows).sum(axis=1))
    a, b = (np.arange(len(uid)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    mask = (rows[a] @ rows[b].T) / (norms[a][:, None] * norms[b][None, :]) >= threshold
    if same:
        mask = np.triu(mask, 1)
    for earlier in range(t):
        mask &= codes[a, earlier][:, None] != codes[b, earlier][None, :]
    counts = np.zeros(len(uid), np.int64)
    np.add.at(counts, a, mask.sum(axis=1))
    np.add.at(counts, b, mask.sum(axis=0))
    edges = _forest(mask, uid[a], uid[b])
    got = np.flatnonzero(counts)
    return pa.table({"a": pa.array(np.append(uid[got], [e[0] for e in edges]).astype(np.int64)),
                     "b": pa.array([None] * len(got) + [e[1] for e in edges], pa.int64()),
                     "n": pa.array(np.append(counts[got], [0] * len(edges)).astype(np.int64))})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, bits: int = BITS,
                    block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = stored(vectors.select("vec_id", "embedding", "label"), "embed-rows").withColumn("uid", F.monotonically_increasing_id())
    keyed = stored(coded(rows, tables, bits, seed), "embed-codes")
    # one row per vector and table: the code, two bytes of the packed codes
    at = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
    slots = keyed.select("uid", "label", "width", "codes", at.alias("tab"))
    code = F.hex(F.substring("codes", F.col("tab") * 2 + 1, 2))
    slots = slots.select("uid", "label", "width", "tab", code.alias("code"))
    sizes = slots.groupBy("label", "width", "tab", "code").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "embed-buckets")
    # a vector's block in a hot bucket is a hash of its row, a bucket of one block needs no pairs
    met = slots.join(sizes, ["label", "width", "tab", "code"])
    met = met.withColumn("mine", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("other", partner).withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    met = met.withColumn("side", F.when(F.col("mine") == F.col("lo"), 0).otherwise(1))
    met = met.select("uid", "label", "width", "tab", "code", "lo", "hi", "side").join(keyed.select("uid", "vector", "codes"), "uid")

    # the rows of a block pair follow each other in a sorted partition, so memory holds one block pair
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def flush():
            if held:
                whole = pa.concat_tables(held)
                if whole.num_rows > 1:
                    yield from linked_in_blocks(last[1], last[5], last[3] == last[4], whole, tables, threshold).to_batches()
            held.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "tab", "code", "lo", "hi", "width"))))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    if keys[start] != last:
                        yield from flush()
                        last = keys[start]
                    held.append(pa.Table.from_batches([batch.slice(start, i - start)]))
                    start = i
        yield from flush()

    key = ["label", "tab", "code", "lo", "hi", "width"]
    dealt = met.repartition(*key).sortWithinPartitions(*key)
    found = stored(dealt.mapInArrow(run, "a long, b long, n long"), "embed-links")
    links = found.where("n > 0").groupBy(F.col("a").alias("u")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    # the component's name is its smallest vec_id
    member = roots.join(rows.select("uid", "vec_id"), roots["node"] == F.col("uid"))
    names = member.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "uid")).alias("first"))
    named = stored(roots.join(names, "root").select("node", "component_id", F.col("first.uid").alias("first")), "embed-names")
    out = rows.join(links, F.col("uid") == F.col("u"), "left").join(named, F.col("uid") == F.col("node"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
