"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its shingles of five lower-cased words; a shingle weighs tf * (1 + DAMPING * ln((n+1)/(df+1)) / ln(n+1)), df and n
counted over all documents. Two texts are near duplicates when their weighted Jaccard similarity is at least 0.8.

1. Shingle hashes go to SHARDS-many groups, packed; copies of a text count as one class. A group counts df and classes per
   shingle and returns those that two classes share. All others match nothing, so their weight alone matters.
2. A class with less than 0.8 of its weight in shared shingles has no partner and is done. For the rest
   ROWS * BANDS consistent samples are drawn; by the law of the samples the unshared shingles of a text may stand as one element.
3. Bands make buckets. First each class is compared with the best class it meets, the one with the least weight of its own (the likeliest
   original), then every class with the best, the smallest and the largest of each of its buckets. Last come, in blocks, the pairs of a bucket
   that are still in different components, each in its first common bucket, and only if an upper bound of their similarity (CAPS) reaches the
   threshold. So a large group of near copies is linked through few members and not paired with itself, and no link between components is
   lost. Each comparison computes the exact similarity.

At similarity 0.8 three samples agree with 0.51, and 15 bands miss a pair with 2e-5.

Defined cases: a null text is empty; texts without words are in no group but that of their equals; texts of less than five words have one
shingle, all their words; rows with equal texts are one class; a null id is larger than any other when a group takes its
smallest; an empty table gives no rows; further columns are kept by `keep_one` and ignored by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U, by_shard, combine, mix, pack, slices, stored, text_key, text_of, unpack, word_hashes
from .components import components

WORDS, THRESHOLD, BANDS, ROWS, DAMPING = 5, 0.8, 15, 3, 0.25
#: Parts of a class's shared weight, by shingle hash. The smaller of two classes' parts, added up, bound their common weight from above.
CAPS = 32
#: Members of a bucket per block, where a bucket is compared with itself.
BLOCK = 4096
#: Bytes of text per group of shingles.
GROUP_BYTES = 12 << 20


def shingles(texts: list[str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the text of each."""
    words, offsets = word_hashes(texts)
    count = np.diff(offsets)
    text = np.repeat(np.arange(len(texts)), count)
    h = words
    for k in range(1, size):
        h = combine(h[:-1], words[k:]) if len(h) > 1 else h[:0]
    at = np.arange(len(h))
    inside = at + size <= offsets[1:][text[:len(h)]]
    out, owner = [h[inside]], [text[:len(h)][inside]]
    for n in range(1, size):  # short texts are one shingle
        short = np.flatnonzero(count == n)
        if len(short):
            h = words[offsets[short]]
            for k in range(1, n):
                h = combine(h, words[offsets[short] + k])
            out.append(mix(h + U(n)))
            owner.append(short)
    return np.concatenate(out), np.concatenate(owner)


def idf(df, n: int):
    """1 for a shingle of all documents, 1 + DAMPING for one of none: the classical logarithm scaled to a range in which
    0.8 means much the same as without weights."""
    return 1 + DAMPING * np.log((n + 1) / (np.asarray(df, np.float64) + 1)) / np.log(n + 1)


# ---- counting -------------------------------------------------------------------------------------------------

def _spread(texts: DataFrame, shards: int) -> DataFrame:
    """Packed shingles by shard: classes, their copies in the batch, their number of shingles, runs of (hash, tf)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            key, first, copies = np.unique(batch.column("key").to_numpy(), return_index=True, return_counts=True)
            h, text = shingles(batch.column("text").take(pa.array(first)).to_pylist())
            if not len(h):
                continue
            total = np.bincount(text, minlength=len(key))
            shard = (h >> U(40)).astype(np.int64) % shards
            order = np.lexsort((h, text, shard))
            h, text, shard = h[order], text[order], shard[order]
            at = np.flatnonzero(np.concatenate(([True], (np.diff(h) != 0) | (np.diff(text) != 0))))
            tf = np.diff(np.append(at, len(h)))
            h, text, shard = h[at], text[at], shard[at]
            runs = np.flatnonzero(np.concatenate(([True], (np.diff(text) != 0) | (np.diff(shard) != 0))))
            groups, starts, _ = by_shard(shard[runs])
            entry = np.append(runs, len(h))[starts]
            who = text[runs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups.astype(np.int32)), pack(key[who], starts), pack(copies[who].astype(np.int32), starts), pack(total[who].astype(np.int32), starts),
                 pack(np.diff(np.append(runs, len(h))).astype(np.int32), starts), pack(h, entry), pack(tf.astype(np.int32), entry)],
                names=["shard", "classes", "copies", "totals", "runs", "hashes", "tfs"])

    return texts.mapInArrow(run, "shard int, classes binary, copies binary, totals binary, runs binary, hashes binary, tfs binary")


def _shared(table):
    """Of one group: the shingles of two classes or more: hash, class, copies, shingles of the class, tf, df."""
    runs = unpack(table["runs"], np.int32)
    per_run = [unpack(table[c], t) for c, t in (("classes", np.int64), ("copies", np.int32), ("totals", np.int32))]
    h, tf = unpack(table["hashes"], np.uint64), unpack(table["tfs"], np.int32)
    run = np.repeat(np.arange(len(runs), dtype=np.int32), runs)
    order = np.argsort(h, kind="stable")
    h = h[order]
    # shingles that occur once in all need no further look
    twice = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    order, h = order[twice], h[twice]
    run, tf = run[order], tf[order]
    who, copies, total = per_run[0][run], per_run[1][run].astype(np.int64), per_run[2][run]
    order = np.lexsort((who, h))
    h, who, copies, total, tf = (x[order] for x in (h, who, copies, total, tf))
    # a class that came from several tasks is one entry, with all its copies
    new = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(who) != 0)))[:len(h)]
    at = np.flatnonzero(new)
    copies = np.add.reduceat(copies, at) if len(at) else copies
    h, who, total, tf = h[at], who[at], total[at], tf[at]
    first = np.flatnonzero(np.concatenate(([True], np.diff(h) != 0))[:len(h)])
    sizes = np.diff(np.append(first, len(h)))
    df = np.repeat(np.add.reduceat(copies, first), sizes) if len(first) else copies
    shared = np.repeat(sizes, sizes) > 1
    return h[shared], who[shared], copies[shared], total[shared], tf[shared], df[shared]


def _parts(shards: int):
    """Sends the shared shingles of one group on to the groups of their classes, one packed row for each."""
    def run(key, table):
        h, who, copies, total, tf, df = _shared(table)
        part = (mix(who.view(np.uint64)) >> U(20)).astype(np.int64) % shards
        groups, starts, (h, who, copies, total, tf, df) = by_shard(part, h, who, copies, total, tf, df)
        return pa.table({"part": pa.array(groups.astype(np.int32)), "classes": pack(who, starts), "copies": pack(copies.astype(np.int32), starts),
                         "totals": pack(total.astype(np.int32), starts), "hashes": pack(h, starts), "dfs": pack(df.astype(np.int64), starts),
                         "tfs": pack(tf.astype(np.int32), starts)})

    return run


# ---- consistent weighted sampling --------------------------------------------------------------------------------

def _unit(h: np.ndarray) -> np.ndarray:
    """Two uniform numbers in (0, 1) from one hash, multiplied."""
    low = (h & U(0xFFFFFFFF)).astype(np.float64)
    high = (h >> U(32)).astype(np.float64)
    low += 0.5
    high += 0.5
    return low * high / 2.0**64


def samples(h: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """`count` consistent samples of a weighted set: equal with a probability that is the weighted Jaccard similarity."""
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * U(0xD6E8FEB86659FD93))[:, None]
    base = mix(h[None, :] ^ seeds)
    r = -np.log(_unit(base))                                    # Gamma(2, 1)
    c = -np.log(_unit(mix(base + U(0x9E3779B97F4A7C15))))       # Gamma(2, 1)
    beta = (mix(base + U(0x3C6EF372FE94F82A)) >> U(11)).astype(np.float64) / 2.0**53
    t = np.floor(np.log(weights)[None, :] / r + beta)
    best = np.argmin(np.log(c) - r * (t - beta) - r, axis=1)
    rows = np.arange(count)
    return mix(base[rows, best] + t[rows, best].astype(np.int64).view(np.uint64) * U(0xC2B2AE3D27D4EB4F))


def _profiles(n: int, threshold: float):
    """Of one group of classes those that can have a partner: their shared shingles, total weight, samples, band keys and caps."""
    def run(key, table):
        who, h = unpack(table["classes"], np.int64), unpack(table["hashes"], np.uint64)
        order = np.lexsort((h, who))
        who, h = who[order], h[order]
        copies, total, tf = (unpack(table[c], np.int32)[order] for c in ("copies", "totals", "tfs"))
        df = unpack(table["dfs"], np.int64)[order]
        weights = tf * idf(df, n)
        at = np.flatnonzero(np.concatenate(([True], np.diff(who) != 0))[:len(who)])
        rows = []
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(who)]):
            w, shared = weights[lo:hi], float(weights[lo:hi].sum())
            # every group of shingles has seen the same copies of a class
            rest = (int(total[lo:hi].max()) - int(tf[lo:hi].sum())) * float(idf(copies[lo:hi].max(), n))
            if shared < threshold * (shared + rest) * (1 - 1e-9):
                continue
            elements, masses = h[lo:hi], w
            if rest > 0:
                own = mix(who[lo:lo + 1].view(np.uint64) + U(0x27D4EB2F165667C5))
                elements, masses = np.append(elements, own), np.append(masses, rest)
            bands = samples(elements, masses, BANDS * ROWS).reshape(BANDS, ROWS)
            band = combine(combine(bands[:, 0], bands[:, 1]), bands[:, 2]) + np.arange(BANDS, dtype=np.uint64)
            caps = np.bincount((h[lo:hi] >> U(11)).astype(np.int64) % CAPS, w, CAPS)
            rows.append((int(who[lo]), h[lo:hi].tobytes(), df[lo:hi].tobytes(), tf[lo:hi].tobytes(), shared + rest, rest / (shared + rest),
                         mix(band).view(np.int64).tolist(), caps.tolist()))
        cells = zip(*rows) if rows else [[]] * 8
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        return pa.table([pa.array(c, k) for c, k in zip(cells, kinds)], names=["cls", "hashes", "dfs", "tfs", "mass", "alone", "bands", "caps"])

    return run


def _verified(pairs: DataFrame, profiles: DataFrame, n: int, threshold: float) -> DataFrame:
    """Of pairs (a, b) in components (ra, rb) those with a weighted Jaccard similarity of at least the threshold, as links between the components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            cells = [batch.column(c).to_pylist() for c in ("ha", "ta", "da", "ma", "hb", "tb", "mb")]
            for ha, ta, da, ma, hb, tb, mb in zip(*cells):
                ha, hb = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
                at = np.searchsorted(hb, ha)
                at[at == len(hb)] = 0
                both = hb[at] == ha
                tf = np.minimum(np.frombuffer(ta, np.int32)[both], np.frombuffer(tb, np.int32)[at[both]])
                common = float((tf * idf(np.frombuffer(da, np.int64)[both], n)).sum())
                good.append(common >= threshold * (ma + mb - common) * (1 - 1e-12))
            kept = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column("ra").take(kept), batch.column("rb").take(kept)], names=["a", "b"])

    left = profiles.select(F.col("cls").alias("ca"), F.col("hashes").alias("ha"), F.col("tfs").alias("ta"), F.col("dfs").alias("da"), F.col("mass").alias("ma"))
    right = profiles.select(F.col("cls").alias("cb"), F.col("hashes").alias("hb"), F.col("tfs").alias("tb"), F.col("mass").alias("mb"))
    joined = pairs.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb"))
    return joined.select("ra", "rb", "ha", "ta", "da", "ma", "hb", "tb", "mb").mapInArrow(run, "a long, b long")


def _rooted(rows: DataFrame, column: str, name: str, levels: list[DataFrame]) -> DataFrame:
    """Adds the component of `column`: each level maps the roots of the one before to those they were merged into."""
    rows = rows.withColumn(name, F.col(column))
    for level in levels:
        named = level.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        rows = rows.join(named, F.col(name) == F.col("__n"), "left").withColumn(name, F.coalesce("__r", name)).drop("__n", "__r")
    return rows


def _blocks(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of the members of a bucket with each other, dealt to (bucket, i, j) with i <= j: a bucket of m members has
    m / BLOCK blocks, so that no task takes the square of a large bucket."""
    sizes = mixed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mixed = mixed.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    left = mixed.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = mixed.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("block"))))
    return left.drop("block", "blocks"), right.drop("block", "blocks")


def _linked(profiles: DataFrame, n: int, threshold: float) -> list[DataFrame]:
    """The components of near duplicates, as levels of (node, root)."""
    # the class with the least weight of its own is the likeliest original: the first hub of its buckets
    met = profiles.select(F.struct("alone", "cls").alias("rank"), F.explode("bands").alias("bucket"))
    hubs = met.groupBy("bucket").agg(F.min("rank").alias("best"), F.min("rank.cls").alias("low"), F.max("rank.cls").alias("high")).where("low <> high")
    met = stored(met.join(hubs, "bucket").select("bucket", F.col("rank.cls").alias("cls"), "best", "low", "high"), "near-met")
    # each class with the best class it meets
    first = met.groupBy("cls").agg(F.min_by("best.cls", "best").alias("hub")).where("hub <> cls")
    pairs = first.select(F.col("hub").alias("a"), F.col("cls").alias("b"), F.col("hub").alias("ra"), F.col("cls").alias("rb"))
    levels = [components(_verified(pairs, profiles, n, threshold))]
    # the best, the smallest and the largest of each bucket with those of other components
    apart = met.select("cls", F.explode(F.array("best.cls", "low", "high")).alias("hub")).where("hub <> cls").distinct()
    apart = _rooted(_rooted(apart, "hub", "ra", levels), "cls", "rb", levels).where("ra <> rb")
    levels.append(components(_verified(apart.select(F.col("hub").alias("a"), F.col("cls").alias("b"), "ra", "rb"), profiles, n, threshold)))
    # what is left: members of one bucket in different components, as far as their caps allow the similarity
    placed = _rooted(met.select("bucket", "cls"), "cls", "root", levels)
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    known = profiles.select(F.col("cls").alias("c"), "bands", "caps", "mass", ((1 - F.col("alone")) * F.col("mass")).alias("shared"))
    placed = stored(placed.join(mixed, "bucket").join(known, F.col("cls") == F.col("c")).drop("c"), "near-mixed")
    left, right = _blocks(placed)
    other = right.select(F.col("bucket").alias("k"), F.col("i").alias("ki"), F.col("j").alias("kj"), F.col("cls").alias("b"), F.col("root").alias("rb"),
                         F.col("bands").alias("bands_b"), F.col("caps").alias("caps_b"), F.col("mass").alias("mass_b"), F.col("shared").alias("shared_b"))
    # the cheap bound by whole shared weights comes first; a fold over the caps stays small enough to be compiled
    bound = F.lit(threshold * (1 - 1e-9)) * (F.col("mass") + F.col("mass_b"))
    whole = F.least("shared", "shared_b") * (1 + threshold) >= bound
    common = F.aggregate(F.zip_with("caps", "caps_b", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)
    once = (F.col("root") != F.col("rb")) & ((F.col("i") < F.col("j")) | (F.col("cls") < F.col("b")))
    rest = left.join(other, (F.col("bucket") == F.col("k")) & (F.col("i") == F.col("ki")) & (F.col("j") == F.col("kj")) & once & whole
                     & (common * (1 + threshold) >= bound) & (F.array_intersect("bands", "bands_b")[0] == F.col("bucket")))
    levels.append(components(_verified(rest.select(F.col("cls").alias("a"), "b", F.col("root").alias("ra"), "rb"), profiles, n, threshold)))
    return levels


# ---- the operator ---------------------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, class_id (smallest id with this text), group_id (smallest id of the near-duplicate group), kept, text_key."""
    whole = text_of(text)
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), text_key(whole).alias("key"), F.octet_length(whole).cast("long").alias("bytes")), "near-rows")
    rows = rows.withColumn("uid", F.monotonically_increasing_id())
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, -(-total // GROUP_BYTES))
    spread = _spread(docs.select(text_key(whole).alias("key"), whole.alias("text")), int(shards))
    packed = "classes binary, copies binary, totals binary, hashes binary, dfs binary, tfs binary"
    shared = spread.groupBy("shard").applyInArrow(_parts(int(shards)), f"part int, {packed}")
    # a group of classes is bounded by its text
    profiles = shared.groupBy("part").applyInArrow(
        _profiles(max(n, 1), threshold), "cls long, hashes binary, dfs binary, tfs binary, mass double, alone double, bands array<long>, caps array<double>")
    profiles = stored(profiles, "near-profiles")
    levels = _linked(profiles, max(n, 1), threshold)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "uid")).alias("first")
    classes = stored(rows.groupBy("key").agg(first), "near-classes")
    named = _rooted(classes, "key", "root", levels).select("key", F.col("first").alias("own"), "root")
    groups = named.groupBy("root").agg(F.min("own").alias("best"))
    named = named.join(groups, "root").select(F.col("key").alias("k"), F.col("own.doc_id").alias("class_id"), F.col("best.doc_id").alias("group_id"), F.col("best.uid").alias("best"))
    return rows.join(named, F.col("key") == F.col("k")).select(
        "doc_id", "class_id", "group_id", (F.col("uid") == F.col("best")).alias("kept"), F.col("key").alias("text_key"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which one per near-duplicate group stays, with all their columns."""
    found = stored(near_duplicates(docs, threshold), "near-found")
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__k"))
    keyed = docs.withColumn("__key", text_key(text_of("text")))
    out = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left_semi")
    # rows that share id and text are told apart by nothing: one of them stays
    twice = found.groupBy("doc_id", "text_key").count().where("count > 1")
    if not twice.isEmpty():
        out = out.dropDuplicates(["doc_id", "__key"])
    return out.select(*docs.columns)
