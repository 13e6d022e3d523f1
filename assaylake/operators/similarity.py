"""Multiset Jaccard over k-mers: given pairs, threshold joins, cross-split maxima; exact, and an approximate join with banded sketches.

Exact candidates come from an inverted index over prefixes: in any fixed order of k-mers, a pair with Jaccard >= t must share a
k-mer within the first |a| - ceil(t |a|) + 1 tokens of both sides. The order is rarest first as far as a table of SLOTS hash slots tells,
one byte each, whatever the data: a row finds its own prefix from it, so no vocabulary is counted and only prefix tokens move, as numbers of
8 bytes. Equal numbers of different k-mers only add candidates. Sizes and the overlap seen inside the prefixes prune before the exact check;
thresholds are fractions, so every bound is whole-number arithmetic. Nothing is capped: long lists are split into blocks, hot ids are salted. Between
steps only texts, prefixes and id pairs are stored.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import sequence as S
from ..session import cut_lineage, packed_lineage, shuffle_partitions
from . import overlap as O
from .joins import attach_row, hot_keys, hot_of_counts, salted_join

BLOCK = 512
SKETCH = 16
#: Slots of the table that orders k-mers.
SLOTS = 1 << 20
#: Bands of sketches that are moved at once.
BANDS_AT_ONCE = 8_000_000
_LOW = 55  # bits of a k-mer's hash below its commonness


def as_fraction(threshold: float | str | Fraction) -> Fraction:
    return threshold if isinstance(threshold, Fraction) else Fraction(str(threshold))


def signature_classes(rows: DataFrame, ident: str, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows with equal k-mer multisets collapse to one class before any pairing.

    Returns (members: ident, rep) and (sets: id, size, key), one row per class; rep is the smallest ident.
    The way back to rows is a salted join, as one class may hold most rows. Strings shorter than k have
    no profile (similarity 0) and are left out of `sets`.
    """
    # the strings are made once and dealt out evenly, however few files they come from
    rows = packed_lineage(rows.select(ident, key).repartition(shuffle_partitions(rows.sparkSession), ident))
    # equal multisets have equal marks; only rows whose mark repeats need the signature, which sorts all k-mers
    marked = rows.select(ident, F.greatest(F.length(key) - (k - 1), F.lit(0)).alias("size"), O.mark_column(F.col(key), k).alias("mark"))
    marked = cut_lineage(marked.select(ident, F.struct("size", "mark").alias("mark")))
    marks = cut_lineage(marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")))
    told = cut_lineage(salted_join(marked, marks, "mark", hot=hot_of_counts(marks, "mark", "n")).select(ident, (F.col("n") > 1).alias("repeats")))
    signed = rows.join(told.where("repeats").select(ident), ident, "left_semi")
    signed = cut_lineage(signed.select(ident, O.signature_column(F.col(key), k).alias("signature")))
    reps = signed.groupBy("signature").agg(F.min(ident).alias("rep"))
    members = told.where("NOT repeats").select(ident, F.col(ident).alias("rep")).unionByName(salted_join(signed, reps, "signature").select(ident, "rep"))
    members = cut_lineage(members)
    leaders = members.where(F.col(ident) == F.col("rep")).select(ident)
    texts = rows.where(F.length(key) >= k).join(leaders, ident, "left_semi")
    sets = texts.select(F.col(ident).alias("id"), (F.length(key) - (k - 1)).cast("long").alias("size"),
                        F.col(key).alias("key"))
    return members, packed_lineage(sets)


def as_sets(rows: DataFrame, ident: str, key: str, k: int) -> DataFrame:
    """(id, size, key) of rows as they are, without collapsing."""
    return rows.where(F.length(key) >= k).select(
        F.col(ident).alias("id"), (F.length(key) - (k - 1)).cast("long").alias("size"), F.col(key).alias("key"))


def jaccard_of(pairs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """Exact overlap, union and Jaccard of given (a, b, ...) pairs; ids without a profile give 0."""
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    side = packed_lineage(sets.join(wanted, "id", "left_semi").select("id", "size", "key"))
    a = side.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("key").alias("key_a"))
    b = side.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("key").alias("key_b"))
    both = salted_join(salted_join(pairs, a, "a", "left"), b, "b", "left", hot_keys(pairs, "b"))
    overlap = F.coalesce(O.overlap_column(F.col("key_a"), F.col("key_b"), k), F.lit(0).cast("long"))
    sizes = F.coalesce("size_a", F.lit(0)) + F.coalesce("size_b", F.lit(0))
    # stored before anything filters on it, so the overlap is computed once per pair
    out = cut_lineage(both.select(*pairs.columns, overlap.alias("overlap"), sizes.alias("__sizes")))
    out = out.withColumn("union", F.col("__sizes") - F.col("overlap"))
    jaccard = F.when(F.col("union") > 0, F.col("overlap") / F.col("union")).otherwise(F.lit(0.0))
    return out.select(*pairs.columns, "overlap", "union", jaccard.alias("jaccard"))


def at_least(t: Fraction) -> Column:
    return F.col("overlap") * t.denominator >= F.col("union") * t.numerator


def _need(size: Column, t: Fraction) -> Column:
    """Smallest overlap a set of this size needs with any partner: max(1, ceil(t * size))."""
    ceil = F.floor((size * t.numerator + (t.denominator - 1)) / F.lit(t.denominator))
    return F.greatest(ceil.cast("long"), F.lit(1).cast("long"))


def _level(n: Column | int) -> Column:
    """Two steps a doubling: fits 7 bits for any 63-bit count."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(F.log2(n + 1) * 2).cast("tinyint")


def commonness(sets: DataFrame, k: int) -> DataFrame:
    """One row `slots`: for each hash slot how common its k-mers are, on a logarithmic scale."""
    places = F.transform(S.kmers(F.col("key"), k), lambda g: F.pmod(F.xxhash64(g), F.lit(SLOTS)))
    counts = sets.select(F.explode(places).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    every = sets.sparkSession.range(SLOTS).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("n"))
    filled = counts.unionByName(every).groupBy("slot").agg(_level(F.sum("n")).alias("level"))
    # SLOTS entries, whatever the data
    row = filled.agg(F.sort_array(F.collect_list(F.struct("slot", "level"))).alias("c"))
    return cut_lineage(row.select(F.col("c.level").alias("slots")))


def prefix_rows(sets: DataFrame, t: Fraction, k: int, others: tuple[str, ...] = (), table: DataFrame | None = None) -> DataFrame:
    """(id, size, kmer, n, blocks, others) of the prefix k-mers: `kmer` is a number that orders them, n the occurrences inside the
    prefix, blocks the number of blocks of the k-mer's list. Found row by row; only the lists of k-mers in common slots are counted. `table` takes
    the result of `commonness` when it is already there."""
    def number(g):
        h = F.xxhash64(g)
        level = F.get("slots", F.pmod(h, F.lit(SLOTS)).cast("int")).cast("long")
        return F.shiftleft(level, _LOW).bitwiseOR(h.bitwiseAND(F.lit((1 << _LOW) - 1)))

    length = (F.col("size") - _need(F.col("size"), t) + 1).cast("int")
    runs = S.sorted_runs(F.slice(F.array_sort(F.transform(S.kmers(F.col("key"), k), number)), F.lit(1), length), "bigint")
    rows = cut_lineage(attach_row(sets, commonness(sets, k) if table is None else table).select("id", "size", *others, F.explode(runs).alias("e")).select(
        "id", "size", *others, F.col("e.token").alias("kmer"), F.col("e.n").cast("long").alias("n")))
    # a list longer than a block lies in a slot that is at least as common
    common = rows.where(F.shiftright("kmer", _LOW) >= _level(BLOCK))
    long_lists = common.groupBy("kmer").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > BLOCK)
    long_lists = cut_lineage(long_lists.select(F.col("kmer").alias("__k"), F.ceil(F.col("df") / BLOCK).cast("int").alias("__b")))
    out = rows.join(long_lists, F.col("kmer") == F.col("__k"), "left")
    return out.select(*rows.columns, F.coalesce("__b", F.lit(1)).alias("blocks"))


def _side(rows: DataFrame, tag: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}_{tag}" for c in rows.columns if c not in ("kmer", "blk_a", "blk_b")})


def _blocked(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of left and right rows with the same k-mer. Short lists meet as they are. A long list is cut into blocks
    per side and every block pair is its own join key, so no task meets more than about BLOCK x BLOCK."""
    short = _side(left.where("blocks = 1").drop("blocks"), "a").join(_side(right.where("blocks = 1").drop("blocks"), "b"), "kmer")
    left, right = left.where("blocks > 1"), right.where("blocks > 1")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = _side(left.withColumn("blk_a", own).withColumn("blk_b", every).drop("blocks"), "a")
    b = _side(right.withColumn("blk_b", own).withColumn("blk_a", every).drop("blocks"), "b")
    return short.unionByName(a.join(b, ["kmer", "blk_a", "blk_b"]).drop("blk_a", "blk_b"))


def grouped(sets: DataFrame, t: Fraction, k: int) -> DataFrame:
    """`sets` with `comp`, the profiles that hub pairs link, and `blocks` to compare these in, all with all (0: the profile is alone). A group too large for
    that is left apart: its profiles are alone."""
    from .families import connected_components  # it is built on this module

    linked = jaccard_of(hub_pairs(sets, t, k), sets, k).where(at_least(t))
    first = connected_components(linked.select("a", "b"))
    sizes = sets.select("id", "size").join(first.withColumnRenamed("node", "id"), "id").groupBy("component").agg(F.sum("size").alias("n"))
    sizes = sizes.where(F.col("n") <= O.GROUP_MOST).select("component", F.ceil(F.col("n") / O.ALL_TOKENS).cast("int").alias("blocks"))
    where = cut_lineage(salted_join(first, sizes, "component").select(F.col("node").alias("id"), "component", "blocks"))
    both = sets.join(where, "id", "left")
    return packed_lineage(both.select(*sets.columns, F.coalesce("component", "id").alias("comp"), F.coalesce("blocks", F.lit(0)).alias("blocks")))


def _with_jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "overlap", "union", (F.col("overlap") / F.col("union")).alias("jaccard"))


def similar_pairs(sets: DataFrame, threshold: float | Fraction, k: int) -> DataFrame:
    """All pairs a < b of distinct profiles with Jaccard >= threshold; the pairs are the result. Profiles that hub pairs link are compared all with all,
    those of different groups by the join by parts."""
    t = as_fraction(threshold)
    told = grouped(sets, t, k)
    across = jaccard_of(O.candidate_pairs(told, t, k, label=F.col("comp")), sets, k).where(at_least(t))
    return across.unionByName(_with_jaccard(O.pairs_within(told.where("blocks > 0"), t, k, "comp")))


def sketch_rows(sets: DataFrame, k: int, count: int = SKETCH) -> DataFrame:
    """(id, size, h): the smallest k-mer hashes of every set. Likely copies meet in a shared h."""
    others = [c for c in sets.columns if c != "key"]
    return cut_lineage(sets.select(*others, F.explode(O.least_hashes(F.col("key"), k, count)).alias("h")))


def hub_pairs(sets: DataFrame, t: Fraction, k: int) -> DataFrame:
    """A linear number of likely similar pairs: every set with the smallest id sharing one of its hashes,
    where that happens at least twice. Only a head start; what it misses the prefix join finds."""
    rows = sketch_rows(sets, k)
    hubs = rows.groupBy("h").agg(F.min(F.struct("id", "size")).alias("hub"))
    pairs = salted_join(rows, hubs, "h").where(F.col("hub.id") < F.col("id"))
    fits = F.least("size", "hub.size") * t.denominator >= F.greatest("size", "hub.size") * t.numerator
    met = pairs.where(fits).groupBy(F.col("hub.id").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("__n"))
    return met.where("__n > 1").select("a", "b")


def max_cross_jaccard(members: DataFrame, sets: DataFrame, k: int, train: str = "train") -> DataFrame:
    """One row: the largest Jaccard between a train profile and any other, and the pair that has it.

    `members` is (rep, split) with repeats. Exact in two steps: hub pairs across the border give a lower
    bound (linear in number), then exact joins of all rows run at descending thresholds and stop at the first that
    finds a pair, at the bound at last.
    """
    sides = members.groupBy(F.col("rep").alias("id")).agg(
        F.max(F.col("split") == train).alias("in_train"), F.max(F.col("split") != train).alias("in_other"))
    known = packed_lineage(sets.join(sides, "id"))
    shared = known.where("in_train AND in_other").agg(F.min("id").alias("id")).first()["id"]
    if shared is not None:
        return sets.sparkSession.createDataFrame([(shared, shared, 1.0)], "a long, b long, max_jaccard double")
    rows = sketch_rows(known.drop("in_other"), k)
    hubs = rows.groupBy("h").agg(F.min(F.when(F.col("in_train"), F.col("id"))).alias("hub_train"),
                                 F.min(F.when(~F.col("in_train"), F.col("id"))).alias("hub_other"))
    met = salted_join(rows, hubs.where("hub_train IS NOT NULL AND hub_other IS NOT NULL"), "h")
    pairs = met.groupBy(F.when(F.col("in_train"), F.col("id")).otherwise(F.col("hub_train")).alias("a"),
                        F.when(F.col("in_train"), F.col("hub_other")).otherwise(F.col("id")).alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    # the bound only saves work, and pairs that share most hashes give the best
    pairs = cut_lineage(pairs)
    likely = pairs.where(F.col("n") * 4 >= SKETCH)
    pairs = (pairs if likely.isEmpty() else likely).select("a", "b")
    best = jaccard_of(pairs, known, k).orderBy(F.desc("jaccard"), "a", "b").select("overlap", "union").first()
    bound = Fraction(best["overlap"], best["union"]) if best and best["overlap"] else Fraction(0)
    top = None
    # a high bound is joined at once: few pairs are above it
    for t in [bound] if bound >= Fraction(1, 4) else descending(bound, known):
        top = cut_lineage(_crossing(known, t, k))
        if not top.isEmpty():
            break
    return top.orderBy(F.desc("jaccard"), "a", "b").limit(1).select("a", "b", F.col("jaccard").alias("max_jaccard"))


def descending(bound: Fraction, sets: DataFrame) -> list[Fraction]:
    """Thresholds 1/2, 1/4, ... above a bound, then the bound. A join that finds a pair at one of them has found the largest too, so most
    searches end far above the bound; without any bound they end where one shared token is enough."""
    if bound == 0:
        largest = sets.agg(F.max("size")).first()[0] or 1
        bound = Fraction(1, 2 * largest)
    out, t = [], Fraction(1, 2)
    while t > bound:
        out.append(t)
        t /= 2
    return [*out, bound]


def _crossing(known: DataFrame, t: Fraction, k: int) -> DataFrame:
    """All pairs (a in train, b outside) with Jaccard >= t."""
    pairs = O.candidate_pairs(known, t, k, role=F.when(F.col("in_train"), 1).otherwise(2))
    top = jaccard_of(pairs, known, k).where(at_least(t) & (F.col("overlap") > 0))
    first_train = known.select(F.col("id").alias("a"), F.col("in_train").alias("__ta"))
    return top.join(first_train, "a").select(F.when(F.col("__ta"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                             F.when(F.col("__ta"), F.col("b")).otherwise(F.col("a")).alias("b"), "jaccard")


# ---- approximate join ----------------------------------------------------------------------------------------------

def similar_pairs_lsh(sets: DataFrame, threshold: float | Fraction, k: int, bands: int = 64, rows: int = 3) -> DataFrame:
    """Pairs a < b of distinct profiles with Jaccard >= threshold that share a band of their sketches; each is checked exactly, so no pair
    is wrong, but some are missed (`lsh_recall` measures how many). `similar_pairs` is the exact way. Bands move in waves."""
    t = as_fraction(threshold)
    told = grouped(sets, t, k)
    marked = packed_lineage(told.select("id", "size", "comp", "blocks", O.band_keys(F.col("key"), k, bands, rows).alias("bands")))
    waves = min(bands, max(1, -(-marked.count() * bands // BANDS_AT_ONCE)))
    fits = F.least("size_a", "size_b") * t.denominator >= F.greatest("size_a", "size_b") * t.numerator
    across = []
    for w in range(waves):
        low, high = w * bands // waves, (w + 1) * bands // waves
        placed = marked.select("id", "size", "comp", F.explode(F.slice("bands", low + 1, high - low)).alias("kmer"))
        # a band of one group only brings no groups together
        lists = placed.groupBy("kmer").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("__first"), F.max("comp").alias("__last"))
        lists = lists.where("__first < __last").select("kmer", F.ceil(F.col("df") / BLOCK).cast("int").alias("blocks"))
        placed = packed_lineage(placed.join(lists, "kmer").select("id", "size", "comp", "kmer", "blocks"))
        met = _blocked(placed, placed).where((F.col("id_a") < F.col("id_b")) & (F.col("comp_a") != F.col("comp_b")) & fits)
        across.append(packed_lineage(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()))
    pairs = jaccard_of(reduce(DataFrame.unionByName, across).distinct(), sets, k).where(at_least(t))
    inside = told.where("blocks > 0").withColumn("bands", O.band_keys(F.col("key"), k, bands, rows))
    return pairs.unionByName(_with_jaccard(O.pairs_within(inside, t, k, "comp", "bands")))


def pairs_of(probes: DataFrame, sets: DataFrame, threshold: float | Fraction, k: int) -> DataFrame:
    """All pairs (a, b) of a probe (id) and any other profile with Jaccard >= threshold, exact: the join by parts with only the probes listed."""
    t = as_fraction(threshold)
    marked = sets.join(probes.select("id", F.lit(3).alias("__role")).distinct(), "id", "left")
    found = O.candidate_pairs(marked, t, k, role=F.coalesce("__role", F.lit(2)))
    both = jaccard_of(found, sets, k).where(at_least(t))
    each = both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return each.join(probes.select(F.col("id").alias("a")).distinct(), "a", "left_semi")


def lsh_recall(found: DataFrame, probes: DataFrame, sets: DataFrame, threshold: float | Fraction, k: int) -> DataFrame:
    """Per probe (id): n_exact similar profiles, n_found of them in `found` (a, b), n_wrong others there."""
    exact = pairs_of(probes, sets, threshold, k).withColumn("exact", F.lit(1))
    each = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).withColumn("hit", F.lit(1))
    each = each.join(probes.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    both = exact.join(each, ["a", "b"], "full").groupBy("a").agg(
        F.count("exact").alias("n_exact"), F.count_if(F.col("exact").isNotNull() & F.col("hit").isNotNull()).alias("n_found"),
        F.count_if(F.col("exact").isNull()).alias("n_wrong"))
    out = probes.select("id").distinct().join(both.withColumnRenamed("a", "id"), "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_exact", "n_found", "n_wrong")])
