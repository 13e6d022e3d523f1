"""Brute-force fixtures and invariants of the distributed operators."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaylake import registry as R
from assaylake.functions import clean as C
from assaylake.operators import censoring as Z, features as X, metrics as M, prepare as P, rank as K, replicates as Rep
from assaylake.operators import joins as J, overlap as O, similarity as Sim, splits as Sp
from assaylake.operators.families import connected_components, families


def py_kmers(s, k):
    return Counter(s[i:i + k] for i in range(len(s) - k + 1))


def py_jaccard(a, b, k):
    x, y = py_kmers(a, k), py_kmers(b, k)
    inter = sum((x & y).values())
    union = sum(x.values()) + sum(y.values()) - inter
    return inter / union if x and y else 0.0


def peptides(n=90, seed=7, copies=0.4):
    """Random peptides of which a large part are near copies of one parent (a hot group)."""
    rnd = random.Random(seed)
    parent = "".join(rnd.choice(R.ALPHABET) for _ in range(30))
    out = []
    for i in range(n):
        if rnd.random() < copies:
            s = list(parent)
            for _ in range(rnd.randint(0, 8)):
                s[rnd.randrange(len(s))] = rnd.choice(R.ALPHABET)
            out.append("".join(s))
        elif rnd.random() < 0.3 and out:
            s = out[rnd.randrange(len(out))]
            out.append(s[: rnd.randint(4, len(s))] + "".join(rnd.choice("ACDK") for _ in range(rnd.randint(0, 6))))
        else:
            out.append("".join(rnd.choice("ACDEK") for _ in range(rnd.randint(4, 25))))
    return out


def brute_families(seqs, t, k):
    parent = list(range(len(seqs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in itertools.combinations(range(len(seqs)), 2):
        if py_jaccard(seqs[i], seqs[j], k) >= t or py_kmers(seqs[i], k) == py_kmers(seqs[j], k):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(seqs))}


@pytest.mark.parametrize("t", [0.35, 0.5])
def test_pairs_and_families_match_brute_force(spark, t):
    seqs = peptides()
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    members, sets = Sim.signature_classes(rows, "id", "key", 3)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in Sim.similar_pairs(sets, t, 3).collect()}
    reps = sorted(set(rep.values()))
    want = {(i, j) for i, j in itertools.combinations(reps, 2) if py_jaccard(seqs[i], seqs[j], 3) >= t}
    assert got == want and len(want) > 20
    fam = {r["id"]: r["family"] for r in families(rows, "id", "key", t, 3).collect()}
    assert fam == brute_families(seqs, t, 3)


def test_strings_without_a_profile_are_one_class(spark):
    seqs = ["", "A", "AC", "GG", "ACD", "DCA", "ACDAC", "CDACD", None]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    members, sets = Sim.signature_classes(rows, "id", "key", 3)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    assert rep == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8} and sorted(r["id"] for r in sets.collect()) == [4, 5, 6]


def test_hot_lists_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(Sim, "BLOCK", 4)
    seqs = peptides(60, 3)
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    _, sets = Sim.signature_classes(rows, "id", "key", 3)
    reps = sorted(r["id"] for r in sets.select("id").collect())
    got = sorted((r["a"], r["b"]) for r in Sim.similar_pairs(sets, 0.35, 3).collect())
    assert got == [(i, j) for i, j in itertools.combinations(reps, 2) if py_jaccard(seqs[i], seqs[j], 3) >= 0.35]


def test_parts_and_blocks_lose_no_pair(spark, monkeypatch):
    # the token lists of a pair moved as strings before; now a token is three bytes, in many small tasks here
    monkeypatch.setattr(O, "GROUP_TOKENS", 40)
    monkeypatch.setattr(O, "PARTS", 8)
    monkeypatch.setattr(O, "MEET", 50)
    seqs = peptides(60, 4)
    sets = Sim.as_sets(spark.createDataFrame(list(enumerate(seqs)), "id long, key string"), "id", "key", 3)
    t = Sim.as_fraction(0.35)
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if py_jaccard(seqs[i], seqs[j], 3) >= 0.35}
    got = {(r["a"], r["b"]) for r in O.candidate_pairs(sets, t, 3).collect()}
    assert want <= got and len(want) > 20
    probes = {(r["a"], r["b"]) for r in O.candidate_pairs(sets, t, 3, role=F.when(F.col("id") % 7 == 0, 3).otherwise(2)).collect()}
    assert {p for p in want if p[0] % 7 == 0 or p[1] % 7 == 0} <= probes and all(a % 7 == 0 or b % 7 == 0 for a, b in probes)
    cross = {(r["a"], r["b"]) for r in O.candidate_pairs(sets, t, 3, role=F.when(F.col("id") < 30, 1).otherwise(2)).collect()}
    assert {p for p in want if p[0] < 30 <= p[1]} <= cross and all(a < 30 <= b for a, b in cross)


def test_overlap_and_signature_in_numpy():
    texts = ["ACDACDACD", "ACDACD", "", "AC", "AC\nDACD", "\u00e9\u4e00ACDAC", "DACDACDAC", "ACD\u2028ACD", "ACDxACD"]
    grams = lambda s, k: Counter(g for g in (s[i:i + k] for i in range(len(s) - k + 1)) if not set(g) & set(O._LINE_ENDS))
    for k in (3, 9):
        for a, b in itertools.product(texts, texts):
            assert O.overlap(a, b, k) == sum((grams(a, k) & grams(b, k)).values())
            assert (O.signature(a, k) == O.signature(b, k)) == (grams(a, k) == grams(b, k)), (a, b, k)


def test_max_cross_jaccard(spark):
    seqs = peptides(70, 11, copies=0.2)
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    members, sets = Sim.signature_classes(rows, "id", "key", 3)
    fam = families(rows, "id", "key", 0.35, 3)
    split = Sp.family_split(fam).select("id", "rep", "split")
    side = {r["id"]: r["split"] for r in split.collect()}
    want = max(py_jaccard(seqs[i], seqs[j], 3) for i in side for j in side if side[i] == "train" != side[j])
    top = Sim.max_cross_jaccard(split.select("rep", "split"), sets, 3).first()
    assert top["max_jaccard"] == pytest.approx(want) and want < 0.35
    leak = Sp.exact_leaks(split, "rep").first()
    assert leak["n_leaking"] == 0


def test_jaccard_of_given_pairs(spark):
    seqs = ["GAGAGA", "GAGAGAGAGAGA", "ACDE", "ACDEFGHIKLMNPQRSTVWY", "AC"]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    pairs = spark.createDataFrame([(0, 1), (2, 3), (0, 4)], "a long, b long")
    got = {(r["a"], r["b"]): r["jaccard"] for r in Sim.jaccard_of(pairs, Sim.as_sets(rows, "id", "key", 3), 3).collect()}
    assert got == pytest.approx({(0, 1): 0.4, (2, 3): 1 / 9, (0, 4): 0.0})


def test_components_of_path_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_counts_follow_rounding(spark):
    rows = spark.createDataFrame([(i, i % 45) for i in range(300)], "row_id long, key long")
    def sizes(df, col):
        return {r["split"]: r["n"] for r in df.groupBy("split").agg(F.countDistinct(col).alias("n")).collect()}
    keyed = Sp.unique_key_split(rows)
    n_train, n_val = round(45 * 0.7), round(45 * 0.1)
    assert sizes(keyed, "key") == {"train": n_train, "val": n_val, "test": 45 - n_train - n_val}
    assert Sp.exact_leaks(keyed, "key").first()["n_leaking"] == 0
    fam = sizes(Sp.family_split(rows.withColumnRenamed("key", "family")), "family")
    assert fam == {"train": int(45 * 0.7), "val": int(45 * (0.7 + 0.1)) - int(45 * 0.7), "test": 45 - int(45 * (0.7 + 0.1))}
    assert sizes(Sp.random_row_split(rows), "row_id") == {"train": 210, "val": 30, "test": 60}


def test_rank_prefix_and_quantiles(spark):
    rnd = random.Random(1)
    values = [rnd.choice([5.0] * 40 + [rnd.random() * 100 for _ in range(40)]) for _ in range(600)]
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    for g in (0, 1):
        mine = sorted(v for i, v in enumerate(values) if i % 2 == g)
        for r in K.global_rank(rows, "v", ["g"], buckets=7).where(F.col("g") == g).collect():
            assert r["n_before"] == sum(v < r["v"] for v in mine) and r["n"] == mine.count(r["v"]) and r["n_total"] == len(mine)
        q = K.exact_quantiles(rows, "v", {"m": 0.5, "q": 0.9}, ["g"]).where(F.col("g") == g).first()
        pos = 0.9 * (len(mine) - 1)
        lo = int(pos)
        assert q["q"] == pytest.approx(mine[lo] + (mine[lo + 1] - mine[lo]) * (pos - lo))
        assert q["m"] == pytest.approx((mine[(len(mine) - 1) // 2] + mine[len(mine) // 2]) / 2)


def test_prefix_max(spark):
    rows = spark.createDataFrame([(float(i), float(i) if i % 7 == 0 else None) for i in range(100)], "at double, v double")
    got = {r["at"]: r["v_upto"] for r in K.prefix_max(rows, "at", "v", buckets=5).collect()}
    assert got == {float(i): float(i - i % 7) for i in range(100)}


def test_salted_join_keeps_every_row(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    look = spark.range(0, 1000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = J.salted_join(rows, look, "k", "left")
    assert got.count() == 1000 and got.where("v IS NULL").count() == rows.where("k % 2 = 1").count()
    assert got.where("k = 0").select("v").distinct().collect()[0]["v"] == 0


def test_auc_with_ties_and_mirror(spark):
    df = spark.createDataFrame([(0, .2), (1, .2), (1, .9), (0, .1)], "y int, score double")
    assert M.auc(df).first()["auc"] == pytest.approx(0.875)
    assert M.auc(df.withColumn("score", -F.col("score"))).first()["auc"] == pytest.approx(0.125)
    assert M.auc(df.where("y = 1")).first()["auc"] is None


def test_floor_shares_and_ceilings(spark):
    df = spark.createDataFrame([(v,) for v in (-10.0, -10.0, -6.0, -5.0, -4.0)], "y double")
    share = {r["region"]: r["ss_share"] for r in Z.variance_share(df).collect()}
    c = Z.oracle_ceiling(df).first()
    assert share["floor"] == pytest.approx(0.5625)
    assert c["ceiling_global_mean"] == pytest.approx(1 - share["floor"]) and c["ceiling_floor_mean"] == pytest.approx(1.0)


def test_noise_ceiling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "key string, y double")
    assert Rep.noise_ceiling(df).first()["ceiling"] == pytest.approx(2 / 3)


def test_rank_gaussian_round_trip_is_monotone(spark, sf_dir):
    from assaylake.plans import bindings as B
    rows = B.assay(spark, sf_dir)
    z = Z.rank_gaussian(rows)
    back = Z.rank_gaussian_inverse(z, rows.where("split = 'train'"))
    both = z.join(back.withColumnRenamed("value", "back"), "z").orderBy("value").collect()
    assert all(a["back"] <= b["back"] + 1e-9 for a, b in zip(both, both[1:]))


def test_soft_blend_prefers_zero_without_gain(spark):
    df = spark.createDataFrame([("val", 1.0, 1.0, .5), ("val", 2.0, 2.0, .5), ("test", 1.0, 1.0, .5), ("test", 3.0, 2.0, .5)],
                               "split string, y double, pred double, p_floor double")
    assert Z.soft_blend(df, [0.0, 0.5, 1.0]).where("chosen").first()["beta"] == 0.0


def test_scaler_uses_population_deviation_of_train(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (0, [3.0, 5.0]), (1, [100.0, 7.0])], "t int, x array<double>")
    row = X.fit_scaler(df, "x", F.col("t") == 0).first()
    assert row["mu"] == [2.0, 5.0] and row["sigma"] == [1.0, 1.0]


def test_missing_embedding_fails(spark):
    rows = spark.createDataFrame([(1,), (2,)], "key long")
    store = spark.createDataFrame([(1, [0.5])], "key long, emb array<float>")
    assert X.attach_embeddings(rows, store, missing="drop").count() == 1
    assert X.novel_keys(rows, store).collect()[0]["key"] == 2
    with pytest.raises(Exception, match="no embedding for key"):
        X.attach_embeddings(rows, store).collect()


def test_label_stats_counts_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (4.0,), (None,)], "y double")
    r = P.label_stats(df).first()
    assert (r["n"], r["n_null"], r["min"], r["median"], r["max"]) == (4, 2, 1.0, 2.5, 4.0)


def test_maximum_without_hub_pair_descends(spark, monkeypatch):
    # no sketch hash is shared, so there is no lower bound; the pair is found at the first threshold below its similarity
    monkeypatch.setattr(Sim, "sketch_rows", lambda sets, k, count=16: sets.where("false").select(*[c for c in sets.columns if c != "key"], F.lit(0).cast("long").alias("h")))
    tried, plain = [], Sim._crossing
    monkeypatch.setattr(Sim, "_crossing", lambda known, t, *rest: tried.append(t) or plain(known, t, *rest))
    rnd = random.Random(2)
    seqs = ["".join(rnd.choice(R.ALPHABET) for _ in range(40)) for _ in range(40)]
    seqs[7] = seqs[3][:24] + seqs[7][:16]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    members, sets = Sim.signature_classes(rows, "id", "key", 3)
    split = members.withColumn("split", F.when(F.col("rep") % 2 == 0, "train").when(F.col("rep") == 3, "train").otherwise("test"))
    side = {r["rep"]: r["split"] for r in split.collect()}
    value, pair = max((py_jaccard(seqs[i], seqs[j], 3), (i, j)) for i in side for j in side if side[i] == "train" and side[j] != "train")
    top = Sim.max_cross_jaccard(split.select("rep", "split"), sets, 3).first()
    assert (top["a"], top["b"]) == pair == (3, 7) and top["max_jaccard"] == pytest.approx(value)
    assert [float(t) for t in tried] == [0.5, 0.25] and 0.25 <= value < 0.5
    lone = rows.where("id < 2")
    members, sets = Sim.signature_classes(lone.withColumn("key", F.when(F.col("id") == 0, "AAAAAA").otherwise("CCCCCC")), "id", "key", 3)
    assert Sim.max_cross_jaccard(members.withColumn("split", F.when(F.col("rep") == 0, "train").otherwise("test")).select("rep", "split"), sets, 3).count() == 0


def test_prefixes_hold_a_shared_token_of_every_similar_pair(spark, monkeypatch):
    monkeypatch.setattr(Sim, "SLOTS", 16)  # a coarse order is right too
    seqs = peptides(60, 5)
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    _, sets = Sim.signature_classes(rows, "id", "key", 3)
    t = Sim.as_fraction(0.35)
    prefix = {}
    for r in Sim.prefix_rows(sets, t, 3).collect():
        prefix.setdefault(r["id"], Counter())[r["kmer"]] += r["n"]
    for i, p in prefix.items():
        size = len(seqs[i]) - 2
        assert sum(p.values()) == size - max(1, -(-size * 35 // 100)) + 1
    similar = [(i, j) for i, j in itertools.combinations(sorted(prefix), 2) if py_jaccard(seqs[i], seqs[j], 3) >= 0.35]
    assert similar and all(prefix[i].keys() & prefix[j].keys() for i, j in similar)
    got = {(r["a"], r["b"]) for r in Sim.similar_pairs(sets, t, 3).collect()}
    assert got == set(similar)


def test_approximate_pairs_are_exact_and_mostly_found(spark, monkeypatch):
    monkeypatch.setattr(Sim, "BLOCK", 3)  # long bands meet in blocks
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choice(R.ALPHABET) for _ in range(n))
    base = [letters(rnd.randrange(80, 200)) for _ in range(12)]
    seqs = [b[:rnd.randrange(5)] + "".join(c if rnd.random() > 0.03 else rnd.choice(R.ALPHABET) for c in b) for b in base for _ in range(6)] + ["AC", "ACD", "ACDACDACD" * 9]
    rows = spark.createDataFrame(list(enumerate(seqs)), "id long, key string")
    _, sets = Sim.signature_classes(rows, "id", "key", 3)
    want = {(i, j) for i, j in itertools.combinations(sorted(r["id"] for r in sets.collect()), 2) if py_jaccard(seqs[i], seqs[j], 3) >= 0.5}
    found = Sim.similar_pairs_lsh(sets, 0.5, 3)
    pairs = [(r["a"], r["b"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.9 * len(want) > 50
    probes = sets.where("id % 5 = 0").select("id")
    for r in Sim.lsh_recall(found, probes, sets, 0.5, 3).collect():
        mine = [p for p in want if r["id"] in p]
        assert (r["n_exact"], r["n_found"], r["n_wrong"]) == (len(mine), len([p for p in pairs if r["id"] in p]), 0)
    assert Sim.similar_pairs_lsh(sets.where("false"), 0.5, 3).count() == 0


def test_stratified_split_evens_label_rates(spark):
    rnd = random.Random(6)
    rows, n = [], 0
    for fam in range(400):
        rate = rnd.choice([0.02, 0.5, 0.98])
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 9, 40])):
            n += 1
            rows.append((n, fam, float(rnd.random() < rate) if fam % 7 else None))
    df = spark.createDataFrame(rows, "row_id long, family long, label double")
    plain, strata = Sp.family_split(df), Sp.stratified_family_split(df, "label")
    gap = lambda d: Sp.label_rate_gap(d, ["label"]).first()["max_gap"]
    count = lambda d: {r["split"]: r["n"] for r in d.groupBy("split").agg(F.countDistinct("family").alias("n")).collect()}
    assert all(abs(n - count(plain)[side]) <= 1 for side, n in count(strata).items()) and gap(strata) <= gap(plain)
    assert strata.groupBy("family").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0 and strata.count() == n
    # inside every stratum the shares are those asked for, to one family
    per = strata.select("family", "split").distinct().join(Sp.family_strata(df, "family", "label"), "family")
    for r in per.groupBy("size_class", "rate_class").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("t")).collect():
        assert abs(r["t"] - 0.7 * r["n"]) <= 1
    assert Sp.stratified_family_split(df.where("false"), "label").count() == 0
