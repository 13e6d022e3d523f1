"""The join by steps: pairs of tokens that are neighbours bring similar documents together, in ranges of sizes, parts, blocks and waves."""

import itertools
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake import registry as R
from assaylake.operators import overlap as O, similarity as Sim

RND = random.Random(12)


def grams(s, k):
    return Counter(s[i:i + k] for i in range(len(s) - k + 1))


def jaccard(a, b, k):
    x, y = grams(a, k), grams(b, k)
    both = sum((x & y).values())
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


def texts():
    """Groups of near copies of 5 to 300 letters, and a repeated letter."""
    letters = lambda n: "".join(RND.choice(R.ALPHABET) for _ in range(n))
    out = [letters(n) for n in (5, 8, 20, 40, 90, 150, 300)]
    for base in list(out):
        for share in (0.02, 0.06, 0.1, 0.2):
            out.append("".join(c if RND.random() > share else RND.choice(R.ALPHABET) for c in base) + letters(RND.randrange(len(base))))
    return [*out, "A" * 50, "A" * 70, "A" * 200]


@pytest.mark.parametrize("t", [Fraction(1, 4), Fraction(35, 100), Fraction(1, 2), Fraction(1)])
def test_steps_meet_just_the_similar_pairs_of_a_part(monkeypatch, t):
    monkeypatch.setattr(O, "STEPS", 40)
    monkeypatch.setattr(O, "MEET", 7)
    rnd = random.Random(3)
    for trial in range(60):
        docs = [sorted({rnd.randrange(25) for _ in range(rnd.randint(1, 12))}) for _ in range(14)]
        docs += [sorted({*rnd.sample(d, -(-len(d) * 2 // 3)), rnd.randrange(25)}) for d in docs]
        n, ids = np.array([len(d) for d in docs]), np.arange(len(docs)) * 3
        roles = np.array([rnd.choice([3] if trial % 2 else [1, 2, 3]) for _ in docs], np.int8)
        labels = np.array([rnd.randrange(5) for _ in docs]) if trial % 3 else None
        got = {(min(p), max(p)) for a, b in O.near(ids, n, labels, roles, n * 0, n, np.concatenate(docs), t) for p in zip(a.tolist(), b.tolist())}
        want = set()
        for i, j in itertools.combinations(range(len(docs)), 2):
            both = len({*docs[i]} & {*docs[j]})
            able = roles[i] & 1 and roles[j] & 2 or roles[j] & 1 and roles[i] & 2
            if able and both >= t * (n[i] + n[j] - both) and (labels is None or labels[i] != labels[j]):
                want.add((3 * i, 3 * j))
        assert got == want


def test_ranges_waves_and_blocks_lose_no_pair(spark, monkeypatch):
    """F1 to F12: beyond 0.2 billion tokens each token moved once for every block of documents."""
    keys = texts()
    want = {(i, j) for i, j in itertools.combinations(range(len(keys)), 2) if jaccard(keys[i], keys[j], 3) >= 0.35}
    sets = Sim.as_sets(spark.createDataFrame(list(enumerate(keys)), "i long, key string"), "i", "key", 3)
    for group, wave in ((3_000_000, 10_000), (100, 400)):
        for name, value in {"RANGES": (0, 16, 32, 64, 128), "LEAST": 3, "GROUP_TOKENS": group, "WAVE_TOKENS": wave}.items():
            monkeypatch.setattr(O, name, value)
        got = {(r["a"], r["b"]) for r in O.candidate_pairs(sets, Fraction(35, 100), 3).collect()}
        assert want <= got and len(want) > 15
    few = {p for p in want if p[0] % 5 == 0 or p[1] % 5 == 0}
    got = {(r["a"], r["b"]) for r in O.candidate_pairs(sets, Fraction(35, 100), 3, role=F.when(F.col("id") % 5 == 0, 3).otherwise(2)).collect()}
    assert few <= got and all(a % 5 == 0 or b % 5 == 0 for a, b in got)


def test_tokens_move_once_where_one_block_holds_them(spark):
    """1.1 billion tokens, about 1 GB of documents, were cut into six blocks."""
    sums = spark.range(270_000).select(F.pow(F.lit(2), F.col("id") % 8 + 7).cast("long").alias("size"), F.lit(3).alias("role"))
    ranges, waves = O._ranges_of(sums, Fraction(35, 100), False)
    assert all(r.blocks == 1 for r in ranges) and waves > 1


def test_pairs_inside_groups_are_exact(spark, monkeypatch):
    """a text went through a shuffle for every pair."""
    monkeypatch.setattr(O, "ALL_TOKENS", 500)
    keys = [k for k in texts() if len(k) > 2] + ["ACD\nACDACD", "ACDACD A"]
    whole = lambda s: Counter({g: n for g, n in grams(s, 3).items() if not set(g) & set(O._LINE_ENDS)})
    sets = Sim.as_sets(spark.createDataFrame(list(enumerate(keys)), "i long, key string"), "i", "key", 3)
    total = sum(len(k) - 2 for k in keys)
    one = sets.withColumns({"comp": F.lit(0), "blocks": F.lit(-(-total // 500))})
    got = {(r["a"], r["b"]): (r["overlap"], r["union"]) for r in O.pairs_within(one, Fraction(35, 100), 3, "comp").collect()}
    want = {}
    for i, j in itertools.combinations(range(len(keys)), 2):
        both = sum((whole(keys[i]) & whole(keys[j])).values())
        union = len(keys[i]) + len(keys[j]) - 4 - both
        if both >= 0.35 * union:
            want[i, j] = (both, union)
    assert got == want and len(want) > 15


def test_bands_in_waves_find_the_same_pairs(spark, monkeypatch):
    """all bands moved at once."""
    keys = [k for k in texts() if len(k) > 2]
    sets = Sim.as_sets(spark.createDataFrame(list(enumerate(keys)), "i long, key string"), "i", "key", 3)
    bands = {r["id"]: r["b"] for r in sets.select("id", O.band_keys(F.col("key"), 3, 64, 3).alias("b")).collect()}
    want = sorted((i, j) for i, j in itertools.combinations(range(len(keys)), 2)
                  if jaccard(keys[i], keys[j], 3) >= 0.35 and any(x == y for x, y in zip(bands[i], bands[j])))
    for at_once in (8_000_000, 1000):
        monkeypatch.setattr(Sim, "BANDS_AT_ONCE", at_once)
        assert sorted((r["a"], r["b"]) for r in Sim.similar_pairs_lsh(sets, 0.35, 3).collect()) == want
