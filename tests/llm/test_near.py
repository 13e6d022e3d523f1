"""Weighted near dedup against all pairs, the language model against a plain one, and the pipeline's stages."""

import hashlib
import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assaylake.llm import minhash, quality
from assaylake.llm.common import stored, table
from assaylake.session import ensure_checkpoint_dir


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns(
        {"key": F.lit(1), "bytes": F.lit(2), "n": F.lit(0), "root": F.lit("r"), "l": F.lit(1), "loss": F.lit(2)})


def made():
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(400)]
    rows, texts = [], [list(rng.choice(vocabulary, int(n))) for n in rng.integers(40, 160, 25)]
    for i in range(240):
        words = list(texts[i % 25])
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, len(words)))] = "new%d" % rng.integers(0, 10**6)
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(["Hot"] + texts[0] + ["end%d" % i])) for i in range(80)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one"), (None, rows[5][1]), (5, rows[5][1]), (5, rows[5][1]),
             (2006, "to " * 500), (2007, "to " * 520), (2008, "a b c d e"), (2009, "A b\tc d e")]
    return [(d, t, "en", 0) for d, t in rows]


def brute_groups(rows):
    shingled = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        shingled.append(Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else []))
    df, n = Counter(s for c in shingled for s in c), len(rows)
    weigh = [{s: k * (1 + 0.25 * math.log((n + 1) / (df[s] + 1)) / math.log(n + 1)) for s, k in c.items()} for c in shingled]
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(n):
        for b in range(a):
            both = sum(min(w, weigh[b].get(s, 0)) for s, w in weigh[a].items())
            union = sum(weigh[a].values()) + sum(weigh[b].values()) - both
            if (rows[a][1] or "") == (rows[b][1] or "") or union and both / union >= 0.8:
                parent[top(a)] = top(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[top(k)] = min(least.get(top(k), r[0]), r[0])
    return sorted((str(r[0]), str(least.get(top(k)))) for k, r in enumerate(rows))


def test_near_duplicates_against_all_pairs(spark):
    rows = made()
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    want = brute_groups(rows)
    assert sorted((str(r["doc_id"]), str(r["group_id"])) for r in got) == want
    assert sum(r["kept"] for r in got) == len({g for _, g in want})
    assert all(r["doc_id"] == r["group_id"] for r in got if r["kept"])
    kept = minhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({int(g) for _, g in want})
    assert minhash.near_duplicates(frame(spark, [])).count() == 0 and minhash.keep_one(frame(spark, [])).count() == 0


def test_sampling_estimates_the_similarity():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
    b[:10] = 1e-12
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = (minhash.samples(h, a, 4000) == minhash.samples(h, b, 4000)).mean()
    assert abs(got - want) < 0.04


class Plain:
    """An interpolated modified Kneser-Ney trigram model in dictionaries."""

    def __init__(self, texts):
        tri = Counter()
        for t in texts:
            w = ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
            tri.update(zip(w, w[1:], w[2:]))
        bi = Counter((v, w) for _, v, w in tri)
        uni = Counter(w for _, w in bi)
        self.levels = [self.level({(w,): c for w, c in uni.items()}), self.level(bi), self.level(tri)]
        self.vocabulary = len(uni)

    @staticmethod
    def level(counts):
        n = [sum(c == k for c in counts.values()) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(max(k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5, 0.1), k - 0.1) for k in range(1, 4)]
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3) - 1]
        return counts, d, total, left

    def p(self, gram):
        counts, d, total, left = self.levels[len(gram) - 1]
        lower = self.p(gram[1:]) if len(gram) > 1 else 1 / (self.vocabulary + 1)
        if not total[gram[:-1]]:
            return lower
        c = counts.get(gram, 0)
        return ((c - d[min(c, 3) - 1]) if c else 0) / total[gram[:-1]] + left[gram[:-1]] / total[gram[:-1]] * lower

    def log(self, text):
        w = ["<s>", "<s>", *(text or "").lower().split(), "</s>"]
        return sum(math.log(self.p(g)) for g in zip(w, w[1:], w[2:]))


def test_perplexity_equals_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(quality, "SLICE_BYTES", 2000)
    rng = np.random.default_rng(4)
    words = ["w%d" % k for k in range(30)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 40)))), "en", 0) for i in range(60)]
    rows += [(100, None, "en", 0), (101, "zz yy zz ## w1 w2", "en", 0), (102, rows[3][1], "en", 0), (103, "w1 w1", None, 0), (104, "w1", "xx", 0), (3, rows[3][1], "en", 0), (None, "w2 w3", "en", 0)]
    docs, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = quality.scored(docs, trusted, quantile=0.9).collect()
    assert len(got) == len(rows)
    seen = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) / 2**32 < 0.5
    good = [(d, t) for d, t, lang, _ in rows if d is not None and d < 40]
    model = Plain([t for d, t in good if seen(d)])
    rest = [t for d, t in good if not seen(d)]
    tokens = lambda t: len((t or "").split()) + 1
    mean = -sum(map(model.log, rest)) / sum(map(tokens, rest))
    by_text = {(d, t): (-model.log(t), tokens(t)) for d, t, lang, _ in rows if lang == "en"}
    want = sorted((str(d), round(math.exp((x + 30 * mean) / (n + 30)), 6)) for (d, t), (x, n) in by_text.items() if d != 3)
    assert sorted((str(r["doc_id"]), round(r["perplexity"], 6)) for r in got if r["lang"] == "en" and r["doc_id"] != 3) == want
    assert all(r["kept"] and r["threshold"] is None for r in got if r["lang"] != "en")
    assert not next(r for r in got if r["doc_id"] == 101)["kept"]
    assert quality.scored(docs.where("false"), trusted).count() == 0
    assert all(r["kept"] for r in quality.scored(docs, trusted.where("false")).collect())


def test_rare_language_is_sampled_beside_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_DOCS", 20)
    monkeypatch.setattr(quality, "TRAIN_PER_LANG", 10)
    monkeypatch.setattr(quality, "LANG_FLOOR", 10)
    rng = np.random.default_rng(5)
    words = {"en": ["e%d" % k for k in range(20)], "is": ["i%d" % k for k in range(20)]}
    rows = [(i, " ".join(rng.choice(words[lang], 40)), lang, 0) for lang, ids in (("en", range(20_000)), ("is", range(30_000, 30_012))) for i in ids]
    rows += [(40_000 + i, " ".join("junk%d" % x for x in rng.integers(0, 10**6, 40)), lang, 0) for i, lang in enumerate(["en", "is"] * 5)]
    rows += [(50_000, rows[0][1], "two", 0), (50_001, rows[1][1], "two", 0), (50_002, "x " * 60, "two", 0), (50_003, "one", "one", 0)]
    docs = frame(spark, rows)
    trusted = docs.where("doc_id < 40000 or doc_id in (50000, 50001, 50003)").select("doc_id")
    drawn = quality.training_ids(docs, trusted).join(docs, "doc_id").groupBy("lang").count()
    drawn = {r["lang"]: r["count"] for r in drawn.collect()}
    assert 1 <= drawn["is"] <= 11 and 1 <= drawn["en"] < 40 and drawn["two"] == 1 and "one" not in drawn
    got = {r["doc_id"]: r for r in quality.scored(docs, trusted).collect()}
    assert not any(got[40_000 + i]["kept"] for i in range(10))
    assert got[50_002]["threshold"] is not None and got[50_003]["threshold"] is None and got[50_003]["kept"]


def test_every_trusted_document_is_used(spark, monkeypatch):
    # the counts came from a few documents of a large language before, whatever its size
    monkeypatch.setattr(quality, "TRAIN_DOCS", 4)
    monkeypatch.setattr(quality, "LANG_FLOOR", 2)
    docs = frame(spark, [(i, "a b c d%d" % i, "en", 0) for i in range(400)])
    seen, plain = [], quality.fitted
    monkeypatch.setattr(quality, "fitted", lambda texts: seen.append(texts.count()) or plain(texts))
    assert quality.scored(docs, docs.select("doc_id")).count() == 400
    assert 150 < seen[0] < 250


def test_level_lowers_only_large_languages():
    assert quality.sample_level([(300.0, 2), (50.0, 3)]) == 300
    assert quality.sample_level([(300.0, 4), (20.0, 2)]) == 240
    assert quality.sample_level([(300.0, 40), (20.0, 2)]) == quality.LANG_FLOOR
    assert quality.sample_level([]) == 300


def test_junk_is_rejected_and_clean_text_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = F.col("doc_id") % 2 == 0
    found = quality.scored(docs, labels.where("quality = 1").where(~held_out)).where(held_out).join(labels, "doc_id")
    rows = found.select("quality", "kept").collect()
    share = lambda q: np.mean([r["kept"] for r in rows if r["quality"] == q])
    assert share(1) > 0.93 and share(0) < 0.6


def test_counts_beyond_16_bits(spark):
    rng = np.random.default_rng(6)
    words = ["w%d" % k for k in range(30)]
    rows = [(i, " ".join(rng.choice(words, 20)), "en", 0) for i in range(40)]
    rows += [(100, "w1 " * 100_000, "en", 0), (101, "w1 w2 " * 70_000 + "w3", "en", 0), (102, "w4 " * 65_535, "en", 0)]
    docs, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    chosen = {r["doc_id"] for r in quality.training_ids(docs, trusted).collect()}
    model = Plain([t for d, t, *_ in rows if d in chosen])
    rest = [t for d, t, *_ in rows if d < 40 and d not in chosen]
    mean = -sum(map(model.log, rest)) / sum(len(t.split()) + 1 for t in rest)
    got = {r["doc_id"]: r["perplexity"] for r in quality.scored(docs, trusted).collect()}
    for d, t, *_ in rows[40:]:
        assert got[d] == pytest.approx(math.exp((-model.log(t) + 30 * mean) / (len(t.split()) + 31)), rel=1e-6)


def test_parts_and_waves_give_the_plain_model_and_leave_no_n_grams(spark, monkeypatch):
    # all trigrams, bigrams and the model stayed on disk before, and each step moved all of them
    for name, value in {"PARTS": 3, "PART_BYTES": 200, "PASSES": 2, "WAVES": 3, "WAVE_BYTES": 500, "BLOCK_KEYS": 40, "SHARD_BYTES": 100}.items():
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(8)
    words = ["w%d" % k for k in range(25)]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 30)))), "en", 0) for i in range(50)] + [(100, "w1 w1 w1 w2 zz", "en", 0), (101, "w3 w4 w5", "en", 0), (102, "w3 w4 w5", "en", 0)]
    docs, trusted = frame(spark, rows), spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    chosen = {r["doc_id"] for r in quality.training_ids(docs, trusted, bounded=False).collect()}
    folder, before = Path(ensure_checkpoint_dir(spark).removeprefix("file:")), {t.name for t in spark.catalog.listTables()}
    known = {*folder.rglob("*.parquet")}
    got = {r["doc_id"]: r["perplexity"] for r in quality.scored(docs, trusted).collect()}
    assert {t.name for t in spark.catalog.listTables()} == before
    left = {p.relative_to(folder).parts[0].split("-")[1 if p.relative_to(folder).parts[0].startswith("quality-") else 0] for p in {*folder.rglob("*.parquet")} - known}
    assert left and not left & {"trigrams", "bigrams", "contexts", "pairs", "p2", "model", "quality_model"}
    model = Plain([t for d, t, *_ in rows if d in chosen])
    rest = [t for d, t, *_ in rows if d < 40 and d not in chosen]
    mean = -sum(map(model.log, rest)) / sum(len(t.split()) + 1 for t in rest)
    for d, t, *_ in rows:
        assert got[d] == pytest.approx(math.exp((-model.log(t) + 30 * mean) / (len(t.split()) + 31)), rel=1e-9)


def test_squeezed_arrays_come_back():
    rng = np.random.default_rng(9)
    for x in (np.zeros(0, np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), rng.normal(size=77), np.array([-3, 5], np.int32)):
        assert np.array_equal(quality.unsqueezed(quality.squeezed(x), len(x), x.dtype), x)
    keys = np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64))
    assert np.array_equal(np.cumsum(quality._steps(keys)), keys)


def test_distinct_words_of_windows():
    texts = ["", "a", "a A b", "x " * 64 + "x y", " ".join("w%d" % (k % 100) for k in range(300))]
    words, offsets = quality.padded(texts, quality._lang_hash(["en"] * len(texts)))
    plain = [[*t.lower().split(), "</s>"] for t in texts]
    want = [sum(len(set(w[i:i + 64])) for i in range(0, len(w), 64)) for w in plain]
    assert quality.distinct_words(words, offsets).tolist() == want
    assert quality.distinct_words(*quality.padded([], np.zeros(0, np.uint64))).tolist() == []


def test_repetition_is_rejected(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = F.col("doc_id") % 2 == 0
    made = docs.where("doc_id < 200 and lang = 'en'").withColumns({"doc_id": F.col("doc_id") + 10**8, "text": F.concat(F.repeat(F.lit("The for "), 300), F.substring("text", 1, 40))})
    found = quality.scored(docs.unionByName(made), labels.where("quality = 1").where(~held_out)).join(labels.where(held_out), "doc_id", "left").where("quality is not null or doc_id >= 100000000")
    rows = found.select("doc_id", "quality", "kept").collect()
    share = lambda q: np.mean([r["kept"] for r in rows if r["quality"] == q])
    assert share(1) > 0.93 and share(0) < 0.15
    repeated = [r["kept"] for r in rows if r["doc_id"] >= 10**8]
    assert repeated and not any(repeated)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, sf_dir, empty):
    docs = table(spark, sf_dir, "documents")
    if empty:
        docs = docs.where("false")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "best-fit packing":
            ids = {r["doc_id"] for r in out.collect()}
            assert ids == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns and out.count() <= before
        docs = stored(out, "test")
        before = docs.count()
    if not empty:
        texts = [r["text"] for r in docs.select("text").collect() if r["text"]]
        assert len(texts) > 20
