"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

All trusted documents are used: one half, drawn by id, gives trigram counts, the other the thresholds. Continuation
counts, discounts and back-off weights are groupings of them. Each stored n-gram then has one number, such that the log
probability of a text is the sum of the numbers of its words, bigrams and trigrams that are stored: a word carries its own
probability and its weight as a context, a bigram or trigram the gain over what the shorter ones say. So
a text is scored by a join of its n-gram counts with the model, cut into shards by hash. A bit filter of fixed size tells a task which n-grams
can be stored, so the others, which add nothing, don't move.

Disk is what limits this, so no step moves everything: trigrams are counted in passes by context, weighed in parts by their last two words, and texts are scored
in waves; what a step has moved, and parts that no later step reads, are removed as it ends. The model is written once, packed, in a bucket per shard, so that
waves read it without moving it. Texts ask for each n-gram once per batch, with the list of those that hold it.

The mean log loss is drawn towards the language's by PRIOR_TOKENS tokens, as short texts say little. A document is rejected above the
QUANTILE of those trusted documents of its language that the model was not trained on. The mean hides repetition, as frequent words are
likely; so a document is also rejected below their 1 - QUANTILE of the share of words that are new within a window of WINDOW words,
drawn to the language's share alike. Together the two cuts reject at most 2 * (1 - QUANTILE) of these trusted documents.

Defined cases: a null or empty text has no words and the language's mean loss; a null language is one of its own; documents of a
language with less than two trusted documents (one to learn from, one to set the threshold) are kept, with a null threshold; rows with equal text and language get equal scores; without any
trusted text everything is kept; an empty table gives no rows; further columns are kept by `keep_good` and ignored by `scored`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import U, combine, discard, in_buckets, in_parts, mix, slices, stored, text_key, text_of, word_hashes

TRAIN_PER_LANG, TRAIN_DOCS, LANG_FLOOR = 300, 1000, 100
QUANTILE, PRIOR_TOKENS, SHARDS = 0.99, 30, 16
#: Words within which a repeated one counts: a share over whole texts would fall with their length.
WINDOW = 64
#: Trigrams and bigrams are weighed in up to PARTS parts, one for each PART_BYTES of counted text, and counted in as many passes, up to PASSES; texts are asked in up to WAVES waves, one for each
#: WAVE_BYTES, and more if one would have over SLICE_BYTES. What is on disk at once follows from these.
PARTS, PART_BYTES, PASSES = 8, 2 << 20, 2
WAVES, WAVE_BYTES, SLICE_BYTES = 4, 16 << 20, 4 << 30
#: Counted text for each shard beyond the SHARDS that there are at least. Numbers of shards are powers of two.
SHARD_BYTES, MOST_SHARDS = 32 << 20, 1024
#: Tasks that deal the contexts out to the parts.
SCAN_TASKS = 48
#: Stored n-grams that are sorted and packed together.
BLOCK_KEYS = 1 << 18
FILTER_BITS = 27
#: Bytes of a key that are stored and move: with the shard 52 bits, so of 50 million stored n-grams none is expected to share a key with another.
_KEY_BYTES = 6
_BEGIN, _END = U(0x5D0C3A1B2E4F6071), U(0x1F3E5D7C9BAA8866)
_OF_CONTEXT = ["total", "once", "twice", "all"]
_KINDS = np.array([0x11, 0x22, 0x33], np.uint64) * U(0x9E3779B97F4A7C15)


def _language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("\x00null"))


# ---- n-grams of texts -----------------------------------------------------------------------------------------

def padded(texts: list[str], langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with two begin marks and one end mark per text, mixed with the language; and the offsets."""
    words, offsets = word_hashes(texts)
    n = np.diff(offsets) + 3
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(n) else 0, np.uint64)
    starts = ends - n
    inner = np.ones(len(out), bool)
    inner[starts], inner[starts + 1], inner[ends - 1] = False, False, False
    out[inner] = words
    out[starts], out[starts + 1], out[ends - 1] = _BEGIN, _BEGIN, _END
    return mix(out ^ np.repeat(langs, n)), np.concatenate(([0], ends))


def grams(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all scored n-grams, and the text of each: words from the second begin mark on, all bigrams and trigrams."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(words)) - offsets[:-1][text]
    one = at >= 1
    bi = np.flatnonzero(at[1:] >= 1)
    tri = np.flatnonzero(at[2:] >= 2)
    two = combine(words[bi], words[bi + 1])
    three = combine(combine(words[tri], words[tri + 1]), words[tri + 2])
    keys = np.concatenate((mix(words[one] + _KINDS[0]), mix(two + _KINDS[1]), mix(three + _KINDS[2])))
    return keys, np.concatenate((text[one], text[bi], text[tri]))


def distinct_words(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per padded text the number of words and end marks that are the first of their kind in their window of WINDOW."""
    n = np.diff(offsets) - 2
    windows = -(-n // WINDOW)
    starts, first = np.cumsum(n) - n, np.cumsum(windows) - windows
    at = np.arange(int(n.sum())) - np.repeat(starts, n)
    window = np.repeat(first, n) + at // WINDOW
    code = np.sort(window.astype(np.uint64) << U(40) | words[np.repeat(offsets[:-1] + 2, n) + at] >> U(24))
    code = code[np.concatenate(([True], code[1:] != code[:-1]))[:len(code)]]
    return np.bincount(np.repeat(np.arange(len(n)), windows)[(code >> U(40)).astype(np.int64)], minlength=len(n))


def _lang_hash(langs: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    for s in set(langs):
        h = 1469598103934665603
        for b in s.encode():
            h = (h ^ b) * 1099511628211 & (1 << 64) - 1
        known[s] = h
    return mix(np.array([known[s] for s in langs], np.uint64))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


# ---- the model ------------------------------------------------------------------------------------------------

def sample_level(wanted: list[tuple[float, int]]) -> float:
    """Documents a language may give, from (documents wanted, number of such languages): small languages give all they want."""
    left, langs = float(TRAIN_DOCS), sum(k for _, k in wanted)
    for m, k in sorted(wanted):
        if m * langs > left:
            return max(left / langs, LANG_FLOOR)
        left, langs = left - m * k, langs - k
    return TRAIN_PER_LANG


def training_ids(docs: DataFrame, trusted: DataFrame, bounded: bool = True) -> DataFrame:
    """Half of the documents whose id is in trusted (doc_id); if `bounded`, of each language in expectation the level of `sample_level` at most.
    Of each language with two documents or more the lowest draw is always in and the highest never."""
    ids = docs.select("doc_id", _language(F.col("lang")).alias("lang")).join(trusted.select("doc_id").distinct(), "doc_id").distinct()
    draw = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    ids = stored(ids.withColumn("draw", draw), "quality-trusted")
    at = F.struct("draw", "doc_id")
    sizes = stored(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last")), "quality-sizes")
    share = F.lit(0.5)
    if bounded:
        # at most 2 * TRAIN_PER_LANG different numbers
        wanted = sizes.groupBy(F.least(F.col("n") / 2, F.lit(float(TRAIN_PER_LANG))).alias("m")).count().collect()
        share = F.least(F.lit(float(sample_level([(r["m"], r["count"]) for r in wanted]))) / F.col("n"), share)
    drawn = (F.col("draw") < share) | (F.col("doc_id") == F.col("first.doc_id"))
    return stored(ids.join(sizes, "lang").where(drawn & (F.col("doc_id") != F.col("last.doc_id"))).select("doc_id"), "quality-sample")


def training_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """lang and text of the chosen documents."""
    return docs.select("doc_id", _language(F.col("lang")).alias("lang"), text_of("text").alias("text")).join(chosen, "doc_id", "left_semi")


def trigrams(texts: DataFrame, n_parts: int = 1) -> DataFrame:
    """lang, u, v, w, c: counted trigrams of word hashes, with the total of their context (u, v), the trigrams of it that were seen once and twice,
    and all of them (total, once, twice, all); first is told of one trigram of each context. Written in parts by their last two words."""
    passes, found = min(n_parts, PASSES), None
    for k in range(passes):
        found = in_parts(_counted(texts, k, passes).withColumn("part", _part("v", "w", n_parts)).sortWithinPartitions("part", "u", "v", "w"), "quality-trigrams", found)
    return found


def _counted(texts: DataFrame, nth: int, passes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            langs = batch.column("lang").to_pylist()
            words, offsets = padded(batch.column("text").to_pylist(), _lang_hash(langs))
            text = np.repeat(np.arange(len(langs)), np.diff(offsets))
            tri = np.flatnonzero(np.arange(len(words)) - offsets[:-1][text] >= 2)
            context = combine(words[tri - 2], words[tri - 1])
            own = (context >> U(40)) % U(passes) == U(nth)
            tri, context = tri[own], context[own]
            _, first, times = np.unique(combine(context, words[tri]), return_index=True, return_counts=True)
            tri = tri[first]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()).take(pa.array(text[tri])), _long(words[tri - 2]), _long(words[tri - 1]), _long(words[tri]),
                                              pa.array(times)], names=["lang", "u", "v", "w", "c"])

    found = texts.select("lang", "text").mapInArrow(run, "lang string, u long, v long, w long, c long")
    # one shuffle, by context, serves the counts and the sums of contexts
    counted = found.repartition("u", "v").groupBy("lang", "u", "v", "w").agg(F.sum("c").alias("c"))
    of = Window.partitionBy("u", "v")
    c = F.col("c")
    return counted.select("*", F.sum(c).over(of).alias("total"), F.sum((c == 1).cast("long")).over(of).alias("once"),
                          F.sum((c == 2).cast("long")).over(of).alias("twice"), F.count(c).over(of).alias("all"),
                          (F.col("w") == F.min("w").over(of)).alias("first"))


def _part(a: str, b: str, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(n_parts)).cast("int")


def pairs_of(tri: DataFrame, n_parts: int = 1) -> DataFrame:
    """lang, a, b of every bigram, n: the different words before it, and what `trigrams` tells of it as a context; n or total is 0 if it is none.
    Made part after part, so that a part of it is moved at once."""
    last = tri.select("lang", F.col("v").alias("a"), F.col("w").alias("b"), F.lit(1).alias("n"), *[F.lit(0).cast("long").alias(x) for x in _OF_CONTEXT], "part")
    context = tri.where("first").select("lang", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(0).alias("n"), *_OF_CONTEXT, _part("u", "v", n_parts).alias("part"))
    # a scan of many small files has a task for each few of them; each task writes every part
    context = in_parts(context.coalesce(SCAN_TASKS).sortWithinPartitions("part", "a", "b"), "quality-contexts")
    found = None
    for k in range(n_parts):
        both = last.where(F.col("part") == k).unionByName(context.where(F.col("part") == k))
        both = both.groupBy("lang", "a", "b").agg(F.sum("n").alias("n"), *[F.max(x).alias(x) for x in _OF_CONTEXT]).withColumn("part", F.lit(k))
        found = in_parts(both.sortWithinPartitions("a", "b"), "quality-pairs", found)
        discard(context, k)
    return found


def discounts(counted: DataFrame) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    row = counted.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [row[k] or 0 for k in range(4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for k in range(1, 4):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5
        out.append(min(max(d, 0.1), k - 0.1))
    return out


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _left(d: list[float]) -> Column:
    """What the discounts of a context's n-grams come to."""
    return d[0] * F.col("once") + d[1] * F.col("twice") + d[2] * (F.col("all") - F.col("once") - F.col("twice"))


def _packed_model(shards: int):
    """Of rows in the order of their bigram, the bigram's own first: the keys and numbers of all n-grams, packed by shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = np.nan, []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            u, a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("u", "a", "b"))
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            lower = np.append(last, x)[np.maximum.accumulate(np.where(kind == 2, np.arange(1, len(x) + 1), 0))]
            last = lower[-1] if len(lower) else last
            two = combine(a, b)
            keys = np.where(kind == 1, mix(a + _KINDS[0]), np.where(kind == 2, mix(two + _KINDS[1]), mix(combine(combine(u, a), b) + _KINDS[2])))
            values = np.where(kind == 3, np.log1p(np.where(kind == 3, x, 0.0) / np.where(kind == 3, lower, 1.0)), y)
            held.append((keys, values))
            if sum(len(k) for k, _ in held) >= BLOCK_KEYS:
                yield _block(held, shards)
                held = []
        if held:
            yield _block(held, shards)

    return run


def _block(held: list[tuple[np.ndarray, np.ndarray]], shards: int) -> pa.RecordBatch:
    keys, values = (np.concatenate(x) for x in zip(*held))
    keys = _coded(keys, shards)
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    group, starts = np.unique(keys >> U(8 * _KEY_BYTES), return_index=True)
    ends = np.append(starts[1:], len(keys))
    return pa.RecordBatch.from_arrays(
        [pa.array(group.astype(np.int32)), pa.array(ends - starts), pa.array([squeezed(_steps(_low(keys[i:j]))) for i, j in zip(starts, ends)], pa.binary()),
         pa.array([squeezed(values[i:j]) for i, j in zip(starts, ends)], pa.binary())], names=["shard", "n", "keys", "numbers"])


def _coded(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from the highest bits of a key, above the low bits that are kept of it; `shards` is a power of two, 2 at least."""
    return keys >> U(65 - shards.bit_length()) << U(8 * _KEY_BYTES) | _low(keys)


def _low(keys: np.ndarray) -> np.ndarray:
    return keys & U((1 << 8 * _KEY_BYTES) - 1)


def _steps(x: np.ndarray) -> np.ndarray:
    """What each number adds to the one before, the first to 0; modulo 2**64, so any order is kept."""
    return np.diff(x, prepend=U(0))


def squeezed(x: np.ndarray) -> bytes:
    """An array as compressed bytes, all first bytes before all second ones."""
    x = np.ascontiguousarray(x)
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unsqueezed(cell: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    data = pa.decompress(cell, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def fitted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model, (shard, n, keys, numbers) with n stored n-grams a row, and per language the loss of an unknown word (lang, unknown)."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n_parts, shards = min(PARTS, 1 + total // PART_BYTES), min(max(SHARDS, 1 << (total // SHARD_BYTES).bit_length()), MOST_SHARDS)
    tri = trigrams(texts, n_parts)
    pairs = pairs_of(tri, n_parts)
    seen = pairs.where("n > 0")
    uni = stored(seen.groupBy("lang", F.col("b").alias("w")).agg(F.count(F.lit(1)).alias("c")), "quality-words")
    d3, d2, d1 = discounts(tri), discounts(seen.select(F.col("n").alias("c"))), discounts(uni)
    langs = uni.groupBy("lang").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("words"), F.sum(_discount(F.col("c"), d1)).alias("left"))
    langs = stored(langs.select("lang", "all", (F.col("left") / F.col("all") / (F.col("words") + 1)).alias("p0")), "quality-langs")
    c, n = F.col("c"), F.col("n")
    p1 = uni.join(langs, "lang").select("w", ((c - _discount(c, d1)) / F.col("all") + F.col("p0")).alias("p1"), "p0")
    ctx1 = seen.groupBy(F.col("a").alias("w")).agg(F.sum("n").alias("total1"), (F.sum(_discount(n, d2)) / F.sum("n")).alias("back1"))
    words = stored(p1.join(ctx1, "w", "full"), "quality-weights")
    none = F.lit(0).cast("long")
    rows = words.select(F.lit(1).alias("kind"), none.alias("u"), F.col("w").alias("a"), none.alias("b"), F.lit(0.0).alias("x"),
                        (F.coalesce(F.log(F.col("p1") / F.col("p0")), F.lit(0.0)) + F.coalesce(F.log("back1"), F.lit(0.0))).alias("y"))
    model = by_shard_stored(rows, shards)
    for k in range(n_parts):
        # each bigram's probability, and the weight that it leaves as a context
        two = pairs.where(F.col("part") == k).join(words.select(F.col("w").alias("a"), "total1", "back1"), "a", "left")
        two = two.join(words.select(F.col("w").alias("b"), "p1"), "b", "left")
        p2 = F.when(n > 0, (n - _discount(n, d2)) / F.col("total1") + F.col("back1") * F.col("p1"))
        own = F.when(n > 0, F.log(p2 / F.col("back1") / F.col("p1"))).otherwise(0.0) + F.when(F.col("total") > 0, F.log(_left(d3) / F.col("total"))).otherwise(0.0)
        two = two.select(F.lit(2).alias("kind"), none.alias("u"), "a", "b", F.coalesce(p2, F.lit(1.0)).alias("x"), own.alias("y"))
        three = tri.where(F.col("part") == k).select(F.lit(3).alias("kind"), "u", F.col("v").alias("a"), F.col("w").alias("b"),
                                                     ((c - _discount(c, d3)) / _left(d3)).alias("x"), F.lit(0.0).alias("y"))
        model = by_shard_stored(two.unionByName(three).repartition("a", "b").sortWithinPartitions("a", "b", "kind"), shards, model)
        discard(tri, k)
        discard(pairs, k)
    return model, langs.select("lang", F.log("p0").alias("unknown"))


def by_shard_stored(rows: DataFrame, shards: int, table: DataFrame | None = None) -> DataFrame:
    packed = rows.mapInArrow(_packed_model(shards), "shard int, n long, keys binary, numbers binary")
    return in_buckets(packed.repartition(shards, "shard"), "quality_model", shards, "shard", table)


def _probes(coded: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a key, both in its shard's share of the filter: the lowest and the highest that are kept of it."""
    width = FILTER_BITS + 1 - shards.bit_length()
    base, low = (coded >> U(8 * _KEY_BYTES)) << U(width), _low(coded)
    return (base + (low & U((1 << width) - 1))).astype(np.int64), (base + (low >> U(8 * _KEY_BYTES - width))).astype(np.int64)


def key_filter(model: DataFrame, shards: int) -> np.ndarray:
    """A bit filter of 2**FILTER_BITS bits of the model's keys, a share of it for each shard: 16 MB whatever the input; with a larger model it lets more
    n-grams pass that are not stored."""
    own = (1 << FILTER_BITS) // shards

    def run(key, part):
        bits, shard = np.zeros(own, bool), key[0].as_py()
        for cell, n in zip(part["keys"].to_pylist(), part["n"].to_pylist()):
            for at in _probes(np.cumsum(unsqueezed(cell, n, np.uint64)) | U(shard << 8 * _KEY_BYTES), shards):
                bits[at - shard * own] = True
        return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros((shards, own // 8), np.uint8)
    for row in model.select("shard", "n", "keys").groupBy("shard").applyInArrow(run, "shard int, bits binary").toLocalIterator():
        out[row["shard"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


# ---- scores ---------------------------------------------------------------------------------------------------

_PACKED = "shard int, sizes binary, texts binary, tokens binary, distinct binary, steps binary, times binary, who binary"


def _asked(texts: DataFrame, bits, shards: int) -> DataFrame:
    """The texts' n-grams that can be stored, packed by shard: each n-gram of some texts once, with those of them that hold it and how often.
    The numbers of tokens and of distinct words go with a text's first shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in slices(batches, "text"):
            first = np.unique(batch.column("key").to_numpy(), return_index=True)[1]
            batch = batch.take(pa.array(np.sort(first)))  # copies score alike
            key = batch.column("key").to_numpy()
            words, offsets = padded(batch.column("text").to_pylist(), _lang_hash(batch.column("lang").to_pylist()))
            keys, text = grams(words, offsets)
            keys = _coded(keys, shards)
            a, b = _probes(keys, shards)
            hit = ((held[a >> 3] >> (a & 7).astype(np.uint8)) & (held[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
            keys, text = keys[hit], text[hit]
            if not len(keys):
                continue
            order = np.lexsort((text, keys))
            keys, text = keys[order], text[order]
            new = np.concatenate(([True], np.diff(keys) != 0))
            at = np.flatnonzero(new | np.concatenate(([True], np.diff(text) != 0)))
            times = np.diff(np.append(at, len(keys)))
            keys, text, new = keys[at], text[at], new[at]
            groups, starts = np.unique(keys >> U(8 * _KEY_BYTES), return_index=True)
            tokens, distinct = np.diff(offsets) - 2, distinct_words(words, offsets)
            rows, told = {c: [] for c in ("sizes", "texts", "tokens", "distinct", "steps", "times", "who")}, np.zeros(len(key), bool)
            for i, j in zip(starts, np.append(starts[1:], len(keys))):
                here, who = np.unique(text[i:j], return_inverse=True)
                one = np.flatnonzero(new[i:j])
                # per n-gram the step of its key; per pair of n-gram and text the step from the text before, from 0 with a new n-gram
                step = np.diff(who, prepend=0) + 1
                step[one] = who[one] + 1
                step[one] *= -1  # the sign tells a new n-gram
                rows["sizes"].append(np.array([len(here), len(one), j - i], np.int64).tobytes())
                rows["texts"].append(squeezed(key[here]))
                for name, x in (("tokens", tokens), ("distinct", distinct)):
                    rows[name].append(squeezed(np.where(told[here], 0, x[here]).astype(np.int64)))
                told[here] = True
                rows["steps"].append(squeezed(_steps(_low(keys[i:j][one]))))
                rows["times"].append(squeezed(times[i:j].astype(np.int64)))
                rows["who"].append(squeezed(step.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(groups.astype(np.int32)), *[pa.array(x, pa.binary()) for x in rows.values()]], names=["shard", *rows])

    return texts.mapInArrow(run, _PACKED)


def _summed(key, asked, model):
    """Partial log probabilities of texts under one shard of the model."""
    stored_keys = [np.cumsum(unsqueezed(cell, n, np.uint64)) for cell, n in zip(model["keys"].to_pylist(), model["n"].to_pylist())]
    stored_keys = np.concatenate(stored_keys) if stored_keys else np.zeros(0, np.uint64)
    values = [unsqueezed(cell, n, np.float64) for cell, n in zip(model["numbers"].to_pylist(), model["n"].to_pylist())]
    order = np.argsort(stored_keys)
    stored_keys, values = stored_keys[order], np.concatenate(values)[order] if values else np.zeros(0)
    found = []
    for row in asked.to_pylist():
        n_texts, n_keys, n = np.frombuffer(row["sizes"], np.int64)
        keys, step = np.cumsum(unsqueezed(row["steps"], n_keys, np.uint64)), unsqueezed(row["who"], n, np.int32).astype(np.int64)
        new = step < 0
        nth = np.cumsum(new) - 1
        # running sums, less what they were at the n-gram's first text
        sums = np.cumsum(np.where(new, 0, step - 1))
        who = sums - sums[new][nth] - step[new][nth] - 1
        at = np.minimum(np.searchsorted(stored_keys, keys), max(len(stored_keys) - 1, 0))
        value = np.where(stored_keys[at] == keys, values[at], 0.0) if len(stored_keys) else np.zeros(len(keys))
        part = np.bincount(who, value[nth] * unsqueezed(row["times"], n, np.int64), minlength=n_texts)
        found.append((unsqueezed(row["texts"], n_texts, np.int64), part, unsqueezed(row["tokens"], n_texts, np.int64), unsqueezed(row["distinct"], n_texts, np.int64)))
    texts, parts, tokens, distinct = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
    # a text that came from several tasks counts once
    text, first, which = np.unique(texts, return_index=True, return_inverse=True)
    most = lambda x: np.maximum.reduceat(x[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which)) - np.bincount(which)) if len(text) else x
    return pa.table({"key": pa.array(text), "part": pa.array(parts[first]), "tokens": pa.array(most(tokens)), "distinct": pa.array(most(distinct))})


def log_scores(texts: DataFrame, model: DataFrame, waves: int = 1) -> DataFrame:
    """(key, gain, tokens, distinct) of texts (key, lang, text), stored: the log probability beyond that of unknown words only.
    The texts are asked in waves, so that a part of their n-grams is moved at once; the model, kept in a bucket per shard, isn't."""
    shards = model.buckets
    bits = texts.sparkSession.sparkContext.broadcast(key_filter(model, shards))
    wave = F.pmod(F.xxhash64("lang", "text"), F.lit(waves))
    found = None
    for k in range(waves):
        asked = _asked(texts.where(wave == k), bits, shards)
        parts = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(_summed, "key long, part double, tokens long, distinct long")
        summed = parts.groupBy("key").agg(F.sum("part").alias("gain"), F.max("tokens").alias("tokens"), F.max("distinct").alias("distinct"))
        found = in_parts(summed.withColumn("part", F.lit(k)), "quality-scores", found)
    bits.destroy()
    return found.drop("part")


def scored(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, prior: int = PRIOR_TOKENS) -> DataFrame:
    """One row per document (doc_id, lang, text): doc_id, lang, text_key, tokens, perplexity, threshold, distinct_share, least_share, kept."""
    rows = docs.select("doc_id", "lang", text_of("text").alias("text"), _language(F.col("lang")).alias("l"))
    chosen = training_ids(docs, trusted, bounded=False)
    key = text_key(F.col("l"), F.col("text"))
    keys = stored(rows.select("doc_id", "lang", "l", key.alias("key"), F.octet_length("text").cast("long").alias("bytes")), "quality-keys")
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    model, langs = fitted(training_texts(docs, chosen))
    found = log_scores(rows.select(key.alias("key"), F.col("l").alias("lang"), "text"), model, max(min(WAVES, 1 + total // WAVE_BYTES), -(-total // SLICE_BYTES)))
    discard(model)
    losses = keys.join(found, "key", "left").join(langs.withColumnRenamed("lang", "l"), "l", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    losses = losses.withColumn("loss", -(F.coalesce("gain", F.lit(0.0)) + tokens * F.col("unknown")))
    losses = stored(losses.select("doc_id", "lang", "l", "key", tokens.cast("long").alias("tokens"), F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
                                  "loss", "unknown"), "quality-losses")
    # the trusted documents that the model has not seen, of languages that it has
    good = losses.where("unknown is not null").join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").join(chosen, "doc_id", "left_anti")
    means = good.groupBy("l").agg((F.sum("loss") / F.sum("tokens")).alias("mean"), (F.sum("distinct") / F.sum("tokens")).alias("usual"))
    shrunk = (F.col("loss") + prior * F.col("mean")) / (F.col("tokens") + prior)
    share = (F.col("distinct") + prior * F.col("usual")) / (F.col("tokens") + prior)
    # one row per language with trusted text
    cuts = good.join(means, "l").groupBy("l").agg(F.percentile_approx(shrunk, quantile, 10_000).alias("cut"),
                                                      F.percentile_approx(share, 1 - quantile, 10_000).alias("least"))
    out = losses.join(means, "l", "left").join(cuts, "l", "left")
    kept = F.coalesce((shrunk <= F.col("cut")) & (share >= F.col("least")), F.lit(True))
    return out.select("doc_id", "lang", F.col("key").alias("text_key"), "tokens", F.exp(shrunk).alias("perplexity"), F.exp("cut").alias("threshold"),
                      share.alias("distinct_share"), F.col("least").alias("least_share"), kept.alias("kept"))


def keep_good(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns. Rejected texts are few: they are told by key."""
    rejected = scored(docs, trusted, quantile).where(~F.col("kept")).select(F.col("text_key").alias("__k")).distinct()
    keyed = docs.withColumn("__key", text_key(_language(F.col("lang")), text_of("text")))
    return keyed.join(rejected, F.col("__key") == F.col("__k"), "left_anti").select(*docs.columns)
