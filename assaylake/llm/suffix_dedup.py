"""Removal of repeated byte strings by a distributed difference-cover suffix sort.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else in the corpus. Suffixes are brought together and
sorted in three steps, each exact:

1. Winnowing. Each window of LENGTH bytes is named by its smallest hash of GRAM bytes (the leftmost on ties), its anchor. Equal
   windows have equal anchors at equal distance, so only windows whose anchor hash occurs twice can repeat. Copies of a whole
   text are counted once before.
2. Those windows are cut into segments of up to SPAN windows that share their anchor and lie within one range of distances.
   All windows of a range contain the same core around the anchor, so equal windows meet under the hash of their core. Segments equal as a whole
   are counted; a segment that occurs twice repeats in all its windows.
3. Where different segments share a core, their suffixes are sorted by the difference-cover algorithm: triples at the
   positions 1 and 2 mod 3 are sorted and named, the names sorted by recursion until they cover LENGTH bytes, the suffixes at
   positions 0 mod 3 merged in, and neighbours with an equal prefix of LENGTH bytes marked.

A core shared by more than HOT_SEGMENTS segments is not sorted in one task: its windows are counted by their hash, combined before
the shuffle. Texts are told apart by 128 bits of their SHA-256, segments by core and content hash together (128 bits); anchors and windows of hot
cores, within a core, by 64.

Defined cases: a null text is empty; a text shorter than LENGTH stays; rows with equal texts repeat each other; a null id
is a document of its own; the cut may leave bytes that are no UTF-8, which `cut_text` drops; an empty table gives no rows; further columns are
kept by `cut_text` and ignored by `repeated_spans`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U, byte_lengths, combine, mix, offsets_and_bytes, slices, stored, text_digest, text_of

LENGTH, GRAM, SPAN = 400, 64, 113
HOT_SEGMENTS = 4000
#: Segments that share a core and are sorted in one task, on average.
TASK_BYTES = 2 << 20


# ---- hashes of all substrings of one length ---------------------------------------------------------------

def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of each substring of `length` bytes, by doubling."""
    h, out, at, step = mix(data.astype(np.uint64) + U(1)), None, 0, 1
    count = len(data) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if length & step:
            part = h[at:at + count]
            out = part.copy() if out is None else _join(out, part)
            at += step
        if 2 * step > length:
            return mix(out)
        h, step = _join(h[:-step], h[step:]), 2 * step


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = left * U(0xC2B2AE3D27D4EB4F)
    out += right ^ (right >> U(31))
    out *= U(0xD6E8FEB86659FD93)
    return out


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor position, and the gram hashes of all positions."""
    grams = rolling(data, gram)
    width = length - gram + 1
    count = len(data) - length + 1
    # hash above, position below: the minimum is the leftmost smallest hash; 40 bits of hash and 24 of position
    best = None
    if len(data) >= 1 << 24:
        return _anchors_of_long(grams, width, count), grams
    keyed = (grams & U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    step, at = 1, 0
    while True:
        if width & step:
            part = keyed[at:at + count]
            best = part.copy() if best is None else np.minimum(best, part)
            at += step
        if 2 * step > width:
            break
        keyed, step = np.minimum(keyed[:-step], keyed[step:]), 2 * step
    return (best & U(0xFFFFFF)).astype(np.int64), grams


def _anchors_of_long(grams: np.ndarray, width: int, count: int) -> np.ndarray:
    """The same for a text of 16 MB or more, part by part."""
    out, part = np.empty(count, np.int64), 1 << 23
    for start in range(0, count, part):
        n = min(part, count - start)
        keyed = (grams[start:start + n + width - 1] & U(0xFFFFFFFFFF000000)) | np.arange(n + width - 1, dtype=np.uint64)
        best, step, at = None, 1, 0
        while True:
            if width & step:
                piece = keyed[at:at + n]
                best = piece.copy() if best is None else np.minimum(best, piece)
                at += step
            if 2 * step > width:
                break
            keyed, step = np.minimum(keyed[:-step], keyed[step:]), 2 * step
        out[start:start + n] = (best & U(0xFFFFFF)).astype(np.int64) + start
    return out


# ---- difference-cover suffix sort ---------------------------------------------------------------------------

def suffix_ranks(text: np.ndarray, covered: int, enough: int) -> np.ndarray:
    """Rank of each suffix of an array of names (1 or more). A name stands for `covered` bytes; once triples of names cover `enough`
    bytes, equal triples are ranked by position."""
    n = len(text)
    if n < 3:
        order = np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
        ranks = np.empty(n, np.int64)
        ranks[order] = np.arange(n)
        return ranks
    s = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    # sort and name the triples at 1 and 2 mod 3
    one, two = np.arange(1, n + 2, 3), np.arange(2, n + 2, 3)
    one, two = one[one < n + (n % 3 == 1)], two[two < n]  # a dummy triple keeps the halves apart when n = 1 mod 3
    sample = np.concatenate((one, two))
    names, order, distinct = _named(s, sample)
    if distinct == len(sample):
        rank12 = names
    elif 3 * covered >= enough:
        rank12 = np.empty(len(sample), np.int64)
        rank12[order] = np.arange(1, len(sample) + 1)
    else:
        rank12 = suffix_ranks(names, 3 * covered, enough) + 1
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = rank12
    # merge the suffixes at 0 mod 3: each compares with those at 1 mod 3 by one name, with those at 2 mod 3 by two
    top = int(s.max()) + 1
    size = len(sample) + 2
    zero = np.arange(0, n, 3)
    sorted12 = sample[np.argsort(rank12, kind="stable")]
    sorted12 = sorted12[sorted12 < n]
    wide = top * top * size < 1 << 62
    by_one = lambda i: s[i] * size + rank[i + 1]
    zero = zero[np.argsort(by_one(zero), kind="stable")]
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    less1 = np.searchsorted(by_one(ones), by_one(zero))
    if wide:
        by_two = lambda i: (s[i] * top + s[i + 1]) * size + rank[i + 2]
        less2 = np.searchsorted(by_two(twos), by_two(zero))
    else:  # pairs of names are renamed first, so that the key fits
        pairs = np.concatenate((s[zero] * top + s[zero + 1], s[twos] * top + s[twos + 1]))
        renamed = np.unique(pairs, return_inverse=True)[1]
        left, right = renamed[len(zero):] * size + rank[twos + 2], renamed[:len(zero)] * size + rank[zero + 2]
        less2 = np.searchsorted(left, right)
    ranks = np.empty(n, np.int64)
    # suffixes that agree beyond `enough` bytes have an arbitrary order, so the counts may step back among them
    at_zero = np.arange(len(zero)) + np.maximum.accumulate(less1 + less2)
    ranks[zero] = at_zero
    free = np.ones(n, bool)
    free[at_zero] = False
    ranks[sorted12] = np.flatnonzero(free)
    return ranks


def _named(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Names (from 1, in order) of the triples at some positions, their order, the number of different ones."""
    top = int(s.max()) + 1
    s = np.concatenate((s, np.zeros(3, np.int64)))
    if top < 1 << 21:
        key = (s[at] * top + s[at + 1]) * top + s[at + 2]
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))
    else:
        order = np.lexsort((s[at + 2], s[at + 1], s[at]))
        rows = np.stack((s[at], s[at + 1], s[at + 2]))[:, order]
        new = np.concatenate(([True], (np.diff(rows) != 0).any(axis=0)))
    names = np.empty(len(at), np.int64)
    names[order] = np.cumsum(new)
    return names, order, int(new.sum())


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows equal a window that starts elsewhere in the segments."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    # a separator that is smaller than any byte follows each segment
    text = np.zeros(len(data) + len(segments), np.int64)
    inside = np.ones(len(text), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    text[inside] = data.astype(np.int64) + 2
    text[~inside] = 1
    ranks = suffix_ranks(text, 1, length)
    starts = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - length + 1
    windows = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    order = windows[np.argsort(ranks[windows], kind="stable")]
    equal = np.zeros(len(order), bool)
    view = np.lib.stride_tricks.sliding_window_view(text.astype(np.uint16), length)
    for k in range(0, len(order) - 1, 4096):  # compare adjacent prefixes
        to = min(k + 4096, len(order) - 1)
        equal[k + 1:to + 1] = (view[order[k:to]] == view[order[k + 1:to + 1]]).all(axis=1)
    marked = equal.copy()
    marked[:-1] |= equal[1:]
    flags = np.zeros(len(text), bool)
    flags[order[marked]] = True
    return [flags[s:s + c] for s, c in zip(starts, counts)]


# ---- segments of a document -----------------------------------------------------------------------------------

def _cut(data: np.ndarray, anchor: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of wanted windows with one anchor and one range of distances: first window, number, range."""
    at = np.flatnonzero(wanted)
    reach = (anchor[at] - at) // SPAN
    new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(anchor[at]) != 0) | (np.diff(reach) != 0)))
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), reach[first]


def _segments(data: np.ndarray, repeated: np.ndarray, length: int):
    """Of one text: window starts, counts, core hashes, content hashes."""
    anchor, grams = anchors(data, length)
    used = np.unique(anchor)
    hit = used[np.isin(grams[used], repeated)]
    wanted = np.isin(anchor, hit)
    start, count, reach = _cut(data, anchor, wanted)
    if not len(start):
        return None
    a = anchor[start]
    # every window of the range holds the bytes from a - reach * SPAN to a - (reach + 1) * SPAN + 1 + length
    lo, hi = a - reach * SPAN, a - (reach + 1) * SPAN + 1 + length
    powers, sums = _prefix(data)
    core = combine(_range_hash(powers, sums, lo, hi), (reach + 1).astype(np.uint64))
    content = combine(_range_hash(powers, sums, start, start + count + length - 1), (a - start + 1).astype(np.uint64))
    return start, count, core, content


_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def _prefix(data: np.ndarray):
    powers = np.full(len(data) + 1, _BASE, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data.astype(np.uint64) + U(77)) * powers[:-1], out=sums[1:])
    down = np.full(len(data) + 1, _INVERSE, np.uint64)
    down[0] = 1
    np.cumprod(down, out=down)
    return down, sums


def _range_hash(down, sums, lo, hi):
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _window_hashes(text: bytes, length: int) -> np.ndarray:
    return rolling(np.frombuffer(text, np.uint8), length)


# ---- the operator ---------------------------------------------------------------------------------------------

def _candidates(texts: DataFrame, length: int) -> DataFrame:
    """(key, grams): the anchor hashes of each text that occur more than once; copies of a text count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            offsets, data = offsets_and_bytes(batch.column("data"))
            keys = batch.column("key").to_pylist()
            for k in range(batch.num_rows):
                anchor, grams = anchors(data[offsets[k]:offsets[k + 1]], length)
                got, count = np.unique(grams[np.unique(anchor)], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [_long(got), pa.array([keys[k]] * len(got), pa.binary()), pa.array(count.astype(np.int32))], names=["gram", "key", "n"])

    grams = texts.mapInArrow(_joined(run), "gram long, key binary, n int").groupBy("gram", "key").agg(F.max("n").alias("n"))
    grams = stored(grams, "suffix-anchors")
    twice = grams.groupBy("gram").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select(F.col("gram").alias("g"))
    found = grams.join(twice, F.col("gram") == F.col("g"))
    return found.groupBy("key").agg(F.collect_list("gram").alias("grams"))


def _joined(run, rows: int = 20_000):
    """Gathers the small batches of `run` into larger ones."""
    def gathered(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return gathered


def _cut_documents(texts: DataFrame, length: int) -> DataFrame:
    """Segments: key, first, count, core, content, and the bytes where a task meets the segment first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keys = batch.column("key").to_pylist()
            lists = batch.column("grams")
            for k, data in enumerate(batch.column("data").to_pylist()):
                wanted = np.asarray(lists[k].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                got = _segments(np.frombuffer(data, np.uint8), wanted, length)
                if got is None:
                    continue
                start, count, core, content = got
                cells = []
                if len(seen) > 200_000:
                    seen.clear()
                for s, c, name in zip(start.tolist(), count.tolist(), zip(core.tolist(), content.tolist())):
                    fresh = name not in seen
                    if fresh:
                        seen.add(name)
                    cells.append(data[s:s + c + length - 1] if fresh else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[k]] * len(start), pa.binary()), pa.array(start), pa.array(count.astype(np.int32)), _long(core), _long(content),
                     pa.array(cells, pa.binary())], names=["key", "first", "count", "core", "content", "data"])

    return texts.mapInArrow(_joined(run, 4000), "key binary, first long, count int, core long, content long, data binary")


def _sorted_cores(segments: DataFrame, length: int) -> DataFrame:
    """(core, content, flags) of the segments whose cores they share with others; packed bits per window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None

        def flush():
            table = pa.Table.from_batches(held)
            names = list(zip(table["core"].to_pylist(), table["content"].to_pylist()))
            data = table["data"].to_pylist()
            unique = dict(zip(names, data))
            flags = repeated_windows(list(unique.values()), length)
            held.clear()
            core, content = zip(*unique)
            return pa.RecordBatch.from_arrays(
                [pa.array(core, pa.int64()), pa.array(content, pa.int64()), pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())],
                names=["core", "content", "flags"])

        for batch in batches:
            cores = batch.column("core").to_numpy()
            ends = np.append(np.flatnonzero(np.diff(cores)) + 1, len(cores))
            sizes = np.concatenate(([0], np.cumsum(byte_lengths(batch.column("data")))))
            start = 0
            for end in ends:
                # a block is closed between cores only
                if cores[start] != last and size > TASK_BYTES:
                    yield flush()
                    size = 0
                held.append(batch.slice(start, end - start))
                size += int(sizes[end] - sizes[start])
                last, start = cores[end - 1], end
        if held:
            yield flush()

    total = segments.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    n = max(segments.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    dealt = segments.select("core", "content", "data").repartition(int(n), "core").sortWithinPartitions("core", "content")
    return dealt.mapInArrow(run, "core long, content long, flags binary")


def _hot_cores(segments: DataFrame, length: int) -> DataFrame:
    """The same for cores with very many segments: windows are counted by hash."""
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [_window_hashes(d, length) for d in batch.column("data").to_pylist()]
            n = [len(h) for h in each]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("core").to_numpy(), n)), pa.array(np.repeat(batch.column("content").to_numpy(), n)),
                 pa.array(np.concatenate([np.arange(x) for x in n]).astype(np.int32)), _long(np.concatenate(each))],
                names=["core", "content", "at", "window"])

    windows = segments.select("core", "content", "data").mapInArrow(hashes, "core long, content long, at int, window long")
    twice = windows.groupBy("core", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("core").alias("c"), F.col("window").alias("w"))
    hit = windows.join(twice, (F.col("core") == F.col("c")) & (F.col("window") == F.col("w")))
    return hit.groupBy("core", "content").agg(F.collect_list("at").alias("hits"))


def _flagged(segments: DataFrame, length: int) -> DataFrame:
    """Removed byte ranges of documents: (key, lo, hi), one row per segment with a repeated window."""
    counted = segments.groupBy("core", "content").agg(F.count(F.lit(1)).alias("n"), F.first("data", ignorenulls=True).alias("data"))
    counted = stored(counted, "suffix-segments")
    cores = counted.groupBy("core").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    mixed = counted.join(cores.withColumnRenamed("core", "c"), F.col("core") == F.col("c")).drop("c")
    mixed = stored(mixed.select("core", "content", "n", "data", "different"), "suffix-mixed")
    sorted_ = _sorted_cores(mixed.where(F.col("different") <= HOT_SEGMENTS), length)
    hot = _hot_cores(mixed.where(F.col("different") > HOT_SEGMENTS), length)
    found = sorted_.withColumn("hits", F.lit(None).cast("array<int>")).unionByName(hot.withColumn("flags", F.lit(None).cast("binary")))
    found = found.where("hits IS NOT NULL OR flags IS NOT NULL")
    marks = (counted.where("n > 1").select("core", "content", F.lit(True).alias("whole"), F.lit(None).cast("binary").alias("flags"), F.lit(None).cast("array<int>").alias("hits"))
             .unionByName(found.withColumn("whole", F.lit(False))))
    marks = marks.groupBy("core", "content").agg(F.max("whole").alias("whole"), F.max("flags").alias("flags"), F.max("hits").alias("hits"))
    marks = stored(marks, "suffix-marks").withColumnsRenamed({"core": "c", "content": "t"})
    places = segments.select("key", "first", "count", "core", "content")
    return places.join(marks, (F.col("core") == F.col("c")) & (F.col("content") == F.col("t"))).select("key", "first", "count", "whole", "flags", "hits")


def _covered(size: int, places: list, length: int) -> np.ndarray:
    """Which bytes of a text go, from its marked segments."""
    change = np.zeros(size + 1, np.int64)
    for p in places:
        if p["whole"]:
            change[p["first"]] += 1
            change[p["first"] + p["count"] + length - 1] -= 1
            continue
        if p["flags"] is not None:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(p["flags"], np.uint8))[:p["count"]])
        else:
            at = np.array(sorted(p["hits"]), np.int64)
        np.add.at(change, at + p["first"], 1)
        np.add.at(change, at + p["first"] + length, -1)
    return np.cumsum(change[:-1]) > 0


def _cuts(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Of documents (doc_id, text, further columns): rows with __key, __bytes, __sha, copies (null for single texts) and all columns but the
    text; cut single texts (key, data, text, n_removed, n_spans)."""
    raw = text_of("text").cast("binary")
    key = text_digest(raw)
    rows = docs.select(*[c for c in docs.columns if c != "text"], F.octet_length(raw).cast("long").alias("__bytes"), key.alias("__key"), F.sha2(raw, 256).alias("__sha"))
    rows = stored(rows, "suffix-rows")
    heads = rows.where(F.col("__bytes") >= length).groupBy("__key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("head"))
    heads = stored(heads, "suffix-heads")
    texts = docs.select("doc_id", raw.alias("data"), key.alias("key")).where(F.octet_length("data") >= length)
    # the text of one row per group of copies is fetched by its id, so a hot text is moved once
    grams = stored(_candidates(texts.select("key", "data"), length), "suffix-grams").withColumnRenamed("key", "__key").join(heads, "__key")
    at = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("key") == F.col("__key"))
    chosen = texts.join(grams, at).select("key", "data", "grams", "copies").dropDuplicates(["key"])
    chosen = stored(chosen, "suffix-chosen")
    segments = stored(_cut_documents(chosen, length), "suffix-cut")
    places = _flagged(segments, length).groupBy(F.col("key").alias("p")).agg(F.collect_list(F.struct("first", "count", "whole", "flags", "hits")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, removed, spans = [], [], []
            for data, marks in zip(batch.column("data").to_pylist(), batch.column("places").to_pylist()):
                gone = _covered(len(data), marks, length)
                out.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(out, pa.binary()), pa.array([d.decode("utf-8", "ignore") for d in out]), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                names=["key", "data", "text", "n_removed", "n_spans"])

    # a text with copies goes as a whole
    cuts = chosen.where("copies = 1").select("key", "data").join(places, F.col("key") == F.col("p")).select("key", "data", "places")
    cuts = stored(cuts.mapInArrow(cut, "key binary, data binary, text string, n_removed long, n_spans long"), "suffix-cuts")
    return rows.join(heads.where("copies > 1").select("__key", "copies"), "__key", "left"), cuts


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, cuts = _cuts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), length)
    cuts = cuts.select(F.col("key").alias("k"), F.sha2("data", 256).alias("cut_sha"), "n_removed", "n_spans")
    out = rows.join(cuts, F.col("__key") == F.col("k"), "left")
    whole = F.col("copies").isNotNull()
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", F.col("__bytes").alias("n_bytes"),
                      F.when(whole, F.col("__bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(whole, nothing).otherwise(F.coalesce("cut_sha", "__sha")).alias("kept_sha256"))


def cut_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents (doc_id, text, n_chars and further columns) with repeated strings cut out of the text, n_chars counted anew."""
    _, cuts = _cuts(docs.select("doc_id", "text"), length)
    raw = text_of("text").cast("binary")
    large = docs.where(F.octet_length(raw) >= length)
    copies = large.groupBy(text_digest(raw).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", F.lit("").alias("new"))
    new = cuts.select(F.col("key").alias("k"), F.col("text").alias("new")).unionByName(copies)
    out = docs.withColumn("__key", text_digest(raw)).join(new, (F.col("__key") == F.col("k")) & (F.octet_length(raw) >= length), "left")
    changed = F.col("new").isNotNull()
    return out.withColumns({"text": F.when(changed, F.col("new")).otherwise(F.col("text")),
                            "n_chars": F.when(changed, F.length("new").cast("long")).otherwise(F.col("n_chars"))}).select(*docs.columns)
