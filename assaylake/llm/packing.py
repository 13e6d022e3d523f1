"""Packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised and cut into pieces of at most CAPACITY tokens. Full pieces are sequences of their own; the others are dealt at
random into shards of about SHARD_ITEMS pieces. ISLANDS populations evolve per shard, from fits of the pieces in random order: crossover injects whole
well-filled bins of one parent into another, removes the bins that hold the same pieces, and best-fits the displaced ones; mutation empties the worst
bins. After each epoch the elites of a shard's islands migrate to all of its islands; the best one wins. An island stops at the lower
bound, the tokens divided by the capacity, so a shard wastes less than a few sequences and there is one shard per SHARD_ITEMS pieces.

Defined cases: a null or empty text is its end token only; a text longer than the capacity fills whole sequences first;
repeated rows and null ids are pieces of their own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import array
import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import WORD_END, default_vocabulary
from .common import U, combine, mix, slices, stored, text_of

CAPACITY, END_ID = 4096, 1
SHARD_ITEMS, ISLANDS, EPOCHS = 8192, 2, 2
POPULATION, GENERATIONS = 6, 10
CACHE_CHUNKS = 500_000
#: ASCII marks that never join a word of letters before them.
MARKS = ".,;:!?%#*$&@+=~^_-/|)]}>\""
_CONTROL = re.compile("[\x1c-\x1f]")
#: Latin-1 letters in lower case, its blanks beyond ASCII as a blank.
_LOWER = bytes(32 if b in (0x85, 0xA0) else chr(b).lower().encode("latin-1")[0] for b in range(256))
_SOLID = np.array([not bytes([b]).isspace() for b in range(256)])
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a chunk that are compared as two words.
SHORT = 16
_ELITE = "shard long, island int, uids binary, lengths binary, bins binary, n_bins long, fitness double, generations int"


class ChunkIds:
    """Token ids by the tokenizers library, for chunks between blanks that are not known yet.

    No token crosses a blank, so the ids of a text are those of its chunks. A text of Latin-1 letters is lowered as a whole, as the library does letter by
    letter, and its chunks are bytes; numpy finds the different chunks of many such texts, so that only these are looked up. A new chunk of letters with marks
    behind it is its word and its marks; new words go to the library in one text, whose ids part at the tokens that end a word. Two generations of CACHE_CHUNKS
    chunks are kept.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ends = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.library.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.new: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters only."""
        if not words:
            return []
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        after = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(after) != len(words):  # a letter whose lower case holds a mark
            return self._chunks(words)
        ids = ids.tobytes()
        return [ids[a:b] for a, b in zip([0, *after], after)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(chunks, add_special_tokens=False)]

    def _find(self, missing: list[str | bytes]) -> None:
        """Adds the ids of new chunks."""
        new, old = self.new, self.old
        words, others = {}, {}  # the key of a chunk and its text
        chunks, lows, tails = [], [], []
        for c in missing:
            text = c if isinstance(c, str) else c.decode("latin-1")
            word = text.rstrip(MARKS)
            if not word.isalpha() or "İ" in word:  # its lower case ends in a mark, which joins those behind it
                others[c] = text
                continue
            low = word.lower() if isinstance(c, str) and (word.isascii() or max(word) < "\u0100") else word
            if low == text:
                words[c] = text
                continue
            key = low if isinstance(c, str) else c[:len(word)]
            if key not in new and key not in words:
                if key in old:
                    new[key] = old[key]
                else:
                    words[key] = low
            tail = c[len(word):]
            others[tail] = text[len(word):]
            chunks.append(c)
            lows.append(key)
            tails.append(tail)
        new.update(zip(words, self._words(list(words.values()))))
        new.update(zip(others, self._chunks(list(others.values()))))
        for c, low, tail in zip(chunks, lows, tails):
            new[c] = new[low] + new[tail]

    @staticmethod
    def _lowered(text: str) -> bytes | None:
        """A text of Latin-1 letters in lower case, None for any other; special tokens count as they are written."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if b"<|" in raw else raw.translate(_LOWER)

    def _learn(self, chunks) -> None:
        """Makes sure that the ids of all given chunks are in `new`."""
        fresh = set(chunks).difference(self.new)
        again = fresh & self.old.keys()
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        self._find(list(fresh - again))

    def _of_lowered(self, raws: list[bytes]) -> list[bytes]:
        """The ids of texts of bytes, each different chunk looked up once."""
        text = b" ".join(raws) + b" " * (SHORT + 1)  # two words can be read from any place
        data = np.frombuffer(text, np.uint8)
        starts, ends, group, firsts = different_chunks(data)
        chunks = [text[a:b] for a, b in zip(starts[firsts].tolist(), ends[firsts].tolist())]
        ids = list(map(self.new.get, chunks))
        unknown = [k for k, i in enumerate(ids) if i is None]
        self._learn([chunks[k] for k in unknown])
        for k in unknown:
            ids[k] = self.new[chunks[k]]
        held = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = held[group]
        before = np.concatenate(([0], np.cumsum(n)))
        at = np.arange(before[-1]) + np.repeat((np.cumsum(held) - held)[group] - before[:-1], n)
        out = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        begin = np.cumsum([0, *(len(r) + 1 for r in raws)])
        cuts = (4 * before[np.searchsorted(starts, begin)]).tolist()
        return [out[a:b] for a, b in itertools.pairwise(cuts)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words."""
        raws = [self._lowered(t) for t in texts]
        plain = iter(self._of_lowered([r for r in raws if r is not None]))
        # control characters part words for str.split only: such texts are one chunk
        split = [None if r is not None else [t] if _CONTROL.search(t) else t.split() for t, r in zip(texts, raws)]
        self._learn(itertools.chain.from_iterable(filter(None, split)))
        known = self.new.__getitem__
        out = [next(plain) if chunks is None else b"".join(map(known, chunks)) for chunks in split]
        if len(self.new) > CACHE_CHUNKS:
            self.old, self.new = self.new, {}
        return out


def different_chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks between blanks of bytes that end in SHORT + 1 blanks: starts, ends, the group of each, and one chunk of each group. A group's chunks are equal.

    Chunks meet by a hash of their first SHORT bytes and their size; longer ones are numbered beforehand. What a hash brings together is compared, and a
    chunk that differs from its group's first is a group of its own.
    """
    edges = np.flatnonzero(np.diff(_SOLID[data], prepend=False))
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    word = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    head = word[starts] & _FIRST[np.minimum(size, 8)]
    tail = word[starts + 8] & _FIRST[np.clip(size - 8, 0, 8)]
    numbers: dict[bytes, int] = {}
    for k in np.flatnonzero(size > SHORT).tolist():
        head[k] = numbers.setdefault(data[starts[k]:ends[k]].tobytes(), len(numbers))
        tail[k] = 0
    code = combine(head, tail) ^ mix(size.astype(U))
    order = np.argsort(code)
    new = np.concatenate(([True], np.diff(code[order]) != 0))[:len(order)]
    firsts = order[new]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    like = firsts[group]
    odd = np.flatnonzero((head != head[like]) | (tail != tail[like]) | (size != size[like]))
    group[odd] = len(firsts) + np.arange(len(odd))
    return starts, ends, group, np.append(firsts, odd)


_LIBRARIES: dict[str, ChunkIds] = {}


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LIBRARIES:
            _LIBRARIES[path] = ChunkIds(path)
        encode, end = _LIBRARIES[path], END_ID.to_bytes(4, "little")
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for d, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((d, k, at // 4, len(part) // 4, zlib.crc32(part)))
            d, k, at, n, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---- the algorithm on one shard: bins are lists of item numbers ------------------------------------------

class Bins(list):
    """A packing: lists of item numbers, and beside them how full each is."""

    def __init__(self, bins=(), fills=()):
        super().__init__(bins)
        self.fills = list(fills)


def filled(bins, lengths) -> Bins:
    return bins if isinstance(bins, Bins) else Bins(bins, [sum(map(lengths.__getitem__, b)) for b in bins])


def best_fit(bins, items, lengths, capacity: int) -> Bins:
    """Puts each item into the fullest bin that still takes it, or a new one."""
    bins = filled(bins, lengths)
    fills = bins.fills
    free = sorted(zip([capacity - f for f in fills], range(len(fills))))
    for i in items:
        n = lengths[i]
        at = bisect.bisect_left(free, (n, -1))
        if at == len(free):
            bins.append([i])
            fills.append(n)
            bisect.insort(free, (capacity - n, len(fills) - 1))
        else:
            room, k = free.pop(at)
            bins[k].append(i)
            fills[k] += n
            bisect.insort(free, (room - n, k))
    return bins


def fitness(bins, lengths, capacity: int) -> float:
    """Mean squared fill: prefers full bins beside empty room that can be emptied."""
    return sum([(f / capacity) ** 2 for f in filled(bins, lengths).fills]) / len(bins)


def crossover(one, two, lengths, capacity: int, rng) -> Bins:
    """Injects well-filled bins of `two` into `one`."""
    one, two = filled(one, lengths), filled(two, lengths)
    order = sorted(range(len(two)), key=lambda k: -two.fills[k])
    good = order[:max(1, len(order) // 2)]
    chosen = rng.permutation(good)[:max(1, len(good) // 2)].tolist()
    child = Bins([list(two[k]) for k in chosen], [two.fills[k] for k in chosen])
    taken, displaced = set(itertools.chain.from_iterable(child)), []
    for b, fill in zip(one, one.fills):
        if taken.isdisjoint(b):
            child.append(list(b))
            child.fills.append(fill)
        else:
            displaced += [i for i in b if i not in taken]
    return best_fit(child, sorted(displaced, key=lambda i: -lengths[i]), lengths, capacity)


def mutated(bins, lengths, capacity: int, rng) -> Bins:
    """Empties the worst-filled bin and a few others, and best-fits their items in a shuffled order."""
    bins = filled(bins, lengths)
    drop = {min(range(len(bins)), key=bins.fills.__getitem__)} | set(rng.integers(0, len(bins), 3).tolist())
    items = [i for k in drop for i in bins[k]]
    rng.shuffle(items)
    stay = [k for k in range(len(bins)) if k not in drop]
    return best_fit(Bins([list(bins[k]) for k in stay], [bins.fills[k] for k in stay]), items, lengths, capacity)


def evolve(lengths: list[int], elites: list, capacity: int, rng, population: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[list[int]], int]:
    """The best packing bred from the given elites and random fits, and the generations it took: one at least, no more once the bound is met.

    A generation crosses pairs of the better half both ways, mutates every other child, and keeps the best of parents and children.
    """
    bound = -(-sum(lengths) // capacity)
    rated = lambda bins: (len(bins), -fitness(bins, lengths, capacity), bins)
    pool = [rated(filled(e, lengths)) for e in elites]
    while len(pool) < population:
        pool.append(rated(best_fit([], rng.permutation(len(lengths)).tolist(), lengths, capacity)))
    pool.sort(key=lambda r: r[:2])
    for done in range(1, generations + 1):
        children = []
        for k in range(population // 2):
            a, b = rng.permutation(max(2, population // 2))[:2]
            child = crossover(pool[a][2], pool[b][2], lengths, capacity, rng)
            children.append(rated(mutated(child, lengths, capacity, rng) if k % 2 else child))
        pool = sorted(pool + children, key=lambda r: r[:2])[:population]
        if pool[0][0] <= bound:
            break
    return pool[0][2], done


def _elite_row(shard: int, island: int, uids, lengths, bins, capacity: int, generations: int) -> pa.Table:
    where = np.zeros(len(lengths), np.int32)
    for k, b in enumerate(bins):
        where[b] = k
    cell = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
    return pa.table([pa.array([shard], pa.int64()), pa.array([island], pa.int32()), cell(uids), cell(np.asarray(lengths, np.int32)), cell(where),
                     pa.array([len(bins)], pa.int64()), pa.array([fitness(bins, lengths, capacity)], pa.float64()), pa.array([generations], pa.int32())],
                    names=["shard", "island", "uids", "lengths", "bins", "n_bins", "fitness", "generations"])


def _bins(packed: bytes) -> list[list[int]]:
    where = np.frombuffer(packed, np.int32)
    order = np.argsort(where, kind="stable")
    return [b.tolist() for b in np.split(order, np.flatnonzero(np.diff(where[order])) + 1)]


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS,
         epochs: int = EPOCHS, seed: int = 8) -> DataFrame:
    """Adds sequence_id, offset and generations (of the shard that packed the piece; 0 for a full one) to pieces (doc_id, piece, start, length, ids_crc32)."""
    rows = stored(parts, "pack-pieces").withColumn("uid", F.monotonically_increasing_id())
    small = rows.where(F.col("length") < capacity)
    shards = max(1, -(-small.count() // shard_items))
    dealt = small.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))

    def begin(key, table):
        shard, island = key[0].as_py(), key[1].as_py()
        table = table.sort_by("uid")
        lengths = table["length"].to_pylist()
        best, done = evolve(lengths, [], capacity, np.random.default_rng([seed, shard, island]))
        return _elite_row(shard, island, table["uid"].to_numpy(), lengths, best, capacity, done)

    def migrate(epoch: int):
        def run(key, table):
            shard, island = key[0].as_py(), key[1].as_py()
            lengths = np.frombuffer(table["lengths"][0].as_py(), np.int32).tolist()
            elites = [_bins(b) for b in table["bins"].to_pylist()]
            best, done = evolve(lengths, elites, capacity, np.random.default_rng([seed, shard, island, epoch]))
            done += max(table["generations"].to_pylist())
            return _elite_row(shard, island, np.frombuffer(table["uids"][0].as_py(), np.int64), lengths, best, capacity, done)
        return run

    each = F.explode(F.array(*[F.lit(k) for k in range(islands)]))
    elites = dealt.withColumn("island", each).groupBy("shard", "island").applyInArrow(begin, _ELITE)
    for epoch in range(1, epochs):
        elites = elites.withColumn("island", each).groupBy("shard", "island").applyInArrow(migrate(epoch), _ELITE)
    elites = stored(elites, "pack-elites")
    best = elites.groupBy("shard").agg(F.min_by("island", F.struct("n_bins", -F.col("fitness"), "island")).alias("island"))
    winners = elites.join(best, ["shard", "island"]).select("shard", "uids", "lengths", "bins", "generations")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, uids, lengths, bins, done in zip(*(batch.column(c).to_pylist() for c in ("shard", "uids", "lengths", "bins", "generations"))):
                uids, n, where = np.frombuffer(uids, np.int64), np.frombuffer(lengths, np.int32).astype(np.int64), np.frombuffer(bins, np.int32)
                order = np.argsort(where, kind="stable")
                before = np.cumsum(n[order]) - n[order]
                first = np.concatenate(([True], np.diff(where[order]) > 0))
                start = np.maximum.accumulate(np.where(first, before, 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uids[order]), pa.array(2 * ((shard << 32) + where[order].astype(np.int64))), pa.array(before - start), pa.array(np.full(len(order), done, np.int32))],
                    names=["at", "sequence_id", "offset", "generations"])

    placed = winners.mapInArrow(place, "at long, sequence_id long, offset long, generations int")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "generations"]
    full = rows.where(F.col("length") >= capacity).select(
        *columns[:5], (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("generations"))
    return full.unionByName(small.join(placed, F.col("uid") == F.col("at")).select(*columns))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS,
                   text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, generations."""
    return pack(pieces(docs, path, capacity, text, doc_id), capacity, shard_items)
