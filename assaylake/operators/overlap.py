"""K-mer multisets in numpy: exact overlaps of two strings, sketches, and candidate pairs from a partition of the tokens.

Tokens (the i-th repeat of a k-mer is one of its own) are dealt by hash into parts. Overlap and union of a pair are the sums of those of the
parts, so a pair with Jaccard >= t has Jaccard >= t in a part at least. Documents of one range of sizes and the larger ones that can be similar to them
meet in the parts of that range, more parts for larger documents, so that a part holds some tokens of each. A task holds one part, or that of two blocks of
documents, and returns the pairs that can reach t there: nothing is capped, no similar pair is lost. A token moves as three bytes, and parts are
done in waves; equal numbers of different tokens only add candidates, which are checked exactly.

Inside a part the tokens of a document stand in a ring by number. Of two documents with n and m tokens there, o of them shared, the gaps between a shared
token and the next shared one sum up to n + m - 2 o over both rings, so at least o - (n + m - 2 o) / (gap + 1) of the o steps have `gap` other tokens at most.
Pairs of tokens with `gap` others between them at most are therefore what documents are met by: unlike single tokens, two of them are seldom shared by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from ..session import packed_lineage

#: Tokens that a task should hold (twice as many at most), the most parts of a range of sizes, and the pairs met in one step.
GROUP_TOKENS, PARTS, MEET = 3_000_000, 256, 2_000_000
#: Where ranges of sizes begin, the fewest tokens that a document of a range has in a part, by expectation, and the widest gap that steps are made of.
RANGES, LEAST, GAP = (0, 128, 256, 512, 1024, 2048, 8192), 10, 4
#: Steps that are sorted at once, and tokens that are moved at once.
STEPS, WAVE_TOKENS = 14_000_000, 80_000_000
#: Letters that one vectorised step works on. A longer string is a step of its own.
STEP = 1 << 20
U = np.uint64
_MULT, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
#: What a dot of a regular expression does not match.
_LINE_ENDS = "\n\r\x85\u2028\u2029"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * _MIX1
    h = (h ^ (h >> U(33))) * _MIX2
    return h ^ (h >> U(33))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _whole(text: str, k: int) -> np.ndarray | None:
    """Which k-mers hold no line end; None if all."""
    if len(text) < k or not any(c in text for c in _LINE_ENDS):
        return None
    bad = np.isin(_letters(text), _letters(_LINE_ENDS))
    return ~np.lib.stride_tricks.sliding_window_view(bad, k).any(axis=1)


def _codes(points: np.ndarray, k: int) -> np.ndarray:
    """A number per k-mer: its letters themselves where they fit 64 bits, else a hash."""
    n = len(points) - k + 1
    fits = k <= 8 and (not len(points) or int(points.max()) < 256)
    step, out = U(256) if fits else _MULT, np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out = out * step + (points[j:j + n] if fits else _mix(points[j:j + n].astype(np.uint64) + U(1)))
    return out


def _exact(points: np.ndarray, k: int) -> np.ndarray:
    """A number per k-mer, equal only if they are equal."""
    if k <= 8 and (not len(points) or int(points.max()) < 256):
        return _codes(points, k)
    views = np.lib.stride_tricks.sliding_window_view(points, k)
    return np.unique(np.ascontiguousarray(views).view(np.dtype((np.void, 4 * k))).reshape(-1), return_inverse=True)[1]


def overlap(a: str, b: str, k: int) -> int:
    """Size of the intersection of two k-mer multisets, exact."""
    if len(a) < k or len(b) < k:
        return 0
    x, y = _letters(a), _letters(b)
    both = _exact(np.concatenate((x, y)), k)
    cut = len(x) - k + 1
    keep = [both[:cut], both[len(x):]]
    keep = [v if (w := _whole(p, k)) is None else v[w] for v, p in zip(keep, (a, b))]
    u, v = map(np.sort, keep)
    first = np.searchsorted(u, u)
    times = np.searchsorted(v, u, "right") - np.searchsorted(v, u)
    return int((np.arange(len(u)) - first < times).sum())


def overlap_column(a: Column, b: Column, k: int) -> Column:
    """The overlap of two strings; null if one is null."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else overlap(x, y, k) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    return F.arrow_udf(run, LongType())(a, b)


def mark_column(key: Column, k: int) -> Column:
    """A sum of hashes of the k-mers: equal for equal multisets; null for null."""
    def run(keys: pa.Array) -> pa.Array:
        return pa.array([None if s is None else mark(s) for s in keys.to_pylist()], pa.int64())

    def mark(s: str) -> int:
        h, whole = _mix(_codes(_letters(s), k) + U(1)), _whole(s, k)
        return int((h if whole is None else h[whole]).sum(dtype=np.uint64).view(np.int64))

    return F.arrow_udf(run, LongType())(key)


def signature(s: str, k: int) -> bytes:
    """Equal exactly when the k-mer multisets are equal, but for SHA-256."""
    points, whole = _letters(s), _whole(s, k)
    if k <= 8 and whole is None and (not len(points) or int(points.max()) < 256):
        return hashlib.sha256(np.sort(_codes(points, k)).tobytes()).digest()
    grams = sorted(g for g in (s[i:i + k] for i in range(len(s) - k + 1)) if not any(c in g for c in _LINE_ENDS))
    if k <= 8 and all(ord(c) < 256 for g in grams for c in g):
        return hashlib.sha256(b"".join(int.from_bytes(g.encode("latin-1"), "big").to_bytes(8, "little") for g in grams)).digest()
    return hashlib.sha256("\n".join(grams).encode()).digest()


def signature_column(key: Column, k: int) -> Column:
    def run(keys: pa.Array) -> pa.Array:
        return pa.array([None if s is None else signature(s, k) for s in keys.to_pylist()], pa.binary())

    return F.arrow_udf(run, BinaryType())(key)


def least_hashes(key: Column, k: int, count: int) -> Column:
    """The smallest hashes of the distinct k-mers."""
    def run(keys: pa.Array) -> pa.Array:
        out = []
        for s in keys.to_pylist():
            h = np.sort(_mix(_codes(_letters(s or ""), k) + U(1)))
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))[:len(h)]][:count].view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    return F.arrow_udf(run, ArrayType(LongType()))(key)


# ---- candidates by parts ------------------------------------------------------------------------------------------

def tokens_of(keys: list[str], k: int, line_ends: bool = True, wave: int = 0, waves: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of several strings and the string of each: 40 bits of a k-mer's hash and how often it came before. With waves, those of one of them."""
    codes = [_codes(_letters(s), k) for s in keys]
    if not line_ends:
        codes = [c if (w := _whole(s, k)) is None else c[w] for s, c in zip(keys, codes)]
    doc = np.repeat(np.arange(len(keys), dtype=np.uint64), [len(c) for c in codes])
    grams = _mix(np.concatenate(codes or [np.zeros(0, np.uint64)]) + U(1))
    if waves > 1:
        now = (grams & U(0xFFFF)) * U(waves) >> U(16) == U(wave)
        doc, grams = doc[now], grams[now]
    code = np.sort(doc << U(40) | grams >> U(24))
    new = np.concatenate(([True], code[1:] != code[:-1]))[:len(code)]
    at = np.flatnonzero(new)
    nth = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code))))
    return _mix((code & U((1 << 40) - 1)) + nth.astype(np.uint64) * _MULT), (code >> U(40)).astype(np.int64)


def _bands(keys: list[str], k: int, bands: int, rows: int) -> pa.Array:
    bins, n = bands * rows, len(keys)
    h, doc = tokens_of(keys, k, line_ends=False)
    least = np.full(n * bins, ~U(0))
    np.minimum.at(least, doc * bins + (h % U(bins)).astype(np.int64), h)
    held = np.zeros(n * bins, bool)
    held[doc * bins + (h % U(bins)).astype(np.int64)] = True
    least, held = least.reshape(n, bins), held.reshape(n, bins)
    # the next filled bin, round the end; a copied value is told apart by its distance
    at = np.where(np.concatenate((held, held), axis=1), np.arange(2 * bins), 4 * bins)
    after = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
    some = held.any(axis=1)
    after = np.where(some[:, None], after, np.arange(bins))
    value = _mix(np.take_along_axis(least, after % bins, axis=1) + _mix((after - np.arange(bins)).astype(np.uint64) + U(1)))
    key = np.tile(_mix(np.arange(bands, dtype=np.uint64) + U(11)), (n, 1))
    for r in range(rows):
        key = _mix(key * _MULT + value[:, r::rows])
    offsets = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[some].reshape(-1).view(np.int64)))


def band_keys(key: Column, k: int, bands: int, rows: int) -> Column:
    """A number per band of the sketch of a k-mer multiset, equal for equal bands; none of a string without a k-mer.

    Each token falls into one of bands x rows bins, and a bin keeps its smallest hash; an empty bin takes that of the next filled one.
    """
    def run(keys: pa.Array) -> pa.Array:
        texts = [s or "" for s in keys.to_pylist()]
        out, at, ends = [], 0, np.cumsum([len(s) for s in texts])
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            out.append(_bands(texts[at:to], k, bands, rows))
            at = to
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))

    return F.arrow_udf(run, ArrayType(LongType()))(key)


_PACKED = "part int, left int, right int, ids binary, sizes binary, labels binary, roles binary, ns binary, tokens binary, block int"
_KINDS = {"ids": np.int64, "sizes": np.int32, "labels": np.int64, "roles": np.int8, "ns": np.int32}


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ends = 0, np.cumsum([len(s) for s in batch.column("key").to_pylist()])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right")))
            yield batch.slice(at, to - at)
            at = to


class Range(NamedTuple):
    """Documents of low <= size < high, which meet each other and those up to `reach`: in `parts` parts a wave that are numbered from `first`, and
    in `blocks` blocks. `star`: every block has all documents that list; else every two blocks meet."""

    low: int
    high: int | None
    reach: int | None
    first: int
    parts: int
    blocks: int
    star: bool


def _packed(sets: DataFrame, k: int, ranges: list[Range], labelled: bool, wave: int, waves: int) -> DataFrame:
    """The tokens of documents (id, size, key, label, role) by part and pair of blocks. A document larger than its range has 4 added to its role."""
    names = [c.split()[0] for c in _PACKED.split(", ")]
    kinds = [pa.binary() if " binary" in c else pa.int32() for c in _PACKED.split(", ")]

    def cells(r: Range, h, doc, ids, sizes, labels, roles, block, several) -> Iterator[tuple]:
        group = (h & U(0xFFFFFFFF)) * U(r.parts) >> U(32)
        if several:
            group = group * U(r.blocks) + block[doc]
        code = np.sort(group << U(44) | doc.astype(np.uint64) << U(24) | h >> U(40))
        low = (code & U(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        each = code >> U(24)
        at = np.flatnonzero(np.concatenate(([True], each[1:] != each[:-1])))
        n, docs, group = np.diff(np.append(at, len(code))).astype(np.int32), (each[at] & U(0xFFFFF)).astype(np.int64), (each[at] >> U(20)).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part, blk = divmod(int(group[a]), r.blocks) if several else (int(group[a]), 0)
            d, last = docs[a:b], at[b] if b < len(at) else len(code)
            yield r.first + part, blk, d, (ids[d].tobytes(), sizes[d].tobytes(), labels[d].tobytes() if labelled else b""), n[a:b].tobytes(), low[at[a]:last].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches):
            ids, sizes, labels = (batch.column(c).to_numpy().astype(np.int64) for c in ("id", "size", "label"))
            roles = batch.column("role").to_numpy().astype(np.int8)
            h, doc = tokens_of(batch.column("key").to_pylist(), k, wave=wave, waves=waves)
            for r in ranges:
                here = (sizes >= r.low) & (True if r.reach is None else sizes <= r.reach)
                # larger ones meet the range only
                role = roles if r.high is None else np.where(sizes < r.high, roles, roles | np.int8(4))
                block, rows = _mix(ids.view(np.uint64) + U(3)) % U(r.blocks), []
                lists = (roles & 1 > 0) & r.star & (r.blocks > 1)
                for some, all_blocks in ((here & ~lists, False), (here & lists, True)):
                    kept = some[doc]
                    if not kept.any():
                        continue
                    for part, blk, d, given, n, low in cells(r, h[kept], doc[kept], ids, sizes.astype(np.int32), labels, role, block, r.blocks > 1 and not all_blocks):
                        for o in range(r.blocks):
                            if all_blocks:
                                now = np.where(block[d] == U(o), role[d], role[d] & np.int8(5))
                                rows.append((part, o, o, *given, now.tobytes(), n, low, o))
                            elif not r.star or o == blk:
                                rows.append((part, min(blk, o), max(blk, o), *given, role[d].tobytes(), n, low, blk))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return sets.select("id", "size", "key", "label", "role").mapInArrow(run, _PACKED)


def _need(n: np.ndarray, t: Fraction) -> np.ndarray:
    return np.maximum(1, -(-n * t.numerator // t.denominator))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _shared(code: np.ndarray, begin: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens of the shorter document of each pair the other has; `code` holds documents and tokens in order."""
    swap = n[left] > n[right]
    few, many = np.where(swap, right, left), np.where(swap, left, right)
    out, ends, a = np.zeros(len(few), np.int64), np.cumsum(n[few]), 0
    while a < len(few):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MEET, "right")), a + 1)
        asked = np.repeat(many[a:b], n[few[a:b]]) << 32 | code[_ranges(begin[few[a:b]], n[few[a:b]])] & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(code, asked), len(code) - 1)
        out[a:b] = np.bincount(np.repeat(np.arange(b - a), n[few[a:b]]), code[at] == asked, b - a)
        a = b
    return out


def met(ids, sizes, labels, roles, block, n, tokens, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents of a part that can have Jaccard >= t there: one with role 1 or 3 and one with role 2 or 3, of different labels and, if
    there are two blocks, of different blocks. `n` tells how many of the tokens, in order, are each document's."""
    order = np.argsort(sizes, kind="stable")
    rank_of = np.empty(len(ids), np.int64)
    rank_of[order] = np.arange(len(ids))
    doc = np.repeat(rank_of, n)
    ids, sizes, labels, roles, block, n = (x[order] for x in (ids, sizes, labels, roles, block, n))
    two = len(np.unique(block)) > 1
    _, inverse, df = np.unique(tokens, return_inverse=True, return_counts=True)
    rare = np.empty(len(df), np.int64)
    rare[np.argsort(df, kind="stable")] = np.arange(len(df))
    # inside each document rarest first; the prefix, without tokens of one document only
    code = np.sort(doc << 32 | rare[inverse])
    doc, token = code >> 32, code & 0xFFFFFFFF
    begin = np.cumsum(n) - n
    at = np.arange(len(code)) - begin[doc]
    need = _need(n, t)
    keep = (at < (n - need + 1)[doc]) & (np.sort(df)[token] > 1)
    doc, token = doc[keep], token[keep]
    self_join = bool((roles == 3).all())
    listed = np.sort((token << 32 | doc)[(roles[doc] & 1) > 0])
    who = listed & 0xFFFFFFFF
    entry = (roles[doc] & 2) > 0
    doc, token = doc[entry], token[entry]
    # sizes that can reach t
    first = np.searchsorted(sizes, -(-sizes * t.numerator // t.denominator))
    last = np.searchsorted(sizes, sizes * t.denominator // t.numerator, "right")
    starts = np.searchsorted(listed, token << 32 | first[doc])
    ends = np.searchsorted(listed, token << 32 | (doc if self_join else last[doc]))
    counts = ends - starts
    some = counts > 0
    doc, starts, counts = doc[some], starts[some], counts[some]
    a, total = 0, np.cumsum(counts)
    while a < len(doc):
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + MEET, "right")), a + 1)
        # whole documents only; one that meets more alone is counted in steps
        b = int(np.searchsorted(doc, doc[b - 1], "right" if doc[b - 1] == doc[a] else "left")) if b < len(doc) else b
        if doc[a] == doc[b - 1]:
            seen = np.zeros(len(ids), np.int64)
            c = a
            while c < b:
                e = min(b, max(int(np.searchsorted(total, (total[c - 1] if c else 0) + MEET, "right")), c + 1))
                seen += np.bincount(who[_ranges(starts[c:e], counts[c:e])], minlength=len(ids))
                c = e
            right = np.flatnonzero(seen)
            left, seen = np.full(len(right), doc[a]), seen[right]
        else:
            pairs = np.sort(np.repeat(doc[a:b], counts[a:b]) << 32 | who[_ranges(starts[a:b], counts[a:b])])
            new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            seen, pairs = np.diff(np.append(new, len(pairs))), pairs[new]
            left, right = pairs >> 32, pairs & 0xFFFFFFFF
        # a shared token outside a prefix lies in the suffix of the side whose prefix ends first
        most = seen + np.maximum(need[left], need[right]) - 1
        ok = (most * (t.numerator + t.denominator) >= (n[left] + n[right]) * t.numerator) & (labels[left] != labels[right])
        if two:
            ok &= block[left] != block[right]
        left, right = left[ok], right[ok]
        shared = _shared(code, begin, n, left, right)
        ok = shared * (t.numerator + t.denominator) >= (n[left] + n[right]) * t.numerator
        yield ids[left[ok]], ids[right[ok]]
        a = b


def widest(t: Fraction) -> int:
    """The gap of the steps that documents with Jaccard >= t meet by; one more than the least that a similar pair needs, so that it has several such steps."""
    return int(1 / t - 1) + 1


def near(ids, sizes, labels, roles, block, n, tokens, t: Fraction) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `met`, met by steps. Documents with 4 in their role don't meet each other; `labels` is None if all differ."""
    gap, alone = widest(t), labels is None
    order = np.argsort(sizes if alone else labels, kind="stable")
    rank_of = np.empty(len(ids), np.int64)
    rank_of[order] = np.arange(len(ids))
    code = np.sort(np.repeat(rank_of, n) << 32 | tokens)
    ids, sizes, roles, block, n = (x[order] for x in (ids, sizes, roles, block, n))
    lists, asks, larger, every = (roles & 1) > 0, (roles & 2) > 0, (roles & 4) > 0, np.arange(len(ids))
    two = len(np.unique(block)) > 1
    low, high = -(-sizes * t.numerator // t.denominator), sizes * t.denominator // t.numerator
    if alone:
        own = every
    else:
        own = np.searchsorted(labels[order], labels[order])
    # of two that both list and look up, only the later looks up
    behind = asks if (lists & ~asks).any() else asks & ~lists
    doc, token, begin = code >> 32, (code & 0xFFFFFF).astype(np.uint64), np.cumsum(n) - n
    # by the tokens of both: how many a similar pair shares, and how many steps
    both = np.arange(2 * int(n.max(initial=0)) + 1)
    shared = np.maximum(1, -(-both * t.numerator // (t.numerator + t.denominator)))
    steps_shared = shared - (both - 2 * shared) // (gap + 1)
    who, found, base = [], [], 0
    listed_tokens = None
    if not lists.all():
        listed_tokens = np.zeros(1 << 24, bool)
        listed_tokens[token[lists[doc]]] = True
    shares = -(-len(code) * (gap + 1) // STEPS)
    for share in range(shares):
        steps = []
        for g in range(gap + 1):
            to, full = np.roll(token, -1 - g), n > g
            # the last ones go on with the first of their document
            for j in range(g + 1):
                to[begin[full] + n[full] - 1 - j] = token[begin[full] + g - j]
            h, d = token << U(24) | to, doc
            some = (n > g)[doc] if g else None
            if listed_tokens is not None:
                # a step that no listed document can have
                able = (lists[doc] | (listed_tokens[token] & listed_tokens[to]))
                some = able if some is None else some & able
            if some is not None:
                h, d = h[some], d[some]
            h = (h ^ h >> U(25)) * _MULT
            if shares > 1:
                now = (h >> U(32) & U(0xFF)) * U(shares) >> U(8) == U(share)
                h, d = h[now], d[now]
            steps.append(h >> U(24) << U(24) | d.view(np.uint64))
        steps = np.concatenate(steps)
        steps.sort()
        # a step of one document only meets none
        same = (steps[1:] ^ steps[:-1]) < U(1 << 24)
        steps = steps[(np.append(same, False) | np.append(False, same))[:len(steps)]]
        d = (steps & U(0xFFFFFF)).astype(np.int64)
        new = np.append(True, (steps[1:] ^ steps[:-1]) >= U(1 << 24))[:len(steps)]
        mine = own[d]
        alike = new | np.append(True, mine[1:] != mine[:-1])[:len(steps)]
        every_lists = bool(lists.all())
        upto = None if every_lists else np.append(0, np.cumsum(lists[d]))
        who.append((d if every_lists else d[lists[d]]).astype(np.int32))
        # where the documents of a step begin and end, and among them those of the own label
        bounds = []
        for starts in (new, alike):
            at = np.append(np.flatnonzero(starts), len(steps))
            place = at if every_lists else upto[at]
            length = np.diff(at)
            bounds += [np.repeat(place[:-1], length), np.repeat(place[1:], length)]
        for some, lo, hi in ((asks, bounds[0], bounds[2]), (behind, bounds[3], bounds[1])):
            if not some.any():
                continue
            counts = hi - lo
            meets = np.flatnonzero((counts > 0) & some[d])
            found.append((d[meets].astype(np.int32), lo[meets] + base, counts[meets].astype(np.int32)))
        base += len(who[-1])
        del steps, d, same, new, alike, mine, bounds
    if not found:
        return
    who, (doc, starts, counts) = np.concatenate(who), (np.concatenate(x) for x in zip(*found))
    del found, token
    order = np.sort(doc.astype(np.int64) << 32 | np.arange(len(doc))) & 0xFFFFFFFF
    doc, starts, counts = doc[order].astype(np.int64), starts[order], counts[order].astype(np.int64)
    a, total = 0, np.cumsum(counts)
    while a < len(doc):
        b = max(int(np.searchsorted(total, (total[a - 1] if a else 0) + MEET, "right")), a + 1)
        # whole documents only; one that meets more alone is counted in steps
        b = int(np.searchsorted(doc, doc[b - 1], "right" if doc[b - 1] == doc[a] else "left")) if b < len(doc) else b
        if doc[a] == doc[b - 1]:
            seen, c = np.zeros(len(ids), np.int64), a
            while c < b:
                e = min(b, max(int(np.searchsorted(total, (total[c - 1] if c else 0) + MEET, "right")), c + 1))
                seen += np.bincount(who[_ranges(starts[c:e], counts[c:e])], minlength=len(ids))
                c = e
            right = np.flatnonzero(seen)
            left, seen = np.full(len(right), doc[a]), seen[right]
        else:
            left, right = np.repeat(doc[a:b], counts[a:b]), who[_ranges(starts[a:b], counts[a:b])].astype(np.int64)
            pairs = np.sort(left << 32 | right)
            new = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))[:len(pairs)]
            seen, pairs = np.diff(np.append(new, len(pairs))), pairs[new]
            left, right = pairs >> 32, pairs & 0xFFFFFFFF
        a, both = b, n[left] + n[right]
        ok = seen >= steps_shared[both]
        left, right, need = left[ok], right[ok], shared[both[ok]]
        ok = (need <= np.minimum(n[left], n[right])) & ~(larger[left] & larger[right]) & (ids[left] != ids[right])
        ok &= (sizes[right] >= low[left]) & (sizes[right] <= high[left])
        if two:
            ok &= block[left] != block[right]
        left, right, need = left[ok], right[ok], need[ok]
        ok = _shared(code, begin, n, left, right) >= need
        yield ids[left[ok]], ids[right[ok]]


def every_pair(ids: np.ndarray, keys: list[str], block: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each string: it, those after it (of other blocks if there are two) and their overlaps, exact. Places, not ids, are given."""
    points, starts = _letters("".join(keys)), np.cumsum([0, *map(len, keys)])
    codes = np.unique(_exact(points, k), return_inverse=True)[1] if len(points) >= k else np.zeros(0, np.int64)
    kept = [codes[a:max(a, b - k + 1)] for a, b in zip(starts[:-1], starts[1:])]
    kept = [c if (w := _whole(s, k)) is None else c[w] for s, c in zip(keys, kept)]
    n = np.array([len(c) for c in kept])
    code = np.sort(np.repeat(np.arange(len(keys)), n) << 32 | np.concatenate(kept))
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
    nth = np.arange(len(code)) - np.repeat(at, np.diff(np.append(at, len(code))))
    token = np.unique((code & 0xFFFFFFFF) * (int(nth.max(initial=0)) + 1) + nth, return_inverse=True)[1]
    ends = np.cumsum(n)
    seen, two = np.zeros(len(token) + 1, bool), len(np.unique(block)) > 1
    for i in range(len(keys) - 1):
        mine = token[ends[i] - n[i]:ends[i]]
        seen[mine] = True
        upto = np.append(0, np.cumsum(seen[token[ends[i]:]]))[ends[i:] - ends[i]]
        seen[mine] = False
        others = np.arange(i + 1, len(keys))
        some = block[others] != block[i] if two else slice(None)
        yield np.full(len(others[some]), i), others[some], np.diff(upto)[some]


#: Tokens of a block of strings that all meet in one task, two blocks at a time, and the most tokens of a group that is done so.
ALL_TOKENS, GROUP_MOST = 400_000, 200_000_000


def pairs_within(sets: DataFrame, t: Fraction, k: int, group: str, bands: str | None = None) -> DataFrame:
    """(a, b, overlap, union), a < b: every pair of `sets` (id, size, key, group, blocks) of one group with Jaccard >= t, exact; a text is read once for many pairs.
    A group is cut into `blocks`, and every two blocks meet. With `bands`, an array column, only pairs that have an entry in common at the same place."""
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    extra = [bands] if bands else []
    placed = sets.select("id", "size", "key", *extra, F.col(group).alias("grp"), own.alias("blk"), F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)).alias("o"))
    placed = placed.select("id", "size", "key", *extra, "grp", "blk", F.least("blk", "o").alias("lo"), F.greatest("blk", "o").alias("hi"))

    def run(key, table):
        ids, sizes, block = (table[c].to_numpy().astype(np.int64) for c in ("id", "size", "blk"))
        out = [np.zeros((4, 0), np.int64)]
        if key[1].as_py() == key[2].as_py() or len(np.unique(block)) > 1:
            marks = np.array(table[bands].to_pylist(), np.int64) if bands else None
            for i, j, both in every_pair(ids, table["key"].to_pylist(), block, k):
                union = sizes[i] + sizes[j] - both
                ok = (both * t.denominator >= union * t.numerator) & (ids[i] != ids[j])
                if bands and ok.any():
                    ok[ok] = (marks[i[ok]] == marks[j[ok]]).any(axis=1)
                a, b = ids[i[ok]], ids[j[ok]]
                out.append(np.stack((np.minimum(a, b), np.maximum(a, b), both[ok], union[ok])))
        return pa.table(dict(zip(("a", "b", "overlap", "union"), np.concatenate(out, axis=1))))

    return placed.groupBy("grp", "lo", "hi").applyInArrow(run, "a long, b long, overlap long, union long")


def _ranges_of(docs: DataFrame, t: Fraction, by_role: bool) -> tuple[list[Range], int]:
    """Ranges of sizes with their parts and blocks, and the number of waves."""
    begins = RANGES if widest(t) <= GAP else RANGES[:1]
    ends = [*begins[1:], None]
    reach = [None if e is None else int((e - 1) / t) for e in ends]
    size, tokens = F.col("size"), []
    for low, far in zip(begins, reach):
        here = (size >= low) & (F.lit(True) if far is None else size <= far)
        tokens += [F.sum(F.when(here, size)), F.sum(F.when(here & (F.col("role").bitwiseAND(F.lit(1)) > 0), size))]
    sums = [x or 0 for x in docs.agg(*tokens, F.sum("size")).first()]
    total, most = sums.pop(), 2 * GROUP_TOKENS
    share = max(WAVE_TOKENS, total // 2)
    found, waves = [], max(1, -(-sum(sums[::2]) // share))
    while True:
        out, first, moved = [], 0, 0
        for i, low in enumerate(begins):
            here, listed = sums[2 * i], sums[2 * i + 1]
            fine = max(1, low // (LEAST * waves)) if len(begins) > 1 else PARTS
            parts = max(1, min(-(-max(here, 8 * waves) // (GROUP_TOKENS * waves)), fine, -(-PARTS // waves)))
            if len(begins) == 1:
                parts = max(parts, min(8, PARTS))
            held = parts * waves * most
            star = by_role and 2 * listed <= held
            blocks = 1 if here <= held else -(-here // (held - listed)) if star else -(-2 * here // held)
            out.append(Range(low, ends[i], reach[i], first, parts, blocks, star))
            first += parts
            moved += here + listed * (blocks - 1) if star else here * blocks
        again = max(1, -(-moved // share))
        if again <= waves or found:
            return out, waves
        found, waves = out, again


def candidate_pairs(sets: DataFrame, t: Fraction, k: int, label: Column | None = None, role: Column | None = None) -> DataFrame:
    """(a, b), a < b: every pair of `sets` (id, size, key) with Jaccard >= t > 0, and few others. Pairs with the same `label` are left out. With `role` only
    pairs of one that lists (1 or 3) and one that looks up (2 or 3); rows of role 0 are left out."""
    labelled, by_role = label is not None, role is not None
    label, role = F.col("id") if label is None else label, F.lit(3) if role is None else role
    docs = sets.select("id", "size", "key", label.cast("long").alias("label"), role.cast("int").alias("role")).where("role > 0")
    ranges, waves = _ranges_of(docs, t, by_role)

    def run(key, table):
        both, one = key[1].as_py() != key[2].as_py(), lambda c: np.frombuffer(b"".join(table[c].to_pylist()), _KINDS[c])
        n = one("ns").astype(np.int64)
        block = np.repeat(np.array(table["block"].to_pylist(), np.int64), [len(x) // 4 for x in table["ns"].to_pylist()])
        out = []
        if not both or len(np.unique(block)) > 1:
            low = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint8).reshape(-1, 3)
            tokens = low[:, 0].astype(np.int64)
            tokens |= low[:, 1].astype(np.int64) << 8
            tokens |= low[:, 2].astype(np.int64) << 16
            ids, sizes, labels, roles = one("ids"), one("sizes").astype(np.int64), one("labels") if labelled else None, one("roles")
            if widest(t) <= GAP:
                # larger ones only look up, where all list and look up
                roles = roles if by_role else np.where(roles & 4, 6, roles)
                out = [*near(ids, sizes, labels, roles, block, n, tokens, t)]
            else:
                out = [*met(ids, sizes, ids if labels is None else labels, roles & 3, block, n, tokens, t)]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in out)]) for i in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    found = [_packed(docs, k, ranges, labelled, w, waves).groupBy("part", "left", "right").applyInArrow(run, "a long, b long") for w in range(waves)]
    if waves > 1:
        # what a wave has moved goes before the next
        found = [packed_lineage(x.distinct()) for x in found]
    return reduce(DataFrame.unionByName, found).distinct()
