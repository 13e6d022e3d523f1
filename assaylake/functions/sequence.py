"""Sequence features: composition, dipeptides, physico-chemistry, k-mers (row-local)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..registry import ALPHABET
from .composition import dpc_entries  # noqa: F401

# Hydropathy and charge per residue, mass per residue.
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
CHARGE = {"R": 1.0, "K": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}
MASS_PER_RESIDUE = 110.0

DIPEPTIDES = [a + b for a in ALPHABET for b in ALPHABET]
PHYSCHEM = ("mw", "hydro_mean", "hydro_range", "net_charge", "pi_est", "gravy", "hydrophobic_share", "charged_share")


def letter_count(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def _weighted(s: Column, weights: dict[str, float]) -> Column:
    """Sum over residues; the weights are tenths, so the sum is exact in whole numbers."""
    tenths = reduce(lambda a, b: a + b, [letter_count(s, a) * F.lit(round(10 * w)) for a, w in weights.items()])
    return tenths / F.lit(10.0)


def aac(s: Column) -> Column:
    """Array of the 20 letter shares in alphabet order; zeros for an empty string."""
    size = F.greatest(F.length(s), F.lit(1))
    return F.array(*[letter_count(s, a) / size for a in ALPHABET])


def kmers(s: Column, k: int = 3) -> Column:
    """All overlapping k-mers in order (one linear regex pass); empty when the string is shorter than k."""
    return F.regexp_extract_all(s, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def bind(value: Column, body) -> Column:
    """body(value) with `value` computed once per row: a lambda variable instead of a repeated expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(ordered: Column) -> Column:
    n = F.size(ordered)
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(ordered, i - 1) != F.get(ordered, i)))
    return bind(ends, lambda last: F.transform(last, lambda e, j: F.struct(
        F.get(ordered, e - 1).alias("token"),
        (e - F.when(j == 0, F.lit(0)).otherwise(F.get(last, j - 1))).alias("n"))))


def sorted_runs(ordered: Column, kind: str = "string") -> Column:
    """Sorted token array -> array of (token, n)."""
    nothing = F.array().cast(f"array<struct<token:{kind},n:int>>")
    return bind(ordered, lambda o: F.when(F.size(o) > 0, _runs(o)).otherwise(nothing))


def run_counts(tokens: Column) -> Column:
    """Token array -> sorted array of (token, n), counted inside the row, so no shuffle is needed."""
    return sorted_runs(F.sort_array(tokens))


def kmer_counts(s: Column, k: int = 3) -> Column:
    return run_counts(kmers(s, k))


def kmer_signature(s: Column, k: int = 3) -> Column:
    """Equal exactly when the k-mer multisets are equal (order-free, count-sensitive)."""
    return F.sha2(F.array_join(F.sort_array(kmers(s, k)), ","), 256)


def physchem(s: Column) -> dict[str, Column]:
    """The eight whole-sequence properties, all from letter counts, so they stay in generated code."""
    size = F.greatest(F.length(s), F.lit(1))
    mean = _weighted(s, HYDROPATHY) / size
    present = [F.when(letter_count(s, a) > 0, F.lit(h)) for a, h in HYDROPATHY.items()]
    positive = reduce(lambda a, b: a + b, [letter_count(s, a) for a, h in HYDROPATHY.items() if h > 0])
    charged = reduce(lambda a, b: a + b, [letter_count(s, a) for a in CHARGE])
    basic = letter_count(s, "R") + letter_count(s, "K")
    acidic = letter_count(s, "D") + letter_count(s, "E")
    values = (F.length(s) * F.lit(MASS_PER_RESIDUE), mean, F.greatest(*present) - F.least(*present),
              _weighted(s, CHARGE), F.lit(7.0) + (basic - acidic) / size * 2, mean, positive / size, charged / size)
    return {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in zip(PHYSCHEM, values)}


def checked(s: Column) -> Column:
    """The string itself, or an error naming it when a residue is outside the alphabet."""
    bad = F.coalesce(s.rlike(f"[^{ALPHABET}]"), F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit("non-standard residue in sequence "), s))).otherwise(s)
