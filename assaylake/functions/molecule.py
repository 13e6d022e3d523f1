"""Hashed token fingerprints of molecule strings (row-local).

Token n-grams are hashed to bits. The block has the shape of a circular fingerprint (one block of
2048 bits per radius) but is not chemically one: neighbourhoods here are runs of the string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..registry import FINGERPRINT_BITS
from .sequence import bind

# Bracket atoms, two-letter elements, two-digit ring closures, then single characters.
TOKEN_PATTERN = r"\[[^\]]*\]|Br|Cl|%[0-9][0-9]|."


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(TOKEN_PATTERN), F.lit(0))


def ngrams(toks: Column, n: int) -> Column:
    count = F.size(toks) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                        lambda i: F.array_join(F.slice(toks, i, n), " "))
    return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))


def _bit(token: Column, bits: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(bits)).cast("int")


def fingerprint_bits(s: Column, radius: int = 2, bits: int = FINGERPRINT_BITS) -> Column:
    """Sorted array of set bits from all n-grams with n = 1 .. radius + 1."""
    grams = bind(tokens(s), lambda toks: F.flatten(F.array(*[ngrams(toks, n) for n in range(1, radius + 2)])))
    return F.array_sort(F.array_distinct(F.transform(grams, lambda g: _bit(g, bits))))
