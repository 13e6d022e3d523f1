"""Cleaning, validity and target functions (row-local Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import registry as R

# Characters removed at both ends of a key, and the words that mean "no molecule".
_STRIP = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")
_NO_MOLECULE = ("", "nan", "None")
_MOLECULE_CHARS = r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*~]+$"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(_STRIP))


def clean_sequence(s: Column) -> Column:
    """Canonical upper-case key, or NULL: strip the ends, drop inner spaces, alphabet only, 4..120 letters."""
    key = F.replace(F.upper(strip(s)), F.lit(" "), F.lit(""))
    ok = key.rlike(f"^[{R.ALPHABET}]{{{R.PREPARED_MIN_LEN},{R.PREPARED_MAX_LEN}}}$") & ~key.endswith("\n")
    return F.when(ok, key)


def is_missing(y: Column) -> Column:
    return y.isNull() | F.isnan(y)


def valid_label(y: Column, kind: Column | str) -> Column:
    """Present and finite; a binary label is also 0 or 1."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return ~is_missing(y) & (F.abs(y) < F.lit(float("inf"))) & ((kind != R.BINARY) | y.isin(0.0, 1.0))


def scoring_mask(s: Column) -> Column:
    """Scoring-time validity: at least three letters of the alphabet in any case; no trimming, no maximum."""
    return F.coalesce(F.upper(s).rlike(f"^[{R.ALPHABET}]{{{R.SCORING_MIN_LEN},}}$") & ~s.endswith("\n"), F.lit(False))


def molecule_present(s: Column) -> Column:
    return F.coalesce(~strip(s).isin(*_NO_MOLECULE), F.lit(False))


def _balanced(s: Column, opening: str, closing: str) -> Column:
    """Depth over the brackets only; -1 sticks once a bracket closes before it opens."""
    marks = F.regexp_extract_all(s, F.lit(f"[\\{opening}\\{closing}]"), F.lit(0))
    depth = F.aggregate(
        marks, F.lit(0),
        lambda d, m: F.when(d < 0, d).otherwise(d + F.when(m == opening, 1).otherwise(-1)))
    return depth == 0


def valid_molecule(s: Column) -> Column:
    """Usable molecule string: present, only line-notation characters, brackets balanced.

    A lexical check; whether the string is chemically sound is not decided here.
    """
    key = strip(s)
    return (molecule_present(s) & F.coalesce(key.rlike(_MOLECULE_CHARS), F.lit(False))
            & F.coalesce(_balanced(key, "(", ")") & _balanced(key, "[", "]"), F.lit(False)))


def to_model_space(y: Column, transform: Column | str) -> Column:
    transform = F.lit(transform) if isinstance(transform, str) else transform
    return F.when(transform == R.LOG10, F.log10(y)).otherwise(y)


def to_human_units(p: Column, transform: Column | str) -> Column:
    transform = F.lit(transform) if isinstance(transform, str) else transform
    return F.when(transform == R.LOG10, F.pow(F.lit(10.0), p)).otherwise(p)


def is_floor(y: Column, floor: float = R.FLOOR, tolerance: float = R.FLOOR_TOLERANCE) -> Column:
    return y <= F.lit(floor + tolerance)


def region(y: Column, floor: float = R.FLOOR, cut: float = R.REGION_CUT,
           tolerance: float = R.FLOOR_TOLERANCE) -> Column:
    return (F.when(is_floor(y, floor, tolerance), F.lit("floor"))
            .when(y <= F.lit(cut), F.lit("bulk"))
            .when(y > F.lit(cut), F.lit("tail")))
