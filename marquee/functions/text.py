"""String expressions (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex is ASCII-only unless (?U); these classes follow Python's Unicode \s and \w.
_WS = r"(?U)\s"
_NON_WORD = r"(?U)[^\p{L}\p{N}_\s]"
# fixed values: the characters Python's str.strip() removes (str.isspace)
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
                 "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_title(c) -> Column:
    """null -> "", lower, strip, runs of '_' -> ' ', whitespace runs -> ' ', drop non-word chars.

    The steps run in this order, so the result may keep double or trailing spaces
    where punctuation sat between spaces (same as the reference).
    """
    s = F.lower(F.coalesce(_col(c).cast("string"), F.lit("")))
    s = F.btrim(s, F.lit(PY_WHITESPACE))
    # '_' -> ' ' one by one: the next step folds every whitespace run (underscores
    # included) to one space, which equals folding '_+' first
    s = F.translate(s, "_", " ")
    s = F.regexp_replace(s, rf"{_WS}+", " ")
    return F.regexp_replace(s, _NON_WORD, "")


def normalize_category(c) -> Column:
    """str, strip, upper; whole value "NAN" or null -> "UNKNOWN" ("" stays "")."""
    s = F.upper(F.btrim(_col(c).cast("string"), F.lit(PY_WHITESPACE)))
    return F.when(s.isNull() | (s == "NAN"), F.lit("UNKNOWN")).otherwise(s)


def title_similarity(a, b) -> Column:
    """1 - levenshtein / max(len); 1.0 when both are empty."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        1.0 - F.levenshtein(a, b).cast("double") / longest)
