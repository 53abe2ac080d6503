"""Analyzers as column expressions: everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of a stored token (fixed values: ASCII controls, then Unicode).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def tokens(value: Column) -> Column:
    """ASCII alphanumeric runs in lower case.  Extract first, lower second: some other letters lower to ASCII ones."""
    return F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def keyword(value: Column) -> Column:
    """The whole value as one token, in lower case and not trimmed."""
    return F.array(F.lower(value))


def trigrams(token: Column) -> Column:
    """All runs of three code points; none for shorter tokens."""
    n = F.length(token)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(token, i, F.lit(3)))
    return F.when(n >= 3, grams).otherwise(F.array().cast("array<string>"))


def clean_term(token: Column) -> Column:
    """A stored token as the analyzers would spell it: lower case, freed of white space at both ends; null if blank."""
    clean = F.lower(F.btrim(token, F.lit(WHITE_SPACE)))
    return F.nullif(clean, F.lit(""))
