"""Column expressions that several operators share.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed
and carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank text."""
    bare = F.btrim(whole(text), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words_lower(text: Column) -> Column:
    return words(ascii_lower(whole(text)))


def sealed(value: Column) -> Column:
    """The same value, which the optimizer doesn't copy into conditions or projections above.

    A filter on a computed array would otherwise move below the projection and compute it anew for each use,
    within lambdas for each element.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
