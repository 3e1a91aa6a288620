"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII but digits and lower-case letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; the optimizer would copy a plain expression into every use."""
    return F.transform(F.array(value), body)[0]


def ascii_words(text: Column) -> Column:
    """Words of letters and digits after lower-casing A-Z; null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def shingle_hashes(words: Column, k: int) -> Column:
    """A hash for each place of a k-word shingle; words must be a lambda variable or a stored column."""
    hashes = F.transform(words, lambda x, i: F.xxhash64(F.lit(k), x, *[F.get(words, i + j) for j in range(1, k)]))
    return F.slice(hashes, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def group_key(*names: str) -> Column:
    """One string for the values of columns; null, empty and other values stay apart."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in names])
