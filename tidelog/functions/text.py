"""Small string helpers: blank handling, defaults, display cuts."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware classes, as log text is not always ASCII.
UNICODE = "(?U)"


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space, not only blanks."""
    return F.regexp_replace(c, UNICODE + r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*candidates: Column) -> Column:
    """First value that is neither null nor empty; the last candidate passes as it is."""
    *head, last = candidates
    return F.coalesce(*[blank_to_null(c) for c in head], last)


def cut(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def contains_any(c: Column, words: list[str]) -> Column:
    """True where any word occurs as a substring. Plain searches: an alternation is tried word by word at every place."""
    return reduce(lambda found, word: found | c.contains(word), words[1:], c.contains(words[0]))


def round_even(c: Column, digits: int) -> Column:
    """Half-to-even rounding."""
    return F.bround(c, digits)
