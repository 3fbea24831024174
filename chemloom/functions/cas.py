"""Column expressions for registry numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

FORM = r"^\d{1,9}-\d{2}-\d$"
STATUSES = ["valid", "bad_check", "bad_format"]


def is_cas(c: Column) -> Column:
    return F.coalesce(F.rlike(strip(c), F.lit(FORM)), F.lit(False))


def checksum(digits: Column, compat: bool = False) -> Column:
    """Weighted digit sum mod 10. The published rule leaves out the check digit itself; compat weighs it, too, with 1."""
    used = digits if compat else F.substring(digits, 1, F.length(digits) - 1)
    n = F.length(used)
    weighted = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.substring(used, i, F.lit(1)).try_cast("int"), F.lit(0)) * (n - i + 1))
    return F.aggregate(weighted, F.lit(0), lambda s, x: s + x) % 10


def status(c: Column, compat: bool = False) -> Column:
    """valid, bad_check or bad_format; null counts as bad_format."""
    digits = F.translate(strip(c), "-", "")
    right = checksum(digits, compat) == F.right(digits, F.lit(1)).try_cast("int")
    return F.when(~is_cas(c), "bad_format").when(right, "valid").otherwise("bad_check")


def first_cas(c: Column) -> Column:
    """The first blank-separated token that has the form once its brackets and commas are off; else the trimmed input."""
    tokens = F.transform(F.split(strip(c), r"\s+"), lambda x: F.btrim(x, F.lit("(),")))
    return F.coalesce(F.get(F.filter(tokens, lambda x: F.rlike(x, F.lit(FORM))), F.lit(0)), strip(c))


def compact(c: Column) -> Column:
    """Matching key: without hyphens and blanks."""
    return F.translate(c, "- ", "")
