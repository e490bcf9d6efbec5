"""Comparison keys of names, numbers and tax ids, as Column expressions.

Spark has no compatibility folding of Unicode; `folded` covers it with an Arrow-batched helper that is
only needed where text is not plain ASCII. The keys differ on purpose: names keep ``_`` as a letter in
one place and drop it in another, and tax ids are compared in three ways.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKC and casefold, for texts that are not plain ASCII."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def collapse(c: ColumnOrName) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def name_key(c: ColumnOrName, ascii_only: bool = True) -> Column:
    """Case, punctuation and spacing folded away; empty for null."""
    low = F.lower(_col(c)) if ascii_only else folded(_col(c))
    return F.coalesce(collapse(F.regexp_replace(low, r"(?U)[^\w\s]", " ")), F.lit(""))


def text_key(c: ColumnOrName, ascii_only: bool = True) -> Column:
    """Like `name_key`, with ``_`` folded away too."""
    low = F.lower(_col(c)) if ascii_only else folded(_col(c))
    return F.coalesce(F.trim(F.regexp_replace(low, r"(?U)[\W_]+", " ")), F.lit(""))


def tax_key(c: ColumnOrName) -> Column:
    """Collapsed spacing, upper case; empty for null."""
    return F.coalesce(F.upper(collapse(c)), F.lit(""))


def contact_tax_key(c: ColumnOrName) -> Column:
    """Letters and digits only, upper case."""
    return F.coalesce(F.regexp_replace(F.upper(_col(c)), r"(?U)[^\p{L}\p{N}]", ""), F.lit(""))


def number_key(c: ColumnOrName) -> Column:
    """Letters and digits of an invoice or order number, upper case; empty for null."""
    return F.coalesce(F.regexp_replace(F.upper(_col(c)), r"[^\p{L}\p{N}]", ""), F.lit(""))


def canonical_key(key: ColumnOrName) -> Column:
    """A number key without leading zeros in its runs of digits."""
    return F.regexp_replace(_col(key), r"(?<![0-9])0+(?=[0-9])", "")


def digits(key: ColumnOrName) -> Column:
    return F.regexp_replace(_col(key), r"[^0-9]", "")


def common_subsequence(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Length of the longest common subsequence of two short strings, by one array row per character."""
    a, b = _col(a), _col(b)
    none = F.array_repeat(F.lit(0), F.length(b) + 1)
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")

    def row(previous: Column, ch: Column) -> Column:
        def step(done: Column, j: Column) -> Column:
            fit = F.when(F.substring(b, j, F.lit(1)) == ch, F.element_at(previous, j) + 1)
            best = F.greatest(F.element_at(done, -1), F.element_at(previous, j + 1))
            return F.concat(done, F.array(F.coalesce(F.greatest(fit, best), best)))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), step)

    last = F.aggregate(chars(a), none, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(last, -1))


def ratio_200(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Similarity 0 to 100 that counts insertions and deletions; two empty strings are alike."""
    total = F.length(_col(a)) + F.length(_col(b))
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * common_subsequence(a, b) / total)


def number_similarity(a_key: ColumnOrName, b_key: ColumnOrName, least_digits: int = 4) -> Column:
    """The best of the keys', the canonical keys' and (with enough digits on both) the digits' ratio."""
    a, b = _col(a_key), _col(b_key)
    da, db = digits(a), digits(b)
    whole = F.greatest(ratio_200(a, b), ratio_200(canonical_key(a), canonical_key(b)))
    enough = (F.length(da) >= least_digits) & (F.length(db) >= least_digits)
    return F.when(enough, F.greatest(whole, ratio_200(da, db))).otherwise(whole)
