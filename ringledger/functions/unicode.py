"""Unicode decomposition, which Spark's functions lack: Arrow batches, and only texts beyond ASCII are decomposed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ringledger.functions.text import SUFFIX, squeezed


@F.pandas_udf(StringType())
def unmarked(x: pd.Series) -> pd.Series:
    """NFKD without combining marks."""

    def one(s: str | None) -> str | None:
        if s is None or s.isascii():
            return s
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    return x.map(one, na_action="ignore")


def plain_name(x: Column) -> Column:
    """Lower case, decomposed, without marks and suffix, single blanks."""
    return F.trim(F.regexp_replace(squeezed(F.lower(unmarked(x))), SUFFIX, ""))


def letters(x: Column) -> Column:
    """Lower case ASCII letters and blanks only, single blanks; for comparing names."""
    return squeezed(F.regexp_replace(F.lower(unmarked(x)), r"[^a-z\s]", ""))


def leading(x: Column, n: int, head: int = 100) -> Column:
    """The first n words of letters(x), joined by a blank.

    Decomposition goes letter by letter, so that a head of the text in which n + 1 words have ASCII letters is enough;
    only the other texts go through whole.
    """
    start = F.left(x, F.lit(head))
    enough = start.rlike(rf"^(?:[^A-Za-z]*[A-Za-z]\S*\s){{{n}}}[^A-Za-z]*[A-Za-z]")
    return F.array_join(F.slice(F.split(letters(F.when(enough, start).otherwise(x)), " "), 1, n), " ")
