"""Unicode forms that Spark has no function for, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """The compatibility composition; null stays null."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """The compatibility composition with case folded."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t).casefold())


def match_key(text: Column) -> Column:
    """Folded text without anything but letters, digits and underscores: the strict form of papers.match_key."""
    return F.regexp_replace(folded(text), r"[^\p{L}\p{N}_]+", "")
