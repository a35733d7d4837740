"""Titles that are alike, without comparing all pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from colophon.functions import text as T
from colophon.operators.matching import grams

LIKE = 0.8


@F.pandas_udf(T_.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def alike(targets: DataFrame, candidates: DataFrame, least: float = LIKE) -> DataFrame:
    """(target_id, cand_id): normalised titles that are equal, contain one another, or match by more than ``least``.

    Both sides are (id, title).  Titles are compared once each, however many rows
    have them.  Two titles of together more than ten characters that match by
    more than 0.8 share three characters in a row: at most a fifth of all
    characters is unmatched, so the matched ones lie in too few blocks for all
    blocks to be shorter.  Shorter pairs and titles inside others meet by the
    shorter one's first characters.
    """
    t = targets.select(F.col("id").alias("target_id"), T.title_norm(F.col("title")).alias("t")).where("t <> ''")
    c = candidates.select(F.col("id").alias("cand_id"), T.title_norm(F.col("title")).alias("c")).where("c <> ''")
    left, right = t.select("t").distinct(), c.select("c").distinct()
    near = F.greatest(F.length("t"), F.length("c")) * least <= F.least(F.length("t"), F.length("c")) * (2 - least) + 1
    three = left.select("t", F.explode(grams(F.col("t"), 3)).alias("g")).join(right.select("c", F.explode(grams(F.col("c"), 3)).alias("g")), "g").select("t", "c")
    short = lambda x: F.length(x) <= 10
    ones = left.where(short("t")).select("t", F.explode(grams(F.col("t"), 1)).alias("g")).join(right.where(short("c")).select("c", F.explode(grams(F.col("c"), 1)).alias("g")), "g").select("t", "c")
    tiny = lambda d, a: d.where(F.length(a) < 3)
    held = lambda d, a: d.select(a, F.explode(F.concat(grams(F.col(a), 1), grams(F.col(a), 2))).alias("g"))
    inside = tiny(left, "t").withColumn("g", F.col("t")).join(held(right, "c"), "g").select("t", "c").unionByName(tiny(right, "c").withColumn("g", F.col("c")).join(held(left, "t"), "g").select("t", "c"))
    pairs = three.unionByName(ones).unionByName(inside).distinct()
    sure = F.contains("t", F.col("c")) | F.contains("c", F.col("t"))
    good = pairs.where(sure).unionByName(pairs.where(~sure & near).where(_ratio("t", "c") > least))
    return good.join(t, "t").join(c, "c").select("target_id", "cand_id")
