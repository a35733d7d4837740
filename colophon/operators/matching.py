"""Joins of questions with titles, names and lookups, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.functions import papers as P


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams."""
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array())


def title_mentions(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, paper_id): a naming word of the title stands anywhere in the question.

    questions (query_id, text), titles (paper_id, title).  Words have four
    letters and more, so a word and the questions that hold it meet in its first
    four; words are compared once, not once for each title that has them.
    """
    named = titles.select("paper_id", F.explode(P.title_words(F.col("title"))).alias("word"))
    words = named.select("word").distinct().withColumn("gram", F.substring("word", 1, 4))
    asked = questions.select("query_id", F.lower("text").alias("text"))
    held = asked.select("query_id", "text", F.explode(grams(F.col("text"), 4)).alias("gram")).join(words, "gram").where(F.contains("text", F.col("word")))
    return held.select("query_id", "word").join(named, "word").select("query_id", "paper_id").distinct()


def abbreviation_mentions(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, paper_id): a hyphenated abbreviation of the question, all of whose parts stand in the title's initials.

    Parts have two characters and more; the first two of the first part are the join key.
    """
    found = F.regexp_extract_all("text", F.lit("([A-Z][A-Z0-9-]*)"), F.lit(1))
    parts = F.transform(F.filter(found, lambda w: F.contains(w, F.lit("-"))), lambda w: F.filter(F.split(F.lower(w), "-"), lambda p: p != ""))
    asked = questions.select("query_id", F.explode(parts).alias("parts")).where((F.size("parts") >= 2) & F.forall("parts", lambda p: F.length(p) >= 2))
    asked = asked.withColumn("gram", F.substring(F.get("parts", F.lit(0)), 1, 2))
    named = titles.select("paper_id", P.title_initials(F.col("title")).alias("initials"))
    named = named.select("paper_id", "initials", F.explode(grams(F.col("initials"), 2)).alias("gram"))
    return asked.join(named, "gram").where(F.forall("parts", lambda p: F.contains(F.col("initials"), p))).select("query_id", "paper_id").distinct()


def unique_affix_match(questions: DataFrame, names: DataFrame, sizes: tuple[int, ...] = (4, 3, 2)) -> DataFrame:
    """(query_id, name): the first window of the question that names one name only.

    Longer windows go first, then earlier ones; a window may be the prefix of
    exactly one name or else the suffix of exactly one.
    """
    size = F.explode(F.array(*[F.lit(n) for n in sizes])).alias("size")
    cut = names.select("name", size).where(F.length("name") >= F.col("size"))
    once = lambda c, rank: cut.select(c.alias("part"), "name").groupBy("part").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1").select("part", "name", F.lit(rank).alias("side"))
    sides = once(F.expr("left(name, size)"), 0).unionByName(once(F.expr("right(name, size)"), 1))
    asked = questions.select("query_id", "text", size).where(F.length("text") >= F.col("size"))
    windows = asked.select("query_id", "size", F.posexplode(F.expr("transform(sequence(1, length(text) - size + 1), i -> substring(text, i, size))")).alias("pos", "part"))
    first = windows.groupBy("query_id", "size", "part").agg(F.min("pos").alias("pos"))
    order = F.struct((-F.col("size")).alias("s"), "pos", "side")
    return first.join(sides, "part").groupBy("query_id").agg(F.min_by("name", order).alias("name"))


def lookup_with_fallback(rows: DataFrame, found: DataFrame, key: str, title: str, value: str) -> DataFrame:
    """Adds ``value`` by key, and by title where the key found none; of several the least."""
    by_key = found.groupBy(key).agg(F.min(value).alias("_v1"))
    by_title = found.groupBy(title).agg(F.min(value).alias("_v2"))
    out = rows.join(by_key, key, "left").join(by_title, title, "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_v1", "_v2")


def keep_group_if_none(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """Rows that are hit; all rows of a group in which none is."""
    flagged = rows.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    some = flagged.where("_hit").select(group).distinct()
    return flagged.where("_hit").unionByName(flagged.where("NOT _hit").join(some, group, "left_anti")).drop("_hit")


def append_new(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The first row in order of each key that ``old`` lacks."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    return new.join(old.select(key).distinct(), key, "left_anti").withColumn("_r", rank).where("_r = 1").drop("_r")
