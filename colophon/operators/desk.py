"""Small rules of listings, logs and tasks: orders, prefixes, unions, windows of pages, two-pass matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, key: str, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key, numbered; the limit is applied before the exchange too."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn(name, rank).where(F.col(name) <= n)


def page_slice(rows: DataFrame, key: str, order: list[Column], offset: int, size: int) -> DataFrame:
    """Rows offset+1 to offset+size of each key."""
    return first_of_each(rows, key, order, offset + size).where(F.col("rank") > offset)


def in_source_order(batches: list[DataFrame], order: str) -> DataFrame:
    """All batches one after the other: (source_pos, pos) is the place of a row."""
    parts = [b.withColumn("source_pos", F.lit(i)) for i, b in enumerate(batches)]
    return reduce(DataFrame.unionByName, parts).withColumn("pos", F.row_number().over(W.partitionBy("source_pos").orderBy(order)) - 1)


def between_years(rows: DataFrame, year: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Years within the bounds that are set; rows without a year stay only if none is."""
    if low is None and high is None:
        return rows
    y = F.col(year)
    return rows.where((y >= low if low is not None else F.lit(True)) & (y <= high if high is not None else F.lit(True)))


def within_windows(marks: DataFrame, units: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Marks whose place lies between the least start and the largest end of their key's units."""
    span = units.groupBy(key).agg(F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    return marks.join(span, key).where(F.col(at).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def two_pass_match(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, pos, href, pass): the first entry of the same title, else the first that contains the target or is contained.

    entries: (pos, title, href), targets: (target_id, title), both normalised.  Titles are
    compared once each; a title and one within it meet in the shorter's first
    three characters (or all, if fewer).
    """
    e = entries.where("title <> ''").groupBy("title").agg(F.min(F.struct("pos", "href")).alias("first"))
    t = targets.where("title <> ''")
    names = t.select(F.col("title").alias("want")).distinct()
    head = lambda c: F.substring(c, 1, 3)

    def grams(c: Column) -> Column:
        of = lambda n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.explode(F.array_distinct(F.concat(of(1), of(2), of(3))))

    inner = names.withColumn("gram", head("want")).join(e.select("title", "first", grams(F.col("title")).alias("gram")), "gram")
    outer = e.withColumn("gram", head("title")).join(names.select("want", grams(F.col("want")).alias("gram")), "gram")
    cols = ["want", "title", "first"]
    hits = inner.select(cols).unionByName(outer.select(cols)).where(F.contains("title", F.col("want")) | F.contains("want", F.col("title")))
    best = hits.groupBy("want").agg(F.min(F.struct((F.col("title") != F.col("want")).cast("int").alias("pass"), "first.pos", "first.href")).alias("best"))
    return t.join(best, F.col("title") == F.col("want")).select("target_id", "best.pos", "best.href", "best.pass")


def acronym_mentions(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(query_id, acronym): capitals of three letters and more in a title that stand, lower case, in the question."""
    words = titles.select(F.explode(F.regexp_extract_all("title", F.lit("([A-Z]{2,})"), F.lit(1))).alias("w")).where(F.length("w") >= 3).select(F.lower("w").alias("acronym")).distinct()
    low = questions.select("query_id", F.lower("text").alias("text"))
    # questions are cut into pieces of the acronyms' lengths, so the join is on the whole acronym
    lengths = F.broadcast(words.select(F.length("acronym").alias("n")).distinct().agg(F.collect_list("n").alias("ns")))  # one row of few lengths
    sized = low.crossJoin(lengths).select("query_id", "text", F.explode("ns").alias("n")).where(F.length("text") >= F.col("n"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1), lambda i: F.substring(F.col("text"), i, F.col("n")))
    asked = sized.select("query_id", F.explode(F.array_distinct(pieces)).alias("acronym"))
    return asked.join(words, "acronym").select("query_id", "acronym").distinct()


def marked_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, text): pages in order, each between its markers, blanks and blank lines collapsed."""
    number = F.col(page).cast("string")
    one = F.concat(F.lit("[Page "), number, F.lit("]\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n[Page "), number, F.lit(" end]"))
    rows = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), one.alias("t")))).alias("x"))
    joined = F.array_join(F.transform("x", lambda x: x.t), "\n\n")
    return rows.select(key, F.regexp_replace(F.regexp_replace(joined, "[ \t]+", " "), "\n{3,}", "\n\n").alias("text"))


def without_irrelevant(rows: DataFrame, key: str, irrelevant: Column, direct: Column, least: int = 20, most: int = 60) -> DataFrame:
    """Irrelevant rows of each result list go, if ``least`` others stay; lists of more than ``most`` rows and direct ones keep all."""
    flagged = rows.withColumn("_bad", F.coalesce(irrelevant, F.lit(False))).withColumn("_direct", F.coalesce(direct, F.lit(False)))
    lists = flagged.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(~F.col("_bad")).alias("_good"), F.max("_direct").alias("_all"))
    cut = lists.where((F.col("_n") <= most) & (F.col("_good") >= least) & ~F.col("_all")).select(key, F.lit(True).alias("_cut"))
    return flagged.join(cut, key, "left").where(~F.col("_bad") | F.col("_cut").isNull()).drop("_bad", "_direct", "_cut")


def with_question_terms(chunks: DataFrame, questions: DataFrame, key: str, run: str = "[\u4e00-\u9fff]{2,}") -> DataFrame:
    """Chunks that hold a run of characters of their question; all of them where none does or the question has no run."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(f"({run})"), F.lit(1)))
    asked = questions.select(key, terms.alias("_terms"))
    low = F.lower("text")
    flagged = chunks.join(asked, key, "left").withColumn("_hit", F.coalesce(F.exists("_terms", lambda t: F.contains(low, t)), F.lit(False)))
    some = flagged.where("_hit").select(key, F.lit(True).alias("_some")).distinct()
    return flagged.join(some, key, "left").where(F.col("_hit") | F.col("_some").isNull()).drop("_terms", "_hit", "_some")
