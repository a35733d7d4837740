"""Removal of figure and table text around captions, line by line.

The rules are a finite automaton that walks up and down from captions.  Each of its
walks ends at a line that can be named without walking: the nearest caption,
sentence end or forbidding line before or behind.  So a document's lines are sorted once forwards
and once backwards, and running maxima and minima tell for each line which walks reach it;
texts of any number of lines take linear time and stay in columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the rules: patterns, words and reaches.
SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"
CAPTION = rf"(?i)^{SPACE}*(?:(?:fig(?:ure)?\.?|table){SPACE}*(?:\d+[a-z]?|[IVXLCDM]+){SPACE}*[:：.]|(?:图|表){SPACE}*(?:\d+[a-z]?|[IVXLCDM]+){SPACE}*[:：.])"
HEADING = rf"^(?:[IVXLC]+|\d+(?:\.\d+)*|[A-Z])[.、]{SPACE}+[A-Za-z\x{{4e00}}-\x{{9fff}}]"
EQUATION = rf"(?i)^.+=.+[（(]{SPACE}*\d+[a-z]?{SPACE}*[）)]$"
BODY_START = r"(?i)^(?:The|We|This|These|After|Following|前文|后文|我们|随后|因此|其中|为此|该方法|这些)"
SUB_LABEL = rf"(?i)^(?:以及)?{SPACE}*[（(][a-z][）)]"
METRICS = r"(?i)(?:PSNR|SSIM|LPIPS|FSIM|Params|FLOPs|Method|Scene|Thin|Moderate|Thick|RICE|RSID|SateHaze)"
VISUAL_WORDS = ("anchor", "attention", "categorize", "conv", "downscale", "pixel", "prompting", "shuffle", "uncategorized")
SIGNS = ("+", "-", "±", "✓", "✗", "•", "●")
UP, DOWN, BETWEEN = 40, 60, 20
REVERSED = rf"(?i)(?:^|[^A-Za-z])(?:{'|'.join(w[::-1] for w in VISUAL_WORDS)})(?:[^A-Za-z]|$)"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
HAN, LATIN = r"[\x{4e00}-\x{9fff}]", r"[A-Za-z]{2,}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def _like(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def prose(t: Column, size: Column) -> Column:
    """Whether a stripped line is a heading, a numbered equation or running text; ``size`` is its length."""
    han, latin = _count(t, HAN), _count(t, LATIN)
    ends = ((han >= 5) & _like(t, "[，。；！？]$")) | ((latin >= 7) & _like(t, "[.!?]$"))
    return (t != "") & (_like(t, HEADING) | _like(t, EQUATION) | ends | ((size >= 60) & ((han >= 8) | (latin >= 8))))


def boundary(t: Column, size: Column) -> Column:
    """Whether a stripped line stops the walk from reversed labels."""
    long = (size >= 60) & ((_count(t, HAN) >= 8) | (_count(t, LATIN) >= 8))
    return (t != "") & ~_like(t, SUB_LABEL) & (_like(t, HEADING) | _like(t, EQUATION) | _like(t, BODY_START) | long)


def table_row(t: Column) -> Column:
    """Whether a stripped line looks like a row or head of a table."""
    hits, words = _count(t, METRICS), _count(t, "[A-Za-z0-9]+")
    short = (F.length(t) < 40) & F.substring(t, 1, 1).isin(*SIGNS)
    return (t != "") & ((_count(t, r"\d+\.\d+") >= 2) | short | ((hits >= 2) & (hits * 2 > F.greatest(F.lit(1), words))) | ((F.length(t) <= 35) & _like(t, r"[#×\d]")))


def marked_lines(docs: DataFrame, id_col: str, text_col: str, guarded: bool) -> DataFrame:
    """(id, pos, line, gone): each line and whether a walk removes it.

    ``guarded`` walks up over labels and down over table rows only; otherwise both ways over everything but running text.
    """
    text = F.col(text_col)
    lines = F.split(F.regexp_replace(text, rf"(?:{BREAKS})\z", ""), BREAKS) if guarded else F.split(text, r"\r?\n")
    rows = docs.where(text.isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(lines).alias("pos", "line")).withColumn("t", strip(F.col("line")))
    t, size = F.col("t"), F.length("t")
    if not guarded:  # the client counts UTF-16 units
        size = size + F.length(F.regexp_replace(t, r"[^\x{10000}-\x{10FFFF}]", ""))
    plain = ~prose(t, size)
    up = plain & (t != "") & (size <= 40) & ~t.contains("=") if guarded else plain
    down = plain & table_row(t) if guarded else plain
    flags = {"cap": _like(F.col("line"), CAPTION), "up": up, "down": down, "term": _like(t, "[.!?。！？]$"), "stop": boundary(t, size), "rev": _like(t, REVERSED)}
    rows = rows.select("id", "pos", "line", *[c.alias(n) for n, c in flags.items()])
    forward, back = W.partitionBy("id").orderBy("pos"), W.partitionBy("id").orderBy(F.desc("pos"))
    at = lambda c: F.when(F.col(c) if isinstance(c, str) else c, F.col("pos"))
    before = lambda c, near=0: F.max(at(c)).over(forward.rowsBetween(W.unboundedPreceding, -near))
    behind = lambda c, near=0: F.min(at(c)).over(back.rowsBetween(W.unboundedPreceding, -near))
    pos, none, far = F.col("pos"), F.lit(-1), F.lit(2**31 - 1)
    rows = rows.withColumns({
        "last_cap": before("cap"), "last_term": before("term", 1), "no_down": before(~F.col("down")), "last_stop": before("stop"), "last_rev": before("rev", 1),
        "next_cap": behind("cap", 1), "no_up": behind(~F.col("up")), "next_stop": behind("stop"), "next_rev": behind("rev", 1), "is_last": F.lag("pos").over(back).isNull(),
    })
    in_caption = F.col("last_cap").isNotNull() & (F.coalesce("last_term", none) < F.col("last_cap"))
    near_last, near_next = pos - F.col("last_rev") <= BETWEEN, F.col("next_rev") - pos <= BETWEEN
    near_last, near_next = F.coalesce(near_last, F.lit(False)), F.coalesce(near_next, F.lit(False))
    rows = rows.withColumns({
        "in_caption": in_caption, "is_end": in_caption & (F.col("term") | F.col("is_last")),
        "first": F.col("rev") & ~near_last & near_next, "last": F.col("rev") & near_last & ~near_next,
        "in_group": F.when(F.col("rev"), near_last | near_next).otherwise(F.coalesce(F.col("next_rev") - F.col("last_rev") <= BETWEEN, F.lit(False))),
    })
    rows = rows.withColumns({"last_end": before("is_end", 1), "next_first": behind("first", 1), "last_last": before("last", 1)})
    gone = [
        F.col("cap"), F.col("in_caption"), F.col("in_group"),
        F.col("up") & (F.col("next_cap") - pos <= UP) & (F.coalesce("no_up", far) >= F.col("next_cap")),
        F.col("down") & (pos - F.col("last_end") <= DOWN) & (F.coalesce("no_down", none) <= F.col("last_end")),
        (F.col("next_first") - pos <= UP) & (F.coalesce("next_stop", far) >= F.col("next_first")),
        (pos - F.col("last_last") <= DOWN) & (F.coalesce("last_stop", none) <= F.col("last_last")),
    ]
    return rows.select("id", "pos", "line", reduce(lambda a, b: a | b, [F.coalesce(g, F.lit(False)) for g in gone]).alias("gone"))


def strip_visuals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", guarded: bool = True) -> DataFrame:
    """(id, stripped): texts without the lines of figures and tables; texts without a caption or reversed labels are as they were.

    Ids are distinct.  Null texts give null.
    """
    lines = marked_lines(docs, id_col, text_col, guarded).groupBy("id").agg(F.max("gone").alias("some"), F.sort_array(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "line"))))["line"].alias("kept"))
    kept = strip(F.regexp_replace(F.array_join("kept", "\n"), r"\n{3,}", "\n\n"))
    both = docs.select(F.col(id_col), F.col(text_col).alias("_text")).join(lines.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"), "left")
    return both.select(F.col(id_col), F.when(F.coalesce("some", F.lit(False)), kept).otherwise(F.col("_text")).alias("stripped"))
