"""Recognising section headings in lines of text, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions.papers import heading_level, strip, word_count

# The known headings; True where a number may stand in front.
KNOWN_HEADINGS = (
    ("abstract", False, r"abstract|摘要"),
    ("introduction", True, r"introduction|引言|绪论|研究背景"),
    ("related_work", True, r"related\s+work|文献综述|相关工作"),
    ("method", True, r"(?:proposed\s*)?(?:method(?:ology)?s?|approach|model|方法|研究方法|模型)"),
    ("experiments", True, r"experiments?|experimental\s*results?|evaluation|实验|实验结果|结果与分析"),
    ("results", True, r"results?|findings|结果"),
    ("discussion", True, r"discussion|讨论"),
    ("conclusion", True, r"conclusions?|总结|结论|结论与展望"),
    ("references", False, r"references|bibliography|参考文献"),
)
NUMBER = r"(?:[0-9]+(?:\.[0-9]+)*[.、]?\s*)?"
TOP_IN_LINE = r"\b([IVXLC]+)[.、]\s*(INTRODUCTION|RELATED\s*WORKS?|METHOD(?:OLOGY)?S?|EXPERIMENTS?|EXPERIMENTAL\s+RESULTS?|CONCLUSIONS?|DISCUSSION)\b"
ABSTRACT = r"(?i)^\s*(abstract|摘要)(?:\s|[—–-])"
REFERENCES = r"(REFERENCES|BIBLIOGRAPHY|参考文献)\s*$"
LETTER, ROMAN, DECIMAL = r"^([A-Z])[.、]\s+(.+)$", r"^([IVXLC]+)[.、]\s+(.+)$", r"^([0-9]+(?:\.[0-9]+)*)[.、]?\s+(.+)$"
TAIL = r"(\s+where\s+|\s+Reference\s+Patch\b).*$"
# Words that end no heading, and words that open a clause.
LAST_WORDS = (
    "a an the of to in on for with and or as by at from into than that this these those is are was were be been has have had will would can could may might "
    "should shall do does did not no but its it their our your my his her we they"
).split()
CLAUSE_WORDS = "since although while when because if as however moreover furthermore specifically notably given though whereas unlike despite".split()


def known_heading(title: Column) -> Column:
    """The name of a known heading; null for others."""
    t = F.regexp_replace(strip(title), "[:：]+$", "")
    out = F.lit(None).cast("string")
    for name, numbered, words in reversed(KNOWN_HEADINGS):
        out = F.when(t.rlike(rf"(?i)^{NUMBER if numbered else ''}(?:{words})\s*$"), name).otherwise(out)
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def section_heading(line: Column) -> Column:
    """struct(title, norm, level, numbered) of a line that is a heading; null for others.

    Prefixes and tokens go first, then lines of at most 120 characters with a
    letter, Roman or decimal number in front, whose rest must look like a title.
    """
    return once(F.regexp_replace(F.regexp_replace(strip(line), r"\s+", " "), "[:：]+$", ""), _heading)


def _heading(c: Column) -> Column:
    make = lambda title, norm, level, numbered: F.struct(title.alias("title"), norm.alias("norm"), level.cast("int").alias("level"), F.lit(numbered).alias("numbered"))
    part = lambda pattern, k: F.regexp_extract(c, pattern, k)
    other = lambda t: F.coalesce(known_heading(t), F.lit("other"))
    top = part(TOP_IN_LINE, 2)

    text = F.when(c.rlike(LETTER), F.regexp_replace(part(LETTER, 2), TAIL, "")).when(c.rlike(ROMAN), part(ROMAN, 2)).when(c.rlike(DECIMAL), part(DECIMAL, 2))
    text = F.trim(text)
    number = F.when(c.rlike(LETTER), part(LETTER, 1)).when(c.rlike(ROMAN), part(ROMAN, 1)).when(c.rlike(DECIMAL), part(DECIMAL, 1))
    split = F.struct(text.alias("text"), number.alias("number"), c.rlike(LETTER).alias("letter"), (c.rlike(DECIMAL) & ~c.rlike(LETTER) & ~c.rlike(ROMAN)).alias("decimal"), other(text).alias("norm"))
    numbered = F.when(number.isNotNull(), once(split, lambda x: _numbered(c, x, make)))

    return (
        F.when((F.coalesce(c, F.lit("")) == "") | c.rlike(r"(?i)\bet al\.?\s*$"), None)
        .when(c.rlike(ABSTRACT), make(part(ABSTRACT, 1), F.lit("abstract"), F.lit(1), False))
        .when(c.rlike(TOP_IN_LINE), make(F.concat_ws(". ", part(TOP_IN_LINE, 1), top), other(top), F.lit(1), True))
        .when(c.rlike(REFERENCES), make(part(REFERENCES, 1), F.lit("references"), F.lit(1), False))
        .when(F.length(c) > 120, None)
        .when(number.isNotNull(), numbered)
        .otherwise(once(known_heading(c), lambda name: F.when(name.isNotNull(), make(c, name, F.lit(1), False))))
    )


def _numbered(c: Column, x: Column, make: Callable[..., Column]) -> Column:
    """The heading of a line with a number in front; null where the rest is no title."""
    text, number, letter, decimal = x.text, x.number, x.letter, x.decimal
    words = word_count(text)
    first, last = F.lower(F.regexp_extract(text, r"^(\S+)", 1)), F.lower(F.regexp_extract(text, r"(\S+)$", 1))
    lead = F.regexp_extract(number, "^([0-9]+)", 1).try_cast("int")
    plain = x.norm == "other"
    no_title = (text == "") | (words > 14) | ~text.rlike(r"^[A-Za-z\x{4e00}-\x{9fff}]") | text.rlike(r"[{\[]")
    bad_letter = F.contains(text, F.lit(",")) | text.rlike(r"\b(?:19|20)[0-9]{2}\b")
    bad_decimal = (
        F.coalesce(lead > 20, F.lit(True))
        | (number.rlike("^0+$"))
        | (plain & (text.rlike("[,;]") | text.rlike(r"^\p{Ll}")))
        | (plain & ~F.contains(number, F.lit(".")) & (words < 2))
        | last.isin(*LAST_WORDS)
        | text.rlike(r"^[A-Za-z]\s*[0-9].*$")
        | text.rlike(r"\.\s+[A-Z]")
        | ((words > 8) & (first.isin(*CLAUSE_WORDS)))
    )
    refused = no_title | (letter & bad_letter) | (decimal & bad_decimal)
    level = F.when(letter, 2).otherwise(heading_level(number))
    return F.when(~F.coalesce(refused, F.lit(True)), make(F.when(letter, F.concat_ws(". ", number, text)).otherwise(c), x.norm, level, True))


def first_line_title(text: Column) -> Column:
    """The first line that is not blank, blanks collapsed, without outer punctuation."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*$"))
    line = F.regexp_replace(strip(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), r"\s+", " ")
    return F.regexp_replace(line, r"^[ \t.:;,_-]+|[ \t.:;,_-]+$", "")


def abstract(text: Column, heading: str = r"(?i)(?:^|\n)\s*(?:abstract|摘要)\b", stop: str = r"(?i)(?:^|\n)\s*(?:[IVXLC0-9]+\.?\s+)?(?:introduction|keywords|index\s*terms|参考文献)\b") -> Column:
    """The text between an abstract's heading and the next one; label lines are skipped; 5000 characters at most."""
    after = F.get(F.split(text, heading, 2), F.lit(1))
    body = F.get(F.split(after, stop, 2), F.lit(0))
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: (x != "") & ~x.rlike(r"(?i)^(?:keywords?|article info|graphical abstract)\b"))
    joined = F.regexp_replace(F.array_join(lines, " "), r"\s+", " ")
    return F.coalesce(F.substring(F.regexp_replace(joined, r"^[^\p{L}\p{N}_]+", ""), 1, 5000), F.lit(""))
