"""Scalar text rules as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_MARKER = r"\[Page [0-9]+( end)?\]"


def clean_text(text: Column) -> Column:
    """Unix line ends, no control characters, at most one blank line, one line end at the end."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    t = F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.when(t == "", t).otherwise(F.concat(t, F.lit("\n")))


def tokens(text: Column) -> Column:
    """Words between white space, as they are."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def title_norm(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def doi(value: Column) -> Column:
    """A DOI without resolver prefix; blank is null."""
    return F.nullif(F.regexp_replace(F.trim(value), r"(?i)^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def arxiv_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf)/([^/?#\s]+)", 1)
    return F.lower(F.regexp_replace(found, r"v[0-9]+$", ""))


def language_label(text: Column) -> Column:
    """zh, en, mixed or unknown from the counts of Han and Latin letters."""
    zh, latin = F.regexp_count(text, F.lit("[一-鿿]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return (
        F.when((zh == 0) & (latin == 0), "unknown")
        .when((zh > 0.35 * latin) & (latin < 0.35 * zh), "zh")
        .when(zh < 0.08 * latin, "en")
        .otherwise("mixed")
    )


def publication_year(text: Column) -> Column:
    """The year of an arXiv stamp, else the largest 20xx word start; null if none."""
    stamp = F.regexp_extract(text, r"(?i)arxiv:\s*([0-9]{2})[0-9]{2}[.]", 1)
    years = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-9]{2})"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(stamp != "", stamp.cast("int") + 2000).otherwise(F.array_max(years))


def score_from_reply(reply: Column, default: int = 3) -> Column:
    """All digits of a reply as one number, held to 1..5."""
    n = F.regexp_replace(reply, "[^0-9]", "").try_cast("bigint")
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(n, F.lit(default)))).cast("int")


def short_title(text: Column, n: int = 30) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def caption_spacing(text: Column) -> Column:
    """Blanks where the text layer of a page lost them.

    Between label and number, between letters and digits of one run (a run's last digits keep one
    or two letters that end it, as in "DF 2K"), and behind a full stop before a letter.
    """
    t = F.regexp_replace(text, r"(?i)\b(table|fig(?:ure)?\.?)([0-9]+)", "$1 $2")
    t = F.regexp_replace(t, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])(?![A-Za-z]{1,2}(?![A-Za-z0-9]))", " ")
    t = F.regexp_replace(t, r"\.(?=[A-Za-z])", ". ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
