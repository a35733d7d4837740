"""Rules of scholarly text as Spark columns; a null input gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a table's header, and words that open a sentence.
METRICS = "PSNR|FSIM|LPIPS|SSIM|Params|FLOPs|Accuracy|Precision|Recall|mAP|IoU|Dice|F1|MAE|RMSE|NDCG"
OPENERS = (
    "We|This|The|These|Those|In|For|Since|However|Moreover|Specifically|Notably|Given|Compared|Figure|Table|Our|Their|Its|A|An"
)
# Title words that name no paper.
COMMON_TITLE_WORDS = (
    "image", "lightweight", "network", "for", "the", "with", "attention", "transformer", "modulation", "super", "resolution", "deep",
    "guided", "unfolding", "prompt", "based", "multi", "window", "feature", "level", "fusion", "remote", "sensing", "collaborative",
    "heterogeneous", "expert", "mechanism", "learning", "approach", "method", "efficient", "novel", "scale", "toward", "using", "time",
)
# Metric and data set names of a table's header, and the words that route a question.
HEADER_NAMES = "PSNR|FSIM|LPIPS|SSIM|Params|FLOPs|Accuracy|Scene|Thin|Moderate|Thick|RICE|RSID|SateHaze|Urban|BSD|Manga|Set"
CHAT_WORDS = ("你好", "您好", "你是谁", "你是什么", "谢谢", "感谢", "再见", "hello", "hi")
CATALOG_WORDS = ("有什么论文", "有哪些论文", "几篇论文", "多少篇", "列举", "清单", "库里有什么", "库里有哪些")
INTRODUCE, LIBRARY_WORDS, HOW_WORDS = "介绍", ("论文库", "库里"), ("方法", "原理", "如何", "为什么", "技术")
OPEN_STATUSES = ("gold", "green", "hybrid", "bronze", "diamond")
FILE_KINDS = ("txt", "md", "pdf", "html", "htm")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def clean_lines(text: Column) -> Column:
    """Blank lines collapse first, then each line loses its outer blanks: the order can leave blank lines."""
    lines = F.split(F.regexp_replace(text, "\n{3,}", "\n\n"), "\n")
    return F.array_join(F.transform(lines, strip), "\n")


def squeeze_lines(text: Column) -> Column:
    """Runs of blanks and tabs become one blank, lines are stripped, at most one blank line stays."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    joined = F.array_join(F.transform(lines, lambda x: strip(F.regexp_replace(x, "[ \t]+", " "))), "\n")
    return strip(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def match_key(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def search_terms(text: Column) -> Column:
    """A query for a search interface; if no Latin word is left, only quotes and brackets go."""
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "))
    return F.when(plain == "", F.trim(F.regexp_replace(text, "[\"'()]", ""))).otherwise(plain)


def heading_level(number: Column) -> Column:
    """None and Roman numerals 1, a capital letter 2, decimals by their depth up to 3."""
    depth = F.regexp_count(number, F.lit(r"[.]")) + 1
    top = number.isNull() | number.rlike("^[IVXLC]*$")
    return F.when(top, 1).when(number.rlike("^[A-Z]$"), 2).otherwise(F.least(depth, F.lit(3))).cast("int")


def table_row(line: Column) -> Column:
    """A table's line: a deviation sign with a digit, two decimals, or two different metric names."""
    decimals = F.regexp_count(line, F.lit(r"[0-9]+\.[0-9]+"))
    names = F.size(F.array_distinct(F.regexp_extract_all(line, F.lit(f"(?i)({METRICS})"), F.lit(1))))
    return (F.contains(line, F.lit("±")) & line.rlike("[0-9]")) | (decimals >= 2) | (names >= 2)


def body_sentence(title: Column) -> Column:
    """A sentence that poses as a heading; an empty title counts as one."""
    t = strip(F.coalesce(title, F.lit("")))
    numbered = t.rlike(rf"(?i)^[0-9]+(\.[0-9]+)*[.\s]+({OPENERS})\s") & (word_count(t) > 6)
    plain = ~t.rlike(r"(?i)^([0-9]+|[IVXLC]+|[A-Z])\.?\s") & F.endswith(t, F.lit(".")) & (word_count(t) > 10)
    return (t == "") | numbered | plain


def authors(value: Column) -> Column:
    names = F.transform(F.split(value, r";|,|\band\b"), strip)
    return F.filter(names, lambda x: x != "")


def without_table_rows(text: Column, min_chars: int = 15) -> Column:
    """Lines of numbers and of metric names are left out.

    The first have three decimals and more, and more than a quarter of digits;
    the second two names and more, which are over half of the line's words.
    """

    def is_row(raw: Column) -> Column:
        line = strip(raw)
        digits, names = F.regexp_count(line, F.lit("[0-9]")), F.regexp_count(line, F.lit(f"(?i)(?:{HEADER_NAMES})"))
        numbers = (F.length(line) >= min_chars) & (F.regexp_count(line, F.lit(r"[0-9]+\.[0-9]+")) >= 3) & (digits > 0.25 * F.length(line))
        return numbers | ((names >= 2) & (names > 0.5 * F.greatest(F.regexp_count(line, F.lit("[A-Za-z0-9]+")), F.lit(1))))

    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~is_row(x)), "\n")


def intent(question: Column) -> Column:
    """chitchat, catalog or qa, by words anywhere in the question; to introduce the library is to list it, unless it is asked how."""
    low = F.lower(F.coalesce(question, F.lit("")))
    some = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    listing = some(CATALOG_WORDS) | (F.contains(low, F.lit(INTRODUCE)) & some(LIBRARY_WORDS) & ~some(HOW_WORDS))
    return F.when(some(CHAT_WORDS), "chitchat").when(listing, "catalog").otherwise("qa")


def title_words(title: Column) -> Column:
    """Distinct lower-case words of a title that can name it: four letters and more, not common.

    Parts of a hyphenated word count where its first part is upper case.
    """
    words = F.regexp_extract_all(title, F.lit("([A-Za-z][A-Za-z0-9-]*)"), F.lit(1))
    parts = F.flatten(F.transform(words, lambda w: F.when(w.rlike("^[A-Z][A-Z0-9]*-"), F.concat(F.array(w), F.split(w, "-"))).otherwise(F.array(w))))
    low = F.transform(parts, F.lower)
    return F.array_distinct(F.filter(low, lambda w: (F.length(w) >= 4) & ~w.isin(*COMMON_TITLE_WORDS)))


def title_initials(title: Column) -> Column:
    """First letters of a title's words and of their hyphenated parts, lower case."""
    parts = F.regexp_extract_all(F.regexp_replace(title, r"([A-Za-z][A-Za-z0-9]*)-", "$1- "), F.lit("([A-Za-z][A-Za-z0-9-]*)"), F.lit(1))
    return F.lower(F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))


def evidence_plan(n: Column, max_chars: int = 20000, chunk_chars: int = 800) -> Column:
    """Chunks for each of n papers: 1 to 3 as the room allows, 0 without papers."""
    room = F.floor(F.lit(max_chars) / (F.greatest(n, F.lit(1)) * chunk_chars))
    return F.when(n <= 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(3), room))).cast("int")


def year(value: Column) -> Column:
    n = F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))
    return F.when(n.between(1900, 2100), n)


def field_label(reply: Column, fallback: str = "other") -> Column:
    """The first line of a reply without quotes, brackets and closing marks."""
    first = F.split(strip(reply), "\n")[0]
    out = strip(F.regexp_replace(first, r"^[\"'`\[(]+|[\"'`\]).,;:!?]+$", ""))
    return F.when(F.coalesce(out, F.lit("")) == "", fallback).otherwise(out)


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine rounded to four places; a zero vector gives 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(F.round(dot(a, b) / norm, 4))


def json_object(text: Column, schema: str) -> Column:
    """The object between the first { and the last }; null where it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), schema)


def slug(title: Column) -> Column:
    """A heading without its number, lower case, blanks as underscores."""
    t = strip(F.coalesce(title, F.lit("")))
    for number in (r"^[0-9]+(\.[0-9]+)*[.、]?\s*", r"(?i)^[IVXLC]+[.、]\s*", r"^[A-Z][.、]\s*"):
        t = F.regexp_replace(t, number, "")
    return F.replace(F.lower(F.coalesce(F.nullif(strip(t), F.lit("")), F.lit("other"))), F.lit(" "), F.lit("_"))


def access_status(is_open: Column, status: Column, free_venue: Column, arxiv: Column) -> Column:
    """open or closed; a free venue and an arXiv id open what is not said to be open."""
    said = is_open | status.isin(*OPEN_STATUSES)
    return F.when(F.coalesce(said, F.lit(False)) | F.coalesce(free_venue | arxiv, F.lit(False)), "open").when(status == "closed", "closed")


def published(venue: Column, doi: Column, kind: Column) -> Column:
    has = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    return has(venue) | (has(doi) & (F.coalesce(kind, F.lit("")) != "preprint"))


def file_kind(path: Column) -> Column:
    """The lower-case extension of a readable file; null for others."""
    kind = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(kind.isin(*FILE_KINDS), kind)


def event_frame(event: Column, payload: Column) -> Column:
    """A server-sent event with a JSON payload."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(payload), F.lit("\n\n"))


def indexed_text(name: Column, base: Column, text: Column) -> Column:
    """A chunk as it is indexed: with its file and library in front."""
    return F.concat(F.lit("[file:"), name, F.lit("] [library:"), base.cast("string"), F.lit("] "), text)
