"""Replies and payloads in JSON, names of files, captions and addresses, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions.papers import strip

# File names that some systems reserve, and the fields of a report.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
REPORT_FIELDS = ("background", "motivation", "existing_problems", "solution", "contributions", "terms")
CAPTION = r"(?i)^\s*(?:(?:fig(?:ure)?\.?|table)\s*(?:[0-9]+[a-z]?|[IVXLCDM]+)\s*[:：.]|(?:图|表)\s*(?:[0-9]+[a-z]?|[IVXLCDM]+)\s*[:：.])"
LOOSE_TABLE = r"^\s*[Tt]able\s*(?:[0-9]+[a-z]?|[IVXLCDM]+)(?:\s*[A-Z]|$)"
CAPTION_NUMBER = r"(?i)^\s*(?:fig(?:ure)?\.?|table)\s*([0-9]+[a-z]?|[IVXLCDM]+)"
GLUED = "[A-Za-z]{19,}"


def _present(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) != ""


def json_array(reply: Column, schema: str) -> Column:
    """The array between the first [ and the last ], fences aside; null where it does not parse."""
    plain = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(F.nullif(F.regexp_extract(plain, r"(?s)\[.*\]", 0), F.lit("")), f"array<{schema}>")


def captions(reply: Column) -> Column:
    """Items (index, caption) of a reply that have both; null if none has."""
    items = F.filter(json_array(reply, "struct<index:long,caption:string>"), lambda x: x.index.isNotNull() & (F.coalesce(x.caption, F.lit("")) != ""))
    out = F.transform(items, lambda x: F.struct(x.index.alias("index"), strip(x.caption).alias("caption")))
    return F.when(F.size(out) > 0, out)


def outline_items(reply: Column) -> Column:
    """Items (title, level, page_start, page_end) of a reply that have a title; missing numbers are 1; null if none has."""
    raw = json_array(reply, "struct<title:string,level:long,page_start:long,page_end:long>")
    items = F.filter(raw, lambda x: F.coalesce(x.title, F.lit("")) != "")
    one = lambda c: F.when(F.coalesce(c, F.lit(0)) == 0, 1).otherwise(c).cast("long")
    out = F.transform(items, lambda x: F.struct(strip(x.title).alias("title"), one(x.level).alias("level"), one(x.page_start).alias("page_start"), one(x.page_end).alias("page_end")))
    return F.when(F.size(out) > 0, out)


def filter_of_reply(reply: Column) -> Column:
    """struct(field, year_min, year_max, authors, keywords, language) of the first flat object; empty defaults where there is none."""
    flat = F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"\{[^{}]*\}", 0), F.lit(""))
    get = lambda k: F.get_json_object(flat, f"$.{k}")
    year = lambda k: F.when(get(k).try_cast("int").between(1900, 2100), get(k).try_cast("int"))
    both = lambda k: F.coalesce(F.from_json(get(k), "array<string>"), F.when(_present(get(k)) & ~F.startswith(get(k), F.lit("[")), F.array(get(k))), F.array().cast("array<string>"))
    items = lambda k: F.filter(F.transform(both(k), strip), lambda x: F.coalesce(x, F.lit("")) != "")
    text = lambda k: F.coalesce(strip(get(k)), F.lit(""))
    return F.struct(text("field").alias("field"), year("year_min").alias("year_min"), year("year_max").alias("year_max"), items("authors").alias("authors"), items("keywords").alias("keywords"), text("language").alias("language"))


REVIEW = "struct<summary:string,contributions:array<string>,strengths:array<string>,major_issues:array<string>,minor_issues:array<string>,suggestions:array<string>,ratings:map<string,string>,recommendation:string,score:string>"


def review(payload: Column) -> Column:
    """A review's fields: lists without blank items, missing texts empty, a score only where it is a number."""
    p = F.from_json(payload, REVIEW)
    value = F.try_variant_get(F.try_parse_json(payload), "$.score", "variant")
    number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$", "double"))
    items = lambda k: F.coalesce(F.filter(F.transform(p[k], strip), lambda x: x != ""), F.array().cast("array<string>")).alias(k)
    text = lambda c, k: F.coalesce(strip(c), F.lit("")).alias(k)
    lists = [items(k) for k in ("contributions", "strengths", "major_issues", "minor_issues", "suggestions")]
    ratings = [text(F.try_element_at(p["ratings"], F.lit(k)), k) for k in ("novelty", "correctness", "experiments", "writing")]
    return F.struct(text(p["summary"], "summary"), *lists, F.struct(*ratings).alias("ratings"), text(p["recommendation"], "recommendation"), number.alias("score"))


def slides_markdown(payload: Column) -> Column:
    """The slides that have a title as Markdown: a numbered heading, bullets without blank ones, notes."""
    slides = F.from_json(F.get_json_object(payload, "$.slides"), "array<struct<title:string,bullets:array<string>,notes:string>>")
    kept = F.filter(slides, lambda s: _present(s.title))

    def one(s: Column, i: Column) -> Column:
        bullets = F.transform(F.filter(F.transform(F.coalesce(s.bullets, F.array().cast("array<string>")), strip), lambda b: b != ""), lambda b: F.concat(F.lit("- "), b))
        notes = F.when(_present(s.notes), F.array(F.concat(F.lit("  (notes) "), strip(s.notes)))).otherwise(F.array().cast("array<string>"))
        head = F.concat(F.lit("## Slide "), (i + 1).cast("string"), F.lit(": "), strip(s.title))
        return F.array_join(F.concat(F.array(head), bullets, notes), "\n")

    return F.coalesce(F.array_join(F.transform(kept, one), "\n"), F.lit(""))


def report_markdown(report: Column, labels: tuple[str, ...] = REPORT_FIELDS, missing: str = "no evidence") -> Column:
    """A report (map of texts) as Markdown with its fixed headings; missing fields say so."""
    blocks = [F.concat(F.lit(f"## {label}\n\n"), F.coalesce(F.try_element_at(report, F.lit(k)), F.lit(missing))) for k, label in zip(REPORT_FIELDS, labels, strict=True)]
    return F.array_join(F.array(*blocks), "\n\n")


def report_of_reply(reply: Column, paper_id: Column, title: Column, missing: str = "no evidence") -> Column:
    """struct(report, citations) of a reply's object: every field has a text, and citations carry the given paper, whatever they say."""
    p = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), "struct<report:map<string,string>,citations:array<struct<paper_id:string,paper_title:string,chunk_id:string,quote:string>>>")
    fields = [F.coalesce(F.try_element_at(p["report"], F.lit(k)), F.lit("[]" if k == "terms" else missing)).alias(k) for k in REPORT_FIELDS]
    own = F.transform(F.filter(p["citations"], lambda c: c.chunk_id.isNotNull() & c.quote.isNotNull()), lambda c: F.struct(paper_id.alias("paper_id"), title.alias("paper_title"), c.chunk_id.alias("chunk_id"), c.quote.alias("quote")))
    return F.struct(F.struct(*fields).alias("report"), F.coalesce(own, F.array().cast("array<struct<paper_id:string,paper_title:string,chunk_id:string,quote:string>>")).alias("citations"))


def layout_heading(block: Column) -> Column:
    """struct(title, level) of a layout block that is a heading: a title block, or a text block with a level; 120 characters at most."""
    get = lambda k: F.get_json_object(block, k)
    kind = get("$.type")
    title = F.when(kind == "title", get("$.content.title_content")).when((kind == "text") & get("$.text_level").isNotNull(), get("$.text"))
    level = F.when(kind == "title", get("$.content.level")).otherwise(get("$.text_level")).try_cast("int")
    text = strip(F.regexp_replace(strip(title), r"^#+\s*", ""))
    return F.when((F.coalesce(text, F.lit("")) != "") & (F.length(text) <= 120), F.struct(text.alias("title"), F.coalesce(level, F.lit(1)).alias("level")))


OWN_FIELDS = ("paper_id", "section", "page_start", "page_end", "char_start", "char_end")


def chunk_metadata(extra: Column) -> Column:
    """A chunk's own fields beside its other metadata, as one map of texts."""
    return F.map_concat(F.map_filter(extra, lambda k, _: ~k.isin(*OWN_FIELDS)), F.create_map(*[x for c in OWN_FIELDS for x in (F.lit(c), F.col(c).cast("string"))]))


def chunk_of_metadata(meta: Column, content: Column) -> Column:
    """struct of a chunk's own fields from its metadata, with their defaults, and ``extra``, what is left."""
    get = lambda k: F.try_element_at(meta, F.lit(k))
    number = lambda k, default: F.coalesce(get(k).cast("int"), default).alias(k)
    first = F.coalesce(get("page_start").cast("int"), F.lit(1))
    return F.struct(
        get("paper_id").cast("int").alias("paper_id"), F.coalesce(get("section"), F.lit("")).alias("section"), number("page_start", F.lit(1)), number("page_end", first), number("char_start", F.lit(0)), number("char_end", F.length(content)),
        F.map_filter(meta, lambda k, _: ~k.isin(*OWN_FIELDS)).alias("extra"),
    )


def reply_text(reply: Column) -> Column:
    """A reply's text: an object gives its ``content``, a list its parts' ``text``."""
    t = strip(F.coalesce(reply, F.lit("")))
    parts = F.from_json(t, "array<struct<text:string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, F.lit(""))), "")
    return F.when(F.startswith(t, F.lit("{")), F.coalesce(strip(F.get_json_object(t, "$.content")), F.lit(""))).when(F.startswith(t, F.lit("[{")), strip(F.coalesce(joined, t))).otherwise(t)


def source_file_name(title: Column, source: Column) -> Column:
    """source_title.pdf with anything but letters, digits, dot, underscore and hyphen as an underscore, 80 characters of title."""
    name = F.substring(F.regexp_replace(title, "[^A-Za-z0-9._-]+", "_"), 1, 80)
    return F.concat(source, F.lit("_"), F.when(name == "", "paper").otherwise(name), F.lit(".pdf"))


def url_file_name(url: Column) -> Column:
    """The last part of a URL's path as a safe file name of 180 characters at most, which keeps a short extension."""
    last = F.get(F.split(F.element_at(F.split(url, "/", -1), -1), r"\?", -1), F.lit(0))
    name = F.regexp_replace(F.regexp_replace(last, "[^A-Za-z0-9._-]", "_"), r"[ .]+$", "")
    name = F.when((F.length(name) > 180) & (F.substring(name, -4, 1) == "."), F.concat(F.substring(name, 1, 176), F.right(name, F.lit(4)))).when(F.length(name) > 180, F.substring(name, 1, 180)).otherwise(name)
    stem = F.upper(F.regexp_replace(name, r"\.[^.]*$", ""))
    return F.when((name == "") | stem.isin(*RESERVED), "paper.pdf").otherwise(name)


def first_link(links: Column, patterns: tuple[str, ...]) -> Column:
    """The first link of the first pattern that any link has."""
    of = lambda pattern: F.get(F.filter(links, lambda x: x.rlike(pattern)), F.lit(0))
    return F.coalesce(*[of(p) for p in patterns])


def caption_number(caption: Column) -> Column:
    """A caption's Arabic number; 0 for Roman ones and for panels such as 4a; null without a label."""
    label = F.nullif(F.regexp_extract(caption, CAPTION_NUMBER, 1), F.lit(""))
    return F.when(label.isNotNull(), F.coalesce(label.try_cast("int"), F.lit(0)))


def without_page_prefix(text: Column) -> Column:
    """A page's text without a page number line at its top and a caption within its first six lines.

    The caption goes up to the first line from it on that ends a sentence (the last line at most).
    """
    lines = F.split(text, "\n")
    body = F.when(F.get(lines, F.lit(0)).rlike(r"^\s*[0-9]+\s*$"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)

    def cut(x: Column) -> Column:
        at = lambda test, lo, hi: F.get(F.filter(F.sequence(lo, hi), test), F.lit(0))
        n = F.size(x)
        top = at(lambda i: F.get(x, i).rlike(r"(?i)^\s*(?:Fig(?:ure)?\.?)[ ]*[0-9]+[.:]"), F.lit(0), F.least(n, F.lit(6)) - 1)
        end = lambda t: F.coalesce(at(lambda i: F.get(x, i).rlike(r"[.!?]\s*$"), t, n - 1), n - 1)
        return F.when((n == 0) | top.isNull(), x).otherwise(F.slice(x, end(F.coalesce(top, F.lit(0))) + 2, n))

    return strip(F.array_join(F.get(F.transform(F.array(body), cut), F.lit(0)), "\n"))


def conference_pages(year: Column, recent: int) -> Column:
    """Index pages that may list a year's papers; without a year those of three recent years. A second series runs in odd years."""
    of = lambda y: F.when(y % 2 == 1, F.array(F.concat(F.lit("CVPR"), y.cast("string"), F.lit("?day=all")), F.concat(F.lit("ICCV"), y.cast("string"), F.lit("?day=all")))).otherwise(F.array(F.concat(F.lit("CVPR"), y.cast("string"), F.lit("?day=all"))))
    years = F.when(year.isNotNull(), F.array(year)).otherwise(F.array(*[F.lit(recent - i) for i in range(3)]))
    return F.flatten(F.transform(years, of))


def issue_of_year(label: Column, year: Column) -> Column:
    """A label such as AAAI-23 belongs to 2023; any year will do where none is asked."""
    issue = F.regexp_extract(label, "AAAI-([0-9]+)", 1).try_cast("int") + 2000
    return F.coalesce(issue.isNotNull() & (year.isNull() | (issue == year)), F.lit(False))


def volume_of_year(text: Column, year: Column) -> Column:
    key = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")
    return (F.contains(key, F.lit("icml")) | F.contains(key, F.lit("ecml"))) & (year.isNull() | F.contains(text, year.cast("string")))
