"""Bibliographic payloads as rows: JSON works, JSON search hits and Atom entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.functions import venues as V
from colophon.functions.papers import OPEN_STATUSES, strip

_SOURCE = "struct<source:struct<display_name:string>>"
WORK = f"""struct<id:string,title:string,doi:string,type:string,publication_year:int,cited_by_count:long,authorships:array<struct<author:struct<display_name:string>>>,
primary_location:{_SOURCE},locations:array<{_SOURCE}>,open_access:struct<is_oa:boolean,oa_status:string,oa_url:string>>"""
HIT = "struct<title:string,year:int,venue:string,url:string,citationCount:long,authors:array<struct<name:string>>,externalIds:struct<DOI:string>,openAccessPdf:struct<url:string>>"


def _text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def _filled(c: Column) -> Column:
    return F.nullif(_text(c), F.lit(""))


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def work_row(payload: Column) -> Column:
    """A work's row; null where it does not parse or has no title.

    The venue is that of the primary location, else of the first other location
    that is no preprint server.  Closed works of freely hosted venues, or with a
    preprint, are open.  A work is published with a venue of a known level, or
    with a DOI where it is no preprint.
    """
    return once(F.from_json(payload, WORK), _work)


def _work(w: Column) -> Column:
    names = F.transform(F.coalesce(w.locations, F.array().cast(f"array<{_SOURCE}>")), lambda x: _text(x.source.display_name))
    preprint = lambda n: F.contains(F.lower(n), F.lit("arxiv"))
    venue = F.coalesce(_filled(w.primary_location.source.display_name), F.get(F.filter(names, lambda n: (n != "") & ~preprint(n)), F.lit(0)), F.lit(""))
    authors = F.filter(F.transform(w.authorships, lambda a: _filled(a.author.display_name)), lambda a: a.isNotNull())
    is_open, status = w.open_access.is_oa, w.open_access.oa_status
    has_preprint = F.exists(names, preprint)
    url = _filled(w.open_access.oa_url)

    def row(v: Column) -> Column:
        free = V.open_source(v).isNotNull() | has_preprint
        access = F.when(F.coalesce(is_open, F.lit(False)) | F.coalesce(status.isin(*OPEN_STATUSES), F.lit(False)), "open")
        access = access.when(F.coalesce(~is_open, F.lit(False)) | F.coalesce(status == "closed", F.lit(False)), F.when(free, "open").otherwise("closed")).otherwise("unknown")
        doi, level = T.doi(w.doi), V.venue_level(v)
        page = F.coalesce(url, F.concat(F.lit("https://doi.org/"), doi), F.lit(""))
        published = (v != "") & ~preprint(v) | (doi.isNotNull() & (F.coalesce(w.type, F.lit("")) != "preprint"))
        return F.struct(
            _text(w.title).alias("title"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), w.publication_year.alias("year"), v.alias("venue"), doi.alias("doi"), url.alias("pdf_url"), page.alias("page_url"),
            F.coalesce(w.cited_by_count, F.lit(0)).alias("citations"), published.alias("published"), level.alias("level"), access.alias("access"), F.when(F.contains(w.id, F.lit("/W")), F.element_at(F.split(w.id, "/"), -1)).alias("work_id"),
        )

    return F.when(_text(w.title) != "", once(venue, row))


def hit_rows(payload: Column) -> Column:
    """The rows of a search answer's ``data``; items that are no objects are skipped."""
    items = F.from_json(F.get_json_object(payload, "$.data"), f"array<{HIT}>")

    def row(x: Column) -> Column:
        names = F.filter(F.transform(x.authors, lambda a: a["name"]), lambda n: F.coalesce(n, F.lit("")) != "")
        empty = lambda c: F.coalesce(c, F.lit(""))
        return F.struct(_text(x.title).alias("title"), F.size(F.coalesce(names, F.array().cast("array<string>"))).alias("n_authors"), x.year.alias("year"), empty(x.venue).alias("venue"), F.nullif(x.externalIds.DOI, F.lit("")).alias("doi"), F.nullif(x.openAccessPdf.url, F.lit("")).alias("pdf_url"), F.coalesce(x.citationCount, F.lit(0)).alias("citations"), V.venue_level(empty(x.venue)).alias("level"))

    return F.transform(F.filter(items, lambda x: x.isNotNull()), row)


def atom_rows(feed: Column) -> Column:
    """The entries of an Atom feed: title, id without its version, year of publication, authors, venue and DOI."""
    entries = F.filter(F.split(feed, "<entry>"), lambda e: F.contains(e, F.lit("</entry>")))
    tag = lambda e, name: F.nullif(F.regexp_extract(e, rf"(?s)<{name}[^>]*>\s*(.*?)\s*</{name}>", 1), F.lit(""))

    def row(e: Column) -> Column:
        url = F.coalesce(tag(e, "id"), F.lit(""))
        key = F.regexp_replace(F.when(F.contains(url, F.lit("/abs/")), F.element_at(F.split(url, "/abs/"), -1)).otherwise(""), r"v[0-9]+$", "")
        names = F.regexp_extract_all(e, F.lit(r"<name>\s*([^<]*?)\s*</name>"), F.lit(1))
        return F.struct(F.regexp_replace(F.coalesce(tag(e, "title"), F.lit("")), "\n", " ").alias("title"), key.alias("key"), F.substring(tag(e, "published"), 1, 4).try_cast("int").alias("year"), F.size(F.filter(names, lambda n: n != "")).alias("n_authors"), F.coalesce(tag(e, "arxiv:journal_ref"), F.lit("")).alias("venue"), tag(e, "arxiv:doi").alias("doi"))

    return F.transform(entries, row)
