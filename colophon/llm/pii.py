"""Personal data by pattern, checksum and context (native columns only).

Regular expressions propose spans; validators confirm them (Luhn for cards,
mod 97 for IBANs, part and digit bounds for addresses and phone numbers); words
before and after a span move its score up or down.  Everything is a Spark column:
the text is split at the matches, and positions are running sums of the pieces'
lengths, so no position needs a second search.  Context is read from the ends of
the neighbouring pieces, never by cutting the whole text at a position.

The patterns use possessive loops and start only where a match can start, which
finds the same leftmost non-overlapping matches as the plain patterns.  Arrays
that several places read are bound to a lambda variable (:func:`bound`), which
evaluates them once; so time grows in proportion to the text, however many
matches it has.

Defined results: null text counts as empty and has no spans; rows are handled
one by one, so repeated ids each get their row; extra columns are ignored; an
empty table gives an empty result; positions count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which equal starts are listed.  kind: (pattern, score without context)
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.7),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", 0.8),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3),
    "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", 0.3),
}
BASE = ("email", "ip", "card", "phone")
#: A cheap test that a text must pass before its kind's pattern runs (with a digit, but for email).
HINT = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "address|server|host|login|addr",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|tax",
    "secret": "token|secret|passw|api.?key|credential",
}
#: Words that make a span less likely to be personal.
AGAINST = {
    "email": "noreply|example",
    "ip": "version|release|section|chapter",
    "card": "isbn|order|serial|tracking|sample|test",
    "phone": "version|score|example",
    "iban": "serial|part no|version|example|sample|test",
    "ssn": "serial|part no|version|example|sample",
    "secret": "commit|checksum|digest|sha1|sha256|md5|example",
}
CONTEXT_CHARS = 40
CONTEXT_GAIN = 0.3
CONTEXT_LOSS = 0.4
#: Kinds outside the base need this score; base kinds stay and carry theirs.
ACCEPT = 0.5
_BLOCK = 64
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _before(lengths: Column) -> Column:
    """Exclusive running sums of an int array: within blocks of _BLOCK, then over the blocks' totals."""

    def scan(values: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("each"))
        return F.aggregate(values, start, lambda a, x: F.struct((a.sum + x).alias("sum"), F.concat(a.each, F.array(a.sum)).alias("each")))

    def join(blocks: Column) -> Column:
        starts = scan(F.transform(blocks, lambda b: b.sum)).each
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b.each, lambda x: x + s)))

    def cut(all_lengths: Column) -> Column:
        n = F.floor((F.size(all_lengths) - 1) / F.lit(_BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda b: scan(F.slice(all_lengths, b * _BLOCK + 1, F.lit(_BLOCK))))

    return bound(bound(lengths, cut), join)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod97(plain: Column) -> Column:
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, "(?!$)"), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return bound(_digits(match), lambda d: F.length(d).between(12, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return bound(F.replace(match, F.lit(" "), F.lit("")), lambda p: F.length(p).between(15, 34) & _mod97(p))
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _kind_spans(rank: int, kind: str, pattern: str, score: float) -> Column:
    """The accepted spans of one kind in ``_t``."""
    width = CONTEXT_CHARS

    def spans(x: Column) -> Column:
        """``x``: matches, gaps around them, where each gap starts, and the pieces' first and last characters."""

        def span(i: Column) -> Column:
            start = F.get(x.at, i) + F.length(F.get(x.gaps, i))
            # no match is empty, so `width` pieces hold at least half as many characters; gaps may be empty
            left = F.when(F.length(F.get(x.tails, i * 2)) >= width, F.get(x.tails, i * 2)).otherwise(
                F.array_join(F.slice(x.tails, F.greatest(i * 2 + 1 - 2 * width, F.lit(1)), F.least(i * 2 + 1, F.lit(2 * width + 1))), "")
            )
            right = F.when(F.length(F.get(x.heads, i * 2 + 2)) >= width, F.get(x.heads, i * 2 + 2)).otherwise(F.array_join(F.slice(x.heads, i * 2 + 3, F.lit(2 * width + 1)), ""))
            # a line break between them, so that no word is joined across the span
            near = F.concat(F.right(left, F.lit(width)), F.lit("\n"), F.left(right, F.lit(width)))
            parts = F.struct(start.alias("start"), F.get(x.found, i).alias("value"), near.alias("near"))

            def points(s: Column) -> Column:
                gain = F.when(s.near.rlike(f"(?i){CONTEXT[kind]}"), CONTEXT_GAIN).otherwise(0.0)
                loss = F.when(s.near.rlike(f"(?i){AGAINST[kind]}"), CONTEXT_LOSS).otherwise(0.0)
                total = F.round(F.least(F.greatest(F.lit(score) + gain - loss, F.lit(0.0)), F.lit(1.0)), 2)
                return F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), (s.start + F.length(s.value)).alias("end"), F.lit(kind).alias("kind"), s.value.alias("value"), total.alias("score"))

            return bound(parts, points)

        sound = F.filter(F.sequence(F.lit(0), F.size(x.found) - 1), lambda i: _valid(kind, F.get(x.found, i)))
        return F.transform(sound, span)

    def pieces(x: Column) -> Column:
        lengths = F.zip_with(x.gaps, x.found, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        ends = lambda cut: F.flatten(F.zip_with(x.gaps, x.found, lambda g, m: F.array(cut(g, F.lit(width)), F.coalesce(cut(m, F.lit(width)), F.lit("")))))
        more = F.struct(x.found.alias("found"), x.gaps.alias("gaps"), _before(lengths).alias("at"), ends(F.right).alias("tails"), ends(F.left).alias("heads"))
        return bound(more, spans)

    may = F.contains("_t", F.lit(HINT[kind])) if kind in HINT else F.lit(True)
    found = F.when(may if kind == "email" else may & F.col("_d"), F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)))
    kept = bound(found, lambda m: F.when(F.size(m) > 0, bound(F.struct(m.alias("found"), F.split("_t", pattern, -1).alias("gaps")), pieces)))
    if kind not in BASE:
        kept = F.filter(kept, lambda s: s.score >= ACCEPT)
    return F.coalesce(kept, F.array().cast(_SPANS))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): every accepted span, by start and then kind.

    A span is struct(start, rank, end, kind, value, score).
    """
    df = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    df = df.select("_id", "_t", F.col("_t").rlike("[0-9]").alias("_d"))
    found = [_kind_spans(rank, kind, *rule) for rank, (kind, rule) in enumerate(KINDS.items())]
    return df.select(F.col("_id").alias(id_col), F.array_sort(F.concat(*found)).alias("spans"))


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, base digest, span list and scores (in the list's order) of :func:`find_spans`' result."""
    text = lambda s: F.concat_ws(":", s.kind, s.start, s.end)
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return spans.select(
        F.col(id_col),
        *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_join(F.transform("spans", lambda s: s.score.cast("string")), ",").alias("scores"),
    )
