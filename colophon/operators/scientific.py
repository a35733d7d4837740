"""Text cut into prose and formulas.

Formulas stand between delimiters, with escapes inside single dollars, on a line of their own with
a number behind them, or are letters with HTML indices.  No rule of it looks twice at
a character in vain: where a closing delimiter is missing, that is known after one search, so texts of any
length take linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<kind: string, content: string, display: boolean, number: string>>"
_ENDS = "\n\r\u2028\u2029"
_NUMBER = re.compile(r"\\quad\s*(\(\s*[0-9]+[a-z]?\s*\))\s*\Z", re.I)
_TAG = re.compile(r"\\tag\s*\{?\s*(?:\(\s*)?([0-9]+[a-z]?)(?:\s*\))?\s*\}?\s*\Z", re.I)
_TAIL = re.compile(r"[（(]\s*([0-9]+[a-z]?)\s*[）)]\Z", re.I)
_ESCAPED = re.compile(r"&lt;(/?)(sub|sup)&gt;", re.I)
_INDEX = re.compile(r"<(sub|sup)>([^<>]+)</(sub|sup)>", re.I)
_BASE = re.compile(r"[A-Za-zΘθΦφ][A-Za-z0-9]*\Z")
_WORD = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


class _Closers:
    """Where the delimiters of one text close."""

    def __init__(self, text: str):
        self.text, self.gone = text, set()
        # dollars that no backslash escapes, and backslashes before a line end, which no formula passes
        self.events: list[tuple[int, bool]] = []
        run = 0
        for m in re.finditer(r"\\+|\$", text):
            if m[0] == "$":
                if run != m.start():
                    self.events.append((m.start(), True))
            elif len(m[0]) % 2:
                run = m.end()  # the run escapes what comes next
                if m.end() == len(text) or text[m.end()] in _ENDS:
                    self.events.append((m.end() - 1, False))
        self.at = [e[0] for e in self.events]

    def find(self, closer: str, start: int) -> int:
        if closer in self.gone:
            return -1
        at = self.text.find(closer, start)
        if at < 0:
            self.gone.add(closer)  # nor is there one for any later opening
        return at

    def dollar(self, opening: int) -> int:
        k = bisect_right(self.at, opening)
        return self.at[k] if k < len(self.at) and self.events[k][1] and self.at[k] > opening + 1 else -1


def formulas(text: str) -> Iterator[tuple[int, int, int]]:
    """(begin, end, size of the delimiters) of the delimited formulas, from left to right."""
    closers, at = _Closers(text), 0
    while True:
        found = [i for i in (closers.find("\\[", at), closers.find("\\(", at), closers.find("$", at)) if i >= 0]
        if not found:
            return
        at = min(found)
        if text[at] == "\\":
            end, size = closers.find("\\]" if text[at + 1] == "[" else "\\)", at + 2), 2
        else:
            end, size = (closers.find("$$", at + 2), 2) if text.startswith("$$", at) else (-1, 1)
            if end < 0 and text[at + 1 : at + 2] != "$":
                end, size = closers.dollar(at), 1
        if end < 0:
            at += 1
            continue
        yield at, end + size, size
        at = end + size


def _indexed(text: str) -> Iterator[tuple[int, int, str]]:
    """(begin, end, LaTeX) of letters with one or two HTML indices behind them."""
    tags, floor, k = list(_INDEX.finditer(text)), 0, 0
    while k < len(tags):
        tag = tags[k]
        stop = tag.start()
        while stop > floor and text[stop - 1].isspace():
            stop -= 1
        begin = stop
        while begin > floor and text[begin - 1] in _WORD:
            begin -= 1
        if begin > floor and text[begin - 1] in "ΘθΦφ":
            begin -= 1
        while begin < stop and text[begin].isdigit():
            begin += 1
        k += 1
        if begin == stop or not _BASE.match(text[begin:stop]):
            continue
        index = {tag[1].lower(): _index(tag)}
        end = tag.end()
        if k < len(tags) and not text[end : tags[k].start()].strip():
            index[tags[k][1].lower()] = _index(tags[k])
            end = tags[k].end()
            k += 1
        yield begin, end, text[begin:stop] + "".join(f"{mark}{{{index[kind]}}}" for kind, mark in (("sub", "_"), ("sup", "^")) if index.get(kind))
        floor = end


def _index(tag: re.Match) -> str:
    content = tag[2].strip()
    return rf"\mathrm{{{content}}}" if tag[1].lower() == "sub" and re.fullmatch("[A-Za-z]{2,}", content) else content


def _equation(line: str) -> tuple[str, str] | None:
    """(left and right side, number) of a line that is an equation with a number behind it."""
    bare = line.rstrip()
    open_ = max(bare.rfind("("), bare.rfind("（"))
    tail = _TAIL.match(bare, open_) if open_ >= 0 else None
    equals = line.find("=", 1)
    if not tail or equals < 0 or equals + 1 >= open_:
        return None
    return line[:open_].strip(), tail[1]


def segments(text: str) -> list[tuple[str, str, bool, str | None]]:
    """(kind, content, display, number); neighbouring prose is one segment, an empty text is one empty segment."""
    out: list[list] = []

    def prose(part: str) -> None:
        if part and out and out[-1][0] == "text":
            out[-1][1].append(part)
        elif part:
            out.append(["text", [part], False, None])

    def plain(part: str) -> None:
        for i, line in enumerate(re.split(r"\r?\n", part)):
            if i:
                prose("\n")
            equation = _equation(line)
            if equation:
                content = re.sub(r"\s+", " ", _ESCAPED.sub(r"<\1\2>", equation[0]))
                at, latex = 0, []
                for begin, end, formula in _indexed(content):
                    latex += [content[at:begin], formula]
                    at = end
                out.append(["math", ["".join(latex) + content[at:]], True, f"({equation[1]})"])
                continue
            line, at = _ESCAPED.sub(r"<\1\2>", line), 0
            for begin, end, formula in _indexed(line):
                prose(line[at:begin])
                out.append(["math", [formula], False, None])
                at = end
            prose(line[at:])

    at = 0
    for begin, end, size in formulas(text):
        if begin > at:
            plain(text[at:begin])
        content, number, display = text[begin + size : end - size].strip(), None, text[begin : begin + 2] in ("\\[", "$$") and size == 2
        if display:
            m = _last(_NUMBER, content, "\\quad") or _last(_TAG, content, "\\tag")
            if m:
                raw = re.sub(r"\s+", "", m[1])
                number, content = (f"({raw})" if raw[0].isdigit() else raw), content[: m.start()].strip()
        out.append(["math", [content], display, number])
        at = end
    if at < len(text):
        plain(text[at:])
    return [(kind, "".join(parts), display, number) for kind, parts, display, number in out] or [("text", text, False, None)]


def _last(pattern: re.Pattern, content: str, word: str) -> re.Match | None:
    """The number at the end: it can only stand behind the last such command."""
    at = content.lower().rfind(word)
    return pattern.match(content, at) if at >= 0 else None


def scientific_segments(text: Column) -> Column:
    """``SEGMENTS`` of each text; null gives null."""

    @F.pandas_udf(SEGMENTS)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [dict(zip(("kind", "content", "display", "number"), s, strict=True)) for s in segments(t)])

    return cut(text)
