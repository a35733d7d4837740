"""Prose and formulas against the same rules written as backtracking patterns."""

import random
import re
import time

import pytest

from colophon.operators import scientific
from colophon.plans.registry import QUERIES

MATH = re.compile(r"(\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)|\$\$[\s\S]*?\$\$|\$(?!\$)(?:\\[^\n\r\u2028\u2029]|[^$\\])+\$)")
EQUATION = re.compile(r"^\s*(.+?=.+?)\s*[（(]\s*([0-9]+[a-z]?)\s*[）)]\s*$", re.I)
INDEXED = re.compile(r"([A-Za-zΘθΦφ][A-Za-z0-9]*)(\s*<(?:sub|sup)>[^<>]+</(?:sub|sup)>){1,2}", re.I)
TAG = re.compile(r"<(sub|sup)>([^<>]+)</(?:sub|sup)>", re.I)
NUMBERS = re.compile(r"\s*\\quad\s*(\(\s*[0-9]+[a-z]?\s*\))\s*$", re.I), re.compile(r"\s*\\tag\s*\{?\s*(?:\(\s*)?([0-9]+[a-z]?)(?:\s*\))?\s*\}?\s*$", re.I)


def latex(m):
    index = {}
    for kind, content in TAG.findall(m[0]):
        content = content.strip()
        index[kind.lower()] = rf"\mathrm{{{content}}}" if kind.lower() == "sub" and re.fullmatch("[A-Za-z]{2,}", content) else content
    return m[1] + (f"_{{{index['sub']}}}" if index.get("sub") else "") + (f"^{{{index['sup']}}}" if index.get("sup") else "")


def plain(text):
    out, at = [], 0

    def push(part):
        if part and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + part, False, None)
        elif part:
            out.append(("text", part, False, None))

    def prose(part):
        lines = re.split(r"\r?\n", part)
        for i, line in enumerate(lines):
            e = EQUATION.match(line)
            tags = lambda s: re.sub(r"(?i)&lt;(/?)(sub|sup)&gt;", r"<\1\2>", s)
            if e:
                out.append(("math", INDEXED.sub(latex, re.sub(r"\s+", " ", tags(e[1].strip()))), True, f"({e[2]})"))
            else:
                line, k = tags(line), 0
                for m in INDEXED.finditer(line):
                    push(line[k : m.start()])
                    out.append(("math", latex(m), False, None))
                    k = m.end()
                push(line[k:])
            if i < len(lines) - 1:
                push("\n")

    for m in MATH.finditer(text):
        if m.start() > at:
            prose(text[at : m.start()])
        size = 1 if m[0][0] == "$" and not m[0].startswith("$$") else 2
        content, number, display = m[0][size:-size].strip(), None, m[0].startswith(("\\[", "$$"))
        n = (NUMBERS[0].search(content) or NUMBERS[1].search(content)) if display else None
        if n:
            raw = re.sub(r"\s+", "", n[1])
            number, content = (f"({raw})" if raw[0].isdigit() else raw), content[: n.start()].strip()
        out.append(("math", content, display, number))
        at = m.end()
    if at < len(text):
        prose(text[at:])
    return out or [("text", text, False, None)]


@pytest.mark.parametrize("seed", range(6))
def test_against_patterns(seed):
    rng = random.Random(seed)
    parts = ["$", "$$", "\\[", "\\]", "\\(", "\\)", "\\", "\\$", "a", "x1", "Θ", " ", "\n", "\r\n", "=", "(1)", "（2a）", "( 3 )", "<sub>i</sub>", "<sup>2</sup>", "<SUB>max</SUB>", "&lt;sub&gt;k&lt;/sub&gt;", "<sub>", "</sub>", "\\quad (4)", "\\tag{5}", "\\tag", "12", "Y = a<sub>i</sub> (6)", "<sub>i</sup>", "　"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert scientific.segments(text) == plain(text), repr(text)


@pytest.mark.parametrize("kind", ["\\[", "\\(", "$", "$$", "\\$", "\\", "a", "=", "(", "<sub>", "a<sub>", "$ ", "$a$ ", "\\[a\\] ", "x<sub>i</sub> ", "a = b (1)\n", "\\tag ", "\\[\\tag"])
def test_long_texts_take_linear_time(kind):
    begin = time.perf_counter()
    out = scientific.segments(kind * (300_000 // len(kind)))
    assert time.perf_counter() - begin < 10 and out


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.pos): (r.kind, r.content, r.display, r.number) for r in QUERIES["scientific_segments"](spark, sf).collect()}
    texts = QUERIES["scientific_segments"].texts(spark, sf).collect()
    want = {(r.doc_id, i): s for r in texts if r.text is not None for i, s in enumerate(plain(r.text))}
    assert got == want and sum(s[0] == "math" for s in want.values()) > 100
