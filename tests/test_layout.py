"""Stripped figure text, page markers and caption spacing against plain walks over lines and characters."""

import random
import re

import pytest
from pyspark.sql import functions as F

from colophon.functions import text as T
from colophon.operators import markers, visuals
from colophon.plans import registry

POOL = [
    "Fig. 3. A short caption", "Figure 4: ends here.", "表 2. 说明", "TABLE IV. of all", "label", "two labels", "a = b", "x = y + z (12)", "1. Introduction", "IV. Results", "", "  ", "12.5 3.4 0.1", "+ 26.56", "Method PSNR SSIM", "算法 #12",
    "This line has more than seven latin words and it ends.", "seven words of latin text that do not end here", "noitnetta", "a vnoc b lexip", "The body begins", "(a) of a figure", "long " * 20, "这是一个很长的中文句子。", "end.", "(b) x", "12", "nothing to see", "图 5: 图",
]


def plain_walks(text, guarded):
    """The lines that remain, walking from every caption and marker."""
    lines = text.splitlines() if guarded else re.split(r"\r?\n", text)
    han = lambda t: len(re.findall(r"[一-鿿]", t))
    latin = lambda t: len(re.findall(r"[A-Za-z]{2,}", t))
    head = lambda t: bool(re.match(r"(?:[IVXLC]+|\d+(?:\.\d+)*|[A-Z])[.、]\s+[A-Za-z一-鿿]", t) or re.match(r"(?i).+=.+[（(]\s*\d+[a-z]?\s*[）)]$", t))
    long = lambda t: len(t) >= 60 and (han(t) >= 8 or latin(t) >= 8)

    def prose(t):
        return bool(t) and (head(t) or (han(t) >= 5 and t[-1] in "，。；！？") or (latin(t) >= 7 and t[-1] in ".!?") or long(t))

    def stop(t):
        if not t or re.match(r"(?i)(?:以及)?\s*[（(][a-z][）)]", t):
            return False
        return head(t) or bool(re.match(r"(?i)The|We|This|These|After|Following|前文|后文|我们|随后|因此|其中|为此|该方法|这些", t)) or long(t)

    def row(t):
        hits = re.findall("(?i)PSNR|SSIM|LPIPS|FSIM|Params|FLOPs|Method|Scene|Thin|Moderate|Thick|RICE|RSID|SateHaze", t)
        return bool(t) and (len(re.findall(r"\d+\.\d+", t)) >= 2 or (len(t) < 40 and t[0] in "+-±✓✗•●") or (len(hits) >= 2 and len(hits) / max(1, len(re.findall("[A-Za-z0-9]+", t))) > 0.5) or (len(t) <= 35 and bool(re.search(r"[#×\d]", t))))

    bare = [x.strip() for x in lines]
    goes_up = [not prose(t) and (not guarded or (0 < len(t) <= 40 and "=" not in t)) for t in bare]
    goes_down = [not prose(t) and (not guarded or row(t)) for t in bare]
    marked = [any(w.lower()[::-1] in visuals.VISUAL_WORDS for w in re.findall("[A-Za-z]{4,}", x)) for x in lines]
    captions = [i for i, x in enumerate(lines) if re.match(visuals.CAPTION.replace(visuals.SPACE, r"\s"), x)]
    gone = set()

    def walk(i, step, most, ok):
        for k in range(most):
            at = i + step * (k + 1)
            if not (0 <= at < len(lines) and ok(at)):
                break
            gone.add(at)

    for c in captions:
        gone.add(c)
        walk(c, -1, 40, goes_up.__getitem__)
        while c < len(lines) - 1 and not re.search("[.!?。！？]$", bare[c]):
            c += 1
            gone.add(c)
        walk(c, 1, 60, goes_down.__getitem__)
    groups = []
    for i in [i for i, m in enumerate(marked) if m]:
        if groups and i - groups[-1][-1] <= 20:
            groups[-1].append(i)
        else:
            groups.append([i])
    for g in groups:
        if len(g) > 1:
            gone.update(range(g[0], g[-1] + 1))
            walk(g[0], -1, 40, lambda at: not stop(bare[at]))
            walk(g[-1], 1, 60, lambda at: not stop(bare[at]))
    if not gone:
        return text
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for i, x in enumerate(lines) if i not in gone)).strip()


@pytest.mark.parametrize("guarded", [True, False])
def test_strip(spark, guarded):
    rng = random.Random(4)
    texts = ["\n".join(rng.choices(POOL, k=rng.randrange(60))) for _ in range(250)]
    texts += ["\n".join(rng.choices([p for p in POOL if "ig" not in p and "表" not in p and "TABLE" not in p and "图" not in p], k=25)) for _ in range(60)]
    texts += ["", "\n", "a\r\nFig. 1. x\r\ny", "label\n" * 50 + "Fig. 1. Done.\n" + "1.5 2.5\n" * 70, "noitnetta\n" + "x\n" * 19 + "noitnetta\n" + "y\n" * 80, "noitnetta\n" + "x\n" * 20 + "noitnetta"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r.stripped for r in visuals.strip_visuals(df, guarded=guarded).collect()}
    assert got.pop(-1) is None
    for i, t in enumerate(texts):
        assert got[i] == plain_walks(t, guarded), repr(t)
    assert sum(got[i] != t for i, t in enumerate(texts)) > 100 and sum(got[i] == t for i, t in enumerate(texts)) > 10


def test_strip_long_text(spark):
    """200,000 lines: each is sorted twice, none is walked."""
    lines = [POOL[i % len(POOL)] for i in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    assert visuals.strip_visuals(df).select(F.length("stripped")).first()[0] > 0


def plain_markers(text, pages):
    clean, kept, end, found = re.sub(r"\s+", "", text), [i for i, c in enumerate(text) if not c.isspace()], 0, []
    for n, page in pages:
        anchor = re.sub(r"\s+", "", page)[:80]
        at = clean.find(anchor, end) if len(anchor) >= 10 else -1
        if at >= 0:
            found.append((kept[at], n))
            end = at + len(anchor)
    for at, n in reversed(found):
        text = text[:at] + f"[Page {n}] " + text[at:]
    return text


def test_page_markers(spark):
    rng = random.Random(5)
    texts, pages, want = [], [], {}
    for i in range(60):
        parts = ["".join(rng.choices(["ab", "c ", " \n", "dé", "　", "f", " g"], k=rng.randrange(80))) for _ in range(rng.randrange(8))]
        text = "".join(p.replace("c ", "c  ") + rng.choice(["", "\n", " "]) for p in parts)
        mine = [(n + 1, p) for n, p in enumerate(parts)]
        if i % 3 == 0:
            rng.shuffle(mine)
            mine = [(n + 1, p) for n, (_, p) in enumerate(mine)]  # pages out of order are passed over
        texts.append((i, text))
        pages += [(i, n, p) for n, p in mine]
        want[i] = plain_markers(text, mine)
    texts += [(100, None), (101, "")]
    pages += [(100, 1, "some text of a page"), (102, 1, "some text of a page"), (5, 99, None)]
    got = {r.id: r.text for r in markers.with_page_markers(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(pages, "id long, page int, text string")).collect()}
    assert got == want | {100: None, 101: ""}
    assert sum("[Page" in t for t in want.values()) > 30


def plain_spacing(text):
    def cut(run):
        parts = re.findall("[0-9]+|[A-Za-z]+", run)
        if len(parts) > 1 and parts[-2][0].isdigit() and len(parts[-1]) <= 2:
            parts[-2:] = ["".join(parts[-2:])]
        return " ".join(parts)

    text = re.sub(r"(?i)\b(table|fig(?:ure)?\.?)(\d+)", r"\1 \2", text)
    text = re.sub("[A-Za-z0-9]+", lambda m: cut(m[0]), text)
    return re.sub(r"\s+", " ", re.sub(r"\.(?=[A-Za-z])", ". ", text)).strip()


def test_caption_spacing(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["Table", "Fig.", "figure", "1", "23", "a", "bc", "Def", ".", " ", "  ", "_", "×", "é", "\n", "2K"], k=rng.randrange(14))) for _ in range(800)]
    texts += ["Table1Manga109datasetforDF2K.Then", "DF2K", "ViT", "x4", "4x", "a1b2c3de", "a1b2c3def", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.caption_spacing(F.col("t")).alias("s")).collect()
    assert [(r.t, r.s) for r in got if r.s != plain_spacing(r.t)] == []


def test_words_of_tables_are_shuffled_by_page_only(spark, tmp_path):
    """Lines, rows and columns of words are found where their document lies."""
    text = "\n".join(["Table one a b", "1.5 2.5 3.5", "plain words here", "4 5 6"] * 5)
    spark.createDataFrame([(i, text) for i in range(5)] + [(7, None), (8, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.QUERIES["table_bodies"](spark, str(tmp_path))
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", out._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("row#" in k or ", i#" in k for k in keys)
    assert sorted((r.page, r.id) for r in out.collect()) == [(p, i) for p in range(5) for i in (0, 12)]
