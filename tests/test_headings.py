"""Truth tables of headings, abstracts and regions."""

from pyspark.sql import functions as F

from colophon.functions import headings as H
from colophon.operators import regions, segments


def test_headings(spark):
    rows = [
        ("Introduction", ("Introduction", "introduction", 1, False)), ("2 Related Work:", ("2 Related Work", "related_work", 1, True)), ("III. Proposed Method", ("III. Proposed Method", "method", 1, True)),
        ("3.2.1 Loss of the Net", ("3.2.1 Loss of the Net", "other", 3, True)), ("B. Ablation study where x is", ("B. Ablation study", "other", 2, True)), ("Abstract—We show", ("Abstract", "abstract", 1, False)),
        ("12  REFERENCES", ("REFERENCES", "references", 1, False)), ("text before II. INTRODUCTION and after", ("II. INTRODUCTION", "introduction", 1, True)), ("参考文献", ("参考文献", "references", 1, False)),
        ("A. Smith, B. Jones", None), ("Jones et al.", None), ("25 Apples and pears", None), ("0 Nothing here", None), ("2 lower case start", None), ("3 Results, and more", None), ("4 Word", None), ("5 We go to", None),
        ("6 M 3 x", None), ("7 First thing. Second thing", None), ("8 Since methods that are built on this do sample from it", None), ("9 The {json} thing", None), ("C. In 1999 we saw", None), ("", None), ("plain words", None), ("10 " + "Word " * 15, None),
        (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    for r in df.select("i", "t", H.section_heading(F.col("t")).alias("h")).collect():
        assert (tuple(r.h) if r.h else None) == rows[r.i][1], r.t


def test_abstract_and_title(spark):
    text = "A Title.\n\nABSTRACT\nWe  show\nKeywords: none\nthis.\n\n1. Introduction\nbody"
    df = spark.createDataFrame([(text,), ("no such thing",), ("\n  \n -- First  line: \nx",)], "t string")
    got = df.select(H.abstract(F.col("t")).alias("a"), H.first_line_title(F.col("t")).alias("f")).collect()
    assert [r.a for r in got] == ["We show", "", ""] and [r.f for r in got] == ["A Title", "no such thing", "First  line".replace("  ", " ")]


def test_lines_of_a_page(spark):
    pages = spark.createDataFrame([(1, "Abstract x\n1 Introduction\nwords\nResults\nmore"), (2, "Results\nAccuracy F1 0.91 0.92\nDiscussion\ntext"), (3, "none")], "page int, text string")
    heads = segments.heading_lines(pages)
    assert [(r.page, r.title, r.offset) for r in heads.orderBy("page", "pos").collect()] == [(1, "Abstract", 0), (1, "1 Introduction", 11), (2, "Discussion", 30)]
    cut = segments.segments(pages, heads).orderBy("page", "begin").collect()
    assert [(r.page, r.section, r.begin, r.end) for r in cut] == [(1, "Abstract", 0, 11), (1, "1 Introduction", 11, 44), (2, "Discussion", 30, 45), (3, "whole text", 0, 4)]


def test_joint_regions(spark):
    rows = [(1, 1, "a", 0.0, 0.0, 50.0, 50.0), (1, 2, "a", 0.0, 80.0, 50.0, 100.0), (1, 3, "a", 55.0, 0.0, 90.0, 50.0), (1, 4, "b", 0.0, 101.0, 50.0, 110.0), (2, 1, "a", 0.0, 0.0, 9.0, 9.0), (1, 9, "a", 400.0, 400.0, 450.0, 450.0)]
    got = regions.joint_regions(spark.createDataFrame(rows, "page int, id int, number string, x0 double, y0 double, x1 double, y1 double"))
    assert sorted((r.page, r.region, r.n) for r in got.collect()) == [(1, 1, 3), (1, 4, 1), (1, 9, 1), (2, 1, 1)]
