"""Sweeps, grid joins, components and figure regions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import figures, graph, regions, spatial, sweeps

BOX = "page long, id long, x0 double, y0 double, x1 double, y1 double"


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(300 + rng.randrange(40), 300 + rng.randrange(40)) for _ in range(30)] + [(None, 5), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def boxes(rng, n, first, pages=3):
    out = []
    for i in range(n):
        x, y = rng.randrange(-50, 600), rng.randrange(800)
        out.append((rng.randrange(pages), first + i, float(x), float(y), float(x + rng.choice([0, 1, 50, 900])), float(y + rng.choice([0, 3, 200]))))
    return out


def test_touching(spark):
    rng = random.Random(2)
    a, b = boxes(rng, 300, 0), boxes(rng, 200, 1000)
    odd = [(None, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, None, 0.0, 1.0, 1.0), (1, 3, 9.0, 0.0, 1.0, 1.0)]
    got = spatial.touching(spark.createDataFrame(a + odd, BOX), spark.createDataFrame(b + odd, BOX), 40, 20)
    want = [(p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[4] + 40 and q[2] - 40 <= p[4] and p[3] <= q[5] + 20 and q[3] - 20 <= p[5]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    got.explain()  # an equi-join on cells, whatever its strategy
    assert "cx" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [3, 1])  # one key holds all rows
def test_running(spark, keys):
    rng = random.Random(3)
    rows = [(rng.randrange(keys), float(rng.randrange(50)), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df, order, band = spark.createDataFrame(rows, "k long, y double, i long, v long"), [F.col("y"), F.col("i")], F.floor(F.col("y") / 8)
    out = sweeps.running(df, ["k"], order, band, F.col("v"), "min", "low", inclusive=False)
    out = sweeps.running(out, ["k"], order, band, F.col("v"), "sum", "total")
    out = sweeps.running(out, ["k"], order, band, F.when(F.col("v").isNotNull(), F.struct("y", "i", "v")), "max", "last")
    for r in out.collect():
        before = [q for q in rows if q[0] == r.k and (q[1], q[2]) < (r.y, r.i)]
        upto = [*before, (r.k, r.y, r.i, r.v)]
        assert r.low == min((q[3] for q in before if q[3] is not None), default=None)
        assert r.total == sum(q[3] or 0 for q in upto)
        assert (tuple(r.last) if r.last else None) == max((q[1:] for q in upto if q[3] is not None), default=None)


def plain_region(cap, graphics, width=600.0, height=800.0):
    """One caption against its page, graphic by graphic."""
    _, _, cx0, cy0, cx1, _, upper = cap
    top = bottom = cy0 - 2
    left = right = None
    above = sorted((g for g in graphics if g[3] < cy0 - 2 and g[5] > 0 and g[5] > upper), key=lambda g: -g[5])
    n = 0
    for _, _, x0, y0, x1, y1 in above:
        if top - y1 > 40:
            break
        n, top, bottom = n + 1, min(top, y0), max(bottom, y1)
        left, right = (x0 if left is None else min(left, x0)), (x1 if right is None else max(right, x1))
    if above:
        if left is None:
            left, right = cx0 - 12, cx1 + 12
        y0 = top if upper > top + 4 else max(top, upper)
        y0 = bottom - 0.6 * height if bottom - y0 > 0.6 * height else y0
    else:
        left, right, y0 = cx0, cx1, max(upper, cy0 - 0.4 * height)
    x0, x1 = max(0.0, min(left, cx0) - 12), min(width, max(right, cx1) + 12)
    if cx1 <= width / 2 + 20 and cx0 < width / 2:
        x1 = min(x1, width / 2 - 2)
    elif cx0 >= width / 2 - 20 and cx1 > width / 2:
        x0 = max(x0, width / 2 + 2)
    return n, x0, y0, x1, bottom if above else cy0 - 2


@pytest.mark.parametrize("n", [6, 40, 400])
def test_figure_regions(spark, n):
    rng = random.Random(n)
    pages = 1 if n == 400 else 8  # one full page
    graphics = [(rng.randrange(pages), i, x := float(rng.randrange(500)), y := float(rng.randrange(-20, 780)), x + rng.randrange(100), y + rng.choice([1, 5, 30, 120])) for i in range(n)]
    captions = [(rng.randrange(pages), 9000 + i, x := float(rng.randrange(500)), y := float(rng.randrange(780)), x + rng.randrange(200), y + 9, float(rng.choice([0, max(0, y - 100), max(0, y - 300)]))) for i in range(60)]
    got = figures.figure_regions(spark.createDataFrame(captions, BOX + ", upper double"), spark.createDataFrame(graphics, BOX), 600.0, 800.0)
    want = [(c[0], c[1], *plain_region(c, [g for g in graphics if g[0] == c[0]])) for c in captions]
    assert sorted(tuple(r) for r in got.select("page", "id", "n", "x0", "y0", "x1", "y1").collect()) == sorted(want)


def test_regions_never_hold_two_numbers(spark):
    """A block without a number between two numbered ones goes with the upper one; a chain of any length is one region."""
    chain = [(1, 100 + i, None, 0.0, 50.0 * i, 30.0, 50.0 * i + 30, "") for i in range(40)]
    rows = [(2, 1, "6", 0.0, 0.0, 100.0, 100.0, "Figure 6. a b"), (2, 2, None, 0.0, 110.0, 100.0, 200.0, ""), (2, 3, "7", 0.0, 210.0, 100.0, 300.0, "Figure 7"), (2, 4, "7", 105.0, 210.0, 180.0, 300.0, "Figure 7. long one"), (2, 5, None, 500.0, 700.0, 510.0, 710.0, "")]
    df = spark.createDataFrame(chain + rows, "page long, id long, number string, x0 double, y0 double, x1 double, y1 double, caption string")
    got = {(r.page, r.region): (r.number, r.n, r.caption) for r in regions.joint_regions(df).collect()}
    assert got == {(1, 100): (None, 40, ""), (2, 1): ("6", 2, "Figure 6. a b"), (2, 3): ("7", 2, "Figure 7. long one"), (2, 5): (None, 1, "")}


def test_nearest_and_labels(spark):
    marks = [(1, 10.0, 0, "a"), (1, 30.0, 1, "b"), (1, 30.0, 0, "c"), (2, 5.0, 0, "d")]
    points = [(1, 20.0, 1), (1, 21.0, 2), (1, -500.0, 3), (1, 900.0, 4), (2, 5.0, 5), (3, 1.0, 6), (1, 20.0, 1)]
    got = figures.nearest(spark.createDataFrame(points, "page long, at double, id long"), spark.createDataFrame(marks, "page long, at double, place long, text string"))
    assert sorted((r.id, r.text) for r in got.collect() if r.text) == [(1, "a"), (1, "a"), (2, "c"), (3, "a"), (4, "c"), (5, "d")]
    lists = [["GT"], ["Fig. 2 x", "Figure 11. y", "Table 11 z"], ["fig 3b", "Table IV"], [], ["see Fig. 3"]]
    df = spark.createDataFrame([(x,) for x in lists], "c array<string>").select(figures.picked_label(F.col("c")).alias("p"))
    assert [r.p for r in df.collect()] == ["", "Figure 11. y", "fig 3b", "", ""]


def test_layout_replies(spark):
    """Lists and objects; broken entries cost only themselves; a figure without any caption goes, a table stays."""
    whole = '{"type":"image","bbox":[0,0,500,500],"page_idx":0,"image_caption":[" ","Figure 1. x"]}'
    bare = '{"type":"chart","bbox":[0,600,500,900],"page_idx":0}'
    contents = ["not json", None, "[]", f'[1, null, {{"type":"image"}}, {{"type":"image","bbox":"x","page_idx":0}}, {whole}, {{"type":"text","bbox":[0,0,900,900],"page_idx":0}}]', f'{{"content_list": [{bare}, {{"type":"table","bbox":[0,0,100,500],"page_idx":1}}]}}', f"[{bare}]", '[{"type":"image","bbox":[0,0,1,1],"page_idx":0}]']
    lines = spark.createDataFrame([((4, 1), 700.0, 0, "Figure 9. near"), ((4, 1), 10.0, 1, "Figure 8. far")], "page struct<doc: long, page: int>, y0 double, place long, text string")
    got = figures.layout_regions(spark.createDataFrame(list(enumerate(contents)), "doc long, content string"), lines, 600.0, 800.0).collect()
    assert sorted((r.page.doc, r.page.page, r.kind, r.caption) for r in got) == [(3, 1, "figure", "Figure 1. x"), (4, 1, "figure", "Figure 9. near"), (4, 2, "table", "")]


def test_full_and_sparse_pages_agree(spark, monkeypatch):
    """One pass over sorted pages and the grid with its stars give the same regions, with null numbers and boxes of no side among them."""
    rng = random.Random(3)
    rows = [(i % 4, i, rng.choice([None, "a", "b"]), x := float(10 * rng.randrange(60)), y := float(10 * rng.randrange(70)), x + rng.randrange(90), y + rng.randrange(60)) for i in range(200)]
    rows += [(9, i, None, None, 0.0, 1.0, 1.0) for i in range(2)] + [(None, 1, "a", 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "page long, id long, number string, x0 double, y0 double, x1 double, y1 double")
    few = sorted(regions.joint_regions(df).collect(), key=lambda r: (r.page, r.region))
    monkeypatch.setattr(regions, "FULL", 1)
    assert sorted(regions.joint_regions(df).collect(), key=lambda r: (r.page, r.region)) == few and len(few) < 202


def test_sparse_pages_take_no_rounds(spark, monkeypatch):
    """Pages of bounded length need neither stars nor checkpoints of edges."""
    monkeypatch.setattr(regions, "components", None)
    monkeypatch.setattr(regions, "touching", None)
    df = spark.createDataFrame([(p, i, "a", 0.0, 50.0 * i, 30.0, 50.0 * i + 30) for p in range(3) for i in range(40)], "page long, id long, number string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.page, r.region, r.n) for r in regions.joint_regions(df).collect()) == [(p, 0, 40) for p in range(3)]


def test_gaps_of_just_the_limit(spark, monkeypatch):
    """A gap of 40 points counts, whichever way its sum is rounded, on sparse and on full pages."""
    tops = [(a, b) for a in range(400) for b in (a + 50,) if (b + 0.5) / 1000 * 800 - (a + 0.5) / 1000 * 800 <= 40]
    rows = [(a, 1, "a", 0.0, 0.0, 50.0, (a + 0.5) / 1000 * 800) for a, _ in tops] + [(a, 2, "a", 0.0, (b + 0.5) / 1000 * 800, 50.0, 700.0) for a, b in tops]
    df = spark.createDataFrame(rows, "page long, id long, number string, x0 double, y0 double, x1 double, y1 double")
    for full in (256, 1):
        monkeypatch.setattr(regions, "FULL", full, raising=False)
        assert {r.n for r in regions.joint_regions(df).collect()} == {2}


def test_captions_of_sparse_pages_take_no_bands(spark, monkeypatch):
    """Pages of bounded length are one pass, and both ways agree; nulls and captions without graphics among them."""
    rng = random.Random(5)
    graphics = [(rng.randrange(6), i, x := float(rng.randrange(500)), y := float(rng.randrange(-20, 780)), x + rng.randrange(100), y + rng.choice([1, 5, 30, 120])) for i in range(150)]
    graphics += [(1, 900, None, 100.0, 50.0, 130.0), (2, 901, 9.0, None, 50.0, 130.0), (None, 902, 0.0, 0.0, 9.0, 9.0), (8, 903, 0.0, 0.0, 9.0, 9.0)]
    captions = [(rng.randrange(7), 9000 + i, x := float(rng.randrange(500)), y := float(rng.randrange(780)), x + rng.randrange(200), y + 9, rng.choice([0.0, 50.0, max(0.0, y - 100), None])) for i in range(60)]
    captions += [(1, 9900, 5.0, None, 9.0, 9.0, 0.0), (None, 9901, 5.0, 5.0, 9.0, 9.0, 0.0)]
    args = spark.createDataFrame(captions, BOX + ", upper double"), spark.createDataFrame(graphics, BOX)
    columns = ["page", "id", "upper", "n", "top", "bottom", "left", "right", "any_above"]
    rows = lambda: sorted((tuple(r) for r in figures.absorbed(*args).select(columns).collect()), key=repr)
    monkeypatch.setattr(regions, "FULL", 0)
    want = rows()
    monkeypatch.setattr(regions, "FULL", 256)
    monkeypatch.setattr(figures, "running", None)
    assert rows() == want and len(want) == 61 and any(r[3] for r in want)
