"""Regions of figures: what a caption absorbs, blocks of a layout model, and captions that no region covers.

Captions meet their page's graphics in one pass over sorted pages.  Full pages are cut into bands
(:mod:`colophon.operators.sweeps`): a caption is one more row in the order of its page's graphics,
and finds its graphics by an equi-join on the run it falls into.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from colophon.operators import pages, regions, spatial
from colophon.operators.graph import with_checkpoints
from colophon.operators.sweeps import running

#: Points: the largest gap between the graphics of one figure, the margin beside them, and the tolerance at the middle of a page.
GAP, PAD, MIDDLE = 40.0, 12.0, 20.0
#: Of a page's height: the tallest figure, and the stretch taken where a caption has no graphics.
TALLEST, BLANK = 0.6, 0.4
#: Height of a band, in points.
BAND = 64.0
LABEL = r"(?i)^(fig(?:ure)?\.?|table)\s*(\d+[a-z]?|[IVXLCDM]+)"
BLOCK = "struct<type: string, bbox: array<double>, page_idx: int, image_caption: array<string>, table_caption: array<string>>"


def clamped(x0: Column, x1: Column, cap_x0: Column, cap_x1: Column, width: float) -> tuple[Column, Column]:
    """A region's sides, kept in the column in which its caption stands; not for captions across the middle."""
    mid = width / 2
    left, right = (cap_x1 <= mid + MIDDLE) & (cap_x0 < mid), (cap_x0 >= mid - MIDDLE) & (cap_x1 > mid)
    return F.when(~left & right, F.greatest(x0, F.lit(mid + 2))).otherwise(x0), F.when(left, F.least(x1, F.lit(mid - 2))).otherwise(x1)


def absorbed(captions: DataFrame, graphics: DataFrame, gap: float = GAP) -> DataFrame:
    """captions (page, id, x0, y0, x1, y1, upper, ...) with n, top, bottom, left, right of the graphics above that each absorbs, and ``any_above``.

    From two points above the caption upwards, by falling lower edge, a graphic joins while it
    begins at most ``gap`` below what is joined already; those that end above ``upper``
    stay out.  Pages of up to ``regions.FULL`` boxes pass through one task together, fuller ones are cut into bands.
    """
    with_checkpoints(captions.sparkSession)
    captions, graphics = captions.where("page IS NOT NULL AND id IS NOT NULL"), graphics.where("page IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL").select("page", *spatial.CORNERS)
    boxes = captions.select("page").unionByName(graphics.select("page")).groupBy("page").agg(F.count("*").alias("_n"))
    full = boxes.where(F.col("_n") > regions.FULL).select("page").checkpoint()  # one row for FULL boxes at most
    if full.isEmpty():
        return _page_absorbed(captions, graphics, gap)
    part = lambda how: [df.join(full, "page", how).select(df.columns) for df in (captions, graphics)]
    return _page_absorbed(*part("left_anti"), gap).unionByName(_full_page_absorbed(*part("left_semi"), gap))


def _page_absorbed(captions: DataFrame, graphics: DataFrame, gap: float) -> DataFrame:
    """:func:`absorbed` where no page has more than FULL boxes: a page's boxes pass through one task together."""
    found = [StructField("n", LongType()), *[StructField(c, DoubleType()) for c in ("top", "bottom", "left", "right")], StructField("any_above", BooleanType())]
    schema, names = StructType([*captions.schema.fields, *found]), captions.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pages.whole_pages(batches, "page"):
            new = pages.absorbed(rows, "_caption", gap)
            caps = rows.filter(rows.column("_caption")).select(names)
            none = new["n"] == 0
            for f in found:
                caps = caps.append_column(f.name, pa.array(new[f.name], mask=np.zeros(len(none), bool) if f.name == "any_above" else none | np.isnan(new[f.name])))
            yield from caps.combine_chunks().to_batches()

    rows = captions.withColumn("_caption", F.lit(True)).unionByName(graphics.withColumn("_caption", F.lit(False)), allowMissingColumns=True)
    return rows.repartition("page").sortWithinPartitions("page", "_caption").mapInArrow(work, schema)


def _full_page_absorbed(captions: DataFrame, graphics: DataFrame, gap: float) -> DataFrame:
    """:func:`absorbed` for pages of any size.

    Where a page's graphics, taken by falling lower edge, leave a larger gap, a run ends
    for every caption alike; so runs are numbered once a page, and a caption
    belongs to the run that is open ``gap`` above it.
    """
    captions, top = captions.checkpoint(), F.col("y0") - 2  # both tables are read by several steps
    boxes = graphics.groupBy("page", F.col("y0").alias("top"), F.col("y1").alias("bottom")).agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.count("*").alias("n")).checkpoint()
    rows = boxes.select("page", F.col("bottom").alias("at"), F.lit(0).alias("rank"), "top", "bottom", "left", "right", "n", F.lit(None).cast("long").alias("id"))
    caps = captions.select("page", (top - gap).alias("at"), F.lit(1).alias("rank"), *[F.lit(None).cast(t).alias(c) for c, t in (("top", "double"), ("bottom", "double"), ("left", "double"), ("right", "double"), ("n", "long"))], F.col("id").cast("long").alias("id"))
    rows = rows.unionByName(caps)
    order, band = [F.desc("at"), F.asc("rank"), F.asc("top")], F.floor(-F.col("at") / BAND)
    rows = running(rows, ["page"], order, band, F.col("top"), "min", "above", inclusive=False)
    ends = (F.col("rank") == 0) & (F.col("above").isNull() | (F.col("above") - F.col("at") > gap))
    rows = running(rows, ["page"], order, band, ends.cast("long"), "sum", "run").checkpoint()
    # whether anything stands above: the lowest edge among graphics that begin before the caption
    starts = boxes.select("page", F.col("top").alias("at"), F.lit(1).alias("rank"), "bottom", F.lit(None).cast("long").alias("id"))
    starts = starts.unionByName(captions.select("page", top.alias("at"), F.lit(0).alias("rank"), F.lit(None).cast("double").alias("bottom"), F.col("id").cast("long").alias("id")))
    starts = running(starts, ["page"], [F.asc("at"), F.asc("rank")], F.floor(F.col("at") / BAND), F.col("bottom"), "max", "lowest")
    known = captions.join(rows.where("rank = 1").select("page", "id", "run"), ["page", "id"]).join(starts.where("rank = 0").select("page", "id", "lowest"), ["page", "id"])
    floor = F.greatest(F.lit(0.0), F.col("upper"))
    held = known.select("page", "id", "run", top.alias("c"), floor.alias("floor")).join(rows.where("rank = 0").drop("id", "at", "rank", "above"), ["page", "run"]).where("top < c AND bottom > floor")
    held = held.groupBy("page", "id").agg(F.sum("n").alias("n"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.min("left").alias("left"), F.max("right").alias("right"))
    return known.join(held, ["page", "id"], "left").withColumn("any_above", F.coalesce(F.col("lowest") > floor, F.lit(False))).drop("run", "lowest")


def figure_regions(captions: DataFrame, graphics: DataFrame, width: float, height: float) -> DataFrame:
    """(page, id, n, x0, y0, x1, y1): the region above each caption (page, id, x0, y0, x1, y1, upper).

    Captions have distinct ids on a page.  ``upper`` is the lower edge of what
    stands before on the page.  A caption without graphics above takes a stretch of the page.
    """
    cap = F.col("y0") - 2
    a = absorbed(captions, graphics)
    y0, y1 = F.least(cap, F.coalesce("top", cap)), F.greatest(cap, F.coalesce("bottom", cap))
    y0 = F.when(F.col("upper") > y0 + 4, y0).otherwise(F.greatest(y0, F.col("upper")))
    y0 = F.when(y1 - y0 > TALLEST * height, y1 - TALLEST * height).otherwise(y0)
    # without graphics the caption's own sides are widened twice where some stand above but too far
    far = F.when(F.col("any_above"), PAD).otherwise(0.0)
    left, right = F.coalesce("left", F.col("x0") - far), F.coalesce("right", F.col("x1") + far)
    x0 = F.greatest(F.lit(0.0), F.least(left, "x0") - PAD)
    x1 = F.least(F.lit(width), F.greatest(right, "x1") + PAD)
    x0, x1 = clamped(x0, x1, F.col("x0"), F.col("x1"), width)
    y0 = F.when(F.col("any_above"), y0).otherwise(F.greatest("upper", F.col("y0") - BLANK * height))
    return a.select("page", "id", F.coalesce("n", F.lit(0)).alias("n"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), F.when(F.col("any_above"), y1).otherwise(cap).alias("y1"))


# --- captions and regions ----------------------------------------------------


def label_number(caption: Column) -> Column:
    """The number behind a caption's label in lower case; null where there is none."""
    number = F.lower(F.regexp_extract(caption, LABEL, 2))
    return F.when(number != "", number)


def uncovered(captions: DataFrame, found: DataFrame, across: float = 40.0, down: float = 20.0) -> DataFrame:
    """The captions (page, id, x0, y0, x1, y1, caption) that no region (page, id, x0, y0, x1, y1, caption) covers.

    A region covers a caption of its page that has its number, or whose centre lies in it with some tolerance.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    points = captions.select("page", "id", x.alias("x0"), y.alias("y0"), x.alias("x1"), y.alias("y1"))
    near = spatial.touching(points, found, across, down).select("page", F.col("a").alias("id")).distinct()
    numbers = found.select("page", label_number(F.col("caption")).alias("number")).where("number IS NOT NULL").distinct()
    rest = captions.withColumn("number", label_number(F.col("caption"))).join(numbers, ["page", "number"], "left_anti").drop("number")
    return rest.join(near, ["page", "id"], "left_anti").select(captions.columns)


def picked_label(candidates: Column) -> Column:
    """Of an array of captions the labelled one of the highest number, the first of those; empty where none is labelled."""
    labelled = F.filter(candidates, lambda c: F.regexp_like(c, F.lit(LABEL)))
    number = lambda c: F.coalesce(F.regexp_extract(c, r"(?i)^(?:fig(?:ure)?\.?|table)\s*(\d+)(?![\da-z])", 1).try_cast("long"), F.lit(0))
    best = F.array_max(F.transform(labelled, lambda c, i: F.struct(number(c).alias("n"), (-i).alias("i"), c.alias("c"))))
    return F.coalesce(best["c"], F.lit(""))


def parsed_blocks(layouts: DataFrame, width: float, height: float) -> DataFrame:
    """(page, id, kind, caption, x0, y0, x1, y1): figures and tables of layout replies (doc, content: JSON list).

    Boxes are thousandths of a page; thin and tiny ones, and entries that are not whole, are passed
    over.  ``page`` is the struct (doc, page) and ``id`` the entry's place.
    """
    # the list, or an object that holds it; entries are parsed one by one, so that a broken one costs only itself
    entries = F.from_json(F.coalesce(F.get_json_object("content", "$.content_list"), F.col("content")), "array<string>")
    items = layouts.select("doc", F.posexplode(F.transform(entries, lambda e: F.from_json(e, BLOCK))).alias("id", "b")).select("doc", F.col("id").cast("long").alias("id"), "b.*")
    items = items.where("type IN ('image', 'chart', 'table') AND size(bbox) = 4 AND NOT exists(bbox, x -> x IS NULL) AND page_idx >= 0")
    texts = F.when(F.col("type") == "table", F.col("table_caption")).otherwise(F.col("image_caption"))
    texts = F.filter(F.transform(F.coalesce(texts, F.array().cast("array<string>")), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != "")
    flat = items.select(F.struct("doc", (F.col("page_idx") + 1).alias("page")).alias("page"), "id", F.when(F.col("type") == "table", "table").otherwise("figure").alias("kind"), picked_label(texts).alias("caption"), *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(spatial.CORNERS)])
    return flat.drop(*spatial.CORNERS).join(regions.scaled(flat, width, height), ["page", "id"])


def nearest(points: DataFrame, marks: DataFrame) -> DataFrame:
    """points (page, at, ...) with ``text`` of the mark (page, at, place, text) of the nearest ``at``; the first in order of equally near ones.

    One sort of both: the nearest is the last mark before a point or the first one behind it.
    """
    first = marks.groupBy("page", "at").agg(F.min(F.struct("place", "text")).alias("m"))
    key = [f"_{c}" for c in points.columns if c != "at"]
    rows = first.select("page", "at", F.struct("at", "m").alias("mark"), F.lit(None).alias("p")).unionByName(
        points.select("page", "at", F.lit(None).alias("mark"), F.struct(*[F.col(c).alias(f"_{c}") for c in points.columns if c != "at"]).alias("p"))
    )
    band = F.floor(F.col("at") / BAND)
    rows = running(rows, ["page"], [F.asc("at"), F.asc_nulls_last("mark")], band, F.col("mark"), "max", "before")
    rows = running(rows, ["page"], [F.desc("at"), F.asc_nulls_last("mark")], -band, F.col("mark"), "min", "behind").where("p IS NOT NULL")
    back, on = F.col("at") - F.col("before.at"), F.col("behind.at") - F.col("at")
    text = F.when(on.isNull() | (back <= on), F.col("before.m.text")).otherwise(F.col("behind.m.text"))
    return rows.select(*[F.col(f"p.{c}").alias(c[1:]) for c in key], "at", text.alias("text"))


def layout_regions(layouts: DataFrame, lines: DataFrame, width: float, height: float) -> DataFrame:
    """(page, kind, caption, x0, y0, x1, y1) of layout replies (doc, content).

    Blocks of one figure number become one region; regions without a caption take the nearest caption
    line (page, y0, place, text) of their page; figures that still have none are dropped.
    """
    with_checkpoints(layouts.sparkSession)
    blocks = parsed_blocks(layouts, width, height).checkpoint()  # read by every step below
    figures = regions.joint_regions(blocks.where("kind = 'figure'").withColumn("number", label_number(F.col("caption")))).withColumn("kind", F.lit("figure"))
    columns = ["page", "kind", "caption", *spatial.CORNERS]
    found = figures.select(columns).unionByName(blocks.where("kind = 'table'").select(columns))
    need = found.where("caption = ''").withColumn("at", (F.col("y0") + F.col("y1")) / 2)
    filled = nearest(need, lines.select("page", F.col("y0").alias("at"), "place", "text")).withColumn("caption", F.coalesce("text", "caption"))
    return found.where("caption <> ''").unionByName(filled.select(columns)).where("kind = 'table' OR trim(caption) <> ''")
