"""Links between vectors of one label by cosine, from PCA-ordered tiles.

Unit vectors are turned onto the principal axes of a bounded seeded sample, the
axes of most variance first.  A tile pair's products are accumulated over the leading axes,
and after each run of axes the Cauchy-Schwarz inequality bounds what is left by the product of
the suffix norms: pairs that cannot reach the threshold any more are given up, so most
stop after a few axes.  The axes only order the work; the links do not depend on the sample.

A label of many rows is cut into cells by median splits along the leading axes, as
deep as its size asks for, and a cell into parts by hash.  The boxes of two tiles
on the leading axes bound their rows' distance from below; tile pairs whose bound
exceeds that of the threshold are not compared.  Labels of few rows share a tile.
No tile pair returns its links one by one: it returns each row's number of them
and a spanning forest, so a large group of copies costs its tiles rows, not pairs.

Defined results: vectors that are null, empty or zero, or hold a null or
non-finite component, and rows without a label or an id link with nothing; every
row is returned.  Vectors link only with those of their length.  Rows that share an
id count as vectors of their own in ``n_links`` (a repeated row links with its twin)
and as one in the components.  A row without an id has no component and is not
kept.  Cosines within 1e-9 of the threshold are taken again from the vectors as
given.  Vectors of any length and size are handled; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, components, join_hot, keep

THRESHOLD = 0.93
#: Rows of a tile, at most, and the bytes that its vectors may take.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Rows and bytes of the sample that gives the axes and the splits, at most.
SAMPLE, SAMPLE_BYTES = 8192, 32 << 20
#: Leading axes whose range a tile records, and the splits along them, at most.
LEADING, DEPTH = 8, 10
STRIP = 512
#: Below this share of open pairs a strip goes on pair by pair.
SPARSE = 1 / 32
#: Rounding that no sum of products of unit vectors reaches.
SLACK = 1e-9
_INT, _REAL = pa.int64(), pa.float64()


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Axes:
    """Principal axes of a sample and median splits along the leading ones."""

    def __init__(self, sample: np.ndarray, dim: int):
        self.dim = dim
        u = units(sample) if len(sample) else np.zeros((0, dim))
        self.turn = np.linalg.eigh(u.T @ u)[1][:, ::-1].copy() if len(sample) else np.eye(dim)
        self.lead = min(LEADING, dim)
        #: (depth, path) -> (axis, value); a node is split along the axis of its widest spread
        self.splits: dict[tuple[int, int], tuple[int, float]] = {}
        nodes = {0: u @ self.turn[:, : self.lead]}
        for depth in range(DEPTH):
            below = {}
            for path, z in nodes.items():
                if len(z) >= 8:
                    axis = int(np.ptp(z, axis=0).argmax())
                    value = float(np.median(z[:, axis]))
                    self.splits[depth, path] = axis, value
                    right = z[:, axis] > value
                    below[2 * path], below[2 * path + 1] = z[~right], z[right]
            nodes = below

    def path(self, z: np.ndarray) -> np.ndarray:
        """DEPTH bits for each row; its first bits are its place in a shallower tree."""
        out = np.zeros(len(z), np.int64)
        for depth in range(DEPTH):
            right = np.zeros(len(z), bool)
            for p in np.unique(out):
                if (depth, p) in self.splits:
                    axis, value = self.splits[depth, p]
                    at = out == p
                    right[at] = z[at, axis] > value
            out = 2 * out + right
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def placed(rows: DataFrame, axes: Axes) -> DataFrame:
    """(row, id, label, v, z, path): the leading coordinates and the place in the tree of splits."""
    sent = rows.sparkSession.sparkContext.broadcast(axes)
    schema = pa.schema([("row", _INT), ("id", _INT), ("label", _INT), ("v", pa.list_(_REAL)), ("z", pa.list_(_REAL)), ("path", _INT)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        for b in batches:
            if b.num_rows:
                z = units(_matrix(b.column("v"))) @ a.turn[:, : a.lead]
                offsets = np.arange(len(z) + 1, dtype=np.int32) * a.lead
                leading = pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))
                yield batch(schema, row=b.column("row"), id=b.column("id"), label=b.column("label"), v=b.column("v"), z=leading, path=pa.array(a.path(z)))

    return rows.select("row", "id", "label", "v").mapInArrow(work, "row long, id long, label long, v array<double>, z array<double>, path long")


def tiled(rows: DataFrame, block: int) -> DataFrame:
    """Adds (pool, cell, part): at most about ``block`` rows share them, and rows of one label share the pool."""
    n = F.sum("n").over(W.partitionBy("label"))  # at most 2**DEPTH places a label
    counts = rows.groupBy("label", "path").agg(F.count("*").alias("n")).withColumn("n_label", n)
    depth = F.least(F.lit(DEPTH), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_label") / block)))).cast("int")
    # a place's first bits: dividing by a power of two drops the others
    counts = counts.withColumn("cell", F.floor(F.col("path") / F.pow(F.lit(2.0), DEPTH - depth)).cast("long"))
    counts = counts.withColumn("parts", F.ceil(F.sum("n").over(W.partitionBy("label", "cell")) / block).cast("int"))
    counts = keep(counts, "tile-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    light = F.col("n_label") <= block // 8
    facts = counts.withColumn("pool", F.when(light, F.pmod(F.xxhash64("label"), F.lit(total // block + 1))).otherwise(F.xxhash64("label")))
    out = join_hot(rows, facts.drop("n_label"), ["label", "path"], "n", total)
    return out.withColumn("part", F.pmod(F.xxhash64(F.lit(23), "row"), "parts").cast("int")).drop("n", "parts", "path")


def tile_pairs(rows: DataFrame, lead: int, threshold: float) -> DataFrame:
    """(pool, cell, part, cell2, part2): the tile pairs, each once, whose boxes may hold a link."""
    ends = [f(F.get("z", F.lit(i))).alias(f"{name}{i}") for i in range(lead) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = keep(rows.groupBy("pool", "cell", "part").agg(*ends), "tiles")
    other = boxes.select("pool", *[F.col(c).alias(f"{c}_2") for c in boxes.columns if c != "pool"])
    gap = lambda i: F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"hi{i}_2"), F.col(f"lo{i}_2") - F.col(f"hi{i}"))
    apart = sum((gap(i) * gap(i) for i in range(lead)), F.lit(0.0))
    once = F.struct("cell", "part") <= F.struct(F.col("cell_2").alias("cell"), F.col("part_2").alias("part"))
    pairs = boxes.join(other, "pool").where(once & (apart <= 2 - 2 * threshold + SLACK))
    return pairs.select("pool", "cell", "part", F.col("cell_2").alias("cell2"), F.col("part_2").alias("part2"))


def link_matrix(u: np.ndarray, w: np.ndarray, turn: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Which rows of ``u`` link with which of ``w`` (unit vectors); ``same`` where both are one tile."""
    x, y = u @ turn, w @ turn
    dim = x.shape[1]
    edges = [0, *(k for k in (8, 16, 32, 64, 128, 256, 512, 1024, 2048) if k < dim), dim]
    tail = lambda z: np.stack([np.sqrt((z[:, k:] ** 2).sum(1)) for k in edges[1:]], 1)
    tx, ty = tail(x), tail(y)
    out = np.zeros((len(x), len(y)), bool)
    for lo in range(0, len(x), STRIP):
        a, ta, at = x[lo : lo + STRIP], tx[lo : lo + STRIP], lo if same else 0
        b, tb = y[at:], ty[at:]
        total = np.zeros((len(a), len(b)))
        pairs = None
        for s, (k0, k1) in enumerate(zip(edges, edges[1:], strict=False)):
            if pairs is None:
                total += a[:, k0:k1] @ b[:, k0:k1].T
                open_ = total + ta[:, s, None] * tb[None, :, s] >= threshold - SLACK
                if np.count_nonzero(open_) <= SPARSE * open_.size:
                    pairs = np.nonzero(open_)
                    value = total[pairs]
            else:
                r, c = pairs
                value = value + np.einsum("ij,ij->i", a[r, k0:k1], b[c, k0:k1])
                open_ = value + ta[r, s] * tb[c, s] >= threshold - SLACK
                pairs, value = (r[open_], c[open_]), value[open_]
            if pairs is not None and not len(pairs[0]):
                break
        if pairs is None:
            pairs = np.nonzero(open_)
            value = total[pairs]
        r, c = pairs
        ok = value >= threshold
        close = np.flatnonzero(np.abs(value - threshold) <= SLACK)
        for k in range(0, len(close), 4096):
            i = close[k : k + 4096]
            ok[i] = np.einsum("ij,ij->i", u[lo + r[i]], w[at + c[i]]) >= threshold
        out[lo + r[ok], at + c[ok]] = True
    if same:
        out |= out.T
        np.fill_diagonal(out, False)
    return out


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) out of the links that connect all that the links connect; fewer than rows plus columns."""
    across = np.ascontiguousarray(links.T)
    new_row, new_col = links.any(1), links.any(0)
    rows, cols = [], []
    for start in np.flatnonzero(new_row):
        if not new_row[start]:
            continue
        new_row[start] = False
        stack = [(True, int(start))]
        while stack:
            is_row, i = stack.pop()
            line, new = (links[i], new_col) if is_row else (across[i], new_row)
            found = np.flatnonzero(line & new)
            new[found] = False
            one = np.full(len(found), i)
            rows.append(one if is_row else found)
            cols.append(found if is_row else one)
            stack += [(not is_row, int(j)) for j in found]
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64),) * 2


def compared(rows: DataFrame, pairs: DataFrame, axes: Axes, threshold: float) -> DataFrame:
    """(row, n) with a row's number of links in a tile pair, and (a, b) with links between ids that connect the same."""
    sent = rows.sparkSession.sparkContext.broadcast(axes.turn)
    schema = pa.schema([("row", _INT), ("n", _INT), ("a", _INT), ("b", _INT)])

    def out(row, n, a, b) -> pa.Table:
        none = lambda k: pa.nulls(k, _INT)
        columns = [(pa.array(row), pa.array(n), none(len(row)), none(len(row))), (none(len(a)), none(len(a)), pa.array(a), pa.array(b))]
        return pa.concat_tables([pa.Table.from_arrays(list(c), schema=schema) for c in columns])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [schema.empty_table()]
        if not left.num_rows:
            return found[0]
        same = not right.num_rows
        lab = left.column("label").to_numpy(), (left if same else right).column("label").to_numpy()
        for label in np.intersect1d(*lab):
            l = left.filter(pa.array(lab[0] == label))  # noqa: E741
            r = l if same else right.filter(pa.array(lab[1] == label))
            u = units(_matrix(l.column("v")))
            links = link_matrix(u, u if same else units(_matrix(r.column("v"))), sent.value, threshold, same)
            if links.any():
                down, over = links.sum(1), links.sum(0)
                i, j = forest(links)
                row, ids = (t.column("row").to_numpy() for t in (l, r)), [t.column("id").to_numpy() for t in (l, r)]
                row_l, row_r = row
                rows_ = [row_l[down > 0]] if same else [row_l[down > 0], row_r[over > 0]]
                n = [down[down > 0]] if same else [down[down > 0], over[over > 0]]
                found.append(out(np.concatenate(rows_), np.concatenate(n).astype(np.int64), ids[0][i], ids[1][j]))
        return pa.concat_tables(found)

    tile, both = ["pool", "cell", "part"], ["pool", "cell", "part", "cell2", "part2"]
    slim = rows.select(*tile, "label", "row", "id", "v")
    left = slim.join(pairs, tile)
    right = slim.toDF("pool", "cell2", "part2", "label", "row", "id", "v").join(pairs.where("cell <> cell2 OR part <> part2"), ["pool", "cell2", "part2"])
    columns = [*both, "label", "row", "id", "v"]
    return left.select(columns).groupBy(*both).cogroup(right.select(columns).groupBy(*both)).applyInArrow(work, "row long, n long, a long, b long")


def vector_links(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Labels may be whole numbers of any width; every link is between rows of one label.
    """
    spark = df.sparkSession
    v = F.transform(vec_col, lambda x: x.cast("double"))
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    ok = F.coalesce(ok & F.col(id_col).isNotNull() & F.col(label_col).isNotNull(), F.lit(False))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(ok, v).alias("v"))
    rows = keep(rows, "vectors")
    found = spark.createDataFrame([], "row long, n long, a long, b long")
    valid = rows.where("v IS NOT NULL")
    for r in valid.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():  # one row a length
        some = valid.where(F.size("v") == r.dim)
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * r.dim)))
        sample = some.where(F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(max(1, r.n // most))) == 0).orderBy(F.xxhash64("row")).limit(most)
        axes = Axes(np.array([s.v for s in sample.select("v").collect()], np.float64).reshape(-1, r.dim), r.dim)
        tiles = keep(tiled(placed(some, axes), max(64, min(BLOCK, BLOCK_BYTES // (8 * r.dim)))), "placed")
        found = found.unionByName(keep(compared(tiles, tile_pairs(tiles, axes.lead, threshold), axes, threshold), "links"))
    counts = found.where("n IS NOT NULL").groupBy("row").agg(F.sum("n").alias("n_links"))
    groups = components(found.where("a IS NOT NULL")).select(F.col("node").alias("id"), "component")
    out = rows.select("row", "id").join(counts, "row", "left").join(groups, "id", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
