"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised inside tasks and cut into pieces of at most
``capacity`` tokens.  Full pieces are sequences of their own.  The others are
dealt by hash into shards of about ``SHARD_PIECES`` pieces; a shard is packed by
``ISLANDS`` islands, which start from best-fit packings of differently disturbed
orders.  The gene is a bin, not a piece (Falkenauer, 1996): crossover injects
the other parent's well-filled bins whole, deletes the bins that now hold a
piece twice, and puts the displaced pieces back by best fit.  After each epoch
every island sends its elite to the next.  A shard stops when it meets
Martello and Toth's lower bound, or when an epoch with the elites of other
islands does not improve its best fitness.  Bins that stay badly filled are dealt
again over all shards and packed as blocks, so the shards' edges cost nothing.

Defined results: null text counts as empty and is the end token alone; repeated
rows are packed each; a row without an id is packed too and keeps its null id; extra columns are ignored; an empty table gives an empty
result.  Texts of any length are tokenised whole, in one task, and cut only above ``capacity`` tokens.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, keep, partitions
from .tokens import byte_ids, tokenizer_folder

CAPACITY = 1024
END = 2
SHARD_PIECES = 4096
ISLANDS = 3
EPOCHS = 3
GENERATIONS = 6
POPULATION = 4
#: Bins filled to less than this share are dealt again.
LOOSE = 0.985
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The documents' token pieces: only documents over ``capacity`` are cut, and their first piece takes the odd rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = folder or tokenizer_folder()  # where this executor has it
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*byte_ids([text.as_py() or ""], place)[0], END], "<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
            yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True) if out else [[]] * 5, strict=True)))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(work, PIECES)


# --- one shard ---------------------------------------------------------------


def best_fit(order: list[int], size: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Put the items one by one into the fullest bin that still takes them."""
    bins = [list(b) for b in bins or []]
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some bin has exactly r room
    for k, b in enumerate(bins):
        room = capacity - sum(size[i] for i in b)
        by_room[room].append(k)
        mask |= 1 << room
    for i in order:
        fits = mask >> size[i]
        if fits:
            room = size[i] + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
            bins[k].append(i)
            room -= size[i]
        else:
            k, room = len(bins), capacity - size[i]
            bins.append([i])
        by_room[room].append(k)
        mask |= 1 << room
    return bins


def disturbed(size: list[int], capacity: int, rng: random.Random | None) -> list[list[int]]:
    """Best fit by falling size; with ``rng`` in an order that is disturbed."""
    noise = [x * rng.uniform(0.9, 1.1) for x in size] if rng else size
    return best_fit(sorted(range(len(size)), key=lambda i: (-noise[i], i)), size, capacity)


class Plan:
    """Bins by falling fill, and their fitness: every sum is taken once."""

    def __init__(self, bins: list[list[int]], size: list[int]):
        both = sorted(((sum([size[i] for i in b]), b) for b in bins), key=lambda x: -x[0])
        self.bins, self.fills = [b for _, b in both], [f for f, _ in both]
        self.square = sum(f * f for f in self.fills)
        #: fewer bins first; then unevenly filled ones, which leave room to empty a bin
        self.fitness = len(bins), -self.square


def cross(a: Plan, b: Plan, size: list[int], capacity: int, rng: random.Random) -> Plan:
    """Inject well-filled bins of ``b`` into ``a``; best-fit what they displace."""
    gift = [g for g in b.bins[: max(1, len(b.bins) // 2)] if rng.random() < 0.7] or b.bins[:1]
    given = set().union(*gift)
    left, loose = [], []
    for g in a.bins:
        if given.isdisjoint(g):
            left.append(g)
        else:
            loose += [i for i in g if i not in given]
    # the emptiest bins are broken up too, or the number of bins could not fall
    keep_n = max(0, len(left) - max(2, len(left) // 50))
    for g in left[keep_n:]:
        loose += g
    loose.sort(key=lambda i: (-size[i], i))
    return Plan(best_fit(loose, size, capacity, left[:keep_n] + gift), size)


def evolve(size: list[int], capacity: int, seed: int, migrants: list[list[list[int]]] = (), generations: int = GENERATIONS, bound: int | None = None) -> Plan:
    """The best packing that one island finds in an epoch."""
    rng = random.Random(seed)
    bound = lower_bound(size, capacity) if bound is None else bound
    score = lambda plan: plan.fitness
    people: list[Plan] = []

    def admit(plan: Plan) -> None:
        # equal individuals would only be crossed with themselves
        if all(plan.fitness != p.fitness or set(map(frozenset, plan.bins)) != set(map(frozenset, p.bins)) for p in people):
            people.append(plan)

    for bins in migrants or [disturbed(size, capacity, None)]:
        admit(Plan(bins, size))
    if len(min(people, key=score).bins) <= bound:
        return min(people, key=score)
    for _ in range(2 * POPULATION):  # short lists may have fewer plans than that
        if len(people) >= POPULATION:
            break
        admit(Plan(disturbed(size, capacity, rng), size))
    for _ in range(generations):
        best = min(people, key=score)
        if len(best.bins) <= bound:
            break
        a, b = rng.sample(range(len(people)), 2) if len(people) > 1 else (0, 0)
        for child in (cross(people[a], people[b], size, capacity, rng), cross(best, people[b], size, capacity, rng)):
            admit(child)
        people = sorted(people, key=score)[:POPULATION]
    return min(people, key=score)


def lower_bound(size: list[int], capacity: int) -> int:
    """Martello and Toth's L2: bins that any packing needs, over all thresholds for small items."""
    n = np.bincount(np.asarray(size, np.int64), minlength=capacity + 1)[: capacity + 1]
    count, mass = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1))
    best, half = 0, capacity // 2
    for small in range(half + 1):
        big = int(count[capacity] - count[capacity - small])  # nothing of size >= small fits beside them
        mid = int(count[capacity - small] - count[half])
        room = mid * capacity - int(mass[capacity - small] - mass[half])
        rest = int(mass[half] - (mass[small - 1] if small else 0))
        best = max(best, big + mid + max(0, -(-(rest - room) // capacity)))
    return best


def _flat(bins: list[list[int]], n: int) -> bytes:
    at = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        at[b] = k
    return at.tobytes()


def _bins(raw: bytes) -> list[list[int]]:
    at = np.frombuffer(raw, np.int32)
    out: list[list[int]] = [[] for _ in range(int(at.max()) + 1 if len(at) else 0)]
    for i, k in enumerate(at.tolist()):
        out[k].append(i)
    return [b for b in out if b]


STATE = "shard int, island int, sizes binary, plan binary, n_bins int, square long, bound int"


def _epoch(state: DataFrame, capacity: int, epoch: int, islands: int) -> DataFrame:
    """One epoch on every island of the shards that are above their bound.

    In the first epoch the islands are on their own; then each has the elite of the one before it as a guest.
    """
    n = F.lit(ISLANDS)
    guests = state.select("shard", F.pmod(F.col("island") + 1, n).alias("island"), (F.col("plan") if epoch else F.lit(None).cast("binary")).alias("guest"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                size = np.frombuffer(row.sizes, np.int32).tolist()
                migrants = [_bins(p) for p in (row.plan, row.guest) if p]
                best = evolve(size, capacity, row.shard * 1009 + row.island * 31 + epoch, migrants, bound=row.bound)
                yield pd.DataFrame({"shard": [row.shard], "island": [row.island], "sizes": [row.sizes], "plan": [_flat(best.bins, len(size))], "n_bins": [len(best.bins)], "square": [best.square], "bound": [row.bound]})

    # few rows, much work: one island a task
    joined = state.join(guests, ["shard", "island"])
    return joined.repartition(max(1, min(islands, 4 * partitions(state.sparkSession))), "shard", "island").mapInPandas(work, STATE)


def start_plans(shard: int, size: np.ndarray, capacity: int) -> pd.DataFrame:
    """A STATE row for each island: the first packs by falling size, the others in disturbed orders."""
    sizes, bound, rows = size.tolist(), lower_bound(size.tolist(), capacity), []
    for island in range(ISLANDS):
        plan = Plan(disturbed(sizes, capacity, random.Random(shard * 7919 + island) if island else None), sizes)
        rows.append({"shard": shard, "island": island, "sizes": size.tobytes(), "plan": _flat(plan.bins, len(size)), "n_bins": len(plan.bins), "square": plan.square, "bound": bound})
        if len(plan.bins) <= bound:
            # at the bound there is nothing left to evolve: one island will do
            return pd.DataFrame([{**rows[-1], "island": 0}])
    return pd.DataFrame(rows)


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(shard, idx, bin) for rows (shard, idx, size): idx counts from 0 in each shard."""

    def start(key, pdf):
        return start_plans(int(key[0]), pdf.sort_values("idx")["size"].to_numpy(np.int32), capacity)

    state = keep(items.groupBy("shard").applyInPandas(start, STATE), "pack-start")
    done = state.where("n_bins <= bound")
    open_ = state.where("n_bins > bound")
    for epoch in range(EPOCHS):
        islands = open_.count()
        if not islands:
            break
        before, open_ = open_, keep(_epoch(open_, capacity, epoch, islands), f"pack-epoch{epoch}")
        # a shard leaves when it meets its bound, or when an epoch with the neighbours' elites did not improve its best fitness
        fitness = F.struct("n_bins", (-F.col("square")).alias("square"))
        now = open_.groupBy("shard").agg(F.min(fitness).alias("now"), F.first("bound").alias("least"))
        best_before = before.groupBy("shard").agg(F.min(fitness).alias("was"))
        improved = F.col("now") < F.col("was") if epoch else F.lit(True)
        goes_on = now.join(best_before, "shard").where((F.col("now.n_bins") > F.col("least")) & improved).select("shard")
        done = done.unionByName(open_.join(goes_on, "shard", "left_anti"))
        open_ = open_.join(goes_on, "shard", "left_semi")
    best = done.unionByName(open_).groupBy("shard").agg(F.min_by("plan", F.struct("n_bins", (-F.col("square")).alias("square"), "island")).alias("plan"))

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                at = np.frombuffer(row.plan, np.int32)
                yield pd.DataFrame({"shard": np.full(len(at), row.shard, np.int32), "idx": np.arange(len(at), dtype=np.int32), "bin": at})

    return best.mapInPandas(spread, "shard int, idx int, bin int")


def _sharded(df: DataFrame, n: int, keys: list[str], size: str) -> DataFrame:
    """Adds shard and idx, which counts a shard's rows by size and keys."""
    from pyspark.sql import Window as W

    shards = max(1, -(-n // SHARD_PIECES))
    df = df.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))
    order = W.partitionBy("shard").orderBy(F.col(size).desc(), *keys)
    return df.withColumn("idx", F.row_number().over(order) - 1)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    from pyspark.sql import Window as W

    cut = keep(pieces(docs, id_col, text_col, folder, capacity), "pieces")
    full = cut.where(F.col("length") == capacity).withColumn("offset", F.lit(0).cast("long"))
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    rest = cut.where(F.col("length") < capacity)
    n = rest.count()
    rest = keep(_sharded(rest, n, keys, "length"), "pack-rest")
    first = pack_items(rest.select("shard", "idx", F.col("length").cast("int").alias("size")), capacity)
    placed = rest.join(first, ["shard", "idx"])
    placed = keep(placed.select(*cut.columns, "shard", "bin"), "pack-first")
    # badly filled bins of all shards, packed again as blocks
    fill = placed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    loose = keep(fill.where(F.col("fill") < capacity * LOOSE), "pack-loose")
    again = keep(_sharded(loose.withColumnsRenamed({"shard": "shard1", "bin": "bin1"}), loose.count(), ["shard1", "bin1"], "fill"), "pack-loose2")
    second = pack_items(again.select("shard", "idx", F.col("fill").cast("int").alias("size")), capacity)
    moved = again.join(second, ["shard", "idx"]).select("shard1", "bin1", F.struct(F.lit(1).alias("level"), "shard", "bin").alias("to"))
    home = placed.join(moved, (placed.shard == moved.shard1) & (placed.bin == moved.bin1), "left")
    at = F.coalesce(F.col("to"), F.struct(F.lit(0).alias("level"), placed.shard, placed.bin))
    home = home.select(*cut.columns, at.alias("at"))
    order = W.partitionBy("at").orderBy(F.col("length").desc(), *keys)
    run = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1))
    home = home.select(*cut.columns, F.shiftleft(F.col("at.shard").cast("long") * 2 + F.col("at.level"), 32).bitwiseOR(F.col("at.bin").cast("long")).alias("number"), F.coalesce(run, F.lit(0)).cast("long").alias("offset"))
    # full pieces take negative numbers, packed bins the others
    full = full.withColumn("number", -1 - F.monotonically_increasing_id())
    cols = [*cut.columns, F.col("number").alias("sequence_id"), "offset"]
    return home.select(*cols).unionByName(full.select(*cols))
