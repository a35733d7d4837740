"""The line index under insertions and deletions, against counting the whole corpus."""

import random

import numpy as np

from colophon.llm import line_dedup
from colophon.llm.line_dedup import SLOTS, CuckooFilter


def brute(docs, min_docs=5):
    """{doc_id: numbers of dropped lines}."""
    where = {}
    for i, text in docs.items():
        for k, line in enumerate((text or "").split("\n")):
            key = line.strip(" \t\n\x0b\x0c\r")
            if len(key) >= 40:
                where.setdefault(key, {}).setdefault(i, []).append(k)
    drop = {}
    for held in where.values():
        if len(held) >= min_docs:
            for i, lines in held.items():
                if i < max(held):
                    drop.setdefault(i, set()).update(lines)
    return drop


def dropped(index):
    return {r.doc_id: set(r.drop) for r in line_dedup.dropped_lines(index).collect()}


def shards(index):
    return {r.shard: bytes(r.filter) for r in index.filters.collect()}


def test_insert_delete_insert(spark):
    rng = random.Random(11)
    lines = [f"line number {i} of forty characters and some more" for i in range(60)] + ["short"]
    docs = {i: "\n".join(rng.choices(lines, k=rng.randrange(1, 12))) for i in range(60)}
    frame = lambda ids: spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    index = line_dedup.insert_documents(None, frame(range(40)))
    held = {i: docs[i] for i in range(40)}
    assert dropped(index) == brute(held)
    index = line_dedup.insert_documents(index, frame(range(40, 60)))
    assert dropped(index) == brute(docs)
    gone = [*range(5, 30), 59, 58]  # among them the largest documents that hold a line
    index = line_dedup.delete_documents(index, frame(gone).select("doc_id"))
    held = {i: t for i, t in docs.items() if i not in gone}
    assert dropped(index) == brute(held)
    exact = line_dedup.reference_counts(index.postings)
    assert sorted(exact.collect()) == sorted(index.counts.select(exact.columns).collect())
    loaded = {s: CuckooFilter(np.frombuffer(f, np.uint16).reshape(-1, SLOTS)) for s, f in shards(index).items()}
    for r in index.frequent.collect():
        assert loaded[r.h1 % line_dedup.SHARDS].contains(np.array([r.h1]))[0]
    # the filters hold one fingerprint for each frequent key, and none of the others
    assert sum(int((f.table != 0).sum()) for f in loaded.values()) == index.frequent.count()
    index = line_dedup.insert_documents(index, frame(gone))
    assert dropped(index) == brute(docs)


def test_untouched_shards_keep_their_filters(spark):
    lines = [f"line number {i} of forty characters and some more" for i in range(30)]
    docs = spark.createDataFrame([(i, "\n".join(lines)) for i in range(6)] + [(100 + i, lines[0]) for i in range(4)], "doc_id long, text string")
    one = line_dedup.insert_documents(None, docs)
    two = line_dedup.delete_documents(one, docs.where("doc_id in (0, 1)").select("doc_id"))  # four documents and four more hold the first line
    before, after = shards(one), shards(two)
    assert two.frequent.count() == 1 and set(before) == set(after)
    same = [s for s in before if before[s] == after[s]]
    assert len(same) <= 1 and dropped(two).keys() == {2, 3, 4, 5, 100, 101, 102}
    more = line_dedup.insert_documents(two, spark.createDataFrame([(200, "nothing here")], "doc_id long, text string"))
    assert shards(more) == after


def test_a_full_filter_is_built_again(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARDS", 1)
    lines = [f"line number {i} of forty characters and some more" for i in range(200)]
    frame = lambda ids, n: spark.createDataFrame([(i, "\n".join(lines[:n])) for i in ids], "doc_id long, text string")
    index = line_dedup.insert_documents(None, frame(range(5), 3))
    small = len(shards(index)[0])
    index = line_dedup.insert_documents(index, frame(range(10, 15), 200))
    assert len(shards(index)[0]) > small and index.frequent.count() == 200
    assert {i: len(d) for i, d in dropped(index).items()} == {i: 3 if i < 5 else 200 for i in (*range(5), *range(10, 14))} 


def test_no_frequent_line_and_no_document(spark):
    for rows in ([], [(1, None), (None, "x" * 50)]):
        index = line_dedup.insert_documents(None, spark.createDataFrame(rows, "doc_id long, text string"))
        assert dropped(index) == {} and shards(index) == {}
        index = line_dedup.delete_documents(index, spark.createDataFrame([(1,)], "doc_id long"))
        assert dropped(index) == {}


def test_filters_have_a_bound(spark, monkeypatch):
    """Many frequent keys are dealt over more shards, at once or when an index outgrows its own."""
    monkeypatch.setattr(line_dedup, "SHARDS", 2)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    lines = [f"frequent line number {i} that is long enough to count" for i in range(500)]
    docs = {i: "\n".join(lines) for i in range(5)} | {5 + i: "\n".join(lines[:40]) for i in range(6)}
    frame = lambda ids: spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    bound = 2 * SLOTS * 2 * line_dedup.SHARD_KEYS  # bytes: slots of two bytes, filled to a quarter at least
    whole = line_dedup.insert_documents(None, frame(range(11)))
    assert whole.shards == 32 and max(map(len, shards(whole).values())) <= bound and dropped(whole) == brute(docs)
    grown = line_dedup.insert_documents(None, frame(range(5, 11)))
    assert grown.shards == 4
    grown = line_dedup.insert_documents(grown, frame(range(5)))
    assert grown.shards == 32 and max(map(len, shards(grown).values())) <= bound and dropped(grown) == brute(docs)
    fewer = line_dedup.delete_documents(grown, frame([0]).select("doc_id"))
    assert dropped(fewer) == brute({i: t for i, t in docs.items() if i}) and fewer.frequent.count() == 40
