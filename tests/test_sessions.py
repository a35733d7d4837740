"""Streams against batch tables: stopped and resumed, out of order, and with ends that are lost."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colophon.operators import fonts
from colophon.streaming import sessions

MESSAGE = "thread string, turn long, role string, text string"


def key(rows):
    return sorted(map(str, map(tuple, rows)))


def test_stopped_and_resumed_is_one_run(spark, tmp_path):
    rng = random.Random(1)
    rows = [(str(t), n, rng.choice(["user", "assistant"]), rng.choice([None, "", "x" * n, f"é{t}"])) for n in range(12) for t in range(1 + n % 5, 9)]
    source, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    done = []
    for part in (rows[:20], rows[20:23], rows[23:]):  # the query stops after each part
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(source)
        sessions.save_versions(spark.readStream.schema(MESSAGE).parquet(source), out, state).awaitTermination()
        done += part
        saved, whole = spark.read.parquet(out), sessions.versions(spark.createDataFrame(done, MESSAGE))
        assert key(saved.select(whole.columns).collect()) == key(whole.collect())
        assert key(sessions.resume_points(saved).collect()) == key(sessions.resume_points(whole).collect())
    # nothing new: nothing is written again
    sessions.save_versions(spark.readStream.schema(MESSAGE).parquet(source), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == len(rows)


def test_threads(spark):
    rows = spark.createDataFrame([("t", 1), (None, 2)], "thread string, session long")
    assert [r.t for r in rows.select(sessions.thread_of(F.col("thread"), F.col("session")).alias("t")).collect()] == ["t", "2"]


@pytest.mark.parametrize("seed", [1, 2])
def test_topics_end_on_streams(spark, tmp_path, seed):
    rng, zero = random.Random(seed), datetime(2024, 1, 1)
    schema = "topic long, id long, ts timestamp, kind string"
    rows = [(rng.randrange(12), i, zero + timedelta(seconds=i * 3 + rng.randrange(-9, 10), microseconds=rng.randrange(10**6)), rng.choice(["hit"] * 30 + ["done"])) for i in range(400)]
    rows += [(50, -3, zero + timedelta(seconds=100), "hit"), (51, -2, zero + timedelta(seconds=100), "done"), (51, -1, zero + timedelta(seconds=100), "done")]  # 50 loses its end
    rows.sort(key=lambda r: r[1])
    late = [(99, 1000, zero + timedelta(days=9), "hit"), (99, 1001, zero + timedelta(days=10), "hit"), (99, 1002, zero + timedelta(days=20), "hit")]  # carry the watermark on
    source = str(tmp_path / "in")
    for i, part in enumerate([rows[:150], rows[150:300], rows[300:], late[:1], late[1:2], late[2:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = sessions.closing_stream(spark.readStream.schema(schema).parquet(source), 240.0, "30 seconds")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    want = sessions.closed_topics(spark.createDataFrame(rows, schema), 240.0).collect()
    got = spark.read.parquet(str(tmp_path / "out")).where("topic < 99").collect()
    assert key(got) == key(want) and {r.topic: r.ended for r in want}[50] == "error"
    assert {r.ended for r in want} == {"done", "error"}


def test_titles(spark):
    pieces = [
        (1, 20.0, 50.0, 100.0, "A Study"), (1, 19.5, 10.0, 120.0, "of Things:"), (1, 30.0, 0.0, 10.0, "arXiv:2211.09800v2"), (1, 40.0, 0.0, 300.0, "W"), (1, 10.0, 0.0, 200.0, "body"), (1, 50.0, 0.0, 700.0, "below"),
        (2, 9.0, 0.0, 700.0, "Only"), (2, 9.0, 5.0, 701.0, "below"), (3, 12.0, 0.0, 1.0, " "), (4, 12.0, 0.0, 1.0, "DOI 10"), (5, 30.0, 0.0, 1.0, "ab"), (5, 29.5, 9.0, 1.0, "cd"), (6, 11.0, 0.0, 1.0, "x"), (6, 10.0, 0.0, 1.0, "Long"),
    ]
    got = fonts.titles(spark.createDataFrame(pieces, "page long, size double, x0 double, y0 double, text string"), 800.0).collect()
    assert dict(map(tuple, got)) == {1: "A Study of Things: W", 2: "Only below", 3: None, 4: None, 5: "ab cd", 6: "Long"}
