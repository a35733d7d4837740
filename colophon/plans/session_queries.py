"""Queries on conversations' checkpoints and on topics that always end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.plans.base import query, read
from colophon.streaming import sessions


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Every third conversation has a configured thread."""
    rows = read(spark, d, "conversations")
    thread = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("t-"), F.col("conv_id").cast("string")))
    return rows.select(sessions.thread_of(thread, F.col("conv_id")).alias("thread"), F.col("turn").cast("long").alias("turn"), "role", "text")


VERSIONS = """m AS (SELECT CASE WHEN conv_id % 3 = 0 THEN 't-' || conv_id ELSE CAST(conv_id AS VARCHAR) END AS thread, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
v AS (SELECT thread, CAST(row_number() OVER w AS INTEGER) AS version, turn, count(*) OVER w AS messages, CAST(sum(coalesce(length(text), 0)) OVER w AS BIGINT) AS chars, last_value(CASE WHEN role = 'user' THEN md5(coalesce(text, '')) END IGNORE NULLS) OVER w AS asked FROM m WINDOW w AS (PARTITION BY thread ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(f"WITH {VERSIONS} SELECT thread, version, nullif(version - 1, 0) AS parent, turn, messages, chars, asked FROM v")
def session_versions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.versions(messages(spark, d))


@query(f"WITH {VERSIONS} SELECT thread, version, turn, messages, chars, asked FROM v QUALIFY row_number() OVER (PARTITION BY thread ORDER BY version DESC) = 1")
def resume_points(spark: SparkSession, d: str) -> DataFrame:
    return sessions.resume_points(sessions.versions(messages(spark, d)))


@query("""WITH e AS (SELECT user_id AS topic, event_id AS id, ts, event_type = 'purchase' AS e FROM events), s AS (SELECT topic, min(ts) + INTERVAL 172800 SECOND AS deadline FROM e GROUP BY 1),
d AS (SELECT e.topic, min(row(ts, id)) AS done FROM e JOIN s USING (topic) WHERE e AND ts <= deadline GROUP BY 1),
j AS (SELECT e.topic, ts, id, deadline, done FROM e JOIN s USING (topic) LEFT JOIN d USING (topic))
SELECT topic, count(*) FILTER (CASE WHEN done IS NULL THEN ts <= deadline ELSE row(ts, id) <= done END) AS events, CASE WHEN any_value(done) IS NULL THEN 'error' ELSE 'done' END AS ended, strftime(coalesce(any_value(done)[1], any_value(deadline)), '%Y-%m-%d %H:%M:%S.%f') AS closed_at FROM j GROUP BY 1""")
def closed_topics(spark: SparkSession, d: str) -> DataFrame:
    """A user's events are a topic, which a purchase ends; after two days it ends anyway."""
    rows = read(spark, d, "events").select(F.col("user_id").cast("long").alias("topic"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"))
    out = sessions.closed_topics(rows, 172_800.0, "purchase")
    return out.withColumn("closed_at", F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
