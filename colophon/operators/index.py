"""A search index as tables in a folder: build, append, load, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

TABLES = ("chunks", "vectors")


def save(chunks: DataFrame, vectors: DataFrame, folder: str, paper: int | None = None) -> None:
    """Write an index anew.  With ``paper`` it is that paper's own: no chunk, or a chunk of another one, is an error."""
    if paper is not None:
        n, foreign = chunks.agg(F.count("*"), F.count_if(~F.col("paper_id").eqNullSafe(F.lit(paper)))).first()
        if not n or foreign:
            raise ValueError("no chunks" if not n else f"{foreign} chunks of other papers")
    for name, df in zip(TABLES, (chunks, vectors), strict=True):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def append(chunks: DataFrame, vectors: DataFrame, folder: str) -> None:
    """Add chunks and vectors; keyword weights follow from the chunks when they are searched."""
    for name, df in zip(TABLES, (chunks, vectors), strict=True):
        df.write.mode("append").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """The index's tables; None where one of them is missing."""
    try:
        chunks, vectors = (spark.read.parquet(f"{folder}/{name}") for name in TABLES)
    except AnalysisException:
        return None
    return chunks, vectors


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` and the rows of ``new`` that have a key and a vector; a key that ``old`` has keeps its row."""
    good = new.where(F.col(key).isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    return old.unionByName(good.join(old.select(key), key, "left_anti"))
