"""Running minima, maxima and sums along an axis, without one task for a hot key.

A key's rows are cut into bands of the axis.  Each band's total is a partial
aggregate; a window over the few bands of a key carries the totals on, and the
rows themselves are sorted within their band only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_AGG = {"min": F.min, "max": F.max, "sum": F.sum}


def running(df: DataFrame, keys: list[str], order: list[Column], band: Column, value: Column, kind: str, name: str, inclusive: bool = True) -> DataFrame:
    """Adds ``name``: the min, max or sum of ``value`` over the key's rows up to this one.

    ``band`` must not fall along ``order``; nulls among the values are passed over.  A
    maximum of structs whose first fields are the order is the last value before a row.
    """
    agg = _AGG[kind]
    rows = df.withColumn("_band", band).withColumn("_value", value)
    before = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    bands = rows.groupBy(*keys, "_band").agg(agg("_value").alias("_total")).withColumn("_carry", agg("_total").over(before)).drop("_total")
    on = [*keys, "_band"]
    bands = bands.toDF(*[f"_k{i}" for i in range(len(on))], "_carry")
    both = rows.join(bands, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(on)]).drop(*[f"_k{i}" for i in range(len(on))])
    inside = W.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    inside = agg("_value").over(inside)
    both = both.withColumn("_inside", inside)
    carry, inside = F.col("_carry"), F.col("_inside")
    if kind == "sum":
        chosen = F.coalesce(carry, F.lit(0)) + F.coalesce(inside, F.lit(0))
    else:  # by case, since least and greatest take no structs
        chosen = F.when(inside.isNull() | (carry < inside if kind == "min" else carry > inside), carry).otherwise(inside)
    return both.withColumn(name, chosen).drop("_band", "_value", "_carry", "_inside")
