"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, group: str, value: str, at: dict[str, float], width: float) -> DataFrame:
    """(group, one column for each name of `at`): interpolated quantiles, exactly.

    Values are first counted in ranges of `width`, which tells in which range
    each wanted rank lies; only these ranges are read again, their values
    counted and put in order. No task holds more than the ranges of a group or
    the distinct values of one range. Nulls and NaN are left out; a group
    without values has no row."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(group, F.col(value).cast("double").alias("v")).withColumn("range", F.floor(F.col("v") / width))
    up_to = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = x.groupBy(group, "range").agg(F.count("*").alias("n"))
    counts = counts.withColumns({"end": F.sum("n").over(up_to(group).orderBy("range")), "all": F.sum("n").over(Window.partitionBy(group))})
    place = lambda q: F.lit(q) * (F.col("all") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("bigint").alias("rank"), place(q).alias("place")) for name, q in at.items() for r in (F.floor(place(q)), F.ceil(place(q)))]))
    ranks = counts.select(group, "range", (F.col("end") - F.col("n")).alias("before"), "end", wanted.alias("w")).where((F.col("w.rank") >= F.col("before")) & (F.col("w.rank") < F.col("end")))
    ranks = ranks.select(group, "range", "before", "w.name", "w.rank", "w.place").distinct()
    values = x.join(ranks.select(group, "range").distinct(), [group, "range"], "left_semi").groupBy(group, "range", "v").agg(F.count("*").alias("k"))
    values = values.withColumn("last", F.sum("k").over(up_to(group, "range").orderBy("v")))
    hit = ranks.join(values, [group, "range"]).where((F.col("rank") - F.col("before") < F.col("last")) & (F.col("rank") - F.col("before") >= F.col("last") - F.col("k")))
    part = F.col("place") - F.floor("place")
    weight = F.when(F.col("rank") == F.floor("place"), 1 - part).otherwise(part)
    return hit.groupBy(group).agg(*[F.sum(F.when(F.col("name") == name, F.col("v") * weight)).alias(name) for name in at])
