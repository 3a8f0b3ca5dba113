"""Array beams: what errors of the antennas' phases cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.operators.quantiles import quantiles


def uniform(trial: Column, antenna: Column, stream: float) -> Column:
    """A number in [0, 1) that depends on the three numbers only, so that a
    result does not depend on how the draws are dealt out."""
    x = F.sin(trial * 12.9898 + antenna * 78.233 + stream) * 43758.5453
    return x - F.floor(x)


def normal(trial: Column, antenna: Column) -> Column:
    u, v = uniform(trial, antenna, 1.0), uniform(trial, antenna, 2.0)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * F.pi() * v)


def phase_loss(spark: SparkSession, trials: int, antennas: int, sd: float) -> DataFrame:
    """(p10, p50, p90) of 1 - |mean of exp(i phase)|^2 over draws of normal
    phases for each antenna, to five places."""
    g = spark.range(trials * antennas).select(F.floor(F.col("id") / antennas).alias("t"), F.pmod("id", F.lit(antennas)).alias("a"))
    phase = sd * normal(F.col("t"), F.col("a"))
    e = g.select("t", phase.alias("p")).groupBy("t").agg((1 - (F.pow(F.avg(F.cos("p")), 2) + F.pow(F.avg(F.sin("p")), 2))).alias("loss"))
    q = quantiles(e.withColumn("one", F.lit(1)), "one", "loss", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 0.001)
    return q.select(*[F.round(c, 5).alias(c) for c in ("p10", "p50", "p90")])
