"""Nested observing setups as rows, rules over their parameters, and claims
against computed values under a sweep of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OK, BELOW, ABOVE, NOT_ALLOWED, OFF_STEP, MISSING, NOT_NUMBER = "ok", "below", "above", "not_allowed", "off_step", "missing", "not_a_number"


def parameters(setups: DataFrame, doc: str = "doc") -> DataFrame:
    """(setup_id, subarray, product, name, value): the settings of every data
    product of JSON setups {"subarrays": {id: {"odpList": [{"type",
    "settings": {…}}]}}}. A document that does not parse gives no rows."""
    kind = "struct<subarrays: map<string, struct<odpList: array<struct<type: string, settings: map<string, string>>>>>>"
    s = setups.select("setup_id", F.from_json(doc, kind).alias("d")).select("setup_id", F.explode("d.subarrays").alias("subarray", "s"))
    p = s.select("setup_id", "subarray", F.explode("s.odpList").alias("o"))
    return p.select("setup_id", "subarray", F.col("o.type").alias("product"), F.explode("o.settings").alias("name", "value"))


def missing_parameters(params: DataFrame, required: DataFrame) -> DataFrame:
    """(setup_id, subarray, product, missing): what each product lacks of the
    required names (product, name), in order."""
    have = params.groupBy("setup_id", "subarray", "product").agg(F.collect_set("name").alias("have"))
    need = required.groupBy("product").agg(F.collect_set("name").alias("need"))
    return have.join(need, "product").select("setup_id", "subarray", "product", F.array_sort(F.array_except("need", "have")).alias("missing"))


def judged(params: DataFrame, rules: DataFrame) -> DataFrame:
    """Each parameter with its rule and the verdict. Rules: (name, kind,
    allowed, lo, hi, step) with kind oneof (value among `allowed`), equals (the
    first of them) or minmax (within [lo, hi], on a step from lo where there is
    one). A name without a rule is ok; a null value is missing."""
    v = F.col("value").try_cast("double")
    off = F.col("step").isNotNull() & (F.abs((v - F.col("lo")) / F.col("step") - F.round((v - F.col("lo")) / F.col("step"))) > 1e-9)
    span = F.when(v.isNull(), NOT_NUMBER).when(v < F.col("lo"), BELOW).when(v > F.col("hi"), ABOVE).when(off, OFF_STEP).otherwise(OK)
    verdict = (
        F.when(F.col("kind").isNull(), OK)
        .when(F.col("value").isNull(), MISSING)
        .when(F.col("kind") == "oneof", F.when(F.array_contains("allowed", F.col("value")), OK).otherwise(NOT_ALLOWED))
        .when(F.col("kind") == "equals", F.when(F.col("allowed")[0] == F.col("value"), OK).otherwise(NOT_ALLOWED))
        .otherwise(span)
    )
    return params.join(rules, "name", "left").withColumn("verdict", verdict).select(*params.columns, "verdict")


def rolled_up(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """The state of each group: its failing names in order, and whether all are ok."""
    bad = F.array_sort(F.collect_set(F.when(F.col("verdict") != OK, F.col("name"))))
    return verdicts.groupBy(*by).agg(bad.alias("failing")).withColumn("passes", F.size("failing") == 0)


def closest_variant(claims: DataFrame, variants: DataFrame) -> DataFrame:
    """(claim_id, variant, claimed, computed, pct_diff, within_10pct): of each
    claim (claim_id, claimed, key) the computed variant (key, variant,
    computed) that is nearest in per cent, ties to the first by name. A claim
    without variants, or of zero, has nulls."""
    j = claims.join(variants, "key", "left")
    pct = F.when(F.col("claimed") != 0, (F.col("computed") - F.col("claimed")) / F.col("claimed") * 100)
    best = j.groupBy("claim_id", "claimed").agg(F.min(F.when(pct.isNotNull(), F.struct(F.abs(pct).alias("a"), "variant", "computed", pct.alias("pct")))).alias("b"))
    return best.select("claim_id", F.col("b.variant").alias("variant"), "claimed", F.col("b.computed").alias("computed"), F.round("b.pct", 3).alias("pct_diff"), (F.col("b.a") <= 10).alias("within_10pct"))


def scaled_sensitivity(value: Column, width: Column, claimed_width: Column) -> Column:
    """A sensitivity at another channel width: it falls with the root of it."""
    return value * F.sqrt(width / claimed_width)


def kelvin_to_jansky(kelvin: Column, freq_ghz: Column, major_arcsec: Column, minor_arcsec: Column) -> Column:
    """Brightness temperature in a Gaussian beam as flux density per beam."""
    return kelvin * freq_ghz * freq_ghz * major_arcsec * minor_arcsec / 1.222e6


def closest_of(claims: DataFrame, variants: list[tuple[str, float]]) -> DataFrame:
    """closest_variant() of claims that all compare with the same few computed
    values: these are columns, so claims neither move nor multiply."""
    pct = lambda v: (F.lit(v) - F.col("claimed")) / F.col("claimed") * 100
    each = [F.struct(F.abs(pct(v)).alias("a"), F.lit(n).alias("variant"), F.lit(v).alias("computed"), pct(v).alias("pct")) for n, v in variants]
    b = claims.where("claimed <> 0").withColumn("b", F.array_min(F.array(*each)))
    return b.select("claim_id", F.col("b.variant").alias("variant"), "claimed", F.col("b.computed").alias("computed"), F.round("b.pct", 3).alias("pct_diff"), (F.col("b.a") <= 10).alias("within_10pct"))


def sweep(spark: SparkSession, lists: dict[str, list[float]]) -> DataFrame:
    """The product of lists of parameters, a column each. The lists are given
    by the caller; the product is made by the executors."""
    df = spark.range(1)
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df.drop("id")


def interpolated(x: Column, points: list[tuple[float, float]]) -> Column:
    """A value between the points of a table, at its ends outside of it."""
    at = F.greatest(F.lit(points[0][0]), F.least(F.lit(points[-1][0]), x))
    out = None
    for (a, u), (b, v) in zip(points, points[1:]):
        part = F.lit(u) + (at - a) * ((v - u) / (b - a))
        out = F.when(at <= b, part) if out is None else out.when(at <= b, part)
    return out
