"""Queries over times, volumes and quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.functions.quantities import quantities_of
from almagest.operators import beams, catalogue, schedule, volumes
from almagest.plans.registry import query
from almagest.session import cut
from almagest.sources.tables import table

YEAR = 2042


def _demand(spark, d):
    r = table(spark, d, "requests")
    e = catalogue.effective_requests(r).select("id", "hours", "commensal_group")
    return cut(schedule.demand(r.drop("hours", "commensal_group").join(e, "id"), YEAR))


@query("t4_lst_pressure")
def t4_lst_pressure(spark, d):
    return schedule.pressure(_demand(spark, d), schedule.supply(spark, YEAR))


@query("t4_demand_totals")
def t4_demand_totals(spark, d):
    return schedule.totals(_demand(spark, d), schedule.supply(spark, YEAR))


@query("t4_placement_states")
def t4_placement_states(spark, d):
    return _demand(spark, d).groupBy("state").agg(F.count_distinct("id").alias("n_requests"), F.sum("hours").alias("hours"))


@query("t3_visibility")
def t3_visibility(spark, d):
    return schedule.visibility(spark, [("zenith", 0.0, -26.82), ("equator", 90.0, 0.0), ("north", 180.0, 30.0)], "low", YEAR)


_H = "select id, hours * 3600 as s, telescope from requests where hours > 0 and not isnan(hours)"


@query(
    "o6_visibility_volumes",
    f"with h as ({_H}) select id, round(197 * (197 + 1) / 2 * ceil(s / 8.0) * (52 * 52084 + 141) / 1e12, 3) as tb, round(197 * 2 * 52084 * ceil(s / 8.0) * 32 / 8 / 1e12, 6) as auto_tb from h",
)
def o6_visibility_volumes(spark, d):
    r = table(spark, d, "requests").where("hours > 0 and not isnan(hours)")
    s, n = F.col("hours") * 3600, F.lit(197)
    return r.select("id", F.round(volumes.visibilities_tb(n, s, F.lit(8.0), F.lit(52084)), 3).alias("tb"), F.round(volumes.autocorrelations_tb(n, F.lit(2), F.lit(52084), s, F.lit(8.0), F.lit(32)), 6).alias("auto_tb"))


@query("u1_quantities")
def u1_quantities(spark, d):
    r = table(spark, d, "requests").select("id", F.inline(quantities_of(F.col("quote"))))
    return r.select("id", "value", "unit", "base", "start")


_DRAW = "(sin(%s * 12.9898 + %s * 78.233 + %s) * 43758.5453)"


@query(
    "o14_monte_carlo",
    f"""with g as (select t, a, {_DRAW % ("t", "a", "1.0")} as x, {_DRAW % ("t", "a", "2.0")} as y from (select range as t from range(5000)), (select range as a from range(64))),
    n as (select t, 0.2 * sqrt(-2 * ln(greatest(x - floor(x), 1e-12))) * cos(2 * pi() * (y - floor(y))) as phase from g),
    e as (select t, 1 - (power(avg(cos(phase)), 2) + power(avg(sin(phase)), 2)) as loss from n group by t)
    select round(quantile_cont(loss, 0.1), 5) as p10, round(quantile_cont(loss, 0.5), 5) as p50, round(quantile_cont(loss, 0.9), 5) as p90 from e""",
)
def o14_monte_carlo(spark, d):
    """Percentiles, over 5,000 draws, of the power that phase errors of 0.2 rad
    cost an array of 64 antennas. Draws depend on their number alone."""
    return beams.phase_loss(spark, 5000, 64, 0.2)


@query(
    "a20_commensal_max",
    "select commensal_group, sum(h) as hours from (select commensal_group, band, max(hours) as h from requests where commensal_group is not null and commensal_group <> '' and not isnan(hours) group by all) group by commensal_group",
)
def a20_commensal_max(spark, d):
    r = table(spark, d, "requests").where("commensal_group is not null and commensal_group <> '' and not isnan(hours)")
    return r.groupBy("commensal_group", "band").agg(F.max("hours").alias("h")).groupBy("commensal_group").agg(F.sum("h").alias("hours"))


@query(
    "j24_band_of_frequency",
    """with b(band, lo, hi) as (values ('Band 1', 350.0, 1050.0), ('Band 2', 950.0, 1760.0), ('Band 5a', 4600.0, 8500.0), ('Band 5b', 8300.0, 15400.0))
    select id, band as nearest from (select r.id, b.band, row_number() over (partition by r.id order by greatest(b.lo - freq_mhz, freq_mhz - b.hi, 0), b.band) as rn from requests r, b where freq_mhz > 0 and not isnan(freq_mhz)) where rn = 1""",
)
def j24_band_of_frequency(spark, d):
    """The band that holds a frequency, else the nearest; four bands, as columns."""
    bands = [("Band 1", 350.0, 1050.0), ("Band 2", 950.0, 1760.0), ("Band 5a", 4600.0, 8500.0), ("Band 5b", 8300.0, 15400.0)]
    f = F.col("freq_mhz")
    dist = [F.struct(F.greatest(F.lit(lo) - f, f - F.lit(hi), F.lit(0.0)).alias("d"), F.lit(b).alias("band")) for b, lo, hi in bands]
    return table(spark, d, "requests").where("freq_mhz > 0 and not isnan(freq_mhz)").select("id", F.array_min(F.array(*dist))["band"].alias("nearest"))
