"""Queries of the data-pipeline problems of the core: sky neighbourhoods and
units of quantities."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.operators import sky, unit_hmm
from almagest.plans.registry import query
from almagest.sources.tables import table

_POSITIONS = """s as (
  select id, case when w >= 360 then 0 else w end as ra, dec_deg as d
  from (select id, ((ra_deg % 360) + 360) % 360 as w, dec_deg from sources
        where ra_deg is not null and not isnan(ra_deg) and not isinf(ra_deg) and dec_deg between -90 and 90))"""
_BOXES = """b as (
  select id, case when a >= 360 then 0 else a end as a, case when z >= 360 then 0 else z end as z, dec_min, dec_max
  from (select id, ((ra_min % 360) + 360) % 360 as a, ((ra_max % 360) + 360) % 360 as z, dec_min, dec_max from requests
        where isfinite(ra_min) and isfinite(ra_max) and isfinite(dec_min) and isfinite(dec_max)))"""
_NEAR = """select 'near' as relation, p.id as source_id, q.id as other_id
  from s p join s q on p.id < q.id and abs(p.d - q.d) <= 0.0084
  where degrees(2 * asin(sqrt(least(1.0, power(sin(radians(q.d - p.d) / 2), 2)
        + cos(radians(p.d)) * cos(radians(q.d)) * power(sin(radians(q.ra - p.ra) / 2), 2))))) * 3600.0 <= 30.0"""
_INSIDE = """select 'inside' as relation, s.id as source_id, b.id as other_id from s join b
  on s.d between b.dec_min and b.dec_max and case when a <= z then ra between a and z else ra >= a or ra <= z end"""


@query("p3_found", f"with {_POSITIONS}, {_BOXES} {_NEAR} union all {_INSIDE}")
def p3_found(spark, d):
    return sky.found(table(spark, d, "sources"), table(spark, d, "requests"))


@query(
    "p3_neighbour_counts",
    f"with {_POSITIONS}, n as ({_NEAR}), e as (select source_id as id from n union all select other_id from n) select id as source_id, count(*) as n_near from e group by id",
)
def p3_neighbour_counts(spark, d):
    n = sky.near_pairs(sky.positions(table(spark, d, "sources"), "id"), 30.0)
    return n.select(F.explode(F.array("id_a", "id_b")).alias("source_id")).groupBy("source_id").agg(F.count("*").alias("n_near"))


@query("p4_found")
def p4_found(spark, d):
    return unit_hmm.found(table(spark, d, "requests"))


@query("p4_common_units")
def p4_common_units(spark, d):
    return unit_hmm.common_units(table(spark, d, "requests"))
