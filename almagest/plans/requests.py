"""Queries over requests and sources: demand, conflicts, positions, rules over
their parameters, sweeps, names in text, angles."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.operators import catalogue, requirements, schedule, setups, sky, volumes
from almagest.plans.corpus import _CHUNKS
from almagest.plans.papers import FACILITIES
from almagest.plans.registry import query
from almagest.sources.tables import latest_chunks, table

#: Rules over the parameters of requests: name, kind, allowed values, least, most, step.
RULES = [("telescope", "oneof", ["low", "mid"], None, None, None), ("freq_mhz", "minmax", None, 50.0, 15400.0, None), ("hours", "minmax", None, 0.5, 2000.0, None), ("min_elevation", "minmax", None, 15.0, 60.0, 5.0)]
#: Frequencies in GHz and the system temperature there, between which it is interpolated.
TEMPERATURE = [(0.35, 40.0), (0.95, 22.0), (1.76, 18.0), (5.0, 20.0), (15.4, 27.0)]
#: Computed hours by weighting, of which a claim's nearest counts.
VARIANTS = [("natural", 40.0), ("robust 0", 90.0), ("uniform", 240.0)]
SUN = (283.1, -22.9)


def _t(spark, d, name="requests"):
    return table(spark, d, name)


@query("a22_demand_by_status", "select coalesce(review_status, 'new') as status, telescope, count(*) as n, round(sum(case when hours > 0 and not isnan(hours) then hours end), 3) as hours from requests group by all")
def a22_demand_by_status(spark, d):
    h = F.when((F.col("hours") > 0) & ~F.isnan("hours"), F.col("hours"))
    return _t(spark, d).groupBy(F.coalesce("review_status", F.lit("new")).alias("status"), "telescope").agg(F.count("*").alias("n"), F.round(F.sum(h), 3).alias("hours"))


@query(
    "a22_tiers",
    """select r.id, r.commensal_group, r.telescope, count(o.id) as n_restated, coalesce(max(case when not isnan(o.hours) then o.hours end), r.hours) as most_hours
    from requests r left join requests o on o.duplicate_of = r.id where r.commensal_group <> '' group by r.id, r.commensal_group, r.telescope, r.hours""",
)
def a22_tiers(spark, d):
    """Requests of a commensal group with those that restate them."""
    r = _t(spark, d)
    o = r.where("duplicate_of is not null").groupBy(F.col("duplicate_of").alias("id")).agg(F.count("*").alias("n"), F.max(F.when(~F.isnan("hours"), F.col("hours"))).alias("h"))
    return r.where("commensal_group <> ''").join(o, "id", "left").select("id", "commensal_group", "telescope", F.coalesce("n", F.lit(0)).alias("n_restated"), F.coalesce("h", "hours").alias("most_hours"))


@query("a23_lst_by_group")
def a23_lst_by_group(spark, d):
    from almagest.plans.numeric import _demand

    return schedule.by_group(_demand(spark, d))


@query("w9_pressed_bins")
def w9_pressed_bins(spark, d):
    from almagest.plans.numeric import YEAR, _demand

    return schedule.most_pressed(schedule.pressure(_demand(spark, d), schedule.supply(spark, YEAR)), 5)


@query(
    "a32_quote_counts",
    "select telescope, count(*) as n, count(*) filter (trim(quote) <> '') as n_quoted, count(distinct paper) as n_papers, coalesce(sum(length(quote)), 0)::bigint as n_chars from requests group by telescope",
)
def a32_quote_counts(spark, d):
    return _t(spark, d).groupBy("telescope").agg(F.count("*").alias("n"), F.count_if(F.trim("quote") != "").alias("n_quoted"), F.count_distinct("paper").alias("n_papers"), F.coalesce(F.sum(F.length("quote")), F.lit(0)).cast("bigint").alias("n_chars"))


@query(
    "a31_mention_pages",
    "select paper, count(*) as n, quantile_cont(page, 0.25) as q1, quantile_cont(page, 0.5) as median, quantile_cont(page, 0.75) as q3 from mentions where page > 0 and paper is not null group by paper",
)
def a31_mention_pages(spark, d):
    """Quartiles of the pages of each paper's mentions; pages are counted before they meet in a group."""
    p = _t(spark, d, "mentions").where("page > 0 and paper is not null").groupBy("paper", "page").agg(F.count("*").alias("k"))
    q = lambda x, n: F.percentile("page", F.lit(x), F.col("k")).alias(n)
    return p.groupBy("paper").agg(F.sum("k").alias("n"), q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"))


@query(
    "j11_request_positions",
    """with f as (select field_key, ra_deg, dec_deg from (select *, row_number() over (partition by field_key order by coalesce(created_at, '~'), coalesce(paper, '~'), ra_deg, dec_deg) as rn from fields where ra_deg is not null and dec_deg is not null) where rn = 1),
    g as (select upper(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) as k, min(field_key) as field_key from fields where name is not null group by 1)
    select r.id, case when r.ra_deg is not null and r.dec_deg is not null then 'own' when f.ra_deg is not null then 'field' when s.ra_deg is not null and s.dec_deg is not null then 'source' end as origin,
      case when r.ra_deg is not null and r.dec_deg is not null then r.ra_deg when f.ra_deg is not null then f.ra_deg when s.ra_deg is not null and s.dec_deg is not null then s.ra_deg end as ra
    from requests r left join g on g.k = upper(regexp_replace(r.field, '[^A-Za-z0-9]', '', 'g')) left join f on f.field_key = g.field_key left join sources s on s.id = r.source_id""",
)
def j11_request_positions(spark, d):
    return catalogue.request_positions(_t(spark, d), _t(spark, d, "fields"), _t(spark, d, "sources"))


@query(
    "t9_source_mentions",
    """with n as (select name_key, max_by(source_id, (coalesce(checked_at, ''), coalesce(source_id, -1))) as source_id from names group by name_key)
    select n.source_id, m.source_path, count(*) as n from (select distinct source_path, chunk_index, name_key from mentions) m join n using (name_key) where n.source_id % 50 = 0 group by all""",
)
def t9_source_mentions(spark, d):
    """Where every fiftieth source is mentioned."""
    n = catalogue.latest_names(_t(spark, d, "names")).where("source_id % 50 = 0").select("name_key", "source_id")
    m = _t(spark, d, "mentions").select("source_path", "chunk_index", "name_key").distinct().groupBy("source_path", "name_key").agg(F.count("*").alias("k"))
    return m.join(n, "name_key").groupBy("source_id", "source_path").agg(F.sum("k").alias("n"))


@query("x37_display_names", "select id, trim(regexp_replace(case when main_id like 'NAME %' then substr(main_id, 6) else main_id end, '\\s+', ' ', 'g'), ' ') as name from sources")
def x37_display_names(spark, d):
    return _t(spark, d, "sources").select("id", catalogue.display_name(F.col("main_id")).alias("name"))


_PREFIXES = "|".join(FACILITIES)


@query(
    "x19_names_in_text",
    rf"with {_CHUNKS}, x as (select source, chunk_id, unnest(regexp_extract_all(text, '\b(?:{_PREFIXES})[ \t]?[0-9]+\b')) as raw from c) select upper(regexp_replace(raw, '\s+', '', 'g')) as name_key, count(*) as n, count(distinct source) as n_sources from x group by 1",
)
def x19_names_in_text(spark, d):
    """Numbered designations as chunks have them, by key."""
    return catalogue.designations(latest_chunks(spark, d), FACILITIES)


_VERDICTS = [
    "select id, telescope as value, 'telescope' as name, case when telescope is null then 'missing' when telescope in ('low', 'mid') then 'ok' else 'not_allowed' end as verdict from requests",
    "select id, freq_mhz::varchar, 'freq_mhz', case when freq_mhz is null then 'missing' when freq_mhz < 50 then 'below' when freq_mhz > 15400 then 'above' else 'ok' end from requests where freq_mhz is null or not isnan(freq_mhz)",
    "select id, hours::varchar, 'hours', case when hours is null then 'missing' when hours < 0.5 then 'below' when hours > 2000 then 'above' else 'ok' end from requests where hours is null or not isnan(hours)",
    "select id, min_elevation::varchar, 'min_elevation', case when min_elevation is null then 'missing' when min_elevation < 15 then 'below' when min_elevation > 60 then 'above' when abs((min_elevation - 15) / 5 - round((min_elevation - 15) / 5)) > 1e-9 then 'off_step' else 'ok' end from requests where min_elevation is null or not isnan(min_elevation)",
]
_JUDGED = f"v as ({' union all '.join(_VERDICTS)})"


def _judged(spark, d):
    r = _t(spark, d)
    parts = [r.where(F.col(n).isNull() | ~F.isnan(n)) if n != "telescope" else r for n, *_ in RULES]
    p = [x.select("id", "telescope", F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for x, (n, *_) in zip(parts, RULES)]
    rules = spark.createDataFrame(RULES, "name string, kind string, allowed array<string>, lo double, hi double, step double")
    return setups.judged(p[0].unionByName(p[1]).unionByName(p[2]).unionByName(p[3]), rules)


@query("o2_request_rules", f"with {_JUDGED} select id, name, verdict from v")
def o2_request_rules(spark, d):
    return _judged(spark, d).select("id", "name", "verdict")


@query("a28_verdict_rollup", f"with {_JUDGED} select v.id, coalesce(string_agg(name, ',' order by name) filter (verdict <> 'ok'), '') as failing, bool_and(verdict = 'ok') as passes from v group by v.id")
def a28_verdict_rollup(spark, d):
    return setups.rolled_up(_judged(spark, d), ["id"]).select("id", F.array_join("failing", ",").alias("failing"), "passes")


@query(
    "o10_closest_variant",
    f"""with v(variant, computed) as (values {", ".join(f"('{n}', {x})" for n, x in VARIANTS)}),
    j as (select id as claim_id, hours as claimed, variant, computed, (computed - hours) / hours * 100 as pct from requests, v where hours > 0 and not isnan(hours))
    select claim_id, variant, claimed, computed, round(pct, 3) as pct_diff, abs(pct) <= 10 as within_10pct from (select *, row_number() over (partition by claim_id order by abs(pct), variant) as rn from j) where rn = 1""",
)
def o10_closest_variant(spark, d):
    claims = _t(spark, d).where("hours > 0 and not isnan(hours)").select(F.col("id").alias("claim_id"), F.col("hours").alias("claimed"), F.lit("all").alias("key"))
    return setups.closest_of(claims, VARIANTS)


@query(
    "j16_sweep",
    """select bw, width, hours, round(197 * 198 / 2 * ceil(hours * 3600 / 8.0) * (52 * ceil(round(bw / width, 3)) + 141) / 1e12, 6) as tb
    from unnest([5e6, 1e8, 3e8, 8.1e8]) a(bw), unnest([13440.0, 210.0, 5400.0]) b(width), (select range::double as hours from range(1, 201)) c""",
)
def j16_sweep(spark, d):
    """The product of three lists of parameters, and the visibilities of each setup."""
    grid = setups.sweep(spark, {"bw": [5e6, 1e8, 3e8, 8.1e8], "width": [13440.0, 210.0, 5400.0], "hours": [float(k) for k in range(1, 201)]})
    n = volumes.channels(F.col("bw"), F.col("width"))
    return grid.withColumn("tb", F.round(volumes.visibilities_tb(F.lit(197), F.col("hours") * 3600, F.lit(8.0), n), 6))


@query(
    "m15_interpolated",
    "select id, round(case "
    + " ".join(f"when f <= {b} then {u} + (f - {a}) * ({v} - {u}) / ({b} - {a})" for (a, u), (b, v) in zip(TEMPERATURE, TEMPERATURE[1:]))
    + f" end, 6) as kelvin from (select id, greatest({TEMPERATURE[0][0]}, least({TEMPERATURE[-1][0]}, freq_mhz / 1000)) as f from requests where freq_mhz > 0 and not isnan(freq_mhz))",
)
def m15_interpolated(spark, d):
    return _t(spark, d).where("freq_mhz > 0 and not isnan(freq_mhz)").select("id", F.round(setups.interpolated(F.col("freq_mhz") / 1000, TEMPERATURE), 6).alias("kelvin"))


@query(
    "m4_sun_separation",
    f"""select id, round(degrees(2 * asin(sqrt(least(1.0, power(sin(radians(dec_deg - ({SUN[1]})) / 2), 2) + cos(radians(dec_deg)) * cos(radians({SUN[1]})) * power(sin(radians(ra_deg - {SUN[0]}) / 2), 2))))), 6) as sep
    from sources where isfinite(ra_deg) and dec_deg between -90 and 90""",
)
def m4_sun_separation(spark, d):
    """Degrees from the Sun's place in January."""
    p = sky.positions(_t(spark, d, "sources"), "id")
    return p.select("id", F.round(sky.separation_deg(F.col("ra"), F.col("dec"), F.lit(SUN[0]), F.lit(SUN[1])), 6).alias("sep"))


@query(
    "m12_coordinates_in_names",
    r"""with p as (select id, regexp_extract(main_id, 'J([0-9]{6}(?:\.[0-9]+)?)[+-][0-9]{6}(?:\.[0-9]+)?$', 1) as a, regexp_extract(main_id, 'J[0-9]{6}(?:\.[0-9]+)?([+-][0-9]{6}(?:\.[0-9]+)?)$', 1) as b from sources)
    select id, round(15 * (left(a, 2)::double + substr(a, 3, 2)::double / 60 + substr(a, 5)::double / 3600), 6) as ra,
      round(case when left(b, 1) = '-' then -1 else 1 end * (substr(b, 2, 2)::double + substr(b, 4, 2)::double / 60 + substr(b, 6)::double / 3600), 6) as dec from p where a <> ''""",
)
def m12_coordinates_in_names(spark, d):
    ra, dec = sky.coordinates_in_name(F.col("main_id"))
    return _t(spark, d, "sources").select("id", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec")).where("ra is not null")


@query(
    "t10_cone_nearest",
    """with p as (select id, object_type, ((ra_deg % 360) + 360) % 360 as ra, dec_deg as d from sources where isfinite(ra_deg) and dec_deg between -90 and 90 and object_type = 'G'),
    s as (select id, round(degrees(2 * asin(sqrt(least(1.0, power(sin(radians(d + 30) / 2), 2) + cos(radians(-30)) * cos(radians(d)) * power(sin(radians(ra - 60) / 2), 2))))) * 3600.0, 3) as sep from p)
    select id, sep from s where sep <= 144000 order by sep, id limit 20""",
)
def t10_cone_nearest(spark, d):
    """The twenty galaxies nearest to a place, within forty degrees."""
    p = sky.positions(_t(spark, d, "sources").where("object_type = 'G'"), "id")
    return sky.cone(p, 60.0, -30.0, 144000.0).select("id", F.round("sep_arcsec", 3).alias("sep")).orderBy("sep", "id").limit(20)


@query(
    "j25_interval_union",
    """with b as (select distinct telescope, floor(dec_min)::int as lo, ceil(dec_max)::int as hi from requests where telescope is not null and isfinite(dec_min) and isfinite(dec_max) and dec_min <= dec_max),
    g as (select *, max(hi) over (partition by telescope order by lo, hi rows between unbounded preceding and 1 preceding) as before from b),
    i as (select *, sum(case when before is null or lo > before then 1 else 0 end) over (partition by telescope order by lo, hi) as island from g)
    select telescope, min(lo) as lo, max(hi) as hi from i group by telescope, island""",
)
def j25_interval_union(spark, d):
    """Declinations that boxes of requests cover, in whole degrees, as intervals that do not touch."""
    b = _t(spark, d).where("telescope is not null and dec_min <= dec_max and abs(dec_min) <= 1e6 and abs(dec_max) <= 1e6").select("telescope", F.floor("dec_min").cast("int").alias("lo"), F.ceil("dec_max").cast("int").alias("hi"))
    return catalogue.interval_union(b, "telescope")


@query("u3_requirement_drafts")
def u3_requirement_drafts(spark, d):
    return requirements.drafts(_t(spark, d).select("id", "quote"))


@query("u4_requirement_checks")
def u4_requirement_checks(spark, d):
    return requirements.checked(_t(spark, d).select("id", "quote", "freq_mhz", "hours"), {"freq_mhz": "MHz", "hours": "h"})
