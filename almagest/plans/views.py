"""Queries that select, page, format and convert."""

from __future__ import annotations

from pyspark.sql import functions as F

from almagest.operators import papers, setups, sky, volumes
from almagest.plans.corpus import _CHUNKS, _SECTION, _STEM
from almagest.plans.registry import query
from almagest.sources.tables import latest_chunks, table

_POS = "p as (select id, ((ra_deg % 360) + 360) % 360 as ra, dec_deg as d from sources where isfinite(ra_deg) and dec_deg between -90 and 90)"


@query("f2_where", f"with {_CHUNKS} select chunk_id, source from c where doc_source in ('skybook1', 'theses') and zone = 'body' and page_no > 3")
def f2_where(spark, d):
    """A flat filter: a value, or any of a list, for each key."""
    c = latest_chunks(spark, d)
    return c.where(papers.fits({"doc_source": ["skybook1", "theses"], "zone": "body"}) & (F.col("page_no") > 3)).select("chunk_id", "source")


@query(
    "f14_document_page",
    f"""with {_CHUNKS}, s as (select source, {_STEM} as stem, count(*) as n_chunks from c group by source having count(*) > 2)
    select * from s order by n_chunks desc, source limit 5 offset 5""",
)
def f14_document_page(spark, d):
    """The second page of five documents by size, those of two chunks or fewer hidden."""
    g = latest_chunks(spark, d).groupBy("source").agg(F.count("*").alias("n_chunks")).where("n_chunks > 2")
    return papers.page(g.select("source", papers.stem_of(F.col("source")).alias("stem"), "n_chunks"), [F.col("n_chunks").desc(), F.col("source")], 5, 2)


@query(
    "x33_passages",
    f"""with {_CHUNKS} select chunk_id, '[' || {_STEM} || ', ' || case when {_SECTION} = '' then 'no section' else {_SECTION} end || case when page_no > 0 then ', p. ' || page_no else '' end || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as passage
    from c where chunk_id % 50 = 0""",
)
def x33_passages(spark, d):
    return latest_chunks(spark, d).where("chunk_id % 50 = 0").select("chunk_id", papers.passage().alias("passage"))


@query("x34_linked", rf"with {_CHUNKS} select chunk_id, regexp_replace(text, '\b([A-Z]{{3}}) ([0-9]+)\b', '[\1 \2](#\1\2)', 'g') as linked from c where chunk_id % 50 = 0")
def x34_linked(spark, d):
    """Numbered designations as links to their key."""
    return latest_chunks(spark, d).where("chunk_id % 50 = 0").select("chunk_id", F.regexp_replace("text", r"\b([A-Z]{3}) ([0-9]+)\b", "[$1 $2](#$1$2)").alias("linked"))


_NORM = "regexp_replace(lower(%s), '[^a-z0-9]+', '_', 'g')"


@query(
    "j18_vocabularies",
    f"""with a as (select {_NORM % "alias"} as k, prefix from catalog_aliases union select {_NORM % "prefix"}, prefix from catalog_aliases),
    w as (select distinct {_NORM % "split_part(main_id, ' ', 1)"} as k from sources) select w.k as written, min(a.prefix) as canonical, count(a.prefix) as n from w left join a using (k) group by w.k""",
)
def j18_vocabularies(spark, d):
    """First words of identifiers among the catalogues' names, by normalised spelling; none, one or several fit."""
    a = table(spark, d, "catalog_aliases")
    words = table(spark, d, "sources").select(F.split_part("main_id", F.lit(" "), F.lit(1)).alias("written"))
    return papers.across_vocabularies(words, a.select(F.col("alias").alias("name"), F.col("prefix").alias("canonical")).unionByName(a.select(F.col("prefix").alias("name"), F.col("prefix").alias("canonical"))))


@query(
    "a26_volumes_by_band",
    """select telescope, coalesce(band, 'none') as band, count(*) as n, round(sum(197 * 198 / 2 * ceil(hours * 3600 / 8.0) * (52 * ceil(round(5e6 / 13440.0, 3)) + 141) / 1e12), 3) as tb
    from requests where hours > 0 and not isnan(hours) and telescope is not null group by all""",
)
def a26_volumes_by_band(spark, d):
    r = table(spark, d, "requests").where("hours > 0 and not isnan(hours) and telescope is not null")
    tb = volumes.visibilities_tb(F.lit(197), F.col("hours") * 3600, F.lit(8.0), volumes.channels(F.lit(5e6), F.lit(13440.0)))
    return r.groupBy("telescope", F.coalesce("band", F.lit("none")).alias("band")).agg(F.count("*").alias("n"), F.round(F.sum(tb), 3).alias("tb"))


@query("m13_kelvin_to_jansky", "select id, round(0.5 * (freq_mhz / 1000) * (freq_mhz / 1000) * 2.0 * 1.5 / 1.222e6, 12) as jy from requests where freq_mhz > 0 and not isnan(freq_mhz)")
def m13_kelvin_to_jansky(spark, d):
    return table(spark, d, "requests").where("freq_mhz > 0 and not isnan(freq_mhz)").select("id", F.round(setups.kelvin_to_jansky(F.lit(0.5), F.col("freq_mhz") / 1000, F.lit(2.0), F.lit(1.5)), 12).alias("jy"))


@query("m14_scaled_sensitivity", "select id, round(1.7 * sqrt(13440.0 / (1000.0 * hours)), 9) as ujy from requests where hours > 0 and not isnan(hours)")
def m14_scaled_sensitivity(spark, d):
    return table(spark, d, "requests").where("hours > 0 and not isnan(hours)").select("id", F.round(setups.scaled_sensitivity(F.lit(1.7), F.lit(13440.0), 1000.0 * F.col("hours")), 9).alias("ujy"))


@query(
    "m3_altitudes",
    f"with {_POS} select id, round(degrees(asin(least(1.0, greatest(-1.0, sin(radians(-30.72)) * sin(radians(d)) + cos(radians(-30.72)) * cos(radians(d)) * cos(radians(6.5 * 15 - ra)))))), 6) as altitude from p",
)
def m3_altitudes(spark, d):
    """Altitudes of all sources at 6.5 h of sidereal time, latitude -30.72."""
    p = sky.positions(table(spark, d, "sources"), "id")
    return p.select("id", F.round(sky.altitude_deg(F.col("ra"), F.col("dec"), F.lit(6.5), -30.72), 6).alias("altitude"))


@query(
    "m10_galactic",
    f"""with {_POS}, g as (select id, sin(radians(d)) * sin(radians(27.12825)) + cos(radians(d)) * cos(radians(27.12825)) * cos(radians(ra - 192.859481)) as sb,
      cos(radians(d)) * sin(radians(ra - 192.859481)) as y, sin(radians(d)) * cos(radians(27.12825)) - cos(radians(d)) * sin(radians(27.12825)) * cos(radians(ra - 192.859481)) as x from p)
    select id, round(degrees(asin(least(1.0, greatest(-1.0, sb)))), 4) as b, round(sin(radians(122.931918 - degrees(atan2(y, x)))), 4) as sin_l from g""",
)
def m10_galactic(spark, d):
    """Galactic latitudes, and the sine of longitudes, from right ascension and declination."""
    p = sky.positions(table(spark, d, "sources"), "id")
    l, b = sky.galactic(F.col("ra"), F.col("dec"))
    return p.select("id", F.round(b, 4).alias("b"), F.round(F.sin(F.radians(l)), 4).alias("sin_l"))


@query("x24_sentences", rf"with {_CHUNKS} select chunk_id, len(list_filter(string_split_regex(text, '[.!?]+[ \t\r\n]+'), lambda s: trim(s, E' \t\r\n') <> ''))::bigint as n from c")
def x24_sentences(spark, d):
    """How many sentences each chunk has."""
    return latest_chunks(spark, d).select("chunk_id", F.size(papers.sentences(F.col("text"))).cast("bigint").alias("n"))
