"""Sources, names, mentions, requests and fields as tables: joins, counts,
overlays and conflicts."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def name_key(raw: Column) -> Column:
    """A name without blanks, in capitals."""
    return F.upper(F.regexp_replace(raw, r"(?U)\s+", ""))


def latest_names(names: DataFrame) -> DataFrame:
    """One row per name_key: the last checked, a null check being the oldest;
    ties to the resolved row, then the smaller raw_name."""
    r = F.struct(F.coalesce("checked_at", F.lit("")).alias("t"), F.coalesce("source_id", F.lit(-1)).alias("s"), "raw_name", "source_id", "status")
    return names.groupBy("name_key").agg(F.max(r).alias("r")).select("name_key", "r.raw_name", "r.source_id", "r.status")


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    """Each (source_path, chunk_index, name_key) once: a repeated mention is the same one."""
    return mentions.groupBy("source_path", "chunk_index", "name_key").agg(F.min("paper").alias("paper"), F.min("section").alias("section"))


def query_sources(sources: DataFrame, names: DataFrame, mentions: DataFrame, min_mentions: int = 1, object_type: str | None = None) -> DataFrame:
    """(id, main_id, display_name, n_mentions, n_papers, sections) of sources by
    their mentions. Mentions are added up per name before they meet the names,
    so a name that a tenth of all rows mention is one row when it is joined.
    The display name is the most mentioned spelling, ties to the smaller."""
    s = sources if object_type is None else sources.where(F.col("object_type") == object_type)
    n = latest_names(names).where("source_id is not null").select("name_key", "raw_name", "source_id")
    m = distinct_mentions(mentions)
    per_name = m.groupBy("name_key").agg(F.count("*").alias("n"))
    papers = m.select("name_key", "paper", "section").distinct().join(n, "name_key").groupBy("source_id").agg(F.count_distinct("paper").alias("n_papers"), F.array_join(F.array_sort(F.collect_set("section")), "|").alias("sections"))
    hits = per_name.join(n, "name_key").groupBy("source_id").agg(F.sum("n").alias("n_mentions"), F.min(F.struct((-F.col("n")).alias("k"), "raw_name")).alias("d"))
    out = hits.where(F.col("n_mentions") >= min_mentions).join(papers, "source_id").join(s.select(F.col("id").alias("source_id"), "main_id"), "source_id")
    return out.select(F.col("source_id").alias("id"), "main_id", F.col("d.raw_name").alias("display_name"), "n_mentions", "n_papers", "sections")


def catalogue_stats(sources: DataFrame, names: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: sources, those with a position, names by status, mentions."""
    a = sources.agg(F.count("*").alias("n_sources"), F.count_if(F.col("ra_deg").isNotNull() & ~F.isnan("ra_deg")).alias("n_placed"))
    b = names.agg(F.count("*").alias("n_names"), *[F.count_if(F.col("status") == x).alias(f"n_{x}") for x in ("resolved", "unresolved", "pending")])
    c = mentions.agg(F.count("*").alias("n_mentions"), F.count_distinct("paper").alias("n_papers"))
    one = lambda d: d.withColumn("one", F.lit(1))
    return one(a).join(one(b), "one").join(one(c), "one").drop("one")


def unresolved(names: DataFrame, mentions: DataFrame, n: int) -> DataFrame:
    """(name_key, n_mentions, n_papers) of names without a source, most mentioned first."""
    open_ = latest_names(names).where("source_id is null").select("name_key")
    g = distinct_mentions(mentions).groupBy("name_key").agg(F.count("*").alias("n_mentions"), F.count_distinct("paper").alias("n_papers"))
    return open_.join(g, "name_key").orderBy(F.col("n_mentions").desc(), "name_key").limit(n)


def resolve(names: DataFrame, sources: DataFrame) -> DataFrame:
    """(name_key, source_id, status): pending names looked up in the catalogue
    by key, then with NAME before it; a miss is kept as unresolved, so that it
    is not asked again. Other names stay as they are."""
    s = sources.groupBy(name_key(F.col("main_id")).alias("k")).agg(F.min("id").alias("hit"))
    n = latest_names(names)
    a = n.join(s.withColumnsRenamed({"k": "name_key", "hit": "h1"}), "name_key", "left").withColumn("k2", F.concat(F.lit("NAME"), F.col("name_key")))
    a = a.join(s.withColumnsRenamed({"k": "k2", "hit": "h2"}), "k2", "left")
    pending = F.col("status") == "pending"
    sid = F.when(pending, F.coalesce("h1", "h2")).otherwise(F.col("source_id"))
    return a.select("name_key", sid.alias("source_id"), F.when(pending, F.when(sid.isNotNull(), "resolved").otherwise("unresolved")).otherwise(F.col("status")).alias("status"))


def effective_requests(requests: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Requests under their review: reviewed values replace recorded ones, an
    empty reviewed group clears the group, null leaves it."""
    rg, g = F.col("reviewed_commensal_group"), F.col("commensal_group")
    r = requests.select(
        "id", "name", "telescope", "band", F.coalesce("reviewed_hours", "hours").alias("hours"), F.when(rg.isNotNull(), F.nullif(rg, F.lit(""))).otherwise(g).alias("commensal_group"),
        F.coalesce("reviewed_field", "field").alias("field"), F.coalesce("review_status", F.lit("new")).alias("review_status"), "duplicate_of", "extracted_by", "paper", "ra_deg", "dec_deg", "ra_min", "ra_max", "dec_min", "dec_max", "min_elevation", "sun",
    )
    return r if include_rejected else r.where("review_status <> 'rejected'")


def hour_conflicts(requests: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(id, duplicate_of, hours, other_hours) of requests that repeat another
    one with other hours, by more than `tolerance` of the larger."""
    r = effective_requests(requests)
    o = r.select(F.col("id").alias("duplicate_of"), F.col("hours").alias("other_hours"))
    j = r.where("duplicate_of is not null").select("id", "duplicate_of", "hours").join(o, "duplicate_of")
    return j.where(F.abs(F.col("hours") - F.col("other_hours")) > tolerance * F.greatest("hours", "other_hours")).select("id", "duplicate_of", "hours", "other_hours")


def agreement(requests: DataFrame) -> DataFrame:
    """(paper, name, n_runs, n_values, lo, hi): hours by paper and name over the runs that extracted them."""
    g = requests.where("hours is not null and not isnan(hours)").groupBy("paper", "name").agg(F.count_distinct("extracted_by").alias("n_runs"), F.count_distinct("hours").alias("n_values"), F.min("hours").alias("lo"), F.max("hours").alias("hi"))
    return g.where("n_runs > 1")


def list_fields(fields: DataFrame) -> DataFrame:
    """(field_key, name, n_papers, area_deg2, n_descriptions, description) of
    survey fields: how many descriptions a field has, and the first in order."""
    return fields.groupBy("field_key").agg(F.min("name").alias("name"), F.count("*").alias("n_papers"), F.max("area_deg2").alias("area_deg2"), F.count_distinct("description").alias("n_descriptions"), F.min("description").alias("description"))


def geometry_kind(df: DataFrame) -> Column:
    """Which geometry a row has: box, band, galactic box, point, area, or null."""
    has = lambda *cs: functools.reduce(operator.and_, [F.col(c).isNotNull() for c in cs])
    k = F.when(has("ra_min", "ra_max", "dec_min", "dec_max"), "box").when(has("dec_min", "dec_max"), "band").when(has("gal_l_min", "gal_l_max", "gal_b_min", "gal_b_max"), "galactic").when(has("ra_deg", "dec_deg"), "point")
    return k.when(has("area_deg2"), "area") if "area_deg2" in df.columns else k


def field_positions(fields: DataFrame) -> DataFrame:
    """(field_key, ra_deg, dec_deg): of each field the position of the first
    row that has one, by created_at, then paper."""
    p = fields.where("ra_deg is not null and dec_deg is not null")
    return p.groupBy("field_key").agg(F.min(F.struct(F.coalesce("created_at", F.lit("~")).alias("t"), F.coalesce("paper", F.lit("~")).alias("p"), "ra_deg", "dec_deg")).alias("x")).select("field_key", "x.ra_deg", "x.dec_deg")


def squash(text: Column) -> Column:
    """A text without blanks, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def mentions_in_chunks(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Mentions with the chunk that they name: an equi-join on source and index,
    so that a context is looked for in one chunk only. (name_key, source_path,
    chunk_index, verbatim): whether the chunk holds the context, blanks apart."""
    c = chunks.select(F.col("source").alias("source_path"), "chunk_index", "text")
    m = mentions.where("context is not null").select("name_key", "source_path", "chunk_index", "context").distinct()
    return m.join(c, ["source_path", "chunk_index"]).select("name_key", "source_path", "chunk_index", F.contains(squash(F.col("text")), squash(F.col("context"))).alias("verbatim"))


def request_positions(requests: DataFrame, fields: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, origin, ra): where a request looks, by its own position, else by
    that of its field (by name, letters and digits apart), else by that of its
    source; null where none has one."""
    key = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    named = fields.where("name is not null").groupBy(key("name").alias("k")).agg(F.min("field_key").alias("field_key"))
    at = named.join(field_positions(fields), "field_key").select("k", F.col("ra_deg").alias("fra"))
    s = sources.where("ra_deg is not null and dec_deg is not null").select(F.col("id").alias("source_id"), F.col("ra_deg").alias("sra"))
    r = requests.select("id", "ra_deg", "dec_deg", "source_id", key("field").alias("k")).join(at, "k", "left").join(s, "source_id", "left")
    own = F.col("ra_deg").isNotNull() & F.col("dec_deg").isNotNull()
    pick = lambda a, b, c: F.when(own, a).when(F.col("fra").isNotNull(), b).when(F.col("sra").isNotNull(), c)
    return r.select("id", pick(F.lit("own"), F.lit("field"), F.lit("source")).alias("origin"), pick(F.col("ra_deg"), F.col("fra"), F.col("sra")).alias("ra"))


def display_name(main_id: Column) -> Column:
    """An identifier without NAME before it, its blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(main_id, "^NAME ", ""), r"\s+", " "))


def designations(chunks: DataFrame, prefixes: list[str]) -> DataFrame:
    """(name_key, n, n_sources) of the numbered designations of the given
    catalogues in texts; a chunk's are counted before they are shuffled."""
    raw = F.regexp_extract_all("text", F.lit(r"\b(?:" + "|".join(prefixes) + r")[ \t]?[0-9]+\b"), 0)
    per = chunks.select("source", F.explode(raw).alias("raw")).groupBy(F.upper(F.regexp_replace("raw", r"\s+", "")).alias("name_key"), "source").agg(F.count("*").alias("k"))
    return per.groupBy("name_key").agg(F.sum("k").alias("n"), F.count("*").alias("n_sources"))


def interval_union(intervals: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): the union of whole-numbered intervals (key, lo, hi) as
    intervals that do not touch. Distinct intervals are few, whatever the rows:
    they are pre-aggregated to the furthest end of each start."""
    per = intervals.groupBy(key, "lo").agg(F.max("hi").alias("hi"))
    w = Window.partitionBy(key).orderBy("lo")  # as many rows as there are starts
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = per.withColumn("reach", reach).withColumn("new", (F.col("reach").isNull() | (F.col("lo") > F.col("reach"))).cast("int"))
    island = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")
