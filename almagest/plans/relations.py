"""Queries over the relational stores: catalogue, requests, citations, and the
star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.operators import catalogue, citations
from almagest.operators.quantiles import quantiles
from almagest.plans.corpus import _BLANK, _CHUNKS
from almagest.plans.registry import query
from almagest.sources.tables import latest_chunks, table

_NAMES = """n as (select name_key, raw_name, source_id, status from (select *, row_number() over (partition by name_key order by coalesce(checked_at, '') desc, coalesce(source_id, -1) desc, raw_name desc nulls last, status desc nulls last) as rn from names) where rn = 1)"""
_MENTIONS = "m as (select source_path, chunk_index, name_key, min(paper) as paper, min(section) as section from mentions group by all)"


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


@query(
    "a10_query_sources",
    f"""with {_NAMES}, {_MENTIONS}, k as (select name_key, count(*) as n from m group by name_key),
    h as (select source_id, sum(k.n)::bigint as n_mentions, min(struct_pack(k := -k.n, r := raw_name)).r as display_name from n join k using (name_key) where source_id is not null group by source_id),
    p as (select source_id, count(distinct paper) as n_papers, coalesce(string_agg(distinct section, '|' order by section), '') as sections from m join n using (name_key) where source_id is not null group by source_id)
    select s.id, s.main_id, display_name, n_mentions, n_papers, sections from h join p using (source_id) join sources s on s.id = h.source_id where n_mentions >= 2""",
)
def a10_query_sources(spark, d):
    return catalogue.query_sources(*_t(spark, d, "sources", "names", "mentions"), min_mentions=2)


@query(
    "a12_catalogue_stats",
    """select n_sources, n_placed, n_names, n_resolved, n_unresolved, n_pending, n_mentions, n_papers from
    (select count(*) as n_sources, count(*) filter (ra_deg is not null and not isnan(ra_deg)) as n_placed from sources),
    (select count(*) as n_names, count(*) filter (status = 'resolved') as n_resolved, count(*) filter (status = 'unresolved') as n_unresolved, count(*) filter (status = 'pending') as n_pending from names),
    (select count(*) as n_mentions, count(distinct paper) as n_papers from mentions)""",
)
def a12_catalogue_stats(spark, d):
    return catalogue.catalogue_stats(*_t(spark, d, "sources", "names", "mentions"))


@query(
    "a14_unresolved",
    f"with {_NAMES}, {_MENTIONS} select name_key, count(*) as n_mentions, count(distinct paper) as n_papers from m join n using (name_key) where source_id is null group by name_key order by 2 desc, 1 limit 50",
)
def a14_unresolved(spark, d):
    return catalogue.unresolved(*_t(spark, d, "names", "mentions"), 50)


@query(
    "t1_resolve",
    f"""with {_NAMES}, s as (select upper(regexp_replace(main_id, '\\s+', '', 'g')) as k, min(id) as hit from sources group by 1)
    select name_key, case when status = 'pending' then coalesce(a.hit, b.hit) else source_id end as source_id,
      case when status = 'pending' then case when coalesce(a.hit, b.hit) is null then 'unresolved' else 'resolved' end else status end as status
    from n left join s a on a.k = name_key left join s b on b.k = 'NAME' || name_key""",
)
def t1_resolve(spark, d):
    return catalogue.resolve(*_t(spark, d, "names", "sources"))


_EFF = """e as (select id, coalesce(reviewed_hours, hours) as hours, case when reviewed_commensal_group is not null then nullif(reviewed_commensal_group, '') else commensal_group end as commensal_group,
    coalesce(reviewed_field, field) as field, coalesce(review_status, 'new') as review_status, duplicate_of, telescope from requests)"""


@query("t7_effective_requests", f"with {_EFF} select id, hours, commensal_group, field, review_status from e where review_status <> 'rejected'")
def t7_effective_requests(spark, d):
    return catalogue.effective_requests(table(spark, d, "requests")).select("id", "hours", "commensal_group", "field", "review_status")


@query(
    "j8_hour_conflicts",
    f"with {_EFF}, f as (select * from e where review_status <> 'rejected') select a.id, a.duplicate_of, a.hours, b.hours as other_hours from f a join f b on b.id = a.duplicate_of where abs(a.hours - b.hours) > 0.1 * greatest(a.hours, b.hours)",
)
def j8_hour_conflicts(spark, d):
    return catalogue.hour_conflicts(table(spark, d, "requests"))


@query("j9_agreement", "select paper, name, count(distinct extracted_by) as n_runs, count(distinct hours) as n_values, min(hours) as lo, max(hours) as hi from requests where hours is not null and not isnan(hours) group by all having count(distinct extracted_by) > 1")
def j9_agreement(spark, d):
    return catalogue.agreement(table(spark, d, "requests"))


@query("a13_fields", "select field_key, min(name) as name, count(*) as n_papers, max(area_deg2) as area_deg2, count(distinct description) as n_descriptions, min(description) as description from fields group by field_key")
def a13_fields(spark, d):
    return catalogue.list_fields(table(spark, d, "fields"))


@query(
    "j11_field_positions",
    "select field_key, ra_deg, dec_deg from (select *, row_number() over (partition by field_key order by coalesce(created_at, '~'), coalesce(paper, '~'), ra_deg, dec_deg) as rn from fields where ra_deg is not null and dec_deg is not null) where rn = 1",
)
def j11_field_positions(spark, d):
    return catalogue.field_positions(table(spark, d, "fields"))


@query(
    "h10_geometry",
    """select id, case when ra_min is not null and ra_max is not null and dec_min is not null and dec_max is not null then 'box' when dec_min is not null and dec_max is not null then 'band'
    when gal_l_min is not null and gal_l_max is not null and gal_b_min is not null and gal_b_max is not null then 'galactic' when ra_deg is not null and dec_deg is not null then 'point' end as geometry from requests""",
)
def h10_geometry(spark, d):
    r = table(spark, d, "requests")
    return r.select("id", catalogue.geometry_kind(r).alias("geometry"))


_SQUASHED = f"lower(regexp_replace(%s, '{_BLANK}', '', 'g'))"


@query(
    "x23_verbatim_contexts",
    f"""with {_CHUNKS}, m as (select distinct name_key, source_path, chunk_index, context from mentions where context is not null)
    select name_key, source_path, m.chunk_index, contains({_SQUASHED % "text"}, {_SQUASHED % "context"}) as verbatim from m join c on c.source = source_path and c.chunk_index = m.chunk_index""",
)
def x23_verbatim_contexts(spark, d):
    return catalogue.mentions_in_chunks(table(spark, d, "mentions"), latest_chunks(spark, d))


def _refs(spark, d):
    return citations.references(latest_chunks(spark, d))


@query("x15_references")
def x15_references(spark, d):
    return _refs(spark, d)


@query("a7_top_cited")
def a7_top_cited(spark, d):
    return citations.top_cited(_refs(spark, d), 2, None, 50)


@query("a8_citing_papers")
def a8_citing_papers(spark, d):
    return citations.citing_papers(_refs(spark, d), "et al", 20)


@query("a9_citation_stats")
def a9_citation_stats(spark, d):
    return citations.citation_stats(_refs(spark, d))


@query("a21_year_histogram")
def a21_year_histogram(spark, d):
    return citations.year_histogram(_refs(spark, d))


@query("e7_merged_works")
def e7_merged_works(spark, d):
    return citations.merge_works(_refs(spark, d))


# --- star schema ---


@query(
    "rel_pricing_summary",
    """select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1 - l_discount)) as sum_disc_price, avg(l_discount) as avg_disc, count(*) as n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
)
def rel_pricing_summary(spark, d):
    l = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query(
    "rel_revenue_by_nation",
    """select n_name, r_name, sum(l_extendedprice * (1 - l_discount)) as revenue from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
    join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by all""",
)
def rel_revenue_by_nation(spark, d):
    l, o, c, n, r = _t(spark, d, "lineitem", "orders", "customer", "nation", "region")
    per_order = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    j = per_order.join(o, per_order.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("n_name", "r_name").agg(F.sum("rev").alias("revenue"))


@query("rel_cube_orders", "select o_orderstatus, o_orderpriority, count(*) as n, sum(o_totalprice) as total, grouping(o_orderstatus)::bigint as g from orders group by cube (o_orderstatus, o_orderpriority)")
def rel_cube_orders(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.grouping("o_orderstatus").cast("bigint").alias("g"))


@query("rel_customers_without_orders", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def rel_customers_without_orders(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("rel_full_outer_keys", "select coalesce(s_nationkey, c_nationkey) as nationkey, coalesce(ns, 0) as ns, coalesce(nc, 0) as nc from (select s_nationkey, count(*) as ns from supplier group by 1) full join (select c_nationkey, count(*) as nc from customer group by 1) on s_nationkey = c_nationkey")
def rel_full_outer_keys(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("ns"))
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("nc"))
    return s.join(c, "nationkey", "full_outer").select("nationkey", F.coalesce("ns", F.lit(0)).alias("ns"), F.coalesce("nc", F.lit(0)).alias("nc"))


@query(
    "rel_window_frames",
    """select o_orderkey, sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row) as moving,
    lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous, ntile(4) over (partition by o_custkey order by o_orderdate, o_orderkey)::bigint as quarter from orders""",
)
def rel_window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.sum("o_totalprice").over(w.rowsBetween(-2, 0)).alias("moving"), F.lag("o_totalprice").over(w).alias("previous"), F.ntile(4).over(w).cast("bigint").alias("quarter"))


@query(
    "rel_asof_events",
    "select p.event_id, v.event_id as last_view from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by all) v on p.user_id = v.user_id and p.ts >= v.ts",
)
def rel_asof_events(spark, d):
    """Backward as-of join: each purchase with the user's last view before it,
    by one union and a window that carries the last view forward."""
    e = table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("view").isNull().cast("int"), "view").rowsBetween(Window.unboundedPreceding, 0)
    both = e.where("event_type in ('purchase', 'view')").withColumn("view", F.when(F.col("event_type") == "view", F.col("event_id")))
    return both.withColumn("last_view", F.last("view", ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "last_view")


@query("rel_json_props", "select event_type, sum((json_extract(props, '$.k'))::bigint)::bigint as k, count(*) as n from events group by event_type")
def rel_json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count("*").alias("n"))


@query("rel_set_operations", "(select c_nationkey::bigint as k from customer intersect select s_nationkey from supplier) union all (select n_nationkey from nation except select c_nationkey from customer)")
def rel_set_operations(spark, d):
    c, s, n = [table(spark, d, t).select(F.col(k).cast("bigint").alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return c.intersect(s).unionAll(n.exceptAll(n.intersect(c)))


@query("rel_percentiles", "select l_shipmode, lo, med, hi from (select l_returnflag as l_shipmode, quantile_cont(l_extendedprice, 0.1) as lo, quantile_cont(l_extendedprice, 0.5) as med, quantile_cont(l_extendedprice, 0.9) as hi from lineitem group by 1)")
def rel_percentiles(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("l_shipmode"), "l_extendedprice")
    return quantiles(t, "l_shipmode", "l_extendedprice", {"lo": 0.1, "med": 0.5, "hi": 0.9}, 1000.0)
