"""Queries of the streaming operators on tables, which give what a stream
gives when it has ended."""

from __future__ import annotations

from almagest.plans.registry import query
from almagest.sources.tables import table
from almagest.streaming import streams


@query("g_tumbling_windows", "select date_trunc('hour', ts) as start, event_type, count(*) as n, sum(value) as total from events group by all")
def g_tumbling_windows(spark, d):
    return streams.windows(table(spark, d, "events"))


@query(
    "g_sliding_windows",
    """select start, event_type, count(*) as n, sum(value) as total from (select time_bucket(interval '30 minutes', ts) - k * interval '30 minutes' as start, event_type, value, ts from events, range(4) t(k)) where ts < start + interval '2 hours' group by all""",
)
def g_sliding_windows(spark, d):
    return streams.windows(table(spark, d, "events"), "2 hours", "30 minutes")


@query(
    "g_sessions",
    """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""",
)
def g_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"))
