"""Registered source/sink queries: result records and the newest runs per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from bizlens.plans.registry import register
from bizlens.sources import views
from bizlens.sources.ledger import flat_summary, latest_n
from bizlens.sources.records import records


@register("result_records", """
SELECT c_custkey, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
                          'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS record
FROM customer ORDER BY c_custkey LIMIT 20""")
def q_result_records(spark, sf):
    return records(views.table(spark, sf, "customer"), ["c_custkey"], 20)


@register("ledger_latest_n", """
SELECT user_id, event_id, event_type,
       CASE WHEN len(json_keys(props)) > 0
            THEN array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$."' || k || '"')), '; ')
            ELSE 'без KPI' END AS summary,
       CAST(rn AS INTEGER) AS recent_rank
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def q_ledger_latest_n(spark, sf):
    ev = views.table(spark, sf, "events")
    recent = latest_n(ev, "user_id", ["event_id"], 5)
    return recent.select("user_id", "event_id", "event_type", flat_summary(F.col("props")).alias("summary"), "recent_rank")
