"""Queries of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexweave.plans.base import query, table
from lexweave.sources.jsonl import shared_folder
from lexweave.streaming import events


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, floor(sum(value) * 100.0::double + 0.5) / 100.0::double as total from events group by all")
def stream_windows(spark, folder):
    out = events.run_to_table(events.windowed(events.read_events(spark, f"{folder}/events.parquet*"), late="3650 days"))
    return out.select("start", "event_type", "n", (F.floor(F.col("total") * F.lit(100.0) + 0.5) / F.lit(100.0)).alias("total"))


@query("""with e as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events),
s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 30 minutes as end, count(*) as n from s group by user_id, k""")
def event_sessions(spark, folder):
    return events.sessions(table(spark, folder, "events"))


@query("select distinct event_id, user_id from events")
def stream_once(spark, folder):
    """Events without those sent again."""
    out = events.run_to_table(events.once(events.read_events(spark, f"{folder}/events.parquet*"), late="3650 days"), "append")
    return out.select("event_id", "user_id")


@query("select distinct event_id, user_id from events")
def append_resume(spark, folder):
    """A run that stopped half way goes on: keys that the table has are not appended again."""
    base = f"{shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    table(spark, folder, "events").where("event_id % 2 = 0").dropDuplicates(["event_id"]).write.parquet(f"{base}/table")
    events.append_new(events.read_events(spark, f"{folder}/events.parquet*"), f"{base}/table", "event_id", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/table").select("event_id", "user_id")
