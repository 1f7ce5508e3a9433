"""Batch forms of the event-stream jobs, over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from grantlens.plans.registry import job
from grantlens.plans.evaluation import INTAKE_SQL
from grantlens.plans.views import INTAKE
from grantlens.session import new_folder, sql_over, table
from grantlens.sources import records as S
from grantlens.streaming import limits as L
from grantlens.streaming.expiry import closed_windows, use_timers
from grantlens.streaming.intake import stream_intake
from grantlens.streaming.sinks import read_batches, split_sink

# The event table is sparse, so the limiter runs with a day-long window and three hits.
SECONDS, LIMIT = 24 * 3600, 3
_WIDTH = SECONDS * 1_000_000


@job("rate_limited_events", "T1", sql=f"""with recursive e as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
w as (select event_id, user_id, t, rn, t as ws, 1 as hits from e where rn = 1
 union all select e.event_id, e.user_id, e.t, e.rn, case when e.t >= w.ws + {_WIDTH} then e.t else w.ws end, case when e.t >= w.ws + {_WIDTH} then 1 else w.hits + 1 end from w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
select event_id, user_id, ws as window_start, hits, hits > {LIMIT} as is_blocked from w""")
def rate_limited_events(spark, base):
    return L.rate_limit(table(spark, base, "events"), seconds=SECONDS, limit=LIMIT)


@job("route_windows", "T3", sql="""with g as (select epoch_us(time_bucket(interval '6 hours', ts, timestamp '1970-01-01')) as window_start, event_type, user_id % 20 as client, count(*) as hits from events group by 1, 2, 3)
select *, greatest(hits - 2, 0) as n_blocked from g""")
def route_windows(spark, base):
    e = table(spark, base, "events").withColumn("client", F.col("user_id") % 20)
    return L.route_limits(e, ["event_type", "client"], window="6 hours", limit=2)


_REQUESTS = """select event_id as request_id, user_id * 1000 + day(ts) as token, case when event_id % 29 = 0 then 99 else user_id % 7 end as ip, ts from events"""
_SESSIONS = """select user_id * 1000 + day(ts) as token, user_id % 7 as ip, min(ts) as issued_at from events where user_id % 10 <> 3 group by 1, 2"""


@job("session_verdicts", "T2", sql=f"""with r as ({_REQUESTS}), s as ({_SESSIONS}),
k as (select r.*, s.token is not null as known, s.token is not null and (r.ts >= s.issued_at + interval '12 hours' or r.ip <> s.ip) as bad from r left join s using (token)),
b as (select *, bool_or(bad) over (partition by token order by ts, request_id rows between unbounded preceding and current row) as ended from k),
u as (select *, sum(case when known and not ended then 1 else 0 end) over (partition by token order by ts, request_id rows between unbounded preceding and current row) as uses from b)
select request_id, token, case when not known then 'unknown' when ended then 'invalid' when uses <= 2 then 'ok' else 'limit' end as verdict from u""")
def session_verdicts(spark, base):
    return L.session_validity(sql_over(spark, base, _REQUESTS), sql_over(spark, base, _SESSIONS), seconds=12 * 3600, max_uses=2)


_DELAY_HOURS = 2


@job("expired_windows", "T4", sql=f"""with recursive e as (select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
w as (select user_id, t, rn, t as ws from e where rn = 1
 union all select e.user_id, e.t, e.rn, case when e.t >= w.ws + {_WIDTH} then e.t else w.ws end from w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
select user_id, ws as window_start, count(*) as hits, greatest(count(*) - {LIMIT}, 0) as n_blocked from w group by user_id, ws
having ws + {_WIDTH} <= (select max(t) // 1000 * 1000 from e) - {_DELAY_HOURS} * 3600000000::bigint""")
def expired_windows(spark, base):
    """The events as a stream: windows that have ended, written batch by batch and read back."""
    use_timers(spark)
    shape = table(spark, base, "events").schema
    # The pattern stands for a table of one file and for a folder of files.
    events = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1000).parquet(f"{base}/events.parque[t]")
    ended = closed_windows(events, seconds=SECONDS, limit=LIMIT, watermark=f"{_DELAY_HOURS} hours")
    out = new_folder(spark, "expired-windows")
    query = ended.writeStream.foreachBatch(split_sink({out: F.lit(True)}, kind="parquet")).option("checkpointLocation", new_folder(spark, "expired-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_batches(spark, out, ended.schema, "parquet").select("user_id", "window_start", "hits", "n_blocked")


@job("streamed_intake", "T5", "S2", sql=f"""with i as (select *, {INTAKE_SQL} as reject_reason from ({INTAKE}) i0)
select record_id, reject_reason, case when reject_reason is null then trim(coalesce(name, '')) else name end as name, case when reject_reason is null then trim(coalesce(message, '')) else message end as message, rating from i""")
def streamed_intake(spark, base):
    """Records written as JSON lines, taken in as a stream, and both sides read back from what the batches wrote."""
    records = sql_over(spark, base, INTAKE)
    arrived, valid, rejected, state = (new_folder(spark, f"intake-{n}") for n in ("arrived", "valid", "rejected", "state"))
    S.write_results(records, arrived)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1000).json(arrived)
    stream_intake(stream, valid, rejected, state).awaitTermination()
    kept = read_batches(spark, valid, records.schema).withColumn("reject_reason", F.lit(None).cast("string"))
    back = kept.unionByName(read_batches(spark, rejected, records.schema.add("reject_reason", "string")))
    return back.select("record_id", "reject_reason", "name", "message", "rating")
