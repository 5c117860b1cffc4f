"""Streaming queries over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.pipeline import _folder
from ..sources import tables as T
from ..streaming import events as Ev
from ..streaming import limiter
from .base import Registry

query = Registry()
c = F.col


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(s, d):
    r = Ev.windows(T.table(s, d, "events"), "1 hour")
    return r.select(c("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL")
def sliding_events(s, d):
    r = Ev.windows(T.table(s, d, "events"), "3 hours", "1 hour")
    return r.select(c("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


_SESS = """g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM {}))"""


@query("WITH " + _SESS.format("events") + " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM g GROUP BY user_id, k")
def session_windows(s, d):
    r = Ev.sessions(T.table(s, d, "events"), "6 hours")
    return r.select("user_id", c("w.start").cast("timestamp_ntz").alias("start"), c("w.end").cast("timestamp_ntz").alias("ended"), "n")


@query("WITH " + _SESS.format("(SELECT * FROM events WHERE event_type = 'error')") + " SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def stream_error_sessions(s, d):
    r = Ev.sessions(T.table(s, d, "events").where("event_type = 'error'"), "6 hours")
    return r.select("user_id", c("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_ingest(s, d):
    """The events table through a checkpointed file stream, daily counts a batch, each batch bound to its number."""
    base = f"{_folder(s)}/stream-{uuid.uuid4().hex}"
    r = Ev.ingest_once(s, f"{d}/events*.parquet", T.table(s, d, "events").schema, base, lambda df: Ev.windows(df, "1 day"), {"window": "1 day"})
    r = r.groupBy(c("w.start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return r.withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
 r AS (SELECT *, CASE WHEN event_type = 'error' THEN count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) ELSE 0 END AS run FROM g),
 w AS (SELECT *, CASE WHEN run > 0 THEN least(60.0, pow(2, least(run, 10) - 1)) ELSE 0 END::DOUBLE AS delay FROM r),
 u AS (SELECT *, max(CASE WHEN run > 0 THEN epoch_us(ts) + (delay * 1000000)::BIGINT END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM w)
 SELECT user_id, event_id, run::INT AS run, delay, round(greatest(0, coalesce(until, 0) - epoch_us(ts)) / 1000000.0, 6)::DOUBLE AS wait FROM u""")
def stream_limiter(s, d):
    """Rate-limiter state of each user over the stream of events."""
    limiter.rocksdb_state(s)
    base = f"{_folder(s)}/limiter-{uuid.uuid4().hex}"
    stream = s.readStream.schema(T.table(s, d, "events").schema).parquet(f"{d}/events*.parquet")
    q = limiter.limited(stream).writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).format("parquet").option("path", f"{base}/out").start()
    q.awaitTermination()
    return s.read.schema(limiter.OUT).parquet(f"{base}/out").select("user_id", "event_id", "run", "delay", F.round("wait", 6).alias("wait"))
