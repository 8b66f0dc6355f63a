"""Streaming jobs, run to completion over the available files and compared with batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from questloom.plans.q_sources import scratch
from questloom.plans.q_traces import FLAGS_SQL
from questloom.plans.registry import Tables, query
from questloom.streaming import monitor as MO
from questloom.streaming import progress as PR


def as_stream(t: Tables, df, files: int = 6):
    """Write a frame in random order to the shared folder; read it as a stream, a file at a time."""
    folder = scratch(t, "feed")
    df.repartition(files, F.xxhash64(*df.columns)).write.mode("overwrite").parquet(folder)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("stream_step_monitor", f"WITH {FLAGS_SQL} SELECT task_id, step_index, action, repeated, error_run, scout_excess, empty_sql_run, profile_missing FROM fl", ["trace_steps"])
def stream_step_monitor(t: Tables):
    feed = as_stream(t, t.trace_steps)
    out = scratch(t, "monitor")
    MO.monitor(feed, out, scratch(t, "state")).awaitTermination()
    return MO.flags(t.spark, out)


@query("stream_progress", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS completed, count(*) FILTER (event_type <> 'error') AS succeeded,
count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') / count(*) AS success_rate FROM events GROUP BY 1""")
def stream_progress(t: Tables):
    done = t.events.select("ts", (F.col("event_type") != "error").alias("ok"))
    out = scratch(t, "progress")
    PR.write_updates(PR.counts(as_stream(t, done)), out, scratch(t, "state")).awaitTermination()
    return PR.latest(t.spark, out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
