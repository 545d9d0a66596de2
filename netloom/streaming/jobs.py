"""Durable jobs: leases, claims and guarded transitions, folded from events in batch or as a stream.

Events are (event_id, ts, job_id, kind) with kind queued, claimed, heartbeat,
cancel, completed or failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEASE = "INTERVAL 5 MINUTES"
LEASE_MS = 300_000
FINAL = ["completed", "failed", "cancelled"]


def lease_gaps(events: DataFrame) -> DataFrame:
    """Per job, how often the time between two events exceeded the lease, and the longest wait in seconds."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return events.withColumn("gap", gap).groupBy("job_id").agg(F.count_if(F.col("gap") > LEASE_MS * 1000).alias("expired"), F.coalesce(F.max(F.floor(F.col("gap") / 1_000_000)), F.lit(0)).cast("long").alias("longest_s"))


def state(events: DataFrame) -> DataFrame:
    """State of every job: the first final event decides, later ones are refused; otherwise running after a claim or a
    heartbeat, queued before. One aggregate with partial combine, no window."""
    order = F.struct("ts", "event_id")
    final = F.col("kind").isin("completed", "failed", "cancel")
    outcome = F.when(F.col("kind") == "cancel", "cancelled").otherwise(F.col("kind"))
    found = events.groupBy("job_id").agg(
        F.min_by(outcome, F.when(final, order)).alias("outcome"),
        F.count_if(final).alias("finals"),
        F.count_if(F.col("kind").isin("claimed", "heartbeat")).alias("alive"),
        F.max(F.when(F.col("kind").isin("claimed", "heartbeat"), F.col("ts"))).alias("last_alive"),
        F.count_if(F.col("kind") == "queued").alias("queued"),
    )
    now = F.coalesce("outcome", F.when(F.col("alive") > 0, "running").when(F.col("queued") > 0, "queued").otherwise("unknown"))
    return found.select("job_id", now.alias("state"), F.greatest(F.col("finals") - 1, F.lit(0)).alias("refused"), (F.col("last_alive") + F.expr(LEASE)).alias("lease_until"))


def claimable(jobs: DataFrame, now: Column, slots: int) -> DataFrame:
    """The oldest queued jobs and running ones with an expired lease, numbered by slot: jobs (job_id, state, created,
    lease_until, attempt). A bounded top k; ``now`` is a parameter, so a claim can be repeated."""
    free = (F.col("state") == "queued") | ((F.col("state") == "running") & (F.col("lease_until") < now))
    top = jobs.where(free).orderBy("created", "job_id").limit(slots)
    claimed = top.withColumn("slot", F.row_number().over(Window.orderBy("created", "job_id")))
    return claimed.withColumns({"attempt": F.col("attempt") + 1, "state": F.lit("running"), "lease_until": now + F.expr(LEASE)})


def latest_completed(runs: DataFrame, by: str) -> DataFrame:
    """The latest completed run of every import, by completion, then creation, then id: an aggregate, not a sort."""
    return runs.where("state = 'completed'").groupBy(by).agg(F.max_by("run_id", F.struct("completed_at", "created_at", "run_id")).alias("run_id"))


def allowed(before: Column, after: Column) -> Column:
    return ((before == "queued") & after.isin("running", "cancelled")) | ((before == "running") & after.isin("completed", "failed", "cancelled"))


OUTPUT = "job_id long, state string, attempt int, ts timestamp"
STATE = "state string, attempt int, last_ms long"


def follow(events: DataFrame, lease_ms: int = LEASE_MS) -> DataFrame:
    """State changes of jobs from a stream of events. The state of a job is kept by Spark; a processing-time timeout stands
    for the lease: a running job without a sign of life for that long returns to the queue, and the next claim is a new
    attempt. Spark looks for expired leases in batch after batch, so a query that is to end by itself (``availableNow``)
    needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off; leases are then checked whenever events come."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, attempt, last = held.get if held.exists else ("new", 0, 0)
        rows = []
        if held.hasTimedOut:
            if state == "running":
                state = "queued"
                rows.append((key[0], state, attempt, pd.Timestamp(last + lease_ms, unit="ms")))
        else:
            for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
                before = state
                if e.kind == "queued" and state == "new":
                    state = "queued"
                elif e.kind in ("claimed", "heartbeat") and state in ("new", "queued"):
                    state, attempt = "running", attempt + 1
                elif e.kind in ("completed", "failed") and state == "running":
                    state = e.kind
                elif e.kind == "cancel" and state in ("new", "queued", "running"):
                    state = "cancelled"
                last = max(last, int(e.ts.timestamp() * 1000))
                if state != before:
                    rows.append((key[0], state, attempt, e.ts))
        held.update((state, attempt, last))
        if state == "running":
            held.setTimeoutDuration(lease_ms)
        yield pd.DataFrame(rows, columns=["job_id", "state", "attempt", "ts"])

    return events.groupBy("job_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
