"""The life of a job, from the records it writes: queued, running, then completed or failed.

Each job's last record is kept as state.  A job that is neither completed nor failed has a time that every record of it
sets anew; when that runs out, the job has been silent too long (its process died, or its machine did) and counts as failed.  A job that was given
up like this and speaks again goes on from what it says; one that ended by its own word stays as it is until it is queued again.
"""

from __future__ import annotations

import pickle
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ENDED = ("completed", "failed")
RECORD = "job_id string, status string, message string, progress double, error string, result string, updated_at double"
STATE = "job_id string, status string, message string, progress double, error string, result string, created_at double, updated_at double, silent boolean"
_FIELDS = [p.split()[0] for p in STATE.split(", ")]


def records(events: DataFrame) -> DataFrame:
    """Events with the columns of a record; those that are absent are empty, and rows without a job or a time are left out."""
    have = set(events.columns)
    cols = [(F.col(n) if n in have else F.lit(None)).cast(kind).alias(n) for n, kind in (p.split() for p in RECORD.split(", "))]
    return events.select(*cols).where("job_id is not null and updated_at is not null")


def follow(last: dict | None, new: dict) -> dict | None:
    """The state of a job after one more record; None if the record changes nothing.

    Records that are older than the last, or that come after the job's own end, are ignored; ``queued`` begins it anew.
    """
    if last is not None:
        if new["updated_at"] < last["updated_at"]:
            return None
        if last["status"] in ENDED and not last["silent"] and new["status"] != "queued":
            return None
    begun = new["updated_at"] if last is None or new["status"] == "queued" else last["created_at"]
    progress = 1.0 if new["status"] in ENDED else min(1.0, max(0.0, new["progress"] or 0.0))
    return {**{k: new[k] or "" for k in ("job_id", "status", "message", "error", "result")}, "progress": progress, "created_at": begun, "updated_at": new["updated_at"], "silent": False}


def given_up(last: dict, at: float, silence: float) -> dict:
    return {**last, "status": "failed", "progress": 1.0, "error": f"no record for {silence:g} seconds", "updated_at": at, "silent": True}


#: Jobs are kept by hash of their id in so many parts, each a state of its own with one timer, set to the first end of a silence in it: a state and a
#: call of Python for each job would cost more than all else.
PARTS = 4096
_SAID = [p.split()[0] for p in RECORD.split(", ")]


def _place(row: dict) -> tuple:
    """Records in the order of their times, as a sort of columns would have them: those without a value come last."""
    return tuple((row[c] is None, row[c] or 0) if c != "status" else (row[c] is None, row[c] or "") for c in ("updated_at", "progress", "status"))


def _life(silence: float, by_clock: bool):
    """The function that takes a part's new records, or the end of its timer, to the changes of its jobs."""
    def of(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        jobs = pickle.loads(bytes(kept.get[0])) if kept.exists else {}  # job -> (state, when its silence is too long, in ms)
        now = kept.getCurrentProcessingTimeMs() if by_clock else kept.getCurrentWatermarkMs()
        before = {}
        if not kept.hasTimedOut:
            told = [dict(zip(_SAID, (None if v != v else v for v in row))) for f in frames for row in zip(*(f[c].tolist() for c in _SAID))]
            for row in sorted(told, key=_place):
                held = jobs.get(row["job_id"], (None, 0))[0]
                state = follow(held, row)
                if state is not None and state != held:
                    before.setdefault(row["job_id"], held)
                    jobs[row["job_id"]] = (state, (now if by_clock else int(state["updated_at"] * 1000)) + int(silence * 1000))
        first = None
        for job, (state, due) in jobs.items():
            if state["status"] not in ENDED:
                if due <= now:
                    before.setdefault(job, state)
                    jobs[job] = (given_up(state, due / 1000, silence), due)
                else:
                    first = due if first is None else min(first, due)
        kept.update((pickle.dumps(jobs),))
        if first is not None and by_clock:
            kept.setTimeoutDuration(first - now)
        elif first is not None:
            kept.setTimeoutTimestamp(max(first - 1, now, 1))  # it runs out when the watermark has passed it
        changed = [jobs[job][0] for job, held in before.items() if jobs[job][0] != held]
        if changed:
            yield pd.DataFrame([[state[f] for f in _FIELDS] for state in changed], columns=_FIELDS)

    return of


def changes(events: DataFrame, silence: float = 600.0, by_clock: bool = True, late: str = "0 seconds") -> DataFrame:
    """A stream of events as a stream of changes (the columns of STATE): one row for each job that a micro-batch changes, and
    one for each job that falls silent for ``silence`` seconds.

    ``by_clock``: silence is measured by the clock of the cluster, so that jobs end even if no job writes any more; else by the
    latest time that any record carries, less ``late``.  Needs the RocksDB state store.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = records(events)
    if not by_clock:
        rows = rows.withColumn("at", F.timestamp_seconds("updated_at")).withWatermark("at", late)
    times = GroupStateTimeout.ProcessingTimeTimeout if by_clock else GroupStateTimeout.EventTimeTimeout
    rows = rows.withColumn("part", F.pmod(F.xxhash64("job_id"), F.lit(PARTS)).cast("int"))
    return rows.groupBy("part").applyInPandasWithState(_life(silence, by_clock), STATE, "jobs binary", "update", times)


def states(events: DataFrame, silence: float = 600.0, now: float | None = None) -> DataFrame:
    """The states that a finished table of events leads to, with silence measured up to ``now`` or the latest record, by the
    same rules as the stream: the events of a job fold in the order of their times."""
    rows = records(events)
    end = F.lit(now) if now is not None else F.lit(rows.agg(F.max("updated_at")).first()[0])
    order = Window.partitionBy("job_id").orderBy("updated_at", "progress", "status")
    gap = F.col("updated_at") - F.lag("updated_at").over(order)
    # Attempts begin with a record of ``queued``; within one, the first end that a silence did not bring about is the last word.
    rows = rows.withColumn("attempt", F.sum(F.when(F.col("status") == "queued", 1).otherwise(0)).over(order)).withColumn("gap", gap)
    own = Window.partitionBy("job_id", "attempt").orderBy("updated_at", "progress", "status")
    ended = F.coalesce(F.sum(F.col("status").isin(*ENDED).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("over", ended).where("over = 0").withColumn("begun", F.min("updated_at").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "message", "progress", "error", "result", "begun", "updated_at"), F.struct("updated_at", "progress", "status")).alias("s"))
    s = F.col("s")
    open_ = ~s["status"].isin(*ENDED)
    due = F.floor(s["updated_at"] * 1000) + int(silence * 1000)  # timers run in milliseconds
    silent = open_ & (F.floor(end * 1000) >= due)
    text = lambda c: F.coalesce(s[c], F.lit(""))
    return last.select(
        "job_id", F.when(silent, "failed").otherwise(s["status"]).alias("status"), text("message").alias("message"),
        F.when(silent | ~open_, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(s["progress"], F.lit(0.0))))).alias("progress"),
        F.when(silent, F.lit(f"no record for {silence:g} seconds")).otherwise(text("error")).alias("error"), text("result").alias("result"),
        s["begun"].alias("created_at"), F.when(silent, due / 1000).otherwise(s["updated_at"]).alias("updated_at"), silent.alias("silent"),
    )
