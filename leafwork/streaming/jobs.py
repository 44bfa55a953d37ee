"""Jobs as streams: files that arrive, and the latest status of each job.

Documents are stateless against each other, so the batch plan runs unchanged on every micro-batch.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import LatestRows
from ..tables import cut
from . import lifecycle

#: Stages of a run and the progress each begins at.
MILESTONES = {"parse": 0.08, "figures": 0.22, "probe": 0.42, "translate": 0.44, "extract": 0.62, "summary": 0.74, "write": 0.84, "done": 1.0}


def clamp(progress: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), progress))


def translation_progress(done: Column | int, total: Column | int) -> Column | float:
    """Translation takes the progress from 0.45 to 0.62 (G3); of columns or of numbers."""
    if not isinstance(done, Column):
        return 0.46 if total <= 0 else 0.45 + min(done / total, 1.0) * 0.17
    return F.when(total <= 0, 0.46).otherwise(0.45 + F.least(done / total, F.lit(1.0)) * 0.17)


def latest_status(events: DataFrame) -> DataFrame:
    """The last status of each job, however late its events come (G2, K11); progress from 0 to 1."""
    at = F.struct("updated_at", "progress", "status")
    cols = [c for c in events.columns if c != "job_id"]
    out = events.where("job_id is not null").groupBy("job_id").agg(F.max_by(F.struct(*cols), at).alias("s")).select("job_id", "s.*")
    return out.withColumn("progress", clamp(F.col("progress")))


def status_table(spark: SparkSession, path: str, buckets: int = 64) -> LatestRows:
    """The latest status of each job, at ``path``."""
    return LatestRows(spark, path, "job_id", ["updated_at", "progress", "status"], buckets)


def read_status(spark: SparkSession, path: str, job_id: str | None = None) -> DataFrame:
    """The table as it stands, or one job's row: all of a merge is seen or nothing of it."""
    rows = status_table(spark, path).read()
    return rows if job_id is None else rows.where(F.col("job_id") == job_id)


def stream_status(source: DataFrame, path: str, checkpoint: str, buckets: int = 64, once: bool = False, silence: float | None = None, by_clock: bool = True):
    """Keep the latest status of each job in a table at ``path`` while events arrive (G4); ``read_status`` reads it.

    A micro-batch rewrites only the buckets of the jobs that it is about; one that runs again changes nothing.  With ``silence``,
    jobs follow their life cycle: one that writes nothing for so many seconds turns ``failed``.
    """
    def merge(batch: DataFrame, number: int) -> None:
        rows = batch if silence is not None else latest_status(batch)
        status_table(batch.sparkSession, path, buckets).merge(rows, number, checkpoint)

    rows = source if silence is None else lifecycle.changes(source, silence, by_clock)
    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge)
    if silence is not None:
        writer = writer.outputMode("update")
    return (writer.trigger(availableNow=True) if once else writer).start()


#: What a job writes of itself.
RECORD = "job_id string, status string, message string, progress double, error string, result string, updated_at double"


def reporter(spark: SparkSession, path: str, job_id: str) -> Callable[..., None]:
    """A function (stage, progress, error, result) that appends a status record of a job, for the engine's ``progress``.

    A record with an error ends the job as ``failed``; progress 1 without one ends it as ``completed``.
    """
    def report(stage: str, progress: float, error: str = "", result: str = "") -> None:
        status = "failed" if error else "completed" if progress >= 1 else "running"
        row = (job_id, status, stage, 1.0 if error else float(progress), error, result, time.time())
        spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").json(path)

    return report


def record(jobs: DataFrame, status: str, path: str, message: str = "", error: str = "") -> None:
    """Append a record of one status for each job of a table (job_id), however many."""
    progress = 1.0 if status in lifecycle.ENDED else 0.0
    said = {"status": status, "message": message, "progress": progress, "error": error, "result": "", "updated_at": time.time()}
    jobs.select(F.col("job_id").cast("string").alias("job_id"), *[F.lit(v).alias(k) for k, v in said.items()]).write.mode("append").json(path)


def reason(error: BaseException, most: int = 500) -> str:
    """What went wrong, in a line: of an error within a task, the line that its Python raised."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    raised = [line for line in lines if re.match(r"(\w+\.)*\w*(Error|Exception|Exit|Interrupt)\b", line)]
    return (raised[-1] if raised else lines[0] if lines else type(error).__name__)[:most]


def isolated(rows: DataFrame, work: Callable[[DataFrame], None], done: Callable[[DataFrame, str], None], key: str = "job_id", depth: int = 0) -> None:
    """Run a plan on all rows; where it fails, on each half of the keys, and so on, until only the keys that make it fail are left out.

    ``done`` is told the keys (one column ``job_id``) of every part that went through, with "", and each key that did not, with
    the error.  One bad document among n costs about 2 log n runs, of which half fail; ``work`` must bear running again on rows that it has seen.
    """
    keys = rows.select(F.col(key).alias("job_id")).distinct()
    try:
        work(rows)
    except Exception as e:  # a plan may fail in any way
        few = [r["job_id"] for r in keys.limit(2).collect()]
        if len(few) == 1:
            done(keys, reason(e))
        elif few:
            half = F.shiftright(F.xxhash64(F.col(key).cast("string")), depth).bitwiseAND(1)
            for side in (0, 1):
                isolated(rows.where(half == side), work, done, key, depth + 1)
    else:
        done(keys, "")


def submit(spark: SparkSession, file: str, inbox: str, status: str) -> str:
    """Put a file into the inbox that arriving_files reads and record a queued job for it; gives the job's id, time and eight
    random digits (G1)."""
    job = f"{int(time.time())}_{uuid.uuid4().hex[:8]}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.hadoop.fs.Path(f"{inbox}/{job}_{file.rstrip('/').rsplit('/', 1)[-1]}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, conf)
    row = (job, "queued", "", 0.0, file, target.toString(), time.time())
    kind = "job_id string, status string, message string, progress double, uploaded_name string, input_path string, updated_at double"
    spark.createDataFrame([row], kind).coalesce(1).write.mode("append").json(status)
    return job


def arriving_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Files as they arrive in an inbox."""
    fields = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(fields).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.xxhash64("path").alias("doc_id"), "length", "content")


def run_jobs(files: DataFrame, work: Callable[[DataFrame], None], checkpoint: str, once: bool = True, status: str | None = None):
    """Run a batch plan on every micro-batch of files; the checkpoint says which files are done.

    With ``status``, a folder of records, each file is a job: ``running`` when its batch begins, ``completed`` when the plan went
    through, and ``failed`` with the error if it is this file that the plan fails on; the others complete.  A batch that was
    cut off by a crash runs again when the stream starts, and until then ``stream_status`` with ``silence`` ends its jobs.
    """
    def each(batch: DataFrame, _: int) -> None:
        if status is None:
            work(batch)
            return
        rows = cut(batch.withColumn("job_id", job_of(F.col("path"))))
        jobs = rows.select("job_id").distinct()
        record(jobs, "running", status)
        isolated(rows, work, lambda ended, error: record(ended, "failed" if error else "completed", status, error=error))

    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def job_of(path: Column) -> Column:
    """The id that ``submit`` put before a file's name, else the path."""
    found = F.regexp_extract(path, r"([0-9]+_[0-9a-f]{8})_[^/]*$", 1)
    return F.when(found == "", path).otherwise(found)


def window_counts(events: DataFrame, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Events by hour and kind, late ones within the watermark included."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
