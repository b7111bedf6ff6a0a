"""The same operators on streams of files and findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scanloom.operators.plugins import ScannerRegistry

# Ids that share one state: a call of Python serves many ids.  Fixed for a checkpoint, as the number of state partitions is.
ID_GROUPS = 4096


def _drain(query) -> None:
    query.awaitTermination()


def stream_scan(files: DataFrame, out: str, checkpoint: str, *, registry: ScannerRegistry | None = None) -> None:
    """Scan the files that arrived since the last run, unless they were scanned before with the same content.

    ``out/files`` keeps (path, hash) of every scanned version by micro-batch, ``out/findings`` what was found.  A file is scanned when
    its hash differs from the last one known for its path; of several versions in one micro-batch the one with the greatest hash
    is taken.  Each micro-batch has folders of its own, overwritten when it is replayed, and looks only at those before it, so
    a lost executor or a restart doubles nothing.  :func:`current_findings` reads the result.
    """
    registry = registry or ScannerRegistry()

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
        one = hashed.groupBy("path").agg(F.max_by(F.struct(*hashed.columns), "hash").alias("f")).select("f.*")
        known = _before(spark, f"{out}/files", batch_id)
        if known is not None:
            last = known.groupBy("path").agg(F.max_by("hash", "batch_id").alias("hash"))
            one = one.join(last, ["path", "hash"], "left_anti")
        one.write.mode("overwrite").parquet(f"{out}/versions/batch_id={batch_id}")
        fresh = spark.read.parquet(f"{out}/versions/batch_id={batch_id}")
        registry.run(fresh.drop("hash")).write.mode("overwrite").parquet(f"{out}/findings/batch_id={batch_id}")
        # Last, so that a version counts as scanned only when its findings are there.
        fresh.select("path", "hash").write.mode("overwrite").parquet(f"{out}/files/batch_id={batch_id}")

    _drain(files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    """What earlier micro-batches wrote; None for the first."""
    if batch_id == 0:
        return None
    return spark.read.option("basePath", folder).parquet(folder).filter(F.col("batch_id") < batch_id)


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of the version of each file that was scanned last."""
    last = spark.read.parquet(f"{out}/files").groupBy("path").agg(F.max("batch_id").alias("batch_id"))
    return spark.read.parquet(f"{out}/findings").join(last.withColumnRenamed("path", "file_path"), ["file_path", "batch_id"], "left_semi").drop("batch_id")


def stream_dedup(findings: DataFrame, out: str, checkpoint: str, *, key: str = "id", ts: str = "ts", delay: str = "1 day") -> None:
    """Reports that repeat no kept report of their id within ``delay``, before or after.

    Reports are taken in the order of the micro-batches and inside one by time, then by their text.  Those that are no later than the
    watermark (``delay`` behind the latest report of earlier micro-batches) are dropped.  Of an id the times of its kept reports
    that can still matter are remembered, which lie more than ``delay`` apart, so two or three; ids are dealt to :data:`ID_GROUPS`
    states by their hash.  A timer calls a state once the watermark has passed some of its times, which it then forgets.  Ids that are null are one id.  Micro-batches are overwritten when replayed.
    """
    schema, exact = findings.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    start = F.timestamp_seconds(F.lit(0))
    wait = findings.sparkSession.range(1).select(F.unix_micros(start + F.expr(f"INTERVAL {delay}")).alias("us")).first().us
    rows = findings.withWatermark(ts, delay).select(
        F.pmod(F.xxhash64(key), F.lit(ID_GROUPS)).alias("id_group"), F.col(key).cast("string").alias("key"), F.col(ts).alias("event_time"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.to_json(F.struct(*findings.columns), exact).alias("report"))

    def keep(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept: dict[str | None, list[int]] = dict(zip(*state.get)) if state.exists else {}
        new: list[str] = []
        for at, report, id_ in sorted(((a, r, k) for part in parts for a, r, k in zip(part["at"].tolist(), part["report"], part["key"])), key=lambda x: x[:2]):
            times = kept.setdefault(id_, [])
            if all(abs(at - k) > wait for k in times):
                times.append(at)
                new.append(report)
        now = state.getCurrentWatermarkMs() * 1000
        kept = {i: left for i, times in kept.items() if (left := [k for k in times if k + wait > now])}
        if kept:
            state.update((list(kept), [list(times) for times in kept.values()]))
            state.setTimeoutTimestamp((min(map(min, kept.values())) + wait) // 1000 + 1)
        elif state.exists:
            state.remove()
        if new:
            yield pd.DataFrame({"report": new})

    first = rows.groupBy("id_group").applyInPandasWithState(
        keep, "report string", "ids array<string>, kept array<array<long>>", "append", GroupStateTimeout.EventTimeTimeout)

    def sink(batch: DataFrame, batch_id: int) -> None:
        reports = batch.select(F.from_json("report", schema, exact).alias("r")).select("r.*")
        reports.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _drain(first.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def windowed_counts(findings: DataFrame, *, ts: str = "ts", size: str = "1 day", slide: str | None = None, by: str = "severity") -> DataFrame:
    """Findings per time window and severity; batch and stream share it."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (findings.groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("window_start"), by, "n"))


def stream_trend(findings: DataFrame, out: str, checkpoint: str, *, ts: str = "ts", size: str = "1 day", slide: str | None = None,
                 delay: str = "1 day", by: str = "severity") -> None:
    """Windowed counts of a stream.  Every micro-batch writes the windows it changed; :func:`latest_counts` reads
    the last value of each, so open windows are visible and replays are harmless."""
    counts = windowed_counts(findings.withWatermark(ts, delay), ts=ts, size=size, slide=slide, by=by)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _drain(counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, out: str, by: str = "severity") -> DataFrame:
    return spark.read.parquet(out).groupBy("window_start", by).agg(F.max_by("n", "batch_id").alias("n"))


def read_parquet_stream(spark: SparkSession, folder: str, name: str, *, files_per_trigger: int | None = None) -> DataFrame:
    """What is stored under one name pattern in a folder as a stream: Parquet files, or folders of them, as a table is when Spark
    wrote it.  All that are there at a time, unless a limit is given."""
    path = f"{folder}/{{{name}}}"  # braces: a single file is read as a pattern, not as the base of partitions
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
