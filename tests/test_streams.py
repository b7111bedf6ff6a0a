"""Streams over several files, one micro-batch each, against the batch result."""

from pyspark.sql import functions as F

from scanloom.operators.plugins import ScannerRegistry
from scanloom.streaming import streams


def event_files(spark, folder):
    """Two files; the second repeats an id and adds to a window of the first."""
    schema = "id string, severity string, ts timestamp"
    row = lambda i, s, h: (i, s, f"2024-01-01 {h:02d}:00:00")
    for part, rows in enumerate([[row("a", "HIGH", 1), row("b", "LOW", 2), row("a", "HIGH", 3)], [row("b", "LOW", 4), row("c", "HIGH", 5)]]):
        df = spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder)


def test_trend_over_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    batch = event_files(spark, folder)
    stream = lambda: streams.read_parquet_stream(spark, folder, "*.parquet", files_per_trigger=1)
    streams.stream_trend(stream(), out + "/trend", out + "/trend-state")
    want = sorted((r.severity, r.n) for r in streams.windowed_counts(batch).collect())
    assert sorted((r.severity, r.n) for r in streams.latest_counts(spark, out + "/trend").collect()) == want == [("HIGH", 3), ("LOW", 2)]
    assert spark.read.parquet(out + "/trend").select("batch_id").distinct().count() >= 2


def deliver(spark, folder, rows):
    df = spark.createDataFrame(rows, "id string, n int, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.write.mode("append").parquet(folder)


def test_dedup_over_deliveries_late_rows_and_restarts(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00.123456"
    run = lambda: streams.stream_dedup(streams.read_parquet_stream(spark, folder, "*.parquet"), out + "/rows", out + "/state", ts="at", delay="2 days")
    rows = lambda: sorted((r.n, str(r.at)) for r in spark.read.parquet(out + "/rows").collect())
    deliver(spark, folder, [("a", 1, day(3)), ("a", 2, day(4)), ("a", 3, day(2)), ("b", 4, day(3)), ("a", 5, day(6)), (None, 6, day(3)), (None, 7, day(3, 1))])
    run()
    assert [n for n, _ in rows()] == [3, 4, 5, 6]  # 3 comes first in time, 1 and 2 repeat it, 5 lies four days on
    assert rows()[0][1] == "2024-01-02 00:00:00.123456"
    # The watermark stands two days behind the sixth: the third is too late, the fifth is not.
    deliver(spark, folder, [("c", 10, day(3)), ("c", 11, day(5)), ("b", 12, day(5)), ("a", 13, day(5)), ("a", 14, day(8)), ("a", 15, day(9))])
    run()
    assert [n for n, _ in rows()] == [3, 4, 5, 6, 11, 15]  # 12 repeats 4, 13 and 14 repeat 5
    deliver(spark, folder, [("c", 20, day(20)), ("a", 21, day(20)), ("a", 22, day(20)), ("b", 23, day(9))])
    run()
    assert [n for n, _ in rows()] == [3, 4, 5, 6, 11, 15, 20, 21, 23]
    run()  # nothing new
    assert len(rows()) == 9


def test_many_ids_share_a_state(spark, tmp_path, monkeypatch):
    """The states, each a call of Python, do not grow with the ids; each id keeps its own times, and passed ones are forgotten."""
    monkeypatch.setattr(streams, "ID_GROUPS", 3)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: streams.stream_dedup(streams.read_parquet_stream(spark, folder, "*.parquet"), out + "/rows", out + "/state", ts="at", delay="2 days")
    deliver(spark, folder, [(None if i == 7 else f"id{i}", i, f"2024-01-{3 + i % 4:02d}") for i in range(60)])
    run()
    states = lambda: spark.read.format("statestore").load(out + "/state")
    assert 0 < states().count() <= 3
    deliver(spark, folder, [(None if i == 7 else f"id{i}", 100 + i, "2024-01-07") for i in range(60)])
    run()
    assert sorted(r.n for r in spark.read.parquet(out + "/rows").collect()) == list(range(60)) + [100 + i for i in range(60) if i % 4 < 2]
    deliver(spark, folder, [("new", 200, "2024-02-07")])
    run()
    assert [list(r.ids) for r in states().select("value.groupState.ids").collect() if r.ids] == [["new"]]


def test_a_replayed_batch_doubles_nothing(spark, tmp_path):
    """A micro-batch whose folder was written but that was not committed runs again."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    deliver(spark, folder, [("a", 1, "2024-01-03"), ("b", 2, "2024-01-03")])
    run = lambda: streams.stream_dedup(streams.read_parquet_stream(spark, folder, "*.parquet"), out + "/rows", out + "/state", ts="at")
    run()
    for commit in (tmp_path / "out" / "state" / "commits").iterdir():
        commit.rename(tmp_path / commit.name)
    run()
    assert sorted(r.n for r in spark.read.parquet(out + "/rows").collect()) == [1, 2]


def test_unchanged_files_are_skipped_and_changed_ones_scanned_again(spark, tmp_path):
    folder, out = str(tmp_path / "files"), str(tmp_path / "out")
    texts = {"x/Dockerfile": "FROM a:latest\n", "y/Dockerfile": "FROM b:1\nUSER app\n", "z/.env": "K = 'AKIA" + "A1" * 8 + "'"}
    put = lambda files: spark.createDataFrame(list(files.items()), "path string, content string").write.mode("append").parquet(folder)
    run = lambda: streams.stream_scan(streams.read_parquet_stream(spark, folder, "*.parquet"), out + "/rows", out + "/state")
    scanned = lambda: spark.read.parquet(out + "/rows/files").groupBy("batch_id").count().orderBy("batch_id").collect()
    now = lambda: {(r.file_path, r.rule_id) for r in streams.current_findings(spark, out + "/rows").collect()}
    put(texts)
    run()
    first = now()
    assert ("x/Dockerfile", "docker.latest_tag") in first and ("z/.env", "secret.aws_access_key") in first
    put({**texts, "y/Dockerfile": "FROM b:1\nUSER root\n"})
    run()
    assert [r["count"] for r in scanned()] == [3, 1]
    assert now() - first == {("y/Dockerfile", "docker.root_user"), ("y/Dockerfile", "docker.no_user")}
    put(texts)  # back to the first version: it is not the last one known
    run()
    assert [r["count"] for r in scanned()] == [3, 1, 1] and now() == first


def test_scan_sees_only_new_files(spark, tmp_path):
    folder, out = str(tmp_path / "files"), str(tmp_path / "out")
    add = lambda path: spark.createDataFrame([(path, "FROM a:latest\n")], "path string, content string").coalesce(1).write.mode("append").parquet(folder)
    run = lambda: streams.stream_scan(streams.read_parquet_stream(spark, folder, "*.parquet"), out + "/rows", out + "/state")
    add("x/Dockerfile")
    run()
    first = streams.current_findings(spark, out + "/rows").count()
    add("y/Dockerfile")
    run()
    rows = streams.current_findings(spark, out + "/rows")
    assert first == 2 and rows.count() == 4 and {r.file_path for r in rows.collect()} == {"x/Dockerfile", "y/Dockerfile"}


def test_a_table_is_a_stream_as_a_file_and_as_a_folder_of_files(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(40).select(F.col("id"), F.concat(F.lit("what? "), F.col("id").cast("string")).alias("text"))
    rows.repartition(4).write.parquet(folder + "/many.parquet")  # a folder, as Spark writes it
    rows.toPandas().to_parquet(folder + "/one.parquet")
    for name in ("many.parquet", "one.parquet"):
        out = f"{folder}/out-{name}"
        files = streams.read_parquet_stream(spark, folder, name).select(F.col("id").cast("string").alias("path"), F.col("text").alias("content"))
        found = lambda files: files.select(F.lit("q").alias("rule_id"), F.lit("q").alias("check_name"), F.lit("low").alias("severity"), "path", F.lit(1).alias("line"))
        streams.stream_scan(files, out + "/rows", out + "/state", registry=ScannerRegistry({"q": found}))
        assert sorted(int(r.file_path) for r in streams.current_findings(spark, out + "/rows").collect()) == list(range(40))
