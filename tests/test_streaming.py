"""Streams of files: windows equal the batch result, late rows are left out, refreshes follow changes."""

import json

from pyspark.sql import functions as F

from lodestone.streaming import events, refresh


def write(spark, folder, name, rows):
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{folder}/{name}")


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows_and_late_rows(spark, tmp_path):
    base = [(k, f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", k % 3, "view" if k % 2 else "click", 1.0, "{}") for k in range(300)]
    write(spark, tmp_path, "a", base)
    whole = events.source(spark, f"{tmp_path}/*")
    complete = {(str(r.start), r.event_type): r.n for r in drain(events.windows(whole), "complete", "complete").collect()}
    assert complete == {(f"2024-01-01 {h:02d}:00:00", t): 30 for h in range(5) for t in ("view", "click")}
    write(spark, tmp_path, "b", [(1000, "2024-01-01 00:05:00", 1, "view", 1.0, "{}"), (1001, "2024-01-01 09:00:00", 1, "view", 1.0, "{}"), (1001, "2024-01-01 09:00:00", 1, "view", 1.0, "{}")])
    late = {(str(r.start), r.event_type): r.n for r in drain(events.windows(events.source(spark, f"{tmp_path}/*")), "late").collect()}
    assert late[("2024-01-01 00:00:00", "view")] in (30, 31) and ("2024-01-01 09:00:00", "view") not in late
    assert drain(events.once(events.source(spark, f"{tmp_path}/*")), "once").where("event_id = 1001").count() == 1
    assert drain(events.sessions(events.source(spark, f"{tmp_path}/*"), "2 minutes"), "sessions", "complete").where("user_id = 1").count() > 1


def test_refresh(spark, tmp_path):
    seen = []
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(x) for x in [{"path": "a.sql", "text": "select 1"}, {"path": "b.sql", "text": "select 2"}]))
    note = lambda files, changes: seen.append(({r.path: r.text for r in files.collect()}, {(r.path, r.change) for r in changes.collect()}))
    refresh.run(refresh.watch(spark, str(tmp_path / "in")), note, str(tmp_path / "c")).awaitTermination(120)
    assert seen[-1] == ({"a.sql": "select 1", "b.sql": "select 2"}, {("a.sql", "added"), ("b.sql", "added")})
    held = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    now = refresh.keep_latest(held, spark.createDataFrame([("a", None), ("c", "z")], "path string, text string"))
    assert {(r.path, r.text) for r in now.collect()} == {("b", "y"), ("c", "z")}
