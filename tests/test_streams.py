"""State of event-time streams: windows close, state is dropped, late rows are counted."""

from lurescan.plans.storage import scratch_path
from lurescan.streaming import score


def _append(spark, folder, rows):
    spark.createDataFrame(rows, "day int, url string").selectExpr("timestamp_seconds(day * 86400L) AS ts", "url").coalesce(1).write.mode("append").parquet(folder)


def test_state_falls_and_late_rows_are_counted(spark):
    folder = scratch_path(spark, "events")
    good, bad = "http://example.org/a", "http://paypa1.com/"
    _append(spark, folder, [(d, u) for d in range(10) for u in (good, bad, bad)])
    _append(spark, folder, [(30, good)])
    _append(spark, folder, [(31, good), (3, bad), (4, bad)])  # two of a time that is closed
    _append(spark, folder, [(60, good)])
    stream = spark.readStream.schema("ts timestamp, url string").option("maxFilesPerTrigger", 1).parquet(folder)
    out, state = scratch_path(spark, "out"), scratch_path(spark, "state")
    query = score.start_counts(score.verdict_counts(stream, delay="2 days"), out, state)
    query.awaitTermination()
    seen = score.state_of(query)
    held = [b["held"] for b in seen]
    assert max(held) >= 20 and held[-1] < 5 and sum(b["dropped"] for b in seen) >= 20
    assert sum(b["late"] for b in seen) == 2 and sum(b["rows"] for b in seen) == 35
    got = {(r["start"].timetuple().tm_yday, r["verdict"]): r["urls"] for r in spark.read.parquet(out).collect()}
    assert got == {(d + 1, v): n for d in range(10) for v, n in (("legitimate", 1), ("phishing", 2))} | {(31, "legitimate"): 1, (32, "legitimate"): 1}


def test_repeats_pass_again_once_their_state_expired(spark):
    folder = scratch_path(spark, "repeats")
    for days in ([0, 0], [1], [20], [21], [22]):
        _append(spark, folder, [(d, "http://a.com/") for d in days])
    stream = spark.readStream.schema("ts timestamp, url string").option("maxFilesPerTrigger", 1).parquet(folder)
    out, state = scratch_path(spark, "kept"), scratch_path(spark, "kept-state")
    writer = score.distinct_urls(stream, delay="3 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert sum(b["dropped"] for b in score.state_of(query)) >= 1


def test_click_log_arrives_as_many_files_in_four_batches(spark, monkeypatch, tmp_path):
    from registry import corpus, queries

    monkeypatch.setattr(queries, "LOG_FILE_ROWS", 50)
    monkeypatch.setattr(score, "check", lambda df, *_, keep: df.selectExpr(*keep, "'legitimate' AS verdict"))
    monkeypatch.setattr(queries, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    rows = [(i, f"2024-01-{1 + i // 40:02d} 10:00:00", 1) for i in range(400)]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts", "user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"http://site{i}.example.org/a") for i in range(3)], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {}
    for r in queries.stream_windows(spark, str(tmp_path)).collect():
        got[r["day"]] = got.get(r["day"], 0) + r["urls"]
    per_day = corpus.load(spark, str(tmp_path), "clicks").selectExpr("date_format(ts, 'yyyy-MM-dd') AS day").groupBy("day").count()
    want = {r["day"]: r["count"] for r in per_day.collect()}
    assert got == {d: n for d, n in want.items() if d <= "2024-01-08"}  # two days before the latest click
    # one file a part left one task with all the work of a micro-batch
    assert len(list((tmp_path / "clicks").glob("*.parquet"))) >= 8
    assert len([f for f in (tmp_path / "windows-state" / "offsets").iterdir() if f.name.isdigit()]) >= 4
