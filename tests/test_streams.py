"""Merges with state, folding sinks, offset sources and late rows, over restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import cdc, late, merge, segments

VERSION = "k string, ts timestamp, seq long, op string, v double"
START = datetime(2026, 1, 1)


def feed(spark, tmp_path, *batches):
    """Adds each batch as files of its own and yields the stream's folder after each."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame([(k, START + timedelta(seconds=s), q, o, v) for k, s, q, o, v in rows], VERSION).coalesce(1).write.mode("append").json(path)
        yield path


def merged(spark, tmp_path, path, **how):
    return merge.merged(spark, spark.readStream.schema(VERSION).json(path), str(tmp_path / "table"), str(tmp_path / "check"), "k", "ts", "seq", **how)


def test_stateful_merge_equals_batch_merge_in_any_order(spark, tmp_path):
    """Versions in random order over batches, each a restart; late ones don't undo newer ones, nor deletes."""
    r = random.Random(1)
    rows = [(f"k{r.randrange(8)}", r.randrange(3000), i, r.choice("uud"), float(i)) for i in range(120)]
    every = spark.createDataFrame([(k, START + timedelta(seconds=s), q, o, v) for k, s, q, o, v in rows], VERSION)
    cuts = [rows[i : i + 40] for i in range(0, 120, 40)]
    for path in feed(spark, tmp_path, *cuts):
        table = merged(spark, tmp_path, path, fold=2)
    want = cdc.latest_versions(every, "k", "ts", "seq")
    assert sorted(table.collect()) == sorted(want.select(*table.columns).collect())


def state_rows(spark, tmp_path):
    return spark.read.format("statestore").option("stateVarName", "newest").load(str(tmp_path / "check")).count()


def test_delete_marks_expire_and_late_versions_stay_out(spark, tmp_path):
    first = [("a", 0, 1, "u", 1.0), ("b", 0, 2, "u", 2.0), ("a", 10, 3, "d", 0.0)]
    later = [("c", 5000, 4, "u", 4.0)]
    late = [("a", 5, 5, "u", 5.0), ("b", 1, 6, "u", 6.0), ("c", 5001, 7, "u", 7.0)]
    held = []
    for path in feed(spark, tmp_path, first, later, [("c", 5000, 4, "u", 4.0)], late):
        table = merged(spark, tmp_path, path, delay="60 seconds", keep_seconds=30)
        held.append(state_rows(spark, tmp_path))
    assert sorted((r.k, r.v) for r in table.collect()) == [("b", 2.0), ("c", 7.0)]
    assert held[0] == 2 and held[-1] == 2  # a's mark has gone; b and c are live


def test_a_row_may_come_back_after_its_delete(spark, tmp_path):
    for path in feed(spark, tmp_path, [("a", 0, 1, "u", 1.0)], [("a", 10, 2, "d", 0.0)], [("a", 20, 3, "u", 3.0), (None, 1, 1, "u", 9.0)]):
        table = merged(spark, tmp_path, path, delay="1 hour")
    assert [(r.k, r.v) for r in table.collect()] == [("a", 3.0)]


@pytest.mark.parametrize("fold", [0, 1, 3])
def test_folding_changes_no_result_and_bounds_versions(spark, tmp_path, fold):
    sink = cdc.VersionedSink(spark, str(tmp_path / "t"), ["k"], fold)
    want = {}
    for n in range(8):
        rows = [(f"k{(n * 3 + i) % 5}", n * 10 + i) for i in range(3)]
        want |= dict(rows)
        for _ in range(2 if n in (2, 5) else 1):  # replayed after its fold
            sink(spark.createDataFrame(rows, "k string, v long"), n)
        assert dict(map(tuple, sink.table().select("k", "v").collect())) == want
    left = spark.read.parquet(str(tmp_path / "t" / "changes")).select("sink_version").distinct().count()
    assert left == 8 if not fold else left <= 2 * fold + 2


def test_half_written_base_is_not_read(spark, tmp_path):
    sink = cdc.VersionedSink(spark, str(tmp_path / "t"), ["k"], 2)
    for n in range(3):
        sink(spark.createDataFrame([("a", n)], "k string, v long"), n)
    spark.createDataFrame([("a", 99, 2)], "k string, v long, sink_version int").write.parquet(str(tmp_path / "t" / "base" / "2"))
    assert [r.v for r in sink.table().collect()] == [2]


def test_missing_replay_has_no_events(spark, tmp_path):
    assert cdc.json_replay(spark, str(tmp_path / "none")).count() == 0
    sink = cdc.VersionedSink(spark, str(tmp_path / "t"), ["event_id"])
    stream = cdc.json_replay(spark, str(tmp_path / "later"), stream=True)
    cdc.run_available(stream, sink, str(tmp_path / "check"))
    spark.createDataFrame([("1",)], "event_id string").write.mode("append").json(str(tmp_path / "later"))
    cdc.run_available(stream, sink, str(tmp_path / "check"))
    assert [r.event_id for r in sink.table().collect()] == ["1"]


def test_offset_source_reads_each_event_once_over_restarts(spark, tmp_path):
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    sink = cdc.VersionedSink(spark, str(tmp_path / "t"), ["offset"])
    run = lambda: cdc.run_available(segments.decoded_log(segments.log(spark, log), "k long"), sink, check, "append")
    run()  # no folder yet: no events
    assert segments.log(spark, log, stream=False).count() == 0
    for n, parts in enumerate((3, 1, 2)):
        rows = spark.range(n * 100, n * 100 + 100).select(F.col("id").alias("k")).repartition(parts)
        segments.append(rows, log, str(tmp_path / f"staging{n}"))
        run()
        run()  # nothing new
    got = sink.table().collect()
    assert sorted(r.offset for r in got) == list(range(300)) and sorted(r.k for r in got) == list(range(300))
    batches = spark.read.parquet(str(tmp_path / "t" / "changes")).groupBy("sink_version").count().collect()
    assert sorted(r["count"] for r in batches if r["count"]) == [100, 100, 100]
    assert segments.log(spark, log, stream=False).count() == 300


def test_a_segment_that_grew_is_read_on(spark, tmp_path):
    log, check = tmp_path / "log", str(tmp_path / "check")
    log.mkdir()
    first = log / f"{0:020d}.jsonl"
    sink = cdc.VersionedSink(spark, str(tmp_path / "t"), ["offset"])
    run = lambda: cdc.run_available(segments.log(spark, str(log)), sink, check, "append")
    first.write_text("a\nb\n")
    run()
    first.write_text("a\nb\nc\n")
    (log / f"{3:020d}.jsonl").write_text("d\n")
    (log / "notes.txt").write_text("not a segment\n")
    run()
    assert sorted(map(tuple, sink.table().collect())) == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


def test_on_time_and_late_rows_are_all_rows(spark, tmp_path):
    log, check = str(tmp_path / "log"), str(tmp_path / "check")
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, at(0)), (2, at(100))], [(3, at(95)), (4, at(10)), (5, at(300)), (6, None)], [(7, at(289)), (8, at(290)), (9, at(50))]]
    sink = late.LateSplit(spark, str(tmp_path / "late"), "ts", 10)
    for n, rows in enumerate(batches):
        segments.append(spark.createDataFrame(rows, "k long, ts timestamp"), log, str(tmp_path / f"s{n}"))
        cdc.run_available(segments.decoded_log(segments.log(spark, log), "k long, ts timestamp"), sink, check, "append")
    assert {r.k for r in sink.late().collect()} == {4, 7, 9} and {r.k for r in sink.on_time().collect()} == {1, 2, 3, 5, 6, 8}
    last = spark.createDataFrame(batches[2], "k long, ts timestamp")
    sink(last, 2)  # a replay parts the batch as before
    assert {r.k for r in sink.late().collect()} == {4, 7, 9} and sink.on_time().count() == 6


def test_listener_counts_what_spark_drops(spark, tmp_path):
    import time

    path, listener = str(tmp_path / "in"), late.DroppedRows()
    sums = cdc.VersionedSink(spark, str(tmp_path / "t"), ["w"])
    spark.streams.addListener(listener)
    try:
        every = 0
        for seconds in ([0, 1000], [2000, 5], [3000], [7, 28, 2990], [4000]):
            every += len(seconds)
            rows = spark.createDataFrame([(START + timedelta(seconds=s),) for s in seconds], "ts timestamp")
            rows.coalesce(1).write.mode("append").json(path)
            stream = spark.readStream.schema("ts timestamp").json(path).withWatermark("ts", "60 seconds")
            counts = stream.groupBy(F.window("ts", "10 seconds").alias("w")).count()
            q = counts.writeStream.queryName("counted").outputMode("update").foreachBatch(sums).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination()
        deadline = time.time() + 20
        counted = sums.table().agg(F.sum("count")).first()[0]
        while counted + listener.dropped["counted"] < every and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped["counted"] >= 2 and counted + listener.dropped["counted"] == every
