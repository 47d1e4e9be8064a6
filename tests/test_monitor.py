import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from folioforge.streaming import inbox, monitor

CLEAN = {"schema_version": 1, "document_id": "d", "source_url": "u", "title": "t", "markdown": "m", "cleaned_at": "1"}


def until(true, seconds=60):
    end = time.monotonic() + seconds
    while not true():
        assert time.monotonic() < end, "waited too long"
        time.sleep(0.1)


@pytest.fixture
def box(tmp_path):
    paths = {n: str(tmp_path / n) for n in ("inbox", "out", "dead", "check", "seen")}
    os.makedirs(paths["inbox"])
    return paths


def start(spark, box, stage, every=None):
    lines = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", 2).text(box["inbox"])
    writer = lines.writeStream.queryName("clean").foreachBatch(stage).option("checkpointLocation", box["check"])
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def put(box, names):
    for name in names:
        with open(f"{box['inbox']}/.{name}", "w") as f:
            f.write(json.dumps(CLEAN | {"document_id": name}))
        os.rename(f"{box['inbox']}/.{name}", f"{box['inbox']}/{name}.json")


def test_rows_of_a_listener(spark, box):
    listener = monitor.StageMonitor(spark, box["seen"])
    spark.streams.addListener(listener)
    try:
        put(box, "abcde")
        start(spark, box, lambda rows, n: rows.write.mode("overwrite").parquet(f"{box['out']}/batch={n}")).awaitTermination()
        kinds = lambda: [r.kind for r in monitor.events(spark, box["seen"]).collect()] if os.path.exists(box["seen"]) else []
        until(lambda: "ended" in kinds())
        rows = monitor.events(spark, box["seen"])
        beat = monitor.heartbeats(rows).first()
        assert (beat.stage, beat.alive, beat.error) == ("clean", False, None)
        assert [(r.stage, r.batches, r.rows) for r in monitor.metrics(rows).collect()] == [("clean", 3, 5)]

        def fail(rows, n):
            raise ValueError("broken stage")

        put(box, "f")
        with pytest.raises(Exception, match="broken stage"):
            start(spark, box, fail).awaitTermination()
        until(lambda: kinds().count("ended") == 2)
        beat = monitor.heartbeats(monitor.events(spark, box["seen"])).first()
        assert beat.alive is False and "broken stage" in beat.error
        assert monitor.unfinished(spark, box["check"]) == [3]
    finally:
        spark.streams.removeListener(listener)


def test_metrics_count_a_repeated_batch_once(spark):
    rows = spark.createDataFrame([("s", "r1", "batch", "1", 0, 5, 10, None), ("s", "r2", "batch", "2", 0, 5, 30, None), ("s", "r2", "batch", "3", 1, 0, 1, None), ("s", "r1", "started", "0", None, None, None, None)], monitor.EVENT)
    assert [tuple(r) for r in monitor.metrics(rows).collect()] == [("s", 1, 5, 31, 30)]
    assert monitor.metrics(rows.limit(0)).count() == 0 and monitor.heartbeats(rows.limit(0)).count() == 0


def test_drain_waits_for_the_batch(spark, box):
    """A stage drained in the middle of a batch has all claimed files in its output, and a later run has the others, once each."""
    began = threading.Event()

    def slow(rows, n):
        began.set()
        time.sleep(2)
        inbox_rows = rows.select(F.get_json_object("value", "$.document_id").alias("id"))
        inbox_rows.write.mode("overwrite").parquet(f"{box['out']}/batch={n}")

    put(box, "abcdefg")
    query = start(spark, box, slow, every="0 seconds")
    assert began.wait(60)
    last = monitor.drain(query, box["check"], lambda: start(spark, box, slow))
    assert last >= 0 and not query.isActive and monitor.unfinished(spark, box["check"]) == []
    done = [r.id for r in spark.read.parquet(box["out"]).collect()]
    assert len(done) == len(set(done)) >= 2
    start(spark, box, slow).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(box["out"]).collect()) == list("abcdefg")


def test_drain_gives_up(spark, box):
    put(box, "a")
    query = start(spark, box, lambda rows, n: time.sleep(8), every="0 seconds")
    until(lambda: query.status["isTriggerActive"])
    with pytest.raises(TimeoutError):
        monitor.drain(query, box["check"], lambda: query, timeout=0.5)
    query.stop()


def test_stage_progress_of_the_inbox_is_named(spark, box):
    put(box, "a")
    query = inbox.start_stage(spark, box["inbox"], "clean", lambda rows: rows, box["out"], box["dead"], box["check"])
    query.awaitTermination()
    assert monitor.unfinished(spark, box["check"]) == []
