"""Bursts of file events that end by the clock."""

import time

from symgraph.api import Workspace
from symgraph.streaming import watch

EVENTS = "module string, path string"


def _wait(until, seconds=120):
    end = time.time() + seconds
    while not until() and time.time() < end:
        time.sleep(0.2)
    assert until()


def test_a_burst_ends_without_a_later_event_and_is_scanned(spark, tmp_path):
    inbox, tree = tmp_path / "inbox", tmp_path / "tree"
    tree.mkdir()
    inbox.mkdir()
    (tree / "a.ts").write_text("export function a() { return b() }\n")
    put = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(inbox))
    w = Workspace(spark).scan(str(tree), "m")
    assert w.tables["edges"].count() == 0
    events = spark.readStream.schema(EVENTS).json(str(inbox))
    taken = []
    seen = watch.on_each_burst(watch.quiet_bursts(events, gap_seconds=1), lambda df, n: taken.extend(df.collect()), str(tmp_path / "marks"))
    scans = watch.scan_on_bursts(w, {"m": str(tree)}, events, str(tmp_path / "marks2"), gap_seconds=1)
    try:
        (tree / "b.ts").write_text("export function b() { return 1 }\n")
        put([("m", "b.ts"), ("m", "b.ts"), ("m", "notes.txt"), ("other", "c.java")])
        _wait(lambda: len(taken) == 1)
        assert (taken[0].scope, taken[0].paths, taken[0].n_events) == ("all", ["b.ts", "c.java"], 3)
        _wait(lambda: w.tables["edges"].count() == 1)
    finally:
        seen.stop()
        scans.stop()


def test_a_flush_gives_out_at_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    events = spark.readStream.schema(EVENTS).json(str(inbox))
    taken = []
    q = watch.on_each_burst(watch.quiet_bursts(events, gap_seconds=3600), lambda df, n: taken.extend(df.collect()), str(tmp_path / "marks"))
    try:
        spark.createDataFrame([("m", "x.java")], EVENTS).coalesce(1).write.mode("append").json(str(inbox))
        time.sleep(5)
        spark.createDataFrame([("m", None)], EVENTS).coalesce(1).write.mode("append").json(str(inbox))
        _wait(lambda: len(taken) == 1)
        assert taken[0].paths == ["x.java"]
    finally:
        q.stop()
