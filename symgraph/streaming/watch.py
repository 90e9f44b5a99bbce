"""Debounced change events: a burst ends when nothing came for the gap."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from symgraph.session import ship

# Endings of watched files, and the quiet time in seconds.
WATCHED = (".java", ".ts", ".tsx", ".js", ".jsx", ".scala", ".sc", ".graphql", ".gql")
GAP_SECONDS = 2


def watched(events: DataFrame, path_col: str = "path") -> DataFrame:
    return events.where(F.lower(path_col).rlike("\\.(" + "|".join(e[1:] for e in WATCHED) + ")$"))


def debounce(events: DataFrame, keys: list[str], ts: str, value: str, gap_seconds: int) -> DataFrame:
    """(keys, started, ended, n_events, values): bursts of a finished table of events.

    An event joins the burst if it comes no later than the gap after the one before.
    """
    order = Window.partitionBy(*keys).orderBy(ts, value)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    marked = events.withColumn("__new", F.coalesce(gap > gap_seconds * 1_000_000, F.lit(True)).cast("int"))
    numbered = marked.withColumn("burst", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "burst").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"), F.array_sort(F.collect_set(value)).alias("values"))


def debounce_stream(events: DataFrame, ts: str = "ts", path_col: str = "path", gap_seconds: int = GAP_SECONDS, late: str = "1 second", scope: Column | None = None) -> DataFrame:
    """Bursts of a stream of file events as session windows: distinct paths of each.

    With a scope (say, the module a path lies in) bursts are told apart by it and spread over tasks.
    """
    return (
        watched(events, path_col).withWatermark(ts, late)
        .withColumn("scope", scope if scope is not None else F.lit("all"))
        .groupBy("scope", F.session_window(ts, f"{gap_seconds} seconds").alias("burst"))
        .agg(F.array_sort(F.collect_set(path_col)).alias("paths"))
        .select("scope", "burst.start", "burst.end", "paths")
    )


class QuietTimer(StatefulProcessor):
    """Collects the paths of a scope and gives them out when no event came for the gap, by the clock.

    Each event starts the timer anew. A row without a path gives out at once what has been collected.
    """

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "events long")
        self.due = handle.getValueState("due", "at long")

    def _stop_timer(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()

    def _burst(self, key) -> Iterator[pd.DataFrame]:
        held = sorted((path[0], events[0]) for path, events in self.paths.iterator())
        self.paths.clear()
        if held:
            yield pd.DataFrame({"scope": [key[0]], "paths": [[p for p, _ in held]], "n_events": [sum(n for _, n in held)]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flush, last = False, None
        for batch in rows:
            flush = flush or bool(batch["path"].isna().any())
            for path, n in batch["path"].dropna().value_counts().items():
                before = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else 0
                self.paths.updateValue((path,), (before + int(n),))
                last = timerValues.getCurrentProcessingTimeInMs()
        if flush:
            self._stop_timer()
            yield from self._burst(key)
        elif last is not None:
            self._stop_timer()
            self.handle.registerTimer(last + self.gap_ms)
            self.due.update((last + self.gap_ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield from self._burst(key)

    def close(self) -> None:
        pass


def quiet_bursts(events: DataFrame, path_col: str = "path", gap_seconds: float = GAP_SECONDS, scope: Column | None = None) -> DataFrame:
    """(scope, paths, n_events) of bursts that end by the clock: no later event is needed.

    events is a stream; a row whose path is null flushes its scope. State is keyed by scope and holds the distinct paths of
    the open burst. It lives in RocksDB, which the session is set to use here.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = events.withColumn("scope", scope if scope is not None else F.lit("all"))
    seen = watched(named, path_col).union(named.where(F.col(path_col).isNull()))
    rows = seen.select("scope", F.col(path_col).alias("path"))
    return rows.groupBy("scope").transformWithStateInPandas(QuietTimer(int(gap_seconds * 1000)), "scope string, paths array<string>, n_events long", "Append", "ProcessingTime")


def scan_on_bursts(workspace, roots: dict[str, str], events: DataFrame, checkpoint: str, gap_seconds: float = GAP_SECONDS):
    """Start a stream that scans a module again after each burst of events(module, path) in it; it is also what scans on a flush."""

    def take(bursts: DataFrame, number: int) -> None:
        for row in bursts.select("scope").distinct().collect():  # modules with a burst in this batch
            if row.scope in roots:
                workspace.scan(roots[row.scope], row.scope)

    return on_each_burst(quiet_bursts(events, gap_seconds=gap_seconds, scope=F.col("module")), take, checkpoint)


def on_each_burst(bursts: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Start the stream; take(batch, number) gets the bursts that ended, say to scan their paths again."""
    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(take)
    return writer.trigger(availableNow=True).start() if once else writer.start()
