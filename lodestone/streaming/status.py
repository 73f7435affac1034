"""Status of tasks as a state machine over a stream of log rows.

A task's log (PENDING, IN_PROGRESS, SUCCESS, FAILED) is cut to runs. A row that is not terminal opens a run where none is open; the
first IN_PROGRESS of a run is its start; the first terminal row closes it, and terminal rows where no run is open are repeats, which
change nothing. A run without a row for longer than the timeout is stale: it is closed as FAILED at the end of that time, by a timer
where no row comes any more.

Rows wait in the state until the watermark passes them and are then taken in the order of their times, so the result does not depend
on how rows were dealt to batches, as long as they are not later than the watermark allows. The state of a task is its open run and
the rows that wait; it is cleared when there are neither, so it does not grow with the tasks ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ORDER = ("PENDING", "IN_PROGRESS", "SUCCESS", "FAILED")
TERMINAL = ORDER[2:]
STALE = "no news for longer than the timeout"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = T.StructType().add("task", "string").add("opened_ms", "long").add("started_ms", "long").add("status", "string").add("completed_ms", "long").add("error", "string")


class Runs(StatefulProcessor):
    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "opened long, started long, last long")
        self.waiting = handle.getListState("waiting", "ms long, place int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = {(r["ms"], ORDER.index(r["status"])) for r in rows if r["status"] in ORDER}
        if found:
            self.waiting.appendList(sorted(found))
            self.handle.registerTimer(min(found)[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted({tuple(r) for r in self.waiting.get()}) if self.waiting.exists() else []
        run = tuple(self.open.get()) if self.open.exists() else None
        due = [r for r in waiting if r[0] <= now]
        out = []

        def close(status: str, at: int, error: str | None = None) -> None:
            out.append(Row(task=key[0], opened_ms=run[0], started_ms=run[1], status=status, completed_ms=at, error=error))

        for ms, place in due:
            if run and ms > run[2] + self.timeout:
                close("FAILED", run[2] + self.timeout, STALE)
                run = None
            if ORDER[place] in TERMINAL:
                if run:
                    close(ORDER[place], ms)
                run = None
            else:
                opened, started = run[:2] if run else (ms, None)
                run = (opened, ms if started is None and ORDER[place] == "IN_PROGRESS" else started, ms)
        if run and run[2] + self.timeout <= now:
            close("FAILED", run[2] + self.timeout, STALE)
            run = None
        later = waiting[len(due) :]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if run:
            self.open.update(run)
        else:
            self.open.clear()
        if later or run:
            self.handle.registerTimer(min([r[0] for r in later[:1]] + [r[2] + self.timeout for r in [run] if r]))
        return iter(out)

    def close(self) -> None:
        pass


def runs(log: DataFrame, timeout_ms: int, late: str = "1 day") -> DataFrame:
    """log: a stream of task, ts, status. A stream of closed runs: task, opened_at, started_at, status, completed_at, error. Its session
    needs the state store of PROVIDER. Times are cut to milliseconds; null tasks, times and unknown statuses are left out."""
    rows = log.where("task is not null and ts is not null").select(F.col("task").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("ts"), "status")
    rows = rows.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    closed = rows.groupBy("task").transformWithState(statefulProcessor=Runs(timeout_ms), outputStructType=RUN, outputMode="Append", timeMode="EventTime")
    at = lambda c: F.timestamp_millis(f"{c}_ms").alias(f"{c}_at")
    return closed.select("task", at("opened"), at("started"), "status", at("completed"), "error")
