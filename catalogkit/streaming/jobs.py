"""Streams T1 to T6 and their batch twins.

State is kept per path, title or key in the RocksDB state store, on the
executors' disks with changes in the checkpoint, and goes by timers of event
time or by its time to live, so it does not grow with what has gone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import figures as G
from ..operators import audit


_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, output: str, mode: str, time: str) -> DataFrame:
    """``df`` by ``key`` through ``processor``; its session keeps state in RocksDB from here on, as timers and times to live need it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return df.groupBy(key).transformWithStateInPandas(processor, output, mode, time)


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


class _Timed(StatefulProcessor):
    """One value for each key, and at most one timer, whose time is kept beside the value."""

    schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.timer = handle.getValueState("timer", "at long")

    def close(self) -> None:
        pass

    def set_timer(self, at: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def forget(self) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        self.held.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        self.held.clear()
        return iter([])


def stable_polls(polls: DataFrame, quiet_s: float = 30.0) -> DataFrame:
    """W9 and the batch twin of T1: polls (path, size, quiet_s, polled_at, event_id) at which a file is stable.

    A file inside its quiet window only records its size; outside it is stable
    if the size is that of the poll before.
    """
    before = F.lag("size").over(Window.partitionBy("path").orderBy("polled_at", "event_id"))
    rows = polls.withColumn("before", before)
    return rows.where((F.col("quiet_s") >= quiet_s) & (F.col("before") == F.col("size"))).drop("before")


def first_stable(polls: DataFrame, quiet_s: float = 30.0) -> DataFrame:
    """T1 in batch: the first stable poll of each path."""
    s = F.struct("polled_at", "event_id", "size")
    return stable_polls(polls, quiet_s).groupBy("path").agg(F.min(s).alias("s")).select("path", "s.size", "s.polled_at")


def stable_arrivals(polls: DataFrame, quiet_s: float = 30.0, forget: str = "1 hour") -> DataFrame:
    """One row (path, size, polled_at) when a file is first stable.

    ``polls`` is a stream of path, size, quiet_s, polled_at (timestamp), event_id.
    A path that is not polled for ``forget`` of event time is forgotten.
    """
    wait = int(pd.Timedelta(forget).total_seconds() * 1000)
    keyed = polls.withWatermark("polled_at", "10 minutes")
    return _stateful(keyed, "path", _Arrivals(quiet_s, wait), "path string, size long, polled_at timestamp", "append", "EventTime")


class _Arrivals(_Timed):
    schema = "size long, done boolean"

    def __init__(self, quiet_s: float, wait: int):
        self.quiet_s, self.wait = quiet_s, wait

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        size, done = self.held.get() if self.held.exists() else (None, False)
        polls, out = pd.concat(list(rows)).sort_values(["polled_at", "event_id"]), []
        for r in polls.itertuples():
            if not done and r.quiet_s >= self.quiet_s and size == r.size:
                done = True
                out.append(pd.DataFrame({"path": [key[0]], "size": [r.size], "polled_at": [r.polled_at]}))
            size = int(r.size)
        self.held.update((size, done))
        self.set_timer(max(_ms(polls["polled_at"].max()), timerValues.getCurrentWatermarkInMs()) + self.wait)
        return iter(out)


def current_stage(history: DataFrame) -> DataFrame:
    """The latest stage of each title; the same expression in batch and, in update mode, on a stream."""
    latest = F.max(F.struct("at", "event_id", "stage")).alias("s")
    return history.groupBy("title_id").agg(latest).select("title_id", "s.stage", "s.at")


def stage_upserts(history: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """T2 as a running query: each batch's changed titles go to ``sink``, an upsert by title_id."""
    return current_stage(history).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()


_BLOCK = ("frame", "fps", "total")


def progress_blocks(lines: DataFrame) -> DataFrame:
    """T3 in batch: the last complete block of each title (title_id, seq, line with key=value); ``progress`` ends a block."""
    kv = F.split("line", "=", 2)
    rows = lines.select("title_id", "seq", F.trim(kv[0]).alias("k"), F.trim(F.get(kv, 1)).alias("v"))
    ends = F.max(F.when(F.col("k") == "progress", F.col("seq"))).over(Window.partitionBy("title_id"))
    inside = rows.withColumn("end", ends).where("seq <= end")
    last = lambda name: F.max_by("v", F.when(F.col("k") == name, F.col("seq"))).alias(name)
    out = inside.groupBy("title_id").agg(*[last(n) for n in (*_BLOCK, "progress")])
    frame, fps, total = F.col("frame").try_cast("long"), F.col("fps").try_cast("double"), F.col("total").try_cast("long")
    return out.select("title_id", frame.alias("frame"), fps.alias("fps"), G.eta_seconds(frame, total, fps).alias("eta_s"), "progress")


def encode_progress(lines: DataFrame, keep: str | None = None) -> DataFrame:
    """After each complete block, the frame, fps and seconds left of its title.

    State ends with ``progress=end``. With ``keep`` it also ends once a title has
    said nothing for so long by the clock; such a query runs batches for the
    clock's sake, so it suits one that is never done, not a bounded run.
    """
    keep_ms = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)
    return _stateful(lines, "title_id", _Progress(keep_ms), "title_id long, frame long, fps double, eta_s long, progress string", "update", "None" if keep is None else "ProcessingTime")


class _Progress(StatefulProcessor):
    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("block", ", ".join(f"{n} string" for n in _BLOCK), self.keep_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held: list[Any] = list(self.held.get()) if self.held.exists() else [None, None, None]
        out, ended = None, False
        for line in pd.concat(list(rows)).sort_values("seq")["line"]:
            name, _, value = line.partition("=")
            name, value = name.strip(), value.strip()
            if name in _BLOCK:
                held[_BLOCK.index(name)] = value
            elif name == "progress":
                frame, fps, total = (pd.to_numeric(v, errors="coerce") if v is not None else float("nan") for v in held)
                eta = int(max(0, total - frame) // fps) if fps and fps > 0 and total == total and frame == frame else None
                out, ended = {"title_id": key[0], "frame": frame, "fps": fps, "eta_s": eta, "progress": value}, value == "end"
        if ended:
            self.held.clear()
        else:
            self.held.update(tuple(held))
        return iter([] if out is None else [pd.DataFrame([out]).astype({"frame": "Int64", "eta_s": "Int64"})])


#: Changes that are kept apart before they are folded into the stored findings.
COMPACT = 16


def _versions(spark, findings_path: str) -> tuple[int | None, list[int], list[int]]:
    """The version that the findings were last folded into, those written after it, and those that the fold before it replaced."""
    log = spark.read.schema("version long, whole boolean").json(f"{findings_path}/log")
    rows = sorted((r["version"], r["whole"]) for r in log.distinct().collect())
    folds = [v for v, whole in rows if whole]
    base, before = folds[-1] if folds else None, folds[-2] if len(folds) > 1 else -1
    replaced = [v for v, _ in rows if base is not None and before <= v < base]
    return base, [v for v, whole in rows if not whole and (base is None or v > base)], replaced


def read_findings(spark, findings_path: str) -> DataFrame | None:
    """T4: the findings as of the last batch: of each path the newest row, of rows of one batch the greatest; None before the first batch."""
    base, later, _ = _versions(spark, findings_path)
    parts = [spark.read.parquet(f"{findings_path}/v{v}").withColumn("_version", F.lit(v)) for v in ([] if base is None else [base]) + later]
    if not parts:
        return None
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    columns = [c for c in rows.columns if c not in ("path", "_version")]
    return rows.groupBy("path").agg(F.max_by(F.struct(*columns), F.struct("_version", *columns)).alias("r")).select("path", "r.*")


def continuous_audit(listing: DataFrame, findings_path: str, assess: Callable[[DataFrame], DataFrame], checkpoint: str):
    """T4: files of a listing stream that are new or changed are assessed and put over the stored findings.

    A batch writes its changed rows only, as a version of their own, and then
    names it in a log, so a failed batch leaves the findings as they were. After
    COMPACT versions they are folded into one. What a fold replaces is emptied
    at the next fold, so a reader that began before it has COMPACT batches to
    end. ``read_findings`` gives the findings.
    """
    log = f"{findings_path}/log"
    listing.sparkSession.createDataFrame([], "version long, whole boolean").write.mode("append").json(log)

    def named(spark, version: int, whole: bool) -> None:
        spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(whole).alias("whole")).write.mode("append").json(log)

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        base, later, replaced = _versions(spark, findings_path)
        # even versions are changes, odd ones are folded
        version = 2 * epoch
        if max([-1 if base is None else base, *later]) >= version:  # a repeated batch is already in
            return
        stored = read_findings(spark, findings_path)
        fresh = batch if stored is None else audit.unseen_files(batch, stored)
        assess(fresh).write.mode("overwrite").parquet(f"{findings_path}/v{version}")
        named(spark, version, False)
        if len(later) + 1 >= COMPACT:
            read_findings(spark, findings_path).write.mode("overwrite").parquet(f"{findings_path}/v{version + 1}")
            named(spark, version + 1, True)
            for old in replaced:
                spark.read.parquet(f"{findings_path}/v{version + 1}").limit(0).write.mode("overwrite").parquet(f"{findings_path}/v{old}")

    return listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(upsert).start()


def due_holds(holds: DataFrame, now: Column) -> DataFrame:
    """T5 in batch: the latest hold of each title that is due."""
    last = holds.groupBy("title_id").agg(F.max(F.struct("at", "retry_after")).alias("h")).select("title_id", "h.at", "h.retry_after")
    return last.where(F.col("retry_after") <= now)


def retry_timers(holds: DataFrame) -> DataFrame:
    """T5: a held title (title_id, at, retry_after; timestamps) once the watermark passes its retry time; a later hold replaces the timer."""
    return _stateful(holds.withWatermark("at", "0 seconds"), "title_id", _Retries(), "title_id long, retry_after timestamp", "append", "EventTime")


class _Retries(_Timed):
    schema = "at long, due long"

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("at").iloc[-1]
        at = last["at"].value
        if not self.held.exists() or self.held.get()[0] <= at:
            due = _ms(last["retry_after"])
            self.held.update((at, due))
            self.set_timer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = self.held.get()[1]
        super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        return iter([pd.DataFrame({"title_id": [key[0]], "retry_after": [pd.Timestamp(due, unit="ms")]})])


def lockouts(logins: DataFrame, n: int = 5, seconds: int = 900) -> DataFrame:
    """T6 in batch: recorded failures (event_id, key, at, failed, ok) after which a key is blocked, and until when.

    A success clears the key. The window is half-open: a failure ``seconds`` old
    no longer counts.
    """
    w = Window.partitionBy("key").orderBy("at", "event_id")
    rows = logins.withColumn("cleared", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    failed = rows.where("failed").withColumn("us", F.unix_micros(F.col("at").cast("timestamp")))
    span = Window.partitionBy("key", "cleared").orderBy("us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = failed.withColumns({"recent": F.count("*").over(span), "place": F.row_number().over(Window.partitionBy("key", "cleared").orderBy("us", "event_id"))})
    nth = F.lag("us", n - 1).over(Window.partitionBy("key", "cleared").orderBy("us", "event_id"))
    rows = counted.withColumn("nth", nth).where(F.col("us") - F.col("nth") < seconds * 1_000_000)
    return rows.select("event_id", "key", "at", F.timestamp_micros(F.col("nth") + seconds * 1_000_000).alias("until"))


def lockout_stream(logins: DataFrame, n: int = 5, seconds: int = 900) -> DataFrame:
    """T6 on a stream: the failures after which a key is blocked; a key's state ends when its failures are old."""
    output = "event_id long, key string, at timestamp, until timestamp"
    return _stateful(logins.withWatermark("at", "10 minutes"), "key", _Lockouts(n, seconds), output, "append", "EventTime")


class _Lockouts(_Timed):
    schema = "recent array<long>"

    def __init__(self, n: int, seconds: int):
        self.n, self.seconds = n, seconds

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        recent: list[int] = list(self.held.get()[0]) if self.held.exists() else []
        out = []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            us = r.at.value // 1000
            if r.ok:
                recent = []
            elif r.failed:
                recent = [x for x in recent if us - x < self.seconds * 1_000_000] + [us]
                if len(recent) >= self.n:
                    out.append({"event_id": r.event_id, "key": key[0], "at": r.at, "until": pd.Timestamp(recent[-self.n] + self.seconds * 1_000_000, unit="us")})
        recent = recent[-self.n :]
        if recent:
            self.held.update((recent,))
            self.set_timer(max(recent[-1] // 1000 + self.seconds * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        else:
            self.forget()
        return iter([pd.DataFrame(out)] if out else [])
