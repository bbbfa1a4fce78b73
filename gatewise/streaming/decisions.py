"""Structured Streaming forms: decide on arrival, windowed monitoring, de-duplication, latest state and label maturation.

Watermarks need TIMESTAMP, while parquet written without a zone loads as TIMESTAMP_NTZ: ``event_stream`` casts.
"""

from __future__ import annotations

import datetime
import sys
import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gatewise.session import checkpoint_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the library

# No event is later: the time of the row that closes a bounded stream.
END = datetime.datetime(9999, 1, 1, tzinfo=datetime.timezone.utc)


def event_stream(spark: SparkSession, folder: str, name: str, time: str, files_per_trigger: int | None = None) -> DataFrame:
    """File stream over one table of a directory, with the event time as TIMESTAMP."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern that fits this name alone: it takes a table of one file and a table that is a folder of files
    return reader.parquet(f"{folder}/{name}.parque[t]").withColumn(time, F.col(time).cast("timestamp"))


class Ran(NamedTuple):
    """What a run says at its end: rows that came after the watermark and were left out, and rows that are still kept as state."""

    late: int
    state_rows: int


def run_available(stream: DataFrame, mode: str, state_folder: str, output: str) -> Ran:
    """Process everything available into parquet on shared storage, then stop.

    Append mode uses the file sink. The other modes write each micro-batch to its own generation ``batch=<id>``, which is replaced
    as a whole when the batch is retried. No result passes through the driver.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state_folder).trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").option("path", output).start()
    else:
        started = writer.foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")).start()
    seen: dict[tuple, dict] = {}
    done = False
    while not done:  # only so many progress reports are kept
        done = started.awaitTermination(2)
        seen |= {(p["batchId"], p["timestamp"]): p for p in started.recentProgress}
    states = [p["stateOperators"] for _, p in sorted(seen.items()) if p["stateOperators"]]
    return Ran(sum(o["numRowsDroppedByWatermark"] for s in states for o in s), sum(o["numRowsTotal"] for o in states[-1]) if states else 0)


def new_state_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"


def available_rows(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a bounded stream to its end into parquet and read it back: all rows (append) or all updates."""
    spark = stream.sparkSession
    state = new_state_folder(spark, name)
    output = f"{state}-out"
    run_available(stream, mode, state, output)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(output)
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(output).drop("batch")


def closed_rows(stream: DataFrame, time: str, watermark: str, name: str, operator: Callable[[DataFrame], DataFrame], said: list[Ran] | None = None) -> DataFrame:
    """All rows that ``operator`` gives in append mode for a bounded stream, those of windows still open at its end included.

    ``operator`` gets the stream with its watermark. A first run takes what there is and emits what the watermark has passed. A second
    one, from the same checkpoint, finds a single row at ``END`` in a source of its own: it moves the watermark past
    everything, so the rest is emitted and its state goes. ``operator`` never sees that row. ``said`` collects what both runs say.
    """
    spark = stream.sparkSession
    state = new_state_folder(spark, name)
    output, closing = f"{state}-out", f"{state}-end"
    schema = StructType([StructField(f.name, f.dataType, True) for f in stream.schema])
    spark.createDataFrame([], schema).write.parquet(closing)
    both = stream.unionByName(spark.readStream.schema(schema).parquet(closing)).withWatermark(time, watermark)
    both = both.observe(name, F.count(F.lit(1)).alias("rows"))  # no filter of the operator moves below it, where it would hide the closing row
    result = operator(both.where(F.col(time) < F.lit(END)))
    ran = [run_available(result, "append", state, output)]
    spark.createDataFrame([tuple(END if c == time else None for c in stream.columns)], schema).write.mode("append").parquet(closing)
    ran.append(run_available(result, "append", state, output))
    if said is not None:
        said += ran
    return spark.read.schema(result.schema).parquet(output)


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for streams with keyed state: it alone uses the state store that these need."""
    session = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        value = spark.conf.get(key, None)
        if value is not None and not (key == "spark.checkpoint.dir" and spark.sparkContext.getConf().contains(key)):
            session.conf.set(key, value)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return session


def window_rates(events: DataFrame, time: str, category: str, value: str, window: str, watermark: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and mean value per tumbling (or sliding) window and category. Without ``watermark`` the events have theirs already."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    events = events.withWatermark(time, watermark) if watermark else events
    return (events.groupBy(span.alias("w"), category).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value"))
            .select(F.col("w.start").alias("window_start"), category, "n", "mean_value"))


def sessions(events: DataFrame, time: str, key: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Session windows per key: start, end and number of events. Without ``watermark`` the events have theirs already."""
    events = events.withWatermark(time, watermark) if watermark else events
    return (events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
            .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))


def drop_resent(events: DataFrame, time: str, keys: list[str], watermark: str) -> DataFrame:
    """First copy of re-sent events; state is kept only within the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


class _Latest(StatefulProcessor):
    """Keeps the newest (time, id, payload) per key and emits it when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._newest = handle.getValueState("newest", "at timestamp, event_id bigint, payload string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self._newest.get() if self._newest.exists() else None
        changed = False
        for batch in rows:
            top = batch.sort_values(["at", "event_id"]).iloc[-1]
            candidate = (top["at"].to_pydatetime(), int(top["event_id"]), top["payload"])
            if best is None or candidate[:2] > (best[0].replace(tzinfo=candidate[0].tzinfo), best[1]):
                best, changed = candidate, True
        if changed:
            self._newest.update(best)
            yield pd.DataFrame({"key": [key[0]], "at": [best[0]], "event_id": [best[1]], "payload": [best[2]]})

    def close(self) -> None:
        pass


def latest_state(events: DataFrame, key: str, time: str, event_id: str, payload: str) -> DataFrame:
    """Update stream of the newest payload per key, kept as keyed state. Needs the RocksDB state store provider."""
    narrow = events.select(F.col(key).cast("bigint").alias("key"), F.col(time).alias("at"), F.col(event_id).cast("bigint").alias("event_id"), F.col(payload).cast("string").alias("payload"))
    return narrow.groupBy("key").transformWithStateInPandas(statefulProcessor=_Latest(), outputStructType="key bigint, at timestamp, event_id bigint, payload string",
                                                            outputMode="Update", timeMode="None")


def latest_rows(events: DataFrame, key: str, time: str, event_id: str, payload: str) -> DataFrame:
    """The same as an update stream of Spark's own aggregate: combined before the shuffle, one state row per key."""
    row = F.struct(F.col(time).alias("at"), F.col(event_id).alias("event_id"), F.col(payload).alias("payload"))
    return events.groupBy(F.col(key).alias("key")).agg(F.max_by(row, F.struct(F.col(time), F.col(event_id))).alias("r")).select("key", "r.*")


def newest_update(updates: DataFrame) -> DataFrame:
    """The last of all updates per key."""
    return updates.groupBy("key").agg(F.max_by(F.struct("event_id", "payload"), F.struct("at", "event_id")).alias("r")).select("key", "r.*")


# ---- label maturation --------------------------------------------------------------------------------------------

def label_events(events: DataFrame, key: str, time: str, event_id: str, amount: str, decided: Column, reported: Column) -> DataFrame:
    """Decisions and reports of one stream in the layout of ``mature_labels``. A row that is neither is left out, one that is both counts twice."""
    kinds = F.array_compact(F.array(F.when(decided, F.lit(True)), F.when(reported, F.lit(False))))
    return events.select(F.col(key).cast("bigint").alias("key"), F.explode(kinds).alias("decision"), F.col(event_id).cast("bigint").alias("id"), F.col(time).alias("at"), F.col(amount).cast("double").alias("amount"))


_ROW = np.dtype([("decision", "?"), ("id", "i8"), ("at", "i8"), ("known", "?"), ("amount", "f8")])
SLICE = 10_000  # rows of a key that are kept as one entry


class _Maturing(StatefulProcessor):
    """Decisions whose interval is not over, and reports that one of them or a later row's decision may still want, as packed rows of their
    key in the order of arrival.

    Times are microseconds. A key has a timer at the end of the first interval that is over, set anew when it fires (without open
    decisions at the time of its last report), so a batch costs a key a few calls, however many rows it has. When all have fired nothing is kept.
    """

    def __init__(self, span: int):
        self._span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", "packed binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields = ((decision, row_id, at, amount is not None and amount == amount, amount or 0.0) for _, decision, row_id, at, amount, _ in rows)
        while len(new := np.fromiter(islice(fields, SLICE), _ROW)):
            self._rows.appendList(self._packed(new))
            self._set_timer(new)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = [np.frombuffer(packed, _ROW) for (packed,) in self._rows.get()]
        if not kept:
            return
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows = np.concatenate(kept)
        decided, reports = rows[rows["decision"]], rows[~rows["decision"]]
        last = len(decided) - 1 - np.unique(decided["id"][::-1], return_index=True)[1]  # of an id that comes again, the last
        decided = decided[np.sort(last)]
        is_over = self._timer(decided["at"] + self._span) <= now
        over, still = decided[is_over], decided[~is_over]
        wanted = (self._timer(reports["at"]) > now) | (reports["at"] >= (still["at"].min() if len(still) else np.iinfo(np.int64).max))
        rest = np.concatenate((still, reports[wanted]))
        if len(rest) == 0:
            self._rows.clear()
        else:
            if len(rest) < len(rows):
                self._rows.put(self._packed(rest))
            self._set_timer(rest)
        reports = reports[np.lexsort((reports["id"], reports["at"]))]
        first = np.searchsorted(reports["at"], over["at"])
        for (_, row_id, at, _, _), k in zip(over.tolist(), first.tolist()):
            report = reports[k].item() if k < len(reports) and reports["at"][k] <= at + self._span else None
            yield Row(key=key[0], decision_id=row_id, decided_at=at, report_id=report and report[1], reported_at=report and report[2], amount=report[4] if report and report[3] else None)

    def close(self) -> None:
        pass

    def _packed(self, rows: np.ndarray) -> list[tuple]:
        return [(rows[k : k + SLICE].tobytes(),) for k in range(0, len(rows), SLICE)]

    def _timer(self, micros):
        return -(-micros // 1000)

    def _set_timer(self, rows: np.ndarray) -> None:
        decided = rows["at"][rows["decision"]]
        self._handle.registerTimer(int(self._timer(decided.min() + self._span if len(decided) else rows["at"].max())))


def mature_labels(labelled: DataFrame, days: int = 180) -> DataFrame:
    """One row per decision once its ``days`` are over: the first report of its key from then on, with time and amount, or NULLs.

    ``labelled`` is a stream in the layout of ``label_events`` with a watermark on ``at``. State: each decision not yet mature and each
    report that the watermark or such a decision has not passed. Reports that come too late for their decision are behind the watermark: Spark leaves
    them out and counts them (``Ran.late``). Rows without id, key or time are left out. Start it in a ``state_session``.
    """
    whole = labelled.where("key IS NOT NULL AND id IS NOT NULL AND at IS NOT NULL").withColumn("micros", F.unix_micros("at"))
    out = whole.select("key", "decision", "id", "micros", "amount", "at").groupBy("key").transformWithState(
        statefulProcessor=_Maturing(days * 86_400_000_000), outputMode="Append", timeMode="EventTime",
        outputStructType="key bigint, decision_id bigint, decided_at bigint, report_id bigint, reported_at bigint, amount double")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("decided_at", "reported_at")})


def first_reports(labelled: DataFrame, days: int = 180) -> DataFrame:
    """The same for tables: one row per decision with its first report within ``days``, or NULLs."""
    decided = labelled.where("decision").selectExpr("key", "id AS decision_id", "at AS decided_at")
    reports = labelled.where("NOT decision").selectExpr("key AS _key", "id AS report_id", "at AS reported_at", "amount")
    near = F.expr(f"key = _key AND reported_at >= decided_at AND reported_at <= decided_at + INTERVAL {int(days)} DAYS")
    first = F.min_by(F.struct("report_id", "reported_at", "amount"), F.struct("reported_at", "report_id")).alias("r")
    return decided.join(reports, near, "left").groupBy("key", "decision_id", "decided_at").agg(first).select("key", "decision_id", "decided_at", "r.*")


def count_late(reports: DataFrame, decisions: DataFrame, key: str, decided_at: str, reported_at: str, days: int = 180) -> DataFrame:
    """Batch check beside the stream: reports that fall after the interval of every decision of their key."""
    last = decisions.groupBy(key).agg(F.max(decided_at).alias("_last"))
    late = reports.join(last, key).filter(F.col(reported_at) > F.col("_last") + F.expr(f"INTERVAL {int(days)} DAYS"))
    return late.agg(F.count("*").alias("late_reports"))


def decide_stream(payloads: DataFrame, decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply the batch decision function to a stream; it is stateless, so nothing else is needed."""
    return decide(payloads)
