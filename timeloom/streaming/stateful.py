"""Keyed operators with typed state, timers and an end: the ledger, paragraphs, and frames joined to sections."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from timeloom.functions.scalars import SENTENCE_END

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Typed state with timers lives in RocksDB; a provider that the session names already is left alone."""
    if "HDFSBacked" in spark.conf.get(_STORE, "HDFSBacked"):
        spark.conf.set(_STORE, _ROCKS)


def _at_ms(seconds: float) -> int:
    """Seconds of a timeline as event time: from one second on, since what lies at zero counts as late."""
    return int((seconds + 1) * 1000)


class Ledger(StatefulProcessor):
    """Admits the calls of one run in order; what it and its stages have spent and when it ends is one value, which one call reads and one writes."""

    def __init__(self, limits: dict[str, tuple[float, int]], total_limit: float, run: str, order: str, idle_ms: int):
        self.limits, self.total_limit, self.run, self.order, self.idle_ms = limits, total_limit, run, order, idle_ms
        self.verdict = Row(run, order, "stage", "verdict")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "spent double, closes long, stages array<struct<stage: string, money: double, calls: int>>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        spent, closes, stages = self.book.get() or (0.0, None, [])
        booked = {stage: (money, n) for stage, money, n in stages}
        out, last = [], 0
        for call in sorted(rows, key=lambda c: (c[self.order] is None, c[self.order])):
            estimate, actual = (math.nan if x is None else x for x in (call.estimate, call.actual))
            money, n = booked.get(call.stage, (0.0, 0))
            cap, most = self.limits.get(call.stage, (0.0, 0))
            verdict = "calls" if n >= most else "stage_money" if money + estimate > cap else "total_money" if spent + estimate > self.total_limit else "admitted"
            if verdict == "admitted":
                spent += actual
                booked[call.stage] = (money + actual, n + 1)
            out.append(self.verdict(key[0], call[self.order], call.stage, verdict))
            last = max(last, call.at_ms)
        if closes is None:
            self.handle.registerTimer(last + self.idle_ms)
        self.book.update((spent, max(last + self.idle_ms, closes or 0), [(stage, *of) for stage, of in booked.items()]))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The run's one timer stays where its first calls put it; a run that went on since waits again."""
        closes = self.book.get()[1]
        if closes > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(closes)
        else:
            self.book.clear()
            yield self.verdict(key[0], None, None, "closed")

    def close(self) -> None:
        pass


def ledger_stream(calls: DataFrame, limits: dict[str, tuple[float, int]], total_limit: float, at: str, delay: str, idle_seconds: float, run: str = "run_id", order: str = "call_pos") -> DataFrame:
    """(run, order, stage, verdict) of calls as they come; rejected calls add nothing.

    Calls of one trigger are taken in order. ``idle_seconds`` after a run's last call by its event time ``at``, once the
    watermark is past, the run is closed: its state goes and a row with the verdict ``closed``
    (and neither order nor stage) tells so. A call behind the watermark is late and
    dropped, whether its run is open or not (as is one at the epoch itself); a later one of a closed run begins it anew.
    """
    keep_state(calls.sparkSession)
    timed = calls.select(run, order, "stage", "estimate", "actual", F.col(at).cast("timestamp").alias("at")).withColumn("at_ms", F.unix_millis("at")).withWatermark("at", delay)
    processor = Ledger(limits, total_limit, run, order, int(idle_seconds * 1000))
    return timed.groupBy(run).transformWithState(processor, f"{run} long, {order} long, stage string, verdict string", "Append", "EventTime")


class Paragraphs(StatefulProcessor):
    """Joins the segments of one timeline; those ahead of the watermark wait in a list, the open paragraph is another."""

    def __init__(self, key: str, gap: float, soft_gap: float, max_duration: float):
        self.gap, self.soft_gap, self.max_duration = gap, soft_gap, max_duration
        self.paragraph = Row(key, "para_id", "start", "end", "text", "seg_indices")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        segment = "seg_idx int, begin double, stop double, text string"
        self.waiting = handle.getListState("waiting", segment)
        self.open = handle.getListState("open", segment)
        #: Paragraphs that are closed, where the open one, or the first, begins, and the one timer.
        self.place = handle.getValueState("place", "n int, begin double, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(s.seg_idx, s.start, s.end, s.text or "") for s in rows]
        self.waiting.appendList(new)
        n, begin, timer = self.place.get() or (0, None, None)
        earliest = min(_at_ms(s[1]) for s in new)
        if timer is None or earliest < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest)
            self.place.update((n, begin, earliest))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All segments up to the watermark are there, and one that ends more than the longest pause before it is followed by none."""
        now, out = timerValues.getCurrentWatermarkInMs(), []
        waiting = sorted(tuple(s) for s in self.waiting.get())
        due, later = [s for s in waiting if _at_ms(s[1]) <= now], [s for s in waiting if _at_ms(s[1]) > now]
        before = [tuple(s) for s in self.open.get()]
        open_, (n, begin, _) = list(before), self.place.get() or (0, None, None)

        def closed(parts: list[tuple], at: float, number: int) -> Row:
            return self.paragraph(key[0], f"p{number:04d}", at, parts[-1][2], " ".join(s[3] for s in parts), [s[0] for s in parts])

        for s in due:
            begin = s[1] if begin is None else begin
            text = s[3].strip()
            if not text:
                continue
            pause = s[1] - open_[-1][2] if open_ else 0.0
            if open_ and (pause > self.gap or (pause > self.soft_gap and re.search(SENTENCE_END, open_[-1][3])) or s[2] - begin > self.max_duration):
                out.append(closed(open_, begin, n))
                open_, n, begin = [], n + 1, s[1]
            elif not open_ and n:
                begin = s[1]
            open_.append((*s[:3], text))
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        quiet = _at_ms(open_[-1][2] + self.gap) + 1 if open_ else None
        if quiet is not None and quiet <= now:
            out.append(closed(open_, begin, n))
            open_, n, quiet = [], n + 1, None
        if open_ != before:
            self.open.put(open_) if open_ else self.open.clear()
        timer = min([_at_ms(s[1]) for s in later] + ([] if quiet is None else [quiet]), default=None)
        if timer is not None:
            self.handle.registerTimer(timer)
        self.place.update((n, begin, timer))
        return iter(out)

    def close(self) -> None:
        pass


def paragraph_stream(segments: DataFrame, key: str = "video_id", *, gap: float = 1.5, soft_gap: float = 0.8, max_duration: float = 30.0, delay: str = "1 minute") -> DataFrame:
    """The paragraphs of :func:`timeline.paragraphs` from segments as they come, in any order.

    A segment's event time is its start. It is looked at when the watermark reaches it, hence
    after all before it, and a paragraph is written when another begins or when the watermark has passed
    the longest pause after its end. A segment behind the watermark is late and dropped.
    Of a timeline, what waits or is open stays as state, and three numbers.
    """
    keep_state(segments.sparkSession)
    timed = segments.select(key, "seg_idx", "start", "end", "text", F.timestamp_micros(((F.col("start") + 1) * 1_000_000).cast("long")).alias("at")).withWatermark("at", delay)
    out = f"{key} long, para_id string, start double, end double, text string, seg_indices array<int>"
    return timed.groupBy(key).transformWithState(Paragraphs(key, gap, soft_gap, max_duration), out, "Append", "EventTime")


def section_frames_stream(frames: DataFrame, sections: DataFrame, key: str, at: str, start: str, end: str, delay: str, longest: str) -> DataFrame:
    """Frames beside the sections [start, end) that hold them, both as streams.

    No section may be longer than ``longest``. That bound, with a watermark on either side, tells when
    a frame or a section can have no partner any more, and its state goes. Columns of the sections but the key are kept
    under their names; the times have to be timestamps. Late rows are dropped and counted
    (:func:`late_rows`).
    """
    f = frames.withColumn("_at", F.col(at)).withWatermark("_at", delay)
    s = sections.withColumnRenamed(key, "_key").withColumn("_start", F.col(start)).withWatermark("_start", delay)
    inside = (F.col(key) == F.col("_key")) & (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col(end)) & (F.col("_at") <= F.col("_start") + F.expr(f"INTERVAL {longest}"))
    return f.join(s, inside).drop("_key", "_at", "_start")


def late_rows(query) -> int:
    """Rows that a streaming query has dropped because they came behind the watermark."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in _plain(p)["stateOperators"])


def _plain(progress) -> dict:
    return json.loads(progress.json) if hasattr(progress, "json") else progress
