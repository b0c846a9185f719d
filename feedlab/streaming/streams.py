"""Streaming twins: hourly counts, disorder, sequence gaps, duplicates and the raw-segment sink.

Over a whole stream they give the rows of their batch twins, but for what comes late, which each says how it treats.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream_hourly_counts(stream: DataFrame, ts: str, key: str, bytes_: Column, failed: Column, late: str = "2 hours") -> DataFrame:
    """Frames, parse errors and bytes of each key and UTC hour, for the ``update`` mode.

    A batch gives out the hours that it has changed, open ones too, so the last row of each hour is its count and no hour
    waits for a later frame. Frames that come more than ``late`` behind the newest one are not counted.
    """
    hours = stream.withWatermark(ts, late).groupBy(key, F.window(ts, "1 hour").alias("w"))
    return hours.agg(F.count(F.lit(1)).alias("frames"), F.count_if(failed).alias("parse_errors"), F.sum(bytes_).alias("bytes")).select(key, F.col("w.start").alias("hour_start"), "frames", "parse_errors", "bytes")


def stream_dedupe(stream: DataFrame, ts: str, content: list[str], late: str = "2 hours") -> DataFrame:
    """Rows without exact repeats within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(content)


class SequenceGaps(StatefulProcessor):
    """By key, in order of arrival: the top number, numbers jumped over, numbers not above the top. State is three numbers a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gaps", "top long, missing long, late long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        top, missing, late = self.state.get() if self.state.exists() else (None, 0, 0)
        # A batch comes in any order; its rows are put in order of arrival, and of number where they arrived together.
        for _, s in sorted((int(t), int(x)) for part in rows for t, x in zip(part["arrival"], part["seq"], strict=True)):
            if top is not None and s <= top:
                late += 1
            else:
                missing += s - top - 1 if top is not None else 0
                top = s
        self.state.update((top, missing, late))
        yield pd.DataFrame({"key": [key[0]], "top": [top], "missing": [missing], "late": [late]})

    def close(self) -> None:
        pass


class Continuity(StatefulProcessor):
    """Sequence numbers of streams that are cut: a reconnect ends an epoch, silence ends a stream, a run may begin from a snapshot.

    Within an epoch numbers are counted as ``SequenceGaps`` does. What was missed across a reconnect can't be known, so the
    next number opens a new epoch and nothing is counted as missing. When the watermark is ``idle_ms`` past a stream's last
    frame, its row is given out once more as ended and its state goes.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("continuity", "top long, missing long, late long, unknown long, last_ms long")

    def _row(self, key, state: tuple, ended: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "top": pd.array([state[0]], "Int64"), "missing": [state[1]], "late": [state[2]], "unknown": [state[3]], "ended": [ended]})

    def _wait(self, last_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(last_ms + self.idle_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N803
        top, missing, late, unknown, last = (initialState.iloc[0][c] for c in ("top", "missing", "late", "unknown", "last_ms"))
        self.state.update((None if pd.isna(top) else int(top), int(missing), int(late), int(unknown), int(last)))
        self._wait(int(last))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        top, missing, late, unknown, last = state = self.state.get() if self.state.exists() else (None, 0, 0, 0, 0)
        if self.state.exists() and timerValues.getCurrentWatermarkInMs() >= last + self.idle_ms:  # its timer is due in this very batch
            yield self._row(key, state, True)
            top, missing, late, unknown, last = None, 0, 0, 0, 0
        batch = sorted((int(t), int(r), -1 if pd.isna(x) else int(x)) for part in rows for t, r, x in zip(part["arrival_us"], part["reconnect"], part["seq"], strict=True))
        for at, reconnect, s in batch:
            last = max(last, at // 1000)
            if reconnect:
                top, unknown = None, unknown + 1
            elif top is None or s > top:
                missing += s - top - 1 if top is not None else 0
                top = s
            else:
                late += 1
        self.state.update((top, missing, late, unknown, last))
        self._wait(last)
        yield self._row(key, (top, missing, late, unknown), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        if self.state.exists():
            state = self.state.get()
            self.state.clear()
            yield self._row(key, state, True)

    def close(self) -> None:
        pass


def stream_continuity(stream: DataFrame, key: str, seq: str, arrival: str, reconnect: Column, idle_ms: int, late: str = "10 minutes", initial: DataFrame | None = None) -> DataFrame:
    """(key, top, missing, late, unknown, ended) after each batch and at a stream's end; see ``Continuity``. Needs the RocksDB state store.

    ``initial`` (key, top, missing, late, unknown, last_ms) is the state of an earlier run, as its last rows give it; at equal
    arrival a reconnect comes after frames. Frames ``late`` behind the newest one are not counted.
    """
    rows = stream.withWatermark(arrival, late).select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(arrival), F.unix_micros(arrival).alias("arrival_us"), reconnect.cast("int").alias("reconnect"))
    start = None if initial is None else initial.select("key", "top", "missing", "late", "unknown", "last_ms").groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(Continuity(idle_ms), "key long, top long, missing long, late long, unknown long, ended boolean", "Update", "EventTime", initialState=start)


class Disorder(StatefulProcessor):
    """By key: regressions of the source clock in receive order. Rows of the newest receive time wait until a later one comes.

    Ties on receive are ordered by source, so a receive time's rows are judged together. Rows that come after a later
    receive time has been judged have no neighbours left to be compared with: they are counted as late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("disorder", "received long, source long, regressions long, comparisons long, late long")
        self.waiting = handle.getListState("open", "received long, source long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        judged, last, back, compared, late = self.state.get() if self.state.exists() else (None, None, 0, 0, 0)
        new = [(int(r), int(s)) for part in rows for r, s in zip(part["received"], part["source"], strict=True)]
        held = sorted([tuple(map(int, x)) for x in self.waiting.get()] + [x for x in new if judged is None or x[0] > judged])
        late += sum(judged is not None and x[0] <= judged for x in new)
        newest = held[-1][0] if held else None
        rest = [x for x in held if x[0] == newest]
        for received, source in held[: len(held) - len(rest)]:
            if last is not None:
                compared += 1
                back += source < last
            judged, last = received, source
        self.state.update((judged, last, back, compared, late))
        self.waiting.put(rest)
        for _, source in rest:  # as if the stream ended here
            if last is not None:
                compared += 1
                back += source < last
            last = source
        yield pd.DataFrame({"key": [key[0]], "regressions": [back], "comparisons": [compared], "late": [late]})

    def close(self) -> None:
        pass


def stream_sequence_gaps(stream: DataFrame, key: str, seq: str, arrival: str) -> DataFrame:
    """(key, top, missing, late) after each batch, numbers taken in order of the time ``arrival``; needs the RocksDB state store."""
    rows = stream.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.unix_micros(arrival).alias("arrival"))
    return rows.groupBy("key").transformWithStateInPandas(SequenceGaps(), "key long, top long, missing long, late long", "Update", "None")


def stream_disorder(stream: DataFrame, key: str, received: str, source: str) -> DataFrame:
    """(key, regressions, comparisons, late) after each batch; needs the RocksDB state store."""
    rows = stream.select(F.col(key).alias("key"), F.unix_micros(received).alias("received"), F.unix_micros(source).alias("source"))
    return rows.groupBy("key").transformWithStateInPandas(Disorder(), "key long, regressions long, comparisons long, late long", "Update", "None")


def write_raw_segments(stream: DataFrame, ts: str, source: str, name: str, path: str, checkpoint: str):
    """Start a sink that appends frames below source=/stream=/date=/hour= and a manifest of each batch's hours beside them."""

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"source": F.lit(source), "stream": F.lit(name), "date": F.to_date(ts), "hour": F.hour(ts)})
        rows.write.mode("overwrite").partitionBy("source", "stream", "date", "hour").option("timestampFormat", _MICROS).json(f"{path}/frames/batch={batch_id}")
        rows.groupBy("source", "stream", "date", "hour").agg(F.count(F.lit(1)).alias("record_count"), F.min(ts).alias("first_receive_at"), F.max(ts).alias("last_receive_at")).write.mode("overwrite").option("timestampFormat", _MICROS).json(f"{path}/manifests/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
