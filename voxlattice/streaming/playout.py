"""Playout of packet streams with state: early packets wait, a deadline a frame closes gaps, late frames change nothing.

A stream's first arrival anchors its clock; frame n is due `playout` seconds and n frames after it. A packet goes out as
soon as all frames before it have; until then it waits in the state, across micro-batches. A frame without a packet in
time is decided when the watermark has passed its deadline, by an event-time timer, and repeats the last good value. A
packet that comes after its frame was closed is told as late, once, and does not become the last good value.

State of a stream: its clock, the next frame and the last value; the packets that wait; frames that were closed
without a packet, for `remembered` seconds of event time after their deadline. A marker row (seq null) moves the
watermark on; the last frame of a stream is the largest seq that was seen.

Streams are dealt to shards by a hash, and the state is kept by shard, as tables of all its streams: each access to state
is a call to the JVM, so a call a packet or a stream costs far more than the work on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: told: ok (a packet in time), concealed (closed without one), late (a packet came, too late; without a value if its
#: frame had been closed before).
TOLD = "ssrc long, seq long, told string, out double"

#: The tables of a shard, each a value of columns.
STATE = {
    "streams": {"ssrc": "long", "anchor": "long", "due": "long", "seen": "long", "last": "double"},
    "waiting": {"ssrc": "long", "seq": "long", "arrival": "long", "event_id": "long", "value": "double"},
    "closed": {"ssrc": "long", "seq": "long", "deadline": "long"},
}
_TYPE = {"long": np.int64, "double": np.float64}
_KINDS = np.array(["ok", "late", "concealed"], dtype=object)

Table = dict[str, np.ndarray]


def _rows(table: Table, which: np.ndarray) -> Table:
    return {c: x[which] for c, x in table.items()}


def _with(table: Table, **more: np.ndarray) -> Table:
    return {c: np.concatenate([x, more[c]]) for c, x in table.items()}


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands, and whether it does."""
    at = np.searchsorted(sorted_keys, keys)
    return at, at < np.searchsorted(sorted_keys, keys, "right")


def _first(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows, whether each is the first of its keys."""
    return np.concatenate([np.ones(min(1, len(keys[0])), bool), np.any([k[1:] != k[:-1] for k in keys], axis=0)])


class Playout(StatefulProcessor):
    def __init__(self, playout: int, frame: int, remembered: int):
        self.playout, self.frame, self.remembered = playout * 1_000_000, frame * 1_000_000, remembered * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = {name: handle.getValueState(name, ", ".join(f"{c} array<{t}>" for c, t in columns.items())) for name, columns in STATE.items()}

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat([part[["ssrc", "seq", "at", "event_id", "value"]] for part in rows])
        got = got[got["seq"].notna()].rename(columns={"at": "arrival"})
        if len(got):
            yield self._go_on({c: got[c].to_numpy(_TYPE[t]) for c, t in STATE["waiting"].items()}, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._go_on({c: np.empty(0, _TYPE[t]) for c, t in STATE["waiting"].items()}, timerValues)

    def _go_on(self, got: Table, timerValues) -> pd.DataFrame:
        tables, passed = {name: self._read(name) for name in STATE}, timerValues.getCurrentWatermarkInMs() * 1000
        told, after = self.advance(tables, got, passed)
        for name, table in after.items():
            if any(not np.array_equal(x, tables[name][c], equal_nan=True) for c, x in table.items()):
                self.kept[name].update(tuple(x.tolist() for x in table.values()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        streams = after["streams"]
        deadlines = (streams["anchor"] + self.playout + streams["due"] * self.frame)[streams["due"] <= streams["seen"]]
        if len(deadlines):  # the watermark has to be beyond the deadline: a packet at it is still in time
            self.handle.registerTimer(int(deadlines.min()) // 1000 + 1)
        return told

    def _read(self, name: str) -> Table:
        columns = self.kept[name].get() or ([] for _ in STATE[name])
        return {c: np.array(x, _TYPE[t]) for (c, t), x in zip(STATE[name].items(), columns, strict=True)}

    def advance(self, tables: dict[str, Table], got: Table, passed: int) -> tuple[pd.DataFrame, dict[str, Table]]:
        """TOLD rows and the tables after `got` has come and the watermark stands at `passed` microseconds."""
        got = _rows(got, np.lexsort((got["event_id"], got["arrival"], got["ssrc"])))
        streams, closed = self._known(tables["streams"], got), tables["closed"]
        ssrc, anchor, due = streams["ssrc"], streams["anchor"], streams["due"]
        width = 1 + max(int(x.max()) for x in (streams["seen"], got["seq"], np.zeros(1)) if len(x))
        number = lambda rows: np.searchsorted(ssrc, rows["ssrc"])
        key = lambda rows: number(rows) * width + rows["seq"]

        # A packet of a frame that was closed is told as late, once; others that come after their frame are not told.
        early = got["seq"] >= due[number(got)]
        at, hit = _found(key(closed), np.unique(key(_rows(got, ~early))))
        at = at[hit]
        late = pd.DataFrame({"ssrc": closed["ssrc"][at], "seq": closed["seq"][at], "told": "late", "out": np.nan}).astype({"told": object})
        closed = _rows(closed, np.delete(np.arange(len(closed["seq"])), at))

        waiting = _with(tables["waiting"], **_rows(got, early))
        waiting = _rows(waiting, np.lexsort((waiting["event_id"], waiting["arrival"], key(waiting))))
        waiting = _rows(waiting, _first(key(waiting)))
        of, seq = number(waiting), waiting["seq"]
        seen = streams["seen"].copy()
        np.maximum.at(seen, of, seq)

        # Frames whose deadline has passed are decided, and those after them as long as each has its packet in time.
        intime = waiting["arrival"] <= anchor[of] + self.playout + seq * self.frame
        over = np.maximum(due, np.minimum(seen + 1, -((anchor + self.playout - passed) // self.frame)))
        next_of, next_seq = of[intime & (seq >= over[of])], seq[intime & (seq >= over[of])]
        unbroken = next_seq - (np.arange(len(next_of)) - np.searchsorted(next_of, next_of)) == over[next_of]
        stop = over + np.bincount(next_of[unbroken], minlength=len(ssrc))

        n = stop - due
        begin = np.repeat(np.cumsum(n) - n, n)
        place, stream = np.arange(n.sum()), np.repeat(np.arange(len(ssrc)), n)
        frame = place - begin + due[stream]
        at, hit = _found(key(waiting), stream * width + frame)
        at = np.where(hit, at, 0)
        value = waiting["value"][at] if len(seq) else np.zeros(len(place))
        good = hit & (intime[at] if len(seq) else False)
        latest = np.maximum.accumulate(np.where(good & ~np.isnan(value), place, -1))  # a packet without a value repeats the last
        out = np.where(latest >= begin, value[latest], streams["last"][stream])
        told = pd.DataFrame({"ssrc": ssrc[stream], "seq": frame, "told": _KINDS[np.where(good, 0, np.where(hit, 1, 2))], "out": out})

        last = streams["last"].copy()
        last[n > 0] = out[(np.cumsum(n) - 1)[n > 0]]
        deadline = anchor[stream] + self.playout + frame * self.frame
        closed = _with(closed, **_rows({"ssrc": ssrc[stream], "seq": frame, "deadline": deadline}, ~hit))
        closed = _rows(closed, closed["deadline"] + self.remembered >= passed)
        closed = _rows(closed, np.argsort(key(closed)))
        after = {"streams": streams | {"due": stop, "seen": seen, "last": last}, "waiting": _rows(waiting, seq >= stop[of]), "closed": closed}
        return pd.concat([late, told]) if len(late) else told, after

    @staticmethod
    def _known(streams: Table, got: Table) -> Table:
        """The streams, sorted, with those that `got` (sorted by stream and arrival) begins."""
        begun = _rows(got, _first(got["ssrc"]) & ~np.isin(got["ssrc"], streams["ssrc"]))
        n = len(begun["ssrc"])
        streams = _with(streams, ssrc=begun["ssrc"], anchor=begun["arrival"], due=np.zeros(n, np.int64), seen=np.full(n, -1), last=np.zeros(n))
        return _rows(streams, np.argsort(streams["ssrc"]))


def played(packets: DataFrame, playout: int = 30, frame: int = 20, delay: str = "10 minutes", remembered: int = 3600, shards: int = 1024) -> DataFrame:
    """TOLD rows of a stream of packets (ssrc, seq, arrival, event_id, value). `delay`: how far arrivals may be out of
    order across micro-batches; older ones are dropped by the watermark. `shards`: as many that the streams of one fit in
    a task's memory."""
    shard = F.pmod(F.xxhash64("ssrc"), F.lit(shards)).cast("int").alias("shard")
    rows = packets.withWatermark("arrival", delay).select(shard, "ssrc", "seq", F.unix_micros("arrival").alias("at"), "arrival", "event_id", "value")
    processor = Playout(playout, frame, remembered)
    return rows.groupBy("shard").transformWithStateInPandas(statefulProcessor=processor, outputStructType=TOLD, outputMode="append", timeMode="eventTime")


def frames(told: DataFrame) -> DataFrame:
    """ssrc, seq, state (ok, late or missing), out of each frame, from all that a stream has told."""
    of = lambda *names: F.col("told").isin(*names)
    state = F.when(F.max(of("ok")), "ok").when(F.max(of("late")), "late").otherwise("missing")
    return told.groupBy("ssrc", "seq").agg(state.alias("state"), F.max("out").alias("out"))
