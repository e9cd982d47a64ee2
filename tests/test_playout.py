"""Playout with state, over several micro-batches."""

import datetime as dt

import numpy as np
import pandas as pd

from voxlattice.session import shared_folder
from voxlattice.streaming import packets as live
from voxlattice.streaming import playout

START = dt.datetime(2024, 1, 1)
SCHEMA = "ssrc long, seq long, arrival timestamp, event_id long, value double"


def told(spark, *batches, **options):
    """batches of (seq, seconds, value); frames of 20 s, playout 30 s."""
    slices = [spark.createDataFrame([(7, seq, START + dt.timedelta(seconds=at), k, v) for k, (seq, at, v) in enumerate(batch)], SCHEMA) for batch in batches]
    through = lambda stream: playout.played(stream, 30, 20, options.get("delay", "5 seconds"))
    return live.in_turn(spark, slices, through, shared_folder(spark, "test-playout"))


def test_early_packets_wait_and_late_ones_change_nothing(spark):
    # 2 and 3 come before 1; 4 comes at its deadline, 5 after its frame was closed; 6 is lost; 8 is late before its frame is closed.
    out = told(
        spark,
        [(0, 0, 1.0), (2, 40, 3.0)],
        [(3, 45, 4.0), (1, 48, 2.0), (1, 49, 9.0)],
        [(4, 110, 5.0)],
        [(7, 165, 8.0)],
        [(5, 168, 6.0), (8, 192, 7.0), (9, 195, 10.0)],
        [(None, 4000, 0.0)],
    )
    rows = {(r["seq"], r["told"]): r["out"] for r in out.collect()}
    assert rows == {
        (0, "ok"): 1.0, (1, "ok"): 2.0, (2, "ok"): 3.0, (3, "ok"): 4.0, (4, "ok"): 5.0, (5, "concealed"): 5.0, (5, "late"): None,
        (6, "concealed"): 5.0, (7, "ok"): 8.0, (8, "late"): 8.0, (9, "ok"): 10.0,
    }
    states = {r["seq"]: (r["state"], r["out"]) for r in playout.frames(out).collect()}
    assert states[5] == ("late", 5.0) and states[6] == ("missing", 5.0) and states[8] == ("late", 8.0) and len(states) == 10


def test_gaps_close_by_the_watermark_alone(spark):
    out = told(spark, [(0, 0, 1.0), (3, 50, 4.0)], [(3, 54, 4.0)])
    assert {r["seq"] for r in out.collect()} == {0}  # the deadlines of 1 and 2 are not over
    out = told(spark, [(0, 0, 1.0), (3, 50, 4.0)], [(4, 99, 5.0)], [(None, 100, 0.0)])
    assert {(r["seq"], r["told"]) for r in out.collect()} == {(0, "ok"), (1, "concealed"), (2, "concealed"), (3, "ok"), (4, "ok")}


def test_a_marker_alone_is_no_stream(spark):
    assert told(spark, [(None, 10, 0.0)]).count() == 0


class Kept:
    """State and timers as the processor sees them; counts the calls."""

    def __init__(self):
        self.values, self.timers, self.calls, self.watermark = {}, [], 0, 0

    def getValueState(self, name, schema):
        return KeptValue(self, name)

    def getCurrentWatermarkInMs(self):
        return self.watermark // 1000

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)


class KeptValue:
    def __init__(self, kept, name):
        self.kept, self.name = kept, name

    def get(self):
        self.kept.calls += 1
        return self.kept.values.get(self.name)

    def update(self, value):
        self.kept.calls += 1
        self.kept.values[self.name] = value


def by_loop(stream, rows, passed, told):
    """One stream, packet by packet and frame by frame."""
    for seq, *packet in sorted(rows, key=lambda r: r[1:3]):
        stream.setdefault("anchor", packet[0])
        if seq >= stream["due"]:
            stream["waiting"][seq] = min(packet, stream["waiting"].get(seq, packet))
            stream["seen"] = max(stream["seen"], seq)
        elif seq in stream["closed"]:
            stream["closed"].remove(seq)
            told.add((stream["ssrc"], seq, "late", None))
    while stream["due"] <= stream["seen"]:
        deadline, packet = stream["anchor"] + 30_000_000 + stream["due"] * 20_000_000, stream["waiting"].get(stream["due"])
        good = packet and packet[0] <= deadline
        if not good and deadline >= passed:
            break
        stream["last"] = packet[2] if good else stream["last"]
        told.add((stream["ssrc"], stream["due"], "ok" if good else "late" if packet else "concealed", stream["last"]))
        if not packet:
            stream["closed"].add(stream["due"])
        stream["waiting"].pop(stream["due"], None)
        stream["due"] += 1


def test_a_shard_of_streams_is_one_step():
    # The number of calls to the state does not grow with streams and packets; what is told is what a loop tells.
    rng, kept, got, expected = np.random.default_rng(3), Kept(), [], set()
    processor = playout.Playout(30, 20, 10**6)
    processor.init(kept)
    streams = {k: {"ssrc": k, "due": 0, "seen": -1, "last": 0.0, "waiting": {}, "closed": set()} for k in range(300)}
    rows = pd.DataFrame({"ssrc": rng.integers(0, 300, 20_000), "seq": rng.integers(0, 90, 20_000), "event_id": rng.permutation(20_000), "value": rng.random(20_000)})
    rows["at"] = (rows["seq"] * 20 + np.where(rng.random(20_000) < 0.2, rng.integers(30, 400, 20_000), rng.integers(0, 9, 20_000))) * 1_000_000
    rows = rows[rng.random(20_000) < 0.7]
    for k in range(8):
        part = rows[(rows["at"] + rows["event_id"] % 3 * 40_000_000) // 300_000_000 == k]
        got += processor.handleInputRows((0,), iter([part[:99], part[99:]]), kept)
        for ssrc, stream in streams.items():
            by_loop(stream, part[part["ssrc"] == ssrc][["seq", "at", "event_id", "value"]].itertuples(index=False), kept.watermark, expected)
        kept.watermark = (k * 300 + 100) * 1_000_000
        got += processor.handleExpiredTimer((0,), kept, None)
        for stream in streams.values():
            by_loop(stream, [], kept.watermark, expected)
    told = pd.concat(got)
    rows = [(s, n, t, None if t == "late" and np.isnan(x) else x) for s, n, t, x in told[["ssrc", "seq", "told", "out"]].itertuples(index=False)]
    assert len(rows) == len(expected) > 20_000 and set(rows) == expected
    assert {t for _, _, t, _ in rows} == {"ok", "late", "concealed"} and any(x is None for *_, x in rows)
    assert kept.calls <= 16 * 9


def test_held_back_packets_do_not_move_the_clock(spark, tmp_path):
    # Of user 1, packets 0 and 1 are held back into the second part and 2 is not; 3 is late by the clock that 0 sets, not by 2's.
    from voxlattice.plans import queries_frames as Q

    events = [(2, 1, 5.0), (5, 1, 6.0), (6, 1, 7.0), (22, 1, 8.0), (8, 2, 9.0), (9, 2, None), (10, None, 1.0)]
    schema = "event_id long, ts timestamp, user_id long, value double"
    for name, rows in (("some", events), ("none", [])):
        spark.createDataFrame([(e, START + dt.timedelta(hours=k), u, v) for k, (e, u, v) in enumerate(rows)], schema).write.parquet(f"{tmp_path}/{name}/events.parquet")
        got, expected = (sorted(map(tuple, q(spark, f"{tmp_path}/{name}").collect())) for q in (Q.stream_plc_frames, Q.plc_last_value))
        assert got == expected and len(got) == (6 if rows else 0)
        assert not rows or got[3] == (1, 3, "late", 7.0) and got[5] == (2, 1, "ok", 9.0)
