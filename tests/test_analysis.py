"""Whole analyses of made recordings, and order statistics of groups."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.operators import advanced, pair
from voxlattice.operators.fusion import FEATURES, FINAL
from voxlattice.operators.order_statistics import order_statistics
from voxlattice.operators.signal import PrefixQuantile, runs

AUDIO = "struct<sample_rate: int, samples: array<double>>"
RATE = 48_000


def tones(seconds, rate=RATE):
    """Three tones, louder and softer in no rhythm: only one alignment is right."""
    t = np.arange(int(seconds * rate)) / rate
    loud = 0.7 + 0.3 * np.sin(2 * np.pi * (0.7 * t + 0.9 * t * t))
    return (loud * (0.25 * np.sin(2 * np.pi * 190 * t) + 0.12 * np.sin(2 * np.pi * 900 * t) + 0.06 * np.sin(2 * np.pi * 4200 * t))).astype(np.float32).astype(np.float64)


def table(spark, cases):
    side = lambda x, rate: None if x is None else (rate, list(map(float, x)))
    rows = [(name, side(r, rate), side(d, rate)) for name, (r, d, rate) in cases.items()]
    return spark.createDataFrame(rows, f"pair_id string, ref {AUDIO}, deg {AUDIO}").repartition(4)


@pytest.fixture(scope="module")
def found(spark):
    ref = tones(4)
    echo, choppy, frozen, bad = (ref.copy() for _ in range(4))
    echo[5760:] = np.clip(ref[5760:] + 0.32 * ref[:-5760], -0.99, 0.99)
    for start in range(RATE // 2, len(ref) - 960, RATE // 5):
        choppy[start : start + 960] = 0
    for start in range(RATE, len(ref) - 960, RATE // 10):
        frozen[start : start + 960] = frozen[start - 960 : start]
    bad[48000:60000] = 0
    cases = {"clean": ref, "echo": echo, "choppy": choppy, "frozen": frozen, "bad": bad}
    cases = {name: (ref, x, RATE) for name, x in cases.items()}
    cases |= {"silent": (np.zeros(RATE), np.ones(RATE), RATE), "empty": (ref, [], RATE), "no rate": (ref, ref, 0), "nothing": (None, ref, RATE), "short": (ref[:300], ref[:300], RATE)}
    rows = pair.analyse_advanced(table(spark, cases)).withColumn("json", pair.result_json()).persist()
    yield {r["pair_id"]: r for r in rows.collect()}, rows
    rows.unpersist()


def test_damages_are_told_from_clean_speech(found):
    got, _ = found
    clean = got["clean"]
    assert clean["mos"] > 4.4 and clean["multi_resolution_similarity"] > 0.98 and clean["resolutions"] == 3
    assert got["echo"]["echo_score"] > clean["echo_score"] + 0.02 and got["echo"]["mos"] < clean["mos"]
    assert got["choppy"]["choppiness_score"] > clean["choppiness_score"] + 0.01 and got["choppy"]["mos"] < clean["mos"]
    assert got["frozen"]["choppiness_score"] > clean["choppiness_score"] + 0.005 and got["frozen"]["mos"] < clean["mos"]
    assert got["bad"]["mos"] < clean["mos"] and got["bad"]["bad_interval_severity"] > clean["bad_interval_severity"]


def test_what_cannot_be_analysed(found):
    got, _ = found
    silent = got["silent"]
    dims = [f"dim_{k}" for k in ("coloration", "noisiness", "discontinuity", "loudness")]
    assert [silent[k] for k in dims] == [1.0] * 4 and silent["base_mos"] == 1 and silent["base_confidence"] == 0
    assert [silent[k] for k in ("missing", "added", "bad_section", "clipping_ratio", "active_seconds")] == [0.0] * 5 and silent["events"] == []
    for name, error in (("empty", "empty audio"), ("no rate", "invalid sample rate"), ("nothing", "invalid sample rate")):
        row = got[name].asDict()
        assert row["error"] == error
        assert all(row[k] is None for k in row if k not in ("pair_id", "error", "events", "json")) and row["events"] == []
    assert got["short"]["error"] is None and got["short"]["choppiness_score"] == 0


def test_weights_below_zero_and_bias(spark):
    weights = dict.fromkeys(FINAL, 0.0) | {"bias": 1.0, "echo": -5.0}
    ref = tones(1)
    assert pair.analyse_advanced(table(spark, {"same": (ref, ref, RATE)}), weights).first()["mos"] == pytest.approx(4.0)


def test_result_document(found):
    got, _ = found
    doc = json.loads(got["bad"]["json"])
    assert list(doc)[:4] == ["mos", "confidence", "bandwidth", "delay_ms"] and doc["hybrid_applied"] is False
    assert list(doc["advanced"]) == pair.DIAGNOSTICS and doc["advanced"]["echo_score"] == pytest.approx(got["bad"]["echo_score"], abs=1e-6)
    assert set(doc["dimensions"]) == {"coloration", "noisiness", "discontinuity", "loudness"} and {e["type"] for e in doc["events"]} <= {"dropout", "clipping"}


def test_feature_rows(spark, found):
    _, rows = found
    experts = spark.createDataFrame([("clean", 4.5, 9.0), ("bad", 2.0, 0.0)], "pair_id string, visqol_speech_mos double, visqol_audio_mos double")
    made = {r["pair_id"]: r for r in pair.feature_rows(rows, experts).collect()}
    assert set(made) == {"clean", "echo", "choppy", "frozen", "bad", "silent", "short"}
    assert made["clean"].__fields__ == ["pair_id", *FEATURES]
    assert (made["clean"]["visqol_speech"], made["clean"]["visqol_audio"]) == (0.125, 0.0) and made["bad"]["visqol_audio"] == 1.0
    assert made["echo"]["visqol_speech"] is None
    assert all(0 <= made[p][c] <= 1 for p in made for c in FEATURES if made[p][c] is not None)


def test_parts_follow_the_delay():
    x = np.random.default_rng(3).standard_normal(4000) * 0.1
    rows = advanced.part_rows(x, np.concatenate([np.zeros(60), x]), 1000, 60)
    frames = rows[rows["kind"] == "r20"]
    assert all(np.allclose(a, b) for a, b in zip(frames["a"], frames["b"], strict=True)) and len(frames) > 390
    assert rows[rows["kind"] == "pair"]["x"].iloc[0] < 1e-6
    early = advanced.part_rows(np.concatenate([np.zeros(60), x]), x, 1000, -60)
    assert early[early["kind"] == "pair"]["x"].iloc[0] < 1e-6
    assert set(advanced.part_rows(x[:5], x[:5], 1000, 0)["kind"]) == {"pair"}


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    rows = [(k, int(v)) for k in (1, 2, None) for v in rng.integers(0, 50, 700)] + [(3, 7), (4, None)] + [(5, 1)] * 3000
    df = spark.createDataFrame(rows, "k int, v int").repartition(6)
    got = {r["k"]: (r["low"], r["mid"], r["top"]) for r in order_statistics(df, ["k"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    for k in (1, 2, None, 3, 5):
        own = sorted(v for key, v in rows if key == k and v is not None)
        assert got[k] == tuple(own[int(q * (len(own) - 1))] for q in (0.1, 0.5, 1.0))
    assert set(got) == {1, 2, 3, 5, None}
    spread = order_statistics(spark.range(5000).select((F.col("id") * 37 % 5000).alias("v")), [], "v", {"q": 0.33}).collect()
    assert [r["q"] for r in spread] == [int(0.33 * 4999)]
    assert order_statistics(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0


def test_runs_tell_the_quantile_of_all_frames_so_far():
    rng = np.random.default_rng(8)
    for q in (0.0, 0.5, 0.9, 1.0):
        own, seen = PrefixQuantile(q), []
        for v in rng.integers(0, 20, 300).tolist():
            own.add(v)
            seen.append(v)
            assert own.value == sorted(seen)[int(q * (len(seen) - 1))]
    assert runs([], 0.5) == [] and runs([0.1, 0.2], 0.5) == [] and runs([0.9], 0.5) == [(0, 1, 1.0)]
    assert runs([0.1, 0.9, 0.8, 0.2, 0.3, 0.7], 0.5) == [(1, 2, 0.8), (5, 1, 1.0)]
    many = np.where(np.arange(1_000_000) % 10 == 0, 0.9, 0.1)
    assert len(runs(many.tolist(), 0.5)) == 100_000
