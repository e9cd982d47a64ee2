"""Edge rows, golden values and error paths of the reference's operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlattice.functions.columns import array_pearson, clamp, cosine, pearson, quantile_floor
from voxlattice.operators import evaluate, fit, fusion, pair, prepare
from voxlattice.sources import files


def test_guarded_metrics(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "truth double, pred double")
    assert rows.agg(*evaluate.metrics()).first()["pearson"] == 0
    assert rows.limit(1).agg(*evaluate.metrics()).first()["pearson"] == 0
    assert rows.where("pred > 9").agg(*evaluate.metrics()).first()["n"] == 0
    assert rows.agg(pearson(F.col("pred"), F.col("pred")).alias("r")).first()["r"] == pytest.approx(1)


def test_quantile_takes_the_lower_place(spark):
    row = spark.range(1).select(*[quantile_floor(F.array(*map(F.lit, v)), 0.9).alias(n) for n, v in (("three", [3.0, 1.0, 2.0]), ("one", [5.0]))], quantile_floor(F.array().cast("array<double>"), 0.5).alias("none")).first()
    assert (row["three"], row["one"], row["none"]) == (2.0, 5.0, 0.0)


def test_clamp_keeps_null_and_array_measures_guard(spark):
    row = spark.range(1).select(clamp(F.lit(None).cast("double")).alias("c"), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"), array_pearson(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("p")).first()
    assert (row["c"], row["z"], row["p"]) == (None, 0.0, 0.0)


def test_average_ranks_with_ties(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, 1.0, 3.0, 2.0)], "x double")
    assert {r["x"]: r["rank"] for r in evaluate.ranks(rows, "x").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


def test_split_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(f, c) for f, n in (("a", 10), ("b", 30), ("c", 3), ("d", 2)) for c in range(n)], "f string, c int")
    got = {(r["f"], r["split"]): r["count"] for r in prepare.stratified_split(rows, "f", "c").groupBy("f", "split").count().collect()}
    assert got == {("a", "test"): 2, ("a", "dev"): 2, ("a", "train"): 6, ("b", "test"): 4, ("b", "dev"): 4, ("b", "train"): 22, ("c", "test"): 1, ("c", "train"): 2, ("d", "train"): 2}


def test_contracts_fail_loudly(spark):
    with pytest.raises(ValueError):
        prepare.ensure_count(spark.range(3), 4)
    with pytest.raises(Exception, match="odd id"):
        prepare.ensure(spark.range(3), F.col("id") % 2 == 0, "odd id").collect()
    assert prepare.resolve(["Ref", "MOS"], "mos") == "MOS"
    assert prepare.resolve(["Ref"], "con", required=False) is None


def test_bias_alone_and_monotone_penalties(spark):
    zeros = spark.range(1).select(*[F.lit(0.0).alias(c) for c in fusion.FEATURES])
    weights = {k: 0.0 for k in fusion.FINAL} | {"bias": 1.0}
    assert zeros.select(fusion.final_mos(F.lit(2.0), weights).alias("m")).first()["m"] == pytest.approx(4.0)
    worse = zeros.withColumn("echo", F.lit(0.5))
    assert worse.select(fusion.final_mos(F.lit(4.0)).alias("m")).first()["m"] < zeros.select(fusion.final_mos(F.lit(4.0)).alias("m")).first()["m"]


def test_hinges_match_a_direct_sum(spark):
    rng = np.random.default_rng(1)
    values = rng.random(len(fusion.FEATURES))
    rows = spark.createDataFrame([(1, *map(float, values))], "key int, " + ", ".join(f"{c} double" for c in fusion.FEATURES))
    model = spark.createDataFrame([("echo", 0.15, 0.5), ("__max", 0.0, 0.25), ("__top3mean", 0.3, 0.1), ("base", 0.0, 0.0)], "feature string, knot double, weight double")
    v = dict(zip(fusion.FEATURES, values, strict=True))
    top = sorted(values)[::-1][:3]
    expected = 5 - 0.1 - 0.5 * max(0, v["echo"] - 0.15) - 0.25 * top[0] - 0.1 * max(0, sum(top) / 3 - 0.3)
    assert fusion.apply_hinges(rows, "key", model, 0.1).first()["mos"] == pytest.approx(min(5, max(1, expected)), abs=1e-12)


def test_descent_finds_weights():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    w = fit.descend(x, 5 - 0.2 - x @ np.array([1.0, 0.5, 0.0]), 6000, 0.05, 0.0)
    assert w == pytest.approx([1.0, 0.5, 0.0, 0.2], abs=0.03)


def _literal_fit(rows, w, bias, epochs, lr, l2, decay, every):
    """The reference's loop over rows (x, y)."""
    w = list(w)
    for epoch in range(epochs):
        gb, gw = 0.0, [0.0] * len(w)
        for x, y in rows:
            raw = 5 - bias - sum(a * b for a, b in zip(w, x, strict=True))
            if 1 < raw < 5:
                gb -= 2 * (raw - y)
                gw = [g - 2 * (raw - y) * v for g, v in zip(gw, x, strict=True)]
        bias = max(0, bias - lr * gb / len(rows))
        w = [max(0, v - lr * (g / len(rows) + 2 * l2 * v)) for v, g in zip(w, gw, strict=True)]
        if epoch and epoch % every == 0:
            lr *= decay
    return [*w, bias]


def test_hinge_fit_sees_all_bases_and_refits_on_both_splits(spark):
    rng = np.random.default_rng(4)
    n = len(fusion.FEATURES)
    values = [(*map(float, v), float(y), s) for v, y, s in zip(rng.random((9, n)), 1 + 4 * rng.random(9), ["train"] * 6 + ["dev"] * 3, strict=True)]
    values += values[:4]  # equal rows count as often as they occur
    rows = spark.createDataFrame(values, ", ".join(f"{c} double" for c in fusion.FEATURES) + ", truth double, split string")
    found = fit.fit_best(rows, fusion.FEATURES, "truth", [0.0005, 0.1], 12, 20, 0.018, expand=fusion.bases(), decay=0.72, every=5, start=0.02).collect()[0]

    def basis(x):
        v, top = dict(zip(fusion.FEATURES, x, strict=True)), sorted(x)[::-1][:3]
        pairs = [("echo", "base"), ("choppiness", "bad_interval"), ("residual", "noisiness"), ("clipping", "bad_interval"), ("visqol_speech", "base")]
        return [max(0, z - k) for z in [*x, top[0], sum(top) / 3, *(v[a] * v[b] for a, b in pairs)] for k in fusion.KNOTS]

    data = [(basis(r[:n]), r[n], r[n + 1]) for r in values]
    trials = []
    for l2 in (0.0005, 0.1):
        w = _literal_fit([(x, y) for x, y, s in data if s == "train"], [0.02] * 168, 0.02, 12, 0.018, l2, 0.72, 5)
        errors = [(min(5, max(1, 5 - w[-1] - np.dot(w[:-1], x))) - y) ** 2 for x, y, s in data if s == "dev"]
        trials.append((np.mean(errors) ** 0.5, l2))
    rmse, l2 = min(trials)
    assert (found["l2"], found["rmse"]) == (l2, pytest.approx(rmse))
    assert found["weights"] == pytest.approx(_literal_fit([(x, y) for x, y, _ in data], [0.02] * 168, 0.02, 20, 0.018, l2, 0.72, 5))


def test_wav_round_trip_and_errors():
    x = np.sin(np.arange(500) / 9) * 0.7
    rate, back, problem = files.decode_wav(files.encode_wav(x, 8000))
    assert rate == 8000 and problem is None and np.abs(back - x).max() <= 1 / 32768
    assert files.decode_wav(b"RIFX")[2] == "invalid WAV"
    assert files.decode_wav(files.encode_wav(x, 8000)[:20])[2] == "incomplete WAV"


def test_wav_files_read_with_errors_in_rows(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(files.encode_wav(np.zeros(10), 8000))
    (tmp_path / "b.wav").write_bytes(b"junk")
    got = {r["path"].rpartition("/")[2]: r["wav"]["error"] for r in files.read_wavs(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.wav": None, "b.wav": "invalid WAV"}


def test_calibration_rejects_what_is_no_number(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.calibration(files.numbered_lines(spark, ["unknown=abc"]), {"bias": 0.0}).collect()


def test_sinc_equals_the_sum_by_hand():
    x = np.random.default_rng(0).normal(size=60)
    for rate, to in ((16000, 48000), (48000, 16000), (44100, 48000)):
        ratio = to / rate
        cut, out = min(1.0, ratio) * 0.94, []
        for n in range(int(len(x) * ratio + 0.5)):
            place, total, norm = n / ratio, 0.0, 0.0
            for k in range(len(x)):
                d = place - k
                if math.floor(place) - 16 < k <= math.floor(place) + 16 and abs(d) <= 16:
                    w = cut * (math.sin(math.pi * cut * d) / (math.pi * cut * d) if d else 1.0) * (1 + math.cos(math.pi * d / 16)) / 2
                    total, norm = total + w * x[k], norm + w
            out.append(total / norm)
        assert pair.resample_sinc(x, rate, to) == pytest.approx(out, abs=1e-6)


def test_alignment_finds_delay_and_drift():
    rng = np.random.default_rng(3)
    a = rng.random(4000)
    for delay, ppm in ((40, 0), (-25, 2000), (120, -3000)):
        at = np.arange(4000)
        place = at - delay - np.floor(at * ppm * 1e-6).astype(int)
        b = np.where((place >= 0) & (place < 4000), a[np.clip(place, 0, 3999)], 0) * 0.8 + rng.random(4000) * 0.1
        whole, drift = pair.alignment(a, b)
        assert abs(whole - delay - 2000 * ppm * 1e-6) <= 10 and drift == pytest.approx(ppm, abs=500)


def analysed(spark, cases):
    audio = "struct<sample_rate: int, samples: array<double>>"
    told = lambda x: None if x is None else (x[0], x[1].tolist())
    rows = spark.createDataFrame([(k, told(x), told(y)) for k, (x, y) in cases.items()], f"pair_id string, ref {audio}, deg {audio}")
    return {r["pair_id"]: r for r in pair.analyse(rows).collect()}


def test_events_dimensions_and_errors(spark):
    x = pair.speech_like(seconds=4.0)
    gone = x.copy()
    gone[16000 : 16000 + 16000 // 3] = 0
    loud = np.clip(x * 9, -1, 1)
    nothing = np.zeros(16000)
    cases = {"same": ((16000, x), (16000, x)), "gone": ((16000, x), (16000, gone)), "loud": ((16000, x), (16000, loud)), "silent": ((16000, nothing), (16000, nothing))}
    cases |= {"rate": ((0, x), (16000, x)), "empty": ((16000, x), (16000, np.zeros(0))), "null": ((16000, x), None)}
    got = analysed(spark, cases)
    assert got["same"]["mos"] > 4.5 and got["same"]["confidence"] > 0.7 and not got["same"]["events"] and abs(got["same"]["drift_ppm"]) < 1
    drops = [e for e in got["gone"]["events"] if e["type"] == "dropout"]
    assert drops and abs(drops[0]["start_ms"] - 1000) < 60 and got["gone"]["mos"] < got["same"]["mos"]
    assert got["gone"]["dim_discontinuity"] < got["same"]["dim_discontinuity"]
    assert [e["type"] for e in got["loud"]["events"] if e["type"] == "clipping"] and got["loud"]["clipping_ratio"] > 0.001 and got["loud"]["mos"] < got["same"]["mos"]
    assert got["loud"]["dim_loudness"] < 4.5
    assert (got["silent"]["mos"], got["silent"]["confidence"], got["silent"]["events"]) == (1.0, 0.0, [])
    assert [got[k]["error"] for k in ("rate", "empty", "null", "same")] == ["invalid sample rate", "empty audio", "invalid sample rate", None]
    assert got["rate"]["mos"] is None


def test_scenarios_are_complete_and_damage_does_what_it_says():
    found = pair.scenarios()
    assert len(found) == 71 + 120 and found == pair.scenarios() and len({(f, level) for f, level, *_ in found}) == 191
    x = pair.speech_like(48000, 5.0)
    assert (pair.degrade(x, "repeated", 3, 48000) == 0).sum() >= 3 * 80 * 48
    quiet = pair.degrade(x, "pole", 2200, 48000)
    loud = lambda y, f: np.abs(np.fft.rfft(y)[int(f * 5) - 50 : int(f * 5) + 50]).max()
    assert loud(quiet, 5200) < 0.1 * loud(x, 5200) and loud(quiet, 180) > 0.9 * loud(x, 180)
    assert len(pair.degrade(x, "drift", 1000, 48000)) == 240240 and len(pair.degrade(x, "stretch", 2, 48000)) == 244800
    noisy = pair.degrade(x, "noise", 20, 48000, 5)
    assert 18 < 20 * math.log10(np.sqrt((x * x).mean()) / np.sqrt(((noisy - x) ** 2).mean())) < 22


def test_csv_asks_for_its_columns(spark, tmp_path):
    (tmp_path / "a_file.csv").write_text("\ufeffMos,con\n1,2\n", encoding="utf-8")
    assert files.read_csv(spark, f"{tmp_path}/*_file.csv", ["Mos"]).collect() == [("1", "2")]
    with pytest.raises(ValueError, match="no column family"):
        files.read_csv(spark, f"{tmp_path}/*_file.csv", ["family"])


def test_hinge_model_refuses_unknown_features(spark):
    with pytest.raises(ValueError, match="no such"):
        fusion.hinge_mos(spark.createDataFrame([("largest", 0.0, 1.0)], "feature string, knot double, weight double"), 0.0)


def test_sinc_keeps_a_tone():
    t = np.arange(1600) / 16000
    y = pair.resample_sinc(np.sin(2 * math.pi * 440 * t), 16000, 48000)
    assert len(y) == 4800
    assert np.abs(y[200:-200] - np.sin(2 * math.pi * 440 * np.arange(4800) / 48000)[200:-200]).max() < 0.02


def test_identity_scores_high_and_damage_lower(spark):
    x = pair.speech_like(seconds=2.0)
    cases = {"same": x, "clip": pair.degrade(x, "clip", 20.0), "noise": pair.degrade(x, "noise", 5.0), "late": pair.degrade(x, "delay", 200.0)}
    audio = "struct<sample_rate: int, samples: array<double>>"
    rows = spark.createDataFrame([(k, (16000, x.tolist()), (16000, y.tolist())) for k, y in cases.items()], f"pair_id string, ref {audio}, deg {audio}")
    got = {r["pair_id"]: r for r in pair.analyse(rows).collect()}
    assert got["same"]["mos"] > 4.5 and got["same"]["delay_ms"] == 0
    assert got["clip"]["mos"] < got["same"]["mos"] and got["clip"]["clipping_ratio"] > 0.001
    assert got["noise"]["mos"] < got["same"]["mos"]
    assert abs(got["late"]["delay_ms"] - 200) <= 15


def test_truncating_reader(spark, tmp_path):
    import struct

    pairs = [(1, 2), (-1, -2), (-3, 0), (32767, 32767), (-32768, -32767), (5, 5)]
    body = b"".join(struct.pack("<hh", *p) for p in pairs)
    stereo = b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(body)) + body
    assert (files.decode_wav(stereo, truncating=True)[1] * 32768).tolist() == [1, -1, -1, 32767, -32767, 5]
    assert (files.decode_wav(stereo)[1] * 32768).tolist() == [1.5, -1.5, -1.5, 32767, -32767.5, 5]
    (tmp_path / "a.wav").write_bytes(stereo)
    (tmp_path / "b.wav").write_bytes(stereo[:20] + struct.pack("<HHIIHH", 3, 2, 8000, 64000, 8, 32) + stereo[36:])
    got = {r["path"].rpartition("/")[2]: r["wav"] for r in files.read_wavs(spark, f"file://{tmp_path}", truncating=True).collect()}
    assert [round(x * 32768) for x in got["a.wav"]["samples"]] == [1, -1, -1, 32767, -32767, 5] and got["b.wav"]["error"] == "WAV must be PCM16"
