"""Queries of whole analyses over recordings that the given tables hold: texts as samples of 8 bits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxlattice.functions.columns import dot
from voxlattice.operators import advanced, pair
from voxlattice.operators.evaluate import r6
from voxlattice.operators.resample import resampled
from voxlattice.session import staged
from voxlattice.sources.lenses import read


def _dealt(pairs):
    """Pairs over all tasks: an analysis takes far longer than its texts' size tells, so they are not dealt by bytes. By a
    hash of the key: dealt by the key itself, as they were grouped, Spark drops the exchange and merges the tasks."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("pair_id"))


def _sides(spark, d):
    """A conversation's two sides, each as one recording, and a delay of three samples at most either way."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("u"), F.when(F.col("role") != "user", F.col("text")).alias("v"))
    whole = lambda c: F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("turn", c)))), lambda t: t[c]), ""), "UTF-8")
    sides = turns.groupBy(F.col("conv_id").alias("pair_id")).agg(whole("u").alias("ref"), whole("v").alias("deg"))
    return _dealt(sides).withColumn("delay", (F.col("pair_id") % 7 - 3).cast("int"))


def advanced_diagnostics(spark, d):
    """All diagnostics of the advanced analysis, of conversations at 1 kHz."""
    found = advanced.diagnostics(staged(advanced.parts(_sides(spark, d), 1000), "parts"))
    return found.select("pair_id", "resolutions", *[r6(F.col(c)).alias(c) for c in pair.DIAGNOSTICS])


def resolution_frames(spark, d):
    """The three-resolution frame table: frames and means of each pair and resolution."""
    frames = advanced.frame_measures(staged(advanced.parts(_sides(spark, d), 1000), "parts"))
    return frames.groupBy("pair_id", "kind").agg(F.count("*").alias("frames"), *[r6(F.avg(c)).alias(c) for c in ("similarity", "asymmetry", "tilt")])


def _recordings(spark, d):
    """A conversation's two sides as recordings of 2 kHz."""

    @F.pandas_udf("array<double>")
    def samples(sides: pd.Series) -> pd.Series:
        return pd.Series([((np.frombuffer(x, np.uint8) - 128.0) / 128) for x in sides])

    side = lambda c: F.struct(F.lit(2000).alias("sample_rate"), samples(c).alias("samples")).alias(c)
    return _sides(spark, d).select("pair_id", side("ref"), side("deg"))


def analyze_recordings(spark, d):
    """The whole analysis, base and advanced, of conversations as recordings; result documents beside the columns."""
    return pair.analyse_advanced(_recordings(spark, d)).withColumn("result", pair.result_json()).drop("events")


def feature_map(spark, d):
    """Training rows out of whole analyses, with experts' scores that follow from the conversation's number."""
    results = pair.analyse_advanced(_recordings(spark, d))
    experts = results.select("pair_id", (1 + F.col("pair_id") % 5).alias("visqol_speech_mos"), (6 - F.col("pair_id") % 7).alias("visqol_audio_mos"))
    return pair.feature_rows(results, experts)


def _damaged(spark, d, scenarios):
    """The analysis of conversations' first sides against the same with a scenario's damage; the conversation's number
    deals the scenarios. Dropouts begin at a third of the recording."""
    sides = _recordings(spark, d).select("pair_id", F.col("ref.samples").alias("samples"))
    audio = "struct<sample_rate: int, samples: array<double>>"

    def damage(batches):
        for part in batches:
            names, pairs = [], ([], [])
            for number, samples in zip(part["pair_id"], part["samples"], strict=True):
                family, level, _, steps = scenarios[int(number) % len(scenarios)]
                x = y = np.asarray(samples, float)
                for op, arg, more in steps:
                    y = pair.degrade(y, op, arg, 2000, None if op == "dropout" else more) if len(y) else y
                names.append(f"{family}/{level:g}/{int(number)}")
                for side, z in zip(pairs, (x, y), strict=True):
                    side.append({"sample_rate": 2000, "samples": z})
            yield pd.DataFrame({"pair_id": names, "ref": pairs[0], "deg": pairs[1]})

    return pair.analyse(sides.where("pair_id is not null").mapInPandas(damage, f"pair_id string, ref {audio}, deg {audio}"))


def analyze_pair_synthetic(spark, d):
    """All that an analysis tells, of one damage each, clean material and mixtures."""
    chosen = {"clean/0", "delay/200", "dropout/320", "dropout_count/3", "noise/40", "lowpass/16000", "clipping/0.92", "attenuation/12", "clock_drift/1000", "time_scale/1", "sample_rate/16000", "mixed/2"}
    return _damaged(spark, d, [x for x in pair.scenarios(0) if f"{x[0]}/{x[1]:g}" in chosen])


def scenario_matrix(spark, d):
    """All scenarios and compositions, a family's scores against those of clean recordings."""
    rows = staged(_damaged(spark, d, pair.scenarios()).select(F.split("pair_id", "/")[0].alias("family"), "mos"), "scenarios")
    clean = rows.where("family = 'clean'").agg(F.avg("mos").alias("clean"))
    told = [F.count("*").alias("cases"), r6(F.max(F.abs(F.col("mos") - F.col("clean")))).alias("most"), r6(F.min("mos")).alias("low"), r6(F.max("mos")).alias("high")]
    return rows.join(F.broadcast(clean)).groupBy("family").agg(*told)


def rational_resample(spark, d):
    """Conversations' sides at 147 to 160 of their rate, as from 48 to 44.1 kHz: their lengths, levels before and after."""
    sides = _recordings(spark, d).select("pair_id", F.col("ref.samples").alias("x")).withColumn("y", resampled(F.col("x"), 147, 160))
    level = lambda c: F.when(F.size(c) > 0, r6(F.sqrt(dot(F.col(c), F.col(c)) / F.size(c))))
    return sides.select("pair_id", F.size("x").alias("before"), F.size("y").alias("after"), level("x").alias("rms"), level("y").alias("rms_after"))


QUERIES = {f.__name__: f for f in (advanced_diagnostics, resolution_frames, analyze_recordings, feature_map, analyze_pair_synthetic, scenario_matrix, rational_resample)}

_FRAMES = """t as (
  select conv_id as pair_id, conv_id % 7 - 3 as delay, hex(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'user'), '')) as hu,
    hex(coalesce(string_agg(text, '' order by turn, text) filter (where role <> 'user'), '')) as hv
  from conversations group by conv_id),
sg as (
  select pair_id, delay, list_transform(range(1, len(hu), 2), lambda i: (cast('0x' || hu[i:i + 1] as int) - 128) / 128e0) as r,
    list_transform(range(1, len(hv), 2), lambda i: (cast('0x' || hv[i:i + 1] as int) - 128) / 128e0) as d
  from t where hu <> '' and hv <> ''),
res as (select * from (values ('r20', 20, 10, 32), ('r80', 80, 40, 128), ('r200', 200, 100, 256)) v(kind, frame, hop, size)),
erb as (select 21.4e0 * log10(1 + 0.00437e0 * 50) as lo, 21.4e0 * log10(1 + 0.00437e0 * 480) as hi),
edge as (
  select kind, size, q, (power(10, (lo + (hi - lo) * q / 32) / 21.4e0) - 1) / 0.00437e0 as f0, (power(10, (lo + (hi - lo) * (q + 1) / 32) / 21.4e0) - 1) / 0.00437e0 as f1
  from res, erb, (select unnest(range(32)) as q)),
bin0 as (select kind, q, least(size // 2, cast(floor(f0 * size / 1000) as int)) as k0, cast(ceil(f1 * size / 1000) as int) as up, size from edge),
bin as (select kind, q, k0, greatest(least(size // 2 + 1, up), k0 + 1) as k1 from bin0),
basis as (
  select kind, k, list_transform(range(frame), lambda n: (0.5e0 - 0.5e0 * cos(2 * pi() * n / (frame - 1))) * cos(2 * pi() * k * n / size)) as c,
    list_transform(range(frame), lambda n: (0.5e0 - 0.5e0 * cos(2 * pi() * n / (frame - 1))) * sin(2 * pi() * k * n / size)) as s
  from (select *, unnest(range(size // 2 + 1)) as k from res)),
cut as (
  select *, i * hop as b from (select pair_id, delay, r, d, kind, frame, hop, unnest(range(case when len(r) >= frame then (len(r) - frame) // hop + 1 else 0 end)) as i from sg, res)),
lev as (select pair_id, kind, i, frame, b, delay, len(d) as nd, r[b + 1:b + frame] as x, d[greatest(b + delay, 0) + 1:b + delay + frame] as y from cut),
gate as (select *, sqrt(list_dot_product(x, x) / frame) as level, max(sqrt(list_dot_product(x, x) / frame)) over (partition by pair_id, kind) as top from lev),
act as (select * from gate where b + delay >= 0 and b + delay + frame <= nd and level >= top * 0.035e0),
pw as (
  select pair_id, kind, i, k, power(list_dot_product(x, c), 2) + power(list_dot_product(x, s), 2) as px, power(list_dot_product(y, c), 2) + power(list_dot_product(y, s), 2) as py
  from act join basis using (kind)),
loud as (
  select pair_id, pw.kind, i, q, power(sum(px) / any_value(k1 - k0) + 1e-15, 0.23e0) as a, power(sum(py) / any_value(k1 - k0) + 1e-15, 0.23e0) as b
  from pw join bin on pw.kind = bin.kind and k >= k0 and k < k1 group by all),
unit as (select pair_id, kind, i, q, a / (sum(a) over w + 1e-12) as a, b / (sum(b) over w + 1e-12) as b from loud window w as (partition by pair_id, kind, i)),
fr as (
  select pair_id, kind, i, least(1e0, greatest(0e0, sum(a * b) / sqrt(sum(a * a) * sum(b * b)))) as similarity,
    least(1e0, greatest(0e0, 0.75e0 * sum(greatest(0e0, a - b)) + 1.25e0 * sum(greatest(0e0, b - a)))) as asymmetry,
    least(1e0, abs(regr_slope(ln(a + 1e-12), ln(1 + q)) - regr_slope(ln(b + 1e-12), ln(1 + q))) / 2) as tilt
  from unit group by all)"""

_CLAMPED = "least(1e0, greatest(0e0, {}))"
SQL = {
    "resolution_frames": f"with {_FRAMES} select pair_id, kind, count(*) as frames, round(avg(similarity), 6) as similarity, round(avg(asymmetry), 6) as asymmetry, round(avg(tilt), 6) as tilt from fr group by 1, 2",
    "advanced_diagnostics": f"""with {_FRAMES},
per as (
  select pair_id, kind, avg(similarity) as similarity, avg(asymmetry) as asymmetry, avg(tilt) as tilt, 1 - list_sort(list(similarity))[cast(floor(0.1 * (count(*) - 1)) as int) + 1] as bad
  from fr group by 1, 2),
roll as (
  select pair_id, count(*) as resolutions, max(similarity) filter (where kind = 'r20') as erb, avg(similarity) as multi, avg(asymmetry) as asymmetry, avg(tilt) as tilt, max(bad) as bad
  from per group by 1),
env as (
  select pair_id, i, n, sqrt(list_dot_product(x, x) / 10) as x, case when i * 10 + delay < 0 or i * 10 + delay + 10 > len(d) then 0 else sqrt(list_dot_product(y, y) / 10) end as y
  from (select *, r[i * 10 + 1:i * 10 + 10] as x, case when i * 10 + delay < 0 or i * 10 + delay + 10 > len(d) then r[i * 10 + 1:i * 10 + 10] else d[i * 10 + delay + 1:i * 10 + delay + 10] end as y
    from (select pair_id, r, d, delay, len(r) // 10 as n, unnest(range(len(r) // 10)) as i from sg))),
wave as (
  select pair_id, k, any_value(n) as n, sqrt(power(sum(x * cos(2 * pi() * k * i / n)), 2) + power(sum(x * sin(2 * pi() * k * i / n)), 2)) as x,
    sqrt(power(sum(y * cos(2 * pi() * k * i / n)), 2) + power(sum(y * sin(2 * pi() * k * i / n)), 2)) as y
  from env, (select unnest(range(1, 17)) as k) group by 1, 2),
modulation as (
  select pair_id, case when any_value(n) < 16 or sum(x * x) <= 1e-12 or sum(y * y) <= 1e-12 then 0 else {_CLAMPED.format("sum(x * y) / sqrt(sum(x * x) * sum(y * y))")} end as m
  from wave group by 1),
together as (
  select pair_id, case when count(*) < 2 or var_pop(x) * count(*) <= 1e-12 or var_pop(y) * count(*) <= 1e-12 then 0 else corr(x, y) end as c from env group by 1),
lvl as (
  select pair_id, abs(20 * log10((sqrt(list_dot_product(y, y) / greatest(len(y), 1)) + 1e-9) / (sqrt(list_dot_product(r, r) / len(r)) + 1e-9))) as level
  from (select pair_id, r, d[greatest(delay, 0) + 1:] as y from sg)),
al0 as (select pair_id, r[greatest(-delay, 0) + 1:] as r, d[greatest(delay, 0) + 1:] as d from sg),
al1 as (select pair_id, r[:least(len(r), len(d))] as r, d[:least(len(r), len(d))] as d from al0),
al2 as (select *, list_dot_product(r, d) / list_dot_product(r, r) as gain, len(r) as n from al1 where len(r) >= 500),
al as (select *, list_transform(range(1, n + 1), lambda i: cast(cast(d[i] - gain * r[i] as float) as double)) as e from al2),
ratio as (select pair_id, sqrt(list_dot_product(e, e) / (list_dot_product(d, d) + 1e-12)) as ratio from al),
pts as (select pair_id, n, unnest(range(n)) as i, unnest(r) as r, unnest(e) as e from al),
lag as (select unnest(range(20, 451, 5)) as lag),
met as (
  select a.pair_id, lag, a.i, a.n - lag as m, a.r as x, b.e as y
  from pts a, lag join pts b on b.pair_id = a.pair_id and b.i = a.i + lag where a.n > lag + 16),
q0 as (
  select pair_id, lag, quarter, count(*) as m, case when var_pop(x) * count(*) < 1e-12 or var_pop(y) * count(*) < 1e-12 or count(*) < 16 then 0 else abs(corr(x, y)) end as c
  from (select *, case when i < m * 1 // 4 then 0 when i < m * 2 // 4 then 1 when i < m * 3 // 4 then 2 else 3 end as quarter from met) group by 1, 2, 3),
quarters as (select pair_id, lag, min(c) as steady from q0 where m > 20 group by 1, 2),
echoes as (
  select pair_id, lag, case when var_pop(x) * count(*) < 1e-12 or var_pop(y) * count(*) < 1e-12 or count(*) < 16 then 0 else abs(corr(x, y)) end as c from met group by 1, 2),
best as (select pair_id, max(c) as c, arg_max(lag, c - lag * 1e-15) as lag from echoes group by 1),
echo as (
  select ratio.pair_id, ratio, coalesce({_CLAMPED.format("sqrt(greatest(0e0, c * coalesce(steady, 0))) * least(1e0, ratio * 1.8e0)")}, 0) as echo
  from ratio left join best on best.pair_id = ratio.pair_id left join quarters on quarters.pair_id = best.pair_id and quarters.lag = best.lag),
mi0 as (
  select pair_id, i, sqrt(list_dot_product(x, x) / 5) as er, sqrt(list_dot_product(y, y) / 5) as ed
  from (select pair_id, i, r[i * 5 + 1:i * 5 + 5] as x, d[i * 5 + 1:i * 5 + 5] as y from (select pair_id, r, d, unnest(range(n // 5)) as i from al))),
peak as (select pair_id, max(er) * 0.04e0 as least_ from mi0 group by 1),
mi as (select pair_id, i, ed / (er + 1e-9) as v from mi0 join peak using (pair_id) where er >= least_),
med as (select pair_id, greatest(1e-6, list_sort(list(v))[cast(floor(0.5 * (count(*) - 1)) as int) + 1]) as median from mi group by 1 having count(*) >= 8),
qs as (select pair_id, i, v / median as raw, least(2.5e0, greatest(0e0, v / median)) as q from mi join med using (pair_id)),
steps as (
  select pair_id, {_CLAMPED.format("(0.65e0 - q) / 0.65e0")} as hole, {_CLAMPED.format("abs(q - coalesce(lag(q) over (partition by pair_id order by i), raw)) / 1.2e0")} as v from qs),
chop as (select pair_id, avg(hole) as hole, list_sort(list(v))[cast(floor(0.9 * (count(*) - 1)) as int) + 1] as step from steps group by 1),
fz0 as (
  select pair_id, i, r[i * 20 - 19:i * 20] as r0, r[i * 20 + 1:i * 20 + 20] as r1, d[i * 20 - 19:i * 20] as d0, d[i * 20 + 1:i * 20 + 20] as d1
  from (select pair_id, r, d, unnest(range(1, n // 20)) as i from al)),
fz1 as (
  select pair_id, sqrt(power(list_distance(r0, r1), 2) / (list_dot_product(r0, r0) + list_dot_product(r1, r1) + 1e-12)) as nr,
    sqrt(power(list_distance(d0, d1), 2) / (list_dot_product(d0, d0) + list_dot_product(d1, d1) + 1e-12)) as nd,
    greatest(sqrt(list_dot_product(r0, r0) / 20), sqrt(list_dot_product(r1, r1) / 20)) as act from fz0),
fz as (select pair_id, {_CLAMPED.format("(0.55e0 - nd / (nr + 1e-9)) / 0.55e0")} as v from fz1 join peak using (pair_id) where act >= least_ and nr > 0.08e0),
frozen as (select pair_id, list_sort(list(v))[cast(floor(0.9 * (count(*) - 1)) as int) + 1] as held from fz group by 1)
select pair_id, coalesce(resolutions, 0) as resolutions, round(coalesce(erb, 0), 6) as erb_similarity, round(coalesce(multi, 0), 6) as multi_resolution_similarity,
  round({_CLAMPED.format("(coalesce(together.c, 0) + 1) / 2")}, 6) as temporal_envelope_similarity, round(coalesce(m, 0), 6) as modulation_similarity,
  round(coalesce(asymmetry, 1), 6) as asymmetric_disturbance, round(coalesce(tilt, 1), 6) as spectral_tilt_error, round(level, 6) as active_level_delta_db,
  round(coalesce(bad, 0), 6) as bad_interval_severity, round(coalesce(echo, 0), 6) as echo_score,
  round({_CLAMPED.format("0.46e0 * coalesce(hole, 0) + 0.18e0 * coalesce(step, 0) + 0.36e0 * coalesce(held, 0)")}, 6) as choppiness_score,
  round(coalesce({_CLAMPED.format("ratio - 0.65e0 * echo")}, 0), 6) as residual_intrusion
from sg left join roll using (pair_id) left join together using (pair_id) left join modulation using (pair_id) left join lvl using (pair_id)
  left join echo using (pair_id) left join chop using (pair_id) left join frozen using (pair_id)
""",
}
