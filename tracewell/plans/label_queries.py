"""Queries of labels, masks, channels, mixes and spectra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions import spectrum
from tracewell.functions.signal import total
from tracewell.operators import labels as M
from tracewell.plans.catalog import GATHER, query, rounded
from tracewell.plans.gather_queries import RANKED, _ranked
from tracewell.plans.views import HDR, WAVE, trace_hdr, trace_wave

ROWS = f"{WAVE}, rk as (select vec_id as trace_idx, row_number() over (partition by label order by vec_id) - 1 as rank, count(*) over (partition by label) as n from embeddings), rows as (select wave.*, rank, n from wave join rk using (trace_idx))"
UNIFORM = "('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0::double"


def _rows(spark, sf_dir):
    w = Window.partitionBy("ffid")
    return trace_wave(spark, sf_dir).withColumn("rank", (F.row_number().over(w.orderBy("trace_idx")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))


def _long(rows, column, *keys):
    out = rows.select(*keys, F.posexplode(column).alias("t", "y"))
    return out.select(*keys, F.col("t").cast("long").alias("t"), rounded("y"))


@query(f"""with {WAVE}, g as (select trace_idx, t, exp(-0.5::double * ((t - (trace_idx * 5) % 64) / 1.5::double) ** 2) as a, exp(-0.5::double * ((t - (trace_idx * 3) % 64) / 1.5::double) ** 2) as b, exp(-0.5::double * ((t - (trace_idx * 5) % 64 - 6) / 1.5::double) ** 2) as c from wave),
m as (select trace_idx, t, case when trace_idx % 4 > 0 then 1 - (1 - a) * (1 - b) else 0 end as p, case when trace_idx % 3 > 0 then c else 0 end as s from g)
select trace_idx, t, round(p / (p + s + greatest(1 - p - s, 0)), 6) as p, round(s / (p + s + greatest(1 - p - s, 0)), 6) as s, round(greatest(1 - p - s, 0) / (p + s + greatest(1 - p - s, 0)), 6) as noise, trace_idx % 4 > 0 or trace_idx % 3 > 0 as label_valid from m""")
def phase_map(spark, sf_dir):
    i, none = F.col("trace_idx"), F.expr("cast(array() as array<bigint>)")
    picks = trace_wave(spark, sf_dir).select("trace_idx", F.when(i % 4 > 0, F.array((i * 5) % 64, (i * 3) % 64)).otherwise(none).alias("pp"), F.when(i % 3 > 0, F.array((i * 5) % 64 + 6)).otherwise(none).alias("sp"))
    out = M.phase_map(picks, "pp", "sp", 64, 1.5)
    out = out.select("trace_idx", "label_valid", F.posexplode(F.arrays_zip("p", "s", "noise")).alias("t", "e"))
    return out.select("trace_idx", F.col("t").cast("long").alias("t"), *[F.round(f"e.{c}", 6).alias(c) for c in ("p", "s", "noise")], "label_valid")


@query(f"""with {RANKED}, o as (select file_id, ffid, rank, n, row_number() over (partition by file_id, ffid order by md5('5:' || rank), rank) <= least(greatest(ceil(round_even(0.3::double * n, 0) / 3), 1), n) as c from ranked),
b as (select distinct file_id, ffid, unnest(generate_series(greatest(least(rank - 1, n - 3), 0), greatest(least(rank - 1, n - 3), 0) + 2)) as rank from o where c and round_even(0.3::double * n, 0) > 0)
select r.file_id, r.ffid, r.trace_idx, b.rank is not null or round_even(0.3::double * n, 0) >= n or (3 >= n and round_even(0.3::double * n, 0) > 0) as masked from ranked r left join b on r.file_id = b.file_id and r.ffid = b.ffid and r.rank = b.rank""")
def trace_mask(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*GATHER)))
    return M.trace_mask(rows, GATHER, 0.3, 3, "5").select(*GATHER, "trace_idx", "masked")


def _u(kind: str) -> str:
    return UNIFORM.format(f"'9{kind}:' || ffid || ':' || gh || ':' || gt")


CHECKER = f"""{ROWS}, g as (select label as ffid, count(*) as n from embeddings group by 1), ch as (select ffid, n, unnest(generate_series(0, ceil(n / 6)::bigint)) as gh from g), ct as (select *, unnest(generate_series(0, 8)) as gt from ch),
sp as (select ffid, greatest(least(gh * 6 + floor({_u("h")} * 3)::bigint - 1, n - 3), 0) as h0, greatest(least(gt * 8 + floor({_u("t")} * 5)::bigint - 2, 60), 0) as t0 from ct where {_u("k")} <= 0.7),
mk as (select r.trace_idx, r.t, r.x, exists (select 1 from sp where sp.ffid = r.ffid and r.rank between h0 and h0 + 2 and r.t between t0 and t0 + 3) as m from rows r)"""


@query(f"with {CHECKER} select trace_idx, sum(m::bigint)::bigint as masked, round(sum(case when m then t else 0 end * 1.0), 6) as moment from mk group by 1")
def checker_mask(spark, sf_dir):
    rows = M.checker_mask(_rows(spark, sf_dir), ["ffid"], 64, (3, 4), (6, 8), (1, 2), 0.7, "9")
    on = F.filter(F.transform("mask", lambda m, t: F.when(m, t)), lambda t: t.isNotNull())
    return rows.select("trace_idx", F.size(on).cast("long").alias("masked"), total(F.transform(on, lambda t: t.cast("double"))).alias("moment"))


@query(f"""with {CHECKER} select trace_idx, t, round(case when m then 0.5 * sqrt(-2 * ln(greatest({UNIFORM.format("'4a:' || trace_idx || ':' || t")}, pow(2.0::double, -32)))) * cos(2 * pi() * {UNIFORM.format("'4b:' || trace_idx || ':' || t")}) else x end, 6) as y from mk""")
def masked_noise(spark, sf_dir):
    rows = M.checker_mask(_rows(spark, sf_dir), ["ffid"], 64, (3, 4), (6, 8), (1, 2), 0.7, "9")
    return _long(rows.withColumn("y", M.with_noise(F.col("samples"), F.col("mask"), F.col("trace_idx"), 0.5, "4")), "y", "trace_idx")


@query(f"""with {WAVE}, c as (select vec_id as trace_idx, round_even((vec_id * 13) % 70 - 2 + 0.5, 0)::bigint - 8 as start, (vec_id * 13) % 70 - 2 + 0.5 > 0 as ok from embeddings), q as (select *, unnest(generate_series(0, 31)) as q from c)
select q.trace_idx, q.q as t, round(case when not ok or q.q = 31 then 0 else coalesce(a.x, 0) * (1 - (q.q % 2) / 2.0::double) + coalesce(b.x, 0) * ((q.q % 2) / 2.0::double) end, 6) as y
from q left join wave a on a.trace_idx = q.trace_idx and a.t = start + q.q // 2 left join wave b on b.trace_idx = q.trace_idx and b.t = start + q.q // 2 + 1""")
def centre_window(spark, sf_dir):
    rows = trace_wave(spark, sf_dir).withColumn("c", (F.col("trace_idx") * 13) % 70 - 2 + 0.5)
    return _long(rows.withColumn("y", M.centre_window(F.col("samples"), F.col("c"), 8, 2)), "y", "trace_idx")


@query(f"with {HDR}, w as (select file_id, ffid, avg(offset_m) as m, stddev_pop(offset_m) as s from hdr where fb > 0 group by 1, 2) select h.file_id, h.trace_idx, round(case when fb > 0 then (offset_m - m) / (s + 1e-6) else 0 end, 6) as channel from hdr h left join w using (file_id, ffid)")
def offset_channel(spark, sf_dir):
    return trace_hdr(spark, sf_dir).withColumn("channel", M.offset_channel(GATHER, "offset_m", F.col("fb") > 0)).select("file_id", "trace_idx", rounded("channel"))


@query(f"""with {ROWS}, e as (select trace_idx, sqrt(avg(x * x)) as r from wave group by 1), p as (select a.trace_idx, a.t, a.x, b.x as z, b.trace_idx as other from rows a join rows b on a.ffid = b.ffid and a.t = b.t and b.rank = (a.rank + 1) % a.n)
select p.trace_idx, t, round(x + z * (case when f.r > 0 then e.r / f.r * pow(10::double, -((p.trace_idx % 13) / 20.0::double)) else 0 end), 6) as y from p join e on e.trace_idx = p.trace_idx join e f on f.trace_idx = other""")
def noise_at_ratio(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    other = rows.select("ffid", F.col("rank").alias("next"), F.col("samples").alias("noise"))
    met = rows.withColumn("next", (F.col("rank") + 1) % F.col("n")).join(other, ["ffid", "next"])
    return _long(met.withColumn("y", M.mixed(F.col("samples"), F.col("noise"), F.col("trace_idx") % 13)), "y", "trace_idx")


@query(f"""with {ROWS}, s as (select trace_idx, ffid, rank, t, n, greatest(least((n - 1) * 0.5::double + (rank - (n - 1) * 0.5::double) / 0.93::double, n - 1), 0) as q from rows)
select s.trace_idx, s.t, round(a.x * (1 - (q - floor(q))) + b.x * (q - floor(q)), 6) as y from s join rows a on a.ffid = s.ffid and a.t = s.t and a.rank = floor(q)::bigint join rows b on b.ffid = s.ffid and b.t = s.t and b.rank = least(floor(q)::bigint + 1, s.n - 1)""")
def spatial_stretch(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    out = M.stretched(rows, ["ffid"], 0.93).join(rows.select("ffid", "rank", "trace_idx"), ["ffid", "rank"])
    return _long(out, "samples", "trace_idx")


@query(f"""with {ROWS}, f as (select trace_idx, rank, n, t, x, {UNIFORM.format("'3:' || trace_idx")} as u from rows) select f.trace_idx, f.t, round(-coalesce(g.x, 0), 6) as y, n - 1 - f.rank as flipped_row from f left join wave g on g.trace_idx = f.trace_idx and g.t = f.t - (case when u < 0.25 then 1 + (f.trace_idx % 4) else 0 end)""")
def flips_and_shifts(spark, sf_dir):
    from tracewell.functions.signal import shifted
    from tracewell.operators.gathers import uniform

    by = F.when(uniform(F.lit("3"), F.col("trace_idx")) < 0.25, 1 + F.col("trace_idx") % 4).otherwise(0)
    rows = _rows(spark, sf_dir).withColumn("y", F.transform(shifted(F.col("samples"), by.cast("double")), lambda v: -v)).withColumn("flipped_row", F.col("n") - 1 - F.col("rank"))
    return _long(rows, "y", "trace_idx", "flipped_row")


DFT = f"{WAVE}, k as (select unnest(generate_series(0, 32)) as k), dft as (select trace_idx, any_value(ffid) as ffid, k, sum(x * cos(2 * pi() * k * t / 64)) as a, sum(x * sin(2 * pi() * k * t / 64)) as b from wave, k group by trace_idx, k)"


@query(f"""with {DFT}, h as (select trace_idx, t, sum(2.0::double / 64 * (a * sin(2 * pi() * k * t / 64) - b * cos(2 * pi() * k * t / 64))) as h from dft, (select unnest(generate_series(0, 63)) as t) where k between 1 and 31 group by 1, 2)
select trace_idx, t, round(sqrt(x * x + h * h), 6) as y from wave join h using (trace_idx, t)""")
def envelope(spark, sf_dir):
    return _long(trace_wave(spark, sf_dir).withColumn("y", spectrum.envelope(F.col("samples"))), "y", "trace_idx")


@query(f"""with {DFT}, g as (select *, (case when k in (0, 32) then 1 else 2 end) / 64.0::double * (0.5 - 0.5 * cos(pi() * least(greatest((k / 32.0::double - 0.08) / 0.04, 0), 1))) * (0.5 + 0.5 * cos(pi() * least(greatest((k / 32.0::double - 0.38) / 0.04, 0), 1))) as g from dft)
select trace_idx, t, round(sum(g * (a * cos(2 * pi() * k * t / 64) + b * sin(2 * pi() * k * t / 64))), 6) as y from g, (select unnest(generate_series(0, 63)) as t) group by 1, 2""")
def frequency_filter(spark, sf_dir):
    return _long(trace_wave(spark, sf_dir).withColumn("y", spectrum.filtered(F.col("samples"), 0.1, 0.4, 0.02)), "y", "trace_idx")


@query(f"""with {DFT}, m as (select trace_idx, ffid, k, ln(sqrt(a * a + b * b) + 1e-6) as m from dft where k between 2 and 20), r as (select vec_id as trace_idx, row_number() over (partition by label order by vec_id) - 1 as rank from embeddings),
q as (select m.*, rank from m join r using (trace_idx)), p as (select a.trace_idx, a.ffid, avg((a.m - b.m) ** 2) as e from q a join q b on a.ffid = b.ffid and a.k = b.k and b.rank = a.rank + 1 group by 1, 2) select ffid, round(avg(e), 6) as error from p group by 1""")
def spectral_error(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("ffid", "rank", F.transform(F.slice(spectrum.magnitude(F.col("samples")), 3, 19), lambda v: F.log(v + 1e-6)).alias("m"))
    met = rows.join(rows.select("ffid", (F.col("rank") - 1).alias("rank"), F.col("m").alias("o")), ["ffid", "rank"])
    e = total(F.zip_with("m", "o", lambda a, b: (a - b) * (a - b))) / F.size("m")
    return met.groupBy("ffid").agg(F.round(F.avg(e), 6).alias("error"))
