"""Queries of composed views and of the named plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import trainsets, views
from tracewell.plans.catalog import query, rounded
from tracewell.plans.label_queries import ROWS, UNIFORM, _rows

SEEN = f"""{ROWS}, g as (select trace_idx, ffid, offset_m, rank as row, n, case when ffid % 3 = 0 then 0.9::double else 1.1::double end as f, ffid % 2 = 1 as flip, (ffid % 5) * 3 as start from rows where t = 0),
s as (select *, (n - 1) * 0.5::double + (row - (n - 1) * 0.5::double) / f as pl from g), q as (select *, greatest(least(pl, n - 1), 0) as q from s),
w as (select *, floor(q)::bigint as lo, least(floor(q)::bigint + 1, n - 1) as hi, q - floor(q) as w, greatest(least(floor(pl + 0.5), n - 1), 0)::bigint as near from q),
v as (select ffid, row, n, w, start, case when flip then n - 1 - lo else lo end as lo, case when flip then n - 1 - hi else hi end as hi, case when flip then n - 1 - near else near end as near from w)"""


def _ops():
    across = F.when(F.col("ffid") % 3 == 0, 0.9).otherwise(1.1)
    return [views.flip(F.col("ffid") % 2 == 1), views.stretch_rows(across)]


@query(f"""with {SEEN}, c as (select *, row % 4 as sh, unnest(generate_series(0, 39)) as t from v)
select c.ffid, c.row, c.t, round(case when c.t < sh then 0 else a.x * (1 - w) + b.x * w end, 6) as y from c
left join rows a on a.ffid = c.ffid and a.rank = c.lo and a.t = c.t - sh + start left join rows b on b.ffid = c.ffid and b.rank = c.hi and b.t = c.t - sh + start""")
def composed_view(spark, sf_dir):
    """Flip, stretch across the gather, cut, shift by row."""
    rows = _rows(spark, sf_dir).select("ffid", "rank", "n", "samples")
    out = views.composed(rows, ["ffid"], [*_ops(), views.cut(F.col("ffid") % 5 * 3, 40)], F.col("rank") % 4)
    out = out.select("ffid", F.col("rank").alias("row"), F.posexplode("samples").alias("t", "y"))
    return out.select("ffid", "row", F.col("t").cast("long").alias("t"), rounded("y"))


@query(f"""with {SEEN}, fv as (select *, case when ffid % 2 = 0 then 1.25::double else 0.8::double end as ft, row % 3 - 1 as sh from v), st as (select *, least(start, case when ffid % 2 = 0 then 32 else 4 end) as cut from fv),
p as (select st.*, (k.trace_idx * 5) % 64 as fb, (1 - w) * l.offset_m + w * h.offset_m as off from st join g k on k.ffid = st.ffid and k.row = near join g l on l.ffid = st.ffid and l.row = lo join g h on h.ffid = st.ffid and h.row = hi),
z as (select *, round_even(fb * ft, 0)::bigint - cut + sh as pv from p)
select ffid, row, case when fb > 0 and pv between 1 and 47 then pv else -1 end as fb_view, round(off, 6) as offset_view, round(0.5 + cut * 0.004::double / ft, 6) as t_first, round(0.5 + (47 + cut) * 0.004::double / ft, 6) as t_last,
 (case when fb > 0 and pv between 1 and 47 then round_even((pv - sh + cut) / ft, 0) else 0 end)::bigint as fb_back from z""")
def composed_picks(spark, sf_dir):
    """Picks, offsets and time under flip, both stretches, cut and shift; and picks brought back."""
    rows = _rows(spark, sf_dir).withColumn("fb", F.col("trace_idx") * 5 % 64)
    ops = [*_ops(), views.stretch_time([1.25, 0.8], F.col("ffid") % 2), views.cut(F.col("ffid") % 5 * 3, 48)]
    seen = views.composed(rows.select("ffid", "rank", "n", "samples"), ["ffid"], ops, F.col("rank") % 3 - 1)
    out = views.projected(rows, seen, ["ffid"], 48).join(seen.select("ffid", F.col("rank").alias("row"), "view", "tshift"), ["ffid", "row"])
    t = views.times(F.col("view"), 48, 0.5, 0.004)
    back = views.raw_pick(F.col("fb_view"), F.col("view"), F.col("tshift"))
    return out.select("ffid", "row", "fb_view", rounded("offset_view"), F.round(F.element_at(t, 1), 6).alias("t_first"), F.round(F.element_at(t, -1), 6).alias("t_last"), back.alias("fb_back"))


def _channels(rows, *keys):
    """keys, channel, t, y of the inputs, with the first target as target."""
    each = rows.select(*keys, "target", F.posexplode("input").alias("channel", "_c"))
    each = each.select(*keys, "channel", F.posexplode(F.arrays_zip("_c", F.get("target", F.lit(0)).alias("_y"))).alias("t", "e"))
    return each.select(*keys, F.col("channel").cast("long").alias("channel"), F.col("t").cast("long").alias("t"), F.round("e._c", 6).alias("y"), F.round("e._y", 6).alias("target"))


@query(f"""with {ROWS}, m as (select trace_idx, ffid, rank, n, offset_m, row_number() over (partition by ffid order by md5('7:' || rank), rank) <= least(greatest(round_even(0.4::double * n, 0), 1), n) and round_even(0.4::double * n, 0) > 0 as masked from rows where t = 0),
z as (select ffid, avg(offset_m) filter (where trace_idx % 9 > 0) as am, stddev_pop(offset_m) filter (where trace_idx % 9 > 0) as sm from m group by 1),
c as (select m.*, am, sm, t, x, 0.5 * sqrt(-2 * ln(greatest({UNIFORM.format("'7a:' || trace_idx || ':' || t")}, pow(2.0::double, -32)))) * cos(2 * pi() * {UNIFORM.format("'7b:' || trace_idx || ':' || t")}) as e from m join z using (ffid) join (select trace_idx, t, x from rows) using (trace_idx))
select trace_idx, 0 as channel, t, round(case when masked then e else x end, 6) as y, round(x, 6) as target from c
union all select trace_idx, 1, t, round(case when trace_idx % 9 > 0 then (offset_m - am) / (sm + 1e-6::double) else 0 end, 6), round(x, 6) from c
union all select trace_idx, 2, t, round(t * 0.004::double, 6), round(x, 6) from c""")
def masked_plan(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("trace_valid", F.col("trace_idx") % 9 > 0)
    return _channels(trainsets.masked(rows, ["ffid"], 0.4, "7", 0.5, offset=True, dt=0.004), "trace_idx")


@query(f"""with {ROWS}, k as (select trace_idx, t, x, case when t < 60 then x else 0 end as cutx, exp(-0.5::double * ((t - (trace_idx * 5) % 60) / 1.5::double) ** 2) as p, case when trace_idx % 3 > 0 then exp(-0.5::double * ((t - (trace_idx * 5) % 60 - 6) / 1.5::double) ** 2) else 0 end as s from rows where t < 60)
select trace_idx, 0 as channel, t, round(cutx, 6) as y, round(p / (p + s + greatest(1 - p - s, 0)), 6) as target from k""")
def phase_plan(spark, sf_dir):
    i, none = F.col("trace_idx"), F.expr("cast(array() as array<bigint>)")
    rows = _rows(spark, sf_dir).withColumn("pp", F.array(i * 5 % 60)).withColumn("sp", F.when(i % 3 > 0, F.array(i * 5 % 60 + 6)).otherwise(none))
    return _channels(trainsets.phases(rows, "pp", "sp", 60, 1.5), "trace_idx")


@query(f"""with {ROWS}, b as (select ffid, rank, t, x from rows), p as (select a.trace_idx, a.t, a.x, b.x as z from rows a join b on b.ffid = a.ffid and b.t = a.t and b.rank = a.n - 1 - a.rank), s as (select trace_idx, avg(x) as m, stddev_pop(x) as d from rows group by 1)
select trace_idx, 0 as channel, t, round((x - m) / (d + 1e-6::double), 6) as y, round((z - m) / (d + 1e-6::double), 6) as target from p join s using (trace_idx)""")
def pair_plan(spark, sf_dir):
    """Each trace with the one at the mirrored place of its gather."""
    rows = _rows(spark, sf_dir)
    mirrored = rows.select("ffid", (F.col("n") - 1 - F.col("rank")).alias("rank"), "samples")
    return _channels(trainsets.pairs(rows, mirrored, ["ffid", "rank"]), "trace_idx")
