"""Queries of the pick operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.operators import picks as P
from tracewell.plans.catalog import GATHER, query, rounded
from tracewell.plans.gather_queries import PROB, RANKED, _prob, _ranked
from tracewell.plans.views import HDR, WAVE, trace_hdr, trace_wave
from tracewell.sources import pickfile

SNAP = "(select *, (trace_idx * 7) % 64 as p from wave)"


def _snap_sql(mode: str, x: str) -> str:
    if mode in ("peak", "trough"):
        inner = f"arg_min(t, (abs(t - p), t)) filter (where t > lo and t < hi and {x}x > {x}pv and {x}x > {x}nx)"
        edge = f"arg_min(t, (abs(t - p), t)) filter (where t between lo and hi and {x}x = {'mx' if mode == 'peak' else '-mn'})"
        return f"case when any_value(p) = 0 then 0 else coalesce({inner}, {edge}) end as {mode}"
    back, ahead = f"max(t) filter (where t <= p and {x}x <= 0)", f"min(t) filter (where t >= p and {x}x >= 0)"
    return f"case when any_value(p) = 0 then 0 else coalesce(case when {x}any_value(xp) > 0 then {back} when {x}any_value(xp) < 0 then {ahead} end, any_value(p)) end as {mode}"


MODES = {"peak": "", "trough": "-", "rising": "", "trailing": "-"}


@query(f"""with {WAVE}, s as (select *, greatest(p - 5, 0) as lo, least(p + 5, 63) as hi from {SNAP}),
w as (select *, lag(x) over g as pv, lead(x) over g as nx, max(case when t between lo and hi then x end) over (partition by trace_idx) as mx, min(case when t between lo and hi then x end) over (partition by trace_idx) as mn, max(case when t = p then x end) over (partition by trace_idx) as xp from s window g as (partition by trace_idx order by t))
select trace_idx, {", ".join(_snap_sql(m, x) for m, x in MODES.items())} from w group by 1""")
def snap_picks(spark, sf_dir):
    at = (F.col("trace_idx") * 7) % 64
    return trace_wave(spark, sf_dir).select("trace_idx", *[P.snap(F.col("samples"), at, m).alias(m) for m in MODES])


@query(f"""with {PROB}, w as (select trace_idx, p, sum(p) over (partition by trace_idx) as s, count(*) over (partition by trace_idx) as n from prob where abs(t - (trace_idx * 7) % 64) <= 5 and (trace_idx * 7) % 64 > 0),
v as (select trace_idx, any_value(n) as n, -sum(p / s * ln(greatest(p / s, 1e-12::double))) as h, list_sort(list(p / s), 'DESC') as d from w group by 1),
c as (select trace_idx, (1 - least(greatest(h / ln(n), 0), 1)) * least(greatest((d[1] - d[2]) / 0.2::double, 0), 1) as c from v)
select vec_id as trace_idx, round(coalesce(c, 0.0), 6) as confidence from embeddings left join c on vec_id = trace_idx""")
def window_confidence(spark, sf_dir):
    return _prob(spark, sf_dir).withColumn("confidence", P.window_confidence(F.col("prob"), (F.col("trace_idx") * 7) % 64, 5, 0.2)).select("trace_idx", rounded("confidence"))


@query(f"with {HDR} select file_id, trace_idx, round(case when fb > 0 then least(greatest(((trace_idx % 20) / 20.0::double - 0.5) / 0.5, 0), 1) * exp(-((abs(chno % 17 - 8) / 8.0::double) ** 2)) else 0 end, 6) as confidence from hdr")
def statics_confidence(spark, sf_dir):
    c = P.statics_confidence(F.col("chno") % 17 - 8, (F.col("trace_idx") % 20) / 20.0, F.col("fb") > 0, 0.5, 8.0)
    return trace_hdr(spark, sf_dir).withColumn("confidence", c).select("file_id", "trace_idx", rounded("confidence"))


TROUGH = f"""{WAVE}, n as (select trace_idx, t, x / max(abs(x)) over (partition by trace_idx) as x, 1 + (trace_idx * 11) % 63 as p from wave),
s as (select *, (coalesce(lag(x) over g, x) + x + coalesce(lead(x) over g, x)) / 3 as v from n window g as (partition by trace_idx order by t)),
l as (select *, lag(v) over g as pv, lead(v) over g as nx from s window g as (partition by trace_idx order by t)),
k as (select trace_idx, any_value(p) as p, min(t) filter (where p < 62 and least(62, p + 12) > p + 1 and t between p + 1 and least(62, p + 12) and pv < v and v >= nx and v >= 0.2) as peak from l group by 1),
m as (select k.trace_idx, k.p, peak, max(t) filter (where t > k.p and t < peak and pv > v and v <= nx) as trough from k join l using (trace_idx) group by 1, 2, 3)"""


@query(f"""with {TROUGH}, r as (select *, case when p >= 62 then 'p_oob' when least(62, p + 12) <= p + 1 then 'scan_empty' when peak is null then 'no_pos_peak' when trough is null then 'no_trough' when trough - p > 6 then 'trough_too_far' else 'shifted' end as reason from m)
select trace_idx, coalesce(peak, -1) as peak_i, coalesce(trough, -1) as trough_i, case when reason = 'shifted' then trough else p end as shifted, reason from r""")
def trough_shift(spark, sf_dir):
    rows = trace_wave(spark, sf_dir).withColumn("p", 1 + (F.col("trace_idx") * 11) % 63)
    return P.trough_shift(rows, "p", "samples", 6, 12, 0.2).select("trace_idx", "peak_i", "trough_i", "shifted", "reason")


MOVED = f"{RANKED}, mv as (select *, case when fb > 0 and chno % 3 > 0 then fb + chno % 7 else fb end as post from ranked), dd as (select *, case when fb > 0 then post - fb else 0 end as d from mv)"


@query(f"""with {MOVED}, c as (select a.file_id, a.ffid, a.trace_idx, a.fb, a.post, a.d, count(b.d) as k, median(b.d) as m, median(b.fb) as mp from dd a left join dd b on a.file_id = b.file_id and a.ffid = b.ffid and abs(a.rank - b.rank) between 1 and 3 and b.d <> 0 group by all)
select file_id, ffid, trace_idx, (case when k >= 2 and ((d = 0 and abs(fb - mp) <= 60) or (d <> 0 and abs(d - m) > 2)) then fb + least(greatest(round_even(m, 0), 0), 5) else post end)::bigint as p_out from c""")
def shift_consensus(spark, sf_dir):
    post = F.when((F.col("fb") > 0) & (F.col("chno") % 3 > 0), F.col("fb") + F.col("chno") % 7).otherwise(F.col("fb"))
    rows = _ranked(spark, sf_dir).withColumn("p_in", F.col("fb")).withColumn("p_post", post)
    return P.consensus(rows, GATHER, "rank", 3, 2, 2, 5, 60).select(*GATHER, "trace_idx", "p_out")


@query(f"""with {RANKED}, a as (select file_id, ffid, rank as row, n, (n - 1) * 0.5::double + (rank - (n - 1) * 0.5::double) / 1.1::double as s from ranked),
b as (select *, least(greatest(s, 0), n - 1) as q from a),
j as (select *, n - 1 - least(greatest(floor(s + 0.5), 0), n - 1)::bigint as near, n - 1 - floor(q)::bigint as lo, n - 1 - least(floor(q) + 1, n - 1)::bigint as hi, q - floor(q) as w from b)
select j.file_id, j.ffid, j.row, (case when round_even(f.fb * 1.05::double, 0) - 20 between 1 and 511 then round_even(f.fb * 1.05::double, 0) - 20 else -1 end)::bigint as fb_view, round((1 - w) * l.offset_m + w * h.offset_m, 6) as offset_view
from j join ranked f on f.file_id = j.file_id and f.ffid = j.ffid and f.rank = near join ranked l on l.file_id = j.file_id and l.ffid = j.ffid and l.rank = lo join ranked h on h.file_id = j.file_id and h.ffid = j.ffid and h.rank = hi""")
def view_projection(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*GATHER)))
    return P.projected(rows, GATHER, True, 1.1, 1.05, 20, 512).select(*GATHER, "row", "fb_view", rounded("offset_view"))


@query(f"""with {RANKED}, v as (select *, fb * ((chno % 4) / 4.0::double) as d, (1 + line % 3) * (chno % 2) as w from ranked),
p as (select a.file_id, a.ffid, a.trace_idx, b.d, b.w, sum(b.w) over (partition by a.file_id, a.ffid, a.trace_idx order by b.d, b.w rows unbounded preceding) as c, sum(b.w) over (partition by a.file_id, a.ffid, a.trace_idx) as s from v a join v b on a.file_id = b.file_id and a.ffid = b.ffid and abs(a.rank - b.rank) <= 3)
select file_id, ffid, trace_idx, round(coalesce(min(d) filter (where s > 0 and c >= 0.5 * s), 0.0), 6) as delta from p group by 1, 2, 3""")
def median_shift_smoothing(spark, sf_dir):
    w = Window.partitionBy(*GATHER).orderBy("rank").rowsBetween(-3, 3)
    pair = F.struct((F.col("fb") * ((F.col("chno") % 4) / 4.0)).alias("v"), ((1 + F.col("line") % 3) * (F.col("chno") % 2)).cast("double").alias("w"))
    rows = _ranked(spark, sf_dir).withColumn("near", F.collect_list(pair).over(w))
    return rows.withColumn("delta", P.weighted_median(F.col("near"))).select(*GATHER, "trace_idx", rounded("delta"))


@query(f"""with {HDR}, c as (select file_id, ffid, chno + 1 as channel, max(fb) as p from hdr group by 1, 2, 3), g as (select distinct file_id, ffid from hdr),
v as (select g.file_id, g.ffid, i.channel, case when coalesce(p, 0) = 0 or round_even(p * 0.4::double, 0) <= 0 then -9999 else round_even(p * 0.4::double, 0)::bigint end as v from g cross join (select unnest(generate_series(1, 200)) as channel) i left join c using (file_id, ffid, channel))
select file_id, ffid as rec, 0 as line_no, '* rec.no.=' || printf('%5d', ffid) as line from g
union all select file_id, ffid, (channel - 1) // 10 + 1, 'fb' || printf('%13d', min(channel)) || printf('%5d', max(channel)) || string_agg(printf('%5d', v), '' order by channel) from v group by 1, 2, 3""")
def pick_file_lines(spark, sf_dir):
    picks = trace_hdr(spark, sf_dir).select("file_id", F.col("ffid").alias("rec"), (F.col("chno") + 1).alias("channel"), F.col("fb").alias("pick"))
    return pickfile.lines(picks, ["file_id"], 0.4, 200).select("file_id", "rec", "line_no", "line")


@query(f"with {HDR} select file_id, trace_idx, case when line % 3 = 0 and fb > 0 then fb + 5 else chno end as by_trace, case when ffid in (2, 5) then fb + 5 else chno end as by_gather, 100 + dense_rank() over (partition by file_id order by ffid) as gather_no from hdr")
def original_picks(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    first = rows.select("file_id", "trace_idx", F.when((F.col("line") % 3 == 0) & (F.col("fb") > 0), F.col("fb") + 5).otherwise(0).alias("orig"), (F.col("fb") + 5).alias("gather_orig"))
    met = rows.join(first, ["file_id", "trace_idx"], "left")
    number = 100 + F.dense_rank().over(Window.partitionBy("file_id").orderBy("ffid"))
    return met.select("file_id", "trace_idx", F.when(F.col("orig") != 0, F.col("orig")).otherwise(F.col("chno")).cast("long").alias("by_trace"), F.when(F.col("ffid").isin(2, 5), F.col("gather_orig")).otherwise(F.col("chno")).alias("by_gather"), number.alias("gather_no"))


@query("select s_suppkey as trace_idx, floor(s_acctbal)::bigint as pick from supplier where s_acctbal >= 0 and s_acctbal * 4 = floor(s_acctbal * 4) and floor(s_acctbal * 4) % 4 = 0")
def picks_from_values(spark, sf_dir):
    from tracewell.plans.views import table

    v = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v == F.floor(v))).select(F.col("s_suppkey").alias("trace_idx"), v.cast("long").alias("pick"))
