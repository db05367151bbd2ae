"""Queries of phase lists, common lengths, shared scaling, draws, scoring, error reports and global trends."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tracewell.operators import draws as D
from tracewell.operators import gathers as A
from tracewell.operators import phases as H
from tracewell.operators import sections as S
from tracewell.operators import trend as T
from tracewell.plans.catalog import GATHER, query, rounded
from tracewell.plans.gather_queries import RANKED, WINDOWS, _ranked, gate_windows
from tracewell.plans.label_queries import ROWS, _long, _rows
from tracewell.plans.views import HDR, WAVE, trace_hdr, trace_wave

PICKS = f"{HDR}, pk as (select file_id, trace_idx, 'P' as phase, fb as pick from hdr where fb > 0 union all select file_id, trace_idx, 'S', fb + line * 15 from hdr where fb > 0 and line > 2 union all select file_id, trace_idx, 'P', fb + 40 from hdr where fb > 0 and chno % 5 = 0)"


def _picks(spark, sf_dir):
    """Long picks: P at fb (twice for some channels), S behind it for later lines."""
    rows = trace_hdr(spark, sf_dir).where("fb > 0")
    every = F.array(
        F.struct(F.lit("P").alias("phase"), F.col("fb").alias("pick"), F.lit(True).alias("on")),
        F.struct(F.lit("S").alias("phase"), (F.col("fb") + F.col("line") * 15).alias("pick"), (F.col("line") > 2).alias("on")),
        F.struct(F.lit("P").alias("phase"), (F.col("fb") + 40).alias("pick"), (F.col("chno") % 5 == 0).alias("on")),
    )
    return rows.select("file_id", "trace_idx", F.explode(F.filter(every, lambda x: x["on"])).alias("x")).select("file_id", "trace_idx", "x.phase", "x.pick")


@query(f"with {PICKS} select h.file_id, h.trace_idx, coalesce(string_agg(cast(pick as varchar), ',' order by pick) filter (where phase = 'P'), '') as p_picks, coalesce(string_agg(cast(pick as varchar), ',' order by pick) filter (where phase = 'S'), '') as s_picks from hdr h left join pk using (file_id, trace_idx) group by 1, 2")
def traces_with_picks(spark, sf_dir):
    rows = H.with_picks(trace_hdr(spark, sf_dir).select("file_id", "trace_idx"), _picks(spark, sf_dir), ["file_id", "trace_idx"])
    return rows.select("file_id", "trace_idx", *[F.array_join(c, ",").alias(c) for c in ("p_picks", "s_picks")])


@query(f"with {PICKS}, c as (select h.file_id, h.trace_idx, count(pick) filter (where phase = 'P') as n from hdr h left join pk using (file_id, trace_idx) group by 1, 2), r as (select file_id, sum(n) over (partition by file_id order by trace_idx) as z from c) select r.file_id, '0,' || string_agg(cast(z::bigint as varchar), ',' order by z) as indptr, (select count(*) from pk where pk.file_id = r.file_id and phase = 'P') as nnz, 0::bigint as faults from r group by 1")
def csr_lists(spark, sf_dir):
    csr = H.picks_to_csr(trace_hdr(spark, sf_dir), _picks(spark, sf_dir).where("phase = 'P'"), ["file_id"])
    csr = csr.withColumn("faults", F.size(H.csr_faults(F.col("indptr"), F.col("data"))).cast("long"))
    return csr.select("file_id", F.array_join(F.col("indptr"), ",").alias("indptr"), F.size("data").cast("long").alias("nnz"), "faults")


@query(f"with {PICKS} select file_id, trace_idx, phase, count(*) as n, sum(pick)::bigint as picks from pk group by 1, 2, 3")
def csr_round_trip(spark, sf_dir):
    traces, picks = trace_hdr(spark, sf_dir), _picks(spark, sf_dir)
    lists = [H.csr_to_picks(H.picks_to_csr(traces, picks.where(F.col("phase") == p), ["file_id"]), ["file_id"], "indptr", "data", p) for p in ("P", "S")]
    return lists[0].unionByName(lists[1]).groupBy("file_id", "trace_idx", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("pick").alias("picks"))


@query(f"with {HDR} select file_id, count(*) as n_traces, count(case when fb > 0 then 1 end) as n_breaks, count(case when fb = 0 then 1 end) as unmatched from hdr group by 1 having count(case when fb = 0 then 1 end) > 0")
def unmatched_first_breaks(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    return H.unmatched(rows, rows.where("fb > 0"), ["file_id", "trace_idx"], ["file_id"])


@query(f"with {HDR} select file_id, trace_idx, fb, offset_m from hdr")
def first_breaks_joined(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    return H.with_first_breaks(rows.select("file_id", "trace_idx", "offset_m"), rows.select("file_id", "trace_idx", "fb"), ["file_id", "trace_idx"])


@query(f"with {WINDOWS}, f as (select *, case when fb < 60 then fb else 0 end as p, case when fb > 0 and fb < 45 and line > 5 then fb + 9 else 0 end as s from win), k as (select *, max(greatest(p, s)) over (partition by file_id, ffid, start) as m from f) select file_id, ffid, start, count(*) as traces, sum(p)::bigint as p, sum(s)::bigint as s from k where m > 0 group by 1, 2, 3")
def gathers_with_picks(spark, sf_dir):
    rows = A.trace_windows(_ranked(spark, sf_dir), GATHER, 16, 8)
    p = F.when(F.col("fb") < 60, F.col("fb")).otherwise(0)
    s = F.when((F.col("fb") > 0) & (F.col("fb") < 45) & (F.col("line") > 5), F.col("fb") + 9).otherwise(0)
    kept = H.with_a_pick(rows.withColumn("p", p).withColumn("s", s), [*GATHER, "start"], "p", "s")
    return kept.groupBy(*GATHER, "start").agg(F.count(F.lit(1)).alias("traces"), F.sum("p").alias("p"), F.sum("s").alias("s"))


@query(f"with {PICKS}, v as (select file_id, trace_idx, cast(round_even(pick * 1.05::double, 0) as bigint) - 20 + trace_idx % 7 - 3 as v from pk where phase = 'P') select h.file_id, h.trace_idx, coalesce(string_agg(cast(v as varchar), ',' order by v) filter (where v > 0 and v < 384), '') as picks from hdr h left join v using (file_id, trace_idx) group by 1, 2")
def pick_list_projection(spark, sf_dir):
    rows = H.with_picks(trace_hdr(spark, sf_dir).select("file_id", "trace_idx"), _picks(spark, sf_dir), ["file_id", "trace_idx"])
    moved = H.project_picks(F.col("p_picks"), 1.05, 20, 384, F.col("trace_idx") % 7 - 3)
    return rows.select("file_id", "trace_idx", F.array_join(moved, ",").alias("picks"))


@query(f"""with {WAVE}, s as (select trace_idx, t, x, 40 + trace_idx % 24 as w from wave where t < 40 + trace_idx % 24), g as (select trace_idx, 40 + trace_idx % 24 as w, unnest(generate_series(0, 47)) as t from (select distinct trace_idx from wave))
select g.trace_idx, g.t, round(coalesce(x, 0.0), 6) as y from g left join s on s.trace_idx = g.trace_idx and s.t = g.t + (case when g.w > 48 then (g.w - 48) // 2 else 0 end)""")
def crop_or_pad(spark, sf_dir):
    rows = trace_wave(spark, sf_dir).withColumn("samples", F.slice("samples", F.lit(1), (40 + F.col("trace_idx") % 24).cast("int")))
    return _long(rows.withColumn("y", S.crop_or_pad(F.col("samples"), 48)), "y", "trace_idx")


@query(f"with {WAVE}, g as (select trace_idx, 40 + trace_idx % 24 as w, unnest(generate_series(0, 39 + (select max(trace_idx % 24) from wave))) as t from (select distinct trace_idx from wave)) select g.trace_idx, g.t, round(case when g.t < w then x else 0.0 end, 6) as y from g left join wave using (trace_idx, t)")
def collate_right(spark, sf_dir):
    rows = trace_wave(spark, sf_dir).withColumn("samples", F.slice("samples", F.lit(1), (40 + F.col("trace_idx") % 24).cast("int")))
    width = rows.agg(F.max(F.size("samples")).alias("w"))
    return _long(rows.crossJoin(F.broadcast(width)).withColumn("y", S.pad_right(F.col("samples"), F.col("w"))), "y", "trace_idx")  # one row of width


PAIR = f"{WAVE}, st as (select trace_idx, avg(x) as m, stddev_pop(x) as s from wave group by 1), pr as (select a.trace_idx, a.t, a.x, b.x as y, m, s from wave a join wave b on b.trace_idx = a.trace_idx + 1 and b.t = a.t join st on st.trace_idx = a.trace_idx)"


def _pairs(spark, sf_dir):
    a = trace_wave(spark, sf_dir).select("trace_idx", "samples")
    b = a.select((F.col("trace_idx") - 1).alias("trace_idx"), F.col("samples").alias("target"))
    return a.join(b, "trace_idx").withColumn("p", S.pair_standardized(F.col("samples"), F.col("target")))


@query(f"with {PAIR} select trace_idx, t, round((y - m) / (s + 1e-6::double), 6) as y from pr")
def pair_standardize(spark, sf_dir):
    return _long(_pairs(spark, sf_dir).withColumn("y", F.col("p.y")), "y", "trace_idx")


@query(f"with {PAIR} select trace_idx, t, round(x + ((y - m) / (s + 1e-6::double) * 0.5::double) * (s + 1e-6::double) + m, 6) as y from pr")
def residual_denormalised(spark, sf_dir):
    rows = _pairs(spark, sf_dir)
    guess = F.transform("p.y", lambda v: v * 0.5)
    return _long(rows.withColumn("y", S.with_residual(F.col("samples"), S.unscaled(guess, F.col("p.mean"), F.col("p.std")))), "y", "trace_idx")


@query(f"with {WAVE}, o as (select trace_idx, offset_m from wave where t = 0) select trace_idx, 3::bigint as channels, round(sum(x), 6) as x, round(sum(t * 0.004::double), 6) as time, round(max(offset_m) * 64.0::double, 6) as offset from wave group by 1")
def channel_stack(spark, sf_dir):
    time = F.transform("samples", lambda v, t: t * F.lit(0.004))
    offset = F.transform("samples", lambda v: F.col("offset_m").cast("double"))
    rows = trace_wave(spark, sf_dir).withColumn("c", S.stacked(F.col("samples"), time, offset))
    sums = [F.round(F.aggregate(F.get("c", F.lit(k)), F.lit(0.0), lambda s, v: s + v), 6).alias(n) for k, n in enumerate(("x", "time", "offset"))]
    return rows.select("trace_idx", F.size("c").cast("long").alias("channels"), *sums)


UP, DOWN, TAPS = S.resampling(1.1)
STRETCHED = f"{WAVE}, h as (select unnest({TAPS}::double[]) as h, unnest(generate_series(0, {len(TAPS) - 1})) as i), g as (select trace_idx, unnest(generate_series(0, {-(-64 * UP // DOWN) - 1})) as n from (select distinct trace_idx from wave))"


@query(f"with {STRETCHED} select g.trace_idx, n as t, round(coalesce(sum(x * h), 0.0), 6) as y from g left join (wave w join h on true) on w.trace_idx = g.trace_idx and i = n * {DOWN} + {len(TAPS) // 2} - w.t * {UP} group by 1, 2")
def time_stretch(spark, sf_dir):
    return _long(trace_wave(spark, sf_dir).withColumn("y", S.time_stretched(F.col("samples"), 1.1)), "y", "trace_idx")


AGC = f"""{WAVE}, an as (select distinct trace_idx, a from (select distinct trace_idx from wave), (select unnest([0, 20, 40, 60, 63]) as a)), p as (select an.trace_idx, a, x, median(x) over (partition by an.trace_idx, a) as m from an join wave w on w.trace_idx = an.trace_idx and t between a - 12 and a + 12),
sc as (select trace_idx, a, any_value(m) as m, median(abs(x - m)) * 1.4826::double + 1e-8::double as s from p group by 1, 2), k as (select w.trace_idx, t, x, least(t // 20 * 20, 60) as lo, case when t // 20 * 20 + 20 > 63 then 63 else t // 20 * 20 + 20 end as hi from wave w)"""


@query(f"with {AGC} select k.trace_idx, t, round((x - (l.m * (1 - (t - lo) / (hi - lo)::double) + h.m * ((t - lo) / (hi - lo)::double))) / pow(l.s * (1 - (t - lo) / (hi - lo)::double) + h.s * ((t - lo) / (hi - lo)::double), 0.75::double), 6) as y from k join sc l on l.trace_idx = k.trace_idx and l.a = lo join sc h on h.trace_idx = k.trace_idx and h.a = hi")
def robust_gain(spark, sf_dir):
    rows = trace_wave(spark, sf_dir).withColumn("y", S.robust_agc(F.col("samples"), 12, 20, 0.75))
    return _long(rows, "y", "trace_idx")


def _neighbour_mean(x: np.ndarray) -> np.ndarray:
    padded = np.pad(x, ((1, 1), (0, 0)))
    return (padded[:-2] + padded[1:-1] + padded[2:]) / 3


@query(f"with {ROWS}, y as (select trace_idx, t, (coalesce(lag(x) over w, 0) + x + coalesce(lead(x) over w, 0)) / 3 as y from rows window w as (partition by ffid, t order by rank)) select trace_idx, round(sum(y), 5) as total, round(sum(y * t), 4) as moment from y group by 1")
def gather_scores(spark, sf_dir):
    found = S.score_gathers(_rows(spark, sf_dir), ["ffid"], "rank", "samples", _neighbour_mean)
    moment = F.aggregate(F.transform("score", lambda v, t: v * t), F.lit(0.0), lambda s, v: s + v)
    return found.select("trace_idx", F.round(F.aggregate("score", F.lit(0.0), lambda s, v: s + v), 5).alias("total"), F.round(moment, 4).alias("moment"))


@query(f"with {WAVE} select trace_idx, round(sum(x * x - t), 5) as total from wave group by 1")
def window_scores(spark, sf_dir):
    found = S.score_windows(trace_wave(spark, sf_dir).select("trace_idx", "samples"), "samples", lambda x: x * x - np.arange(x.shape[1]))
    return found.select("trace_idx", F.round(F.aggregate("score", F.lit(0.0), lambda s, v: s + v), 5).alias("total"))


SECTION = f"""{ROWS}, ss as (select trace_idx, avg(x) as m, stddev_pop(x) as s from wave group by 1), z as (select r.trace_idx, r.ffid, rank, t, (x - m) / (s + 1e-6::double) as z from rows r join ss using (trace_idx)),
y as (select trace_idx, t, (coalesce(lag(z) over w, 0) + z + coalesce(lead(z) over w, 0)) / 3 as y from z window w as (partition by ffid, t order by rank)), e as (select trace_idx, t, exp(y - max(y) over (partition by trace_idx)) as e from y)"""


@query(f"with {SECTION} select trace_idx, t, round(e / sum(e) over (partition by trace_idx), 6) as y from e")
def section_probability(spark, sf_dir):
    found = S.section_probability(_rows(spark, sf_dir), ["ffid"], "rank", "samples", (80, 96), _neighbour_mean)
    return _long(found, "prob", "trace_idx")


@query(f"with {ROWS}, g as (select ffid, count(distinct trace_idx) as n from rows group by 1) select ffid, greatest(n, 80)::bigint as traces, 96::bigint as width, n as real from g")
def pad_to_tile(spark, sf_dir):
    made = S.padded_section(_rows(spark, sf_dir).select("ffid", "rank", "trace_idx", "samples"), ["ffid"], "rank", "samples", (80, 96))
    return made.groupBy("ffid").agg(F.count(F.lit(1)).alias("traces"), F.max(F.size("samples")).cast("long").alias("width"), F.sum((~F.col("padding")).cast("long")).alias("real"))


@query(f"with {WAVE} select trace_idx, t, round(x, 6) as y from wave")
def pad_and_crop_back(spark, sf_dir):
    made = S.padded_section(_rows(spark, sf_dir).select("ffid", "rank", "trace_idx", "samples"), ["ffid"], "rank", "samples", (80, 96))
    return _long(S.cropped_section(made, "samples"), "samples", "trace_idx")


LOSS = f"""{WAVE}, q as (select trace_idx, ffid, t, x, exp(-0.5::double * ((t - (trace_idx * 5) % 63 - 1) / 2.0::double) ** 2) as g, exp(-0.5::double * ((t - (trace_idx * 3) % 63 - 1) / 4.0::double) ** 2) as r from wave),
n as (select *, g / sum(g) over w as qn, r / sum(r) over w as rn, x / 2 - max(x / 2) over w - ln(sum(exp(x / 2 - mx)) over w) as lp2, x - mx * 2 - ln(sum(exp(x - mx * 2)) over w) as lp1 from (select *, max(x / 2) over (partition by trace_idx) as mx from q) window w as (partition by trace_idx)),
e as (select trace_idx, any_value(ffid) as ffid, sum(qn * (ln(greatest(qn, 1.1920928955078125e-07::double)) - lp2)) as kl, -sum(rn * lp1) as ce from n group by 1)"""


def _losses(spark, sf_dir):
    from tracewell.functions.signal import gaussian, let, total

    i = F.col("trace_idx")
    unit = lambda a: let(a, lambda g: let(total(g), lambda s: F.transform(g, lambda v: v / s)))
    rows = trace_wave(spark, sf_dir).withColumn("g", gaussian((i * 5) % 63 + 1, 64, 2.0)).withColumn("r", unit(gaussian((i * 3) % 63 + 1, 64, 4.0)))
    return rows.select("trace_idx", "ffid", S.break_divergence(F.col("g"), F.col("samples"), 2.0).alias("kl"), S.prior_cross_entropy(F.col("r"), F.col("samples")).alias("ce"))


@query(f"with {LOSS} select trace_idx, round(kl, 5) as kl, round(ce, 5) as ce from e")
def trace_errors(spark, sf_dir):
    return _losses(spark, sf_dir).select("trace_idx", F.round("kl", 5).alias("kl"), F.round("ce", 5).alias("ce"))


@query(f"with {LOSS}, m as (select ffid, coalesce(avg(case when kl < ce then kl end), 0) as kl, coalesce(avg(ce), 0) as ce from e group by 1) select ffid, round(kl, 5) as kl, round(ce, 5) as ce, round(kl * 1.0::double + ce * 0.3::double, 5) as total from m")
def weighted_errors(spark, sf_dir):
    parts = [("kl", F.col("kl"), F.col("kl") < F.col("ce"), 1.0), ("ce", F.col("ce"), F.lit(True), 0.3)]
    out = S.weighted_report(_losses(spark, sf_dir), ["ffid"], parts)
    return out.select("ffid", *[F.round(c, 5).alias(c) for c in ("kl", "ce", "total")])


GATED = f"""{WINDOWS}, d as (select *, lag(fb) over (partition by file_id, ffid, start order by row) as p from win), g as (select file_id, ffid, start, avg(case when fb > 0 then 1.0 else 0.0 end) as ratio, count(case when fb > 0 and p > 0 then 1 end) as vp, quantile_cont(case when fb > 0 and p > 0 then abs(fb - p) end, 0.95) * 4.0 as p from d group by all),
w as (select file_id, ffid, start, case when ratio < 0.8 then 'min_pick' when vp < 8 or p > 1500 then 'fblc' else 'ok' end as reason from g), t as (select *, row_number() over (partition by file_id order by md5('d:' || ffid || ':' || start), ffid, start) as draw from w), b as (select *, sum(case when reason = 'ok' then 1 else 0 end) over (partition by file_id order by draw) as n from t where draw <= 40)"""


def _order():
    return [F.md5(F.concat_ws(":", F.lit("d"), "ffid", "start")), F.col("ffid"), F.col("start")]


@query(f"with {GATED} select file_id, ffid, start, draw::int as draw, n::bigint as n from b where reason = 'ok' and n <= 5")
def accepted_draws(spark, sf_dir):
    drawn = D.accepted(gate_windows(spark, sf_dir), ["file_id"], _order(), F.col("reject_reason") == "ok", 5, 40)
    return drawn.select(*GATHER, "start", "draw", "n")


@query(f"with {GATED} select file_id, reason, count(*) as n from b where n - case when reason = 'ok' then 1 else 0 end < 5 group by 1, 2")
def draw_counts(spark, sf_dir):
    return D.draw_counts(gate_windows(spark, sf_dir), ["file_id"], _order(), F.col("reject_reason"), 5, 40)


DRAWN = f"""{HDR}, d as (select file_id, i, {", ".join(f"('0x' || substr(md5('6{k}:' || file_id || ':' || i), 1, 8))::bigint / 4294967296.0::double as u{k}" for k in "kgsr")} from (select distinct file_id from hdr), (select unnest(generate_series(0, 5)) as i)),
nm as (select *, case when uk * 4 < 2 then 'ffid' when uk * 4 < 3 then 'chno' else 'cmp' end as key_name from d),
ks as (select *, row_number() over (partition by file_id, key_name order by key) - 1 as k, count(*) over (partition by file_id, key_name) as nk from (select distinct file_id, 'ffid' as key_name, ffid as key from hdr union select distinct file_id, 'chno', chno from hdr union select distinct file_id, 'cmp', cmp from hdr)),
pk as (select nm.*, key, case when us >= 0.5 or nm.key_name = 'cmp' then 'offset' when nm.key_name = 'ffid' then 'chno' else 'ffid' end as secondary from nm join ks on ks.file_id = nm.file_id and ks.key_name = nm.key_name and k = floor(ug * nk)),
mt as (select pk.*, trace_idx, row_number() over (partition by pk.file_id, i order by case secondary when 'chno' then chno when 'ffid' then ffid else offset_m::double end, trace_idx) - 1 as r, count(*) over (partition by pk.file_id, i) as n from pk join hdr on hdr.file_id = pk.file_id and case key_name when 'ffid' then ffid when 'chno' then chno else cmp end = key),
st as (select *, r - case when n >= 8 then floor(ur * (n - 7)) else 0 end as row from mt)"""


@query(f"with {DRAWN} select file_id, i, key_name, key, secondary, row::bigint as row, trace_idx, greatest(8 - n, 0) as pad from st where row between 0 and 7")
def subset_draws(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    draws = rows.select("file_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return D.subset_draws(rows, draws, ["file_id"], "i", {"ffid": 2.0, "chno": 1.0, "cmp": 1.0}, 8, "6")


SPANS = f"{HDR}, iv as (select file_id, trace_idx * 100.0::double as a, trace_idx * 100.0::double + fb % 90 as z from hdr where fb > 0 and fb % 90 > 0), sp as (select *, sum(z - a) over (partition by file_id order by a) - (z - a) as f, sum(z - a) over (partition by file_id order by a) as e, sum(z - a) over (partition by file_id) as w from iv), dr as (select file_id, k, ('0x' || substr(md5('b:' || file_id || ':' || k), 1, 8))::bigint / 4294967296.0::double as u from (select distinct file_id from hdr), (select unnest(generate_series(1, 20)) as k))"


@query(f"with {SPANS} select dr.file_id, k::int as draw, round(a + u * w - f, 4) as start from dr join sp on sp.file_id = dr.file_id and u * w >= f and u * w < e")
def background_starts(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    a = F.col("trace_idx") * 100.0
    spans = rows.where("fb > 0 and fb % 90 > 0").select("file_id", a.alias("a"), (a + F.col("fb") % 90).alias("z"))
    drawn = rows.select("file_id").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(20))))
    drawn = drawn.withColumn("u", A.uniform(F.lit("b"), F.col("file_id"), F.col("draw")))
    return D.background_starts(spans, ["file_id"], drawn).select("file_id", "draw", F.round("start", 4).alias("start"))


@query(f"with {RANKED}, k as (select file_id, ffid, avg(case when fb > 0 then 1.0 else 0.0 end) as r from ranked group by 1, 2) select r.file_id, r.ffid, trace_idx, fb > 0 as label_valid, 1.0::double as noise, 0.0::double as p from ranked r join k using (file_id, ffid) where k.r < 0.8")
def noise_windows(spark, sf_dir):
    rows = _ranked(spark, sf_dir).withColumn("trace_valid", F.col("fb") > 0)
    decision = rows.groupBy(*GATHER).agg(F.when(F.avg(F.col("trace_valid").cast("double")) < 0.8, "noise").otherwise("reject_A").alias("decision"))
    made = D.noise_windows(rows, decision, GATHER, 8)
    return made.select(*GATHER, "trace_idx", "label_valid", F.array_min("noise").alias("noise"), F.array_max("p").alias("p"))


def _line(k: int) -> str:
    det = f"(n{k} * sxx{k} - sx{k} * sx{k})"
    a = f"(case when {det} > 1e-9 then (n{k} * sxy{k} - sx{k} * sy{k}) / {det} else 0 end)"
    return f"{a} as a{k}, (case when n{k} > 0 then (sy{k} - {a} * sx{k}) / n{k} else 0 end) as b{k}"


SUMS = {"n": "1.0", "sx": "x", "sy": "y", "sxx": "x * x", "sxy": "x * y", "syy": "y * y"}


def _pieces(source: str, key: str, tag: str = "") -> str:
    """The two-piece fit of source (key, x, y), from the table r on; tag sets a second fit apart."""
    k = f"using ({key})"
    return f"""r{tag} as ({source}), sp{tag} as (select {key}, min(x) as lo, max(x) as hi from r{tag} group by {key}),
bk{tag} as (select {key}, lo, hi, j, lo + (hi - lo) * (j + 1) / 10.0::double as xb from sp{tag}, (select unnest(generate_series(0, 8)) as j)),
rb{tag} as (select r{tag}.*, least(9, floor((x - lo) / greatest(hi - lo, 1e-9::double) * 10)) as bin from r{tag} join sp{tag} {k}),
su{tag} as (select {key}, j, any_value(xb) as xb, any_value((lo + hi) / 2) as mid, {", ".join(f"sum(case when bin <= j then {e} else 0 end)::double as {c}1, sum(case when bin > j then {e} else 0 end)::double as {c}2, sum({e})::double as {c}0" for c, e in SUMS.items())} from bk{tag} join rb{tag} {k} group by {key}, j),
ln{tag} as (select *, {_line(1)}, {_line(2)}, {_line(0)} from su{tag}),
er{tag} as (select *, n1 < 3 or n2 < 3 as bad, syy1 - b1 * sy1 - a1 * sxy1 + syy2 - b2 * sy2 - a2 * sxy2 as sse from ln{tag}),
tp{tag} as (select {key}, case when bad then mid else xb end as xb, case when bad then a0 else a1 end as a1, case when bad then b0 else b1 end as b1, case when bad then a0 else a2 end as a2, case when bad then b0 else b2 end as b2, bad as single from er{tag} qualify row_number() over (partition by {key} order by bad, case when bad then 0 else sse end, j) = 1)"""


PIECES = f"{HDR}, {_pieces('select file_id, offset_m as x, fb * 0.004::double as y from hdr where fb > 0 and offset_m > 0', 'file_id')}"


@query(f"with {PIECES} select file_id, round(xb, 4) as xb, round(a1, 6) as a1, round(b1, 4) as b1, round(a2, 6) as a2, round(b2, 4) as b2, single from tp")
def two_piece_trend(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir).where("fb > 0")
    out = T.two_piece(rows, ["file_id"], F.col("offset_m"), F.col("fb") * 0.004, F.lit(1.0))
    return out.select("file_id", F.round("xb", 4).alias("xb"), rounded("a1"), F.round("b1", 4).alias("b1"), rounded("a2"), F.round("b2", 4).alias("b2"), "single")


LO, HI, EPS = "(1.0::double / 8000)", "(1.0::double / 300)", "1e-5::double"


def _projected(key: str, tag: str = "") -> str:
    return f"""cl{tag} as (select {key}, xb, b1, least(greatest(a1, {LO}), {HI}) as a1, least(greatest(a2, {LO}), {HI}) as a2 from tp{tag}),
pj{tag} as (select *, case when a1 > a2 + {EPS} or least(a2, a1 - {EPS}) >= {LO} then a1 when greatest(a1, a2 + {EPS}) <= {HI} then greatest(a1, a2 + {EPS}) else {HI} end as p1, case when a1 > a2 + {EPS} then a2 when least(a2, a1 - {EPS}) >= {LO} then least(a2, a1 - {EPS}) when greatest(a1, a2 + {EPS}) <= {HI} then a2 else {LO} end as p2 from cl{tag})"""


PROJECTED = f"{PIECES}, {_projected('file_id')}"
AT = "case when offset_m <= {t}.xb then {t}.p1 * offset_m + {t}.b1 else {t}.p2 * offset_m + ({t}.p1 * {t}.xb + {t}.b1 - {t}.p2 * {t}.xb) end"
SIDED = f"""{RANKED}, lo as (select file_id, ffid, arg_min(rank, (offset_m, rank)) as r from ranked group by 1, 2),
sg as (select file_id, trace_idx, offset_m, fb, case when offset_m = 0 then 0 when rank < r then -1 else 1 end as side from ranked join lo using (file_id, ffid)),
{_pieces("select file_id, offset_m as x, fb * 0.004::double as y from sg where fb > 0 and offset_m > 0", "file_id")}, {_projected("file_id")},
big as (select file_id, side from sg where fb > 0 and side <> 0 group by 1, 2 having count(*) >= 240),
{_pieces("select file_id, side, offset_m as x, fb * 0.004::double as y from sg join big using (file_id, side) where fb > 0 and offset_m > 0", "file_id, side", "s")}, {_projected("file_id, side", "s")}"""


@query(f"with {PROJECTED} select h.file_id, h.trace_idx, round(case when offset_m <= xb then p1 * offset_m + b1 else p2 * offset_m + (p1 * xb + b1 - p2 * xb) end, 5) as trend from hdr h join pj using (file_id)")
def projected_trend(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    coef = T.projected_slopes(T.two_piece(rows.where("fb > 0"), ["file_id"], F.col("offset_m"), F.col("fb") * 0.004, F.lit(1.0)), 300.0, 8000.0, 1e-5)
    out = rows.join(coef.select("file_id", F.struct("xb", "a1", "b1", "a2", "b2").alias("c")), "file_id")
    return out.select("file_id", "trace_idx", F.round(T.piecewise(F.col("offset_m"), F.col("c")), 5).alias("trend"))


@query(f"""with {SIDED} select sg.file_id, sg.side, pjs.xb is not null as own, count(*) as n, round(avg(case when pjs.xb is not null then {AT.format(t="pjs")} else {AT.format(t="pj")} end), 5) as trend
from sg join pj on pj.file_id = sg.file_id left join pjs on pjs.file_id = sg.file_id and pjs.side = sg.side group by 1, 2, 3""")
def global_trend(spark, sf_dir):
    """Sides of 240 picks and more have a fit of their own, the others that of all rows of the file."""
    rows = A.signed_offset(_ranked(spark, sf_dir), GATHER).withColumn("w", F.when(F.col("fb") > 0, 1.0).otherwise(0.0))
    out = T.global_trend(rows, ["file_id"], "offset_m", "signed_offset", F.col("fb") * 0.004, F.col("w"), 300.0, 8000.0, 1e-5, 240)
    return out.groupBy("file_id", F.signum("signed_offset").cast("int").alias("side"), F.col("own").alias("own")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("trend"), 5).alias("trend"))
