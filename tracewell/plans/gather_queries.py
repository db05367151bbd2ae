"""Queries over the given tables and their SQL, by name.

Every query applies operators of the package to the trace views of the given
tables; the SQL beside it says the same for an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import signal as S
from tracewell.operators import gates as G
from tracewell.operators import gathers as A
from tracewell.operators import series as L
from tracewell.operators import trend as T
from tracewell.plans.catalog import GATHER, query
from tracewell.plans.catalog import rounded as _r
from tracewell.plans.views import HDR, SHOT, WAVE, shots, table, trace_hdr, trace_samples, trace_wave

def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ordered(trace_hdr(spark, sf_dir), GATHER, "chno", "ffid")


RANKED = f"{HDR}, ranked as materialized (select *, row_number() over (partition by file_id, ffid order by chno, ffid, trace_idx) - 1 as rank, count(*) over (partition by file_id, ffid) as n from hdr)"
STARTS = "starts as (select distinct file_id, ffid, s as start from (select distinct file_id, ffid, n from ranked), lateral (select unnest(list_concat(generate_series(0, greatest(n - 16, 0), 8), [greatest(n - 16, 0)])) as s))"
WINDOWS = f"{RANKED}, {STARTS}, win as (select r.*, start, rank - start as row from ranked r join starts using (file_id, ffid) where rank between start and start + 15)"


@query(f"""with {WINDOWS}, d as (select *, lag(fb) over (partition by file_id, ffid, start order by row) as p from win),
g as (select file_id, ffid, start, sum(case when fb > 0 then 1 else 0 end)::bigint as n_valid, avg(case when fb > 0 then 1.0 else 0.0 end) as ratio, count(case when fb > 0 and p > 0 then 1 end) as valid_pairs, quantile_cont(case when fb > 0 and p > 0 then abs(fb - p) end, 0.95) * 4.0 as p from d group by all)
select file_id, ffid, start, n_valid, round(ratio, 6) as pick_ratio, valid_pairs, round(p, 6) as p_ms, case when ratio < 0.8 then 'min_pick' when valid_pairs < 8 or p > 1500 then 'fblc' else 'ok' end as reject_reason, not (ratio < 0.8 or valid_pairs < 8 or coalesce(p > 1500, false)) as accepted from g""")
def gate_windows(spark, sf_dir):
    rows = A.trace_windows(_ranked(spark, sf_dir), GATHER, 16, 8)
    out = G.window_gates(rows, [*GATHER, "start"], ["row"], 0.8, 8, 95, 1500, 4.0)
    return out.select(*GATHER, "start", "n_valid", _r("pick_ratio"), "valid_pairs", _r("p_ms"), "reject_reason", "accepted")


@query(f"with {WINDOWS}, d as (select *, lag(fb) over (partition by file_id, ffid, start order by row) as p from win), g as (select file_id, ffid, start, avg(case when fb > 0 then 1.0 else 0.0 end) as ratio, count(case when fb > 0 and p > 0 then 1 end) as vp, quantile_cont(case when fb > 0 and p > 0 then abs(fb - p) end, 0.95) * 4.0 as p from d group by all) select case when ratio < 0.8 then 'min_pick' when vp < 8 or p > 1500 then 'fblc' else 'ok' end as reject_reason, count(*) as windows from g group by 1")
def reject_reasons(spark, sf_dir):
    return gate_windows(spark, sf_dir).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("windows"))


@query(f"with {RANKED} select file_id, ffid, chno, trace_idx, rank from ranked")
def gather_order(spark, sf_dir):
    return _ranked(spark, sf_dir).select(*GATHER, "chno", "trace_idx", "rank")


@query(f"with {HDR} select file_id, ffid, count(*) as traces, array_to_string(list(trace_idx order by trace_idx), ',') as indices from hdr group by 1, 2")
def group_index(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir).groupBy(*GATHER).agg(F.count(F.lit(1)).alias("traces"), F.sort_array(F.collect_list("trace_idx")).alias("i"))
    return rows.select(*GATHER, "traces", F.array_join(F.transform("i", lambda x: x.cast("string")), ",").alias("indices"))


@query(f"with {HDR}, {SHOT}, sc as (select *, case shot % 3 when 0 then 0.01 when 1 then 1.0 else 10.0 end as k from shot) select ffid, round(avg(sx * k), 6) as cx, round(avg(sy * k), 6) as cy from hdr join sc on file_id = shot group by 1")
def centroids(spark, sf_dir):
    scalar = F.when(F.col("shot") % 3 == 0, -100).when(F.col("shot") % 3 == 1, 0).otherwise(10)
    k = F.when(scalar > 0, scalar.cast("double")).when(scalar < 0, 1 / F.abs(scalar)).otherwise(F.lit(1.0))
    s = shots(spark, sf_dir).withColumn("k", k)
    rows = trace_hdr(spark, sf_dir).join(s, F.col("file_id") == F.col("shot"))
    return rows.groupBy("ffid").agg(F.round(F.avg(F.expr("sx * k")), 6).alias("cx"), F.round(F.avg(F.expr("sy * k")), 6).alias("cy"))


@query(f"with {SHOT} select line, round(quantile_cont(sx, 0.5), 6) as mx, round(quantile_cont(sy, 0.5), 6) as my, count(*) as n from shot group by 1")
def shot_coordinates(spark, sf_dir):
    return shots(spark, sf_dir).groupBy("line").agg(F.round(F.percentile("sx", 0.5), 6).alias("mx"), F.round(F.percentile("sy", 0.5), 6).alias("my"), F.count(F.lit(1)).alias("n"))


@query(f"with {SHOT}, p as (select a.shot as id, b.shot as neighbour, ((a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2)::double as d2 from shot a join shot b on a.shot <> b.shot) select id, neighbour, d2, row_number() over (partition by id order by d2, neighbour) as rank from p qualify rank <= 4")
def knn_shots(spark, sf_dir):
    return A.knn(shots(spark, sf_dir).select(F.col("shot").alias("id"), F.col("sx").cast("double").alias("x"), F.col("sy").cast("double").alias("y")), 4, 700.0)


@query(f"with {HDR} select a.file_id, count(*) as pairs, sum(case when a.fb = b.fb then 1 else 0 end)::bigint as same_fb, round(avg(b.offset_m - a.offset_m), 6) as mean_step from hdr a join hdr b on a.file_id + 1 = b.file_id and a.trace_idx = b.trace_idx group by 1")
def pair_join(spark, sf_dir):
    a = trace_hdr(spark, sf_dir)
    b = a.select((F.col("file_id") - 1).alias("file_id"), "trace_idx", F.col("fb").alias("fb2"), F.col("offset_m").alias("o2"))
    return a.join(b, ["file_id", "trace_idx"]).groupBy("file_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("fb") == F.col("fb2")).cast("long")).alias("same_fb"), F.round(F.avg(F.expr("o2 - offset_m")), 6).alias("mean_step"))


@query(f"with {HDR}, c as (select file_id, count(*) as n from hdr group by 1) select a.file_id, a.n as n_input, b.n as n_target from c a join c b on a.file_id + 1 = b.file_id where a.n <> b.n")
def conformity_rejects(spark, sf_dir):
    c = trace_hdr(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_input"))
    d = c.select((F.col("file_id") - 1).alias("file_id"), F.col("n_input").alias("n_target"))
    return c.join(d, "file_id").where("n_input <> n_target")


@query(f"with {HDR} select file_id, trace_idx, fb as p_first, case when line > 2 and fb > 0 then fb + (line - 2) * 15 when fb > 0 and fb + (line - 2) * 15 >= fb then fb + (line - 2) * 15 else 0 end as s_first from hdr")
def s_before_p(spark, sf_dir):
    s = F.when(F.col("fb") > 0, F.array(F.col("fb") + (F.col("line") - 2) * 15)).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = trace_hdr(spark, sf_dir).withColumn("p", F.array("fb")).withColumn("s", s)
    first = lambda c: F.coalesce(F.array_min(F.filter(c, lambda x: x > 0)), F.lit(0)).cast("long")
    rows = rows.withColumn("p_first", first("p"))
    early = (F.col("p_first") > 0) & (first("s") < F.col("p_first"))
    return rows.select("file_id", "trace_idx", "p_first", F.when(early, F.lit(0)).otherwise(first("s")).cast("long").alias("s_first"))


@query(f"with {HDR} select file_id, trace_idx, (case when fb > 0 and fb < 400 then 1 else 0 end)::bigint as n, (sum(case when fb > 0 and fb < 400 then 1 else 0 end) over (partition by file_id order by trace_idx))::bigint as indptr from hdr")
def csr_indptr(spark, sf_dir):
    n = G.valid_pick(F.col("fb"), 400).cast("long")
    w = Window.partitionBy("file_id").orderBy("trace_idx").rowsBetween(Window.unboundedPreceding, 0)
    return trace_hdr(spark, sf_dir).withColumn("n", n).select("file_id", "trace_idx", "n", F.sum("n").over(w).alias("indptr"))


@query(f"with {HDR} select file_id, ffid, trace_idx, chno from hdr where chno between 0 and 20 or chno between 150 and 170")
def primary_ranges(spark, sf_dir):
    return trace_hdr(spark, sf_dir).where(G.in_ranges(F.col("chno"), [(0, 20), (150, 170)])).select(*GATHER, "trace_idx", "chno")


@query(f"with {HDR} select file_id, ffid, trace_idx, case when count(*) over (partition by file_id, ffid) < 30 then 0 else fb end as fb from hdr")
def low_gathers(spark, sf_dir):
    return G.drop_low_gathers(trace_hdr(spark, sf_dir), GATHER, 30).select(*GATHER, "trace_idx", "fb")


@query(f"with {HDR} select file_id, trace_idx, offset_m from hdr where abs(offset_m) between 500 and 3000")
def offset_mask(spark, sf_dir):
    return trace_hdr(spark, sf_dir).where(F.abs("offset_m").between(500, 3000)).select("file_id", "trace_idx", "offset_m")


TREND = "case when chno % 7 = 0 then null else offset_m / 12 + 3 end"
SCORED = f"{HDR}, sc as (select file_id, trace_idx, (case when fb > 0 and fb < 480 then 0 else 1 end) + (case when coalesce({TREND}, 0) > 0 then 0 else 2 end) + (case when fb > 0 and fb < 480 and coalesce({TREND}, 0) > 0 and abs(fb - round_even({TREND}, 0)) < 128 then 0 else 4 end) as bits, (chno % 100) / 100.0 as s1, (trace_idx % 50) / 50.0 as s2 from hdr)"


def _scored(spark, sf_dir):
    trend = F.when(F.col("chno") % 7 != 0, F.col("offset_m") / 12 + 3)
    rows = trace_hdr(spark, sf_dir)
    return rows.select("file_id", "trace_idx", G.base_valid_bits(F.col("fb"), trend, 480, 128).alias("bits"), ((F.col("chno") % 100) / 100.0).alias("s1"), ((F.col("trace_idx") % 50) / 50.0).alias("s2"))


@query(f"with {SCORED}, th as (select quantile_cont(s1, 0.05) as a, quantile_cont(s2, 0.05) as b from sc where bits = 0) select file_id, trace_idx, (bits + case when s1 >= a then 0 else 8 end + case when s2 >= b then 0 else 16 end)::int as reason from sc, th")
def keep_mask_global(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    th = G.thresholds(rows.where("bits = 0"), [], {"a": "s1", "b": "s2"}, 0.05)  # one row
    out = rows.join(F.broadcast(th))
    return out.select("file_id", "trace_idx", (F.col("bits") + G.score_bits([(F.col("s1"), F.col("a")), (F.col("s2"), F.col("b"))])).cast("int").alias("reason"))


@query(f"with {SCORED}, th as (select file_id, quantile_cont(s1, 0.05) as a, quantile_cont(s2, 0.05) as b from sc where bits = 0 group by 1) select file_id, trace_idx, (bits + case when s1 >= a then 0 else 8 end + case when s2 >= b then 0 else 16 end)::int as reason from sc left join th using (file_id)")
def keep_mask_per_file(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    th = G.thresholds(rows.where("bits = 0"), ["file_id"], {"a": "s1", "b": "s2"}, 0.05)
    return rows.join(th, "file_id", "left").select("file_id", "trace_idx", (F.col("bits") + G.score_bits([(F.col("s1"), F.col("a")), (F.col("s2"), F.col("b"))])).cast("int").alias("reason"))


@query(f"with {HDR}, p as (select file_id, quantile_cont(offset_m, 0.05) as lo, quantile_cont(offset_m, 0.95) as hi from hdr group by 1) select file_id, trace_idx, round(least(greatest((offset_m - lo) / greatest(1e-6, hi - lo), 0), 1), 6) as y from hdr join p using (file_id)")
def percentile_scale(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    p = rows.groupBy("file_id").agg(F.percentile("offset_m", 0.05).alias("lo"), F.percentile("offset_m", 0.95).alias("hi"))
    y = F.least(F.greatest((F.col("offset_m") - F.col("lo")) / F.greatest(F.lit(1e-6), F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return rows.join(p, "file_id").select("file_id", "trace_idx", F.round(y, 6).alias("y"))


@query(f"with {HDR}, e as (select ffid, abs(fb - (fb + (chno % 31) - 15)) as e, (fb - (fb + (chno % 31) - 15)) as d from hdr where fb > 0) select ffid, count(*) as n, round(avg(e), 6) as mean_abs, round(quantile_cont(e, 0.5), 6) as median_abs, round(sqrt(avg(d * d)), 6) as rmse, round(avg(case when e <= 5 then 1.0 else 0.0 end), 6) as within_5, round(avg(case when e <= 10 then 1.0 else 0.0 end), 6) as within_10 from e group by 1")
def pick_metrics(spark, sf_dir):
    d = F.col("fb") - (F.col("fb") + F.col("chno") % 31 - 15)
    e = trace_hdr(spark, sf_dir).where(F.col("fb") > 0).select("ffid", d.alias("d"), F.abs(d).alias("e"))
    near = lambda k: F.round(F.avg((F.col("e") <= k).cast("double")), 6)
    return e.groupBy("ffid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("e"), 6).alias("mean_abs"), F.round(F.percentile("e", 0.5), 6).alias("median_abs"), F.round(F.sqrt(F.avg(F.expr("d * d"))), 6).alias("rmse"), near(5).alias("within_5"), near(10).alias("within_10"))


@query(f"with {HDR}, m as (select ffid, chno, max(fb) as fb from hdr group by 1, 2), c as (select unnest(generate_series(0, 199)) as chno), f as (select distinct ffid from hdr) select f.ffid, array_to_string(list(coalesce(m.fb, 0) order by c.chno), ',') as picks from f cross join c left join m on m.ffid = f.ffid and m.chno = c.chno group by 1")
def fb_matrix(spark, sf_dir):
    m = trace_hdr(spark, sf_dir).groupBy("ffid", "chno").agg(F.max("fb").alias("fb"))
    row = m.groupBy("ffid").agg(F.map_from_entries(F.collect_list(F.struct("chno", "fb"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long")), lambda c: F.coalesce(F.col("m")[c], F.lit(0)).cast("string"))
    return row.select("ffid", F.array_join(dense, ",").alias("picks"))


@query(f"with {HDR}, v as (select *, case when trace_idx % 5 in (0, 3) and fb > 0 then fb end as v from hdr), b as (select *, max(case when v is not null then trace_idx end) over w1 as bi, min(case when v is not null then trace_idx end) over w2 as ai from v window w1 as (partition by file_id order by trace_idx rows unbounded preceding), w2 as (partition by file_id order by trace_idx rows between current row and unbounded following)) select b.file_id, b.trace_idx, h.fb as filled from b left join hdr h on h.file_id = b.file_id and h.trace_idx = case when bi is not null and (ai is null or b.trace_idx - bi <= ai - b.trace_idx) then bi else ai end")
def nearest_fill(spark, sf_dir):
    v = F.when((F.col("trace_idx") % 5).isin(0, 3) & (F.col("fb") > 0), F.col("fb"))
    return A.nearest_fill(trace_hdr(spark, sf_dir).withColumn("v", v), ["file_id"], "trace_idx", "v", "filled").select("file_id", "trace_idx", "filled")


EVENT_DAYS = "ev as (select user_id, date_trunc('day', ts) as day, epoch(ts) - epoch(date_trunc('day', ts)) as s from events where event_type = 'purchase')"


@query(f"with {EVENT_DAYS}, m as (select day, greatest(s - 120 - 60, 0) as a, s + 120 as z from ev), o as (select *, max(z) over (partition by day order by a, z rows between unbounded preceding and 1 preceding) as r from m), g as (select *, sum(case when r is null or a > r then 1 else 0 end) over (partition by day order by a, z rows unbounded preceding) as k from o), iv as (select day, min(a) as a, max(z) as z from g group by day, k), f as (select day, coalesce(lag(z) over (partition by day order by a), 0) as a, a as z from iv union all select day, max(z), 86340 from iv group by day) select strftime(day, '%Y-%m-%d') as day, round(a, 3) as a, round(z, 3) as z from f where z > a")
def background_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    day = F.date_trunc("day", F.col("ts"))
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(day) / 1e6
    rows = e.select(day.alias("day"), F.greatest(s - 180, F.lit(0.0)).alias("a"), (s + 120).alias("z"))
    free = A.gaps(A.merged_intervals(rows, ["day"]), ["day"], F.lit(0.0), F.lit(86340.0))
    return free.select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("a", 3).alias("a"), F.round("z", 3).alias("z"))


@query(f"with {EVENT_DAYS} select user_id, strftime(day, '%Y-%m-%d') as day, round(s - 10, 3) as a, round(s + 60, 3) as z from ev where s >= 10 and s + 60 <= 86400")
def event_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    day = F.date_trunc("day", F.col("ts"))
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(day) / 1e6
    rows = e.select("user_id", F.date_format(day, "yyyy-MM-dd").alias("day"), s.alias("s")).where("s >= 10 and s + 60 <= 86400")
    return rows.select("user_id", "day", F.round(F.col("s") - 10, 3).alias("a"), F.round(F.col("s") + 60, 3).alias("z"))


@query(f"with {WINDOWS}, f as (select file_id, ffid, start, unnest(generate_series(0, 15)) as row from starts) select f.file_id, f.ffid, f.start, f.row, coalesce(trace_idx, -1) as trace_idx, coalesce(offset_m, 0.0) as offset_m, coalesce(fb, -1) as fb, trace_idx is not null as trace_valid from f left join win using (file_id, ffid, start, row)")
def window_payload(spark, sf_dir):
    keys = [*GATHER, "start"]
    return A.padded(A.trace_windows(_ranked(spark, sf_dir), GATHER, 16, 8), keys, 16).select(*keys, "row", "trace_idx", "offset_m", "fb", "trace_valid")


@query(f"with {RANKED} select file_id, ffid, trace_idx, rank from ranked where n >= 8 and rank >= 1 and (rank - 1) % 3 = 0")
def decimation(spark, sf_dir):
    n = F.count(F.lit(1)).over(Window.partitionBy(*GATHER))
    return _ranked(spark, sf_dir).withColumn("n", n).where("n >= 8 and rank >= 1 and (rank - 1) % 3 = 0").select(*GATHER, "trace_idx", "rank")


@query(f"with {RANKED}, m as (select file_id, ffid, arg_min(rank, (offset_m, rank)) as r from ranked group by 1, 2) select file_id, ffid, trace_idx, case when rank < r then -offset_m else offset_m end as signed_offset from ranked join m using (file_id, ffid)")
def signed_offset(spark, sf_dir):
    return A.signed_offset(_ranked(spark, sf_dir), GATHER).select(*GATHER, "trace_idx", "signed_offset")


@query(f"with {HDR} select file_id, trace_idx, row_number() over (partition by file_id, trace_idx // 20 order by md5('7:' || trace_idx), trace_idx) <= 6 as noise from hdr")
def exact_noise_mix(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir)
    w = Window.partitionBy("file_id", F.floor(F.col("trace_idx") / 20)).orderBy(F.md5(F.concat_ws(":", F.lit("7"), "trace_idx")), "trace_idx")
    return rows.select("file_id", "trace_idx", (F.row_number().over(w) <= 6).alias("noise"))


@query(f"with {WAVE}, m as (select trace_idx, avg(x) as m, stddev_pop(x) as s from wave group by 1) select trace_idx, t, round((x - m) / (s + 1e-6), 6) as y from wave join m using (trace_idx)")
def standardize(spark, sf_dir):
    return trace_wave(spark, sf_dir).select("trace_idx", F.posexplode(S.standardize(F.col("samples"))).alias("t", "y")).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"))


PROB = f"{WAVE}, mx as (select trace_idx, max(x) as m from wave group by 1), ex as (select trace_idx, ffid, offset_m, t, exp(20 * (x - m)) as e from wave join mx using (trace_idx)), prob as (select trace_idx, ffid, offset_m, t, e / sum(e) over (partition by trace_idx) as p from ex)"


def _prob(spark, sf_dir):
    return trace_wave(spark, sf_dir).withColumn("prob", S.softmax(F.col("samples"), 20.0))


@query(f"with {PROB} select trace_idx, t, round(p, 6) as p from prob")
def softmax(spark, sf_dir):
    return _prob(spark, sf_dir).select("trace_idx", F.posexplode("prob").alias("t", "p")).select("trace_idx", F.col("t").cast("long").alias("t"), _r("p"))


@query(f"with {PROB}, a as (select trace_idx, max(p) as m, arg_min(t, (-p, t)) as k, greatest(1 + sum(case when p > 0 then p * ln(p) else 0 end) / ln(64), 0) as h from prob group by 1) select trace_idx, case when m < 0.1 then 0 else k end as pick, round(m, 6) as pmax, round(h, 6) as confidence from a")
def argmax_pick(spark, sf_dir):
    p = F.col("prob")
    top = F.array_max(p)
    return _prob(spark, sf_dir).select("trace_idx", F.when(top < 0.1, F.lit(0)).otherwise(S.argmax(p)).cast("long").alias("pick"), F.round(top, 6).alias("pmax"), F.round(S.entropy_confidence(p), 6).alias("confidence"))


@query(f"with {WAVE} select trace_idx, t, round(0.1 * tanh(x / 0.1), 6) as y from wave")
def soft_clip(spark, sf_dir):
    return trace_wave(spark, sf_dir).select("trace_idx", F.posexplode(S.soft_clip(F.col("samples"), 0.1)).alias("t", "y")).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"))


@query(f"with {WAVE} select trace_idx, t, round(sum(x) over (partition by trace_idx order by t rows between 2 preceding and 2 following) / 5, 6) as y from wave")
def box_smooth(spark, sf_dir):
    rows = trace_samples(spark, sf_dir)
    return rows.withColumn("y", L.box(rows, ["trace_idx"], 5)).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"))


RATIO = f"{WAVE}, ratio as (select trace_idx, ffid, t, case when avg(x * x) over (partition by trace_idx order by t rows 31 preceding) > 1e-12 then avg(x * x) over (partition by trace_idx order by t rows 3 preceding) / avg(x * x) over (partition by trace_idx order by t rows 31 preceding) else 0 end as ratio from wave)"


def _ratio(spark, sf_dir):
    rows = trace_samples(spark, sf_dir)
    return rows.withColumn("ratio", L.sta_lta(rows, ["trace_idx"], 4, 32)).withColumn("t", F.col("t").cast("long"))


@query(f"with {RATIO} select trace_idx, t, round(ratio, 6) as ratio from ratio")
def sta_lta(spark, sf_dir):
    return _ratio(spark, sf_dir).select("trace_idx", "t", _r("ratio"))


@query(f"with {RATIO}, c as (select ffid, t, sum(case when ratio >= 1.5 then 1 else 0 end) as n from ratio group by 1, 2), o as (select ffid, t, t - row_number() over (partition by ffid order by t) as g from c where n >= 8) select ffid, min(t) as start, count(*) as length from o group by ffid, g having count(*) >= 2")
def majority_event(spark, sf_dir):
    return L.majority_event(_ratio(spark, sf_dir), ["ffid"], 1.5, 8, 2)


@query(None)
def hysteresis_trigger(spark, sf_dir):
    rows = _ratio(spark, sf_dir).groupBy("trace_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "ratio"))), lambda x: x["ratio"]).alias("a"))
    return rows.select("trace_idx", S.hysteresis(F.col("a"), 1.5, 0.8, 2, 10).alias("hits"))


@query(f"with {WAVE} select trace_idx, t, round(x * least(1.0 / (sqrt(avg(x * x) over (partition by trace_idx order by t rows 15 preceding)) + 1e-6), 50.0), 6) as y from wave")
def agc_causal(spark, sf_dir):
    rows = trace_samples(spark, sf_dir)
    return rows.withColumn("y", L.agc(rows, ["trace_idx"], 16, 1.0, 1e-6, 50.0)).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"))


@query(f"with {PROB} select trace_idx, t, round(1 - exp(-sum(p) over (partition by trace_idx order by t rows between 2 preceding and 2 following)), 6) as y from prob")
def local_event_probability(spark, sf_dir):
    rows = _prob(spark, sf_dir).select("trace_idx", F.posexplode("prob").alias("t", "p"))
    return rows.withColumn("y", L.event_probability(rows, ["trace_idx"], 2)).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"))


@query(f"with {PROB}, a as (select trace_idx, arg_min(t, (-p, t)) as k from prob group by 1), i as (select trace_idx, k, unnest(generate_series(-4, 7)) as o from a) select i.trace_idx, o + 4 as t, round(coalesce(x, 0.0), 6) as y from i left join wave w on w.trace_idx = i.trace_idx and w.t = k + o")
def pick_window(spark, sf_dir):
    rows = _prob(spark, sf_dir).withColumn("at", S.argmax(F.col("prob")))
    return rows.select("trace_idx", F.posexplode(S.aligned(F.col("samples"), F.col("at"), 4, 8)).alias("t", "y")).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"))


@query(f"with {WAVE}, s as (select *, (trace_idx % 9) / 4.0 - 1 as s from wave), i as (select trace_idx, t, floor(t - s)::bigint as i, t - s - floor(t - s) as w from s) select i.trace_idx, i.t, round(coalesce(case when w = 0 then a.x else a.x * (1 - w) + b.x * w end, 0.0), 6) as y from i left join wave a on a.trace_idx = i.trace_idx and a.t = i.i left join wave b on b.trace_idx = i.trace_idx and b.t = i.i + 1")
def fractional_shift(spark, sf_dir):
    rows = trace_wave(spark, sf_dir).withColumn("s", (F.col("trace_idx") % 9) / 4.0 - 1)
    return rows.select("trace_idx", F.posexplode(S.shifted(F.col("samples"), F.col("s"))).alias("t", "y")).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"))


@query(f"with {HDR} select file_id, trace_idx, round(case when fb > 0 then fb - abs(offset_m - 100) / 2000 / 0.004 end, 6) as pick from hdr")
def moveout_picks(spark, sf_dir):
    pick = F.when(F.col("fb") > 0, T.moveout(F.col("fb"), F.col("offset_m"), 100.0, 2000.0, 0.004))
    return trace_hdr(spark, sf_dir).select("file_id", "trace_idx", F.round(pick, 6).alias("pick"))


@query(f"with {HDR}, w as (select file_id, ffid, sum(w) as sw, sum(w * x) as sx, sum(w * y) as sy, sum(w * x * x) as sxx, sum(w * x * y) as sxy from (select file_id, ffid, offset_m as x, fb * 0.004 as y, (1 + chno % 5)::double as w from hdr where fb > 0) group by 1, 2), s as (select *, case when sw * sxx - sx * sx > 1e-9 then (sw * sxy - sx * sy) / (sw * sxx - sx * sx) else 0 end as slope from w) select file_id, ffid, round(slope, 6) as slope, round((sy - slope * sx) / sw, 5) as intercept from s")
def weighted_line(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir).where("fb > 0")
    out = T.weighted_line(rows, GATHER, F.col("offset_m"), F.col("fb") * 0.004, 1 + F.col("chno") % 5)
    return out.select(*GATHER, F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query(f"with {HDR}, d as (select file_id, ffid, trace_idx, fb * 0.004 as tm, coalesce(lag(fb * 0.004) over w - fb * 0.004 > 0.1, false) as d, row_number() over w as i from hdr window w as (partition by file_id, ffid order by abs(offset_m), trace_idx)), g as (select *, i - row_number() over (partition by file_id, ffid, d order by i) as g from d) select file_id, ffid, trace_idx, d and count(*) over (partition by file_id, ffid, d, g) >= 2 as inverted from g")
def velocity_inversion(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir).withColumn("time", F.col("fb") * 0.004)
    return T.inversions(rows, GATHER, 0.1, 2).select(*GATHER, "trace_idx", "inverted")


@query(f"with {HDR} select file_id, trace_idx, max(case when fb = 0 then 1 else 0 end) over (partition by file_id order by trace_idx rows between 2 preceding and 2 following) = 1 as masked from hdr")
def mask_dilation(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir).withColumn("m", F.col("fb") == 0)
    return rows.withColumn("masked", T.dilated(rows, ["file_id"], "m", 2)).select("file_id", "trace_idx", "masked")


@query(f"with {HDR}, v as (select file_id, trace_idx, case when trace_idx % 5 in (0, 3) and fb > 0 then fb end as v from hdr), b as (select *, max(case when v is not null then trace_idx end) over (partition by file_id order by trace_idx rows unbounded preceding) as bi, min(case when v is not null then trace_idx end) over (partition by file_id order by trace_idx rows between current row and unbounded following) as ai from v) select b.file_id, b.trace_idx, round(case when b.v is not null then b.v when y.v >= x.v then x.v + (b.trace_idx - bi) / (ai - bi) * (y.v - x.v) end, 6) as filled from b left join v x on x.file_id = b.file_id and x.trace_idx = bi left join v y on y.file_id = b.file_id and y.trace_idx = ai")
def gap_interpolation(spark, sf_dir):
    v = F.when((F.col("trace_idx") % 5).isin(0, 3) & (F.col("fb") > 0), F.col("fb").cast("double"))
    rows = trace_hdr(spark, sf_dir).withColumn("v", v).withColumn("rank", F.col("trace_idx"))
    return rows.withColumn("filled", T.filled_gaps(rows, ["file_id"], "v")).select("file_id", "trace_idx", _r("filled"))


@query(f"with {PROB} select trace_idx, t, round(case when t * 0.004::double >= offset_m / 4500.0::double - 0.02::double and t * 0.004::double <= offset_m / 1500.0::double + 0.02::double then p else 0 end, 6) as p from prob")
def velocity_cone(spark, sf_dir):
    rows = _prob(spark, sf_dir).select("trace_idx", "offset_m", F.posexplode("prob").alias("t", "p"))
    inside = T.cone(F.col("t") * 0.004, F.col("offset_m"), 1500.0, 4500.0, -0.02, 0.02)
    return rows.select("trace_idx", F.col("t").cast("long").alias("t"), F.round(F.when(inside, F.col("p")).otherwise(0.0), 6).alias("p"))


@query(f"with {HDR}, r as (select file_id, trace_idx, fb - offset_m / 20 as r from hdr), w as (select *, count(r) over v as n, sum(r) over v as s, sum(r * r) over v as q from r window v as (partition by file_id order by trace_idx rows between 4 preceding and 4 following)) select file_id, trace_idx, round(case when n >= 6 then exp(-greatest(q / n - (s / n) * (s / n), 0) / 40000) else 0 end, 6) as confidence from w")
def residual_confidence(spark, sf_dir):
    rows = trace_hdr(spark, sf_dir).withColumn("r", F.col("fb") - F.col("offset_m") / 20)
    return rows.withColumn("confidence", L.residual_confidence(rows, ["file_id"], 4, 200.0, 6)).select("file_id", "trace_idx", _r("confidence"))


@query(f"with {WAVE}, s as (select unnest([0, 16, 32, 40]) as tile), y as (select trace_idx, t, x * (1 + tile / 100.0::double) + t - tile as y, greatest(0.5::double - 0.5::double * cos(2 * pi() * (t - tile) / 23), 1e-3::double) as w from wave join s on t >= tile and t < tile + 24) select trace_idx, t, round(sum(w * y) / sum(w), 6) as y, count(*) as tiles from y group by trace_idx, t")
def tile_blend(spark, sf_dir):
    """A score that differs by tile, so that the weights of the blend show."""
    rows = L.tiled(trace_samples(spark, sf_dir), F.lit(64).cast("long"), 24, 8).withColumn("y", F.expr("x * (1 + tile / 100.0D) + t - tile"))
    return L.blended(rows, ["trace_idx"], 24).select("trace_idx", F.col("t").cast("long").alias("t"), _r("y"), "tiles")


@query(f"with {WAVE}, e as (select ffid, s, avg(abs(a.x - b.x)) as e from wave a join (select trace_idx, t as t2, x from wave) b using (trace_idx), (select unnest(generate_series(-3, 3)) as s) where b.t2 = a.t + s + 1 group by 1, 2) select ffid, round(min(e), 6) as loss from e group by 1")
def shift_robust_l1(spark, sf_dir):
    a = trace_wave(spark, sf_dir)
    rows = a.select("ffid", "samples", F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("s"))
    n, k = F.size("samples"), F.col("s") + 1
    x = F.when(k >= 0, F.slice("samples", F.lit(1), n - k)).otherwise(F.slice("samples", 1 - k, n + k))
    y = F.when(k >= 0, F.slice("samples", k + 1, n - k)).otherwise(F.slice("samples", F.lit(1), n + k))
    err = S.total(F.zip_with(x, y, lambda u, v: F.abs(u - v)))
    by = rows.select("ffid", "s", err.alias("e"), F.size(x).alias("n")).groupBy("ffid", "s").agg((F.sum("e") / F.sum("n")).alias("e"))
    return by.groupBy("ffid").agg(F.round(F.min("e"), 6).alias("loss"))


@query(f"with {HDR}, g as (select file_id, ffid, count(*) as n, dense_rank() over (partition by file_id order by ffid) as r from hdr group by 1, 2) select a.file_id, a.ffid, sum(b.n)::bigint as traces, count(*) as gathers from g a join g b on a.file_id = b.file_id and abs(a.r - b.r) <= 1 group by 1, 2")
def superwindow(spark, sf_dir):
    g = trace_hdr(spark, sf_dir).groupBy(*GATHER).agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.dense_rank().over(Window.partitionBy("file_id").orderBy("ffid")))
    near = g.select(*GATHER, F.explode(F.array(F.col("r") - 1, F.col("r"), F.col("r") + 1)).alias("r"))
    return near.join(g.select("file_id", "r", "n"), ["file_id", "r"]).groupBy(*GATHER).agg(F.sum("n").alias("traces"), F.count(F.lit(1)).alias("gathers"))


@query(f"with {HDR}, n as (select file_id, count(*) as n from hdr group by 1), d as (select file_id, n, unnest(generate_series(0, 3)) as i from n), u as (select *, ('0x' || substr(md5('11:' || file_id || ':' || i), 1, 8))::bigint / 4294967296.0 as u from d) select file_id, i, floor(u * n)::bigint as trace_idx, round(u, 6) as u from u")
def random_draws(spark, sf_dir):
    n = trace_hdr(spark, sf_dir).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    d = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("u", A.uniform(F.lit("11"), F.col("file_id"), F.col("i")))
    return d.select("file_id", "i", F.floor(F.expr("u * n")).cast("long").alias("trace_idx"), _r("u"))


@query(f"with {RANKED}, v as (select *, row_number() over (partition by file_id, ffid order by rank) as k, count(*) over (partition by file_id, ffid) as m, lead(fb) over (partition by file_id, ffid order by rank) as nx, lag(fb) over (partition by file_id, ffid order by rank) as pv from ranked where fb > 0) select file_id, ffid, trace_idx, case when k = 1 and abs(fb - nx) >= 100 then nx when k = m and abs(fb - pv) >= 100 then pv else fb end as fb from v")
def edge_pick_repair(spark, sf_dir):
    w = Window.partitionBy(*GATHER).orderBy("rank")
    rows = _ranked(spark, sf_dir).where("fb > 0").select("*", F.row_number().over(w).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(*GATHER)).alias("m"), F.lead("fb").over(w).alias("nx"), F.lag("fb").over(w).alias("pv"))
    fb = F.when((F.col("k") == 1) & (F.abs(F.expr("fb - nx")) >= 100), F.col("nx")).when((F.col("k") == F.col("m")) & (F.abs(F.expr("fb - pv")) >= 100), F.col("pv")).otherwise(F.col("fb"))
    return rows.select(*GATHER, "trace_idx", fb.alias("fb"))


@query(f"with {HDR}, s as (select file_id, trace_idx, fb, chno + 64 as start from hdr) select file_id, trace_idx, (case when fb > 0 and round_even(start + fb / 2, 0) between 1 and 255 then round_even(start + fb / 2, 0) else 0 end)::bigint as raw_pick, case when fb > 0 and fb % 3 > 0 then (fb - start) * 2 end as window_pick from s")
def pick_mapping(spark, sf_dir):
    s = trace_hdr(spark, sf_dir).withColumn("start", F.col("chno") + 64)
    raw = F.rint(F.col("start") + F.col("fb") / 2)
    return s.select("file_id", "trace_idx", F.when((F.col("fb") > 0) & raw.between(1, 255), raw).otherwise(0).cast("long").alias("raw_pick"), F.when((F.col("fb") > 0) & (F.col("fb") % 3 > 0), (F.col("fb") - F.col("start")) * 2).alias("window_pick"))


@query(f"with {HDR}, c as (select file_id, trace_idx, fb, fb + line as fb2, (chno % 10) / 10.0 as c1, (trace_idx % 10) / 10.0 as c2 from hdr) select file_id, trace_idx, case when greatest(c1, c2) < 0.2 then 0 when c2 >= c1 then fb2 else fb end as pick from c")
def confidence_select(spark, sf_dir):
    c1, c2 = (F.col("chno") % 10) / 10.0, (F.col("trace_idx") % 10) / 10.0
    pick = F.when(F.greatest(c1, c2) < 0.2, F.lit(0)).when(c2 >= c1, F.col("fb") + F.col("line")).otherwise(F.col("fb"))
    return trace_hdr(spark, sf_dir).select("file_id", "trace_idx", pick.cast("long").alias("pick"))


@query(f"with {WAVE}, g as (select trace_idx, t, case when trace_idx % 5 = 0 then 1.0::double else exp(-0.5::double * ((t * 0.004::double - offset_m / 5000.0::double) / 0.02::double) ** 2) end as g from wave) select trace_idx, t, round(g / sum(g) over (partition by trace_idx), 6) as prior from g")
def trend_prior(spark, sf_dir):
    g = F.when(F.col("trace_idx") % 5 == 0, F.lit(1.0)).otherwise(F.exp(-0.5 * ((F.col("t") * 0.004 - F.col("offset_m") / 5000.0) / 0.02) ** 2))
    rows = trace_samples(spark, sf_dir).withColumn("g", g)
    return rows.select("trace_idx", F.col("t").cast("long").alias("t"), F.round(F.col("g") / F.sum("g").over(Window.partitionBy("trace_idx")), 6).alias("prior"))


@query(f"with {WAVE}, e as (select ffid, x - coalesce(lag(x) over (partition by trace_idx order by t), 0) as d from wave) select ffid, round(avg(abs(d)), 6) as l1, round(avg(d * d), 6) as l2, round(avg(case when abs(d) <= 0.1 then 0.5 * d * d else 0.1 * (abs(d) - 0.05) end), 6) as huber from e group by 1")
def regression_errors(spark, sf_dir):
    prior = F.coalesce(F.lag("x").over(Window.partitionBy("trace_idx").orderBy("t")), F.lit(0.0))
    e = trace_samples(spark, sf_dir).select("ffid", (F.col("x") - prior).alias("d"))
    huber = F.when(F.abs("d") <= 0.1, 0.5 * F.col("d") * F.col("d")).otherwise(0.1 * (F.abs("d") - 0.05))
    return e.groupBy("ffid").agg(F.round(F.avg(F.abs("d")), 6).alias("l1"), F.round(F.avg(F.expr("d * d")), 6).alias("l2"), F.round(F.avg(huber), 6).alias("huber"))


@query(f"with {PROB}, y as (select trace_idx, ffid, p, exp(-0.5::double * ((t - trace_idx % 64) / 3.0::double) ** 2) as g from prob), n as (select trace_idx, ffid, p, g / sum(g) over (partition by trace_idx) as g from y), c as (select trace_idx, ffid, -sum(g * ln(greatest(p, 1e-12::double))) as ce from n group by 1, 2) select ffid, round(avg(ce), 5) as ce, count(*) as traces from c group by 1")
def soft_label_ce(spark, sf_dir):
    y = _prob(spark, sf_dir).withColumn("g", S.gaussian(F.col("trace_idx") % 64 + 1, 65, 3.0))
    g = S.let(F.slice("g", F.lit(2), F.lit(64)), lambda a: S.let(S.total(a), lambda s: F.transform(a, lambda v: v / s)))
    ce = -S.total(F.zip_with(g, "prob", lambda u, p: u * F.log(F.greatest(p, F.lit(1e-12)))))
    return y.select("ffid", ce.alias("ce")).groupBy("ffid").agg(F.round(F.avg("ce"), 5).alias("ce"), F.count(F.lit(1)).alias("traces"))


NEAR = f"{WAVE}, r as (select trace_idx, ffid, row_number() over (partition by ffid order by trace_idx) as r from (select distinct trace_idx, ffid from wave)), w as (select wave.*, r.r from wave join r using (trace_idx, ffid))"


def _neighbours(spark, sf_dir, steps):
    """Each trace beside its gather neighbours at the given rank steps."""
    rows = trace_wave(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("ffid").orderBy("trace_idx")))
    want = rows.select("trace_idx", "ffid", "samples", F.explode(F.array(*[F.col("r") + k for k in steps])).alias("r"))
    return want.join(rows.select("ffid", "r", F.col("samples").alias("other")), ["ffid", "r"])


@query(f"with {NEAR} select a.trace_idx, a.t, round(quantile_cont(b.x, 0.5), 6) as y from w a join w b on a.ffid = b.ffid and a.t = b.t and abs(a.r - b.r) between 1 and 2 group by 1, 2")
def reference_trace(spark, sf_dir):
    near = _neighbours(spark, sf_dir, (-2, -1, 1, 2)).select("trace_idx", F.posexplode("other").alias("t", "x"))
    return near.groupBy("trace_idx", "t").agg(F.round(F.percentile("x", 0.5), 6).alias("y")).select("trace_idx", F.col("t").cast("long").alias("t"), "y")


@query(f"with {NEAR}, l as (select unnest(generate_series(-4, 4)) as lag), p as (select a.trace_idx, lag, sum(a.x * b.x) / greatest(sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 1e-12) as c from w a join w b on a.ffid = b.ffid and b.r = a.r + 1 join l on b.t = a.t + lag group by 1, 2) select trace_idx, arg_max(lag, (round(c, 9), -abs(lag), lag)) as lag, round(max(c), 6) as c from p group by 1")
def lag_correlation(spark, sf_dir):
    rows = _neighbours(spark, sf_dir, (1,)).select("trace_idx", "samples", "other", F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("lag"))
    n, k = F.size("samples"), F.col("lag")
    x = F.when(k >= 0, F.slice("samples", F.lit(1), n - k)).otherwise(F.slice("samples", 1 - k, n + k))
    y = F.when(k >= 0, F.slice("other", k + 1, n - k)).otherwise(F.slice("other", F.lit(1), n + k))
    dot = lambda a, b: S.total(F.zip_with(a, b, lambda u, v: u * v))
    c = dot(x, y) / F.greatest(F.sqrt(dot(x, x) * dot(y, y)), F.lit(1e-12))
    best = rows.select("trace_idx", "lag", c.alias("c")).groupBy("trace_idx").agg(F.max_by("lag", F.struct(F.round("c", 9), -F.abs("lag"), "lag")).alias("lag"), F.max("c").alias("c"))
    return best.select("trace_idx", F.col("lag").cast("long").alias("lag"), _r("c"))


@query(f"with {RANKED}, m as (select file_id, ffid, arg_min(rank, (offset_m, rank)) as r from ranked group by 1, 2), s as (select r.file_id, case when rank < m.r then 'left' else 'right' end as side, offset_m as x, fb * 0.004::double as y from ranked r join m using (file_id, ffid) where fb > 0), w as (select file_id, side, count(*)::double as sw, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from s group by 1, 2), f as (select *, case when sw * sxx - sx * sx > 1e-9 then (sw * sxy - sx * sy) / (sw * sxx - sx * sx) else 0 end as slope from w) select file_id, side, round(slope, 6) as slope, round((sy - slope * sx) / sw, 5) as intercept from f")
def side_lines(spark, sf_dir):
    rows = A.signed_offset(_ranked(spark, sf_dir), GATHER).where("fb > 0").withColumn("side", F.when(F.col("signed_offset") < 0, "left").otherwise("right"))
    out = T.weighted_line(rows, ["file_id", "side"], F.col("offset_m"), F.col("fb") * 0.004, F.lit(1.0))
    return out.select("file_id", "side", _r("slope"), F.round("intercept", 5).alias("intercept"))
