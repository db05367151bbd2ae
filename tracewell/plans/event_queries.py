"""Queries of the event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import events as E
from tracewell.plans.catalog import query, rounded
from tracewell.plans.gather_queries import PROB, _prob, _ratio

SUPPORT = f"{PROB}, sm as (select ffid, t, sum(p) over (partition by trace_idx order by t rows between 1 preceding and 1 following) / 3 as m from prob), sup as (select ffid, t, avg(m) as s from sm group by 1, 2)"
PEAKS = f"""{SUPPORT}, sms as (select ffid, t, (coalesce(lag(s) over w, s) + s + coalesce(lead(s) over w, s)) / 3 as s from sup window w as (partition by ffid order by t)),
pk as (select ffid, t, s from (select *, max(s) over (partition by ffid order by t rows between 4 preceding and 4 following) as top, lag(s) over (partition by ffid order by t) as l from sms) where s >= 0.012 and s = top and (l is null or s > l))"""


def _long(spark, sf_dir):
    return _prob(spark, sf_dir).select("ffid", "trace_idx", F.posexplode("prob").alias("t", "p"))


def _peaks(spark, sf_dir):
    return E.peaks(E.support(_long(spark, sf_dir), ["ffid"], 1), ["ffid"], 0.012, 4, 3)


@query(f"with {SUPPORT} select ffid, t, round(s, 6) as support from sup")
def time_support(spark, sf_dir):
    return E.support(_long(spark, sf_dir), ["ffid"], 1).select("ffid", F.col("t").cast("long").alias("t"), F.round("s", 6).alias("support"))


@query(f"with {PEAKS} select ffid, t, round(s, 6) as s from pk")
def event_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir).select("ffid", F.col("t").cast("long").alias("t"), rounded("s"))


@query(f"""with {PEAKS}, q as (select k.ffid, k.t, trace_idx, 1 - exp(-sum(p)) as q from pk k join prob b on k.ffid = b.ffid and b.t between k.t - 2 and k.t + 5 group by 1, 2, 3)
select ffid, t, round(sum((1 + trace_idx % 3) * q) / sum(1 + trace_idx % 3), 6) as score from q group by 1, 2""")
def event_scores(spark, sf_dir):
    out = E.scores(_peaks(spark, sf_dir), _long(spark, sf_dir), ["ffid"], 2, 5, 1 + F.col("trace_idx") % 3)
    return out.select("ffid", F.col("t").cast("long").alias("t"), rounded("score"))


@query(f"""with {PROB}, b as (select *, max(p) over (partition by trace_idx) as m, lag(p) over w as a, lead(p) over w as c from prob window w as (partition by trace_idx order by t)),
k as (select trace_idx, t, p, a, c, row_number() over (partition by trace_idx order by t) as r from b where p = m)
select trace_idx, round(0.004::double * (t + coalesce(case when a - 2 * p + c < 0 then 0.5 * (a - c) / (a - 2 * p + c) end, 0)), 6) as time from k where r = 1""")
def subsample_argmax(spark, sf_dir):
    return _prob(spark, sf_dir).select("trace_idx", F.round(0.004 * E.parabolic_argmax(F.col("prob")), 6).alias("time"))


def _ratio_arrays(spark, sf_dir):
    rows = _ratio(spark, sf_dir).groupBy("ffid", "trace_idx").agg(F.sort_array(F.collect_list(F.struct("t", "ratio"))).alias("a"))
    return rows.select("ffid", "trace_idx", F.col("a.ratio").alias("ratio"))


CLUSTER = {"on": 1.5, "off": 0.8, "min_on": 2, "refractory": 10, "win": 8, "min_traces": 12}


@query(None)
def pick_cluster_event(spark, sf_dir):
    out = E.pick_clusters(_ratio_arrays(spark, sf_dir), ["ffid"], **CLUSTER)
    return out.select("ffid", F.array_max("clusters").alias("most"), "is_event", F.array_join(F.transform("counts", lambda c: c.cast("string")), ",").alias("counts"))


@query(None)
def noise_decision(spark, sf_dir):
    return E.noise_decision(_ratio_arrays(spark, sf_dir), ["ffid"], CLUSTER, {"thr": 1.5, "min_traces": 8, "min_len": 2})
