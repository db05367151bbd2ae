"""Queries of the assembled trend."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import assembly
from tracewell.operators.gathers import signed_offset
from tracewell.plans.catalog import GATHER, query, rounded
from tracewell.plans.gather_queries import RANKED, _ranked

KNOBS = assembly.AssemblyKnobs(n_samples=512, diff_th=60.0, inv_drop=10.0, inv_steps=2, discard_radius=1, dt=0.004, sigma_ms=400.0, var_half=4, var_sigma_ms=600.0, var_least=3)

LAID = f"""{RANKED}, lo as (select file_id, ffid, arg_min(rank, (offset_m, rank)) as r from ranked group by 1, 2),
a as (select file_id, ffid, trace_idx, fb, case when chno % 41 = 0 then null when rank < r then -offset_m else offset_m end as signed,
 case when chno % 6 > 0 and fb > 0 then least(fb, 511)::double end as l, case when line % 4 > 0 then least(60 + offset_m / 25.0::double, 511) end as g from ranked join lo using (file_id, ffid)),
b as (select *, sign(signed) as side, last_value(case when g is not null then trace_idx end ignore nulls) over up as gb, first_value(case when g is not null then trace_idx end ignore nulls) over down as ga,
 last_value(g ignore nulls) over up as vb, first_value(g ignore nulls) over down as va from a
 window up as (partition by file_id, ffid order by trace_idx rows unbounded preceding), down as (partition by file_id, ffid order by trace_idx rows between current row and unbounded following)),
c as (select *, case when gb is not null and (ga is null or trace_idx - gb <= ga - trace_idx) then vb else va end as tg from b),
v as (select file_id, ffid, side, trace_idx, l, row_number() over (partition by file_id, ffid, side order by abs(signed), trace_idx) as k from c where l is not null and side <> 0),
f as (select distinct x.file_id, x.ffid, x.side from v x join v y on y.file_id = x.file_id and y.ffid = x.ffid and y.side = x.side and y.k = x.k + 1 join v z on z.file_id = x.file_id and z.ffid = x.ffid and z.side = x.side and z.k = x.k + 2 where y.l < x.l - 10 and z.l < y.l - 10),
d as (select c.*, f.side is not null and l is not null and abs(tg - l) >= 60 as seed from c left join f on f.file_id = c.file_id and f.ffid = c.ffid and f.side = c.side),
e as (select *, coalesce(max(coalesce(seed, false)::int) over (partition by file_id, ffid order by trace_idx rows between 1 preceding and 1 following), 0) = 1 as discarded from d),
h as (select *, row_number() over (partition by file_id, ffid, side order by abs(signed), trace_idx) as pos, case when not discarded then l end as kept from e),
i as (select *, max(case when kept is not null then pos end) over (partition by file_id, ffid, side order by pos rows between unbounded preceding and 1 preceding) as pb, min(case when kept is not null then pos end) over (partition by file_id, ffid, side order by pos rows between 1 following and unbounded following) as pa from h),
j as (select i.*, p.kept as kb, q.kept as ka from i left join h p on p.file_id = i.file_id and p.ffid = i.ffid and p.side = i.side and p.pos = pb left join h q on q.file_id = i.file_id and q.ffid = i.ffid and q.side = i.side and q.pos = pa),
t as (select *, case when kept is not null or side = 0 then 'local' when side is not null and kb <= ka then 'between' else 'global' end as source from j),
u as (select *, case source when 'local' then l when 'between' then kb + (pos - pb) / (pa - pb)::double * (ka - kb) else tg end as ti from t)"""


def _laid(spark, sf_dir):
    rows = signed_offset(_ranked(spark, sf_dir), GATHER).withColumn("signed", F.when(F.col("chno") % 41 > 0, F.col("signed_offset").cast("double")))
    local = F.when((F.col("chno") % 6 > 0) & (F.col("fb") > 0), F.col("fb").cast("double"))
    return rows.withColumn("local", local).withColumn("whole", F.when(F.col("line") % 4 > 0, 60 + F.col("offset_m").cast("double") / 25.0))


@query(f"with {LAID} select file_id, ffid, trace_idx, discarded, g is null and tg is not null as global_filled, source, round(ti, 6) as trend_i from u")
def trend_assembly(spark, sf_dir):
    """Every branch is taken: discarded, drawn between, global by the nearest trace, falling ends, no distance."""
    out = assembly.assembled(_laid(spark, sf_dir), GATHER, "local", "whole", KNOBS)
    return out.select(*GATHER, "trace_idx", "discarded", "global_filled", "source", rounded("trend_i"))


@query(f"""with {LAID}, w as (select file_id, trace_idx, case when fb > 0 and fb < 512 and ti > 0 then (fb - ti) * 0.004::double end as r from u),
x as (select *, count(r) over k as n, sum(r) over k as s, sum(r * r) over k as q from w window k as (partition by file_id order by trace_idx rows between 4 preceding and 4 following))
select file_id, trace_idx, round(case when r is null or n < 3 then 0 else exp(-((r / 0.4::double) ** 2)) * exp(-greatest(q / n - (s / n) ** 2, 0) / 0.36::double) end, 6) as conf_trend from x""")
def trend_confidence(spark, sf_dir):
    rows = assembly.assembled(_laid(spark, sf_dir), GATHER, "local", "whole", KNOBS)
    return assembly.trend_confidence(rows, ["file_id"], "fb", "trend_i", KNOBS).select("file_id", "trace_idx", rounded("conf_trend"))
