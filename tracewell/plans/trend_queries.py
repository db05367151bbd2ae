"""Queries of statics, robust trends, prior fusion and striped scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewell.functions.signal import entropy_confidence
from tracewell.operators import statics as R
from tracewell.plans.catalog import GATHER, query, rounded
from tracewell.plans.gather_queries import PROB, _prob
from tracewell.plans.label_queries import _long
from tracewell.plans.views import HDR, WAVE, trace_hdr, trace_wave

TILE = 32


def _tiles(spark, sf_dir):
    """Traces in tiles of 32 rows of their gather."""
    r = F.row_number().over(Window.partitionBy("ffid").orderBy("trace_idx")) - 1
    rows = trace_wave(spark, sf_dir).withColumn("r", r)
    rows = rows.withColumn("tile", F.floor(F.col("r") / TILE)).withColumn("rank", (F.col("r") % TILE).cast("long"))
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ffid", "tile")))


@query(None)
def residual_statics(spark, sf_dir):
    out = R.refine(_tiles(spark, sf_dir), ["ffid", "tile"], "trace_idx", 4, 5, 2, 0.1)
    return out.select("ffid", "tile", "trace_idx", rounded("delta_pick"), rounded("cmax"), "valid")


BY_OFFSET = f"{HDR}, o as (select *, row_number() over (partition by file_id, ffid order by offset_m, trace_idx) - 1 as rank from hdr)"
SECTIONS = f"{BY_OFFSET}, e as (select file_id, ffid, rank, offset_m as x, fb * 0.004::double as y, case when fb > 0 then 1.0::double else 0.0::double end as v, (1 + chno % 3)::double as p, unnest(generate_series(greatest(ceil((rank - 15) / 8.0), 0)::bigint, rank // 8)) * 8 as start from o), q0 as (select *, v * p as u from (select *, count(*) over (partition by file_id, ffid, start) as l, row_number() over (partition by file_id, ffid, start order by rank) - 1 as i from e) where l >= 4)"


def _round_sql(k: int) -> str:
    """One round of the weighted fit and its weights."""
    return f"""s{k} as (select file_id, ffid, start, greatest(sum(u), 1e-12) as sw, sum(u * x) as sx, sum(u * y) as sy, sum(u * x * x) as sxx, sum(u * x * y) as sxy from q{k} group by 1, 2, 3),
b{k} as (select *, (sw * sxy - sx * sy) / greatest(sw * sxx - sx * sx, 1e-12) as b from s{k}), a{k} as (select file_id, ffid, start, b, (sy - b * sx) / sw as a from b{k}),
r{k} as (select q{k}.* exclude (u), a, b, (y - a - b * x) * v as res from q{k} join a{k} using (file_id, ffid, start)), c{k} as (select file_id, ffid, start, 1.345 * greatest(1.4826 * quantile_disc(abs(res), 0.5), 1e-6) as scale from r{k} group by 1, 2, 3),
f{k} as (select r{k}.*, v * p * case when abs(res) <= scale then 1 else least(scale / abs(res), 10) end as u from r{k} join c{k} using (file_id, ffid, start)), q{k + 1} as (select * exclude (a, b, res) from f{k})"""


@query(f"""with {SECTIONS}, {", ".join(_round_sql(k) for k in range(3))}, w as (select *, (0.5 - 0.5 * cos(2 * pi() * i / (l - 1))) * v * p as t from f2)
select file_id, ffid, rank, round(sum(t * (a + b * x)) / greatest(sum(t), 1e-6), 4) as trend_t, round(sum(t * least(greatest(b, 1 / 8000.0::double), 1 / 300.0::double)) / greatest(sum(t), 1e-6), 6) as trend_s, sum(t) > 0 as covered from w group by 1, 2, 3""")
def robust_trend(spark, sf_dir):
    return _trend(R.robust_trend(_by_offset(spark, sf_dir), GATHER, 16, 8))


def _by_offset(spark, sf_dir):
    """First breaks in seconds, ranked by offset in their gather."""
    gather = Window.partitionBy(*GATHER)
    rank = (F.row_number().over(gather.orderBy("offset_m", "trace_idx")) - 1).cast("long")
    return trace_hdr(spark, sf_dir).select(*GATHER, rank.alias("rank"), F.count(F.lit(1)).over(gather).alias("n"), F.col("offset_m").alias("x"), (F.col("fb") * 0.004).alias("y"), (F.col("fb") > 0).cast("int").alias("valid"), (1 + F.col("chno") % 3).alias("w"))


def _trend(out):
    return out.select(*GATHER, "rank", F.round("trend_t", 4).alias("trend_t"), rounded("trend_s"), "covered")


def _drawn(side: int) -> str:
    return f"('0x' || substr(md5('7:' || file_id || ':' || ffid || ':' || start || ':' || k || ':{side}'), 1, 8))::bigint / 4294967296.0::double * tot"


@query(f"""with {SECTIONS}, m as (select file_id, ffid, start, quantile_disc(y, 0.5) as med from q0 group by 1, 2, 3),
h as (select file_id, ffid, start, sum(u) as tot, greatest(2 * greatest(1.4826 * quantile_disc(abs(y - med), 0.5), 1e-6), 0.015::double) as thr from q0 join m using (file_id, ffid, start) group by 1, 2, 3 having sum(u) > 0),
z as materialized (select q0.*, tot, thr, sum(u) over (partition by file_id, ffid, start order by i) as c from q0 join h using (file_id, ffid, start)),
k as (select file_id, ffid, start, k, {_drawn(1)} as d1, {_drawn(2)} as d2 from h cross join (select unnest(generate_series(0, 7)) as k)),
d as (select file_id, ffid, start, k, l, count(*) filter (where c <= d1) as i1, count(*) filter (where c <= d2) as i2 from k join z using (file_id, ffid, start) group by 1, 2, 3, 4, 5),
ends as (select file_id, ffid, start, k, i1, case when i1 = i2 then (i2 + 1) % l else i2 end as i2 from d),
lines as (select e.file_id, e.ffid, e.start, k, (g.y - f.y) / (g.x - f.x) as b, f.y - (g.y - f.y) / (g.x - f.x) * f.x as a from ends e join z f on e.file_id = f.file_id and e.ffid = f.ffid and e.start = f.start and e.i1 = f.i join z g on e.file_id = g.file_id and e.ffid = g.ffid and e.start = g.start and e.i2 = g.i where abs(g.x - f.x) >= 1e-6),
tried as (select file_id, ffid, start, k, a, b, sum(case when abs((y - a - b * x) * v) <= thr then u else 0 end) as score from lines join z using (file_id, ffid, start) group by 1, 2, 3, 4, 5, 6),
w as (select file_id, ffid, start, a, b from tried qualify row_number() over (partition by file_id, ffid, start order by score desc, k) = 1),
q1 as (select z.* exclude (u), case when abs((y - a - b * x) * v) <= thr then u else 0 end as u from z join w using (file_id, ffid, start)),
s1 as (select file_id, ffid, start, greatest(sum(u), 1e-12) as sw, sum(u * x) as sx, sum(u * y) as sy, sum(u * x * x) as sxx, sum(u * x * y) as sxy from q1 group by 1, 2, 3),
b1 as (select *, (sw * sxy - sx * sy) / greatest(sw * sxx - sx * sx, 1e-12) as b from s1), a1 as (select file_id, ffid, start, b, (sy - b * sx) / sw as a from b1),
t as (select z.*, a, b, (0.5 - 0.5 * cos(2 * pi() * i / (l - 1))) * case when abs((y - a - b * x) * v) <= thr then u else 0 end as t from z join a1 using (file_id, ffid, start))
select file_id, ffid, rank, round(sum(t * (a + b * x)) / greatest(sum(t), 1e-6), 4) as trend_t, round(sum(t * least(greatest(b, 1 / 6000.0::double), 1 / 300.0::double)) / greatest(sum(t), 1e-6), 6) as trend_s, sum(t) > 0 as covered from t group by 1, 2, 3""")
def consensus_trend(spark, sf_dir):
    return _trend(R.consensus_trend(_by_offset(spark, sf_dir), GATHER, 16, 8, "7", 8))


@query(f"""with {PROB}, c as (select trace_idx, ffid, greatest(1 + sum(case when p > 0 then p * ln(p) else 0 end) / ln(64), 0) as c from prob group by 1, 2), g as (select ffid, quantile_disc(c, 0.5) >= 0.06 as gate from c group by 1),
f as (select trace_idx, t, 40 * x as l, greatest(exp(-0.5::double * ((t * 0.004::double - offset_m / 5000.0::double) / 0.02::double) ** 2) / 64, 1e-12) as pr, gate from wave join g using (ffid))
select trace_idx, t, round(case when gate then least(greatest(least(greatest(l, -30), 30) + ln(pr), -30), 30) else least(greatest(l, -30), 30) end, 6) as y from f""")
def prior_fusion(spark, sf_dir):
    rows = _prob(spark, sf_dir).withColumn("c", entropy_confidence(F.col("prob")))
    by = rows.groupBy("ffid").agg(F.expr("percentile_disc(0.5) within group (order by c)").alias("m"))
    prior = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda t: F.exp(-0.5 * F.pow((t * 0.004 - F.col("offset_m") / 5000.0) / 0.02, 2)) / 64)
    out = rows.join(by, "ffid").withColumn("y", R.fused(F.transform("samples", lambda v: v * 40), prior, F.col("m") >= 0.06))
    return _long(out, "y", "trace_idx")


def _row_mean(x: np.ndarray) -> np.ndarray:
    """Mean of a row and its two neighbours; nothing beyond the edges."""
    z = np.pad(x, ((1, 1), (0, 0)))
    return (z[:-2] + z[1:-1] + z[2:]) / 3


@query(f"""with {WAVE}, r as (select vec_id as trace_idx, row_number() over (partition by label order by vec_id) - 1 as r from embeddings), w as (select wave.*, r // 32 as tile, r % 32 as rank from wave join r using (trace_idx))
select a.trace_idx, a.t, round(coalesce(sum(b.x), 0) / 3, 6) as y from w a left join w b on a.ffid = b.ffid and a.tile = b.tile and a.t = b.t and abs(a.rank - b.rank) = 1 and a.rank // 2 <> b.rank // 2 group by 1, 2""")
def striped_scoring(spark, sf_dir):
    rows = _tiles(spark, sf_dir)
    out = R.striped(rows, ["ffid", "tile"], 2, _row_mean).join(rows.select("ffid", "tile", "rank", "trace_idx"), ["ffid", "tile", "rank"])
    return _long(out, "samples", "trace_idx")


@query(f"""with {WAVE}, r as (select vec_id as trace_idx, row_number() over (partition by label order by vec_id) - 1 as r from embeddings), w as (select wave.*, r // 32 as tile, r % 32 as rank from wave join r using (trace_idx)),
n as (select ffid, tile, max(rank) + 1 as n from w group by 1, 2), s as (select distinct ffid, tile, n, s as start from n, lateral (select unnest(list_concat(generate_series(0, greatest(n - 16, 0), 8), [greatest(n - 16, 0)])) as s)),
c as (select w.*, n, start, rank - start as i, least(n, 16) as m from w join s using (ffid, tile) where rank between start and start + 15),
y as (select a.ffid, a.tile, a.trace_idx, a.t, a.start, a.i, a.n, a.m, coalesce(sum(b.x), 0) / 3 as y from c a left join c b on a.ffid = b.ffid and a.tile = b.tile and a.start = b.start and a.t = b.t and abs(a.i - b.i) = 1 group by all),
h as (select *, greatest(0.5 - 0.5 * cos(2 * pi() * i / greatest(m - 1, 1)), 1e-3) as h from y),
v as (select *, case when start > 0 and i < 8 then h else 1 end * case when start + m < n and i >= m - 8 then h else 1 end as w from h)
select trace_idx, t, round(sum(w * y) / sum(w), 6) as y from v group by 1, 2""")
def chunked_scoring(spark, sf_dir):
    rows = _tiles(spark, sf_dir).drop("r")
    out = R.chunked(rows, ["ffid", "tile"], 16, 8, 1, _row_mean).join(rows.select("ffid", "tile", "rank", "trace_idx"), ["ffid", "tile", "rank"])
    return out.select("trace_idx", F.col("t").cast("long").alias("t"), rounded("y"))
