"""Queries over shots and receivers: azimuth bins, superwindows by centroid, days of recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import azimuth, superwindows
from tracewell.plans.catalog import GATHER, query, rounded
from tracewell.plans.views import HDR, SHOT, shots, table, trace_hdr
from tracewell.sources import dayarrays

KNOBS = azimuth.AzimuthKnobs(bins=36, width=3, prominence=0.005, apart=3, rows_a_bin=200)


def _seen(spark, sf_dir):
    """Traces with the line of their shot and the azimuth from shot to receiver."""
    s = shots(spark, sf_dir).select(F.col("shot").alias("file_id"), F.col("line").alias("shot_line"), "sx", "sy")
    rows = trace_hdr(spark, sf_dir).join(s, "file_id")
    angle = F.degrees(F.atan2(F.col("cmp") * 200.0 - F.col("sy"), F.col("chno") * 50.0 - F.col("sx")))
    return rows.select("shot_line", "file_id", "trace_idx", angle.alias("azimuth"))


@query(None)
def azimuth_bins(spark, sf_dir):
    rows = azimuth.azimuth_labels(_seen(spark, sf_dir), ["shot_line"], F.col("azimuth"), KNOBS)
    return rows.select("shot_line", "file_id", "trace_idx", "azimuth_bin")


@query(None)
def azimuth_bin_cuts(spark, sf_dir):
    rows = azimuth.azimuth_cuts(_seen(spark, sf_dir), ["shot_line"], F.col("azimuth"), KNOBS)
    return rows.select("shot_line", "rows", rounded("origin"), F.array_join(F.transform("cuts", lambda c: c.cast("string")), ",").alias("cuts"), "fallback")


@query(f"""with {HDR}, {SHOT}, held as (select distinct line, ffid, file_id from hdr), near as (
 select a.shot as key, b.shot as member, row_number() over (partition by a.shot order by a.shot <> b.shot, (a.sx - b.sx) ** 2 + (a.sy - b.sy) ** 2, b.shot) as k from shot a join shot b on a.sx >= 2000 and b.sx >= 2000 qualify k <= 5),
keys as (select line, file_id as key, dense_rank() over (partition by line order by file_id) as r from (select distinct line, file_id from hdr)),
placed as (select k.line, k.key, n.member, 'centroid' as way from keys k join near n using (key) join keys h on h.line = k.line and h.key = n.member),
plain as (select a.line, a.key, b.key as member, 'rank' as way from keys a join keys b on a.line = b.line and abs(a.r - b.r) <= 2 where a.key not in (select shot from shot where sx >= 2000))
select * from placed union all select * from plain""")
def superwindow_centroid(spark, sf_dir):
    """Shots west of the mapped area (sx under 2000) have no centroid and go by rank."""
    gathers = trace_hdr(spark, sf_dir).select("line", F.col("file_id").alias("key"))
    points = shots(spark, sf_dir).where("sx >= 2000").select(F.col("shot").alias("key"), F.col("sx").alias("x"), F.col("sy").alias("y"))
    return superwindows.superwindow(gathers, ["line"], "key", points, 2, 700.0).withColumnRenamed("by", "way")


@query("""with d as (select distinct cast(o_orderdate as date) as day from orders)
select 'JST_' || strftime(day, '%Y%m%d') || '_100Hz_pad30s.npy' as name, strftime(day::timestamp - interval 9 hour - interval 30 second, '%Y-%m-%d %H:%M:%S') as first, strftime(day::timestamp + interval 15 hour + interval 30 second, '%Y-%m-%d %H:%M:%S') as last,
 round((9 * 3600 + 30 + day_of_year) * 100, 0)::bigint as noon from (select *, dayofyear(day) as day_of_year from d)""")
def day_files(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    lo, hi = dayarrays.day_bounds(F.col("day"), 30)
    instant = F.col("day").cast("timestamp") + F.make_interval(secs=F.dayofyear("day"))
    style = "yyyy-MM-dd HH:mm:ss"
    return days.select(dayarrays.day_name(F.col("day"), 100, 30).alias("name"), F.date_format(lo, style).alias("first"), F.date_format(hi, style).alias("last"), dayarrays.sample_of(instant, F.col("day"), 100, 30).alias("noon"))
